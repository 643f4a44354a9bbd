"""A hot key holding a third of all rows: results stay exact and whole."""

import contextlib
import io as _io
import random

from pyspark.sql import functions as F

from promptforge.operators import merge, sampling, scores, select


def _explain(df):
    buf = _io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_hot_prompt_dedup_and_best_of(spark):
    rnd = random.Random(7)
    n = 30000
    rows = []
    for i in range(n):
        prompt = "hot" if i % 3 == 0 else f"p{i}"
        rows.append((prompt, rnd.randint(0, 1), rnd.randint(0, 9), i, rnd.random()))
    df = spark.createDataFrame(rows, "original_prompt string, source_rank int, process int, row_index long, score double") \
        .repartition(12)
    first = merge.dedup_keep_first(df, "original_prompt", ["source_rank", "process", "row_index"])
    exp_hot = min((r for r in rows if r[0] == "hot"), key=lambda r: (r[1], r[2], r[3]))
    got = {r.original_prompt: r.row_index for r in first.collect()}
    assert len(got) == 1 + (n - n // 3) and got["hot"] == exp_hot[3]
    assert "partial_min(struct(" in _explain(first).replace(" ", "")

    cands = spark.createDataFrame([(1 if i % 3 == 0 else i, i % 10, i // 10, f"c{i}", rnd.random(), rnd.random())
                                   for i in range(n)],
                                  "prompt_id long, iter int, cand_pos int, revised_prompt string, tifa double, vqa double")
    sc = scores.candidate_scores(cands)
    best = select.best_paraphrase(select.iteration_best(sc)).filter("prompt_id = 1").collect()[0]
    hot = [r for r in sc.filter("prompt_id = 1").collect()]
    top = max(hot, key=lambda r: (r["sum"], r.iter, -r.cand_pos))
    assert (best.best_iter, best.best_paraphrase) == (top.iter, top.revised_prompt)


def test_hot_text_sampling_is_exact(spark):
    corpus = spark.createDataFrame([(i, "same text" if i % 3 == 0 else f"text {i}") for i in range(9000)],
                                   "doc_id long, text string").repartition(9)
    existing = spark.createDataFrame([("text 1",), ("text 2",)] * 1000, "prompt string")
    got = sampling.sample_new_prompts(corpus, existing, 10 ** 6, seed=1)
    rows = got.collect()
    assert len(rows) == 1 + (9000 - 3000) - 2  # every distinct new text once, none dropped
    assert sum(r.prompt == "same text" for r in rows) == 1
    assert got.filter(F.col("prompt") == "text 1").count() == 0


def test_hot_prompt_in_eval_rows_makes_no_product(spark):
    from promptforge.operators import evalrows
    n = 3000
    q = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"p{i}", i) for i in range(n)], "doc_id long, prompt string, a long")
    c = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"p{i}", "x, y") for i in range(n)], "doc_id long, prompt string, noun_chunks string")
    rows, _ = evalrows.load_eval_rows(qca=q, chunks=c, scoring=c.select("prompt", F.col("doc_id").alias("s")), order_by=["doc_id", "s"])
    got = rows.collect()
    assert len(got) == 1 + n - n // 3
    assert [(r.doc_id_x, r.doc_id_y, r.s) for r in got if r.prompt == "hot"] == [(0, 0, 0)]
