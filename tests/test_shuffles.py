"""What the runs shuffle, broadcast and group by, beside the results."""

import glob
import os

from pyspark.sql import functions as F

from promptforge.functions.messages import short_key
from promptforge.operators import history, requests, scores
from promptforge.operators.ledger import RequestLedger
from promptforge.plans import jobs, loop
from promptforge.plans.fixtures import Tables

CAND = ["prompt_id", "iter", "cand_pos"]
QCA = "struct<questions:array<string>,choices:array<string>,answers:array<string>>"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


def scored(spark):
    rows = [(1, 0, 0, "a", ["x", None], [1.0, 0.0, 1.0], 0.5, 0.5), (1, 0, 0, "a", ["x", None], [1.0, 0.0, 1.0], 0.5, 0.5),  # a row twice
            (1, 0, 1, "b", ["y"], [0.0], 0.2, 0.4), (2, 0, 0, "c", [], None, 0.0, 0.0), (3, 0, 0, "open", ["x"], [None], None, None),
            (None, 0, 0, "nobody's", ["x"], [1.0], 1.0, 1.0)]
    return scores.candidate_scores(spark.createDataFrame(rows, "prompt_id long, iter int, cand_pos int, revised_prompt string, "
                                                         "answers array<string>, vqa_scores array<double>, tifa double, vqa double"))


def evals(spark):
    one = (1, (["q1", "q2"], ["x, y", "y, z"], ["x", "z"]), ["sky", "sea"])
    return spark.createDataFrame([one, one, (2, None, ["hill"]), (3, (["q"], ["x"], ["x"]), ["sun"])],
                                 f"prompt_id long, qca {QCA}, chunks array<string>")


def test_lists_are_opened_behind_one_join(spark):
    sc, ev = scored(spark), evals(spark)
    e = jobs.element_rows(sc, ev, CAND)
    got = sorted((r.prompt_id, r.cand_pos, r.chunk_pos, r.chunk, r.prob) for r in e.where("prompt_id < 3").collect())
    assert got == sorted([(1, 0, 0, "sky", 1.0), (1, 0, 1, "sea", 0.0)] * 4 + [(1, 1, 0, "sky", 0.0)] * 2)  # repeated rows multiply
    p = plan(e)
    assert p.count("Exchange hashpartitioning") == 2 and p.index("Generate") < p.index("SortMergeJoin")  # printed top down
    assert "BroadcastHashJoin" not in p


def test_history_of_list_columns_is_that_of_rows(spark):
    sc, ev = scored(spark), evals(spark)
    want = history.history_text(sc, qa=jobs.question_rows(sc, ev, CAND), elements=jobs.element_rows(sc, ev, CAND))
    got = history.history_text(jobs.with_outcomes(sc, ev), qa="qa", elements="elements")
    rows = lambda df: sorted((str(r.prompt_id), r.n_entries, r.history) for r in df.collect())
    assert rows(got) == rows(want) and len(rows(got)) == 3
    p = plan(got)
    assert p.count("Exchange hashpartitioning") == 2 and "BroadcastHashJoin" not in p  # candidates and texts, once each by prompt


def test_requests_and_replies_meet_by_a_short_key(spark):
    cands, ev = scored(spark).select(*CAND, "revised_prompt").distinct(), evals(spark).distinct()
    tifa, vqa = jobs.scoring_requests(cands, ev, "ds", CAND, prompt_col="revised_prompt")
    said = lambda reqs, text: reqs.select("request_id", F.lit("ok").alias("status"), F.lit(text).alias("reply"))
    table = jobs.candidate_score_table(cands, tifa, said(tifa, "x"), vqa, said(vqa, "yes"), ev, CAND)
    assert {(r.prompt_id, r.cand_pos): (r.tifa, r.vqa) for r in table.collect()} == {
        (1, 0): (0.5, 1.0), (1, 1): (0.5, 1.0), (2, 0): (0.0, 1.0), (3, 0): (1.0, 1.0), (None, 0): (0.0, 0.0)}
    assert "BroadcastHashJoin" not in plan(table).split("SortMergeJoin")[0]
    keys = spark.createDataFrame([("a" * 64,), (None,)], "k string").select(short_key("k").alias("k")).collect()
    assert len(keys[0].k) == 16 and keys[1].k is None


def test_resumed_scores_leave_unread_texts_behind(spark, tmp_dir):
    cands = scored(spark).select(*CAND, "revised_prompt").where("prompt_id = 1").distinct()
    ask = lambda stage, reqs: reqs.select("request_id", F.lit("ok").alias("status"), F.lit("yes").alias("reply"))
    s = loop.score_pending(f"{tmp_dir}/s", cands, evals(spark), ask, "ds", call=0)
    assert sorted(r.revised_prompt for r in s.collect()) == ["a", "b"]
    group = [x for x in plan(s.select(*CAND, "sum")).splitlines() if "Aggregate(" in x and "sum" in x]
    assert group and not any("revised_prompt" in x for x in group)


def test_requests_carry_kept_columns_and_rounds_group_short_rows(spark, tmp_dir):
    lines = spark.createDataFrame([(0, "a kite")], "line_no long, prompt string")
    for build in (requests.visual_question_requests, requests.noun_chunk_requests):
        kept = build(lines, keys=("line_no",), keep=("prompt",))
        assert kept.first().prompt == "a kite"
        assert kept.drop("prompt").collect() == build(lines, keys=("line_no",)).collect()
    ledger = RequestLedger(spark, f"{tmp_dir}/ledger", F.col("status") == "ok")
    ledger.enter(spark.createDataFrame([("a",), ("b",)], "request_id string"))
    sent = [("a", "ok", "z", 0), ("a", "ok", "y", 0), ("a", "error", "zz", 1), ("b", "error", "x", 0), ("b", "filtered", "w", 0)]
    ledger.settle(spark.createDataFrame(sent, "request_id string, status string, reply string, attempt int"), 1)
    assert [(r.reply, r.attempts) for r in ledger.answers().collect()] == [("y", 3)]
    assert [(r.last_status, r.attempts) for r in ledger.open_after(1).collect()] == [("filtered", 2)]


def test_lines_are_numbered_without_shuffling_their_texts(spark, tmp_dir):
    spark.createDataFrame([("cat",), ("dog",), ("cat",)], "value string").coalesce(1).write.text(f"{tmp_dir}/p")
    lines = jobs.keyed_lines(spark, f"{tmp_dir}/p")
    assert sorted((r.line_no, r.prompt, r.occurrence) for r in lines.collect()) == [(0, "cat", 0), (1, "dog", 0), (2, "cat", 1)]
    assert "SortMergeJoin" not in plan(jobs.prompt_lines(spark, f"{tmp_dir}/p"))
    said = jobs.content_requests(lines, "ds").select("request_id", F.col("prompt_key").alias("reply"))
    out = jobs.content_noun_chunk_table(lines, "ds", said, f"{tmp_dir}/csv")
    assert out.count() == 3 and "Window" not in plan(out)  # read back, not made a second time


def test_candidate_texts_do_not_multiply_rows(spark, tmp_dir):
    docs = [(1, "a"), (1, "b"), (2, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_dir}/documents.parquet")
    run = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (2, 1, 0), (3, 0, 0)], "prompt_id long, iter int, cand_pos int")
    got = Tables(spark, tmp_dir).with_candidate_text(run).collect()
    assert sorted((r.prompt_id, r.cand_pos, str(r.revised_prompt)) for r in got) == [(1, 0, "b v0.0"), (1, 1, "b v0.1"), (2, 0, "None")]


def test_what_finished_calls_asked_leaves_the_disk(spark, tmp_dir):
    """A batch's requests and pending candidates stay while its scores are missing and go with their commit."""
    files = lambda name: glob.glob(f"{tmp_dir}/r/{name}/data/*/*.parquet")
    asked = ("asked", "asked_vqa", "pending", "asked_text", "asked_select", "cands")
    cands = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 0, 1, "b"), (3, 0, None, "n"), (None, 0, 0, "z")],
                                  "prompt_id long, iter int, cand_pos int, revised_prompt string")

    def ask(stage, reqs, there=True):
        if stage == "vqa" and not there:
            return None
        return reqs.select("request_id", F.lit("ok").alias("status"), F.lit({"generate": "P", "select": "one\ntwo"}.get(stage, "yes")).alias("reply"))

    ev = evals(spark).distinct()
    assert loop.score_pending(f"{tmp_dir}/r", cands, ev, lambda *a: ask(*a, there=False), "ds", call=0) is None
    assert files("asked") and files("asked_vqa") and files("pending")
    got = loop.score_pending(f"{tmp_dir}/r", cands, ev, ask, "ds", call=0)
    assert not any(files(x) for x in asked) and not loop.commits.has_batch(spark, f"{tmp_dir}/r/asked", "0-tifa")
    # as by a plain join on the keys: rows of a repeated key multiply, null keys meet nothing
    assert sorted((r.prompt_id, r.cand_pos, r.revised_prompt, r.n_chunks) for r in got.collect()) == [(1, 0, "a", 2), (1, 1, "b", 4)]
    rows = loop.finished(spark, f"{tmp_dir}/r")
    assert rows.where("cand_pos = 1").count() == 4 and rows.count() == 5
    later = loop.score_pending(f"{tmp_dir}/r", cands.where("prompt_id is not null"), ev, ask, "ds", call=1)
    assert later.count() == 2 and loop.finished(spark, f"{tmp_dir}/r").count() == 5  # nothing with a whole key was pending
    prompts = spark.createDataFrame([(1, "a kite"), (3, "sun")], "prompt_id long, original_prompt string")
    assert loop.iterative_run(f"{tmp_dir}/r/loop", prompts, ev, ask, 2, "ds") == 2
    assert not glob.glob(f"{tmp_dir}/r/loop/[ac]*/data/*/*.parquet") and loop.finished(spark, f"{tmp_dir}/r/loop").count() == 8


def test_steps_of_a_scoring_call_free_their_shuffle_files(spark, tmp_dir):
    """A committed batch leaves no shuffle files behind, whenever the driver collects its garbage."""
    local = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    left = lambda: {x for x in local.getAllFiles().mkString("|").split("|") if x.endswith(".data") and os.path.getsize(x) > 10_000}
    before = left()
    loop.commits.commit_batch(spark.range(500_000).repartition(3, "id"), f"{tmp_dir}/t", 0)
    assert not left() - before
