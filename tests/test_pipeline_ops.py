import pytest
from pyspark.sql import functions as F

from promptforge.functions import messages as M
from promptforge.operators import (evalrows, history, merge, replies, requests, sampling, scores, select,
                                   training)


def test_generated_prompt_marker(spark):
    df = spark.createDataFrame([("x [/INST] Absolutely! Here is the rephrased prompt:  new one \n",), ("no marker",),
                                ("a Here is the rephrased prompt: b Here is the rephrased prompt: c",)], "o string")
    got = [r[0] for r in df.select(replies.generated_prompt("o")).collect()]
    assert got == ["new one", None, "b"]


def test_paraphrase_candidates_positions(spark):
    df = spark.createDataFrame([("r1", "\n one \n\n two\n"), ("r2", None)], "request_id string, reply string")
    got = [(r.request_id, r.cand_pos, r.revised_prompt) for r in replies.paraphrase_candidates(df).collect()]
    assert got == [("r1", 0, "one"), ("r1", 1, "two")]


def test_open_requests_and_attach(spark):
    req = spark.createDataFrame([("a",), ("b",), ("c",)], "request_id string")
    rep = spark.createDataFrame([("a", "ok", "x"), ("b", "filtered", "")], "request_id string, status string, reply string")
    assert sorted(r.request_id for r in replies.open_requests(req, rep, F.col("status") == "ok").collect()) == ["b", "c"]
    assert replies.attach_replies(req, rep).count() == 2


def test_request_templates_whole_strings(spark):
    df = spark.createDataFrame([(7, "\t a cat \n")], "prompt_id long, prompt string")
    r = requests.noun_chunk_requests(df).collect()[0]
    assert r.messages[0].content[0].text == requests.NOUN_PHRASE_INSTRUCTION + "\n\na cat"
    vq = requests.visual_question_requests(df).collect()[0]
    assert len(vq.messages) == len(requests.DEFAULT_FEW_SHOT) + 1
    assert vq.messages[-1].content[0].text == "Description: a cat"
    g = requests.generation_requests(df).collect()[0]
    assert g.request_text.startswith("<s> [INST] ") and g.request_text.endswith(" [/INST] Here is the rephrased prompt:")
    # request ids are deterministic and stage-scoped
    again = requests.noun_chunk_requests(df).collect()[0]
    assert again.request_id == r.request_id != requests.instant_requests(df).collect()[0].request_id


def test_modality_first_message_decides(spark):
    df = spark.range(1).select(
        F.array(M.message("user", M.image_part(F.lit("u")), M.text_part(F.lit("t")))).alias("a"),
        F.array(M.text_message("user", F.lit("t")), M.message("user", M.image_part(F.lit("u")))).alias("b"))
    r = df.select(M.modality("a").alias("a"), M.modality("b").alias("b")).collect()[0]
    assert (r.a, r.b) == ("multimodal", "text")


def test_icl_requests_fold_examples_once(spark):
    ex = spark.createDataFrame([("p1", "b1", "k2"), ("p0", "b0", "k1")], "prompt string, best_paraphrase string, sample_key string")
    tests = spark.createDataFrame([(1, "u")], "prompt_id long, prompt string")
    msgs = requests.icl_requests(tests, ex).collect()[0].messages
    assert [m.role for m in msgs] == ["system", "user", "assistant", "user", "assistant", "user"]
    assert msgs[1].content[0].text == "Prompt: p0" and msgs[-1].content[0].text == "Prompt: u"


def test_training_formats(spark):
    df = spark.createDataFrame([("o", "r", "Correct."), ("o2", "r2", "fixed")],
                               "original_prompt string, rephrased_prompt string, corrected_prompt string")
    pairs = training.corrected_pairs(df)
    assert [r.rephrased_prompt for r in pairs.collect()] == ["r", "fixed"]
    hf = training.format_pairs(pairs, "hf").collect()[0].text
    assert hf == "<s> [INST] " + training.DEFAULT_INSTRUCTION + "o [/INST] Here is the rephrased prompt: r"
    q = training.format_pairs(pairs, "qwen").collect()[0].messages
    assert [m["from"] for m in q] == ["user", "assistant"]
    with pytest.raises(ValueError):
        training.format_pairs(pairs, "alpaca")


def test_dedup_keeps_first_and_drops_null_keys(spark):
    df = spark.createDataFrame([("p", 1, 5, "late"), ("p", 0, 9, "combined"), (None, 0, 0, "x")],
                               "original_prompt string, source_rank int, row_index long, v string")
    got = merge.dedup_keep_first(df, "original_prompt", ["source_rank", "row_index"]).collect()
    assert [(r.original_prompt, r.v) for r in got] == [("p", "combined")]


def test_sampling_is_seeded_new_and_distinct(spark):
    corpus = spark.createDataFrame([(i, f"t{i % 30}\n") for i in range(100)], "doc_id long, text string")
    existing = spark.createDataFrame([("t1",), ("t2 ",)], "prompt string")
    a = [r.doc_id for r in sampling.sample_new_prompts(corpus, existing, 10, seed=3).collect()]
    b = [r.doc_id for r in sampling.sample_new_prompts(corpus, existing, 10, seed=3).collect()]
    assert a == b and len(a) == 10
    got = sampling.sample_new_prompts(corpus, existing, 100, seed=3).collect()
    assert len(got) == 28 and not {"t1", "t2"} & {r.prompt for r in got}


def test_resume_pending(spark):
    rows = spark.createDataFrame([(1, " a "), (2, "b")], "id long, prompt string")
    done = spark.createDataFrame([("a",)], "original_prompt string")
    assert [r.id for r in sampling.resume_pending(rows, done).collect()] == [2]


def test_eval_rows_kinds_and_suffixes(spark):
    q = spark.createDataFrame([("p", 1), ("p", 2), (None, 3)], "prompt string, doc_id long")
    c = spark.createDataFrame([("p", "a,b", 9), ("p", "c", 8)], "prompt string, noun_chunks string, doc_id long")
    rows, kind = evalrows.load_eval_rows(qca=q, chunks=c, multiply=True)
    assert kind == "MERGED" and rows.count() == 4 and {"doc_id_x", "doc_id_y"} <= set(rows.columns)
    assert evalrows.load_eval_rows(chunks=c)[1] == "NOUN_CHUNK"
    first, _ = evalrows.load_eval_rows(qca=q, chunks=c, order_by=["doc_id"])
    got = [(r.doc_id_x, r.doc_id_y, r.noun_chunks) for r in first.collect()]
    assert got == [(1, 8, "c")]  # first of each side by doc_id, no pair product
    with pytest.raises(ValueError):
        evalrows.load_eval_rows()


def test_history_text_sorted_ascending_and_stable(spark):
    sc = scores.candidate_scores(spark.createDataFrame(
        [(1, 0, 0, "hi", 0.5, 0.5), (1, 0, 1, "lo", 0.1, 0.1), (1, 1, 0, "hi2", 0.5, 0.5)],
        "prompt_id long, iter int, cand_pos int, revised_prompt string, tifa double, vqa double"))
    qa = spark.createDataFrame([(1, 0, 0, 0, "q?", "a, b", "a", "b")],
                               "prompt_id long, iter int, cand_pos int, q_pos long, question string, choices string, answer string, picked string")
    h = history.history_text(sc, qa=qa).collect()[0].history
    assert h.index("1. lo") < h.index("2. hi\n") < h.index("3. hi2")
    assert "- q? | choices: a; b | correct: a | picked: b | wrong\n" in h
    assert history.history_text(sc, before_iter=1).collect()[0].n_entries == 2
    hr = history.history_rows(sc).orderBy("hist_pos").collect()
    assert [r.revised_prompt for r in hr] == ["hi", "lo", "hi2"]


def test_annotation_rows_use_true_winner(spark):
    sc = scores.candidate_scores(spark.createDataFrame(
        [(1, 0, -1, "orig <x>", 0.3, 0.4), (1, 0, 0, "a", 0.1, 0.1), (1, 0, 1, "b", 0.9, 0.9), (1, 1, 0, "c", 0.2, 0.2)],
        "prompt_id long, iter int, cand_pos int, revised_prompt string, tifa double, vqa double"))
    prompts = spark.createDataFrame([(1, "orig <x>")], "prompt_id long, original_prompt string")
    rows = history.annotation_rows(sc, prompts, "ds")
    ann = {(r.iter, r.cand_pos): r for r in rows.collect()}
    assert set(ann) == {(0, -1), (0, 0), (0, 1), (1, -1), (1, 0)}
    assert ann[(0, -1)].prompt_used_for_generation == "orig <x>" and (ann[(0, -1)].tifa, ann[(0, -1)].vqa) == (0.3, 0.4)
    assert ann[(1, -1)].prompt_used_for_generation == "b" and ann[(1, -1)].tifa == 0.9
    assert ann[(1, 0)].original_prompt == "b" and ann[(1, -1)].image_path == ann[(0, 1)].image_path
    html = history.annotation_html(rows, ["prompt_id", "iter", "cand_pos"])
    blocks = [r.html for r in html.orderBy("part", "prompt_id", "iter", "cand_pos").collect()]
    assert blocks[0] == history.HTML_HEADER and blocks[-1] == history.HTML_FOOTER and len(blocks) == 7
    assert "<figcaption>orig &lt;x&gt;</figcaption>" in blocks[1]
    # images are named by the whole text
    long = "a long common opening of far more than fifty characters "
    two = spark.createDataFrame([(1, 0, 0, long + "x", 0.1, 0.1), (1, 0, 1, long + "y", 0.2, 0.2)],
                                "prompt_id long, iter int, cand_pos int, revised_prompt string, tifa double, vqa double")
    paths = {r.image_path for r in history.annotation_rows(scores.candidate_scores(two), prompts, "ds").collect()}
    assert len(paths) == 3


def test_request_ids_hold_scope_and_nulls(spark):
    df = spark.createDataFrame([(1, None, "p"), (None, 1, "p"), (1, 1, "p")], "a long, b long, prompt string")
    ids = [r.request_id for scope in ("x", "y") for r in requests.noun_chunk_requests(df, keys=("a", "b"), scope=scope).collect()]
    assert len(set(ids)) == 6


def test_own_wording_of_every_request(spark):
    df = spark.createDataFrame([(1, "cat", "some reply", "h", 0, "q?", "a, b", 0, "tail")],
                               "prompt_id long, prompt string, reply string, history string, q_pos int, question string, "
                               "choices string, chunk_pos int, chunk string")
    one = df.select("prompt_id", F.lit("u").alias("image_url"))
    made = [requests.instant_requests(df, n=2, template="I{n} {prompt}"), requests.first_iteration_requests(df, template="F {prompt}", role_text=""),
            requests.next_iteration_requests(df, 1, prompt="prompt", template="N {prompt}{history}", role_text=""),
            requests.select_all_requests(df, template="A {reply}", keys=("prompt_id",)),
            requests.select_best_requests(df, template="B {reply}", keys=("prompt_id",)),
            requests.tifa_requests(one, df, ["prompt_id"], ["prompt_id"], template="T {question} {choices}"),
            requests.vqa_requests(one, df.drop("image_url"), ["prompt_id"], ["prompt_id"], template="V {chunk}")]
    texts = [m.select(M.message_text(F.get("messages", 0)).alias("t")).first().t for m in made]
    assert texts == ["I2 cat", "F cat", "N cath", "A some reply", "B some reply", "T q? a, b", "V tail"]
    with pytest.raises(ValueError, match="no column"):
        requests.instant_requests(df, template="{other}")


def test_long_prompts_sharing_50_chars_share_an_image_key_not_a_request(spark):
    from promptforge.functions.text import image_key
    base = "a very long prompt about a lighthouse on a cliff at dusk, "
    df = spark.createDataFrame([(1, base + "with gulls"), (2, base + "with boats")], "prompt_id long, prompt string")
    keys = {r.k for r in df.select(image_key("prompt").alias("k")).collect()}
    assert len(keys) == 1 and len(next(iter(keys))) == 50
    ids = {r.request_id for r in requests.noun_chunk_requests(df).collect()}
    assert len(ids) == 2


def test_non_breaking_space_padding(spark):
    from promptforge.functions.text import one_line, strip
    vals = ["\xa0 prompt\xa0", " x ", "﻿keep"]  # BOM is not whitespace in Python
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "v string").select(strip("v")).collect()]
    assert got == [v.strip() for v in vals]
    got2 = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "v string").select(one_line("v")).collect()]
    assert got2 == [v.replace("\n", " ").strip() for v in vals]


@pytest.mark.parametrize("n", [0, 1, 37, 500, 4999, 5000, 6000])
def test_sampling_is_the_exact_top_n(spark, n):
    import hashlib
    df = spark.range(5000).select(F.col("id").alias("doc_id"))
    got = [r.doc_id for r in sampling.seeded_sample(df, "doc_id", n, seed=9).collect()]
    assert got == sorted(range(5000), key=lambda i: hashlib.md5(f"9{i}".encode()).hexdigest())[:n]


def test_sampling_on_empty_input(spark):
    df = spark.range(0).select(F.col("id").alias("doc_id"))
    assert sampling.seeded_sample(df, "doc_id", 50).count() == 0


def test_sampling_new_prompts_with_null_ids_and_texts(spark):
    rows = [(i, f"t{i}") for i in range(20)] + [(None, f"t{i}") for i in range(10)] + [(None, "a"), (None, "b"), (None, None), (30, None)]
    corpus = spark.createDataFrame(rows, "doc_id long, text string")
    existing = spark.createDataFrame([("t1",)], "prompt string")
    got = sampling.sample_new_prompts(corpus, existing, 20, seed=3).collect()
    assert len(got) == 20 and [r.doc_id for r in got].count(None) == 1
    got = sampling.sample_new_prompts(corpus, existing, 100, seed=3).collect()
    assert sorted(r.prompt for r in got) == sorted({f"t{i}" for i in range(20) if i != 1} | {"a", "b"})
    assert {r.prompt for r in got if r.doc_id is None} == {"a", "b"}
