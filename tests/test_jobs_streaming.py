import os

from pyspark.sql import functions as F

from promptforge.operators import replies
from promptforge.plans import jobs
from promptforge.streaming.replies import ingest_replies


def test_streaming_ingest_resumes_from_checkpoint(spark, tmp_dir):
    reqs = spark.createDataFrame([("r1", 1), ("r2", 2), ("r3", 3)], "request_id string, prompt_id long")
    reply_dir, out, ck = f"{tmp_dir}/replies", f"{tmp_dir}/out", f"{tmp_dir}/ck"
    spark.createDataFrame([("r1", "ok", "a\nb"), ("zz", "ok", "orphan")], "request_id string, status string, reply string") \
        .write.mode("append").parquet(reply_dir)
    parse = lambda df: replies.paraphrase_candidates(df, keys=("request_id", "prompt_id"))
    q = ingest_replies(spark, reply_dir, reqs, out, ck, parse=parse)
    q.awaitTermination()
    assert spark.read.parquet(out).count() == 2
    spark.createDataFrame([("r2", "ok", "c")], "request_id string, status string, reply string") \
        .write.mode("append").parquet(reply_dir)
    q = ingest_replies(spark, reply_dir, reqs, out, ck, parse=parse)
    q.awaitTermination()
    got = sorted((r.prompt_id, r.cand_pos, r.revised_prompt) for r in spark.read.parquet(out).collect())
    assert got == [(1, 0, "a"), (1, 1, "b"), (2, 0, "c")]  # r1 not ingested twice


def test_sample_and_generation_jobs(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/existing", exist_ok=True)
    open(f"{tmp_dir}/existing/old.txt", "w").write("t1\nt2\n")
    corpus = spark.createDataFrame([(i, f"t{i}") for i in range(10)], "doc_id long, text string")
    picked = jobs.sample_prompts(corpus, f"{tmp_dir}/existing", 5, f"{tmp_dir}/new")
    assert picked.count() == 5 and spark.read.text(f"{tmp_dir}/new").count() == 5
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(10)], "prompt_id long, prompt string")
    reqs = jobs.generation_requests(prompts, first_n=6)
    assert reqs.agg(F.max("batch_no")).first()[0] == 1 and reqs.count() == 6
    outs = reqs.select("request_id", F.concat(F.lit("Here is the rephrased prompt: new "), F.col("prompt_id"))
                       .alias("reply"))
    gen = jobs.generation_table(reqs, outs)
    assert sorted(r.generated_prompt for r in gen.collect())[0] == "new 0"


def test_iterative_loop_is_a_query_over_scores(spark):
    scored = spark.createDataFrame([(1, 0, 0, "a", 0.5, 0.5), (1, 0, 1, "b", 0.2, 0.2)],
                                   "prompt_id long, iter int, cand_pos int, revised_prompt string, tifa double, vqa double")
    from promptforge.operators import scores
    scored = scores.candidate_scores(scored)
    prompts = spark.createDataFrame([(1, "orig"), (2, "other")], "prompt_id long, original_prompt string")
    r0 = jobs.iteration_requests(scored, prompts, 0)
    r1 = jobs.iteration_requests(scored, prompts, 1)
    assert r0.count() == 2 and r1.count() == 2
    txt = [r.messages[0].content[0].text for r in r1.collect() if r.prompt_id == 1][0]
    assert txt.index("1. b") < txt.index("2. a")
    result, avg = jobs.iterative_results(scored, prompts)
    got = {r.prompt_id: (r.best_iter, r.best_paraphrase) for r in result.collect()}
    assert got == {1: (0, "a"), 2: (-1, "")}
    assert {r.metric for r in avg.collect()} == {"best_tifa_at_each_iter", "best_vqa_at_each_iter",
                                                  "best_sum_at_each_iter"}


def test_mode_checks_and_prompt_to_score(spark):
    import pytest
    from promptforge.operators import evalrows
    assert jobs.check_mode("scoring", ["tifa"]) == "scoring"
    with pytest.raises(ValueError):
        jobs.check_mode("optimise")
    with pytest.raises(ValueError):
        jobs.check_mode("iterative", ["tifa"])
    df = spark.createDataFrame([(" p ", " s "), ("q", None)], "prompt string, alt string")
    got = [r.prompt_to_score for r in evalrows.prompt_to_score(df, "alt").collect()]
    assert got == ["s", "nan"]
    assert [r.prompt_to_score for r in evalrows.prompt_to_score(df).collect()] == ["p", "q"]


def _scoring_inputs(spark):
    from promptforge.operators import evalrows
    qca = evalrows.qca_table(spark.createDataFrame(
        [("a red kite", "Q: is there a kite?\nChoices: yes, no\nA: yes\nQ: color?\nChoices: red, blue\nA: red"), ("plain", "no questions")],
        "prompt string, visual_questions string"))
    chunks = spark.createDataFrame([("a red kite", "red kite, sky"), ("plain", "x")], "prompt string, noun_chunks string")
    rows_, kind = evalrows.load_eval_rows(qca=qca.select("prompt", "qca"), chunks=chunks)
    ids = F.when(F.col("prompt") == "plain", 2).otherwise(1).cast("long")
    ev = evalrows.eval_info(rows_, kind).withColumn("prompt_id", ids)
    # the plain prompt has no chunks either
    return ev.withColumn("chunks", F.when(F.col("prompt_id") == 1, F.col("chunks")).otherwise(F.array().cast("array<string>")))


def test_scoring_job_with_imperfect_replies(spark):
    ev, keys = _scoring_inputs(spark), ["prompt_id", "cand_pos"]
    long = "a common opening of more than fifty characters, then "
    cands = spark.createDataFrame([(1, 0, long + "a"), (1, 1, long + "b"), (1, 2, "c"), (1, 3, "d"), (2, 0, "plain")],
                                  "prompt_id long, cand_pos int, prompt_to_score string")
    treq, vreq = jobs.scoring_requests(cands, ev, "ds", keys)
    assert treq.count() == 8 and vreq.count() == 8
    urls = {r.u for r in vreq.select(vreq.messages[0].content[0].image_url.alias("u")).collect()}
    assert len(urls) == 4  # one image per candidate
    trep = treq.select("request_id", F.lit("ok").alias("status"), F.when(F.col("q_pos") == 0, " Yes").otherwise("blue").alias("reply"),
                       "cand_pos", "q_pos")
    vrep = vreq.select("request_id", F.lit("ok").alias("status"), F.when(F.col("chunk_pos") == 0, "yes").otherwise("no").alias("reply"),
                       "cand_pos", "chunk_pos")
    drop = ["cand_pos", "q_pos", "chunk_pos"]
    # 1: one question unanswered; 2: an unclear reply asked again, and a reply sent twice; 3: filtered
    trep = trep.filter("not (cand_pos = 1 and q_pos = 1)").unionByName(trep.filter("cand_pos = 2")) \
        .withColumn("status", F.when(F.col("cand_pos") == 3, "filtered").otherwise("ok")) \
        .withColumn("reply", F.when(F.col("cand_pos") == 3, None).otherwise(F.col("reply")))
    vrep = vrep.unionByName(vrep.filter("cand_pos = 2").withColumn("reply", F.lit("perhaps")))
    got = {(r.prompt_id, r.cand_pos): r for r in jobs.candidate_score_table(
        cands, treq, trep.drop(*drop), vreq, vrep.drop(*drop), ev, keys).collect()}
    assert (got[1, 0].tifa, got[1, 0].vqa, got[1, 0]["sum"], got[1, 0].answers, got[1, 0].vqa_scores) == (0.5, 0.5, 1.0, [" Yes", "blue"], [1.0, 0.0])
    assert (got[1, 1].n_questions, got[1, 1].n_open_questions, got[1, 1].tifa, got[1, 1]["sum"]) == (2, 1, None, None)
    assert (got[1, 2].n_questions, got[1, 2].n_chunks, got[1, 2].n_open, got[1, 2]["sum"]) == (2, 2, 0, 1.0)
    assert (got[1, 3].tifa, got[1, 3].n_open_questions, got[1, 3].answers) == (0.0, 0, ["", ""])
    assert (got[2, 0].tifa, got[2, 0].vqa, got[2, 0]["sum"], got[2, 0].answers) == (0.0, 0.0, 0.0, [])


def test_soft_scores_in_order(spark):
    ev, keys = _scoring_inputs(spark), ["prompt_id", "cand_pos"]
    cands = spark.createDataFrame([(1, 0, "p")], "prompt_id long, cand_pos int, prompt_to_score string")
    treq, vreq = jobs.scoring_requests(cands, ev, "ds", keys)
    trep = treq.select("request_id", F.lit("ok").alias("status"), F.lit("yes").alias("reply"))
    vrep = vreq.select("request_id", F.when(F.col("chunk_pos") == 0, "ok").otherwise("filtered").alias("status"),
                       F.expr("array(struct('no' as token, -9.0D as logprob), struct(' Yes' as token, 0.0D as logprob))").alias("top_logprobs"))
    got = jobs.candidate_score_table(cands, treq, trep, vreq, vrep, ev, keys, soft=True).collect()[0]
    assert (got.vqa_scores, got.vqa, got.tifa) == ([1.0, 0.0], 0.5, 0.5)


def test_merge_and_training_jobs(spark, tmp_dir):
    from promptforge.sources import io
    # Combined file first, then shards; C9: training text from the merged rows
    shards = spark.createDataFrame([("ds_combined.csv", "p", "combined"), ("ds_process0_nextline_40.csv", "p", "shard"),
                                    ("ds_process1_nextline_40.csv", "q", "x"), ("ds2_process0_nextline_40.csv", "r", "other")],
                                   "file_name string, original_prompt string, best_paraphrase string")
    io.write_result_shards(shards, f"{tmp_dir}/parts")
    first, _ = jobs.merge_results(spark, f"{tmp_dir}/parts", "ds", "original_prompt string, best_paraphrase string")
    got = {r.original_prompt: r.best_paraphrase for r in first.collect()}
    assert got == {"p": "combined", "q": "x"}
    text = {r.text for r in jobs.training_table(first, "chatml").collect()}
    assert any(t.startswith("<|im_start|>user ") and t.endswith("Here is the rephrased prompt: combined") for t in text)

    # C11: examples sampled once, folded into every request; replies give the improved prompts
    ex = first.select(F.col("original_prompt").alias("prompt"), "best_paraphrase")
    tests = spark.createDataFrame([(7, "new prompt"), (8, "other")], "prompt_id long, prompt string")
    reqs = jobs.icl_requests(ex, tests, n_examples=1)
    msgs = reqs.filter("prompt_id = 7").collect()[0].messages
    assert len(msgs) == 4 and msgs[-1].content[0].text == "Prompt: new prompt"
    rep = reqs.select("request_id", F.when(F.col("prompt_id") == 7, "Rewritten: a better one ").otherwise(" plain ").alias("reply"))
    table = jobs.icl_table(reqs, tests, rep.unionByName(rep))
    assert sorted(map(tuple, table.collect())) == [("new prompt", "a better one"), ("other", "plain")]


def test_eval_rows_from_files_skips_missing_inputs(spark, tmp_dir):
    import pandas as pd
    import pytest
    os.makedirs(tmp_dir, exist_ok=True)
    pd.DataFrame({"prompt": [" a ", "b"], "noun_chunks": ["x, y", None]}).to_csv(f"{tmp_dir}/nc.csv")
    rows = jobs.eval_rows_from_files(spark, f"{tmp_dir}/missing.json", f"{tmp_dir}/nc.csv")
    got = sorted((r.original_prompt, r.chunks) for r in rows.collect())
    assert got == [("a", ["x", "y"]), ("b", ["nan"])]
    with pytest.raises(ValueError):
        jobs.eval_rows_from_files(spark, f"{tmp_dir}/missing.json", f"{tmp_dir}/missing.csv")


def test_two_iterations_through_request_and_reply_tables(spark):
    from promptforge.operators import scores
    prompts = spark.createDataFrame([(1, "a cat"), (2, "a dog")], "prompt_id long, original_prompt string")
    scored = None
    for it in range(2):
        gen = jobs.iteration_requests(scored, prompts, it) if it else jobs.iteration_requests(None, prompts, 0)
        gen_rep = gen.select("request_id", F.concat(F.lit("1. x\n2. y")).alias("reply"))
        sel = jobs.selection_requests(gen, gen_rep, it)
        sel_rep = sel.select("request_id", F.concat(F.lit(f"v{it}a\n\n v{it}b ")).alias("reply"))
        cands = jobs.candidates_from_selection(sel, sel_rep)
        new = scores.candidate_scores(cands.withColumn("tifa", F.when(F.col("cand_pos") == 0, 0.5).otherwise(0.25))
                                      .withColumn("vqa", F.lit(0.5)))
        scored = new if scored is None else scored.unionByName(new)
    assert scored.count() == 8
    result, _ = jobs.iterative_results(scored, prompts)
    got = {r.prompt_id: (r.best_iter, r.best_paraphrase) for r in result.collect()}
    assert got == {1: (1, "v1a"), 2: (1, "v1a")}  # equal sums: the later iteration wins


def test_preparation_and_reply_jobs(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/in", exist_ok=True)
    open(f"{tmp_dir}/in/ds.txt", "w").write(" a red kite \nblue sea\n")
    finished = spark.createDataFrame([("blue sea",)], "prompt string")
    reqs = jobs.preparation_requests(spark, f"{tmp_dir}/in", "ds", finished=finished)
    assert reqs.count() == 1
    other = jobs.preparation_requests(spark, f"{tmp_dir}/in", "ds2")
    assert not {r.request_id for r in reqs.collect()} & {r.request_id for r in other.collect()}
    lines = jobs.prompt_lines(spark, f"{tmp_dir}/in")
    rep = reqs.select("request_id", F.lit("kite, sea").alias("reply"))
    nc = jobs.noun_chunk_table(reqs, lines, rep, out_csv=f"{tmp_dir}/chunks").collect()
    assert [(r.prompt, r.noun_chunks) for r in nc] == [("a red kite", "kite, sea")]
    vreqs = jobs.preparation_requests(spark, f"{tmp_dir}/in", "ds", kind="visual_questions")
    vrep = vreqs.select("request_id", F.when(F.col("line_no") == 0, "Q: kite?\nChoices: yes, no\nA: yes")
                        .otherwise("Q: broken").alias("reply"))
    parsed, errors = jobs.qca_table(vreqs, lines, vrep, "ds", f"{tmp_dir}/qca", f"{tmp_dir}/errors")
    assert parsed.count() == 2 and [r.row_index for r in errors.collect()] == [1]
    from promptforge.sources import io
    assert io.read_csv(spark, f"{tmp_dir}/chunks", "prompt string, noun_chunks string").count() == 1
    assert io.read_qca_json(spark, f"{tmp_dir}/qca").count() == 2
    assert io.read_csv(spark, f"{tmp_dir}/errors", "dataset string, row_index long").collect()[0].row_index == 1


def test_instant_annotation_and_timer_jobs(spark, tmp_dir):
    from promptforge.operators import replies, scores
    prompts = spark.createDataFrame([(1, "a cat")], "prompt_id long, original_prompt string")
    from promptforge.operators import requests as rq
    gen = rq.instant_requests(prompts, prompt="original_prompt")
    gen_rep = gen.select("request_id", F.lit("1. x <BEST>y</BEST>").alias("reply"))
    sel = jobs.selection_requests(gen, gen_rep, 0, best_only=True)
    assert "one line only" in sel.collect()[0].messages[0].content[0].text
    best = replies.attach_replies(sel.select("request_id", "prompt_id"),
                                  sel.select("request_id", F.lit("  y ").alias("reply")))
    assert best.select(replies.best_from_reply("reply")).first()[0] == "y"
    sc = scores.candidate_scores(spark.createDataFrame([(1, 0, 0, "p <b>", 0.5, 0.5)],
                                                       "prompt_id long, iter int, cand_pos int, revised_prompt string, tifa double, vqa double"))
    both = jobs.annotation_candidates(sc.select("prompt_id", "iter", "cand_pos", "revised_prompt"), prompts)
    assert {(r.cand_pos, r.revised_prompt) for r in both.collect()} == {(0, "p <b>"), (-1, "a cat")}
    ann = jobs.annotation_run(sc, prompts, "ds", f"{tmp_dir}/html", f"{tmp_dir}/ann", "1")
    assert ann.count() == 2
    page = "".join(open(os.path.join(f"{tmp_dir}/html", f)).read() for f in sorted(os.listdir(f"{tmp_dir}/html"))
                   if f.endswith(".txt"))
    assert "p &lt;b&gt;" not in page and "a cat" in page  # the page shows the current prompt of each row
    times = spark.createDataFrame([("gen", 0, 2.0), ("gen", 1, 4.0)], "purpose string, seq long, elapsed double")
    assert jobs.timer_summary(times, f"{tmp_dir}/timers").collect()[0].average_time == 3.0


def test_readme_quick_start(spark, tmp_dir):
    """The README's quick start, on small files and in-memory reply tables."""
    import pandas as pd
    from promptforge.operators import scores
    from promptforge.sources import io
    os.makedirs(f"{tmp_dir}/prompts", exist_ok=True)
    os.makedirs(f"{tmp_dir}/data", exist_ok=True)
    open(f"{tmp_dir}/prompts/ds.txt", "w").write("a red kite\n")
    pd.DataFrame({"prompt": ["a red kite"], "qca": [{"questions": ["kite?"], "choices": ["yes, no"],
                                                    "answers": ["yes"]}]}) \
        .to_json(f"{tmp_dir}/data/ds_eval_q_a.json", orient="records")
    pd.DataFrame({"prompt": ["a red kite"], "noun_chunks": ["red kite"]}).to_csv(f"{tmp_dir}/data/ds_noun_chunks.csv")

    prompts = io.read_prompt_lines(spark, f"{tmp_dir}/prompts/*.txt") \
        .select(F.col("line_no").alias("prompt_id"), F.col("prompt").alias("original_prompt"))
    gen = jobs.iteration_requests(None, prompts, 0)
    sel = jobs.selection_requests(gen, gen.select("request_id", F.lit("1. p\n2. q").alias("reply")), 0)
    cands = jobs.candidates_from_selection(sel, sel.select("request_id", F.lit("kite in red\nred kite").alias("reply")))
    ev = jobs.eval_rows_from_files(spark, f"{tmp_dir}/data/ds_eval_q_a.json", f"{tmp_dir}/data/ds_noun_chunks.csv") \
        .join(prompts, "original_prompt")
    tifa_req, vqa_req = jobs.scoring_requests(cands.withColumnRenamed("revised_prompt", "prompt_to_score"),
                                              ev, "ds", ["prompt_id", "iter", "cand_pos"])
    tifa_rep = tifa_req.select("request_id", F.lit("ok").alias("status"),
                               F.when(F.col("cand_pos") == 1, "yes").otherwise("no").alias("reply"))
    vqa_rep = vqa_req.select("request_id", F.lit("ok").alias("status"), F.lit("yes").alias("reply"))
    scored = jobs.candidate_score_table(cands, tifa_req, tifa_rep, vqa_req, vqa_rep, ev, ["prompt_id", "iter", "cand_pos"])
    result, averages = jobs.iterative_results(
        scores.candidate_scores(scored.join(cands, ["prompt_id", "iter", "cand_pos"])), prompts)
    r = result.collect()[0]
    assert (r.best_iter, r.best_paraphrase, r.best_sum) == (0, "red kite", 2.0)
    assert {a.metric: a.value for a in averages.collect()}["best_sum_at_each_iter"] == 200.0


def test_merge_results_with_combined_file_only(spark, tmp_dir):
    import pandas as pd
    import pytest
    os.makedirs(tmp_dir, exist_ok=True)
    pd.DataFrame({"original_prompt": ["p", "p"], "best_paraphrase": ["z", "a"], "lists": ["[0.5, 0.75]", "[0.1]"]}) \
        .to_csv(f"{tmp_dir}/ds_combined.csv")
    first, avg = jobs.merge_results(spark, tmp_dir, "ds", "original_prompt string, best_paraphrase string, lists string",
                                    list_cols=["lists"])
    assert [(r.original_prompt, r.best_paraphrase) for r in first.collect()] == [("p", "z")]  # file order, not text order
    assert avg.collect()[0].value == 75.0
    with pytest.raises(ValueError):
        jobs.merge_results(spark, f"{tmp_dir}/no_shards", "ds", "original_prompt string")


def test_replies_before_their_request_are_kept(spark, tmp_dir):
    reply_dir, out, ck = f"{tmp_dir}/replies", f"{tmp_dir}/out", f"{tmp_dir}/ck"
    rep = "request_id string, status string, reply string"
    spark.createDataFrame([("r1", "ok", "a"), ("r2", "ok", "early")], rep).write.mode("append").parquet(reply_dir)
    one = spark.createDataFrame([("r1",)], "request_id string")
    ingest_replies(spark, reply_dir, one, out, ck).awaitTermination()
    both = spark.createDataFrame([("r1",), ("r2",), ("r3",)], "request_id string")
    spark.createDataFrame([("r3", "ok", "c")], rep).write.mode("append").parquet(reply_dir)
    ingest_replies(spark, reply_dir, both, out, ck).awaitTermination()
    assert sorted(r.reply for r in spark.read.parquet(out).collect()) == ["a", "c", "early"]


def test_unmatched_replies_expire(spark, tmp_dir):
    reqs = spark.createDataFrame([("r1", 1), ("late", 2)], "request_id string, prompt_id long")
    reply_dir, out, ck = f"{tmp_dir}/in", f"{tmp_dir}/out", f"{tmp_dir}/ck"
    for n, ids in enumerate((["nobody"], ["late"], ["r1"], ["r1"])):
        spark.createDataFrame([(i, "ok", "a") for i in ids], "request_id string, status string, reply string") \
            .write.mode("append").parquet(reply_dir)
        known = reqs if n >= 2 else reqs.where("request_id = 'r1'")
        ingest_replies(spark, reply_dir, known, out, ck, max_wait=2).awaitTermination()
    assert sorted(r.request_id for r in spark.read.parquet(out).collect()) == ["late", "r1", "r1"]
    assert [r.request_id for r in spark.read.parquet(f"{out}_unmatched_expired").collect()] == ["nobody"]
    assert spark.read.parquet(f"{out}_unmatched/batch=3").count() == 0
