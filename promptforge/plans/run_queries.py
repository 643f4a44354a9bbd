"""Registered queries of whole jobs: several steps, their files
and, where a job carries state, a second call after a stop."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptforge.functions.text import round6
from promptforge.functions.messages import request_id
from promptforge.operators import replies, requests, sampling, scores, select, training
from promptforge.operators.ledger import RequestLedger
from promptforge.plans import jobs, loop
from promptforge.plans.fixtures import Tables
from promptforge.plans.queries import CAND, L, _existing_folder, _qca_flat, _run_eval, _scored, query
from promptforge.session import scratch_dir
from promptforge.sources import commits, io


def _documents(t: Tables):
    return t.documents.select(F.col("doc_id").alias("prompt_id"), F.col("text").alias("original_prompt"))


@query("iterative_run")
def q_iterative_run(spark, sf_dir):
    """Three iterations; the first call stops inside the second one, where
    replies are missing, and the next call goes on from there."""
    t, path = Tables(spark, sf_dir), scratch_dir(spark, "loop")
    prompts, evals = _documents(t), _run_eval(t)
    done = loop.iterative_run(path, prompts, evals, t.loop_replies(stop_at=("select", 1)), 3, "docs", "1")
    if done != 1:
        raise RuntimeError(f"{done} iterations where one is complete")
    loop.iterative_run(path, prompts, evals, t.loop_replies(), 3, "docs", "1")
    result, _ = jobs.iterative_results(loop.finished(spark, path), prompts)
    sums = F.transform(select.ITER_LIST_TEMPLATE.format("sum"), lambda x: F.when(x.isNotNull(), F.format_string("%.6f", x)).otherwise("open"))
    return result.select("prompt_id", L(F.size("iters")).alias("n_iters"), F.array_join(sums, ",").alias("sums"),
                         F.array_join(select.ITER_LIST_TEMPLATE.format("paraphrase"), " | ").alias("paraphrases"), "best_iter",
                         "best_paraphrase", round6("best_sum").alias("best_sum"))


@query("score_run_resumed")
def q_score_run_resumed(spark, sf_dir):
    """C4 with J4: the first call scores every second document's candidates, the
    second call is given all and scores the others and those still open."""
    t, path = Tables(spark, sf_dir), scratch_dir(spark, "scoring")
    cands, evals, ask = t.run_candidates, _run_eval(t), t.loop_replies()
    loop.score_pending(path, cands.where("prompt_id % 2 = 0"), evals, ask, "docs", "1", call=0)
    s = loop.score_pending(path, cands, evals, ask, "docs", "1", call=1)
    return s.select(*CAND, "n_questions", "n_open_questions", "n_correct", "n_chunks", "n_open", round6("tifa").alias("tifa"),
                    round6("vqa").alias("vqa"), round6("sum").alias("sum"), F.array_join("answers", "|", "?").alias("answers"),
                    F.array_join(F.transform("vqa_scores", lambda x: x.cast("int").cast("string")), "", "?").alias("vqa_scores"))


def _document_lines(spark, t: Tables, name: str, rows_=None) -> str:
    path = scratch_dir(spark, name)
    io.write_prompt_lines((t.documents if rows_ is None else rows_).orderBy("doc_id"), path, col="text")
    return path


@query("qca_ledger")
def q_qca_ledger(spark, sf_dir):
    """C3 with R7: question requests of a prompt file go through three rounds of
    replies; the second round is settled twice, as a failed job would."""
    t = Tables(spark, sf_dir)
    lines = jobs.prompt_lines(spark, _document_lines(spark, t, "qca-prompts"))
    reqs = requests.visual_question_requests(lines, keys=("line_no", "prompt_key"), scope="docs", keep=("prompt",))
    reqs = reqs.select("line_no", "request_id", "prompt")
    path = scratch_dir(spark, "qca-requests")
    reqs.write.option("compression", "zstd").parquet(path)
    reqs = spark.read.parquet(path)
    ledger = RequestLedger(spark, scratch_dir(spark, "ledger"), (F.col("status") == "ok") & F.col("reply").isNotNull())
    ledger.enter(reqs)
    # the first round answers what was sent; in the second and third, replies to answered requests come too
    for number, asked in ((1, ledger.to_send(reqs, 0)), (2, reqs), (2, reqs), (3, reqs)):
        ledger.settle(t.ledger_replies(asked, number), number)
    found = reqs.join(ledger.answers(), "request_id")
    parsed, anomalies, _ = jobs.qca_run(found.select("line_no", "attempts", "round", "prompt", F.col("reply").alias("visual_questions")),
                                scratch_dir(spark, "qca-out"), "docs", keep=("line_no", "attempts", "round"))
    good = _qca_flat(parsed, ["line_no", "attempts", "round"]).withColumn("state", F.lit("answered"))
    bad = anomalies.select("line_no", "attempts", "round", F.lit("anomaly").alias("state"))
    left = reqs.join(ledger.open_after(3), "request_id").select(
        "line_no", "attempts", F.concat(F.lit("open "), F.coalesce("last_status", F.lit("never"))).alias("state"))
    return good.unionByName(bad, allowMissingColumns=True).unionByName(left, allowMissingColumns=True)


@query("noun_chunk_run")
def q_noun_chunk_run(spark, sf_dir):
    """A prompt file is answered, lines are put before, between and out of
    it, and only the new lines are asked in the second run."""
    t = Tables(spark, sf_dir)
    docs = t.documents.select("doc_id", "text")
    first = jobs.keyed_lines(spark, _document_lines(spark, t, "chunks-1", docs.where("doc_id % 4 <> 1")))
    second = jobs.keyed_lines(spark, _document_lines(spark, t, "chunks-2", docs.where("doc_id % 5 <> 2")))
    asked = scratch_dir(spark, "chunk-replies")
    reply = lambda reqs, run: reqs.select("request_id", F.concat(
        F.lit(f"run {run}, "), F.substring(F.col("prompt_key"), 1, 8), F.lit("-"), F.col("occurrence").cast("string")).alias("reply"))
    one = jobs.content_requests(first, "docs")
    reply(one, 1).write.parquet(f"{asked}/1")
    two = jobs.content_requests(second, "docs", answered=one)
    reply(two, 2).write.parquet(f"{asked}/2")
    path = scratch_dir(spark, "chunk-table")
    out = jobs.content_noun_chunk_table(second, "docs", spark.read.parquet(f"{asked}/1", f"{asked}/2"), path)
    back = io.read_csv(spark, path, "prompt string, noun_chunks string")
    return out.select(L("line_no").alias("line_no"), F.md5("prompt").alias("prompt_md5"), "noun_chunks").unionByName(
        back.select(F.lit(None).cast("long").alias("line_no"), F.md5("prompt").alias("prompt_md5"), "noun_chunks"))


@query("sample_prompts_run")
def q_sample_prompts_run(spark, sf_dir):
    """C1 whole: sample of new prompts to its text file, and the file read back."""
    t, path = Tables(spark, sf_dir), scratch_dir(spark, "sampled")
    jobs.sample_prompts(t.documents, _existing_folder(spark, t), 300, path, seed=7)
    return spark.read.text(path).select(F.col("value").alias("prompt"))


@query("instant_run")
def q_instant_run(spark, sf_dir):
    """Instant requests -> replies -> selection of the best -> scores of it
    against the prompt's questions and elements, and the run's averages."""
    t = Tables(spark, sf_dir)
    prompts = _documents(t)
    gen = requests.instant_requests(prompts, prompt="original_prompt")
    ask = t.loop_replies()
    sel = jobs.selection_requests(gen, ask("generate", gen), 0, best_only=True)
    picked = replies.attach_replies(sel.select("request_id", "prompt_id", "iter"), ask("select", sel))
    best = picked.select("prompt_id", "iter", F.lit(0).alias("cand_pos"), replies.best_from_reply("reply").alias("revised_prompt"))
    path = scratch_dir(spark, "instant")
    loop.score_pending(path, best, _run_eval(t), ask, "docs", "instant", call=0)
    scored = loop.finished(spark, path)
    averages = select.run_averages_scoring(scored.select(F.col("tifa").alias("tifa_score"), F.col("vqa").alias("vqa_score")),
                                           ["tifa_score", "vqa_score"])
    return scored.select(F.col("prompt_id").cast("string").alias("item"), F.col("revised_prompt").alias("best_paraphrase"),
                         round6("tifa").alias("tifa"), round6("vqa").alias("vqa")).unionByName(
        averages.select(F.col("metric").alias("item"), F.lit(None).cast("string").alias("best_paraphrase"), F.col("value").alias("tifa"),
                        F.lit(None).cast("double").alias("vqa")))


@query("annotation_gallery")
def q_annotation_gallery(spark, sf_dir):
    """C7 + K7: scored candidates -> annotation rows -> gallery pages of 200
    entries with an index page, all files read back."""
    t, path = Tables(spark, sf_dir), scratch_dir(spark, "gallery")
    scored = _scored(t).unionByName(scores.candidate_scores(t.scored_originals))
    jobs.annotation_run(scored, t.cand_prompts, "ds", path, per_page=200)
    pages = spark.read.schema("value string, page long").text(f"{path}/pages")
    index = spark.read.text(f"{path}/index").select("value", F.lit(None).cast("long").alias("page"))
    return pages.select("page", F.col("value").alias("html")).unionByName(index.select("page", F.col("value").alias("html")))


@query("incremental_commits")
def q_incremental_commits(spark, sf_dir):
    """K8 + U3 exactly once: three batches; the second is written twice, the
    table compacted, and the third written again after that."""
    t, path = Tables(spark, sf_dir), scratch_dir(spark, "commits")
    rows_ = t.raw_prompts.select("prompt_id", F.md5("raw").alias("raw_md5"))
    schema = "prompt_id long, raw_md5 string"
    part = lambda b: rows_.where(F.pmod("prompt_id", F.lit(3)) == b)
    for b in (0, 1, 1, 2):
        io.write_batch(part(b), path, b)
    commits.compact(spark, path, schema)
    io.write_batch(part(2).withColumn("raw_md5", F.reverse("raw_md5")), path, 2)
    return commits.read_committed(spark, path, schema, "batch_id")


@query("generation_run")
def q_generation_run(spark, sf_dir):
    """Outputs of the fine-tuned model split into prompts and rejects, with
    counts, in one evaluation."""
    t = Tables(spark, sf_dir)
    prompts = t.generated.select("conv_id", "turn", F.lit("x").alias("prompt"))
    reqs = requests.generation_requests(prompts, keys=("conv_id", "turn"))
    outputs = t.generated.select(request_id("generation", "conv_id", "turn").alias("request_id"), F.col("output").alias("reply"))
    good, bad, n = jobs.generation_run(reqs, outputs, scratch_dir(spark, "generated"))
    counts = spark.range(2).select(F.when(F.col("id") == 0, "count accepted").otherwise("count rejected").alias("kind"),
                                   F.when(F.col("id") == 0, n["accepted"]).otherwise(n["rejected"]).cast("long").alias("conv_id"))
    rows_ = good.select(F.lit("accepted").alias("kind"), "conv_id", "turn", F.col("generated_prompt").alias("text")).unionByName(
        bad.select(F.lit("rejected").alias("kind"), "conv_id", "turn", F.col("reply").alias("text")))
    return rows_.unionByName(counts, allowMissingColumns=True)


@query("training_run")
def q_training_run(spark, sf_dir):
    """The correction pick written once, all five formats rendered from it
    and read back."""
    t, keys = Tables(spark, sf_dir), ("conv_id", "turn")
    folders = jobs.write_training_tables(t.pairs, scratch_dir(spark, "training"), rephrased="rephrased_prompt",
                                         corrected="corrected_prompt", keys=keys)
    schema = "conv_id long, turn long, "
    out = None
    for fmt, folder in sorted(folders.items()):
        more = {"qwen": "messages array<struct<from:string,value:string>>",
                "test": "original_prompt string, rephrased_and_corrected_prompt string"}.get(fmt, "text string")
        back = spark.read.schema(schema + more).json(folder)
        body = {"qwen": F.array_join(F.flatten(F.transform("messages", lambda m: F.array(m["from"], m["value"]))), "|"),
                "test": F.concat_ws("|", *[F.col(c) for c in back.columns[2:]])}.get(fmt, F.col(back.columns[-1]))
        one = back.select(F.lit(fmt).alias("format"), *keys, body.alias("body"))
        out = one if out is None else out.unionByName(one)
    return out


@query("icl_run")
def q_icl_run(spark, sf_dir):
    """C11: example pairs -> requests for every prompt -> replies, some of which
    repeat the answer label -> improved prompts, written as CSV and read back."""
    t = Tables(spark, sf_dir)
    keys = ["conv_id", "turn"]
    pairs = training.corrected_pairs(t.pairs).select(*keys, F.col("original_prompt").alias("prompt"),
                                                     F.col("rephrased_prompt").alias("best_paraphrase"))
    examples = sampling.seeded_sample(pairs.withColumn("pair_key", F.concat_ws("-", *keys)), "pair_key", 100, seed=42)
    tests = pairs.select(*keys, "prompt")
    reqs = requests.icl_requests(tests, examples, keys=tuple(keys))
    said = F.concat(F.lit("better "), F.md5(F.concat_ws("-", *keys)))
    answer = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit(requests.ICL_ANSWER_LABEL), said)).otherwise(
        F.concat(F.lit("  "), said, F.lit("\n")))
    reply = reqs.where("conv_id % 7 <> 1").select("request_id", answer.alias("reply"))
    path = scratch_dir(spark, "icl")
    io.write_csv(jobs.icl_table(reqs, tests, reply.unionByName(reply), keys), path)  # every reply comes twice
    return io.read_csv(spark, path, "prompt string, improved_prompt string", pandas_na=False)


@query("timer_run")
def q_timer_run(spark, sf_dir):
    """The timer summary of a run and its file, side by side."""
    t, path = Tables(spark, sf_dir), scratch_dir(spark, "timer-run")
    made = jobs.timer_summary(t.purposes, path).select("purpose", round6("average_time").alias("average_time"), F.lit("table").alias("place"))
    back = io.read_csv(spark, path, "Purpose string, `Average Time` double")
    return made.unionByName(back.select(F.col("Purpose").alias("purpose"), round6("Average Time").alias("average_time"),
                                        F.lit("file").alias("place")))
