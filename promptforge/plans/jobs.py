"""Composed jobs as functions of DataFrames and paths.

Every model call of the reference is a hand-off here: a job writes a request
table, something outside this library answers it, and the next job joins the
reply table back by ``request_id``.  Each function is one Catalyst plan per
arrow of the survey's job table; none keeps driver-side state between runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from promptforge.functions.messages import short_key
from promptforge.functions.text import strip, yes_no
from promptforge.operators import (evalrows, history, merge, misc, replies, requests, rows, sampling, scores,
                                   select, training)
from promptforge.session import dropped, scratch_dir
from promptforge.sources import io


# The run modes of the optimiser.
MODES = ("scoring", "instant", "iterative", "iterative_for_annotation")


def check_mode(mode: str, metrics: list[str] | None = None) -> str:
    """Unknown modes fail before any plan is built; the iterative
    modes need both TIFA and VQA (their history and score use both)."""
    if mode not in MODES:
        raise ValueError(f"invalid mode {mode!r}; choose from {', '.join(MODES)}")
    if mode.startswith("iterative") and metrics is not None and set(metrics) != {"tifa", "vqa"}:
        raise ValueError("iterative modes need both the tifa and the vqa metric")
    return mode


# C1 -------------------------------------------------------------------------
def sample_prompts(corpus: DataFrame, existing_folder: str, n: int, out_path: str, seed: int = 42) -> DataFrame:
    """Corpus -> drop prompts already in the folder's *.txt files -> n seeded,
    distinct, one-line prompts -> text file."""
    existing = io.read_prompt_folder(corpus.sparkSession, existing_folder)
    picked = sampling.sample_new_prompts(corpus, existing, n, seed=seed)
    io.write_prompt_lines(picked, out_path)
    return picked


# C2 / C3 (request halves) ------------------------------------------------------
def prompt_lines(spark: SparkSession, prompt_file: str) -> DataFrame:
    """(line_no, prompt, prompt_key): lines with a hash of their text, which
    identifies a prompt when lines move."""
    return io.read_prompt_lines(spark, prompt_file).withColumn("prompt_key", sampling.text_key("prompt"))


def keyed_lines(spark: SparkSession, prompt_file: str) -> DataFrame:
    """``prompt_lines`` with ``occurrence``: which of the equal lines this one
    is, from 0.  (text, occurrence) names a line whatever is put before it."""
    lines = prompt_lines(spark, prompt_file)
    # texts stay out of the numbering and meet it by line: not at all where they are not read
    return lines.join(rows.with_occurrence(lines.select("line_no", "prompt_key"), ["prompt_key"], "line_no").drop("prompt_key"), "line_no")


def content_requests(lines: DataFrame, dataset: str, answered: DataFrame | None = None, kind: str = "noun_chunks",
                     keep: tuple[str, ...] = ()) -> DataFrame:
    """C2 / C3 over a prompt file that changes between runs: requests of the
    lines (``keyed_lines``) that ``answered`` (prompt_key, occurrence) lacks.
    Ids hold dataset, text and occurrence, so inserted, moved or deleted lines
    leave the ids of all others as they are."""
    keys = ["prompt_key", "occurrence"]
    if answered is not None:
        lines = lines.join(answered.select(*keys), keys, "left_anti")
    build = requests.noun_chunk_requests if kind == "noun_chunks" else requests.visual_question_requests
    return build(lines, prompt="prompt", keys=tuple(keys), scope=dataset, keep=keep)


def content_noun_chunk_table(lines: DataFrame, dataset: str, reply_table: DataFrame, out_csv: str | None = None) -> DataFrame:
    """``(line_no, prompt, noun_chunks)`` of the file's answered lines: replies
    of every run, joined by the id of text and occurrence; written as CSV (K3)
    when a path is given (the table is made once: the CSV and what is returned
    are read from it)."""
    keyed = content_requests(lines, dataset, keep=("line_no",)).select("request_id", "line_no")
    one = replies.one_reply(reply_table, F.col("reply").isNotNull())
    answered = replies.attach_replies(keyed, one).select("line_no", F.col("reply").alias("noun_chunks"))
    out = lines.select("line_no", "prompt").join(answered, "line_no")
    if out_csv:
        path = scratch_dir(lines.sparkSession, "noun-chunks")
        out.write.option("compression", "zstd").parquet(path)
        out = lines.sparkSession.read.schema(out.schema).parquet(path)
        io.write_csv(out.select("prompt", "noun_chunks"), out_csv)
    return out


def preparation_requests(spark: SparkSession, prompt_file: str, dataset: str, finished: DataFrame | None = None,
                         kind: str = "noun_chunks") -> DataFrame:
    """Prompt lines -> (resume: skip finished prompts) -> noun-phrase or
    visual-question requests.  Ids hold dataset, line and text, so replies of
    one prompt file never attach to another."""
    lines = prompt_lines(spark, prompt_file)
    if finished is not None:
        lines = sampling.resume_pending(lines, finished, "prompt", "prompt")
    build = requests.noun_chunk_requests if kind == "noun_chunks" else requests.visual_question_requests
    return build(lines, prompt="prompt", keys=("line_no", "prompt_key"), scope=dataset)


# C2 / C3 (reply halves) --------------------------------------------------------
def _answered_lines(reqs: DataFrame, lines: DataFrame, reply_table: DataFrame) -> DataFrame:
    one = replies.one_reply(reply_table, F.col("reply").isNotNull())
    j = replies.attach_replies(reqs.select("request_id", "line_no", "prompt_key"), one)
    return j.join(lines.select("line_no", "prompt_key", "prompt"), ["line_no", "prompt_key"])


def noun_chunk_table(reqs: DataFrame, lines: DataFrame, reply_table: DataFrame, out_csv: str | None = None) -> DataFrame:
    """Replies joined back to their prompt: ``(line_no, prompt, noun_chunks)``;
    written as CSV (K3) when a path is given."""
    out = _answered_lines(reqs, lines, reply_table).select("line_no", "prompt", F.col("reply").alias("noun_chunks"))
    if out_csv:
        io.write_csv(out.select("prompt", "noun_chunks"), out_csv)
    return out


def qca_table(reqs: DataFrame, lines: DataFrame, reply_table: DataFrame, dataset: str, out_json: str | None = None,
              out_errors: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Replies -> parsed QCA table and the anomaly report; written as JSON (K4)
    and CSV (K3) when paths are given."""
    j = _answered_lines(reqs, lines, reply_table)
    parsed = evalrows.qca_table(j.select("line_no", "prompt", F.col("reply").alias("visual_questions")),
                                keep=("line_no",))
    errors = evalrows.qca_errors(parsed.withColumnRenamed("line_no", "row_index"), dataset)
    if out_json:
        io.write_json(parsed.select("prompt", "qca"), out_json)
    if out_errors:
        io.write_csv(errors, out_errors)
    return parsed, errors


# C4 / C5 / C6 -------------------------------------------------------------------
def scoring_requests(cands: DataFrame, eval_rows: DataFrame, dataset: str, cand_keys: list[str],
                     prompt_col: str = "prompt_to_score", run: str = "") -> tuple[DataFrame, DataFrame]:
    """TIFA and VQA request tables for scored candidates (one per question /
    noun chunk).  ``cands`` carries ``prompt_id`` and ``prompt_col``; images
    and requests are identified by dataset, run, candidate and whole text."""
    scope = f"{dataset}/{run}"
    c = cands.withColumn("image_url", misc.candidate_image(scope, prompt_col, *cand_keys))
    qs = evalrows.qca_rows(eval_rows.select("prompt_id", "qca"), keys=("prompt_id",))
    ch = eval_rows.select("prompt_id", F.posexplode("chunks").alias("chunk_pos", "chunk"))
    return (requests.tifa_requests(c, qs, ["prompt_id"], cand_keys, scope=scope),
            requests.vqa_requests(c, ch, ["prompt_id"], cand_keys, scope=scope))


def answer_rows(tifa_reqs: DataFrame, tifa_replies: DataFrame, vqa_reqs: DataFrame, vqa_replies: DataFrame, cand_keys: list[str],
                soft: bool = False) -> tuple[DataFrame, DataFrame]:
    """Every request with its one valid reply, or null where it is open:
    (candidate, q_pos, picked) and (candidate, chunk_pos, reply or yes_prob).

    Requests and replies meet by ``short_key`` of the id.  Replies are shuffled
    whatever their size on disk: written lists of few values take a hundredth of
    what they take in memory, where a broadcast would hold them."""
    picked, short = scores.effective_reply("status", "reply"), short_key("request_id").alias("request_id")
    tr = replies.one_reply(tifa_replies.withColumn("picked", picked).withColumn("request_id", short), F.col("picked").isNotNull())
    ta = tifa_reqs.select(short, *cand_keys, "q_pos").join(tr.select("request_id", "picked").hint("merge"), "request_id", "left")
    vr = vqa_replies.withColumn("request_id", short)
    if soft:
        vr = vr.withColumn("yes_prob", F.when(F.col("status") == scores.FILTERED_STATUS, F.lit(0.0))
                           .when(F.col("top_logprobs").isNotNull(), scores.yes_probability("top_logprobs")))
        valid, keep = F.col("yes_prob").isNotNull(), "yes_prob"
    else:
        vr = vr.withColumn("reply", picked)
        valid, keep = yes_no("reply").isNotNull(), "reply"
    vr = replies.one_reply(vr, valid)
    va = vqa_reqs.select(short, *cand_keys, "chunk_pos").join(vr.select("request_id", keep).hint("merge"), "request_id", "left")
    return ta.drop("request_id"), va.drop("request_id")


def scores_of_answers(cands: DataFrame, ta: DataFrame, va: DataFrame, eval_rows: DataFrame, cand_keys: list[str],
                      soft: bool = False) -> DataFrame:
    """Answers (``answer_rows``) -> TIFA (A1) and VQA (A2 hard / A3 soft) per
    candidate -> sum (A4), reduced in one aggregation over the stacked question /
    chunk rows.  Answers of prompts are shuffled like replies."""
    answers = evalrows.qca_rows(eval_rows.select("prompt_id", "qca"), keys=("prompt_id",)) \
        .select("prompt_id", "q_pos", "answer")
    ta = ta.join(answers.hint("merge"), ["prompt_id", "q_pos"])
    scored = scores.score_candidates(ta, va, cand_keys, soft=soft)
    none = {"n_questions": 0, "n_open_questions": 0, "n_correct": 0, "n_chunks": 0, "n_open": 0}
    out = cands.select(*cand_keys).join(scored.hint("merge"), cand_keys, "left")
    asked = F.col("n_questions").isNotNull()
    out = out.select(*cand_keys, *[F.coalesce(c, F.lit(v).cast("long")).alias(c) for c, v in none.items()],
                     F.when(asked, F.col("tifa")).otherwise(F.lit(0.0)).alias("tifa"),
                     F.when(asked, F.col("vqa")).otherwise(F.lit(0.0)).alias("vqa"),
                     F.coalesce("answers", F.array().cast("array<string>")).alias("answers"),
                     F.coalesce("vqa_scores", F.array().cast("array<double>")).alias("vqa_scores"))
    return out.withColumn("sum", F.col("tifa") + F.col("vqa"))


def candidate_score_table(cands: DataFrame, tifa_reqs: DataFrame, tifa_replies: DataFrame, vqa_reqs: DataFrame,
                          vqa_replies: DataFrame, eval_rows: DataFrame, cand_keys: list[str],
                          soft: bool = False) -> DataFrame:
    """Replies -> scores per candidate (``answer_rows``, ``scores_of_answers``).

    Every request counts: it is joined with its one valid reply, or left open,
    and a score stays null while one of its requests is open.  Every candidate
    of ``cands`` has a row; without questions (chunks) its score is 0.0."""
    ta, va = answer_rows(tifa_reqs, tifa_replies, vqa_reqs, vqa_replies, cand_keys, soft)
    return scores_of_answers(cands, ta, va, eval_rows, cand_keys, soft)


def with_outcomes(scored: DataFrame, eval_rows: DataFrame, how: str = "left", lists: tuple[str, ...] = ("qa", "elements")) -> DataFrame:
    """``scored`` with two lists per candidate: ``qa``, its answered questions (the
    parsed questions zipped with its ordered answers), and ``elements``, its noun
    chunks zipped with their presence scores (G2, J8).

    One join by prompt: questions and chunks are shuffled once a prompt, not once
    a candidate, and lists are opened behind the join.  It is a merge join: a
    score table of few megabytes on disk opens to gigabytes."""
    zero = F.lit(0)
    asked = F.arrays_zip(F.col("qca.questions").alias("question"), F.col("qca.choices").alias("choices"), F.col("qca.answers").alias("answer")) \
        if "qa" in lists else None
    sides = {"qa": ("answers", asked, lambda x, i, y: F.struct(
                 i.alias("q_pos"), x.alias("picked"), *[y[c].alias(c) for c in ("question", "choices", "answer")])),
             "elements": ("vqa_scores", F.col("chunks"), lambda x, i, y: F.struct(i.alias("chunk_pos"), x.alias("prob"), y.alias("chunk")))}
    ev = eval_rows.select("prompt_id", *[sides[k][1].alias(f"_{k}") for k in lists])
    out = scored.join(ev.hint("merge"), "prompt_id", how)
    for k in lists:
        mine, _, item = sides[k]
        n = F.least(F.coalesce(F.array_size(mine), zero), F.coalesce(F.array_size(f"_{k}"), zero))
        zipped = F.transform(F.slice(mine, F.lit(1), n), lambda x, i: item(x, i, F.get(f"_{k}", i)))  # noqa: B023
        out = out.withColumn(k, F.coalesce(zipped, F.array()))
    return out.drop(*[f"_{k}" for k in lists])


def question_rows(scored: DataFrame, eval_rows: DataFrame, cand_keys: list[str]) -> DataFrame:
    """The ``qa`` input of the history text (G2): every answered question of a
    candidate, from the parsed questions and the candidate's ordered answers."""
    return with_outcomes(scored.select(*cand_keys, "answers"), eval_rows, "inner", ("qa",)).select(*cand_keys, F.inline("qa"))


def element_rows(scored: DataFrame, eval_rows: DataFrame, cand_keys: list[str]) -> DataFrame:
    """The ``elements`` input of the history text (G2, J8): every noun chunk of
    a candidate zipped with its presence score."""
    return with_outcomes(scored.select(*cand_keys, "vqa_scores"), eval_rows, "inner", ("elements",)).select(*cand_keys, F.inline("elements"))


def iteration_requests(scored: DataFrame, prompts: DataFrame, iteration: int, qa: DataFrame | str | None = None,
                       elements: DataFrame | str | None = None, n: int = 4) -> DataFrame:
    """Iteration 0 asks for n paraphrases; iteration k > 0 asks with the
    history of iterations < k (G1 + G2 + M5)."""
    if iteration == 0:
        return requests.first_iteration_requests(prompts, prompt="original_prompt", n=n)
    hist = history.history_text(scored, qa=qa, elements=elements, before_iter=iteration)
    return requests.next_iteration_requests(prompts.join(hist, "prompt_id", "left"), iteration, n=n)


def selection_requests(gen_reqs: DataFrame, gen_replies: DataFrame, iteration: int, n: int = 4,
                       best_only: bool = False) -> DataFrame:
    """C5 / C6, second model call: the paraphrase reply of each prompt goes
    back out as a selection request (M6 all n / M7 best one), keyed by
    (prompt_id, iteration)."""
    j = replies.attach_replies(gen_reqs.select("request_id", "prompt_id"), gen_replies) \
        .withColumn("iter", F.lit(iteration))
    build = requests.select_best_requests if best_only else requests.select_all_requests
    return build(j, keys=("prompt_id", "iter"), n=n)


def candidates_from_selection(sel_reqs: DataFrame, sel_replies: DataFrame) -> DataFrame:
    """R2: one candidate per non-empty line of the selection reply, with its
    0-based position, keyed by (prompt_id, iter)."""
    j = replies.attach_replies(sel_reqs.select("request_id", "prompt_id", "iter"), sel_replies)
    return replies.paraphrase_candidates(j, keys=("prompt_id", "iter")).withColumn("cand_pos",
                                                                                 F.col("cand_pos").cast("int"))


def iterative_results(scored: DataFrame, prompts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C6 tail: per-iteration best (A5/A6), lists (A8), best paraphrase (A7,
    read off the lists in-row) and the run averages (A10).  Two shuffles in
    all: (prompt, iteration) and prompt."""
    lists = select.best_from_lists(select.iteration_lists(select.iteration_best(scored)))
    result = prompts.join(lists, "prompt_id", "left").select(
        *prompts.columns, *[c for c in lists.columns if c not in ("prompt_id", "best_iter", "best_paraphrase",
                                                                  "best_sum")],
        F.coalesce("best_iter", F.lit(-1)).alias("best_iter"),
        F.coalesce("best_paraphrase", F.lit("")).alias("best_paraphrase"),
        F.coalesce("best_sum", F.lit(0.0)).alias("best_sum"))
    cols = [select.ITER_LIST_TEMPLATE.format(m) for m in ("tifa", "vqa", "sum")]
    return result, select.run_averages_iterative(lists, cols)


# C7 ---------------------------------------------------------------------------
def annotation_candidates(cands: DataFrame, prompts: DataFrame) -> DataFrame:
    """The candidates to score in annotation mode: those of the iterations and
    the original prompt itself, as candidate -1 of iteration 0 (G7)."""
    return cands.unionByName(history.current_prompt_rows(prompts), allowMissingColumns=True)


def annotation_run(scored: DataFrame, prompts: DataFrame, dataset: str, out_html: str, out_rows: str | None = None,
                   run: str = "0", per_page: int | None = None) -> DataFrame:
    """Annotation rows (G7), the gallery (K7: one page, or pages of ``per_page``
    entries with an index) and, when a folder is given, the run's rows added to
    the annotations there (U3)."""
    ann = history.annotation_rows(scored, prompts, dataset)
    order = ["prompt_id", "iter", "cand_pos"]
    if per_page:
        # images go along by the hash in their name
        named = ann.withColumn("image", misc.image_digest(dataset, "prompt_used_for_generation"))
        pages, index = history.gallery_pages(named, order, per_page, path="image", shown=lambda c: misc.image_of_digest(
            dataset, c, out_dir=f"./{misc.ANNOTATION_FOLDER}/"))
        io.write_gallery(pages, index, out_html)
        dropped(pages)
    else:
        io.write_annotation_html(history.annotation_html(ann, order), out_html, order)
    if out_rows:
        io.append_annotations(ann, out_rows, run)
    return ann


# C8 ---------------------------------------------------------------------------
def merge_results(spark: SparkSession, root: str, dataset: str, schema: str, metric_cols: list[str] | None = None,
                  list_cols: list[str] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The dataset's combined file first, then every shard by process, progress
    and place in the file; first row per prompt wins; then the averages over
    the merged rows: of ``metric_cols`` (scoring mode), or of the stringified
    lists ``list_cols`` (iterative mode)."""
    parts = io.read_optional(io.read_result_shards, spark, root, dataset, schema)
    if parts is None:
        raise ValueError(f"no result files for dataset {dataset!r}")
    first = merge.dedup_keep_first(parts, "original_prompt", ["source_rank", "process", "nextline", "file", "position"])
    if list_cols:
        lists = first.select(*[io.parse_list_col(c).alias(c) for c in list_cols])
        return first, select.run_averages_iterative(lists, list_cols)
    return first, select.run_averages_scoring(first, metric_cols) if metric_cols else None


# C9 ---------------------------------------------------------------------------
def training_table(results: DataFrame, fmt: str, rephrased: str = "best_paraphrase",
                   corrected: str | None = None) -> DataFrame:
    pairs = training.corrected_pairs(results, "original_prompt", rephrased, corrected)
    return training.format_pairs(pairs, fmt)


def write_training_tables(results: DataFrame, path: str, formats: tuple[str, ...] = training.ALL_FORMATS,
                          rephrased: str = "best_paraphrase", corrected: str | None = None, keys: tuple[str, ...] = ()) -> dict[str, str]:
    """C9 for several formats at once: the correction pick is evaluated and
    written once, and every format is rendered from that table into a folder of
    its own.  Returns the folder of each format."""
    unknown = [f for f in formats if f not in training.ALL_FORMATS]
    if unknown:
        raise ValueError(f"unknown format {unknown[0]!r}; choose from {', '.join(training.ALL_FORMATS)}")
    spark, path = results.sparkSession, path.rstrip("/")
    pairs = training.corrected_pairs(results, "original_prompt", rephrased, corrected).select(*keys, "original_prompt", "rephrased_prompt")
    pairs.write.mode("overwrite").parquet(f"{path}/pairs")
    pairs = spark.read.schema(pairs.schema).parquet(f"{path}/pairs")
    for fmt in formats:
        io.write_json(training.format_pairs(pairs, fmt, keys=keys), f"{path}/{fmt}")
    return {fmt: f"{path}/{fmt}" for fmt in formats}


# C10 --------------------------------------------------------------------------
def generation_requests(prompts: DataFrame, prompt_col: str = "prompt", first_n: int = 200,
                        batch: int = 4) -> DataFrame:
    """First n prompts (L3) in batches of 4 (G5) as fine-tuned-model inputs."""
    top = rows.first_rows(prompts, ["prompt_id"], first_n)
    r = requests.generation_requests(top, prompt=prompt_col, keys=("prompt_id", "row_index"))
    return r.withColumn("batch_no", rows.batch_number("row_index", batch))


def generation_table(reqs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Outputs -> generated prompt after the marker; rows without it rejected."""
    j = replies.attach_replies(reqs, outputs)
    return j.withColumn("generated_prompt", replies.generated_prompt("reply")) \
            .withColumn("rejected", F.col("generated_prompt").isNull())


def split_once(rows_: DataFrame, reject: F.Column, path: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Accepted rows, rejected rows and their counts from a single evaluation of
    ``rows_``: one write, dealt into folders by verdict, with the counts observed
    while it runs.  A null verdict rejects."""
    seen = Observation()
    verdict = F.coalesce(reject, F.lit(True))
    # the verdict first: what is counted is what is written
    marked = rows_.withColumn("rejected", verdict).observe(
        seen, F.count(F.when(~F.col("rejected"), 1)).alias("accepted"), F.count(F.when(F.col("rejected"), 1)).alias("rejected"))
    marked.write.mode("overwrite").option("compression", "zstd").partitionBy("rejected").parquet(path)
    counts = dict(seen.get)
    back = rows_.sparkSession.read.schema(marked.schema).parquet(path)
    return back.where("not rejected").drop("rejected"), back.where("rejected").drop("rejected"), counts


def generation_run(reqs: DataFrame, outputs: DataFrame, path: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """C10 in one pass: generated prompts, rejected outputs and their counts."""
    made = generation_table(reqs, outputs).drop("rejected")
    return split_once(made, F.col("generated_prompt").isNull(), path)


def qca_run(replies_: DataFrame, path: str, dataset: str, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """C3 with P7 in one pass: parsed replies, the anomaly report's rows and
    their counts."""
    parsed = evalrows.qca_table(replies_, keep=keep).withColumn("dataset", F.lit(dataset))
    return split_once(parsed, F.col("anomaly"), path)


# C11 --------------------------------------------------------------------------
def icl_requests(examples: DataFrame, tests: DataFrame, n_examples: int = 100, seed: int = 42) -> DataFrame:
    ex = sampling.seeded_sample(examples.withColumn("_k", F.concat_ws("|", "prompt", "best_paraphrase")),
                                "_k", n_examples, seed)
    return requests.icl_requests(tests, ex)


def icl_table(reqs: DataFrame, tests: DataFrame, reply_table: DataFrame, keys: list[str] | None = None,
              answer_label: str = requests.ICL_ANSWER_LABEL) -> DataFrame:
    """C11, reply half: ``(prompt, improved_prompt)``, the reply without the
    answer label it may repeat, stripped."""
    keys = keys or ["prompt_id"]
    j = replies.attach_replies(reqs.select("request_id", *keys), replies.one_reply(reply_table, F.col("reply").isNotNull()))
    text = strip("reply")
    text = F.when(F.startswith(text, F.lit(answer_label)), strip(F.substring(text, F.lit(len(answer_label) + 1), F.length(text)))) \
        .otherwise(text)
    return j.select(*keys, text.alias("improved_prompt")).join(tests.select(*keys, "prompt"), keys) \
        .select("prompt", "improved_prompt")


# C12 --------------------------------------------------------------------------
def timer_summary(times: DataFrame, out_path: str) -> DataFrame:
    summary = misc.timer_averages(times)
    io.write_timer_summary(summary, out_path)
    return summary


def eval_rows_from_files(spark: SparkSession, qca_json: str | None, chunks_csv: str | None,
                         scoring_csv: str | None = None, scoring_column: str = "",
                         qca_array_file: bool = True) -> DataFrame:
    """Inputs that are not given or do not exist are skipped and the rest
    choose the plan; at least one of QCA / chunks must be there.  The QCA file
    is a JSON array as the original pipeline writes it (``qca_array_file``;
    False for JSON lines as ``io.write_json`` writes them)."""
    qca = io.read_optional(io.read_qca_json, spark, qca_json, qca_array_file) if qca_json else None
    chunks = io.read_optional(io.read_csv, spark, chunks_csv, "_c0 long, prompt string, noun_chunks string") \
        if chunks_csv else None
    scoring = io.read_optional(io.read_csv, spark, scoring_csv) if (scoring_csv and scoring_column) else None
    rows_, kind = evalrows.load_eval_rows(qca, chunks, scoring)
    out = evalrows.eval_info(rows_, kind)
    return evalrows.prompt_to_score(out, scoring_column).withColumn("original_prompt", strip("prompt"))
