"""Jobs that carry state: committed batches, the request ledger, resumed and
iterative runs; and the file work around them."""

import os
import random

import pytest
from pyspark.sql import functions as F

from promptforge import session
from promptforge.operators import history, rows
from promptforge.operators.ledger import RequestLedger
from promptforge.plans import jobs, loop
from promptforge.sources import commits, io

SCHEMA = "k long, v string"


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def pairs(df):
    return sorted((r.k, r.v) for r in df.collect())


# ------------------------------------------------------------------- commits
def test_repeated_batches_replace_and_lost_ones_do_not_count(spark, tmp_dir):
    path = f"{tmp_dir}/t"
    assert commits.read_committed(spark, path, SCHEMA).count() == 0
    commits.commit_batch(frame(spark, [(1, "a"), (2, "b")]), path, 0)
    commits.commit_batch(frame(spark, [(3, "c")]), path, 1)
    commits.commit_batch(frame(spark, [(3, "c")]), path, 1)  # a job that runs again
    assert pairs(commits.read_committed(spark, path, SCHEMA)) == [(1, "a"), (2, "b"), (3, "c")]
    # a job that was lost before its commit
    frame(spark, [(9, "x")]).withColumn("batch_id", F.lit("2")).write.parquet(f"{path}/data/folder=123e4")
    assert pairs(commits.read_committed(spark, path, SCHEMA)) == [(1, "a"), (2, "b"), (3, "c")]
    commits.compact(spark, path, SCHEMA, rows_per_file=2)
    assert pairs(commits.read_committed(spark, path, SCHEMA)) == [(1, "a"), (2, "b"), (3, "c")]
    assert commits.live(spark, path).select("folder").distinct().count() == 1
    commits.commit_batch(frame(spark, [(4, "d")]), path, 1)  # replaced after the compaction
    got = commits.read_committed(spark, path, SCHEMA, "b")
    assert sorted((r.k, r.v, r.b) for r in got.collect()) == [(1, "a", "0"), (2, "b", "0"), (4, "d", "1")]
    assert commits.has_batch(spark, path, 1) and not commits.has_batch(spark, path, 2)
    commits.commit_batch(frame(spark, []), path, 0)  # an empty batch replaces too
    assert pairs(commits.read_committed(spark, path, SCHEMA)) == [(4, "d")]


# -------------------------------------------------------------------- ledger
REPLY = "request_id string, status string, reply string, attempt int"


def test_ledger_asks_until_answered(spark, tmp_dir):
    valid = (F.col("status") == "ok") & F.col("reply").isNotNull()
    ledger = RequestLedger(spark, f"{tmp_dir}/ledger", valid)
    reqs = spark.createDataFrame([("a",), ("b",), ("c",), ("c",), (None,)], "request_id string")
    assert ledger.last_round() == -1
    ledger.enter(reqs)
    ledger.enter(reqs)  # again: nothing new
    assert ledger.open_after(0).count() == 3 and ledger.last_round() == 0
    first = spark.createDataFrame([("a", "ok", "yes", 0), ("b", "error", None, 0), ("x", "ok", "stray", 0)], REPLY)
    for _ in range(2):  # settled twice: the same state
        assert ledger.settle(first, 1) == {"answered": 1, "open": 2, "ignored": 1}
    assert sorted(r.request_id for r in ledger.to_send(reqs.distinct(), 1).collect()) == ["b", "c"]
    state = {r.request_id: (r.attempts, r.last_status) for r in ledger.open_after(1).collect()}
    assert state == {"b": (1, "error"), "c": (0, None)}  # open requests alone
    second = spark.createDataFrame([("a", "ok", "late", 0), ("b", "error", None, 0), ("b", "ok", "2nd", 1), ("b", "ok", "3rd", 2),
                                    ("c", "ok", None, 0)], REPLY)
    assert ledger.settle(second, 2) == {"answered": 1, "open": 1, "ignored": 1}
    got = {r.request_id: (r.reply, r.attempts, r.round) for r in ledger.answers().collect()}
    assert got == {"a": ("yes", 1, 1), "b": ("2nd", 4 - 0, 2)}
    ledger.enter(spark.createDataFrame([("a",), ("c",), ("d",)], "request_id string"), 2)  # answered, open and new
    assert sorted(r.request_id for r in ledger.open_after(2).collect()) == ["c", "d"]
    # replies without an attempt column
    assert ledger.settle(spark.createDataFrame([("c", "ok", "at last"), ("d", "ok", "d")], "request_id string, status string, reply string"),
                         3) == {"answered": 2, "open": 0, "ignored": 0}
    assert ledger.open_after(3).count() == 0 and ledger.last_round() == 3


# ---------------------------------------------------------------------- loop
def inputs(spark):
    qca = "struct<questions:array<string>,choices:array<string>,answers:array<string>>"
    evals = spark.createDataFrame([(1, ((["kite?"], ["yes, no"], ["yes"])), ["kite", "sky"]), (2, ((["boat?"], ["yes, no"], ["no"])), ["boat"])],
                                  f"prompt_id long, qca {qca}, chunks array<string>")
    prompts = spark.createDataFrame([(1, "a kite"), (2, "a boat")], "prompt_id long, original_prompt string")
    return prompts, evals


def answers(log, missing=()):
    def ask(stage, reqs):
        got = reqs.collect()
        log.append((stage, sorted(r.request_id for r in got)))
        if stage in missing:
            return None
        reply = {"generate": "P", "select": "one\ntwo", "tifa": "yes", "vqa": "yes"}[stage]
        return reqs.select("request_id", F.lit("ok").alias("status"), F.lit(reply).alias("reply"))
    return ask


def test_iterative_run_goes_on_where_it_stopped(spark, tmp_dir):
    prompts, evals = inputs(spark)
    path, log = f"{tmp_dir}/run", []
    assert loop.iterative_run(path, prompts, evals, answers(log, missing=("vqa",)), 2, "ds") == 0
    first = [x for x in log if x[0] == "vqa"]
    log.clear()
    assert loop.iterative_run(path, prompts, evals, answers(log), 2, "ds") == 2
    assert [x for x in log if x[0] == "vqa"][:1] == first  # the same requests again, from the table
    assert [s for s, _ in log].count("generate") == 2
    table = loop.finished(spark, path)
    assert table.count() == 8 and table.where("sum is null").count() == 0
    log.clear()
    assert loop.iterative_run(path, prompts, evals, answers(log), 3, "ds") == 3  # only the new iteration is asked
    assert [s for s, _ in log] == ["generate", "select", "tifa", "vqa"]
    log.clear()
    assert loop.iterative_run(path, prompts, evals, answers(log), 3, "ds") == 3 and not log
    result, _ = jobs.iterative_results(loop.finished(spark, path), prompts)
    assert {r.prompt_id: (r.best_iter, r.best_paraphrase) for r in result.collect()} == {1: (2, "one"), 2: (2, "one")}


def test_resumed_scoring_asks_for_pending_candidates_alone(spark, tmp_dir):
    _, evals = inputs(spark)
    cands = spark.createDataFrame([(1, 0, 0, "k0"), (1, 0, 1, "k1"), (2, 0, 0, "b0")],
                                  "prompt_id long, iter int, cand_pos int, revised_prompt string")
    path, log = f"{tmp_dir}/scores", []
    one = loop.score_pending(path, cands.where("prompt_id = 1"), evals, answers(log), "ds", call=0)
    assert one.count() == 2
    asked = dict(log)
    log.clear()
    both = loop.score_pending(path, cands, evals, answers(log), "ds", call=1)
    assert {(r.prompt_id, r.cand_pos): r.tifa for r in both.collect()} == {(1, 0): 1.0, (1, 1): 1.0, (2, 0): 0.0}
    assert all(len(ids) == 1 and not set(ids) & set(asked[stage]) for stage, ids in log)  # b0's alone
    log.clear()
    changed = cands.withColumn("revised_prompt", F.when(F.col("cand_pos") == 1, "new").otherwise(F.col("revised_prompt")))
    again = loop.score_pending(path, changed, evals, answers(log), "ds")
    assert sorted(r.revised_prompt for r in again.collect()) == ["b0", "k0", "new"]
    assert len(dict(log)["tifa"]) == 1  # a candidate of another text is another candidate
    other = changed.withColumn("revised_prompt", F.lit("z"))
    assert loop.score_pending(path, other, evals, answers(log, ("tifa",)), "ds") is None  # replies are missing
    last = loop.score_pending(path, other.where("prompt_id = 2").unionByName(changed), evals, answers(log), "ds")
    assert sorted(r.revised_prompt for r in last.collect()) == ["b0", "k0", "new", "z"]  # not what the unfinished call had


# ---------------------------------------------------------------------- rows
def test_occurrence_numbers(spark):
    rnd = random.Random(2)
    data = [(i, rnd.choice(["a", "a", "a", "b", None, f"u{i}"])) for i in range(500)]
    got = {r.k: r.occurrence for r in rows.with_occurrence(frame(spark, data).repartition(5), ["v"], "k", block=16).collect()}
    seen = {}
    for k, v in data:
        assert got[k] == seen.get(v, 0)
        seen[v] = seen.get(v, 0) + 1


def test_content_keys_survive_inserted_lines(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/p", exist_ok=True)
    put = lambda name, lines: open(f"{tmp_dir}/p/{name}", "w").write("\n".join(lines) + "\n")
    put("1.txt", ["cat", "dog", "cat", "", "fox"])
    put("2.txt", ["new", "cat", "cat", "fox", "cat", "", ""])
    one, two = (jobs.keyed_lines(spark, f"{tmp_dir}/p/{n}.txt") for n in (1, 2))
    first = jobs.content_requests(one, "ds")
    later = jobs.content_requests(two, "ds", answered=first)
    assert later.count() == 3  # "new", the third cat, the second blank line
    replies = first.unionByName(later).select("request_id", F.concat("prompt_key", F.lit("!")).alias("reply"))
    table = jobs.content_noun_chunk_table(two, "ds", replies).orderBy("line_no").collect()
    assert [r.prompt for r in table] == ["new", "cat", "cat", "fox", "cat", "", ""]
    assert jobs.content_requests(one, "other").join(first, "request_id").count() == 0


# --------------------------------------------------------------------- files
def test_result_files_with_quoted_line_ends_and_splits(spark, tmp_dir):
    root = f"{tmp_dir}/res"
    os.makedirs(root)
    open(f"{root}/ds_process0_nextline_40.csv", "w").write('id,original_prompt,extra\n1,"two\nlines, ""quoted""",x\n\n2,plain,"a,b"\n')
    open(f"{root}/ds_process1_nextline_40.csv", "w").write("original_prompt,id\r\nwindows,3\r\n")
    open(f"{root}/ds_combined.csv", "w").write("id,original_prompt\n" + "".join(f"{i},row {i}\n" for i in range(100, 3000)))
    open(f"{root}/ds_process2_nextline_40.csv", "w").write("")
    open(f"{root}/ds_process3_nextline_40.csv", "w").write("id,original_prompt\n")
    open(f"{root}/dsx_process0_nextline_40.csv", "w").write("id,original_prompt\n7,other\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = io.read_result_shards(spark, root, "ds", "id long, original_prompt string, extra string")
        small = sorted((r.id, r.original_prompt, r.extra, r.process, r.source_rank) for r in got.where("id < 100").collect())
        assert small == [(1, 'two\nlines, "quoted"', "x", 0, 1), (2, "plain", "a,b", 0, 1), (3, "windows", None, 1, 1)]
        whole = got.where("source_rank = 0")
        assert [r.id for r in whole.orderBy("position").collect()] == list(range(100, 3000))  # one order over all splits
        assert whole.select(F.countDistinct("position.block")).first()[0] > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_csv_records_over_split_ends(spark, tmp_dir):
    rnd = random.Random(5)
    piece = lambda: "".join(rnd.choice(['a', 'b,', '"', "\n", "\n\n", " x ", "é"]) for _ in range(rnd.randrange(1, 60)))
    data = [(i, piece(), None if i % 7 == 0 else "v") for i in range(400)]
    frame_ = spark.createDataFrame(data, "k long, t string, v string").coalesce(1)
    io.write_csv(frame_, f"{tmp_dir}/csv")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = io.read_split_csv(spark, f"{tmp_dir}/csv", "k long, t string, v string", pandas_na=False)
        assert sorted((r.k, r.t, r.v) for r in got.collect()) == data
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert io.read_split_csv(spark, f"{tmp_dir}/csv/_SUCCESS", "k long").count() == 0


def test_files_are_packed_by_size(spark, tmp_dir):
    rnd = random.Random(3)
    sizes = [(f"p{i:04d}", rnd.choice([1, 10, 500, 5000])) for i in range(300)]
    got = io.pack_files(spark.createDataFrame(sizes, "path string, length long"), 1000).orderBy("path").collect()
    total, want = 0, []
    for path, n in sizes:
        want.append((path, n, total // 1000))
        total += n
    assert [(r.path, r.length, r.pack) for r in got] == want


def test_gallery_pages_are_one_file_each(spark, tmp_dir):
    data = spark.range(25).select(F.col("id").alias("k"), F.lit("t").alias("original_prompt"), F.lit("i.png").alias("image_path"))
    io.write_gallery(*history.gallery_pages(data, ["k"], per_page=10), f"{tmp_dir}/g")
    for page in range(3):
        assert len(os.listdir(f"{tmp_dir}/g/pages/page={page}")) == 1
    assert spark.read.schema("value string, page long").text(f"{tmp_dir}/g/pages").where("value like '<li>%'").count() == 25


def test_gallery_pages_and_index(spark, tmp_dir):
    data = spark.createDataFrame([(i, f"p<{i}>", f"img{i}.png") for i in range(25)], "k long, original_prompt string, image_path string")
    io.write_gallery(*history.gallery_pages(data, ["k"], per_page=10), f"{tmp_dir}/g")
    pages = spark.read.schema("value string, page long").text(f"{tmp_dir}/g/pages")
    assert {r.page: r.n for r in pages.where("value like '<li>%'").groupBy("page").agg(F.count("*").alias("n")).collect()} == {0: 10, 1: 10, 2: 5}
    assert pages.where("value like '%<ol start=\"11\">%'").select("page").collect()[0].page == 1
    one = [n for n in os.listdir(f"{tmp_dir}/g/pages/page=1") if n.startswith("part-")]
    text = open(f"{tmp_dir}/g/pages/page=1/{one[0]}").read()
    assert len(one) == 1 and text.startswith(history.HTML_HEADER.split("\n")[0]) and text.rstrip().endswith("</html>")
    assert text.index("p&lt;10&gt;") < text.index("p&lt;19&gt;")
    index = [r.value for r in spark.read.text(f"{tmp_dir}/g/index").collect()]
    assert any("page=2" in v and "20 to 24" in v and "(5)" in v for v in index)
    empty = history.gallery_pages(data.limit(0), ["k"])
    assert empty[0].count() == 0 and empty[1].count() == 2


def test_one_pass_split_counts_what_it_writes(spark, tmp_dir):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def once(k):
        calls.add(1)
        return k
    data = frame(spark, [(i, None if i == 5 else "x" * (i % 3)) for i in range(30)]).withColumn("k", once("k"))
    good, bad, n = jobs.split_once(data, F.length("v") == 0, f"{tmp_dir}/split")
    assert n == {"accepted": good.count(), "rejected": bad.count()} == {"accepted": 19, "rejected": 11}
    assert calls.value == 30 and 5 in [r.k for r in bad.collect()]


def test_all_training_formats_from_one_table(spark, tmp_dir):
    data = spark.createDataFrame([("o", "r", "Correct."), ("p", "r", "c")], "original_prompt string, best_paraphrase string, fix string")
    folders = jobs.write_training_tables(data, f"{tmp_dir}/train", corrected="fix")
    assert sorted(folders) == ["chatml", "gemma", "hf", "qwen", "test"]
    got = spark.read.json(folders["test"]).collect()
    assert sorted((r.original_prompt, r.rephrased_and_corrected_prompt) for r in got) == [("o", "r"), ("p", "c")]
    with pytest.raises(ValueError):
        jobs.write_training_tables(data, f"{tmp_dir}/no", formats=("hf", "pdf"))


def test_gallery_shuffles_what_entries_are_made_of(spark, tmp_dir):
    scored = spark.createDataFrame([(1, 0, 0, "a<b", 1.0, 0.5, 1.5), (1, 0, -1, "p", 0.5, 0.5, 1.0), (2, 0, 0, "c", 0.0, 0.0, 0.0)],
                                   "prompt_id long, iter int, cand_pos int, revised_prompt string, tifa double, vqa double, sum double")
    prompts = spark.createDataFrame([(1, "p"), (2, None), (2, "twice")], "prompt_id long, original_prompt string")
    ann = jobs.annotation_run(scored, prompts, "ds", f"{tmp_dir}/g", per_page=2)
    want = sorted(r.image_path for r in ann.where("original_prompt is not null").collect())
    html = [r.value for r in spark.read.text(f"{tmp_dir}/g/pages").where("value like '<li>%'").collect()]
    got = sorted(x.split('src="')[1].split('"')[0] for x in html)
    assert got == want and len(got) == 4
    data = spark.range(9).select(F.col("id").alias("k"), F.lit("t").alias("original_prompt"), F.lit("i.png").alias("image_path"))
    pages, _ = history.gallery_pages(data, ["k"], per_page=4)
    text = pages._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("<li>") < text.index("RepartitionByExpression")  # printed top down: entries behind the exchange
    tables = pages.inputFiles()
    assert tables and os.path.exists(tables[0].removeprefix("file://").removeprefix("file:"))
    session.dropped(pages)
    assert not os.path.exists(os.path.dirname(tables[0].removeprefix("file://").removeprefix("file:")))
