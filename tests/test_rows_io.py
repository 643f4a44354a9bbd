import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from promptforge.operators import rows
from promptforge.sources import io


def test_row_index_dense_and_ordered(spark):
    df = spark.range(0, 5000, 1, numPartitions=7).select((F.col("id") * 7 % 5003).alias("k"),
                                                          F.lit("x").alias("wide"))
    for unique in (False, True):
        got = rows.with_row_index(df, ["k"], with_total=True, unique_keys=unique).orderBy("k").collect()
        assert [r.row_index for r in got] == list(range(5000))
        assert {r._pf_total for r in got} == {5000} and {r.wide for r in got} == {"x"}


@pytest.mark.parametrize("total,n", [(10, 3), (7, 8), (16, 8), (1, 4)])
def test_shard_number_matches_contiguous_split(spark, total, n):
    df = spark.range(total).select(F.col("id").alias("row_index"), F.lit(total).alias("t"))
    got = [r.s for r in df.select(rows.shard_number("row_index", "t", n).alias("s")).orderBy("row_index").collect()]
    base, rem = divmod(total, n)
    exp = []
    for p in range(n):
        exp += [p] * (base + (1 if p < rem else 0))
    assert got == exp


def test_slice_and_first_rows(spark):
    df = spark.range(50).select(F.col("id").alias("row_index"))
    assert rows.row_slice(df, 10, 20).count() == 10
    assert rows.row_slice(df, 10, -1).count() == 40
    assert rows.row_slice(df, 10, 5).count() == 40
    top = rows.first_rows(spark.range(100).select(F.col("id").alias("k")), ["k"], 7, "i").collect()
    assert [(r.k, r.i) for r in top] == [(i, i) for i in range(7)]


def test_batches(spark):
    df = spark.range(10).select(rows.batch_number(F.col("id"), 4).alias("b"))
    assert [r.b for r in df.collect()] == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]


def test_prompt_lines_multi_file_order_and_blank_lines(spark, tmp_dir):
    os.makedirs(tmp_dir, exist_ok=True)
    with open(f"{tmp_dir}/a.txt", "w") as f:
        f.write(" first \n\nsecond\r\nthird\n")
    with open(f"{tmp_dir}/b.txt", "w") as f:
        f.write("\tfourth\n")
    got = [(r.line_no, r.prompt) for r in io.read_prompt_lines(spark, tmp_dir).orderBy("line_no").collect()]
    assert got == [(0, "first"), (1, ""), (2, "second"), (3, "third"), (4, "fourth")]


def test_prompt_folder_is_txt_only_and_not_recursive(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/sub", exist_ok=True)
    open(f"{tmp_dir}/x.txt", "w").write("a\n b \n")
    open(f"{tmp_dir}/y.csv", "w").write("nope\n")
    open(f"{tmp_dir}/sub/z.txt", "w").write("deep\n")
    assert sorted(r.prompt for r in io.read_prompt_folder(spark, tmp_dir).collect()) == ["a", "b"]


def test_csv_reads_pandas_file_with_index_quotes_and_na(spark, tmp_dir):
    os.makedirs(tmp_dir, exist_ok=True)
    pdf = pd.DataFrame({"prompt": ["a, b", 'say "hi"\nthere', "NA", ""], "n": [1, 2, 3, 4]})
    pdf.to_csv(f"{tmp_dir}/f.csv")  # leading unnamed index column, as the reference writes
    df = io.read_csv(spark, f"{tmp_dir}/f.csv", "prompt string, n int")  # by name: the index column is skipped
    got = sorted((r.n, r.prompt) for r in df.collect())
    assert got == [(1, "a, b"), (2, 'say "hi"\nthere'), (3, None), (4, None)]
    assert df.columns == ["prompt", "n"]


def test_csv_roundtrip_keeps_arrays_as_json(spark, tmp_dir):
    df = spark.createDataFrame([(0, ["a", "b"], " x ")], "row_index long, l array<string>, t string")
    io.write_csv(df, tmp_dir, index_col="row_index")
    back = io.read_csv(spark, tmp_dir, "row_index long, l string, t string").collect()[0]
    assert back.l == '["a","b"]' and back.t == " x "
    assert io.parse_list_col(F.lit("['a', 'b']"), "string") is not None


def test_qca_json_array_and_lines(spark, tmp_dir):
    os.makedirs(tmp_dir, exist_ok=True)
    pd.DataFrame({"prompt": ["p"], "qca": [{"questions": ["q"], "choices": ["a, b"], "answers": ["a"]}]}) \
        .to_json(f"{tmp_dir}/arr.json", orient="records")
    r = io.read_qca_json(spark, f"{tmp_dir}/arr.json", array_file=True).collect()[0]
    assert (r.prompt, r.qca.questions, r.qca.choices) == ("p", ["q"], ["a, b"])


def test_parse_list_col(spark):
    df = spark.createDataFrame([("[0.5, 0.75]",), ("[]",), ("['a']",)], "s string")
    got = [r[0] for r in df.select(io.parse_list_col("s")).collect()]
    assert got[0] == [0.5, 0.75] and got[1] == []


def test_result_shards_roundtrip_and_latest(spark, tmp_dir):
    from promptforge.operators import merge
    df = spark.createDataFrame(
        [("ds_process0_nextline_40.csv", 1, "p1", 0.5), ("ds_process0_nextline_80.csv", 2, "p2", 0.7),
         ("ds_process1_nextline_40.csv", 3, "p1", 0.9), ("other_process9_nextline_40.csv", 4, "q", 0.1)],
        "file_name string, row_index long, original_prompt string, score double")
    io.write_result_shards(df, tmp_dir)
    back = io.read_result_shards(spark, tmp_dir, "ds", "row_index long, original_prompt string, score double")
    assert back.count() == 3
    latest = {r.process: r.nextline for r in merge.latest_shard(back).collect()}
    assert latest == {0: 80, 1: 40}
    first = merge.dedup_keep_first(back, "original_prompt", ["process", "row_index"])
    assert {r.original_prompt: r.row_index for r in first.collect()} == {"p1": 1, "p2": 2}


def test_binary_file_source_and_data_url(spark, tmp_dir):
    from promptforge.operators import misc
    os.makedirs(tmp_dir, exist_ok=True)
    payload = bytes(range(256)) * 2
    for name in ("a.png", "b.jpg", "c.bin"):
        open(f"{tmp_dir}/{name}", "wb").write(payload)
    df = io.read_images(spark, tmp_dir, "*.*")
    got = {os.path.basename(r.path): r.u for r in df.select("path", misc.data_url("path", "content").alias("u")).collect()}
    import base64
    b64 = base64.b64encode(payload).decode()
    assert got["a.png"] == f"data:image/png;base64,{b64}"
    assert got["b.jpg"] == f"data:image/jpeg;base64,{b64}"
    assert got["c.bin"] == f"data:application/octet-stream;base64,{b64}"


def test_sinks(spark, tmp_dir):
    from promptforge.operators import misc
    df = spark.createDataFrame([(" a\nb ",), ("c",)], "prompt string")
    io.write_prompt_lines(df, f"{tmp_dir}/k1")
    assert sorted(r.value for r in spark.read.text(f"{tmp_dir}/k1").collect()) == ["a b", "c"]
    times = spark.createDataFrame([("x", 2, 1.0), ("y", 1, 3.0), ("x", 3, 2.0), ("idle", 5, None)],
                                  "purpose string, seq long, elapsed double")
    io.write_timer_summary(misc.timer_averages(times), f"{tmp_dir}/k6")
    lines = open([os.path.join(f"{tmp_dir}/k6", f) for f in os.listdir(f"{tmp_dir}/k6") if f.endswith(".csv")][0]).read()
    assert lines.splitlines() == ["Purpose,Average Time", "y,3.0", "x,1.5", "idle,-1.0"]
    inc = spark.createDataFrame([(1, 0), (2, 1)], "v long, batch_no long")
    io.write_incremental(inc, f"{tmp_dir}/k8")
    io.write_incremental(inc, f"{tmp_dir}/k8")
    assert spark.read.parquet(f"{tmp_dir}/k8").count() == 4


def test_averages_html_and_annotation_append(spark, tmp_dir):
    from promptforge.operators import history, select
    res = spark.createDataFrame([(0.5, 1.0), (0.25, 0.0)], "tifa_score double, vqa_score double")
    io.write_averages(select.run_averages_scoring(res, ["tifa_score", "vqa_score"]), f"{tmp_dir}/k5")
    back = {r.metric: r.value for r in io.read_csv(spark, f"{tmp_dir}/k5", "metric string, value double").collect()}
    assert back == {"tifa_score": 37.5, "vqa_score": 50.0}
    rows = spark.createDataFrame([(1, "b & c", "./x.png"), (0, "a", "./y.png")], "k long, original_prompt string, image_path string")
    io.write_annotation_html(history.annotation_html(rows, ["k"]), f"{tmp_dir}/k7", ["k"])
    page = "".join(open(os.path.join(f"{tmp_dir}/k7", f)).read() for f in sorted(os.listdir(f"{tmp_dir}/k7"))
                   if f.endswith(".txt"))
    assert page.startswith("<!DOCTYPE html>")
    assert page.index("<figcaption>a</") < page.index("<figcaption>b &amp; c</") < page.index("</html>")
    ann = spark.createDataFrame([(1, "p")], "k long, v string")
    for run in ("a", "b", "b"):  # a run that is written again replaces its rows
        io.append_annotations(ann, f"{tmp_dir}/u3", run)
    assert io.read_annotations(spark, f"{tmp_dir}/u3", "k long, v string").count() == 2


def test_line_numbers_survive_split_files(spark, tmp_dir):
    """One file cut into many scan splits, plus small files packed together."""
    os.makedirs(tmp_dir, exist_ok=True)
    with open(f"{tmp_dir}/a_big.txt", "w") as f:
        for i in range(5000):
            f.write(f"line {i:05d} " + "x" * (i % 37) + "\n")
    for j in range(3):
        open(f"{tmp_dir}/b_small{j}.txt", "w").write(f"small {j}\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = io.read_prompt_lines(spark, tmp_dir)
        assert df.rdd.getNumPartitions() > 20
        got = [r.prompt for r in df.orderBy("line_no").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    exp = [(f"line {i:05d} " + "x" * (i % 37)).strip() for i in range(5000)] + [f"small {j}" for j in range(3)]
    assert got == exp


def test_flat_layout_headers_names_and_file_order(spark, tmp_dir):
    from promptforge.operators import merge
    os.makedirs(tmp_dir, exist_ok=True)
    cols = ["original_prompt", "best_paraphrase"]
    pd.DataFrame([["p", "from combined"]], columns=cols).to_csv(f"{tmp_dir}/ds_combined.csv", index=False)
    pd.DataFrame([["late", "p"], ["z", "q"], ["a", "q"]], columns=cols[::-1]).to_csv(f"{tmp_dir}/ds_process0_nextline_40.csv")
    pd.DataFrame([["r", "y", 1]], columns=[*cols, "more"]).to_csv(f"{tmp_dir}/ds_process1_nextline_80.csv", index=False)
    pd.DataFrame([["tifa", 50.0]], columns=["metric", "value"]).to_csv(f"{tmp_dir}/ds_average_scores.csv")
    pd.DataFrame([["x", "other"]], columns=cols).to_csv(f"{tmp_dir}/ds2_process0_nextline_40.csv", index=False)
    pd.DataFrame([["x", "other"]], columns=cols).to_csv(f"{tmp_dir}/ds_process0_nextline_40_process0_nextline_40.csv", index=False)
    open(f"{tmp_dir}/ds_process3_nextline_40.csv", "w").close()  # empty
    df = io.read_result_shards(spark, tmp_dir, "ds", "original_prompt string, best_paraphrase string, more int")
    first = merge.dedup_keep_first(df, "original_prompt", ["source_rank", "process", "nextline", "file", "position"])
    got = {r.original_prompt: (r.best_paraphrase, r.more) for r in first.collect()}
    assert got == {"p": ("from combined", None), "q": ("z", None), "r": ("y", 1)}  # the first row of a file wins


def test_row_index_keeps_null_keys(spark):
    df = spark.createDataFrame([(2, "b"), (None, "n"), (1, "a")], "k long, v string")
    for unique in (False, True):
        got = sorted((r.row_index, r.v) for r in rows.with_row_index(df, ["k"], unique_keys=unique).collect())
        assert got == [(0, "n"), (1, "a"), (2, "b")]


def test_scratch_needs_a_shared_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from promptforge import session
    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077", getConf=lambda: SimpleNamespace(get=lambda *a: None))
    with pytest.raises(RuntimeError, match="checkpoint"):
        session.ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc))
    sc.master = "local-cluster[3,2,1024]"
    with pytest.raises(RuntimeError, match="checkpoint"):
        session.ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc))
