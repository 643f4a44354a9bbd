"""Readers and writers for the files the pipeline exchanges
(SURVEY S1-S10 and K1-K8).

All readers return lazy DataFrames; writers use Spark's atomic task commit, so
a lost executor re-runs its task instead of leaving half-written files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptforge.functions.text import one_line, strip
from promptforge.operators.merge import with_shard_parts
from promptforge.operators.rows import total_before, with_line_numbers
from promptforge.session import scratch_dir, shuffles_released
from promptforge.sources import commits

QCA_SCHEMA = T.StructType([
    T.StructField("prompt", T.StringType()),
    T.StructField("qca", T.StructType([
        T.StructField("questions", T.ArrayType(T.StringType())),
        T.StructField("choices", T.ArrayType(T.StringType())),
        T.StructField("answers", T.ArrayType(T.StringType())),
    ])),
])

# Names pandas / Spark give an unnamed leading index column.
INDEX_COLUMNS = ("_c0", "Unnamed: 0", "")

# The strings pandas' read_csv turns into NaN by default (the
# reference reads every CSV with pandas); Spark only nulls the empty field.
PANDAS_NA = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

_CSV_OPTS = dict(header=True, multiLine=True, quote='"', escape='"',
                 ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


# ------------------------------------------------------------------ sources
def read_prompt_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line of the prompt file(s), stripped, blank lines kept, with a
    0-based ``line_no`` in file order."""
    lines = spark.read.text(path)
    return with_line_numbers(lines).select("line_no", strip("value").alias("prompt"))


def read_prompt_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Every ``*.txt`` directly inside ``folder`` (not recursive) as one
    prompt set; each line newline->space, stripped."""
    return spark.read.text(f"{folder.rstrip('/')}/*.txt").select(one_line("value").alias("prompt"))


def _as_schema(spark: SparkSession, schema: T.StructType | str) -> T.StructType:
    if isinstance(schema, T.StructType):
        return schema
    return spark.createDataFrame([], schema).schema


def _by_name(df: DataFrame, schema: T.StructType | None, extra: tuple[str, ...] = ()) -> DataFrame:
    """Drop unnamed index columns, then select the schema's columns by header
    name (``try_cast``: unparsable values become null, as in PERMISSIVE mode),
    plus the ``extra`` columns unchanged."""
    df = df.drop(*[c for c in df.columns if c in INDEX_COLUMNS])
    if schema is None:
        return df
    fields = [f for f in schema.fields if f.name not in INDEX_COLUMNS]
    return df.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in fields], *extra)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             pandas_na: bool = True) -> DataFrame:
    """CSV with header, quoted commas / newlines.  Columns are matched to
    ``schema`` by header name, not position, so a leading unnamed index column
    (as pandas writes it) is simply dropped.  With ``pandas_na`` the NA
    spellings pandas reads as missing become null in string columns
    (SURVEY 4.3 #9)."""
    df = _by_name(spark.read.options(**_CSV_OPTS).csv(path),
                  _as_schema(spark, schema) if schema is not None else None)
    return _without_na(df) if pandas_na else df


def read_qca_json(spark: SparkSession, path: str, array_file: bool = False) -> DataFrame:
    """QCA records; ``array_file`` for one JSON array per file, else JSON lines."""
    return spark.read.schema(QCA_SCHEMA).option("multiLine", array_file).json(path)


def read_optional(read, *args, **kwargs) -> DataFrame | None:
    """A reader whose path may be missing returns None instead of failing,
    so the caller's plan can choose between QCA, noun chunks or both."""
    from pyspark.errors import AnalysisException
    try:
        return read(*args, **kwargs)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return None
        raise


def _file_lines(spark: SparkSession, pattern: str) -> DataFrame:
    """(file, at, line): all lines of the files; ``at`` orders those of a file,
    however it was split."""
    lines = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(pattern)
    # a split's rows are in file order and its offset in the file is known
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return lines.select(F.col("_metadata.file_path").alias("file"), at.alias("at"), F.col("value").alias("line"))


def _quotes(c) -> F.Column:
    return F.length(c) - F.length(F.replace(c, F.lit('"'), F.lit("")))


def _records(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """(file, at, record).  Files in which every line holds an even number of
    quotes have a record per line.  In the others a line begins a record where
    the file's quotes so far are even.  Both stay split: a split's quotes are
    counted by itself, and what lies before it in its file (quotes, and the last
    record that began there) comes from a table of one row a split."""
    plain = lines.join(tables.where("not quoted_ends").select("file"), "file", "left_semi").select(
        "file", "at", F.regexp_replace("line", "\r$", "").alias("record"))
    joined = lines.join(tables.where("quoted_ends").select("file"), "file", "left_semi").withColumn("_block", F.col("at.block"))
    ahead = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # the splits of a file
    inside = Window.partitionBy("file", "_block").orderBy("at")
    quotes = joined.groupBy("file", "_block").agg(F.sum(_quotes("line")).alias("_q"))
    quotes = quotes.withColumn("_ahead", F.coalesce(F.sum("_q").over(ahead), F.lit(0)))
    own = F.coalesce(F.sum(_quotes("line")).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = joined.withColumn("_own", own).join(quotes, ["file", "_block"])
    marked = marked.withColumn("_begin", F.when((F.col("_ahead") + F.col("_own")) % 2 == 0, F.col("at")))
    marked = marked.withColumn("_record", F.max("_begin").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    starts = marked.groupBy("file", "_block").agg(F.max("_begin").alias("_last"))
    starts = starts.select("file", "_block", F.max("_last").over(ahead).alias("_carry"))
    whole = marked.join(starts, ["file", "_block"]).groupBy("file", F.coalesce("_record", "_carry").alias("at")).agg(
        F.array_sort(F.collect_list(F.struct("at", "line"))).alias("l"))  # a record's lines are one value anyway
    whole = whole.select("file", "at", F.regexp_replace(F.array_join("l.line", "\n"), "\r$", "").alias("record"))
    return plain.unionByName(whole).where("record <> ''")


def _csv_rows(spark: SparkSession, lines: DataFrame, st: T.StructType) -> DataFrame | None:
    """The records of CSV files with headers: the columns of ``st`` by header
    name (null where a file lacks one), ``file`` and ``position``.  None if there
    is no line at all.

    The headers go into a table of one row a file (written under the checkpoint
    folder); records are parsed by position and matched to their file's header
    in a join, so neither the driver nor the plan holds the files one by one."""
    tables = lines.groupBy("file").agg(F.min(F.struct("at", "line")).alias("first"), F.max(_quotes("line") % 2 == 1).alias("quoted_ends"))
    tables = tables.select("file", F.col("first.at").alias("header_at"), F.regexp_replace("first.line", "\r$", "").alias("header"),
                           "quoted_ends")
    path = scratch_dir(spark, "csv-files")
    tables.write.parquet(path)
    tables = spark.read.parquet(path)
    # one number to the driver: the largest number of columns (commas bound it)
    width = tables.agg(F.max(F.length("header") - F.length(F.replace("header", F.lit(","), F.lit(""))) + 1)).first()[0]
    if width is None:
        return None
    columns = [f"c{i}" for i in range(width)]
    options = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
               "maxCharsPerColumn": "-1"}

    def cells(df: DataFrame, text: str, name: str) -> DataFrame:
        parsed = df.withColumn("_csv", F.from_csv(text, ", ".join(f"{c} string" for c in columns), options))
        return parsed.withColumn(name, F.array(*[F.col(f"_csv.{c}") for c in columns])).drop("_csv")

    heads = cells(tables, "header", "names").select("file", "header_at", "names")
    rows = _records(lines, tables).join(heads, "file").where(F.col("at") != F.col("header_at"))
    picked = [F.get("cells", F.array_position("names", F.lit(f.name)) - 1).try_cast(f.dataType).alias(f.name)
              for f in st.fields if f.name not in INDEX_COLUMNS]
    return cells(rows, "record", "cells").select(*picked, "file", F.col("at").alias("position"))


def read_split_csv(spark: SparkSession, path: str, schema: T.StructType | str, pandas_na: bool = True) -> DataFrame:
    """S4 for large files: as :func:`read_csv`, but a file is split however its
    fields are quoted, line ends in them included.  Two passes over the text come
    before the rows: one for headers, one for quotes where lines are joined."""
    st = _as_schema(spark, schema)
    out = _csv_rows(spark, _file_lines(spark, path), st)
    if out is None:
        return spark.createDataFrame([], T.StructType([f for f in st.fields if f.name not in INDEX_COLUMNS]))
    return _without_na(out.drop("file", "position")) if pandas_na else out.drop("file", "position")


def _without_na(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(~F.col(f.name).isin(PANDAS_NA), F.col(f.name)).alias(f.name)
                       if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema.fields])


def read_result_shards(spark: SparkSession, root: str, name: str, schema: T.StructType | str) -> DataFrame:
    """S7 + S8: the result files of dataset ``name`` under ``root``, in either
    layout: ``{name}_process{p}_nextline_{n}.csv`` and ``{name}_combined.csv``
    side by side (files, or folders of part files), or ``shard=<file name>``
    folders.  The whole name must match, so a longer dataset name is another
    dataset.  Empty files are skipped.

    Files may have different headers (:func:`_csv_rows`).

    Adds ``file_name``, ``process``, ``nextline``, ``source_rank`` (0 for the
    combined file, 1 for shards), ``file`` and ``position`` (a struct), which
    orders the rows of a file as they stand in it.
    """
    from pyspark.errors import AnalysisException

    root = root.rstrip("/")
    exact = rf"/(?:shard=)?(\Q{name}\E_(?:process\d+_nextline_\d+|combined)\.csv)(?:/|$)"
    lines = _file_lines(spark, f"{root}/{{{name}_*.csv,shard={name}_*.csv}}").where(F.regexp_extract("file", exact, 1) != "")
    out = _csv_rows(spark, lines, _as_schema(spark, schema))
    if out is None:
        raise AnalysisException(f"PATH_NOT_FOUND: no result files of dataset {name!r} under {root}")
    out = out.withColumn("file_name", F.regexp_extract("file", exact, 1))
    out = out.withColumn("source_rank", F.when(F.endswith("file_name", F.lit("_combined.csv")), 0).otherwise(1))
    return with_shard_parts(out, "file_name")


def read_images(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Files as bytes (``path``, ``length``, ``content`` + partition columns)."""
    r = spark.read.format("binaryFile")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path)


def pack_files(files: DataFrame, target_bytes: int) -> DataFrame:
    """(path, length) -> (path, length, pack): files in the order of their paths,
    packed into runs of about ``target_bytes``: a file's run is the number of
    whole targets before it."""
    totals = total_before(files.select("path", "length"), "path", "length", "before")
    return totals.select("path", "length", F.floor(F.col("before") / target_bytes).cast("long").alias("pack"))


def read_packed_images(spark: SparkSession, path: str, target_bytes: int = 64 << 20, glob: str | None = None) -> DataFrame:
    """S9 by size: the paths and lengths are listed without reading a file, packed
    into runs of about ``target_bytes``, and each run's files are read together:
    (path, length, content, partition columns, pack)."""
    files = read_images(spark, path, glob)
    packs = pack_files(files.select("path", "length"), target_bytes).select("path", "pack")
    return files.join(packs, "path")


def parse_list_col(c, elem_type: str = "double"):
    """A stringified list (``[0.5, 0.75]`` / ``['a', 'b']``) back to an array."""
    return F.from_json(c if not isinstance(c, str) else F.col(c), f"array<{elem_type}>",
                       {"allowSingleQuotes": "true", "allowNonNumericNumbers": "true"})


# -------------------------------------------------------------------- sinks
def write_prompt_lines(df: DataFrame, path: str, col: str = "prompt", mode: str = "overwrite") -> None:
    """K1: one prompt per line, newline->space, stripped."""
    df.select(one_line(col).alias("value")).write.mode(mode).text(path)


def _flatten_for_csv(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            cols.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def write_csv(df: DataFrame, path: str, index_col: str | None = None, mode: str = "overwrite") -> None:
    """K2 / K3: CSV with header; nested values as JSON text; ``index_col`` (a
    G4 row index) is written first when given."""
    out = _flatten_for_csv(df)
    if index_col:
        out = out.select(index_col, *[c for c in out.columns if c != index_col])
    out.write.mode(mode).options(**_CSV_OPTS).csv(path)


def write_result_shards(df: DataFrame, root: str, shard_col: str = "file_name", mode: str = "append") -> None:
    """K8 counterpart of S7: one folder and one file per shard name (rows are
    brought together by shard first, not one file per task and shard)."""
    _flatten_for_csv(df).withColumnRenamed(shard_col, "shard").repartition("shard").write.mode(mode).partitionBy("shard") \
        .options(**_CSV_OPTS).csv(root)


def append_annotations(df: DataFrame, path: str, run: str) -> None:
    """The annotation rows of one run are added to the existing ones (no
    rewrite).  They live in a folder of their own, so writing a run again
    replaces its rows instead of adding them twice."""
    _flatten_for_csv(df).write.mode("overwrite").options(**_CSV_OPTS).csv(f"{path.rstrip('/')}/run={run}")


def read_annotations(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """All runs of :func:`append_annotations`."""
    return read_csv(spark, f"{path.rstrip('/')}/run=*", schema)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K4: JSON records (one per line)."""
    df.write.mode(mode).json(path)


def write_averages(df: DataFrame, path: str) -> None:
    """K5: the long (metric, value) averages table."""
    df.select("metric", "value").coalesce(1).write.mode("overwrite").options(**_CSV_OPTS).csv(path)


def write_timer_summary(df: DataFrame, path: str) -> None:
    """K6: ``Purpose, Average Time`` in first-seen order (one row per purpose)."""
    out = df.orderBy("first_seq").select(F.col("purpose").alias("Purpose"),
                                          F.col("average_time").alias("Average Time"))
    out.coalesce(1).write.mode("overwrite").options(**_CSV_OPTS).csv(path)


def write_annotation_html(blocks: DataFrame, path: str, order_cols: list[str]) -> None:
    """K7: the gallery page, parts in order (range-partitioned sort: part files
    follow the order)."""
    blocks.orderBy("part", *order_cols).select("html").write.mode("overwrite").text(path)


# so many small files: on file: paths, Hadoop starts several processes a file for a checksum file and its rights
_PAGE_OPTS = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def write_gallery(pages: DataFrame, index: DataFrame, path: str) -> None:
    """K7 by pages: ``history.gallery_pages`` as one file a page (folders
    ``pages/page=<n>``) and the index page beside them.  On a local file system
    a page's file has no checksum file beside it (other systems make none)."""
    with shuffles_released(pages.sparkSession):
        pages.select("page", "html").write.mode("overwrite").options(**_PAGE_OPTS).partitionBy("page").text(f"{path}/pages")
        index.orderBy("part", "page").select("html").write.mode("overwrite").text(f"{path}/index")


def write_batch(df: DataFrame, path: str, batch_id: str | int) -> None:
    """K8: results of one call, added exactly once: a repeated batch id replaces
    its rows, and readers see complete batches alone (``sources.commits``)."""
    commits.commit_batch(df, path, batch_id)


def write_incremental(df: DataFrame, path: str, batch_col: str = "batch_no") -> None:
    """K8 without a batch id: results are appended per call, so a repeated call
    repeats its rows (:func:`write_batch` does not).  The batch number is a
    column of ordinary files (a folder for every few rows would drown the file
    system)."""
    df.sortWithinPartitions(batch_col).write.mode("append").parquet(path)
