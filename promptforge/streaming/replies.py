"""Incremental reply ingestion with Structured Streaming.

The reference saves partial results every few rows and resumes by skipping
finished prompts.  The Spark form of that loop: reply files land in a folder
as they are produced; a streaming query picks up only new files, joins them
to the (static) request table by ``request_id``, parses them and appends the
result.  Progress lives in the checkpoint location, so a restarted or
failed run continues where it stopped, and batches are idempotent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

REPLY_SCHEMA = "request_id string, status string, reply string"


def reply_stream(spark: SparkSession, reply_dir: str, schema: str = REPLY_SCHEMA,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(reply_dir)


def ingest_replies(spark: SparkSession, reply_dir: str, requests: DataFrame, out_dir: str, checkpoint: str,
                   parse: Callable[[DataFrame], DataFrame] | None = None, available_now: bool = True,
                   schema: str = REPLY_SCHEMA, unmatched_dir: str | None = None, max_wait: int = 16) -> StreamingQuery:
    """New reply files joined with the request table (R6 / J10), optionally
    parsed, appended to Parquet under ``out_dir/batch=<n>``.

    A reply whose request is not known yet waits in ``unmatched_dir`` (beside
    ``out_dir`` by default) and is tried again with the next ``max_wait``
    batches; then it is written once to ``<unmatched_dir>_expired`` and carried
    no further, so what a batch carries does not grow with the stream's age.
    Each batch overwrites folders of its own number, so a batch that is run
    again after a failure leaves the same rows."""
    waiting = (unmatched_dir or out_dir.rstrip("/") + "_unmatched").rstrip("/")

    def write(batch: DataFrame, number: int) -> None:
        pool = batch.withColumn("waited", F.lit(0))
        if number:
            before = batch.sparkSession.read.schema(pool.schema).parquet(f"{waiting}/batch={number - 1}")
            pool = pool.unionByName(before.withColumn("waited", F.col("waited") + 1))
        joined = pool.drop("waited").join(requests, "request_id")
        out = parse(joined) if parse else joined
        out.withColumn("ingested_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/batch={number}")
        left = pool.join(requests.select("request_id"), "request_id", "left_anti").select(*pool.columns)
        left.where(F.col("waited") < max_wait).write.mode("overwrite").parquet(f"{waiting}/batch={number}")
        left.where(F.col("waited") >= max_wait).write.mode("overwrite").parquet(f"{waiting}_expired/batch={number}")

    w = reply_stream(spark, reply_dir, schema).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
