"""A ledger of requests that are asked until they are answered.

    <path>/open      one committed batch per round: the requests still open after it,
                     with attempts so far, the status of the last reply and the round of entry
    <path>/answers   one committed batch per round: the requests that round answered

The state that a round reads and writes holds the open requests alone; an
answer leaves it for good, so a second reply, or one that comes late, meets no
open request and changes nothing.  A round that is run again replaces its own
two batches and leaves the same rows.  A reply to a request that the ledger
does not hold is counted in ``ignored`` of the round's summary and not kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from promptforge.sources import commits

OPEN = "request_id string, attempts long, last_status string, entered long"
ANSWERS = "request_id string, attempts long, status string, reply string, round long"


class RequestLedger:
    """Requests by ``request_id``; replies as (request_id, status, reply[, attempt]).
    ``valid`` says of a reply row whether it answers; null counts as no."""

    def __init__(self, spark: SparkSession, path: str, valid: Column):
        self.spark, self.path, self.valid = spark, path.rstrip("/"), F.coalesce(valid, F.lit(False))

    def open_after(self, number: int) -> DataFrame:
        """The state after round ``number`` (0: before any reply)."""
        rows = commits.read_committed(self.spark, f"{self.path}/open", OPEN, "_batch")
        return rows.where(F.col("_batch") == str(number)).drop("_batch")

    def answers(self) -> DataFrame:
        return commits.read_committed(self.spark, f"{self.path}/answers", ANSWERS)

    def last_round(self) -> int:
        """The last complete round, -1 before the requests are entered."""
        done = commits.live(self.spark, f"{self.path}/open").agg(F.max(F.col("batch_id").cast("long"))).first()[0]
        return -1 if done is None else done

    def enter(self, requests: DataFrame, number: int = 0) -> None:
        """Add requests to the state of round ``number``: those that are neither
        open nor answered yet.  Entering the same requests again adds nothing."""
        new = requests.select("request_id").where("request_id is not null").distinct()
        new = new.join(self.answers().select("request_id"), "request_id", "left_anti")
        new = new.select("request_id", F.lit(0).cast("long").alias("attempts"), F.lit(None).cast("string").alias("last_status"),
                         F.lit(number).cast("long").alias("entered"))
        if self.last_round() >= number:
            known = self.open_after(number)
            new = known.unionByName(new.join(known.select("request_id"), "request_id", "left_anti"))
        commits.commit_batch(new, f"{self.path}/open", number)

    def to_send(self, requests: DataFrame, number: int) -> DataFrame:
        """The requests (all columns) that round ``number + 1`` asks."""
        return requests.join(self.open_after(number).select("request_id", "attempts"), "request_id")

    def settle(self, replies: DataFrame, number: int) -> dict[str, int]:
        """Take the replies of round ``number``: open requests with a valid one
        leave as answered, the others stay with one more attempt per reply.
        Returns the round's counts; the replies are read once."""
        rank = F.col("attempt") if "attempt" in replies.columns else F.lit(0)
        order = F.struct(rank.alias("a"), F.col("status").alias("s"), F.col("reply").alias("r"))
        last = F.struct(rank.alias("a"), F.col("status").alias("s"))  # the text decides nothing here and stays behind
        # map-side combined: a request that was answered a million times is one row a task
        one = replies.where("request_id is not null").groupBy("request_id").agg(
            F.count(F.lit(1)).alias("n"), F.max(last).alias("last"), F.min(F.when(self.valid, order)).alias("good"))
        joined = self.open_after(number - 1).withColumn("_open", F.lit(True)).join(one, "request_id", "full")
        known = F.col("_open").isNotNull()
        tries = F.col("attempts") + F.coalesce("n", F.lit(0))
        seen = Observation()
        joined = joined.observe(
            seen, F.count(F.when(known & F.col("good").isNotNull(), 1)).alias("answered"),
            F.count(F.when(known & F.col("good").isNull(), 1)).alias("open"), F.count(F.when(~known, 1)).alias("ignored"))
        path = f"{self.path}/settling/round={number}"
        joined.where(known).select("request_id", tries.alias("attempts"), F.coalesce("last.s", "last_status").alias("last_status"),
                                   "entered", F.col("good.s").alias("status"), F.col("good.r").alias("reply"),
                                   F.col("good").isNotNull().alias("answered")).write.mode("overwrite").option(
                                       "compression", "zstd").partitionBy("answered").parquet(path)
        rows = self.spark.read.schema(f"{OPEN}, status string, reply string, answered boolean").parquet(path)
        commits.commit_batch(rows.where("answered").select("request_id", "attempts", "status", "reply",
                                                           F.lit(number).cast("long").alias("round")), f"{self.path}/answers", number)
        commits.commit_batch(rows.where("not answered").select("request_id", "attempts", "last_status", "entered"),
                             f"{self.path}/open", number)
        return dict(seen.get)
