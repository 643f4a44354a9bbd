"""Result shards: name parsing, latest shard, union, first-wins dedup
(SURVEY S7, S8, A12, U1, U2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptforge.functions.text import _col

# Fixed value: how result shard files are named.
SHARD_PATTERN = r"process(\d+)_nextline_(\d+)"


def shard_process(c) -> Column:
    return F.regexp_extract(_col(c), SHARD_PATTERN, 1).cast("int")


def shard_nextline(c) -> Column:
    return F.regexp_extract(_col(c), SHARD_PATTERN, 2).cast("int")


def with_shard_parts(df: DataFrame, name_col: str = "file_name") -> DataFrame:
    """``process`` / ``nextline`` from the shard name (null when it does not match)."""
    ok = F.col(name_col).rlike(SHARD_PATTERN)
    return (df.withColumn("process", F.when(ok, shard_process(name_col)))
              .withColumn("nextline", F.when(ok, shard_nextline(name_col))))


def latest_shard(shards: DataFrame, name_col: str = "file_name") -> DataFrame:
    """The highest-``nextline`` file of each process."""
    parts = with_shard_parts(shards.select(name_col).distinct(), name_col).filter(F.col("process").isNotNull())
    best = parts.groupBy("process").agg(F.max(F.struct("nextline", name_col)).alias("_b"))
    return best.select("process", F.col("_b.nextline").alias("nextline"),
                       F.col(f"_b.{name_col}").alias(name_col))


def merge_results(*frames: DataFrame) -> DataFrame:
    """Union all by column name; missing columns become null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def dedup_keep_first(df: DataFrame, key: str, order_cols: list[str]) -> DataFrame:
    """One row per ``key``, the first in ``order_cols`` order (combined file
    first, then shards by process and position).  A partial ``min(struct)``
    aggregate, so a hot key is pre-combined on the map side; null keys dropped."""
    rest = [c for c in df.columns if c != key and c not in order_cols]
    st = F.struct(*[F.col(c) for c in order_cols], *[F.col(c) for c in rest])
    agg = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(st).alias("_f"))
    return agg.select(key, *[F.col(f"_f.{c}").alias(c) for c in order_cols + rest])
