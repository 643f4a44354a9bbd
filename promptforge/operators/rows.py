"""Row numbering, batches, shards and slices.

A global 0-based index is built in two steps instead of one window over the
whole table (which would pull every row into one task):

1. range-partition and sort by the order key, then tag every row with its
   partition id and its position inside the partition;
2. count rows per partition (one row per partition — bounded by the partition
   count, not the data), turn the counts into offsets and join them back.

Numbering runs Spark jobs while it is built: the tagged rows are written to the
checkpoint folder once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptforge.session import ensure_checkpoint_dir, materialise

_PID, _POS = "_pf_pid", "_pf_pos"


def _tag_positions(df: DataFrame) -> DataFrame:
    mid = F.monotonically_increasing_id()
    return (df.withColumn(_PID, F.spark_partition_id())
              .withColumn(_POS, mid - F.shiftleft(F.col(_PID).cast("long"), 33)))


def _apply_offsets(tagged: DataFrame, group_cols: list[str], name: str,
                   with_total: bool) -> DataFrame:
    """``tagged`` rows are in final order when sorted by (group_cols, _POS);
    group_cols are constant inside a partition run."""
    counts = tagged.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_pf_n"),
                                             F.min(_POS).alias("_pf_p0"))
    # A single window group on purpose: ``counts`` has one row per (file,)
    # partition, so its size is bounded by the partition count, not the data.
    # (Spark drops the constant key and still logs "No Partition Defined for
    # Window operation" for this and for the top-k window in first_rows.)
    one = Window.partitionBy(F.lit(0))
    w = one.orderBy(*group_cols).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_pf_off", F.coalesce(F.sum("_pf_n").over(w), F.lit(0)))
    if with_total:
        offsets = offsets.withColumn(
            "_pf_total", F.sum("_pf_n").over(one.rowsBetween(Window.unboundedPreceding,
                                                             Window.unboundedFollowing)))
    # one row per (file,) partition, no more than the driver's list of tasks:
    # broadcast, or all rows would be shuffled to meet them
    out = tagged.join(F.broadcast(offsets), group_cols)
    out = out.withColumn(name, F.col("_pf_off") + F.col(_POS) - F.col("_pf_p0"))
    drop = [_POS, "_pf_n", "_pf_p0", "_pf_off"] + [c for c in group_cols]
    out = out.drop(*drop)
    return out


def with_row_index(df: DataFrame, order_cols: list, name: str = "row_index",
                   with_total: bool = False, unique_keys: bool = False, written: bool = False) -> DataFrame:
    """Dense 0-based index in the order of ``order_cols``.
    With ``with_total`` a ``_pf_total`` column carries the row count.

    The sorted, position-tagged rows are checkpointed (reliably, under the
    session's checkpoint directory) before they are counted and joined: two
    independent range exchanges would each sample their own partition bounds,
    and the offsets would then not fit the rows.  One write of the data buys
    a consistent numbering and a lineage cut that survives lost executors.

    With ``unique_keys`` (the order columns identify a row) only the key
    columns are sorted, numbered and checkpointed, and the wide rows are
    joined back once — one shuffle of the wide data instead of a shuffle plus
    a checkpoint write and read of it.  Use it when ``df`` is cheap to read
    twice (a scan); for an expensive derived table the default computes it once.

    With ``written`` the tagged rows are a compressed table instead of a
    checkpoint, and the sort's shuffle files go once it is written; the caller
    may remove the table (``session.dropped``).
    """
    if unique_keys:
        cols = [c for c in order_cols if isinstance(c, str)]
        if len(cols) != len(order_cols):
            raise ValueError("unique_keys needs plain column names as order keys")
        keys = [f"_pf_k{i}" for i in range(len(cols))]
        idx = with_row_index(df.select(*[F.col(c).alias(k) for c, k in zip(cols, keys)]), keys, name, with_total)
        same = [df[c].eqNullSafe(idx[k]) for c, k in zip(cols, keys)]  # a null key is a key
        return df.join(idx, same).drop(*keys)
    ensure_checkpoint_dir(df.sparkSession)
    tagged = _tag_positions(df.orderBy(*order_cols))
    tagged = materialise(tagged, "numbered", release=True, compression="zstd") if written else tagged.checkpoint(eager=True)
    return _apply_offsets(tagged, [_PID], name, with_total)


def row_index_table(df: DataFrame, order_cols: list[str], name: str = "row_index") -> DataFrame:
    """G4 on the key columns only: ``(order_cols..., name)``.  Cheaper than
    numbering wide rows when the caller keeps only a subset of them (join the
    few survivors back on the key)."""
    return with_row_index(df.select(*order_cols), order_cols, name)


def with_line_numbers(df: DataFrame, name: str = "line_no") -> DataFrame:
    """Line numbers of a file scan in file-name order then in-file order.

    Rows of one file are contiguous inside a scan partition and a file's splits
    keep their offset order across partitions, so (file, partition, position)
    is the file order.  The scan's partitioning is a deterministic function of
    the file listing (no shuffle, no sampling), so counting and numbering can
    read it twice.
    """
    tagged = _tag_positions(df.withColumn("_pf_file", F.col("_metadata.file_path")))
    return _apply_offsets(tagged, ["_pf_file", _PID], name, False)


def total_before(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """The sum of ``value`` over all rows before this one in the order of the
    unique column ``order``.  Sums run inside ranges of the order; a range's
    offset is the sum of the ranges before it (one row a range), so no task sees
    all rows.  The ranges are checkpointed: a second range exchange would draw
    other bounds."""
    ensure_checkpoint_dir(df.sparkSession)
    ranged = df.repartitionByRange(order).withColumn(_PID, F.spark_partition_id()).checkpoint(eager=True)
    sums = ranged.groupBy(_PID).agg(F.sum(value).alias("_pf_sum"))
    ahead = Window.partitionBy(F.lit(0)).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(_PID, F.coalesce(F.sum("_pf_sum").over(ahead), F.lit(0)).alias("_pf_off"))
    inside = Window.partitionBy(_PID).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumn("_pf_in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(sums, _PID)
    return out.withColumn(name, F.col("_pf_off") + F.col("_pf_in")).drop(_PID, "_pf_off", "_pf_in")


def with_occurrence(df: DataFrame, keys: list[str], order: str, name: str = "occurrence", block: int = 1 << 16) -> DataFrame:
    """Number rows of equal ``keys`` from 0 in the order of ``order``, a unique
    non-negative row number.  A key that fills a third of the table is numbered
    in blocks of ``block`` consecutive row numbers, each a window of its own; a
    block's offset is a running sum over the blocks of its key, one row each."""
    blocked = df.withColumn("_pf_block", F.floor(F.col(order) / block).cast("long"))
    # null keys are equal: the joins below need a value for them
    names = [f"_pf_g{i}" for i in range(len(keys))]
    blocked = blocked.select("*", *[F.struct(F.col(k).alias("v")).alias(n) for k, n in zip(keys, names)])
    counts = blocked.groupBy(*names, "_pf_block").agg(F.count(F.lit(1)).alias("_pf_n"))
    before = Window.partitionBy(*names).orderBy("_pf_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_pf_off", F.coalesce(F.sum("_pf_n").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy(*names, "_pf_block").orderBy(order)) - 1
    out = blocked.withColumn("_pf_in", inside).join(counts, [*names, "_pf_block"])
    return out.withColumn(name, F.col("_pf_off") + F.col("_pf_in")).drop(*names, "_pf_block", "_pf_n", "_pf_off", "_pf_in")


def batch_number(row_index, k: int) -> Column:
    """Batches of ``k`` consecutive rows."""
    ri = F.col(row_index) if isinstance(row_index, str) else row_index
    return F.floor(ri / F.lit(k)).cast("long")


def shard_number(row_index, total, n: int) -> Column:
    """Contiguous split of ``total`` rows over ``n`` processes, the first
    ``total % n`` processes taking one extra row (ntile semantics), 0-based."""
    ri = F.col(row_index) if isinstance(row_index, str) else row_index
    tot = F.col(total) if isinstance(total, str) else total
    base = F.floor(tot / F.lit(n)).cast("long")
    rem = tot - base * n
    big = rem * (base + 1)
    return F.when(ri < big, F.floor(ri / (base + 1))) \
            .otherwise(rem + F.floor((ri - big) / F.greatest(base, F.lit(1)))).cast("int")


def row_slice(df: DataFrame, start: int, end: int, row_index: str = "row_index") -> DataFrame:
    """L2: rows ``[start, end)``; ``end == -1`` or ``end < start`` means to the end."""
    cond = F.col(row_index) >= start
    if not (end == -1 or end < start):
        cond = cond & (F.col(row_index) < end)
    return df.filter(cond)


def first_rows(df: DataFrame, order_cols: list, n: int, name: str = "row_index") -> DataFrame:
    """L3: the first ``n`` rows in input order (top-k, no full sort), numbered."""
    top = df.orderBy(*order_cols).limit(n)
    w = Window.partitionBy(F.lit(0)).orderBy(*order_cols)  # one group of at most n rows
    return top.withColumn(name, (F.row_number().over(w) - 1).cast("long"))


def skip_first(indexed: DataFrame, finished: DataFrame, row_index: str = "row_index") -> DataFrame:
    """J5 with A13: drop the first ``count(finished)`` rows (resume by offset)."""
    n_done = finished.select(F.count(F.lit(1))).scalar()
    return indexed.filter(F.col(row_index) >= n_done)
