"""Helpers shared by the corpus operators: shared scratch tables, contiguous
groups of a sorted stream, and word positions of whole Arrow text columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

from promptforge.session import dropped, materialise  # noqa: F401

#: ASCII white space of every word rule here: blank, \t \n \v \f \r
SPACES = r"\x20\x09-\x0D"
WORD = rf"[^{SPACES}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of equal ``keys`` from a stream sorted by them.  Only the group
    that is being read stays in memory; null keys are equal to each other."""
    rest: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cut = np.zeros(n, dtype=bool)
        for k in keys:
            col = batch.column(batch.schema.get_field_index(k))
            null = np.asarray(col.is_null())
            val = col.fill_null(0).to_numpy(zero_copy_only=False)
            cut[1:] |= (val[1:] != val[:-1]) | (null[1:] != null[:-1])
        first = tuple(batch.column(batch.schema.get_field_index(k))[0].as_py() for k in keys)
        starts = np.flatnonzero(cut).tolist()
        if last is not None and first != last:
            yield pa.Table.from_batches(rest)
            rest = []
        at = 0
        for s in starts:
            rest.append(batch.slice(at, s - at))
            yield pa.Table.from_batches(rest)
            rest, at = [], s
        rest.append(batch.slice(at))
        last = tuple(batch.column(batch.schema.get_field_index(k))[n - 1].as_py() for k in keys)
    if rest:
        yield pa.Table.from_batches(rest)


class Words:
    """Words (runs of bytes that are no ASCII white space) of a text column.

    ``buf`` holds the texts with each white-space run as one blank and a blank
    after every text, so words ``i .. j`` of a text are joined by single blanks
    in ``buf[start[i]:end[j]]``.  ``first[r] : first[r + 1]`` are the words of
    row r; null texts have none.
    """

    def __init__(self, col: pa.Array, lower: bool = False):
        col = col.cast(pa.large_binary()).fill_null(b"")
        n = len(col)
        off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + n + 1] if n else np.zeros(1, np.int64)
        size = int(off[-1] - off[0])
        raw = np.frombuffer(col.buffers()[2], dtype=np.uint8)[int(off[0]):int(off[-1])] if size else np.zeros(0, np.uint8)
        # one blank behind every text keeps words of neighbours apart
        ends = off[1:] - off[0]
        text = np.full(size + n, 32, dtype=np.uint8)
        mask = np.ones(size + n, dtype=bool)
        mask[ends + np.arange(n)] = False
        text[mask] = raw
        gap = (text == 32) | ((text >= 9) & (text <= 13))
        keep = np.ones(len(text), dtype=bool)
        if len(text):
            keep[1:] = ~(gap[1:] & gap[:-1])
            keep[0] = not gap[0]
        begin = ~gap
        begin[1:] &= gap[:-1]
        row_of_begin = np.searchsorted(ends + np.arange(n), np.flatnonzero(begin), side="left")
        text = np.where(gap, np.uint8(32), text)[keep]
        if lower:
            text = np.where((text >= 65) & (text <= 90), text + np.uint8(32), text)
        gap = text == 32
        begin = ~gap
        if len(text):
            begin[1:] &= gap[:-1]
        self.buf = np.concatenate([text, np.zeros(8, np.uint8)])
        self.start = np.flatnonzero(begin)
        last = ~gap
        if len(text):
            last[:-1] &= gap[1:]
        self.end = np.flatnonzero(last) + 1
        self.first = np.searchsorted(row_of_begin, np.arange(n + 1), side="left")
        self.rows = n

    def load8(self, at: np.ndarray) -> np.ndarray:
        """Little-endian 64-bit words of ``buf`` at byte positions ``at``."""
        view = np.ndarray(shape=(len(self.buf) - 7,), dtype="<u8", buffer=self.buf.data, strides=(1,))
        return view[at]


def slices_by_bytes(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` bytes of ``column``
    (one row at least), so working arrays stay small whatever the batch size."""
    col = batch.column(batch.schema.get_field_index(column))
    size = np.nan_to_num(np.asarray(pa.compute.binary_length(col).to_numpy(zero_copy_only=False), dtype=float))
    total = np.cumsum(size)
    at = 0
    while at < batch.num_rows:
        base = total[at - 1] if at else 0.0
        to = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to
