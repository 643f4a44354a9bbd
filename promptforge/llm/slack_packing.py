"""Packing of token ids into windows by minimum bin slack.

A document's ids (with an end id) that reach over a window are cut into whole
windows first; what remains of each document, always shorter than a window,
waits in a pool by length.  A window is filled from the multiset of the pool's
lengths: the longest piece goes in, a subset-sum over the other lengths (one
bit per reachable sum, copies of a length by doubling) finds the sum closest to
the room left, and the steps are walked back to the number of pieces of each
length.  The same choice is taken as often as the pool holds it.

Only a fill without slack is taken while more documents may come; the pool is
bounded (``pool_ids``), and where it is full, or at the end of a task's rows,
the closest fill is topped up by the front of a further piece.  The last ids of
a task, fewer than a window, are laid out in sequences whose lengths are powers
of two.  So no sequence is padded.

There is no shuffle: each task packs the rows it reads, holding one batch and
the pool.  Sequence ids are unique: task number times 2^33 plus a number from
0.  A retried task packs its rows anew and its earlier output is dropped by
Spark's commit.

Defined cases: a null or empty text is the end id alone; a repeated row is a
document of its own; a null id is kept; an empty table gives no row; a text of
any length is encoded whole; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptforge.llm.byte_bpe import encoder, with_end
from promptforge.llm.common import slices_by_bytes

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def closest_fill(room: int, lengths: list[int], counts: dict[int, int]) -> dict[int, int]:
    """How many of each length make the largest sum of at most ``room``.

    ``lengths`` descends; ``counts`` says how many pieces there are.  Bit s of
    ``reach`` is set once some choice sums to s."""
    reach, mask, goal = 1, (1 << room + 1) - 1, 1 << room
    steps: list[tuple[int, int, int]] = []  # length, how many at once, sums reachable before
    for length in lengths:
        left, times = min(counts[length], room // length), 1
        while left:
            n = min(times, left)
            now = (reach | reach << n * length) & mask
            if now != reach:
                steps.append((length, n, reach))
                reach = now
            left -= n
            times *= 2
        if reach & goal:
            break
    at = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, n, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + n
            at -= n * length
    return used


class Pool:
    """Pieces shorter than a window, by length: (doc_id, start, ids, doc_tokens)."""

    def __init__(self, window: int, limit: int):
        self.window, self.limit = window, limit
        self.by_length: dict[int, list[tuple]] = {}
        self.counts: dict[int, int] = {}
        self.order: list[int] = []  # the lengths present, ascending
        self.total = 0

    def add(self, piece: tuple) -> None:
        length = len(piece[2])
        if length not in self.counts:
            insort(self.order, length)
            self.by_length[length], self.counts[length] = [], 0
        self.by_length[length].append(piece)
        self.counts[length] += 1
        self.total += length

    def take(self, length: int) -> tuple:
        piece = self.by_length[length].pop()
        self.counts[length] -= 1
        self.total -= length
        if not self.counts[length]:
            del self.by_length[length], self.counts[length], self.order[bisect_left(self.order, length)]
        return piece

    def _fill(self, seed: int) -> dict[int, int]:
        """A piece of length ``seed`` and the closest fill of the room beside it."""
        room = self.window - seed
        self.counts[seed] -= 1
        lengths = self.order[:bisect_right(self.order, room)]
        lengths.reverse()
        used = closest_fill(room, lengths, self.counts)
        self.counts[seed] += 1
        used[seed] = used.get(seed, 0) + 1
        return used

    def windows(self, last: bool) -> Iterator[list[tuple]]:
        """Sequences (lists of pieces).  Without ``last`` only fills without
        slack are made, unless the pool is over its limit."""
        below = self.window  # seeds from here on up have no exact fill in this pool
        while self.total >= self.window:
            at = bisect_left(self.order, below) - 1
            if at < 0:
                return
            seed = self.order[at]
            used = self._fill(seed)
            if sum(x * n for x, n in used.items()) == self.window:
                for _ in range(min(self.counts[x] // n for x, n in used.items())):
                    yield [self.take(x) for x, n in sorted(used.items(), reverse=True) for _ in range(n)]
            elif last or self.total > self.limit:
                yield self._topped_up(used)
                below = self.window
            else:
                below = seed  # pieces only grow fewer, so it stays without one
        if last and self.total:
            yield from self._powers_of_two()

    def _topped_up(self, used: dict[int, int]) -> list[tuple]:
        """The chosen pieces, and the front of the shortest piece that covers
        what is missing (else whole shorter ones and the front of another)."""
        out = [self.take(x) for x, n in sorted(used.items(), reverse=True) for _ in range(n)]
        gap = self.window - sum(len(p[2]) for p in out)
        while gap:
            at = bisect_left(self.order, gap)
            length = self.order[min(at, len(self.order) - 1)]
            piece = self.take(length)
            out.append(self._front(piece, gap))
            gap -= len(out[-1][2])
        return out

    def _front(self, piece: tuple, n: int) -> tuple:
        """The first ``n`` ids of a piece; the rest goes back to the pool."""
        doc_id, start, ids, total = piece
        if len(ids) <= n:
            return piece
        self.add((doc_id, start + n, ids[n:], total))
        return doc_id, start, ids[:n], total

    def _powers_of_two(self) -> Iterator[list[tuple]]:
        size = self.window
        while self.total:
            size = 1 << min(size, self.total).bit_length() - 1
            out, gap = [], size
            while gap:
                out.append(self._front(self.take(self.order[-1]), gap))
                gap -= len(out[-1][2])
            yield out


def _rows(sequences: list[tuple[int, list[tuple]]]) -> pa.RecordBatch:
    cols: list[list] = [[] for _ in _ARROW]
    for number, pieces in sequences:
        offset = 0
        for doc_id, start, ids, total in pieces:
            for col, value in zip(cols, (doc_id, start, len(ids), ids.tobytes(), total, number, offset)):
                col.append(value)
            offset += len(ids)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id",
         text_col: str = "text", pool_ids: int = 1 << 22) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian uint32
    bytes), doc_tokens, sequence_id, offset.  ``window`` is a power of two."""
    if window < 1 or window & window - 1:
        raise ValueError("window must be a power of two")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pool = encoder(tokenizer), Pool(window, pool_ids)
        number = TaskContext.get().partitionId() << 33
        for batch in (part for whole in batches for part in slices_by_bytes(whole, "text")):
            ids, counts = with_end(*encode(batch.column("text")), end_id)
            ids = ids.astype("<u4", copy=False)
            out, at = [], 0
            for doc_id, n in zip(batch.column("doc_id").to_pylist(), counts.tolist()):
                whole = n - n % window
                for start in range(0, whole, window):
                    out.append((number, [(doc_id, start, ids[at + start:at + start + window], n)]))
                    number += 1
                if n > whole:
                    pool.add((doc_id, whole, ids[at + whole:at + n].copy(), n))
                at += n
                if len(out) >= 512:
                    yield _rows(out)
                    out = []
            if pool.total > pool_ids // 2:  # enough pieces to choose from
                for pieces in pool.windows(last=False):
                    out.append((number, pieces))
                    number += 1
                    if len(out) >= 512:
                        yield _rows(out)
                        out = []
            if out:
                yield _rows(out)
        out = []
        for pieces in pool.windows(last=True):
            out.append((number, pieces))
            number += 1
            if len(out) >= 512:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)

    return rows.mapInArrow(run, PIECES)


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, n_tokens, ids (all pieces in order),
    doc_ids and lengths of the pieces.  At most a window of ids a row."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    rows = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("p"))
    return rows.select("sequence_id", "n_tokens", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
                       F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths"))


def padding(n_tokens: Column, window: int = 2048) -> Column:
    """Ids of padding that a sequence needs: none at a power of two."""
    return F.when(F.bit_count(n_tokens) == 1, F.lit(0)).otherwise(window - n_tokens)
