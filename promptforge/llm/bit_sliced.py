"""Exact top-k by inner product over a bit-sliced index.

The index holds, for every shard of vectors and every component, one bitmap
per bit of the quantised value ``floor(scale * x)`` (shifted to start at 0).
The score of a query against all vectors of a shard is a sum of component
bitmaps, shifted by the bits of the query's components and added with carry
by AND / XOR on whole bitmaps; a negative digit adds the complement.  The top
rows are then selected from the highest slice of the sum downward; rows that
tie at the boundary are resolved by vec_id.

The query set is a stated share of the rows and meets all rows in blocks: one
task works on one block of queries and one shard, and hands on k rows a query.
Both sides of a block are bounded, whatever the size of the table.

Defined cases: vectors that are null or hold a null, NaN or infinite component
take no part; vectors are compared with vectors of as many components (an
empty vector scores 0); rows that repeat id and vector count once; one id with
several vectors is several candidates and several queries, and no row with
the query's id answers it; null ids never query and come last among ties;
fewer than k candidates give fewer rows; an empty table gives an empty result;
a component of 2^27 or more after scaling stops the job with an error, so
no score can overflow a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptforge.llm.common import materialise

SHARD_ROWS = 16384
QUERY_ROWS = 512
_LAST = np.iinfo(np.int64).max


def quantised(col: str, scale: float) -> Column:
    return F.transform(F.col(col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def _vectors(df: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").alias("_e"))
    fine = F.forall("_e", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    big = F.exists("_v", lambda x: F.abs(x) >= F.lit(1 << 27))
    rows = rows.where(F.col("_e").isNotNull() & fine).select("vec_id", quantised("_e", scale).alias("_v"))
    rows = rows.withColumn("_v", F.when(big, F.raise_error(F.lit("a scaled component passes 2^27")).cast("array<bigint>"))
                           .otherwise(F.col("_v")))
    return rows.distinct().withColumn("_dim", F.size("_v"))


def _matrix(col: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = col.combine_chunks().flatten() if isinstance(col, pa.ChunkedArray) else col.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim) if dim else np.zeros((len(col), 0), np.int64)


class SlicedIndex:
    """Bit slices of one shard; rows are in order of vec_id (null last)."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, values = ids[order], values[order]
        self.rows, self.dim = values.shape
        self.low = int(values.min()) if values.size else 0
        self.bits = max(1, int(values.max() - self.low).bit_length()) if values.size else 1
        words = -(-self.rows // 64)
        self.slices = np.zeros((2, self.dim, self.bits, words), dtype=np.uint64)
        for b in range(self.bits):
            plane = np.zeros((self.dim, words * 64), dtype=np.uint8)
            plane[:, :self.rows] = ((values - self.low) >> b & 1).T
            self.slices[0, :, b] = np.packbits(plane, axis=1, bitorder="little").view(np.uint64)
        self.slices[1] = ~self.slices[0]
        everyone = np.zeros(words * 64, dtype=np.uint8)
        everyone[:self.rows] = 1
        self.everyone = np.packbits(everyone, bitorder="little").view(np.uint64)

    def total(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of ``score + shift`` for all rows, lowest first, and shift."""
        flat = self.slices.reshape(-1, self.slices.shape[-1])
        at: dict[int, list[int]] = {}
        shift = -self.low * int(query.sum())
        for d, q in enumerate(query.tolist()):
            sign, q = (1, -q) if q < 0 else (0, q)
            j = 0
            while q:
                if q & 1:
                    digit = 2 - (q & 3)  # signed digits: no two in a row
                    q -= digit
                    side = sign ^ (digit < 0)
                    if side:
                        shift += ((1 << self.bits) - 1) << j
                    base = (side * self.dim + d) * self.bits
                    for b in range(self.bits):
                        at.setdefault(j + b, []).append(base + b)
                q >>= 1
                j += 1
        out, carried, weight = [], [], 0
        while weight <= max(at, default=-1) or carried:
            parts = ([flat[at[weight]]] if weight in at else []) + carried
            carried = []
            if not parts:
                out.append(np.zeros_like(self.everyone))
                weight += 1
                continue
            stack = np.concatenate(parts)
            while len(stack) > 2:  # three bitmaps of a weight become one, and one of the next weight
                n = len(stack) // 3
                a, b, c = stack[:n], stack[n:2 * n], stack[2 * n:3 * n]
                half = a ^ b
                carried.append((a & b) | (half & c))
                stack = np.concatenate([half ^ c, stack[3 * n:]])
            if len(stack) == 2:
                carried.append((stack[0] & stack[1])[None])
                stack = (stack[0] ^ stack[1])[None]
            out.append(stack[0])
            weight += 1
        return out, shift

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and scores of the k best rows, ties to smaller ids."""
        slices, shift = self.total(query)
        open_ = self.everyone.copy()
        lo, hi = np.searchsorted(self.ids, [query_id, query_id + 1])
        for own in range(int(lo), int(hi)):
            open_[own >> 6] &= ~np.uint64(1 << (own & 63))
        sure, found = np.zeros_like(open_), 0
        for s in reversed(slices):
            more = open_ & s
            n = int(np.bitwise_count(more).sum())
            if found + n > k:
                open_ = more
            else:
                sure |= more
                found += n
                open_ = open_ & ~s
                if found == k:
                    open_[:] = 0
                    break
        rows = self._rows(sure)
        if found < k:  # boundary: all open rows have one score, and rows are in order of id
            rows = np.concatenate([rows, self._rows(open_)[:k - found]])
        score = np.zeros(len(rows), dtype=np.int64)
        for w, s in enumerate(slices):
            score += ((s[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << w
        return rows, score - shift

    @staticmethod
    def _rows(bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _pack(key: str):
    """applyInArrow: one row per group with its ids and values as bytes."""

    def run(group: pa.Table) -> pa.Table:
        dim = group.column("_dim")[0].as_py()
        ids = group.column("vec_id").fill_null(_LAST).to_numpy().astype(np.int64)
        values = _matrix(group.column("_v"), dim).astype(np.int32)
        return pa.table({"_dim": pa.array([dim], pa.int32()), key: pa.array([group.column(key)[0].as_py()], pa.int32()),
                         f"{key}_ids": pa.array([ids.tobytes()], pa.binary()),
                         f"{key}_values": pa.array([values.tobytes()], pa.binary())})

    return run


def _blocks(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    part = F.pmod(F.xxhash64("vec_id", "_v", F.lit(seed)), F.lit(n)).cast("int")
    return rows.withColumn(key, part).groupBy("_dim", key).applyInArrow(
        _pack(key), f"_dim int, {key} int, {key}_ids binary, {key}_values binary")


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, of = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                one = {name: batch.column(i)[row].as_py() for i, name in enumerate(batch.schema.names)}
                dim = one["_dim"]
                if of != (dim, one["_shard"]):  # pairs of a shard follow each other
                    of = dim, one["_shard"]
                    ids = np.frombuffer(one["_shard_ids"], np.int64)
                    index = SlicedIndex(ids, np.frombuffer(one["_shard_values"], np.int32).astype(np.int64).reshape(len(ids), dim))
                queries = np.frombuffer(one["_block_ids"], np.int64)
                values = np.frombuffer(one["_block_values"], np.int32).astype(np.int64).reshape(len(queries), dim)
                out = []
                for n, (q, v) in enumerate(zip(queries.tolist(), values)):
                    rows, score = index.top(q, v, k)
                    out.append(pd.DataFrame({"query_id": q, "_q": (one["_block"] << 32) + n, "vec_id": index.ids[rows], "score": score}))
                if out:
                    found = pd.concat(out).astype("int64")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found["query_id"]), pa.array(found["_q"]),
                         pa.array(found["vec_id"], mask=(found["vec_id"] == _LAST).to_numpy()), pa.array(found["score"])],
                        names=["query_id", "_q", "vec_id", "score"])

    return run


def top_k(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
          scale: float = 256, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of every query row.

    ``is_query`` is a condition on ``vec_id`` that states the query set.
    """
    rows = materialise(_vectors(df, id_col, vec_col, scale), "topk-vectors")
    asked = rows.where(is_query & F.col("vec_id").isNotNull())
    n, m = rows.count(), asked.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-m // query_rows))
    index = _blocks(rows, "_shard", shards, 1)
    queries = _blocks(asked, "_block", blocks, 2).withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    pairs = queries.join(index, ["_dim", "_shard"])
    found = pairs.mapInArrow(_search(k), "query_id long, _q long, vec_id long, score long")
    best = Window.partitionBy("query_id", "_q").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
