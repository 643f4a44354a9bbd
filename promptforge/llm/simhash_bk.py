"""SimHash near-dedup with BK-trees.

A text's fingerprint has bit i set if more than half of its word-shingle
hashes (XXH64, seed 42, UTF-8) have it set.  Two fingerprints link at
``radius`` or fewer differing bits.

Distinct fingerprints are dealt into shards by pairs of blocks: the 64 bits
are cut into ``radius + 2`` blocks, and two fingerprints within the radius
agree in at least two whole blocks, so they meet in a shard of that pair (no
link is lost).  Each shard's BK-tree keys children by their integer Hamming
distance to the parent and is sent to the tasks that hold the shard's queries;
a query follows only edges within the radius of its own distance.  A shard
with very many fingerprints is split into trees of bounded size, and every
pair of its parts meets in one task.  A task hands on a spanning forest of the
links it found, never all pairs; components follow from star steps on that.

Defined cases: a text without words (null, empty, blank) has fingerprint zero
and links like any other; a text with fewer words than the shingle length has
its whole word sequence as one shingle; repeated rows give repeated rows; a
null id links but is never a component's name unless the component has no
other (then the name is null); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptforge.llm.common import Words, materialise, slices_by_bytes, sorted_groups
from promptforge.llm.components import stars
from promptforge.llm.xxh64 import xxh64

TREE_ROWS = 2048     # fingerprints of one BK-tree
_CHUNK = 1 << 16     # shingles whose bits are counted at once


def fingerprints_of(texts: pa.Array, width: int) -> np.ndarray:
    """SimHash fingerprints (uint64) of a column of texts."""
    words = Words(texts, lower=True)
    count = np.diff(words.first)
    shingles = np.where(count > width, count - width + 1, np.minimum(count, 1))
    bound = np.concatenate([[0], np.cumsum(shingles)])
    row = np.repeat(np.arange(words.rows), shingles)
    begin = words.first[row] + np.arange(bound[-1]) - bound[row]
    last = np.minimum(begin + width, words.first[row + 1]) - 1
    hashes = xxh64(words, words.start[begin], words.end[last] if len(last) else last, 42)
    ones = np.zeros((words.rows, 64), dtype=np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part, rows = hashes[at:at + _CHUNK], row[at:at + _CHUNK]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        heads = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        ones[rows[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > shingles[:, None], axis=1, bitorder="little").view(np.uint64).reshape(-1)


def _fingerprints(width: int, text_col: str, carry: list[str]):
    """mapInArrow: the ``carry`` columns and the fingerprint of ``text_col``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices_by_bytes(whole, text_col):
                fp = fingerprints_of(batch.column(text_col), width).view(np.int64)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carry], pa.array(fp)], names=[*carry, "_fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) for every row."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    return rows.mapInArrow(_fingerprints(width, "_text", ["doc_id"]), "doc_id long, _fp long").withColumnRenamed("_fp", "fp")


class BKTree:
    """BK-tree of distinct 64-bit fingerprints, built and searched level by
    level.  Node 0 is the root; the children of a node are contiguous in
    ``child``, in order of their distance to it."""

    def __init__(self, points: np.ndarray):
        self.points = points
        n = len(points)
        parent, edge = np.full(n, -1), np.zeros(n, dtype=np.int64)
        todo, at = np.arange(1, n), np.zeros(max(n - 1, 0), dtype=np.int64)  # at: the node each point has come to
        while len(todo):
            d = np.bitwise_count(points[todo] ^ points[at]).astype(np.int64)
            _, head, of = np.unique(at * 65 + d, return_index=True, return_inverse=True)
            new = todo[head]  # the first point at a distance becomes that child
            parent[new], edge[new] = at[head], d[head]
            stay = np.ones(len(todo), dtype=bool)
            stay[head] = False
            todo, at = todo[stay], new[of][stay]
        order = np.argsort(parent * 65 + edge, kind="stable")
        self.child = order[1:]
        self.key = (parent * 65 + edge)[self.child]  # sorted: (parent, distance)

    def search(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) index pairs within the radius."""
        q, node = np.arange(len(queries)), np.zeros(len(queries), dtype=np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(q):
            d = np.bitwise_count(queries[q] ^ self.points[node]).astype(np.int64)
            hit = d <= radius
            found.append((q[hit], node[hit]))
            lo = np.searchsorted(self.key, node * 65 + np.maximum(d - radius, 0), side="left")
            hi = np.searchsorted(self.key, node * 65 + np.minimum(d + radius, 64), side="right")
            n = hi - lo
            q = np.repeat(q, n)
            node = self.child[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())] if n.sum() else q[:0]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _forest(tree: np.ndarray, queries: np.ndarray, radius: int, block: int = 256) -> list[tuple[int, int]]:
    """A spanning forest of the links between ``queries`` and ``tree``."""
    both, at = np.unique(np.concatenate([tree, queries]), return_inverse=True)
    of_tree, of_query = at[:len(tree)], at[len(tree):]
    label, out = np.arange(len(both)), []
    bk = BKTree(tree)
    for b in range(0, len(queries), block):
        q, node = bk.search(queries[b:b + block], radius)
        x, y = label[of_query[b + q]], label[of_tree[node]]
        pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1)[x != y], axis=0)
        root = {}

        def find(v: int) -> int:
            while (up := root.get(v, v)) != v:
                root[v] = root.get(up, up)
                v = root[v]
            return v

        for x, y in pairs.tolist():
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((int(both[max(x, y)]), int(both[min(x, y)])))
        if root:
            move = np.arange(len(both))
            for v in root:
                move[v] = find(v)
            label = move[label]
    return out


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for group in sorted_groups(batches, ["band", "key", "part", "other"]):
            fp = group.column("fp").to_numpy().view(np.uint64)
            role = group.column("role").to_numpy()
            tree, queries = np.unique(fp[role != 1]), np.unique(fp[role != 0])
            out += _forest(tree, queries, radius)
            if len(out) > 100_000:
                yield _edges(out)
                out = []
        yield _edges(out)

    return run


def _edges(out: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])


def _bands(fp: Column, radius: int) -> Column:
    """array<struct<band, key>>: the bits of every pair of blocks."""
    n = radius + 2
    cuts = [round(64 * i / n) for i in range(n + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    out = []
    for band, (i, j) in enumerate(combinations(range(n), 2)):
        mask = masks[i] | masks[j]
        mask -= (mask >> 63) << 64  # as a signed long
        out.append(F.struct(F.lit(band).alias("band"), fp.bitwiseAND(F.lit(mask)).alias("key")))
    return F.array(*out)


def links(nodes: DataFrame, radius: int = 3, tree_rows: int = TREE_ROWS) -> DataFrame:
    """``nodes(fp)`` distinct -> edges (a, b) that connect all fingerprints
    linked directly or through others."""
    dealt = nodes.select("fp", F.explode(_bands(F.col("fp"), radius)).alias("_b")).select("fp", "_b.band", "_b.key")
    shards = dealt.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shards = shards.select("band", "key", F.ceil(F.col("n") / tree_rows).cast("int").alias("parts"))
    placed = dealt.join(shards, ["band", "key"])
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int")
    # part p meets itself and every other part once: as tree with p >= other, as queries with other >= p
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(
        F.greatest(o, F.col("mine")).alias("part"), F.least(o, F.col("mine")).alias("other"),
        F.when(o < F.col("mine"), 0).when(o > F.col("mine"), 1).otherwise(2).alias("role")))
    met = placed.withColumn("mine", mine).select("band", "key", "fp", F.explode(meets).alias("_m"))
    met = met.select("band", "key", "_m.part", "_m.other", "_m.role", "fp")
    by = ["band", "key", "part", "other"]
    # a fixed number of tasks: small rows, but much work for each
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return met.repartition(tasks, *by).sortWithinPartitions(*by, "fp").mapInArrow(_links(radius), "a long, b long")


def _labelled(fps: DataFrame, radius: int, tree_rows: int) -> DataFrame:
    """fp, root, low (smallest non-null doc_id), one row per fingerprint."""
    nodes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-nodes")
    star = stars(links(nodes.select("fp"), radius, tree_rows))
    return nodes.join(star, nodes["fp"] == star["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "low")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
               radius: int = 3, tree_rows: int = TREE_ROWS) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id."""
    fps = materialise(fingerprints(docs, id_col, text_col, width), "simhash-fingerprints")
    node = materialise(_labelled(fps, radius, tree_rows), "simhash-labels")
    name = node.groupBy("root").agg(F.min("low").alias("component_id"))
    out = fps.join(node.join(name, "root").select("fp", "component_id"), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
             radius: int = 3, tree_rows: int = TREE_ROWS) -> DataFrame:
    """One row of each component, with all columns: of the rows with the
    smallest (id, fingerprint) the one with the smallest hash of all columns
    (a null id stays only where a component has no other)."""
    @F.arrow_udf(T.LongType())
    def fingerprint(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in columns:
            batch = pa.RecordBatch.from_arrays([texts], names=["text"])
            parts = [fingerprints_of(b.column("text"), width).view(np.int64) for b in slices_by_bytes(batch, "text")]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))

    cols = [F.col(f"`{c}`") for c in docs.columns]
    # 128 bits of all columns stand for a row; the caller's columns are kept apart from the names used here
    tie = [F.xxhash64(F.lit(i), *cols, *[c.isNull() for c in cols]).alias(f"t{i}") for i in range(2)]
    fps = materialise(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), fingerprint(F.col(f"`{text_col}`").cast("string")).alias("fp"),
                                  *tie), "simhash-fingerprints")
    by = F.struct(F.col("low").isNull().alias("none"), F.col("low").alias("id"), F.col("fp").alias("fp"))
    best = _labelled(fps, radius, tree_rows).groupBy("root").agg(F.min(by).alias("_b")).select(F.col("_b.fp").alias("fp"))
    first = fps.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t0", "t1")).alias("m"))
    best = best.join(first, "fp").select(F.col("m.t0").alias("t0"), F.col("m.t1").alias("t1"))
    rows = docs.select(*tie, F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).alias("row"))
    # rows that are equal in all columns stand together after the join
    kept = rows.join(best, ["t0", "t1"], "left_semi").dropDuplicates(["t0", "t1"])
    return kept.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
