"""Mixing sources to target weights: cube-method balanced sampling.

Every source gets a target number of words; a document of a source with ratio
``r = target / source size`` is taken ``floor(r)`` times and once more with
probability ``frac(r)``.  The flight phase moves these fractional
probabilities through the null space of two constraints per source (documents
and words): three units at a time move along the vector that changes neither
total until one of them reaches 0 or 1.  Rows are dealt into blocks by a hash
of the document, so a source that holds a third of all rows is spread over all
tasks; a task streams through its blocks and keeps at most two open units.  The
open units (two per source and block) fly again in fewer blocks, until one
landing problem of at most two units per source is left; it takes the rounding whose
words come nearest to the target.

Defined cases: null or blank text has size 0 (taken 0 words); a null source is
a source of its own and comes last; a source without words has target 0; rows
that repeat are separate units; null ids are allowed; an empty table gives an
empty mix.  The same rows in the same session settings give the same mix.
"""

from __future__ import annotations

import random
from collections import deque
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptforge.llm.common import WORD, materialise
from promptforge.operators.rows import with_row_index

WEIGHTS = (5, 2, 1)
SHARE = 1.5          # mix size as a share of all words
MOST = 2.0           # a source's target stops at this multiple of its size
BLOCK_ROWS = 4096    # documents of one first flight
FAN_IN = 1024        # blocks whose open units fly together at the next level
LANDING = 12         # units of a source that wait for the landing
_EPS = 1e-9


def word_count(text: str):
    return F.coalesce(F.regexp_count(F.col(f"`{text}`").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE,
                   most: float = MOST) -> DataFrame:
    """source, source_size, n_docs, target for ``sizes(source, size)``.

    Sources are numbered by code point (null last) and weigh ``weights`` in
    turn.  A target that passes ``most`` times its source's size stops there
    and the excess goes to the others by weight, until none passes.  The table
    has one row per source; it is never collected.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    per = with_row_index(materialise(per, "mix-sources"), [F.col("source").asc_nulls_last()], "_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    per = materialise(per.withColumn("_w", weight).withColumn("_top", F.col("source_size") * F.lit(float(most))), "mix-weights")
    total = per.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = 0.0, -1
    while True:
        over = F.col("_top") <= F.col("_w") * F.lit(level)
        n, held, open_w = per.agg(F.coalesce(F.sum(over.cast("long")), F.lit(0)),
                                  F.coalesce(F.sum(F.when(over, F.col("_top"))), F.lit(0.0)),
                                  F.coalesce(F.sum(F.when(~over, F.col("_w"))), F.lit(0.0))).first()
        if n == stopped or not open_w:
            break
        stopped, level = n, max(level, (share * total - held) / open_w)
    target = F.least(F.col("_top"), F.col("_w") * F.lit(level))
    return per.select("source", "source_size", "n_docs", target.alias("target"))


class Flight:
    """Cube flight over the units of one source: (key, probability, size)."""

    def __init__(self, seed: str):
        self.open: list[tuple] = []
        self.random = random.Random(seed).random

    def add(self, key, p: float, size: int) -> Iterator[tuple]:
        """Yields (key, 0 or 1, size) of the units that this one settles."""
        if p <= _EPS or p >= 1 - _EPS:
            yield key, float(p > 0.5), size
            return
        self.open.append((key, p, size))
        if len(self.open) < 3:
            return
        (ka, pa, a), (kb, pb, b), (kc, pc, c) = self.open
        move = (b - c, c - a, a - b) if not a == b == c else (1, -1, 0)
        probs = (pa, pb, pc)
        # how far the three can go along +move and along -move
        fore = min((1 - p if m > 0 else p) / abs(m) for p, m in zip(probs, move) if m)
        back = min((p if m > 0 else 1 - p) / abs(m) for p, m in zip(probs, move) if m)
        step = fore if self.random() * (fore + back) < back else -back
        self.open = []
        for key, p, m, size in zip((ka, kb, kc), probs, move, (a, b, c)):
            p += step * m
            if p <= _EPS or p >= 1 - _EPS:
                yield key, float(p > 0.5), size
            else:
                self.open.append((key, p, size))

    def rest(self) -> Iterator[tuple]:
        """The open units as they are, for the next level."""
        units, self.open = self.open, []
        yield from units

    def land(self, held: Sequence[tuple] = ()) -> Iterator[tuple]:
        """Settle the at most two open units and the few ``held`` back: the
        rounding nearest in words, then in documents, then the likeliest."""
        units, self.open = [*self.open, *held], []
        if not units:
            return
        p, size = (np.array([u[i] for u in units], dtype=float) for i in (1, 2))
        take = (np.arange(1 << len(units))[:, None] >> np.arange(len(units))) & 1
        off = take - p
        best = np.lexsort((np.abs(off).sum(axis=1), np.abs(off.sum(axis=1)).round(6), np.abs(off @ size).round(6)))[0]
        for t, (key, _, size) in zip(take[best].tolist(), units):
            yield key, float(t), size


class Hold:
    """Units of a source that wait for its landing: the last (smallest) ones
    and as many drawn from the others, so that the landing has small and
    middling sizes to make up for a long document that stays open longest."""

    def __init__(self, rand, n: int = LANDING // 2):
        self.n, self.rand, self.seen = n, rand, 0
        self.small: deque = deque()
        self.drawn: list[tuple] = []

    def swap(self, unit: tuple) -> tuple | None:
        """Take ``unit`` in; returns the unit that leaves for the flight."""
        self.small.append(unit)
        if len(self.small) <= self.n:
            return None
        unit, self.seen = self.small.popleft(), self.seen + 1
        if len(self.drawn) < self.n:
            self.drawn.append(unit)
            return None
        at = int(self.rand() * self.seen)
        if at < self.n:
            unit, self.drawn[at] = self.drawn[at], unit
        return unit

    def units(self) -> list[tuple]:
        return [*self.drawn, *self.small]


def _fly(seed: int, level: int, final: bool):
    """mapInPandas over rows sorted by block and source: settles p to 0 or 1
    where it can; with ``final`` the last open units land, else they keep p."""
    columns = ["doc_id", "key", "source", "size", "_block", "_p"]

    def frame(out: list[tuple]) -> pd.DataFrame:
        table = pd.DataFrame([key[:-1] + (p,) for key, p, _ in out], columns=columns)
        return table.astype({"doc_id": "Int64"})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, flight, hold = None, None, None

        def close() -> Iterator[tuple]:
            if flight is not None:
                held = hold.units() if hold else []
                yield from flight.land(held) if final else [*flight.rest(), *held]

        for rows in frames:
            out: list[tuple] = []
            ids = rows["doc_id"].astype("Int64").astype(object).where(rows["doc_id"].notna(), None)
            sources = rows["source"].astype(object).where(rows["source"].notna(), None)
            for row in zip(ids, rows["key"], sources, rows["size"], rows["_block"], rows["_p"]):
                _, _, source, size, block, p = row
                if (block, source) != now:
                    out += close()
                    now = block, source
                    flight = Flight(f"{seed}|{level}|{block}|{source!r}")
                    hold = Hold(flight.random) if block == 0 else None  # one block of each level
                unit = row, p, int(size)
                if hold is not None and _EPS < p < 1 - _EPS:
                    unit = hold.swap(unit)
                if unit is not None:
                    out += flight.add(*unit)
            if out:
                yield frame(out)
        if out := list(close()):
            yield frame(out)

    return run


def picks(units: DataFrame, seed: int = 42, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Settle ``units(doc_id, key, source, size, _p)``: the same rows, ``_p`` 0
    or 1.  ``key`` is a hash of the text, which tells rows of one id apart."""
    blocks = max(1, -(-units.count() // block_rows))
    block = F.pmod(F.xxhash64("doc_id", "key", F.lit(seed)), F.lit(blocks)).cast("int")
    work = units.select("doc_id", "key", "source", "size", block.alias("_block"), "_p")
    level, done = 0, []
    while True:
        final = blocks == 1
        # first each task takes whole blocks; later, with few rows, sources land in parallel
        flown = work.repartition(*["_block", "source"][:1 + (level > 0)]) \
            .sortWithinPartitions("_block", "source", F.desc("size"), F.xxhash64("doc_id", "key", F.lit(seed)), "doc_id", "key") \
            .mapInPandas(_fly(seed, level, final), work.schema)
        if final:
            return reduce(DataFrame.unionByName, [*done, flown.drop("_block")])
        flown = materialise(flown, f"mix-flight{level}")
        done.append(flown.where("_p in (0.0, 1.0)").drop("_block"))
        blocks = -(-blocks // FAN_IN)
        work = flown.where("_p not in (0.0, 1.0)").withColumn("_block", F.pmod("_block", F.lit(blocks)).cast("int"))
        level += 1


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 42,
        block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, times, key.

    ``times`` is how often the mix repeats the document, ``taken`` its words,
    ``key`` the hash of its text.
    """
    sizes = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(f"`{text_col}`").alias("key"),
                        F.col(f"`{source_col}`").alias("source"), word_count(text_col).alias("size"))
    sizes = materialise(sizes, "mix-sizes")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    per = source_targets(sizes, weights, share, most).withColumn("_whole", F.floor(ratio + _EPS))
    per = materialise(per.select(F.col("source").alias("_source"), "source_size", "target", "_whole",
                                 F.greatest(F.lit(0.0), ratio - F.col("_whole")).alias("_frac")), "mix-targets")
    units = sizes.join(per, F.col("source").eqNullSafe(F.col("_source")))
    settled = picks(units.select("doc_id", "key", "source", "size", F.col("_frac").alias("_p")), seed, block_rows)
    out = settled.join(per, F.col("source").eqNullSafe(F.col("_source")))
    times = (F.col("_whole") + F.col("_p")).cast("long")
    return out.select("doc_id", "size", "source_size", "target", (times * F.col("size")).alias("taken"),
                      times.alias("times"), "key")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of the mix, each as often as it is taken, with all columns of
    ``docs``, whatever their names.  Rows that repeat id and text share what they
    are taken evenly; what is left over goes to the first of them in the order
    of a hash of all columns, so a task that runs again takes the same rows."""
    share = mix(docs, id_col, text_col, **options).groupBy("doc_id", "key").agg(F.sum("times").alias("all"), F.count(F.lit(1)).alias("rows"))
    cols = [F.col(f"`{c}`") for c in docs.columns]
    keys = [F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(f"`{text_col}`").alias("key"),
            F.xxhash64(*cols, *[c.isNull() for c in cols]).alias("h")]
    # equal rows are one row with a count; of a repeated id and text, one row per different row
    kinds = docs.select(*keys).groupBy("doc_id", "key", "h").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("doc_id", "key").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    kinds = kinds.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    same = lambda a, b, names: [a[n].eqNullSafe(b[n]) for n in names]
    left = F.pmod("all", "rows") - F.col("before")
    taken = kinds.join(share, same(kinds, share, ["doc_id", "key"])).select(
        kinds["doc_id"].alias("id"), kinds["key"].alias("k"), F.col("h").alias("hash"),
        (F.col("n") * F.floor(F.col("all") / F.col("rows")) + F.greatest(F.lit(0), F.least("n", left))).cast("int").alias("times"))
    rows = docs.select(*keys, F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).alias("row")).dropDuplicates(["doc_id", "key", "h"])
    on = rows["doc_id"].eqNullSafe(taken["id"]) & (rows["key"] == taken["k"]) & (rows["h"] == taken["hash"])
    out = rows.join(taken.where("times > 0"), on).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return out.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
