"""Source divergence audit by sorting token-start pointers.

A task takes slices of whole texts.  On the Arrow buffer of a slice it finds
where terms begin (runs of ASCII letters and of anything beyond ASCII, A-Z
lower-cased) and sorts these pointers by the bytes behind them: a multikey
quicksort whose characters are eight bytes, in which only runs that are equal
so far are sorted by their next eight.  Equal runs give, for each term, its
occurrences and the documents that hold it, by (language, source).  Spark adds
the runs of all slices.

A language keeps the terms of at least ``least`` documents.  The shares p of a
source, and of the language, are whole numbers of billionths, smoothed by 5 per
term.  The distance of two sources is summed over all kept terms: a task takes
blocks of terms, one row of shares per term, and adds |p - q| for all sources
of the language at once, so no pair of rows is built.  Terms that a source
lacks have its smoothed share.

Defined cases: null text, language and source are empty strings; a text without
terms still makes its (language, source) occur; a language without kept terms
has distances of 0 and no terms; a repeated row is a document of its own; an
empty table gives no row; a task holds the longest text and arrays of some
twenty times its size; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptforge.llm.common import materialise, slices_by_bytes

LEAST = 30
SMOOTH = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
_SLICE = 12 << 20
_RUNS = "lang string, source string, term string, n long, docs long"
# bytes of terms: letters, and all bytes of characters beyond ASCII
_TERM = np.zeros(256, dtype=bool)
_TERM[65:91] = _TERM[97:123] = True
_TERM[128:] = True


def sort_pointers(buf: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the pointers by (group, bytes), and where runs of equal ones
    begin in it.  Equal pointers keep their order.  ``buf`` has eight spare
    bytes at its end; terms hold no zero byte."""
    view = np.ndarray(shape=(len(buf) - 7,), dtype=">u8", buffer=buf.data, strides=(1,))
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)

    def chunk(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        key = view[at].astype(np.uint64)
        short = np.clip(8 - left, 0, 7).astype(np.uint64) * np.uint64(8)
        return key & (ones << short)

    # a term that goes on behind its chunk is no equal of one that ends with it
    key, more = chunk(start, size), size > 8
    order = np.lexsort((more, key, group))
    head = np.ones(len(order), dtype=bool)  # does a run begin here
    by = key[order], more[order], group[order]
    head[1:] = (by[0][1:] != by[0][:-1]) | (by[1][1:] != by[1][:-1]) | (by[2][1:] != by[2][:-1])
    live = np.flatnonzero(by[1])
    depth = 8
    while len(live):
        # only runs of several terms need another look; each either ends or goes on as a whole
        live = live[~(head[live] & np.append(head[1:], True)[live])]
        if not len(live):
            break
        run = np.cumsum(head)[live]
        at = order[live]
        left = size[at] - depth
        key, more = chunk(start[at] + depth, left), left > 8
        move = np.lexsort((more, key, run))
        order[live] = at[move]
        key, more = key[move], more[move]
        fresh = np.ones(len(live), dtype=bool)
        fresh[1:] = (run[1:] != run[:-1]) | (key[1:] != key[:-1]) | (more[1:] != more[:-1])
        head[live] |= fresh
        depth += 8
        live = live[more]
    return order, np.flatnonzero(head)


def equal_runs(col: pa.Array, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text column whose rows belong to groups: term, group, occurrences
    and documents of each equal run."""
    col = col.cast(pa.large_binary()).fill_null(b"")
    n = len(col)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + n + 1]
    raw = np.frombuffer(col.buffers()[2], np.uint8)[int(off[0]):int(off[-1])] if off[-1] > off[0] else np.zeros(0, np.uint8)
    off = off - off[0]
    buf = np.concatenate([np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw), np.zeros(8, np.uint8)])
    term = _TERM[buf[:len(raw)]]
    begin, last = term.copy(), term.copy()
    begin[1:] &= ~term[:-1]
    last[:-1] &= ~term[1:]
    full = np.diff(off) > 0
    begin[off[:-1][full]] = term[off[:-1][full]]
    last[off[1:][full] - 1] = term[off[1:][full] - 1]
    start = np.flatnonzero(begin)
    size = np.flatnonzero(last) + 1 - start
    doc = np.searchsorted(off, start, side="right") - 1
    order, runs = sort_pointers(buf, start, size, group[doc])
    ends = np.append(runs[1:], len(order))
    of = doc[order]
    new = np.ones(len(order), dtype=np.int64)  # pointers of one document stand together in a run
    new[1:] = of[1:] != of[:-1]
    new[runs] = 1
    docs = np.add.reduceat(new, runs) if len(runs) else np.zeros(0, np.int64)
    first = order[runs]
    length = size[first]
    bound = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    at = np.repeat(start[first] - bound[:-1], length) + np.arange(int(bound[-1]))
    terms = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(bound.tobytes()), pa.py_buffer(buf[at])])
    return terms.cast(pa.large_string()), group[of[runs]] if len(runs) else np.zeros(0, np.int64), ends - runs, docs


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.large_string()), ("n", pa.int64()), ("docs", pa.int64())])
    for batch in _slices(batches):
        lang, source = batch.column("lang").dictionary_encode(), batch.column("source").dictionary_encode()
        width = len(source.dictionary)
        group = lang.indices.to_numpy().astype(np.int64) * width + source.indices.to_numpy()
        terms, of, n, docs = equal_runs(batch.column("text"), group)
        for at in range(0, len(terms), 1 << 16):
            to = at + (1 << 16)
            yield pa.RecordBatch.from_arrays([
                lang.dictionary.take(pa.array(of[at:to] // width)), source.dictionary.take(pa.array(of[at:to] % width)),
                terms[at:to], pa.array(n[at:to].astype(np.int64)), pa.array(docs[at:to].astype(np.int64))], schema=schema)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``_SLICE`` bytes of text, over batch ends."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in (part for whole in batches for part in slices_by_bytes(whole, "text", _SLICE)):
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.column("text").nbytes
        if size >= _SLICE // 2:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * terms)), exactly."""
    big = lambda c: c.cast("decimal(19,0)")
    whole = F.lit(SCALE).cast("decimal(10,0)") * (big(n) + F.lit(SMOOTH).cast("decimal(1,0)"))
    part = big(total) + F.lit(SMOOTH).cast("decimal(1,0)") * big(terms)
    return F.call_function("div", whole, part) + 1


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it)."""
    plain = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(plain(lang_col).alias("lang"), plain(source_col).alias("source"), plain(text_col).alias("text"))
    runs = rows.mapInArrow(_audit, _RUNS)
    return runs.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, sources, floors, found: [(source, p)]) -> sums of |p - q| per pair."""
    held: dict[str, list] = {}

    def block(lang: str) -> None:
        sources, floors, rows, total = held[lang]
        number = {s: i for i, s in enumerate(sources)}
        x = np.tile(np.array(floors, np.int64), (len(rows), 1))
        for t, found in enumerate(rows):
            for f in found:
                x[t, number[f["source"]]] = f["p"]
        for a in range(len(sources)):
            total[a] += np.abs(x - x[:, a:a + 1]).sum(axis=0)
        rows.clear()

    for batch in batches:
        for row in batch.to_pylist():
            lang = row["lang"]
            if lang not in held:
                n = len(row["sources"])
                held[lang] = [row["sources"], row["floors"], [], np.zeros((n, n), np.int64)]
            if row["found"] is not None:  # a row without terms only names the sources
                held[lang][2].append(row["found"])
                if len(held[lang][2]) * len(row["sources"]) >= 1 << 16:
                    block(lang)
    for lang in list(held):
        block(lang)
        sources, _, _, total = held.pop(lang)
        for a, source in enumerate(sources):
            others = [b for b in range(len(sources)) if b != a]
            if others:
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(others), pa.string()), pa.array([source] * len(others), pa.string()),
                    pa.array([sources[b] for b in others], pa.string()), pa.array(total[a, others], pa.int64())],
                    names=["lang", "source", "item", "value"])


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP_TERMS, text_col: str = "text", lang_col: str = "lang",
          source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: the distance of each source of a
    language to its other sources (``pair``), and the terms that mark it
    (``term``, the first ``top``)."""
    counts = materialise(term_counts(docs, text_col, lang_col, source_col), "audit-terms")
    plain = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    groups = docs.select(plain(lang_col).alias("lang"), plain(source_col).alias("source")).distinct()
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n")).where(F.col("docs") >= least)
    kept = materialise(counts.join(kept.select("lang", "term", "all_n"), ["lang", "term"]).select(
        "lang", "source", "term", "n", "all_n"), "audit-kept")
    # one row per group with its terms and its language's: v kept terms, all_total and total occurrences
    langs = kept.groupBy("lang", "term").agg(F.first("all_n").alias("all_n")).groupBy("lang").agg(
        F.count(F.lit(1)).alias("v"), F.sum("all_n").alias("all_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("total", "v", "all_total")])
    groups = materialise(groups.withColumn("floor", F.when(F.col("v") > 0, _share(F.lit(0), F.col("total"), F.col("v"))).otherwise(0)),
                         "audit-groups")
    shares = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", _share(F.col("n"), F.col("total"), F.col("v")).alias("p"),
        _share(F.col("all_n"), F.col("all_total"), F.col("v")).alias("q"))
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(
        Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    terms = ranked(shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                                (F.col("p") - F.col("q")).alias("value"))).where(F.col("rank") <= top)
    # a language's sources are one list: the result has a row for each two of them anyway
    listed = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "floor"))).alias("s")).select(
        "lang", F.col("s.source").alias("sources"), F.col("s.floor").alias("floors"))
    found = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p")).alias("found"))
    rows = found.join(listed, "lang").select("lang", "sources", "floors", "found")
    rows = rows.unionByName(listed.withColumn("found", F.lit(None).cast("array<struct<source:string,p:bigint>>")))
    pairs = rows.mapInArrow(_distances, "lang string, source string, item string, value long")
    pairs = ranked(pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value"))
    return pairs.unionByName(terms)
