"""Phrase collocation mining with HAT-trie counting.

Texts are cut into pieces and words on their Arrow buffers; a task numbers the
words it meets, by language.  Phrases are counted in a HAT-trie: a shallow trie
over word numbers whose leaves are hash containers of the remaining words.  A
container that grows over ``burst`` entries is replaced by a node with one
container per next word.  A full trie spills its largest subtrees whole: their
phrases leave as sorted runs, one per prefix partition (a hash of the language
and the first three words at most, so that the phrases under one common word
spread over all partitions), and the runs of a prefix partition are merged in
one place by summing equal phrases.

Counting takes two passes.  The first counts words and word pairs; the second
counts longer phrases, at places alone whose word pairs are all frequent, since
a phrase is never more frequent than a pair in it.  Frequent pairs reach the
tasks as a Bloom filter of fixed size (8 MB, whatever the data): it lets some
rare pairs through, whose phrases then fall below the count exactly, and never
stops a frequent one.  Only phrases with at least ``least`` occurrences outlive
the merge; every part of such a phrase is as frequent, so all that scores need
is there.  Scores and the choice of phrases are DataFrame work with decimals.

Defined cases: a null or empty text has no words; a null language is ``und``;
a repeated row counts again; equal scores follow the order of the rule; an
empty table gives no row; a text of any length is counted whole (a task holds
the longest one and a few arrays of its size); further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptforge.llm.common import materialise, slices_by_bytes, sorted_groups

LEAST = 30
LONGEST = 4
BLOOM_BITS = 1 << 26
_BITS = 21              # bits of a word number; three rest words make one 63-bit key
_WORDS = 1 << 19        # word places counted at once
_MASK = (1 << _BITS) - 1
_RUNS = "bucket int, langs array<string>, phrases array<string>, counts array<binary>, places array<long>"
_RUN_SCHEMA = pa.schema([("bucket", pa.int32()), ("langs", pa.list_(pa.string())), ("phrases", pa.list_(pa.string())),
                         ("counts", pa.list_(pa.binary())), ("places", pa.list_(pa.int64()))])

# bytes that end a piece: . , ; : ! ? and \n \v \f \r; bytes between words: blank and tab
_PIECE_END = np.zeros(256, dtype=bool)
_PIECE_END[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAP = _PIECE_END.copy()
_GAP[list(b" \t")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads every bit of ``h`` over the result."""
    h = h.astype(np.uint64)
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _chain(*parts: np.ndarray) -> np.ndarray:
    """Hash of a sequence of word hashes."""
    h = _mix(parts[0])
    with np.errstate(over="ignore"):
        for p in parts[1:]:
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + p)
    return h


class Places:
    """Words of a text column: distinct words, the word at each place, the row
    of each place, and the piece it lies in."""

    def __init__(self, col: pa.Array):
        col = col.cast(pa.large_binary()).fill_null(b"")
        n = len(col)
        off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = np.frombuffer(col.buffers()[2], np.uint8)[int(off[0]):int(off[-1])] if off[-1] > off[0] else np.zeros(0, np.uint8)
        off = off - off[0]
        gap = _GAP[raw]
        word = ~gap
        begin, last = word.copy(), word.copy()
        begin[1:] &= gap[:-1]
        last[:-1] &= gap[1:]
        full = np.diff(off) > 0
        begin[off[:-1][full]] = word[off[:-1][full]]
        last[off[1:][full] - 1] = word[off[1:][full] - 1]
        start = np.flatnonzero(begin)
        bound = np.concatenate([[0], np.cumsum(np.flatnonzero(last) + 1 - start)]).astype(np.int64)
        # a piece ends at each of its marks and where a row ends
        self.row = np.searchsorted(off, start, side="right") - 1
        self.piece = np.searchsorted(np.flatnonzero(_PIECE_END[raw]), start) + self.row
        body = _LOWER[raw[word]]
        words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bound.tobytes()), pa.py_buffer(body)])
        coded = words.dictionary_encode()
        self.words: list[bytes] = coded.dictionary.to_pylist()
        self.code = coded.indices.to_numpy().astype(np.int64)


class Vocabulary:
    """Numbers of (language, word), from 1, with a hash of each that all tasks agree on."""

    def __init__(self):
        self.number: dict[str, dict[bytes, int]] = {}
        self.words: list[bytes | None] = [None]
        self.langs: list[str] = []
        self.hash, self.lang = np.zeros(1, np.uint64), np.zeros(1, np.int64)

    def numbers(self, lang: str, words: list[bytes]) -> np.ndarray:
        import xxhash

        if lang not in self.number:
            self.number[lang] = {}
            self.langs.append(lang)
        known = self.number[lang]
        at = [known.get(w, 0) for w in words]
        new = [w for w, i in zip(words, at) if not i]
        if new:
            salt, digest = xxhash.xxh64_intdigest(lang.encode(), 7), xxhash.xxh64_intdigest
            known.update(zip(new, range(len(self.words), len(self.words) + len(new))))
            self.words += new
            self.hash = np.concatenate([self.hash, np.array([digest(w, salt) for w in new], np.uint64)])
            self.lang = np.concatenate([self.lang, np.full(len(new), self.langs.index(lang))])
            at = [i or known[w] for w, i in zip(words, at)]
        return np.array(at, dtype=np.int64)


class HatTrie:
    """Counts by (first word, packed rest).  ``root[first]`` is a container
    (dict of rest -> count) or, once burst, a node: a pair of a container for
    the word alone and a dict of next word -> container."""

    def __init__(self, burst: int = 1 << 14):
        self.burst = burst
        self.root: dict[int, dict | tuple] = {}
        self.entries = 0

    def add(self, first: np.ndarray, rest: np.ndarray, count: np.ndarray) -> None:
        """Add counts of distinct (first, rest), sorted by first."""
        if not len(first):
            return
        heads = np.append(0, np.flatnonzero(np.diff(first)) + 1)
        root, burst, grown = self.root, self.burst, 0
        words, bounds = first[heads].tolist(), [*heads.tolist(), len(first)]
        rest, count = rest.tolist(), count.tolist()
        for word, a, b in zip(words, bounds, bounds[1:]):
            box = root.get(word)
            if box is None:
                root[word] = box = dict(zip(rest[a:b], count[a:b]))
                grown += b - a
            elif type(box) is dict:
                before, get = len(box), box.get
                for r, n in zip(rest[a:b], count[a:b]):
                    box[r] = get(r, 0) + n
                grown += len(box) - before
            else:
                own, children = box
                for r, n in zip(rest[a:b], count[a:b]):
                    leaf = children.setdefault(r >> 2 * _BITS, {}) if r else own
                    grown += r not in leaf
                    leaf[r] = leaf.get(r, 0) + n
                continue
            if len(box) > burst:
                root[word] = self._split(box)
        self.entries += grown

    @staticmethod
    def _split(box: dict) -> tuple[dict, dict]:
        own, children = {}, {}
        for r, n in box.items():
            (children.setdefault(r >> 2 * _BITS, {}) if r else own)[r] = n
        return own, children

    def spill(self, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Take out the largest subtrees until at most ``keep`` entries stay:
        first words, rests and counts of what was taken."""
        root = self.root
        gone = list(root)
        size = [len(b) if type(b) is dict else len(b[0]) + sum(map(len, b[1].values())) for b in root.values()]
        if keep:
            order = np.argsort(-np.array(size), kind="stable")
            left = self.entries - np.cumsum(np.array(size)[order])
            order = order[:int(np.searchsorted(-left, -keep)) + 1].tolist()  # until no more than ``keep`` are left
            gone, size = [gone[i] for i in order], [size[i] for i in order]
        boxes = list(map(root.pop, gone))
        leaves = list(chain.from_iterable((b,) if type(b) is dict else (b[0], *b[1].values()) for b in boxes))
        total = sum(size)
        self.entries -= total
        return (np.repeat(np.array(gone, np.int64), size), np.fromiter(chain.from_iterable(leaves), np.int64, total),
                np.fromiter(chain.from_iterable(map(dict.values, leaves)), np.int64, total))


def _runs(vocabulary: Vocabulary, taken: tuple[np.ndarray, np.ndarray, np.ndarray], buckets: int) -> pa.RecordBatch:
    """The taken subtrees as sorted runs: one row per prefix partition, which
    holds a run of each language."""
    first, rest, count = taken
    places = [first, rest >> 2 * _BITS, rest >> _BITS & _MASK, rest & _MASK]
    h = vocabulary.hash
    bucket = (_chain(*(h[w] for w in places[:3])) % np.uint64(buckets)).astype(np.int64)
    lang = vocabulary.lang[first]
    # the words that occur, in the order of their bytes; 0, no word, before all
    used = np.zeros(len(h), dtype=bool)
    used[0] = True
    for w in places:
        used[w] = True
    used = np.flatnonzero(used)
    words = pa.array([vocabulary.words[i] or b"" for i in used.tolist()], pa.large_binary())
    by_word = pc.sort_indices(words).to_numpy()
    rank = np.empty(len(h), np.int64)
    rank[used[by_word]] = np.arange(len(used))
    places = [rank[w] for w in places]
    # at most four words of 21 bits: two numbers to sort by behind partition and language
    order = np.lexsort((places[2] << _BITS | places[3], places[0] << _BITS | places[1], bucket * len(vocabulary.langs) + lang))
    text = words.take(pa.array(by_word)).cast(pa.large_string())
    text = pa.concat_arrays([pa.array([None], pa.large_string()), text.slice(1)])
    phrase = pc.binary_join_element_wise(*[text.take(pa.array(w[order])) for w in places if w.any()],
                                         pa.scalar(" ", pa.large_string()), null_handling="skip")
    count, bucket, lang = count[order].astype("<i8"), bucket[order], lang[order]
    run = np.append(0, np.flatnonzero((np.diff(bucket) != 0) | (np.diff(lang) != 0)) + 1)
    at = np.append(run, len(bucket))
    joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(at), phrase), pa.scalar("\n", pa.large_string()))
    counts = pa.Array.from_buffers(pa.large_binary(), len(run), [None, pa.py_buffer((at * 8).tobytes()), pa.py_buffer(count.tobytes())])
    head = np.append(0, np.flatnonzero(np.diff(bucket[run])) + 1)
    lists = lambda values: pa.ListArray.from_arrays(pa.array(np.append(head, len(run)), pa.int32()), values)
    return pa.RecordBatch.from_arrays([
        pa.array(bucket[run][head], pa.int32()), lists(pa.array([vocabulary.langs[i] for i in lang[run].tolist()], pa.string())),
        lists(joined.cast(pa.string())), lists(counts.cast(pa.binary())),
        lists(pa.array(np.zeros(len(run)), pa.int64()))], schema=_RUN_SCHEMA)


def _words_and_pairs(word: np.ndarray, piece: np.ndarray, hashes, bloom) -> Iterator[tuple]:
    """Counts of words and of pairs of neighbours in one piece."""
    own = word[:-3]
    at = np.flatnonzero(piece[:-3] == piece[1:-2])
    # a word alone is a pair with no word
    pair, n = np.unique(np.concatenate([own << _BITS, own[at] << _BITS | word[at + 1]]), return_counts=True)
    yield pair >> _BITS, (pair & _MASK) << 2 * _BITS, n


def _longer(word: np.ndarray, piece: np.ndarray, hashes: np.ndarray, bloom: np.ndarray) -> Iterator[tuple]:
    """Counts of three and four words in a row whose pairs the filter lets through."""
    h = hashes[word]
    near = piece[:-1] == piece[1:]
    at = np.flatnonzero(near)
    near[at] = _may_hold(bloom, h[at], h[at + 1])
    three = near[:-1] & near[1:]
    at = np.flatnonzero(three[:len(word) - 3])
    if not len(at):
        return
    pair, which = np.unique(word[at] << _BITS | word[at + 1], return_inverse=True)
    four = three[at] & near[at + 2]
    for here, last in ((np.arange(len(at)), False), (np.flatnonzero(four), True)):
        i = at[here]
        key = which[here] << 2 * _BITS | word[i + 2] << _BITS
        if last:
            key |= word[i + 3]
        key, n = np.unique(key, return_counts=True)
        head = pair[key >> 2 * _BITS]
        yield head >> _BITS, (head & _MASK) << 2 * _BITS | key & (1 << 2 * _BITS) - 1, n


def _count(kind, buckets: int, room: int, lang_col: str, shared=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = shared.value if shared is not None else None
        vocabulary, trie, places = Vocabulary(), HatTrie(), {}
        for batch in (part for whole in batches for part in slices_by_bytes(whole, "text")):
            found = Places(batch.column("text"))
            coded = batch.column(lang_col).dictionary_encode()
            langs, lang_of_row = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            lang_of = lang_of_row[found.row]
            for i, lang in enumerate(langs):
                at = np.flatnonzero(lang_of == i)
                places[lang] = places.get(lang, 0) + len(at)
                for a in range(0, len(at), _WORDS):
                    here = at[a:a + _WORDS + 3]  # three words more, as the rest of phrases that begin before
                    code, inverse = np.unique(found.code[here], return_inverse=True)
                    number = vocabulary.numbers(lang, [found.words[c] for c in code.tolist()])
                    tail = 3 if len(here) <= _WORDS else _WORDS + 3 - len(here)
                    word = np.concatenate([number[inverse], np.zeros(tail, np.int64)])
                    piece = np.concatenate([found.piece[here], -1 - np.arange(tail)])
                    for some in kind(word, piece, vocabulary.hash, bloom):
                        trie.add(*some)
                    if trie.entries > room:
                        yield _runs(vocabulary, trie.spill(room // 4), buckets)
                    if len(vocabulary.words) > _MASK - (_WORDS + 4):
                        yield _runs(vocabulary, trie.spill(0), buckets)
                        vocabulary = Vocabulary()
        if trie.entries:
            yield _runs(vocabulary, trie.spill(0), buckets)
        if bloom is None and places:  # words of each language in all
            one = lambda values, kind: pa.array([values], pa.list_(kind))
            names = list(places)
            yield pa.RecordBatch.from_arrays([
                pa.array([-1], pa.int32()), one(names, pa.string()), one([""] * len(names), pa.string()),
                one([b""] * len(names), pa.binary()), one([places[n] for n in names], pa.int64())], schema=_RUN_SCHEMA)

    return run


def _merge(least: int):
    """Runs of one prefix partition, summed; phrases of fewer occurrences go.
    Partition -1 holds the number of words of each language (phrase null)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])
        for group in sorted_groups(batches, ["bucket"]):
            flat = {c: pc.list_flatten(group.column(c)).combine_chunks() for c in ("langs", "phrases", "counts", "places")}
            if group.column("bucket")[0].as_py() < 0:
                total = pa.table({"lang": flat["langs"], "n": flat["places"]}).group_by("lang", use_threads=False).aggregate([("n", "sum")])
                yield from pa.table([total["lang"], pa.nulls(len(total), pa.string()), total["n_sum"]], schema=schema).to_batches()
                continue
            langs = flat["langs"].dictionary_encode()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                mine = pc.equal(langs.indices, i)
                phrases = pc.list_flatten(pc.split_pattern(flat["phrases"].filter(mine).cast(pa.large_string()), "\n")).dictionary_encode()
                count = np.frombuffer(b"".join(flat["counts"].filter(mine).to_pylist()), "<i8")
                total = np.zeros(len(phrases.dictionary), np.int64)
                np.add.at(total, phrases.indices.to_numpy(), count)
                kept = np.flatnonzero(total >= least)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(kept), pa.string()),
                                                  phrases.dictionary.take(pa.array(kept)).cast(pa.string()), pa.array(total[kept])], schema=schema)

    return run


def _bloom_places(h1: np.ndarray, h2: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = _chain(h1, h2)
    return (h % np.uint64(bits)).astype(np.int64), ((h >> np.uint64(32)) * np.uint64(2654435761) % np.uint64(bits)).astype(np.int64)


def _may_hold(bloom: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    a, b = _bloom_places(h1, h2, len(bloom) * 8)
    return ((bloom[a >> 3] >> (a & 7).astype(np.uint8)) & (bloom[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)


def pair_filter(pairs: DataFrame, bits: int = BLOOM_BITS) -> np.ndarray:
    """Bloom filter of (lang, phrase) pairs of words.  Spark joins the bits by
    words of 64; at most bits / 64 of these reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            if not batch.num_rows:
                continue
            h = [[], []]
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist()):
                salt = xxhash.xxh64_intdigest(lang.encode(), 7)
                for k, w in enumerate(phrase.split(" ")):
                    h[k].append(xxhash.xxh64_intdigest(w.encode(), salt))
            at = np.unique(np.concatenate(_bloom_places(np.array(h[0], np.uint64), np.array(h[1], np.uint64), bits)))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.int64(1) << (at & 63))], names=["word", "bits"])

    words = pairs.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    got = words.toArrow()  # at most bits / 64 rows of 16 bytes
    out = np.zeros(bits >> 6, dtype="<i8")
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint8)


def phrase_counts(docs: DataFrame, least: int = LEAST, text_col: str = "text", lang_col: str = "lang",
                  room: int = 600_000, buckets: int | None = None, bloom_bits: int = BLOOM_BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all phrases of 1 to 4 words with f >= ``least``,
    and (lang, n).  ``room``: entries of a task's trie."""
    spark = docs.sparkSession
    # prefix partitions follow the session's shuffle partitions, which follow the data
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))

    def merged(runs: DataFrame) -> DataFrame:
        dealt = runs.repartition("bucket").sortWithinPartitions("bucket")
        return dealt.mapInArrow(_merge(least), "lang string, phrase string, f long")

    short = materialise(merged(rows.mapInArrow(_count(_words_and_pairs, buckets, room, "lang"), _RUNS)), "phrase-pairs")
    shared = spark.sparkContext.broadcast(pair_filter(short.where(F.instr("phrase", " ") > 0), bloom_bits))
    long = materialise(merged(rows.mapInArrow(_count(_longer, buckets, room, "lang", shared), _RUNS)), "phrase-longer")
    totals = short.where("phrase is null").select("lang", F.col("f").alias("n"))
    return short.where("phrase is not null").unionByName(long), totals


def collocations(docs: DataFrame, least: int = LEAST, share: int = 80, top: int = 2000, scale: int = 2_000_000,
                 **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases.

    A phrase's score is floor(scale * a / (l + r)) of its weakest cut; phrases
    inside a longer one with at least ``share`` percent of their count go."""
    counts, totals = phrase_counts(docs, least, **options)
    words = counts.select("lang", "phrase", "f", F.split("phrase", " ").alias("w"))
    words = words.where(F.size("w") > 1)
    cut = words.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.transform(
        F.sequence(F.lit(1), F.size("w") - 1), lambda k: F.struct(
            k.alias("k"), F.array_join(F.slice("w", F.lit(1), k), " ").alias("left"),
            F.array_join(F.slice("w", k + 1, F.size("w") - k), " ").alias("right")))).alias("c"))
    part = cut.select("lang", "phrase", "a", "c.k", F.explode(F.array(
        F.struct(F.lit(True).alias("is_left"), F.col("c.left").alias("part")),
        F.struct(F.lit(False).alias("is_left"), F.col("c.right").alias("part")))).alias("p")).select("lang", "phrase", "a", "k", "p.*")
    found = part.join(counts.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    both = found.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("is_left"), F.col("f"))).alias("l"),
                                                         F.max(F.when(~F.col("is_left"), F.col("f"))).alias("r"))
    dec = lambda c: F.col(c).cast("decimal(19,0)")
    both = both.withColumn("top", dec("a") * F.lit(scale).cast("decimal(10,0)")).withColumn("low", dec("l") + dec("r"))
    scored = both.withColumn("score", F.expr("top div low"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    inside = words.where(F.size("w") > 2).select("lang", "f", F.explode(F.flatten(F.transform(
        F.sequence(F.lit(2), F.size("w") - 1), lambda m: F.transform(
            F.sequence(F.lit(1), F.size("w") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " "))))).alias("phrase"))
    covered = inside.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    cover = F.lit(100).cast("decimal(3,0)") * dec("longer") >= F.lit(share).cast("decimal(3,0)") * dec("a")
    kept = best.join(covered, ["lang", "phrase"], "left").where(F.col("longer").isNull() | ~cover)
    order = Window.partitionBy("lang").orderBy(F.desc("b.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "b.l", "b.r", "n",
                                              "b.score")
