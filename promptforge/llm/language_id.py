"""Language ID by word-first backoff.

A text's words (runs of letters, lower case) are scored one by one.  A word
of the model scores its log relative frequency in every language, whichever
language brought it into the model (a floor where training never saw it).  Any
other word backs off to its character n-grams, longest first: the mean over
the n-grams of the first length of which the model has any; n-grams are
counted over all words of the sample.  The text goes to the language with the
largest total; the score is that language's share of the likelihood.

Training reads a bounded sample: at most ``docs_per_lang`` documents a
language, chosen by a hash of the id, and ``max_docs`` in all.  The model has
at most ``max_entries`` words and n-grams in all (the most frequent of each
language; rarer words are unseen to it), so it is small enough to broadcast at any size of the corpus.
Prediction is one pass without a shuffle over whole texts.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
a text none of whose words or letters training saw goes to the first language
in order, with score 1 / languages; a corpus without training rows makes
every text ``und``; equal totals go to the first language in order; repeated
rows repeat; a null id is not held out and never trains; further columns are
ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptforge.llm.common import materialise, slices_by_bytes

DOCS_PER_LANG = 800
MAX_DOCS = 20_000
MAX_ENTRIES = 400_000
LEAST_SCORE = 0.3        # a text under this share of the likelihood is not recognised
LONGEST = 4              # characters of the longest n-gram
_ROOM = 400_000          # white-space tokens whose scores a task keeps, fewer with very many languages
_CELLS = 4_000_000
_LETTERS = regex.compile(r"\p{L}+")


def crc_bucket(id_col: str, buckets: int = 4) -> Column:
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % buckets


def training_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    usable: Column | None = None, docs_per_lang: int = DOCS_PER_LANG, max_docs: int = MAX_DOCS) -> DataFrame:
    """(lang, text) of the bounded training sample.  Ids are chosen first, on
    two narrow columns; a repeated id brings all its rows of that language."""
    usable = F.lit(True) if usable is None else usable
    able = docs.where(usable & F.col(f"`{id_col}`").isNotNull() & F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull())
    keys = able.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{lang_col}`").alias("lang"), F.xxhash64(id_col, F.lit(11)).alias("_h"))
    # a histogram of the hashes' leading bits says how far each language's sample reaches, so that the
    # window below sees little more than the sample, however many tasks read the table
    keys = keys.withColumn("_bucket", F.shiftright("_h", 52))
    before = Window.partitionBy("lang").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    reach = keys.groupBy("lang", "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    reach = reach.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).where(F.col("_before") < docs_per_lang)
    reach = reach.groupBy("lang").agg(F.max("_bucket").alias("_last"))
    # one row a language: the model lists the languages anyway
    keys = keys.join(F.broadcast(reach), "lang").where(F.col("_bucket") <= F.col("_last"))
    first = Window.partitionBy("lang").orderBy("_h", "_id")
    keys = keys.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= docs_per_lang)
    # at most max_docs narrow rows: a proven bound for the broadcast
    keys = keys.orderBy("_n", "lang").limit(max_docs).select("_id", "lang").distinct()
    rows = able.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    return rows.join(F.broadcast(keys), ["_id", "lang"]).select("lang", "text")


class Model:
    """Log relative frequencies: rows of words and of n-grams by length."""

    def __init__(self, langs: list[str], words: dict[str, int], grams: list[dict[str, int]], table: np.ndarray):
        self.langs, self.words, self.grams, self.table = langs, words, grams, table

    def word(self, word: str) -> np.ndarray | None:
        """Score of one word in every language; None if nothing is known."""
        at = self.words.get(word)
        if at is not None:
            return self.table[at]
        marked = f" {word} "
        for n in range(len(self.grams), 0, -1):
            known = self.grams[n - 1]
            rows = [known[g] for i in range(len(marked) - n + 1) if (g := marked[i:i + n]) in known]
            if rows:
                return self.table[rows].mean(axis=0)
        return None


def _top(counts: DataFrame, parts: list[str], quota: int) -> DataFrame:
    """The ``quota`` most frequent keys of each part."""
    rank = F.row_number().over(Window.partitionBy(*parts).orderBy(F.desc("n"), "key"))
    return counts.withColumn("_r", rank).where(F.col("_r") <= quota).drop("_r")


def fit(sample: DataFrame, longest: int = LONGEST, max_entries: int = MAX_ENTRIES) -> Model:
    """Count the words of the sample and their n-grams in Spark.  The most
    frequent of each language are the model's keys (``max_entries`` in all); their
    counts in every language come to the driver."""
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("key"))
    words = materialise(words.groupBy("lang", "key").agg(F.count(F.lit(1)).alias("n")), "langid-words")
    langs = [r["lang"] for r in words.select("lang").distinct().orderBy("lang").collect()]
    if not langs:
        return Model([], {}, [], np.zeros((0, 0)))
    # keys are scored in every language: the model's table stays within max_entries keys and _CELLS scores
    quota = max(1, min(max_entries, _CELLS // len(langs)) // (len(langs) * (longest + 1)))
    marked = words.select("lang", F.concat(F.lit(" "), "key", F.lit(" ")).alias("w"), "n")
    counts = words.select("lang", F.lit(0).alias("g"), "key", "n")
    for g in range(1, longest + 1):
        at = F.sequence(F.lit(1), F.length("w") - g + 1)
        counts = counts.unionByName(marked.where(F.length("w") >= g).select("lang", F.lit(g).alias("g"), F.explode(F.transform(
            at, lambda i: F.substring("w", i, F.lit(g)))).alias("key"), "n"))  # noqa: B023
    counts = materialise(counts.groupBy("lang", "g", "key").agg(F.sum("n").alias("n")), "langid-counts")
    totals = counts.groupBy("lang", "g").agg(F.sum("n").alias("total"))
    kept = _top(counts, ["lang", "g"], quota).select("g", "key").distinct()
    rows = counts.join(kept, ["g", "key"], "left_semi").join(totals, ["lang", "g"]).select("lang", "g", "key", "n", "total").collect()
    rows.sort(key=lambda r: (r["g"], r["key"], r["lang"]))  # at most max_entries keys, one row a language that has the key
    total = {(r["lang"], r["g"]): r["total"] for r in rows}
    known: list[dict[str, int]] = [{} for _ in range(longest + 1)]
    size = 0
    for r in rows:
        if r["key"] not in known[r["g"]]:
            known[r["g"]][r["key"]] = size
            size += 1
    scores = np.empty((size, len(langs)))
    at = {lang: i for i, lang in enumerate(langs)}
    for g, keys in enumerate(known):
        if keys:
            floor = [np.log(0.5 / total.get((lang, g), 1)) for lang in langs]
            scores[min(keys.values()):max(keys.values()) + 1] = floor
    for r in rows:
        scores[known[r["g"]][r["key"]], at[r["lang"]]] = np.log(r["n"] / r["total"])
    return Model(langs, known[0], known[1:], scores)


class Scorer:
    """Scores texts with a model.  White-space tokens are scored once and kept
    in a bounded table; a full table starts anew."""

    def __init__(self, model: Model, room: int = _ROOM):
        self.model, self.langs = model, len(model.langs)
        self.room = max(1024, min(room, _CELLS // (self.langs + 1)))
        self.table = np.empty((self.room, self.langs + 1))
        self.rows: dict[str, int] = {}

    def _score(self, token: str) -> np.ndarray:
        """Sum over the token's words of their scores; last: has it a letter."""
        out = np.zeros(self.langs + 1)
        for word in _LETTERS.findall(token.lower()):
            out[-1] = 1
            score = self.model.word(word)
            if score is not None:
                out[:-1] += score
        return out

    def __call__(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs:
            return "und", 0.0
        counts = Counter(text.split())
        if len(self.rows) + len(counts) > self.room:
            self.rows.clear()
        rows, times, more = [], [], np.zeros(self.langs + 1)
        get = self.rows.get
        for token, n in counts.items():
            row = get(token)
            if row is None:
                if len(token) > 40 or len(self.rows) >= self.room:
                    more += n * self._score(token)
                    continue
                row = self.rows[token] = len(self.rows)
                self.table[row] = self._score(token)
            rows.append(row)
            times.append(n)
        total = more + np.array(times, dtype=float) @ self.table[rows] if rows else more
        if not total[-1]:
            return "und", 0.0
        total = total[:-1]
        best = int(total.argmax())
        return self.model.langs[best], float(1 / np.exp(total - total[best]).sum())


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_name: str = "lang_pred",
            score_name: str = "score") -> DataFrame:
    """``docs`` with the two prediction columns; only ``text_col`` is read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(lang_name, T.StringType()), T.StructField(score_name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value)
        for batch in (part for whole in batches for part in slices_by_bytes(whole, text_col)):
            found = [score(t.as_py()) for t in batch.column(text_col)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*batch.schema.names, lang_name, score_name])

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held: int = 2,
             buckets: int = 4, **fit_options) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; documents whose
    crc32(id) mod ``buckets`` is ``held`` never train."""
    bucket = crc_bucket(id_col, buckets)
    model = fit(training_sample(docs, id_col, text_col, lang_col, bucket != held), **fit_options)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(crc_bucket(id_col, buckets) == held, F.lit(False)).alias("held_out"),
                       F.col(f"`{text_col}`").cast("string").alias("_text"))
    return predict(rows, model, "_text").drop("_text")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    least: float = LEAST_SCORE, **fit_options) -> DataFrame:
    """The documents whose language is recognised: not ``und``, and a score of
    at least ``least``; columns as they came, whatever their names.  Texts go to
    Python, a verdict comes back; the rows themselves stay with Spark."""
    model = fit(training_sample(docs, id_col, text_col, lang_col, crc_bucket(id_col) != 2), **fit_options)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.BooleanType())
    def recognised(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        score = Scorer(shared.value, _ROOM // 2)  # whole rows pass beside the texts and need their room
        for texts in columns:
            found = (score(t.as_py()) for t in texts)
            yield pa.array([lang != "und" and share >= least for lang, share in found], pa.bool_())

    return docs.where(recognised(F.col(f"`{text_col}`").cast("string")))
