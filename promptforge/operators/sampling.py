"""Sampling, de-duplication against existing prompts and resume
(SURVEY L4-L6, J3, J4, U4, C1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptforge.functions.text import _col, one_line, strip


def sample_key(key, seed: int) -> Column:
    """Repeatable pseudo-random order: md5 of the seed and the row key."""
    return F.md5(F.concat(F.lit(str(seed)), _col(key).cast("string")))


# Hex digits of the key that the histogram counts: at most 16 ** 4 rows.
_BUCKET_DIGITS = 4


def top_by_sample_key(df: DataFrame, n: int, tiebreak: str) -> DataFrame:
    """The n rows with the smallest ``sample_key`` (md5 hex), exactly.

    A histogram over the first hex digits of the key (at most 65,536 rows,
    map-side combined) names the bucket in which the n-th row lies; only rows
    up to that bucket enter the top-k, so its last task sees about n rows
    instead of n of every partition.  The bucket is a lazy scalar subquery."""
    bucket = F.substring("sample_key", 1, _BUCKET_DIGITS)
    counts = df.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("c"))
    start = F.struct(F.lit(0).cast("long").alias("rows"), F.lit(None).cast("string").alias("b"))
    last = counts.agg(F.array_sort(F.collect_list(F.struct("b", "c"))).alias("h")).select(
        F.aggregate("h", start, lambda done, x: F.when(done["rows"] >= n, done).otherwise(
            F.struct((done["rows"] + x["c"]).alias("rows"), x["b"].alias("b"))))["b"]).scalar()
    return df.filter(bucket <= last).orderBy("sample_key", tiebreak).limit(n)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """N rows without replacement in seeded random order (exact top-n
    by ``md5(seed || key)``; see :func:`top_by_sample_key`)."""
    return top_by_sample_key(df.withColumn("sample_key", sample_key(key, seed)), n, key)


def text_key(c) -> Column:
    """SHA-256 of a text: what membership joins shuffle instead of the text."""
    return F.sha2(_col(c), 256)


def new_prompts(candidates: DataFrame, existing: DataFrame, text: str = "prompt",
                existing_text: str = "prompt") -> DataFrame:
    """Candidates whose normalised text is not among the normalised
    existing prompts — an anti-join on a hash of the text, so the existing
    side sends hashes alone."""
    # distinct combines repeated existing prompts map-side before the shuffle
    ex = existing.select(text_key(one_line(existing_text)).alias("_norm")).filter(F.col("_norm").isNotNull()).distinct()
    return candidates.withColumn("_norm", text_key(one_line(text))).join(ex, "_norm", "left_anti").drop("_norm")


def sample_new_prompts(corpus: DataFrame, existing: DataFrame, n: int, seed: int = 42, key: str = "doc_id",
                       text: str = "text", existing_text: str = "prompt") -> DataFrame:
    """C1 (L4 + L5 + J3 + P2): normalise, keep one row per distinct prompt,
    drop prompts that already exist, then take n in seeded order.  Filtering
    before sampling means every sampled row is new in one pass (no redraw
    loop).  Hashes and keys alone are shuffled; the n texts are joined last."""
    # a null text is no prompt; prompts without an id come last, in the order of
    # their hashes ("g" sorts behind the hex digits)
    norm = corpus.select(key, text_key(one_line(text)).alias("_norm")).where("_norm is not null")
    norm = norm.withColumn("sample_key", F.coalesce(sample_key(key, seed), F.concat(F.lit("g"), "_norm")))
    # de-duplicate first: the partial min runs map-side, so a text held by a
    # third of the corpus reaches the shuffle as one row per task; the
    # anti-join then reuses the hash partitioning (one exchange per side)
    one = norm.groupBy("_norm").agg(F.min(F.struct("sample_key", key)).alias("_m")) \
              .select("_norm", F.col(f"_m.{key}").alias(key), F.col("_m.sample_key").alias("sample_key"))
    ex = existing.select(text_key(one_line(existing_text)).alias("_norm")).filter(F.col("_norm").isNotNull()).distinct()
    picked = top_by_sample_key(one.join(ex, "_norm", "left_anti"), n, key)
    texts = corpus.select(key, one_line(text).alias("prompt"), text_key(one_line(text)).alias("_norm"))
    here = picked.select(F.col(key).alias("_key"), F.col("_norm").alias("_picked"), "sample_key")
    out = texts.join(here, (F.col("_norm") == F.col("_picked")) & texts[key].eqNullSafe(F.col("_key")))
    out = out.dropDuplicates(["_norm"])  # n rows; an id may repeat
    drawn = F.when(F.col("_key").isNotNull(), F.col("sample_key")).alias("sample_key")
    return out.select(texts[key], "prompt", drawn).orderBy(F.asc_nulls_last("sample_key"), key)


def resume_pending(rows: DataFrame, finished: DataFrame, prompt: str = "prompt",
                   finished_col: str = "original_prompt") -> DataFrame:
    """Rows whose stripped prompt is not among the finished prompts."""
    done = finished.select(text_key(finished_col).alias("_p")).filter(F.col("_p").isNotNull()).distinct()
    return rows.withColumn("_p", text_key(strip(prompt))).join(done, "_p", "left_anti").drop("_p")
