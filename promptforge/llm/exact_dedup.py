"""Exact dedup: 128-bit content hash, bytes compared inside each hash group.

Everything is DataFrame work.  One aggregation groups by (hash, text): Spark
compares the bytes of rows that share a hash, so texts that only collide end
up in different classes, and copies are combined on the map side before they
are shuffled (a text that fills a third of the table leaves each task once).
The wide text moves in that one shuffle; what follows carries hashes and ids.

Defined cases: a null text counts as empty; rows with the same id and text
are one document (one result row; ``group_size`` counts the rows); a null id
is smaller than any id and stays only where its class has no other id; an
empty table gives an empty result; further columns are ignored by
``exact_groups`` and carried by ``keep_one``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptforge.llm.common import materialise


def _pick(keep: str):
    if keep not in ("min", "max"):
        raise ValueError(f"keep must be min or max, not {keep!r}")
    return F.min if keep == "min" else F.max


def _text(col: str, normalise) -> Column:
    text = F.coalesce(F.col(f"`{col}`").cast("string"), F.lit(""))
    return normalise(text) if normalise else text


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 keep: str = "min", normalise=None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep`` names the id that stays (smallest by default); ``normalise`` is
    an optional Column -> Column rule applied before texts are compared.
    """
    pick = _pick(keep)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), _text(text_col, normalise).alias("_t"))
    rows = rows.withColumn("_h", F.unhex(F.md5("_t")))
    classes = rows.groupBy("_h", "_t").agg(F.count(F.lit(1)).alias("group_size"), pick("doc_id").alias("keep_id"))
    # narrow: one row per hash; _k > 1 marks hashes that several texts share
    hashes = materialise(classes.groupBy("_h").agg(F.count(F.lit(1)).alias("_k"), F.max("group_size").alias("group_size"),
                                                   F.max("keep_id").alias("keep_id")), "exact-hashes")
    members = rows.select("doc_id", "_h", F.sha2("_t", 256).alias("text_sha256")).distinct()
    out = members.join(hashes.where("_k = 1"), "_h")
    collided = hashes.where("_k > 1").select("_h")
    if not collided.isEmpty():  # one bit to the driver; practically never taken
        inside = rows.join(collided, "_h")
        exact = inside.groupBy("_h", "_t").agg(F.count(F.lit(1)).alias("group_size"), pick("doc_id").alias("keep_id"))
        again = inside.select("doc_id", "_h", "_t").distinct().join(exact, ["_h", "_t"])
        out = out.drop("_k").unionByName(again.withColumn("text_sha256", F.sha2("_t", 256)).drop("_t"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                      "text_sha256")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             keep: str = "min", normalise=None) -> DataFrame:
    """The rows that stay, with all columns of ``docs``: one shuffle, in which
    each class keeps its best row as a map-side combined aggregate.  Rows that
    agree in id and text are told apart by a hash of their other columns."""
    pick = F.min_by if _pick(keep) is F.min else F.max_by
    cols = docs.columns
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols) if c != text_col],
                     F.col(f"`{text_col}`").isNull().alias("no_text"),
                     *([F.col(f"`{text_col}`").alias("text")] if normalise else []))
    plain = [F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t and c != text_col]
    best = F.struct(F.col(f"`{id_col}`").isNull() if keep == "min" else F.col(f"`{id_col}`").isNotNull(),
                    F.col(f"`{id_col}`"), F.xxhash64(*plain))
    keyed = docs.select(_text(text_col, normalise).alias("_t"), whole.alias("_row"), best.alias("_by"))
    kept = keyed.groupBy(F.unhex(F.md5("_t")).alias("_h"), "_t").agg(pick("_row", "_by").alias("_row"))
    text = F.col("_row.text") if normalise else F.when(~F.col("_row.no_text"), F.col("_t"))
    return kept.select(*[(text if c == text_col else F.col(f"_row.c{i}")).alias(c) for i, c in enumerate(cols)])
