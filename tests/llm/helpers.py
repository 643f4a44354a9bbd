"""Small tables with every awkward row, shared by the operator tests."""

from __future__ import annotations

from pyspark.sql import types as T

DOC = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.IntegerType()),
    # names that operators use inside or return
    T.StructField("fp", T.StringType()), T.StructField("size", T.StringType()), T.StructField("kept", T.StringType())])


def docs(spark, rows):
    """rows of (doc_id, text[, lang[, source]])"""
    full = [(*r, *(None, None)[len(r) - 2:]) if len(r) < 4 else r for r in rows]
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", "y", "z") for r in full], DOC)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


AWKWARD = [
    (1, "the quick brown fox jumps over the lazy dog", "en", "a"),
    (2, "the quick brown fox jumps over the lazy dog", "en", "a"),
    (3, "The Quick brown  fox\njumps over the lazy dog ", "en", None),
    (4, None, None, "b"),
    (5, "", "en", "b"),
    (6, " \t\n\x0b\x0c\r ", None, None),
    (7, "word", "en", "a"),
    (8, "日本語 のテキスト é ß 𠮷", "ja", "c"),
    (9, "1234 !!! --- 5678", None, "c"),
    (10, " ".join(f"w{i}" for i in range(30_000)), "en", "a"),
    (11, "x" * 200_000, None, "a"),
    (12, "a b <|endoftext|> <s> ▁ \x00", "en", "b"),
    (12, "a b <|endoftext|> <s> ▁ \x00", "en", "b"),
    (12, "another text with the same id", "en", "b"),
    (None, "no id here", "en", "a"),
    (None, "no id here", "en", "a"),
    (None, None, None, None),
]
