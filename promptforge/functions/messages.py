"""Chat-message columns.

A message list is ``array<struct<role, content: array<struct<type, text, image_url>>>>``;
text-only messages carry one ``text`` part.  Requests are keyed by a SHA-256 of
the stage name, the scope (dataset and run) and the business keys, so re-running a job yields the same ids
and replies can be joined back without any driver-side state.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptforge.functions.text import _col

KEY_SEP = "\x1f"


def text_part(text) -> Column:
    return F.struct(F.lit("text").alias("type"), _col(text).cast("string").alias("text"),
                    F.lit(None).cast("string").alias("image_url"))


def image_part(url) -> Column:
    return F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"),
                    _col(url).cast("string").alias("image_url"))


def message(role: str, *parts: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), F.array(*parts).alias("content"))


def text_message(role: str, text) -> Column:
    return message(role, text_part(text))


def _key_text(key) -> Column:
    """A key as text; a null is told apart from every value."""
    return F.coalesce(F.concat(F.lit("="), _col(key).cast("string")), F.lit("~"))


def request_id(stage: str, *keys, scope: str = "") -> Column:
    """Deterministic request key: sha256 of stage, scope and keys.  ``scope``
    names the dataset and run, so equal keys of two datasets differ."""
    return F.sha2(F.concat_ws(KEY_SEP, F.lit(stage), F.lit(scope), *[_key_text(k) for k in keys]), 256)


def short_key(c) -> Column:
    """128 bits of a long key (a request id, a text) for joins and groupings: a
    quarter of a hex SHA-256 in a shuffle.  Null stays null; of ten billion
    different keys two share one with a probability under 1e-18."""
    return F.unhex(F.md5(_col(c)))


def message_text(msg) -> Column:
    """Text parts of one message joined by newlines."""
    return F.array_join(F.transform(F.filter(_col(msg)["content"], lambda p: p["type"] == "text"),
                                    lambda p: p["text"]), "\n")


def modality(messages) -> Column:
    """The first message decides — ``multimodal`` if its content has an image part."""
    first = F.get(_col(messages), 0)
    return F.when(F.exists(first["content"], lambda p: p["type"] == "image_url"),
                  F.lit("multimodal")).otherwise(F.lit("text"))
