"""Response parsers and reply joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptforge.functions.text import _col, split_lines, strip

# Fixed value: the marker that precedes the generated prompt in the
# fine-tuned model's output (also the end of every training text).
GENERATION_MARKER = "Here is the rephrased prompt:"


def best_from_reply(c) -> Column:
    """The instant-mode selection reply, stripped."""
    return strip(c)


def best_tag(c) -> Column:
    """Extra: the text of the first <BEST> tag of an instant-mode reply,
    stripped; null without one (the selection request is the usual way)."""
    found = F.regexp_extract(_col(c), r"(?s)<BEST>(.*?)</BEST>", 1)
    return F.when(_col(c).rlike(r"(?s)<BEST>.*?</BEST>"), strip(found))


def paraphrase_candidates(replies: DataFrame, reply: str = "reply", keys=("request_id",)) -> DataFrame:
    """One row per non-empty line of the reply, 0-based ``cand_pos``."""
    return replies.select(*keys, F.posexplode(split_lines(reply)).alias("cand_pos", "revised_prompt"))


def generated_prompt(c) -> Column:
    """Text after the marker (2nd piece of the split), stripped; null when
    the marker is missing (the reference fails on such rows)."""
    pieces = F.split(_col(c), "\\Q" + GENERATION_MARKER + "\\E")
    return strip(F.get(pieces, 1))


def attach_replies(requests: DataFrame, replies: DataFrame, key: str = "request_id") -> DataFrame:
    """Replies joined back to their requests (inner equi-join)."""
    return requests.join(replies, key, "inner")


def one_reply(replies: DataFrame, valid: Column | None = None, key: str = "request_id") -> DataFrame:
    """One valid reply per request: the smallest in the order of an ``attempt``
    column where there is one, else of the reply's own columns.  A partial
    ``min(struct)``, so a request that was asked very often costs one row a
    task; invalid replies (null, not yes / no, ...) never hide a valid one."""
    good = replies if valid is None else replies.filter(valid)
    rest = [c for c in good.columns if c != key]
    order = sorted(rest, key=lambda c: c != "attempt")
    kept = good.groupBy(key).agg(F.min(F.struct(*order)).alias("_r"))
    return kept.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def open_requests(requests: DataFrame, replies: DataFrame, valid: Column | None = None,
                  key: str = "request_id") -> DataFrame:
    """Requests without a valid reply yet — the next job run sends only these."""
    good = replies if valid is None else replies.filter(valid)
    return requests.join(good.select(key), key, "left_anti")
