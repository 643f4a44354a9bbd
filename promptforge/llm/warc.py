"""WARC derivatives: linked metadata and plain-text conversion records.

Every response record gives two records that refer to it: ``metadata``
(application/warc-fields: the source's HTTP status and headers, its digests,
title, language and outlinks, and the id of the conversion) and ``conversion``
(text/plain, UTF-8).  Both carry WARC-Refers-To with the response's record id,
target URI and date, and digests of their own block.  Record ids are UUIDs
from a hash of what the record says, so reruns give the same records.

All of it is column work in one pass over the responses, without a shuffle.
``write`` and ``read`` move records to and from .warc files (the two line
ends after a record are the file's line separator, so Spark's own text writer
and its task commit produce the files).

Defined cases: a null payload or URI counts as empty; an empty payload gives
an empty block; an unclosed script, style or comment runs to the end; a tag
that is never closed is text; repeated rows give repeated records with the
same ids; a null page id is kept; an empty table gives no records; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
CRAWL_DATE = "1970-01-01T00:00:00Z"  # of pages without a date; a parameter
HTTP_HEADERS = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"

# fixed values: RFC 4648 base32 alphabet
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

_DROP = r"(?is)<(?:!--.*?(?:-->|\z)|(?:script|style|noscript|template)\b.*?(?:</(?:script|style|noscript|template)\s*>|\z))"
_BREAK = (r"(?i)<(?:/?(?:p|div|h[1-6]|li|ul|ol|tr|table|section|article|header|footer|nav|aside|blockquote|pre|title|head|body)|[bh]r)"
          r"\b[^<>]*>")
_TAG = r"(?s)<[/!?A-Za-z][^<>]*>"
#: named entities that become text, the ampersand last
_ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")]
_TITLE = r"(?is)<title[^<>]*>(.*?)</title"
_LANG = r"""(?is)<html[^<>]*\blang=["']([^"'<>]*)"""
_LINK = r"""(?i)<a\b[^<>]*\bhref=["']([^"'<>]*)["']"""


def _trim_lines(text: Column) -> Column:
    text = F.regexp_replace(text, r"[ \t\r\f\x0b]{2,}|[\t\r\f\x0b]", " ")
    return F.btrim(F.regexp_replace(text, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def plain_text(html: Column) -> Column:
    """Text of a page: scripts, styles and comments go, block tags end lines,
    other tags go, common entities become characters, blank runs shrink."""
    text = F.regexp_replace(F.regexp_replace(html, _DROP, " "), _BREAK, "\n")
    text = F.regexp_replace(text, _TAG, "")
    for name, char in _ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return _trim_lines(text)


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sha1_base32(data: Column) -> Column:
    """``sha1:`` digest label in base32, as WARC headers write it."""

    def label(digest: Column) -> Column:
        parts = []
        for i in range(8):  # 20 bits a time
            five = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
            parts += [F.substring(F.lit(_BASE32), F.shiftright(five, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
        return F.concat(F.lit("sha1:"), *parts)

    return _once(F.sha1(data.cast("binary")), label)


def _uuid(*parts: Column) -> Column:
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return _once(F.md5(F.concat_ws("\n", *parts)), lambda h: F.concat(
        F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, at, n) for at, n in cuts]), F.lit(">")))


def responses_of_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                       date: str = CRAWL_DATE, http_headers: str = HTTP_HEADERS) -> DataFrame:
    """Response records of a table of pages: page_id, record_id, target_uri,
    date, http_headers, payload."""
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.coalesce(F.col(f"`{url_col}`"), F.lit("")).alias("target_uri"),
                        F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("payload"))
    return rows.select("page_id", _uuid(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("target_uri"),
                                        F.md5("payload")).alias("record_id"),
                       "target_uri", F.lit(date).alias("date"), F.lit(http_headers).alias("http_headers"), "payload")


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing if the value is empty."""
    return _once(value, lambda v: F.when(F.length(v) > 0, F.concat(F.lit(name + ": "), v, F.lit(CRLF))).otherwise(F.lit("")))


def _one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def derive(responses: DataFrame) -> DataFrame:
    """The metadata and conversion record of every response: page_id,
    record_type, record_id, refers_to, target_uri, date, content_type,
    source_digest, block_digest, content_length, block."""
    r = responses.select("page_id", F.col("record_id").alias("refers_to"), "target_uri", "date", "http_headers", "payload")
    r = r.withColumn("source_digest", sha1_base32(F.col("payload")))
    status = F.regexp_extract("http_headers", r"\AHTTP/\S+ ([^\r\n]*)", 1)
    source_headers = F.regexp_replace("http_headers", r"\AHTTP/[^\r\n]*\r?\n", "")
    source_headers = F.regexp_replace(source_headers, r"(?m)^([!-9;-~]+:)", "source-$1")
    links = F.regexp_extract_all("payload", F.lit(_LINK), F.lit(1))
    outlinks = F.array_join(F.transform(links, lambda x: F.concat(F.lit("outlink: "), _one_line(x), F.lit(CRLF))), "")
    conversion = _uuid(F.lit("conversion"), F.col("refers_to"), F.col("source_digest"))
    fields = F.concat(
        _field("conversion-id", conversion), _field("source-status", status), source_headers,
        _field("source-payload-digest", F.col("source_digest")),
        _field("source-length", F.octet_length("payload").cast("string")),
        _field("title", _one_line(F.regexp_extract("payload", _TITLE, 1))),
        _field("language", _one_line(F.regexp_extract("payload", _LANG, 1))), outlinks)
    # the two kinds come from a constant list, so that neither block is computed for the row count alone
    out = r.withColumn("record_type", F.explode(F.array(F.lit("metadata"), F.lit("conversion"))))
    meta = F.col("record_type") == "metadata"
    out = out.select(
        "page_id", "record_type", _uuid(F.col("record_type"), F.col("refers_to"), F.col("source_digest")).alias("record_id"), "refers_to",
        "target_uri", "date", F.when(meta, F.lit("application/warc-fields")).otherwise(F.lit("text/plain; charset=utf-8")).alias("content_type"),
        "source_digest", F.when(meta, fields).otherwise(plain_text(F.col("payload"))).alias("block"))
    return out.select(*[c for c in out.columns if c != "block"], sha1_base32(F.col("block")).alias("block_digest"),
                      F.octet_length("block").cast("long").alias("content_length"), "block")


def render(records: DataFrame) -> DataFrame:
    """``record``: header lines and block of each record, as in a .warc file
    (without the two line ends that close a record)."""
    head = F.concat(
        F.lit("WARC/1.1" + CRLF), _field("WARC-Type", F.col("record_type")), _field("WARC-Record-ID", F.col("record_id")),
        _field("WARC-Date", F.col("date")), _field("WARC-Target-URI", F.col("target_uri")),
        _field("WARC-Refers-To", F.col("refers_to")), _field("WARC-Refers-To-Target-URI", F.col("target_uri")),
        _field("WARC-Refers-To-Date", F.col("date")), _field("WARC-Source-Payload-Digest", F.col("source_digest")),
        _field("WARC-Block-Digest", F.col("block_digest")), _field("Content-Type", F.col("content_type")),
        F.lit("Content-Length: "), F.col("content_length").cast("string"), F.lit(CRLF + CRLF))
    return records.select(F.concat(head, "block").alias("record"))


def write(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write records as .warc text files, one per task."""
    render(records).write.option("compression", compression).option("lineSep", CRLF + CRLF).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of .warc files with text blocks: ``headers`` (map of lower-case
    names) and ``block``.  A block shorter than its Content-Length (a payload
    that holds a record's first line would be cut there) stops the job."""
    version = "WARC/1.1" + CRLF
    rows = spark.read.option("lineSep", CRLF + CRLF + version).text(path)
    rows = rows.select(F.regexp_replace("value", r"\A" + version, "").alias("v")).where(F.length("v") > 0)
    end = F.instr("v", CRLF + CRLF)
    rows = rows.select(F.split(F.substring("v", F.lit(1), end - 1), CRLF).alias("h"), F.expr("substring(v, instr(v, '\r\n\r\n') + 4)").alias("b"))
    headers = F.map_from_arrays(F.transform("h", lambda x: F.lower(F.substring_index(x, ": ", 1))),
                                F.transform("h", lambda x: F.regexp_replace(x, r"\A[^:]*: ?", "")))
    rows = rows.select(headers.alias("headers"), F.col("b").cast("binary").alias("b"))
    size = F.col("headers")["content-length"].cast("int")
    fits = F.octet_length("b") >= size
    block = F.when(fits, F.substring("b", F.lit(1), size)).otherwise(F.raise_error(F.lit("block shorter than its Content-Length")))
    return rows.select("headers", block.cast("string").alias("block"))
