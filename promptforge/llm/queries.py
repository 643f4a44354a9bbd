"""Registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptforge.llm import (
    binary_records,
    bit_sliced,
    cube_mix,
    edit_tokens,
    exact_dedup,
    hat_trie,
    language_id,
    sentencepiece_trie,
    simhash_bk,
    slack_packing,
    source_audit,
    substring_chain,
    warc,
)
from promptforge.llm.common import table
from promptforge.session import scratch_dir

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_file(name: str) -> str:
    """Default place of a public tokenizer file; every operator takes a path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page."""
    return warc.derive(warc.responses_of_pages(table(spark, sf_dir, "pages")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by words first, then shorter n-grams."""
    return language_id.identify(table(spark, sf_dir, "documents"))


def op3_substring_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 or more words that documents share at similarity 0.8."""
    return substring_chain.repeated_passages(table(spark, sf_dir, "documents"))


def op4_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150 % of their words by source weights 5, 2, 1."""
    return cube_mix.mix(table(spark, sf_dir, "documents")).drop("times", "key")


def op5_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written as framed records and read back."""
    path = scratch_dir(spark, "records")
    binary_records.write(table(spark, sf_dir, "documents"), path, tokenizer_file("byte_bpe_50k.json"), end_id=2)
    return binary_records.crc_of_ids(binary_records.read(spark, path))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of identical texts; the largest doc_id stays."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="max")


def op7_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest inner products of every 50th vector, over a bit-sliced index."""
    return bit_sliced.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op8_simhash_bk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components over 3-word shingles within 3 bits."""
    return simhash_bk.components(table(spark, sf_dir, "documents"), width=3, radius=3)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, and whether they decode to its text."""
    return sentencepiece_trie.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op10_edit_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document before and after the edits of a cleaning pass."""
    import public_tokenizers

    return edit_tokens.count_edited(table(spark, sf_dir, "documents"), edit_tokens.cleaning_edits,
                                    tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, carry=["lang"])


def op11_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids in sequences of 2048, filled by subset sums."""
    pieces = slack_packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), window=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2000 strongest phrases of 2 to 4 words."""
    return hat_trie.collocations(table(spark, sf_dir, "documents"), least=30, share=80, top=2000, scale=2_000_000)


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between a language's sources, and the terms that mark each."""
    return source_audit.audit(table(spark, sf_dir, "documents"), least=30, top=50)


LLM_QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_warc_derivatives, op2_language_id, op3_substring_chains, op4_cube_mix, op5_binary_records, op6_exact_dedup,
    op7_bit_sliced_topk, op8_simhash_bk, op9_sentencepiece, op10_edit_token_counts, op11_slack_packing, op12_phrase_mining,
    op13_source_audit)}


def _warc_sql() -> str:
    """The derivative records in DuckDB: same record rule, own expressions."""
    crlf = "chr(13) || chr(10)"
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    swap = lambda x, pattern, to: f"regexp_replace({x}, {quoted(pattern)}, {to}, 'g')"
    uuid = lambda *p: (f"(select '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' "  # noqa: E731
                       f"from (select md5(concat_ws(chr(10), {', '.join(p)})) h))")
    digit = lambda i, s: f"'{warc._BASE32}'[(((cast('0x' || d[{5 * i + 1}:{5 * i + 5}] as bigint) >> {s}) & 31) + 1)]"
    sha = lambda x: (f"(select 'sha1:' || {' || '.join(digit(i, s) for i in range(8) for s in (15, 10, 5, 0))} "  # noqa: E731
                     f"from (select sha1({x}) d))")
    line = lambda x: f"trim({swap(x, '[ \t\n\x0b\f\r]+', quoted(' '))})"
    field = lambda name, x: f"case when length({x}) > 0 then '{name}: ' || {x} || {crlf} else '' end"
    text = swap(swap(swap("payload", warc._DROP, "' '"), warc._BREAK, "chr(10)"), warc._TAG, "''")
    for name, char in warc._ENTITIES:
        text = f"replace({text}, {quoted(name)}, {quoted(char)})"
    text = "trim(" + swap(swap(text, r"[ \t\r\f\x0b]{2,}|[\t\r\f\x0b]", "' '"), r" ?\n[ \n]*", "chr(10)") + ", ' ' || chr(10))"
    block = " || ".join([
        field("conversion-id", "conversion_id"), field("source-status", "'200 OK'"),
        f"'source-Content-Type: text/html; charset=utf-8' || {crlf}", field("source-payload-digest", "source_digest"),
        field("source-length", "cast(strlen(payload) as varchar)"), field("title", "title"), field("language", "lang"),
        f"coalesce(array_to_string(list_transform(links, lambda x: 'outlink: ' || {line('x')} || {crlf}), ''), '')"])
    return f"""
        with r as (select page_id, coalesce(url, '') target_uri, coalesce(html, '') payload from pages),
        s as (select *, {uuid("'response'", "coalesce(cast(page_id as varchar), '')", "target_uri", "md5(payload)")} refers_to,
                {sha('payload')} source_digest, {line(f"regexp_extract(payload, {quoted(warc._TITLE)}, 1)")} title,
                {line(f"regexp_extract(payload, {quoted(warc._LANG)}, 1)")} lang,
                regexp_extract_all(payload, {quoted(warc._LINK)}, 1) links from r),
        c as (select *, {uuid("'conversion'", "refers_to", "source_digest")} conversion_id,
                {uuid("'metadata'", "refers_to", "source_digest")} metadata_id from s),
        b as (select page_id, 'metadata' record_type, metadata_id record_id, refers_to, target_uri, 'application/warc-fields' content_type,
                source_digest, {block} as block from c
              union all select page_id, 'conversion', conversion_id, refers_to, target_uri, 'text/plain; charset=utf-8', source_digest,
                {text} from c)
        select page_id, record_type, record_id, refers_to, target_uri, '{warc.CRAWL_DATE}' as date, content_type, source_digest,
               {sha('block')} block_digest, strlen(block) content_length, block from b"""


def _lower(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_PHRASES_SQL = f"""
    WITH p AS (SELECT lang, list_filter(string_split_regex(x, '[ \t]+'), lambda w: w <> '') AS ws
               FROM (SELECT coalesce(lang, 'und') AS lang,
                            unnest(string_split_regex({_lower("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS x FROM documents)),
    o AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
          FROM p, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k),
    f AS (SELECT lang, phrase, k, count(*) AS f FROM o GROUP BY ALL HAVING count(*) >= 30),
    t AS (SELECT lang, sum(len(ws)) AS n FROM p GROUP BY lang),
    w AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
    c AS (SELECT lang, phrase, k, f AS a, ws, unnest(range(1, k)) AS cut FROM w),
    s AS (SELECT c.lang, c.phrase, c.a, cut, l.f AS l, r.f AS r, CAST(2000000 AS HUGEINT) * c.a // (l.f + r.f) AS score
          FROM c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(ws[1:cut], ' ')
                 JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(ws[cut + 1:c.k], ' ')),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
    i AS (SELECT w.lang, w.f, array_to_string(ws[j:j + m - 1], ' ') AS phrase
          FROM w, (SELECT unnest([2, 3]) AS m), (SELECT unnest([1, 2, 3]) AS j) WHERE m < k AND j + m - 1 <= k),
    d AS (SELECT DISTINCT i.lang, i.phrase FROM i JOIN b ON b.lang = i.lang AND b.phrase = i.phrase
          WHERE CAST(100 AS HUGEINT) * i.f >= CAST(80 AS HUGEINT) * b.a)
    SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
    FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
          FROM b ANTI JOIN d ON d.lang = b.lang AND d.phrase = b.phrase) JOIN t USING (lang) WHERE rank <= 2000"""

_AUDIT_SQL = f"""
    WITH x AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                      regexp_extract_all({_lower("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
    u AS (SELECT doc, lang, source, unnest(ts) AS term FROM x),
    k AS (SELECT lang, term, count(*) AS q_n FROM u GROUP BY lang, term HAVING count(DISTINCT doc) >= 30),
    v AS (SELECT lang, count(*) AS v, sum(q_n) AS q_total FROM k GROUP BY lang),
    g AS (SELECT DISTINCT lang, source FROM x),
    c AS (SELECT lang, source, term, count(*) AS n FROM u SEMI JOIN k USING (lang, term) GROUP BY ALL),
    dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, q_n, v, q_total,
                     sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
              FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    p AS (SELECT *, 1 + CAST(1000000000 AS HUGEINT) * (n + 5) // (total + 5 * v) AS p,
                 1 + CAST(1000000000 AS HUGEINT) * (q_n + 5) // (q_total + 5 * v) AS q FROM dense),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
                     coalesce((SELECT sum(abs(s.p - t.p)) FROM p s JOIN p t ON s.term = t.term AND s.lang = t.lang
                               WHERE s.lang = a.lang AND s.source = a.source AND t.source = b.source), 0) AS value
              FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
    terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
          FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)) WHERE part = 'pair' OR rank <= 50"""

LLM_ORACLES: dict[str, str] = {
    "op12_phrase_mining": _PHRASES_SQL,
    "op13_source_audit": _AUDIT_SQL,
    "op1_warc_derivatives": _warc_sql(),
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op7_bit_sliced_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
              FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
}
