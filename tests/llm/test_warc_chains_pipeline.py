import base64
import glob
import hashlib
import random
import time

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from promptforge.llm import substring_chain, warc
from promptforge.session import ensure_checkpoint_dir, scratch_dir
from tests.llm.helpers import AWKWARD, DOC, docs, rows_of

PAGES = [
    (1, "http://a/x", '<html lang="en"><head><title>A &amp; b</title><style>p{}</style></head><body><!-- no --><p>One<b>two</b>'
                      '<p>three &lt;x&gt;<br>four<script>if (a<b) {"</p>"}</script> five <a href="/l1">l</a><A HREF=\'/l2\'>m</A></body>'),
    (2, None, None), (3, "http://c", ""), (4, "http://d", "plain  text\r\n\r\n<p>é 日"), (5, "http://e", "<script>never closed"),
    (5, "http://e", "<script>never closed"), (6, "http://f", "a < b and <b"), (None, "http://g", "<p>x</p>"), (7, "http://h", "w " * 50_000)]


def pages(spark):
    return spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id long, url string, html string, block string")


def test_warc_records(spark):
    got = warc.derive(warc.responses_of_pages(pages(spark))).collect()
    assert len(got) == 2 * len(PAGES)
    by = {(r.page_id, r.record_type): r for r in got}
    text = by[1, "conversion"].block
    assert text == "A & b\nOnetwo\nthree <x>\nfour five lm"
    fields = by[1, "metadata"].block.split("\r\n")
    assert f"conversion-id: {by[1, 'conversion'].record_id}" in fields
    assert "source-status: 200 OK" in fields and "source-Content-Type: text/html; charset=utf-8" in fields
    assert {"title: A &amp; b", "language: en", "outlink: /l1", "outlink: /l2"} <= set(fields)
    assert by[4, "conversion"].block == "plain text\né 日"
    assert by[5, "conversion"].block == "" and by[2, "conversion"].block == ""
    assert by[6, "conversion"].block == "a < b and <b"
    digest = lambda s: "sha1:" + base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    for r in got:
        html = next(h for i, _, h in PAGES if i == r.page_id) or ""
        assert r.source_digest == digest(html) and r.block_digest == digest(r.block)
        assert r.content_length == len(r.block.encode())
    refers = {r.refers_to for r in got}
    assert len(refers) == len(set(PAGES))  # a repeated page is one response
    assert len({r.record_id for r in got}) == 2 * len(refers)
    assert rows_of(warc.derive(warc.responses_of_pages(pages(spark)))) == sorted(map(tuple, got), key=repr)


def test_warc_files_round_trip(spark):
    records = warc.derive(warc.responses_of_pages(pages(spark)))
    path = scratch_dir(spark, "warc")
    warc.write(records, path)
    back = warc.read(spark, path).collect()
    assert sorted((r.headers["warc-record-id"], r.headers["warc-refers-to"], r.headers["warc-type"], r.block) for r in back) == \
        sorted((r.record_id, r.refers_to, r.record_type, r.block) for r in records.collect())
    raw = spark.read.text(path, wholetext=True).collect()
    assert all(r.value.startswith("WARC/1.1\r\n") and r.value.endswith("\r\n\r\n") for r in raw if r.value)


def test_warc_empty(spark):
    assert warc.derive(warc.responses_of_pages(pages(spark).limit(0))).count() == 0


# --------------------------------------------------------------------- chains
def words(rnd, n):
    return ["".join(rnd.choice("bcdfglmnrst") + rnd.choice("aeiou") for _ in range(rnd.randrange(1, 4))) for _ in range(n)]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance_brute_force():
    rnd = random.Random(1)
    for _ in range(300):
        a = [rnd.randrange(4) for _ in range(rnd.randrange(90))]
        b = [rnd.randrange(4) for _ in range(rnd.randrange(90))] if rnd.random() < 0.5 else [x for x in a if rnd.random() < 0.9]
        assert substring_chain.edit_distance(a, b) == levenshtein(a, b)


def test_chains_are_best_by_brute_force():
    rnd = random.Random(2)
    for _ in range(200):
        points = sorted({(rnd.randrange(30), rnd.randrange(30)) for _ in range(rnd.randrange(1, 12))})
        score = []
        for x, y in points:
            before = [s - 0.1 * (x - u + y - v) for s, (u, v) in zip(score, points) if u < x and v < y]
            score.append(1 + max([0.0, *before]))
        found = substring_chain.chains(points, cost=0.1, max_gap=99, max_shift=99)
        assert sorted(p for c in found for p in c) == points
        assert all(a < b for c in found for (a, _), (b, _) in zip(c, c[1:])) and all(a < b for c in found for (_, a), (_, b) in zip(c, c[1:]))
        total = 0.0
        for i, p in enumerate(found[0]):
            total = 1 + (total - 0.1 * (p[0] - found[0][i - 1][0] + p[1] - found[0][i - 1][1]) if i else 0.0)
        assert abs(total - max(score)) < 1e-9


def planted(seed=4):
    """Documents of random words; some share passages, exact or with edits."""
    rnd = random.Random(seed)
    out, want = [], set()
    base = [words(rnd, rnd.randrange(80, 300)) for _ in range(120)]
    free = rnd.sample(range(120), 120)  # one passage a document, so none cuts another
    for p in range(12):
        passage = words(rnd, rnd.randrange(55, 120))
        holders = [free.pop() for _ in range(rnd.randrange(2, 6))]
        for n, d in enumerate(holders):
            mine = list(passage)
            if n and p % 2:  # fuzzy: one word in fifteen replaced, dropped or doubled
                for at in range(7, len(mine) - 7, 15):
                    mine[at:at + 1] = rnd.choice([["changed"], [], [mine[at], mine[at]]])
            cut = rnd.randrange(len(base[d]))
            base[d][cut:cut] = mine
            want.add(d)
    short = words(rnd, 30)  # a common run under the length
    for d in range(0, 120, 3):
        base[d] += short
    for d, w in enumerate(base):
        out.append((d, " ".join(w)))
    return out, want


def test_planted_passages_are_found_and_no_others(spark):
    rows, want = planted()
    got = substring_chain.repeated_passages(docs(spark, rows)).collect()
    assert {r.doc_id for r in got} | {r.other_id for r in got} == want
    text = dict(rows)
    for r in got:
        a, b = text[r.doc_id].lower().split()[r.start_word:r.end_word], text[r.other_id].lower().split()[r.other_start:r.other_end]
        assert min(len(a), len(b)) >= 50 and r.words == len(a) and r.other_id < r.doc_id
        assert abs(r.similarity - (1 - levenshtein(a, b) / max(len(a), len(b)))) < 1e-9 and r.similarity >= 0.8


def test_passages_awkward_rows(spark):
    rnd = random.Random(9)
    long = " ".join(words(rnd, 70))
    rows = AWKWARD + [(20, long), (20, long), (21, long.upper()), (22, "x " + long), (22, "other " + long), (None, long), (23, long + " " + long)]
    table = docs(spark, rows)
    got = substring_chain.repeated_passages(table).collect()
    assert {r.doc_id for r in got} | {r.other_id for r in got} == {20, 21, 22, 23}
    assert len(got) == len(set(got))
    assert substring_chain.repeated_passages(spark.createDataFrame([], DOC)).count() == 0


def test_seeds_of_a_shared_run():
    import pyarrow as pa
    rnd = random.Random(3)
    run = words(rnd, 14)  # window + k - 1
    texts = [" ".join(words(rnd, 60) + run + words(rnd, 60)) for _ in range(2)]
    row, at, key = substring_chain.seeds_of(pa.array(texts), 5, 10, 50)
    inside = [{int(k) for r, a, k in zip(row, at, key) if r == n and 60 <= a <= 69} for n in range(2)]
    assert inside[0] & inside[1]
    assert np.all(np.diff(np.flatnonzero(row == 0)) == 1)


# ------------------------------------------------------------------- pipeline
def test_pipeline_stages_by_brute_force(spark, tmp_path):
    from tests.llm.test_exact_simhash import brute_components
    from tests.llm.test_text_operators import lang_rows
    rows = lang_rows(60)
    rows += [(200 + i, r[1], r[2], "b") for i, r in enumerate(rows[:10])] + [(300, "12 34", "en", "a"), (301, None, "en", "b")]
    path = f"{tmp_path}/documents.parquet"
    table = docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    table.write.parquet(path)
    now = spark.read.parquet(path)
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        out = spark.createDataFrame(stage(spark, now, str(tmp_path)).collect(), stage(spark, now, str(tmp_path)).schema)
        kept.append(out.collect())
        now = out
    known, exact, near, mixed, pieces = kept
    assert sorted(r.doc_id for r in known) == sorted(r[0] for r in rows if r[0] < 300)
    first = {}
    for r in known:
        first[r.text] = min(first.get(r.text, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in exact) == sorted(first.values())
    assert sorted(r.doc_id for r in near) == sorted({c for _, _, c in brute_components([(r.doc_id, r.text) for r in exact], 3, 3)})
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in near}
    size = lambda rows: sum(len(r.text.split()) for r in rows)
    assert abs(size(mixed) - 1.5 * size(near)) <= 0.1 * size(near)
    assert sorted((r.doc_id, r.text) for r in pieces) == sorted((r.doc_id, r.text) for r in mixed)
    assert all(len(r.ids) == r.n_pieces > 0 for r in pieces)
    assert corpus_pipeline.ORACLE_SQL is None
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r.doc_id for r in final.collect()) == sorted(r.doc_id for r in pieces)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_awkward_rows(spark, tmp_path):
    docs(spark, AWKWARD).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert "ids" in out.columns and out.where(F.col("text").isNull()).count() == 0


def edited(rnd, run, share):
    """About ``share`` of the words replaced, dropped or joined by another, at random places."""
    out = []
    for w in run:
        kind = rnd.randrange(3) if rnd.random() < share else None
        out += [w] if kind is None else [] if kind == 1 else ["n" + w] if kind == 0 else [w, "n" + w]
    return out


def test_fuzzy_passages_at_random_edits_by_brute_force(spark):
    rnd = random.Random(11)
    rows, pairs = [], []
    for share in (0.05, 0.1, 0.15, 0.2):
        for _ in range(60):
            run = words(rnd, rnd.choice([60, 80, 120]))
            other = edited(rnd, run, share)
            if min(len(run), len(other)) < 50 or 1 - levenshtein(run, other) / max(len(run), len(other)) < 0.8:
                continue
            d = len(rows)
            pairs.append((share, d + 1, d))
            rows += [(d + i, " ".join(words(rnd, 80) + r + words(rnd, 80))) for i, r in enumerate((run, other))]
    got = {(r.doc_id, r.other_id) for r in substring_chain.repeated_passages(docs(spark, rows)).collect()}
    assert got <= {(a, b) for _, a, b in pairs}
    for share, least in ((0.05, 0.95), (0.1, 0.95), (0.15, 0.95), (0.2, 0.95)):
        asked = [(a, b) in got for s, a, b in pairs if s == share]
        assert len(asked) > 10 and sum(asked) / len(asked) >= least, share


def test_passages_whose_seeds_stand_first_in_fragments(spark):
    rnd = random.Random(12)
    rows = []
    for case in range(20):
        run, d = words(rnd, 80), 4 * case
        around = [words(rnd, 60) for _ in range(8)]
        parts = [run[:40], run[40:], run, run]
        rows += [(d + i, " ".join(around[2 * i] + p + around[2 * i + 1])) for i, p in enumerate(parts)]
    got = {(r.doc_id, r.other_id): r for r in substring_chain.repeated_passages(docs(spark, rows)).collect()}
    for case in range(20):
        r = got[4 * case + 3, 4 * case + 2]
        assert r.words >= 80 and r.similarity > 0.9


def test_extension_passes_added_and_dropped_words():
    run = list(range(60))
    other = run[:22] + run[23:40] + [900] + run[40:]  # the seeds lie between both
    got = substring_chain.passages(run, other, [(23, 22), (35, 34)])
    assert [(x0, x1, y0, y1) for x0, x1, y0, y1, _ in got] == [(0, 60, 0, 60)]


def test_fuzzy_passages_whose_seeds_stand_first_in_fragments(spark):
    """Two holders share a passage with edits; every seed's first holder has a fragment of 20 words only."""
    rnd = random.Random(13)
    rows, pairs = [], []
    for _ in range(30):
        run, d = words(rnd, 80), len(rows)
        parts = [run[i:i + 20] for i in range(0, 80, 20)] + [run[i:i + 20] for i in range(10, 70, 20)] + [run, edited(rnd, run, 0.1)]
        rows += [(d + i, " ".join(words(rnd, 60) + p + words(rnd, 60))) for i, p in enumerate(parts)]
        if 1 - levenshtein(parts[-2], parts[-1]) / max(len(parts[-2]), len(parts[-1])) >= 0.8:
            pairs.append((d + 8, d + 7))
    got = {(r.doc_id, r.other_id) for r in substring_chain.repeated_passages(docs(spark, rows)).collect()}
    assert got <= set(pairs) and len(pairs) > 25 and len(got) >= 0.95 * len(pairs)


def test_fuzzy_passages_of_common_lines(spark):
    """Lines of 20 words in 70 older documents each; later ones hold three of them, other words between."""
    rnd = random.Random(14)
    lines = [words(rnd, 20) for _ in range(3)]
    rows = [(i, " ".join(words(rnd, 40) + lines[i % 3] + words(rnd, 40))) for i in range(210)]
    for d in range(300, 304):
        run = lines[0] + words(rnd, 1) + lines[1] + words(rnd, 2) + lines[2]
        rows.append((d, " ".join(words(rnd, 40) + run + words(rnd, 40))))
    got = {(r.doc_id, r.other_id) for r in substring_chain.repeated_passages(docs(spark, rows)).collect()}
    assert got == {(a, b) for a in range(300, 304) for b in range(300, a)}


def test_runs_of_the_least_length_with_several_anchors(spark):
    rnd = random.Random(15)
    run = words(rnd, 50)
    parts = [run[:28], run[24:], run, run]
    rows = [(i, " ".join(words(rnd, 60) + p + words(rnd, 60))) for i, p in enumerate(parts)]
    assert {(r.doc_id, r.other_id) for r in substring_chain.repeated_passages(docs(spark, rows)).collect()} == {(3, 2)}


def test_chains_leave_no_shuffle_files_and_only_the_tables_their_result_reads(spark):
    top = ensure_checkpoint_dir(spark).removeprefix("file:") + "/promptforge"
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f.rsplit("/", 1)[1] for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    tables, files = set(glob.glob(f"{top}/chain-*")), shuffles()
    rows, want = planted(seed=5)
    result = substring_chain.repeated_passages(docs(spark, rows))
    new = sorted(p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in set(glob.glob(f"{top}/chain-*")) - tables)
    assert new == ["chain-links", "chain-rest"]
    until = time.time() + 20  # Spark removes them beside the next job
    while shuffles() - files and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - files
    for _ in range(2):
        got = result.collect()
        assert {r.doc_id for r in got} | {r.other_id for r in got} == want
