import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash

from promptforge.llm import components, exact_dedup, simhash_bk
from promptforge.llm.common import Words, sorted_groups
from promptforge.llm.xxh64 import xxh64
from tests.llm.helpers import AWKWARD, DOC, docs, rows_of


def test_exact_groups_awkward_rows(spark):
    for keep, pick in (("min", min), ("max", max)):
        got = rows_of(exact_dedup.exact_groups(docs(spark, AWKWARD), keep=keep).drop("text_sha256"))
        groups = defaultdict(list)
        for i, text, *_ in AWKWARD:
            groups[text or ""].append(i)
        want = set()
        for ids in groups.values():
            named = [i for i in ids if i is not None]
            best = pick(named) if named else None
            want |= {(i, best, len(ids), i == best) for i in ids}
        assert got == sorted(want, key=repr)


def test_exact_keep_one_keeps_whole_rows(spark):
    table = docs(spark, AWKWARD)
    kept = exact_dedup.keep_one(table)
    assert kept.columns == table.columns
    by_text = defaultdict(set)
    for i, text, *_ in AWKWARD:
        by_text[text or ""].add(i)
    got = kept.collect()
    assert len(got) == len(by_text)
    for r in got:
        ids = [i for i in by_text[r.text or ""] if i is not None]
        assert r.doc_id == (min(ids) if ids else None)
        assert r.fp == "x" and r.n_chars == len(r.text or "")


def test_exact_hash_collisions_are_told_apart(spark, monkeypatch):
    # a hash that maps everything together: the comparison of bytes must still separate texts
    from pyspark.sql import functions as F
    monkeypatch.setattr(F, "md5", lambda c: F.lit("00"))
    got = rows_of(exact_dedup.exact_groups(docs(spark, [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "")])).drop("text_sha256"))
    assert got == [(1, 1, 2, True), (2, 2, 1, True), (3, 1, 2, False), (4, 4, 2, True), (5, 4, 2, False)]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOC)
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.keep_one(empty).count() == 0
    assert simhash_bk.components(empty).count() == 0
    assert simhash_bk.keep_one(empty).count() == 0


def test_word_positions_and_hashes():
    texts = [None, "", "  A b\t\nC ", "one", "x" * 40 + " " + "y" * 9, " ", "é 日本"]
    words = Words(pa.array(texts).slice(1), lower=True)
    for r, text in enumerate(texts[1:]):
        want = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
        at = slice(words.first[r], words.first[r + 1])
        assert [bytes(words.buf[s:e]) for s, e in zip(words.start[at], words.end[at])] == want
    rnd = random.Random(3)
    text = "".join(rnd.choice("ab cé日") for _ in range(2000))
    words = Words(pa.array([text]))
    start = np.array([words.start[rnd.randrange(len(words.start) // 2)] for _ in range(200)])
    end = np.array([s + rnd.randrange(80) for s in start])
    got = xxh64(words, start, end, 42)
    assert [int(h) for h in got] == [xxhash.xxh64_intdigest(bytes(words.buf[s:e]), 42) for s, e in zip(start, end)]


def fingerprint(text, width):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not w:
        return 0
    shingles = [b" ".join(w[i:i + width]) for i in range(max(1, len(w) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, width, radius):
    fps = [fingerprint(t, width) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                label[find(i)] = find(j)
    names = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            names[find(i)].append(doc)
    return sorted([(doc, f"{fps[i]:016x}", min(names[find(i)], default=None)) for i, (doc, _) in enumerate(rows)], key=repr)


def near_copies(seed, n):
    rnd = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "abcdefgh" for b in "klmnop"]
    out = []
    for i in range(n):
        if out and rnd.random() < 0.6:
            words = rnd.choice(out)[1].split()
            for _ in range(rnd.randrange(3)):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        else:
            words = [rnd.choice(vocabulary) for _ in range(rnd.randrange(1, 300))]
        out.append((i, " ".join(words)))
    return out


def test_simhash_components_brute_force(spark):
    rows = near_copies(1, 250) + [r[:2] for r in AWKWARD]
    for width, radius, tree_rows in ((3, 3, 2048), (3, 6, 8), (5, 1, 3)):
        got = rows_of(simhash_bk.components(docs(spark, rows), width=width, radius=radius, tree_rows=tree_rows))
        assert got == brute_components(rows, width, radius)


def test_simhash_keep_one(spark):
    rows = near_copies(2, 120) + [r[:2] for r in AWKWARD]
    table = docs(spark, rows)
    kept = simhash_bk.keep_one(table)
    assert kept.columns == table.columns
    want = {c for _, _, c in brute_components(rows, 3, 3)}
    assert {r.doc_id for r in kept.collect()} == want


def test_bk_tree_finds_all():
    rnd = np.random.default_rng(5)
    base = rnd.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = (np.uint64(1) << rnd.integers(0, 64, (400, 4), dtype=np.uint64))
    points = np.unique(np.bitwise_xor.reduce(flips, axis=1) ^ rnd.choice(base, 400))
    tree = simhash_bk.BKTree(points)
    queries = np.concatenate([points, base])
    for radius in (0, 3, 8):
        q, node = tree.search(queries, radius)
        want = np.argwhere(np.bitwise_count(queries[:, None] ^ points[None, :]) <= radius)
        assert sorted(zip(q.tolist(), node.tolist())) == sorted(map(tuple, want.tolist()))
    assert [len(x) for x in simhash_bk.BKTree(points[:1]).search(points[:1], 0)] == [1, 1]


def test_stars_long_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 200), (301, 300), (300, 301)]
    random.Random(4).shuffle(edges)
    got = dict((r.node, r.root) for r in components.stars(spark.createDataFrame(edges, "a long, b long")).collect())
    want = {i: 0 for i in range(1, 61)} | {100 + i: 100 for i in range(1, 40)} | {301: 300}
    assert got == want


def test_sorted_groups_span_batches():
    keys = [1, 1, 2, None, None, 3, 3, 3, 4]
    table = pa.table({"k": pa.array(keys, pa.int64()), "v": list(range(9))})
    for size in range(1, 10):
        got = [g.column("v").to_pylist() for g in sorted_groups(iter(table.to_batches(max_chunksize=size)), ["k"])]
        assert got == [[0, 1], [2], [3, 4], [5, 6, 7], [8]]


def test_simhash_keeps_a_single_row_of_null_and_repeated_ids(spark):
    same, other = "one two three four five six", "some quite different words stand in this text"
    rows = [(None, same, "en"), (None, same, "de"), (None, same, "de"), (None, same.upper(), "en"),
            (7, other, "en"), (7, other, "de"), (7, other.upper(), "en"), (None, other, "en")]
    kept = simhash_bk.keep_one(docs(spark, rows)).collect()
    assert sorted((r.doc_id for r in kept), key=str) == [7, None]
    assert {r.text.lower() for r in kept} == {same, other}


def test_simhash_keep_one_with_clashing_names(spark):
    rows = [(1, "a b c d e", "en", "a"), (2, "a b c d e", "en", "a"), (2, "a b c d e", "en", "a"), (3, "quite another text here", "en", "a")]
    table = docs(spark, rows).withColumnsRenamed({"fp": "_fp", "size": "_tie", "kept": "t0"})
    kept = simhash_bk.keep_one(table)
    assert kept.columns == table.columns
    assert sorted((r.doc_id, r._fp, r._tie, r.t0) for r in kept.collect()) == [(1, "x", "y", "z"), (3, "x", "y", "z")]
