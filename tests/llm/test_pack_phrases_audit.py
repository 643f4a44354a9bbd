"""Packing, phrase mining and the source audit against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from promptforge.llm import byte_bpe, hat_trie, slack_packing, source_audit
from tests.llm.helpers import AWKWARD, docs, rows_of

BPE = public_tokenizers.path("byte_bpe_50k.json")


def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(BPE)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


# ------------------------------------------------------------------ encoding

def test_batch_encoder_gives_the_librarys_ids():
    rnd, whole = random.Random(4), library()
    parts = ["a", "b", " ", " ", "\n", "  ", "\t", "é", "'s", "don't", "<|endoftext|>", "<|endo", "9", "中", "\x85", "\x1c", "!", ".",
             "’", "\r\n", "hello", " the", "　", "🙂", " ", "é", "\xa0", "(x)", ",", "a.b", "it's."]
    encode = byte_bpe.BatchEncoder(BPE, room=60)  # small, so that words are forgotten
    for _ in range(60):
        texts = [None if rnd.random() < 0.05 else "".join(rnd.choice(parts) for _ in range(rnd.randrange(14))) for _ in range(60)]
        ids, n = encode(pa.array(texts, pa.string()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [whole(t) for t in texts]
    sliced = pa.array(["x y", "hello there", None, "the\nend"]).slice(1, 3)
    assert encode(sliced)[0].tolist() == whole("hello there") + whole("the\nend")
    assert encode(pa.array([], pa.string()))[1].tolist() == []


def test_with_end():
    ids, n = byte_bpe.with_end(np.array([5, 6, 7], np.uint32), np.array([2, 0, 1]), 1)
    assert ids.tolist() == [5, 6, 1, 1, 7, 1] and n.tolist() == [3, 1, 2]


# ------------------------------------------------------------------- packing

def test_closest_fill_is_the_best_sum():
    rnd = random.Random(1)
    for _ in range(400):
        counts = {rnd.randint(1, 15): rnd.randint(0, 4) for _ in range(rnd.randrange(5))}
        room = rnd.randrange(45)
        used = slack_packing.closest_fill(room, sorted(counts, reverse=True), counts)
        assert all(0 < n <= counts[x] for x, n in used.items())
        sums = [sum(x * n for x, n in zip(counts, c)) for c in product(*[range(n + 1) for n in counts.values()])]
        assert sum(x * n for x, n in used.items()) == max(s for s in sums if s <= room)


def packed(rows, window):
    """Checks all promises of a packing; the texts' ids by (doc, ids)."""
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length * 4 == len(r.ids) and 0 < r.length <= window
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id, r.doc_tokens].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == window or at & at - 1 == 0  # no padding
    return by_sequence, by_doc


@pytest.mark.parametrize("window,pool", [(64, 1 << 22), (256, 300), (8, 64)])
def test_packing_keeps_every_id_once(spark, window, pool):
    rnd = random.Random(window)
    rows = [(i, " ".join(rnd.choice("alpha beta the of xyzzy".split()) for _ in range(int(rnd.paretovariate(0.9)) % 400)), "en", "a")
            for i in range(300)]
    whole = library()
    got = slack_packing.pack(docs(spark, rows).repartition(3), BPE, window=window, pool_ids=pool).collect()
    by_sequence, by_doc = packed(got, window)
    for i, text, *_ in rows:
        want = [*whole(text), 1]
        pieces = sorted(by_doc[i, len(want)])
        assert [x for _, ids in pieces for x in ids] == want
        assert [s for s, _ in pieces] == np.cumsum([0] + [len(ids) for _, ids in pieces[:-1]]).tolist()
    tokens = sum(r.length for r in got)
    assert len(by_sequence) <= tokens / window + 3 * (window.bit_length() + 1)


def test_packing_of_awkward_rows_and_sequences(spark):
    table = docs(spark, AWKWARD)
    pieces = slack_packing.pack(table, BPE, window=512).cache()
    _, by_doc = packed(pieces.collect(), 512)
    whole = library()
    want = Counter()
    for i, text, *_ in AWKWARD:
        want[i, tuple([*whole(text), 1])] += 1
    ids = Counter()  # rows of one id and length are told apart by their ids only: compare all ids of each
    for (i, n), found in by_doc.items():
        ids[i, n] = sum(len(x) for _, x in found)
    assert ids == Counter({k: v for k, v in ((key, sum(len(w) * c for (d, w), c in want.items() if (d, len(w)) == key))
                                             for key in {(d, len(w)) for d, w in want})})
    seqs = slack_packing.sequences(pieces)
    assert seqs.where(F.octet_length("ids") != F.col("n_tokens") * 4).count() == 0
    assert seqs.agg(F.sum(slack_packing.padding(F.col("n_tokens"), 512))).first()[0] == 0
    assert slack_packing.pack(docs(spark, []), BPE).count() == 0
    with pytest.raises(ValueError):
        slack_packing.pack(table, BPE, window=1000)


def test_packing_without_exact_fills(spark):
    rows = [(i, "a " * 20 + "a", "en", "a") for i in range(200)]  # all of one length
    got = slack_packing.pack(docs(spark, rows).coalesce(1), BPE, window=64).collect()
    _, by_doc = packed(got, 64)
    assert all(sum(len(x) for _, x in found) == n for (_, n), found in by_doc.items())
    crc = {zlib.crc32(r.ids) for r in got if r.start == 0 and r.length == r.doc_tokens}
    assert len(crc) == 1


# ------------------------------------------------------------------- phrases

def brute_phrases(rows, least, share=80, top=2000, scale=2_000_000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i:i + k])] += 1
    out = []
    for lang, counts in f.items():
        kept = {p: c for p, c in counts.items() if c >= least}
        scored, longer = [], Counter()
        for q, c in kept.items():
            for k in range(2, len(q)):
                for i in range(len(q) - k + 1):
                    longer[q[i:i + k]] = max(longer[q[i:i + k]], c)
        for p, a in kept.items():
            if len(p) < 2 or longer[p] and 100 * longer[p] >= share * a:
                continue
            cuts = [(scale * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out, key=repr)


def phrase_rows(seed, n=250):
    rnd = random.Random(seed)
    words = ["new", "york", "of", "the", "é", "São", "x", "City", "in", "a-b", "日本", "\x00"]
    glue = [" "] * 8 + [", ", ".", "\n", "\t ", "  ", "\x0b", ":"]
    made = lambda: "".join(rnd.choice(words[:rnd.randint(2, len(words))]) + rnd.choice(glue) for _ in range(rnd.randrange(60)))
    rows = [(i, made(), rnd.choice(["en", "de", None, "und"]), "a") for i in range(n)]
    return rows + [(i, "New York City in the x", "en", "a") for i in range(40)]


@pytest.mark.parametrize("room,bits", [(700_000, 1 << 26), (50, 1 << 10)])
def test_phrases_against_brute_force(spark, room, bits):
    rows = phrase_rows(3)
    got = hat_trie.collocations(docs(spark, rows).repartition(4), least=5, room=room, bloom_bits=bits)
    assert rows_of(got) == brute_phrases(rows, 5)


def test_phrase_limits_ties_and_awkward_rows(spark):
    rows = phrase_rows(5, 120)
    assert rows_of(hat_trie.collocations(docs(spark, rows), least=3, top=7, share=50)) == brute_phrases(rows, 3, 50, 7)
    awkward = AWKWARD * 3
    assert rows_of(hat_trie.collocations(docs(spark, awkward), least=3)) == brute_phrases(awkward, 3)
    assert hat_trie.collocations(docs(spark, [])).count() == 0
    assert hat_trie.collocations(docs(spark, [(1, None), (2, "")])).count() == 0


def test_hat_trie_bursts_and_spills_whole_subtrees():
    rnd = np.random.default_rng(1)
    trie, want = hat_trie.HatTrie(burst=8), Counter()
    for _ in range(20):
        keys = sorted({(int(a), int(b) << 42 | int(c) << 21) for a, b, c in rnd.integers(0, 6, (30, 3))})
        n = rnd.integers(1, 4, len(keys))
        trie.add(np.array([k[0] for k in keys]), np.array([k[1] for k in keys]), n)
        want.update(dict(zip(keys, n.tolist())))
    assert trie.entries == len(want) and any(type(x) is tuple for x in trie.root.values())
    sizes = Counter(w for w, _ in want)
    first, rest, count = trie.spill(len(want) // 2)
    gone = set(first.tolist())
    assert Counter(first.tolist()) == {w: sizes[w] for w in gone} and not gone & set(trie.root)  # whole subtrees
    assert min(sizes[w] for w in gone) >= max((sizes[w] for w in trie.root), default=0)
    left = trie.spill(0)
    got = Counter()
    for f, r, c in zip(*(np.concatenate(x).tolist() for x in zip((first, rest, count), left))):
        got[f, r] += c
    assert got == want and trie.entries == 0


def test_long_text_is_counted_over_chunk_ends(spark, monkeypatch):
    monkeypatch.setattr(hat_trie, "_WORDS", 7)
    rnd = random.Random(8)
    col = pa.array([" ".join(rnd.choice("a b c d".split()) for _ in range(100)), "a b.c d", None], pa.string())
    batch = pa.RecordBatch.from_arrays([pa.array(["x", "x", "y"]), col], names=["lang", "text"])
    runs = list(hat_trie._count(hat_trie._words_and_pairs, 4, 1000, "lang")(iter([batch])))
    got = Counter()
    for b in runs:
        for row in b.to_pylist():
            if row["bucket"] >= 0:
                for phrases, counts in zip(row["phrases"], row["counts"]):
                    for phrase, n in zip(phrases.split("\n"), np.frombuffer(counts, "<i8").tolist()):
                        got[phrase] += n
    words = col[0].as_py().split()
    want = Counter(words) + Counter("abcd") + Counter(map(" ".join, zip(words, words[1:]))) + Counter(["a b", "c d"])
    assert got == want


# --------------------------------------------------------------------- audit

def brute_audit(rows, least, top=50):
    n, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        n[lang, source].update(terms)
        df[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, d in df[lang].items() if d >= least]
        peers = sorted(s for g, s in groups if g == lang)
        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}
        p = shares(n[lang, source])
        pairs = [(sum(abs(p[t] - q[t]) for t in kept), s) for s in peers if s != source for q in [shares(n[lang, s])]]
        q = shares(sum((n[lang, s] for s in peers), Counter()))
        terms = [(p[t] - q[t], t) for t in kept if n[lang, source][t] > 0 and p[t] > q[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                out.append((lang, source, part, item, value, rank))
    return sorted(out, key=repr)


def audit_rows(seed, n=400):
    rnd = random.Random(seed)
    words = ["alpha", "Beta", "internationalisation", "internationalisations", "internationally", "é", "x", "naïve", "日本", "eightlet", "eightletters"]
    made = lambda: rnd.choice(["", "1 ", "-"]).join("") + " ".join(
        rnd.choice(words[:rnd.randint(1, len(words))]) + rnd.choice(["", ".", "1", "_", "'s"]) for _ in range(rnd.randrange(20)))
    rows = [(i, made(), rnd.choice(["en", "de", None, ""]), rnd.choice(["a", "b", "é", None])) for i in range(n)]
    return rows + [(9000, None, "fr", "a"), (9001, "", "fr", "z"), (9002, "solo", "it", "only")]


@pytest.mark.parametrize("least", [1, 3, 30, 10_000])
def test_audit_against_brute_force(spark, least):
    rows = audit_rows(least)
    assert rows_of(source_audit.audit(docs(spark, rows).repartition(3), least=least, top=4)) == brute_audit(rows, least, 4)


def test_audit_of_awkward_rows(spark):
    assert rows_of(source_audit.audit(docs(spark, AWKWARD), least=1)) == brute_audit(AWKWARD, 1)
    assert source_audit.audit(docs(spark, [])).count() == 0
    assert rows_of(source_audit.audit(docs(spark, [(1, None), (2, None)]))) == []


def test_pointer_sort_groups_equal_terms():
    rnd = random.Random(6)
    terms = ["".join(rnd.choice("ab") for _ in range(rnd.choice([1, 7, 8, 9, 15, 16, 17, 40]))) for _ in range(3000)]
    groups = np.array([rnd.randrange(3) for _ in terms])
    buf = np.frombuffer(" ".join(terms).encode() + b"\0" * 8, np.uint8)
    size = np.array([len(t) for t in terms])
    start = np.cumsum(size + 1) - size - 1
    order, runs = source_audit.sort_pointers(buf, start, size, groups)
    assert sorted(order.tolist()) == list(range(len(terms)))
    key = [(int(groups[i]), terms[i]) for i in order]
    heads = [i for i in range(len(key)) if i == 0 or key[i] != key[i - 1]]
    assert heads == runs.tolist() and len(heads) == len(set(key)) and key == sorted(key)
    stable = all(a < b for a, b, x, y in zip(order, order[1:], key, key[1:]) if x == y)
    assert stable


def test_equal_runs_count_documents():
    texts = pa.array(["The cat the CAT", None, "cat-fish thE", "", "fish"], pa.string())
    terms, group, n, docs_ = source_audit.equal_runs(texts, np.array([0, 0, 0, 1, 1]))
    got = {(t, g): (a, b) for t, g, a, b in zip(terms.to_pylist(), group.tolist(), n.tolist(), docs_.tolist())}
    assert got == {("the", 0): (3, 2), ("cat", 0): (3, 2), ("fish", 0): (1, 1), ("fish", 1): (1, 1)}
