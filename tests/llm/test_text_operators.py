import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from promptforge.llm import binary_records, byte_bpe, edit_tokens, language_id, sentencepiece_trie
from promptforge.session import scratch_dir
from tests.llm.helpers import AWKWARD, DOC, docs, rows_of

BPE = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


# ---------------------------------------------------------------- language ID
SAMPLES = {
    "en": "the cat and the dog are in the house with that other thing which they have",
    "fr": "le chat et le chien sont dans la maison avec cette autre chose que nous avons",
    "de": "die katze und der hund sind in dem haus mit dieser anderen sache die wir haben",
}


def lang_rows(n=160):
    rnd = random.Random(3)
    out = []
    for i in range(n):
        lang = sorted(SAMPLES)[i % 3]
        words = SAMPLES[lang].split()
        out.append((i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(3, 40))).capitalize() + ".", lang, "a"))
    return out


def test_language_id_held_out_accuracy_and_awkward_rows(spark):
    rows = lang_rows() + [(1000 + (r[0] or 0), *r[1:2], None, None) for r in AWKWARD]
    got = {r.doc_id: r for r in language_id.identify(docs(spark, rows)).collect()}
    truth = {r[0]: r for r in rows}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        text = truth[i][1]
        if text is None or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in SAMPLES and 0 < r.score <= 1
    held = [r for r in got.values() if r.held_out and r.doc_id < 1000]
    assert len(held) > 20 and sum(r.lang_pred == truth[r.doc_id][2] for r in held) >= 0.97 * len(held)


def test_language_id_learns_from_training_rows_alone(spark):
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    # held-out rows carry wrong labels and null ids carry a label of their own: neither may be learnt
    rows = [(i, t, "xx" if held(i) else lang, s) for i, t, lang, s in lang_rows()] + [(None, "the cat", "yy", "a")]
    assert {r.lang_pred for r in language_id.identify(docs(spark, rows)).collect()} == set(SAMPLES)


def brute_model(pairs, longest, quota):
    """Counts of words (g = 0) and n-grams by language, and the keys of the model."""
    counts = {}
    for lang, text in pairs:
        for word in regex.findall(r"\p{L}+", text.lower()):
            marked = f" {word} "
            for g, key in [(0, word)] + [(g, marked[i:i + g]) for g in range(1, longest + 1) for i in range(len(marked) - g + 1)]:
                counts.setdefault((lang, g), Counter())[key] += 1
    keys = [set() for _ in range(longest + 1)]
    for (lang, g), c in counts.items():
        keys[g] |= {k for k, _ in sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[:quota]}
    return counts, keys


@pytest.mark.parametrize("entries", [400_000, 90])
def test_language_model_against_plain_counts(spark, entries):
    rnd = random.Random(9)
    made = lambda: "".join(rnd.choice("abcdé xyz ñ1.") for _ in range(rnd.randrange(200)))
    pairs = [(rnd.choice(["a", "b", "c"]), made()) for _ in range(60)]
    sample = spark.createDataFrame(pairs, "lang string, text string")
    model = language_id.fit(sample, longest=3, max_entries=entries)
    counts, keys = brute_model(pairs, 3, max(1, entries // (3 * 4)))
    assert model.langs == ["a", "b", "c"]
    assert [set(k) for k in [model.words, *model.grams]] == keys
    for g, known in enumerate([model.words, *model.grams]):
        for key, row in known.items():
            for i, lang in enumerate(model.langs):
                c = counts[lang, g]
                assert math.isclose(model.table[row, i], math.log((c[key] or 0.5) / sum(c.values())), rel_tol=1e-12)


def test_training_sample_takes_the_first_hashes_of_each_language(spark):
    table = docs(spark, [(i, f"t{i}", "en" if i % 3 else "de", "a") for i in range(2000)] + [(5000, "x", "fr", "a")])
    got = language_id.training_sample(table, docs_per_lang=50)
    every = table.select("lang", "text", F.xxhash64("doc_id", F.lit(11)).alias("h")).collect()
    want = {lang: {r.text for r in sorted((r for r in every if r.lang == lang), key=lambda r: r.h)[:50]} for lang in ("en", "de", "fr")}
    found = {}
    for r in got.collect():
        found.setdefault(r.lang, set()).add(r.text)
    assert found == want


def test_language_filter_with_clashing_names(spark):
    table = docs(spark, lang_rows(30)).withColumnsRenamed({"fp": "_lang_pred", "size": "_lang_score", "kept": "_text"})
    kept = language_id.keep_identified(table)
    assert kept.columns == table.columns and kept.count() == 30 and {r._lang_pred for r in kept.collect()} == {"x"}


def test_language_id_backs_off_to_shorter_ngrams():
    table = np.log(np.array([[0.9, 0.1], [0.2, 0.8], [0.6, 0.4], [0.3, 0.7]]))
    model = language_id.Model(["a", "b"], {"word": 0}, [{"x": 1}, {"wo": 2, "rd": 3}], table)
    assert np.allclose(model.word("word"), table[0])
    assert np.allclose(model.word("words"), table[[2, 3]].mean(axis=0))  # two known 2-grams
    assert np.allclose(model.word("xyz"), table[1])
    assert model.word("é") is None
    small, large = language_id.Scorer(model), language_id.Scorer(model)
    small.room = 2
    texts = ["word words xyz xyz", "12 !", "é", None, "xyz " * 5 + "word " * 3]
    assert [small(t) for t in texts * 2] == [large(t) for t in texts * 2]
    assert small("é") == ("a", 0.5) and small("12 !") == ("und", 0.0)


def test_language_id_without_training_rows(spark):
    got = language_id.identify(docs(spark, [(1, "some text", None, "a"), (2, None, "en", "a")])).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)] * 2
    assert language_id.identify(spark.createDataFrame([], DOC)).count() == 0


def test_language_filter_keeps_columns(spark):
    table = docs(spark, lang_rows() + [(1000, "1 2 3", "en", "a"), (1001, None, "en", "a")])
    kept = language_id.keep_identified(table)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(160))


# ------------------------------------------------------------ binary records
def crc32c_slow(data):
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_crc32c():
    assert int(binary_records.crc32c([b"123456789"])[0]) == 0xE3069283  # published check value
    rnd = random.Random(1)
    parts = [rnd.randbytes(n) for n in (0, 1, 2, 7, 8, 100, 4095, 4096, 4097, 8193, 10_001)]
    assert [int(c) for c in binary_records.crc32c(parts)] == [crc32c_slow(p) for p in parts]
    assert int(binary_records.masked(np.array([0], np.uint32))[0]) == 0xA282EAD8


def encoder():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(BPE)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_piecewise_encoding_equals_whole_encoding():
    rnd = random.Random(2)
    texts = ["", " ", "  ", "a  b", " a", "a ", "a \n b", "a \nb", "a\n b", "a   b", "\x1c x", "<|endoftext|> x"]
    texts += ["".join(rnd.choice("ab  \n\t 　'sé1!") for _ in range(rnd.randrange(30))) for _ in range(3000)]
    whole = encoder()
    ids, n = byte_bpe.BatchEncoder(BPE, room=50)(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [whole(t) for t in texts]


def test_records_round_trip(spark):
    rows = AWKWARD + [(100 + i, f"text {i} " * (i % 50)) for i in range(300)]
    path, whole = scratch_dir(spark, "records"), encoder()
    binary_records.write(docs(spark, rows), path, BPE)
    got = binary_records.read(spark, path).collect()
    assert len(got) == len(rows)
    got.sort(key=lambda r: r.start)
    start = 0
    for r in got:
        assert r.start == start and r.n_tokens * 4 == len(r.ids)
        start += r.n_tokens
    order = [r.doc_id for r in got]
    assert order == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    want = sorted(((i, [*whole(t), 2]) for i, t, *_ in rows), key=repr)
    assert sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got), key=repr) == want
    crcs = {(r.doc_id, r.n_tokens, r.ids_crc32) for r in binary_records.crc_of_ids(binary_records.read(spark, path)).collect()}
    assert crcs == {(i, len(x), binary_records.zlib_crc32(x)) for i, x in want}
    # random access through the offset index
    shards = spark.read.schema(binary_records.MANIFEST).parquet(f"{path}/_manifest").orderBy("shard").collect()
    assert sum(s.records for s in shards) == len(rows)
    at = 0
    for s in shards:
        n = s.records - 1
        doc_id, ids = binary_records.fetch(path, s.file, n)
        assert (doc_id, ids.astype("<u4").tobytes()) == (got[at + n].doc_id, got[at + n].ids)
        at += s.records


def test_broken_records_are_noticed(spark):
    path = scratch_dir(spark, "records")
    binary_records.write(docs(spark, [(1, "some text"), (2, "more")]).coalesce(1), path, BPE)
    shard = spark.read.parquet(f"{path}/_manifest").first()
    fs, base = binary_records._open(path)
    with fs.open_input_file(f"{base}/{shard.file}.bin") as f:
        data = bytearray(f.read())
    data[25] ^= 1
    with fs.open_output_stream(f"{base}/{shard.file}.bin") as f:
        f.write(bytes(data))
    with pytest.raises(Exception, match="checksum"):
        binary_records.read(spark, path).collect()


def test_empty_table_gives_no_shard(spark):
    path = scratch_dir(spark, "records")
    binary_records.write(spark.createDataFrame([], DOC), path, BPE)
    assert binary_records.read(spark, path).count() == 0


def test_wide_ids(spark):
    path = scratch_dir(spark, "records")
    binary_records.write(docs(spark, [(1, "a b")]), path, BPE, end_id=70_000)
    assert np.frombuffer(binary_records.read(spark, path).first().ids, "<u4")[-1] == 70_000


# ------------------------------------------------------------- SentencePiece
def odd_texts(n=1500):
    rnd = random.Random(6)
    texts = ["", " ", "  ", "a  b", " a", "a ", "\n\n x\ty  ", "▁▁a ▁b", "日本𠮷 naïve", "<s></s><unk><0x0A>", "a" * 300,
             "\x00x", "    def f(x):\n        return x"]
    return texts + ["".join(rnd.choice("abcdef ghij▁éü日\n\t.,0123THEtheing") for _ in range(rnd.randrange(40))) for _ in range(n)]


def test_pieces_equal_the_librarys():
    from sentencepiece import SentencePieceProcessor
    library, codec = SentencePieceProcessor(model_file=PIECES), sentencepiece_trie.Codec(PIECES, room=100)
    texts = odd_texts()
    got = codec.encode(texts)
    want = library.encode(texts)
    assert [g.tolist() for g in got] == want
    assert [codec.decode(g) for g in got] == [library.decode(w) for w in want]
    assert "".join(w for w in sentencepiece_trie.marked_words("a  b ")) == "▁a▁▁b▁"


def test_unigram_scores_are_largest(tmp_path):
    from sentencepiece import sentencepiece_model_pb2
    with open(PIECES, "rb") as f:
        model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    model.trainer_spec.model_type = 1
    path = tmp_path / "unigram.model"
    path.write_bytes(model.SerializeToString())
    trie = sentencepiece_trie.Trie(sentencepiece_trie.Vocabulary(str(path)))
    v = trie.v

    def best(word):  # plain recursion over all cuts
        if not word:
            return 0.0
        return max((v.scores[v.ids[word[:n]]] if word[:n] in v.ids else v.low) + best(word[n:])
                   for n in range(1, len(word) + 1) if n == 1 or word[:n] in v.ids)

    words = ["▁the", "▁thes", "▁these", "▁th日e", "▁", "▁an", "▁and", "abcabc"]
    for word, ids in trie.encode(words).items():
        parts, at = 0.0, 0
        for i in ids:
            if i in v.byte_of:
                at += 1
            else:
                parts += v.scores[i]
        unknown = sum(1 for c in word if c not in v.ids)
        assert parts + unknown * v.low == pytest.approx(best(word))


def test_encode_decode_tables(spark):
    table = docs(spark, AWKWARD)
    out = sentencepiece_trie.decode(sentencepiece_trie.encode(table, PIECES), PIECES)
    assert out.columns == [*table.columns, "ids", "decoded"]
    for r in out.collect():
        assert r.decoded == (r.text or "").replace("▁", " ")
        assert bool(r.ids) == bool(r.text)
    trip = sentencepiece_trie.round_trip(table, PIECES).collect()
    assert len(trip) == len(AWKWARD) and all(r.same for r in trip)
    both = sentencepiece_trie.encode_and_decode(table, PIECES)
    plain = sorted((r.doc_id is None, r.doc_id or 0, r.decoded, r.ids) for r in out.collect())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text, r.ids) for r in both.collect()) == plain
    assert both.columns == [*table.columns, "ids"]
    again = sentencepiece_trie.encode(sentencepiece_trie.encode(table, PIECES), PIECES)
    assert again.columns == [*table.columns, "ids"]
    empty = spark.createDataFrame([], DOC)
    assert sentencepiece_trie.round_trip(empty, PIECES).count() == 0
    assert sentencepiece_trie.decode(sentencepiece_trie.encode(empty, PIECES), PIECES).count() == 0


# ------------------------------------------------------- edit-aware counting
def test_segment_tree_follows_random_edits():
    counter = edit_tokens.Counter(RANKS, public_tokenizers.PATTERN, room=300)
    rnd = random.Random(5)
    letters = "ab' sretvml d1 \n\té日!."
    for _ in range(700):
        now = "".join(rnd.choice(letters) for _ in range(rnd.randrange(60)))
        tree = edit_tokens.SegmentTree(now, counter)
        for _ in range(rnd.randrange(1, 6)):
            s = rnd.randrange(len(now) + 1)
            e = min(len(now), s + rnd.choice([0, 0, 1, 2, 5, 20]))
            new = "".join(rnd.choice(letters) for _ in range(rnd.choice([0, 1, 2, 8])))
            tree.edit(s, e, new)
            now = now[:s] + new + now[e:]
            assert tree.text() == now and tree.length == len(now)
            assert [p for leaf in tree.leaves for p in leaf] == counter.cut(now)
            assert tree.tokens == len(counter.encode(now))


def test_an_edit_recounts_little():
    counter = edit_tokens.Counter(RANKS, public_tokenizers.PATTERN)
    tree = edit_tokens.SegmentTree("some words and more " * 5000, counter)
    tree.edit(50_000, 50_004, "other things")
    assert tree.recounted < 20


def edited(text, edits):
    text, out, at = text or "", "", 0
    for start, end, new in sorted(edits, key=lambda e: e[0]):
        start = min(max(start, at), len(text))
        end = max(start, min(max(end, at), len(text)))
        out += text[at:start] + new
        at = end
    return out + text[at:]


def test_counts_after_a_cleaning_pass(spark):
    rows = AWKWARD + [(50, "one 1 22 333\nsame line\nsame line\n\nsame line\nlast", "en")]
    counter = edit_tokens.Counter(RANKS, public_tokenizers.PATTERN)
    got = edit_tokens.count_edited(docs(spark, rows), edit_tokens.cleaning_edits, RANKS, public_tokenizers.PATTERN, carry=["lang"])
    want = []
    for i, text, *rest in rows:
        edits = edit_tokens.cleaning_edits({"text": text, "lang": rest[0] if rest else None})
        want.append((i, len(counter.encode(text or "")), len(edits), len(counter.encode(edited(text, edits)))))
    assert rows_of(got.drop("n_recounted")) == sorted(want, key=repr)
    assert edit_tokens.count_edited(spark.createDataFrame([], DOC), edit_tokens.cleaning_edits, RANKS,
                                    public_tokenizers.PATTERN, carry=["lang"]).count() == 0


def test_edits_from_a_column(spark):
    counter = edit_tokens.Counter(RANKS, public_tokenizers.PATTERN)
    cases = [(1, "hello big world", [(6, 10, ""), (0, 5, "bye")]), (2, "abc", None), (3, None, [(0, 0, "new text")]),
             (4, "abcdef", [(1, 4, "X"), (2, 6, "Y"), (-5, 0, "Z"), (99, 200, "!")]), (5, "abc", [(None, None, None), None])]
    df = spark.createDataFrame(cases, "doc_id long, text string, edits array<struct<start:int, end:int, text:string>>")
    got = edit_tokens.count_edited(df.withColumn("n_tokens", F.lit("x")), "edits", RANKS, public_tokenizers.PATTERN).collect()
    for (_, text, edits), r in zip(cases, sorted(got, key=lambda r: r.doc_id)):
        edits = [(s or 0, e or 0, t or "") for s, e, t in (x for x in edits or [] if x)]
        assert r.n_edits == len(edits) and r.n_tokens_after == len(counter.encode(edited(text, edits)))


def test_a_worker_keeps_no_words_between_tasks():
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"text": odd_texts(50)})
    assert sum(b.num_rows for b in sentencepiece_trie._encode(PIECES, "text")(iter([batch]))) == batch.num_rows
    codec = sentencepiece_trie._CODECS[PIECES]
    assert not codec.late and not codec.old


def test_pairs_are_forgotten_beyond_their_bound(monkeypatch):
    from sentencepiece import SentencePieceProcessor
    monkeypatch.setattr(sentencepiece_trie, "_PAIRS", 50)
    codec, texts = sentencepiece_trie.Codec(PIECES), odd_texts(300)
    assert [g.tolist() for g in codec.encode(texts)] == SentencePieceProcessor(model_file=PIECES).encode(texts)
    assert 0 < sum(len(known) for _, known in codec.trie.fits.values()) <= 50


def test_the_table_of_a_long_word_grows_with_its_length():
    import tracemalloc
    codec = sentencepiece_trie.Codec(PIECES)
    codec.encode(["ab" * 50])
    tracemalloc.start()
    codec.encode(["ab" * 10_000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20_000_000
