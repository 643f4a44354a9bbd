"""SentencePiece encoding and decoding by shared-prefix forward search.

A text becomes marked words (the blank mark, then the characters up to the
next mark); no piece of the vocabulary spans a mark that follows another
character, so words encode on their own.  The distinct words of a batch are
sorted into a trie and walked depth-first: the forward table of a prefix (for
each end position the best last piece and its score) is computed once and
shared by all words that begin with it.

The forward step depends on the model's own type:

* unigram: the last piece with the largest total score (Viterbi);
* bpe: merging highest-scored neighbours first gives every prefix exactly one
  last piece.  Piece b may follow piece a if merging the two alone leaves them
  apart; the last piece of a prefix is the one that may follow the last piece
  of what is before it.  The table so holds the same pieces as merging does.

Characters without a piece become their UTF-8 byte pieces.  Words that were
seen before come from a bounded table.  Decoding joins pieces, turns runs of
byte pieces into text (a byte that is no valid UTF-8 gives U+FFFD) and drops
the leading blank.

Defined cases: a null text has no ids and decodes to an empty text; an empty
text has no ids; white space other than the blank is an ordinary character; a
literal blank mark decodes to a blank; a word of any length is encoded whole;
rows that repeat repeat; an empty table gives an empty result; further columns
are carried by ``encode`` and ignored by nothing else.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptforge.llm.common import slices_by_bytes

MARK = "▁"
_PAIRS = 400_000    # pairs of pieces a worker remembers
_UNKNOWN = -10.0  # below the lowest score, for a character without a piece (unigram)


class Vocabulary:
    """Pieces of a .model file, through the public library's accessors."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        with open(path, "rb") as f:
            proto = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        sp = SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.kind = {1: "unigram", 2: "bpe"}.get(proto.trainer_spec.model_type)
        plain = proto.normalizer_spec
        if self.kind is None or plain.precompiled_charsmap or plain.remove_extra_whitespaces or not plain.escape_whitespaces:
            raise ValueError("only unigram and bpe models without a normaliser are supported")
        self.prefix = plain.add_dummy_prefix
        self.size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(self.size)]
        hidden = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(self.size)]
        self.hidden = hidden
        self.ids = {p: i for i, p in enumerate(self.pieces) if not hidden[i]}
        self.scores = [sp.get_score(i) for i in range(self.size)]
        self.score_of = {p: self.scores[i] for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids), default=1)
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece spans a blank mark")
        byte = {self.pieces[i]: i for i in range(self.size) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.bytes = [byte.get(f"<0x{b:02X}>", self.unknown) for b in range(256)]
        self.byte_of = {i: int(p[3:5], 16) for p, i in byte.items()}
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        self.barrier = "" if "\n" in joined else "\n"
        # a byte piece below 128 is a character whatever stands beside it
        self.text = [chr(self.byte_of[i]) if self.byte_of.get(i, 128) < 128 else "" if hidden[i] else p for i, p in enumerate(self.pieces)]
        self.high = np.array([self.byte_of.get(i, 0) >= 128 for i in range(self.size)])
        self.low = min((self.scores[i] for i in self.ids.values()), default=0.0) + _UNKNOWN


def marked_words(text: str, prefix: bool = True, barrier: str = "") -> list[str]:
    """Cut before every mark that follows another character, and around each
    ``barrier`` (a character that no piece joins to others); joined, the words
    are the marked text."""
    text = text.replace(" ", MARK)
    if not text:
        return []
    if prefix:
        text = MARK + text
    if not barrier or barrier not in text:
        return _cut_marks(text)
    out = []
    for n, line in enumerate(text.split(barrier)):
        if n:
            out.append(barrier)
        if line:
            out += _cut_marks(line)
    return out


def _cut_marks(text: str) -> list[str]:
    first, *parts = text.split(MARK)
    out = [first] if first else []
    if "" not in parts:  # no run of marks
        return out + [MARK + p for p in parts]
    run = ""
    for part in parts:
        run += MARK
        if part:
            out.append(run + part)
            run = ""
    return [*out, run] if run else out


class Trie:
    """Encodes sorted words depth-first, sharing the forward table."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        # pieces that merging their own characters gives, met so far: number and, by the number of the piece
        # before it, whether merging leaves the two apart; characters without a piece are numbered behind the vocabulary
        self.fits: dict[str, tuple[int, dict[int, bool]]] = {}
        self.unmet = set(vocabulary.ids)
        self.loose: list[str] = []
        self.pairs = 0
        self.packed = [np.int32(i).astype("<i4").tobytes() for i in range(vocabulary.size)]

    def encode(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """ids of every distinct word."""
        return {w: tuple(np.frombuffer(ids, dtype="<i4").tolist()) for w, ids in self.encode_packed(words).items()}

    def encode_packed(self, words: Iterable[str]) -> dict[str, bytes]:
        """ids of every distinct word, four bytes each."""
        return (self._scored if self.v.kind == "unigram" else self._merged)(words)

    def _scored(self, words: Iterable[str]) -> dict[str, bytes]:
        out, last, table = {}, "", [(0, 0.0)]
        for word in sorted(set(words)):
            del table[_shared(word, last) + 1:]
            for end in range(len(table), len(word) + 1):
                table.append(self._score(word, end, table))
            last = word
            out[word] = self._ids(word, table)
        return out

    def _score(self, word: str, end: int, table: list) -> tuple[int, float]:
        """Best (start of the last piece, total score) of word[:end]."""
        best = None
        ids, scores = self.v.ids, self.v.scores
        for start in range(max(0, end - self.v.longest), end):
            at = ids.get(word[start:end])
            if at is not None:
                total = table[start][1] + scores[at]
            elif start == end - 1:
                total = table[start][1] + self.v.low
            else:
                continue
            if best is None or total > best[1]:
                best = start, total
        return best

    def _merged(self, words: Iterable[str]) -> dict[str, bytes]:
        """The forward table of a prefix holds the number of its last piece and
        where that begins.  Exactly one last piece fits; short ones are tried
        first, as they fit most often."""
        longest, packed, unmet = self.v.longest, self.packed, self.unmet
        fits = self.fits.get
        out, last, pieces, starts = {}, "", [-1], [0]
        for word in sorted(set(words)):
            at = _shared(word, last) + 1
            del pieces[at:], starts[at:]
            for end in range(at, len(word) + 1):
                for start in range(end - 1, max(-1, end - 1 - longest), -1):
                    fit = fits(word[start:end])
                    if fit is None:
                        if start < end - 1 and word[start:end] not in unmet:
                            continue
                        fit = self._prove(word[start:end])
                        if fit is None:
                            continue
                    if not start:
                        break
                    fine = fit[1].get(pieces[start])
                    if fine is None:
                        fine = self._apart(pieces[start], fit)
                    if fine:
                        break
                else:
                    raise ValueError(f"no last piece for {word[:end]!r}")
                pieces.append(fit[0])
                starts.append(start)
            last, end, ids = word, len(word), []
            while end:
                ids.append(packed[pieces[end]])
                end = starts[end]
            ids.reverse()
            out[word] = b"".join(ids)
        return out

    def _prove(self, piece: str) -> tuple[int, dict[int, bool]] | None:
        """What ``fits`` holds of a piece met for the first time; None if merging
        its characters gives other pieces."""
        if piece in self.unmet:
            self.unmet.remove(piece)
            if self._merge(piece) != [piece]:
                return None
            number = self.v.ids[piece]
        else:
            number = self.v.size + len(self.loose)
            self.loose.append(piece)
            self.packed.append(np.array([self.v.bytes[b] for b in piece.encode()], dtype="<i4").tobytes())
        self.fits[piece] = number, {}
        return self.fits[piece]

    def _apart(self, left: int, fit: tuple[int, dict[int, bool]]) -> bool:
        """Does merging leave the two pieces apart?"""
        if self.pairs >= _PAIRS:
            self.pairs = 0
            for _, known in self.fits.values():
                known.clear()
        self.pairs += 1
        pair = [self.v.pieces[i] if i < self.v.size else self.loose[i - self.v.size] for i in (left, fit[0])]
        fit[1][left] = fine = self._merge("".join(pair)) == pair
        return fine

    def _merge(self, text: str) -> list[str]:
        """Merge the best-scored neighbours, leftmost first, until none merge."""
        score, none = self.v.score_of.get, float("-inf")
        parts = list(text)
        joined = [score(a + b, none) for a, b in zip(parts, parts[1:])]
        while joined and (best := max(joined)) > none:
            i = joined.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del joined[i]
            if i:
                joined[i - 1] = score(parts[i - 1] + parts[i], none)
            if i < len(joined):
                joined[i] = score(parts[i] + parts[i + 1], none)
        return parts

    def _ids(self, word: str, table: list) -> bytes:
        out: list[int] = []
        end = len(word)
        while end:
            start = table[end][0]
            at = self.v.ids.get(word[start:end])
            out += [at] if at is not None else [self.v.bytes[b] for b in reversed(word[start:end].encode())]
            end = start
        return np.array(out[::-1], dtype="<i4").tobytes()


def _shared(a: str, b: str) -> int:
    """Characters that two words begin with."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


class Codec:
    """Encodes and decodes texts.  Words that have not been met for ``room``
    other words are forgotten, so at most twice as many are kept (and those of
    one call)."""

    def __init__(self, path: str, room: int = 120_000):
        self.v = Vocabulary(path)
        self.trie, self.room = Trie(self.v), room
        self.late: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        now, new = {}, []
        for w in words:
            ids = self.late.get(w) or self.old.get(w)
            if ids:
                now[w] = ids
            else:
                new.append(w)
        now.update(self.trie.encode_packed(new))
        self.late.update(now)
        if len(self.late) > self.room:
            self.late, self.old = {}, self.late
        return now

    def forget(self) -> None:
        """Give back the table of words."""
        self.late, self.old = {}, {}
        pa.default_memory_pool().release_unused()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        words = [marked_words(t or "", self.v.prefix, self.v.barrier) for t in texts]
        get = self._learn(set().union(*words)).__getitem__
        return [np.frombuffer(b"".join(map(get, ws)), dtype="<i4") for ws in words]

    def decode(self, ids: np.ndarray) -> str:
        v = self.v
        if v.high[ids].any():
            text = self._decode_bytes(ids.tolist())
        else:
            text = "".join(map(v.text.__getitem__, ids.tolist()))
        text = text.replace(MARK, " ")
        return text[1:] if v.prefix and text.startswith(" ") else text

    def _decode_bytes(self, ids: list[int]) -> str:
        """With bytes beyond ASCII: a run of byte pieces is decoded together."""
        v, out, raw = self.v, [], bytearray()
        for i in ids:
            if i in v.byte_of:
                raw.append(v.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", errors="replace"))
                raw.clear()
            out.append(v.text[i])
        return "".join(out) + raw.decode("utf-8", errors="replace")


def _encode(path: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _codec(path) as codec:
            for batch in (part for whole in batches for part in slices_by_bytes(whole, text_col)):
                ids = codec.encode(batch.column(text_col).to_pylist())
                size = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(size), pa.array(flat, pa.int32()))],
                                                 names=[*batch.schema.names, "ids"])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _codec(path) as codec:
            for batch in batches:
                col = batch.column("ids")
                texts = [codec.decode(np.array([], np.int32) if x.as_py() is None else x.values.to_numpy(zero_copy_only=False)) for x in col]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return run


_CODECS: dict[str, Codec] = {}


@contextmanager
def _codec(path: str) -> Iterator[Codec]:
    """One codec per worker process and model.  Its table of words lives as
    long as a task: a worker that goes on to other work holds none."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    try:
        yield _CODECS[path]
    finally:
        _CODECS[path].forget()


def _with(rows: DataFrame, *fields: T.StructField) -> T.StructType:
    return T.StructType([*rows.schema.fields, *fields])


def encode(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array<int>) of ``text_col``; one pass, no shuffle.
    A column named ``ids`` is replaced."""
    rows = docs.drop("ids")
    return rows.mapInArrow(_encode(model, text_col), _with(rows, T.StructField("ids", T.ArrayType(T.IntegerType()))))


def decode(rows: DataFrame, model: str) -> DataFrame:
    """``rows`` with ``decoded``, the text of ``ids``.  A column named
    ``decoded`` is replaced."""
    rows = rows.drop("decoded")
    return rows.mapInArrow(_decode(model), _with(rows, T.StructField("decoded", T.StringType())))


def encode_and_decode(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` and with ``text_col`` as the ids decode to it, in one
    pass: a task has one worker with one table of words.  A column named
    ``ids`` is replaced."""
    rows = docs.drop("ids").withColumn(text_col, F.col(f"`{text_col}`").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _codec(model) as codec:
            # small slices: the columns carried beside the text need their room too
            for batch in (part for whole in batches for part in slices_by_bytes(whole, text_col, 2 << 20)):
                place = batch.schema.get_field_index(text_col)
                ids = codec.encode(batch.column(place).to_pylist())
                size = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                columns = list(batch.columns)
                columns[place] = pa.array([codec.decode(i) for i in ids], pa.string())
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(size), pa.array(flat, pa.int32()))],
                                                 names=[*batch.schema.names, "ids"])

    return rows.mapInArrow(run, _with(rows, T.StructField("ids", T.ArrayType(T.IntegerType()))))


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pieces, ids_crc32, same (the decoded text is the text, null as empty)."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        with _codec(model) as codec:
            for batch in (part for whole in batches for part in slices_by_bytes(whole, "_text")):
                texts = batch.column("_text").to_pylist()
                ids = codec.encode(texts)
                back = [codec.decode(i) for i in ids]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64()),
                    pa.array([b == (t or "").replace(MARK, " ") for b, t in zip(back, texts)], pa.bool_())],
                    names=["doc_id", "n_pieces", "ids_crc32", "same"])

    return rows.mapInArrow(run, _with(rows.select("doc_id"), T.StructField("n_pieces", T.LongType()),
                                      T.StructField("ids_crc32", T.LongType()), T.StructField("same", T.BooleanType())))
