"""Ids of many texts by a byte-level BPE tokenizer, by distinct words.

The tokenizer's pre-token pattern never joins anything across a blank or a line
end that stands alone between two words: a blank starts the next token and a
line end is a token of its own; a mark behind an ASCII letter starts one too.  Such a text is cut at those places straight on
its Arrow buffer, the cuts are dictionary-encoded, and only words that the
worker has not met lately go to the tokenizer; the ids of all cuts are gathered
by array indices.  Any other text (white space side by side or at an end, other
white space, strings of special tokens) goes to the tokenizer whole.  The ids
are those of ``Tokenizer.encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

_BLANK, _LINE = 32, 10
# between an ASCII letter and one of these the pre-token pattern always ends a token
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b".,;:!?)")] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _rows_with(at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows (by their exclusive end offsets) in which the byte positions lie."""
    return np.searchsorted(ends, at, side="right")


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``flat[start[i]:start[i] + size[i]]`` for all i, one after the other."""
    total = int(size.sum())
    if not total:
        return flat[:0]
    before = np.cumsum(size) - size
    at = np.repeat(start - before, size)
    at += np.arange(total)
    return flat[at]


class BatchEncoder:
    """Encodes columns of texts; keeps the ids of about ``room`` words,
    those that several slices hold before others."""

    def __init__(self, path: str, room: int = 400_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [str(t.content).encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.room = room
        pieces = self.tokenizer.get_vocab()
        lead = self.tokenizer.encode(" a", add_special_tokens=False).tokens[0][0]  # how a piece spells a blank
        self.leads = np.zeros(max(pieces.values()) + 1, dtype=bool)
        self.leads[[i for p, i in pieces.items() if p.startswith(lead)]] = True
        self.end = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self._clear()

    def _clear(self) -> None:
        self.slots: dict[bytes, int] = {b"\n": 0}
        self.flat = np.array([self.end], dtype=np.uint32)
        self.start = np.zeros(1, np.int64)
        self.size = np.ones(1, np.int64)
        self.hits = np.zeros(1, np.int64)  # slices that held the word

    def _forget(self) -> None:
        """Keep the words that several slices held; if those alone fill the
        table, the ones held most often."""
        want = 2
        while np.count_nonzero(self.hits >= want) > self.room // 2:
            want *= 2
        keep = self.hits >= want
        keep[0] = True
        words = [w for w, k in zip(self.slots, keep.tolist()) if k]  # slots are in order of insertion
        self.slots = dict(zip(words, range(len(words))))
        self.flat = gather(self.flat, self.start[keep], self.size[keep])
        self.size, self.hits = self.size[keep], self.hits[keep] // 2
        self.start = np.cumsum(self.size) - self.size

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=np.uint32) for e in found]

    def _new(self, words: list[bytes], blank: bool, at_once: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of words, many in one text: after a blank each begins
        at the one token that begins with a blank; words of line starts stand
        between line ends."""
        flat, size = [], []
        for i in range(0, len(words), at_once):
            some = words[i:i + at_once]
            text = b"".join(some) if blank else b"\n" + b"\n".join(some)
            ids = self._ids([text.decode()])[0]
            marks = np.flatnonzero(self.leads[ids] if blank else ids == self.end)
            n = np.diff(np.append(marks, len(ids)))
            if len(n) != len(some) or (len(marks) and marks[0]):
                raise ValueError("a word does not begin at a token of its own")
            flat.append(ids if blank else np.delete(ids, marks))
            size.append(n if blank else n - 1)
        return (np.concatenate(flat), np.concatenate(size)) if flat else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _slots_of(self, words: list[bytes]) -> np.ndarray:
        if len(self.slots) + len(words) > self.room:
            self._forget()
        get = self.slots.get
        found = [get(w, -1) for w in words]
        new = [w for w, s in zip(words, found) if s < 0]
        for blank in (True, False):
            some = [w for w in new if (w[:1] == b" ") == blank]
            if not some:
                continue
            flat, size = self._new(some, blank)
            start = len(self.flat) + np.cumsum(size) - size
            self.slots.update(zip(some, range(len(self.size), len(self.size) + len(some))))
            self.flat = np.concatenate([self.flat, flat])
            self.start, self.size = np.concatenate([self.start, start]), np.concatenate([self.size, size])
        if new:
            found = [s if s >= 0 else get(w) for w, s in zip(words, found)]
        at = np.array(found, dtype=np.int64)
        self.hits = np.concatenate([self.hits, np.zeros(len(self.size) - len(self.hits), np.int64)])
        self.hits[at] += 1
        return at

    def _odd(self, raw: np.ndarray, off: np.ndarray, data: bytes) -> np.ndarray:
        """Rows that must go to the tokenizer whole."""
        n = len(off) - 1
        odd = np.zeros(n + 1, dtype=bool)
        gap = (raw == _BLANK) | (raw == _LINE)
        ends = off[1:]
        full = np.flatnonzero(np.diff(off) > 0)
        odd[full[gap[off[full]] | gap[ends[full] - 1]]] = True
        # white space side by side; neighbours of two rows are both at an end, so the rows are odd already
        odd[_rows_with(np.flatnonzero(gap[1:] & gap[:-1]), ends)] = True
        odd[_rows_with(np.flatnonzero((raw < _BLANK) & ~gap), ends)] = True
        for lead in (0xC2, 0xE1, 0xE2, 0xE3):  # white space beyond ASCII
            at = np.flatnonzero(raw == lead)
            if not len(at):
                continue
            b1, b2 = raw[np.minimum(at + 1, len(raw) - 1)], raw[np.minimum(at + 2, len(raw) - 1)]
            if lead == 0xC2:
                hit = (b1 == 0x85) | (b1 == 0xA0)
            elif lead == 0xE2:
                hit = (b1 == 0x80) & ((b2 <= 0x8A) | (b2 == 0xA8) | (b2 == 0xA9) | (b2 == 0xAF)) | (b1 == 0x81) & (b2 == 0x9F)
            else:
                hit = (b1 == (0x9A if lead == 0xE1 else 0x80)) & (b2 == 0x80)
            odd[_rows_with(at[hit], ends)] = True
        for mark in self.special:
            at = data.find(mark)
            while at >= 0:
                odd[_rows_with(np.array([at]), ends)] = True
                at = data.find(mark, at + 1)
        return odd[:n]

    def __call__(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after the other, and the number of each row's;
        a null text has none."""
        col = col.cast(pa.large_binary()).fill_null(b"")
        n = len(col)
        off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + n + 1] if n else np.zeros(1, np.int64)
        base = int(off[0])
        off = off - base
        if not n or not off[-1]:
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        raw = np.frombuffer(col.buffers()[2], np.uint8)[base:base + int(off[-1])]
        odd = self._odd(raw, off, raw.tobytes())
        # cuts: starts of rows, blanks, line ends and what follows a line end, marks right behind a letter
        cut = raw == _BLANK
        line = raw == _LINE
        cut |= line
        cut[1:] |= line[:-1]
        cut[1:] |= _MARK[raw[1:]] & _LETTER[raw[:-1]]
        cut[off[:-1][np.diff(off) > 0]] = True
        if odd.any():  # an odd row is one cut that is not looked up
            inside = np.repeat(odd, np.diff(off))
            cut &= ~inside
            cut[off[:-1][odd]] = True
        begin = np.flatnonzero(cut)
        bound = np.append(begin, len(raw))
        words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(bound.tobytes()), pa.py_buffer(raw)])
        row = np.repeat(np.arange(n), np.diff(np.searchsorted(begin, off)))
        plain = ~odd[row]
        coded = (words if plain.all() else words.filter(pa.array(plain))).dictionary_encode()
        slot = self._slots_of(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        size, start, flat = np.empty(len(begin), np.int64), np.empty(len(begin), np.int64), self.flat
        size[plain], start[plain] = self.size[slot], self.start[slot]
        if odd.any():
            whole = self._ids([raw[off[i]:off[i + 1]].tobytes().decode() for i in np.flatnonzero(odd)])
            more = np.array([len(w) for w in whole], dtype=np.int64)
            size[~plain], start[~plain] = more, len(flat) + np.cumsum(more) - more
            flat = np.concatenate([flat, *whole])
        counts = np.bincount(row, weights=size, minlength=n).astype(np.int64)
        return gather(flat, start, size), counts


_ENCODERS: dict[str, BatchEncoder] = {}


def encoder(path: str) -> BatchEncoder:
    """One encoder per worker process, so its table outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = BatchEncoder(path)
    return _ENCODERS[path]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same rows with ``end_id`` behind each."""
    out = np.full(len(ids) + len(counts), end_id, dtype=ids.dtype)
    keep = np.ones(len(out), dtype=bool)
    keep[np.cumsum(counts + 1) - 1] = False
    out[keep] = ids
    return out, counts + 1
