"""Token counts that follow edits.

Each document keeps a segment tree over its pre-tokens: a leaf knows its
pre-tokens, their characters and tokens, an inner node the sums below it.  An
edit finds its leaves by descending on characters, cuts the touched region
anew together with its boundary context, counts only those pre-tokens, and
updates the sums on the paths above.  The region ends where a new pre-token
boundary meets an old one behind the edit: the pattern looks forward only, so
everything after that stays as it is.  It begins with the first pre-token that
could have looked at an edited character (the pattern reads one character
beyond a token's end).

Edits are (start, end, text) in characters of the text as it was given.
Defined cases: null and empty texts have no tokens but take insertions; edits
are applied in order of start (ties: as given); positions are clipped to the
text, and an edit that begins inside the one before it only replaces what is
left; null edits, null positions and null replacement texts change nothing, 0
and "" respectively; repeated rows repeat; a null id is kept; an empty table
gives an empty result; a text of any length is counted whole.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Edit = tuple[int, int, str]


class Counter:
    """Cuts text into pre-tokens and counts their tokens; keeps the counts of
    ``room`` pre-tokens at most."""

    def __init__(self, ranks: str, pattern: str, room: int = 500_000):
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}
        self.room = room

    def cut(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def tokens(self, pieces: Sequence[str]) -> list[int]:
        known = self.known
        try:
            return [known[p] for p in pieces]
        except KeyError:
            if len(known) > self.room:
                known.clear()
            for p in pieces:
                if p not in known:
                    known[p] = len(self.encode(p))
            return [known[p] for p in pieces]


class SegmentTree:
    """Pre-tokens of one document with character and token sums."""

    def __init__(self, text: str, counter: Counter):
        self.counter = counter
        pieces = counter.cut(text)
        self.leaves: list[list[str]] = [[p] for p in pieces] or [[]]
        self.size = 1 << max(0, (len(self.leaves) - 1).bit_length())
        self.chars = self._sums([len(p) for p in pieces])
        self.counts = self._sums(counter.tokens(pieces))
        self.recounted = 0

    def _sums(self, values: list[int]) -> np.ndarray:
        """Heap layout: node i has children 2i and 2i + 1, leaves from ``size``."""
        tree = np.zeros(2 * self.size, dtype=np.int64)
        tree[self.size:self.size + len(values)] = values
        at = self.size
        while at > 1:
            tree[at // 2:at] = tree[at:2 * at].reshape(-1, 2).sum(axis=1)
            at //= 2
        return tree

    @property
    def tokens(self) -> int:
        return int(self.counts[1])

    @property
    def length(self) -> int:
        return int(self.chars[1])

    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p in leaf)

    def _leaf(self, at: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds character ``at``
        (the last leaf with characters, if ``at`` is the end)."""
        if not self.length:
            return 0, 0
        at = max(0, min(at, self.length - 1))
        node, begin = 1, 0
        while node < self.size:
            left = int(self.chars[2 * node])
            node *= 2
            if at - begin >= left:
                begin += left
                node += 1
        return node - self.size, begin

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace characters [start, end) of the present text by ``new``."""
        start = max(0, min(start, self.length))
        end = max(start, min(end, self.length))
        first, begin = self._leaf(start - 2)  # the first token that may have looked at character start
        # old text and boundaries from there, extended leaf by leaf until the cuts agree again
        last, old, bounds = first, "", {0}
        want = end - begin
        grow = 4
        while True:
            while last < len(self.leaves) and len(old) < want + grow:
                for p in self.leaves[last]:
                    old += p
                    bounds.add(len(old))
                last += 1
            whole = last == len(self.leaves)
            now = old[:start - begin] + new + old[end - begin:]
            shift = len(now) - len(old)
            pieces, at, met = [], 0, None
            for piece in self.counter.cut(now):
                if at - shift in bounds and at - shift >= want and at >= start - begin + len(new) and pieces:
                    met = at - shift
                    break
                # a cut near the end of the region may change with what follows
                if not whole and at + len(piece) > len(now) - 2:
                    break
                pieces.append(piece)
                at += len(piece)
            if whole and met is None:
                met = len(old)
            if met is not None:
                break
            grow *= 2
        # met lies on a pre-token boundary; a leaf may go on behind it
        stop, size = first, 0
        while stop < last and size < met:
            size += sum(map(len, self.leaves[stop]))
            stop += 1
        stop = max(stop, first + 1)
        self._put(first, stop, pieces + self._tail(first, stop, met))

    def _tail(self, first: int, stop: int, met: int) -> list[str]:
        out, at = [], 0
        for leaf in self.leaves[first:stop]:
            for p in leaf:
                if at >= met:
                    out.append(p)
                at += len(p)
        return out

    def _put(self, first: int, stop: int, pieces: list[str]) -> None:
        """Spread ``pieces`` over the leaves [first, stop) and fix the sums."""
        self.recounted += len(pieces)
        n = stop - first
        counts = self.counter.tokens(pieces)
        for i in range(n):
            a, b = len(pieces) * i // n, len(pieces) * (i + 1) // n
            self.leaves[first + i] = pieces[a:b]
            self.chars[self.size + first + i] = sum(map(len, pieces[a:b]))
            self.counts[self.size + first + i] = sum(counts[a:b])
        lo, hi = self.size + first, self.size + stop - 1
        while lo > 1:
            lo, hi = lo // 2, hi // 2
            for tree in (self.chars, self.counts):
                tree[lo:hi + 1] = tree[2 * lo:2 * hi + 2].reshape(-1, 2).sum(axis=1)


def apply_edits(tree: SegmentTree, edits: Sequence[Edit]) -> int:
    """Apply edits given in characters of the first text; returns their number."""
    shift, done = 0, 0
    length = tree.length
    for start, end, new in sorted(edits, key=lambda e: e[0]):
        start, end = min(max(start, done), length), min(max(end, done), length)
        end = max(start, end)
        tree.edit(start + shift, end + shift, new)
        shift += len(new) - (end - start)
        done = end
    return len(edits)


_COUNTERS: dict[tuple[str, str], Counter] = {}


def _counter(ranks: str, pattern: str) -> Counter:
    if (ranks, pattern) not in _COUNTERS:
        _COUNTERS[ranks, pattern] = Counter(ranks, pattern)
    return _COUNTERS[ranks, pattern]


def count_edited(docs: DataFrame, edits: str | Callable[[dict], Sequence[Edit]], ranks: str, pattern: str,
                 id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_edits, n_tokens_after,
    n_recounted (pre-tokens counted again because of edits).

    ``edits`` names a column array<struct<start, end, text>> or is a function
    of a row (a dict of ``text_col`` and the ``carry`` columns) to edits.
    """
    named = edits if isinstance(edits, str) else None
    cols = list(dict.fromkeys([text_col, *carry, *([named] if named else [])]))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_doc_id"), *[F.col(f"`{c}`") for c in cols])

    def of(row: dict) -> Sequence[Edit]:
        if named is None:
            return edits(row)
        return [tuple(e.values()) for e in row[named] or () if e is not None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(ranks, pattern)
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in cols}
                tree = SegmentTree(row[text_col] or "", counter)
                before = tree.tokens
                n = apply_edits(tree, [(s or 0, e or 0, t or "") for s, e, t in of(row)])
                out.append((before, n, tree.tokens, tree.recounted))
            yield pa.RecordBatch.from_arrays([batch.column("_doc_id"), *[pa.array([o[k] for o in out], pa.int64()) for k in range(4)]],
                                             names=["doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_recounted"])

    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_edits long, n_tokens_after long, n_recounted long")


_DIGITS = regex.compile(r"[0-9]+")


def cleaning_edits(row: dict, text_col: str = "text", lang_col: str = "lang") -> list[Edit]:
    """The edits of a usual cleaning pass: a language tag in front, each run of
    digits becomes one 0, and a line that repeats an earlier line of its
    document goes, with its line end."""
    text = row[text_col] or ""
    out: list[Edit] = [(0, 0, f"<{row[lang_col] or 'und'}> ")]
    seen, at = set(), 0
    for line in text.splitlines(keepends=True):
        key = line.strip()
        if key and key in seen:
            out.append((at, at + len(line), ""))
        else:
            seen.add(key)
            out += [(at + m.start(), at + m.end(), "0") for m in _DIGITS.finditer(line) if m[0] != "0"]
        at += len(line)
    return out
