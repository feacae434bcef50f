"""Greedy longest-suffix encoding of whole Arrow batches by a double-array trie.

The trie holds the pieces from their last character to the first.  All places
of a batch walk it together, a character back at a step, and drop out as soon
as no piece goes on; so each place knows the longest piece that ends there.
Which places the encoding really visits follows from the ends of the texts:
jumps of 64 pieces are found by doubling single ones, texts are crossed by
these, and what lies between is filled in by halves.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of texts that are worked on at once (a longer text is taken alone).
STEP = 1 << 18
#: Doublings of a jump.
DOUBLINGS = 6


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after the other, and the length of each (0 if null)."""
    sizes = pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, dtype=np.uint32), sizes
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=wide)[column.offset : column.offset + len(column) + 1]
    raw = bytes(memoryview(column.buffers()[2])[offsets[0] : offsets[-1]])
    if raw.isascii():
        return np.frombuffer(raw, dtype=np.uint8).astype(np.uint32), sizes
    return np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), dtype="<u4"), sizes


def slices(column: pa.Array, size: int | None = None) -> Iterator[pa.Array]:
    """Parts of a column with about that many bytes, one text at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(column):
        done = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + (size or STEP), side="right")))
        yield column.slice(start, stop - start)
        start = stop


class Automaton:
    """The pieces of a vocabulary, ready to encode; its arrays travel with the function that uses it."""

    def __init__(self, pieces: dict[str, int]):
        letters = sorted({ord(c) for p in pieces for c in p})
        # letters are numbered from 1; 0 is any other character, and the end of a text
        self.known = np.zeros(letters[-1] + 2 if letters else 1, dtype=np.int32)
        self.known[letters] = np.arange(1, len(letters) + 1)
        self.depth = max(map(len, pieces), default=0)
        #: For pieces of one character: whether a letter is one, and its token.
        self.single, self.tokens = np.zeros(len(letters) + 1, dtype=bool), np.zeros(len(letters) + 1, dtype=np.int32)
        for piece, token in pieces.items():
            if len(piece) == 1:
                self.single[self.known[ord(piece)]], self.tokens[self.known[ord(piece)]] = True, token
        self._build(pieces, len(letters) + 1)

    def _build(self, pieces: dict[str, int], width: int) -> None:
        """Lay out the trie: the child of state s by letter c is at base[s] + c if check there is s."""
        below: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for piece, token in pieces.items():
            state = 0
            for c in reversed(piece):
                letter = int(self.known[ord(c)])
                if letter not in below[state]:
                    below[state][letter] = len(below)
                    below.append({})
                state = below[state][letter]
            ends[state] = token
        room = 2 * len(below) + 4 * width
        base, check, token, final = np.zeros(room, dtype=np.int32), np.full(room, -1, dtype=np.int32), np.zeros(room, dtype=np.int32), np.zeros(room, dtype=bool)
        check[0], first, roomy, todo = 0, 1, 1, deque([(0, 0)])
        while todo:
            node, at = todo.popleft()
            if not below[node]:
                continue
            own = np.array(sorted(below[node]))
            while check[first] != -1:
                first += 1
            # one child fills the first gap, several go where gaps are many; a base may be negative
            # (a step to a place before the first reads one near the last, which is no child of the same state)
            low = int(own[0])
            start = (first if len(own) == 1 else roomy) - low
            while True:
                if start + 4096 + width >= len(check):
                    more = room + 4096 + width
                    base, token = np.r_[base, np.zeros(more, dtype=np.int32)], np.r_[token, np.zeros(more, dtype=np.int32)]
                    check, final = np.r_[check, np.full(more, -1, dtype=np.int32)], np.r_[final, np.zeros(more, dtype=bool)]
                span = 64 if len(own) == 1 else 1024
                free = np.ones(span, dtype=bool)
                for c in own.tolist():
                    free &= check[start + c : start + c + span] == -1
                if free.any():
                    start += int(free.argmax())
                    break
                start += span
                if len(own) > 1:
                    roomy = start + low
            base[at] = start
            check[start + own] = at
            for c in own.tolist():
                child = below[node][c]
                if child in ends:
                    token[start + c], final[start + c] = ends[child], True
                todo.append((child, start + c))
        # a step from any state stays within the arrays
        used = int(np.flatnonzero(check >= 0).max()) + 1
        size = max(used, int(base.max()) + width, width + 1)
        self.base, self.check, self.token, self.final = (np.resize(x, size) if len(x) < size else x[:size].copy() for x in (base, check, token, final))
        self.check[used:] = -1
        # letter 0 leads nowhere
        self.check[0] = -1

    def longest(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length and token of the longest piece that ends at each place; length 0 where none does."""
        size, token = np.zeros(len(letters), dtype=np.int32), np.zeros(len(letters), dtype=np.int32)
        at = np.flatnonzero(letters).astype(np.int32)
        state = np.zeros(len(at), dtype=np.int32)
        for n in range(self.depth):
            go = self.base[state] + letters[at - n]
            on = self.check[go] == state
            at, state = at[on], go[on]
            if not len(at):
                break
            hit = np.flatnonzero(self.final[state])
            size[at[hit]], token[at[hit]] = n + 1, self.token[state[hit]]
        return size, token

    def encode(self, column: pa.Array, strict: bool = False) -> pa.Array:
        """Tokens of every text; a null text has null tokens; unknown characters are skipped, or raise if ``strict``."""
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        if not len(column):
            return pa.array([], pa.list_(pa.int32()))
        return pa.concat_arrays(list(self.encoded(column, strict)))

    def encoded(self, column: pa.Array, strict: bool = False) -> Iterator[pa.Array]:
        """As ``encode``, a slice at a time."""
        for part in slices(column):
            yield self._encode(part, strict)

    def _encode(self, column: pa.Array, strict: bool) -> pa.Array:
        codes, sizes = code_points(column)
        letters = self.known[np.minimum(codes, len(self.known) - 1)]
        if self.depth <= 1:
            seen, ends = self.single[letters], np.concatenate([[0], np.cumsum(sizes)])
            lost = ~seen
            found = self.tokens[letters]
            if lost.any():
                found = found[seen]
                ends = np.concatenate([[0], np.cumsum(seen)])[ends]
        else:
            # a place of letter 0 before every text parts it from the one before
            starts = np.concatenate([[0], np.cumsum(sizes + 1)])
            inner = np.ones(int(starts[-1]), dtype=bool)
            inner[starts[:-1]] = False
            flat = np.zeros(len(inner), dtype=np.int32)
            flat[inner] = letters
            size, token = self.longest(flat)
            seen = self._visited(size, starts)
            hit = size[seen] > 0
            lost = np.zeros(len(inner), dtype=bool)
            lost[seen[~hit]] = True
            lost, seen = lost[inner], seen[hit]
            ends, found = np.searchsorted(seen, starts), token[seen]
        if strict and lost.any():
            raise ValueError(f"not encodable: {chr(int(codes[lost.argmax()]))!r}")
        null = pc.is_null(column) if column.null_count else None
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(found), mask=null)

    def _visited(self, size: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Places where a piece (or a character that is skipped) ends, in order."""
        place = np.arange(len(size), dtype=np.int32)
        jump = place - np.maximum(size, 1)
        jump[starts[:-1]] = starts[:-1]  # where a text ends, one stays
        jumps = [jump]
        for _ in range(DOUBLINGS):
            jumps.append(jumps[-1][jumps[-1]])
        far, seeds = memoryview(jumps[-1]), []
        for first, end in zip(starts[:-1].tolist(), (starts[1:] - 1).tolist()):
            while end > first:
                seeds.append(end)
                end = far[end]
        seen = np.array(seeds, dtype=np.int32)
        for jump in jumps[-2::-1]:
            seen = np.concatenate([seen, jump[seen]])
        mark = np.zeros(len(size), dtype=bool)
        mark[seen] = True
        mark[starts[:-1]] = False
        return np.flatnonzero(mark)


def distinct_characters(column: pa.Array) -> np.ndarray:
    """Code points that the texts of a column hold."""
    held = np.zeros(0, dtype=np.uint32)
    for part in slices(column):
        codes, _ = code_points(part)
        if len(codes):
            top = int(codes.max())
            seen = np.zeros(top + 1, dtype=bool)
            seen[codes] = True
            held = np.union1d(held, np.flatnonzero(seen).astype(np.uint32))
    return held


def first_places(column: pa.Array, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each code point of the texts, the row of least rank that holds it, and its first place there, from 1."""
    none = np.iinfo(np.int64).max
    least, row, start = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 0
    for part in slices(column):
        codes, sizes = code_points(part)
        if len(codes):
            top = max(int(codes.max()) + 1, len(least))
            least, row = (np.concatenate([x, np.full(top - len(x), none)]) for x in (least, row))
            place = np.arange(1, len(codes) + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            own = np.full(top, none)
            np.minimum.at(own, codes, np.repeat(ranks[start : start + len(part)] << 32, sizes) + place)
            better = np.flatnonzero(own < least)
            # rows of one rank may share the least place; any of them will do
            of_rank = {int(r): start + n for n, r in enumerate(ranks[start : start + len(part)].tolist())}
            row[better] = [of_rank[r] for r in (own[better] >> 32).tolist()]
            least[better] = own[better]
        start += len(part)
    held = np.flatnonzero(least != none) if len(least) else np.zeros(0, dtype=np.int64)
    return held.astype(np.uint32), row[held], (least[held] & 0xFFFFFFFF).astype(np.int32)
