"""Byte-level BPE by prefix-sharing trie traversal, and its decoder.

For byte pair merges the encoding of every prefix of a word ends in one token,
and that token together with the encoding of what precedes it is the encoding
of the prefix.  So one "last token" per trie node holds the encoding of the
whole path, and a word's tokens are read off by stepping back along its path.
The distinct words of a slice form a trie that is traversed depth first: in
sorted order each word keeps the nodes that it shares with the one before it,
and each further node's last token is computed once, from the states above it.
Only the path from the root to the present node is held.

Files are read by path, which is a parameter; nothing is trained or copied.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import struct
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramlake.llm.common import Recent, kept, map_slices

#: Fixed value: the public pre-tokenizer pattern of this vocabulary family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Marks that often end a chunk.
ENDINGS = frozenset(".,;:!?")
#: Chunks of text whose ids a worker keeps, and checked token pairs, in each of two generations.
CACHE_CHUNKS, CACHE_PAIRS = 200_000, 300_000
#: Transitions that are kept beside those of the vocabulary's own prefixes.
CACHE_STEPS = 400_000
#: Bytes from which on a word's path is held in packed arrays.
LONG_WORD = 10_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files of this kind."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(spare)}


class BpeDecoder:
    """Bytes of every token of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_alphabet()
        self._raw = lambda piece: bytes(to_byte[c] for c in piece)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces = {i: self._raw(p) for p, i in spec["model"]["vocab"].items()} | {i: s.encode() for s, i in self.special.items()}
        self.table = [self.pieces.get(i, b"") for i in range(max(self.pieces, default=-1) + 1)]
        self._load(spec)

    def _load(self, spec: dict) -> None:
        """What only the encoder needs."""

    def decode(self, ids: bytes) -> str:
        """Text of little-endian ids; special tokens keep their strings, unknown ids are left out, bad bytes become U+FFFD."""
        known = np.frombuffer(ids, dtype="<u4")
        if len(known) and known.max() >= len(self.table):
            known = known[known < len(self.table)]
        return b"".join(map(self.table.__getitem__, known.tolist())).decode("utf-8", "replace")


class BpeModel(BpeDecoder):
    """Encoder (and decoder) of one vocabulary file."""

    def _load(self, spec: dict) -> None:
        raw = self._raw
        self.vocab = {raw(p): i for p, i in spec["model"]["vocab"].items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for n, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]):
            left, right = raw(a), raw(b)
            self.rank[self.vocab[left], self.vocab[right]] = (n, self.vocab[left + right])
        self._automaton()
        self.words = regex.compile(PATTERN)
        self.parted = regex.compile(r"\x00|" + PATTERN.replace(r"\p{N}]+", r"\p{N}\x00]+"))
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self._made: dict[int, list[tuple[int, int, int]]] = {}
        self._fit: dict[int, bool] = {}
        self._marks = {x: struct.pack("<I", self.vocab[x.encode()]) for x in ENDINGS}
        self._line = struct.pack("<I", self.vocab[b"\n"])
        self._first, self._spaced = Recent(CACHE_CHUNKS), Recent(CACHE_CHUNKS)

    def _automaton(self) -> None:
        """The vocabulary as an Aho-Corasick automaton.

        ``_go`` maps (state, byte) to a state; ``_ending`` lists, longest
        first, length and id of every vocabulary entry that ends in a state.
        """
        go, token, fall = {}, [None], [0]
        parent: list[tuple[int, int, int]] = [(0, 0, 0)]
        for piece, i in self.vocab.items():
            state = 0
            for depth, byte in enumerate(piece, 1):
                further = go.get(state << 8 | byte)
                if further is None:
                    further = go[state << 8 | byte] = len(token)
                    token.append(None)
                    fall.append(0)
                    parent.append((depth, state, byte))
                state = further
            token[state] = (len(piece), i)
        self._go, self._fall, self._most_steps = go, fall, len(go) + CACHE_STEPS
        self._ending: list[tuple[tuple[int, int], ...]] = [()] * len(token)
        for state in sorted(range(1, len(token)), key=lambda s: parent[s][0]):
            depth, above, byte = parent[state]
            if depth > 1:
                fall[state] = self._step(fall[above], byte)
            own = self._ending[fall[state]]
            self._ending[state] = (token[state], *own) if token[state] else own

    def _step(self, state: int, byte: int) -> int:
        """The state after a byte: that of the longest vocabulary prefix that ends there."""
        go, at = self._go, state
        while (further := go.get(at << 8 | byte)) is None and at:
            at = self._fall[at]
        further = further or 0
        if len(go) < self._most_steps:
            go[state << 8 | byte] = further
        return further

    def merge(self, data: bytes, steps: list | None = None) -> list[int]:
        """Plain BPE of one word: repeatedly merge the pair of lowest rank."""
        ids = [self.vocab[data[i : i + 1]] for i in range(len(data))]
        if steps is not None:
            steps.append((-1, ids[0], ids[-1]))
        while len(ids) > 1:
            best = min((self.rank.get(p, (len(self.rank), -1)) for p in zip(ids, ids[1:])))
            if best[1] < 0:
                break
            out, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and self.rank.get((ids[i], ids[i + 1])) == best:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
            if steps is not None:
                steps.append((best[0], ids[0], ids[-1]))
        return ids

    def _history(self, token: int) -> list[tuple[int, int, int]]:
        """(rank of the merge, first id, last id) over the making of a token."""
        known = self._made.get(token)
        if known is None:
            known = self._made[token] = []
            self.merge(self.pieces[token], known)
        return known

    def fits(self, a: int, b: int) -> bool:
        """Whether the bytes of both tokens together encode as just these two.

        Replays the merges inside each token by rank; the pair is refused when
        a merge across their border would come first at any moment.
        """
        left, right, never = self._history(a), self._history(b), len(self.rank)
        i = j = 0
        while True:
            across = self.rank.get((left[i][2], right[j][1]), (never, -1))[0]
            in_a = left[i + 1][0] if i + 1 < len(left) else never
            in_b = right[j + 1][0] if j + 1 < len(right) else never
            if in_a <= in_b:
                if across < in_a or in_a == never:
                    return across == never
                i += 1
            else:
                if across <= in_b:
                    return False
                j += 1

    def encode_words(self, words: set[bytes]) -> dict[bytes, list[int]]:
        """Ids of every distinct word, by depth-first traversal of their trie."""
        if len(self._fit) > CACHE_PAIRS:
            self._fit = {}
        ordered = sorted(words)
        long = [w for w in ordered if len(w) >= LONG_WORD]
        out = self._walk([w for w in ordered if len(w) < LONG_WORD] if long else ordered, list)
        return out | self._walk(long, lambda x: array("i", x)) if long else out

    def _walk(self, ordered: list[bytes], holding) -> dict[bytes, list[int]]:
        """Traverse the trie of sorted words; ``holding`` makes the stacks of the path.

        The node at depth d has state ``states[d]``, last token ``last[d]``,
        and that token begins at depth ``back[d]``.
        """
        go, ending, fit = self._go, self._ending, self._fit
        states, last, back = holding([0]), holding([-1]), holding([0])
        out: dict[bytes, list[int]] = {}
        for word, same in zip(ordered, shared_prefixes(ordered)):
            del states[same + 1 :], last[same + 1 :], back[same + 1 :]
            state = states[same]
            for end, byte in enumerate(word[same:], same + 1):
                further = go.get(state << 8 | byte)
                state = self._step(state, byte) if further is None else further
                for length, token in ending[state]:
                    start = end - length
                    if not start:
                        break
                    pair = last[start] << 32 | token
                    known = fit.get(pair)
                    if known is None:
                        known = fit[pair] = self.fits(last[start], token)
                    if known:
                        break
                states.append(state)
                last.append(token)
                back.append(start)
            ids, at = [], len(word)
            while at:
                ids.append(last[at])
                at = back[at]
            ids.reverse()
            out[word] = ids
        return out

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of texts without special tokens, each cut by the pattern alone."""
        split = [[w.encode("utf-8", "surrogatepass") for w in self.words.findall(t)] for t in texts]
        ids = self.encode_words({w for ws in split for w in ws})
        packed = {w: struct.pack(f"<{len(x)}I", *x) for w, x in ids.items()}
        return [b"".join(map(packed.__getitem__, ws)) for ws in split]

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """As ``_plain`` for texts that neither end in white space nor hold NUL: all are cut at once."""
        if not chunks:
            return []
        split = self.parted.findall("\0".join(chunks))
        ids = self.encode_words({w.encode("utf-8", "surrogatepass") for w in set(split) if w != "\0"})
        packed = {w.decode("utf-8", "surrogatepass"): struct.pack(f"<{len(x)}I", *x) for w, x in ids.items()}
        packed["\0"] = b"\xff\xff\xff\xff"
        flat = b"".join(map(packed.__getitem__, split))
        stops = (np.flatnonzero(np.frombuffer(flat, dtype="<u4") == 0xFFFFFFFF) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *(x + 4 for x in stops)], [*stops, len(flat)])]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        A space or a line feed between two other characters always begins a
        new word of the pattern (with the space, after the line feed), so a
        text is cut there and ids are kept by chunk.  Texts with other runs of
        white space beside a space are cut by the pattern itself.
        """
        parts: list[str] = []
        plan: list[list[int | bytes]] = []
        for t in texts:
            steps: list[int | bytes] = []
            for p in self.marks.split(t) if self.marks and any(s in t for s in self.special) else (t,):
                if p in self.special:
                    steps.append(np.array([self.special[p]], dtype="<u4").tobytes())
                elif p:
                    steps.append(len(parts))
                    parts.append(p)
            plan.append(steps)
        cut = [p.split(" ") for p in parts]
        self._first.turn()
        self._spaced.turn()
        heads, missing = self._first.missing({c[0] for c in cut}), self._spaced.missing(set(itertools.chain.from_iterable(c[1:] for c in cut)))
        first, spaced = self._first.now, self._spaced.now
        regular, ended, lined, inner = set(), [], [], set()
        for x in missing:
            if x and x[-1] in ENDINGS and x[:-1].isalpha():
                ended.append(x)
            elif not x or x[0].isspace() or x[-1].isspace() or "\0" in x:
                spaced[x] = None
            elif "\n" in x and all(y and not y[0].isspace() and not y[-1].isspace() for y in x.split("\n")):
                lined.append((x, x.split("\n")))
                inner.update(lined[-1][1][1:])
            else:
                regular.add(x)
        # the first of several lines follows a space, the others a line feed
        of_lines = self._spaced.missing({ys[0] for _, ys in lined} - regular)
        regular.update(of_lines.difference(ended))
        # letters and one mark are two words of the pattern
        regular.update(self._spaced.missing({x[:-1] for x in ended}))
        heads |= self._first.missing(inner - heads)
        spaced.update(zip(regular, self._chunks([" " + x for x in regular])))
        spaced.update((x, spaced[x[:-1]] + self._marks[x[-1]]) for x in ended)
        plain = [x for x in heads if not x or x[-1].isspace() or "\0" in x]
        first.update(zip(plain, self._plain(plain)))
        heads.difference_update(plain)
        first.update(zip(heads, self._chunks(list(heads))))
        spaced.update((x, self._line.join([spaced[ys[0]], *map(first.__getitem__, ys[1:])])) for x, ys in lined)
        done: list[bytes] = []
        for p, c in zip(parts, cut):
            ids = [first[c[0]], *map(spaced.__getitem__, c[1:])]
            if len(c) > 1 and (not c[0] or c[0][-1].isspace()) or None in ids:
                done.append(self._plain([p])[0])
            else:
                done.append(b"".join(ids))
        return [b"".join(s if isinstance(s, bytes) else done[s] for s in steps) for steps in plan]


def shared_prefixes(ordered: list[bytes], width: int = 48) -> list[int]:
    """Bytes that each word shares with the one before it."""
    if not ordered:
        return []
    sizes = np.fromiter(map(len, ordered), dtype=np.int64, count=len(ordered))
    raw = np.array([w[:width] for w in ordered], dtype=f"S{width}").view(np.uint8).reshape(-1, width)
    differ = raw[1:] != raw[:-1]
    same = np.where(differ.any(1), differ.argmax(1), width)
    same = np.minimum(same, np.minimum(sizes[1:], sizes[:-1])).tolist()
    for i, n in enumerate(same):
        if n == width:
            a, b = ordered[i], ordered[i + 1]
            end = min(len(a), len(b))
            while n < end and a[n] == b[n]:
                n += 1
            same[i] = n
    return [0, *same]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids (binary, little-endian unsigned 32-bit), n_tokens`` of whole texts.

    A null text encodes like the empty one (no ids).  Repeated rows and null
    doc_ids each give a row; other columns are ignored; no rows give none.
    """

    def make():
        model = kept(("bpe", path), lambda: BpeModel(path))

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            ids = model.encode_batch([t or "" for t in b.column("text").to_pylist()])
            return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], ["doc_id", "ids", "n_tokens"])

        return work

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_slices(docs, "text", make, "doc_id long, ids binary, n_tokens long")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded`` to rows that have ``ids``; null ids decode to the empty text."""

    def make():
        model = kept(("bpe decoder", path), lambda: BpeDecoder(path))

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = pa.array([model.decode(x or b"") for x in b.column("ids").to_pylist()], pa.string())
            return pa.RecordBatch.from_arrays([*b.columns, texts], [*b.schema.names, "decoded"])

        return work

    schema = ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes if n != "decoded") + ", decoded string"
    return map_slices(encoded.drop("decoded"), "ids", make, schema)


def op2_query(docs: DataFrame, path: str) -> DataFrame:
    """Digests of the ids and of the text decoded from them, made by one worker per task."""

    def make():
        model = kept(("bpe", path), lambda: BpeModel(path))
        digest = lambda data: hashlib.sha256(data).hexdigest()

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            ids = model.encode_batch([t or "" for t in b.column("text").to_pylist()])
            decoded = [digest(model.decode(x).encode("utf-8", "surrogatepass")) for x in ids]
            columns = [b.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(digest, ids), pa.string()), pa.array(decoded, pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return work

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_slices(docs, "text", make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
