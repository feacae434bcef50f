"""Toxicity by a linear-chain conditional random field over tokens.

Labels exist for documents only, so tokens are labelled first: in a bounded
sample of labelled documents, token features (the word, its beginnings) that
occur in toxic documents and in no clean one are chosen greedily by how many
toxic documents they newly explain, then completed by those too frequent to
be chance.  Tokens of toxic documents that have a chosen feature are toxic.
The field (states clean and toxic) is trained on those tokens; its forward and
backward messages give each token's marginal; a document's score combines the
three largest, and runs of tokens above one half are the offending spans.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramlake.llm.common import map_slices, slices

#: Most labelled documents the field is fitted on, by label (about; chosen by a hash of doc_id).
TOXIC_SAMPLE, CLEAN_SAMPLE = 1_500, 5_000
#: Most bytes of their texts, by label, in the order of a hash; no text of more than one LONG_SHARE of them is trained on.
SAMPLE_BYTES, LONG_SHARE = 64_000_000, 16
#: Clean chains of the first fit, drawn at random (about; twice the toxic side's chains if those are more).
FIRST_CHAINS = 4_000
#: Clean words that look most toxic after the first fit, and the chains with such words that the second fit has beside (about).
SUSPECTS, HARD_CHAINS = 2_000, 6_000
#: Share of its lines that a toxic document may have in common with those before it; else it is a copy for training.
COPY_SHARE = 0.5
#: Share of the unmarked chains of toxic documents that the fits have too.
UNMARKED = 0.05
#: Hashed features, and the tokens of one chain (longer lines go on in a further chain).
FEATURES, CHAIN = 1 << 16, 256
#: Tokens of a chain that is trained on.
TRAINED = 32
#: Lengths of a word's beginnings that are features.
BEGINNINGS = (3, 4, 5, 6, 8)
#: Distinct tokens whose unary scores a worker keeps.
CACHE_WORDS = 200_000
#: Unary score of a token without letters or digits.
BLANK = -8.0
#: Marginals below this count as nothing in a document's score.
NOTHING = 1e-3
THRESHOLD = 0.7
_STRIP = ".,;:!?\"'()[]{}<>|*_-…«»„“”‚‘’/\\"


def normal(token: str) -> str:
    return token.strip(_STRIP).lower()


def marker_features(word: str) -> list[str]:
    return ["w=" + word] + [f"p{n}=" + word[:n] for n in (4, 5, 6) if len(word) > n]


def hashed(words: list[str]) -> np.ndarray:
    """Feature numbers, a row per word: its beginnings of 3 to 8 bytes, its last 3, itself.

    FEATURES stands where a word is too short for a beginning.
    """
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    flat = np.frombuffer(b"".join(raw) + bytes(8), dtype=np.uint8).astype(np.uint32)
    start = np.cumsum(size) - size
    out = np.full((len(raw), 7), FEATURES, dtype=np.int64)

    def mixed(h: np.ndarray, kind: int) -> np.ndarray:
        return (((h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1) + np.uint32(kind * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(8)) % np.uint32(FEATURES)

    h = np.full(len(raw), 0x811C9DC5, dtype=np.uint32)
    for n in range(1, 9):
        h = (h ^ flat[start + n - 1]) * np.uint32(0x01000193)
        if n in BEGINNINGS:
            own = size >= n
            out[own, BEGINNINGS.index(n)] = mixed(h, n)[own]
    h = np.full(len(raw), 0x811C9DC5, dtype=np.uint32)
    for n in (3, 2, 1):
        h = (h ^ flat[start + np.maximum(size - n, 0)]) * np.uint32(0x01000193)
    out[:, 5] = mixed(h, 9)
    out[:, 6] = np.fromiter((zlib.crc32(r) for r in raw), dtype=np.int64, count=len(raw)) % FEATURES
    return out


def choose_markers(toxic: list[set[str]], clean_words: set[str], n_clean: int) -> set[str]:
    """Features of toxic documents (as word sets) that no clean document has."""
    innocent = {f for w in clean_words for f in marker_features(w)}
    count: dict[str, int] = defaultdict(int)
    for words in toxic:
        for f in {f for w in words for f in marker_features(w)}:
            if f not in innocent:
                count[f] += 1
    del innocent
    holders: dict[str, set[int]] = {f: set() for f, c in count.items() if c > 1}
    n_features = len(count)
    del count
    for n, words in enumerate(toxic):
        for w in words:
            for f in marker_features(w):
                if f in holders:
                    holders[f].add(n)
    # by chance a feature of c documents has only toxic ones with probability share ** c
    share = len(toxic) / max(1, len(toxic) + n_clean)
    by_count: dict[int, int] = defaultdict(int)
    for h in holders.values():
        by_count[len(h)] += 1
    sure = next((c for c in range(2, 40) if sum(n for k, n in by_count.items() if k >= c) * share**c / max(1e-9, 1 - share) < 0.05 and share**c * max(1, n_features) < 1), 40)
    chosen, left = set(), set(range(len(toxic)))
    order = sorted(holders, key=lambda f: (-len(holders[f]), len(f), f))
    while left:
        best, gain = None, max(1, sure // 2)
        for f in order:
            if len(holders[f]) <= gain:
                break
            if (g := len(holders[f] & left)) > gain:
                best, gain = f, g
        if best is None:
            break
        chosen.add(best)
        left -= holders[best]
    return chosen | {f for f, h in holders.items() if len(h) >= sure}


class Field:
    """Two-state linear-chain CRF: ``w`` scores toxic over clean per feature; ``t`` the transitions."""

    def __init__(self, w: np.ndarray | None = None, t: np.ndarray | None = None, start: float = 0.0):
        self.w = np.zeros(FEATURES, dtype=np.float32) if w is None else w
        self.t = np.zeros((2, 2)) if t is None else t
        self.start = start
        self._known: dict[str, float] = {}

    def unary(self, tokens: list[str]) -> np.ndarray:
        words = [normal(x) for x in tokens]
        scores = np.append(self.w, np.float32(0))[hashed(words)].sum(1, dtype=np.float64)
        scores[np.fromiter((not w for w in words), dtype=bool, count=len(words))] = BLANK
        return scores

    def unaries(self, tokens: list[str]) -> np.ndarray:
        known = self._known
        if len(known) > CACHE_WORDS:
            known.clear()
        new = list(set(tokens).difference(known))
        known.update(zip(new, self.unary(new).tolist()))
        return np.fromiter(map(known.__getitem__, tokens), dtype=np.float64, count=len(tokens))

    def messages(self, e: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log ratios (toxic to clean) of forward and backward messages.

        ``e`` is (longest, chains), padded; chains are sorted by falling size.
        """
        t = np.exp(self.t)
        a, b = np.zeros_like(e), np.zeros_like(e)
        if not e.size:
            return a, b
        active = np.searchsorted(-sizes, -np.arange(len(e)), side="left")
        a[0] = e[0] + self.start
        for i in range(1, len(e)):
            n = active[i]
            r = np.exp(np.clip(a[i - 1, :n], -60, 60))
            a[i, :n] = e[i, :n] + np.log((t[0, 1] + t[1, 1] * r) / (t[0, 0] + t[1, 0] * r))
        for i in range(len(e) - 2, -1, -1):
            n = active[i + 1]
            r = np.exp(np.clip(e[i + 1, :n] + b[i + 1, :n], -60, 60))
            b[i, :n] = np.log((t[1, 0] + t[1, 1] * r) / (t[0, 0] + t[0, 1] * r))
        return a, b

    def marginals(self, e: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Probability of toxic for every token; ``e`` holds the unaries of all chains in turn."""
        out = np.empty(len(e))
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        for s in range(0, len(order), 4096):
            part = order[s : s + 4096]
            part = part[sizes[part] > 0]
            if not len(part):
                break
            n = sizes[part]
            column = np.repeat(np.arange(len(part)), n)
            row = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = starts[part][column] + row
            padded = np.zeros((n[0], len(part)))
            padded[row, column] = e[at]
            a, b = self.messages(padded, n)
            out[at] = 1 / (1 + np.exp(-np.clip((a + b)[row, column], -60, 60)))
        return out

    def gradient(self, blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]], u: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Of the conditional log-likelihood: by the unary score of each word, by ``t`` and by ``start``.

        A block is (word numbers, labels, sizes): chains in columns, padded with -1, sorted by falling size.
        """
        per_word, grad_t, grad_s = np.zeros(len(u)), np.zeros((2, 2)), 0.0
        for token, y, sizes in blocks:
            real = token >= 0
            e = np.where(real, u[token], 0.0)
            a, b = self.messages(e, sizes)
            rest = np.where(real, y - 1 / (1 + np.exp(-np.clip(a + b, -60, 60))), 0.0)
            per_word += np.bincount(token[real], rest[real], len(u))
            grad_s += rest[0].sum()
            # seen against expected transitions
            t = np.exp(self.t)
            prev, after = np.exp(np.clip(a[:-1], -60, 60)), np.exp(np.clip(e[1:] + b[1:], -60, 60))
            norm = t[0, 0] + t[0, 1] * after + t[1, 0] * prev + t[1, 1] * prev * after
            pair, before, now = real[1:], y[:-1], y[1:]
            for i, j, mass, seen in ((0, 0, 1.0, (1 - before) * (1 - now)), (0, 1, after, (1 - before) * now), (1, 0, prev, before * (1 - now)), (1, 1, prev * after, before * now)):
                grad_t[i, j] += (seen - t[i, j] * mass / norm)[pair].sum()
        return per_word, grad_t, grad_s

    def fit(self, chains: list[list[str]], labels: list[np.ndarray], rounds: int = 30, rate: float = 0.3, decay: float = 1e-4) -> Field:
        """Gradient ascent (Adagrad) on the conditional likelihood, all chains at once."""
        words = sorted({normal(x) for c in chains for x in c})
        number = {w: n for n, w in enumerate(words)}
        numbers = hashed(words)
        here = (numbers < FEATURES) & np.array([bool(w) for w in words])[:, None]
        flat, owner = numbers[here].astype(np.int32), np.repeat(np.arange(len(words), dtype=np.int32), here.sum(1))
        del numbers, here
        order = sorted((n for n in range(len(chains)) if chains[n]), key=lambda n: -len(chains[n]))
        if not order:
            return self
        blocks = []
        for s in range(0, len(order), 4096):
            part = order[s : s + 4096]
            sizes = np.array([len(chains[n]) for n in part])
            token, y = np.full((sizes[0], len(part)), -1, dtype=np.int32), np.zeros((sizes[0], len(part)))
            for c, n in enumerate(part):
                token[: sizes[c], c] = [number[normal(x)] for x in chains[n]]
                y[: sizes[c], c] = labels[n]
            blocks.append((token, y, sizes))
        blank = np.array([not w for w in words])
        w, sum_w = np.zeros(FEATURES), np.full(FEATURES, 1e-8)
        sum_t, sum_s = np.full((2, 2), 1e-8), 1e-8
        n_tokens = sum(sizes.sum() for _, _, sizes in blocks)
        for _ in range(rounds):
            u = np.where(blank, BLANK, np.bincount(owner, w[flat], len(words)))
            per_word, grad_t, grad_s = self.gradient(blocks, u)
            per_word[blank] = 0
            grad = np.bincount(flat, per_word[owner], FEATURES) / n_tokens - decay * w / 100
            sum_w += grad**2
            w += rate * grad / np.sqrt(sum_w)
            sum_t += (grad_t / n_tokens) ** 2
            self.t += rate * grad_t / n_tokens / np.sqrt(sum_t)
            sum_s += (grad_s / n_tokens) ** 2
            self.start += rate * grad_s / n_tokens / np.sqrt(sum_s)
        self.w = w.astype(np.float32)
        self._known.clear()
        return self

    def tagged(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all tokens of the texts in turn: marginal, chain and text number."""
        tokens: list[str] = []
        sizes, owner = [], []
        for n, text in enumerate(texts):
            for line in text.split("\n"):
                words = line.split()
                if words:
                    tokens += words
                    left = len(words)
                    while left > 0:
                        sizes.append(min(left, CHAIN))
                        owner.append(n)
                        left -= CHAIN
        if not tokens:
            return np.zeros(0), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        sizes = np.array(sizes)
        return self.marginals(self.unaries(tokens), sizes), np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.array(owner), sizes)

    def score(self, texts: list[str]) -> list[float]:
        """1 - product of (1 - p) over the three likeliest toxic tokens of each text; 0 without tokens."""
        return self._scores(len(texts), *self.tagged(texts))

    @staticmethod
    def _scores(n: int, p: np.ndarray, chain: np.ndarray, doc: np.ndarray) -> list[float]:
        found = np.flatnonzero(p >= NOTHING)
        found = found[np.lexsort((-p[found], doc[found]))]
        first = np.searchsorted(doc[found], doc[found], side="left")
        top = found[np.arange(len(found)) - first < 3]
        clean = np.ones(n)
        np.multiply.at(clean, doc[top], 1 - p[top])
        return (1 - clean).tolist()

    def judge(self, texts: list[str], at_least: float = 0.5) -> tuple[list[float], list[list[tuple[int, int]]]]:
        """Scores, and the offending spans of texts that score ``at_least``.

        A span is [start, end) in characters of a run of tokens of one chain
        whose marginals exceed one half.
        """
        p, chain, doc = tagged = self.tagged(texts)
        scores = self._scores(len(texts), *tagged)
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        hot = np.flatnonzero(p > 0.5)
        hot = hot[np.array(scores)[doc[hot]] >= at_least]
        new = np.r_[True, (np.diff(hot) != 1) | (chain[hot[1:]] != chain[hot[:-1]])][: len(hot)]
        starts = hot[new]
        ends = hot[np.r_[new[1:], True]] if len(hot) else hot
        held, places, base = -1, [], 0
        for n, a, b in zip(doc[starts].tolist(), starts.tolist(), ends.tolist()):
            if n != held:
                # tokens are the runs of characters other than white space, in order
                held, places, base = n, [m.span() for m in re.finditer(r"\S+", texts[n])], int(np.searchsorted(doc, n))
            spans[n].append((places[a - base][0], places[b - base][1]))
        return scores, spans

    def offending(self, text: str) -> list[tuple[int, int]]:
        """Character spans [start, end) of runs of tokens whose marginal exceeds one half."""
        return self.judge([text], 0.0)[1][0]


def train(toxic_texts: list[str], clean_texts: list[str], seed: int = 5) -> Field:
    """A field from texts by document label; with either side empty it calls nothing toxic.

    Texts are cut anew in every pass and equal tokens share one object, so what
    is held beside the texts is the distinct words and the chosen chains.
    Empty texts give no chains; repeated toxic texts count once.
    """
    shared: dict[str, str] = {}

    def chains_of(text: str) -> list[list[str]]:
        out = []
        for line in text.split("\n"):
            tokens = [shared.setdefault(x, x) for x in line.split()]
            out += [tokens[s : s + TRAINED] for s in range(0, len(tokens), TRAINED)]
        return out

    words = lambda text: {w for x in set(text.split()) if (w := normal(x))}
    field = Field()
    if not toxic_texts or not clean_texts:
        field.start = -20.0
        field.t = np.array([[0.0, -20.0], [0.0, -20.0]])
        return field
    fresh = without_copies(toxic_texts)
    clean_words: set[str] = set()
    for text in clean_texts:
        clean_words |= words(text)
    markers = choose_markers([words(t) for t in fresh], clean_words, len(clean_texts))
    del clean_words
    marked: dict[str, bool] = {}

    def is_toxic(token: str) -> bool:
        if token not in marked:
            w = normal(token)
            marked[token] = bool(w) and any(f in markers for f in marker_features(w))
        return marked[token]

    rng = np.random.default_rng(seed)
    chains, labels, total = [], [], 0
    for text in fresh:
        for chain in chains_of(text):
            y = [is_toxic(x) for x in chain]
            if any(y) or rng.random() < UNMARKED:
                chains.append(chain)
                labels.append(np.array(y, dtype=float))
    for text in clean_texts:
        total += sum(-(-len(line.split()) // TRAINED) for line in text.split("\n"))
    share = max(FIRST_CHAINS, 2 * len(chains)) / max(1, total)
    first = [c for text in clean_texts for c in chains_of(text) if rng.random() < share]
    field.fit(chains + first, labels + [np.zeros(len(c)) for c in first])
    # chains of clean words that look toxic so far join as further examples
    every = list({x for text in clean_texts for x in text.split()})
    scores = dict(zip(every, field.unary(every).tolist()))
    suspects = set(sorted(scores, key=lambda x: (-scores[x], x))[:SUSPECTS])
    del scores, every
    hard = hard_chains(clean_texts, suspects, chains_of)
    return Field().fit(chains + first + hard, labels + [np.zeros(len(c)) for c in first + hard], rounds=50)


def without_copies(texts: list[str], share: float = COPY_SHARE) -> list[str]:
    """Texts of which at most that share of the lines stood in texts before; copies teach nothing new."""
    seen: set[int] = set()
    fresh = []
    for text in texts:
        lines = {zlib.crc32(x.encode("utf-8", "surrogatepass")) for line in text.split("\n") if (x := " ".join(line.split()))}
        if len(lines & seen) <= share * len(lines):
            fresh.append(text)
        seen |= lines
    return fresh


def hard_chains(texts: list[str], suspects: set[str], chains_of: Callable[[str], list[list[str]]]) -> list[list[str]]:
    """Chains with a suspect word, from texts in the order of their hashes, until there are HARD_CHAINS."""
    hard: list[list[str]] = []
    for _, n in sorted((zlib.crc32(text.encode("utf-8", "surrogatepass")), n) for n, text in enumerate(texts)):
        if len(hard) >= HARD_CHAINS:
            break
        if not suspects.isdisjoint(texts[n].split()):
            hard += [c for c in chains_of(texts[n]) if not suspects.isdisjoint(c)]
    return hard


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame) -> Field:
    """Fit on a sample of the labelled documents that are not held out.

    Labels without doc_id or verdict are ignored; a doc_id that is labelled
    more than once is toxic if any label says so, and of the texts of a
    repeated doc_id the smallest counts; null texts count as empty.
    Without labels of both kinds nothing is called toxic.
    """
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    sizes = dict(usable.groupBy("toxic").count().collect())
    # a uniform sample by hash, alike at every size: exactly the bound is expected, or all there are
    share = F.when(F.col("toxic") == 1, TOXIC_SAMPLE / max(sizes.get(1, 0), TOXIC_SAMPLE)).otherwise(CLEAN_SAMPLE / max(sizes.get(0, 0), CLEAN_SAMPLE))
    picked = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    picked = picked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    # rows that share a doc_id are one document, so neither rows nor bytes of the sample grow with the table
    found = found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    # one very long text must not take the place of all that come after it
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    found = found.where(size <= SAMPLE_BYTES // LONG_SHARE)
    upto = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("upto", F.sum(size).over(upto)).where(F.col("upto") <= SAMPLE_BYTES)
    found = found.select("toxic", "text", "doc_id").toArrow().sort_by([("doc_id", "ascending")])
    texts = {0: [], 1: []}
    for y, t in zip(found.column("toxic").to_pylist(), found.column("text").to_pylist()):
        texts[1 if y == 1 else 0].append(t or "")
    del found
    return train(texts[1], texts[0])


def score_documents(docs: DataFrame, field: Field) -> DataFrame:
    """``doc_id, score, predicted, spans`` for every row; null and empty texts score 0.

    Spans are ``[start, end)`` in characters, given where the score reaches
    one half.  Repeated rows and null ids each give a row; no rows give none.
    """
    parts = (field.w, field.t, field.start)

    def make():
        field = Field(*parts)

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            scores, spans = field.judge([t or "" for t in b.column("text").to_pylist()])
            spans = [[{"start": s, "end": e} for s, e in own] for own in spans]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(p >= THRESHOLD) for p in scores], pa.int32()), pa.array(spans, kind)], ["doc_id", "score", "predicted", "spans"])

        return work

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_slices(docs, "text", make, "doc_id long, score double, predicted int, spans array<struct<start: long, end: long>>")


def keep_clean(docs: DataFrame, field: Field) -> DataFrame:
    """The rows whose text is not predicted toxic, all columns kept; scored in place, without a join.

    Null and empty texts stay; repeated rows stay or go together.
    """
    parts = (field.w, field.t, field.start)

    def run(batches):
        own = Field(*parts)
        for b in batches:
            for part in slices(b, "text"):
                keep = [p < THRESHOLD for p in own.score([str(t) if t is not None else "" for t in part.column("text").to_pylist()])]
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op7_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A score for every row of ``documents``, by a field fitted on labels that are not held out; cases as in ``score_documents``."""
    out = score_documents(docs, fit_on(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
