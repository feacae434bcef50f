"""The model behind one object: the verbs of the library and of its generation service."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramlake.functions.language import Language
from gramlake.operators import interchange, ngrams, sample, score
from gramlake.operators import model as algebra
from gramlake.operators.prefixes import Prefixes, prefixes
from gramlake.sources import readers, scratch, writers

#: Limits of requests.
MAX_PROMPT_CHARS, MAX_PROMPT_BYTES, MAX_PROMPT_TOKENS = 1048, 4192, 1048
MAX_BATCH, MAX_SAMPLES, MAX_STREAM_BATCH, MAX_BATCHES = 65_536, 10, 262_144, 1_000


@dataclass
class Model:
    """A model of characters (prefixes are strings) or tokens (lists of them); verbs return DataFrames or new models."""

    node: DataFrame
    block: int
    dense: bool = True
    language: Language | None = None

    @classmethod
    def parse_all(cls, docs: DataFrame, block: int, dense: bool = True, text: str = "text", **events) -> Model:
        """Count all texts, or all arrays of tokens where ``text`` is such a column."""
        if prefixes(docs, text).tokens:
            counts = ngrams.token_counts(docs.select(F.col(text).alias("tokens")), block, dense=dense, **events)
        else:
            counts = (ngrams.dense_counts if dense else ngrams.sparse_counts)(docs, block, text, **events)
        return cls(counts, block, dense)

    @classmethod
    def load(cls, spark, path: str, block: int) -> Model:
        return cls(readers.model(spark, path), block)

    @classmethod
    def deserialize(cls, spark, data: bytes, block: int, compressed: bool = True, characters: bool = False) -> Model:
        return cls(interchange.model_from_bytes(spark, data, compressed, characters), block)

    @property
    def kind(self) -> Prefixes:
        return prefixes(self.node)

    def _with(self, node: DataFrame, dense: bool | None = None) -> Model:
        return Model(node, self.block, self.dense if dense is None else dense, self.language)

    def save(self, path: str) -> DataFrame:
        return writers.model_by_root(self.node, path)

    def serialize(self, compress: bool = True) -> bytes:
        return interchange.model_bytes(self.node, compress)

    def serialized_trees(self, compress: bool = True) -> DataFrame:
        return interchange.serialized_trees(self.node, compress)

    def json(self, token) -> DataFrame:
        """``prefix, json`` of the part under one root token."""
        return algebra.subtree(self.node, token)

    def densify(self) -> Model:
        return self if self.dense else self._with(ngrams.densify(self.node), True)

    def sparsify(self) -> Model:
        return self._with(ngrams.sparsify(self.node), False) if self.dense else self

    def merge(self, other: Model) -> Model:
        if self.dense != other.dense:
            return self.densify().merge(other.densify())
        return Model(algebra.merge(self.node, other.node), max(self.block, other.block), self.dense, self.language)

    def reduce(self, other: Model) -> Model:
        return self._with(algebra.clean(algebra.reduce_counts(self.node, other.node)))

    def parse(self, prefix, successor) -> Model:
        """The model after one more event."""
        return self._with(algebra.add_event(self.node, prefix, successor, self.dense))

    def remove(self, prefix, successor, n: int = 1) -> Model:
        return self._with(algebra.clean(algebra.remove_count(self.node, prefix, successor, n)))

    def cache(self) -> Model:
        """Write the counts once, so that no later verb counts the corpus again."""
        self.node = scratch.written(self.node, "model")
        return self

    def depth(self) -> int:
        return self.node.agg(F.max("k")).first()[0] or 0

    def size(self) -> int:
        return algebra.size(self.node).first()[0]

    def sizes(self) -> dict[str, int]:
        """``prefixes, patterns, occurrences``."""
        return algebra.sizes(self.node).first().asDict()

    def memory(self) -> int:
        return algebra.memory(self.node).first()[0] or 0

    def prefixes(self) -> DataFrame:
        return algebra.leaves(self.node).select("prefix").distinct()

    def patterns(self) -> DataFrame:
        return algebra.leaves(self.node).select("prefix", "successor")

    def children(self, prefix=None) -> DataFrame:
        return algebra.children(self.node, prefix)

    def get(self, prefix) -> dict:
        """``{successor: n}`` of one prefix, empty if it is not in the model."""
        rows = self.node.join(self._one(prefix), "prefix", "left_semi").collect()
        return {r["successor"]: r["n"] for r in rows}

    def __contains__(self, prefix) -> bool:
        return self.match(prefix)

    def _one(self, prefix) -> DataFrame:
        return self.node.sparkSession.createDataFrame([(prefix,)], self.kind.schema("prefix"))

    def match(self, prefix) -> bool:
        if not len(prefix):
            raise ValueError("the prefix must not be empty")
        return bool(score.matches(self._one(prefix), self.node).take(1))

    def search(self, prefix):
        found = score.longest_suffix(self._one(prefix), self.node).first()
        return found["match"] if found else prefix[:0]

    def match_length(self, prefix) -> int:
        return len(self.search(prefix))

    def probability(self, prefix, successor, back_off: str = "unigram") -> float:
        """Of a successor; ``back_off`` at the longest suffix: ``none``, to the ``unigram``, or ``recursive``."""
        schema = f"{self.kind.schema('prefix')}, successor {self.kind.token_type.simpleString()}"
        rows = self.node.sparkSession.createDataFrame([(self.kind.cut(prefix, self.block), successor)], schema)
        if back_off == "recursive":
            return score.recursive_probabilities(rows, self.node).first()["probability"]
        return score.probabilities(rows, self.node, back_off == "unigram").first()["probability"]

    def perplexity(self, docs: DataFrame, by: tuple[str, ...], text: str = "text") -> DataFrame:
        return score.perplexity(docs, self.node, self.block, by, text)

    def sample(self, prefix, seed: int = 0):
        """One token drawn at the longest known suffix."""
        rows = self._one(self.kind.cut(prefix, self.block)).withColumn("seed", F.lit(seed).cast("long"))
        return sample.sample_next(rows, self.densify().node).first()["successor"]

    def generate(self, prompt, steps: int, samples: int = 1, seed: int = 0) -> list:
        """``samples`` texts (or lists of tokens): the prompt and ``steps`` more tokens."""
        rows = self.node.sparkSession.createDataFrame([(seed + n, prompt) for n in range(samples)], f"sample long, {self.kind.schema('text')}")
        run = sample.generate if steps <= sample.ROUND else sample.generate_long
        return [r["text"] for r in run(rows, self.densify().node, steps, self.block).orderBy("sample").collect()]


class Service:
    """Requests of the generation service, with its checks (``ValueError`` where they fail)."""

    def __init__(self, model: Model, language: Language):
        self.model, self.language = model.densify().cache(), language

    def _prompt(self, text: str | None = None, utf8: bytes | None = None, tokens: list[int] | None = None):
        """The prompt as the model takes it: characters, or tokens of the language."""
        given = [x for x in (text, utf8, tokens) if x is not None]
        if len(given) != 1:
            raise ValueError("give one of text, utf8 and tokens")
        if text is not None and len(text) > MAX_PROMPT_CHARS or utf8 is not None and len(utf8) > MAX_PROMPT_BYTES or tokens is not None and len(tokens) > MAX_PROMPT_TOKENS:
            raise ValueError("the prompt is too long")
        if tokens is not None:
            text = self.language.decode_tokens(tokens)
        text = text if text is not None else utf8.decode("utf-8")
        if not self.model.kind.tokens:
            return text
        return tokens if tokens is not None else self.language.encode_text(text, strict=True)

    def _text(self, drawn) -> str:
        return self.language.decode_tokens(drawn) if self.model.kind.tokens else drawn

    @staticmethod
    def _within(name: str, value: int, most: int, least: int = 1) -> None:
        if not least <= value <= most:
            raise ValueError(f"{name} must be from {least} to {most}")

    def get_valid_text(self) -> list[str]:
        return list(self.language.pieces)

    def is_valid_text(self, text: str) -> tuple[str, bool]:
        spark = self.model.node.sparkSession
        row = spark.createDataFrame([(text,)], "t string").select(self.language.is_valid(F.col("t"))).first()
        return text, bool(row[0])

    def get_model_block_size(self) -> int:
        return self.model.depth()

    def generate_batch(self, batch_size: int, samples: int = 1, request_id: str | None = None, seed: int = 0, instrument: bool = False, **prompt):
        """``samples`` independent texts, each the prompt and ``batch_size`` more tokens.

        With ``instrument`` a pair of the texts and the statistics of the run:
        ``gen_time_ns`` and ``gen_freq_ns``, the time per token drawn.
        """
        if request_id is not None:
            uuid.UUID(request_id)
        self._within("batch_size", batch_size, MAX_BATCH)
        self._within("samples", samples, MAX_SAMPLES)
        start = self._prompt(**prompt)
        began = time.perf_counter_ns()
        texts = [self._text(x) for x in self.model.generate(start, batch_size, samples, seed)]
        took = time.perf_counter_ns() - began
        return (texts, {"gen_time_ns": took, "gen_freq_ns": took / (batch_size * samples)}) if instrument else texts

    def generate_stream(self, batch_size: int, max_batches: int, seed: int = 0, instrument: bool = False, **prompt) -> Iterator:
        """Chunks of one long text; each goes on from the last tokens of the one before.

        With ``instrument`` each chunk comes with its statistics.
        """
        self._within("batch_size", batch_size, MAX_STREAM_BATCH)
        self._within("max_batches", max_batches, MAX_BATCHES, 0)
        last = self._prompt(**prompt)
        for n in range(max_batches):
            tail = self.model.kind.cut(last, self.model.block)
            began = time.perf_counter_ns()
            (last,) = self.model.generate(tail, batch_size, 1, seed + n)
            took = time.perf_counter_ns() - began
            text = self._text(last[len(tail) :])
            yield (text, {"gen_time_ns": took, "gen_freq_ns": took / batch_size}) if instrument else text

    def answer(self, verb: str, request: dict) -> Iterator[dict]:
        """Requests and answers as plain dicts (one answer, or several of a stream)."""
        if verb == "valid_text":
            yield {"text": self.get_valid_text()}
        elif verb == "is_valid_text":
            text, valid = self.is_valid_text(request["text"])
            yield {"text": text, "valid": valid}
        elif verb == "model_block_size":
            yield {"size": self.get_model_block_size()}
        elif verb == "generate_batch":
            out = self.generate_batch(**request)
            yield {"result": out[0], "stats": out[1]} if request.get("instrument") else {"result": out}
        elif verb == "generate_stream":
            for out in self.generate_stream(**request):
                yield {"result": out[0], "stats": out[1]} if request.get("instrument") else {"result": out}
        else:
            raise KeyError(verb)

    def answer_json(self, verb: str, request: str) -> Iterator[str]:
        for out in self.answer(verb, json.loads(request or "{}")):
            yield json.dumps(out, ensure_ascii=False)
