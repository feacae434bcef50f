"""Prefixes are strings of characters or arrays of tokens; the same expressions for both.

A model over characters keeps ``prefix`` as a string and one character per
token; a model over any other vocabulary keeps arrays.  Which one it is
follows from the column's type.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType


@dataclass(frozen=True)
class Prefixes:
    """Expressions over one kind of prefix; ``type`` is that of the column."""

    type: DataType

    @property
    def tokens(self) -> bool:
        return isinstance(self.type, ArrayType)

    @property
    def token_type(self) -> DataType:
        return self.type.elementType if self.tokens else StringType()

    def size(self, prefix: str) -> Column:
        return F.size(prefix) if self.tokens else F.length(prefix)

    def last(self, prefix: str, n: str) -> Column:
        """The last ``n`` (a column's name) tokens."""
        return F.expr(f"slice({prefix}, size({prefix}) - {n} + 1, {n})" if self.tokens else f"right({prefix}, {n})")

    def rest(self, prefix: str) -> Column:
        """Without the first token."""
        return F.expr(f"slice({prefix}, 2, size({prefix}))" if self.tokens else f"substring({prefix}, 2)")

    def root(self, prefix: str) -> Column:
        """The token that a prefix ends in."""
        return F.expr(f"element_at({prefix}, -1)" if self.tokens else f"right({prefix}, 1)")

    def extend(self, prefix: str, token: str) -> Column:
        return F.expr(f"concat({prefix}, array({token}))" if self.tokens else f"concat({prefix}, {token})")

    def text(self, prefix: str, between: str = " ") -> Column:
        """A readable form: characters as they are, tokens with ``between``."""
        return F.array_join(F.col(prefix).cast("array<string>"), between) if self.tokens else F.col(prefix)

    def schema(self, *names: str) -> str:
        return ", ".join(f"{n} {self.type.simpleString()}" for n in names)

    def cut(self, prefix, n: int):
        """The last ``n`` tokens of a prefix in Python."""
        return prefix[len(prefix) - min(n, len(prefix)) :]


def prefixes(df: DataFrame, column: str = "prefix") -> Prefixes:
    return Prefixes(df.schema[column].dataType)
