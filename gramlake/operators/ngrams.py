"""From texts and token arrays to prefix -> successor counts.

The model is one relation ``node(k, prefix, successor, n)``: ``n`` times the
token ``successor`` followed ``prefix``, which is ``k`` tokens long.  For a
corpus of tokens x[0..N) and block size B the events are the positions i with
1 <= i <= N - 2: prefix x[max(0, i-B):i], successor x[i].  *Sparse* counts keep
just that prefix; *dense* counts also keep all its shorter suffixes, down to
the empty one.  Sequences of at most B tokens have no events.

Characters are code points.  Grams of characters are cut by one pass of a
lookahead pattern over the text instead of slicing an array of characters, and
dense counts are made from aggregated sparse ones: the corpus is exploded once,
not B + 1 times, and only distinct grams are exploded further.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramlake.operators.prefixes import prefixes

#: Bytes of texts whose grams are counted at once.
COUNTED = 1 << 21


def chars(text: Column) -> Column:
    """Array of code points; the empty text has none."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def spread(docs: DataFrame) -> DataFrame:
    """Deal rows anew where the plan of ``docs`` has fewer tasks than the cluster has cores.

    A small file or two would otherwise be exploded by a few tasks only; where
    the scan itself is split into enough tasks nothing is moved.  Streams and
    plans with a shuffle stay as they are.
    """
    if docs.isStreaming:
        return docs
    cores = docs.sparkSession.sparkContext.defaultParallelism
    scans = docs._jdf.queryExecution().sparkPlan().collectLeaves()
    few = scans.size() == 1 and scans.head().execute().getNumPartitions() < cores
    return docs.repartition(cores) if few else docs


def char_grams(text: Column, block: int, include_start: bool = True, include_last: bool = False) -> Column:
    """All events of a text as strings ``prefix || successor``."""
    full = F.regexp_extract_all(text, F.lit("(?s)(?=(.{%d}))." % (block + 1)), F.lit(1))
    if not include_last:
        full = F.slice(full, F.lit(1), F.greatest(F.size(full) - 1, F.lit(0)))
    if not include_start or block < 2:
        return full
    heads = F.array(*[F.substring(text, 1, i + 1) for i in range(1, block)])
    return F.concat(heads, full)


def sparse_counts(docs: DataFrame, block: int, text: str = "text", by: tuple[str, ...] = (), dealt: bool = False, **events) -> DataFrame:
    """``by..., k, prefix, successor, n`` of full-width (and leading) prefixes of characters.

    Rows that are ``dealt`` out already stay where they are.
    """
    long_enough = docs.where(F.length(text) > block).select(*by, text)
    texts = long_enough if dealt else spread(long_enough)
    if by or docs.isStreaming:
        counts = texts.select(*by, F.explode(char_grams(F.col(text), block, **events)).alias("gram")).groupBy(*by, "gram").agg(F.count("*").alias("n"))
    else:
        counts = texts.mapInArrow(_counted(block, events), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    size = F.length("gram")
    return counts.select(*by, (size - 1).alias("k"), F.expr("substring(gram, 1, length(gram) - 1)").alias("prefix"), F.expr("right(gram, 1)").alias("successor"), "n")


def _counted(block: int, events: dict) -> Callable[[Iterator], Iterator]:
    """Grams of texts, counted a slice of about COUNTED bytes at a time."""
    from gramlake.functions.automaton import slices
    from gramlake.operators.suffixes import gram_counts

    size = COUNTED

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            for part in slices(b.column(0), size):
                yield gram_counts(part, block, **events)

    return run


def densify(node: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Dense counts from sparse ones: every row also counts for all its shorter suffixes."""
    rows = node.select(*by, F.explode(F.sequence(F.lit(0), F.col("k"))).alias("j"), "prefix", "successor", "n")
    rows = rows.select(*by, F.col("j").alias("k"), prefixes(node).last("prefix", "j").alias("prefix"), "successor", "n")
    return rows.groupBy(*by, "k", "prefix", "successor").agg(F.sum("n").alias("n"))


def dense_counts(docs: DataFrame, block: int, text: str = "text", by: tuple[str, ...] = (), **events) -> DataFrame:
    return densify(sparse_counts(docs, block, text, by, **events), by)


def sparsify(node: DataFrame) -> DataFrame:
    """Sparse counts from dense ones: what longer prefixes account for goes; rows of zero go."""
    longer = node.where("k > 0").groupBy((F.col("k") - 1).alias("k"), prefixes(node).rest("prefix").alias("prefix"), "successor").agg(F.sum("n").alias("m"))
    left = node.join(longer, ["k", "prefix", "successor"], "left").withColumn("n", F.col("n") - F.coalesce("m", F.lit(0)))
    return left.where("n > 0").select("k", "prefix", "successor", "n")


def token_events(tokens: DataFrame, block: int, by: tuple[str, ...] = (), column: str = "tokens", include_start: bool = True, include_last: bool = False) -> DataFrame:
    """``by..., k, prefix (array), successor`` per event of token arrays of any type."""
    size = F.size(column)
    last = size if include_last else size - 1
    first = F.lit(2 if include_start else block + 1)
    rows = tokens.where((size > block) & (last >= first)).select(*by, column, F.explode(F.sequence(first, last)).alias("i"))
    k = F.least(F.lit(block), F.col("i") - 1)
    return rows.select(*by, k.alias("k"), F.slice(F.col(column), F.col("i") - k, k).alias("prefix"), F.expr(f"{column}[i - 1]").alias("successor"))


def token_counts(tokens: DataFrame, block: int, by: tuple[str, ...] = (), dense: bool = True, **events) -> DataFrame:
    """Counts of token arrays; prefixes are arrays."""
    sparse = token_events(tokens, block, by, **events).groupBy(*by, "k", "prefix", "successor").agg(F.count("*").alias("n"))
    return densify(sparse, by) if dense else sparse


def with_boundaries(tokens: DataFrame, start: int = 0, end: int = 1, column: str = "tokens") -> DataFrame:
    """Wrap every token array as ``[start] + tokens + [end]``."""
    return tokens.withColumn(column, F.concat(F.array(F.lit(start)), F.col(column), F.array(F.lit(end))))


def delimited_tokens(text: Column, delimiter: str = ",") -> Column:
    """Array of integers from an already encoded text."""
    return F.transform(F.split(text, delimiter), lambda x: x.cast("int"))


def split_segments(docs: DataFrame, segments: int, block: int, column: str = "tokens", by: tuple[str, ...] = ("doc_id",), strict: bool = False) -> DataFrame:
    """Cut sequences into ``segments`` parts that differ by one in size at most.

    Each later part begins with the ``block`` tokens before it.  Sequences with
    N div segments <= block cannot be cut so: they give no rows, or raise if
    ``strict``.
    """
    n = F.size(column)
    share, rest = F.expr(f"size({column}) div {segments}"), n % segments
    fits = share > block
    if strict:
        fits = F.when(fits, F.lit(True)).otherwise(F.raise_error(F.lit(f"a sequence is too short for {segments} segments")).cast("boolean"))
    rows = docs.where(fits).select(*by, column, F.explode(F.sequence(F.lit(0), F.lit(segments - 1))).alias("segment"))
    start = F.col("segment") * share + F.least(F.col("segment"), rest)
    size = share + (F.col("segment") < rest).cast("int")
    back = F.when(F.col("segment") > 0, F.lit(block)).otherwise(F.lit(0))
    return rows.select(*by, "segment", F.slice(F.col(column), start + 1 - back, size + back).alias("part"))


def merge_segments(parts: DataFrame, block: int, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Undo ``split_segments``: ``by..., tokens``."""
    own = F.when(F.col("segment") > 0, F.slice(F.col("part"), F.lit(block + 1), F.size("part"))).otherwise(F.col("part"))
    rows = parts.withColumn("own", own).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("segment", "own"))).alias("all"))
    return rows.select(*by, F.flatten(F.transform("all", lambda x: x["own"])).alias("tokens"))


def segment_counts(parts: DataFrame, block: int, segments: int, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Dense counts over parts that equal those of the uncut sequences.

    The last token of a part is a successor too, but for the last part; a later
    part's leading prefixes belong to the part before.
    """
    ends = parts.where(F.col("segment") == segments - 1)
    first, mid = parts.where((F.col("segment") == 0) & (F.lit(segments) > 1)), parts.where((F.col("segment") > 0) & (F.col("segment") < segments - 1))
    pieces = [
        token_events(first, block, by, "part", True, True),
        token_events(mid, block, by, "part", False, True),
        token_events(ends, block, by, "part", segments == 1, False),
    ]
    return densify(pieces[0].unionByName(pieces[1]).unionByName(pieces[2]).groupBy("k", "prefix", "successor").agg(F.count("*").alias("n")))


def front_and_rest(docs: DataFrame, fraction: float, block: int, column: str = "tokens") -> DataFrame:
    """``train`` = the first floor(fraction * N) tokens, ``valid`` = from block + 1 before there on."""
    cut = F.floor(F.size(column) * F.lit(fraction)).cast("int")
    begin = F.greatest(cut - block - 1, F.lit(0))
    return docs.withColumn("train", F.slice(F.col(column), F.lit(1), cut)).withColumn("valid", F.slice(F.col(column), begin + 1, F.size(column)))
