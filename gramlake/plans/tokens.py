"""Queries over models of tokens (arrays of numbers), and the same in SQL.

The tokens are those of the catalog's small vocabulary; prefixes are shown as
numbers with spaces between.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramlake.operators import model, ngrams, sample, score
from gramlake.operators.prefixes import prefixes
from gramlake.plans import catalog
from gramlake.plans.catalog import BLOCK, CDF, LEAVES, PROBABILITY, STEPS, SUFFIX
from gramlake.sources import writers

PROMPTS = ((2, 10), (1,), (99, 98), ())


def _tokens(s: SparkSession, d: str, name: str) -> DataFrame:
    rows = ngrams.spread(s.read.parquet(f"{d}/{name}.parquet"))
    return rows.withColumn("tokens", catalog._greedy().encode(F.col("text")))


def _node(s, d, name: str = "documents") -> DataFrame:
    return ngrams.token_counts(_tokens(s, d, name), BLOCK)


def _windows(s, d) -> DataFrame:
    return score.token_windows(_tokens(s, d, "benchmark"), BLOCK, ()).select("prefix", "successor")


def shown(df: DataFrame, *columns: str) -> DataFrame:
    """Arrays of tokens as text."""
    out = df
    for c in columns:
        out = out.withColumn(c, prefixes(df, c).text(c))
    return out


def _prompts(s) -> DataFrame:
    return s.createDataFrame([(n, list(p)) for n, p in enumerate(PROMPTS)], "sample long, text array<int>")


def _last_tokens(s, d) -> DataFrame:
    cut = F.slice("tokens", F.greatest(F.size("tokens") - BLOCK, F.lit(0)) + 1, F.lit(BLOCK))
    return _tokens(s, d, "benchmark").select(F.col("item_id").alias("seed"), cut.alias("prefix"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    perplexity = lambda s, d: score.perplexity(_tokens(s, d, "benchmark"), _node(s, d), BLOCK, ("item_id",), "tokens")
    return {
        "token_ngram_counts": lambda s, d: shown(_node(s, d), "prefix"),
        "token_sparsify": lambda s, d: shown(ngrams.sparsify(_node(s, d)), "prefix"),
        "token_model_sizes": lambda s, d: model.sizes(_node(s, d)),
        "token_list_prefixes": lambda s, d: shown(model.leaves(_node(s, d)).select("prefix").distinct(), "prefix"),
        "token_list_patterns": lambda s, d: shown(model.leaves(_node(s, d)).select("prefix", "successor"), "prefix"),
        "token_model_merge": lambda s, d: shown(model.merge(_node(s, d, "benchmark"), _node(s, d, "conversations")), "prefix"),
        "token_model_verify": lambda s, d: model.verify(model.reduce_counts(_node(s, d), _node(s, d).where("k = 0"))).groupBy("k").agg(F.count("*").alias("bad")),
        "token_partition_stats": lambda s, d: writers.part_stats(_node(s, d)),
        "token_top_successors": lambda s, d: shown(model.top_successors(_node(s, d), 2).select("prefix", "successor", "n", "place"), "prefix"),
        "token_subtree_json": lambda s, d: shown(model.subtree(_node(s, d), 5), "prefix").select("prefix", F.get_json_object("json", "$.total").cast("long").alias("total")),
        "token_match": lambda s, d: shown(score.matches(_windows(s, d), _node(s, d, "conversations")), "prefix"),
        "token_unmatched": lambda s, d: shown(score.misses(_windows(s, d), _node(s, d, "conversations")), "prefix"),
        "token_search": lambda s, d: shown(score.longest_suffix(_windows(s, d), _node(s, d, "conversations")), "prefix", "match"),
        "token_probability": lambda s, d: shown(score.probabilities(_windows(s, d), _node(s, d, "conversations")), "prefix"),
        "token_recursive_probability": lambda s, d: shown(score.recursive_probabilities(_windows(s, d), _node(s, d, "conversations")), "prefix"),
        "token_perplexity": lambda s, d: perplexity(s, d).select("item_id", "windows", *(F.round(c, 6).alias(c) for c in ("lg_pp", "perplexity"))),
        "token_sample": lambda s, d: shown(sample.sample_next(_last_tokens(s, d), _node(s, d)), "prefix"),
        "token_generate": lambda s, d: shown(sample.generate(_prompts(s), _node(s, d), STEPS, BLOCK), "text"),
        "token_generate_long": lambda s, d: shown(sample.generate_long(_prompts(s), _node(s, d), STEPS, BLOCK), "text"),
        "token_generate_greedy": lambda s, d: shown(sample.generate(_prompts(s), _node(s, d), STEPS, BLOCK, greedy=True), "text"),
    }


# --- SQL: prefixes are lists -----------------------------------------------------------------------


def _of_lists(sql: str) -> str:
    pairs = (("substr(prefix, 2)", "prefix[2:len(prefix)]"), ("substr(i.prefix, 2)", "i.prefix[2:len(i.prefix)]"), ("right(q.prefix, c.k)", "q.prefix[len(q.prefix) - c.k + 1:len(q.prefix)]"), ("length(q.prefix)", "len(q.prefix)"))
    for a, b in pairs:
        sql = sql.replace(a, b)
    return sql


def _sparse(name: str, table: str, first: int = 2, last: bool = False, key: str = "") -> str:
    by = f"{key}, " if key else ""
    back = ", ".join(f"lag(t, {i}) OVER w" for i in range(BLOCK, 0, -1))
    return f"""
{name}_t AS (SELECT {by}{catalog._tokens_sql()} AS c, row_number() OVER () AS r FROM {table}),
{name}_f AS (SELECT {by}r, len(c) AS len, unnest(c) AS t, unnest(range(1, len(c) + 1)) AS pos FROM {name}_t WHERE len(c) > {BLOCK}),
{name}_e AS (SELECT {by}pos, len, t, list_filter([{back}], lambda x: x IS NOT NULL) AS prefix FROM {name}_f WINDOW w AS (PARTITION BY r ORDER BY pos)),
{name} AS (SELECT {by}least({BLOCK}, pos - 1)::INT AS k, prefix, t AS successor, count(*)::BIGINT AS n
  FROM {name}_e WHERE pos >= {first} AND pos < len + {int(last)} GROUP BY ALL)"""


def _dense(name: str, table: str) -> str:
    return _sparse(name + "_s", table) + f""",
{name} AS (SELECT j::INT AS k, prefix[len(prefix) - j + 1:len(prefix)] AS prefix, successor, sum(n)::BIGINT AS n
  FROM (SELECT *, unnest(range(0, k + 1)) AS j FROM {name}_s) GROUP BY ALL)"""


def oracle_sql() -> dict[str, str]:
    node, conv, bench = _dense("node", "documents"), _dense("node", "conversations"), _dense("a", "benchmark")
    with_ = catalog._with
    text = lambda c="prefix": f"array_to_string({c}, ' ') AS {c.split('.')[-1]}"
    windows = _sparse("windows_s", "benchmark", BLOCK + 1, True, "item_id") + """,
windows AS (SELECT item_id, prefix, successor, n AS times FROM windows_s),
queries AS (SELECT DISTINCT prefix, successor FROM windows)"""
    leaves, suffix = _of_lists(LEAVES), _of_lists(SUFFIX)
    per = "(SELECT prefix, count(*) AS c, sum(n) AS n FROM leaves GROUP BY prefix)"
    rows = ", ".join(f"({n}, {(n * sample.MULTIPLIER + sample.INCREMENT) % sample.MODULUS}, {list(p)}::INT[])" for n, p in enumerate(PROMPTS))
    prompts = f"prompts AS (SELECT * FROM (VALUES {rows}) AS t(sample, r, text))"
    ranked = "(SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY n DESC, successor) AS place FROM node)"

    def recursive(steps: str, greedy: bool) -> str:
        body = catalog.generated_sql(STEPS, greedy, lists=True)
        return "WITH RECURSIVE " + ", ".join((node, steps, prompts, body)) + f" SELECT sample, array_to_string(text, ' ') AS text FROM g WHERE step = {STEPS}"

    drawn = recursive(CDF + ", steps AS (SELECT k, prefix, successor, lo, hi, total FROM cdf)", False)
    seed = "((seed * 1103515245 + 12345) % 2147483648) / 2147483648.0"
    merged = "merged AS (SELECT k, prefix, successor, sum(n)::BIGINT AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL)"
    return {
        "token_ngram_counts": with_(node, then=f"SELECT k, {text()}, successor, n FROM node"),
        "token_sparsify": with_(_sparse("s", "documents"), then=f"SELECT k, {text()}, successor, n FROM s"),
        "token_model_sizes": with_(node, leaves, then=f"SELECT count(*) AS prefixes, sum(c)::BIGINT AS patterns, sum(n)::BIGINT AS occurrences FROM {per}"),
        "token_list_prefixes": with_(node, leaves, then=f"SELECT DISTINCT {text()} FROM leaves"),
        "token_list_patterns": with_(node, leaves, then=f"SELECT {text()}, successor FROM leaves"),
        "token_model_merge": with_(bench, _dense("b", "conversations"), merged, then=f"SELECT k, {text()}, successor, n FROM merged"),
        "token_model_verify": with_(node, then="SELECT 0 AS k, count(DISTINCT successor) AS bad FROM node WHERE k = 1"),
        "token_partition_stats": with_(node, then="SELECT prefix[len(prefix)] AS root, count(*) AS rows, sum(4 * k + 12)::BIGINT AS rawbytes FROM node WHERE k > 0 GROUP BY 1"),
        "token_top_successors": with_(node, then=f"SELECT {text()}, successor, n, place::INT AS place FROM {ranked} WHERE place <= 2"),
        "token_subtree_json": with_(node, then=f"SELECT {text()}, sum(n)::BIGINT AS total FROM node WHERE k > 0 AND prefix[len(prefix)] = 5 GROUP BY prefix"),
        "token_match": with_(conv, windows, then=f"SELECT {text()}, successor FROM queries q SEMI JOIN (SELECT prefix FROM node WHERE k > 0) i USING (prefix)"),
        "token_unmatched": with_(conv, windows, then=f"SELECT {text()}, successor FROM queries q ANTI JOIN (SELECT prefix FROM node WHERE k > 0) i USING (prefix)"),
        "token_search": with_(conv, windows, suffix, then=f"SELECT {text()}, {text('match')}, match_length, total FROM found"),
        "token_probability": with_(conv, windows, suffix, PROBABILITY, then=f"SELECT {text()}, successor, match_length, CASE WHEN own > 0 THEN own ELSE unigram END AS probability FROM probs"),
        "token_recursive_probability": with_(conv, windows, _of_lists(catalog.RECURSIVE), then=f"SELECT {text()}, successor, match_length, probability FROM backed"),
        "token_perplexity": with_(node, windows, suffix, PROBABILITY, catalog.PERPLEXITY, then="SELECT item_id, windows, round(lg_pp, 6) AS lg_pp, round(pow(2, lg_pp), 6) AS perplexity FROM per"),
        "token_sample": with_(node, CDF, f"queries AS (SELECT item_id AS seed, c[greatest(len(c) - {BLOCK}, 0) + 1:len(c)] AS prefix FROM (SELECT item_id, {catalog._tokens_sql()} AS c FROM benchmark))", suffix, then=f"SELECT seed, {text('q.prefix')}, f.match_length, c.successor FROM queries q JOIN found f ON q.prefix = f.prefix JOIN cdf c ON c.prefix = f.match AND lo <= {seed} * c.total AND {seed} * c.total < hi"),
        "token_generate": drawn,
        "token_generate_long": drawn,
        "token_generate_greedy": recursive(f"steps AS (SELECT k, prefix, successor FROM {ranked} WHERE place = 1)", True),
    }
