"""The engine's queries over the given tables, and the same in SQL.

Each query runs over whole tables and whole texts.  The SQL is written apart
from the engine: texts are cut into lists of characters and counted directly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from gramlake.functions import language as lang
from gramlake.functions.language import Language
from gramlake.operators import charcount, documents, model, ngrams, sample, score
from gramlake.sources import readers, writers
from gramlake.streaming import counts as streaming

BLOCK = 3
SEGMENTS = 3
#: A small vocabulary of overlapping pieces.
PIECES = ("tion", "ing", "the", "and", "en", "er", "th", "on", "an", "in", " ", "a", "e", "h", "i", "n", "o", "r", "s", "t", ".", ",")
#: What a text may hold to be valid in the query of that name.
PLAIN = tuple("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ .,\n")
PROMPTS = ("the ", "on", "Qu", "zz", "")
STEPS = 8


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(s, d):
    return _t(s, d, "documents")


def _node(s, d, table: str = "documents") -> DataFrame:
    return ngrams.dense_counts(_t(s, d, table), BLOCK)


def _greedy() -> Language:
    return Language({p: n for n, p in enumerate(PIECES)})


def _prompts(s) -> DataFrame:
    return s.createDataFrame([(n, p) for n, p in enumerate(PROMPTS)], "sample long, text string")


def _queries_of(s, d) -> DataFrame:
    """Distinct windows of the benchmark items: prefixes to look up, and what follows them."""
    return score.windows(_t(s, d, "benchmark"), BLOCK, ()).select("prefix", "successor")


def _code_points(df: DataFrame) -> DataFrame:
    return df.withColumn("tokens", F.transform(ngrams.chars(F.col("text")), lambda c: F.ascii(c)))


# --- queries -------------------------------------------------------------------------------------


def char_language_encoded(s, d):
    docs = _docs(s, d).select("doc_id", "text")
    tokens = Language.from_corpus(docs).encode(F.col("text"))
    return ngrams.spread(docs).select("doc_id", F.array_join(tokens.cast("array<string>"), " ").alias("tokens"))


def decode_roundtrip(s, d):
    docs = _docs(s, d).select("doc_id", "text")
    language = Language.from_corpus(docs)
    return ngrams.spread(docs).select("doc_id", language.decode(language.encode(F.col("text"))).alias("decoded"))


def encode_greedy_suffix(s, d):
    tokens = _greedy().encode(F.col("text"))
    return ngrams.spread(_docs(s, d).select("doc_id", "text")).select("doc_id", F.array_join(tokens.cast("array<string>"), " ").alias("tokens"))


def language_valid_text(s, d):
    """The pieces that the language accepts, and how often the documents use them."""
    used = ngrams.spread(_docs(s, d).select("text")).select(F.explode(_greedy().encode(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return _greedy().vocab(s).join(used, "token", "left").select("piece", "token", F.coalesce("n", F.lit(0)).alias("n"))


def tokenize_documents(s, d):
    ids = F.concat(_greedy().encode(F.col("text")), F.array(F.lit(len(PIECES))))
    return ngrams.spread(_docs(s, d).select("doc_id", "text")).select(F.col("doc_id").cast("string").alias("id"), F.array_join(ids.cast("array<string>"), " ").alias("encoded"))


def token_length_histogram(s, d):
    rows = ngrams.spread(_docs(s, d).select("text")).select(F.explode(_greedy().split(F.col("text"))).alias("piece"))
    return lang.length_histogram(rows)


def parse_delimited_tokens(s, d):
    flat = tokenize_documents(s, d)
    ids = ngrams.delimited_tokens(F.col("encoded"), " ")
    return flat.select("id", F.size(ids).alias("n_tokens"), F.aggregate(ids, F.lit(0).cast("long"), lambda a, x: a + x).alias("sum_tokens"))


def ngram_doc_boundaries(s, d):
    tokens = ngrams.with_boundaries(_code_points(_t(s, d, "conversations")))
    counts = ngrams.token_counts(tokens, 2)
    return counts.select("k", F.array_join(F.col("prefix").cast("array<string>"), " ").alias("prefix"), "successor", "n")


def ngram_window_frame(s, d):
    frame = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-BLOCK, -1)
    rows = _t(s, d, "events").withColumn("prefix", F.array_join(F.collect_list("event_type").over(frame), " "))
    return rows.where("prefix <> ''").groupBy("prefix", F.col("event_type").alias("successor")).agg(F.count("*").alias("n"))


def event_transitions(s, d):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = _t(s, d, "events").withColumn("before", F.lag("event_type").over(order))
    return rows.where("before is not null").groupBy("before", F.col("event_type").alias("after")).agg(F.count("*").alias("n"))


def prefix_views(s, d):
    """Views of each item: first and last token, without either, and the first and last three."""
    c = ngrams.chars(F.col("text"))
    join = lambda x: F.array_join(x, "")
    rows = _t(s, d, "benchmark").where("length(text) > 0")
    return rows.select("item_id", F.get(c, F.lit(0)).alias("first"), F.element_at(c, -1).alias("last"), join(F.slice(c, F.lit(2), F.size(c))).alias("popped"), join(F.slice(c, F.lit(1), F.size(c) - 1)).alias("shortened"), join(F.slice(c, 1, 3)).alias("head"), F.expr("right(text, 3)").alias("tail"))


def densify_equals_dense(s, d):
    """Rows in which direct dense counts and densified sparse ones differ: none."""
    tokens = _t(s, d, "conversations").select(ngrams.chars(F.col("text")).alias("tokens"))
    direct = ngrams.token_events(tokens, BLOCK).select(F.explode(F.sequence(F.lit(0), F.col("k"))).alias("j"), "prefix", "successor", "k")
    direct = direct.select(F.col("j").alias("k"), F.array_join(F.slice("prefix", F.col("k") - F.col("j") + 1, F.col("j")), "").alias("prefix"), "successor").groupBy(*model.KEY).agg(F.count("*").alias("n"))
    other = _node(s, d, "conversations").select(*model.KEY, F.col("n").alias("m"))
    both = direct.join(other, model.KEY, "full")
    return both.agg(F.count("*").alias("nodes"), F.coalesce(F.sum(F.when(F.col("n").eqNullSafe(F.col("m")), 0).otherwise(1)), F.lit(0)).alias("different"))


def sampler_reduce(s, d):
    """Merge two unigram models, then take one away again: the other is left."""
    one, two = (_node(s, d, t).where("k = 0") for t in ("benchmark", "conversations"))
    return model.clean(model.reduce_counts(model.merge(one, two), two)).select("successor", "n")


def model_summary(s, d):
    events = _docs(s, d).where(F.length("text") > BLOCK).agg(F.sum(F.length("text") - 2).cast("long").alias("events"))
    return model.sizes(_node(s, d)).crossJoin(F.broadcast(events)).select("prefixes", "patterns", "occurrences", "events", (F.col("prefixes") / F.col("events")).alias("prefix_share"), (F.col("patterns") / F.col("prefixes")).alias("per_prefix"))


def per_document_model_stats(s, d):
    rows = documents.document_models(_docs(s, d).select("doc_id", "text"), BLOCK).where("events > 0")
    return rows.select("doc_id", "in_bytes", "prefixes", "patterns", "occurrences", "depth", "out_bytes")


def per_label_models(s, d):
    """Unigram models of the documents of each toxic label, merged per label."""
    rows = _docs(s, d).join(_t(s, d, "labels").select("doc_id", "toxic"), "doc_id")
    return ngrams.sparse_counts(rows, 1, by=("toxic",))


def sample_next_token(s, d):
    """One draw for every conversation turn from the unigram model."""
    seeds = _t(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seed"), F.lit("").alias("prefix")).distinct()
    return sample.sample_next(seeds, _node(s, d).where("k = 0")).select("seed", "successor")


def sample_backoff(s, d):
    seeds = _t(s, d, "benchmark").select(F.col("item_id").alias("seed"), F.expr(f"right(text, {BLOCK})").alias("prefix"))
    return sample.sample_next(seeds, _node(s, d))


def _flat_parts(s, d) -> DataFrame:
    docs = _t(s, d, "benchmark").select("item_id", ngrams.chars(F.col("text")).alias("tokens"))
    return ngrams.split_segments(docs, SEGMENTS, BLOCK, by=("item_id",))


def split_segments(s, d):
    return _flat_parts(s, d).select("item_id", "segment", F.lit(SEGMENTS).alias("num_segments"), F.lit(BLOCK).alias("block_size"), F.array_join("part", "").alias("text"))


def split_roundtrip(s, d):
    back = ngrams.merge_segments(_flat_parts(s, d), BLOCK, ("item_id",))
    return back.select("item_id", F.array_join("tokens", "").alias("text"))


def split_model(s, d):
    """Counts over the parts, which equal those over whole items."""
    counts = ngrams.segment_counts(_flat_parts(s, d), BLOCK, SEGMENTS, ("item_id",))
    return counts.select("k", F.array_join("prefix", "").alias("prefix"), "successor", "n")


def train_validation_split(s, d):
    docs = _docs(s, d).select("doc_id", ngrams.chars(F.col("text")).alias("tokens"))
    both = ngrams.front_and_rest(docs, 0.75, BLOCK)
    return both.select("doc_id", F.array_join("train", "").alias("train"), F.array_join("valid", "").alias("valid"))


def _prefixes(s, d, table: str) -> DataFrame:
    return _node(s, d, table).where("k > 0").select("k", "prefix").distinct()


def stream_char_counts(s, d):
    """The documents as a stream, counted until there is no more: as the batch query."""
    import uuid

    name = "gramlake_stream_" + uuid.uuid4().hex
    table = _docs(s, d)
    path = f"{d}/documents.parquet"
    import posixpath

    stream = s.readStream.schema(table.schema).option("pathGlobFilter", "*.parquet").parquet(path if len(table.inputFiles()) > 1 else posixpath.dirname(path) + "/documents.parq*")
    run = streaming.char_counts(stream).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    return s.table(name).select("char", "n")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    on_node = lambda f, table="documents": lambda s, d: f(_node(s, d, table))
    return {
        "next_token_distribution": on_node(model.histogram),
        "char_counts": lambda s, d: charcount.char_counts(_docs(s, d)),
        "char_counts_pages": lambda s, d: charcount.char_counts(_t(s, d, "pages"), "html"),
        "char_counts_lines": lambda s, d: charcount.char_counts_of_lines(_docs(s, d)).groupBy("char").agg(F.sum("n").alias("n")),
        "char_counts_filtered": lambda s, d: charcount.char_counts(_docs(s, d), exclude=(" ", "e", "\x00")),
        "char_count_text": lambda s, d: charcount.char_counts(_docs(s, d)).select(F.format_string("%s: %d", "char", "n").alias("line")),
        "stream_char_counts": stream_char_counts,
        "char_language": lambda s, d: lang.char_language(_docs(s, d)),
        "char_language_first_seen": lambda s, d: lang.char_language_first_seen(_docs(s, d)),
        "language_json": lambda s, d: lang.vocab_from_json(lang.language_json(lang.char_language(_docs(s, d)))),
        "language_valid_text": language_valid_text,
        "encode_chars": char_language_encoded,
        "decode_roundtrip": decode_roundtrip,
        "encode_greedy_suffix": encode_greedy_suffix,
        "is_valid_text": lambda s, d: _docs(s, d).select("doc_id", Language({c: n for n, c in enumerate(PLAIN)}).is_valid(F.col("text")).alias("valid")),
        "token_length_histogram": token_length_histogram,
        "tokenize_documents": tokenize_documents,
        "parse_delimited_tokens": parse_delimited_tokens,
        "ngram_counts_dense": _node,
        "ngram_counts_sparse": lambda s, d: ngrams.sparse_counts(_docs(s, d), BLOCK),
        "ngram_counts_full_window": lambda s, d: ngrams.sparse_counts(_docs(s, d), BLOCK, include_start=False),
        "ngram_counts_with_last": lambda s, d: ngrams.sparse_counts(_docs(s, d), BLOCK, include_last=True),
        "ngram_doc_boundaries": ngram_doc_boundaries,
        "ngram_window_frame": ngram_window_frame,
        "event_transitions": event_transitions,
        "prefix_views": prefix_views,
        "densify_equals_dense": densify_equals_dense,
        "sparsify": lambda s, d: ngrams.sparsify(_node(s, d)),
        "model_merge": lambda s, d: model.merge(_node(s, d, "benchmark"), _node(s, d, "conversations")),
        "sampler_merge": lambda s, d: model.merge(*(_node(s, d, t).where("k = 0") for t in ("benchmark", "conversations"))).select("successor", "n"),
        "sampler_reduce": sampler_reduce,
        "sampler_verify": lambda s, d: model.verify(_node(s, d)).agg(F.count("*").alias("bad")),
        "model_by_root_token": on_node(model.by_root),
        "count_prefixes": lambda s, d: model.sizes(_node(s, d)).select("prefixes"),
        "count_patterns": lambda s, d: model.sizes(_node(s, d)).select("patterns"),
        "model_occurrences": lambda s, d: model.sizes(_node(s, d)).select("occurrences"),
        "list_prefixes": lambda s, d: model.leaves(_node(s, d)).select("prefix").distinct(),
        "list_patterns": lambda s, d: model.leaves(_node(s, d)).select("prefix", "successor"),
        "model_memory": on_node(model.memory),
        "model_depth": on_node(model.depth),
        "model_summary": model_summary,
        "per_document_model_stats": per_document_model_stats,
        "per_label_models": per_label_models,
        "model_partition_stats": on_node(writers.part_stats),
        "unigram_histogram": lambda s, d: model.histogram(_node(s, d).where("k = 0")).select("successor", "n", "probability"),
        "top_k_successors": lambda s, d: model.top_successors(_node(s, d), 3).select("prefix", "successor", "n", "place"),
        "most_likely_next": on_node(model.most_likely),
        "match_prefixes": lambda s, d: score.matches(_queries_of(s, d), _node(s, d)),
        "unmatched_prefixes": lambda s, d: score.misses(_queries_of(s, d), _node(s, d, "conversations")),
        "search_longest_suffix": lambda s, d: score.longest_suffix(_queries_of(s, d), _node(s, d, "conversations")).select("prefix", "match"),
        "match_length": lambda s, d: score.longest_suffix(_queries_of(s, d), _node(s, d, "conversations")).groupBy("match_length").agg(F.count("*").alias("n")),
        "suffix_probability": lambda s, d: score.probabilities(_queries_of(s, d), _node(s, d, "conversations"), back_off_at_zero=False),
        "backoff_probability": lambda s, d: score.probabilities(_queries_of(s, d), _node(s, d, "conversations")),
        "recursive_probability": lambda s, d: score.recursive_probabilities(_queries_of(s, d), _node(s, d, "conversations")),
        "perplexity": lambda s, d: score.perplexity(_t(s, d, "benchmark"), _node(s, d, "documents"), BLOCK, ("item_id",)).select("item_id", "windows", *(F.round(c, 6).alias(c) for c in ("lg_pp", "perplexity", "lg_squared"))),
        "sample_next_token": sample_next_token,
        "sample_backoff": sample_backoff,
        "generate_greedy": lambda s, d: sample.generate(_prompts(s), _node(s, d), STEPS, BLOCK, greedy=True),
        "generate_seeded": lambda s, d: sample.generate(_prompts(s), _node(s, d), STEPS, BLOCK),
        "generate_long": lambda s, d: sample.generate_long(_prompts(s), _node(s, d), STEPS, BLOCK),
        "split_segments": split_segments,
        "split_roundtrip": split_roundtrip,
        "split_model": split_model,
        "train_validation_split": train_validation_split,
        "model_prefix_intersect": lambda s, d: _prefixes(s, d, "benchmark").intersect(_prefixes(s, d, "conversations")),
        "model_prefix_except": lambda s, d: _prefixes(s, d, "benchmark").exceptAll(_prefixes(s, d, "conversations")),
        "gs_url_parts": lambda s, d: _t(s, d, "pages").select("page_id", readers.url_parts(F.col("url")).alias("u")).select("page_id", "u.bucket", "u.key"),
        "text_sha1": lambda s, d: _docs(s, d).select("doc_id", F.sha1("text").alias("sha1")),
        "json_lines": lambda s, d: writers.as_json(_t(s, d, "labels").select("doc_id", "quality")),
        "subtree_json_rows": lambda s, d: model.subtree(_node(s, d), "q"),
    }


# --- SQL -----------------------------------------------------------------------------------------


def _before(column: str, block: int = BLOCK) -> str:
    return "concat(" + ", ".join(f"lag({column}, {i}) OVER w" for i in range(block, 0, -1)) + ")"


def _sparse(name: str, table: str, first: int = 2, last: bool = False, block: int = BLOCK, key: str = "") -> str:
    by = f"{key}, " if key else ""
    return f"""
{name}_f AS (SELECT {by}r, length(text) AS len, unnest(string_split(text, '')) AS ch, unnest(range(1, length(text) + 1)) AS pos
  FROM (SELECT {by}text, row_number() OVER () AS r FROM {table} WHERE length(text) > {block})),
{name}_e AS (SELECT {by}pos, len, ch, {_before('ch', block)} AS prefix FROM {name}_f WINDOW w AS (PARTITION BY r ORDER BY pos)),
{name} AS (SELECT {by}least({block}, pos - 1)::INT AS k, prefix, ch AS successor, count(*)::BIGINT AS n
  FROM {name}_e WHERE pos >= {first} AND pos < len + {int(last)} GROUP BY ALL)"""


def _dense(name: str, table: str) -> str:
    return _sparse(name + "_s", table) + f""",
{name} AS (SELECT j::INT AS k, right(prefix, j) AS prefix, successor, sum(n)::BIGINT AS n
  FROM (SELECT *, unnest(range(0, k + 1)) AS j FROM {name}_s) GROUP BY ALL)"""


def _with(*parts: str, then: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + then


LEAVES = """inner_ AS (SELECT DISTINCT k - 1 AS k, substr(prefix, 2) AS prefix FROM node WHERE k > 1),
leaves AS (SELECT n.* FROM node n ANTI JOIN inner_ i ON n.k = i.k AND n.prefix = i.prefix WHERE n.k >= 1)"""
WINDOWS = _sparse("windows_s", "benchmark", BLOCK + 1, True, key="item_id") + """,
windows AS (SELECT item_id, prefix, successor, n AS times FROM windows_s),
queries AS (SELECT DISTINCT prefix, successor FROM windows)"""
SUFFIX = """contexts AS (SELECT k, prefix, sum(n)::BIGINT AS total FROM node GROUP BY ALL),
found AS (SELECT q.prefix, max(c.k) AS match_length, arg_max(c.prefix, c.k) AS match, arg_max(c.total, c.k) AS total
  FROM (SELECT DISTINCT prefix FROM queries) q JOIN contexts c ON right(q.prefix, c.k) = c.prefix AND c.k <= length(q.prefix) GROUP BY q.prefix)"""
PROBABILITY = """uni AS (SELECT successor, n, sum(n) OVER () AS everything FROM node WHERE k = 0),
probs AS (SELECT q.prefix, q.successor, f.match_length, coalesce(n.n / f.total, 0) AS own, coalesce(u.n / u.everything, 0) AS unigram
  FROM queries q LEFT JOIN found f ON q.prefix = f.prefix LEFT JOIN node n ON n.prefix = f.match AND n.k = f.match_length AND n.successor = q.successor
  LEFT JOIN uni u ON u.successor = q.successor)"""
RECURSIVE = """totals AS (SELECT k, prefix, sum(n) AS total FROM node GROUP BY ALL),
tails AS (SELECT q.prefix, q.successor, unnest(range(0, length(q.prefix) + 1)) AS k FROM queries q),
hits AS (SELECT q.prefix, q.successor, c.k, c.n / t.total AS p FROM tails q
  JOIN node c ON c.k = q.k AND c.prefix = right(q.prefix, c.k) AND c.successor = q.successor JOIN totals t ON t.k = c.k AND t.prefix = c.prefix),
backed AS (SELECT q.prefix, q.successor, coalesce(max(h.k), 0)::INT AS match_length, coalesce(arg_max(h.p, h.k), 0) AS probability
  FROM queries q LEFT JOIN hits h ON q.prefix = h.prefix AND q.successor = h.successor GROUP BY q.prefix, q.successor)"""
PERPLEXITY = f"""per AS (SELECT w.item_id, sum(times)::BIGINT AS windows,
  sum(times * -log2(CASE WHEN greatest(own, unigram) = 0 THEN {score.TINY} WHEN own > 0 THEN own ELSE unigram END)) / sum(times) AS lg_pp
  FROM windows w JOIN probs p ON w.prefix = p.prefix AND w.successor = p.successor GROUP BY w.item_id)"""
CDF = """cdf AS (SELECT prefix, k, successor, sum(n) OVER w - n AS lo, sum(n) OVER w AS hi, sum(n) OVER (PARTITION BY prefix) AS total
  FROM node WINDOW w AS (PARTITION BY prefix ORDER BY successor ROWS UNBOUNDED PRECEDING))"""
PROMPT_ROWS = "prompts AS (SELECT * FROM (VALUES " + ", ".join(f"({n}, {(n * sample.MULTIPLIER + sample.INCREMENT) % sample.MODULUS}, '{p}')" for n, p in enumerate(PROMPTS)) + ") AS t(sample, r, text))"


def _q(text: str) -> str:
    return text.replace("'", "''")


def _rx(pieces) -> str:
    order = sorted(pieces, key=lambda p: (-len(p), p))
    return _q("|".join("".join("\\" + c if c in ".,\\" else c for c in p[::-1]) for p in order))


def _tokens_sql(extra: str = "") -> str:
    names = "MAP {" + ", ".join(f"'{_q(p)}': {n}" for n, p in enumerate(PIECES)) + "}"
    return f"list_reverse(list_transform(regexp_extract_all(reverse(text), '{_rx(PIECES)}'), lambda p: {names}[reverse(p)])){extra}"


def generated_sql(steps: int, greedy: bool, lists: bool = False) -> str:
    """Recursive query ``g(sample, step, r, text)`` over ``prompts`` and ``steps``: of all prefixes that a text ends in, the longest decides."""
    size = "len(g.text)" if lists else "length(g.text)"
    last = f"g.text[{size} - s.k + 1:{size}]" if lists else "right(g.text, s.k)"
    longer = "list_append(g.text, s.successor)" if lists else "g.text || s.successor"
    drawn = "" if greedy else " AND s.lo <= g.r / 2147483648.0 * s.total AND g.r / 2147483648.0 * s.total < s.hi"
    return f"""g(sample, step, r, text) AS (
  SELECT sample::BIGINT, 0, r::BIGINT, text FROM prompts
  UNION ALL
  (SELECT sample, step, r, text FROM (
    SELECT g.sample, g.step + 1 AS step, (g.r * 1103515245 + 12345) % 2147483648 AS r, {longer} AS text,
           row_number() OVER (PARTITION BY g.sample ORDER BY s.k DESC) AS place
    FROM g JOIN steps s ON s.k <= {size} AND s.prefix = {last}{drawn} WHERE g.step < {steps}) WHERE place = 1))"""


def oracle_sql() -> dict[str, str]:
    node = _dense("node", "documents")
    conv = _dense("node", "conversations")
    parts = f"""docs AS (SELECT item_id, string_split(text, '') AS c, len(string_split(text, '')) // {SEGMENTS} AS m, len(string_split(text, '')) % {SEGMENTS} AS r FROM benchmark WHERE length(text) // {SEGMENTS} > {BLOCK}),
parts AS (SELECT item_id, j::INT AS segment, c[greatest(1, j * m + least(j, r) + 1 - CASE WHEN j > 0 THEN {BLOCK} ELSE 0 END):(j + 1) * m + least(j + 1, r)] AS part FROM (SELECT *, unnest(range(0, {SEGMENTS})) AS j FROM docs))"""
    chars = "c AS (SELECT unnest(string_split(text, '')) AS char FROM documents WHERE text <> '')"
    first = "f AS (SELECT doc_id, pos, char FROM (SELECT doc_id, unnest(string_split(text, '')) AS char, unnest(range(1, len(string_split(text, '')) + 1)) AS pos FROM documents WHERE text <> ''))"
    vocab = "v AS (SELECT char AS piece, (row_number() OVER (ORDER BY char) - 1)::INT AS token FROM (SELECT DISTINCT char FROM c))"
    seed = "((seed * 1103515245 + 12345) % 2147483648) / 2147483648.0"
    greedy = "steps AS (SELECT k, prefix, successor FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY n DESC, successor) AS r FROM node) WHERE r = 1)"
    recursive = lambda steps, g: "WITH RECURSIVE " + ", ".join((node, steps, PROMPT_ROWS, generated_sql(STEPS, g))) + f" SELECT sample, text FROM g WHERE step = {STEPS}"
    drawn = recursive(CDF + ", steps AS (SELECT k, prefix, successor, lo, hi, total FROM cdf)", False)
    sizes = "s AS (SELECT count(*) AS prefixes, sum(c)::BIGINT AS patterns, sum(n)::BIGINT AS occurrences FROM (SELECT prefix, count(*) AS c, sum(n) AS n FROM leaves GROUP BY prefix))"
    merged = "merged AS (SELECT k, prefix, successor, sum(n)::BIGINT AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL)"
    two = (_dense("a", "benchmark"), _dense("b", "conversations"))
    return {
        "next_token_distribution": _with(node, then="SELECT *, sum(n) OVER w::BIGINT AS total, n / sum(n) OVER w AS probability FROM node WINDOW w AS (PARTITION BY k, prefix)".replace("OVER w::BIGINT", "OVER w").replace("sum(n) OVER w AS total", "(sum(n) OVER w)::BIGINT AS total")),
        "char_counts": _with(chars, then="SELECT char, count(*) AS n FROM c GROUP BY char"),
        "char_counts_pages": _with(chars.replace("text", "html").replace("documents", "pages"), then="SELECT char, count(*) AS n FROM c GROUP BY char"),
        "char_counts_lines": "SELECT char, sum(n)::BIGINT AS n FROM (SELECT char, count(*) AS n FROM (SELECT unnest(string_split(line, '')) AS char FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line <> '') GROUP BY char UNION ALL SELECT chr(10), sum(len(string_split(text, chr(10)))) FROM documents) GROUP BY char",
        "char_counts_filtered": _with(chars, then="SELECT char, count(*) AS n FROM c WHERE char NOT IN (' ', 'e', chr(0)) GROUP BY char"),
        "char_count_text": _with(chars, then="SELECT char || ': ' || count(*) AS line FROM c GROUP BY char"),
        "stream_char_counts": _with(chars, then="SELECT char, count(*) AS n FROM c GROUP BY char"),
        "char_language": _with(chars, vocab, then="SELECT * FROM v"),
        "language_json": _with(chars, vocab, then="SELECT * FROM v"),
        "char_language_first_seen": _with(first, then="SELECT char AS piece, (row_number() OVER (ORDER BY m))::INT AS token FROM (SELECT char, min({'d': doc_id, 'p': pos}) AS m FROM f GROUP BY char)"),
        "language_valid_text": f"WITH u AS (SELECT reverse(p) AS piece, count(*) AS n FROM (SELECT unnest(regexp_extract_all(reverse(text), '{_rx(PIECES)}')) AS p FROM documents) GROUP BY 1) SELECT piece, token, coalesce(n, 0)::BIGINT AS n FROM (VALUES " + ", ".join(f"('{_q(p)}', {n})" for n, p in enumerate(PIECES)) + ") AS t(piece, token) LEFT JOIN u USING (piece)",
        "encode_chars": _with(chars, vocab, first, then="SELECT doc_id, string_agg(token::VARCHAR, ' ' ORDER BY pos) AS tokens FROM f JOIN v ON f.char = v.piece GROUP BY doc_id UNION ALL SELECT doc_id, '' FROM documents WHERE text = ''"),
        "decode_roundtrip": "SELECT doc_id, text AS decoded FROM documents",
        "encode_greedy_suffix": f"SELECT doc_id, array_to_string({_tokens_sql()}, ' ') AS tokens FROM documents",
        "is_valid_text": "SELECT doc_id, regexp_full_match(text, '[a-zA-Z .,\\n]*') AS valid FROM documents",
        "token_length_histogram": f"SELECT length(p)::INT AS length, count(*) AS n FROM (SELECT unnest(regexp_extract_all(reverse(text), '{_rx(PIECES)}')) AS p FROM documents) GROUP BY 1",
        "tokenize_documents": f"SELECT doc_id::VARCHAR AS id, array_to_string({_tokens_sql(f' || [{len(PIECES)}]')}, ' ') AS encoded FROM documents",
        "parse_delimited_tokens": f"SELECT id, len(t)::INT AS n_tokens, list_sum(t)::BIGINT AS sum_tokens FROM (SELECT doc_id::VARCHAR AS id, {_tokens_sql(f' || [{len(PIECES)}]')} AS t FROM documents)",
        "ngram_counts_dense": _with(node, then="SELECT * FROM node"),
        "ngram_counts_sparse": _with(_sparse("s", "documents"), then="SELECT * FROM s"),
        "ngram_counts_full_window": _with(_sparse("s", "documents", BLOCK + 1), then="SELECT * FROM s"),
        "ngram_counts_with_last": _with(_sparse("s", "documents", 2, True), then="SELECT * FROM s"),
        "ngram_doc_boundaries": """WITH d AS (SELECT row_number() OVER () AS r, [0] || list_transform(list_filter(string_split(text, ''), lambda x: x <> ''), lambda x: unicode(x)) || [1] AS c FROM conversations),
f AS (SELECT r, len(c) AS len, unnest(c) AS t, unnest(range(1, len(c) + 1)) AS pos FROM d WHERE len(c) > 2),
e AS (SELECT pos, len, t, lag(t, 1) OVER w AS t1, lag(t, 2) OVER w AS t2 FROM f WINDOW w AS (PARTITION BY r ORDER BY pos)),
x AS (SELECT t, t1, t2, unnest(range(0, CASE WHEN t2 IS NULL THEN 2 ELSE 3 END)) AS j FROM e WHERE pos >= 2 AND pos < len)
SELECT j::INT AS k, CASE j WHEN 0 THEN '' WHEN 1 THEN t1::VARCHAR ELSE t2 || ' ' || t1 END AS prefix, t::INT AS successor, count(*) AS n FROM x GROUP BY ALL""",
        "ngram_window_frame": f"SELECT array_to_string(p, ' ') AS prefix, event_type AS successor, count(*) AS n FROM (SELECT event_type, list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {BLOCK} PRECEDING AND 1 PRECEDING) AS p FROM events) WHERE len(p) > 0 GROUP BY 1, 2",
        "event_transitions": "SELECT before, event_type AS after, count(*) AS n FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NOT NULL GROUP BY 1, 2",
        "prefix_views": "SELECT item_id, left(text, 1) AS first, right(text, 1) AS last, substr(text, 2) AS popped, left(text, length(text) - 1) AS shortened, left(text, 3) AS head, right(text, 3) AS tail FROM benchmark WHERE length(text) > 0",
        "densify_equals_dense": _with(conv, then="SELECT count(*) AS nodes, 0::BIGINT AS different FROM node"),
        "sparsify": _with(_sparse("s", "documents"), then="SELECT * FROM s"),
        "model_merge": _with(*two, merged, then="SELECT * FROM merged"),
        "sampler_merge": _with(*two, merged, then="SELECT successor, n FROM merged WHERE k = 0"),
        "sampler_reduce": _with(two[0], then="SELECT successor, n FROM a WHERE k = 0"),
        "sampler_verify": "SELECT 0::BIGINT AS bad",
        "model_by_root_token": _with(node, then="SELECT right(prefix, 1) AS root, count(DISTINCT prefix) AS prefixes, count(*) AS patterns, sum(n)::BIGINT AS occurrences FROM node WHERE k > 0 GROUP BY 1"),
        "count_prefixes": _with(node, LEAVES, sizes, then="SELECT prefixes FROM s"),
        "count_patterns": _with(node, LEAVES, sizes, then="SELECT patterns FROM s"),
        "model_occurrences": _with(node, LEAVES, sizes, then="SELECT occurrences FROM s"),
        "list_prefixes": _with(node, LEAVES, then="SELECT DISTINCT prefix FROM leaves"),
        "list_patterns": _with(node, LEAVES, then="SELECT prefix, successor FROM leaves"),
        "model_memory": _with(node, then="SELECT sum(8 + 6 * c + CASE WHEN k > 0 THEN 2 ELSE 0 END)::BIGINT AS bytes FROM (SELECT k, prefix, count(*) AS c FROM node GROUP BY ALL)"),
        "model_depth": _with(node, then="SELECT max(k) AS depth FROM node"),
        "model_summary": _with(node, LEAVES, sizes, f"ev AS (SELECT sum(length(text) - 2)::BIGINT AS events FROM documents WHERE length(text) > {BLOCK})", then="SELECT prefixes, patterns, occurrences, events, prefixes / events AS prefix_share, patterns / prefixes AS per_prefix FROM s, ev"),
        "per_document_model_stats": _with(_sparse("s", "documents", key="doc_id"), then="SELECT doc_id, any_value(strlen(d.text))::INT AS in_bytes, count(DISTINCT prefix) AS prefixes, count(*) AS patterns, sum(n)::BIGINT AS occurrences, max(k) AS depth, sum(strlen(prefix) + strlen(successor) + 8)::BIGINT AS out_bytes FROM s JOIN documents d USING (doc_id) GROUP BY doc_id"),
        "per_label_models": _with(_sparse("s", "(SELECT toxic, text FROM documents JOIN labels USING (doc_id))", block=1, key="toxic"), then="SELECT * FROM s"),
        "model_partition_stats": _with(node, then="SELECT right(prefix, 1) AS root, count(*) AS rows, sum(strlen(prefix) + strlen(successor) + 8)::BIGINT AS rawbytes FROM node WHERE k > 0 GROUP BY 1"),
        "unigram_histogram": _with(node, then="SELECT successor, n, n / sum(n) OVER () AS probability FROM node WHERE k = 0"),
        "top_k_successors": _with(node, then="SELECT prefix, successor, n, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY k, prefix ORDER BY n DESC, successor) AS place FROM node) WHERE place <= 3"),
        "most_likely_next": _with(node, then="SELECT k, prefix, successor, n FROM (SELECT *, row_number() OVER (PARTITION BY k, prefix ORDER BY n DESC, successor) AS place FROM node) WHERE place = 1"),
        "match_prefixes": _with(node, WINDOWS, then="SELECT prefix, successor FROM windows WHERE prefix IN (SELECT prefix FROM node WHERE k > 0)").replace("FROM windows WHERE", "FROM queries WHERE"),
        "unmatched_prefixes": _with(conv, WINDOWS, then="SELECT prefix, successor FROM queries WHERE prefix NOT IN (SELECT prefix FROM node WHERE k > 0)"),
        "search_longest_suffix": _with(conv, WINDOWS, SUFFIX, then="SELECT prefix, match FROM found"),
        "match_length": _with(conv, WINDOWS, SUFFIX, then="SELECT match_length, count(*) AS n FROM found GROUP BY 1"),
        "suffix_probability": _with(conv, WINDOWS, SUFFIX, PROBABILITY, then="SELECT prefix, successor, match_length, own AS probability FROM probs"),
        "backoff_probability": _with(conv, WINDOWS, SUFFIX, PROBABILITY, then="SELECT prefix, successor, match_length, CASE WHEN own > 0 THEN own ELSE unigram END AS probability FROM probs"),
        "recursive_probability": _with(conv, WINDOWS, RECURSIVE, then="SELECT prefix, successor, match_length, probability FROM backed"),
        "perplexity": _with(node, WINDOWS, SUFFIX, PROBABILITY, PERPLEXITY, then="SELECT item_id, windows, round(lg_pp, 6) AS lg_pp, round(pow(2, lg_pp), 6) AS perplexity, round(lg_pp * lg_pp, 6) AS lg_squared FROM per"),
        "sample_next_token": _with(node, CDF, "seeds AS (SELECT DISTINCT conv_id * 1000 + turn AS seed FROM conversations)", then=f"SELECT seed, successor FROM seeds JOIN cdf ON k = 0 AND lo <= {seed} * total AND {seed} * total < hi"),
        "sample_backoff": _with(node, CDF, f"queries AS (SELECT item_id AS seed, right(text, {BLOCK}) AS prefix FROM benchmark)", SUFFIX, then=f"SELECT seed, q.prefix, f.match_length, c.successor FROM queries q JOIN found f ON q.prefix = f.prefix JOIN cdf c ON c.prefix = f.match AND lo <= {seed} * c.total AND {seed} * c.total < hi"),
        "generate_greedy": recursive(greedy, True),
        "generate_seeded": drawn,
        "generate_long": drawn,
        "split_segments": _with(parts, then=f"SELECT item_id, segment, {SEGMENTS} AS num_segments, {BLOCK} AS block_size, array_to_string(part, '') AS text FROM parts"),
        "split_roundtrip": f"SELECT item_id, text FROM benchmark WHERE length(text) // {SEGMENTS} > {BLOCK}",
        "split_model": _with(_dense("node", f"(SELECT text FROM benchmark WHERE length(text) // {SEGMENTS} > {BLOCK})"), then="SELECT * FROM node"),
        "train_validation_split": f"SELECT doc_id, left(text, floor(length(text) * 0.75)::INT) AS train, substr(text, greatest(floor(length(text) * 0.75)::INT - {BLOCK} - 1, 0) + 1) AS valid FROM documents",
        "model_prefix_intersect": _with(*two, then="SELECT k, prefix FROM a WHERE k > 0 INTERSECT SELECT k, prefix FROM b"),
        "model_prefix_except": _with(*two, then="SELECT k, prefix FROM a WHERE k > 0 EXCEPT SELECT k, prefix FROM b"),
        "gs_url_parts": "SELECT page_id, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/]+)/(.*)$', 1) AS bucket, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/]+)/(.*)$', 2) AS key FROM pages",
        "text_sha1": "SELECT doc_id, sha1(text) AS sha1 FROM documents",
        "json_lines": "SELECT '{\"doc_id\":' || doc_id || ',\"quality\":' || quality || '}' AS json FROM labels",
        "subtree_json_rows": _with(node, then="""SELECT prefix, '{"k":' || k || ',"prefix":' || to_json(prefix) || ',"total":' || sum(n) || ',"counts":{' || string_agg(to_json(successor) || ':' || n, ',' ORDER BY successor) || '}}' AS json
FROM node WHERE k > 0 AND right(prefix, 1) = 'q' GROUP BY k, prefix"""),
    }
