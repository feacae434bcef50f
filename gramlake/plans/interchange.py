"""Queries that go through files, messages, single verbs and the service, and the same in SQL.

What is written goes to a new path below the shared folder of the session and
is read back by the readers of ``gramlake.sources``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramlake.functions import language as functions
from gramlake.functions import udtf
from gramlake.functions.language import Language
from gramlake.operators import charcount, interchange, model, ngrams, requests, sample
from gramlake.operators.service import MAX_SAMPLES
from gramlake.plans import catalog
from gramlake.plans.catalog import BLOCK, CDF
from gramlake.sources import readers, writers
from gramlake.sources.scratch import scratch_path
from gramlake.streaming import counts as streaming

#: Characters of a prompt, draws of a request, and characters and number of the chunks of a stream.
PROMPT, SAMPLES, CHUNK, CHUNKS = 6, 2, 5, 3
DRAWS = 1_000_000


def _t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _node(s, d, name: str = "conversations") -> DataFrame:
    return ngrams.dense_counts(_t(s, d, name), BLOCK)


def _items(s, d, compression: str | None = None) -> str:
    """Every benchmark item as a text file in a folder of its own."""
    path = scratch_path(s, "items")
    _t(s, d, "benchmark").select("item_id", "text").write.partitionBy("item_id").text(path, compression=compression, lineSep="\n")
    return path


def _item(path):
    return F.regexp_extract(path, r"item_id=(\d+)", 1).cast("long").alias("item_id")


def whole_text_files(s, d):
    return readers.whole_texts(s, _items(s, d) + "/*").select(_item("path"), "text")


def gzipped_binary_files(s, d):
    rows = readers.binary_files(s, _items(s, d, "gzip") + "/*")
    return rows.select(_item("path"), F.decode("data", "UTF-8").alias("text"), F.length("data").cast("long").alias("bytes"))


def text_line_files(s, d):
    lines = readers.text_lines(s, _items(s, d, "gzip"))
    return lines.groupBy("line").agg(F.count("*").alias("n"))


def listed_files(s, d):
    return readers.list_files(s, _items(s, d)).where(F.col("path").endswith(".txt")).select(_item("path"), F.col("length").alias("bytes"))


def article_array_files(s, d):
    path = scratch_path(s, "articles")
    article = F.struct(F.col("item_id").cast("string").alias("id"), F.lit("item").alias("title"), "text")
    _t(s, d, "benchmark").select("item_id", F.to_json(F.array(article)).alias("value")).write.partitionBy("item_id").text(path)
    return readers.article_files(s, path + "/*").select(_item("src"), "id", "title", "text")


def replaced_table(s, d):
    """Counts written over a table's rows, read by a query of its columns."""
    name = "gramlake_" + scratch_path(s, "table").rsplit("-", 1)[1]
    s.sql(f"create table {name} (char string, n bigint) using parquet location '{scratch_path(s, 'table')}'")
    for table in ("conversations", "benchmark"):
        writers.replace_table(charcount.char_counts(_t(s, d, table)).select("char", "n"), name)
    return readers.table_rows(s, name, ["char", "n"])


def json_line_files(s, d):
    path = scratch_path(s, "json")
    writers.json_lines(_t(s, d, "labels"), path, "gzip")
    return readers.json_rows(s, path, "doc_id long, quality int, toxic int")


def text_sink(s, d):
    path = scratch_path(s, "text")
    rows = charcount.char_counts(_t(s, d, "benchmark")).where("char not in ('\n', '\r')")
    writers.text_lines(rows.select(F.format_string("%s: %d", "char", "n").alias("line")), path)
    return readers.text_lines(s, path)


def model_files(s, d):
    """A model written by root token and read back."""
    path = scratch_path(s, "model")
    writers.model_by_root(_node(s, d), path)
    return readers.model(s, path)


def language_file(s, d):
    """The characters of the corpus as a gzipped message, read back."""
    language = Language.from_corpus(_t(s, d, "documents"))
    path = writers.language(s, language, scratch_path(s, "language") + ".pb")
    return readers.language(s, path).vocab(s)


def serialized_trees(s, d):
    """Trees of every root token as gzipped messages, and the counts in them."""
    trees = interchange.serialized_trees(_node(s, d))
    return interchange.tree_rows(trees).select("k", F.array_join(F.col("prefix").cast("array<string>"), " ").alias("prefix"), "successor", "n")


def tree_base64(s, d):
    """Trees of the benchmark's tokens as text, and back."""
    tokens = _t(s, d, "benchmark").withColumn("tokens", catalog._greedy().encode(F.col("text")))
    texts = interchange.serialized_trees(ngrams.token_counts(tokens, BLOCK)).select("token", F.base64("tree").alias("text"))
    back = interchange.tree_rows(texts.select(F.unbase64("text").alias("tree")))
    return back.groupBy(F.element_at("prefix", -1).alias("token")).agg(F.count("*").alias("rows"), F.sum("n").alias("n"))


def model_message(s, d):
    """A whole model as a message in parts, and back."""
    rows = interchange.set_rows(interchange.set_messages(_node(s, d, "benchmark"))).withColumn("successors", F.array("successor"))
    return rows.select("k", _characters("prefix"), _characters("successors").alias("successor"), "n")


def _characters(numbers: str):
    """Numbers of code points as a text."""
    return F.array_join(F.transform(numbers, lambda c: F.decode(F.unhex(F.lpad(F.hex(c.cast("long")), 8, "0")), "UTF-32")), "").alias(numbers)


def sampler_message(s, d):
    """The sampler of every prefix as a message, and back."""
    rows = interchange.sampler_rows(interchange.sampler_messages(_node(s, d)))
    return rows.select("k", F.array_join(F.col("prefix").cast("array<string>"), " ").alias("prefix"), F.col("successor").cast("int").alias("successor"), "n")


def sampling_accuracy(s, d):
    """Draws from the unigram model by successor, and how far their share is from the probability."""
    node = _node(s, d).where("k = 0")
    drawn = sample.sample_next(s.range(DRAWS).select(F.col("id").alias("seed"), F.lit("").alias("prefix")), node)
    share = drawn.groupBy("successor").agg(F.count("*").alias("draws"))
    rows = model.histogram(node).select("successor", "probability").join(share, "successor", "left").na.fill(0, ["draws"])
    return rows.select("successor", "draws", (F.abs(F.col("draws") / DRAWS - F.col("probability")) <= 0.001).alias("near"))


def service_valid_text(s, d):
    return requests.valid_text(_t(s, d, "conversations"))


def service_is_valid(s, d):
    """Every document as a request: whether the language of the conversations has all its characters."""
    return requests.are_valid(_t(s, d, "documents"), requests.valid_text(_t(s, d, "conversations")), "doc_id")


def service_block_size(s, d):
    return requests.block_size(_node(s, d))


def _requests(s, d) -> DataFrame:
    """Every benchmark item as a request: its last characters are the prompt."""
    return _t(s, d, "benchmark").select(F.col("item_id").alias("request"), F.expr(f"right(text, {PROMPT})").alias("text"))


def service_batch(s, d):
    return requests.generate_batches(_requests(s, d), _node(s, d), BLOCK, catalog.STEPS, SAMPLES).select("request", "draw", "text")


def service_stream(s, d):
    return requests.generate_streams(_requests(s, d), _node(s, d), BLOCK, CHUNK, CHUNKS)


def language_define(s, d):
    """The benchmark encoded by a language with two further pieces."""
    language = catalog._greedy().define("qu", 90).define(b"\xc3\xa9", 91)
    rows = _t(s, d, "benchmark").select("item_id", language.encode(F.col("text")).alias("t"))
    return rows.select("item_id", F.array_join(F.col("t").cast("array<string>"), " ").alias("tokens"))


def language_memory(s, d):
    """Bytes of the language of the documents, from the vocabulary as a table."""
    vocab = functions.char_language(_t(s, d, "documents"))
    return vocab.agg(F.sum(F.octet_length("piece") + 4).cast("long").alias("bytes"))


def stream_sparse_counts(s, d):
    """The conversations as a stream of files, counted until there is no more, then densified."""
    path = scratch_path(s, "stream")
    table = _t(s, d, "conversations").select("text")
    table.repartition(3).write.parquet(path)
    name = "gramlake_stream_" + path.rsplit("-", 1)[1]
    stream = s.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path)
    run = streaming.sparse_counts(stream, BLOCK).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    return ngrams.densify(s.table(name))


def stream_transitions(s, d):
    """Event types per hour, counted from a stream under a watermark."""
    path = scratch_path(s, "stream")
    table = _t(s, d, "events").select("ts", "event_type")
    table.coalesce(1).sortWithinPartitions("ts").write.parquet(path)
    name = "gramlake_stream_" + path.rsplit("-", 1)[1]
    stream = s.readStream.schema(table.schema).parquet(path)
    run = streaming.windowed_transitions(stream).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    return s.table(name).select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


def ngrams_function(s, d):
    udtf.register(s)
    view = "gramlake_texts"
    _t(s, d, "benchmark").select("text").createOrReplaceTempView(view)
    rows = s.sql(f"select n.k, n.prefix, n.successor from {view}, lateral ngrams(text, {BLOCK}) n")
    return rows.groupBy("k", "prefix", "successor").agg(F.count("*").alias("n"))


def added_event(s, d):
    return model.add_event(_node(s, d, "benchmark"), "zqx", "j")


def removed_count(s, d):
    return model.clean(model.remove_count(_node(s, d, "benchmark"), "", "e", 7))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "whole_text_files": whole_text_files,
        "gzipped_binary_files": gzipped_binary_files,
        "text_line_files": text_line_files,
        "listed_files": listed_files,
        "article_array_files": article_array_files,
        "replaced_table": replaced_table,
        "json_line_files": json_line_files,
        "text_sink": text_sink,
        "model_files": model_files,
        "language_file": language_file,
        "language_define": language_define,
        "language_memory": language_memory,
        "serialized_trees": serialized_trees,
        "tree_base64": tree_base64,
        "model_message": model_message,
        "sampler_message": sampler_message,
        "sampling_accuracy": sampling_accuracy,
        "service_valid_text": service_valid_text,
        "service_is_valid": service_is_valid,
        "service_block_size": service_block_size,
        "service_batch": service_batch,
        "service_stream": service_stream,
        "stream_sparse_counts": stream_sparse_counts,
        "stream_transitions": stream_transitions,
        "ngrams_function": ngrams_function,
        "added_event": added_event,
        "removed_count": removed_count,
        "model_size": lambda s, d: model.size(_node(s, d, "documents")),
        "model_children": lambda s, d: model.children(_node(s, d, "documents"), "e"),
        "model_root_children": lambda s, d: model.children(_node(s, d, "documents")),
        "model_contexts": lambda s, d: model.contexts(_node(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    with_, dense = catalog._with, catalog._dense
    conv, bench, docs = dense("node", "conversations"), dense("node", "benchmark"), dense("node", "documents")
    chars = lambda table: f"c AS (SELECT DISTINCT unnest(string_split(text, '')) AS char FROM {table} WHERE text <> '')"
    vocab = "SELECT char AS piece, (row_number() OVER (ORDER BY char) - 1)::INT AS token FROM c"
    codes = "array_to_string(list_transform(list_filter(string_split(prefix, ''), lambda x: x <> ''), lambda x: unicode(x)), ' ')"
    more = {p: n for n, p in enumerate(catalog.PIECES)} | {"qu": 90, "é": 91}
    named = "MAP {" + ", ".join(f"'{catalog._q(p)}': {n}" for p, n in more.items()) + "}"
    defined = f"list_reverse(list_transform(regexp_extract_all(reverse(text), '{catalog._rx(more)}'), lambda p: {named}[reverse(p)]))"
    first = lambda seed: f"(({seed}) * 1103515245 + 12345) % 2147483648"
    steps = "steps AS (SELECT k, prefix, successor, lo, hi, total FROM cdf)"
    asked = f"asked AS (SELECT item_id, draw, right(text, {PROMPT}) AS text, item_id * {MAX_SAMPLES} + draw AS sample FROM benchmark, range({SAMPLES}) AS t(draw)), prompts AS (SELECT sample, {first('sample')} AS r, text FROM asked)"
    batch = "WITH RECURSIVE " + ", ".join((conv, CDF, steps, asked, catalog.generated_sql(catalog.STEPS, False))) + f" SELECT item_id AS request, draw::INT AS draw, g.text FROM g JOIN asked USING (sample) WHERE step = {catalog.STEPS}"
    # a chunk starts its own sequence of numbers at the request's number plus the chunk's
    chunk = catalog.generated_sql(CHUNK * CHUNKS, False).replace("(g.r * 1103515245 + 12345) % 2147483648 AS r", f"CASE WHEN (g.step + 1) % {CHUNK} = 0 THEN {first(f'g.sample + (g.step + 1) // {CHUNK}')} ELSE {first('g.r')} END AS r")
    starts = f"prompts AS (SELECT item_id AS sample, {first('item_id')} AS r, right(right(text, {PROMPT}), {BLOCK}) AS text FROM benchmark)"
    stream = "WITH RECURSIVE " + ", ".join((conv, CDF, steps, starts, chunk)) + f" SELECT sample AS request, (step // {CHUNK} - 1)::INT AS batch, right(text, {CHUNK}) AS text FROM g WHERE step > 0 AND step % {CHUNK} = 0"
    draws = f"""draws AS (SELECT successor, count(*) AS draws FROM (SELECT ((i * 1103515245 + 12345) % 2147483648) / 2147483648.0 AS u FROM range({DRAWS}) t(i))
  JOIN cdf ON k = 0 AND lo <= u * total AND u * total < hi GROUP BY successor)"""
    return {
        "whole_text_files": "SELECT item_id, text || chr(10) AS text FROM benchmark",
        "gzipped_binary_files": "SELECT item_id, text || chr(10) AS text, strlen(text) + 1 AS bytes FROM benchmark",
        "text_line_files": "SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM benchmark) GROUP BY line",
        "listed_files": "SELECT item_id, strlen(text) + 1 AS bytes FROM benchmark",
        "article_array_files": "SELECT item_id, item_id::VARCHAR AS id, 'item' AS title, text FROM benchmark",
        "replaced_table": "SELECT char, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS char FROM benchmark WHERE text <> '') GROUP BY char",
        "json_line_files": "SELECT doc_id, quality::INT AS quality, toxic::INT AS toxic FROM labels",
        "text_sink": "SELECT char || ': ' || count(*) AS line FROM (SELECT unnest(string_split(text, '')) AS char FROM benchmark WHERE text <> '') WHERE char NOT IN (chr(10), chr(13)) GROUP BY char",
        "model_files": with_(conv, then="SELECT * FROM node"),
        "language_file": with_(chars("documents"), then=vocab),
        "language_define": f"SELECT item_id, array_to_string({defined}, ' ') AS tokens FROM benchmark",
        "language_memory": with_(chars("documents"), then="SELECT sum(strlen(char) + 4)::BIGINT AS bytes FROM c"),
        "serialized_trees": with_(conv, then=f"SELECT k, {codes} AS prefix, unicode(successor)::INT AS successor, n FROM node WHERE k > 0"),
        "tree_base64": _tokens_by_root(),
        "model_message": with_(bench, then="SELECT * FROM node"),
        "sampler_message": with_(conv, then=f"SELECT k, {codes} AS prefix, unicode(successor)::INT AS successor, n FROM node"),
        "sampling_accuracy": with_(conv, CDF, draws, then=f"SELECT successor, coalesce(draws, 0) AS draws, abs(coalesce(draws, 0) / {DRAWS} - n / sum(n) OVER ()) <= 0.001 AS near FROM (SELECT * FROM node WHERE k = 0) LEFT JOIN draws USING (successor)"),
        "service_valid_text": with_(chars("conversations"), then="SELECT char AS text FROM c"),
        "service_is_valid": with_(chars("conversations"), then="SELECT doc_id, len(list_filter(string_split(text, ''), lambda x: x <> '' AND NOT list_contains(v, x))) = 0 AS valid FROM documents, (SELECT list(char) AS v FROM c)"),
        "service_block_size": with_(conv, then="SELECT max(k) AS size FROM node"),
        "service_batch": batch,
        "service_stream": stream,
        "stream_sparse_counts": with_(conv, then="SELECT * FROM node"),
        "stream_transitions": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2",
        "ngrams_function": with_(catalog._sparse("s", "benchmark"), then="SELECT * FROM s"),
        "added_event": with_(bench, then="SELECT k, prefix, successor, sum(n)::BIGINT AS n FROM (SELECT * FROM node UNION ALL SELECT j::INT, right('zqx', j), 'j', 1 FROM range(4) t(j)) GROUP BY ALL"),
        "removed_count": with_(bench, then="SELECT * FROM (SELECT k, prefix, successor, CASE WHEN prefix = '' AND successor = 'e' AND n >= 7 THEN n - 7 ELSE n END AS n FROM node) WHERE n > 0"),
        "model_size": with_(docs, then="SELECT count(DISTINCT right(prefix, 1)) AS size FROM node WHERE k > 0"),
        "model_children": with_(docs, then="SELECT left(prefix, 1) AS token, prefix, sum(n)::BIGINT AS total, count(*) AS choices FROM node WHERE k = 2 AND right(prefix, 1) = 'e' GROUP BY prefix"),
        "model_root_children": with_(docs, then="SELECT prefix AS token, prefix, sum(n)::BIGINT AS total, count(*) AS choices FROM node WHERE k = 1 GROUP BY prefix"),
        "model_contexts": with_(docs, then="SELECT k, prefix, sum(n)::BIGINT AS total, count(*) AS choices FROM node GROUP BY k, prefix"),
    }


def _tokens_by_root() -> str:
    from gramlake.plans import tokens

    return catalog._with(tokens._dense("node", "benchmark"), then="SELECT prefix[len(prefix)] AS token, count(*) AS rows, sum(n)::BIGINT AS n FROM node WHERE k > 0 GROUP BY 1")
