"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gramlake.llm import bpe, lines, mixing, negatives, shards, simhash, spelling, sstable, toxicity, urls, vectors, warc
from gramlake.llm.common import table


def tokenizer_file(name: str) -> str:
    """Path of a public vocabulary file; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    docs = lambda s, d: table(s, d, "documents")
    return {
        "op1_topk_search": lambda s, d: vectors.op1_query(table(s, d, "embeddings")),
        "op2_bpe": lambda s, d: bpe.op2_query(docs(s, d), tokenizer_file("byte_bpe_50k.json")),
        "op3_simhash": lambda s, d: simhash.op3_query(docs(s, d)),
        "op4_embedding_neardup": lambda s, d: vectors.op4_query(table(s, d, "embeddings")),
        "op5_mixing": lambda s, d: mixing.op5_query(docs(s, d)),
        "op6_url_filter": lambda s, d: urls.op6_query(table(s, d, "pages")),
        "op7_toxicity": lambda s, d: toxicity.op7_query(docs(s, d), table(s, d, "labels")),
        "op8_token_tables": lambda s, d: sstable.op8_query(docs(s, d), tokenizer_file("word_bpe_49k.json")),
        "op9_sharding": lambda s, d: shards.op9_query(docs(s, d)),
        "op10_line_dedup": lambda s, d: lines.op10_query(docs(s, d)),
        "op11_warc": lambda s, d: warc.op11_query(table(s, d, "pages")),
        "op12_hard_negatives": lambda s, d: negatives.op12_query(table(s, d, "embeddings")),
        "op13_spelling": lambda s, d: spelling.op13_query(docs(s, d)),
    }


OP1_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""

OP5_SQL = f"""
WITH light AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 8))::BIGINT >> 2 AS h
  FROM documents),
named AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM light GROUP BY source),
weighted AS (
  SELECT source, source_size, [5, 2, 1][(place - 1) % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap,
         (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total
  FROM named),
units AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit
  FROM weighted),
plan AS (
  SELECT source, source_size, least(cap, max(unit) OVER () * weight) AS target FROM units),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole,
         target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size AS budget
  FROM plan),
runs AS (
  SELECT l.source, l.h, l.words, sum(l.words) OVER (PARTITION BY l.source ORDER BY l.h) AS upto, b.budget
  FROM (SELECT source, h, sum(size)::BIGINT AS words FROM light GROUP BY source, h) l
  JOIN budgets b ON l.source IS NOT DISTINCT FROM b.source),
edge AS (
  SELECT source, coalesce(arg_min({{'h': h, 'upto': upto, 'below': upto - words, 'budget': budget}}, h) FILTER (WHERE upto > budget),
                          arg_max({{'h': h, 'upto': upto, 'below': upto - words, 'budget': budget}}, h)) AS e
  FROM runs GROUP BY source),
cuts AS (
  SELECT source, CASE WHEN e.upto - e.budget <= e.budget - e.below THEN e.h + 1 ELSE e.h END AS cut FROM edge)
SELECT l.doc_id, l.size, b.source_size, b.target,
       (l.size * (b.whole + CASE WHEN l.h < c.cut AND b.whole < 2 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM light l JOIN budgets b ON l.source IS NOT DISTINCT FROM b.source JOIN cuts c ON l.source IS NOT DISTINCT FROM c.source
"""


def _op6_sql() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in urls.RULES)
    count = lambda terms: " + ".join(f"regexp_matches(low, '(^|[^a-z]){t}([^a-z]|$)')::INT" for t in terms)
    lower = f"translate(%s, '{''.join(map(chr, range(65, 91)))}', '{''.join(map(chr, range(97, 123)))}')"
    return f"""
WITH r(verdict, rule_host, rule_path) AS (VALUES {rules}),
cut AS (
  SELECT page_id, {lower % "coalesce(url, '')"} AS low,
         CASE WHEN coalesce(strpos(url, '://'), 0) > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest, row_number() OVER () AS n
  FROM pages),
parts AS (
  SELECT n, page_id, low, {lower % "regexp_extract(rest, '^[^/?#]*')"} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fits AS (
  SELECT n, arg_max({{'verdict': r.verdict, 'rule': rule_host || rule_path}}, length(rule_host || rule_path)) AS best
  FROM parts p JOIN r ON (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path)
  GROUP BY n)
SELECT page_id, host, path, best.rule AS rule,
       CASE WHEN best IS NOT NULL THEN best.verdict
            WHEN {urls.SOFT_NEEDED} * ({count(urls.STRICT)}) + ({count(urls.SOFT)}) >= {urls.SOFT_NEEDED} THEN 'block' ELSE 'allow' END AS verdict
FROM parts LEFT JOIN fits USING (n)
"""


OP10_SQL = f"""
WITH lines AS (
  SELECT n, doc_id, source, text, pos, line, trim(line, ' ' || chr(9) || chr(13)) AS bare
  FROM (SELECT n, doc_id, source, text, unnest(string_split(text, chr(10))) AS line,
               unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos
        FROM (SELECT *, row_number() OVER () AS n FROM documents WHERE text IS NOT NULL))),
totals AS (SELECT source, count(*) AS pages FROM documents WHERE source IS NOT NULL GROUP BY source),
hot AS (
  SELECT source, bare FROM (SELECT source, bare, count(DISTINCT n) AS c FROM lines WHERE source IS NOT NULL AND bare <> '' GROUP BY source, bare)
  JOIN totals USING (source) WHERE c >= {lines.LEAST_PAGES} AND c > pages * {lines.RATIO}::DOUBLE),
kept AS (
  SELECT n, any_value(doc_id) AS doc_id, any_value(text) AS before,
         coalesce(string_agg(l.line, chr(10) ORDER BY pos) FILTER (WHERE h.bare IS NULL), '') AS text
  FROM lines l LEFT JOIN hot h ON l.source = h.source AND l.bare = h.bare GROUP BY n)
SELECT doc_id, text, length(before)::BIGINT AS n_before, length(text)::BIGINT AS n_after FROM kept
UNION ALL SELECT doc_id, text, NULL, NULL FROM documents WHERE text IS NULL
"""


OP11_SQL = """
WITH hashed AS (
  SELECT page_id, coalesce(html, '') AS payload, encode(coalesce(html, ''))::BLOB AS raw FROM pages),
named AS (
  SELECT page_id, octet_length(raw)::BIGINT AS payload_bytes, payload,
         list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           ((('0x' || substr(sha1(raw), (i // 4 * 5 + 1)::INT, 5))::INT >> (15 - i % 4 * 5)::INT) & 31) + 1, 1)), 'string_agg', '') AS payload_digest
  FROM hashed),
whole AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS top FROM named)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM whole
"""

OP12_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v,
         CASE WHEN vec_id % {negatives.RELABEL} = 0 THEN (label + 1) % {negatives.CLASSES} ELSE label END AS label
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % {negatives.EVERY} = 0 AND c.vec_id <> q.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {negatives.POSITIVES})
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
WHERE rank <= {negatives.NEGATIVES}
"""

OP13_SQL = f"""
WITH RECURSIVE steps AS (
  SELECT list_reduce(list_prepend(b, range(0, 8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t, b
  FROM range(0, 256) AS r(b)),
crc AS (SELECT list(t ORDER BY b) AS t FROM steps),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' AS head,
         translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), '{spelling.UPPER}', '{spelling.LOWER}') AS word FROM documents),
met AS (SELECT head, word, count(*) AS n FROM runs WHERE length(word) >= {spelling.SHORTEST} GROUP BY head, word),
hashed AS (
  SELECT word, n, xor(list_reduce(list_prepend(4294967295::BIGINT,
           flatten(list_transform(string_split(head || word, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64]::BIGINT[] END))),
           lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS h FROM met, crc),
cut AS (
  SELECT CASE WHEN h % {spelling.EVERY} = 0 THEN substr(word, 1, (h % length(word))::INT) || substr(word, (h % length(word))::INT + 2) ELSE word END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= {spelling.SHORTEST} GROUP BY word HAVING sum(n) >= {spelling.LEAST}),
holes AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS less
  FROM (SELECT word, n, unnest(range(0, length(word)))::INT AS i FROM words)),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.less = b.word
  UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.less = b.word),
best AS (
  SELECT word, count(*) AS n_near, min_by(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near,
         CASE WHEN near_n >= {spelling.FORM_RATIO} * w.n THEN near END AS form, CASE WHEN near_n >= {spelling.FORM_RATIO} * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
paths(word, root) AS (
  SELECT word, word FROM forms WHERE form IS NULL
  UNION ALL SELECT f.word, p.root FROM forms f JOIN paths p ON f.form = p.word)
SELECT f.word, f.form, p.root, f.n, f.n_near, f.form_n FROM forms f JOIN paths p ON f.word = p.word
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_topk_search": OP1_SQL,
        "op5_mixing": OP5_SQL,
        "op6_url_filter": _op6_sql(),
        "op10_line_dedup": OP10_SQL,
        "op11_warc": OP11_SQL,
        "op12_hard_negatives": OP12_SQL,
        "op13_spelling": OP13_SQL,
    }
