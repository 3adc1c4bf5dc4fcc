"""The corpus operators as queries over the standard tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import chat, decontamination, near_dedup, pii, quality_classifier, quality_rules, sentencepiece_lattice, sharding, url_filter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = quality_rules.measured(_table(spark, sf_dir, "documents"))
    return measures.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_lattice.digests(_table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    voters = quality_classifier.fitted(docs, labels.filter(~held_out))
    return quality_classifier.scored(docs.select("doc_id", "text"), voters).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = pii.digest(pii.spotted(docs, pii.fitted(docs)))
    return spans.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write(_table(spark, sf_dir, "pages"))
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(sharding.sharded(_table(spark, sf_dir, "documents")))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.sql("SELECT -7L AS conv_id, turn, role, '\\\\### Assistant: </turn> ok' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return chat.digest(chat.read_back(chat.examples(given.union(more))))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judged(pages, url_filter.fitted(url_filter.example_labels(pages))).select("page_id", "host", "path", "rule", "verdict")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    marks = decontamination.digest(decontamination.marked(docs, _table(spark, sf_dir, "benchmark"), clean=False))
    return marks.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_sentencepiece, op3_quality_classifier, op4_pii, op5_warc, op6_sharding, op7_chat, op8_url_filter, op9_decontamination, op10_minhash_forest, pipeline)}

_OP1 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d),
full_lines AS (SELECT doc_id, l FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM full_lines GROUP BY doc_id),
grams AS (SELECT doc_id, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS p FROM w)),
twice AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM twice, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
base AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id)),
judged AS (SELECT doc_id, l, length(l) AS c, regexp_extract_all(l, '[^\x20\x09-\x0D]+') AS v FROM full_lines),
failed AS (SELECT doc_id, c,
  (len(v) <= {nav} AND NOT regexp_matches(rtrim(l), '{closing}'))
  OR len(regexp_extract_all(l, '[#*$%&<>]')) > {symbol} * c OR len(regexp_extract_all(l, '[|]')) > {bar} * c OR len(regexp_extract_all(l, '\p{{Lu}}')) > {upper} * c
  OR (len(v) >= {long} AND len(list_distinct(v)) < {distinct} * len(v))
  OR ({phrases}) AS bad FROM judged),
kept AS (SELECT doc_id, coalesce(sum(c) FILTER (NOT bad), 0) / sum(c) AS share FROM failed GROUP BY doc_id)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  (n_words < {words} OR 100 * n_repeat_words > {repeat} * n_words) AS base_failed,
  (NOT (n_words < {words} OR 100 * n_repeat_words > {repeat} * n_words) AND coalesce(share, 0) >= {share}) AS kept
FROM base LEFT JOIN kept USING (doc_id)
"""
_Q = quality_rules

_OP5 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, h, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS f FROM p),
g AS (SELECT page_id, strlen(h) AS n, f, list_transform(range(0, 8), lambda k: ('0x' || substr(x, (5 * k + 1)::INT, 5))::BIGINT) AS v FROM d)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(v, lambda q: substr(a, ((q // 32768) % 32 + 1)::INT, 1) || substr(a, ((q // 1024) % 32 + 1)::INT, 1) || substr(a, ((q // 32) % 32 + 1)::INT, 1) || substr(a, (q % 32 + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to
FROM g, (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS a)
"""

_OP7 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
n AS (SELECT *, row_number() OVER o AS k, count(*) OVER (PARTITION BY conv_id) AS n_turns,
  sum(length('### : </turn>x') + length(role) + length(text)
    + length(text) - length(replace(replace(replace(text, '\', ''), '#', ''), '<', ''))
    + length(role) - length(replace(replace(replace(replace(role, '\', ''), '#', ''), '<', ''), ':', ''))) OVER (o ROWS UNBOUNDED PRECEDING) AS upto
  FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)),
s AS (SELECT conv_id, max(n_turns) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY k) AS told,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), '') AS loss,
  coalesce(sum(upto) FILTER (role = 'assistant' OR k = n_turns), 0) AS formatted FROM n GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(told) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted::BIGINT AS formatted_chars FROM s
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP9 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT item_id, w, least(8, len(w)) AS n, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM g),
x AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes)),
h AS (SELECT x.doc_id, x.p, x.n, g.item_id FROM x JOIN g ON x.g = g.g AND x.n = g.n),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP10 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
linked AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT e.b, reach.r FROM reach JOIN edges e ON e.a = reach.doc_id WHERE reach.r < e.b),
least_of AS (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, r AS component_id, d.doc_id = r AS kept FROM d LEFT JOIN n USING (doc_id) JOIN least_of USING (doc_id)
"""

ORACLES = {
    "op1_quality_rules": _OP1.format(
        nav=_Q.NAV_WORDS, closing=_Q.CLOSING.replace("\\\\", "\\").replace("'", "''"), symbol=_Q.MAX_SYMBOL_SHARE, bar=_Q.MAX_BAR_SHARE, upper=_Q.MAX_UPPER_SHARE, long=_Q.LONG_LINE, distinct=_Q.MIN_DISTINCT_SHARE,
        phrases=" OR ".join(f"contains(lower(l), '{x}')" for x in _Q.BOILERPLATE), words=_Q.MIN_WORDS, repeat=_Q.MAX_REPEAT_PERCENT, share=_Q.MIN_KEPT_SHARE,
    ),
    "op5_warc": _OP5,
    "op7_chat": _OP7,
    "op9_decontamination": _OP9,
    "op10_minhash_forest": _OP10,
}
