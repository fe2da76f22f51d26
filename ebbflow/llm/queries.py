"""The registered queries of this subpackage: thin wrappers over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, htmltext, mixing, near, packing, quality, repeats, secrets, toxicity, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.round_trip(spark, table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_components(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_passages(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact.DigestIndex.fresh(spark)
    rows = index.assign(table(spark, sf_dir, "documents"))
    index.drop()
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Query] = {
    "op1_warc": op1_warc,
    "op2_mixing": op2_mixing,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_packing": op5_packing,
    "op6_toxicity": op6_toxicity,
    "op7_secret_scan": op7_secret_scan,
    "op8_repeated_passages": op8_repeated_passages,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_html_extraction": op10_html_extraction,
}

_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"

_CFG = quality.QualityConfig()
_RULE_ROWS = ", ".join(f"('{r.name}', CASE WHEN {r.bottom} > 0 THEN {r.top} / {r.bottom} ELSE 0.0 END, {r.slack!r})" for r in _CFG.rules)

OP4_SQL = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '~null') AS lang, coalesce(source, '~null') AS source, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (
  SELECT rid, regexp_extract_all(t, '{_WORD}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM d),
grams AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM again, (VALUES (0), (1), (2)) AS o(k) GROUP BY rid),
c AS MATERIALIZED (
  SELECT d.rid, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines
  FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid)),
r AS MATERIALIZED (
  SELECT rid, lang, source, rule, x, slack, CAST(ceil(round(ln(1.0 + x) / ln({_CFG.growth!r}::DOUBLE), 9)) AS BIGINT) AS bucket
  FROM c, LATERAL (VALUES {_RULE_ROWS}) AS v(rule, x, slack) WHERE n_words > 0),
levels AS (
  SELECT lang, source, rule, bucket, slack, 0 AS level FROM r UNION ALL SELECT lang, '', rule, bucket, slack, 1 FROM r UNION ALL SELECT '', '', rule, bucket, slack, 2 FROM r),
h AS (SELECT level, lang, source, rule, bucket, any_value(slack) AS slack, count(*) AS n FROM levels GROUP BY ALL),
runs AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rule ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, lang, source, rule) AS total FROM h),
q AS (
  SELECT level, lang, source, rule, any_value(slack) AS slack, max(total) AS total,
    min(CASE WHEN upto >= ceil(0.5 * total) THEN pow({_CFG.growth!r}::DOUBLE, bucket) - 1.0 END) AS mid,
    min(CASE WHEN upto >= ceil({_CFG.upper!r} * total) THEN pow({_CFG.growth!r}::DOUBLE, bucket) - 1.0 END) AS up
  FROM runs GROUP BY ALL),
f AS MATERIALIZED (SELECT level, lang, source, rule, total, mid, up, up + greatest({_CFG.fence!r} * (up - mid), slack) AS fence FROM q),
limits AS (
  SELECT a.lang, a.source, a.rule, a.total, a.mid, a.up, a.fence, e.fence AS every,
    CASE WHEN b.total < {_CFG.min_rows} THEN e.fence WHEN b.mid <= e.fence AND b.up > e.fence THEN e.fence ELSE b.fence END AS wide
  FROM f a JOIN f b ON b.level = 1 AND b.lang = a.lang AND b.rule = a.rule JOIN f e ON e.level = 2 AND e.rule = a.rule WHERE a.level = 0),
bad AS (
  SELECT DISTINCT r.rid FROM r
  JOIN limits a ON a.lang = r.lang AND a.source = r.source AND a.rule = r.rule
  WHERE r.x > CASE WHEN a.total < {_CFG.min_rows} THEN wide WHEN a.mid <= least(wide, every) AND a.up > least(wide, every) THEN least(wide, every) ELSE a.fence END)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND rid NOT IN (SELECT rid FROM bad) AS kept
FROM c
"""

OP9_SQL = rf"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '{_SPACE}', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id IS NOT DISTINCT FROM first_value(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""

OP3_SQL = rf"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT rid, h FROM (
    SELECT rid, hash(array_to_string(ws[i:i + 4], ' ')) AS h FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)
    UNION ALL SELECT rid, hash(array_to_string(ws, ' ')) FROM d WHERE len(ws) BETWEEN 1 AND 4)),
n AS MATERIALIZED (SELECT rid, count(*) AS n FROM s GROUP BY rid),
pairs AS (SELECT a.rid AS x, b.rid AS y, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.rid <> b.rid GROUP BY ALL),
links AS MATERIALIZED (
  SELECT dx.doc_id AS x, dy.doc_id AS y FROM pairs JOIN n nx ON nx.rid = x JOIN n ny ON ny.rid = y JOIN d dx ON dx.rid = x JOIN d dy ON dy.rid = y
  WHERE 100 * k >= 75 * (nx.n + ny.n - k)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
low AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, low.component_id, d.doc_id = low.component_id AS kept
FROM d LEFT JOIN n USING (rid) JOIN low ON low.x = d.doc_id
"""

OP1_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

ORACLES: dict[str, str] = {"op1_warc": OP1_SQL, "op3_minhash_near_dedup": OP3_SQL, "op4_quality_rules": OP4_SQL, "op9_exact_dedup": OP9_SQL}
