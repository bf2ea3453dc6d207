"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.decontaminate import decontaminate
from weftgraph.llm.exact_dedup import exact_groups
from weftgraph.llm.html_text import extract_text
from weftgraph.llm.language_model import language_model
from weftgraph.llm.licences import licence_scan
from weftgraph.llm.line_dedup import recurring_lines
from weftgraph.llm.mixing import mix_sources
from weftgraph.llm.near_dups import jaccard_join
from weftgraph.llm.secrets import secret_spans
from weftgraph.llm.toxicity import toxicity


def _read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(_read(spark, sf_dir, "documents", "doc_id", "text"), _read(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recurring_lines(_read(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.array_join("dropped", ",").alias("dropped_lines"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_read(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "class_id", "class_size", "n_links")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_read(spark, sf_dir, "documents", "doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_read(spark, sf_dir, "documents", "doc_id", "text"), _read(spark, sf_dir, "labels", "doc_id", "toxic")).select("doc_id", "held_out", "score", "predicted")


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op7_extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_read(spark, sf_dir, "pages", "page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op8_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(_read(spark, sf_dir, "documents", "doc_id", "text")).drop("base_spans")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_read(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(_read(spark, sf_dir, "documents", "doc_id", "text")).drop("text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_line_dedup": op2_line_dedup,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_mix_sources": op4_mix_sources,
    "op5_toxicity": op5_toxicity,
    "op6_language_model": op6_language_model,
    "op7_extract_text": op7_extract_text,
    "op8_secret_spans": op8_secret_spans,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_licence_scan": op10_licence_scan,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL: dict[str, str] = {
    "op1_decontaminate": f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS g
       FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT dw.r, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS l FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)""",
    "op3_jaccard_join": f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS c FROM s GROUP BY r),
k AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM k JOIN n p ON p.r = x JOIN n q ON q.r = y WHERE k.c >= 0.8 * (p.c + q.c - k.c) - 1e-6),
e AS MATERIALIZED (SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l),
reach(r, t) AS (SELECT r, r FROM d UNION SELECT reach.r, e.b FROM reach JOIN e ON e.a = reach.t),
classes AS (SELECT reach.r, min(d.doc_id) AS class_id, count(*) AS class_size FROM reach JOIN d ON d.r = reach.t GROUP BY reach.r),
links AS (SELECT a AS r, count(*) AS n_links FROM e GROUP BY a)
SELECT doc_id, class_id, class_size, coalesce(n_links, 0) AS n_links FROM d JOIN classes USING (r) LEFT JOIN links USING (r)""",
    "op4_mix_sources": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(0) || coalesce(text, '')) AS turn FROM documents),
s AS (SELECT source, sum(size) AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END AS weight
      FROM d GROUP BY source),
u AS (SELECT *, 2.0 * source_size AS full_, 2.0 * source_size / weight AS ratio FROM s),
v AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(full_) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM u),
t AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, CAST(least(full_, weight * (SELECT max(level) FROM v WHERE level <= ratio)) AS DOUBLE) AS target FROM v),
q AS (SELECT d.*, source_size, target, CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, round(target) - before)) + greatest(0, least(size, round(target) - source_size - before)) AS BIGINT) AS taken FROM q""",
    "op9_exact_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(length(text), 0) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY chars DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY norm) AS group_size,
             first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id NULLS LAST) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM g""",
}
