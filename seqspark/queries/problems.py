"""Queries of the data-preparation problems that belong to the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intervals import merge_intervals
from ..operators.nested import merkle_tables, task_children
from ..operators.rejects import failed, loaded, parse_rows
from . import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return failed(parse_rows(table(spark, d, "hiv_mix_lines").select("line_id", "line"))).select("line_id", "reason")


def p1_loaded(spark: SparkSession, d: str) -> DataFrame:
    rows = loaded(parse_rows(table(spark, d, "hiv_mix_lines").select("line_id", "line")))
    return rows.select("line_id", F.coalesce(F.col("c0").cast("string"), F.col("wide")["c0"]).alias("c0"), *[f"c{i}" for i in range(1, 12)])


def p1_loaded_all(spark: SparkSession, d: str) -> DataFrame:
    """The good rows in the operator's own types; p1_loaded has the read number as its digits, for the comparison with SQL."""
    return loaded(parse_rows(table(spark, d, "hiv_mix_lines").select("line_id", "line"))).drop("line", "wide")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return task_children(merkle_tables(table(spark, d, "task_manifests"), "rec_id", "manifest"), "rec_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return merge_intervals(table(spark, d, "a_mg_reads_cds"), "sseqid", "s_start", "s_end")


QUERIES = {f.__name__: f for f in (p1_found, p1_loaded, p1_loaded_all, p2_found, p3_found)}

_FIELD = r"""("([^"]|"")*"|[^"\t]*)"""
_PARSED = rf"""
WITH x AS (SELECT line_id, regexp_replace(line, '\r$', '') AS t FROM hiv_mix_lines WHERE line IS NOT NULL),
y AS (SELECT * FROM x WHERE NOT starts_with(t, '#') AND regexp_matches(t, '\S')),
z AS (
  SELECT *, regexp_full_match(t, '{_FIELD}(\t{_FIELD})*') AS ok,
         len(string_split(regexp_replace(t, '"([^"]|"")*"', '', 'g'), chr(9))) AS n,
         regexp_extract(t, '^{_FIELD}', 1) AS q0, regexp_extract(t, '\t{_FIELD}$', 1) AS q11
  FROM y),
w AS (
  SELECT *, trim(CASE WHEN starts_with(q0, '"') THEN replace(q0[2:-2], '""', '"') ELSE q0 END) AS c0,
         trim(CASE WHEN starts_with(q11, '"') THEN replace(q11[2:-2], '""', '"') ELSE q11 END) AS c11
  FROM z),
v AS (
  SELECT *, CASE WHEN NOT ok THEN 'quoting' WHEN n <> 12 THEN 'columns'
                 WHEN NOT regexp_full_match(c0, '0*[1-9][0-9]*') OR NOT regexp_full_match(c11, '\+?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?')
                      OR NOT coalesce(isfinite(try_cast(c11 AS double)), false) THEN 'value' END AS reason
  FROM w)
"""
_CELLS = r"""
, u AS (SELECT *, list_transform(regexp_extract_all(chr(9) || t, '\t("([^"]|"")*"|[^"\t]*)', 1), lambda f: trim(CASE WHEN starts_with(f, '"') THEN replace(f[2:-2], '""', '"') ELSE f END)) AS f FROM v WHERE reason IS NULL)
"""

SQL = {
    "p1_found": _PARSED + "SELECT line_id, reason FROM v WHERE reason IS NOT NULL",
    "p1_loaded": _PARSED
    + _CELLS
    + "SELECT line_id, ltrim(c0, '0') AS c0, f[2] AS c1, try_cast(f[3] AS double) AS c2, " + ", ".join(f"try_cast(f[{i + 1}] AS int) AS c{i}" for i in range(3, 10)) + ", try_cast(f[11] AS double) AS c10, CAST(c11 AS double) AS c11 FROM u",
    "p2_found": """
WITH m AS (SELECT rec_id, CAST(manifest AS json) AS j FROM task_manifests WHERE manifest IS NOT NULL),
t0 AS (SELECT rec_id, CASE WHEN (j->'tasks') IS NULL THEN [j] WHEN json_type(j->'tasks') = 'ARRAY' THEN CAST((j->'tasks') AS json[]) ELSE [(j->'tasks')] END AS l FROM m),
t AS (SELECT rec_id, unnest(generate_series(0, len(l) - 1)) AS task_pos, unnest(l) AS task FROM t0),
f AS (SELECT rec_id, task_pos, unnest(['options', 'requires', 'see_also']) AS field, unnest([(task->'options'), (task->'requires'), (task->'see_also')]) AS v FROM t),
g AS (SELECT rec_id, task_pos, field, CASE WHEN json_type(v) = 'ARRAY' THEN CAST(v AS json[]) ELSE [v] END AS l FROM f WHERE v IS NOT NULL AND json_type(v) <> 'NULL'),
e AS (SELECT rec_id, task_pos, field, unnest(generate_series(0, len(l) - 1)) AS pos, unnest(l) AS e FROM g),
s AS (
  SELECT rec_id, task_pos, field, pos, CASE json_type(e) WHEN 'VARCHAR' THEN (e->>'$') WHEN 'OBJECT' THEN CASE WHEN field = 'options' THEN coalesce(nullif((e->>'opt'), ''), (e->>'name')) END END AS val
  FROM e WHERE field <> 'requires'
  UNION ALL
  SELECT rec_id, task_pos, 'perl_lib', pos, unnest(CASE json_type(e->'perl_lib') WHEN 'ARRAY' THEN CAST((e->'perl_lib') AS varchar[]) ELSE [(e->>'perl_lib')] END)
  FROM e WHERE field = 'requires' AND json_type(e) = 'OBJECT' AND (e->'perl_lib') IS NOT NULL)
SELECT rec_id, CAST(task_pos AS int) AS task_pos, field, CAST(pos AS int) AS pos, val FROM s WHERE val IS NOT NULL AND val <> ''
""",
    "p3_found": """
WITH r AS (SELECT sseqid, CAST(least(s_start, s_end) AS bigint) AS lo, max(CAST(greatest(s_start, s_end) AS bigint)) AS hi FROM a_mg_reads_cds
           WHERE sseqid IS NOT NULL AND s_start IS NOT NULL AND s_end IS NOT NULL GROUP BY ALL),
m AS (SELECT *, max(hi) OVER (PARTITION BY sseqid ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM r),
g AS (SELECT *, sum(CASE WHEN pm IS NULL OR lo > pm + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY sseqid ORDER BY lo ROWS UNBOUNDED PRECEDING) AS k FROM m),
c AS (SELECT sseqid, k, min(lo) AS s, max(hi) AS e FROM g GROUP BY ALL)
SELECT sseqid, 'covered' AS stretch, s AS start_pos, e AS end_pos FROM c
UNION ALL
SELECT sseqid, 'gap', pe + 1, s - 1 FROM (SELECT *, lag(e) OVER (PARTITION BY sseqid ORDER BY k) AS pe FROM c) WHERE pe IS NOT NULL
""",
}
