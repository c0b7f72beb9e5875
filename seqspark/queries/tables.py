"""Queries of the table operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tables as B
from . import table


def tab_filter(spark, d):
    parts = table(spark, d, "part").filter("p_size < 10").select("p_partkey")
    return B.filter_rows(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), parts, "l_partkey", "p_partkey")


def tab_filter_inverse(spark, d):
    parts = table(spark, d, "part").filter("p_size < 40").select("p_partkey")
    return B.filter_rows(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), parts, "l_partkey", "p_partkey", invert=True)


def tab_filter_list_order(spark, d):
    listed = table(spark, d, "customer").selectExpr("c_custkey", "c_custkey * 7 % 1009 as pos")
    return B.filter_rows(table(spark, d, "orders").select("o_orderkey", "o_custkey"), listed, "o_custkey", "c_custkey", "pos", "o_orderkey")


def tab_merge(spark, d):
    e = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("tag"), F.col("o_orderkey").alias("value"), F.col("o_orderkey").alias("pos"))
    return B.merge_lists(e, ["F", "O", "P"])


def tab_replace(spark, d):
    n = table(spark, d, "nation")
    return B.replace_column(table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("nation")), n.filter("n_nationkey < 20").select(F.col("n_nationkey").cast("string").alias("k"), "n_name"), "nation", "k", "n_name", "other")


def tab_round(spark, d):
    return B.round_cells(table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") * 1.37).alias("x"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("name")), 0, "floor")


def tab_split(spark, d):
    e = table(spark, d, "events").groupBy("user_id").pivot("event_type").agg(F.count(F.lit(1)))
    e = e.select(F.col("user_id"), *[F.col(f"`{c}`").cast("long").alias(f"n.{c}") for c in sorted(e.columns) if c != "user_id"])
    long = B.split_columns(e.toDF(*[c.replace(".", "/") for c in e.columns]), "user_id")
    return long


def _pairs(spark, d):
    m = table(spark, d, "rbm").filter("seq1 is not null and seq2 is not null and id is not null")
    return m.select(F.col("seq1").alias("a"), F.col("seq2").alias("b"), F.col("id").alias("value"))


def df2dist(spark, d):
    return B.distances(_pairs(spark, d), max_sim=100)


def df2dist_matrix(spark, d):
    p = _pairs(spark, d)
    ids = p.select(F.col("a").alias("id")).union(p.select("b")).distinct()
    return B.distances(p.filter("value > 60"), max_sim=100, default=0.3, ids=ids)


def df2dist_group(spark, d):
    return B.group_distances(_pairs(spark, d))


def df2dist_list(spark, d):
    p = B.distances(_pairs(spark, d), max_sim=100)
    groups = p.select(F.col("a").alias("id")).distinct().withColumn("group", F.substring("id", 1, 1))
    return B.grouped_pairs(p, groups)


def _presence(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row"), (F.col("l_suppkey") % 25).alias("column"))


def prefscore(spark, d):
    return B.preference_scores(_presence(spark, d), spark.range(0, 8).select(F.col("id").alias("column")))


def barplot_top(spark, d):
    e = table(spark, d, "lineitem").select(F.concat(F.lit("s"), (F.col("l_suppkey") % 60).cast("string")).alias("row"), F.col("l_returnflag").alias("column"), F.floor("l_quantity").alias("n"))
    return B.bar_table(e, "row", "column", "n", 12)


QUERIES = {f.__name__: f for f in (tab_filter, tab_filter_inverse, tab_filter_list_order, tab_merge, tab_replace, tab_round, tab_split, df2dist, df2dist_matrix, df2dist_group, df2dist_list, prefscore, barplot_top)}

_PAIRS = "p AS (SELECT seq1 AS a, seq2 AS b, id AS value FROM rbm WHERE seq1 IS NOT NULL AND seq2 IS NOT NULL AND id IS NOT NULL)"
_DIST = _PAIRS + ", d AS (SELECT a, b, min((100 - value) / 100) AS d FROM (SELECT * FROM p UNION ALL SELECT b, a, value FROM p) {w} GROUP BY ALL)"
SQL = {
    "tab_filter": "SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10)",
    "tab_filter_inverse": "SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)",
    "tab_filter_list_order": "SELECT max(o_orderkey) AS o_orderkey, o_custkey, o_custkey * 7 % 1009 AS list_pos FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey",
    "tab_merge": "SELECT o_custkey AS key, coalesce(max(o_orderkey) FILTER (o_orderstatus = 'F'), 0) AS F, coalesce(max(o_orderkey) FILTER (o_orderstatus = 'O'), 0) AS O, coalesce(max(o_orderkey) FILTER (o_orderstatus = 'P'), 0) AS P FROM orders GROUP BY 1",
    "tab_replace": "SELECT c_custkey, coalesce(n_name, 'other') AS nation FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey < 20",
    "tab_round": "SELECT CAST(c_custkey AS varchar) AS c_custkey, CAST(CAST(floor(c_custkey * 1.37) AS bigint) AS varchar) AS x, 'c' || c_custkey AS name FROM customer",
    "tab_split": "SELECT 'n_' || event_type AS name, user_id, count(*) AS value FROM events GROUP BY ALL",
    "df2dist": f"WITH {_DIST.format(w='')} SELECT * FROM d",
    "df2dist_matrix": f"WITH {_DIST.format(w='WHERE value > 60')}, i AS (SELECT a AS id FROM p UNION SELECT b FROM p) SELECT x.id AS a, y.id AS b, CASE WHEN x.id = y.id THEN 0 ELSE least(coalesce(d.d, 0.3), 0.3) END AS d FROM i AS x CROSS JOIN i AS y LEFT JOIN d ON d.a = x.id AND d.b = y.id",
    "df2dist_group": f"WITH {_PAIRS} SELECT least(a, b) AS a, greatest(a, b) AS b, median(value) AS d FROM p GROUP BY 1, 2",
    "df2dist_list": f"WITH {_DIST.format(w='')} SELECT left(a, 1) AS \"group\", a, b, d FROM d WHERE left(a, 1) = left(b, 1)",
    "prefscore": """
WITH p AS (SELECT DISTINCT l_orderkey AS r, l_suppkey % 25 AS c FROM lineitem),
rs AS (SELECT r, count(*) AS n, count(*) FILTER (c < 8) AS i FROM p GROUP BY 1), cs AS (SELECT c, count(*) AS m FROM p GROUP BY 1),
t AS (SELECT (SELECT count(*) FROM rs) AS U, (SELECT count(*) FROM cs) AS S, (SELECT count(*) FROM p) AS X),
b AS (SELECT c, (m + 1) / ((SELECT U FROM t) + 2) AS b FROM cs), a AS (SELECT *, (n + 1) / ((SELECT S FROM t) + 2) AS a FROM rs),
f AS (SELECT r, (2 * i - n) / (SELECT X FROM t) AS observed, a * (SELECT sum(CASE WHEN c < 8 THEN b ELSE -b END) FROM b) / ((SELECT sum(a) FROM a) * (SELECT sum(b) FROM b)) AS expected FROM a)
SELECT r AS "row", observed, expected, observed / abs(expected) AS score, CASE WHEN observed / abs(expected) > 1 + 100 / (SELECT U FROM t) THEN 1 WHEN observed / abs(expected) < -(1 + 100 / (SELECT U FROM t)) THEN -1 ELSE 0 END AS class FROM f""",
    "barplot_top": """
WITH e AS (SELECT 's' || (l_suppkey % 60) AS r, l_returnflag AS c, sum(CAST(floor(l_quantity) AS bigint)) AS n FROM lineitem GROUP BY ALL),
p AS (SELECT r, c, 100.0 * n / sum(n) OVER (PARTITION BY c) AS p FROM e),
g AS (SELECT r, c FROM (SELECT DISTINCT r FROM p) CROSS JOIN (SELECT DISTINCT c FROM p)),
m AS (SELECT g.r, median(coalesce(p.p, 0)) AS m FROM g LEFT JOIN p ON p.r = g.r AND p.c = g.c GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12)
SELECT coalesce(m.r, 'Other') AS "row", c AS "column", sum(p) AS percent FROM p LEFT JOIN m ON m.r = p.r GROUP BY ALL""",
}
