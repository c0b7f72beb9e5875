"""Queries of ranges, model statistics and look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ranges as G
from ..operators import hits as H
from ..operators import models as M
from . import table
from .coverage import _HITS as _CAT
from .coverage import catsbj_hits
from .hits import go


def _locations(spark, d):
    p = F.col("p_partkey")
    s = p % 50 + 1
    t = F.concat(F.when(p % 2 == 0, "complement(").otherwise("join("), s.cast("string"), F.lit(".."), (s + 9).cast("string"), F.lit(","), (s + 5 + p % 9).cast("string"), F.lit("..>"), (s + 20).cast("string"), F.lit(")"))
    return table(spark, d, "part").select("p_partkey", t.alias("t"))


def range_algebra(spark, d):
    r = _locations(spark, d).select("p_partkey", G.parse_range(F.col("t")).alias("r"))
    return r.select("p_partkey", G.leftmost(F.col("r")).alias("a"), G.rightmost(F.col("r")).alias("b"), G.range_size(F.col("r")).alias("size"), G.range_size(G.compacted(F.col("r"))).alias("compact"), F.col("r")[0]["reverse"].alias("reverse"))


def list_filter_any_key(spark, d):
    r = table(spark, d, "customer").select(F.col("c_custkey").alias("rid"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.concat_ws(" ", F.concat(F.lit("c"), F.col("c_custkey").cast("string")), F.col("c_nationkey").cast("string")).alias("defline"))
    listed = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).otherwise(F.concat(F.lit(">c"), F.col("o_custkey").cast("string"), F.lit(" 7"))).alias("k"))
    return H.filter_any_key(r, listed, [F.col("id"), F.col("defline"), F.concat(F.lit(">"), "defline")], "k").select("id")


def _aligned(spark, d, salt):
    return table(spark, d, "part").select(F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("model"), F.translate(F.md5(F.concat((F.col("p_partkey") % 7).cast("string"), F.lit(salt))), "0123456789abcdef", "AAAACCCCDDDDEE--").alias("protein_aln"))


def haai(spark, d):
    return M.model_identity_summary(M.model_identity(_aligned(spark, d, "a"), _aligned(spark, d, "b")))


def _model_hits(spark, d):
    li = table(spark, d, "lineitem")
    return li.select((F.col("l_suppkey") % 10).alias("genome"), F.concat(F.lit("m"), (F.col("l_partkey") % 60).cast("string")).alias("query"), F.col("l_orderkey").alias("seq_id"), F.concat_ws("-", "l_orderkey", "l_partkey").alias("rid")).distinct()


def _models(spark, d):
    return spark.range(0, 50).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("model"))


def essential_quality(spark, d):
    return M.genome_quality(M.essential_genes(_model_hits(spark, d), _models(spark, d)), _models(spark, d))


def essential_copies(spark, d):
    return M.copy_numbers(M.essential_genes(_model_hits(spark, d), _models(spark, d)), _models(spark, d))


def hits_pathways(spark, d):
    m = go(spark, d).select(F.col("sseqid").alias("id")).dropna().distinct().select("id", F.explode(F.array(F.concat(F.lit("path:ko"), F.substring("id", -3, 3)), F.concat(F.lit("path:map"), F.substring("id", -2, 2)))).alias("pathway"))
    return M.pathways(go(spark, d), m).groupBy("pathway").agg(F.count(F.lit(1)).alias("n"))


def hits_first(spark, d):
    return M.first_matches(go(spark, d).filter("qseqid is not null"), 100, 40, 50).select("qseqid", "hit_id")


def hits_best_filtered(spark, d):
    return H.best_matches(go(spark, d).filter("qseqid is not null and not isnan(bitscore)"), 100, 40, 50, 0.5).select("qseqid", "hit_id")


def recplot_legacy(spark, d):
    return M.binned_depth_summary(catsbj_hits(spark, d))


def clusters_shared(spark, d):
    e = table(spark, d, "embeddings")
    return M.shared_members(e.select(F.col("vec_id").alias("item"), F.col("label").alias("cluster")), e.select(F.col("vec_id").alias("item"), (F.col("vec_id") % 10).alias("cluster")))


QUERIES = {f.__name__: f for f in (range_algebra, list_filter_any_key, haai, essential_quality, essential_copies, hits_pathways, hits_first, hits_best_filtered, recplot_legacy, clusters_shared)}

_GO = "go AS (SELECT DISTINCT * EXCLUDE (loaded_at) FROM a_mg_cds_go)"
_ALN = "translate(md5((p_partkey % 7) || '{s}'), '0123456789abcdef', 'AAAACCCCDDDDEE--')"
_HITS = "h AS (SELECT DISTINCT l_suppkey % 10 AS genome, l_partkey % 60 AS m, l_orderkey || '-' || l_partkey AS rid FROM lineitem WHERE l_partkey % 60 < 50)"

SQL = {
    "range_algebra": "WITH x AS (SELECT p_partkey, p_partkey % 50 + 1 AS s, p_partkey % 9 AS k FROM part) SELECT p_partkey, s AS a, s + 20 AS b, 10 + 16 - k AS size, CASE WHEN s + 5 + k <= s + 10 THEN 21 ELSE 26 - k END AS compact, p_partkey % 2 = 0 AS reverse FROM x",
    "list_filter_any_key": "SELECT 'c' || c_custkey AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0) OR (c_nationkey = 7 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 1))",
    "haai": f"""
WITH a AS (SELECT p_partkey AS m, {_ALN.format(s="a")} AS x, {_ALN.format(s="b")} AS y FROM part), c AS (SELECT m, x, y, unnest(generate_series(1, 32)) AS i FROM a),
v AS (SELECT m, 100.0::double * count(*) FILTER (x[i] = y[i]) / count(*) AS identity FROM c WHERE NOT (x[i] = '-' AND y[i] = '-') GROUP BY m)
SELECT avg(identity) AS haai, stddev_pop(identity) AS sd, count(*) AS models FROM v""",
    "essential_quality": f"WITH {_HITS}, g AS (SELECT genome, 100.0::double * count(DISTINCT m) / 50 AS completeness, 100.0::double * (count(*) - count(DISTINCT m)) / 50 AS contamination FROM h GROUP BY 1) SELECT *, completeness - 5 * contamination AS quality FROM g",
    "essential_copies": f"WITH {_HITS}, c AS (SELECT i, count(m) AS c FROM (SELECT unnest(generate_series(0, 49)) AS i) LEFT JOIN h ON m = i GROUP BY 1) SELECT avg(c) AS mean, median(c) AS median, count(*) FILTER (c > 0) AS found FROM c",
    "hits_pathways": f"WITH {_GO} SELECT 'path:map' || right(sseqid, 2) AS pathway, count(*) AS n FROM go WHERE sseqid IS NOT NULL GROUP BY 1",
    "hits_first": f"WITH {_GO} SELECT qseqid, min(hit_id) AS hit_id FROM go WHERE qseqid IS NOT NULL AND length >= 100 AND pident >= 40 AND bitscore >= 50 GROUP BY 1",
    "hits_best_filtered": f"WITH {_GO} SELECT qseqid, hit_id FROM go WHERE qseqid IS NOT NULL AND NOT isnan(bitscore) AND length >= 100 AND pident >= 40 AND bitscore >= 50 AND length / qry_len >= 0.5 QUALIFY row_number() OVER (PARTITION BY qseqid ORDER BY bitscore DESC, hit_id) = 1",
    "recplot_legacy": _CAT + "SELECT CAST(ceil((start + e) / 2 / 1000) AS bigint) AS bin, count(*) AS reads, CAST(sum(e - start + 1) AS bigint) AS bases, avg(pident) AS mean, quantile_cont(pident, 0.25) AS q25, median(pident) AS median, quantile_cont(pident, 0.75) AS q75 FROM cat WHERE pident > 95 GROUP BY 1",
    "clusters_shared": "WITH x AS (SELECT label AS a, vec_id % 10 AS b, count(*) AS n FROM embeddings GROUP BY ALL) SELECT a, b, n AS shared, sum(n) OVER (PARTITION BY a) + sum(n) OVER (PARTITION BY b) - n AS united FROM x",
}
