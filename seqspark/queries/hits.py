"""Queries of the hit operators, over the hit tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hits as H
from . import table


def go(spark: SparkSession, d: str) -> DataFrame:
    """Hits on function terms, each once."""
    return table(spark, d, "a_mg_cds_go").drop("loaded_at").dropDuplicates(["hit_id"])


def reads(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Hits of reads on genes, each distinct row once: a few rows of one hit_id differ in values, so the whole row counts. With ``columns``
    only these, the hit_id and a hash of the whole row cross the network."""
    t = table(spark, d, "a_mg_reads_cds").drop("loaded_at")
    if not columns:
        return t.distinct()
    return t.select(*dict.fromkeys(("hit_id", *columns)), F.xxhash64(*t.columns).alias("__row")).distinct().drop("__row")


def gene_lengths(spark: SparkSession, d: str) -> DataFrame:
    """The largest position of each gene; repeated rows make no difference to it."""
    h = table(spark, d, "a_mg_reads_cds").filter("sseqid is not null").groupBy("sseqid").agg(F.max(F.greatest("s_start", "s_end")).alias("length"))
    return h.filter("length is not null").withColumnRenamed("sseqid", "id")


def reads_per_gene(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d, "sseqid").filter("sseqid is not null").groupBy(F.col("sseqid").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("weight"))


def hits_best(spark, d):
    return H.best_hit(go(spark, d).filter("qseqid is not null")).select("qseqid", "hit_id", "bitscore")


def hits_top_n_evalue(spark, d):
    return H.top_hits(go(spark, d).filter("qseqid is not null"), 3, "evalue").select("qseqid", "hit_id", "evalue")


def hits_top_n_identity(spark, d):
    return H.top_hits(go(spark, d).filter("qseqid is not null"), 2, "pident").select("qseqid", "hit_id", "pident")


def hits_top_n_file_order(spark, d):
    return H.top_hits(go(spark, d).filter("qseqid is not null"), 4, "hit_id").select("qseqid", "hit_id")


def list_filter(spark, d):
    return H.filter_by_list(reads(spark, d, "sseqid"), go(spark, d), "sseqid", "qseqid").select("hit_id", "sseqid")


def list_filter_inverse(spark, d):
    return H.filter_by_list(reads(spark, d, "sseqid"), go(spark, d), "sseqid", "qseqid", invert=True).select("hit_id", "sseqid")


def hits_subsample_by_ids(spark, d):
    ids = table(spark, d, "part").select(F.concat(F.lit("A:"), F.col("p_partkey").cast("string")).alias("id"))
    return H.filter_by_list(go(spark, d), ids, "qseqid", "id").select("hit_id", "qseqid", "sseqid")


def hits_add_length(spark, d):
    return H.add_length(go(spark, d).filter("qseqid is not null"), gene_lengths(spark, d), "qseqid", name="gene_len", strict=False).select("hit_id", "qseqid", "gene_len")


def _cogs(spark, d):
    return go(spark, d).select(F.col("sseqid").alias("gene")).dropna().distinct().withColumn("category", F.translate(F.substring("gene", -2, 2), "0123456789", "JKLDVTMNUO"))


def hits_cog(spark, d):
    c = H.cog_categories(go(spark, d), _cogs(spark, d), "sseqid")
    return c.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def hits_sum_per_hit(spark, d):
    return H.sum_per_hit(reads(spark, d, "qseqid", "sseqid", "bitscore", "pident"), min_score=60, min_identity=80)


def hits_weighted_sum(spark, d):
    best = H.top_hits(go(spark, d).filter("qseqid is not null"), 1)
    return H.sum_per_hit(best, reads_per_gene(spark, d))


def hits_weighted_sum_norm(spark, d):
    return H.sum_per_hit(go(spark, d).filter("qseqid is not null"), reads_per_gene(spark, d), normalise=True, zero=True)


def _mates(spark, d):
    """Order lines as reads: sister reads of an order, on subjects named by the return flag."""
    li = table(spark, d, "lineitem")
    back = F.col("l_linestatus") == "F"
    at, n = F.col("l_partkey").cast("int"), F.col("l_quantity").cast("int")
    return li.select(F.col("l_orderkey").alias("base"), F.when(F.col("l_linenumber") % 2 == 0, "2").otherwise("1").alias("mate"), F.concat("l_returnflag", F.col("l_suppkey") % 3).alias("sseqid"), F.col("l_extendedprice").cast("double").alias("bitscore"), F.when(back, at + n).otherwise(at).alias("s_start"), F.when(back, at).otherwise(at + n).alias("s_end")).distinct()


def hits_paired(spark, d):
    return H.paired_hits(_mates(spark, d), F.col("base"), F.col("mate"), min_score=20000)


def hits_paired_best(spark, d):
    return H.paired_hits(_mates(spark, d), F.col("base"), F.col("mate"), orientation=4, top=2)


def hits_taxon_prepare(spark, d):
    genes = gene_lengths(spark, d).select(F.col("id").alias("gene"), F.substring("id", 1, 1).alias("contig"), F.col("length").alias("gene_len"))
    h = go(spark, d).withColumn("sseqid", F.concat(F.lit("gi|"), F.substring("sseqid", 4, 10), F.lit("|x")))
    return H.taxon_prepare(h, genes)


def hits_progress(spark, d):
    queries = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderkey").alias("rid"))
    h = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("qseqid"), F.col("l_orderkey").alias("hit_id"))
    return H.search_progress(h, queries)


def _directions(spark, d):
    m = table(spark, d, "rbm").dropna(subset=["seq1", "id1", "seq2", "id2", "bitscore", "id"])
    f = m.select(F.concat_ws(">", "seq1", "id1").alias("qseqid"), F.concat_ws(">", "seq2", "id2").alias("sseqid"), "bitscore", F.col("id").alias("pident"))
    return f, f.select(F.col("sseqid").alias("qseqid"), F.col("qseqid").alias("sseqid"), "bitscore", "pident")


def rbm(spark, d):
    f, r = (H.best_hit(x.withColumn("hit_id", F.concat_ws("|", F.format_number(1e6 - F.col("pident"), 4), "sseqid")), order="hit_id") for x in _directions(spark, d))
    return H.reciprocal_best_matches(f, r).select("qseqid", "sseqid", "bitscore", "pident")


def identity_by_pair(spark, d):
    m = table(spark, d, "rbm").filter("seq1 is not null and seq2 is not null and id is not null").distinct()
    return H.identity_statistics(m, ["seq1", "seq2"], "id", min_hits=5)


def _genomes(spark, d):
    """Parts as one genome and suppliers as another; order lines as hits of each on the other, the fewer as windows of 100 to 499."""
    li = table(spark, d, "lineitem")
    hit = ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 20_001 + F.col("l_partkey")) * 1_001 + F.col("l_suppkey")
    h = li.select(F.col("l_partkey").cast("string").alias("p"), F.col("l_suppkey").cast("string").alias("s"), (40 + F.col("l_quantity")).cast("double").alias("pident"), (F.col("l_linenumber") * 40).cast("int").alias("length"), (F.col("l_extendedprice") / 100).cast("double").alias("bitscore"), hit.alias("hit_id")).distinct()
    parts = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), (F.col("p_size") * 10 + 50).alias("length"))
    suppliers = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), (F.col("s_suppkey") % 400 + 100).alias("length"))
    return h.withColumnsRenamed({"p": "qseqid", "s": "sseqid"}), h.withColumnsRenamed({"s": "qseqid", "p": "sseqid"}), parts, suppliers


_LIMITS = {"min_length": 80, "min_identity": 60, "min_score": 150, "min_fraction": 0.5}


def aai_one_way(spark, d):
    return H.genome_identity(*_genomes(spark, d), min_hits=5, **_LIMITS).filter("direction <> 'two-way'")


def aai_two_way(spark, d):
    return H.genome_identity(*_genomes(spark, d), min_hits=1, **_LIMITS).filter("direction = 'two-way'")


def ani_two_way(spark, d):
    return H.genome_identity(*_genomes(spark, d), min_hits=1, correction=0.8621, min_length=120, min_identity=70)


def hits_first_queries(spark, d):
    """Sums over the first 50 queries in the order of the file."""
    return H.sum_per_hit(go(spark, d).filter("qseqid is not null"), max_queries=50)


def ani_corrected(spark, d):
    m = table(spark, d, "rbm").filter("seq1 is not null and seq2 is not null and id >= 70").distinct()
    return H.identity_statistics(m, ["seq1", "seq2"], "id", min_hits=3, correction=0.8621)


def _taxonomy(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    nodes = n.selectExpr("cast(1000 + n_nationkey as bigint) tax_id", "cast(100 + n_regionkey as bigint) parent_id", "'species' rank")
    nodes = nodes.unionByName(r.selectExpr("cast(100 + r_regionkey as bigint) tax_id", "cast(1 as bigint) parent_id", "'genus' rank"))
    nodes = nodes.unionByName(table(spark, d, "customer").selectExpr("cast(100000 + c_custkey as bigint) tax_id", "cast(1000 + c_nationkey as bigint) parent_id", "'strain' rank"))
    return nodes, r.selectExpr("cast(r_regionkey as bigint) rid", "cast(100 + r_regionkey as bigint) tax_id", "r_name name", "'scientific name' name_class")


def tax_rank(spark, d):
    nodes, names = _taxonomy(spark, d)
    h = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return H.hits_to_rank(h, F.col("o_custkey") + 100000, nodes, names).groupBy("taxon").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (hits_best, hits_top_n_evalue, hits_top_n_identity, hits_top_n_file_order, list_filter, list_filter_inverse, hits_subsample_by_ids, hits_add_length, hits_cog, hits_sum_per_hit, hits_weighted_sum, hits_weighted_sum_norm, hits_paired, hits_paired_best, hits_taxon_prepare, hits_progress, rbm, identity_by_pair, aai_one_way, aai_two_way, ani_two_way, hits_first_queries, ani_corrected, tax_rank)}

_GO = "go AS (SELECT DISTINCT * EXCLUDE (loaded_at) FROM a_mg_cds_go)"
_READS = "reads AS (SELECT DISTINCT * EXCLUDE (loaded_at) FROM a_mg_reads_cds)"
_LEN = _READS + ", len AS (SELECT sseqid AS id, max(greatest(s_start, s_end)) AS length FROM reads WHERE sseqid IS NOT NULL GROUP BY 1 HAVING max(greatest(s_start, s_end)) IS NOT NULL)"
_WEIGHT = _READS + ", w AS (SELECT sseqid AS id, CAST(count(*) AS double) AS weight FROM reads WHERE sseqid IS NOT NULL GROUP BY 1)"


def _top(n: int, order: str, columns: str) -> str:
    return f"WITH {_GO} SELECT {columns} FROM go WHERE qseqid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY qseqid ORDER BY {order}) <= {n}"


_PAIR = """
h AS ({hits}),
p AS (
  SELECT a.base, a.subject, a.bitscore + b.bitscore AS bitscore, least(a.s_start, a.s_end, b.s_start, b.s_end) AS s_from, greatest(a.s_start, a.s_end, b.s_start, b.s_end) AS s_to,
         CASE WHEN (a.s_start <= a.s_end) = (b.s_start <= b.s_end) THEN 1 WHEN (a.s_start <= b.s_start AND a.s_start <= a.s_end) OR (a.s_start > b.s_start AND b.s_start <= b.s_end) THEN 2 ELSE 3 END AS orientation
  FROM h AS a JOIN h AS b ON a.base = b.base AND a.subject = b.subject AND a.mate = '1' AND b.mate = '2')
"""
_MATES = "SELECT DISTINCT l_orderkey AS base, CASE WHEN l_linenumber % 2 = 0 THEN '2' ELSE '1' END AS mate, l_returnflag || (l_suppkey % 3) AS subject, CAST(l_extendedprice AS double) AS bitscore, l_partkey + CASE WHEN l_linestatus = 'F' THEN CAST(floor(l_quantity) AS int) ELSE 0 END AS s_start, l_partkey + CASE WHEN l_linestatus = 'F' THEN 0 ELSE CAST(floor(l_quantity) AS int) END AS s_end FROM lineitem"
_STATS = "SELECT seq1, seq2, count(*) AS n, avg({x}) AS identity, stddev_pop({x}) AS sd FROM (SELECT DISTINCT * FROM rbm) WHERE seq1 IS NOT NULL AND seq2 IS NOT NULL AND id IS NOT NULL {c} GROUP BY 1, 2 HAVING count(*) >= {n}"
_CHAIN = """
WITH h AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s, CAST(40 + l_quantity AS double) AS x, l_linenumber * 40 AS len, l_extendedprice / 100 AS bits, ((l_orderkey * 8 + l_linenumber) * 20001 + l_partkey) * 1001 + l_suppkey AS k FROM lineitem),
ok AS (SELECT p, s, x, k FROM h JOIN part ON p_partkey = p JOIN supplier ON s_suppkey = s WHERE len >= {l} AND x >= {i} AND bits >= {s} AND len / least(p_size * 10 + 50, s_suppkey % 400 + 100) >= {f}),
one AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY p ORDER BY k) = 1), two AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY s ORDER BY k) = 1),
w AS (SELECT 'one-way 1' AS direction, {c} AS y FROM one UNION ALL SELECT 'one-way 2', {c} FROM two UNION ALL SELECT 'two-way', {c} FROM two WHERE EXISTS (SELECT 1 FROM one WHERE one.p = two.p AND one.s = two.s)),
t AS (SELECT least((SELECT count(*) FROM part), (SELECT count(*) FROM supplier)) AS omega)
"""
_WAY = "SELECT * FROM (SELECT d.direction, CASE WHEN count(y) >= {n} THEN avg(y) END AS identity, CASE WHEN count(y) >= {n} THEN stddev_pop(y) END AS sd, count(y) AS n, any_value(omega) AS omega, 100.0 * count(y) / any_value(omega) AS frx FROM (SELECT unnest(['one-way 1', 'one-way 2', 'two-way']) AS direction) AS d CROSS JOIN t LEFT JOIN w ON w.direction = d.direction GROUP BY 1)"

SQL = {
    "hits_best": _top(1, "coalesce(isnan(bitscore), false), bitscore DESC NULLS LAST, hit_id", "qseqid, hit_id, bitscore"),
    "hits_top_n_evalue": _top(3, "evalue ASC NULLS LAST, hit_id", "qseqid, hit_id, evalue"),
    "hits_top_n_identity": _top(2, "pident DESC NULLS LAST, hit_id", "qseqid, hit_id, pident"),
    "hits_top_n_file_order": _top(4, "hit_id", "qseqid, hit_id"),
    "list_filter": f"WITH {_GO}, {_READS} SELECT hit_id, sseqid FROM reads WHERE sseqid IN (SELECT qseqid FROM go WHERE qseqid IS NOT NULL)",
    "list_filter_inverse": f"WITH {_GO}, {_READS} SELECT hit_id, sseqid FROM reads WHERE sseqid IS NULL OR sseqid NOT IN (SELECT qseqid FROM go WHERE qseqid IS NOT NULL)",
    "hits_subsample_by_ids": f"WITH {_GO} SELECT hit_id, qseqid, sseqid FROM go WHERE qseqid IN (SELECT 'A:' || p_partkey FROM part)",
    "hits_add_length": f"WITH {_GO}, {_LEN} SELECT hit_id, qseqid, len.length AS gene_len FROM go LEFT JOIN len ON id = qseqid WHERE qseqid IS NOT NULL",
    "hits_cog": f"WITH {_GO} SELECT category, count(*) AS n FROM (SELECT unnest(string_split(translate(right(sseqid, 2), '0123456789', 'JKLDVTMNUO'), '')) AS category FROM go WHERE sseqid IS NOT NULL) GROUP BY 1",
    "hits_sum_per_hit": f"WITH {_READS} SELECT sseqid AS subject, CAST(count(*) AS double) AS total FROM reads WHERE bitscore >= 60 AND pident >= 80 AND sseqid IS NOT NULL GROUP BY 1",
    "hits_weighted_sum": f"WITH {_GO}, {_WEIGHT}, b AS (SELECT * FROM go WHERE qseqid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY qseqid ORDER BY coalesce(isnan(bitscore), false), bitscore DESC NULLS LAST, hit_id) = 1) SELECT sseqid AS subject, sum(weight) AS total FROM b JOIN w ON id = qseqid WHERE bitscore >= 0 AND pident >= 0 AND sseqid IS NOT NULL GROUP BY 1",
    "hits_weighted_sum_norm": f"WITH {_GO}, {_WEIGHT}, k AS (SELECT *, count(*) OVER (PARTITION BY qseqid) AS n FROM go WHERE qseqid IS NOT NULL AND bitscore >= 0 AND pident >= 0 AND sseqid IS NOT NULL) SELECT sseqid AS subject, sum(coalesce(weight, 0) / n) AS total FROM k LEFT JOIN w ON id = qseqid GROUP BY 1",
    "hits_paired": "WITH " + _PAIR.format(hits=_MATES) + "SELECT *, s_to - s_from + 1 AS span FROM p WHERE bitscore > 20000",
    "hits_paired_best": "WITH " + _PAIR.format(hits=_MATES) + "SELECT *, s_to - s_from + 1 AS span FROM p WHERE bitscore > 0 AND orientation <> 1 QUALIFY row_number() OVER (PARTITION BY base ORDER BY bitscore DESC, subject, s_from, s_to) <= 2",
    "hits_taxon_prepare": f"WITH {_GO}, {_LEN} SELECT left(id, 1) AS contig, qseqid AS gene, coalesce(regexp_extract(go.sseqid[4:13], '^(\\d+)$', 1), '') AS gi, CASE WHEN NOT isnan(bitscore) THEN bitscore END AS bitscore, pident FROM go JOIN len ON id = qseqid WHERE go.length >= 0.75 * len.length / 3",
    "hits_progress": "WITH l AS (SELECT DISTINCT l_orderkey AS k FROM lineitem ORDER BY 1 DESC LIMIT 2) SELECT 100.0 * (CAST(min(k) AS double) + 1) / (SELECT count(*) FROM orders) AS percent FROM l",
    "rbm": """
WITH m AS (SELECT seq1 || '>' || id1 AS q, seq2 || '>' || id2 AS s, bitscore, id AS pident FROM rbm WHERE seq1 IS NOT NULL AND id1 IS NOT NULL AND seq2 IS NOT NULL AND id2 IS NOT NULL AND bitscore IS NOT NULL AND id IS NOT NULL),
f AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY q ORDER BY bitscore DESC, round(1e6 - pident, 4), s) = 1),
r AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY s ORDER BY bitscore DESC, round(1e6 - pident, 4), q) = 1)
SELECT f.q AS qseqid, f.s AS sseqid, f.bitscore, f.pident FROM f WHERE EXISTS (SELECT 1 FROM r WHERE r.s = f.s AND r.q = f.q)
""",
    "identity_by_pair": _STATS.format(x="id", c="", n=5),
    "aai_one_way": _CHAIN.format(c="(x)", l=80, i=60, s=150, f=0.5) + _WAY.format(n=5) + " WHERE direction <> 'two-way'",
    "aai_two_way": _CHAIN.format(c="(x)", l=80, i=60, s=150, f=0.5) + _WAY.format(n=1) + " WHERE direction = 'two-way'",
    "ani_two_way": _CHAIN.format(c="(100 - (100 - x) / 0.8621)", l=120, i=70, s=0, f=0) + _WAY.format(n=1),
    "hits_first_queries": f"WITH {_GO}, q AS (SELECT qseqid, min(hit_id) AS o FROM go WHERE qseqid IS NOT NULL AND bitscore >= 0 AND pident >= 0 AND sseqid IS NOT NULL GROUP BY 1 ORDER BY 2 LIMIT 50) SELECT sseqid AS subject, CAST(count(*) AS double) AS total FROM go WHERE qseqid IN (SELECT qseqid FROM q) AND bitscore >= 0 AND pident >= 0 AND sseqid IS NOT NULL GROUP BY 1",
    "ani_corrected": _STATS.format(x="100 - (100 - id) / 0.8621", c="AND id >= 70", n=3),
    "tax_rank": "SELECT r_name AS taxon, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1",
}
