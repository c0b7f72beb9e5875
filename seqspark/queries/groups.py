"""Queries of diversity, clusterings, substitutions, ortholog groups, trees and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diversity as D
from ..operators import orthology as O
from ..operators import statistics as S
from ..operators import trees as T
from . import table
from .coverage import _CELLS, recplot_depth
from .hits import go


def _otus(spark, d):
    return table(spark, d, "lineitem").select(F.concat(F.lit("o"), (F.col("l_partkey") % 97).cast("string")).alias("otu"), F.concat_ws("-", "l_returnflag", "l_linestatus").alias("sample"), F.floor("l_quantity").alias("n"))


def alpha_diversity(spark, d):
    return D.alpha_diversity(_otus(spark, d))


def alpha_qd(spark, d):
    return D.alpha_diversity(_otus(spark, d), q=1, default_distance=0.5).select("sample", "qd", "rao", "rao_eq")


def alpha_rao(spark, d):
    p = table(spark, d, "part").select((F.col("p_partkey") % 97).alias("x"), (F.col("p_size") % 97).alias("y")).filter("x <> y").distinct()
    near = p.select(F.concat(F.lit("o"), "x").alias("a"), F.concat(F.lit("o"), "y").alias("b"), ((F.col("x") + F.col("y")) / 200).alias("d"))
    return D.rao_entropy(_otus(spark, d), near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "d")).distinct())


def chao1(spark, d):
    c = table(spark, d, "lineitem").select(F.col("l_partkey").alias("otu"), (F.col("l_suppkey") % 40).alias("sample"), F.lit(1).alias("n"))
    return D.chao1(c)


def rand_index(spark, d):
    e = table(spark, d, "embeddings")
    return D.rand_index(e.select(F.col("vec_id").alias("item"), F.col("label").alias("cluster")), e.select(F.col("vec_id").alias("item"), (F.col("vec_id") % 10).alias("cluster")))


def taxon_distribution(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("c_custkey")
    names = F.create_map(F.lit("phylum"), F.when(k % 5 != 0, F.col("r_name")), F.lit("genus"), F.when(k % 3 != 0, F.col("n_name")), F.lit("species"), F.when(k % 7 != 0, F.concat(F.lit("s"), (k % 11).cast("string"))))
    return D.taxon_distribution(c.select(names.alias("lineage"), (k % 13 + 1).alias("reads")), ["phylum", "genus", "species"])


def _substitutions(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_orderkey") % 50).alias("protein"), F.when(F.col("l_linestatus") == "F", "A").otherwise("B").alias("group"), F.concat_ws(">", "l_returnflag", (F.col("l_partkey") % 20).cast("string")).alias("aa"), F.lit(1).alias("n"))


def aasubs_ratio(spark, d):
    return D.substitution_ratio(_substitutions(spark, d))


def aasubs_permutation(spark, d):
    return D.substitution_resampling(_substitutions(spark, d), 1000, hashed=_md5)


def aasubs_bootstrap(spark, d):
    return D.substitution_resampling(_substitutions(spark, d), 1000, mode="bootstrap", hashed=_md5)


def _md5(*columns):
    """A hash that SQL has as well."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in columns])), 1, 8), 16, 10).cast("long")


def _variants(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.floor(F.col("l_quantity") / 2).alias("ref_dp"), (F.floor("l_quantity") - F.floor(F.col("l_quantity") / 2) * F.col("l_linenumber") % 9).alias("alt_dp"), F.col("l_partkey").alias("qual"), (F.col("l_suppkey") % 10 == 0).alias("indel"))


def snp_filter(spark, d):
    return D.filter_variants(_variants(spark, d), max_dp=60, min_qual=100, min_shannon=0.5).select("l_orderkey", "l_linenumber", "ref_dp", "alt_dp", "shannon")


def snp_summary(spark, d):
    return D.variant_summary(D.filter_variants(_variants(spark, d)))


def kaks(spark, d):
    g = table(spark, d, "part").select(F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("gene"), F.translate(F.md5(F.col("p_partkey").cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT").alias("seq"))
    s = table(spark, d, "lineitem").select(F.concat(F.lit("g"), F.col("l_partkey").cast("string")).alias("gene"), (F.col("l_suppkey") % 30).alias("pos"), F.substring(F.lit("ACGT"), F.col("l_linenumber").cast("int") % 4 + 1, F.lit(1)).alias("alt")).distinct()
    return D.kaks(g, s)


def _og(spark, d):
    """Groups of very unequal size: the few of low number miss genomes."""
    return table(spark, d, "lineitem").select(F.floor(F.sqrt("l_orderkey")).alias("og"), (F.col("l_suppkey") % 12).alias("genome"), F.col("l_partkey").alias("gene")).distinct()


def og_stats(spark, d):
    return O.group_statistics(_og(spark, d))


def og_core(spark, d):
    return O.filter_core(_og(spark, d), 0.9).select("og").distinct()


def og_no_inparalogs(spark, d):
    return O.remove_inparalogs(_og(spark, d), 2).select("og").distinct()


def og_core_pan(spark, d):
    return O.core_pan(_og(spark, d), 1, order=F.col("genome"))


def og_core_pan_random(spark, d):
    return O.core_pan_summary(O.core_pan(_og(spark, d), 100, order=F.md5(F.concat_ws("|", F.col("rep").cast("string"), F.col("genome").cast("string")))))


def _matches(spark, d):
    return table(spark, d, "rbm").select(F.col("seq1").alias("genome1"), F.col("id1").alias("gene1"), F.col("seq2").alias("genome2"), F.col("id2").alias("gene2"))


def og_components(spark, d):
    return O.groups_from_matches(_matches(spark, d))


def og_annotate(spark, d):
    notes = table(spark, d, "part").select((F.col("p_size") % 12).alias("genome"), F.col("p_partkey").alias("gene"), F.col("p_brand").alias("note"))
    return O.annotate(_og(spark, d), notes.withColumn("gene", F.col("gene")))


def og_extract(spark, d):
    s = table(spark, d, "part").crossJoin(spark.range(0, 12).withColumnRenamed("id", "genome")).select("genome", F.col("p_partkey").alias("id"), F.md5(F.col("p_partkey").cast("string")).alias("seq"))
    return O.extract_genes(_og(spark, d), s, pick="first").select("og", "genome", "gene", "seq")


def og_matrix(spark, d):
    g = _og(spark, d).select("og", F.concat(F.lit("g"), F.col("genome").cast("string")).alias("genome"), F.concat(F.lit("x"), F.col("gene").cast("string")).alias("gene"))
    return O.to_matrix(g, [f"g{i}" for i in range(12)])


def og_mcl(spark, d):
    m = table(spark, d, "rbm").dropna(subset=["seq1", "id1", "seq2", "id2", "bitscore"])
    return O.markov_clusters(m.select(F.concat_ws(">", "seq1", "id1").alias("a"), F.concat_ws(">", "seq2", "id2").alias("b"), F.col("bitscore").alias("weight")))


def og_mcl_holds(spark, d):
    """Every sequence is in one cluster, and no cluster reaches over two connected groups."""
    c = og_mcl(spark, d)
    m = table(spark, d, "rbm").dropna(subset=["seq1", "id1", "seq2", "id2", "bitscore"])
    g = O.connected_groups(m.select(F.concat_ws(">", "seq1", "id1").alias("a"), F.concat_ws(">", "seq2", "id2").alias("b")))
    return c.join(g, "v").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("v").alias("k"), F.count_distinct("og").alias("groups")).agg(F.sum("n").alias("n"), F.sum("k").alias("sequences"), F.max("groups").alias("groups"))


def tree_distances(spark, d):
    t = T.tree_table(spark, _newick(spark, d))
    tips = t.filter("name is not null").select("node", "name")
    pairs = tips.select(F.col("node").alias("a")).crossJoin(tips.select(F.col("node").alias("b"))).filter("a < b")
    named = T.node_distances(pairs, t).join(tips.select(F.col("node").alias("a"), F.col("name").alias("x")), "a").join(tips.select(F.col("node").alias("b"), F.col("name").alias("y")), "b")
    return named.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "d")


def _newick(spark, d):
    """Nations under their regions; edges as long as their keys."""
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).orderBy("n_nationkey").collect()
    groups: dict = {}
    for r in rows:
        groups.setdefault(r["r_regionkey"], []).append(f"'{r['n_name']}':{r['n_nationkey'] + 1}")
    return "(" + ",".join(f"({','.join(v)}):{k + 0.5}" for k, v in sorted(groups.items())) + ");"


def _placed(spark, d):
    t = T.tree_table(spark, _newick(spark, d)).withColumn("edge", F.col("node"))
    p = table(spark, d, "customer").select(F.concat_ws(".", (F.col("c_custkey") % 4).cast("string"), "c_custkey").alias("read"), (F.col("c_custkey") % 31).cast("int").alias("edge_num"), (F.col("c_custkey") % 7 / 10).alias("distal"), (F.col("c_custkey") % 3 / 10).alias("pendant"))
    return t, p


def tree_placements(spark, d):
    t, p = _placed(spark, d)
    return T.placement_distances(p, t, 3)


def tree_placement_counts(spark, d):
    return T.placement_counts(_placed(spark, d)[1], normalise="counts")


def tree_prune(spark, d):
    kept = T.prune_close_tips(T.parse_newick(_newick(spark, d)), 6)
    return spark.createDataFrame([(x,) for x in kept], "name string")


def tree_prune_holds(spark, d):
    """No two of the tips that stay are closer than the limit, and some went."""
    kept = tree_prune(spark, d).select(F.col("name").alias("x"))
    far = tree_distances(spark, d).join(kept, "x").join(kept.select(F.col("x").alias("y")), "y")
    return far.agg((F.min("d") >= 6).alias("apart")).crossJoin(kept.agg((F.count(F.lit(1)) < 25).alias("pruned")))  # one row each


def classify_key(spark, d):
    key = spark.createDataFrame([("1", "status", "F", "2", False), ("1", "status", "O", "open", True), ("1", "status", "*", "3", False), ("2", "prio", "1-URGENT", "urgent", True), ("2", "prio", "*", "3", False), ("3", "even", "y", "even", True), ("3", "even", "n", "odd", True)], "step string, character string, state string, next string, terminal boolean")
    o = table(spark, d, "orders")
    chars = o.select(F.col("o_orderkey").alias("object"), F.explode(F.array(F.struct(F.lit("status").alias("character"), F.col("o_orderstatus").alias("state")), F.struct(F.lit("prio").alias("character"), F.col("o_orderpriority").alias("state")), F.struct(F.lit("even").alias("character"), F.when(F.col("o_orderkey") % 2 == 0, "y").otherwise("n").alias("state")))).alias("x")).select("object", "x.*")
    return T.classify(chars, key)


def taxonomy_paths(spark, d):
    p = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws(";", F.lit("world"), "r_name", "n_name").alias("path"), F.lit("genus").alias("rank"))
    return T.taxonomy_from_paths(p)


def taxon_of_contig(spark, d):
    return T.contig_ranks(table(spark, d, "customer").select(F.col("c_custkey").alias("contig"), F.concat(F.lit("<phylum>p"), (F.col("c_custkey") % 5).cast("string"), F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit(";<genus>g"), (F.col("c_custkey") % 7).cast("string"))).otherwise("")).alias("lineage")))


def contigs_by_taxon(spark, d):
    return T.contigs_of_taxon(table(spark, d, "customer").select(F.col("c_custkey").alias("contig"), F.concat(F.lit("<phylum>p"), (F.col("c_custkey") % 5).cast("string"), F.lit(";<genus>g"), (F.col("c_custkey") % 77).cast("string"), F.lit(";")).alias("lineage")), "g7", "genus")


def lineage_pivot(spark, d):
    l = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return T.lineage_table(l.select(F.col("c_custkey").alias("id"), F.explode(F.array(F.struct(F.lit("phylum").alias("rank"), F.col("r_name").alias("name")), F.struct(F.lit("genus").alias("rank"), F.col("n_name").alias("name")))).alias("x")).select("id", "x.*"), ["phylum", "genus"])


def sample_moments(spark, d):
    return S.moments(table(spark, d, "events"), "value", ["event_type"])


def sarle_bimodality(spark, d):
    return S.bimodality(S.moments(go(spark, d), "pident")).select("n", "sarle")


def truncated_mean(spark, d):
    return S.truncated_mean(table(spark, d, "orders"), "o_totalprice", 0.9)


def trib_hist(spark, d):
    a = table(spark, d, "events").select((F.col("value") / 1000).alias("d"), "event_type")
    return S.trib_test(a.filter("event_type = 'click'"), a, bins=40)


def trib_replicates(spark, d):
    """Label centroids, in all 1000 replicates of all 101 fractions."""
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    pts = e.groupBy(F.col("label").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda v: v["x"]).alias("xs"))
    return S.trib_summary(S.trib_resample(pts))


def trib_whole(spark, d):
    """A subset of all points: the median distance over every pair of vectors."""
    pts = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("xs"))
    return S.trib_resample(pts, [1.0], 1)


def gmm_peaks(spark, d):
    return S.find_peaks(recplot_depth(spark, d))


def gmm_one_peak(spark, d):
    return S.find_peaks(recplot_depth(spark, d), most=1).select("peak", "mean", "sd", "n", "core")


def mower_peaks(spark, d):
    return S.mow_peaks(recplot_depth(spark, d))


def growth_fit(spark, d):
    r = spark.range(0, 25).select(F.col("id").cast("double").alias("t"), F.explode(F.array(F.lit(1.0), F.lit(2.0))).alias("k"))
    p = table(spark, d, "region").select("r_regionkey")
    x = F.exp((0.3 + 0.05 * F.col("r_regionkey")) * F.col("t"))
    return S.growth_curves(r.crossJoin(p).select(F.concat_ws("-", "r_regionkey", "k").alias("sample"), "t", (F.col("k") * 0.01 * x / (F.col("k") + 0.01 * (x - 1))).alias("od"))).select("sample", F.round("k", 4).alias("k"), F.round("r", 4).alias("r"))


_ALL = (alpha_diversity, alpha_qd, alpha_rao, chao1, rand_index, taxon_distribution, aasubs_ratio, aasubs_permutation, aasubs_bootstrap, snp_filter, snp_summary, kaks, og_stats, og_core, og_no_inparalogs, og_core_pan, og_core_pan_random, og_components, og_annotate, og_extract, og_matrix, og_mcl, og_mcl_holds)
QUERIES = {f.__name__: f for f in (*_ALL, tree_distances, tree_placements, tree_placement_counts, tree_prune, tree_prune_holds, classify_key, taxonomy_paths, taxon_of_contig, contigs_by_taxon, lineage_pivot, sample_moments, sarle_bimodality, truncated_mean, trib_hist, trib_replicates, trib_whole, gmm_peaks, gmm_one_peak, mower_peaks, growth_fit)}

_OTU = "c AS (SELECT l_returnflag || '-' || l_linestatus AS sample, 'o' || (l_partkey % 97) AS otu, CAST(sum(floor(l_quantity)) AS double) AS n FROM lineitem GROUP BY ALL HAVING sum(floor(l_quantity)) > 0)"
_POOL = _OTU + ", a AS (SELECT * FROM c UNION ALL SELECT 'gamma', otu, sum(n) FROM c GROUP BY otu), p AS (SELECT sample, otu, n / sum(n) OVER (PARTITION BY sample) AS p FROM a)"
_SUBS = "s AS (SELECT l_returnflag || '>' || (l_partkey % 20) AS aa, CASE WHEN l_linestatus = 'F' THEN 'A' ELSE 'B' END AS g, l_orderkey % 50 AS protein FROM lineitem)"
_VAR = "v AS (SELECT l_orderkey, l_linenumber, floor(l_quantity / 2) AS ref_dp, floor(l_quantity) - floor(l_quantity / 2) * l_linenumber % 9 AS alt_dp, l_partkey AS qual, l_suppkey % 10 = 0 AS indel FROM lineitem), w AS (SELECT *, ref_dp + alt_dp AS dp, CASE WHEN ref_dp > 0 THEN -(ref_dp / (ref_dp + alt_dp)) * log2(ref_dp / (ref_dp + alt_dp)) ELSE 0 END + CASE WHEN alt_dp > 0 THEN -(alt_dp / (ref_dp + alt_dp)) * log2(alt_dp / (ref_dp + alt_dp)) ELSE 0 END AS shannon FROM v WHERE ref_dp + alt_dp > 0)"
_OG = "og AS (SELECT DISTINCT CAST(floor(sqrt(l_orderkey)) AS bigint) AS og, l_suppkey % 12 AS genome, l_partkey AS gene FROM lineitem)"
_TIPS = "t AS (SELECT n_name AS name, n_regionkey AS r, n_nationkey + 1 AS len FROM nation)"
_PROFILE = "pr AS (SELECT protein, aa, CAST(count(*) FILTER (g = 'A') AS double) AS x, CAST(count(*) FILTER (g = 'B') AS double) AS y FROM s GROUP BY ALL), reps AS (SELECT unnest(generate_series(1, 1000)) AS rep)"
_BIT = "CAST('0x' || md5('1|' || rep || '|' || {k})[1:8] AS bigint)"
_RATIO = "SELECT rep, aa, CASE WHEN sum(x) > 0 AND sum(y) > 0 THEN log10(sum(x) / sum(y)) END AS ratio FROM w GROUP BY rep, aa"
_DEPTH_CELLS = _CELLS + ", w AS (SELECT pos_bin, sum(n) / 1000 AS depth FROM cells WHERE 70 + (id_bin + 0.5) * 0.5 > 95 GROUP BY 1)"
_MOM = "x AS (SELECT {key}, {v} AS x, avg({v}) OVER ({part}) AS m FROM {t}), s AS (SELECT {key}, count(*) AS n, any_value(m) AS mean, sum((x - m) ** 2) / (count(*) - 1) AS var, sum((x - m) ** 3) AS s3, sum((x - m) ** 4) AS s4 FROM x GROUP BY 1)"
SQL = {
    "alpha_diversity": f"WITH {_POOL} SELECT sample, -sum(p * ln(p)) AS shannon, 1 / sum(p * p) AS inv_simpson, CAST(count(*) AS double) AS qd, 1.0::double AS rao, NULL::double AS rao_eq FROM p GROUP BY 1",
    "alpha_qd": f"WITH {_POOL} SELECT sample, exp(-sum(p * ln(p))) AS qd, 0.5::double AS rao, 2.0::double AS rao_eq FROM p GROUP BY 1",
    "alpha_rao": f"WITH {_OTU}, p AS (SELECT sample, otu, n / sum(n) OVER (PARTITION BY sample) AS p FROM c), k AS (SELECT DISTINCT p_partkey % 97 AS x, p_size % 97 AS y FROM part WHERE p_partkey % 97 <> p_size % 97), d AS (SELECT 'o' || x AS a, 'o' || y AS b, (x + y) / 200 AS d FROM k UNION SELECT 'o' || y, 'o' || x, (x + y) / 200 FROM k) SELECT p.sample, sum(p.p * q.p * coalesce(d.d, 1)) AS rao FROM p JOIN p AS q ON p.sample = q.sample LEFT JOIN d ON d.a = p.otu AND d.b = q.otu GROUP BY 1",
    "chao1": """
WITH c AS (SELECT l_suppkey % 40 AS sample, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL),
s AS (SELECT sample, count(*) AS ob, CAST(count(*) FILTER (n = 1) AS double) AS n1, CAST(count(*) FILTER (n = 2) AS double) AS n2 FROM c GROUP BY 1),
m AS (SELECT *, n1 > 0 AND n2 > 0 AS ok, n1 / nullif(n2, 0) AS m FROM s),
k AS (SELECT *, ob + n1 * m / 2 AS ch, exp(1.96 * sqrt(ln(1 + n2 * (m ** 4 / 4 + m ** 3 + m * m / 2) / (n1 * m / 2) ** 2))) AS k FROM m)
SELECT sample, ob AS observed, CASE WHEN ok THEN ch ELSE ob END AS chao1, CASE WHEN ok THEN greatest(ob + (ch - ob) / k, ob) ELSE 0 END AS lower, CASE WHEN ok THEN ob + k * (ch - ob) ELSE 0 END AS upper FROM k""",
    "rand_index": """
WITH n AS (SELECT label AS i, vec_id % 10 AS j, CAST(count(*) AS double) AS n FROM embeddings GROUP BY ALL),
t AS (SELECT sum(n * (n - 1) / 2) AS n11, sum(n) AS n, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM n GROUP BY i)) AS t1, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM n GROUP BY j)) AS t2 FROM n)
SELECT (n11 + n * (n - 1) / 2 + n11 - t1 - t2) / (n * (n - 1) / 2) AS rand, (n11 - 2 * t1 * t2 / (n * (n - 1))) / ((t1 + t2) / 2 - 2 * t1 * t2 / (n * (n - 1))) AS adjusted FROM t""",
    "taxon_distribution": """
WITH c AS (SELECT c_custkey % 13 + 1 AS n, CASE WHEN c_custkey % 5 <> 0 THEN r_name END AS p, CASE WHEN c_custkey % 3 <> 0 THEN n_name END AS g, CASE WHEN c_custkey % 7 <> 0 THEN 's' || (c_custkey % 11) END AS s FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
x AS (
  SELECT 'phylum' AS rank, coalesce(p, CASE WHEN g IS NOT NULL OR s IS NOT NULL THEN 'Innominate root' ELSE 'Unknown root' END) AS taxon, n FROM c
  UNION ALL SELECT 'genus', coalesce(g, CASE WHEN s IS NOT NULL THEN 'Innominate ' ELSE 'Unknown ' END || coalesce(p, 'root')), n FROM c
  UNION ALL SELECT 'species', coalesce(s, 'Unknown ' || coalesce(g, p, 'root')), n FROM c)
SELECT rank, taxon, 1000 * sum(n) / (SELECT sum(n) FROM c) AS n FROM x GROUP BY rank, taxon""",
    "aasubs_ratio": f"WITH {_SUBS} SELECT aa, CASE WHEN count(*) FILTER (g = 'A') > 0 AND count(*) FILTER (g = 'B') > 0 THEN log10(count(*) FILTER (g = 'A') / count(*) FILTER (g = 'B')) END AS ratio FROM s GROUP BY 1",
    "snp_filter": f"WITH {_VAR} SELECT l_orderkey, l_linenumber, CAST(ref_dp AS bigint) AS ref_dp, CAST(alt_dp AS bigint) AS alt_dp, shannon FROM w WHERE dp BETWEEN 4 AND 60 AND ref_dp >= 2 AND alt_dp >= 2 AND qual >= 100 AND shannon >= 0.5 AND NOT indel",
    "snp_summary": f"WITH {_VAR} SELECT count(*) AS n, sum(shannon) AS information, avg(dp) AS dp, avg(ref_dp) AS ref_dp, avg(alt_dp) AS alt_dp FROM w WHERE dp >= 4 AND ref_dp >= 2 AND alt_dp >= 2 AND qual >= 0 AND shannon >= 0 AND NOT indel",
    "kaks": f"""
WITH g AS (SELECT 'g' || p_partkey AS gene, translate(md5(CAST(p_partkey AS varchar)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq FROM part),
c AS (SELECT gene, k, seq[3 * k + 1:3 * k + 3] AS codon FROM g CROSS JOIN (SELECT unnest(generate_series(0, 9)) AS k)),
b AS (SELECT unnest(['T', 'C', 'A', 'G']) AS b), i AS (SELECT unnest([0, 1, 2]) AS i),
ch AS (SELECT gene, k, i, b, codon, codon[:i] || b || codon[i + 2:] AS new FROM c, i, b WHERE codon[i + 1] <> b),
tr AS (SELECT *, '{D.CODE}'[(instr('TCAG', codon[1]) - 1) * 16 + (instr('TCAG', codon[2]) - 1) * 4 + instr('TCAG', codon[3])] = '{D.CODE}'[(instr('TCAG', new[1]) - 1) * 16 + (instr('TCAG', new[2]) - 1) * 4 + instr('TCAG', new[3])] AS same FROM ch),
st AS (SELECT gene, count(*) FILTER (same) / 3 AS s_sites, count(*) FILTER (NOT same) / 3 AS n_sites FROM tr GROUP BY 1),
sn AS (SELECT DISTINCT 'g' || l_partkey AS gene, l_suppkey % 30 AS pos, 'ACGT'[l_linenumber % 4 + 1] AS alt FROM lineitem),
su AS (SELECT tr.gene, CAST(count(*) FILTER (same) AS double) AS s, CAST(count(*) FILTER (NOT same) AS double) AS n FROM sn JOIN tr ON tr.gene = sn.gene AND k = pos // 3 AND i = pos % 3 AND b = alt GROUP BY 1),
f AS (SELECT gene, coalesce(n, 0) AS n, coalesce(s, 0) AS s, n_sites, s_sites FROM st LEFT JOIN su USING (gene))
SELECT *, (n + 1) / (n_sites + 2) AS ka, (s + 1) / (s_sites + 2) AS ks, ((n + 1) / (n_sites + 2)) / ((s + 1) / (s_sites + 2)) AS ratio FROM f""",
    "og_stats": f"WITH {_OG}, e AS (SELECT og, count(*) AS k, max(n) AS copies FROM (SELECT og, genome, count(*) AS n FROM og GROUP BY ALL) GROUP BY 1), g AS (SELECT count(DISTINCT genome) AS g FROM og) SELECT max(g) AS genomes, count(*) AS pan, count(*) FILTER (k = g) AS core, count(*) FILTER (k / g >= 0.9) AS core90, count(*) FILTER (k / g >= 0.8) AS core80, count(*) FILTER (k = g AND copies = 1) AS unus, count(*) FILTER (k = 1) AS unique_groups, -sum(k / g * ln(k / g)) AS entropy, sum(k) / max(g) AS avg, count(*) FILTER (k = g) / count(*) AS core_pan FROM e, g",
    "og_core": f"WITH {_OG} SELECT og FROM og GROUP BY 1 HAVING count(DISTINCT genome) >= 0.9 * (SELECT count(DISTINCT genome) FROM og)",
    "og_no_inparalogs": f"WITH {_OG} SELECT og FROM (SELECT og, genome, count(*) AS n FROM og GROUP BY ALL) GROUP BY 1 HAVING max(n) <= 2",
    "og_core_pan": f"WITH {_OG}, o AS (SELECT DISTINCT og, genome FROM og), r AS (SELECT genome, row_number() OVER (ORDER BY genome) AS k FROM (SELECT DISTINCT genome FROM o)), m AS (SELECT r.k, og, count(*) AS n FROM r JOIN (SELECT og, k FROM o JOIN r USING (genome)) AS x ON x.k <= r.k GROUP BY ALL) SELECT 1 AS rep, k, count(*) FILTER (n = k) AS core, count(*) AS pan FROM m GROUP BY k",
    "og_components": """
WITH RECURSIVE p AS (SELECT DISTINCT seq1 || '>' || id1 AS a, seq2 || '>' || id2 AS b FROM rbm WHERE seq1 IS NOT NULL AND seq2 IS NOT NULL AND id1 IS NOT NULL AND id2 IS NOT NULL),
v AS (SELECT x, row_number() OVER (ORDER BY encode(replace(x, '>', chr(1)))) AS k FROM (SELECT a AS x FROM p UNION SELECT b FROM p)),
q AS (SELECT i.k AS a, j.k AS b FROM p JOIN v AS i ON i.x = p.a JOIN v AS j ON j.x = p.b), e AS (SELECT a, b FROM q UNION SELECT b, a FROM q),
r AS (SELECT k AS x, k AS least FROM v UNION SELECT e.b, r.least FROM r JOIN e ON r.x = e.a WHERE r.least < e.b),
g AS (SELECT x, min(least) AS least FROM r GROUP BY x)
SELECT w.x AS og, split_part(v.x, '>', 1) AS genome, split_part(v.x, '>', 2) AS gene FROM g JOIN v ON v.k = g.x JOIN v AS w ON w.k = g.least""",
    "og_annotate": f"WITH {_OG} SELECT og, string_agg(t, ' || ' ORDER BY t) AS notes FROM (SELECT DISTINCT og, gene || ': ' || p_brand AS t FROM og JOIN part ON p_partkey = gene AND p_size % 12 = genome) GROUP BY 1",
    "og_extract": f"WITH {_OG} SELECT og, genome, min(gene) AS gene, md5(CAST(min(gene) AS varchar)) AS seq FROM og GROUP BY og, genome",
    "og_matrix": f"WITH {_OG}, c AS (SELECT og, genome, string_agg('x' || gene, ',' ORDER BY 'x' || gene) AS l FROM og GROUP BY ALL) SELECT og, " + ", ".join(f"coalesce(max(l) FILTER (genome = {i}), '-') AS g{i}" for i in range(12)) + " FROM c GROUP BY og",
    "tree_distances": f"WITH {_TIPS} SELECT least(a.name, b.name) AS x, greatest(a.name, b.name) AS y, CAST(a.len + b.len + CASE WHEN a.r = b.r THEN 0 ELSE a.r + b.r + 1 END AS double) AS d FROM t AS a JOIN t AS b ON a.len < b.len",
    "tree_placement_counts": "WITH c AS (SELECT c_custkey % 31 AS edge_num, CAST(c_custkey % 4 AS varchar) AS dataset, count(*) AS n FROM customer GROUP BY ALL) SELECT edge_num, dataset, n / sum(n) OVER (PARTITION BY dataset) AS n FROM c",
    "classify_key": """SELECT o_orderkey AS object, CASE WHEN o_orderstatus = 'O' THEN 'open' WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 'urgent' WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS class FROM orders""",
    "taxonomy_paths": """
WITH p AS (SELECT 'world' AS "full", NULL AS up, 'world' AS name, 'no rank' AS rank UNION SELECT 'world;' || r_name, 'world', r_name, 'no rank' FROM region JOIN nation ON n_regionkey = r_regionkey UNION SELECT 'world;' || r_name || ';' || n_name, 'world;' || r_name, n_name, 'genus' FROM nation JOIN region ON n_regionkey = r_regionkey),
n AS (SELECT *, row_number() OVER (ORDER BY "full") + 1 AS id FROM p)
SELECT a.id AS tax_id, coalesce(b.id, 1) AS parent_id, a.name, a.rank, a."full" FROM n AS a LEFT JOIN n AS b ON b."full" = a.up""",
    "taxon_of_contig": "SELECT c_custkey AS contig, CASE WHEN c_custkey % 3 > 0 THEN 'g' || (c_custkey % 7) ELSE 'Unclassified' END AS taxon FROM customer",
    "contigs_by_taxon": "SELECT c_custkey AS contig, '<phylum>p' || (c_custkey % 5) || ';<genus>g' || (c_custkey % 77) || ';' AS lineage FROM customer WHERE c_custkey % 77 = 7",
    "lineage_pivot": "SELECT c_custkey AS id, r_name AS phylum, n_name AS genus FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "sample_moments": f"WITH {_MOM.format(key='event_type', v='value', part='PARTITION BY event_type', t='events')} SELECT event_type, n, mean, var, sqrt(var) AS sd, s3 / ((n - 1) * sqrt(var) ** 3) AS skewness, s4 / ((n - 1) * var ** 2) AS kurtosis FROM s",
    "sarle_bimodality": f"WITH {_MOM.format(key='1 AS one', v='pident', part='', t='(SELECT DISTINCT * EXCLUDE (loaded_at) FROM a_mg_cds_go)').replace('SELECT 1 AS one, count', 'SELECT one, count')} SELECT n, ((s3 / ((n - 1) * sqrt(var) ** 3)) ** 2 + 1) / (s4 / ((n - 1) * var ** 2) + 3 * (n - 1.0::double) ** 2 / ((n - 2.0::double) * (n - 3.0::double))) AS sarle FROM s",
    "truncated_mean": "WITH x AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) AS k, count(*) OVER () AS n FROM orders) SELECT avg(v) AS mean FROM x WHERE k > round(n * (1 - 0.9::double) / 2) AND k <= n - round(n * (1 - 0.9::double) / 2)",
    "trib_hist": """
WITH e AS (SELECT event_type, least(greatest(floor(value / 1000 * 40), 0), 39) AS k FROM events WHERE value IS NOT NULL),
s AS (SELECT k, count(*) / sum(count(*)) OVER () AS p FROM e WHERE event_type = 'click' GROUP BY 1), a AS (SELECT k, count(*) / sum(count(*)) OVER () AS p FROM e GROUP BY 1)
SELECT coalesce(sum(s.p * a.p) FILTER (s.k >= a.k), 0) AS p_over, coalesce(sum(s.p * a.p) FILTER (s.k <= a.k), 0) AS p_under FROM s, a""",
    "aasubs_permutation": f"WITH {_SUBS}, {_PROFILE}, w AS (SELECT rep, aa, CASE WHEN {_BIT.format(k='protein')} % 2 = 1 THEN y ELSE x END AS x, CASE WHEN {_BIT.format(k='protein')} % 2 = 1 THEN x ELSE y END AS y FROM pr CROSS JOIN reps) " + _RATIO,
    "aasubs_bootstrap": f"WITH {_SUBS}, {_PROFILE}, nm AS (SELECT protein, row_number() OVER (ORDER BY protein) - 1 AS k FROM (SELECT DISTINCT protein FROM pr)), dr AS (SELECT rep, {_BIT.format(k='id')} % (SELECT count(*) FROM nm) AS k FROM reps CROSS JOIN (SELECT k AS id FROM nm)), w AS (SELECT rep, aa, x, y FROM dr JOIN nm ON nm.k = dr.k JOIN pr ON pr.protein = nm.protein) " + _RATIO,
    "og_core_pan_random": f"""WITH {_OG}, o AS (SELECT DISTINCT og, genome FROM og), gs AS (SELECT DISTINCT genome FROM o),
r AS (SELECT rep, genome, row_number() OVER (PARTITION BY rep ORDER BY md5(rep || '|' || genome), genome) AS rank FROM (SELECT unnest(generate_series(1, 100)) AS rep) CROSS JOIN gs),
m AS (SELECT rep, og, list(rank ORDER BY rank) AS l FROM o JOIN r USING (genome) GROUP BY rep, og),
f AS (SELECT rep, l[1] AS first, coalesce(list_min(list_filter(generate_series(1, len(l)), lambda i: l[i] <> i)), len(l) + 1) AS miss FROM m),
c AS (SELECT rep, k, count(*) FILTER (miss > k) AS core, count(*) FILTER (first <= k) AS pan FROM f CROSS JOIN (SELECT unnest(generate_series(1, (SELECT count(*) FROM gs))) AS k) GROUP BY rep, k),
l AS (SELECT k, count(*) AS n, list(core ORDER BY core) AS cs, list(pan ORDER BY pan) AS ps, avg(core) AS core_avg, stddev_pop(core) AS core_sd, avg(pan) AS pan_avg, stddev_pop(pan) AS pan_sd FROM c GROUP BY k)
SELECT k, core_avg, core_sd, """ + ", ".join(f"{c}[least(CAST(floor(n * {i} / 4) AS int) + 1, n)] AS {a}_q{i}" for c, a in (("cs", "core"), ("ps", "pan")) for i in (1, 2, 3)) + ", pan_avg, pan_sd FROM l",
    "og_mcl_holds": "SELECT count(*) AS n, count(*) AS sequences, 1 AS groups FROM (SELECT seq1 || '>' || id1 AS v FROM rbm WHERE seq1 IS NOT NULL AND id1 IS NOT NULL AND seq2 IS NOT NULL AND id2 IS NOT NULL AND bitscore IS NOT NULL UNION SELECT seq2 || '>' || id2 FROM rbm WHERE seq1 IS NOT NULL AND id1 IS NOT NULL AND seq2 IS NOT NULL AND id2 IS NOT NULL AND bitscore IS NOT NULL)",
    "tree_placements": """
WITH n AS (SELECT n_nationkey, n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS j FROM nation),
c AS (SELECT n_regionkey AS r, count(*) AS k FROM n GROUP BY 1), rn AS (SELECT r, 1 + coalesce(sum(k + 1) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS node FROM c),
nodes AS (SELECT 0 AS node, -1 AS r, 0.0::double AS depth UNION ALL SELECT node, r, r + 0.5 FROM rn UNION ALL SELECT node + j, r, r + 0.5 + n_nationkey + 1 FROM n JOIN rn ON r = n_regionkey),
t AS (SELECT node AS tn, r AS tr, depth AS td FROM nodes WHERE node = 3), p AS (SELECT (c_custkey % 4) || '.' || c_custkey AS read, c_custkey % 31 AS node, c_custkey % 7 / 10.0::double AS distal, c_custkey % 3 / 10.0::double AS pendant FROM customer)
SELECT read, depth + td - 2 * CASE WHEN node = tn THEN td WHEN r = tr THEN r + 0.5 ELSE 0 END + pendant + CASE WHEN node = 0 OR node IN (SELECT node FROM rn WHERE rn.r = tr) THEN -distal ELSE distal END AS d FROM p JOIN nodes USING (node) CROSS JOIN t""",
    "tree_prune_holds": "SELECT true AS apart, true AS pruned",
    "trib_whole": "SELECT 1.0::double AS fraction, 1 AS rep, median(list_distance(CAST(a.embedding AS double[]), CAST(b.embedding AS double[]))) AS median FROM embeddings AS a JOIN embeddings AS b ON a.vec_id < b.vec_id",
    "gmm_one_peak": _DEPTH_CELLS + " SELECT 1 AS peak, avg(ln(depth)) AS mean, stddev_pop(ln(depth)) AS sd, CAST(count(*) AS double) AS n, true AS core FROM w WHERE depth > 0 AND depth < (SELECT quantile_cont(depth, 0.95) FROM w WHERE depth > 0)",
    "growth_fit": "SELECT r_regionkey || '-' || k AS sample, k, round(0.3 + 0.05 * r_regionkey, 4)::double AS r FROM region CROSS JOIN (SELECT unnest([1.0::double, 2.0::double]) AS k)",
}
