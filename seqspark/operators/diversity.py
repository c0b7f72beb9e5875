"""Diversity of samples, agreement of clusterings, taxon shares, substitutions and variants."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import store
from .sequences import numbered


def with_pooled(counts: DataFrame, sample: str = "sample", otu: str = "otu", n: str = "n", pooled: str = "gamma") -> DataFrame:
    """(sample, otu, n) added up, with all samples together as one more."""
    each = counts.filter(F.col(n) > 0).groupBy(sample, otu).agg(F.sum(n).cast("double").alias("n"))
    return each.unionByName(each.groupBy(otu).agg(F.sum("n").alias("n")).withColumn(sample, F.lit(pooled)))


def alpha_diversity(counts: DataFrame, sample: str = "sample", otu: str = "otu", n: str = "n", q: float = 0, default_distance: float = 1, gamma: bool = True) -> DataFrame:
    """(sample, shannon, inv_simpson, qd, rao, rao_eq): Shannon index (natural log), inverse Simpson, effective number of order ``q``, Rao's
    entropy where any two OTUs, and one with itself, are ``default_distance`` apart, and 1/(1-Rao), null where that is infinite."""
    c = with_pooled(counts, sample, otu, n) if gamma else counts.filter(F.col(n) > 0).groupBy(sample, otu).agg(F.sum(n).cast("double").alias("n"))
    tot = c.groupBy(sample).agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    s = c.join(tot, sample).groupBy(sample).agg((-F.sum(p * F.ln(p))).alias("shannon"), (1 / F.sum(p * p)).alias("inv_simpson"), F.sum(F.pow(p, q)).alias("__q"))
    qd = F.exp("shannon") if q == 1 else F.pow("__q", 1 / (1 - q))
    s = s.withColumn("qd", qd).withColumn("rao", F.lit(float(default_distance)))
    return s.withColumn("rao_eq", F.when(F.col("rao") != 1, 1 / (1 - F.col("rao")))).drop("__q")


def rao_entropy(counts: DataFrame, distance: DataFrame, sample: str = "sample", otu: str = "otu", n: str = "n", default: float = 1) -> DataFrame:
    """(sample, rao): entropy with distances (a, b, d) given for some pairs of OTUs, one row a direction; all others are ``default`` apart.

    Only listed pairs are joined: rao = default + sum over them of (d - default) p_a p_b, so no sample's OTUs are paired with each other."""
    c = counts.filter(F.col(n) > 0).groupBy(sample, otu).agg(F.sum(n).cast("double").alias("n"))
    p = c.join(c.groupBy(sample).agg(F.sum("n").alias("t")), sample).select(sample, otu, (F.col("n") / F.col("t")).alias("p"))
    x = p.withColumnRenamed(otu, "a").join(distance, "a").join(p.select(sample, F.col(otu).alias("b"), F.col("p").alias("pb")), [sample, "b"])
    extra = x.groupBy(sample).agg(F.sum((F.col("d") - default) * F.col("p") * F.col("pb")).alias("e"))
    return p.select(sample).distinct().join(extra, sample, "left").select(sample, (default + F.coalesce("e", F.lit(0.0))).alias("rao"))


def chao1(counts: DataFrame, sample: str = "sample", otu: str = "otu", n: str = "n") -> DataFrame:
    """(sample, observed, chao1, lower, upper): richness with a log-normal 95 % interval; observed, observed, 0, 0 without singletons or doubletons."""
    c = counts.filter(F.col(n) > 0).groupBy(sample, otu).agg(F.sum(n).alias("n"))
    one = lambda k: F.sum(F.when(F.col("n") == k, 1).otherwise(0))
    s = c.groupBy(sample).agg(F.count(F.lit(1)).alias("observed"), one(1).cast("double").alias("n1"), one(2).cast("double").alias("n2"))
    ok = (F.col("n1") > 0) & (F.col("n2") > 0)
    m, ob = F.col("n1") / F.nullif("n2", F.lit(0.0)), F.col("observed")
    ch = ob + F.col("n1") * m / 2
    var = F.col("n2") * (F.pow(m, 4) / 4 + F.pow(m, 3) + m * m / 2)
    k = F.exp(1.96 * F.sqrt(F.ln(1 + var / F.pow(ch - ob, 2))))
    return s.select(sample, "observed", F.when(ok, ch).otherwise(ob).alias("chao1"), F.when(ok, F.greatest(ob + (ch - ob) / k, ob.cast("double"))).otherwise(0.0).alias("lower"), F.when(ok, ob + k * (ch - ob)).otherwise(0.0).alias("upper"))


def rand_index(a: DataFrame, b: DataFrame, item: str = "item", cluster: str = "cluster") -> DataFrame:
    """(rand, adjusted): agreement of two clusterings of the same items."""
    x = a.select(item, F.col(cluster).alias("i")).join(b.select(item, F.col(cluster).alias("j")), item)
    nij = x.groupBy("i", "j").agg(F.count(F.lit(1)).cast("double").alias("n"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    t = lambda k, name: nij.groupBy(k).agg(F.sum("n").alias("m")).agg(pairs("m").alias(name))
    s = nij.agg(pairs("n").alias("n11"), F.sum("n").alias("n")).crossJoin(t("i", "t1")).crossJoin(t("j", "t2"))  # one row each
    p = F.col("n") * (F.col("n") - 1) / 2
    t3 = 2 * F.col("t1") * F.col("t2") / (F.col("n") * (F.col("n") - 1))
    return s.select(((F.col("n11") + p + F.col("n11") - F.col("t1") - F.col("t2")) / p).alias("rand"), ((F.col("n11") - t3) / ((F.col("t1") + F.col("t2")) / 2 - t3)).alias("adjusted"))


def taxon_distribution(contigs: DataFrame, ranks: list[str], lineage: str = "lineage", reads: str = "reads", permil: bool = True) -> DataFrame:
    """(rank, taxon, n): reads rolled up at each rank. lineage: map of rank to taxon. A contig without the rank counts as ``Innominate`` and
    the nearest named rank above if it has one below, else as ``Unknown`` and the last named rank."""
    x = contigs.select(F.col(lineage).alias("l"), F.col(reads).alias("n"))
    names = F.array(*[F.struct(F.lit(r).alias("rank"), F.lit(i).alias("k"), F.col("l")[r].alias("t")) for i, r in enumerate(ranks)])
    x = x.withColumn("ts", names).select("n", "ts", F.explode("ts").alias("x"))
    below = F.exists("ts", lambda t: (t["k"] > F.col("x.k")) & t["t"].isNotNull())
    x = x.withColumn("__a", F.try_element_at(F.filter("ts", lambda t: (t["k"] < F.col("x.k")) & t["t"].isNotNull()), F.lit(-1))["t"])
    got = F.when(F.col("x.t").isNotNull(), F.col("x.t")).otherwise(F.concat(F.when(below, "Innominate ").otherwise("Unknown "), F.coalesce("__a", F.lit("root"))))
    g = x.groupBy(F.col("x.rank").alias("rank"), got.alias("taxon")).agg(F.sum("n").cast("double").alias("n"))
    if not permil:
        return g
    t = g.groupBy("rank").agg(F.sum("n").alias("t"))
    return g.join(t, "rank").select("rank", "taxon", (1000 * F.col("n") / F.col("t")).alias("n"))


def lineage_counts(contigs: DataFrame, ranks: list[str], lineage: str = "lineage", reads: str = "reads") -> DataFrame:
    """(reads, one column for each rank): reads of each lineage, empty where it has no name at the rank: the rows of a Krona chart."""
    names = [F.coalesce(F.col(lineage)[r], F.lit("")).alias(r) for r in ranks]
    return contigs.select(F.col(reads).alias("reads"), *names).groupBy(*ranks).agg(F.sum("reads").alias("reads")).select("reads", *ranks)


def gene_lineages(genes: DataFrame, contigs: DataFrame) -> DataFrame:
    """(gene, lineage) of the genes (gene, contig) on classified contigs (contig, lineage)."""
    return genes.select("gene", "contig").join(contigs.select("contig", "lineage"), "contig").select("gene", "lineage")


def substitution_ratio(counts: DataFrame, group: str = "group", aa: str = "aa", n: str = "n", a: object = "A", b: object = "B") -> DataFrame:
    """(aa, ratio): log10 of the sums of two groups for each amino acid; null where a sum is 0."""
    s = lambda g: F.sum(F.when(F.col(group) == g, F.col(n)).otherwise(0)).cast("double")
    t = counts.groupBy(aa).agg(s(a).alias("x"), s(b).alias("y"))
    return t.select(aa, F.when((F.col("x") > 0) & (F.col("y") > 0), F.log10(F.col("x") / F.col("y"))).alias("ratio"))


def substitution_resampling(counts: DataFrame, replicates: int = 1000, seed: int = 1, mode: str = "permutation", protein: str = "protein", group: str = "group", aa: str = "aa", n: str = "n", a: object = "A", b: object = "B", hashed: Callable[..., Column] = F.xxhash64) -> DataFrame:
    """(rep, aa, ratio) of replicates, each with the ratio of :func:`substitution_ratio`: ``permutation`` swaps the two profiles of a protein
    or leaves them, with even chances; ``bootstrap`` draws as many proteins as there are, with replacement, each with both its profiles.

    Counts are added up by protein and amino acid first. Draws are hashes (``hashed``) of (seed, replicate, protein or number of the draw), so
    they are the same at each run and on any partitioning. Proteins with a null name do not count."""
    side = lambda g: F.sum(F.when(F.col(group) == g, F.col(n)).otherwise(0)).cast("double")
    each = counts.filter(F.col(protein).isNotNull()).groupBy(F.col(protein).alias("__p"), aa).agg(side(a).alias("x"), side(b).alias("y"))
    each = store(each, "profiles")
    spark = counts.sparkSession
    reps = F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep")
    if mode == "permutation":
        swap = F.pmod(hashed(F.lit(seed), F.col("rep"), F.col("__p")), F.lit(2)) == 1
        t = each.select("*", reps).withColumn("__x", F.when(swap, F.col("y")).otherwise(F.col("x"))).withColumn("y", F.when(swap, F.col("x")).otherwise(F.col("y"))).withColumn("x", F.col("__x")).drop("__x")
    else:
        names = store(each.select("__p").distinct().orderBy("__p").withColumn("rid", F.monotonically_increasing_id()), "proteins")
        size = names.count()
        drawn = F.pmod(hashed(F.lit(seed), F.col("rep"), F.col("id")), F.lit(max(size, 1)))
        draws = spark.range(size).select("id", reps).select("rep", drawn.alias("k")).groupBy("rep", "k").agg(F.count(F.lit(1)).alias("times"))
        t = each.join(numbered(names).select("__p", (F.col("number") - 1).alias("k")), "__p").join(draws, "k")
        t = t.withColumn("x", F.col("x") * F.col("times")).withColumn("y", F.col("y") * F.col("times"))
    t = t.groupBy("rep", aa).agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    return t.select("rep", aa, F.when((F.col("x") > 0) & (F.col("y") > 0), F.log10(F.col("x") / F.col("y"))).alias("ratio"))


def filter_variants(v: DataFrame, min_dp: float = 4, max_dp: float = float("inf"), min_ref: float = 2, min_alt: float = 2, min_qual: float = 0, min_shannon: float = 0, indels: bool = False) -> DataFrame:
    """Variants (ref_dp, alt_dp, qual, indel) within the limits, with ``dp`` and Shannon information ``shannon`` (log2)."""
    dp = F.col("ref_dp") + F.col("alt_dp")
    term = lambda c: F.when(F.col(c) > 0, -(F.col(c) / F.col("dp")) * F.log2(F.col(c) / F.col("dp"))).otherwise(0.0)
    x = v.withColumn("dp", dp).filter("dp > 0").withColumn("shannon", term("ref_dp") + term("alt_dp"))
    ok = (F.col("dp") >= min_dp) & (F.col("dp") <= max_dp) & (F.col("ref_dp") >= min_ref) & (F.col("alt_dp") >= min_alt) & (F.col("qual") >= min_qual) & (F.col("shannon") >= min_shannon)
    return x.filter(ok if indels else ok & ~F.col("indel"))


def variant_summary(v: DataFrame) -> DataFrame:
    """(n, information, dp, ref_dp, alt_dp): number, summed information and mean depths."""
    return v.agg(F.count(F.lit(1)).alias("n"), F.sum("shannon").alias("information"), F.avg("dp").alias("dp"), F.avg("ref_dp").alias("ref_dp"), F.avg("alt_dp").alias("alt_dp"))


#: Standard genetic code (fixed value): amino acids of the codons in the order TTT, TTC, TTA, TTG, TCT, ... of the bases T, C, A, G.
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def _codons() -> dict[str, str]:
    """Amino acid of each codon."""
    bases = "TCAG"
    return {a + b + c: CODE[16 * i + 4 * j + k] for i, a in enumerate(bases) for j, b in enumerate(bases) for k, c in enumerate(bases)}


def codon_changes(spark: SparkSession) -> DataFrame:
    """(codon, i, b, same): the 576 changes of one base of a codon, and whether the amino acid stays the same (1) or not (0)."""
    aa = _codons()
    rows = [(c, i, b, float(aa[c[:i] + b + c[i + 1 :]] == aa[c])) for c in aa for i in range(3) for b in "TCAG" if c[i] != b]
    return spark.createDataFrame(rows, "codon string, i int, b string, same double")


def kaks(genes: DataFrame, snps: DataFrame, fixed: float | None = None, compat: bool = False) -> DataFrame:
    """(gene, n, s, n_sites, s_sites, ka, ks, ratio): substitutions and sites of each gene. genes: (gene, seq); snps: (gene, pos from 0, alt).

    ka=(n+1)/(N+2), ks=(s+1)/(S+2). ``fixed`` is the share of synonymous sites to take instead of counting them (the other way round with
    ``compat``). Only positions of whole codons count; codons with other letters than ACGT have no sites."""
    spark = genes.sparkSession
    change = F.broadcast(codon_changes(spark))  # 576 rows
    per = F.broadcast(codon_changes(spark).groupBy("codon").agg((F.sum("same") / 3).alias("ss"), (F.sum(1 - F.col("same")) / 3).alias("ns")))
    codons = genes.select("gene", F.posexplode(F.filter(F.split(F.regexp_replace(F.upper("seq"), "(...)", "$1 "), " "), lambda x: F.length(x) == 3)).alias("k", "codon"))
    sized = codons.join(per, "codon")
    sites = sized.groupBy("gene").agg(F.sum("ss").alias("s_sites"), F.sum("ns").alias("n_sites"), (F.count(F.lit(1)) * 3).alias("b"))
    if fixed is not None:
        f = 1 - fixed if compat else fixed
        sites = sites.withColumn("s_sites", F.col("b") * f).withColumn("n_sites", F.col("b") * (1 - f))
    hit = snps.select("gene", F.floor(F.col("pos") / 3).cast("int").alias("k"), (F.col("pos") % 3).cast("int").alias("i"), F.upper("alt").alias("b"))
    # Spark sizes the codons as if each gene had one, so it may broadcast all of them unless told to merge
    sub = hit.join(codons.hint("merge"), ["gene", "k"]).join(change, ["codon", "i", "b"]).groupBy("gene").agg(F.sum("same").alias("s"), F.sum(1 - F.col("same")).alias("n"))
    sites = sites.drop("b")
    out = sites.join(sub, "gene", "left").fillna(0, ["s", "n"])
    out = out.withColumn("ka", (F.col("n") + 1) / (F.col("n_sites") + 2)).withColumn("ks", (F.col("s") + 1) / (F.col("s_sites") + 2))
    return out.withColumn("ratio", F.col("ka") / F.col("ks")).select("gene", "n", "s", "n_sites", "s_sites", "ka", "ks", "ratio")
