"""Ortholog groups in long form (og, genome, gene): building, statistics, curves, extraction, annotation and Markov clustering."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import store
from .sampling import shuffled


def connected_groups(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(v, og): least vertex of each connected group of genes, by alternating large-star and small-star steps on the edges.

    A step links every vertex's neighbours to the least of them; it keeps groups as they are and ends in stars. Rounds grow with the
    logarithm of the size, not with the length of paths. Pairs with a null link nothing."""
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna()
    lone = e.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    e = store(e.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).alias("x")
    last = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        e = store(small.filter("a <> b").distinct(), "stars")
        now = e.agg(mark).first()["x"]
        if now == last:
            return lone.join(e.select(F.col("a").alias("v"), "b"), "v", "left").select("v", F.coalesce("b", "v").alias("og"))
        last = now
    raise RuntimeError("groups did not settle")


def groups_from_matches(matches: DataFrame) -> DataFrame:
    """(og, genome, gene): ortholog groups of reciprocal matches (genome1, gene1, genome2, gene2), named after their least member."""
    m = matches.select(F.struct(F.col("genome1").alias("genome"), F.col("gene1").alias("gene")).alias("x"), F.struct(F.col("genome2").alias("genome"), F.col("gene2").alias("gene")).alias("y"))
    key = lambda c: F.concat_ws("\u0001", f"{c}.genome", f"{c}.gene")
    m = m.filter("x.genome is not null and x.gene is not null and y.genome is not null and y.gene is not null").select(key("x").alias("a"), key("y").alias("b"))
    part = lambda i: F.split("v", "\u0001")[i]
    return connected_groups(m).select(F.replace("og", F.lit("\u0001"), F.lit(">")).alias("og"), part(0).alias("genome"), part(1).alias("gene"))


def group_statistics(og: DataFrame) -> DataFrame:
    """(genomes, pan, core, core90, core80, unus, unique_genes, avg, core_pan, entropy): sizes of the pangenome. unus are core groups with one
    gene in each genome; entropy is -sum p ln p with p the share of genomes of each group."""
    g = og.groupBy("og", "genome").agg(F.count(F.lit(1)).alias("n"))
    each = g.groupBy("og").agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("copies"))
    n = og.agg(F.count_distinct("genome").alias("genomes"))
    e = each.crossJoin(F.broadcast(n))  # one row
    p = F.col("k") / F.col("genomes")
    c = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    s = e.agg(F.max("genomes").alias("genomes"), F.count(F.lit(1)).alias("pan"), c(F.col("k") == F.col("genomes")).alias("core"), c(p >= 0.9).alias("core90"), c(p >= 0.8).alias("core80"), c((F.col("k") == F.col("genomes")) & (F.col("copies") == 1)).alias("unus"), c(F.col("k") == 1).alias("unique_groups"), F.sum("k").alias("memberships"), (-F.sum(p * F.ln(p))).alias("entropy"))
    return s.withColumn("avg", F.col("memberships") / F.col("genomes")).withColumn("core_pan", F.col("core") / F.col("pan")).drop("memberships")


def core_pan(og: DataFrame, replicates: int = 100, seed: int = 1, order: Column | None = None) -> DataFrame:
    """(rep, k, core, pan): sizes of core and pan genome of the first k genomes, in ``replicates`` random orders (or ordered by ``order``, made
    of ``rep`` and ``genome``).

    pan(k) counts groups whose first member has rank <= k, core(k) those whose first missing genome has rank > k. Groups found in the same
    genomes are counted first; the orders of the genomes, which are few, go along with the tasks, and each task adds up its own curves."""
    genomes = og.select("genome").filter("genome is not null").distinct()
    ranks = genomes.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    key = order if order is not None else shuffled(seed, F.col("rep"), F.col("genome"))
    rows = ranks.withColumn("rank", F.row_number().over(Window.partitionBy("rep").orderBy(key, "genome"))).collect()
    names = sorted({r["genome"] for r in rows})
    at = {g: i for i, g in enumerate(names)}
    by_rank = np.zeros((replicates, len(names)), np.int64)  # genome at each rank
    for r in rows:
        by_rank[r["rep"] - 1, r["rank"] - 1] = at[r["genome"]]
    spark = og.sparkSession
    numbers = spark.createDataFrame([(g, i) for g, i in at.items()], T.StructType([T.StructField("genome", og.schema["genome"].dataType), T.StructField("i", T.IntegerType())]))
    member = og.select("og", "genome").join(F.broadcast(numbers), "genome").groupBy("og").agg(F.sort_array(F.collect_set("i")).alias("held"))  # as long as there are genomes
    pattern = member.groupBy("held").agg(F.count(F.lit(1)).alias("n"))

    def count(batches):
        import pandas as pd

        g = len(names)
        pan, core = np.zeros((replicates, g + 1), np.int64), np.zeros((replicates, g + 1), np.int64)
        for pdf in batches:
            for held, n in zip(pdf["held"], pdf["n"]):
                here = np.zeros(g, bool)
                here[held] = True
                ordered = here[by_rank]
                every = np.arange(replicates)
                pan[every, ordered.argmax(axis=1)] += n
                missing = np.where(ordered.all(axis=1), g, (~ordered).argmax(axis=1))
                core[:, 0] += n
                core[every, missing] -= n
        pan, core = pan.cumsum(axis=1)[:, :g], core.cumsum(axis=1)[:, :g]
        yield pd.DataFrame({"rep": np.repeat(np.arange(1, replicates + 1), g), "k": np.tile(np.arange(1, g + 1), replicates), "core": core.ravel(), "pan": pan.ravel()})

    return pattern.mapInPandas(count, "rep int, k int, core long, pan long").groupBy("rep", "k").agg(F.sum("core").alias("core"), F.sum("pan").alias("pan"))


def core_pan_summary(curves: DataFrame) -> DataFrame:
    """(k, core_avg, core_sd, core_q1..3, pan_avg, pan_sd, pan_q1..3) over replicates; quartiles stand at place n*q/4 from 0."""
    def q(c: str, i: int) -> Column:
        s = F.sort_array(F.collect_list(c))
        return F.element_at(s, F.least(F.floor(F.count(F.lit(1)) * i / 4) + 1, F.count(F.lit(1))).cast("int")).alias(f"{c}_q{i}")

    return curves.groupBy("k").agg(*[x for c in ("core", "pan") for x in (F.avg(c).alias(f"{c}_avg"), F.stddev_pop(c).alias(f"{c}_sd"), q(c, 1), q(c, 2), q(c, 3))])


def filter_core(og: DataFrame, least: float = 1.0) -> DataFrame:
    """Groups found in at least this share of genomes."""
    n = og.agg(F.count_distinct("genome").alias("__n"))
    k = og.groupBy("og").agg(F.count_distinct("genome").alias("__k")).crossJoin(F.broadcast(n)).filter(F.col("__k") >= F.col("__n") * least)
    return og.join(k.select("og"), "og", "left_semi")


def remove_inparalogs(og: DataFrame, most: int = 1) -> DataFrame:
    """Groups with at most so many genes in each genome."""
    bad = og.groupBy("og", "genome").count().filter(F.col("count") > most).select("og").distinct()
    return og.join(bad, "og", "left_anti")


def extract_genes(og: DataFrame, sequences: DataFrame, pick: str = "all", seed: int = 1, per_genome: bool = False) -> DataFrame:
    """(og, genome, gene, seq, file): sequences (genome, id, seq) of group members: all, the first gene of each genome, or a random one."""
    if pick != "all":
        key = F.col("gene") if pick == "first" else shuffled(seed, F.col("og"), F.col("genome"), F.col("gene"))
        w = Window.partitionBy("og", "genome").orderBy(key, "gene")
        og = og.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")
    s = sequences.select("genome", F.col("id").alias("gene"), "seq")
    return og.join(s, ["genome", "gene"]).select("og", "genome", "gene", "seq", (F.col("genome") if per_genome else F.col("og")).alias("file"))


def annotate(og: DataFrame, notes: DataFrame) -> DataFrame:
    """(og, notes): gene annotations (genome, gene, note) of a group's members as ``gene: note``, in order, joined by `` || ``."""
    j = og.join(notes, ["genome", "gene"]).select("og", F.concat_ws(": ", "gene", "note").alias("t"))
    return j.groupBy("og").agg(F.array_join(F.sort_array(F.collect_set("t")), " || ").alias("notes"))


def to_matrix(og: DataFrame, genomes: list[str]) -> DataFrame:
    """Wide form: a row for each group, a column for each genome, genes joined by commas, ``-`` for none."""
    g = og.groupBy("og").pivot("genome", genomes).agg(F.array_join(F.sort_array(F.collect_list("gene")), ","))
    return g.select("og", *[F.coalesce(F.nullif(F.col(f"`{c}`"), F.lit("")), F.lit("-")).alias(c) for c in genomes])


def _mcl(a: np.ndarray, b: np.ndarray, w: np.ndarray, inflation: float, prune: float, rounds: int, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and clusters of one small connected graph, by dense matrices."""
    v, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    m = np.zeros((len(v), len(v)))
    np.maximum.at(m, (i, j), w)
    m = np.maximum(m, m.T)
    np.fill_diagonal(m, m.max(axis=0))
    m /= m.sum(axis=0)
    for _ in range(rounds):
        new = (m @ m) ** inflation
        new /= new.sum(axis=0)
        new[new < prune] = 0
        new /= new.sum(axis=0)
        off = np.abs(new - m).max()
        m = new
        if off < tolerance:
            break
    else:
        raise RuntimeError("clusters did not settle")
    strong = (m > 0.01) | (m > 0.01).T
    label = np.arange(len(v))
    while True:
        low = np.minimum(label, np.where(strong, label[None, :], len(v)).min(axis=1))
        if (low == label).all():
            return v, v[label]
        label = low


def markov_clusters(edges: DataFrame, a: str = "a", b: str = "b", weight: str = "weight", inflation: float = 1.5, prune: float = 1e-3, rounds: int = 500, tolerance: float = 1e-4, dense: int = 1000) -> DataFrame:
    """(v, cluster): Markov clustering of a weighted graph: the column-stochastic matrix is squared, its entries raised to ``inflation``,
    brought back to column sums of 1 and pruned under ``prune`` until it settles; a cluster is named after its least member.

    Connected parts don't affect each other: those of at most ``dense`` vertices are clustered side by side, a task each, by dense matrices;
    larger ones together as a sparse table (i, j, m), squared by one join and one sum, where pruning bounds a column to 1/prune entries. Both
    give the same clusters. A graph that has not settled after ``rounds`` fails the query."""
    e = edges.select(F.col(a).cast("string").alias("i"), F.col(b).cast("string").alias("j"), F.col(weight).cast("double").alias("m")).dropna()
    e = store(e.groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.max("m").alias("m")), "mcl-edges")
    part = connected_groups(e, "i", "j").withColumnRenamed("og", "part")
    sizes = part.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    placed = store(e.join(part.join(sizes, "part"), F.col("i") == F.col("v")).select("part", "size", "i", "j", "m"), "mcl-parts")

    def small(pdf):
        import pandas as pd

        v, c = _mcl(pdf["i"].to_numpy(), pdf["j"].to_numpy(), pdf["m"].to_numpy(), inflation, prune, rounds, tolerance)
        return pd.DataFrame({"v": v, "cluster": c})

    done = placed.filter(F.col("size") <= dense).select("part", "i", "j", "m").groupBy("part").applyInPandas(small, "v string, cluster string")
    large = placed.filter(F.col("size") > dense).select("i", "j", "m")
    if large.isEmpty():
        return done
    return done.unionByName(_sparse_clusters(large, inflation, prune, rounds, tolerance))


def _sparse_clusters(e: DataFrame, inflation: float, prune: float, rounds: int, tolerance: float) -> DataFrame:
    m = e.unionByName(e.select(F.col("j").alias("i"), F.col("i").alias("j"), "m")).groupBy("i", "j").agg(F.max("m").alias("m"))
    loops = m.groupBy("j").agg(F.max("m").alias("m")).select(F.col("j").alias("i"), "j", "m")
    m = m.filter("i <> j").unionByName(loops)

    def stochastic(x: DataFrame) -> DataFrame:
        s = x.groupBy("j").agg(F.sum("m").alias("__s"))
        return x.join(s, "j").select("i", "j", (F.col("m") / F.col("__s")).alias("m"))

    m = store(stochastic(m), "mcl")
    for _ in range(rounds):
        left = m.select(F.col("i").alias("r"), F.col("j").alias("k"), F.col("m").alias("x"))
        square = left.join(m.select(F.col("i").alias("k"), "j", "m"), "k").groupBy(F.col("r").alias("i"), "j").agg(F.sum(F.col("x") * F.col("m")).alias("m"))
        kept = stochastic(square.withColumn("m", F.pow("m", inflation))).filter(F.col("m") >= prune)
        new = store(stochastic(kept), "mcl")
        off = new.join(m.withColumnRenamed("m", "old"), ["i", "j"], "full").agg(F.max(F.abs(F.coalesce("m", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))).first()[0] or 0
        m = new
        if off < tolerance:
            break
    else:
        raise RuntimeError("clusters did not settle")
    return connected_groups(m.filter("m > 0.01").select(F.col("i").alias("a"), F.col("j").alias("b"))).withColumnRenamed("og", "cluster")


def edge_weights(hits: DataFrame, by: str = "bitscore") -> Column:
    """Weight of a hit for clustering: its score, -log10 of its e-value (200 at 0), its identity, or 1."""
    return {"bitscore": F.col("bitscore"), "evalue": F.when(F.col("evalue") <= 0, 200.0).otherwise(-F.log10("evalue")), "identity": F.col("pident"), "none": F.lit(1.0)}[by]
