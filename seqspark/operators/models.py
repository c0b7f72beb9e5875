"""Statistics on model hits of genomes, look-ups in cached remote tables, and selections from file lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def model_identity(a: DataFrame, b: DataFrame) -> DataFrame:
    """(model, identity, width): identity of two genomes' proteins aligned to one model, both with (model, protein_aln): matches over columns,
    those that are gaps in both left out. Alignments of unequal width fail the query."""
    j = a.select("model", F.col("protein_aln").alias("x")).join(b.select("model", F.col("protein_aln").alias("y")), "model")
    j = j.withColumn("x", F.when(F.length("x") == F.length("y"), F.col("x")).otherwise(F.raise_error(F.concat(F.lit("unequal widths: "), "model")).cast("string")))
    gap = lambda c: c.isin("-", ".")
    cols = F.filter(F.zip_with(F.split("x", ""), F.split("y", ""), lambda p, q: F.when(gap(p) & gap(q), F.lit(None)).otherwise((p == q).cast("int"))), lambda v: v.isNotNull())
    j = j.select("model", cols.alias("v")).filter(F.size("v") > 0)
    return j.select("model", (100.0 * F.aggregate("v", F.lit(0), lambda s, v: s + v) / F.size("v")).alias("identity"), F.size("v").alias("width"))


def model_identity_summary(m: DataFrame) -> DataFrame:
    """(haai, sd, models): mean and population deviation over models."""
    return m.agg(F.avg("identity").alias("haai"), F.stddev_pop("identity").alias("sd"), F.count(F.lit(1)).alias("models"))


def essential_genes(hits: DataFrame, models: DataFrame, order: str = "rid") -> DataFrame:
    """Hits (genome, query, seq_id) of models (model) with ``copy``: 1 for the first hit of a model in a genome, its gene; more are contamination."""
    w = Window.partitionBy("genome", "query").orderBy(order)
    return hits.join(models.select(F.col("model").alias("query")).distinct(), "query", "left_semi").withColumn("copy", F.row_number().over(w))


def genome_quality(copies: DataFrame, models: DataFrame) -> DataFrame:
    """(genome, completeness, contamination, quality): percent of models found, percent of extra copies, completeness - 5 * contamination."""
    n = models.select("model").distinct().agg(F.count(F.lit(1)).alias("n"))
    g = copies.groupBy("genome").agg(F.sum(F.when(F.col("copy") == 1, 1).otherwise(0)).alias("f"), F.sum(F.when(F.col("copy") > 1, 1).otherwise(0)).alias("x"))
    q = g.crossJoin(F.broadcast(n)).select("genome", (100.0 * F.col("f") / F.col("n")).alias("completeness"), (100.0 * F.col("x") / F.col("n")).alias("contamination"))  # one row
    return q.withColumn("quality", F.col("completeness") - 5 * F.col("contamination"))


def restrict_models(models: DataFrame, excluded: list[str]) -> DataFrame:
    """Models but those not expected in a domain, or not present once in its genomes."""
    return models.filter(~F.col("model").isin(excluded)) if excluded else models


def model_report(copies: DataFrame, models: DataFrame) -> DataFrame:
    """(genome, model, copies) of each genome for models that are missing (0) or come more than once."""
    n = copies.groupBy("genome", F.col("query").alias("model")).agg(F.count(F.lit(1)).alias("copies"))
    grid = copies.select("genome").distinct().crossJoin(models.select("model").distinct())  # a row for each genome and model, as in a report
    return grid.join(n, ["genome", "model"], "left").select("genome", "model", F.coalesce("copies", F.lit(0)).alias("copies")).filter("copies <> 1")


def essential_sequences(copies: DataFrame, proteins: DataFrame, every_copy: bool = False, rename: str | None = None) -> DataFrame:
    """(genome, model, id, seq): proteins (genome, id, seq) that are the gene of a model, in a metagenome with ``every_copy``; with ``rename``
    the id is ``rename|model``."""
    c = copies if every_copy else copies.filter("copy = 1")
    j = c.select("genome", F.col("query").alias("model"), F.col("seq_id").alias("id")).join(proteins.select("genome", "id", "seq"), ["genome", "id"])
    return j.select("genome", "model", F.concat_ws("|", F.lit(rename), "model").alias("id") if rename else F.col("id"), "seq")


def copy_numbers(copies: DataFrame, models: DataFrame) -> DataFrame:
    """(mean, median, found): copies of each model in a metagenome, models without a hit having 0."""
    c = copies.groupBy(F.col("query").alias("model")).agg(F.count(F.lit(1)).alias("c"))
    m = models.select("model").distinct().join(c, "model", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    return m.agg(F.avg("c").alias("mean"), F.median("c").alias("median"), F.sum(F.when(F.col("c") > 0, 1).otherwise(0)).alias("found"))


def pathways(hits: DataFrame, mapping: DataFrame, key: str = "sseqid", drop: str = "path:ko") -> DataFrame:
    """(query, pathway) through a cached look-up (id, pathway); entries that start with ``drop`` are left out, as are hits without any."""
    m = mapping.filter(~F.col("pathway").startswith(drop)).select(F.col("id").alias("__i"), "pathway").distinct()
    return hits.join(m, hits[key] == m["__i"]).select(F.col("qseqid").alias("query"), "pathway")


def assemblies(summary: DataFrame, level: str = "Complete Genome") -> DataFrame:
    """(accession, folder) of an assembly list's rows of this level; columns _c0, _c11 and _c19, as read without a header."""
    return summary.filter(F.col("_c11") == level).select(F.col("_c0").alias("accession"), F.col("_c19").alias("folder"))


def unverified(reported: DataFrame, present: DataFrame) -> DataFrame:
    """Files of a report (name, md5) that are missing or whose content (name, content) has another checksum: those to fetch again."""
    have = present.select("name", F.md5("content").alias("have"))
    return reported.join(have, "name", "left").filter(F.col("have").isNull() | (F.col("have") != F.col("md5"))).drop("have")


def first_matches(hits: DataFrame, min_length: int = 0, min_identity: float = 0, min_score: float = 0, query: str = "qseqid", order: str = "hit_id") -> DataFrame:
    """Each query's first hit in file order that passes the limits."""
    ok = (F.col("length") >= min_length) & (F.col("pident") >= min_identity) & (F.col("bitscore") >= min_score)
    w = Window.partitionBy(query).orderBy(order)
    return hits.filter(ok).withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def binned_depth_summary(records: DataFrame, width: int = 1000, cutoff: float = 95) -> DataFrame:
    """(bin, reads, bases, mean, q25, median, q75) of closed bins of positions (ceiling of the middle over the width) for reads above the cut-off:
    the summaries of identities that an older kind of recruitment plot shows."""
    r = records.filter((F.col("pident") > cutoff)).withColumn("bin", F.ceil((F.col("start") + F.col("end")) / 2 / width))
    return r.groupBy("bin").agg(F.count(F.lit(1)).alias("reads"), F.sum(F.col("end") - F.col("start") + 1).alias("bases"), F.avg("pident").alias("mean"), *[F.percentile("pident", q).alias(n) for q, n in ((0.25, "q25"), (0.5, "median"), (0.75, "q75"))])


def select_columns(df: DataFrame, wanted: list | None, names: list[str] | None = None) -> list[str]:
    """Names chosen by name, by position from 1, or by a list of truth values; all if nothing is given. Unknown ones raise KeyError."""
    names = names or df.columns
    if wanted is None:
        return names
    if wanted and all(isinstance(w, bool) for w in wanted):
        return [n for n, w in zip(names, wanted) if w]
    out = [names[w - 1] if isinstance(w, int) else w for w in wanted]
    for o in out:
        if o not in names:
            raise KeyError(o)
    return out


def shared_members(a: DataFrame, b: DataFrame, item: str = "item", cluster: str = "cluster") -> DataFrame:
    """(a, b, shared, united): sizes of the intersection and union of each pair of clusters that share a member."""
    x, y = a.select(item, F.col(cluster).alias("a")), b.select(item, F.col(cluster).alias("b"))
    s = x.join(y, item).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    na, nb = x.groupBy("a").agg(F.count(F.lit(1)).alias("na")), y.groupBy("b").agg(F.count(F.lit(1)).alias("nb"))
    return s.join(na, "a").join(nb, "b").select("a", "b", "shared", (F.col("na") + F.col("nb") - F.col("shared")).alias("united"))
