"""Operators on tabular search hits: ranking, filtering, look-ups, sums, pairs, reciprocal matches and identities.

Rows are hits with the columns of :data:`seqspark.sources.schemas.HITS`; ``order`` names the column that stands for file order. Rows with
a null in a column an operator compares or joins on never match; the docstrings say where that drops them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import store

#: Direction in which each sort key is better.
BETTER = {"bitscore": "desc", "evalue": "asc", "pident": "desc", "length": "desc"}


def _n(c: str) -> Column:
    return F.col(f"`{c}`")


def top_hits(hits: DataFrame, n: int = 5, by: str = "bitscore", query: str = "qseqid", order: str = "hit_id") -> DataFrame:
    """The ``n`` best hits of each query by ``by`` (``order`` for file order), equal ones in file order. The rank filter is applied
    before the shuffle as well. Hits with a null or not-a-number key come last; those with a null query are one group."""
    keys = [] if by == order else [_n(by).desc_nulls_last() if BETTER[by] == "desc" else _n(by).asc_nulls_last()]
    if keys and dict(hits.dtypes)[by] in ("double", "float"):
        keys.insert(0, F.isnan(_n(by)).asc())
    w = Window.partitionBy(_n(query)).orderBy(*keys, _n(order))
    return hits.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= n).drop("__rank")


def best_hit(hits: DataFrame, query: str = "qseqid", score: str = "bitscore", order: str = "hit_id") -> DataFrame:
    """The hit of the highest score of each query; of equal ones the first."""
    return top_hits(hits, 1, score, query, order)


def filter_by_list(rows: DataFrame, listed: DataFrame, key: str, list_key: str, invert: bool = False) -> DataFrame:
    """Rows whose key is in the list, or with ``invert`` those whose key is not (null keys are in no list)."""
    ids = listed.select(_n(list_key).alias("__k")).dropna().distinct()
    return rows.join(ids, rows[key] == ids["__k"], "left_anti" if invert else "left_semi")


def filter_any_key(rows: DataFrame, listed: DataFrame, keys: list[Column], list_key: str, invert: bool = False) -> DataFrame:
    """As :func:`filter_by_list` for records that may be listed under any of several names (whole line, defline, id)."""
    ids = listed.select(_n(list_key).alias("__k")).dropna().distinct()
    hit = rows.select("rid", F.explode(F.array_distinct(F.array(*keys))).alias("__k")).join(ids, "__k", "left_semi").select("rid").distinct()
    return rows.join(hit, "rid", "left_anti" if invert else "left_semi")


def add_length(hits: DataFrame, lengths: DataFrame, key: str, id_col: str = "id", length: str = "length", name: str = "qry_len", strict: bool = True) -> DataFrame:
    """Hits with the length of their sequence; with ``strict`` a hit of an unknown sequence fails the query, else it has null."""
    found = lengths.select(_n(id_col).alias("__id"), _n(length).alias(name))
    out = hits.join(found, hits[key] == found["__id"], "left").drop("__id")
    if strict:
        out = out.withColumn(name, F.when(_n(name).isNull(), F.raise_error(F.concat(F.lit("no length of "), F.coalesce(_n(key), F.lit("null")))).cast("int")).otherwise(_n(name)))
    return out


def cog_categories(hits: DataFrame, cogs: DataFrame, gene: str, one_by_one: bool = True) -> DataFrame:
    """(query, category): one row for each category letter of the hit's gene; genes without an entry give none. cogs: (gene, category)."""
    letters = F.explode(F.filter(F.split("category", ""), lambda x: x != "")) if one_by_one else F.col("category")
    cats = cogs.select(_n("gene").alias("__gene"), letters.alias("category"))
    return hits.join(cats, hits[gene] == cats["__gene"]).drop("__gene")


def sum_per_hit(hits: DataFrame, weights: DataFrame | None = None, query: str = "qseqid", subject: str = "sseqid", weight_id: str = "id", weight: str = "weight", min_score: float = 0, min_identity: float = 0, normalise: bool = False, zero: bool = False, max_queries: int | None = None, order: str = "hit_id") -> DataFrame:
    """(subject, total): sum over hits of the query's weight (1 without weights), divided by the query's number of hits if ``normalise``.

    Hits under the limits do not count. With ``max_queries`` only so many queries count, those that come first by ``order``. A query without weight drops out, or counts 0 with ``zero``. Hits with a null subject drop out.
    """
    kept = hits.filter((F.col("bitscore") >= min_score) & (F.col("pident") >= min_identity) & _n(subject).isNotNull())
    first = [] if max_queries is None else [_n(order).alias("__o")]
    kept = kept.select(_n(query).alias("__q"), _n(subject).alias("subject"), *first)
    if max_queries is not None:
        seen = kept.groupBy("__q").agg(F.min("__o").alias("__o")).orderBy("__o", "__q").limit(max_queries)
        kept = kept.join(seen.select("__q"), "__q", "left_semi").drop("__o")
    if normalise or weights is not None:
        # per query first: a query's hits on one subject become one row before they meet its weight
        kept = kept.groupBy("__q", "subject").agg(F.count(F.lit(1)).alias("__n"))
        share = F.col("__n").cast("double")
        if normalise:
            kept = kept.withColumn("__all", F.sum("__n").over(Window.partitionBy("__q")))
            share = share / F.col("__all")
        if weights is not None:
            w = weights.select(_n(weight_id).alias("__q"), _n(weight).cast("double").alias("__w")).filter(F.col("__q").isNotNull())
            kept = kept.join(w, "__q", "left" if zero else "inner")
            share = share * (F.coalesce("__w", F.lit(0.0)) if zero else F.col("__w"))
        return kept.groupBy("subject").agg(F.sum(share).alias("total"))
    return kept.groupBy("subject").agg(F.count(F.lit(1)).cast("double").alias("total"))


def paired_hits(hits: DataFrame, base: Column, mate: Column, subject: str = "sseqid", min_score: float = 0, orientation: int = 0, top: int = 0, compat: bool = False) -> DataFrame:
    """(base, subject, bitscore, s_from, s_to, orientation, span): pairs of sister reads that hit the same subject.

    ``orientation`` of a pair: 1 both forward or both reverse, 2 facing, 3 back to back; a filter of 0 keeps all, 1..3 that one, 4 all but 1.
    The sum of scores must exceed ``min_score``. ``top`` keeps so many of the best pairs of a read (the lowest with ``compat``).
    """
    h = hits.select(base.alias("base"), mate.alias("mate"), _n(subject).alias("subject"), "bitscore", "s_start", "s_end").dropna()
    side = lambda m: h.filter(F.col("mate") == m).select("base", "subject", *[F.col(c).alias(f"{c}{m}") for c in ("bitscore", "s_start", "s_end")])
    p = side("1").join(side("2"), ["base", "subject"])
    fwd1, fwd2 = F.col("s_start1") <= F.col("s_end1"), F.col("s_start2") <= F.col("s_end2")
    left_fwd = F.when(F.col("s_start1") <= F.col("s_start2"), fwd1).otherwise(fwd2)
    way = F.when(fwd1 == fwd2, 1).when(left_fwd, 2).otherwise(3)
    ends = [F.col(c) for c in ("s_start1", "s_end1", "s_start2", "s_end2")]
    p = p.select("base", "subject", (F.col("bitscore1") + F.col("bitscore2")).alias("bitscore"), F.least(*ends).alias("s_from"), F.greatest(*ends).alias("s_to"), way.alias("orientation"))
    p = p.withColumn("span", F.col("s_to") - F.col("s_from") + 1).filter(F.col("bitscore") > min_score)
    if orientation:
        p = p.filter(F.col("orientation") != 1) if orientation == 4 else p.filter(F.col("orientation") == orientation)
    if top:
        w = Window.partitionBy("base").orderBy(F.col("bitscore").asc() if compat else F.col("bitscore").desc(), "subject", "s_from", "s_to")
        p = p.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= top).drop("__k")
    return p


def best_matches(hits: DataFrame, min_length: int = 0, min_identity: float = 0, min_score: float = 0, min_fraction: float = 0, query: str = "qseqid", order: str = "hit_id") -> DataFrame:
    """Each query's best hit among those that pass the limits; ``min_fraction`` is of the query's length (``qry_len``)."""
    ok = (F.col("length") >= min_length) & (F.col("pident") >= min_identity) & (F.col("bitscore") >= min_score)
    if min_fraction:
        ok = ok & (F.col("length") / F.col("qry_len") >= min_fraction)
    return best_hit(hits.filter(ok), query, "bitscore", order)


def reciprocal_best_matches(forward: DataFrame, reverse: DataFrame, query: str = "qseqid", subject: str = "sseqid") -> DataFrame:
    """Rows of ``forward`` (best hits one way) whose subject's best hit in ``reverse`` is their query."""
    back = reverse.select(_n(query).alias("__s"), _n(subject).alias("__q")).distinct()
    return forward.join(back, (forward[query] == back["__q"]) & (forward[subject] == back["__s"]), "left_semi")


def identity_statistics(matches: DataFrame, keys: list[str], identity: str = "pident", min_hits: int = 50, correction: float | None = None) -> DataFrame:
    """Mean identity and population deviation over matches for each combination of ``keys`` of at least ``min_hits`` matches.

    ``correction`` (0.8621 for windows of a genome) maps an identity to 100-(100-id)/correction first. Null identities do not count.
    """
    x = _n(identity)
    x = 100 - (100 - x) / correction if correction else x
    s = matches.filter(x.isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("identity"), F.stddev_pop(x).alias("sd"))
    return s.filter(F.col("n") >= min_hits)


def passing_first(hits: DataFrame, query_lengths: DataFrame, subject_lengths: DataFrame, min_length: int = 0, min_identity: float = 20, min_score: float = 0, min_fraction: float = 0, query: str = "qseqid", subject: str = "sseqid", order: str = "hit_id") -> DataFrame:
    """Each query's first hit by ``order`` that passes the limits; ``min_fraction`` is of the shorter of both sequences. Lengths: (id, length).
    Hits of sequences without a length, or with a null in a compared column, pass nothing."""
    q = query_lengths.select(F.col("id").alias("__q"), F.col("length").alias("__ql"))
    s = subject_lengths.select(F.col("id").alias("__s"), F.col("length").alias("__sl"))
    ok = (F.col("length") >= min_length) & (F.col("pident") >= min_identity) & (F.col("bitscore") >= min_score)
    known = hits.filter(ok).join(q, hits[query] == q["__q"]).join(s, hits[subject] == s["__s"])
    known = known.filter(F.col("length") / F.least("__ql", "__sl") >= min_fraction).drop("__q", "__s", "__ql", "__sl")
    w = Window.partitionBy(_n(query)).orderBy(_n(order))
    return known.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def average_nucleotide_guard(sequences: DataFrame, most: float = 0.95, seq: str = "seq") -> DataFrame:
    """Sequences of proteins; the query fails if more than ``most`` of all letters are A, C, G, T or N, as of a nucleotide sequence."""
    share = sequences.agg((F.sum(F.length(F.regexp_replace(seq, "[^ACGTNacgtn]", ""))) / F.nullif(F.sum(F.length(seq)), F.lit(0))).alias("__share"))
    told = sequences.crossJoin(F.broadcast(share))  # one row
    fail = F.raise_error(F.lit("these look like nucleotide sequences")).cast("string")
    return told.withColumn(seq, F.when(F.coalesce(F.col("__share") > most, F.lit(False)), fail).otherwise(F.col(seq))).drop("__share")


def genome_identity(forward: DataFrame, reverse: DataFrame, lengths_1: DataFrame, lengths_2: DataFrame, min_hits: int = 50, correction: float | None = None, **limits: float) -> DataFrame:
    """(direction, identity, sd, n, omega, frx): mean identity of two genomes and its population deviation from the hits of each on the other.

    ``one-way 1`` and ``one-way 2`` are over the first hits that pass the ``limits`` (see :func:`passing_first`), ``two-way`` over those of the
    second direction whose subject has its own first hit on their query. ``omega`` is the number of sequences of the genome with fewer, frx
    the percentage of it with a match. A direction of fewer than ``min_hits`` hits has no identity. ``correction`` (0.8621 for windows of a
    genome) maps an identity to 100-(100-id)/correction."""
    one = passing_first(forward, lengths_1, lengths_2, **limits)
    two = passing_first(reverse, lengths_2, lengths_1, **limits)
    both = reciprocal_best_matches(two, one)
    x = F.col("pident")
    x = 100 - (100 - x) / correction if correction else x
    ways = [h.select(F.lit(d).alias("direction"), x.alias("x")) for d, h in (("one-way 1", one), ("one-way 2", two), ("two-way", both))]
    names = one.sparkSession.createDataFrame([("one-way 1",), ("one-way 2",), ("two-way",)], "direction string")
    s = ways[0].unionByName(ways[1]).unionByName(ways[2]).groupBy("direction").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("identity"), F.stddev_pop("x").alias("sd"))
    sizes = lengths_1.agg(F.count_distinct("id").alias("a")).crossJoin(lengths_2.agg(F.count_distinct("id").alias("b"))).select(F.least("a", "b").alias("omega"))  # one row
    out = names.join(s, "direction", "left").crossJoin(F.broadcast(sizes)).withColumn("n", F.coalesce("n", F.lit(0)))
    enough = F.col("n") >= min_hits
    return out.select("direction", F.when(enough, F.col("identity")).alias("identity"), F.when(enough, F.col("sd")).alias("sd"), "n", "omega", (100.0 * F.col("n") / F.nullif("omega", F.lit(0))).alias("frx"))


def rank_ancestors(nodes: DataFrame, rank: str) -> DataFrame:
    """(tax_id, ancestor): for each taxon the ancestor (or itself) of ``rank``; taxa above the rank have none. nodes: (tax_id, parent_id, rank).

    The closure doubles the looked-up distance in every step, until no taxon has anything left to look up, however deep the tree is; what
    is still looking after as many levels as there are taxa runs in a circle and has no ancestor.
    """
    step = nodes.select("tax_id", F.when(F.col("rank") == rank, F.col("tax_id")).alias("ancestor"), F.when((F.col("rank") != rank) & (F.col("parent_id") != F.col("tax_id")), F.col("parent_id")).alias("up"))
    reach, taxa = 1, nodes.count()
    while reach < 2 * taxa:
        for _ in range(3):
            other = step.select(F.col("tax_id").alias("up"), F.col("ancestor").alias("__a"), F.col("up").alias("__u"))
            step = step.join(other, "up", "left").select("tax_id", F.coalesce("ancestor", "__a").alias("ancestor"), F.when(F.coalesce("ancestor", "__a").isNull(), F.col("__u")).alias("up"))
            reach *= 2
        step = store(step, "ancestors")
        if step.filter("up is not null").isEmpty():
            break
    return step.filter(F.col("ancestor").isNotNull()).select("tax_id", "ancestor")


def taxon_names(names: DataFrame) -> DataFrame:
    """(tax_id, name): the scientific name, else the first of all names by file order. names: (rid, tax_id, name, name_class)."""
    best = F.struct((F.col("name_class") != "scientific name").alias("a"), "rid")
    return names.groupBy("tax_id").agg(F.min_by("name", best).alias("name"))


def hits_to_rank(hits: DataFrame, taxon: Column, nodes: DataFrame, names: DataFrame, rank: str = "genus", best_only: bool = False) -> DataFrame:
    """(query, taxon) at ``rank`` for each hit of a taxon at or below it."""
    if best_only:
        hits = best_hit(hits)
    named = rank_ancestors(nodes, rank).join(taxon_names(names).withColumnRenamed("tax_id", "ancestor"), "ancestor").select(F.col("tax_id").alias("__t"), F.col("name").alias("taxon"))
    return hits.withColumn("__t", taxon).join(named, "__t").drop("__t")


def taxon_prepare(hits: DataFrame, genes: DataFrame, min_fraction: float = 0.75) -> DataFrame:
    """(contig, gene, subject number, bitscore, pident) of hits that cover enough of their gene: length >= fraction * gene length / 3.
    genes: (gene, contig, gene_len). The number is what follows ``gi|`` in the subject. A score that is not a number comes out as null."""
    g = genes.select(F.col("gene").alias("qseqid"), "contig", "gene_len")
    kept = hits.join(g, "qseqid").filter(F.col("length") >= min_fraction * F.col("gene_len") / 3)
    return kept.select("contig", F.col("qseqid").alias("gene"), F.regexp_extract("sseqid", r"gi\|(\d+)\|", 1).alias("gi"), F.nanvl("bitscore", F.lit(None)).alias("bitscore"), "pident")


def search_progress(hits: DataFrame, queries: DataFrame, order: str = "hit_id") -> DataFrame:
    """(percent): place of the last but one query of a running search among all queries (id, rid)."""
    ranked = hits.groupBy("qseqid").agg(F.max(_n(order)).alias("o")).orderBy(F.col("o").desc()).limit(2)
    last = ranked.agg(F.min_by("qseqid", "o").alias("id"))
    total = queries.agg(F.count(F.lit(1)).alias("__n"))
    return last.join(queries.select("id", "rid"), "id").crossJoin(total).select((100.0 * (F.col("rid") + 1) / F.col("__n")).alias("percent"))
