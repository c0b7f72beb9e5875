"""Operators on plain tables: lists, merges, look-ups, rounding, distances, bar tables and preference scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filter_rows(rows: DataFrame, listed: DataFrame, key: str, list_key: str, list_pos: str | None = None, pos: str | None = None, invert: bool = False) -> DataFrame:
    """Rows of the listed keys; with ``list_pos`` in the list's order (a column ``list_pos``) and of repeated keys only the last row by
    ``pos``; with ``invert`` the rows of other keys."""
    if invert:
        return rows.join(listed.select(F.col(list_key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left_anti")
    if list_pos is None:
        return rows.join(listed.select(F.col(list_key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left_semi")
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), pos).alias("__r")).select("__r.*")
    return last.join(listed.select(F.col(list_key).alias("__k"), F.col(list_pos).alias("list_pos")), F.col(key) == F.col("__k")).drop("__k")


def merge_lists(lists: DataFrame, tags: list[str], key: str = "key", tag: str = "tag", value: str = "value", pos: str = "pos", empty: object = 0) -> DataFrame:
    """One row for each key with a column for each tag: a full outer join of all lists; of repeated keys the last value counts."""
    wide = lists.groupBy(key).pivot(tag, tags).agg(F.max_by(value, pos))
    return wide.fillna(empty) if empty is not None else wide


def replace_column(rows: DataFrame, mapping: DataFrame, key: str, source: str, target: str, unknown: str = "") -> DataFrame:
    """``rows`` with ``key`` replaced by its value in ``mapping`` (of unique ``source``), or by ``unknown``."""
    m = mapping.select(F.col(source).alias("__s"), F.col(target).alias("__t"))
    return rows.join(m, F.col(key) == F.col("__s"), "left").withColumn(key, F.coalesce("__t", F.lit(unknown))).drop("__s", "__t")


def round_cells(rows: DataFrame, digits: int = 0, mode: str = "round") -> DataFrame:
    """Text cells that are numbers rounded (or ``floor``, ``ceil``); others as they are."""
    f = {"round": F.round, "floor": F.floor, "ceil": F.ceil}[mode]

    def cell(c: str) -> Column:
        x = F.col(f"`{c}`").cast("string").try_cast("double")
        y = f(x * 10**digits) / 10**digits if mode != "round" else F.round(x, digits)
        return F.when(x.isNotNull(), (y.cast("long") if digits <= 0 else y).cast("string")).otherwise(F.col(f"`{c}`").cast("string")).alias(c)

    return rows.select(*[cell(c) for c in rows.columns])


def split_columns(rows: DataFrame, key: str) -> DataFrame:
    """(name, key, value): a list for each column of a wide table; cells that are null, empty or 0 are left out; in names . / : become _."""
    long = rows.unpivot([key], [c for c in rows.columns if c != key], "name", "value")
    return long.filter(F.col("value").isNotNull() & (F.col("value").cast("string") != "") & ~F.coalesce(F.col("value").cast("string").try_cast("double") == 0, F.lit(False))).select(F.translate("name", "./:", "___").alias("name"), key, "value")


def distances(pairs: DataFrame, a: str = "a", b: str = "b", value: str = "value", max_sim: float = 0, default: float | None = None, ids: DataFrame | None = None) -> DataFrame:
    """(a, b, d) for both directions of every listed pair: the least of all values given for it; 0 for a name with itself.

    With ``max_sim`` values are similarities, d = (max_sim - value) / max_sim. With ``default`` and ``ids`` (a bounded list of names) the
    result has all their combinations, unlisted ones at the default, which no one-way value exceeds.
    """
    d = (max_sim - F.col(value)) / max_sim if max_sim else F.col(value).cast("double")
    p = pairs.select(F.col(a).alias("a"), F.col(b).alias("b"), d.alias("d")).dropna(subset=["a", "b"])
    both = p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"), "d")).groupBy("a", "b").agg(F.min("d").alias("d"))
    if ids is not None:
        n = ids.select("id").distinct()
        grid = n.select(F.col("id").alias("a")).crossJoin(n.select(F.col("id").alias("b")))  # the result itself is this matrix
        both = grid.join(both, ["a", "b"], "left")
        both = both.withColumn("d", F.least(F.coalesce("d", F.lit(default)), F.lit(default)) if default is not None else F.col("d"))
        both = both.withColumn("d", F.when(F.col("a") == F.col("b"), 0.0).otherwise(F.col("d")))
    return both


def group_distances(pairs: DataFrame, a: str = "a", b: str = "b", value: str = "value") -> DataFrame:
    """(a, b, d): median over repeated pairs, whatever their direction."""
    return pairs.groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.median(value).alias("d"))


def grouped_pairs(pairs: DataFrame, groups: DataFrame, value: str = "d") -> DataFrame:
    """(group, a, b, d): distances within each group (id, group); groups with a null distance are left out."""
    g = groups.select("id", "group")
    j = pairs.join(g.select(F.col("id").alias("a"), "group"), "a").join(g.select(F.col("id").alias("b"), F.col("group").alias("g2")), "b").filter("group = g2")
    bad = j.filter(F.col(value).isNull()).select("group").distinct()
    return j.join(bad, "group", "left_anti").select("group", "a", "b", value)


def bar_table(counts: DataFrame, row: str, column: str, n: str, top: int = 25) -> DataFrame:
    """(row, column, percent): share of each column's sum; rows past the ``top`` highest median shares (over all columns) are added up as ``Other``."""
    total = counts.groupBy(column).agg(F.sum(n).alias("__t"))
    cols = total.count()
    p = counts.groupBy(row, column).agg(F.sum(n).alias("__n")).join(total, column).withColumn("percent", 100.0 * F.col("__n") / F.col("__t"))
    present = p.groupBy(row).agg(F.sort_array(F.collect_list("percent")).alias("v"))  # as long as there are columns
    padded = F.concat(F.array_repeat(F.lit(0.0), F.lit(cols) - F.size("v")), F.col("v"))
    mid = (F.element_at(padded, int((cols - 1) // 2) + 1) + F.element_at(padded, int(cols // 2) + 1)) / 2
    best = present.select(row, mid.alias("__m")).orderBy(F.col("__m").desc(), row).limit(top).select(F.col(row).alias("__top"))
    named = p.join(best, F.col(row) == F.col("__top"), "left").withColumn(row, F.coalesce("__top", F.lit("Other")))
    return named.groupBy(row, column).agg(F.sum("percent").alias("percent"))


def preference_scores(presence: DataFrame, inside: DataFrame, row: str = "row", column: str = "column", all_columns: DataFrame | None = None) -> DataFrame:
    """(row, observed, expected, score, class): how much a row prefers the columns in ``inside`` over the others.

    presence: distinct (row, column) pairs. The expected value factorises over row and column sums, so no row meets every column."""
    p = presence.select(F.col(row).alias("r"), F.col(column).alias("c")).dropna().distinct()
    s = inside.select(F.col(column).alias("c"), F.lit(1).alias("ins")).distinct()
    marked = p.join(s, "c", "left").withColumn("ins", F.coalesce("ins", F.lit(0)))
    rows = marked.groupBy("r").agg(F.count(F.lit(1)).alias("n"), F.sum("ins").alias("i"))
    cols = marked.groupBy("c").agg(F.count(F.lit(1)).alias("m"), F.max("ins").alias("ins"))
    u, k = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n").alias("n_set")), cols.agg(F.count(F.lit(1)).alias("n_cols"))
    one = cols.crossJoin(F.broadcast(u)).withColumn("b", (F.col("m") + 1) / (F.col("n_rows") + 2))  # one row of totals
    side = one.agg(F.sum(F.when(F.col("ins") == 1, F.col("b")).otherwise(-F.col("b"))).alias("b_diff"), F.sum("b").alias("b_sum"))
    r = rows.crossJoin(F.broadcast(k)).withColumn("a", (F.col("n") + 1) / (F.col("n_cols") + 2))
    tot = r.agg(F.sum("a").alias("a_sum"))
    full = r.crossJoin(F.broadcast(u)).crossJoin(F.broadcast(side)).crossJoin(F.broadcast(tot))
    full = full.select(F.col("r").alias(row), ((2 * F.col("i") - F.col("n")) / F.col("n_set")).alias("observed"), (F.col("a") * F.col("b_diff") / (F.col("a_sum") * F.col("b_sum"))).alias("expected"), (1 + 100 / F.col("n_rows")).alias("t"))
    full = full.withColumn("score", F.col("observed") / F.abs("expected"))
    return full.withColumn("class", F.when(F.col("score") > F.col("t"), 1).when(F.col("score") < -F.col("t"), -1).otherwise(0)).drop("t")
