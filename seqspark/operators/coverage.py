"""Sequencing depth, its averages and windows, concatenated coordinates, recruitment histograms and identity distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import merge_intervals, overlap_join


def depth_runs(spans: DataFrame, key: str = "contig", start: str = "start", end: str = "end") -> DataFrame:
    """(key, start, end, depth): runs of equal depth of half-open spans, found from the changes at their ends, never base by base.

    Changes at one position are added up first. The running sum goes in two levels: over the sums of blocks of positions, then within each
    block, so that no task holds more of a long or hot sequence than one block. Spans with a null or without length do not count.
    """
    good = spans.filter(F.col(key).isNotNull() & F.col(start).isNotNull() & (F.col(end) > F.col(start)))
    change = good.select(key, F.explode(F.array(F.struct(F.col(start).cast("long").alias("p"), F.lit(1).alias("d")), F.struct(F.col(end).cast("long").alias("p"), F.lit(-1).alias("d")))).alias("x"))
    at = change.groupBy(key, F.col("x.p").alias("p")).agg(F.sum("x.d").alias("d")).withColumn("b", F.shiftright("p", 16))
    over = Window.partitionBy(key).orderBy("b")
    blocks = at.groupBy(key, "b").agg(F.sum("d").alias("s"), F.min("p").alias("f"))
    blocks = blocks.select(key, "b", (F.sum("s").over(over) - F.col("s")).alias("before"), F.lead("f").over(over).alias("next"))
    w = Window.partitionBy(key, "b").orderBy("p")
    inner = at.select(key, "b", "p", F.lead("p").over(w).alias("e"), F.sum("d").over(w).alias("d"))
    run = inner.join(blocks, [key, "b"]).select(key, F.col("p").alias("start"), F.coalesce("e", "next").alias("end"), (F.col("before") + F.col("d")).alias("depth"))
    return run.filter(F.col("end").isNotNull())


def depth_histogram(runs: DataFrame, lengths: DataFrame, key: str = "contig") -> DataFrame:
    """(key, depth, n): positions of each depth, those of depth 0 counted from the length. lengths: (key, length)."""
    covered = runs.filter("depth > 0").groupBy(key, "depth").agg(F.sum(F.col("end") - F.col("start")).alias("n"))
    total = covered.groupBy(key).agg(F.sum("n").alias("c"))
    zero = lengths.join(total, key).select(key, F.lit(0).cast("long").alias("depth"), (F.col("length") - F.col("c")).alias("n")).filter("n > 0")
    return covered.unionByName(zero)


def _cumulated(hist: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hist.withColumn("cum", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))


def _median(hist: DataFrame, key: str, name: str = "median") -> DataFrame:
    """(key, name): the lower median over positions."""
    return _cumulated(hist, [key]).filter(F.col("cum") > F.floor((F.col("total") - 1) / 2)).groupBy(key).agg(F.min("depth").alias(name))


def truncated_depth(hist: DataFrame, keys: list[str], keep: float = 0.5) -> DataFrame:
    """(keys, tad, length, breadth): mean depth of the central ``keep`` of positions, and the share of positions of some depth."""
    r = F.round((1 - F.lit(keep)) / 2 * F.col("total"))
    kept = F.greatest(F.lit(0.0), F.least(F.col("cum"), F.col("total") - r) - F.greatest(F.col("cum") - F.col("n"), r))
    c = _cumulated(hist, keys).withColumn("k", kept)
    return c.groupBy(*keys).agg(F.coalesce(F.sum(F.col("depth") * F.col("k")) / F.nullif(F.sum("k"), F.lit(0.0)), F.lit(0.0)).alias("tad"), F.sum("n").alias("length"), (1 - F.sum(F.when(F.col("depth") == 0, F.col("n")).otherwise(0)) / F.sum("n")).alias("breadth"))


def sequence_depth(spans: DataFrame, lengths: DataFrame, key: str = "contig", compat: bool = False) -> DataFrame:
    """(key, average, median, reads, length) of half-open spans on sequences of known length; sequences without spans don't come out.

    The median is the lower one over the positions; with ``compat`` one more position of depth 0 takes part.
    """
    hist = depth_histogram(depth_runs(spans, key), lengths, key)
    if compat:
        extra = hist.select(key).distinct().select(key, F.lit(0).cast("long").alias("depth"), F.lit(1).cast("long").alias("n"))
        hist = hist.unionByName(extra).groupBy(key, "depth").agg(F.sum("n").alias("n"))
    half = _median(hist, key)
    sums = spans.filter(F.col("end") > F.col("start")).groupBy(key).agg(F.sum(F.col("end") - F.col("start")).alias("s"), F.count(F.lit(1)).alias("reads"))
    return sums.join(half, key).join(lengths, key).select(key, (F.col("s") / F.col("length")).alias("average"), "median", "reads", "length")


def average_depth(hits: DataFrame, key: str = "sseqid", length: str = "sbj_len") -> DataFrame:
    """(key, average, reads, length): aligned query bases over the subject's length, without the median."""
    g = hits.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sum(F.abs(F.col("q_start") - F.col("q_end")) + 1).alias("s"), F.count(F.lit(1)).alias("reads"), F.max(length).alias("length"))
    return g.select(key, (F.col("s") / F.col("length")).alias("average"), "reads", "length")


def zero_inflated_depth(hist: DataFrame, key: str = "contig", compat: bool = False) -> DataFrame:
    """(key, mean, variance, lam, pi, median, median_covered): zero-inflated Poisson moments; where the variance is no larger than the mean,
    lam is the mean and pi 0. The medians are the lower ones over all positions and over those of some depth (null without any). With
    ``compat`` the squared mean is taken off the variance once more."""
    s = hist.groupBy(key).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("depth")).alias("s"), F.sum(F.col("n") * F.col("depth") * F.col("depth")).alias("q"))
    m = F.col("s") / F.col("n")
    s = s.select(key, m.alias("mean"), (F.col("q") / F.col("n") - m * m - (m * m if compat else F.lit(0.0))).alias("variance"))
    over = F.col("variance") > F.col("mean")
    lam = F.when(over, F.col("mean") + F.col("variance") / F.col("mean") - 1).otherwise(F.col("mean"))
    s = s.withColumn("lam", lam).withColumn("pi", F.when(over, 1 - F.col("mean") / F.col("lam")).otherwise(0.0))
    return s.join(_median(hist, key), key).join(_median(hist.filter("depth > 0"), key, "median_covered"), key, "left")


def depth_windows(runs: DataFrame, width: int = 1000, start: str = "start", end: str = "end") -> DataFrame:
    """(window, depth): mean depth of consecutive windows of concatenated coordinates; the part-filled last one is left out."""
    s, e = F.col(start), F.col(end)
    x = runs.filter(e > s).select(s.alias("s"), e.alias("e"), "depth", F.explode(F.sequence(F.floor(s / width), F.floor((e - 1) / width))).alias("window"))
    part = F.least(F.col("e"), (F.col("window") + 1) * width) - F.greatest(F.col("s"), F.col("window") * width)
    w = x.groupBy("window").agg((F.sum(part * F.col("depth")) / width).alias("depth"))
    last = runs.agg(F.floor(F.max(e) / width).alias("__last"))
    return w.crossJoin(F.broadcast(last)).filter("window < __last").drop("__last")  # one row


def cumulative_offsets(sequences: DataFrame, order: str = "rid", length: str = "length") -> DataFrame:
    """Sequences with ``offset``: summed lengths of those before them in file order, in two levels: sums per block of the order, then within.

    ``order`` must be a whole number; blocks are ranges of it, so no window spans more than one block's rows or the blocks' sums."""
    b = sequences.withColumn("__b", F.floor(F.col(order) / 65536))
    sums = b.groupBy("__b").agg(F.sum(length).alias("__s")).withColumn("__before", F.coalesce(F.sum("__s").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = Window.partitionBy("__b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inner = b.withColumn("__in", F.coalesce(F.sum(length).over(w), F.lit(0)))
    return inner.join(sums.select("__b", "__before"), "__b").withColumn("offset", F.col("__before") + F.col("__in")).drop("__b", "__before", "__in")


def concatenated_hits(hits: DataFrame, offsets: DataFrame, min_identity: float = 70, min_length: int = 60, order: str = "hit_id") -> DataFrame:
    """(start, end, pident, bitscore, read, corr_identity): hits in coordinates of the concatenated subjects, which begin at 2 (1 is taken
    off no position). The corrected identity is id*length over the query's length, or over the shorter of both where the subject's is known."""
    o = offsets.select(F.col("id").alias("sseqid"), "offset")
    h = hits.filter((F.col("length") >= min_length) & (F.col("pident") >= min_identity)).join(o, "sseqid")
    by = F.least("qry_len", "sbj_len") if "sbj_len" in hits.columns else F.col("qry_len")
    at = lambda f: F.col("offset") + f("s_start", "s_end") + 1
    return h.select(F.col(order), at(F.least).alias("start"), at(F.greatest).alias("end"), "pident", "bitscore", F.col("qseqid").alias("read"), (F.col("pident") * F.col("length") / by).alias("corr_identity"))


def sequence_limits(offsets: DataFrame) -> DataFrame:
    """(id, start, end) of each sequence in concatenated coordinates: from its offset plus 1 to one past its last base."""
    return offsets.select("id", (F.col("offset") + 1).alias("start"), (F.col("offset") + F.col("length") + 1).alias("end"))


def feature_gaps(features: DataFrame, seqid: str = "seqid", start: str = "start", end: str = "end") -> DataFrame:
    """(seqid, start, end, kind): features (FEAT) and the GAPs between them, each from one past what the features before reach."""
    gaps = merge_intervals(features, seqid, start, end).filter("stretch = 'gap'").select(seqid, F.col("start_pos").alias("start"), F.col("end_pos").alias("end"), F.lit("GAP").alias("kind"))
    return gaps.unionByName(features.select(seqid, F.col(start).cast("long").alias("start"), F.col(end).cast("long").alias("end"), F.lit("FEAT").alias("kind")))


def previous_row(rows: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """Rows with ``before``, a struct of ``columns`` of the row before by ``order`` (a whole number), null for the first. Goes in two
    levels: within blocks of the order, and from the last row of the block before."""
    x = rows.withColumn("__b", F.floor(F.col(order) / 65536)).withColumn("__row", F.struct(*columns))
    last = x.groupBy("__b").agg(F.max_by("__row", order).alias("__last"))
    last = last.select("__b", F.lag("__last").over(Window.orderBy("__b")).alias("__before"))  # a row per block
    inner = x.withColumn("__in", F.lag("__row").over(Window.partitionBy("__b").orderBy(order)))
    return inner.join(last, "__b").withColumn("before", F.coalesce("__in", "__before")).drop("__b", "__row", "__in", "__before")


def feature_breaks(features: DataFrame, offsets: DataFrame, gaps: bool = True, order: str = "rid") -> DataFrame:
    """(rid, end, name, kind): ends of features (rid, seqid, start, end, name; in file order) in coordinates of the concatenated sequences of
    ``offsets`` (id, offset, length), to be read in the order of rid and end.

    With ``gaps`` a row GAP, named ``before~after``, ends where a feature begins later than the one before ended, and one that leads to the
    end of the last sequence; a feature that begins earlier begins there. Row 0 is the start. Features of unknown sequences, or with a
    null, drop out."""
    o = offsets.select(F.col("id").alias("seqid"), "offset")
    total = offsets.agg(F.max(F.col("offset") + F.col("length") + 1).alias("__total"))
    f = features.join(o, "seqid").select(F.col(order).alias("rid"), (F.col("offset") + F.col("start") + 1).alias("start"), (F.col("offset") + F.col("end") + 1).alias("end"), "name").dropna()
    first = features.sparkSession.createDataFrame([(-1, 1, "NA", "NA")], "rid long, end long, name string, kind string")
    ends = f.select("rid", "end", "name", F.lit("FEAT").alias("kind"))
    if not gaps:
        return first.unionByName(ends)
    p = previous_row(f, "rid", ["end", "name"])
    came, called = F.coalesce(F.col("before.end"), F.lit(1)), F.coalesce(F.col("before.name"), F.lit("NA"))
    hole = p.filter(F.col("start") > came).select("rid", F.col("start").alias("end"), F.concat_ws("~", called, "name").alias("name"), F.lit("GAP").alias("kind"))
    tail = f.agg(F.max_by(F.struct("rid", "end", "name"), "rid").alias("x")).crossJoin(total).filter("x.end <> __total")  # one row
    tail = tail.select(F.col("x.rid"), F.col("__total").alias("end"), F.concat_ws("~", "x.name", F.lit("NA")).alias("name"), F.lit("GAP").alias("kind"))
    return first.unionByName(ends).unionByName(hole).unionByName(tail)


def equal_breaks(limits: DataFrame, n: int = 1000) -> DataFrame:
    """(pos_bin, low, high): ``n`` equal position bins from the first to the last position of ``limits`` (id, start, end)."""
    ends = limits.agg(F.min("start").cast("double").alias("a"), F.max("end").cast("double").alias("b"))
    at = lambda i: F.col("a") + (F.col("b") - F.col("a")) * i / n
    return limits.sparkSession.range(n).crossJoin(F.broadcast(ends)).select(F.col("id").alias("pos_bin"), at(F.col("id")).alias("low"), at(F.col("id") + 1).alias("high"))  # one row


def sequence_breaks(limits: DataFrame) -> DataFrame:
    """(pos_bin, low, high, name): one position bin a sequence: from where the one before ends to its own end."""
    p = previous_row(limits.select("id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")), "start", ["end"])
    number = cumulative_offsets(p.withColumn("one", F.lit(1)), "start", "one")
    return number.select(F.col("offset").cast("long").alias("pos_bin"), F.coalesce(F.col("before.end"), F.col("start")).cast("double").alias("low"), F.col("end").cast("double").alias("high"), F.col("id").alias("name"))


def table_breaks(breaks: DataFrame) -> DataFrame:
    """(pos_bin, low, high, name): bins between consecutive rows of an explicit list (rid, at, name); a bin has the name of its end."""
    p = previous_row(breaks, "rid", ["at"]).filter("before is not null")
    number = cumulative_offsets(p.withColumn("one", F.lit(1)), "rid", "one")
    return number.select(F.col("offset").cast("long").alias("pos_bin"), F.col("before.at").cast("double").alias("low"), F.col("at").cast("double").alias("high"), "name")


def identity_range(records: DataFrame, column: str = "pident", free: bool = False) -> tuple[float, float]:
    """Lowest and highest identity break: the range of the records' identities, and of 70 and 100 unless ``free``."""
    r = records.agg(F.min(column).alias("a"), F.max(column).alias("b")).first()
    low, high = (70.0, 100.0) if r["a"] is None else (float(r["a"]), float(r["b"]))
    return (low, high) if free else (min(low, 70.0), max(high, 100.0))


def recruitment_cells(records: DataFrame, bins: DataFrame, id_low: float = 70, id_high: float = 100, id_bins: int = 60, in_group: float = 95, column: str = "pident", width: int = 1000) -> DataFrame:
    """(pos_bin, id_bin, n, in_group) as :func:`recruitment_plot`, for position bins (pos_bin, low, high) of any sizes and ``id_bins`` equal
    identity bins, all open on the left. ``column`` may be a corrected identity or a score.

    A range join made an equi-join: records and bins are spread over stretches of ``width`` positions, whatever the breaks."""
    size = (id_high - id_low) / id_bins
    r = records.select(F.lit(1).alias("k"), F.least("start", "end").alias("start"), F.greatest("start", "end").alias("end"), left_open_bin(F.col(column), id_low, size).alias("id_bin")).dropna().filter((F.col("id_bin") >= 0) & (F.col("id_bin") < id_bins))
    b = bins.select(F.lit(1).alias("k"), "pos_bin", (F.floor("low") + 1).alias("start"), F.floor("high").alias("end"))
    j = overlap_join(r, b, "k", width=width)
    n = F.least("end", "end_r") - F.greatest("start", "start_r") + 1
    cells = j.groupBy(F.col("pos_bin_r").alias("pos_bin"), "id_bin").agg(F.sum(n).alias("n"))
    return cells.withColumn("in_group", id_low + (F.col("id_bin") + 0.5) * size > in_group)


def cell_depth(cells: DataFrame, bins: DataFrame, selected: bool = True) -> DataFrame:
    """(pos_bin, depth): bases over the size of the bin for in-group cells, or the others; bins without any have 0."""
    n = cells.filter(F.col("in_group") == selected).groupBy("pos_bin").agg(F.sum("n").alias("n"))
    return bins.select("pos_bin", "low", "high").join(n, "pos_bin", "left").select("pos_bin", (F.coalesce("n", F.lit(0)) / (F.col("high") - F.col("low"))).alias("depth"))


def left_open_bin(x: Column, low: float, width: float) -> Column:
    """Number from 0 of the bin (low + i*width, low + (i+1)*width] that holds x; -1 for the lowest break itself."""
    return (F.ceil((x - low) / width) - 1).cast("int")


def recruitment_plot(records: DataFrame, width: int = 1000, id_low: float = 70, id_width: float = 0.5, in_group: float = 95) -> DataFrame:
    """(pos_bin, id_bin, n, in_group): aligned bases of each cell of position and identity bins, all bins open on the left.

    A record is spread over the position bins it overlaps only, its share being the overlap's length. Identities at or below the lowest break
    fall in no bin. ``in_group`` tells bins whose middle lies above the cut-off.
    """
    r = records.select(F.least("start", "end").alias("s"), F.greatest("start", "end").alias("e"), left_open_bin(F.col("pident"), id_low, id_width).alias("id_bin")).dropna().filter("id_bin >= 0")
    bins = r.select("*", F.explode(F.sequence(F.ceil(F.col("s") / width) - 1, F.ceil(F.col("e") / width) - 1)).alias("pos_bin"))
    n = F.least(F.col("e"), (F.col("pos_bin") + 1) * width) - F.greatest(F.col("s"), F.col("pos_bin") * width + 1) + 1
    cells = bins.groupBy("pos_bin", "id_bin").agg(F.sum(n).alias("n"))
    return cells.withColumn("in_group", id_low + (F.col("id_bin") + 0.5) * id_width > in_group)


def plot_depth(cells: DataFrame, width: int = 1000, selected: bool = True) -> DataFrame:
    """(pos_bin, depth): bases per position of the in-group cells, or of the others."""
    return cells.filter(F.col("in_group") == selected).groupBy("pos_bin").agg((F.sum("n") / width).alias("depth"))


def change_cutoff(cells: DataFrame, cutoff: float = 98, id_low: float = 70, id_width: float = 0.5) -> DataFrame:
    """The plot's cells with groups told apart at another cut-off."""
    return cells.withColumn("in_group", id_low + (F.col("id_bin") + 0.5) * id_width > cutoff)


def plot_identity(cells: DataFrame, low: float, high: float, id_low: float = 70, id_width: float = 0.5) -> DataFrame:
    """(anir): mean identity of the bases in bins whose middle lies in the range."""
    mid = id_low + (F.col("id_bin") + 0.5) * id_width
    return cells.filter((mid >= low) & (mid <= high)).agg((F.sum(mid * F.col("n")) / F.sum("n")).alias("anir"))


def bin_coordinates(bins: DataFrame, limits: DataFrame, width: int = 1000) -> DataFrame:
    """(pos_bin, id, start, end): the sequences that lie in each position bin, with positions within them. limits: as sequence_limits.

    A range join made an equi-join: every sequence is spread over the bins it overlaps."""
    s = limits.select("id", F.col("start").alias("a"), F.col("end").alias("b"), F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))).alias("pos_bin"))
    j = bins.select("pos_bin").distinct().join(s, "pos_bin")
    return j.select("pos_bin", "id", (F.greatest(F.col("a"), F.col("pos_bin") * width) - F.col("a") + 1).alias("start"), (F.least(F.col("b") - 1, (F.col("pos_bin") + 1) * width - 1) - F.col("a") + 1).alias("end"))


def window_threshold(peaks: DataFrame, significance: float = 0.05, lower: bool = True) -> DataFrame:
    """(threshold): the depth that is ``significance`` from the lower (or upper) end of the core peak (mean and sd in logarithms, core: as
    of :func:`seqspark.operators.statistics.find_peaks`)."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(significance if lower else 1 - significance)
    return peaks.filter("core").select(F.exp(F.col("mean") + z * F.col("sd")).alias("threshold"))


def extract_windows(depths: DataFrame, peaks: DataFrame, significance: float = 0.05, lower: bool = True) -> DataFrame:
    """Windows whose depth lies below (or above) the threshold of :func:`window_threshold`."""
    t = F.broadcast(window_threshold(peaks, significance, lower))  # one row
    return depths.crossJoin(t).filter(F.col("depth") < F.col("threshold") if lower else F.col("depth") > F.col("threshold")).drop("threshold")


def compare_identities(left: DataFrame, right: DataFrame, pseudocount: float = 0) -> DataFrame:
    """(hellinger, bhattacharyya, kl, euclidean) between two identity histograms (id_bin, n) brought to sum 1."""
    j = left.groupBy("id_bin").agg(F.sum("n").alias("a")).join(right.groupBy("id_bin").agg(F.sum("n").alias("b")), "id_bin", "full")
    j = j.select(*[(F.coalesce(c, F.lit(0)) + pseudocount).cast("double").alias(c) for c in ("a", "b")])
    tot = j.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    p, q = F.col("a") / F.col("ta"), F.col("b") / F.col("tb")
    s = j.crossJoin(F.broadcast(tot)).select(p.alias("p"), q.alias("q"))  # totals are one row
    h = F.sqrt(F.sum(F.pow(F.sqrt("p") - F.sqrt("q"), 2))) / F.sqrt(F.lit(2.0))
    kl = F.sum(F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("p") * F.ln(F.col("p") / F.col("q"))).otherwise(0.0))
    return s.agg(h.alias("hellinger"), (1 - h * h).alias("bhattacharyya"), kl.alias("kl"), F.sqrt(F.sum(F.pow(F.col("p") - F.col("q"), 2))).alias("euclidean"))


def average_identity(identities: DataFrame, threshold: float = 95, column: str = "pident") -> DataFrame:
    """(anir, reads): mean identity of the reads at or above a fixed threshold."""
    return identities.filter(F.col(column) >= threshold).agg(F.avg(column).alias("anir"), F.count(F.lit(1)).alias("reads"))


def identity_histogram(identities: DataFrame, size: float = 1, column: str = "pident", top: float = 100) -> DataFrame:
    """(from, to, n): histogram of identities with bins counted down from ``top``, each open below."""
    k = F.floor((top - F.col(column)) / size)
    g = identities.filter(F.col(column).isNotNull()).groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return g.select((top - (F.col("k") + 1) * size).alias("lower"), (top - F.col("k") * size).alias("upper"), "n")
