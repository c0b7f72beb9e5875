"""Sample moments, truncated means, mixtures, peaks, resampling tests and growth curves."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import store
from .sampling import shuffled, uniform


def moments(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, n, mean, var, sd, skewness, kurtosis): sample variance; third and fourth central moments over (n-1) times sd^3 and sd^4.

    Two passes: central sums are taken about the mean, as power sums would lose digits."""
    keys = keys or []
    x = df.select(*keys, F.col(value).cast("double").alias("__x")).filter(F.col("__x").isNotNull() & ~F.isnan("__x"))
    m = x.groupBy(*keys).agg(F.avg("__x").alias("__m"))
    c = (x.join(m, keys) if keys else x.crossJoin(F.broadcast(m))).withColumn("__d", F.col("__x") - F.col("__m"))  # without keys, one row
    s = c.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("__m").alias("mean"), *[F.sum(F.pow("__d", k)).alias(f"__s{k}") for k in (2, 3, 4)])
    n1 = F.nullif(F.col("n") - 1, F.lit(0))
    s = s.withColumn("var", F.col("__s2") / n1).withColumn("sd", F.sqrt("var"))
    sd = F.nullif("sd", F.lit(0.0))
    return s.withColumn("skewness", F.col("__s3") / (n1 * F.pow(sd, 3))).withColumn("kurtosis", F.col("__s4") / (n1 * F.pow(sd, 4))).drop("__s2", "__s3", "__s4")


def bimodality(m: DataFrame) -> DataFrame:
    """Rows of :func:`moments` with ``sarle``, Sarle's coefficient; null for fewer than four values."""
    n = F.col("n").cast("double")
    small = F.nullif((n - 2) * (n - 3), F.lit(0.0))
    return m.withColumn("sarle", F.when(n > 3, (F.pow("skewness", 2) + 1) / (F.col("kurtosis") + 3 * F.pow(n - 1, 2) / small)))


def truncated_mean(df: DataFrame, value: str, keep: float = 0.95) -> DataFrame:
    """(mean): mean of the central values, round(n*(1-keep)/2) cut off at either end; null values do not count.

    Values are counted, range-partitioned and stored; their ranks go in two levels, over the partitions' counts and within each."""
    c = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("k"))
    c = store(c.repartitionByRange("v").withColumn("b", F.spark_partition_id()), "ranges")
    b = c.groupBy("b").agg(F.sum("k").alias("s")).withColumn("before", F.sum("s").over(Window.orderBy("b")) - F.col("s"))  # a row per partition
    c = c.join(b.select("b", "before"), "b").withColumn("hi", F.col("before") + F.sum("k").over(Window.partitionBy("b").orderBy("v"))).crossJoin(F.broadcast(c.agg(F.sum("k").alias("N"))))
    r = F.round(F.col("N") * (1 - keep) / 2)
    kept = F.greatest(F.lit(0), F.least("hi", F.col("N") - r) - F.greatest(F.col("hi") - F.col("k"), r))
    return c.agg((F.sum(F.col("v") * kept) / F.nullif(F.sum(kept), F.lit(0.0))).alias("mean"))


#: Values that a peak search holds; more are put on a grid of GRID (in logarithms of depth), which is as few for any number of windows.
VALUES = 100_000
GRID = 1e-4


def log_depths(depths: DataFrame, depth: str = "depth", drop_top: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of the windows' depths and how many windows have each, for windows of some depth below the quantile 1 - ``drop_top`` of it
    (linear between two places; strictly below, all with 0)."""
    d = depths.filter(F.col(depth) > 0).select(F.ln(F.col(depth).cast("double")).alias("x"))
    c = store(d.groupBy("x").agg(F.count(F.lit(1)).alias("k")), "depths")
    if c.count() > VALUES:
        c = c.groupBy((F.round(F.col("x") / GRID) * GRID).alias("x")).agg(F.sum("k").alias("k"))
    rows = c.orderBy("x").collect()
    x, k = np.array([r["x"] for r in rows], float), np.array([r["k"] for r in rows], float)
    if drop_top and len(x):
        cum = np.cumsum(k)
        at = (cum[-1] - 1) * (1 - drop_top)
        value = lambda place: np.exp(x[min(int(np.searchsorted(cum, place, side="right")), len(x) - 1)])
        top = value(np.floor(at)) + (value(np.ceil(at)) - value(np.floor(at))) * (at - np.floor(at))
        keep = np.exp(x) < top
        x, k = x[keep], k[keep]
    return x, k


def _start(x: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, deviations and weights of ``k`` clusters of weighted values, from evenly spaced quantiles."""
    cum = np.cumsum(n) / n.sum()
    mu = x[np.minimum(np.searchsorted(cum, (np.arange(k) + 0.5) / k), len(x) - 1)]
    lab = np.zeros(len(x), int)
    for _ in range(100):
        lab = np.argmin(np.abs(x[:, None] - mu[None, :]), axis=1)
        new = np.array([np.average(x[lab == i], weights=n[lab == i]) if (lab == i).any() else mu[i] for i in range(k)])
        if np.allclose(new, mu):
            break
        mu = new
    spread = lambda s: max(float(np.sqrt(np.average((x[s] - np.average(x[s], weights=n[s])) ** 2, weights=n[s]))), 1e-3)
    every = np.ones(len(x), bool)
    sd = np.array([spread(lab == i) if (lab == i).sum() > 1 else spread(every) for i in range(k)])
    return mu, sd, np.array([max(n[lab == i].sum() / n.sum(), 1e-6) for i in range(k)])


def mixture(x: np.ndarray, k: int, rounds: int = 1000, tolerance: float = 1e-8, counts: np.ndarray | None = None, start: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Means, deviations, weights and log likelihood of a mixture of ``k`` normal distributions, by expectation maximisation over values that
    occur ``counts`` times each: the same as over every one of them."""
    n = np.ones(len(x)) if counts is None else counts
    mu, sd, w = start or _start(x, n, k)
    last = -math.inf
    for _ in range(rounds):
        dens = w * np.exp(-0.5 * ((x[:, None] - mu) / sd) ** 2) / (sd * math.sqrt(2 * math.pi)) + 1e-300
        tot = dens.sum(axis=1)
        ll = float((n * np.log(tot)).sum())
        r = dens / tot[:, None] * n[:, None]
        m = r.sum(axis=0) + 1e-12
        mu = (r * x[:, None]).sum(axis=0) / m
        sd = np.sqrt(np.maximum((r * (x[:, None] - mu) ** 2).sum(axis=0) / m, 1e-6))
        w = m / n.sum()
        if abs(ll - last) <= tolerance:
            break
        last = ll
    return mu, sd, w, ll


def core_peak(peaks: list[tuple[float, float, float]]) -> int:
    """Index of the core among peaks (mean of logarithms, sd, size): from the deepest on, a peak at least as large as the core so far takes its
    place if the logarithms of their depths differ by less than log(1.75) (fixed value) and a fifth of the logarithm of their sizes' ratio."""
    deepest = max(range(len(peaks)), key=lambda i: peaks[i][0])
    core = deepest
    for i, p in enumerate(peaks):
        ratio = math.log(p[2] / peaks[core][2]) if p[2] > 0 and peaks[core][2] > 0 else -1.0
        if ratio >= 0 and abs(p[0] - peaks[deepest][0]) < math.log(1.75) + ratio / 5:
            core = i
    return core


def find_peaks(depths: DataFrame, depth: str = "depth", most: int = 5, drop_top: float = 0.05, criterion: str = "aic", largest: bool = False, digits: int = 2) -> DataFrame:
    """(peak, mean, sd, weight, n, core): peaks of the logarithm of window depths, by normal mixtures of 1 to ``most`` components.

    Every window of some depth counts, those of the highest ``drop_top`` left out, in the fit and in the criterion. The number of components
    has the least AIC or BIC (the largest with ``largest``). Where peaks agree in ``digits`` significant digits of the logarithm of their
    depth, a mixture of the distinct ones is fitted from there, and taken if the criterion says so. ``n`` is the number of windows a peak
    explains, ``core`` marks the core peak (see :func:`core_peak`). No windows give no peaks."""
    spark = depths.sparkSession
    schema = "peak int, mean double, sd double, weight double, n double, core boolean"
    x, n = log_depths(depths, depth, drop_top)
    if not len(x):
        return spark.createDataFrame([], schema)
    best: tuple | None = None

    def consider(k: int, start: tuple | None = None) -> None:
        nonlocal best
        mu, sd, w, ll = mixture(x, k, counts=n, start=start)
        params = 3 * k - 1
        score = 2 * params - 2 * ll if criterion == "aic" else math.log(n.sum()) * params - 2 * ll
        if best is None or (score > best[0] if largest else score < best[0]):
            best = (score, mu, sd, w)

    for k in range(1, min(most, len(x)) + 1):
        consider(k)
    _, mu, sd, w = best
    near = [float(f"{m:.{digits - 1}e}") for m in mu]
    first = [i for i, m in enumerate(near) if m not in near[:i]]
    if len(first) < len(mu):
        consider(len(first), (mu[first], sd[first], w[first] / w[first].sum()))
        _, mu, sd, w = best
    peaks = sorted((float(m), float(s), float(a)) for m, s, a in zip(mu, sd, w))
    core = core_peak(peaks)
    return spark.createDataFrame([(i + 1, *p, float(p[2] * n.sum()), i == core) for i, p in enumerate(peaks)], schema)


def peak_histogram(peaks: DataFrame, mids: list[float]) -> DataFrame:
    """(peak, mid, n): windows that each peak of :func:`find_peaks` is expected to have at the middles of a histogram of depths."""
    at = F.explode(F.array(*[F.lit(float(m)) for m in mids])).alias("mid")
    x = peaks.select("*", at)
    d = F.exp(-0.5 * F.pow((F.ln("mid") - F.col("mean")) / F.col("sd"), 2)) / F.col("sd")
    x = x.withColumn("d", d)
    return x.select("peak", "mid", (F.col("n") * F.col("d") / F.nullif(F.sum("d").over(Window.partitionBy("peak")), F.lit(0.0))).alias("n"))


def mow_peaks(depths: DataFrame, depth: str = "depth", most: int = 5, quantiles: tuple[float, ...] = (0.4, 0.5, 0.6), least: float = 0.05, close: float = math.log(1.75), drop_top: float = 0.0) -> DataFrame:
    """(peak, mean, sd, weight): peaks found one after another: a normal curve is matched to central quantiles of what is left, and the values
    it explains are taken away, until less than ``least`` of them are left. Peaks whose depths' logarithms differ by less than ``close``
    are merged where one curve fits them both: where none but one peak is found in the values of the two."""
    from statistics import NormalDist

    x, n = log_depths(depths, depth, drop_top)
    total, z = n.sum(), np.array([NormalDist().inv_cdf(q) for q in quantiles])

    def mow(x: np.ndarray, n: np.ndarray, number: int) -> list[tuple]:
        found = []
        whole = n.sum()
        while len(x) > 1 and n.sum() > max(5, least * whole) and len(found) < number:
            cum = (np.cumsum(n) - 0.5 * n) / n.sum()
            q = np.interp(quantiles, cum, x)
            sd = max(float(((q - q.mean()) * (z - z.mean())).sum() / ((z - z.mean()) ** 2).sum()), 1e-3)
            mu = float(np.interp(0.5, cum, x))
            inside = np.abs(x - mu) <= 2 * sd
            found.append((mu, sd, x[inside], n[inside]))
            x, n = x[~inside], n[~inside]
        return found

    peaks = mow(x, n, most)
    merged = True
    while merged and len(peaks) > 1:
        merged = False
        for i, p in enumerate(peaks):
            j = min((k for k in range(len(peaks)) if k != i), key=lambda k: abs(peaks[k][0] - p[0]))
            if abs(peaks[j][0] - p[0]) < close:
                both = np.concatenate([p[2], peaks[j][2]])
                order = np.argsort(both, kind="stable")
                again = mow(both[order], np.concatenate([p[3], peaks[j][3]])[order], most)
                if len(again) == 1:
                    peaks = [*(q for k, q in enumerate(peaks) if k not in (i, j)), again[0]]
                    merged = True
                    break
    rows = [(i + 1, p[0], p[1], float(min(1.0, p[3].sum() / 0.9545 / total))) for i, p in enumerate(peaks)]
    return depths.sparkSession.createDataFrame(rows, "peak int, mean double, sd double, weight double")


def trib_resample(points: DataFrame, fractions: list[float] | None = None, replicates: int = 1000, seed: int = 1, pad: float = 0.0) -> DataFrame:
    """(fraction, rep, median): median distance between the members of random subsets of points (id, xs: array), drawn evenly over space.

    A replicate draws points of the unit cube, widened by ``pad`` of its sides, and takes the nearest item to each that is still free;
    replicates run side by side. The ordination (of genomes or samples; 8 bytes a number) is broadcast; one that is over 64 MB raises
    ValueError before it is read. Medians are found by bisection over blocks of distances, so memory grows with the items, not their pairs.
    Fractions are 0 to 1 in steps of 0.01 unless given."""
    fractions = [i / 100 for i in range(101)] if fractions is None else fractions
    size = points.agg(F.coalesce(F.sum(F.size("xs") * 8 + 16), F.lit(0)).alias("b")).first()["b"]
    if size > 64e6:
        raise ValueError("an ordination of more than 64 MB")
    rows = points.select("id", "xs").dropna().orderBy("id").collect()
    xs = np.array([r["xs"] for r in rows], float).reshape(len(rows), -1)
    lo, hi = (xs.min(axis=0), xs.max(axis=0)) if len(xs) else (xs[:0], xs[:0])
    unit = (xs - lo) / np.where(hi > lo, hi - lo, 1) if len(xs) else xs

    def run(batches: Iterator) -> Iterator:
        near = _apart(xs, xs) if len(xs) <= AT_ONCE else None
        for pdf in batches:
            out = []
            for f, rep in zip(pdf["fraction"], pdf["rep"]):
                rng = np.random.default_rng([seed, int(rep), int(round(f * 1e6))])
                n = min(max(2, round(f * len(unit))), len(unit))
                free = np.ones(len(unit), bool)
                for p in rng.random((n, unit.shape[1])) * (1 + 2 * pad) - pad:
                    d = ((unit - p) ** 2).sum(axis=1)
                    d[~free] = np.inf
                    free[int(np.argmin(d))] = False
                out.append(median_distance(xs[~free]) if near is None else _median_within(near, np.flatnonzero(~free)))
            yield pdf.assign(median=out)

    grid = points.sparkSession.range(1, replicates + 1).select(F.explode(F.array(*[F.lit(float(f)) for f in fractions])).alias("fraction"), F.col("id").cast("int").alias("rep"))
    return grid.repartition("fraction", "rep").mapInPandas(run, "fraction double, rep int, median double")


#: Points whose distances to each other are held at once.
AT_ONCE = 2000


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    total = np.zeros((len(x), len(y)))
    for k in range(x.shape[1]):
        total += (x[:, None, k] - y[None, :, k]) ** 2
    return np.sqrt(total)


def _median_within(apart: np.ndarray, chosen: np.ndarray) -> float | None:
    return float(np.median(apart[np.ix_(chosen, chosen)][np.triu_indices(len(chosen), 1)])) if len(chosen) > 1 else None


def median_distance(xs: np.ndarray, at_once: int = AT_ONCE) -> float | None:
    """Median of the distances between all pairs of rows; null for fewer than two. Up to ``at_once`` rows are held at once; beyond, distances
    are counted block by block until the two middle ones are pinned down."""
    n = len(xs)
    if n < 2:
        return None

    def blocks() -> Iterator[np.ndarray]:
        for a in range(0, n, at_once):
            x = xs[a : a + at_once]
            yield _apart(x, x)[np.triu_indices(len(x), 1)]
            for b in range(a + at_once, n, at_once):
                yield _apart(x, xs[b : b + at_once]).ravel()

    if n <= at_once:
        return float(np.median(next(blocks())))
    pairs = n * (n - 1) // 2
    got = []
    for k in {(pairs - 1) // 2, pairs // 2}:
        low, high = 0.0, float(np.sqrt(((xs.max(axis=0) - xs.min(axis=0)) ** 2).sum()))
        while True:
            inside = np.concatenate([d[(d >= low) & (d <= high)] for d in blocks()]) if sum(int(((d >= low) & (d <= high)).sum()) for d in blocks()) <= 1_000_000 else None
            if inside is not None:
                below = sum(int((d < low).sum()) for d in blocks())
                got.append(float(np.partition(inside, k - below)[k - below]))
                break
            mid = (low + high) / 2
            if not low < mid < high:
                got.append(mid)
                break
            low, high = (low, mid) if sum(int((d <= mid).sum()) for d in blocks()) > k else (mid, high)
    return float(sum(got) / len(got))


def trib_summary(tribs: DataFrame) -> DataFrame:
    """(fraction, mean, q25, q50, q75, n) over replicates."""
    return tribs.groupBy("fraction").agg(F.avg("median").alias("mean"), *[F.percentile("median", q / 100).alias(f"q{q}") for q in (25, 50, 75)], F.count(F.lit(1)).alias("n"))


def trib_test(selected: DataFrame, every: DataFrame, value: str = "d", bins: int = 50, low: float = 0, high: float = 1) -> DataFrame:
    """(p_over, p_under): chance that a distance of the selection is at least (at most) one of all, from two histograms and their convolution."""
    def hist(df: DataFrame, name: str) -> DataFrame:
        k = F.least(F.greatest(F.floor((F.col(value) - low) / (high - low) * bins), F.lit(0)), F.lit(bins - 1))
        h = df.filter(F.col(value).isNotNull()).groupBy(k.alias(f"k{name}")).agg(F.count(F.lit(1)).cast("double").alias(f"n{name}"))
        t = h.agg(F.sum(f"n{name}").alias("t"))
        return h.crossJoin(F.broadcast(t)).select(f"k{name}", (F.col(f"n{name}") / F.col("t")).alias(f"p{name}"))

    both = hist(selected, "s").crossJoin(hist(every, "a"))  # at most bins x bins rows
    p = F.col("ps") * F.col("pa")
    return both.agg(F.sum(F.when(F.col("ks") >= F.col("ka"), p).otherwise(0.0)).alias("p_over"), F.sum(F.when(F.col("ks") <= F.col("ka"), p).otherwise(0.0)).alias("p_under"))


def _growth(t: np.ndarray, y: np.ndarray, rounds: int = 200) -> tuple[float, float, float, float]:
    k, p0, r = float(y.max()) * 1.05 + 1e-9, max(float(y.min()), 1e-6), 1.0 / max(float(np.ptp(t)), 1e-9) * 5
    p, lam = np.array([k, p0, r]), 1e-3
    f = lambda q: q[0] * q[1] * np.exp(np.clip(q[2] * t, -50, 50)) / (q[0] + q[1] * (np.exp(np.clip(q[2] * t, -50, 50)) - 1))
    cost = ((y - f(p)) ** 2).sum()
    for _ in range(rounds):
        step = 1e-6 * np.maximum(np.abs(p), 1e-6)
        jac = np.stack([(f(p + step * (np.arange(3) == i)) - f(p)) / step[i] for i in range(3)], axis=1)
        a = jac.T @ jac
        try:
            new = p + np.linalg.solve(a + lam * np.diag(np.diag(a) + 1e-12), jac.T @ (y - f(p)))
        except np.linalg.LinAlgError:
            break
        c = ((y - f(new)) ** 2).sum() if (new > 0).all() else math.inf
        if c < cost:
            done = abs(cost - c) < 1e-14 * (1 + cost)
            p, cost, lam = new, c, lam / 3
            if done:
                break
        else:
            lam *= 5
            if lam > 1e12:
                break
    return (*map(float, p), float(math.sqrt(cost / max(1, len(y) - 3))))


def growth_curves(od: DataFrame, sample: str = "sample", time: str = "t", value: str = "od") -> DataFrame:
    """(sample, k, p0, r, residual): logistic growth K*P0*e^(rt)/(K+P0*(e^(rt)-1)) fitted to each sample by damped Gauss-Newton steps.

    Samples of fewer than four readings have nulls. Null readings do not count."""
    def fit(pdf):
        import pandas as pd

        d = pdf.dropna()
        got = _growth(d["t"].to_numpy(float), d["od"].to_numpy(float)) if len(d) > 3 else (None,) * 4
        return pd.DataFrame([(pdf["sample"].iloc[0], *got)], columns=["sample", "k", "p0", "r", "residual"])

    return od.select(F.col(sample).cast("string").alias("sample"), F.col(time).cast("double").alias("t"), F.col(value).cast("double").alias("od")).groupBy("sample").applyInPandas(fit, "sample string, k double, p0 double, r double, residual double")


def identity_threshold(identities: DataFrame, column: str = "pident", fixed: float = 95, cutoff: float = 5 / 9) -> float:
    """The threshold between reads of the genome and others: the lowest point between two peaks if the identities are bimodal, else ``fixed``."""
    b = bimodality(moments(identities, column)).first()
    if not b or b["sarle"] is None or b["sarle"] < cutoff:
        return fixed
    h = {r["k"]: r["n"] for r in identities.filter(F.col(column).isNotNull()).groupBy(F.floor(F.col(column)).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 101 rows
    ks = range(min(h), max(h) + 1)
    top = max(ks, key=lambda k: (h.get(k, 0), k))
    second = max((k for k in ks if abs(k - top) > 2), key=lambda k: h.get(k, 0), default=top)
    lo, hi = sorted((top, second))
    return float(min(range(lo, hi + 1), key=lambda k: (h.get(k, 0), -k)))


def random_order(df: DataFrame, *keys: str, seed: int = 1) -> DataFrame:
    return df.withColumn("random_order", shuffled(seed, *[F.col(k) for k in keys])).withColumn("u", uniform(seed, *[F.col(k) for k in keys]))
