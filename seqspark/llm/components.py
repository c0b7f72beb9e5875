"""One group identifier for all records linked directly or indirectly: low-diameter decomposition, contraction, recursion."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import discard, store

#: Rate of the exponential shifts.
BETA = 0.3
#: Shifts are drawn from the exponential distribution below this bound, so that no cluster reaches further than REACH - 1 hops.
REACH = 5
#: Edges between clusters that one task finishes, by the same method, once so few are left (16 bytes each).
TAIL_EDGES = 50_000
#: A vertex of more edges than this, and than an even share of a partition, sends its time by broadcast.
HOT_EDGES = 50_000


def _start(v: Column, level: int, beta: float, reach: int) -> Column:
    """Start time of a vertex: minus an exponential variable below ``reach``, drawn from the vertex and the level, so that it's the same at
    each look."""
    u = (F.shiftrightunsigned(F.xxhash64(v, F.lit(level)), 11).cast("double") + 0.5) / float(2**53)
    return F.log(1 - u * (1 - math.exp(-beta * reach))) / beta


def _hot(steps: DataFrame, hot_edges: int) -> list[int]:
    """Vertices with more than a partition's even share of the edges; as many as twice the partitions, at most."""
    n = int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limit = max(hot_edges, steps.count() // n)
    return [r["a"] for r in steps.groupBy("a").count().filter(F.col("count") > limit).select("a").collect()]


def _grow(edges: DataFrame, level: int, beta: float, reach: int, hot_edges: int) -> DataFrame:
    """(v, center) for every vertex of ``edges`` (a, b): the vertex whose shifted time reaches v first.

    A hop is one join and one sum with map-side combination: every vertex has an edge of length 0 to itself that keeps what it has, and a
    time goes along another edge only if it is new and earlier than the start of the vertex at its end. As all start within ``reach`` of
    each other, nothing changes after ``reach`` - 1 hops. The edges of a hot vertex stay where they are and get its time by broadcast."""
    ways = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.*")
    steps = store(ways.unionByName(ways.select("a", F.col("a").alias("b")).distinct()), f"steps{level}")
    label = steps.filter("a = b").select(F.col("a").alias("v"), _start(F.col("a"), level, beta, reach).alias("t"), F.col("a").alias("center"), F.lit(0.0).alias("had"))
    hot = _hot(steps, hot_edges)
    own = F.col("a") == F.col("b")
    useful = own | ((F.col("t") < F.col("had")) & (F.col("t") + 1 < _start(F.col("b"), level, beta, reach)))
    for hop in range(reach - 1):
        ways = [(steps.filter(~F.col("a").isin(hot)) if hot else steps, label.hint("shuffle_hash"))]
        if hot:
            ways.append((steps.filter(F.col("a").isin(hot)), F.broadcast(label.filter(F.col("v").isin(hot)))))
        sent = None
        for some, known in ways:
            x = some.join(known, some["a"] == known["v"]).filter(useful)
            x = x.select(F.col("b").alias("v"), (F.col("t") + F.when(own, 0.0).otherwise(1.0)).alias("t"), "center", F.when(own, F.col("t")).alias("had"))
            sent = x if sent is None else sent.unionByName(x)
        label = sent.groupBy("v").agg(F.min_by("center", "t").alias("center"), F.min("t").alias("t"), F.max("had").alias("had"))
        if hot or hop == reach - 2:
            before, label = label, store(label, f"clusters{level}")
            discard(before)
    discard(steps)
    return label


def _contracted(edges: DataFrame, cluster: DataFrame) -> DataFrame:
    """Edges between clusters, each once."""
    left, right = (cluster.select(F.col("v").alias(x), F.col("center").alias(f"c{x}")) for x in "ab")
    moved = edges.join(left, "a").join(right, "b").filter("ca <> cb")
    return moved.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()


def decompose(a: np.ndarray, b: np.ndarray, beta: float = BETA, reach: int = REACH) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, root of each) of a graph held in memory: growth from shifted starts, contraction, recursion."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(names))
    rng = np.random.default_rng(len(names))
    while len(x):
        live, at = np.unique(np.concatenate([x, y]), return_inverse=True)
        p, q = at[: len(x)], at[len(x) :]
        p, q = np.concatenate([p, q]), np.concatenate([q, p])
        t = np.log(1 - rng.random(len(live)) * (1 - math.exp(-beta * reach))) / beta
        center = np.arange(len(live))
        for _ in range(reach - 1):
            new = t.copy()
            np.minimum.at(new, q, t[p] + 1)
            better = (t[p] + 1 == new[q]) & (new[q] < t[q])
            center[q[better]] = center[p[better]]
            t = new
        move = np.arange(len(names))
        move[live] = live[center]
        root = move[root]
        x, y = move[x], move[y]
        keep = x != y
        x, y = np.unique(np.stack([np.minimum(x, y)[keep], np.maximum(x, y)[keep]]), axis=1) if keep.any() else (x[:0], y[:0])
    return names, names[root]


def _tail(edges: DataFrame, beta: float, reach: int) -> DataFrame:
    """(v, center) of the few edges left, from one task."""
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if held:
            v, root = decompose(*(np.concatenate(x) for x in zip(*held)), beta, reach)
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(root)], names=["v", "center"])

    return edges.select("a", "b").coalesce(1).mapInArrow(finish, "v bigint, center bigint")


def components(edges: DataFrame, a: str = "a", b: str = "b", beta: float = BETA, reach: int = REACH, tail_edges: int = TAIL_EDGES, hot_edges: int = HOT_EDGES) -> DataFrame:
    """(v, component) for every vertex of ``edges``, a table of pairs of whole numbers; component is the smallest vertex of the group.

    Rounds: clusters grow from exponentially shifted start times; each becomes one vertex; edges between clusters go on to the next round
    until none are left; the rounds' assignments are then composed. The shifts lie below ``reach``, so growth has ended after ``reach`` - 1
    hops and every cluster is connected: contracting it changes no group, and each edge between clusters is kept, so none is lost,
    whatever the shifts. Each round is written to the shared folder; once at most ``tail_edges`` edges are left, which is counted, one
    task ends the recursion by the same method. Repeated pairs, both directions and pairs of a vertex with itself are allowed; pairs with
    a null link nothing and name no vertex.
    """
    pairs = edges.select(F.col(f"`{a}`").cast("long").alias("a"), F.col(f"`{b}`").cast("long").alias("b")).dropna()
    stored = store(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    root, used = _roots(stored, beta, reach, tail_edges, hot_edges)
    rooted = store(root, "roots")
    discard(*used)
    least = rooted.groupBy("root").agg(F.min("v").alias("component"))
    return rooted.join(least, "root").select("v", "component")


def _roots(stored: DataFrame, beta: float, reach: int, tail_edges: int, hot_edges: int) -> tuple[DataFrame, list[DataFrame]]:
    """(v, root): the same root for all vertices of a group, some vertex of it, from stored edges (a <= b); and the stored tables it is made
    from, which can go once it is stored itself."""
    levels: list[DataFrame] = []
    rest = stored.filter("a <> b")
    left = rest.count()
    while left > tail_edges:
        levels.append(_grow(rest, len(levels), beta, reach, hot_edges))
        before, rest = rest, store(_contracted(rest, levels[-1]), "edges")
        discard(before)
        left = rest.count()
    if left:
        levels.append(_tail(rest, beta, reach))
    whole = None
    for cluster in reversed(levels):
        if whole is None:
            whole = cluster.select("v", F.col("center").alias("root"))
        else:
            above = whole.select(F.col("v").alias("center"), "root")
            whole = cluster.join(above, "center", "left").select("v", F.coalesce("root", "center").alias("root"))
    vertices = stored.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    if whole is None:
        return vertices.select("v", F.col("v").alias("root")), [stored]
    return vertices.join(whole, "v", "left").select("v", F.coalesce("root", "v").alias("root")), [stored, rest, *levels]


def _number(record: Column, clash: list[int], salt: int) -> Column:
    """A record's number: a hash of its key columns; where that clashes, a hash with the salt."""
    h = F.xxhash64(record)
    return F.when(h.isin(clash), F.xxhash64(F.lit(salt), record)).otherwise(h) if clash else h


def consolidate(matches: DataFrame, left: tuple[str, ...] = ("seq1", "id1"), right: tuple[str, ...] = ("seq2", "id2"), names: tuple[str, ...] = ("seq", "id"), prefix: str = "grp_", beta: float = BETA, reach: int = REACH, tail_edges: int = TAIL_EDGES, hot_edges: int = HOT_EDGES) -> DataFrame:
    """Every record of pairwise ``matches`` with the smallest record of its group, records being compared byte by byte, first column first.

    ``left`` and ``right`` name the key columns of the two records. A match with a null among them links nothing and names no record. Records
    matched only with themselves are groups of their own. Each record comes out once. Other columns are ignored.

    Records are numbered by a 64-bit hash of their keys, so the texts cross the network only twice, and links are pairs of numbers. That no
    two records share a number is checked over all of them; the few that do get another one, and the check is repeated.
    """
    good = matches.select(*[F.col(f"`{c}`").cast("string").alias(f"l{i}") for i, c in enumerate(left)], *[F.col(f"`{c}`").cast("string").alias(f"r{i}") for i, c in enumerate(right)]).dropna()
    k = range(len(names))
    side = lambda p: F.struct(*[F.col(f"{p}{i}").alias(f"k{i}") for i in k])
    clash: list[int] = []
    for salt in range(1, 100):
        both = good.select(F.explode(F.array(side("l"), side("r"))).alias("k"))
        records = store(both.select(_number(F.col("k"), clash, salt).alias("v"), "k").distinct(), "records")
        more = [r["v"] for r in records.groupBy("v").count().filter("count > 1").select("v").limit(10_001).collect()]
        if not more:
            break
        if len(more) > 10_000:
            raise RuntimeError("more clashing hashes than chance can make")
        clash = sorted({*clash, *more})
    else:
        raise RuntimeError("records could not be numbered")
    pairs = good.select(_number(side("l"), clash, salt).alias("a"), _number(side("r"), clash, salt).alias("b"))
    links = store(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    root, used = _roots(links, beta, reach, tail_edges, hot_edges)
    rooted = store(records.select("v", "k").join(root, "v").select("root", "k"), "rooted")
    discard(records, *used)
    least = rooted.groupBy("root").agg(F.min("k").alias("g"))
    out = rooted.join(least, "root")
    return out.select(*[F.col(f"k.k{i}").alias(n) for i, n in enumerate(names)], *[F.col(f"g.k{i}").alias(f"{prefix}{n}") for i, n in enumerate(names)])
