import random

import pytest

from seqspark.llm.components import components, consolidate
from seqspark.llm.top_n import LoserTree, Run, merge_runs, top_n_per_group


def union_find(pairs):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("kind", ["random", "chain", "star", "loops"])
def test_components(spark, kind):
    rng = random.Random(3)
    pairs = {"random": [(rng.randrange(300), rng.randrange(300)) for _ in range(220)], "chain": [(i, i + 1) for i in range(150)], "star": [(0, i) for i in range(1, 400)] + [(500, 501)], "loops": [(1, 1), (2, 2), (3, 1), (1, 3), (3, 1)]}[kind]
    df = spark.createDataFrame([(a, b, "x") for a, b in pairs] + [(None, 1, "x"), (7777, None, "x")], "a bigint, b bigint, center string")
    for more in {"random": [{}], "chain": [{"tail_edges": 0}], "star": [{"tail_edges": 20, "hot_edges": 3}], "loops": [{}]}[kind]:
        got = components(df, **more).collect()
        assert {r["v"]: r["component"] for r in got} == union_find(pairs) and len(got) == len({x for p in pairs for x in p})


def test_clusters_stay_connected_and_settled(spark):
    """Growth ends by itself: every vertex has the center of the earliest time, and its cluster is connected."""
    from seqspark.llm.components import _grow

    rng = random.Random(8)
    pairs = [(i, i + 1) for i in range(120)] + [(rng.randrange(121), rng.randrange(121)) for _ in range(25)]
    pairs = [p for p in pairs if p[0] != p[1]]
    got = {r["v"]: r["center"] for r in _grow(spark.createDataFrame(pairs, "a bigint, b bigint"), 0, 0.3, 5, 50).collect()}
    inside = union_find([(a, b) for a, b in pairs if got[a] == got[b]] + [(v, v) for v in got])
    assert all(inside[v] == inside[c] for v, c in got.items()) and 3 < len(set(got.values())) < 100


def test_clashing_hashes_get_numbers_of_their_own(spark, monkeypatch):
    import seqspark.llm.components as C

    first = C._number
    df = spark.createDataFrame([("a", "1", "b", "1"), ("c", "1", "d", "1"), ("d", "1", "e", "1")], "seq1 string, id1 string, seq2 string, id2 string")
    monkeypatch.setattr(C, "_number", lambda record, clash, salt: first(record, [], salt) if clash else first(record, clash, salt) % 2)
    got = {r["seq"]: r["grp_seq"] for r in C.consolidate(df).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "c"}


def test_consolidate(spark):
    rows = [("G", "2", "B", "1"), ("B", "1", "G", "2"), ("b", "1", "G", "2"), ("é", "1", "z", "9"), ("s", "1", "s", "1"), (None, "1", "G", "2"), ("q", None, "G", "2"), ("G", "2", "B", "1"), ("", "", "s2", "1")]
    df = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "seq1 string, id1 string, seq2 string, id2 string, v double, grp_seq string")
    got = {(r["seq"], r["id"]): (r["grp_seq"], r["grp_id"]) for r in consolidate(df).collect()}
    want = {("G", "2"): ("B", "1"), ("B", "1"): ("B", "1"), ("b", "1"): ("B", "1"), ("é", "1"): ("z", "9"), ("z", "9"): ("z", "9"), ("s", "1"): ("s", "1"), ("", ""): ("", ""), ("s2", "1"): ("", "")}
    assert got == want
    assert consolidate(df.limit(0)).count() == 0


def test_loser_tree():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs, every = [], []
        for _ in range(k):
            items = sorted({(rng.choice("abcd"), -rng.randrange(5), rng.randrange(1000)) for _ in range(rng.randrange(12))})
            every += items
            groups = sorted({i[0] for i in items})
            runs.append(Run(groups, [sum(i[0] == g for i in items) for g in groups], [-i[1] for i in items], [i[2] for i in items]))
        want, seen = [], {}
        for g, _, item in sorted(every):
            taken = seen.setdefault(g, [])
            if item not in taken and len(taken) < 3:
                taken.append(item)
                want.append((g, item, len(taken)))
        assert [(g, i, k) for g, _, i, k in merge_runs(runs, 3)] == want
    assert LoserTree([]).winner == -1


def test_top_n(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.5 else f"g{rng.randrange(40)}", rng.choice([1.0, 2.0, 3.5, float("inf"), float("nan"), None]), rng.randrange(500)) for _ in range(3000)]
    rows += rows[:400] + [(None, 1.0, 1), ("g1", 1.0, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "qseqid string, bitscore double, hit_id bigint, rank string").repartition(9)
    best = {}
    for g, s, i in rows:
        if g is not None and i is not None and s is not None and s == s:
            best[g, i] = max(best.get((g, i), s), s)
    want = set()
    for g in {k[0] for k in best}:
        ranked = sorted((-s, i) for (gg, i), s in best.items() if gg == g)[:5]
        want |= {(g, i, k + 1) for k, (_, i) in enumerate(ranked)}
    got = list(map(tuple, top_n_per_group(df, "qseqid", "bitscore", "hit_id", 5).collect()))
    assert set(got) == want and len(got) == len(want)
    assert top_n_per_group(df.limit(0), "qseqid", "bitscore", "hit_id").count() == 0
    for more in ({"buckets": 1}, {"buckets": 40, "fan_in": 2}):
        assert set(map(tuple, top_n_per_group(df, "qseqid", "bitscore", "hit_id", 5, **more).collect())) == want


def test_top_n_streams_its_buckets(spark):
    """All buckets in one partition: a task holds one bucket at a time, far less than the partition."""
    from seqspark.llm import top_n as N

    df = spark.range(300_000).selectExpr("concat('g', id % 50000) g", "cast(id % 977 as double) s", "id")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = N.top_n_per_group(df, "g", "s", "id", 2, buckets=64)
        assert got.count() == 100_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
