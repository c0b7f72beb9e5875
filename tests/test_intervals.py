import random

import pytest

from seqspark.operators.intervals import label_islands, merge_intervals


def brute(rows):
    out, genes = [], {}
    for g, s, e in rows:
        if None not in (g, s, e):
            genes.setdefault(g, set()).update(range(min(s, e), max(s, e) + 1))
    for g, cells in genes.items():
        stretches, prev = [], None
        for p in sorted(cells):
            if prev is not None and p == prev + 1:
                stretches[-1][1] = p
            else:
                stretches.append([p, p])
            prev = p
        out += [(g, "covered", a, b) for a, b in stretches]
        out += [(g, "gap", x[1] + 1, y[0] - 1) for x, y in zip(stretches, stretches[1:])]
    return sorted(out)


@pytest.mark.parametrize("partitions", [1, 3, 7, 40])
def test_against_brute_force(spark, partitions):
    rng = random.Random(partitions)
    rows = []
    for _ in range(600):
        g = "hot" if rng.random() < 0.4 else rng.choice("abcde")
        s = rng.randrange(2000)
        rows.append((g, s, s + rng.randrange(-3, 15) if rng.random() < 0.9 else s))
    rows += [("hot", 1, 1500)] * 3 + [(None, 1, 2), ("a", None, 3), ("a", 3, None), ("z", 5, 5), ("y", 2**40, 2**40 + 3), ("y", -4, -2)]
    rows = [r for r in rows if not (r[1] == 2**40)] + [("y", 10**6, 10**6 + 3)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "sseqid string, s_start bigint, s_end bigint, entity string, lo int")
    got = sorted(map(tuple, merge_intervals(df, "sseqid", "s_start", "s_end", partitions).collect()))
    assert got == brute(rows)


def test_one_start_that_holds_most_rows(spark):
    rows = [("hot", 5, 9)] * 5000 + [("hot", 5, i % 40 + 5) for i in range(500)] + [("hot", 50, 60)]
    df = spark.createDataFrame(rows, "g string, s int, e int")
    assert sorted(map(tuple, merge_intervals(df, "g", "s", "e").collect())) == [("hot", "covered", 5, 44), ("hot", "covered", 50, 60), ("hot", "gap", 45, 49)]


def test_labels_and_far_positions(spark):
    rows = [("a", 1, 5), ("a", 6, 7), ("a", 9, 9), ("b", -(2**61), -(2**61) + 1), ("b", 2**61, 2**61)]
    df = spark.createDataFrame(rows, "g string, s bigint, e bigint")
    got = {(r["entity"], r["lo"]): r["island"] for r in label_islands(df, "g", "s", "e").collect()}
    assert got == {("a", 1): 1, ("a", 6): 1, ("a", 9): 9, ("b", -(2**61)): -(2**61), ("b", 2**61): 2**61}


def test_empty(spark):
    assert merge_intervals(spark.createDataFrame([], "g string, s int, e int"), "g", "s", "e").count() == 0
