"""Small cases with results worked out by hand or by brute force."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqspark.operators import coverage as C
from seqspark.operators import diversity as D
from seqspark.operators import hits as H
from seqspark.operators import orthology as O
from seqspark.operators import sequences as S
from seqspark.operators import statistics as Q
from seqspark.operators import trees as T
from seqspark.operators.rejects import WHOLE, Field, loaded, parse_rows
from seqspark.queries.sequences import QUERIES as SEQUENCES
from seqspark.sources import readers as R


def test_interleaving_goes_by_place_whatever_the_partitions(spark, tmp_path):
    for k in "12":
        (tmp_path / f"{k}.fa").write_text("".join(f">r{i}/{k}\nACGT\n" for i in range(2000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        one, two = (R.read_fasta(spark, str(tmp_path / f"{k}.fa")) for k in "12")
        assert one.rdd.getNumPartitions() > 3
        got = S.interpose([one, two]).orderBy("rid", "file").collect()
        with pytest.raises(Exception, match="out of step"):
            S.interpose([one, two.filter("id <> 'r5/2'")]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["id"] for r in got] == [f"r{i}/{k}" for i in range(2000) for k in "12"]


def test_fastq_records_cut_by_splits(spark, tmp_path):
    rows = [(f"r{i}", "ACGTN"[: i % 5 + 1] * 3, "@" + "I" * (3 * (i % 5 + 1) - 1)) for i in range(500)]
    (tmp_path / "a.fq").write_text("".join(f"@{i}\n{s}\n+\n{q}\n" for i, s, q in rows))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = R.read_fastq(spark, str(tmp_path / "a.fq")).orderBy("rid").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r["id"], r["seq"], r["qual"]) for r in got] == rows


def test_profiles_are_swapped_as_a_pair(spark):
    rows = [(p, g, "X", n) for p in "abc" for g, n in (("A", 10), ("B", 1))]
    df = spark.createDataFrame(rows, "protein string, group string, aa string, n int")
    values = {round(math.log10(a / b), 6) for a, b in ((30, 3), (21, 12), (12, 21), (3, 30))}
    got = [round(r["ratio"], 6) for r in D.substitution_resampling(df, 200).collect()]
    assert set(got) == values and len(got) == 200
    assert {round(r["ratio"], 6) for r in D.substitution_resampling(df, 50, mode="bootstrap").collect()} == {1.0}
    drawn = spark.createDataFrame([("a", "A", "X", 1), ("a", "B", "X", 1), ("b", "A", "X", 100), ("b", "B", "X", 1), (None, "A", "X", 5)], "protein string, group string, aa string, n int")
    kinds = {round(r["ratio"], 6) for r in D.substitution_resampling(drawn, 100, mode="bootstrap").collect()}
    assert kinds == {round(math.log10(x), 6) for x in (1.0, 101 / 2, 100.0)}


def test_core_peak_moves_on_from_peak_to_peak():
    log = math.log
    assert Q.core_peak([(log(10), 0.1, 5), (log(100), 0.1, 50)]) == 1
    # nearer than 1.75 times and as large: the larger takes its place
    assert Q.core_peak([(log(60), 0.1, 200), (log(100), 0.1, 50)]) == 0
    # too far for its size
    assert Q.core_peak([(log(20), 0.1, 60), (log(100), 0.1, 50)]) == 1
    # the second is compared with the size of the first, not of the deepest
    assert Q.core_peak([(log(60), 0.1, 200), (log(70), 0.1, 100), (log(100), 0.1, 50)]) == 0


def test_mixture_sees_every_window(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(1, 0.2, 700), rng.normal(3, 0.3, 300)])
    twice = np.concatenate([x, x])
    values, counts = np.unique(twice, return_counts=True)
    whole, counted = Q.mixture(np.sort(twice), 2), Q.mixture(values, 2, counts=counts.astype(float))
    for a, b in zip(whole, counted):
        assert np.allclose(a, b, atol=1e-6)
    df = spark.createDataFrame([(float(math.exp(v)),) for v in x] + [(0.0,)], "depth double")
    for criterion in ("aic", "bic"):
        peaks = Q.find_peaks(df, drop_top=0, criterion=criterion, most=3).collect()
        assert sum(p["n"] for p in peaks) == pytest.approx(1000, abs=1e-6) and [p["core"] for p in peaks].count(True) == 1
    two = Q.find_peaks(df, drop_top=0, criterion="bic", most=2).orderBy("mean").collect()
    assert [round(p["mean"], 1) for p in two] == [1.0, 3.0]
    hist = Q.peak_histogram(Q.find_peaks(df, drop_top=0, most=1), [1.0, 5.0, 20.0]).collect()
    assert sum(r["n"] for r in hist) == pytest.approx(1000)
    assert Q.find_peaks(df.filter("depth < 0")).count() == 0


def test_median_distance_in_blocks():
    rng = np.random.default_rng(1)
    for n in (2, 3, 50, 51):
        x = rng.random((n, 3))
        want = np.median([np.linalg.norm(a - b) for a, b in itertools.combinations(x, 2)])
        assert Q.median_distance(x) == pytest.approx(want) and Q.median_distance(x, 7) == pytest.approx(want)
    assert Q.median_distance(x[:1]) is None


def test_long_numbers_are_valid_and_kept(spark):
    digits = "1" + "0" * 319
    df = spark.createDataFrame([(1, f"{digits}\t5"), (2, "7\t5"), (3, "1e5\t5")], "line_id int, line string")
    parsed = parse_rows(df, fields=[Field("c0", "decimal(38,0)", WHOLE), Field("c1", "int")])
    assert {r["line_id"]: r["reason"] for r in parsed.collect()} == {1: None, 2: None, 3: "value"}
    assert {r["line_id"]: (r["c0"], r["wide"]) for r in loaded(parsed).collect()} == {1: (None, {"c0": digits}), 2: (7, None)}


def test_deep_taxonomy_and_circles(spark):
    chain = [(i, i - 1, "genus" if i == 1 else "x") for i in range(1, 200)] + [(0, 0, "root"), (500, 501, "x"), (501, 500, "x")]
    got = {r["tax_id"]: r["ancestor"] for r in H.rank_ancestors(spark.createDataFrame(chain, "tax_id long, parent_id long, rank string"), "genus").collect()}
    assert got == {i: 1 for i in range(1, 200)}


def test_both_ways_of_clustering_agree(spark):
    rng = random.Random(5)
    edges = [(f"{c}{i}", f"{c}{j}", float(rng.randrange(1, 9))) for c in "abc" for i, j in itertools.combinations(range(6), 2) if rng.random() < 0.6] + [("a0", "b0", 0.5)]
    df = spark.createDataFrame(edges, "a string, b string, weight double")
    one = {r["v"]: r["cluster"] for r in O.markov_clusters(df).collect()}
    assert one == {r["v"]: r["cluster"] for r in O.markov_clusters(df, dense=0).collect()} and len(set(one.values())) > 1


def test_exact_samples(spark):
    df = spark.range(3000).withColumnRenamed("id", "rid")
    for n in (0, 1, 700, 2999, 3000, 4000):
        got = [r["rid"] for r in S.sample_exact(df, n=n).collect()]
        assert len(got) == len(set(got)) == min(n, 3000)
    assert {r["rid"] for r in S.sample_exact(df, n=100).collect()} <= {r["rid"] for r in S.sample_exact(df, n=101).collect()}


def test_guard_against_nucleotides(spark):
    proteins = spark.createDataFrame([("p", "MKVLAAGW")], "id string, seq string")
    assert H.average_nucleotide_guard(proteins).count() == 1
    with pytest.raises(Exception, match="nucleotide"):
        H.average_nucleotide_guard(spark.createDataFrame([("n", "ACGTACGT")], "id string, seq string")).collect()


def test_breaks_of_features_in_file_order(spark):
    off = spark.createDataFrame([("s1", 0, 100), ("s2", 100, 50)], "id string, offset long, length long")
    f = spark.createDataFrame([(0, "s1", 5, 20, "a"), (1, "s1", 15, 30, "b"), (2, "s2", 10, 20, "c"), (3, "zz", 1, 2, "d"), (70_000, "s2", 30, None, "e")], "rid long, seqid string, start long, end long, name string")
    got = [tuple(r)[1:] for r in C.feature_breaks(f, off).orderBy("rid", "end").collect()]
    assert got == [(1, "NA", "NA"), (6, "NA~a", "GAP"), (21, "a", "FEAT"), (31, "b", "FEAT"), (111, "b~c", "GAP"), (121, "c", "FEAT"), (151, "c~NA", "GAP")]
    assert C.feature_breaks(f, off, gaps=False).count() == 4


def test_tree_of_a_key(spark):
    key = spark.createDataFrame([("1", "c", "x", "2", False), ("1", "c", "*", "it\'s", True), ("2", "d", "y", "B", True), ("2", "d", "z", "C", True)], "step string, character string, state string, next string, terminal boolean")
    assert T.key_newick(key) == "(('B','C')'2','it''s')'1';"


def test_pruning_above_the_exact_limit_draws_at_random():
    tree = T.parse_newick("(" + ",".join(f"(a{i}:0.1,b{i}:0.1):5" for i in range(20)) + ");")
    kept = [set(T.prune_close_tips(tree, 1.0, most_exact=30, seed=s)) for s in (1, 1, 2)]
    assert kept[0] == kept[1] and all(len({x[1:] for x in k}) == len(k) == 20 for k in kept[:1] + kept[2:])
    assert len(T.prune_close_tips(tree, 1.0)) == 20


def test_ids_cut_and_columns_of_several_files(spark):
    a = spark.createDataFrame([("f", "g1_x", "AC-T"), ("f", "g2_y", "AG-A"), ("h", "g1_z", "QQ"), ("h", "g3_w", None)], "file string, id string, seq string")
    got = {r["id"]: r["seq"] for r in S.concatenate_alignments(a, True, ignore_after="_").collect()}
    assert got == {"g1": "CT", "g2": "GA", "g3": "--"}


def joins(df):
    return re.findall(r"(\w+Join) \[(.+?)\], \[", df._jdf.queryExecution().executedPlan().toString())


def test_codons_of_all_genes_are_merged_not_broadcast(spark):
    # Spark takes these 3,000 codons for less than its limit of 10 MB, and would do so with millions
    genes = spark.range(1000).select(F.concat(F.lit("g"), "id").alias("gene"), F.lit("ATGCTTTAA").alias("seq"))
    snps = spark.range(1000).filter("id % 2 = 0").select(F.concat(F.lit("g"), "id").alias("gene"), (F.col("id") % 3 + 3).alias("pos"), F.lit("c").alias("alt"))
    df = D.kaks(genes, snps)
    assert [kind for kind, keys in joins(df) if re.fullmatch(r"gene#\d+, k#\d+", keys)] == ["SortMergeJoin"]
    got = df.collect()
    assert len(got) == 1000 and {r["gene"]: (r["n"], r["s"]) for r in got} == {f"g{i}": [(0, 0), (1, 0), (0, 1)][i % 3 * (i % 2 == 0)] for i in range(1000)}


def test_mates_of_all_genomes_are_merged_not_broadcast(spark):
    # Spark takes these 1,600 mates of 200 genomes for less than its limit of 10 MB, and would do so with millions
    df = SEQUENCES["seq_simulate_errors"](spark, "/root/testdata/sf0.001")
    assert [kind for kind, _ in joins(df)] == ["SortMergeJoin"]
    assert sorted(map(tuple, df.collect())) == sorted(itertools.permutations("ACGT", 2))
