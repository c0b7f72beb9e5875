"""Queries over all rows and columns of their tables, against brute force on the smallest scale."""

import csv
from collections import defaultdict
from decimal import Decimal
from statistics import mean, median

import duckdb
import pytest

from seqspark.queries.groups import QUERIES as GROUPS
from seqspark.queries.models import QUERIES as MODELS
from seqspark.queries.problems import QUERIES as PROBLEMS
from seqspark.queries.sequences import QUERIES as SEQUENCES

FOLDER = "/root/testdata/sf0.001"


def read(sql: str) -> list[tuple]:
    return duckdb.sql(sql.replace("{", f"'{FOLDER}/").replace("}", ".parquet'")).fetchall()


def test_groups_hang_on_matches_of_either_direction(spark):
    pairs = [((a, b), (x, y)) for a, b, x, y in read("SELECT DISTINCT seq1, id1, seq2, id2 FROM {rbm}") if None not in (a, b, x, y)]
    up = {v: v for p in pairs for v in p}

    def top(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    assert any(a > b for a, b in pairs) and any(a[0] == b[0] and a != b for a, b in pairs)
    got = GROUPS["og_components"](spark, FOLDER).collect()
    assert sorted((r["og"], r["genome"], r["gene"]) for r in got) == sorted((">".join(top(v)), *v) for v in up)


def test_models_count_every_hit(spark):
    hits = read("SELECT DISTINCT l_suppkey % 10, l_partkey % 60, l_orderkey, l_partkey FROM {lineitem}")
    genomes, models = defaultdict(list), dict.fromkeys(range(50), 0)
    for genome, model, *_ in hits:
        if model < 50:
            genomes[genome].append(model)
            models[model] += 1
    want = {}
    for genome, found in genomes.items():
        complete, more = 2.0 * len(set(found)), 2.0 * (len(found) - len(set(found)))
        want[genome] = pytest.approx((complete, more, complete - 5 * more))
    got = MODELS["essential_quality"](spark, FOLDER).collect()
    assert {r["genome"]: (r["completeness"], r["contamination"], r["quality"]) for r in got} == want
    got = MODELS["essential_copies"](spark, FOLDER).first()
    assert tuple(got) == pytest.approx((mean(models.values()), median(models.values()), sum(n > 0 for n in models.values())))


def test_alignments_are_whole(spark):
    base = str.maketrans("0123456789abcdef", "ACGTACGTACGTACGN")
    seqs = {f"p{k}": "AAC" + s.translate(base) for k, s in read("SELECT p_partkey, md5(CAST(p_partkey AS varchar)) || md5(CAST(p_size AS varchar)) FROM {part}")}
    keep = [i for i in range(67) if len({s[i] for s in seqs.values()}) > 1]
    got = SEQUENCES["seq_variable_columns"](spark, FOLDER).collect()
    assert len(seqs) == 200 and len(keep) == 64
    assert {r["id"]: r["seq"] for r in got} == {k: "".join(s[i] for i in keep) for k, s in seqs.items()}
    got = SEQUENCES["seq_partitions"](spark, FOLDER).collect()
    assert sorted(map(tuple, got)) == [(i, 64 * i + 1, 64 * i + 64) for i in range(4)]


def typed(line: str) -> tuple:
    cells = [c.strip() for c in next(csv.reader([line.removesuffix("\r")], delimiter="\t", strict=True))]
    return Decimal(cells[0]), cells[1], float(cells[2]), *map(int, cells[3:10]), float(cells[10]), float(cells[11])


def test_good_lines_load_with_twelve_columns(spark, tmp_path):
    got = PROBLEMS["p1_loaded_all"](spark, FOLDER)
    assert got.columns == ["line_id", *[f"c{i}" for i in range(12)]]
    lines = dict(read("SELECT line_id, line FROM {hiv_mix_lines}"))
    bad = {r["line_id"] for r in PROBLEMS["p1_found"](spark, FOLDER).collect()}
    good = {k: s for k, s in lines.items() if k not in bad and s is not None and s.strip() and not s.startswith("#")}
    assert bad and {r["line_id"]: tuple(r)[1:] for r in got.collect()} == {k: typed(s) for k, s in good.items()}

    wide = f"{2**63}\ts\t99.5\t100\t1\t2\t3\t102\t5\t104\t1e-9\t200"
    spark.createDataFrame([(1, wide)], "line_id bigint, line string").write.parquet(f"{tmp_path}/hiv_mix_lines.parquet")
    assert [tuple(r) for r in PROBLEMS["p1_loaded_all"](spark, str(tmp_path)).collect()] == [(1, *typed(wide))]
