"""The N best items of every group: sorted runs in buckets, merged by a loser tree that seeks to the next group after N outputs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import store

#: Rows of one sorted run.
RUN_ROWS = 500_000
#: Input rows for each bucket, on average; buckets are merged one after another, so this bounds what a task holds, whatever the input.
BUCKET_ROWS = 500_000
#: Runs that are merged at once; more are merged in rounds.
FAN_IN = 512


class Run:
    """A cursor on one sorted run: groups in order, each with its items best first."""

    __slots__ = ("groups", "ends", "scores", "items", "g", "i", "end", "key")

    def __init__(self, groups: list, counts: list, scores: list, items: list):
        self.groups, self.scores, self.items = groups, scores, items
        self.ends = np.cumsum(counts).tolist()
        self.g, self.i = 0, 0
        self._load()

    def _load(self) -> None:
        if self.g >= len(self.groups):
            self.key = None
        else:
            self.end = self.ends[self.g]
            self.key = (self.groups[self.g], -self.scores[self.i], self.items[self.i])

    def step(self) -> None:
        self.i += 1
        if self.i < self.end:
            self.key = (self.groups[self.g], -self.scores[self.i], self.items[self.i])
        else:
            self.g += 1
            self._load()

    def seek(self) -> None:
        """To the first item of the next group."""
        self.i = self.end
        self.g += 1
        self._load()


class LoserTree:
    """Tournament of ``k`` runs: inner nodes hold the loser of their match, so the next winner takes one match per level."""

    def __init__(self, runs: list[Run]):
        self.runs, self.k = runs, len(runs)
        self.tree = [-1] * max(1, self.k)
        best = [-1] * (2 * self.k)
        for j in range(self.k):
            best[self.k + j] = j
        for node in range(self.k - 1, 0, -1):
            a, b = best[2 * node], best[2 * node + 1]
            best[node], self.tree[node] = (a, b) if self._beats(a, b) else (b, a)
        self.winner = best[1] if self.k > 1 else (0 if self.k else -1)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.runs[a].key, self.runs[b].key
        return x is not None and (y is None or x <= y)

    def replay(self) -> None:
        """After the winner's run moved on, play its matches up to the root again."""
        w, node = self.winner, (self.winner + self.k) >> 1
        while node:
            other = self.tree[node]
            if not self._beats(w, other):
                self.tree[node], w = w, other
            node >>= 1
        self.winner = w


def merge_runs(runs: list[Run], n: int) -> Iterator[tuple]:
    """(group, score, item, rank) of the first ``n`` distinct items of each group, in order."""
    tree = LoserTree(runs)
    group, taken = None, set()
    while tree.k:
        run = runs[tree.winner]
        if run.key is None:
            return
        g, _, item = run.key
        if g != group:
            group, taken = g, set()
        if len(taken) < n:
            if item not in taken:
                taken.add(item)
                yield g, run.scores[run.i], item, len(taken)
            run.step()
        else:
            run.seek()
        tree.replay()


def _bucket_of(groups: pd.Series, n: int) -> np.ndarray:
    return (pd.util.hash_array(groups.to_numpy()) % np.uint64(n)).astype(np.int32)


def top_n_per_group(df: DataFrame, group: str, score: str, item: str, n: int = 5, buckets: int | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """(group, item, rank): of every group the ``n`` items of the highest score, equal scores by item upwards; rank counts from 1.

    An item counts once in its group, with its best score. Rows with a null group or item, or a score that is null or not a number, do not
    count; infinite scores do. Groups with fewer items have all of them. No rows give no rows. Other columns are ignored.

    Each input task sorts its rows into runs and keeps at most ``n`` items of a group in a run (more can't be among the best), so a group
    that holds a third of all rows sends ``n`` rows per run. A run is cut into buckets by a hash of the group and stored. Buckets come
    sorted to the tasks, which merge one after another with a loser tree that, after ``n`` outputs, moves every run on to the next group:
    a task holds one bucket's runs at a time. There are as many buckets as the measured number of rows asks for. More than ``fan_in`` runs
    are merged in rounds, each of which leaves one run, of ``n`` items of a group again, for every ``fan_in``.
    """
    kinds = {c: df.schema[c].dataType for c in (group, item)}
    held = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("run", T.LongType()), T.StructField("groups", T.ArrayType(kinds[group])), T.StructField("counts", T.ArrayType(T.IntegerType())), T.StructField("scores", T.ArrayType(T.DoubleType())), T.StructField("items", T.ArrayType(kinds[item]))])
    out = T.StructType([T.StructField(group, kinds[group]), T.StructField(item, kinds[item]), T.StructField("rank", T.IntegerType())])
    n_buckets = buckets or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // BUCKET_ROWS))
    s = F.col(f"`{score}`").cast("double")
    rows = df.filter(F.col(f"`{group}`").isNotNull() & F.col(f"`{item}`").isNotNull() & s.isNotNull() & ~F.isnan(s)).select(F.col(f"`{group}`").alias("g"), s.alias("s"), F.col(f"`{item}`").alias("i"))

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, number = to_arrow_schema(held), TaskContext.get().partitionId() << 32

        def runs(part: list[pa.RecordBatch], run: int) -> Iterator[pa.RecordBatch]:
            pdf = pa.Table.from_batches(part).to_pandas()
            pdf = pdf.sort_values(["g", "s", "i"], ascending=[True, False, True], kind="stable").drop_duplicates(["g", "i"])
            pdf = pdf[pdf.groupby("g", sort=False).cumcount() < n]
            pdf["b"] = _bucket_of(pdf["g"], n_buckets)
            pdf = pdf.sort_values("b", kind="stable")
            found: list[dict] = []
            for b, one in pdf.groupby("b", sort=False):
                g = one["g"].to_numpy()
                at = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
                found.append({"bucket": b, "run": run, "groups": g[at].tolist(), "counts": np.diff(np.r_[at, len(g)]).tolist(), "scores": one["s"].tolist(), "items": one["i"].tolist()})
                if len(found) >= 64:
                    yield pa.RecordBatch.from_pylist(found, schema=schema)
                    found = []
            if found:
                yield pa.RecordBatch.from_pylist(found, schema=schema)

        part, size = [], 0
        for b in batches:
            part.append(b)
            size += b.num_rows
            if size >= RUN_ROWS:
                yield from runs(part, number)
                part, size, number = [], 0, number + 1
        if size:
            yield from runs(part, number)

    def merging(last: bool):
        """Merge the runs of one (bucket, turn) after another, as they come sorted."""
        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            schema = to_arrow_schema(out if last else held)

            def close(key: tuple, cursors: list[Run]) -> Iterator[pa.RecordBatch]:
                got = list(merge_runs(cursors, n))
                if last:
                    for at in range(0, len(got), 100_000):
                        cols = list(zip(*got[at : at + 100_000]))
                        yield pa.RecordBatch.from_arrays([pa.array(cols[i], schema[k].type) for k, i in enumerate((0, 2, 3))], schema=schema)
                else:
                    names = [g[0] for g in got if g[3] == 1]
                    ends = [i for i, g in enumerate(got) if g[3] == 1] + [len(got)]
                    yield pa.RecordBatch.from_pylist([{"bucket": key[0], "run": key[1], "groups": names, "counts": np.diff(ends).tolist(), "scores": [g[1] for g in got], "items": [g[2] for g in got]}], schema=schema)

            key, cursors = None, []
            for b in batches:
                for r in range(b.num_rows):
                    row = {c: b.column(c)[r] for c in ("bucket", "turn", "groups", "counts", "scores", "items")}
                    now = (row["bucket"].as_py(), row["turn"].as_py())
                    if now != key:
                        if cursors:
                            yield from close(key, cursors)
                        key, cursors = now, []
                    cursors.append(Run(*(row[c].as_py() for c in ("groups", "counts", "scores", "items"))))
            if cursors:
                yield from close(key, cursors)

        return merge

    runs = store(rows.mapInArrow(form, held), "runs")
    many = runs.select("run").distinct().count()
    while many > fan_in:
        turn = F.pmod(F.xxhash64("run"), F.lit(-(-many // fan_in)))
        runs = store(_by_bucket(runs.withColumn("turn", turn)).mapInArrow(merging(False), held), "runs")
        many = runs.select("run").distinct().count()
    return _by_bucket(runs.withColumn("turn", F.lit(0).cast("long"))).mapInArrow(merging(True), out)


def _by_bucket(runs: DataFrame) -> DataFrame:
    return runs.repartition("bucket", "turn").sortWithinPartitions("bucket", "turn", "run")
