"""Overlapping and gapped intervals: merge them into continuous stretches and list the gaps, however large an entity is."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import fixed, input_bytes

#: Stored input for each range partition, on average.
PARTITION_BYTES = 64_000_000

State = tuple[object, int, int]  # entity, start of its current island, largest end so far


class Sweep:
    """Goes through rows ordered by entity and start, batch by batch, with the state carried over."""

    def __init__(self, state: State | None):
        self.state, self.own = state, False  # own: the island in state was seen here, so it's closed here

    def batch(self, ent: pa.Array, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list, list]:
        """New-island flags, running maximum end, new-entity flags; the islands this batch closed and the gaps it found, as (entity, start, end)."""
        n = len(lo)
        fresh = np.empty(n, bool)
        fresh[0] = self.state is None or self.state[0] != ent[0].as_py()
        fresh[1:] = pc.not_equal(ent.slice(1), ent.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        seg = np.cumsum(fresh)
        top = hi.copy()
        if not fresh[0]:
            top[0] = max(top[0], self.state[2])
        low, span = int(top.min()), int(top.max()) - int(top.min()) + 1
        if span * (int(seg[-1]) + 1) < 2**62:
            run = np.maximum.accumulate(top - low + seg * span) - seg * span + low
        else:
            run = np.concatenate([np.maximum.accumulate(x) for x in np.split(top, np.flatnonzero(fresh)) if len(x)])
        before = np.empty(n, np.int64)
        before[0] = lo[0] if fresh[0] else self.state[2]
        before[1:] = run[:-1]
        new = fresh | (lo - 1 > before)
        at = np.flatnonzero(new)
        starts = lo[at]
        closed: list = []
        if len(at):
            owners, begins, ends = [], [], []
            if at[0] > 0 or self.own:
                first = at[0]
                owners.append(ent[first - 1].as_py() if first else self.state[0])
                begins.append(int(self.state[1]))
                ends.append(int(run[first - 1]) if first else int(self.state[2]))
            owners += ent.take(pa.array(at[:-1])).to_pylist()
            begins += starts[:-1].tolist()
            ends += run[at[1:] - 1].tolist()
            closed = [owners, begins, ends]
        hole = np.flatnonzero(new & ~fresh)
        gaps = [ent.take(pa.array(hole)).to_pylist(), (before[hole] + 1).tolist(), (lo[hole] - 1).tolist()]
        self.state, self.own = (ent[n - 1].as_py(), int(starts[-1]) if len(at) else self.state[1], int(run[-1])), True
        return new, run, fresh, closed, gaps


def _arrays(b: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    return b.column(0), b.column(1).to_numpy(zero_copy_only=False).astype(np.int64), b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)


def _part() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _summaries(ordered: DataFrame) -> list:
    """One row for each partition that has rows; their number is the number of partitions, whatever the data."""
    kind = ordered.schema[0].dataType
    out = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("first_entity", kind), T.StructField("first_lo", T.LongType()), T.StructField("last_entity", kind), T.StructField("last_start", T.LongType()), T.StructField("last_max", T.LongType())])

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, first = Sweep(None), None
        for b in batches:
            if b.num_rows:
                ent, lo, hi = _arrays(b)
                first = first or (ent[0].as_py(), int(lo[0]))
                sweep.batch(ent, lo, hi)
        if first:
            e, s, m = sweep.state
            yield pa.RecordBatch.from_pylist([{"part": _part(), "first_entity": first[0], "first_lo": first[1], "last_entity": e, "last_start": s, "last_max": m}], schema=_arrow(out))

    return sorted(ordered.mapInArrow(summarise, out).collect(), key=lambda r: r["part"])


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def prefix_combine(rows: list) -> dict[int, tuple[State | None, bool]]:
    """For every partition the state carried into it, and whether its last island goes on in the next one."""
    out: dict[int, tuple[State | None, bool]] = {}
    state: State | None = None
    for k, r in enumerate(rows):
        carried = state
        if state and r["first_entity"] == r["last_entity"] == state[0]:
            goes_on = r["last_start"] - 1 <= state[2]
            state = (state[0], state[1], max(state[2], r["last_max"])) if goes_on else (state[0], r["last_start"], r["last_max"])
        elif state and r["last_entity"] == state[0]:
            raise AssertionError("rows are not ordered by entity")
        else:
            state = (r["last_entity"], r["last_start"], r["last_max"])
        after = rows[k + 1] if k + 1 < len(rows) else None
        out[r["part"]] = (carried, bool(after and after["first_entity"] == state[0] and after["first_lo"] - 1 <= state[2]))
    return out


def range_ordered(df: DataFrame, entity: str, start: str, end: str, partitions: int | None = None) -> DataFrame:
    """(entity, lo, hi) without nulls, one row for each entity and lo with its largest hi, range-partitioned and sorted by entity and lo.

    There are as many partitions as the session's setting or, if that is more, as the stored size of the input asks for. The pre-aggregation keeps one start position that holds a large share of all rows from becoming one large partition; the range
    partitioning splits a large entity over many partitions.
    """
    s, e = F.col(f"`{start}`").cast("long"), F.col(f"`{end}`").cast("long")
    both = df.filter(F.col(f"`{entity}`").isNotNull() & s.isNotNull() & e.isNotNull())
    rows = both.select(F.col(f"`{entity}`").alias("entity"), F.least(s, e).alias("lo"), F.greatest(s, e).alias("hi"))
    n = partitions or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(df) // PARTITION_BYTES))
    return rows.groupBy("entity", "lo").agg(F.max("hi").alias("hi")).repartitionByRange(n, "entity", "lo").sortWithinPartitions("entity", "lo")


def merge_intervals(df: DataFrame, entity: str, start: str, end: str, partitions: int | None = None) -> DataFrame:
    """Stretches of every entity: (entity, stretch, start_pos, end_pos) with stretch ``covered`` or ``gap``.

    Positions are whole numbers and both ends belong to an interval, so intervals that touch ([1,5] and [6,9]) make one stretch. An
    interval whose start is larger than its end (the other strand) counts the same. ``gap`` lies between two covered stretches of one
    entity. Rows with a null entity, start or end do not count; repeated rows change nothing; no rows give no stretches; other columns are
    ignored.

    Method: global range sort by entity and start, each partition's maximum-end summary, a prefix combination of these summaries (as
    many as there are partitions) and a second scan of every partition with the carried state.
    """
    ordered = fixed(range_ordered(df, entity, start, end, partitions))
    carry = prefix_combine(_summaries(ordered))
    out = T.StructType([T.StructField(entity, ordered.schema[0].dataType), T.StructField("stretch", T.StringType()), T.StructField("start_pos", T.LongType()), T.StructField("end_pos", T.LongType())])

    def rescan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, sweep, goes_on = _arrow(out), None, False
        for b in batches:
            if not b.num_rows:
                continue
            if sweep is None:
                state, goes_on = carry[_part()]
                sweep = Sweep(state)
            closed, gaps = sweep.batch(*_arrays(b))[3:]
            for kind, x in (("covered", closed), ("gap", gaps)):
                if x and x[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(x[0], schema[0].type), pa.array([kind] * len(x[0])), pa.array(x[1], pa.int64()), pa.array(x[2], pa.int64())], schema=schema)
        if sweep is not None and not goes_on:
            e, s, m = sweep.state
            yield pa.RecordBatch.from_pylist([{entity: e, "stretch": "covered", "start_pos": s, "end_pos": m}], schema=schema)

    return ordered.mapInArrow(rescan, out)


def label_islands(df: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """Every interval (entity, lo, hi: distinct starts with their largest end) with ``island``, the start position of its covered stretch."""
    ordered = fixed(range_ordered(df, entity, start, end))
    carry = prefix_combine(_summaries(ordered))
    out = T.StructType([*ordered.schema.fields, T.StructField("island", T.LongType())])

    def rescan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = None
        for b in batches:
            if not b.num_rows:
                continue
            sweep = sweep or Sweep(carry[_part()][0])
            ent, lo, hi = _arrays(b)
            begun = sweep.state[1] if sweep.state else 0
            new = sweep.batch(ent, lo, hi)[0]
            at = np.maximum.accumulate(np.where(new, np.arange(len(lo)), -1))
            yield pa.RecordBatch.from_arrays([ent, pa.array(lo), pa.array(hi), pa.array(np.where(at < 0, begun, lo[np.maximum(at, 0)]))], schema=_arrow(out))

    return ordered.mapInArrow(rescan, out)


def overlap_join(left: DataFrame, right: DataFrame, key: str, start: str = "start", end: str = "end", width: int = 1000) -> DataFrame:
    """Pairs of rows of one key whose closed intervals overlap; the right side's other columns come with ``_r`` appended.

    A range join made an equi-join: intervals are spread over bins of ``width``, and a pair counts in the bin of the later of both starts
    only, so it comes out once. A hot key is split by its bins. Rows with a null key, start or end, or an end before the start, match
    nothing; repeated rows match as often as they occur."""
    def binned(df: DataFrame) -> DataFrame:
        ok = F.col(key).isNotNull() & (F.col(end) >= F.col(start))
        return df.filter(ok).withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))

    r = binned(right).select(F.col(key), "__bin", *[F.col(f"`{c}`").alias(f"{c}_r") for c in right.columns if c != key])
    j = binned(left).join(r, [key, "__bin"])
    both = (F.col(start) <= F.col(f"{end}_r")) & (F.col(f"{start}_r") <= F.col(end))
    return j.filter(both & (F.floor(F.greatest(F.col(start), F.col(f"{start}_r")) / width) == F.col("__bin"))).drop("__bin")
