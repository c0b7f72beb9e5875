"""Texts into containers of fixed sizes: tiers by length, best fit in each tier, gaps of long containers filled from shorter tiers."""

from __future__ import annotations

import math
import sys
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import store

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the tokenizer cuts a text before merging (fixed value of this public vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Items that one task packs; more items make more tasks.
GROUP_ITEMS = 250_000
#: Fill under which a container's items are tried in the next longer tier.
LEAST_FILL = 0.97


def encoder(path: str):
    """The tokenizer in ``path`` (a file of ranks), loaded once for each Python process."""
    kept = sys.__dict__.setdefault("_seqspark_encoders", {})
    if path not in kept:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        kept[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return kept[path]


def token_counts(documents: DataFrame, doc: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc, tokens): length of each whole text in tokens; 0 for a null or empty text."""
    out = T.StructType([T.StructField(doc, documents.schema[doc].dataType), T.StructField("tokens", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode_ordinary
        for b in batches:
            n = [len(encode(t.as_py())) if t.is_valid else 0 for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=[doc, "tokens"])

    return documents.select(F.col(f"`{doc}`"), F.col(f"`{text}`")).mapInArrow(count, out)


class Stock:
    """Items by length; gives the longest that fits."""

    def __init__(self) -> None:
        self.lengths: list[int] = []
        self.items: dict[int, list] = {}

    def add(self, length: int, item: object) -> None:
        held = self.items.setdefault(length, [])
        if not held:
            insort(self.lengths, length)
        held.append(item)

    def take(self, room: int) -> tuple[int, object] | None:
        i = bisect_left(self.lengths, room + 1) - 1
        if i < 0:
            return None
        length = self.lengths[i]
        held = self.items[length]
        item = held.pop()
        if not held:
            del self.lengths[i]
        return length, item


def _fill(stocks: list[Stock], k: int, capacity: int) -> list[tuple[int, list]]:
    """Containers of tier ``k`` until its stock is empty: each is opened with the tier's longest item and then given the longest that fits,
    from its own tier or a shorter one, until none fits."""
    made = []
    while got := stocks[k].take(capacity):
        room, held = capacity, []
        while got:
            length, (item, piece, first) = got
            held.append((item, piece, first, length))
            room -= length
            got = None
            best = None
            for s in range(k, -1, -1):
                i = bisect_left(stocks[s].lengths, room + 1) - 1
                if i >= 0 and (best is None or stocks[s].lengths[i] > best[0]):
                    best = (stocks[s].lengths[i], s)
            if best:
                got = stocks[best[1]].take(room)
        made.append((k, held))
    return made


def pack(items: list[tuple[int, object]], capacities: list[int], least_fill: float = LEAST_FILL) -> list[tuple[int, list[tuple[object, int, int, int]]]]:
    """Containers as (index of the capacity, [(item, piece, first token, tokens)]), for capacities in rising order.

    An item goes to the tier of the smallest capacity that takes it whole; one that exceeds the largest is cut into full containers of
    that capacity and a rest, which is routed like an item. Tiers are packed from the longest down, best fit decreasing on the room left,
    the longer filling their gaps from the shorter. Then, from the shortest tier up, the items of containers that are filled by less than
    ``least_fill`` are packed anew in the next longer tier, and stay there if that takes less room.
    """
    top = capacities[-1]
    tiers = [Stock() for _ in capacities]
    made: list[tuple[int, list]] = []
    for length, item in items:
        first = piece = 0
        while length - first > top:
            made.append((len(capacities) - 1, [(item, piece, first, top)]))
            first += top
            piece += 1
        tiers[bisect_left(capacities, length - first)].add(length - first, (item, piece, first))
    for k in range(len(capacities) - 1, -1, -1):
        made += _fill(tiers, k, capacities[k])
    for k in range(len(capacities) - 1):
        poor = [h for kk, h in made if kk == k and sum(x[3] for x in h) < least_fill * capacities[k]]
        lifted = Stock()
        for item, piece, first, length in (x for h in poor for x in h):
            lifted.add(length, (item, piece, first))
        again = _fill([lifted], 0, capacities[k + 1])
        if len(again) * capacities[k + 1] < len(poor) * capacities[k]:
            made = [m for m in made if m[0] != k or sum(x[3] for x in m[1]) >= least_fill * capacities[k]] + [(k + 1, h) for _, h in again]
    return made


def step_groups(loads: list[int], size: int) -> list[int]:
    """A group for each container, so that groups hold ``size`` containers and about as many tokens each: dealt out by load, back and forth."""
    n = max(1, math.ceil(len(loads) / size))
    group = [0] * len(loads)
    for rank, i in enumerate(sorted(range(len(loads)), key=lambda i: -loads[i])):
        lap, at = divmod(rank, n)
        group[i] = at if lap % 2 == 0 else n - 1 - at
    return group


def pack_documents(documents: DataFrame, sizes: DataFrame, doc: str = "doc_id", text: str = "text", kind: str = "pack_kind", capacity: str = "capacity_tokens", tokenizer: str = TOKENIZER, step_size: int = 64, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(kind, capacity, container, step_group, doc, piece, first_token, tokens): where each text, or piece of one that exceeds the largest
    capacity, is placed.

    Hierarchical: a text belongs to the tier of the smallest capacity that takes it whole; tiers are packed from the longest down, each
    filling its gaps from the shorter ones, so that every text is placed once; what a tier holds badly is lifted into the next. Tokens are counted once and written; groups of about
    ``group_items`` texts, dealt out evenly whatever their ids, are packed side by side, a loss of at most one part-filled container of
    each kind per group. ``container`` is unique over kinds; containers of one kind and group are dealt into step groups of ``step_size``
    with balanced token numbers.

    Null or empty texts have no tokens and are placed nowhere. Texts with a null id are placed. Repeated texts are placed as often as they
    occur. ``sizes`` (a few rows) without a positive capacity raise ValueError; of two kinds with one capacity the first by name is used.
    """
    kinds: dict[int, str] = {}
    for r in sorted(sizes.select(F.col(f"`{kind}`").alias("k"), F.col(f"`{capacity}`").alias("c")).dropna().collect(), key=lambda r: (r["c"], r["k"])):
        if r["c"] > 0:
            kinds.setdefault(r["c"], r["k"])
    if not kinds:
        raise ValueError("no positive capacity")
    caps = list(kinds)
    counts = store(token_counts(documents, doc, text, tokenizer), "tokens")
    groups = max(1, math.ceil(counts.count() / group_items))
    out = T.StructType([T.StructField(kind, T.StringType()), T.StructField(capacity, T.IntegerType()), T.StructField("container", T.LongType()), T.StructField("step_group", T.LongType()), T.StructField(doc, documents.schema[doc].dataType), T.StructField("piece", T.IntegerType()), T.StructField("first_token", T.LongType()), T.StructField("tokens", T.LongType())])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, base = to_arrow_schema(out), TaskContext.get().partitionId() << 40
        items = [(n, d) for b in batches for d, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if n]
        made = pack(items, caps)
        step = [0] * len(made)
        for k in range(len(caps)):
            at = [i for i, (kk, _) in enumerate(made) if kk == k]
            for i, g in zip(at, step_groups([sum(x[3] for x in made[i][1]) for i in at], step_size)):
                step[i] = base + (k << 32) + g
        rows: list[tuple] = []
        for i, (k, held) in enumerate(made):
            rows += [(kinds[caps[k]], caps[k], base + i, step[i], d, piece, first, n) for d, piece, first, n in held]
            if len(rows) > 50_000 or i == len(made) - 1:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows = []

    return counts.repartition(groups).mapInArrow(fill, out)


def pack_counts(packed: DataFrame, kind: str = "pack_kind", capacity: str = "capacity_tokens", doc: str = "doc_id") -> DataFrame:
    """(kind, capacity, containers, messages, pieces, tokens, fill): what :func:`pack_documents` placed in containers of each kind."""
    each = packed.groupBy(kind, capacity, "container").agg(F.sum(F.when(F.col("piece") == 0, 1).otherwise(0)).alias("m"), F.count(F.lit(1)).alias("p"), F.sum("tokens").alias("t"))
    return each.groupBy(kind, capacity).agg(F.count(F.lit(1)).alias("containers"), F.sum("m").alias("messages"), F.sum("p").alias("pieces"), F.sum("t").alias("tokens"), (F.sum("t") / (F.count(F.lit(1)) * F.col(capacity))).alias("fill"))
