"""Test items inside a corpus: pigeonhole pieces are looked up exactly, hits are verified with Myers' bit-parallel distance."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import sent, store
from .mail import texts

_WORD = re.compile(r"[^\W_]+")
#: Text of the test items that one block of the search holds, in bytes; more items make more blocks.
BLOCK_BYTES = 32_000_000
#: Candidates that are verified at once.
AT_ONCE = 100_000


class Pieces:
    """Windows of ``window`` words of every item, each cut into ``errors`` + 1 pieces; where every piece stands in the items."""

    def __init__(self, items: list[tuple[object, str]], window: int, errors: int):
        self.window, self.errors = window, errors
        self.size = window // (errors + 1)
        if window > 63 or self.size < 1:
            raise ValueError("a window takes at most 63 words and at least one for each piece")
        self.ids: dict[str, int] = {}
        self.keys = [k for k, _ in items]
        words = [np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in _WORD.findall((t or "").lower())], np.int32) for _, t in items]
        self.first = np.cumsum([0, *map(len, words)])
        self.words = np.concatenate([*words, np.zeros(1, np.int32)])
        self.item = np.repeat(np.arange(len(items), dtype=np.int32), np.array([len(w) for w in words], np.int64))
        self.place = np.arange(len(self.item), dtype=np.int64)
        self.end = self.first[1:][self.item] if len(items) else self.place
        at = self.place[self.place + self.size <= self.end]
        h = self.hashes(self.words)[at] if len(at) else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.posting = at[order]
        self.key, self.begin = np.unique(h[order], return_index=True)
        self.stop = np.r_[self.begin[1:], len(order)]

    def hashes(self, words: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the ``size`` words from each place on; two pieces of one hash that differ are told apart by the verification."""
        n = max(0, len(words) - self.size + 1)
        h = np.zeros(n, np.uint64)
        for j in range(self.size):
            h = (h ^ words[j : j + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def encode(self, text: str) -> list[int]:
        get = self.ids.get
        return [get(w, 0) for w in _WORD.findall(text.lower())]


def myers(pattern: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Least edit distance of each row of ``pattern`` (words) to any stretch of the same row of ``text``, by bit-parallel columns."""
    n, m = pattern.shape
    one, high = np.uint64(1), np.uint64(m - 1)
    weights = (one << np.arange(m, dtype=np.uint64))[None, :]
    pv, mv = np.full(n, (1 << m) - 1, np.uint64), np.zeros(n, np.uint64)
    score = np.full(n, m, np.int64)
    best = score.copy()
    for t in range(text.shape[1]):
        c = text[:, t]
        eq = np.where((pattern == c[:, None]) & (c[:, None] != 0), weights, np.uint64(0)).sum(axis=1, dtype=np.uint64)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        score += ((ph >> high) & one).astype(np.int64) - ((mh >> high) & one).astype(np.int64)
        np.minimum(best, score, out=best)
        ph, mh = ph << one, mh << one
        pv, mv = mh | ~(xv | ph), ph & xv
    return best


def alike(pattern: np.ndarray, text: np.ndarray, errors: int) -> np.ndarray:
    """Rows that can be within the error budget: all but ``errors`` words of the pattern stand at most ``errors`` places off in the text."""
    m, held = pattern.shape[1], np.zeros(pattern.shape, bool)
    for shift in range(2 * errors + 1):
        held |= pattern == text[:, shift : shift + m]
    return held.sum(axis=1) >= m - errors


def search(stream: np.ndarray, p: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where a window of an item stands in ``stream`` (word numbers, 0 for words of no item and between texts) within the error budget:
    place of the window's begin in the stream (give or take the errors), index of the item, distance."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(stream) < p.size or not len(p.key):
        return none
    h = p.hashes(stream)
    known = stream != 0
    whole = np.ones(len(h), bool)
    for j in range(p.size):
        whole &= known[j : j + len(h)]
    at = np.flatnonzero(whole)
    k = np.searchsorted(p.key, h[at])
    k[k == len(p.key)] = 0
    hit = p.key[k] == h[at]
    at, k = at[hit], k[hit]
    if not len(at):
        return none
    padded = np.concatenate([np.zeros(p.window + p.errors, np.int32), stream, np.zeros(p.window + 2 * p.errors, np.int32)])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    many = p.stop[k] - p.begin[k]
    cut = np.flatnonzero(np.diff((np.cumsum(many) - 1) // AT_ONCE)) + 1
    for a, b in zip([0, *cut], [*cut, len(at)]):
        if a == b:
            continue
        reps = many[a:b]
        post = p.posting[np.repeat(p.begin[k[a:b]], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)]
        pos = np.repeat(at[a:b], reps)
        keys = []
        for j in range(p.errors + 1):
            w, s = post - j * p.size, pos - j * p.size + p.window
            ok = (w >= 0) & (s >= 0)
            ok[ok] = (p.item[w[ok]] == p.item[post[ok]]) & (w[ok] + p.window <= p.end[w[ok]])
            keys.append(w[ok] * len(padded) + s[ok])
        w, s = np.divmod(np.unique(np.concatenate(keys)), len(padded))
        for c in range(0, len(w), AT_ONCE):
            wc, sc = w[c : c + AT_ONCE], s[c : c + AT_ONCE]
            pattern = p.words[wc[:, None] + np.arange(p.window)]
            text = padded[sc[:, None] + np.arange(p.window + 2 * p.errors)]
            near = alike(pattern, text, p.errors)
            wc, sc = wc[near], sc[near]
            d = myers(pattern[near], text[near])
            near = d <= p.errors
            found.append((sc[near] - p.window, p.item[wc[near]].astype(np.int64), d[near]))
    if not found:
        return none
    return tuple(np.concatenate(x) for x in zip(*found))


def _taker(read: Callable[[str | None], list[str]], key: T.StructField) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                held = [read(t.as_py()) for t in b.column(1).slice(at, 1000)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 1000), pa.array(held, pa.list_(pa.string()))], names=[key.name, "texts"])

    return take


def leaks(documents: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "passage", window: int = 12, errors: int = 1, read: Callable[[str | None], list[str]] = texts) -> DataFrame:
    """(doc, item, distance, windows): each document with every item of which a stretch of ``window`` words stands in one of its texts
    with at most ``errors`` words changed, put in or left out; the least distance, and how many places match within the budget.

    ``read`` gives the texts of a document; words don't run on from one text to the next. A word is a longest run of letters and digits in
    lower case. By the pigeonhole principle a window with at most ``errors`` errors holds one of its ``errors`` + 1 pieces unchanged, so
    looking up every piece at every place misses none; each hit is verified with Myers' bit-parallel distance over words.

    Every document is searched as a whole, whatever its length. Items of fewer words than a window match nothing, as do null or empty
    texts and passages. Rows with a null id take part, with that id. Repeated documents or items give a row each. The items, a stated query
    set, are searched in blocks of bounded size; messages are taken apart once, their texts scanned once for each block and never shuffled.
    """
    blocks = [items.select(F.col(f"`{item}`").alias("k"), F.col(f"`{passage}`").alias("t"))]
    size = items.agg(F.sum(F.octet_length(F.col(f"`{passage}`")) + 64)).first()[0] or 0
    if size > BLOCK_BYTES:
        n = int(size // BLOCK_BYTES * 2 + 2)
        blocks = [blocks[0].filter(F.pmod(F.xxhash64("k", "t"), F.lit(n)) == i) for i in range(n)]
    out = T.StructType([T.StructField(doc, documents.schema[doc].dataType), T.StructField(item, items.schema[item].dataType), T.StructField("distance", T.IntegerType()), T.StructField("windows", T.IntegerType())])
    corpus = documents.select(F.col(f"`{doc}`"), F.col(f"`{text}`"))
    parts_of = read
    if len(blocks) > 1:  # each message is taken apart once; blocks read its texts
        corpus, parts_of = store(corpus.mapInArrow(_taker(read, out[0]), T.StructType([out[0], T.StructField("texts", T.ArrayType(T.StringType()))])), "texts"), list
    result = None
    for block in blocks:
        index = sent(documents.sparkSession, Pieces([(r["k"], r["t"]) for r in block.collect()], window, errors))

        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            p, schema = index(), to_arrow_schema(out)
            gap = [0] * (p.errors + 1)
            for b in batches:
                ids = b.column(0)
                step = 0
                column = b.column(1)
                while step < len(ids):
                    stream: list[int] = [0]
                    ends: list[int] = []
                    start = step
                    while step < len(ids) and len(stream) < 400_000:
                        for t in parts_of(column[step].as_py()):
                            stream += p.encode(t)
                            stream += gap
                        ends.append(len(stream))
                        step += 1
                    s, it, d = search(np.array(stream, np.int32), p)
                    if not len(s):
                        continue
                    row = np.searchsorted(np.array(ends), np.clip(s, 0, len(stream) - 1), side="right")
                    pair, inverse, count = np.unique(row * len(p.keys) + it, return_inverse=True, return_counts=True)
                    least = np.full(len(pair), p.window, np.int64)
                    np.minimum.at(least, inverse, d)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(start + pair // len(p.keys))), pa.array([p.keys[i] for i in pair % len(p.keys)], schema[1].type), pa.array(least, pa.int32()), pa.array(count, pa.int32())], schema=schema)

        one = corpus.mapInArrow(scan, out)
        result = one if result is None else result.unionByName(one)
    return result
