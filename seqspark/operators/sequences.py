"""Operators on sequence records: FastA (rid, id, defline, seq) and FastQ (rid, id, defline, seq, plus, qual); ``rid`` is the file order.

A null sequence gives null (or drops out where a length is asked for); an empty one has length 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .coverage import cumulative_offsets
from .sampling import uniform

#: Larger than any character.
_NONE = 0x110000

#: Complements of the nucleotide codes (fixed values).
BASES, COMPLEMENTS = "ACGTURYSWKMBDHVNacgturyswkmbdhvn", "TGCAAYRSWMKVHDBNtgcaayrswmkvhdbn"


def letters(c: Column) -> Column:
    """The letters of a sequence."""
    return F.regexp_replace(c, "[^A-Za-z]", "")


def gc_content(c: Column, compat: bool = False) -> Column:
    """Share of G and C among A, C, G and T of either case; null without any. With ``compat`` only upper-case G and C count as such."""
    total = F.regexp_count(c, F.lit("[ACGTacgt]"))
    return F.when(total > 0, F.regexp_count(c, F.lit("[GC]" if compat else "[GCgc]")) / total)


def reverse_complement(c: Column) -> Column:
    return F.reverse(F.translate(c, BASES, COMPLEMENTS))


def lengths(records: DataFrame, seq: str = "seq") -> DataFrame:
    """Records with ``length``, their number of letters."""
    return records.withColumn("length", F.length(letters(F.col(seq))))


def gc(records: DataFrame, seq: str = "seq") -> DataFrame:
    """(id, gc); sequences without any base drop out."""
    return records.select("id", gc_content(F.col(seq)).alias("gc")).filter(F.col("gc").isNotNull())


def filter_length(records: DataFrame, least: int, seq: str = "seq") -> DataFrame:
    return records.filter(F.length(letters(F.col(seq))) >= least)


def filter_ambiguous(records: DataFrame, content: float = 0.5, stretch: int = 100, seq: str = "seq") -> DataFrame:
    """Records with at most ``content`` (a share under 1, else a number) of N and no run of one base of ``stretch`` or more; 0 turns a test off."""
    s = F.col(seq)
    keep = F.lit(True)
    if content:
        keep = keep & (F.regexp_count(s, F.lit("N")) <= (F.length(s) * content if content < 1 else content))
    if stretch:
        keep = keep & ~s.rlike("|".join(f"{b}{{{stretch}}}" for b in "ACTGN"))
    return records.filter(keep)


def n50(records: DataFrame, least: int = 0, x: float = 50, length: str = "length", compat: bool = False) -> DataFrame:
    """(nx, n, total, longest): the length at which lengths cumulated from the longest reach x % of the total; with ``compat`` from the shortest.

    Lengths are counted first, so that the cumulative window holds one row for each distinct length."""
    c = records.filter(F.col(length) >= least).groupBy(length).agg(F.count(F.lit(1)).alias("k"))
    order = F.col(length).asc() if compat else F.col(length).desc()
    cum = c.withColumn("cum", F.sum(F.col(length) * F.col("k")).over(Window.orderBy(order))).crossJoin(F.broadcast(c.agg(F.sum(F.col(length) * F.col("k")).alias("total"))))
    pick = F.min if compat else F.max
    return cum.agg(pick(F.when(F.col("cum") >= F.col("total") * x / 100, F.col(length))).alias("nx"), F.sum("k").alias("n"), F.max("total").alias("total"), F.max(length).alias("longest"))


def length_quantiles(records: DataFrame, least: int = 0, length: str = "length") -> DataFrame:
    """(q0..q4, n, total, average): quartiles at place (n-1)k/4, between two places their mean. Works on counted lengths."""
    c = records.filter(F.col(length) >= least).groupBy(F.col(length).alias("v")).agg(F.count(F.lit(1)).alias("k"))
    cum = c.withColumn("hi", F.sum("k").over(Window.orderBy("v"))).withColumn("lo", F.col("hi") - F.col("k"))
    cum = cum.crossJoin(F.broadcast(c.agg(F.sum("k").alias("N"))))
    at = lambda p: F.max(F.when((F.col("lo") <= p) & (p < F.col("hi")), F.col("v")))
    place = lambda q: (F.col("N") - 1) * q / 4
    qs = [((at(F.floor(place(q))) + at(F.ceil(place(q)))) / 2).alias(f"q{q}") for q in range(5)]
    return cum.agg(*qs, F.sum("k").alias("n"), F.sum(F.col("v") * F.col("k")).alias("total"), (F.sum(F.col("v") * F.col("k")) / F.sum("k")).alias("average"))


def extract(records: DataFrame, coords: DataFrame, seq: str = "seq") -> DataFrame:
    """(id, seq): slices of records. coords: (id or ``*``, from, to), 1-based and inclusive; negative positions count from the end.
    The new id is ``id:i`` with the coordinates' number ``i``."""
    c = coords.select(F.col("id").alias("__id"), "i", "from", "to")
    named = records.join(c.filter("__id <> '*'"), F.col("id") == F.col("__id"))
    every = records.withColumn("__all", F.lit("*")).join(c.filter("__id = '*'"), F.col("__all") == F.col("__id")).drop("__all")
    n = F.length(seq)
    a, b = (F.when(F.col(p) < 0, n + F.col(p) + 1).otherwise(F.col(p)) for p in ("from", "to"))
    return named.unionByName(every).select(F.concat_ws(":", "id", "i").alias("id"), F.substr(F.col(seq), a.cast("int"), (b - a + 1).cast("int")).alias("seq"))


def mask(records: DataFrame, regions: DataFrame, symbol: str = "N", trim: bool = False, seq: str = "seq") -> DataFrame:
    """Records with the regions (id, from, to; 1-based, inclusive) replaced by ``symbol``; with ``trim`` masked ends are cut off."""
    g = regions.groupBy("id").agg(F.collect_list(F.struct(F.col("from").cast("int").alias("a"), F.col("to").cast("int").alias("b"))).alias("__r"))
    j = records.join(g, "id", "left")
    fill = lambda s, r: F.concat(F.substr(s, F.lit(1), r["a"] - 1), F.repeat(F.lit(symbol), r["b"] - r["a"] + 1), F.substr(s, r["b"] + 1))
    out = F.when(F.col("__r").isNull(), F.col(seq)).otherwise(F.aggregate("__r", F.col(seq), fill))
    if trim:
        out = F.regexp_replace(out, f"^{symbol}+|{symbol}+$", "")
    return j.withColumn(seq, out).drop("__r")


def rename(records: DataFrame, mapping: DataFrame, drop_unmapped: bool = False) -> DataFrame:
    """Records with ids replaced by ``new`` of the mapping (old, new), found by the defline, the defline with > or the id, in this order."""
    out = records
    for i, key in enumerate((F.col("defline"), F.concat(F.lit(">"), "defline"), F.col("id"))):
        m = mapping.select(F.col("old").alias(f"__o{i}"), F.col("new").alias(f"__n{i}"))
        out = out.join(m, key == F.col(f"__o{i}"), "left")
    new = F.coalesce("__n0", "__n1", "__n2")
    if drop_unmapped:
        out = out.filter(new.isNotNull())
    return out.withColumn("id", F.coalesce(new, "id")).drop(*[f"__{x}{i}" for x in "on" for i in range(3)])


def numbered(records: DataFrame, order: str = "rid") -> DataFrame:
    """Records with ``number`` from 1 in file order, without bringing them all to one task: counts per block of the order, then within."""
    one = cumulative_offsets(records.withColumn("__one", F.lit(1)), order, "__one")
    return one.withColumn("number", F.col("offset") + 1).drop("__one", "offset")


def tag(records: DataFrame, prefix: str = "", suffix: str = "", keep_defline: bool = False) -> DataFrame:
    """Records with ids prefix + number in file order + suffix."""
    name = F.concat(F.lit(prefix), F.col("number").cast("string"), F.lit(suffix))
    out = numbered(records).withColumn("id", name)
    return out.withColumn("defline", F.concat_ws(" ", "id", "defline") if keep_defline else F.col("id")).drop("number")


def tag_from_list(records: DataFrame, names: DataFrame, keep_defline: bool = False) -> DataFrame:
    """Records with ids from a list (rid, name), both in file order; a record past the list's end has a null id."""
    n = numbered(names).select("number", "name")
    out = numbered(records).join(n, "number", "left").withColumn("id", F.col("name"))
    return out.withColumn("defline", F.concat_ws(" ", "id", "defline") if keep_defline else F.col("id")).drop("number", "name")


def split_round_robin(records: DataFrame, n: int = 12, labels: str = "number") -> DataFrame:
    """Records with ``part``: dealt to n parts in turn, labelled by number, zero-padded number or letters."""
    k = ((F.col("number") - 1) % n).cast("int")
    width = len(str(n))
    name = {"number": (k + 1).cast("string"), "padded": F.lpad((k + 1).cast("string"), width, "0"), "letters": F.concat(F.when(k >= 26, F.char(64 + F.floor(k / 26).cast("int"))).otherwise(""), F.char(65 + k % 26))}[labels]
    return numbered(records).withColumn("part", name).drop("number")


def interpose(files: list[DataFrame], check: bool = True) -> DataFrame:
    """Records of several files taken in turn: (rid, file, ...) to be read in the order of rid and file, where ``rid`` is now the record's
    place in its file, from 1. With ``check`` records of one place must have one id (without a trailing mate mark), and files must be
    equally long; else the query fails."""
    union = None
    for i, f in enumerate(files):
        one = numbered(f).withColumn("rid", F.col("number")).drop("number").withColumn("file", F.lit(i))
        union = one if union is None else union.unionByName(one)
    if check:
        w = Window.partitionBy("rid")
        base = F.regexp_replace("id", r"[/_. ][12]$", "")
        union = union.withColumn("__ok", (F.min(base).over(w) == F.max(base).over(w)) & (F.count(F.lit(1)).over(w) == len(files)))
        union = union.withColumn("id", F.when(F.col("__ok"), F.col("id")).otherwise(F.raise_error(F.concat(F.lit("entries out of step at "), F.col("rid").cast("string"))).cast("string"))).drop("__ok")
    return union


def slide(records: DataFrame, win: int = 18, step: int = 1, short: bool = False, strict: bool = False, seq: str = "seq", lerr: int = 0, seed: int = 1) -> DataFrame:
    """(id, start, seq): windows of every sequence; ``short`` keeps the tail, ``strict`` leaves out a window that ends with the sequence,
    and windows of N alone. With ``lerr`` a window is longer or shorter by a whole number drawn evenly from -lerr up to, not including, lerr."""
    n = F.length(seq)
    last = n - 1 if short else n - win - (1 if strict else 0)
    w = records.select("id", F.col(seq).alias("__s"), F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>")).alias("__at"))
    w = w.select("id", "__s", F.explode("__at").alias("start")).select("id", "start", F.substr("__s", F.col("start") + 1, F.lit(win) + (F.floor(uniform(seed, F.col("id"), F.col("start")) * 2 * lerr).cast("int") - lerr if lerr else F.lit(0))).alias("seq"))
    return w.filter(~F.col("seq").rlike("^N*$")) if strict else w


def to_fastq(records: DataFrame, quality: int = 31, offset: int = 33) -> DataFrame:
    """FastA as FastQ of one constant quality; upper case, letters only; empty sequences drop out."""
    s = F.upper(letters(F.col("seq")))
    return records.withColumn("seq", s).filter(F.length("seq") > 0).withColumn("plus", F.lit("")).withColumn("qual", F.repeat(F.lit(chr(quality + offset)), F.length("seq")))


def to_fasta(reads: DataFrame) -> DataFrame:
    return reads.select("rid", "id", "defline", "seq")


def wrap(c: Column, width: int = 70) -> Column:
    """A sequence broken into lines of ``width``; 0 leaves one line."""
    return F.regexp_replace(F.regexp_replace(c, f"(.{{{width}}})", "$1\n"), "\n$", "") if width else c


def mask_quality(reads: DataFrame, least: int = 15, offset: int = 33) -> DataFrame:
    """Reads with N in place of bases of a quality under ``least``. The qualities' characters are mapped to a mask by one translation."""
    low = "".join(chr(c) for c in range(33, 127) if c - offset < least)
    high = "".join(chr(c) for c in range(33, 127) if c - offset >= least)
    marks = F.split(F.translate("qual", low + high, "0" * len(low) + "1" * len(high)), "")
    return reads.withColumn("seq", F.array_join(F.zip_with(F.split("seq", ""), marks, lambda b, m: F.when(m == "0", "N").otherwise(b)), ""))


def quality_offset(reads: DataFrame) -> DataFrame:
    """(offset): 33 if any character is below 55, 64 if any is above 80 and none below, else null. The least and largest character decide,
    whatever the order of the reads."""
    codes = F.transform(F.split("qual", ""), lambda c: F.ascii(c))
    r = reads.filter(F.length("qual") > 0).agg(F.min(F.array_min(codes)).alias("lo"), F.max(F.array_max(codes)).alias("hi"))
    return r.select(F.when(F.col("lo") < 55, 33).when(F.col("hi") > 80, 64).alias("offset"))


def recode_quality(reads: DataFrame, source: int, target: int = 33, force: bool = False) -> DataFrame:
    """Reads with qualities in another encoding; those out of range fail the query, or are clamped with ``force``."""
    top = 126 - max(source, target)

    def one(c: Column) -> Column:
        q = F.ascii(c) - source
        kept = F.least(F.greatest(q, F.lit(0)), F.lit(top))
        return F.char(F.when((q >= 0) & (q <= top), q).otherwise(kept if force else F.raise_error(F.lit("quality out of range")).cast("int")) + target)

    return reads.withColumn("qual", F.array_join(F.transform(F.filter(F.split("qual", ""), lambda x: x != ""), one), ""))


def expected_errors(reads: DataFrame, offset: int = 33) -> DataFrame:
    """(id, mu, var): expected number of errors of each read and its variance, from p = 10^(-q/10)."""
    p = lambda c: F.pow(F.lit(10.0), -(F.ascii(c) - offset) / 10.0)
    q = F.filter(F.split("qual", ""), lambda x: x != "")
    total = lambda f: F.aggregate(q, F.lit(0.0), lambda s, c: s + f(p(c)))
    return reads.select("id", total(lambda x: x).alias("mu"), total(lambda x: x * (1 - x)).alias("var"))


def observed_errors(reads: DataFrame, hits: DataFrame, offset: int = 33) -> DataFrame:
    """(id, mu, var, subs, ins, del): expected errors beside those seen in a read's alignment."""
    h = hits.select(F.col("qseqid").alias("id"), "mismatch", (F.abs(F.col("q_end") - F.col("q_start")) + 1).alias("q"), (F.abs(F.col("s_end") - F.col("s_start")) + 1).alias("s"), "length")
    return expected_errors(reads, offset).join(h, "id").select("id", "mu", "var", F.col("mismatch").alias("subs"), (F.col("length") - F.col("s")).alias("ins"), (F.col("length") - F.col("q")).alias("del"))


def sample_exact(records: DataFrame, n: int | None = None, fraction: float | None = None, replace: bool = False, seed: int = 1) -> DataFrame:
    """Exactly ``n`` records, or round(size * fraction), drawn by a hash of the seed and rid; with ``replace`` they may come out repeatedly."""
    if n is None:
        n = round(records.count() * (fraction or 0))
    if not replace:
        return _lowest(records, n, seed)
    size = records.count()
    draws = records.sparkSession.range(n).select(F.floor(uniform(seed, F.col("id")) * size).alias("__k"))
    return numbered(records).join(draws, F.col("number") - 1 == F.col("__k")).drop("number", "__k")


def _lowest(records: DataFrame, n: int, seed: int) -> DataFrame:
    """The n records of the lowest hashes: those below a limit found from counts, and of the few in the range of the limit the first ones.

    Hashes are counted in 4,096 ranges, then those of the range that holds the n-th in as many again; no task sees more than one range."""
    x = records.withColumn("__u", uniform(seed, F.col("rid")))
    low, width, left = 0.0, 1.0, n
    for _ in range(2):
        width /= 4096
        inside = x.filter((F.col("__u") >= low) & (F.col("__u") < low + 4096 * width))
        counts = {r["k"]: r["c"] for r in inside.groupBy(F.least(F.floor((F.col("__u") - low) / width), F.lit(4095)).alias("k")).agg(F.count(F.lit(1)).alias("c")).collect()}  # at most 4,096 rows
        for k in range(4096):
            c = counts.get(k, 0)
            if c >= left or k == 4095:
                low += k * width
                break
            left -= c
    below = x.filter(F.col("__u") < low)
    edge = x.filter((F.col("__u") >= low) & (F.col("__u") < low + width)).orderBy("__u", "rid").limit(max(left, 0))
    return below.unionByName(edge).drop("__u")


def subsample(records: DataFrame, percents: list[float], replicates: int = 1, seed: int = 1) -> DataFrame:
    """Records with (percent, replicate) for each draw they are in; every draw is independent and the same at each run."""
    grid = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("percent"), F.lit(r).alias("replicate")) for p in percents for r in range(1, replicates + 1)]))
    x = records.select("*", grid.alias("__g")).select(*records.columns, "__g.percent", "__g.replicate")
    return x.filter(uniform(seed, F.col("rid"), F.col("percent"), F.col("replicate")) * 100 < F.col("percent"))


def fragment(records: DataFrame, completeness: float = 0.8, least: int = 500, seed: int = 1) -> DataFrame:
    """(id, seq): a simulated draft: every sequence cut into fragments of geometric length, one base lost between two, short ones dropped.

    Numbers of bins per fragment are geometric with p = clamp(1 - (completeness/1.25 + 0.1)); a bin has ceil(least/1.5^2) bases."""
    bin_len = -int(-least // 2.25)
    p = min(max(1 - (completeness / 1.25 + 0.1), 1e-6), 1 - 1e-6)

    def cut(batches: Iterator) -> Iterator:
        import random

        import pandas as pd

        for pdf in batches:
            rows = []
            for rid, name, s in zip(pdf["rid"], pdf["id"], pdf["seq"]):
                rng, at, k = random.Random(f"{seed}:{rid}"), 0, 0
                while s is not None and at < len(s):
                    bins = 1
                    while rng.random() > p:
                        bins += 1
                    piece = s[at : at + bins * bin_len]
                    at += len(piece) + 1
                    if len(piece) >= least:
                        k += 1
                        rows.append((f"{name}:{k}", piece))
            yield pd.DataFrame(rows, columns=["id", "seq"])

    return records.select("rid", "id", "seq").mapInPandas(cut, "id string, seq string")


def simulate_pairs(genomes: DataFrame, coverage: float, read_len: int = 100, insert: int = 300, insert_sd: float = 30, error: float = 0.01, seed: int = 1) -> DataFrame:
    """(id, mate, seq): read pairs from circular genomes; insert sizes are normal; each base is, with the chance ``error``, one of the three
    others, all alike likely. Letters other than A, C, G and T stay."""
    g = genomes.select("id", "seq", F.length("seq").alias("n")).filter("n > 0")
    g = g.select("*", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.col("n") * coverage / (2 * read_len))).cast("int"))).alias("k"))
    u = lambda *x: uniform(seed, F.col("id"), F.col("k"), *map(F.lit, x))
    gauss = F.sqrt(-2 * F.ln(u("a") + 1e-12)) * F.cos(u("b") * 6.283185307179586)
    g = g.withColumn("at", F.floor(u("c") * F.col("n")).cast("int")).withColumn("size", F.greatest(F.lit(read_len), F.round(insert + insert_sd * gauss).cast("int")))
    ring = F.repeat("seq", F.ceil((F.col("at") + F.col("size")) / F.col("n")).cast("int") + 1)
    m = g.select("id", "k", F.explode(F.array(*[F.struct(F.lit(i).alias("mate"), F.substr(ring, F.col("at") + s + 1, F.lit(read_len)).alias("seq")) for i, s in ((1, F.lit(0)), (2, F.col("size") - read_len))])).alias("x"))
    def other(b: Column, i: Column) -> Column:
        # among the three bases that follow it in the circle ACGT
        step = F.floor(uniform(seed, F.col("id"), F.col("k"), F.col("x.mate"), i, F.lit("other")) * 3).cast("int") + F.instr(F.lit("ACGT"), b)
        return F.when(F.instr(F.lit("ACGT"), b) > 0, F.substr(F.lit("ACGTACG"), step + 1, F.lit(1))).otherwise(b)

    noisy = F.array_join(F.transform(F.split("x.seq", ""), lambda b, i: F.when((b != "") & (uniform(seed, F.col("id"), F.col("k"), F.col("x.mate"), i) < error), other(b, i)).otherwise(b)), "")
    return m.select(F.concat_ws("_", "id", "k").alias("id"), F.col("x.mate").alias("mate"), noisy.alias("seq"))


def variable_columns(alignments: DataFrame, undefined: str = "-") -> DataFrame:
    """(file, mask): for each alignment (file, seq) a text of 1 for columns that hold two different defined characters, else 0.

    Each task keeps the least and largest character of every column; one row a task and alignment crosses the network."""
    kind = alignments.schema["file"].dataType
    part = T.StructType([T.StructField("file", kind), T.StructField("lo", T.BinaryType()), T.StructField("hi", T.BinaryType())])
    skip = [ord(c) for c in {"-", *undefined}]

    def merged(held: dict, key: object, lo: np.ndarray, hi: np.ndarray) -> None:
        if key in held:
            a, b = held[key]
            n = max(len(a), len(lo))
            grow = lambda x, v: np.pad(x, (0, n - len(x)), constant_values=v)
            lo, hi = np.minimum(grow(a, _NONE), grow(lo, _NONE)), np.maximum(grow(b, 0), grow(hi, 0))
        held[key] = (lo, hi)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        held: dict = {}
        for b in batches:
            for key, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if s is not None:
                    c = np.array([ord(x) for x in s] if not s.isascii() else np.frombuffer(s.encode(), np.uint8), np.uint32)
                    gap = np.isin(c, skip)
                    merged(held, key, np.where(gap, _NONE, c).astype(np.uint32), np.where(gap, 0, c).astype(np.uint32))
        if held:
            yield pa.RecordBatch.from_pylist([{"file": k, "lo": lo.tobytes(), "hi": hi.tobytes()} for k, (lo, hi) in held.items()], schema=to_arrow_schema(part))

    def told(pdf):
        import pandas as pd

        held: dict = {}
        for lo, hi in zip(pdf["lo"], pdf["hi"]):
            merged(held, 0, np.frombuffer(lo, np.uint32), np.frombuffer(hi, np.uint32))
        lo, hi = held[0]
        return pd.DataFrame([(pdf["file"].iloc[0], "".join("1" if a < b else "0" for a, b in zip(lo, hi)))], columns=["file", "mask"])

    return alignments.select("file", "seq").mapInArrow(seen, part).groupBy("file").applyInPandas(told, T.StructType([T.StructField("file", kind), T.StructField("mask", T.StringType())]))


def concatenate_alignments(alignments: DataFrame, drop_invariable: bool = False, undefined: str = "-", ignore_after: str | None = None) -> DataFrame:
    """(id, seq): sequences of several alignments (file, id, seq) put end to end by id; missing ones are filled with gaps. Ids are cut off at
    the first match of the pattern ``ignore_after``; with ``drop_invariable`` columns without two different characters are left out."""
    if ignore_after:
        alignments = alignments.withColumn("id", F.regexp_replace("id", f"(?:{ignore_after}).*", ""))
    if drop_invariable:
        masks = F.broadcast(variable_columns(alignments, undefined))  # a row per alignment
        kept = F.array_join(F.filter(F.split("seq", ""), lambda c, i: F.substr(F.col("mask"), i + 1, F.lit(1)) == "1"), "")
        alignments = alignments.join(masks, "file").select("file", "id", kept.alias("seq"))
    size = alignments.groupBy("file").agg(F.max(F.length("seq")).alias("n"))
    grid = alignments.select("id").distinct().crossJoin(F.broadcast(size))  # a row per file and id, as in the result; files are few
    full = grid.join(alignments.select("file", "id", "seq"), ["file", "id"], "left").select("file", "id", F.coalesce("seq", F.repeat(F.lit(undefined[0]), F.col("n"))).alias("seq"))
    g = full.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("file", "seq"))).alias("x"))  # as long as there are files
    return g.select("id", F.array_join(F.transform("x", lambda x: x["seq"]), "").alias("seq"))


def partition_lines(parts: DataFrame, model: str = "AUTO") -> DataFrame:
    """(value): a line for each of :func:`alignment_partitions` as phylogeny programs take them; a model that ends with /3 tells the three
    codon positions apart."""
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("file").cast("string"), "^.*/", ""), r"\..*", ""), "[^A-Za-z0-9_]", "_")
    if model.endswith("/3"):
        start, m = F.col("from") + F.col("k") - 1, model[:-2]
        p = parts.filter(F.col("to") >= F.col("from")).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(3))))
        return p.select(F.concat(F.lit(m + ", "), name, F.lit("codon"), F.col("k").cast("string"), F.lit(" = "), start.cast("string"), F.lit("-"), F.col("to").cast("string"), F.lit("\\3")).alias("value"))
    return parts.filter(F.col("to") >= F.col("from")).select(F.concat(F.lit(model + ", "), name, F.lit(" = "), F.col("from").cast("string"), F.lit("-"), F.col("to").cast("string")).alias("value"))


def alignment_partitions(alignments: DataFrame) -> DataFrame:
    """(file, from, to): where each alignment's columns lie in the concatenated one, files in order of name."""
    size = alignments.groupBy("file").agg(F.max(F.length("seq")).alias("n"))
    w = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # files are few
    return size.withColumn("to", F.sum("n").over(w)).select("file", (F.col("to") - F.col("n") + 1).alias("from"), "to")
