"""Readers of sequence, alignment, coverage, variant, annotation and group files. Compressed files (.gz, .bz2, .zst) are read as they are.

``rid`` numbers records in file order: it rises with file name and position, but has holes. Files are read in splits; nothing is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sequences import numbered
from . import schemas


def _place(path: str) -> tuple[str, str]:
    u = urlparse(path)
    return u.netloc, unquote(u.path)


def _placed(spark: SparkSession, path: str | list[str], sep: str | None = None) -> DataFrame:
    """(file, block, rank, i, value): lines, or records between separators, with the number ``rank`` of their file by name, the place
    ``block`` where their split begins, and their number ``i`` in it, from 0. One pass of Arrow batches; nothing is shuffled or sorted."""
    r = spark.read.option("lineSep", sep) if sep else spark.read
    t = r.text(path)
    ranks = {p: k for k, p in enumerate(sorted({_place(f) for f in t.inputFiles()}))}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, k = None, 0
        for b in batches:
            file, block = b.column(0), b.column(1)
            n = b.num_rows
            new = np.flatnonzero(np.r_[True, pc.or_(pc.not_equal(file.slice(1), file.slice(0, n - 1)), pc.not_equal(block.slice(1), block.slice(0, n - 1))).to_numpy(zero_copy_only=False)]) if n else []
            at, rank = np.empty(n, np.int64), np.empty(n, np.int64)
            for a, e in zip(new, [*new[1:], n]):
                here = (file[a].as_py(), block[a].as_py())
                if here != now:
                    now, k = here, 0
                at[a:e] = np.arange(k, k + e - a)
                rank[a:e] = ranks[_place(here[0])]
                k += e - a
            yield pa.RecordBatch.from_arrays([file, block, pa.array(rank), pa.array(at), b.column(2)], names=["file", "block", "rank", "i", "value"])

    held = t.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.regexp_replace("value", "\r\\z", "").alias("value"))
    return held.mapInArrow(count, "file string, block long, rank long, i long, value string")


def _lines(spark: SparkSession, path: str | list[str], sep: str | None = None) -> DataFrame:
    """(file, rid, value): lines, or records between separators, with a number that rises in file order.

    The number is made of the file's rank and, within it, of where the line's split begins plus the line's number in the split: a line takes
    a byte at least, so no split's numbers reach those of the next. A file whose compression can be split has no such order: it is sorted."""
    t = _placed(spark, path, sep)
    splittable = any(f.lower().endswith(".bz2") for f in spark.read.text(path).inputFiles())
    if splittable:
        return t.orderBy("rank", "block", "i").select("file", F.monotonically_increasing_id().alias("rid"), "value")
    return t.select("file", (F.shiftleft("rank", 40) + F.col("block") + F.col("i")).alias("rid"), "value")


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(rid, id, defline, seq): sequences over several lines are joined; lines that start with ``;`` are comments; the id is the defline's
    first word. Records are cut at ``\\n>`` by the text reader, so large files are read in splits."""
    t = _lines(spark, path, "\n>").withColumn("value", F.regexp_replace("value", r"\A(?:\s*;[^\n]*\n|\s*\n)*>", ""))
    parts = F.split(F.regexp_replace("value", r"\r", ""), "\n", 2)
    body = F.regexp_replace(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")), r"(?m)^;.*$", "")
    t = t.filter((F.trim("value") != "") & ~F.col("value").rlike(r"\A(?:\s*;[^\n]*\n?)+\z")).select("rid", F.trim(parts[0]).alias("defline"), F.regexp_replace(body, r"[\s>]+", "").alias("seq"))
    return t.select("rid", F.regexp_extract("defline", r"^(\S*)", 1).alias("id"), "defline", "seq")


def read_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(rid, id, defline, seq, plus, qual): strictly four lines a record, so that a quality line may begin with @. A file that isn't made of
    such records fails the query.

    Lines are counted by split first; then each split glues its own records, and only those cut by its ends meet in a shuffle."""
    placed = _placed(spark, path).select("file", "block", "rank", "value")
    counts = placed.groupBy("rank", "block").agg(F.count(F.lit(1)).alias("n")).orderBy("rank", "block").collect()  # a row per split, as the scheduler has
    before: dict[tuple, int] = {}
    rank, total = None, 0
    for r in counts:
        rank, total = r["rank"], total if r["rank"] == rank else 0
        before[r["rank"], r["block"]] = total
        total += r["n"]
    names = [f"l{i}" for i in range(4)]
    out = pa.schema([("rank", pa.int64()), ("g", pa.int64()), ("whole", pa.bool_()), *((n, pa.string()) for n in names)])

    def glue(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []  # lines of the record begun
        now, number, first = None, 0, 0  # split, number of the next line in its file, number of the first line held

        def cut() -> list[tuple]:
            return [(now[0], first // 4, False, *([None] * (k % 4)), v, *([None] * (3 - k % 4))) for k, v in enumerate(held, first)]

        for b in batches:
            rows: list[tuple] = []
            for rank, block, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if (rank, block) != now:
                    rows += cut() if held else []
                    now, number, held = (rank, block), before[rank, block], []
                if not held:
                    first = number
                held.append(value)
                number += 1
                if number % 4 == 0:
                    rows += [(rank, first // 4, True, *held)] if len(held) == 4 else cut()
                    held = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*cut()), out)], schema=out)

    r = placed.select("rank", "block", "value").mapInArrow(glue, "rank long, g long, whole boolean, l0 string, l1 string, l2 string, l3 string")
    parts = r.filter("not whole").groupBy("rank", "g").agg(*[F.max(n).alias(n) for n in names])
    g = r.filter("whole").select("rank", "g", *names).unionByName(parts)
    g = g.filter(~(F.col("l3").isNull() & (F.coalesce(F.trim("l0"), F.lit("")) == "")))
    ok = F.col("l0").startswith("@") & F.col("l2").startswith("+") & (F.length("l1") == F.length("l3"))
    head = F.when(F.coalesce(ok, F.lit(False)), F.expr("substring(l0, 2)")).otherwise(F.raise_error(F.concat(F.lit("no record of four lines: "), F.coalesce("l0", F.lit("")))).cast("string"))
    return g.select((F.shiftleft("rank", 40) + F.col("g")).alias("rid"), F.regexp_extract(head, r"^(\S*)", 1).alias("id"), head.alias("defline"), F.col("l1").alias("seq"), F.expr("substring(l2, 2)").alias("plus"), F.col("l3").alias("qual"))


def _table(spark: SparkSession, path: str | list[str], schema: str, comment: str = "#", sep: str = "\t", header: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("sep", sep).option("comment", comment).option("quote", "").option("mode", "PERMISSIVE").option("header", header).csv(path)


def read_hits(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Tabular hits of 12 to 14 columns; missing ones are null."""
    return _table(spark, path, schemas.HITS).withColumn("hit_id", F.monotonically_increasing_id())


def read_rbm(spark: SparkSession, path: str | list[str], pattern: str = r"([^/\s]+)-([^/\s]+)\.rbm") -> DataFrame:
    """Reciprocal matches with the genomes named by the file: (genome1, gene1, genome2, gene2, ...)."""
    h = _table(spark, path, schemas.HITS).withColumn("__f", F.col("_metadata.file_path"))
    return h.withColumn("genome1", F.regexp_extract("__f", pattern, 1)).withColumn("genome2", F.regexp_extract("__f", pattern, 2)).withColumnRenamed("qseqid", "gene1").withColumnRenamed("sseqid", "gene2").drop("__f")


def read_bedgraph(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return _table(spark, path, schemas.BEDGRAPH)


def read_gff(spark: SparkSession, path: str | list[str], style: str = "gff2") -> DataFrame:
    """Features with ``gene``: from ``gene_id name`` (gff2) or ``id=name`` (gff3), else the whole attributes."""
    a = F.col("attributes")
    gene = F.concat(F.lit("gene_id_"), F.regexp_extract(a, r'gene_id "?([^";\s]+)', 1)) if style == "gff2" else F.regexp_extract(a, r"(?i)\bid=([^;]+)", 1)
    found = a.rlike(r"gene_id ") if style == "gff2" else a.rlike(r"(?i)\bid=")
    return _table(spark, path, schemas.GFF).withColumn("gene", F.when(found, gene).otherwise(a))


def read_rec(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return _table(spark, path, schemas.REC)


def read_lim(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return _table(spark, path, schemas.LIM)


def read_identities(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Distance list with a header."""
    return _table(spark, path, schemas.IDENTITIES, header=True)


def read_vcf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Variants with ``fields`` (INFO and sample values in one map; a flag has the value ``true``), ``indel``, ``ref_dp`` and ``alt_dp``:
    from DP4, else from AD."""
    v = _table(spark, path, schemas.VCF)
    pairs = F.transform(F.filter(F.split(F.coalesce("info", F.lit("")), ";"), lambda x: (x != "") & (x != ".")), lambda x: F.struct(F.split(x, "=", 2)[0].alias("k"), F.coalesce(F.try_element_at(F.split(x, "=", 2), F.lit(2)), F.lit("true")).alias("v")))
    keys, vals = F.split(F.coalesce("format", F.lit("")), ":"), F.split(F.coalesce("sample", F.lit("")), ":")
    n = F.least(F.size(keys), F.size(vals))
    given = F.filter(F.arrays_zip(F.slice(keys, 1, n).alias("k"), F.slice(vals, 1, n).alias("v")), lambda x: x["k"] != "")
    both = F.concat(F.filter(pairs, lambda x: ~F.array_contains(F.transform(given, lambda g: g["k"]), x["k"])), F.transform(given, lambda g: F.struct(g["k"].alias("k"), g["v"].alias("v"))))
    once = F.aggregate(both, F.expr("cast(map() as map<string,string>)"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["k"]), F.create_map(x["k"], x["v"])))
    v = v.withColumn("fields", once).withColumn("qual", F.col("qual").try_cast("double"))
    dp4 = F.transform(F.split(F.col("fields")["DP4"], ","), lambda x: x.try_cast("int"))
    ad = F.transform(F.split(F.col("fields")["AD"], ","), lambda x: x.try_cast("int"))
    at = lambda a, i: F.try_element_at(a, F.lit(i))
    return v.select("*", (F.array_contains(F.map_keys("fields"), "INDEL") | (F.length("ref") != F.length(F.split("alt", ",")[0]))).alias("indel"), F.coalesce(at(dp4, 1) + at(dp4, 2), at(ad, 1)).alias("ref_dp"), F.coalesce(at(dp4, 3) + at(dp4, 4), at(ad, 2)).alias("alt_dp"))


def vcf_line(v: DataFrame) -> Column:
    return F.concat_ws("\t", "chrom", "pos", "id", "ref", "alt", F.coalesce(F.col("qual").cast("string"), F.lit(".")), "filter", "info", "format", "sample")


def read_sam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Alignments with optional fields in ``tags`` by their two letters; header lines are left out."""
    f = F.split("value", "\t")
    t = _lines(spark, path).filter(~F.col("value").startswith("@") & (F.col("value") != ""))
    names = [c.split() for c in schemas.SAM.split(", ")[:11]]
    tags = F.map_from_entries(F.transform(F.slice(f, F.lit(12), F.greatest(F.size(f) - 11, F.lit(0))), lambda x: F.struct(F.split(x, ":", 3)[0], F.split(x, ":", 3)[2])))
    return t.select("rid", *[f[i].cast(k).alias(n) for i, (n, k) in enumerate(names)], F.when(F.size(f) > 11, tags).alias("tags"))


def filter_sam(sam: DataFrame, contigs: DataFrame | None = None, identity: float = 95, paired: bool = True) -> DataFrame:
    """Mapped reads on the contigs (id), of pairs reported together or unpaired if ``paired``, of at least this identity: 100 times the share of
    bases without a letter in MD (deletions' marks count as mismatches). A read without MD fails the query."""
    s = sam.filter(F.col("rname") != "*")
    if paired:
        s = s.filter(F.coalesce(F.col("tags")["YT"].isin("CP", "UU"), F.lit(True)))
    if contigs is not None:
        s = s.join(contigs.select(F.col("id").alias("rname")).distinct(), "rname", "left_semi")
    md = F.col("tags")["MD"]
    i = 100.0 * (F.length("seq") - F.regexp_count(md, F.lit("[^0-9]"))) / F.length("seq")
    i = F.when(md.isNull(), F.raise_error(F.concat(F.lit("no MD field: "), "qname")).cast("double")).otherwise(i)
    return s.withColumn("pident", i).filter(F.col("pident") >= identity)


def read_otu(spark: SparkSession, path: str) -> DataFrame:
    """(otu, sample, n): a table of samples in columns, made long; its first column names the OTU."""
    t = spark.read.option("sep", "\t").option("header", True).csv(path)
    return t.unpivot([t.columns[0]], t.columns[1:], "sample", "n").select(F.col(f"`{t.columns[0]}`").alias("otu"), "sample", F.col("n").try_cast("double").alias("n"))


def read_ogs(spark: SparkSession, path: str) -> DataFrame:
    """(og, genome, gene, notes): groups as lines, genomes as columns, genes joined by commas, ``-`` for none; what follows # is notes."""
    t = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    g = [c for c in t.columns if not c.startswith("#") and not c.startswith("_c")]
    notes = [F.col(f"`{c}`") for c in t.columns if c not in g]
    t = t.withColumn("og", F.monotonically_increasing_id()).withColumn("notes", F.concat_ws(" ", *notes) if notes else F.lit(None).cast("string"))
    return t.unpivot(["og", "notes"], g, "genome", "genes").filter("genes <> '-'").select("og", "genome", F.explode(F.split("genes", ",")).alias("gene"), "notes")


def read_key(spark: SparkSession, path: str) -> DataFrame:
    """Dichotomous key, a row for each branch: (step, character, state, next, terminal); ``[n]`` as the conclusion leads to step n."""
    t = spark.read.option("sep", "\t").option("comment", "#").option("quote", "").csv(path).toDF("step", "character", "a", "b")
    x = t.select("step", "character", F.explode(F.array("a", "b")).alias("x")).select("step", "character", F.split("x", ":", 2).alias("x"))
    goes = F.regexp_extract(F.trim(F.col("x")[1]), r"^\[(.+)\]$", 1)
    return x.select("step", "character", F.trim(F.col("x")[0]).alias("state"), F.when(goes != "", goes).otherwise(F.trim(F.col("x")[1])).alias("next"), (goes == "").alias("terminal"))


def read_characters(spark: SparkSession, path: str) -> DataFrame:
    """(object, character, state) of a wide table with a header; its first column names the object."""
    t = spark.read.option("sep", "\t").option("header", True).csv(path)
    return t.unpivot([t.columns[0]], t.columns[1:], "character", "state").withColumnRenamed(t.columns[0], "object")


def read_taxonomy(spark: SparkSession, nodes: str, names: str) -> tuple[DataFrame, DataFrame]:
    """(tax_id, parent_id, rank) and (rid, tax_id, name, name_class) of taxonomy dump files."""
    f = F.split(F.regexp_replace("value", r"\t\|$", ""), r"\t\|\t")
    n = _lines(spark, nodes).select(f[0].cast("long").alias("tax_id"), f[1].cast("long").alias("parent_id"), f[2].alias("rank"))
    return n, _lines(spark, names).select("rid", f[0].cast("long").alias("tax_id"), f[1].alias("name"), f[3].alias("name_class"))


def read_silva(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, rank): ranked paths."""
    t = spark.read.option("sep", "\t").option("quote", "").csv(path)
    return t.select(F.col("_c0").alias("path"), F.regexp_extract("_c0", r"([^;]+);?$", 1).alias("name"), F.col("_c2").alias("rank"))


def read_lineages(spark: SparkSession, path: str) -> DataFrame:
    """(contig, rank, score, lineage): records of two lines, scores then ``<rank>name;...``."""
    n = numbered(_lines(spark, path).filter(F.trim("value") != ""))
    g = n.groupBy(F.floor((F.col("number") - 1) / 2).alias("g")).agg(*[F.max(F.when(F.col("number") % 2 == i, F.col("value"))).alias(c) for c, i in (("a", 1), ("b", 0))])
    f = F.split("a", "\t")
    return g.select(f[0].alias("contig"), F.try_element_at(f, F.lit(2)).alias("rank"), F.try_element_at(f, F.lit(3)).try_cast("double").alias("score"), F.col("b").alias("lineage"))


def read_growth(spark: SparkSession, path: str) -> DataFrame:
    """(sample, t, od) of a table of time and one column for each replicate."""
    t = spark.read.option("sep", "\t").option("header", True).csv(path)
    return t.unpivot([t.columns[0]], t.columns[1:], "sample", "od").select("sample", F.col(f"`{t.columns[0]}`").cast("double").alias("t"), F.col("od").cast("double").alias("od"))


def read_clusters(spark: SparkSession, path: str, separator: str = r"[,\t ]") -> DataFrame:
    """(cluster, item): a cluster on each line."""
    return _lines(spark, path).filter(F.trim("value") != "").select(F.col("rid").alias("cluster"), F.explode(F.split("value", separator)).alias("item")).filter("item <> ''")


def read_cog(spark: SparkSession, path: str) -> DataFrame:
    """(gene, cog, category, description) of a list of groups: ``[CATS] COGnnnn text`` heads blocks of indented gene lists."""
    blocks = _lines(spark, path, "\n___").select(F.regexp_replace("value", "^_+", "").alias("v"))
    head = lambda i: F.regexp_extract("v", r"\[([A-Z]+)\]\s+(COG\d+)\s*([^\n]*)", i)
    b = blocks.filter(head(2) != "").select(head(2).alias("cog"), head(1).alias("category"), head(3).alias("description"), F.regexp_extract_all("v", F.lit(r"(?m)^[ \t]+(?:\S+:)?[ \t]*(.*)$"), F.lit(1)).alias("l"))
    return b.select(F.explode(F.split(F.trim(F.array_join("l", " ")), r"\s+")).alias("gene"), "cog", "category", "description").filter("gene <> ''")


def read_tblout(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, query, full_evalue, full_score, best_evalue, best_score) of a table of model hits."""
    f = F.split(F.trim("value"), r"\s+")
    t = _lines(spark, path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return t.select("rid", f[0].alias("seq_id"), f[2].alias("query"), *[f[i].try_cast("double").alias(c) for i, c in ((4, "full_evalue"), (5, "full_score"), (7, "best_evalue"), (8, "best_score"))])


def read_model_search(spark: SparkSession, path: str) -> DataFrame:
    """The same columns of a text report: the list of hits that follows each ``Query:`` line."""
    p = _lines(spark, path, "\nQuery:").select(F.regexp_replace("value", r"\A(?:Query:)?\s+", "").alias("v")).filter(F.col("v").rlike("full sequence")).select(F.regexp_extract("v", r"^(\S+)", 1).alias("query"), F.regexp_extract("v", r"(?s)--- full sequence.*?\n((?:(?!\n\s*\n|\nDomain).)*)", 1).alias("t"))
    row = F.explode(F.regexp_extract_all("t", F.lit(r"(?m)^\s*([-+0-9.e]+\s+[0-9.]+\s+[0-9.]+\s+[-+0-9.e]+\s+[0-9.]+\s+[0-9.]+\s+[0-9.]+\s+\d+\s+\S+)"), F.lit(1)))
    f = F.split("r", r"\s+")
    return p.select("query", row.alias("r")).select(f[8].alias("seq_id"), "query", *[f[i].try_cast("double").alias(c) for i, c in ((0, "full_evalue"), (1, "full_score"), (3, "best_evalue"), (4, "best_score"))])


def filter_model_hits(hits: DataFrame, full_evalue: float | None = None, full_score: float | None = None, best_evalue: float | None = None, best_score: float | None = None) -> DataFrame:
    for c, limit in (("full_evalue", full_evalue), ("best_evalue", best_evalue)):
        hits = hits if limit is None else hits.filter(F.col(c) <= limit)
    for c, limit in (("full_score", full_score), ("best_score", best_score)):
        hits = hits if limit is None else hits.filter(F.col(c) >= limit)
    return hits


def read_pairwise(spark: SparkSession, path: str, min_query: int = 30, min_fraction: float = 0.7, min_identity: float = 60) -> DataFrame:
    """(query, subject, aa_qry, aa_sbj, aln_len): substitutions in the best match of each record of a pairwise report, where the line between
    query and subject has + or _. Records end with the word Lambda; only long and alike alignments count."""
    out = T.StructType([T.StructField(n, T.StringType()) for n in ("query", "subject", "aa_qry", "aa_sbj")] + [T.StructField("aln_len", T.IntegerType())])

    def read(batches):
        import re

        import pandas as pd

        for pdf in batches:
            rows = []
            for text in pdf["value"]:
                name = re.search(r"Query=\s*(\S+)", text)
                size = re.search(r"Length=(\d+)", text) or re.search(r"\(([\d,]+) letters\)", text)
                best = re.split(r"(?m)^>", text)[1:2]
                if not (name and size and best):
                    continue
                block = re.split(r"(?m)^ Score =", best[0])
                stats = re.search(r"Identities = (\d+)/(\d+)", best[0])
                if len(block) < 2 or not stats:
                    continue
                n, same, aln = int(size[1].replace(",", "")), int(stats[1]), int(stats[2])
                if n <= min_query or aln / n <= min_fraction or 100 * same / aln <= min_identity:
                    continue
                lines = block[1].split("\n")
                for i, line in enumerate(lines):
                    q = re.match(r"(Query:?\s+\d+\s+)(\S+)", line)
                    if q and i + 2 < len(lines):
                        s = re.match(r"Sbjct:?\s+\d+\s+(\S+)", lines[i + 2])
                        mid = lines[i + 1][len(q[1]) :].ljust(len(q[2]))
                        rows += [(name[1], best[0].split()[0], a, b, aln) for a, b, m in zip(q[2], s[1] if s else "", mid) if m in "+_"]
            yield pd.DataFrame(rows, columns=out.names)

    return _lines(spark, path, "Lambda     ").select("value").mapInPandas(read, out)


def read_alignment_triplets(spark: SparkSession, path: str) -> DataFrame:
    """(model, protein, coords, model_aln, protein_aln): ``# model : protein : coords`` and two lines of alignment."""
    n = numbered(_lines(spark, path).filter(F.trim("value") != ""))
    g = n.groupBy(F.floor((F.col("number") - 1) / 3).alias("g")).agg(*[F.max(F.when((F.col("number") - 1) % 3 == i, F.col("value"))).alias(f"l{i}") for i in range(3)])
    h = F.split(F.regexp_replace("l0", r"^#\s*", ""), r"\s+:\s+")
    return g.select(h[0].alias("model"), h[1].alias("protein"), F.try_element_at(h, F.lit(3)).alias("coords"), F.col("l1").alias("model_aln"), F.col("l2").alias("protein_aln"))


def read_placements(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The tree and (read, multiplicity, edge_num, likelihood, like_weight_ratio, distal_length, pendant_length) of a placement file; the
    first placement of each read counts."""
    from ..operators.trees import tree_table

    v = F.parse_json("value")
    doc = spark.read.text(path, wholetext=True)
    tree = doc.select(F.variant_get(v, "$.tree", "string")).first()[0]
    fields = doc.select(F.variant_get(v, "$.fields", "array<string>")).first()[0]
    p = doc.select(F.explode(F.variant_get(v, "$.placements", "array<variant>")).alias("x"))
    names = F.coalesce(F.try_variant_get("x", "$.nm", "array<array<string>>"), F.transform(F.coalesce(F.try_variant_get("x", "$.n", "array<string>"), F.array(F.try_variant_get("x", "$.n", "string"))), lambda n: F.array(n, F.lit("1"))))
    p = p.select(F.explode(names).alias("n"), F.try_variant_get("x", "$.p[0]", "array<double>").alias("p"))
    out = p.select(F.col("n")[0].alias("read"), F.col("n")[1].cast("double").alias("multiplicity"), *[(F.col("p")[i].cast("int") if f == "edge_num" else F.col("p")[i]).alias(f) for i, f in enumerate(fields)])
    return tree_table(spark, tree), out


def read_newick(spark: SparkSession, path: str) -> DataFrame:
    from ..operators.trees import tree_table

    return tree_table(spark, "".join(r[0] for r in spark.read.text(path).collect()))


def read_alignment(spark: SparkSession, path: str, form: str = "fasta") -> DataFrame:
    """(id, seq) of an alignment in fasta, stockholm, clustal, phylip (relaxed, interleaved or not) or nexus."""
    if form == "fasta":
        return read_fasta(spark, path).select("id", "seq")
    drop = {"stockholm": r"^(#|//|\s*$)", "clustal": r"^(CLUSTAL|MUSCLE|\s|$)", "phylip": r"^\s*(\d+\s+\d+\s*)?$", "nexus": r"(?i)^\s*(#nexus|begin|end|dimensions|format|matrix|;|\[|$)"}[form]
    t = _lines(spark, path).filter(~F.col("value").rlike(drop))
    f = F.split(F.trim(F.regexp_replace("value", ";$", "")), r"\s+", 2)
    t = t.select("rid", F.regexp_replace(f[0], "^'|'$", "").alias("id"), F.regexp_replace(F.regexp_replace(F.coalesce(F.try_element_at(f, F.lit(2)), F.lit("")), r"\s+\d+$", ""), r"\s", "").alias("part"))
    return t.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rid", "part"))), lambda x: x["part"]), "").alias("seq"))


def add_genbank_fields(spark: SparkSession, path: str, annotations: DataFrame, key: str, separator: str = "#", tag: str = "locus_tag") -> DataFrame:
    """(rid, sub, value): lines of a GenBank file, with lines ``/field="v"`` after each ``/tag="id"`` that has annotations (one column for
    each field; several values split at ``separator``), to be written in the order of rid and sub."""
    t = _lines(spark, path).withColumn("__id", F.regexp_extract("value", rf'^\s*/{tag}="([^"]+)"', 1))
    def added(c: str) -> Column:
        return F.transform(F.split(F.coalesce(c, F.lit("")), separator), lambda v: F.concat(F.lit(f'                     /{c}="'), v, F.lit('"')))

    a = annotations.select(F.col(key).alias("__id"), F.explode(F.flatten(F.array(*[added(c) for c in annotations.columns if c != key]))).alias("extra")).filter(~F.col("extra").rlike('=""$'))
    more = t.filter("__id <> ''").join(a, "__id").select("rid", F.lit(1).alias("sub"), F.col("extra").alias("value"))
    return t.select("rid", F.lit(0).alias("sub"), "value").unionByName(more)
