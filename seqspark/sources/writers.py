"""Writers of text formats. A frame is written in its own order and partitions; ``compression`` is any the text writer knows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sequences import wrap


def fasta_lines(records: DataFrame, width: int = 70) -> DataFrame:
    return records.select(F.concat(F.lit(">"), F.coalesce("defline", "id"), F.lit("\n"), wrap(F.col("seq"), width)).alias("value"))


def write_fasta(records: DataFrame, path: str, width: int = 70, compression: str = "none") -> None:
    fasta_lines(records, width).write.text(path, compression=compression)


def _fastq_record() -> Column:
    return F.concat_ws("\n", F.concat(F.lit("@"), F.coalesce("defline", "id")), "seq", F.concat(F.lit("+"), F.coalesce("plus", F.lit(""))), "qual")


def write_fastq(reads: DataFrame, path: str, compression: str = "none") -> None:
    reads.select(_fastq_record().alias("value")).write.text(path, compression=compression)


def write_parts(records: DataFrame, path: str, part: str, width: int = 70) -> None:
    """A folder for each value of ``part``: one for each record by its id, or those of a split; FastQ if records have qualities."""
    lines = _fastq_record() if "qual" in records.columns else F.concat(F.lit(">"), F.coalesce("defline", "id"), F.lit("\n"), wrap(F.col("seq"), width))
    records.select(part, lines.alias("value")).write.partitionBy(part).text(path)


def write_table(rows: DataFrame, path: str, header: bool = True) -> None:
    rows.write.option("sep", "\t").option("header", header).option("quote", "").csv(path)


def write_alignment(rows: DataFrame, path: str, form: str = "fasta", single: bool = True) -> None:
    """Alignment (id, seq) as fasta, stockholm, clustal, phylip or nexus (one block): files that read one after another by name are the
    alignment, and ``single`` makes them one, for programs that ask for it."""
    line = F.concat_ws("  ", "id", "seq")
    body = rows.orderBy("id").select(F.concat(F.lit(">"), "id", F.lit("\n"), "seq").alias("value") if form == "fasta" else line.alias("value"))
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("seq")).alias("m"))
    head = {"stockholm": F.lit("# STOCKHOLM 1.0"), "clustal": F.lit("CLUSTAL W\n"), "phylip": F.concat_ws(" ", "n", "m"), "nexus": F.concat(F.lit("#NEXUS\nbegin data;\ndimensions ntax="), "n", F.lit(" nchar="), "m", F.lit(";\nformat datatype=protein gap=-;\nmatrix"))}
    tail = {"stockholm": "//", "nexus": ";\nend;"}
    out = body.select(F.lit(1).alias("k"), "value")
    if form in head:
        out = out.unionByName(n.select(F.lit(0).alias("k"), head[form].alias("value")))
    if form in tail:
        out = out.unionByName(n.select(F.lit(2).alias("k"), F.lit(tail[form]).alias("value")))
    out = out.orderBy("k", "value").select("value")
    (out.coalesce(1) if single else out).write.text(path)


def save_matches(matches: DataFrame, path: str, keys: list[str]) -> None:
    """Results of genome pairs as a table partitioned by ``keys``; a pair written again replaces what was there."""
    spark = matches.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        matches.write.mode("overwrite").partitionBy(*keys).parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def stored_matches(spark: SparkSession, path: str, pairs: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of ``pairs`` (keys) the matches already stored by :func:`save_matches`, and the pairs that are not there and have to be computed."""
    have = spark.read.parquet(path)
    wanted = pairs.select(*keys).distinct()
    return have.join(wanted, keys, "left_semi"), wanted.join(have.select(*keys).distinct(), keys, "left_anti")


def save_plot(cells: DataFrame, bins: DataFrame, peaks: DataFrame, path: str) -> None:
    """The tables of a recruitment plot as one bundle: folders ``cells``, ``bins`` and ``peaks``."""
    for name, t in (("cells", cells), ("bins", bins), ("peaks", peaks)):
        t.write.mode("overwrite").parquet(f"{path}/{name}")


def load_plot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("cells", "bins", "peaks")}
