"""Queries of the problems tagged llm, and the same in SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..queries import table
from .components import consolidate
from .leaks import leaks
from .packing import pack_counts, pack_documents
from .subjects import subjects
from .top_n import top_n_per_group


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return consolidate(table(spark, d, "rbm"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return top_n_per_group(table(spark, d, "a_mg_cds_go"), "qseqid", "bitscore", "hit_id", 5).select("qseqid", "hit_id")


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(table(spark, d, "documents"), table(spark, d, "pack_sizes"))


def p6_summary(spark: SparkSession, d: str) -> DataFrame:
    return pack_counts(p6_pack(spark, d))


def p6_holds(spark: SparkSession, d: str) -> DataFrame:
    """What any placement must hold: every message with text placed, its pieces joined without gaps or overlaps, split only if it alone exceeds
    the largest capacity, and no container over its capacity."""
    p = p6_pack(spark, d)
    c = p.groupBy("container").agg(F.sum("tokens").alias("t"), F.max("capacity_tokens").alias("c"), F.count_distinct("pack_kind").alias("kinds"))
    m = p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("t"), F.max(F.col("first_token") + F.col("tokens")).alias("end"), F.max("capacity_tokens").alias("c"))
    over = c.agg(F.sum(F.when((F.col("t") > F.col("c")) | (F.col("kinds") > 1), 1).otherwise(0)).alias("over"))
    return m.agg(F.count(F.lit(1)).alias("messages"), F.sum(F.when(F.col("t") != F.col("end"), 1).otherwise(0)).alias("gaps"), F.sum(F.when((F.col("pieces") > 1) & (F.col("t") <= F.col("c")), 1).otherwise(0)).alias("split")).crossJoin(over)  # one row each


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Test items that share twelve words with one another, their passages being read as plain texts."""
    e = table(spark, d, "eval_items")
    found = leaks(e.select(F.col("item_id").alias("doc_id"), F.col("passage").alias("text")), e, read=lambda t: [t or ""])
    return found.filter("distance = 0").select("doc_id", "item_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.filter("distance = 0").select("doc_id", "item_id")


def p7_near(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects(table(spark, d, "documents"), table(spark, d, "subject_examples"), table(spark, d, "subject_areas"))


QUERIES = {f.__name__: f for f in (p4_found, p5_found, p6_pack, p6_summary, p6_holds, p7_items, p7_found, p7_near, p8_found)}

SQL = {
    "p4_found": """
WITH RECURSIVE good AS (SELECT DISTINCT seq1, id1, seq2, id2 FROM rbm WHERE seq1 IS NOT NULL AND id1 IS NOT NULL AND seq2 IS NOT NULL AND id2 IS NOT NULL),
v AS (SELECT seq, id, row_number() OVER (ORDER BY encode(seq), encode(id)) AS k FROM (SELECT seq1 AS seq, id1 AS id FROM good UNION SELECT seq2, id2 FROM good)),
p AS (SELECT a.k AS a, b.k AS b FROM good JOIN v AS a ON a.seq = seq1 AND a.id = id1 JOIN v AS b ON b.seq = seq2 AND b.id = id2),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT k AS x, k AS least FROM v UNION SELECT e.b, r.least FROM r JOIN e ON r.x = e.a WHERE r.least < e.b),
g AS (SELECT x, min(least) AS least FROM r GROUP BY x)
SELECT v.seq, v.id, w.seq AS grp_seq, w.id AS grp_id FROM g JOIN v ON v.k = g.x JOIN v AS w ON w.k = g.least
""",
    "p5_found": """
WITH h AS (SELECT qseqid, hit_id, max(bitscore) AS score FROM a_mg_cds_go WHERE qseqid IS NOT NULL AND hit_id IS NOT NULL AND bitscore IS NOT NULL AND NOT isnan(bitscore) GROUP BY ALL)
SELECT qseqid, hit_id FROM h QUALIFY row_number() OVER (PARTITION BY qseqid ORDER BY score DESC, hit_id) <= 5
""",
    "p6_holds": "SELECT count(*) AS messages, 0 AS gaps, 0 AS split, 0 AS over FROM documents WHERE text <> ''",
    "p7_items": r"""
WITH w AS (SELECT item_id, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') AS l FROM eval_items),
g AS (SELECT DISTINCT item_id, array_to_string(l[i:i + 11], ' ') AS t FROM (SELECT item_id, l, unnest(generate_series(1, len(l) - 11)) AS i FROM w))
SELECT DISTINCT a.item_id AS doc_id, b.item_id FROM g AS a JOIN g AS b ON a.t = b.t""",
}
