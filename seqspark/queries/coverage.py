"""Queries of depth, windows and recruitment, over the reads' hits on genes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coverage as C
from ..operators import statistics as S
from ..operators.intervals import overlap_join
from . import table
from .hits import gene_lengths, go, reads


def _spans(spark, d):
    """Half-open spans of hits on genes."""
    h = reads(spark, d, "sseqid", "s_start", "s_end").filter("sseqid is not null and s_start is not null and s_end is not null")
    return h.select("hit_id", F.col("sseqid").alias("contig"), (F.least("s_start", "s_end") - 1).cast("long").alias("start"), F.greatest("s_start", "s_end").cast("long").alias("end"))


def _lengths(spark, d):
    return gene_lengths(spark, d).select(F.col("id").alias("contig"), F.col("length").cast("long").alias("length"))


def _hist(spark, d):
    return C.depth_histogram(C.depth_runs(_spans(spark, d)), _lengths(spark, d))


def cov_histogram(spark, d):
    return _hist(spark, d)


def cov_tad(spark, d):
    return C.truncated_depth(_hist(spark, d), ["contig"], 0.8)


def cov_tad_total(spark, d):
    return C.truncated_depth(_hist(spark, d).groupBy("depth").agg(F.sum("n").alias("n")), [], 0.5)


def cov_seqdepth(spark, d):
    return C.sequence_depth(_spans(spark, d), _lengths(spark, d))


def cov_average(spark, d):
    return C.average_depth(go(spark, d).filter("q_start is not null and q_end is not null"))


def cov_zip(spark, d):
    return C.zero_inflated_depth(_hist(spark, d))


def _offsets(spark, d):
    g = gene_lengths(spark, d).filter("id rlike '^[A-F]:[0-9]+$'")
    g = g.withColumn("rid", (F.ascii("id") - 64) * 1_000_000 + F.substring("id", 3, 20).cast("long"))
    return C.cumulative_offsets(g)


def catsbj_offsets(spark, d):
    return C.sequence_limits(_offsets(spark, d))


def catsbj_hits(spark, d):
    return C.concatenated_hits(reads(spark, d, "qseqid", "sseqid", "pident", "length", "s_start", "s_end", "bitscore", "qry_len").filter("s_start is not null and s_end is not null"), _offsets(spark, d), 90, 60)


def cov_window(spark, d):
    r = C.depth_runs(_spans(spark, d)).join(_offsets(spark, d).select(F.col("id").alias("contig"), "offset"), "contig")
    return C.depth_windows(r.select((F.col("start") + F.col("offset")).alias("start"), (F.col("end") + F.col("offset")).alias("end"), "depth"), 1000)


def gff_gaps(spark, d):
    f = reads(spark, d, "sseqid", "s_start", "s_end").filter("sseqid is not null and s_start is not null and s_end is not null")
    return C.feature_gaps(f.select(F.col("sseqid").alias("seqid"), F.least("s_start", "s_end").alias("start"), F.greatest("s_start", "s_end").alias("end")).distinct())


def _cells(spark, d):
    return C.recruitment_plot(catsbj_hits(spark, d), 1000, 70, 0.5)


def overlap_counts(spark, d):
    """Hits that touch each 40-base probe of their gene."""
    probes = _lengths(spark, d).select("contig", F.explode(F.sequence(F.lit(1).cast("long"), F.col("length"), F.lit(400).cast("long"))).alias("start")).withColumn("end", F.col("start") + 39)
    j = overlap_join(probes, _spans(spark, d).withColumn("start", F.col("start") + 1), "contig", width=256)
    return j.groupBy("contig", "start").agg(F.count(F.lit(1)).alias("n"))


def recplot_counts(spark, d):
    return _cells(spark, d)


def recplot_depth(spark, d):
    return C.plot_depth(_cells(spark, d))


def recplot_cutoff(spark, d):
    return C.plot_depth(C.change_cutoff(_cells(spark, d), 98), selected=False)


def recplot_anir(spark, d):
    return C.plot_identity(_cells(spark, d), 95, 100)


def recplot_compare(spark, d):
    c = _cells(spark, d)
    return C.compare_identities(c.filter("pos_bin % 2 = 0"), c.filter("pos_bin % 2 = 1"), 1)


def recplot_coordinates(spark, d):
    return C.bin_coordinates(_cells(spark, d), catsbj_offsets(spark, d))


def recplot_windows(spark, d):
    """Windows far below the core peak, where one normal peak is fitted to all."""
    w = recplot_depth(spark, d)
    return C.extract_windows(w, S.find_peaks(w, most=1, drop_top=0), 0.1)


def recplot_windows_core(spark, d):
    """Windows far below the core peak of a mixture."""
    w = recplot_depth(spark, d)
    return C.extract_windows(w, S.find_peaks(w), 0.05)


def _records(spark, d):
    return catsbj_hits(spark, d).select("start", "end", "pident")


def recplot_equal(spark, d):
    r = _records(spark, d)
    return C.recruitment_cells(r, C.equal_breaks(catsbj_offsets(spark, d), 200), *C.identity_range(r))


def recplot_sequences(spark, d):
    bins = C.sequence_breaks(catsbj_offsets(spark, d))
    return C.cell_depth(C.recruitment_cells(_records(spark, d), bins), bins)


def recplot_table(spark, d):
    at = table(spark, d, "nation").select(F.col("n_nationkey").alias("rid"), (1 + F.col("n_nationkey") * F.col("n_nationkey") * 37.5).alias("at"), F.col("n_name").alias("name"))
    bins = C.table_breaks(at)
    cells = C.recruitment_cells(_records(spark, d), bins, id_bins=30)
    return cells.join(bins.select("pos_bin", "name"), "pos_bin")


def gff_breaks(spark, d):
    f = reads(spark, d, "sseqid", "s_start", "s_end").filter("sseqid is not null and s_start is not null and s_end is not null").groupBy("hit_id").agg(F.min("sseqid").alias("seqid"), F.min(F.least("s_start", "s_end")).alias("start"), F.max(F.greatest("s_start", "s_end")).alias("end"))
    return C.feature_breaks(f.select(F.col("hit_id").alias("rid"), "seqid", "start", "end", F.concat(F.lit("f"), F.col("hit_id").cast("string")).alias("name")), _offsets(spark, d))


def anir(spark, d):
    return C.average_identity(reads(spark, d, "pident"), 95)


def anir_histogram(spark, d):
    return C.identity_histogram(reads(spark, d, "pident"))


QUERIES = {f.__name__: f for f in (cov_histogram, cov_tad, cov_tad_total, cov_seqdepth, cov_average, cov_zip, catsbj_offsets, catsbj_hits, cov_window, gff_gaps, overlap_counts, recplot_counts, recplot_depth, recplot_cutoff, recplot_anir, recplot_compare, recplot_coordinates, recplot_windows, recplot_windows_core, recplot_equal, recplot_sequences, recplot_table, gff_breaks, anir, anir_histogram)}

_BASE = """
WITH reads AS (SELECT DISTINCT * EXCLUDE (loaded_at) FROM a_mg_reads_cds),
lens AS (SELECT sseqid AS contig, max(greatest(s_start, s_end)) AS length FROM reads WHERE sseqid IS NOT NULL GROUP BY 1 HAVING max(greatest(s_start, s_end)) IS NOT NULL),
spans AS (SELECT hit_id, sseqid AS contig, least(s_start, s_end) - 1 AS s, greatest(s_start, s_end) AS e FROM reads WHERE sseqid IS NOT NULL AND s_start IS NOT NULL AND s_end IS NOT NULL),
ev AS (SELECT contig, p, sum(d) AS d FROM (SELECT contig, s AS p, 1 AS d FROM spans UNION ALL SELECT contig, e, -1 FROM spans) GROUP BY ALL),
runs AS (SELECT * FROM (SELECT contig, p AS s, lead(p) OVER w AS e, CAST(sum(d) OVER w AS bigint) AS depth FROM ev WINDOW w AS (PARTITION BY contig ORDER BY p)) WHERE e IS NOT NULL),
cov AS (SELECT contig, depth, CAST(sum(e - s) AS bigint) AS n FROM runs WHERE depth > 0 GROUP BY ALL),
hist AS (SELECT * FROM cov UNION ALL SELECT * FROM (SELECT contig, 0, length - sum(n) AS n FROM cov JOIN lens USING (contig) GROUP BY contig, length) WHERE n > 0)
"""
_TAD = """
, c AS (SELECT *, sum(n) OVER ({part} ORDER BY depth) AS cum, sum(n) OVER ({part}) AS total FROM {hist}),
k AS (SELECT *, greatest(0.0, least(cum, total - round((1 - {keep}::double) / 2 * total)) - greatest(cum - n, round((1 - {keep}::double) / 2 * total))) AS k FROM c)
SELECT {key} coalesce(sum(depth * k) / nullif(sum(k), 0), 0) AS tad, CAST(sum(n) AS bigint) AS length, 1 - sum(CASE WHEN depth = 0 THEN n ELSE 0 END) / sum(n) AS breadth FROM k {group}
"""
_OFF = (
    _BASE
    + """
, g AS (SELECT contig AS id, length, (ascii(contig) - 64) * 1000000 + CAST(contig[3:] AS bigint) AS rid FROM lens WHERE regexp_full_match(contig, '[A-F]:[0-9]+')),
off AS (SELECT id, length, CAST(coalesce(sum(length) OVER (ORDER BY rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS off FROM g)
"""
)
_HITS = _OFF + ", cat AS (SELECT hit_id, off + least(s_start, s_end) + 1 AS start, off + greatest(s_start, s_end) + 1 AS e, pident, bitscore, qseqid AS read, pident * reads.length / qry_len AS corr FROM reads JOIN off ON id = sseqid WHERE reads.length >= 60 AND pident >= 90 AND s_start IS NOT NULL AND s_end IS NOT NULL)"
_CELLS = (
    _HITS
    + """
, r AS (SELECT start AS s, e, CAST(ceil((pident - 70) / 0.5) - 1 AS int) AS id_bin FROM cat WHERE pident > 70),
b AS (SELECT *, unnest(generate_series(CAST(ceil(s / 1000.0) - 1 AS bigint), CAST(ceil(e / 1000.0) - 1 AS bigint))) AS pos_bin FROM r),
cells AS (SELECT pos_bin, id_bin, CAST(sum(least(e, (pos_bin + 1) * 1000) - greatest(s, pos_bin * 1000 + 1) + 1) AS bigint) AS n FROM b GROUP BY ALL)
"""
)
_RECS = _HITS + ", lim AS (SELECT id, off + 1 AS a, off + length + 1 AS b FROM off), r AS (SELECT start AS s, e, pident FROM cat WHERE pident > 70)"
_ANY = " c AS (SELECT pos_bin, CAST(ceil((pident - 70) / (30 / {n})) - 1 AS int) AS id_bin, CAST(sum(least(e, floor(high)) - greatest(s, floor(low) + 1) + 1) AS bigint) AS n FROM r JOIN b ON s <= floor(high) AND e >= floor(low) + 1 GROUP BY ALL) "
_MID = "(70 + (id_bin + 0.5) * 0.5)"
SQL = {
    "cov_histogram": _BASE + "SELECT contig, depth, n FROM hist",
    "cov_tad": _BASE + _TAD.format(part="PARTITION BY contig", hist="hist", keep=0.8, key="contig,", group="GROUP BY contig"),
    "cov_tad_total": _BASE + ", h2 AS (SELECT depth, sum(n) AS n FROM hist GROUP BY 1)" + _TAD.format(part="", hist="h2", keep=0.5, key="", group=""),
    "cov_seqdepth": _BASE
    + """, c AS (SELECT *, sum(n) OVER (PARTITION BY contig ORDER BY depth) AS cum, sum(n) OVER (PARTITION BY contig) AS total FROM hist),
m AS (SELECT contig, min(depth) AS median FROM c WHERE cum > floor((total - 1) / 2) GROUP BY 1)
SELECT contig, sum(e - s) / length AS average, median, count(*) AS reads, length FROM spans JOIN m USING (contig) JOIN lens USING (contig) GROUP BY contig, median, length""",
    "cov_average": "SELECT sseqid, sum(abs(q_start - q_end) + 1) / max(sbj_len) AS average, count(*) AS reads, max(sbj_len) AS length FROM (SELECT DISTINCT * EXCLUDE (loaded_at) FROM a_mg_cds_go) WHERE sseqid IS NOT NULL AND q_start IS NOT NULL AND q_end IS NOT NULL GROUP BY 1",
    "cov_zip": _BASE
    + """, s AS (SELECT contig, sum(n * depth) / sum(n) AS mean, sum(n * depth * depth) / sum(n) AS q FROM hist GROUP BY 1), v AS (SELECT contig, mean, q - mean * mean AS variance FROM s),
c AS (SELECT *, sum(n) OVER (PARTITION BY contig ORDER BY depth) AS cum, sum(n) OVER (PARTITION BY contig) AS total FROM hist), m AS (SELECT contig, min(depth) AS median FROM c WHERE cum > floor((total - 1) / 2) GROUP BY 1),
c2 AS (SELECT *, sum(n) OVER (PARTITION BY contig ORDER BY depth) AS cum, sum(n) OVER (PARTITION BY contig) AS total FROM hist WHERE depth > 0), m2 AS (SELECT contig, min(depth) AS median_covered FROM c2 WHERE cum > floor((total - 1) / 2) GROUP BY 1)
SELECT contig, median, median_covered, mean, variance, CASE WHEN variance > mean THEN mean + variance / mean - 1 ELSE mean END AS lam, CASE WHEN variance > mean THEN 1 - mean / (mean + variance / mean - 1) ELSE 0 END AS pi FROM v JOIN m USING (contig) LEFT JOIN m2 USING (contig)""",
    "catsbj_offsets": _OFF + 'SELECT id, off + 1 AS start, off + length + 1 AS "end" FROM off',
    "catsbj_hits": _HITS + 'SELECT hit_id, start, e AS "end", pident, bitscore, read, corr AS corr_identity FROM cat',
    "cov_window": _OFF
    + """, r AS (SELECT s + off AS s, e + off AS e, depth FROM runs JOIN off ON id = contig),
x AS (SELECT *, unnest(generate_series(s // 1000, (e - 1) // 1000)) AS win FROM r)
SELECT win AS "window", sum((least(e, (win + 1) * 1000) - greatest(s, win * 1000)) * depth) / 1000 AS depth FROM x WHERE win < (SELECT max(e) // 1000 FROM r) GROUP BY 1""",
    "gff_gaps": """
WITH f AS (SELECT DISTINCT sseqid AS seqid, least(s_start, s_end) AS s, greatest(s_start, s_end) AS e FROM a_mg_reads_cds WHERE sseqid IS NOT NULL AND s_start IS NOT NULL AND s_end IS NOT NULL),
t AS (SELECT *, max(e) OVER (PARTITION BY seqid ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM f)
SELECT seqid, s AS start, e AS "end", 'FEAT' AS kind FROM f UNION ALL SELECT seqid, top + 1, s - 1, 'GAP' FROM t WHERE s > top + 1""",
    "overlap_counts": _BASE + ", pr AS (SELECT contig, unnest(generate_series(1, length, 400)) AS start FROM lens) SELECT pr.contig, start, count(*) AS n FROM pr JOIN spans ON spans.contig = pr.contig AND s + 1 <= start + 39 AND start <= e GROUP BY ALL",
    "recplot_counts": _CELLS + f"SELECT pos_bin, id_bin, n, {_MID} > 95 AS in_group FROM cells",
    "recplot_depth": _CELLS + f"SELECT pos_bin, sum(n) / 1000 AS depth FROM cells WHERE {_MID} > 95 GROUP BY 1",
    "recplot_cutoff": _CELLS + f"SELECT pos_bin, sum(n) / 1000 AS depth FROM cells WHERE NOT {_MID} > 98 GROUP BY 1",
    "recplot_anir": _CELLS + f"SELECT sum({_MID} * n) / sum(n) AS anir FROM cells WHERE {_MID} BETWEEN 95 AND 100",
    "recplot_compare": _CELLS
    + """, h AS (SELECT id_bin, coalesce(sum(n) FILTER (pos_bin % 2 = 0), 0) + 1 AS a, coalesce(sum(n) FILTER (pos_bin % 2 = 1), 0) + 1 AS b FROM cells GROUP BY 1),
q AS (SELECT a / (SELECT sum(a) FROM h) AS p, b / (SELECT sum(b) FROM h) AS q FROM h)
SELECT sqrt(sum((sqrt(p) - sqrt(q)) ** 2)) / sqrt(2) AS hellinger, 1 - sum((sqrt(p) - sqrt(q)) ** 2) / 2 AS bhattacharyya, sum(p * ln(p / q)) AS kl, sqrt(sum((p - q) ** 2)) AS euclidean FROM q""",
    "recplot_coordinates": _CELLS
    + """, lim AS (SELECT id, off + 1 AS a, off + length + 1 AS b FROM off), s AS (SELECT *, unnest(generate_series(a // 1000, (b - 1) // 1000)) AS pos_bin FROM lim)
SELECT pos_bin, id, greatest(a, pos_bin * 1000) - a + 1 AS start, least(b - 1, (pos_bin + 1) * 1000 - 1) - a + 1 AS "end" FROM s WHERE pos_bin IN (SELECT pos_bin FROM cells)""",
    "recplot_windows": _CELLS
    + f", w AS (SELECT pos_bin, sum(n) / 1000 AS depth FROM cells WHERE {_MID} > 95 GROUP BY 1) SELECT * FROM w WHERE depth < (SELECT exp(avg(ln(depth)) - 1.2815515655446004 * stddev_pop(ln(depth))) FROM w WHERE depth > 0)",
    "recplot_equal": _RECS
    + """, b AS (SELECT i AS pos_bin, mn + (mx - mn) * i / 200 AS low, mn + (mx - mn) * (i + 1) / 200 AS high FROM (SELECT unnest(generate_series(0, 199)) AS i) CROSS JOIN (SELECT CAST(min(a) AS double) AS mn, CAST(max(b) AS double) AS mx FROM lim)),"""
    + _ANY.format(n=60)
    + "SELECT pos_bin, id_bin, n, 70 + (id_bin + 0.5) * 0.5 > 95 AS in_group FROM c",
    "recplot_sequences": _RECS
    + """, b AS (SELECT row_number() OVER (ORDER BY a) - 1 AS pos_bin, coalesce(lag(b) OVER (ORDER BY a), a) AS low, b AS high FROM lim),"""
    + _ANY.format(n=60)
    + "SELECT pos_bin, coalesce(sum(n) FILTER (70 + (id_bin + 0.5) * 0.5 > 95), 0) / (high - low) AS depth FROM b LEFT JOIN c USING (pos_bin) GROUP BY pos_bin, high, low",
    "recplot_table": _RECS
    + """, b AS (SELECT n_nationkey - 1 AS pos_bin, 1 + (n_nationkey - 1) * (n_nationkey - 1) * 37.5::double AS low, 1 + n_nationkey * n_nationkey * 37.5::double AS high, n_name AS name FROM nation WHERE n_nationkey > 0),"""
    + _ANY.format(n=30)
    + "SELECT pos_bin, id_bin, n, 70 + (id_bin + 0.5) * 1.0 > 95 AS in_group, name FROM c JOIN b USING (pos_bin)",
    "gff_breaks": _OFF
    + """, f AS (SELECT hit_id AS rid, min(sseqid) AS seqid, min(least(s_start, s_end)) AS s, max(greatest(s_start, s_end)) AS e FROM reads WHERE sseqid IS NOT NULL AND s_start IS NOT NULL AND s_end IS NOT NULL GROUP BY 1),
ft AS (SELECT rid, off + s + 1 AS s, off + e + 1 AS e, 'f' || rid AS name FROM f JOIN off ON id = seqid),
p AS (SELECT *, coalesce(lag(e) OVER (ORDER BY rid), 1) AS came, coalesce(lag(name) OVER (ORDER BY rid), 'NA') AS called FROM ft), t AS (SELECT max(off + length + 1) AS total FROM off)
SELECT -1 AS rid, 1 AS "end", 'NA' AS name, 'NA' AS kind UNION ALL SELECT rid, e, name, 'FEAT' FROM ft UNION ALL SELECT rid, s, called || '~' || name, 'GAP' FROM p WHERE s > came
UNION ALL SELECT rid, total, name || '~NA', 'GAP' FROM (SELECT * FROM ft ORDER BY rid DESC LIMIT 1) CROSS JOIN t WHERE e <> total""",
    "anir": "SELECT avg(pident) AS anir, count(*) AS reads FROM (SELECT DISTINCT * EXCLUDE (loaded_at) FROM a_mg_reads_cds) WHERE pident >= 95",
    "anir_histogram": "SELECT 100 - (k + 1) AS lower, 100 - k AS upper, count(*) AS n FROM (SELECT CAST(floor(100 - pident) AS int) AS k FROM (SELECT DISTINCT * EXCLUDE (loaded_at) FROM a_mg_reads_cds) WHERE pident IS NOT NULL) GROUP BY 1, 2",
}
