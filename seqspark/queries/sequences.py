"""Queries of the sequence operators, with message texts as sequences and their characters as qualities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sequences as S
from . import table


def _seq(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("rid"), F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("id"), F.concat_ws(" ", F.concat(F.lit("s"), F.col("doc_id").cast("string")), "source").alias("defline"), F.col("text").alias("seq"))


def _dna(spark, d):
    """Sequences of the four bases, made from part names' keys."""
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("rid"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("defline"), F.translate(F.concat(F.md5(F.col("p_partkey").cast("string")), F.md5(F.col("p_size").cast("string"))), "0123456789abcdef", "ACGTACGTACGTACGN").alias("seq"))


def _fastq(spark, d):
    return _dna(spark, d).select("rid", "id", "defline", "seq", F.lit("").alias("plus"), F.concat(F.md5(F.col("id")), F.md5("defline")).alias("qual"))


def seq_length(spark, d):
    return S.lengths(_seq(spark, d)).select("id", "length")


def seq_gc(spark, d):
    return S.gc(_seq(spark, d))


def seq_n50(spark, d):
    return S.n50(S.lengths(_seq(spark, d)), 100, compat=True)


def seq_n90(spark, d):
    return S.n50(S.lengths(_seq(spark, d)), 0, 90)


def seq_qlen(spark, d):
    return S.length_quantiles(S.lengths(_seq(spark, d)))


def seq_filter_len(spark, d):
    return S.filter_length(_seq(spark, d), 1500).select("id")


def seq_filter_n(spark, d):
    return S.filter_ambiguous(_dna(spark, d), 0.06, 4).select("id")


def seq_revcom(spark, d):
    return _dna(spark, d).select("id", S.reverse_complement(F.col("seq")).alias("seq"))


def seq_extract(spark, d):
    coords = spark.createDataFrame([("*", 1, 5, 24), ("*", 2, -10, -1), ("p7", 3, 2, 9)], "id string, i int, `from` int, `to` int")
    return S.extract(_dna(spark, d), coords)


def seq_mask(spark, d):
    r = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), (F.col("p_partkey") % 40 + 1).alias("from"), (F.col("p_partkey") % 40 + 1 + F.col("p_size") % 9).alias("to")).filter("p_partkey % 3 = 0")
    return S.mask(_dna(spark, d), r, trim=True).select("id", "seq")


def seq_rename(spark, d):
    m = table(spark, d, "part").filter("p_partkey % 2 = 0").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("old"), F.concat(F.lit("new"), F.col("p_size").cast("string")).alias("new"))
    return S.rename(_dna(spark, d), m).select("rid", "id")


def seq_tag(spark, d):
    return S.tag(_seq(spark, d), "x", "_y").select("rid", "id")


def seq_tag_list(spark, d):
    names = table(spark, d, "customer").select((F.col("c_custkey") * 3).alias("rid"), F.concat(F.lit("n"), F.col("c_custkey").cast("string")).alias("name"))
    return S.tag_from_list(_seq(spark, d), names).select("rid", "id")


def seq_split_rr(spark, d):
    return S.split_round_robin(_seq(spark, d), 12, "padded").select("rid", "part")


def seq_interpose(spark, d):
    a = _dna(spark, d).select("rid", F.concat("id", F.lit("/1")).alias("id"), "seq")
    b = _dna(spark, d).select("rid", F.concat("id", F.lit("/2")).alias("id"), F.reverse("seq").alias("seq"))
    return S.interpose([a, b]).select("rid", "file", "id", "seq")


def seq_slide(spark, d):
    return S.slide(_dna(spark, d), 18, 6)


def seq_slide_strict(spark, d):
    return S.slide(_dna(spark, d), 32, 8, strict=True)


def seq_to_fastq(spark, d):
    return S.to_fastq(_seq(spark, d)).select("id", "seq", "qual")


def seq_wrap(spark, d):
    return _dna(spark, d).select("id", S.wrap(F.col("seq"), 20).alias("text"))


def seq_concatenate(spark, d):
    a = _dna(spark, d).select((F.col("rid") % 3).alias("file"), F.concat(F.lit("g"), F.floor(F.col("rid") / 3) % 400).alias("id"), "seq")
    return S.concatenate_alignments(a.groupBy("file", "id").agg(F.min("seq").alias("seq")), undefined="-")


def seq_variable_columns(spark, d):
    return S.concatenate_alignments(_dna(spark, d).select(F.lit(1).alias("file"), "id", F.concat(F.lit("AAC"), "seq").alias("seq")), drop_invariable=True)


def seq_partitions(spark, d):
    return S.alignment_partitions(_dna(spark, d).select((F.col("rid") % 4).alias("file"), "id", "seq"))


def fastq_mask(spark, d):
    return S.mask_quality(_fastq(spark, d), 20).select("id", "seq")


def fastq_offset(spark, d):
    return S.quality_offset(_fastq(spark, d))


def fastq_recode(spark, d):
    return S.recode_quality(_fastq(spark, d), 33, 64, force=True).select("id", "qual")


def fastq_expected_error(spark, d):
    return S.expected_errors(_fastq(spark, d))


def fastq_observed_error(spark, d):
    h = table(spark, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("qseqid"), F.col("l_linenumber").cast("int").alias("mismatch"), F.lit(1).alias("q_start"), F.col("l_quantity").cast("int").alias("q_end"), F.lit(3).alias("s_start"), (F.col("l_quantity").cast("int") + F.col("l_linenumber")).alias("s_end"), (F.col("l_quantity").cast("int") + 8).alias("length")).distinct()
    return S.observed_errors(_fastq(spark, d), h)


def _known(spark, d, drawn):
    """Size of a draw, its number of records, and of those that are in the source."""
    ids = _seq(spark, d).select("id").distinct()
    return drawn.agg(F.count(F.lit(1)).alias("n")).crossJoin(drawn.select("id").distinct().join(ids, "id").agg(F.count(F.lit(1)).alias("known")))  # one row each


def seq_sample(spark, d):
    return S.sample_exact(_seq(spark, d), fraction=0.1).select("id")


def seq_sample_holds(spark, d):
    """A tenth of the records comes out, each once and each from the source."""
    return _known(spark, d, seq_sample(spark, d))


def seq_sample_all(spark, d):
    """A sample as large as the source is the source."""
    r = _seq(spark, d)
    return S.sample_exact(r, fraction=1.0).select("id")


def seq_sample_replace(spark, d):
    return S.sample_exact(_seq(spark, d), n=100, replace=True).select("id")


def seq_sample_replace_holds(spark, d):
    return seq_sample_replace(spark, d).join(_seq(spark, d).select("id"), "id").agg(F.count(F.lit(1)).alias("n"))


def seq_subsample(spark, d):
    return S.subsample(_seq(spark, d), [10, 20], 2).select("id", "percent", "replicate")


def seq_subsample_holds(spark, d):
    """No record twice in a draw; a draw of 100 % has all, one of 0 % none."""
    x = S.subsample(_seq(spark, d), [0, 50, 100], 2)
    each = x.groupBy("percent", "replicate", "id").count().groupBy("percent", "replicate").agg(F.max("count").alias("times"), F.count(F.lit(1)).alias("n"))
    return each.select("percent", "replicate", "times", F.when(F.col("percent") == 100, F.col("n")).alias("n"))


def seq_fragment(spark, d):
    return S.fragment(_seq(spark, d), 0.8, 200)


def seq_fragment_holds(spark, d):
    """Fragments are pieces of their sequence, of 200 letters at least, and of no more letters together than it has."""
    f = seq_fragment(spark, d).select(F.substring_index("id", ":", 1).alias("id"), F.col("seq").alias("piece"))
    j = f.join(_seq(spark, d).select("id", "seq"), "id").groupBy("id").agg(F.min(F.col("seq").contains(F.col("piece"))).alias("inside"), F.min(F.length("piece") >= 200).alias("long"), (F.sum(F.length("piece")) <= F.max(F.length("seq"))).alias("fits"))
    return j.select("inside", "long", "fits").distinct()


def seq_simulate(spark, d):
    return S.simulate_pairs(_dna(spark, d), 2, 20, 50, 5)


def seq_simulate_holds(spark, d):
    """Pairs of a genome cover it twice, with mates of 20 bases; without errors each mate is a piece of its circle."""
    g = _dna(spark, d).select("id", F.concat("seq", "seq", "seq").alias("circle"))
    m = S.simulate_pairs(_dna(spark, d), 2, 20, 50, 5, error=0).withColumn("id", F.substring_index("id", "_", 1))
    return m.join(g, "id").groupBy("id", "mate").agg(F.count(F.lit(1)).alias("n"), F.min(F.length("seq") == 20).alias("whole"), F.min(F.col("circle").contains(F.col("seq"))).alias("inside"))


def seq_simulate_errors(spark, d):
    """At an error rate of 1 no base stays, and each of the three others takes its place."""
    a = S.simulate_pairs(_dna(spark, d), 2, 20, 50, 5, error=0).withColumnRenamed("seq", "x")
    b = S.simulate_pairs(_dna(spark, d), 2, 20, 50, 5, error=1).withColumnRenamed("seq", "y")
    # Spark sizes the mates as if each genome had one, so it may broadcast all of them unless told to merge
    j = a.join(b.hint("merge"), ["id", "mate"]).select(F.explode(F.arrays_zip(F.split("x", "").alias("x"), F.split("y", "").alias("y"))).alias("p"))
    return j.filter("p.x <> 'N' and p.x <> ''").select("p.x", "p.y").distinct()


QUERIES = {f.__name__: f for f in (seq_length, seq_gc, seq_n50, seq_n90, seq_qlen, seq_filter_len, seq_filter_n, seq_revcom, seq_extract, seq_mask, seq_rename, seq_tag, seq_tag_list, seq_split_rr, seq_interpose, seq_slide, seq_slide_strict, seq_to_fastq, seq_wrap, seq_concatenate, seq_variable_columns, seq_partitions, fastq_mask, fastq_offset, fastq_recode, fastq_expected_error, fastq_observed_error, seq_sample, seq_sample_holds, seq_sample_all, seq_sample_replace, seq_sample_replace_holds, seq_subsample, seq_subsample_holds, seq_fragment, seq_fragment_holds, seq_simulate, seq_simulate_holds, seq_simulate_errors)}

_DNA = "dna AS (SELECT p_partkey AS rid, 'p' || p_partkey AS id, translate(md5(CAST(p_partkey AS varchar)) || md5(CAST(p_size AS varchar)), '0123456789abcdef', 'ACGTACGTACGTACGN') AS seq FROM part)"
_FQ = _DNA + ", fq AS (SELECT *, md5(id) || md5(id) AS qual FROM dna)"
_LEN = "l AS (SELECT doc_id, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS len FROM documents)"
_NX = """WITH {l}, c AS (SELECT len, sum(len) OVER (ORDER BY len {dir}, doc_id) AS cum FROM l WHERE len >= {least})
SELECT {pick}(CASE WHEN cum >= (SELECT sum(len) FROM l WHERE len >= {least}) * {x} / 100 THEN len END) AS nx, count(*) AS n, sum(len) AS total, max(len) AS longest FROM c"""
_Q = ", ".join(f"(s[CAST(floor((n - 1) * {q} / 4) AS int) + 1] + s[CAST(ceil((n - 1) * {q} / 4) AS int) + 1]) / 2 AS q{q}" for q in range(5))
_P = "pow(10.0, -(ord(c) - 33) / 10.0)"
SQL = {
    "seq_length": f"WITH {_LEN} SELECT 's' || doc_id AS id, len AS length FROM l",
    "seq_gc": "SELECT 's' || doc_id AS id, length(regexp_replace(text, '[^GCgc]', '', 'g')) / length(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS gc FROM documents WHERE length(regexp_replace(text, '[^ACGTacgt]', '', 'g')) > 0",
    "seq_n50": _NX.format(l=_LEN, dir="", least=100, x=50, pick="min"),
    "seq_n90": _NX.format(l=_LEN, dir="DESC", least=0, x=90, pick="max"),
    "seq_qlen": f"WITH {_LEN}, g AS (SELECT list(len ORDER BY len) AS s, count(*) AS n, sum(len) AS total FROM l) SELECT {_Q}, n, total, total / n AS average FROM g",
    "seq_filter_len": f"WITH {_LEN} SELECT 's' || doc_id AS id FROM l WHERE len >= 1500",
    "seq_filter_n": f"WITH {_DNA} SELECT id FROM dna WHERE length(regexp_replace(seq, '[^N]', '', 'g')) <= length(seq) * 0.06 AND NOT regexp_matches(seq, 'A{{4}}|C{{4}}|T{{4}}|G{{4}}|N{{4}}')",
    "seq_revcom": f"WITH {_DNA} SELECT id, reverse(translate(seq, 'ACGT', 'TGCA')) AS seq FROM dna",
    "seq_extract": f"WITH {_DNA} SELECT id || ':1' AS id, seq[5:24] AS seq FROM dna UNION ALL SELECT id || ':2', right(seq, 10) FROM dna UNION ALL SELECT id || ':3', seq[2:9] FROM dna WHERE id = 'p7'",
    "seq_mask": f"WITH {_DNA}, m AS (SELECT id, p_partkey % 40 + 1 AS a, p_partkey % 40 + 1 + p_size % 9 AS b, seq FROM dna JOIN part ON p_partkey = rid) SELECT id, regexp_replace(CASE WHEN CAST(id[2:] AS int) % 3 = 0 THEN left(seq, a - 1) || repeat('N', b - a + 1) || seq[b + 1:] ELSE seq END, '^N+|N+$', '', 'g') AS seq FROM m",
    "seq_rename": "SELECT p_partkey AS rid, CASE WHEN p_partkey % 2 = 0 THEN 'new' || p_size ELSE 'p' || p_partkey END AS id FROM part",
    "seq_tag": "SELECT doc_id AS rid, 'x' || row_number() OVER (ORDER BY doc_id) || '_y' AS id FROM documents",
    "seq_tag_list": "WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k FROM documents), c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS k FROM customer) SELECT doc_id AS rid, 'n' || c_custkey AS id FROM d LEFT JOIN c USING (k)",
    "seq_split_rr": "SELECT doc_id AS rid, lpad(CAST((row_number() OVER (ORDER BY doc_id) - 1) % 12 + 1 AS varchar), 2, '0') AS part FROM documents",
    "seq_interpose": f"WITH {_DNA} SELECT rid + 1 AS rid, 0 AS file, id || '/1' AS id, seq FROM dna UNION ALL SELECT rid + 1, 1, id || '/2', reverse(seq) FROM dna",
    "seq_slide": f"WITH {_DNA}, x AS (SELECT id, seq, unnest(generate_series(0, length(seq) - 18, 6)) AS start FROM dna) SELECT id, start, seq[start + 1:start + 18] AS seq FROM x",
    "seq_slide_strict": f"WITH {_DNA}, x AS (SELECT id, seq, unnest(generate_series(0, length(seq) - 33, 8)) AS start FROM dna) SELECT id, start, seq[start + 1:start + 32] AS seq FROM x WHERE NOT regexp_full_match(seq[start + 1:start + 32], 'N*')",
    "seq_to_fastq": "SELECT 's' || doc_id AS id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq, repeat('@', length(regexp_replace(text, '[^A-Za-z]', '', 'g'))) AS qual FROM documents WHERE length(regexp_replace(text, '[^A-Za-z]', '', 'g')) > 0",
    "seq_wrap": f"WITH {_DNA} SELECT id, seq[1:20] || chr(10) || seq[21:40] || chr(10) || seq[41:60] || chr(10) || seq[61:64] AS text FROM dna",
    "seq_concatenate": f"WITH {_DNA}, a AS (SELECT rid % 3 AS f, 'g' || ((rid // 3) % 400) AS id, min(seq) AS seq FROM dna GROUP BY ALL), i AS (SELECT DISTINCT id FROM a) SELECT i.id, string_agg(coalesce(a.seq, repeat('-', 64)), '' ORDER BY k.f) AS seq FROM i CROSS JOIN (SELECT DISTINCT f FROM a) AS k LEFT JOIN a ON a.id = i.id AND a.f = k.f GROUP BY i.id",
    "seq_variable_columns": f"WITH {_DNA}, a AS (SELECT id, 'AAC' || seq AS seq FROM dna), c AS (SELECT id, unnest(generate_series(1, 67)) AS p, seq FROM a), v AS (SELECT p FROM c WHERE seq[p] <> '-' GROUP BY p HAVING count(DISTINCT seq[p]) > 1) SELECT id, string_agg(seq[p], '' ORDER BY p) AS seq FROM c WHERE p IN (SELECT p FROM v) GROUP BY id",
    "seq_partitions": f'WITH {_DNA}, s AS (SELECT rid % 4 AS file, max(length(seq)) AS n FROM dna GROUP BY 1) SELECT file, sum(n) OVER (ORDER BY file) - n + 1 AS "from", sum(n) OVER (ORDER BY file) AS "to" FROM s',
    "fastq_mask": f"WITH {_FQ}, c AS (SELECT id, seq, qual, unnest(generate_series(1, 64)) AS i FROM fq) SELECT id, string_agg(CASE WHEN ord(qual[i]) - 33 < 20 THEN 'N' ELSE seq[i] END, '' ORDER BY i) AS seq FROM c GROUP BY id",
    "fastq_offset": f"WITH {_FQ}, c AS (SELECT ord(unnest(string_split(qual, ''))) AS c FROM fq) SELECT CASE WHEN min(c) < 55 THEN 33 WHEN max(c) > 80 THEN 64 END AS offset FROM c",
    "fastq_recode": f"WITH {_FQ}, c AS (SELECT id, qual, unnest(generate_series(1, 64)) AS i FROM fq) SELECT id, string_agg(chr(least(ord(qual[i]) - 33, 62) + 64), '' ORDER BY i) AS qual FROM c GROUP BY id",
    "fastq_expected_error": f"WITH {_FQ}, c AS (SELECT id, unnest(string_split(qual, '')) AS c FROM fq) SELECT id, sum({_P}) AS mu, sum({_P} * (1 - {_P})) AS var FROM c GROUP BY id",
    "fastq_observed_error": f"WITH {_FQ}, c AS (SELECT id, unnest(string_split(qual, '')) AS c FROM fq), e AS (SELECT id, sum({_P}) AS mu, sum({_P} * (1 - {_P})) AS var FROM c GROUP BY id), h AS (SELECT DISTINCT 'p' || l_partkey AS q, CAST(l_linenumber AS int) AS m, CAST(floor(l_quantity) AS int) AS qe FROM lineitem) SELECT id, mu, var, m AS subs, qe + 8 - (abs(qe + m - 3) + 1) AS ins, 8 AS del FROM e JOIN h ON q = id".replace("8 AS del", "qe + 8 - qe AS del"),
    "seq_sample_holds": "SELECT CAST(round(count(*) * 0.1) AS bigint) AS n, CAST(round(count(*) * 0.1) AS bigint) AS known FROM documents",
    "seq_sample_all": "SELECT 's' || doc_id AS id FROM documents",
    "seq_sample_replace_holds": "SELECT 100 AS n",
    "seq_subsample_holds": "SELECT p AS percent, r AS replicate, 1 AS times, CASE WHEN p = 100 THEN (SELECT count(*) FROM documents) END AS n FROM (SELECT unnest([50.0::double, 100.0::double]) AS p) CROSS JOIN (SELECT unnest([1, 2]) AS r)",
    "seq_fragment_holds": "SELECT true AS inside, true AS long, true AS fits",
    "seq_simulate_holds": f"WITH {_DNA} SELECT id, m AS mate, CAST(ceil(length(seq) * 2 / 40) AS bigint) AS n, true AS whole, true AS inside FROM dna CROSS JOIN (SELECT unnest([1, 2]) AS m)",
    "seq_simulate_errors": "SELECT a AS x, b AS y FROM (SELECT unnest(['A', 'C', 'G', 'T']) AS a) CROSS JOIN (SELECT unnest(['A', 'C', 'G', 'T']) AS b) WHERE a <> b",
}
