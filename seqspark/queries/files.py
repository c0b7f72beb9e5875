"""Queries of the readers and writers: a test table is written as text to the shared folder, in several files, and read back."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import ranges as G
from ..operators import hits as H
from ..operators import models as M
from ..operators import orthology as O
from ..operators import sequences as S
from ..operators import statistics as Q
from ..operators import trees as T
from ..operators.coverage import depth_runs
from ..operators.diversity import lineage_counts
from ..plans.scratch import new_path
from ..sources import catalog
from ..sources import readers as R
from ..sources import writers as W
from ..streaming.hits import stream_sum_per_hit, stream_windows
from . import table
from .coverage import _BASE, _HITS, _spans, catsbj_hits, catsbj_offsets
from .groups import _OG, _TIPS, _newick, _og, og_matrix
from .hits import _GO, _READS, _taxonomy, go, reads
from .models import _ALN, _aligned, _model_hits, _models
from .models import _HITS as _MODEL_HITS
from .sequences import _DNA, _FQ, _dna, _fastq


def _put(spark, lines, name, parts=5):
    """A frame's column ``value`` as text, in its order, in several files."""
    path = new_path(spark, name)
    lines.coalesce(parts).write.text(path)
    return path


def _sorted(df, by="rid"):
    return df.repartitionByRange(5, by).sortWithinPartitions(by)


# -- sequences


def file_fasta(spark, d):
    path = new_path(spark, "fasta")
    W.write_fasta(_dna(spark, d).withColumn("defline", F.concat_ws(" ", "id", "rid")), path, 20)
    return R.read_fasta(spark, path).select("id", "defline", "seq")


def file_fasta_gz(spark, d):
    """Compressed files, numbered in the order of the files and of the records in each."""
    path = new_path(spark, "fasta")
    W.write_fasta(_sorted(_dna(spark, d)), path, 0, "gzip")
    return S.numbered(R.read_fasta(spark, path)).select("number", "id", "seq")


def file_fasta_splits(spark, d):
    """One file that is read in many splits keeps its order."""
    path = new_path(spark, "fasta")
    W.write_fasta(_sorted(_dna(spark, d)).coalesce(1), path, 10)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        n = S.numbered(R.read_fasta(spark, path)).select("number", "id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    return spark.createDataFrame(n, "number long, id string")


def file_fastq(spark, d):
    path = new_path(spark, "fastq")
    W.write_fastq(_fastq(spark, d), path)
    return R.read_fastq(spark, path).select("id", "seq", "qual")


def file_fastq_order(spark, d):
    path = new_path(spark, "fastq")
    W.write_fastq(_sorted(_fastq(spark, d)), path)
    return S.numbered(R.read_fastq(spark, path)).select("number", "id")


def file_interpose(spark, d):
    """Two files of reads in step, each read in several partitions."""
    one, two = new_path(spark, "reads1"), new_path(spark, "reads2")
    f = _sorted(_fastq(spark, d)).withColumn("defline", F.col("id"))
    W.write_fastq(f.withColumn("defline", F.concat("id", F.lit("/1"))), one)
    W.write_fastq(f.withColumn("defline", F.concat("id", F.lit("/2"))).withColumn("seq", F.reverse("seq")), two)
    return S.interpose([R.read_fastq(spark, one), R.read_fastq(spark, two)]).select("rid", "file", "id", "seq")


def file_parts(spark, d):
    """Reads dealt to files in turn, and read back with the part they are in."""
    path = new_path(spark, "parts")
    W.write_parts(S.split_round_robin(_fastq(spark, d), 4, "letters"), path, "part")
    out = None
    for part in "ABCD":
        one = R.read_fastq(spark, f"{path}/part={part}").select(F.lit(part).alias("part"), "id", "qual")
        out = one if out is None else out.unionByName(one)
    return out


def seq_to_fasta(spark, d):
    return S.to_fasta(_fastq(spark, d))


def fastq_tag(spark, d):
    return S.tag(_fastq(spark, d), "r", "").select("rid", "id", "qual")


def fastq_filter(spark, d):
    ids = table(spark, d, "orders").select(F.concat(F.lit("@p"), F.col("o_custkey").cast("string")).alias("k"))
    return H.filter_any_key(_fastq(spark, d), ids, [F.col("id"), F.concat(F.lit("@"), "defline")], "k").select("id", "qual")


def file_alignments(spark, d):
    a = _dna(spark, d).select("id", "seq")
    out = None
    for form in ("fasta", "stockholm", "clustal", "phylip", "nexus"):
        path = new_path(spark, form)
        W.write_alignment(a, path, form)
        one = R.read_alignment(spark, path, form).select(F.lit(form).alias("form"), "id", "seq")
        out = one if out is None else out.unionByName(one)
    return out


def seq_partition_lines(spark, d):
    p = S.alignment_partitions(_dna(spark, d).select((F.col("rid") % 4).alias("file"), "id", "seq"))
    return S.partition_lines(p, "DNA/3").unionByName(S.partition_lines(p, "GTR"))


def seq_slide_errors(spark, d):
    """Windows of 18 letters, give or take two, at each sixth place."""
    w = S.slide(_dna(spark, d), 18, 6, lerr=2)
    n = F.length("seq")
    return w.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min((n >= 16) & ((n < 20) | (F.col("start") + n >= 64))).alias("near"))


# -- hits and coverage


def file_hits(spark, d):
    path = new_path(spark, "hits")
    c = "qseqid sseqid pident length mismatch gapopen q_start q_end s_start s_end evalue bitscore qry_len sbj_len".split()
    W.write_table(go(spark, d).filter("qseqid is not null and sseqid is not null and not isnan(bitscore)").select(*c), path, header=False)
    return R.read_hits(spark, path).select("qseqid", "sseqid", "pident", "length", "s_end", "evalue", "bitscore", "qry_len", "sbj_len")


def file_hits_few(spark, d):
    """Twelve columns and a comment: the lengths are null."""
    path = new_path(spark, "hits")
    W.write_table(reads(spark, d).filter("sseqid is not null").select("qseqid", "sseqid", "pident", "length", "mismatch", "gapopen", "q_start", "q_end", "s_start", "s_end", "evalue", "bitscore"), path, header=False)
    return R.read_hits(spark, path).groupBy("sseqid").agg(F.count(F.lit(1)).alias("n"), F.count("qry_len").alias("with_length"), F.max("bitscore").alias("best"))


def file_rbm(spark, d):
    path = new_path(spark, "rbm")
    m = table(spark, d, "rbm").dropna(subset=["seq1", "seq2", "id1", "id2", "id"])
    m.select(F.concat("seq1", F.lit("-"), "seq2", F.lit(".rbm")).alias("pair"), F.concat_ws("\t", "id1", "id2", "id", *[F.lit("1")] * 7, F.coalesce("evalue", F.lit(0.0)), F.coalesce("bitscore", F.lit(0.0))).alias("value")).write.partitionBy("pair").text(path)
    return R.read_rbm(spark, path, r"pair=([^/\s]+)-([^/\s]+)\.rbm").select("genome1", "gene1", "genome2", "gene2", "pident")


def file_bedgraph(spark, d):
    path = new_path(spark, "bedgraph")
    W.write_table(depth_runs(_spans(spark, d)).select("contig", "start", "end", "depth"), path, header=False)
    return R.read_bedgraph(spark, path)


def file_gff(spark, d):
    s = _spans(spark, d)
    line = F.concat_ws("\t", "contig", F.lit("x\tCDS"), F.col("start") + 1, "end", F.lit(".\t+\t0"), F.concat(F.lit("ID=g"), "hit_id", F.lit(";note=n")))
    return R.read_gff(spark, _put(spark, s.select(line.alias("value")), "gff"), "gff3").select("seqid", "start", "end", "gene")


def file_rec_lim(spark, d):
    """Hits and limits in concatenated coordinates, written and read as the two files of a recruitment plot."""
    rec, lim = new_path(spark, "rec"), new_path(spark, "lim")
    W.write_table(catsbj_hits(spark, d).select("start", "end", "pident", "bitscore", "read", "corr_identity"), rec, header=False)
    W.write_table(catsbj_offsets(spark, d), lim, header=False)
    r, m = R.read_rec(spark, rec), R.read_lim(spark, lim)
    return r.agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("s"), F.sum("end").alias("e")).crossJoin(m.agg(F.max("end").alias("total"), F.count(F.lit(1)).alias("sequences")))  # one row each


def file_identities(spark, d):
    path = new_path(spark, "aai")
    m = table(spark, d, "rbm").filter("seq1 is not null and seq2 is not null and id is not null")
    W.write_table(m.select(F.col("seq1").alias("SeqA"), F.col("seq2").alias("SeqB"), F.col("id").alias("AAI"), F.lit(1.5).alias("SD"), F.lit(7).alias("N"), F.lit(9).alias("Omega"), F.lit(77.0).alias("Frx")), path)
    return R.read_identities(spark, path).groupBy("SeqA", "SeqB").agg(F.max("AAI").alias("most"), F.sum("N").alias("n"))


def file_vcf(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("q"))
    info = F.concat(F.lit("DP4=1,"), F.col("q"), F.lit(",2,"), F.col("l_linenumber"), F.when(F.col("l_linenumber") == 1, ";INDEL").otherwise(""))
    line = F.concat_ws("\t", F.concat(F.lit("c"), F.col("l_orderkey")), "l_partkey", F.lit(".\tA\tG"), F.col("l_linenumber") * 10, F.lit("PASS"), F.when(F.col("q") % 2 == 0, info).otherwise(F.lit("X=1")), F.lit("GT:AD"), F.concat(F.lit("0/1:"), F.col("q"), F.lit(",5")))
    v = R.read_vcf(spark, _put(spark, li.select(line.alias("value")), "vcf"))
    again = R.read_vcf(spark, _put(spark, v.select(R.vcf_line(v).alias("value")), "vcf"))
    return again.select("chrom", "pos", "qual", "indel", "ref_dp", "alt_dp")


def file_sam(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size")
    line = F.concat_ws("\t", F.concat(F.lit("r"), "p_partkey"), F.lit("0"), F.when(F.col("p_size") % 5 == 0, "*").otherwise(F.concat(F.lit("c"), F.col("p_size") % 7)), F.lit("1\t9\t20M\t*\t0\t0\tACGTACGTACGTACGTACGT\tIIIIIIIIIIIIIIIIIIII"), F.concat(F.lit("MD:Z:5"), F.repeat(F.lit("A0"), (F.col("p_size") % 4).cast("int")), F.lit("5")), F.concat(F.lit("YT:Z:"), F.when(F.col("p_partkey") % 3 == 0, "UP").otherwise("CP")))
    sam = R.read_sam(spark, _put(spark, p.select(line.alias("value")), "sam"))
    return R.filter_sam(sam, spark.range(1, 5).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("id")), 90).select("qname", "rname", "pident")


def anir_threshold(spark, d):
    """The threshold found in the identities: the fixed one, as they have one peak."""
    t = Q.identity_threshold(reads(spark, d, "pident"), cutoff=0.95)
    return spark.createDataFrame([(float(t),)], "threshold double")


# -- tables


def file_table(spark, d):
    path = new_path(spark, "table")
    W.write_table(table(spark, d, "customer").select("c_custkey", "c_nationkey", F.concat(F.lit("n"), "c_custkey").alias("name")), path)
    return spark.read.option("sep", "\t").option("header", True).schema("c_custkey long, c_nationkey long, name string").csv(path)


def file_otu(spark, d):
    path = new_path(spark, "otu")
    li = table(spark, d, "lineitem").select(F.concat(F.lit("o"), F.col("l_partkey") % 97).alias("otu"), "l_returnflag")
    W.write_table(li.groupBy("otu").pivot("l_returnflag", ["A", "N", "R"]).count().fillna(0), path)
    return R.read_otu(spark, path)


def file_groups(spark, d):
    path = new_path(spark, "ogs")
    W.write_table(og_matrix(spark, d).drop("og"), path)
    return R.read_ogs(spark, path).groupBy("genome").agg(F.count("gene").alias("genes"), F.count_distinct("og").alias("groups"))


def file_clusters(spark, d):
    e = table(spark, d, "embeddings").groupBy("label").agg(F.array_join(F.collect_list("vec_id"), ",").alias("value"))
    c = R.read_clusters(spark, _put(spark, e.select("value"), "clusters"))
    return c.groupBy("cluster").agg(F.count("item").alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("clusters"))


def file_growth(spark, d):
    path = new_path(spark, "growth")
    W.write_table(table(spark, d, "nation").select("n_nationkey", (F.col("n_regionkey") * 1.5).alias("a"), (F.col("n_nationkey") / 4).alias("b")), path)
    return R.read_growth(spark, path)


def file_key(spark, d):
    """A key and a table of characters from files; classes, and the tips of the key's tree."""
    path = new_path(spark, "key")
    spark.createDataFrame([("# a key",), ("1\tstatus\tF:[2]\t*:open",), ("2\tprio\t1-URGENT:urgent\t*:[3]",), ("3\teven\ty:even\tn:odd",)], "value string").coalesce(1).write.text(path)
    key = R.read_key(spark, path)
    chars = new_path(spark, "characters")
    o = table(spark, d, "orders")
    W.write_table(o.select(F.col("o_orderkey").alias("object"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("prio"), F.when(F.col("o_orderkey") % 2 == 0, "y").otherwise("n").alias("even")), chars)
    got = T.classify(R.read_characters(spark, chars), key).groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    tips = T.tree_table(spark, T.key_newick(key))
    inner = tips.select(F.col("parent").alias("node")).dropna().distinct()
    tips = tips.join(inner, "node", "left_anti").select(F.col("name").alias("class"))
    return got.join(tips, "class")


# -- taxonomy, trees, reports


def file_taxonomy(spark, d):
    """Dump files written from a taxonomy and read back; names of each taxon's genus."""
    nodes, names = _taxonomy(spark, d)
    named = nodes.join(names.select("tax_id", "name"), "tax_id", "left").select("tax_id", "parent_id", F.coalesce("name", F.concat(F.lit("t"), "tax_id")).alias("name"), "rank")
    files = T.taxonomy_files(named)
    paths = [_put(spark, files[k].select("value"), k) for k in ("nodes", "names")]
    n, m = R.read_taxonomy(spark, *paths)
    a = H.rank_ancestors(n, "genus").join(H.taxon_names(m).withColumnRenamed("tax_id", "ancestor"), "ancestor")
    return a.groupBy("name").agg(F.count(F.lit(1)).alias("taxa"))


def taxonomy_export(spark, d):
    """Patched paths as a taxonomy, and its lines for a table of taxa and of reference sequences."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    p = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws(";", "r_name", "n_name").alias("path"), F.lit("domain").alias("rank"))
    patches = r.filter("r_regionkey = 0").join(n, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws(";", "r_name", "n_name").alias("path"), F.concat_ws(";", F.lit("PATCHED"), "n_name").alias("instead"))
    nodes = T.taxonomy_from_paths(T.patched_paths(p, patches))
    leaves = nodes.filter("rank = 'domain'").select(F.concat(F.lit("seq"), "tax_id").alias("seqname"), "tax_id")
    files = T.taxonomy_files(nodes, leaves)
    return files["taxfile"].select(F.lit("tax").alias("file"), "value").unionByName(files["seqinfo"].select(F.lit("seqinfo").alias("file"), "value")).unionByName(files["nodes"].select(F.lit("nodes").alias("file"), "value"))


def file_silva(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return R.read_silva(spark, _put(spark, n.select(F.concat_ws("\t", F.concat_ws(";", "r_name", F.concat("n_name", F.lit(";"))), F.lit("7"), F.lit("genus")).alias("value")), "silva"))


def file_lineages(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.concat_ws("\n", F.concat(F.lit("c"), "c_custkey", F.lit("\tgenus\t0.5")), F.concat(F.lit("<phylum>p"), F.col("c_custkey") % 5, F.lit(";<genus>g"), F.col("c_custkey") % 7)).alias("value"))
    return T.contig_ranks(R.read_lineages(spark, _put(spark, c.select("value"), "lineages")))


def file_cog(spark, d):
    p = table(spark, d, "part").groupBy((F.col("p_size") % 9).alias("k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("p_partkey")), lambda x: F.concat(F.lit("g"), x.cast("string"))), " ").alias("g"))
    text = F.concat(F.lit("["), F.substring(F.lit("JKLDVTMNU"), (F.col("k") + 1).cast("int"), F.lit(1)), F.lit("] COG000"), F.col("k"), F.lit(" text\n  Org:  "), F.col("g"), F.lit("\n\n_______\n"))
    return R.read_cog(spark, _put(spark, p.select(text.alias("value")), "cog")).select("gene", "cog", "category")


def file_tblout(spark, d):
    line = F.concat_ws(" ", F.concat(F.lit("g"), "p_partkey"), F.lit("-"), F.concat(F.lit("m"), F.col("p_size") % 11), F.lit("PF1"), F.lit("1e-20"), F.col("p_size"), F.lit("0.1 1e-9 12.5 0.1 1.0 1 0 0 1 1 1 1 d"))
    h = R.read_tblout(spark, _put(spark, table(spark, d, "part").select(line.alias("value")), "tblout"))
    return R.filter_model_hits(h, full_score=20, best_evalue=1e-5).select("seq_id", "query", "full_score")


def file_model_search(spark, d):
    p = table(spark, d, "part").withColumn("m", F.col("p_size") % 11)
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_size"))), lambda x: F.concat(F.lit("    1e-20   "), x["p_size"].cast("string"), F.lit(".5   0.1    2e-19   10.5   0.1    1.0  1  g"), x["p_partkey"].cast("string"), F.lit("       d"))), "\n")
    text = F.concat(F.lit("Query:       m"), F.col("m"), F.lit("  [M=10]\nScores for complete sequences (score includes all domains):\n   --- full sequence ---   --- best 1 domain ---    -#dom-\n    E-value  score  bias    E-value  score  bias    exp  N  Sequence Description\n    ------- ------ -----    ------- ------ -----   ---- --  -------- -----------\n"), F.col("rows"), F.lit("\n\nDomain annotation\n//"))
    return R.read_model_search(spark, _put(spark, p.groupBy("m").agg(rows.alias("rows")).select(text.alias("value")), "report")).select("seq_id", "query", "full_score")


def file_pairwise(spark, d):
    """Reports of alignments of 40 letters, with one positive substitution that the key tells."""
    aa = "ARNDCQEGHILKMFPSTWYV"
    p = table(spark, d, "part").select("p_partkey", F.substring(F.lit(aa), (F.col("p_partkey") % 20 + 1).cast("int"), F.lit(1)).alias("a"), F.substring(F.lit(aa), (F.col("p_size") % 20 + 1).cast("int"), F.lit(1)).alias("b"))
    row = "ACDEFGHIKLMNPQRSTVW"
    text = F.concat(F.lit("Query= q"), "p_partkey", F.lit(" d\nLength=40\n\n>s1 other\n Score = 80 bits\n Identities = 38/40 (95%)\nQuery  1   " + row), "a", F.lit(row + "A  40\n           " + row + "+" + row + "A\nSbjct  1   " + row), "b", F.lit(row + "A  40\n\nLambda     K"))
    return R.read_pairwise(spark, _put(spark, p.select(text.alias("value")), "pairwise")).groupBy("aa_qry", "aa_sbj").agg(F.count(F.lit(1)).alias("n"))


def file_triplets(spark, d):
    a = _aligned(spark, d, "a").select(F.concat(F.lit("# "), "model", F.lit(" : p1 : 1-32\nXX\n"), "protein_aln").alias("value"))
    return R.read_alignment_triplets(spark, _put(spark, a, "triplets")).select("model", "protein", "coords", "protein_aln")


def file_placements(spark, d):
    """A placement file: reads of each edge, the multiplicities counted."""
    rows = table(spark, d, "customer").select((F.col("c_custkey") % 5).alias("e"), "c_custkey")
    p = F.to_json(F.struct(F.array(F.array(F.concat(F.lit("d"), F.col("c_custkey") % 3, F.lit(".r"), "c_custkey"), F.lit("2"))).alias("nm"), F.array(F.array(F.col("e").cast("double"), F.lit(-1.0), F.lit(1.0), F.lit(0.1), F.lit(0.2))).alias("p")))
    listed = rows.select(p.alias("j")).agg(F.array_join(F.collect_list("j"), ",").alias("l"))
    head = json.dumps({"tree": "((A:1{0},B:2{1}):3{2},C:4{3}){4};", "fields": ["edge_num", "likelihood", "like_weight_ratio", "distal_length", "pendant_length"]})[:-1]
    tree, placed = R.read_placements(spark, _put(spark, listed.select(F.concat(F.lit(head + ', "placements": ['), "l", F.lit("]}")).alias("value")), "jplace"))
    return T.placement_counts(placed).join(tree.select(F.col("edge").alias("edge_num")), "edge_num")


def itol_file(spark, d):
    tree = T.tree_table(spark, _newick(spark, d))
    p = table(spark, d, "customer").select(F.concat_ws(".", (F.col("c_custkey") % 3).cast("string"), "c_custkey").alias("read"), (F.col("c_custkey") % 31).cast("int").alias("edge_num"))
    return T.itol_lines(T.placement_counts(p), tree.select(F.col("node").alias("edge_num"), "name"), ["0", "1", "2"], ["#111111", "#222222", "#333333"]).select("value")


def file_newick(spark, d):
    path = _put(spark, spark.createDataFrame([(_newick(spark, d),)], "value string"), "newick", 1)
    return R.read_newick(spark, path).filter("name is not null").select("name", "length", "depth")


def file_genbank(spark, d):
    """Lines of genes with their annotations put in after each name."""
    p = _sorted(table(spark, d, "part"), "p_partkey")
    lines = p.select(F.concat(F.lit("     gene            1..9\n                     /locus_tag=\"g"), "p_partkey", F.lit('"')).alias("value"))
    notes = table(spark, d, "part").filter("p_size < 25").select(F.concat(F.lit("g"), "p_partkey").alias("gene"), F.concat(F.lit("a"), "p_size", F.lit("#b")).alias("note"))
    return R.add_genbank_fields(spark, _put(spark, lines, "genbank"), notes, "gene").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


# -- stored results, views, ranges


def stored_results(spark, d):
    """Matches of genome pairs stored, stored again for some, and looked up: what is there and what is left to do."""
    path = new_path(spark, "stored")
    m = table(spark, d, "rbm").filter("seq1 is not null and seq2 is not null and id is not null").groupBy("seq1", "seq2").agg(F.max("id").alias("v"))
    W.save_matches(m.filter("seq1 <= seq2"), path, ["seq1", "seq2"])
    W.save_matches(m.filter("seq1 = seq2").withColumn("v", F.lit(-1.0)), path, ["seq1", "seq2"])
    have, todo = W.stored_matches(spark, path, m, ["seq1", "seq2"])
    return have.select("seq1", "seq2", "v").unionByName(todo.withColumn("v", F.lit(None).cast("double")))


def sql_views(spark, d):
    catalog.register_views(spark, d, ["orders", "customer"])
    orders = catalog.query(spark, "SELECT o_custkey, count(*) AS n FROM {o} GROUP BY o_custkey", o=table(spark, d, "orders"))
    return catalog.query(spark, "SELECT c_nationkey, sum(n) AS n FROM customer JOIN {x} ON c_custkey = o_custkey GROUP BY c_nationkey", x=orders)


def range_pairs(spark, d):
    """Two locations of each part: s..s+9 forward, and t..t+4 with its complement u..u+4."""
    p, z = F.col("p_partkey") % 50 + 1, F.col("p_size") + 1
    a = G.parse_range(F.concat(p.cast("string"), F.lit(".."), (p + 9).cast("string")))
    b = G.parse_range(F.concat(F.lit("join("), z.cast("string"), F.lit(".."), (z + 4).cast("string"), F.lit(",complement("), (z + 20).cast("string"), F.lit(".."), (z + 24).cast("string"), F.lit("))")))
    r = table(spark, d, "part").select("p_partkey", a.alias("a"), b.alias("b"))
    back = G.reversed_range(F.col("b"))
    return r.select("p_partkey", G.overlaps(F.col("a"), F.col("b")).alias("overlaps"), G.touches(F.col("a"), F.col("b")).alias("touches"), G.coverage_ratio(F.col("b"), F.col("a")).alias("ratio"), back[0]["left"].alias("first"), back[0]["reverse"].alias("reverse"), G.sorted_range(back)[0]["left"].alias("least"), G.range_size(G.united(F.col("a"), F.col("b"))).alias("size"))


def hits_edge_weights(spark, d):
    h = go(spark, d).filter("qseqid is not null and sseqid is not null")
    x = h.select("hit_id", O.edge_weights(h, "evalue").alias("w"), O.edge_weights(h, "identity").alias("i"), O.edge_weights(h, "none").alias("one"))
    return x.select("hit_id", F.round("w", 6).alias("w"), "i", "one")


def og_extract_modes(spark, d):
    """Every member, and one member at random of each genome of a group."""
    s = table(spark, d, "part").crossJoin(spark.range(0, 12).withColumnRenamed("id", "genome")).select("genome", F.col("p_partkey").alias("id"), F.lit("A").alias("seq"))
    every, one = O.extract_genes(_og(spark, d), s), O.extract_genes(_og(spark, d), s, pick="random", per_genome=True)
    known = one.join(_og(spark, d), ["og", "genome", "gene"], "left_semi")
    n = lambda x, c: x.groupBy("genome").agg(F.count(F.lit(1)).alias(c))
    return n(every, "members").join(n(one, "picked"), "genome").join(n(known, "known"), "genome")


def essential_report(spark, d):
    models = M.restrict_models(_models(spark, d), ["m3", "m7"])
    return M.model_report(M.essential_genes(_model_hits(spark, d), models), models)


def essential_extract(spark, d):
    """Order lines as the proteins that are the first hit of their model in a genome."""
    c = M.essential_genes(_model_hits(spark, d).withColumn("seq_id", F.col("rid")), _models(spark, d))
    proteins = table(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("genome"), F.concat_ws("-", "l_orderkey", "l_partkey").alias("id"), F.concat(F.lit("M"), F.col("l_partkey").cast("string")).alias("seq")).distinct()
    return M.essential_sequences(c, proteins, rename="x")


def genome_list(spark, d):
    s = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("_c0"), F.when(F.col("o_orderstatus") == "F", "Complete Genome").otherwise("Contig").alias("_c11"), F.concat(F.lit("f/"), "o_orderkey").alias("_c19"))
    return M.assemblies(s)


def files_to_fetch(spark, d):
    """Files that are missing or whose checksum is another one."""
    k = F.col("c_custkey").cast("string")
    c = table(spark, d, "customer")
    reported = c.select(k.alias("name"), F.md5(k).alias("md5"))
    present = c.filter("c_custkey % 3 <> 0").select(k.alias("name"), F.when(F.col("c_custkey") % 5 == 0, "broken").otherwise(k).alias("content"))
    return M.unverified(reported, present).select("name")


def _streamed(spark, name, frame, mode):
    """What a stream over all files there are leaves in a table in memory."""
    from uuid import uuid4

    table_name = f"{name}_{uuid4().hex[:8]}"
    q = frame.writeStream.outputMode(mode).format("memory").queryName(table_name).option("checkpointLocation", new_path(spark, name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(table_name)


def _stream(spark, d, name):
    return spark.readStream.schema(table(spark, d, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def stream_windows_total(spark, d):
    return _streamed(spark, "windows", stream_windows(_stream(spark, d, "events"), "1 day", delay="3650 days"), "complete")


def stream_sums(spark, d):
    """Hits per gene, each hit of the stream counted once."""
    h = _stream(spark, d, "a_mg_cds_go").withColumn("loaded_at", F.coalesce("loaded_at", F.lit("2000-01-01").cast("timestamp")))
    return _streamed(spark, "sums", stream_sum_per_hit(h, "qseqid", delay="36500 days"), "complete")


def krona_rows(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    names = F.create_map(F.lit("phylum"), F.col("r_name"), F.lit("genus"), F.when(F.col("c_custkey") % 3 != 0, F.col("n_name")))
    return lineage_counts(c.select(names.alias("lineage"), (F.col("c_custkey") % 13 + 1).alias("reads")), ["phylum", "genus"])


QUERIES = {f.__name__: f for f in (file_fasta, file_fasta_gz, file_fasta_splits, file_fastq, file_fastq_order, file_interpose, file_parts, seq_to_fasta, fastq_tag, fastq_filter, file_alignments, seq_partition_lines, seq_slide_errors)}
QUERIES |= {f.__name__: f for f in (file_hits, file_hits_few, file_rbm, file_bedgraph, file_gff, file_rec_lim, file_identities, file_vcf, file_sam, anir_threshold, file_table, file_otu, file_groups, file_clusters, file_growth, file_key)}
QUERIES |= {f.__name__: f for f in (file_taxonomy, taxonomy_export, file_silva, file_lineages, file_cog, file_tblout, file_model_search, file_pairwise, file_triplets, file_placements, itol_file, file_newick, file_genbank)}
QUERIES |= {f.__name__: f for f in (stored_results, sql_views, range_pairs, hits_edge_weights, og_extract_modes, essential_report, essential_extract, genome_list, files_to_fetch, krona_rows, stream_sums, stream_windows_total)}

_AA = "'ARNDCQEGHILKMFPSTWYV'"
_PATHS = "p AS (SELECT CASE WHEN r_regionkey = 0 THEN 'PATCHED' ELSE r_name END AS up, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey), n AS (SELECT *, row_number() OVER (ORDER BY \"full\") + 1 AS id FROM (SELECT DISTINCT up AS \"full\", NULL AS up, up AS name, 'no rank' AS rank FROM p UNION SELECT up || ';' || name, up, name, 'domain' FROM p)), t AS (SELECT a.id, coalesce(b.id, 1) AS parent, a.name, a.rank FROM n AS a LEFT JOIN n AS b ON b.\"full\" = a.up UNION ALL SELECT 1, 1, 'root', 'no rank')"

SQL = {
    "file_fasta": f"WITH {_DNA} SELECT id, id || ' ' || rid AS defline, seq FROM dna",
    "file_fasta_gz": f"WITH {_DNA} SELECT row_number() OVER (ORDER BY rid) AS number, id, seq FROM dna",
    "file_fasta_splits": f"WITH {_DNA} SELECT row_number() OVER (ORDER BY rid) AS number, id FROM dna",
    "file_fastq": f"WITH {_FQ} SELECT id, seq, qual FROM fq",
    "file_fastq_order": f"WITH {_FQ} SELECT row_number() OVER (ORDER BY rid) AS number, id FROM fq",
    "file_interpose": f"WITH {_DNA}, n AS (SELECT *, row_number() OVER (ORDER BY rid) AS k FROM dna) SELECT k AS rid, 0 AS file, id || '/1' AS id, seq FROM n UNION ALL SELECT k, 1, id || '/2', reverse(seq) FROM n",
    "file_parts": f"WITH {_FQ}, n AS (SELECT *, row_number() OVER (ORDER BY rid) - 1 AS k FROM fq) SELECT 'ABCD'[k % 4 + 1] AS part, id, qual FROM n",
    "seq_to_fasta": f"WITH {_FQ} SELECT rid, id, id AS defline, seq FROM fq",
    "fastq_tag": f"WITH {_FQ} SELECT rid, 'r' || row_number() OVER (ORDER BY rid) AS id, qual FROM fq",
    "fastq_filter": f"WITH {_FQ} SELECT id, qual FROM fq WHERE rid IN (SELECT o_custkey FROM orders)",
    "file_alignments": f"WITH {_DNA} SELECT form, id, seq FROM dna CROSS JOIN (SELECT unnest(['fasta', 'stockholm', 'clustal', 'phylip', 'nexus']) AS form)",
    "seq_partition_lines": "SELECT 'DNA, ' || f || 'codon' || k || ' = ' || (64 * f + k) || '-' || (64 * f + 64) || '\\3' AS value FROM (SELECT unnest([0, 1, 2, 3]) AS f) CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) UNION ALL SELECT 'GTR, ' || f || ' = ' || (64 * f + 1) || '-' || (64 * f + 64) FROM (SELECT unnest([0, 1, 2, 3]) AS f)",
    "seq_slide_errors": f"WITH {_DNA} SELECT id, 8 AS n, true AS near FROM dna",
    "file_hits": f"WITH {_GO} SELECT qseqid, sseqid, pident, length, s_end, evalue, bitscore, qry_len, sbj_len FROM go WHERE qseqid IS NOT NULL AND sseqid IS NOT NULL AND NOT coalesce(isnan(bitscore), false)",
    "file_hits_few": f"WITH {_READS} SELECT sseqid, count(*) AS n, 0 AS with_length, max(bitscore) AS best FROM reads WHERE sseqid IS NOT NULL GROUP BY 1",
    "file_rbm": "SELECT seq1 AS genome1, id1 AS gene1, seq2 AS genome2, id2 AS gene2, id AS pident FROM rbm WHERE seq1 IS NOT NULL AND seq2 IS NOT NULL AND id1 IS NOT NULL AND id2 IS NOT NULL AND id IS NOT NULL",
    "file_bedgraph": _BASE + 'SELECT contig, s AS start, e AS "end", depth FROM runs',
    "file_gff": _BASE + "SELECT contig AS seqid, s + 1 AS start, e AS \"end\", 'g' || hit_id AS gene FROM spans",
    "file_rec_lim": _HITS + "SELECT (SELECT count(*) FROM cat) AS n, (SELECT sum(start) FROM cat) AS s, (SELECT sum(e) FROM cat) AS e, (SELECT max(off + length + 1) FROM off) AS total, (SELECT count(*) FROM off) AS sequences",
    "file_identities": 'SELECT seq1 AS "SeqA", seq2 AS "SeqB", max(id) AS most, 7 * count(*) AS n FROM rbm WHERE seq1 IS NOT NULL AND seq2 IS NOT NULL AND id IS NOT NULL GROUP BY 1, 2',
    "file_vcf": "SELECT 'c' || l_orderkey AS chrom, l_partkey AS pos, l_linenumber * 10.0::double AS qual, q % 2 = 0 AND l_linenumber = 1 AS indel, CASE WHEN q % 2 = 0 THEN 1 + q ELSE q END AS ref_dp, CASE WHEN q % 2 = 0 THEN 2 + l_linenumber ELSE 5 END AS alt_dp FROM (SELECT *, CAST(floor(l_quantity) AS int) AS q FROM lineitem)",
    "file_sam": "SELECT 'r' || p_partkey AS qname, 'c' || (p_size % 7) AS rname, 100.0::double * (20 - p_size % 4) / 20 AS pident FROM part WHERE p_size % 5 <> 0 AND p_size % 7 BETWEEN 1 AND 4 AND p_partkey % 3 <> 0 AND p_size % 4 <= 2",
    "anir_threshold": "SELECT 95.0::double AS threshold",
    "file_table": "SELECT c_custkey, c_nationkey, 'n' || c_custkey AS name FROM customer",
    "file_otu": "SELECT 'o' || o AS otu, f AS sample, CAST(count(l_partkey) AS double) AS n FROM (SELECT DISTINCT l_partkey % 97 AS o FROM lineitem) CROSS JOIN (SELECT unnest(['A', 'N', 'R']) AS f) LEFT JOIN lineitem ON l_partkey % 97 = o AND l_returnflag = f GROUP BY 1, 2",
    "file_groups": f"WITH {_OG} SELECT 'g' || genome AS genome, count(*) AS genes, count(DISTINCT og) AS groups FROM og GROUP BY 1",
    "file_clusters": "SELECT n, count(*) AS clusters FROM (SELECT count(*) AS n FROM embeddings GROUP BY label) GROUP BY 1",
    "file_growth": "SELECT 'a' AS sample, CAST(n_nationkey AS double) AS t, n_regionkey * 1.5::double AS od FROM nation UNION ALL SELECT 'b', n_nationkey, n_nationkey / 4 FROM nation",
    "file_key": "SELECT CASE WHEN o_orderstatus <> 'F' THEN 'open' WHEN o_orderpriority = '1-URGENT' THEN 'urgent' WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS class, count(*) AS n FROM orders GROUP BY 1",
    "file_taxonomy": "SELECT r_name AS name, 1 + (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) + (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = r_regionkey) AS taxa FROM region",
    "taxonomy_export": f"WITH {_PATHS} SELECT 'tax' AS file, id || chr(9) || parent || chr(9) || rank || chr(9) || name AS value FROM t UNION ALL SELECT 'seqinfo', '\"seq' || id || '\",\"' || id || '\",\"' || name || '\"' FROM t WHERE rank = 'domain' UNION ALL SELECT 'nodes', id || chr(9) || '|' || chr(9) || parent || chr(9) || '|' || chr(9) || CASE rank WHEN 'domain' THEN 'superkingdom' ELSE rank END || chr(9) || '|' || chr(9) || repeat(chr(9) || '|' || chr(9) || '0', 8) || chr(9) || '|' || chr(9) || chr(9) || '|' FROM t",
    "file_silva": "SELECT r_name || ';' || n_name || ';' AS path, n_name AS name, 'genus' AS rank FROM nation JOIN region ON n_regionkey = r_regionkey",
    "file_lineages": "SELECT 'c' || c_custkey AS contig, 'g' || (c_custkey % 7) AS taxon FROM customer",
    "file_cog": "SELECT 'g' || p_partkey AS gene, 'COG000' || (p_size % 9) AS cog, 'JKLDVTMNU'[p_size % 9 + 1] AS category FROM part",
    "file_tblout": "SELECT 'g' || p_partkey AS seq_id, 'm' || (p_size % 11) AS query, CAST(p_size AS double) AS full_score FROM part WHERE p_size >= 20",
    "file_model_search": "SELECT 'g' || p_partkey AS seq_id, 'm' || (p_size % 11) AS query, p_size + 0.5::double AS full_score FROM part",
    "file_pairwise": f"SELECT {_AA}[p_partkey % 20 + 1] AS aa_qry, {_AA}[p_size % 20 + 1] AS aa_sbj, count(*) AS n FROM part GROUP BY 1, 2",
    "file_triplets": f"SELECT 'm' || p_partkey AS model, 'p1' AS protein, '1-32' AS coords, {_ALN.format(s='a')} AS protein_aln FROM part",
    "file_placements": "SELECT c_custkey % 5 AS edge_num, 'd' || (c_custkey % 3) AS dataset, 2.0::double * count(*) AS n FROM customer GROUP BY 1, 2",
    "itol_file": """
WITH n AS (SELECT n_name, n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS j FROM nation), c AS (SELECT n_regionkey AS r, count(*) AS k FROM n GROUP BY 1),
rn AS (SELECT r, 1 + coalesce(sum(k + 1) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS node FROM c), t AS (SELECT node + j AS node, n_name FROM n JOIN rn ON r = n_regionkey),
p AS (SELECT c_custkey % 31 AS e, count(*) AS n, count(*) FILTER (c_custkey % 3 = 0) AS a, count(*) FILTER (c_custkey % 3 = 1) AS b, count(*) FILTER (c_custkey % 3 = 2) AS c FROM customer GROUP BY 1)
SELECT coalesce(n_name, CAST(e AS varchar)) || chr(9) || '0.5' || chr(9) || n || chr(9) || a || '.0' || chr(9) || b || '.0' || chr(9) || c || '.0' AS value FROM p LEFT JOIN t ON node = e
UNION ALL SELECT unnest(['DATASET_PIECHART', 'SEPARATOR TAB', 'DATASET_LABEL' || chr(9) || 'ReadPlacement', 'COLOR' || chr(9) || '#1f2122', 'FIELD_LABELS' || chr(9) || '0' || chr(9) || '1' || chr(9) || '2', 'FIELD_COLORS' || chr(9) || '#111111' || chr(9) || '#222222' || chr(9) || '#333333', 'DATA'])""",
    "file_newick": f"WITH {_TIPS} SELECT name, CAST(len AS double) AS length, len + r + 0.5::double AS depth FROM t",
    "file_genbank": "SELECT value, count(*) AS n FROM (SELECT '     gene            1..9' AS value FROM part UNION ALL SELECT repeat(' ', 21) || '/locus_tag=\"g' || p_partkey || '\"' FROM part UNION ALL SELECT repeat(' ', 21) || '/note=\"a' || p_size || '\"' FROM part WHERE p_size < 25 UNION ALL SELECT repeat(' ', 21) || '/note=\"b\"' FROM part WHERE p_size < 25) GROUP BY 1",
    "stored_results": "SELECT seq1, seq2, CASE WHEN seq1 = seq2 THEN -1.0::double WHEN seq1 < seq2 THEN max(id) END AS v FROM rbm WHERE seq1 IS NOT NULL AND seq2 IS NOT NULL AND id IS NOT NULL GROUP BY 1, 2",
    "sql_views": "SELECT c_nationkey, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "range_pairs": "SELECT p_partkey, (z <= s + 9 AND z + 4 >= s) OR (z + 20 <= s + 9 AND z + 24 >= s) AS overlaps, z <= s + 10 AND z + 5 >= s AS touches, 1.0::double AS ratio, z + 20 AS first, false AS reverse, z AS least, 20 AS size FROM (SELECT p_partkey, p_partkey % 50 + 1 AS s, p_size + 1 AS z FROM part)",
    "hits_edge_weights": f"WITH {_GO} SELECT hit_id, CASE WHEN evalue <= 0 THEN 200.0::double ELSE round(-log10(evalue), 6) END AS w, pident AS i, 1.0::double AS one FROM go WHERE qseqid IS NOT NULL AND sseqid IS NOT NULL",
    "og_extract_modes": f"WITH {_OG} SELECT genome, count(*) AS members, count(DISTINCT og) AS picked, count(DISTINCT og) AS known FROM og GROUP BY 1",
    "essential_report": f"WITH {_MODEL_HITS}, m AS (SELECT unnest(generate_series(0, 49)) AS m), c AS (SELECT g.genome, m.m, count(h.m) AS copies FROM (SELECT DISTINCT genome FROM h) AS g CROSS JOIN m LEFT JOIN h ON h.genome = g.genome AND h.m = m.m WHERE m.m NOT IN (3, 7) GROUP BY 1, 2) SELECT genome, 'm' || m AS model, copies FROM c WHERE copies <> 1",
    "essential_extract": f"WITH {_MODEL_HITS} SELECT genome, 'm' || m AS model, 'x|m' || m AS id, 'M' || split_part(min(rid), '-', 2) AS seq FROM h GROUP BY genome, m",
    "genome_list": "SELECT CAST(o_orderkey AS varchar) AS accession, 'f/' || o_orderkey AS folder FROM orders WHERE o_orderstatus = 'F'",
    "files_to_fetch": "SELECT CAST(c_custkey AS varchar) AS name FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 5 = 0",
    "stream_sums": f"WITH {_GO} SELECT qseqid, count(*) AS total FROM go WHERE qseqid IS NOT NULL GROUP BY 1",
    "stream_windows_total": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
    "krona_rows": "SELECT sum(c_custkey % 13 + 1) AS reads, r_name AS phylum, CASE WHEN c_custkey % 3 <> 0 THEN n_name ELSE '' END AS genus FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 2, 3",
}
