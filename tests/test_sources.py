import gzip
import json

import pytest

from seqspark.operators import trees as T
from seqspark.operators.sequences import interpose, numbered, quality_offset, recode_quality
from seqspark.sources import readers as R
from seqspark.sources import writers as W
from seqspark.streaming.hits import stream_sum_per_hit, stream_windows


def put(tmp_path, name, text):
    p = tmp_path / name
    (gzip.open(p, "wt") if name.endswith(".gz") else open(p, "w")).write(text)
    return str(p)


@pytest.mark.parametrize("name", ["a.fa", "a.fa.gz"])
def test_fasta(spark, tmp_path, name):
    p = put(tmp_path, name, ";comment\n>s1 first one\nACGT\nAC\n;inner\nGT\n>s2\r\nTT\r\n>s3 empty\n>s4\nA\n\n")
    got = [(r["id"], r["defline"], r["seq"]) for r in R.read_fasta(spark, p).orderBy("rid").collect()]
    assert got == [("s1", "s1 first one", "ACGTACGT"), ("s2", "s2", "TT"), ("s3", "s3 empty", ""), ("s4", "s4", "A")]
    out = str(tmp_path / "out")
    W.write_fasta(R.read_fasta(spark, p).filter("seq <> ''"), out, 3)
    again = {(r["id"], r["seq"]) for r in R.read_fasta(spark, out).collect()}
    assert again == {("s1", "ACGTACGT"), ("s2", "TT"), ("s4", "A")}
    W.write_parts(R.read_fasta(spark, p), str(tmp_path / "parts"), "id")
    assert (tmp_path / "parts" / "id=s2").exists()


def test_fastq(spark, tmp_path):
    p = put(tmp_path, "a.fq", "@r1 x\nACGT\n+\n@III\n@r2\nAC\n+r2\n!~\n")
    rows = R.read_fastq(spark, p).orderBy("rid").collect()
    assert [(r["id"], r["seq"], r["qual"], r["plus"]) for r in rows] == [("r1", "ACGT", "@III", ""), ("r2", "AC", "!~", "r2")]
    assert quality_offset(R.read_fastq(spark, p)).first()[0] == 33
    with pytest.raises(Exception, match="four lines"):
        R.read_fastq(spark, put(tmp_path, "b.fq", "@r1\nAC\n+\n")).collect()
    with pytest.raises(Exception, match="out of range"):
        recode_quality(R.read_fastq(spark, p), 64).collect()
    W.write_fastq(R.read_fastq(spark, p), str(tmp_path / "fq"))
    assert R.read_fastq(spark, str(tmp_path / "fq")).count() == 2


def test_hits_and_matches(spark, tmp_path):
    line = "q\ts\t99.5\t10\t0\t0\t1\t10\t5\t14\t1e-9\t50.5"
    h = R.read_hits(spark, put(tmp_path, "h.tsv", f"# c\n{line}\n{line}\t100\n{line}\t100\t200\n")).orderBy("hit_id").collect()
    assert [(r["qry_len"], r["sbj_len"]) for r in h] == [(None, None), (100, None), (100, 200)] and h[0]["evalue"] == 1e-9
    m = R.read_rbm(spark, put(tmp_path, "GA-GB.rbm", line + "\n")).first()
    assert (m["genome1"], m["gene1"], m["genome2"], m["gene2"]) == ("GA", "q", "GB", "s")


def test_vcf(spark, tmp_path):
    v = R.read_vcf(spark, put(tmp_path, "a.vcf", "##x\n#CHROM\nc\t5\t.\tA\tG\t30\tPASS\tDP4=1,2,3,4;FLAG\tGT:AD\t0/1:9,8\nc\t6\t.\tAT\tA\t.\tPASS\tINDEL;DP=3\tGT:AD\t0/1:2,3\n")).orderBy("pos").collect()
    assert (v[0]["ref_dp"], v[0]["alt_dp"], v[0]["indel"], v[0]["fields"]["FLAG"], v[0]["qual"]) == (3, 7, False, "true", 30.0)
    assert (v[1]["ref_dp"], v[1]["alt_dp"], v[1]["indel"], v[1]["qual"]) == (2, 3, True, None)


def test_sam(spark, tmp_path):
    s = R.read_sam(spark, put(tmp_path, "a.sam", "@HD\nr1\t0\tc1\t1\t9\t4M\t*\t0\t0\tACGT\tIIII\tMD:Z:4\tYT:Z:UU\nr2\t0\tc1\t1\t9\t4M\t*\t0\t0\tACGT\tIIII\tMD:Z:2A1\tYT:Z:UU\nr3\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\n"))
    assert [(r["qname"], r["pident"]) for r in R.filter_sam(s, identity=70).orderBy("rid").collect()] == [("r1", 100.0), ("r2", 75.0)]
    assert R.filter_sam(s, spark.createDataFrame([("zz",)], "id string")).count() == 0


def test_tables(spark, tmp_path):
    assert sorted(map(tuple, R.read_otu(spark, put(tmp_path, "o.tsv", "OTU\tA\tB\nx\t1\t2\ny\t0\t3\n")).collect())) == [("x", "A", 1.0), ("x", "B", 2.0), ("y", "A", 0.0), ("y", "B", 3.0)]
    og = R.read_ogs(spark, put(tmp_path, "g.ogs", "G1\tG2\na,b\t-\n-\tc\n"))
    assert sorted((r["genome"], r["gene"]) for r in og.collect()) == [("G1", "a"), ("G1", "b"), ("G2", "c")]
    key = R.read_key(spark, put(tmp_path, "k.tsv", "# key\n1\tcolour\tred:[2]\t*:other\n2\tsize\tbig:A\tsmall:B\n"))
    chars = R.read_characters(spark, put(tmp_path, "c.tsv", "obj\tcolour\tsize\no1\tred\tbig\no2\tblue\tbig\no3\tred\todd\n"))
    assert dict(map(tuple, T.classify(chars, key).collect())) == {"o1": "A", "o2": "other", "o3": None}
    assert R.read_bedgraph(spark, put(tmp_path, "b.bg", "c\t0\t5\t2\n")).first()["depth"] == 2
    assert R.read_gff(spark, put(tmp_path, "b.gff", "c\ts\tCDS\t1\t9\t.\t+\t0\tgene_id 12; x\n")).first()["gene"] == "gene_id_12"
    assert R.read_gff(spark, put(tmp_path, "b.gff3", "c\ts\tCDS\t1\t9\t.\t+\t0\tID=g7;x=1\n"), "gff3").first()["gene"] == "g7"
    cog = R.read_cog(spark, put(tmp_path, "whog", "[JK] COG0001 text here\n  Org:  g1 g2\n        g3\n\n_______\n\n[L] COG0002 t\n  Org:  g4\n_______\n"))
    assert sorted((r["gene"], r["cog"], r["category"]) for r in cog.collect()) == [("g1", "COG0001", "JK"), ("g2", "COG0001", "JK"), ("g3", "COG0001", "JK"), ("g4", "COG0002", "L")]
    lin = R.read_lineages(spark, put(tmp_path, "m.txt", "c1\tgenus\t0.9\n<phylum>P;<genus>G\nc2\tphylum\t0.5\n<phylum>P\n"))
    assert dict(map(tuple, T.contig_ranks(lin).collect())) == {"c1": "G", "c2": "Unclassified"}
    nodes, names = R.read_taxonomy(spark, put(tmp_path, "nodes.dmp", "1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tgenus\t|\n"), put(tmp_path, "names.dmp", "2\t|\tBug\t|\t\t|\tsynonym\t|\n2\t|\tBugus\t|\t\t|\tscientific name\t|\n"))
    from seqspark.operators.hits import rank_ancestors, taxon_names

    assert rank_ancestors(nodes, "genus").collect()[0]["ancestor"] == 2 and taxon_names(names).first()["name"] == "Bugus"
    tri = R.read_alignment_triplets(spark, put(tmp_path, "t.txt", "# m1 : p1 : 1-5\nAC-D\nAC-E\n")).first()
    assert (tri["model"], tri["protein"], tri["model_aln"]) == ("m1", "p1", "AC-D")
    tb = R.read_tblout(spark, put(tmp_path, "t.tbl", "# x\ng1 - m1 PF1 1e-20 70.1 0.1 2e-19 66.5 0.1 1.0 1 0 0 1 1 1 1 desc\n")).first()
    assert (tb["seq_id"], tb["query"], tb["full_score"], tb["best_evalue"]) == ("g1", "m1", 70.1, 2e-19)
    report = "Query:       m1  [M=10]\nScores for complete sequences (score includes all domains):\n   --- full sequence ---   --- best 1 domain ---    -#dom-\n    E-value  score  bias    E-value  score  bias    exp  N  Sequence Description\n    ------- ------ -----    ------- ------ -----   ---- --  -------- -----------\n    1.2e-20   70.1   0.1    2e-19   66.5   0.1    1.0  1  g1       d\n      0.5      3.1   0.0    0.6     2.5   0.0    1.0  1  g2       d\n\nDomain annotation\n//\n"
    ms = R.read_model_search(spark, put(tmp_path, "r.txt", report))
    assert sorted((r["seq_id"], r["query"], r["best_score"]) for r in ms.collect()) == [("g1", "m1", 66.5), ("g2", "m1", 2.5)]
    assert [r["seq_id"] for r in R.filter_model_hits(ms, full_evalue=1e-3).collect()] == ["g1"]


def test_alignments(spark, tmp_path):
    rows = spark.createDataFrame([("a", "AC-GT"), ("b", "ACCGT")], "id string, seq string")
    for form in ("fasta", "stockholm", "clustal", "phylip", "nexus"):
        W.write_alignment(rows, str(tmp_path / form), form)
        assert sorted(map(tuple, R.read_alignment(spark, str(tmp_path / form), form).collect())) == [("a", "AC-GT"), ("b", "ACCGT")], form


def test_pairwise(spark, tmp_path):
    text = "Query= q1 desc\nLength=40\n\n>s1 other\n Score = 80 bits\n Identities = 38/40 (95%)\nQuery  1   ACDEFGHIKLMNPQRSTVWYACDEFGHIKLMNPQRSTVWY  40\n           AC EFGHIKLMNPQRSTVWYACDEFGHI+LMNPQRSTVWY\nSbjct  1   ACXEFGHIKLMNPQRSTVWYACDEFGHIRLMNPQRSTVWY  40\n\nLambda     K\n"
    got = R.read_pairwise(spark, put(tmp_path, "p.txt", text)).collect()
    assert [(r["query"], r["subject"], r["aa_qry"], r["aa_sbj"], r["aln_len"]) for r in got] == [("q1", "s1", "K", "R", 40)]


def test_genbank(spark, tmp_path):
    p = put(tmp_path, "g.gbk", '     gene 1..3\n                     /locus_tag="x1"\n     gene 4..5\n                     /locus_tag="x2"\n')
    ann = spark.createDataFrame([("x1", "a#b")], "gene string, note string")
    got = [r["value"].strip() for r in R.add_genbank_fields(spark, p, ann, "gene").orderBy("rid", "sub", "value").collect()]
    assert got == ["gene 1..3", '/locus_tag="x1"', '/note="a"', '/note="b"', "gene 4..5", '/locus_tag="x2"']


def test_trees(spark, tmp_path):
    doc = {"tree": "((A:1{0},B:2{1}):3{2},C:4{3}){4};", "fields": ["edge_num", "likelihood", "like_weight_ratio", "distal_length", "pendant_length"], "placements": [{"n": ["r1", "r2"], "p": [[0, -1.0, 0.9, 0.5, 0.1]]}, {"nm": [["r3", 2]], "p": [[3, -1.0, 1.0, 0.0, 0.2]]}]}
    tree, placed = R.read_placements(spark, put(tmp_path, "p.jplace", json.dumps(doc)))
    assert {(r["read"], r["edge_num"], r["multiplicity"]) for r in placed.collect()} == {("r1", 0, 1.0), ("r2", 0, 1.0), ("r3", 3, 2.0)}
    d = T.placement_distances(placed.selectExpr("read", "edge_num", "distal_length distal", "pendant_length pendant"), tree, 3)
    assert {r["read"]: round(r["d"], 6) for r in d.collect()} == {"r1": 8.6, "r2": 8.6, "r3": 0.2}
    assert T.to_newick(T.parse_newick("((A:1,B:2):3,C:4);")) == "((A:1,B:2):3,C:4);"
    with pytest.raises(ValueError):
        T.parse_newick("((A,B);")
    assert T.prune_close_tips(T.parse_newick("((A:1,B:1):5,(C:1,D:9):5);"), 3) == ["B", "C", "D"]
    c = T.collapse_counts(T.placement_counts(placed, r"^(r)"), tree, [2])
    assert {(r["edge_num"], r["n"]) for r in c.collect()} == {(2, 2.0), (3, 2.0)}


def test_order_and_interpose(spark):
    df = spark.createDataFrame([(i * 7, f"r{i}/1", "A") for i in range(50)], "rid bigint, id string, seq string").repartition(5)
    assert sorted((r["rid"], r["number"]) for r in numbered(df).collect()) == [(i * 7, i + 1) for i in range(50)]
    with pytest.raises(Exception, match="out of step"):
        interpose([df, df.limit(10)]).collect()


def test_saved_matches_are_replaced(spark, tmp_path):
    p = str(tmp_path / "m")
    W.save_matches(spark.createDataFrame([("a", "b", 1), ("a", "c", 2)], "x string, y string, v int"), p, ["x", "y"])
    W.save_matches(spark.createDataFrame([("a", "b", 9)], "x string, y string, v int"), p, ["x", "y"])
    assert sorted(r["v"] for r in spark.read.parquet(p).collect()) == [2, 9]


def test_streams(spark, tmp_path):
    hits = spark.read.parquet("/root/testdata/sf0.001/a_mg_reads_cds.parquet")
    hits.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(hits.schema).parquet(str(tmp_path / "in"))
    q = stream_sum_per_hit(s).writeStream.outputMode("complete").format("memory").queryName("sums").start()
    q.processAllAvailable()
    q.stop()
    want = {r["sseqid"]: r["n"] for r in hits.filter("sseqid is not null").select("sseqid", "hit_id").distinct().groupBy("sseqid").count().withColumnRenamed("count", "n").collect()}
    assert {r["subject" if "subject" in r else "sseqid"]: r["total"] for r in spark.table("sums").collect()} == want
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    ev.write.parquet(str(tmp_path / "ev"))
    q = stream_windows(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev"))).writeStream.outputMode("append").format("memory").queryName("wins").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("wins").columns == ["start", "event_type", "n"]
