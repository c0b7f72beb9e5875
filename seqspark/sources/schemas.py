"""Schemas of the record types."""

#: Tabular search hits: twelve columns, then the lengths of query and subject if given.
HITS = "qseqid string, sseqid string, pident double, length int, mismatch int, gapopen int, q_start int, q_end int, s_start int, s_end int, evalue double, bitscore double, qry_len int, sbj_len int"
BEDGRAPH = "contig string, start long, end long, depth int"
GFF = "seqid string, source string, type string, start int, end int, score string, strand string, phase string, attributes string"
VCF = "chrom string, pos int, id string, ref string, alt string, qual string, filter string, info string, format string, sample string"
REC = "start long, end long, pident double, bitscore double, read string, corr_identity double"
LIM = "id string, start long, end long"
SAM = "qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, tags map<string,string>"
IDENTITIES = "SeqA string, SeqB string, AAI double, SD double, N int, Omega int, Frx double"
