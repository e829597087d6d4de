"""Queries of scalar functions, predicates, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import reads as R, sequence as S, specs, vcf
from ..operators import haplotype
from ..shared import temporary
from ..sources import fasta, gztext, sinks, text
from .registry import Registry

QUERIES = Registry()
q = QUERIES.add

# --- sequences and qualities


@q("fn_revcomp", "SELECT doc_id, translate(reverse(seq), 'ACGT', 'TGCA') AS rc FROM dna")
def _(v):
    return v.dna.select("doc_id", S.revcomp(F.col("seq")).alias("rc"))


@q("fn_complement", "SELECT doc_id, translate(seq, 'ACGT', 'TGCA') AS c FROM dna")
def _(v):
    return v.dna.select("doc_id", S.complement(F.col("seq")).alias("c"))


@q("fn_orient", "SELECT name, read_num, CASE WHEN flag & 16 <> 0 THEN translate(reverse(seq), 'ACGTacgt', 'TGCAtgca') ELSE seq END AS s, CASE WHEN flag & 16 <> 0 THEN reverse(qual) ELSE qual END AS ql FROM aln")
def _(v):
    s, ql = S.orient(F.col("seq"), F.col("qual"), R.flagged(F.col("flag"), R.REVERSE))
    return v.aln.select("name", "read_num", s.alias("s"), ql.alias("ql"))


@q("fn_upper", "SELECT doc_id, CASE WHEN doc_id % 7 >= length(seq) THEN '' ELSE upper(substr(lower(seq), CAST(doc_id % 7 + 1 AS INT), CAST(length(seq) - doc_id % 7 AS INT))) END AS s FROM dna")
def _(v):
    return v.dna.select("doc_id", S.fetch_upper(F.lower("seq"), F.col("doc_id") % 7, F.length("seq")).alias("s"))


@q("fn_is_dna", "SELECT line_no, regexp_full_match(split_part(line, chr(9), 4), '[ACGTacgt]+') AS ref_ok, regexp_full_match(split_part(line, chr(9), 5), '[ACGTacgt]+') AS alt_ok FROM vcf WHERE line <> '#comment'")
def _(v):
    return v.vcf.where("line <> '#comment'").select("line_no", S.is_dna(F.split("line", "\t")[3]).alias("ref_ok"), S.is_dna(F.split("line", "\t")[4]).alias("alt_ok"))


@q("fn_base_index", "SELECT name, read_num, CASE upper(substr(seq, 1, 1)) WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 END AS i FROM aln")
def _(v):
    return v.aln.select("name", "read_num", S.base_index(F.substring("seq", 1, 1)).alias("i"))


@q("fn_prev_q_bin", "SELECT name, read_num, CASE WHEN k < 10 THEN 0 WHEN k < 20 THEN 1 WHEN k < 30 THEN 2 ELSE 3 END AS b FROM (SELECT *, ascii(substr(qual, 7, 1)) - 33 AS k FROM aln)")
def _(v):
    return v.aln.select("name", "read_num", S.previous_bin(S.phred(F.substring("qual", 7, 1))).alias("b"))


@q("fn_perr", "SELECT name, read_num, round(pow(10::DOUBLE, -(ascii(substr(qual, 7, 1)) - 33) / 10.0), 9) AS p FROM aln")
def _(v):
    return v.aln.select("name", "read_num", F.round(S.error_probability(S.phred(F.substring("qual", 7, 1))), 9).alias("p"))


@q("fn_mean_qual", "SELECT name, read_num, round(list_avg(list_transform(string_split(qual, ''), lambda c: ascii(c) - 33)), 6) AS m FROM aln")
def _(v):
    return v.aln.select("name", "read_num", F.round(S.mean_phred(F.col("qual")), 6).alias("m"))


@q("fn_truncate", "SELECT doc_id, CASE WHEN length(t) <= 20 THEN t ELSE concat(substr(t, 1, 17), '...') END AS t FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def _(v):
    d = v.spark.read.parquet(f"{v.sf_dir}/documents.parquet")
    return d.select("doc_id", S.truncated(F.coalesce("text", F.lit("")), 20).alias("t"))


@q("fn_escape_json", r"""SELECT doc_id, md5(replace(replace(replace(coalesce(text, ''), chr(92), concat(chr(92), chr(92))), '"', concat(chr(92), '"')), chr(10), concat(chr(92), 'n'))) AS h FROM documents""")
def _(v):
    d = v.spark.read.parquet(f"{v.sf_dir}/documents.parquet")
    return d.select("doc_id", F.md5(S.json_escaped(F.coalesce("text", F.lit("")))).alias("h"))


# --- variant fields

_F = "split_part(line, chr(9), 8)"
_INFO = "nullif(regexp_extract(concat(';', {f}), ';{k}=([^;]*)', 1), '')"


def _info(key: str, f: str = _F) -> str:
    return _INFO.format(f=f, k=key)


_BODY = "SELECT line_no, split_part(line, chr(9), 1) AS chrom, TRY_CAST(split_part(line, chr(9), 2) AS BIGINT) AS raw_pos, split_part(line, chr(9), 3) AS id, split_part(line, chr(9), 4) AS ref_, split_part(line, chr(9), 5) AS alt, split_part(line, chr(9), 8) AS info, split_part(line, chr(9), 10) AS sample FROM vcf WHERE substr(line, 1, 1) <> '#'"


def _i(key: str) -> str:
    return _info(key, "info")


_KIND = f"CASE WHEN {_i('SVTYPE')} IN ('DEL', 'DUP', 'INV', 'INS', 'BND') THEN {_i('SVTYPE')} WHEN {_i('SVTYPE')} IS NULL AND regexp_full_match(ref_, '[ACGTacgt]+') AND regexp_full_match(alt, '[ACGTacgt]+') THEN 'SNP' END"
_RECORDS = f"body AS ({_BODY}), records AS (SELECT *, CASE WHEN sv_type IN ('BND', 'SNP') THEN raw_pos - 1 ELSE raw_pos END AS pos FROM (SELECT *, {_KIND} AS sv_type FROM body WHERE raw_pos > 0) WHERE sv_type IS NOT NULL)"
_AF = "coalesce(" + ", ".join(f"CASE WHEN TRY_CAST({_i(k)} AS DOUBLE) > 0 AND TRY_CAST({_i(k)} AS DOUBLE) <= 1 THEN TRY_CAST({_i(k)} AS DOUBLE) END" for k in ("SIM_VAF", "VAF", "AF")) + ")"
_END = f"coalesce(TRY_CAST({_i('END')} AS BIGINT), pos + abs(TRY_CAST({_i('SVLEN')} AS BIGINT)), pos + 1)"
_PARTNER = r"regexp_extract(alt, '[\[\]]([^:\[\]]+):([0-9]+)[\[\]]', {n})"


def _records(v):
    return text.variant_records(v.vcf)


@q("fn_info", f"WITH body AS ({_BODY}) SELECT line_no, {_i('SVTYPE')} AS svtype, {_i('END')} AS e, {_i('SVLEN')} AS l, {_i('SIM_GENE')} AS g FROM body")
def _(v):
    i = F.split("line", "\t")[7]
    b = v.vcf.where("line <> '#comment'")
    return b.select("line_no", vcf.info_value(i, "SVTYPE").alias("svtype"), vcf.info_value(i, "END").alias("e"), vcf.info_value(i, "SVLEN").alias("l"), vcf.info_value(i, "SIM_GENE").alias("g"))


@q("fn_extract_af", f"WITH {_RECORDS} SELECT line_no, {_AF} AS af FROM records")
def _(v):
    return _records(v).select("line_no", vcf.info_fraction(F.col("info")).alias("af"))


@q("fn_vcf_end", f"WITH {_RECORDS} SELECT line_no, {_END} AS e FROM records")
def _(v):
    return _records(v).select("line_no", vcf.end_of(F.col("pos"), F.col("info")).alias("e"))


@q("fn_ins_payload", f"WITH {_RECORDS} SELECT line_no, s, n FROM (SELECT line_no, CASE WHEN substr(alt, 1, 1) <> '<' AND length(alt) > 1 THEN substr(alt, 2) END AS s, coalesce(CASE WHEN substr(alt, 1, 1) <> '<' AND length(alt) > 1 THEN length(alt) - 1 END, nullif(abs(coalesce(TRY_CAST({_i('SVLEN')} AS BIGINT), 0)), 0)) AS n FROM records WHERE sv_type = 'INS') WHERE n IS NOT NULL")
def _(v):
    s, n = vcf.inserted(F.col("alt"), F.col("info"))
    return _records(v).where("sv_type = 'INS'").select("line_no", s.alias("s"), n.alias("n")).where("n is not null")


@q("fn_bnd_alt", f"WITH {_RECORDS} SELECT line_no, {_PARTNER.format(n=1)} AS c, greatest(CAST({_PARTNER.format(n=2)} AS BIGINT) - 1, 0) AS p, alt LIKE '%]%]%' AS inv FROM records WHERE sv_type = 'BND'")
def _(v):
    c, p, inv = vcf.partner(F.col("alt"))
    return _records(v).where("sv_type = 'BND'").select("line_no", c.alias("c"), p.alias("p"), inv.alias("inv"))


@q("sink_gt", "SELECT event_id, CASE WHEN vaf >= 0.9 THEN '1/1' ELSE '0/1' END AS gt FROM sv")
def _(v):
    return v.sv.select("event_id", R.genotype(F.col("vaf")).alias("gt"))


# --- specs

_SPEC = """SELECT event_id, concat(CASE WHEN event_id % 2 = 0 THEN lower(sv_type) ELSE sv_type END, ':', chrom, ':', CASE WHEN sv_type = 'SNP' THEN concat(start + 1, ':', ref_allele, ':', alt_allele) WHEN sv_type = 'INS' THEN concat(start, ':', CASE WHEN event_id % 4 < 2 THEN CAST(ins_len AS STRING) ELSE ins_seq END) ELSE concat(start, '-', "end") END,
 CASE event_id % 4 WHEN 0 THEN ';af=het' WHEN 1 THEN ';af=HOM' WHEN 2 THEN concat(';af=', vaf) ELSE '' END) AS spec FROM sv WHERE sv_type <> 'BND'"""


def _specs(v):
    return v.spark.sql(_SPEC.replace('"end"', "`end`").replace("FROM sv", "FROM {sv}"), sv=v.sv)


@q("fn_event_spec", """SELECT event_id, sv_type, chrom, start, "end" FROM sv WHERE sv_type <> 'BND'""")
def _(v):
    c = specs.event_columns(F.col("spec"))
    return _specs(v).select("event_id", *[c[k].alias(k) for k in ("sv_type", "chrom", "start", "end")])


@q("fn_af_value", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'het' WHEN 1 THEN 'hom' WHEN 2 THEN 'exact' END AS kind, CASE WHEN event_id % 4 = 2 THEN vaf END AS val FROM sv WHERE sv_type <> 'BND'")
def _(v):
    c = specs.event_columns(F.col("spec"))
    return _specs(v).select("event_id", c["af_kind"].alias("kind"), c["af_value"].alias("val"))


@q("fn_af_resolve", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN vaf ELSE 0.4::DOUBLE END AS af FROM sv WHERE sv_type <> 'BND'")
def _(v):
    c = specs.event_columns(F.col("spec"))
    return _specs(v).select("event_id", R.allele_fraction(c["af_kind"], c["af_value"], 0.4, F.lit(0.5)).alias("af"))


@q("fn_ins_spec", "SELECT event_id, ins_len FROM sv WHERE sv_type = 'INS'")
def _(v):
    c = specs.event_columns(F.col("spec"))
    return _specs(v).select("event_id", c["sv_type"].alias("k"), c["ins_len"].alias("ins_len")).where("k = 'INS'").drop("k")


@q("fn_snp_spec", """SELECT event_id, start, "end" FROM sv WHERE sv_type = 'SNP'""")
def _(v):
    c = specs.event_columns(F.col("spec"))
    return _specs(v).select("event_id", c["sv_type"].alias("k"), c["start"].alias("start"), c["end"].alias("end")).where("k = 'SNP'").drop("k")


@q("fn_region", """SELECT event_id, chrom, start, "end" FROM sv WHERE "end" > start""")
def _(v):
    d = v.sv.where("end > start").select("event_id", F.concat("chrom", F.lit(":"), F.format_number(F.col("start") + 1, 0), F.lit("-"), F.format_number("end", 0)).alias("r"))
    part = lambda i: F.regexp_extract("r", "^([^:]+):([0-9,]+)-([0-9,]+)$", i)
    n = lambda i: F.replace(part(i), F.lit(",")).cast("bigint")
    return d.select("event_id", part(1).alias("chrom"), (n(2) - 1).alias("start"), n(3).alias("end"))


@q("fn_exon_number", "SELECT line_no, CAST(replace(split_part(name, '_', 2), 'exon', '') AS INT) AS n FROM exons")
def _(v):
    return text.exons(v.bed).select("line_no", F.regexp_extract("name", "(?i)_(?:exon)?([0-9]+)$", 1).try_cast("int").alias("n"))


@q("fn_event_label", """SELECT event_id, concat(sv_type, ' ', chrom, ':', start, '-', "end") AS a, concat(sv_type, ' ', chrom, ':', start, '-', "end", ' (', gene, ')') AS b FROM sv""")
def _(v):
    c = [F.col(x) for x in ("sv_type", "chrom", "start", "end")]
    return v.sv.select("event_id", R.event_label(*c).alias("a"), R.run_label(*c, F.col("gene")).alias("b"))


@q("fn_primary_region", """SELECT event_id, CASE WHEN sv_type <> 'BND' THEN start END AS lo, CASE WHEN sv_type = 'INS' THEN start WHEN sv_type = 'SNP' THEN start + length(ref_allele) WHEN sv_type <> 'BND' THEN "end" END AS hi FROM sv""")
def _(v):
    lo, hi = R.primary_region(*(F.col(c) for c in ("sv_type", "start", "end", "ref_allele")))
    return v.sv.select("event_id", lo.alias("lo"), hi.alias("hi"))


# --- sources


@q("src_bed_exon", 'SELECT line_no, chrom, start, "end", name, gene FROM exons')
def _(v):
    return text.exons(v.bed)


@q("agg_gene", 'SELECT gene, chrom, min(start) AS lo, max("end") AS hi, count(*) AS n FROM exons GROUP BY gene, chrom')
def _(v):
    return text.genes(text.exons(v.bed)).select("gene", "chrom", F.col("start").alias("lo"), F.col("end").alias("hi"), F.size("exons").cast("bigint").alias("n"))


@q("win_exon_rank", "SELECT line_no, gene, CAST(row_number() OVER (PARTITION BY gene, chrom ORDER BY start, line_no) AS INT) AS number FROM exons")
def _(v):
    return text.numbered_exons(text.exons(v.bed)).select("line_no", "gene", "number")


@q("sort_genes", "SELECT gene, chrom, CAST(row_number() OVER (ORDER BY chrom, lo, gene) AS INT) AS k FROM (SELECT gene, chrom, min(start) AS lo FROM exons GROUP BY gene, chrom)")
def _(v):
    g = text.genes(text.exons(v.bed)).orderBy("chrom", "start", "gene")
    return g.agg(F.array_sort(F.collect_list(F.struct("chrom", "start", "gene"))).alias("l")).select(F.posexplode("l").alias("i", "g")).select("g.gene", "g.chrom", (F.col("i") + 1).alias("k"))


@q("src_vcf", f"WITH {_RECORDS} SELECT line_no, chrom, pos, id, alt, sv_type FROM records")
def _(v):
    return _records(v).select("line_no", "chrom", "pos", "id", "alt", "sv_type")


@q("src_vcf_blocks", f"WITH {_RECORDS} SELECT chrom, pos, id, alt, sv_type FROM records")
def _(v):
    """Variants from block-gzip files that are cut into ranges of some blocks."""
    path = temporary(v.spark, "variants")
    gztext.write_variants(v.vcf.where(~F.col("line").startswith("#")), path, v.spark.sparkContext.defaultParallelism, ["##fileformat=VCFv4.2"])
    return text.variant_records(gztext.lines(v.spark, path, range_bytes=1 << 17)).select("chrom", "pos", "id", "alt", "sv_type")


_MATES = "row_number() OVER (PARTITION BY CASE WHEN id = '.' THEN {dot} ELSE concat(least(id, coalesce({m}, id)), '|', greatest(id, coalesce({m}, id))) END ORDER BY line_no) = 1"
_FIRST = _MATES.format(dot="concat('line|', line_no)", m=_i("MATEID"))


@q("join_bnd_mate", f"WITH {_RECORDS} SELECT line_no, id FROM records WHERE sv_type = 'BND' QUALIFY {_FIRST}")
def _(v):
    return text.first_breakends(_records(v).where("sv_type = 'BND'")).select("line_no", "id")


@q("set_union_events", f"""WITH {_RECORDS}, one AS (SELECT * FROM records WHERE sv_type <> 'BND' UNION ALL (SELECT * FROM records WHERE sv_type = 'BND' QUALIFY {_FIRST}))
 SELECT line_no, sv_type, chrom, pos AS start, CASE WHEN sv_type IN ('BND', 'INS') THEN pos WHEN sv_type = 'SNP' THEN pos + length(ref_) ELSE {_END} END AS "end", {_AF} AS allele_fraction FROM one
 WHERE sv_type <> 'INS' OR (substr(alt, 1, 1) <> '<' AND length(alt) > 1) OR abs(coalesce(TRY_CAST({_i('SVLEN')} AS BIGINT), 0)) > 0
 UNION ALL SELECT event_id + 1000000000, sv_type, chrom, start, "end", vaf FROM sv""")
def _(v):
    e = text.events(v.vcf).select("line_no", "sv_type", "chrom", "start", "end", "allele_fraction")
    return e.unionByName(v.sv.select((F.col("event_id") + 1000000000).alias("line_no"), "sv_type", "chrom", "start", "end", F.col("vaf").alias("allele_fraction")))


_TKIND = f"CASE WHEN {_i('SVTYPE')} IN ('DEL', 'DUP', 'INV', 'INS', 'BND') THEN {_i('SVTYPE')} ELSE 'SNP' END"
_TRUTH = f"body AS ({_BODY}), t AS (SELECT *, {_TKIND} AS sv_type FROM body), one AS (SELECT * FROM t WHERE sv_type <> 'BND' UNION ALL (SELECT * FROM t WHERE sv_type = 'BND' QUALIFY {_MATES.format(dot=chr(39) + '.' + chr(39), m=_i('MATEID'))}))"


@q("src_truth_vcf", f"""WITH {_TRUTH} SELECT line_no, sv_type, CASE WHEN sv_type IN ('BND', 'SNP') THEN greatest(raw_pos - 1, 0) ELSE raw_pos END AS start,
 CASE WHEN sv_type = 'BND' THEN raw_pos WHEN sv_type = 'SNP' THEN greatest(raw_pos - 1, 0) + length(ref_) ELSE coalesce(TRY_CAST({_i('END')} AS BIGINT), raw_pos + 1) END AS "end",
 coalesce(TRY_CAST({_i('SIM_VAF')} AS DOUBLE), 0.5) AS vaf, coalesce({_i('SIM_GENE')}, 'unknown') AS gene FROM one""")
def _(v):
    return text.truth(v.vcf).select("line_no", "sv_type", "start", "end", "vaf", "gene")


@q("join_bnd_truth", f"WITH {_TRUTH} SELECT line_no FROM one WHERE sv_type = 'BND'")
def _(v):
    return text.truth(v.vcf).where("sv_type = 'BND'").select("line_no")


@q("src_truth_dup", f"WITH body AS ({_BODY}) SELECT line_no, chrom, raw_pos - 1 AS start, TRY_CAST({_i('END')} AS BIGINT) AS \"end\", coalesce(TRY_CAST({_i('SIM_VAF')} AS DOUBLE), 0.5) AS vaf FROM body WHERE {_i('SVTYPE')} = 'DUP' AND TRY_CAST({_i('END')} AS BIGINT) IS NOT NULL")
def _(v):
    return text.truth_duplications(v.vcf, one_based=True)


_GT = "split_part(sample, ':', 1) IN ('0/1', '1/0', '0|1', '1|0')"


@q("src_gvcf_het", f"WITH body AS ({_BODY}) SELECT chrom, raw_pos - 1 AS p, ref_ AS ref, split_part(alt, ',', 1) AS alt FROM body WHERE length(ref_) = 1 AND length(split_part(alt, ',', 1)) = 1 AND split_part(alt, ',', 1) NOT IN ('.', '*') AND {_GT} AND raw_pos > 0")
def _(v):
    return text.het_snps(v.vcf)


@q("src_gvcf_region", f"WITH body AS ({_BODY}) SELECT chrom, raw_pos - 1 AS p, ref_ AS ref, split_part(alt, ',', 1) AS alt FROM body WHERE length(ref_) = 1 AND length(split_part(alt, ',', 1)) = 1 AND split_part(alt, ',', 1) NOT IN ('.', '*') AND {_GT} AND chrom = 'chr2' AND raw_pos > 2000 AND raw_pos <= 70000")
def _(v):
    """Heterozygous sites of a region, by the tabix index of block-gzip files."""
    path = temporary(v.spark, "sites")
    gztext.write_variants(v.vcf.where(~F.col("line").startswith("#")), path, v.spark.sparkContext.defaultParallelism)
    region = ("chr2", 2000, 70_000)
    return text.het_snps(gztext.lines(v.spark, path, [region]), region)


@q("sort_hets", f"WITH body AS ({_BODY}) SELECT chrom, raw_pos - 1 AS p FROM body WHERE length(ref_) = 1 AND length(split_part(alt, ',', 1)) = 1 AND split_part(alt, ',', 1) NOT IN ('.', '*') AND {_GT} AND raw_pos > 0 ORDER BY chrom, p")
def _(v):
    return text.het_snps(v.vcf).select("chrom", "p").orderBy("chrom", "p")


@q("flt_truth_del", f"WITH body AS ({_BODY}) SELECT line_no, chrom, raw_pos AS pos, abs(TRY_CAST({_i('SVLEN')} AS BIGINT)) AS size FROM body WHERE {_i('SVTYPE')} = 'DEL' AND abs(TRY_CAST({_i('SVLEN')} AS BIGINT)) BETWEEN 500 AND 50000 AND alt <> '*' AND {_GT}")
def _(v):
    return text.het_deletions(v.vcf)


@q("win_dedup_first", f"WITH body AS ({_BODY}) SELECT line_no FROM body QUALIFY row_number() OVER (PARTITION BY chrom, raw_pos ORDER BY line_no) = 1")
def _(v):
    from ..operators.pool import last_by

    b = v.vcf.where("line <> '#comment'").select("line_no", F.split("line", "\t")[0].alias("c"), F.split("line", "\t")[1].alias("p"))
    return last_by(b, ["c", "p"], ["line_no"], first=True).select("line_no")


@q("src_snp_list", "SELECT concat('chr', p_partkey % 5 + 1) AS chrom, p_partkey * 50 - 1 AS p, 'A' AS ref, 'G' AS alt FROM part WHERE p_size % 9 <> 0")
def _(v):
    p = v.spark.read.parquet(f"{v.sf_dir}/part.parquet")
    line = F.concat(F.lit(" chr"), (F.col("p_partkey") % 5 + 1).cast("string"), F.lit("\t "), (F.col("p_partkey") * 50).cast("string"), F.lit("  a"), F.when(F.col("p_size") % 9 != 0, " g x").otherwise(""))
    return text.snp_list(p.select(line.alias("line")), one_based=True)


@q("src_fasta", "SELECT chrom, chunk_id, seq FROM (SELECT concat('chr', c) AS chrom, k AS chunk_id, substr(s, CAST(k * 32 + 1 AS INT), 32) AS seq FROM (SELECT c, s, unnest(range(0, CAST(floor((length(s) + 31) / 32) AS BIGINT))) AS k FROM (SELECT p_partkey % 5 AS c, string_agg(upper(md5(CAST(p_partkey AS STRING))), '' ORDER BY p_partkey) AS s FROM part GROUP BY 1)))")
def _(v):
    p = v.spark.read.parquet(f"{v.sf_dir}/part.parquet").select((F.col("p_partkey") % 5).alias("c"), F.col("p_partkey").alias("k"))
    body = p.select((F.col("c") * 10**9 + F.col("k") + 1).alias("line_no"), F.md5(F.col("k").cast("string").cast("binary")).alias("line"))
    head = p.select("c").distinct().select((F.col("c") * 10**9).alias("line_no"), F.concat(F.lit(">chr"), F.col("c").cast("string"), F.lit(" made up")).alias("line"))
    return text.fasta_chunks(body.union(head))


@q("src_chrom_len", "SELECT chrom, CAST(sum(length(seq)) AS BIGINT) AS len FROM ref GROUP BY chrom")
def _(v):
    return v.ref.groupBy("chrom").agg(F.sum(F.length("seq")).alias("len"))


@q("agg_genome_size", "SELECT CAST(sum(length(seq)) AS BIGINT) AS bases FROM ref")
def _(v):
    return v.ref.agg(F.sum(F.length("seq")).alias("bases"))


_WHOLE = "whole AS (SELECT chrom, string_agg(seq, '' ORDER BY chunk_id) AS s FROM ref GROUP BY chrom)"


@q("src_ref_mem", f"""WITH {_WHOLE} SELECT event_id, md5(CASE WHEN "end" <= start THEN '' ELSE substr(s, CAST(start + 1 AS INT), CAST("end" - start AS INT)) END) AS h FROM sv JOIN whole USING (chrom)""")
def _(v):
    w = v.sv.select("event_id", "chrom", F.col("start").alias("ref_start"), F.col("end").alias("ref_end"))
    return haplotype.reference_slices(w, v.ref).select("event_id", F.md5(F.col("sequence").cast("binary")).alias("h"))


@q("src_fasta_index", f"""WITH {_WHOLE}, w AS (SELECT event_id, chrom, greatest(start - 50, 0) AS a, least("end" + 50, 1000000000) AS b FROM sv) SELECT event_id, md5(substr(s, CAST(a + 1 AS INT), CAST(b - a AS INT))) AS h, length(s) AS chrom_length FROM w JOIN whole USING (chrom)""")
def _(v):
    """Event windows from FASTA files by their index, clamped to the chromosome."""
    path = temporary(v.spark, "reference")
    fasta.write(v.ref, path, 3)
    w = v.sv.select("event_id", "chrom", (F.col("start") - 50).alias("ref_start"), (F.col("end") + 50).alias("ref_end"))
    cut = fasta.slices(w, path).select("event_id", "chrom", F.md5(F.col("sequence").cast("binary")).alias("h"))
    return cut.join(F.broadcast(fasta.lengths(v.spark, path)), "chrom").select("event_id", "h", F.col("length").alias("chrom_length"))


@q("src_ref_cache", f"""WITH {_WHOLE} SELECT event_id, k, md5(substr(s, CAST(start + 1 AS INT), 100)) AS h FROM sv JOIN whole USING (chrom) CROSS JOIN (VALUES (0), (1), (2)) t(k)""")
def _(v):
    """Regions asked for again and again: each distinct one is cut from the reference once."""
    asked = v.sv.select("event_id", F.explode(F.array(*map(F.lit, range(3)))).alias("k"), "chrom", F.col("start").alias("ref_start"), (F.col("start") + 100).alias("ref_end"))
    return haplotype.reference_slices(asked, v.ref).select("event_id", "k", F.md5(F.col("sequence").cast("binary")).alias("h"))


@q("flt_ref_allele", f"WITH {_WHOLE} SELECT event_id, substr(s, CAST(start + 1 AS INT), CAST(length(ref_allele) AS INT)) = upper(ref_allele) AS ok FROM sv JOIN whole USING (chrom) WHERE sv_type = 'SNP'")
def _(v):
    w = v.sv.where("sv_type = 'SNP'").select("event_id", "chrom", F.col("start").alias("ref_start"), (F.col("start") + F.length("ref_allele")).alias("ref_end"), "ref_allele")
    return haplotype.reference_slices(w, v.ref).select("event_id", (F.col("sequence") == F.upper("ref_allele")).alias("ok"))


@q("flt_af_arg", "SELECT event_id, x > 0 AND x <= 1 AS ok FROM (SELECT event_id, CAST(event_id % 25 - 3 AS DOUBLE) / 20 AS x FROM sv)")
def _(v):
    from .simulate import allowed_fraction

    return v.sv.select("event_id", allowed_fraction((F.col("event_id") % 25 - 3).cast("double") / 20).alias("ok"))


@q("fn_days_to_ymd", "SELECT event_id, CAST(year(d) AS INT) AS year, CAST(month(d) AS INT) AS month, CAST(day(d) AS INT) AS day, strftime(d, '%Y%m%d') AS stamp FROM (SELECT event_id, DATE '1970-01-01' + CAST(event_id * 37 % 60000 AS INT) AS d FROM sv)")
def _(v):
    year, month, day, stamp = sinks.calendar((F.col("event_id") * 37 % 60000).cast("int"))
    return v.sv.select("event_id", year.alias("year"), month.alias("month"), day.alias("day"), stamp.alias("stamp"))


@q("flt_coord", """WITH len AS (SELECT chrom, sum(length(seq)) AS n FROM ref GROUP BY chrom) SELECT event_id, "end" > n - 5000 OR start >= n - 5000 AS outside FROM sv JOIN len USING (chrom)""")
def _(v):
    from .simulate import violations

    n = v.ref.groupBy("chrom").agg((F.sum(F.length("seq")) - 5000).alias("length"))
    sv = v.sv.drop("chrom_b", "bp_b")  # an event's own place only
    bad = violations(sv.where("sv_type <> 'SNP'").unionByName(sv.where("sv_type = 'SNP'").withColumn("ref_allele", F.lit(""))), n, v.ref, allow_overlap=True).where("problem = 'outside its chromosome'").select("event_id").distinct()
    return v.sv.select("event_id").join(bad.withColumn("outside", F.lit(True)), "event_id", "left").select("event_id", F.coalesce("outside", F.lit(False)).alias("outside"))


# --- read predicates


@q("flt_primary", "SELECT name, read_num FROM aln WHERE (flag & 3844) = 0 AND mapq >= 20")
def _(v):
    return v.aln.where(R.primary(F.col("flag"), F.col("mapq"), 20)).select("name", "read_num")


@q("flt_proper", "SELECT name, read_num FROM aln WHERE (flag & 2) <> 0 AND (flag & 8) = 0 AND (flag & 192) <> 0")
def _(v):
    return v.aln.where(R.proper_pair(F.col("flag"))).select("name", "read_num")


@q("flt_global", "SELECT name, read_num FROM aln WHERE (flag & 2308) = 0")
def _(v):
    return v.aln.where(R.globally_counted(F.col("flag"))).select("name", "read_num")


@q("flt_insert", "SELECT name FROM pairs WHERE abs(insert_size) > 0 AND abs(insert_size) < 10000")
def _(v):
    return v.pairs.where(R.usable_insert(F.col("insert_size"))).select("name")


@q("flt_tlen_pos", "SELECT name FROM aln WHERE (flag & 2) <> 0 AND (flag & 8) = 0 AND (flag & 192) <> 0 AND tlen > 0")
def _(v):
    return v.aln.where(R.proper_pair(F.col("flag")) & (F.col("tlen") > 0)).select("name")


@q("flt_sa", "SELECT name, read_num FROM aln WHERE sa IS NOT NULL")
def _(v):
    return v.aln.where(F.col("sa").isNotNull()).select("name", "read_num")


@q("flt_event_region", """SELECT event_id FROM sv WHERE sv_type = 'DUP' AND chrom = 'chr2' AND start >= 5000 AND "end" <= 60000""")
def _(v):
    return v.sv.where((F.col("sv_type") == "DUP") & (F.col("chrom") == "chr2") & (F.col("start") >= 5000) & (F.col("end") <= 60000)).select("event_id")


# --- sinks


@q("sink_fastq", "SELECT name, md5(concat('@', name, '/1', chr(10), seq, chr(10), '+', chr(10), qual)) AS h FROM aln WHERE read_num = 1")
def _(v):
    r = v.aln.where("read_num = 1").select("name", F.col("seq").alias("seq1"), F.col("qual").alias("qual1"))
    return sinks.fastq(r, 1).select("name", F.md5(F.col("value").cast("binary")).alias("h"))


@q("sink_fastq_files", "SELECT a.name, a.seq AS seq1, a.qual AS qual1, b.seq AS seq2, b.qual AS qual2 FROM aln a JOIN aln b ON a.name = b.name AND a.read_num = 1 AND b.read_num = 2")
def _(v):
    """Pairs written as FASTQ in one job and read again: record k of a part of R1 and of R2 are mates."""
    path = temporary(v.spark, "reads")
    end = lambda n: v.aln.where(F.col("read_num") == n).select("name", F.col("seq").alias(f"seq{n}"), F.col("qual").alias(f"qual{n}"))
    sinks.write_fastq(end(1).join(end(2).hint("merge"), "name"), path)
    return sinks.read_fastq(v.spark, path)


_TR = """SELECT event_id, 0 AS part, chrom, CASE WHEN sv_type IN ('SNP', 'BND') THEN start + 1 ELSE start END AS pos, CASE sv_type WHEN 'SNP' THEN concat('sim_var_', event_id) WHEN 'BND' THEN concat('sim_fus_', event_id) ELSE concat('sim_', lower(sv_type), '_', event_id) END AS id,
 CASE sv_type WHEN 'SNP' THEN alt_allele WHEN 'BND' THEN CASE WHEN inverted THEN concat('N]', chrom_b, ':', bp_b + 1, ']') ELSE concat('N[', chrom_b, ':', bp_b + 1, '[') END ELSE concat('<', sv_type, '>') END AS alt, CASE WHEN vaf >= 0.9 THEN '1/1' ELSE '0/1' END AS gt FROM sv
 UNION ALL SELECT event_id, 1, chrom_b, bp_b + 1, concat('sim_fus_', event_id, '_mate'), CASE WHEN inverted THEN concat('[', chrom, ':', start + 1, '[N') ELSE concat(']', chrom, ':', start + 1, ']N') END, CASE WHEN vaf >= 0.9 THEN '1/1' ELSE '0/1' END FROM sv WHERE sv_type = 'BND'"""


@q("sink_truth", _TR)
def _(v):
    e = v.sv.withColumn("allele_fraction", F.col("vaf")).withColumn("gene_b", F.lit("other")).withColumn("exons", F.array().cast("array<string>"))
    return sinks.truth_records(e).select("event_id", "part", "chrom", "pos", "id", "alt", "gt")


@q("sink_bed", """SELECT event_id, chrom, greatest(start - 10000, 0) AS start, CASE WHEN sv_type = 'BND' THEN start ELSE "end" END + 10000 AS "end" FROM sv UNION ALL SELECT event_id, chrom_b, greatest(bp_b - 10000, 0), bp_b + 10000 FROM sv WHERE sv_type = 'BND'""")
def _(v):
    return sinks.event_regions(v.sv, 10000)


@q("sink_tsv", "SELECT event_id, concat_ws(chr(9), chrom, CAST(start AS STRING), CAST(\"end\" AS STRING), gene) AS line FROM sv WHERE sv_type = 'DUP'")
def _(v):
    return v.sv.where("sv_type = 'DUP'").select("event_id", F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), "gene").alias("line"))
