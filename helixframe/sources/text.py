"""Line formats read with Spark's text reader: variants, intervals, sequences, alignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import vcf
from ..functions.sequence import is_dna
from . import bgzf, gztext


def lines(spark: SparkSession, path: str, regions: list[tuple[str, int, int]] | None = None) -> DataFrame:
    """(line_no, line, file): plain or gzip files; line numbers rise along each file, with gaps.

    Block-gzip files are read in ranges of their blocks, and with regions by their tabix index
    where they have one; lines of other files are not looked at for regions.

    A line's number is its split's first byte plus its place among the task's lines. A split
    has no more lines than bytes, and only a file's last split shares its task with others, so
    the order within a file is right however Spark deals the splits.
    """
    if gztext.is_blocked(path):
        return gztext.lines(spark, path, regions if regions is not None and bgzf.size_of(f"{path}.tbi") is not None else None)
    at = F.col("_metadata.file_block_start")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    raw = spark.read.text(path).select(F.col("value").alias("line"), (F.when(at > 0, at + 1).otherwise(0) + place).alias("line_no"), F.col("_metadata.file_path").alias("file"))
    return raw.select("line_no", "line", "file")


def _field(i: int, by: str = "\t") -> Column:
    return F.get(F.split("line", by), F.lit(i))


def exons(text: DataFrame) -> DataFrame:
    """(line_no, chrom, start, end, name, gene) of BED lines; blank, comment and track lines are skipped.

    The gene is the fifth column, else the name up to its first _. Fewer than four columns are an error.
    """
    body = text.where((F.trim("line") != "") & ~F.col("line").startswith("#") & ~F.col("line").startswith("track"))
    body = body.withColumn("n", F.size(F.split("line", "\t")))
    ok = F.when(F.col("n") >= 4, _field(1).cast("bigint")).otherwise(F.raise_error(F.concat(F.lit("a BED line has fewer than 4 columns: "), F.col("line"))).cast("bigint"))
    gene = F.coalesce(F.nullif(_field(4), F.lit("")), F.get(F.split(_field(3), "_"), F.lit(0)))
    return body.select("line_no", _field(0).alias("chrom"), ok.alias("start"), _field(2).cast("bigint").alias("end"), _field(3).alias("name"), gene.alias("gene"))


def genes(ex: DataFrame) -> DataFrame:
    """(gene, chrom, start, end, exons): bounds of each gene and chromosome, exons numbered by start (ties as in the file)."""
    g = ex.groupBy("gene", "chrom").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sort_array(F.collect_list(F.struct("start", "line_no", "end", "name"))).alias("e"))
    return g.select("gene", "chrom", "start", "end", F.transform("e", lambda x, i: F.struct((i + 1).alias("number"), x["start"].alias("start"), x["end"].alias("end"), x["name"].alias("name"))).alias("exons"))


def numbered_exons(ex: DataFrame) -> DataFrame:
    return ex.withColumn("number", F.row_number().over(Window.partitionBy("gene", "chrom").orderBy("start", "line_no")))


def _records(text: DataFrame, least: int = 8) -> DataFrame:
    body = text.where(~F.col("line").startswith("#") & (F.size(F.split("line", "\t")) >= least))
    return body.select("line_no", _field(0).alias("chrom"), _field(1).try_cast("bigint").alias("raw_pos"), _field(2).alias("id"), _field(3).alias("ref"), _field(4).alias("alt"), _field(7).alias("info"), _field(9).alias("sample"))


def variant_records(text: DataFrame) -> DataFrame:
    """(line_no, chrom, pos, id, ref, alt, info, sv_type) of variant lines.

    DEL, INS, DUP, INV and BND by SVTYPE; without one, records whose alleles are bases are SNP.
    Others, and those without a position from 1, are skipped. Positions of breakends and
    small variants become 0-based; those of the others already name the base before, which
    is the 0-based start.
    """
    r = _records(text).where("raw_pos > 0")
    kind = vcf.info_value(F.col("info"), "SVTYPE")
    sv = F.when(kind.isin("DEL", "INS", "DUP", "INV", "BND"), kind).when(kind.isNull() & is_dna(F.col("ref")) & is_dna(F.col("alt")), "SNP")
    r = r.withColumn("sv_type", sv).where("sv_type is not null")
    return r.select("line_no", "chrom", F.when(F.col("sv_type").isin("BND", "SNP"), F.col("raw_pos") - 1).otherwise(F.col("raw_pos")).alias("pos"), "id", "ref", "alt", "info", "sv_type")


def first_breakends(records: DataFrame, dots_are_ids: bool = False) -> DataFrame:
    """Breakend records without the second of each pair of mates. Records with the id . are never collapsed, unless dots_are_ids (as truth files are read)."""
    mate = F.coalesce(vcf.info_value(F.col("info"), "MATEID"), F.col("id"))
    pair = F.concat(F.least("id", mate), F.lit("|"), F.greatest("id", mate))
    key = pair if dots_are_ids else F.when(F.col("id") == ".", F.concat(F.lit("line|"), F.col("line_no").cast("string"))).otherwise(pair)
    if dots_are_ids:
        key = F.when(F.col("id") == ".", F.lit(".")).otherwise(pair)
    w = Window.partitionBy("__pair").orderBy("line_no")
    return records.withColumn("__pair", key).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__pair")


def events(text: DataFrame) -> DataFrame:
    """One row for each event of a variant file, in file order (line_no)."""
    r = variant_records(text)
    r = r.where("sv_type <> 'BND'").unionByName(first_breakends(r.where("sv_type = 'BND'")))
    seq, size = vcf.inserted(F.col("alt"), F.col("info"))
    chrom_b, bp_b, inverted = vcf.partner(F.col("alt"))
    bnd, ins, snp = (F.col("sv_type") == k for k in ("BND", "INS", "SNP"))
    end = F.when(bnd | ins, F.col("pos")).when(snp, F.col("pos") + F.length("ref")).otherwise(vcf.end_of(F.col("pos"), F.col("info")))
    out = r.select(
        "line_no", "sv_type", "chrom", F.col("pos").alias("start"), end.alias("end"),
        F.when(bnd, chrom_b).alias("chrom_b"), F.when(bnd, bp_b).alias("bp_b"), F.when(bnd, inverted).alias("inverted"),
        F.when(ins, seq).alias("ins_seq"), F.when(ins, size).alias("ins_len"),
        F.when(snp, F.col("ref")).alias("ref_allele"), F.when(snp, F.col("alt")).alias("alt_allele"),
        F.coalesce(vcf.info_value(F.col("info"), "GENE_A"), F.lit("unknown")).alias("gene_a"), F.coalesce(vcf.info_value(F.col("info"), "SIM_GENE"), F.lit("unknown")).alias("sim_gene"),
        F.when(bnd, F.coalesce(vcf.info_value(F.col("info"), "GENE_B"), F.lit("unknown"))).alias("gene_b"),
        vcf.info_fraction(F.col("info")).alias("allele_fraction"),
    )
    out = out.withColumn("gene", F.when(F.col("sv_type") == "BND", F.col("gene_a")).otherwise(F.col("sim_gene"))).drop("gene_a", "sim_gene")
    return out.where((F.col("sv_type") != "INS") | F.col("ins_len").isNotNull())


def truth(text: DataFrame) -> DataFrame:
    """(line_no, sv_type, chrom, start, end, vaf, gene, ref_allele, alt_allele) of a truth file: any type but the five is SNP."""
    r = _records(text).where("raw_pos is not null").withColumn("kind", vcf.info_value(F.col("info"), "SVTYPE"))
    r = r.withColumn("sv_type", F.when(F.col("kind").isin("DEL", "DUP", "INV", "INS", "BND"), F.col("kind")).otherwise("SNP"))
    r = r.where("sv_type <> 'BND'").unionByName(first_breakends(r.where("sv_type = 'BND'"), dots_are_ids=True))
    before = F.greatest(F.col("raw_pos") - 1, F.lit(0))
    bnd, snp = (F.col("sv_type") == k for k in ("BND", "SNP"))
    start = F.when(bnd | snp, before).otherwise(F.col("raw_pos"))
    end = F.when(bnd, F.col("raw_pos")).when(snp, before + F.length("ref")).otherwise(F.coalesce(vcf.info_long(F.col("info"), "END"), F.col("raw_pos") + 1))
    return r.select("line_no", "sv_type", "chrom", start.alias("start"), end.alias("end"), F.coalesce(vcf.info_value(F.col("info"), "SIM_VAF").try_cast("double"), F.lit(0.5)).alias("vaf"), F.coalesce(vcf.info_value(F.col("info"), "SIM_GENE"), F.lit("unknown")).alias("gene"), F.col("ref").alias("ref_allele"), F.col("alt").alias("alt_allele"))


def truth_duplications(text: DataFrame, one_based: bool = False) -> DataFrame:
    """(line_no, chrom, start, end, vaf) of DUP records with an END."""
    r = _records(text)
    end = vcf.info_long(F.col("info"), "END")
    r = r.where((vcf.info_value(F.col("info"), "SVTYPE") == "DUP") & end.isNotNull() & F.col("raw_pos").isNotNull())
    return r.select("line_no", "chrom", (F.col("raw_pos") - int(one_based)).alias("start"), end.alias("end"), F.coalesce(vcf.info_value(F.col("info"), "SIM_VAF").try_cast("double"), F.lit(0.5)).alias("vaf"))


def het_snps(text: DataFrame, region: tuple[str, int, int] | None = None) -> DataFrame:
    """(chrom, p, ref, alt) of heterozygous single bases of the first sample; of several alternatives the first counts."""
    r = _records(text, 10).withColumn("p", F.col("raw_pos") - 1).withColumn("a", F.get(F.split("alt", ","), F.lit(0)))
    gt = F.get(F.split("sample", ":"), F.lit(0))
    ok = (F.length("ref") == 1) & (F.length("a") == 1) & ~F.col("a").isin(".", "*") & gt.isin("0/1", "1/0", "0|1", "1|0")
    if region:
        ok = ok & (F.col("chrom") == region[0]) & F.col("p").between(region[1], region[2] - 1)
    return r.where(ok & (F.col("p") >= 0)).select("chrom", "p", F.col("ref"), F.col("a").alias("alt")).orderBy("chrom", "p")


def het_deletions(text: DataFrame, least: int = 500, most: int = 50000) -> DataFrame:
    """Heterozygous deletions of a size range, as a benchmark's truth is cut."""
    size = F.abs(vcf.info_long(F.col("info"), "SVLEN"))
    gt = F.get(F.split("sample", ":"), F.lit(0))
    return _records(text, 10).where((vcf.info_value(F.col("info"), "SVTYPE") == "DEL") & size.between(least, most) & (F.col("alt") != "*") & gt.isin("0/1", "1/0", "0|1", "1|0")).select("line_no", "chrom", F.col("raw_pos").alias("pos"), size.alias("size"))


def snp_list(text: DataFrame, one_based: bool = False) -> DataFrame:
    """(chrom, p, ref, alt) of lines with at least four fields between white space."""
    f = lambda i: F.get(F.split(F.trim("line"), r"\s+"), F.lit(i))
    body = text.where(~F.col("line").startswith("#") & (F.size(F.split(F.trim("line"), r"\s+")) >= 4))
    return body.select(f(0).alias("chrom"), (f(1).try_cast("bigint") - int(one_based)).alias("p"), F.upper(f(2)).alias("ref"), F.upper(f(3)).alias("alt")).where("p is not null")


def fasta_chunks(text: DataFrame, chunk: int = 32, width: int = 1 << 20) -> DataFrame:
    """(chrom, chunk_id, seq) of a FASTA file's lines (line_no, line, and file where there are several).

    Lines are ordered within stretches of width line numbers. Which chromosome a stretch begins
    in, and how many of its bases came before, is carried from a table of one row a stretch, so
    no chromosome is ordered in one task.
    """
    rows = text if "file" in text.columns else text.withColumn("file", F.lit(""))
    head = F.col("line").startswith(">")
    rows = rows.select("file", "line_no", F.floor(F.col("line_no") / width).alias("part"), F.when(head, F.get(F.split(F.substring("line", 2, 1000), r"\s+"), F.lit(0))).alias("named"), F.when(~head, F.upper(F.trim("line"))).alias("body"))
    rows = rows.withColumn("n", F.coalesce(F.length("body"), F.lit(0)).cast("bigint"))
    upto = Window.partitionBy("file", "part").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # bases of the stretch up to each line, and those up to its last header
    rows = rows.withColumn("sum", F.sum("n").over(upto))
    rows = rows.withColumn("last", F.last(F.when(F.col("named").isNotNull(), F.struct("named", "sum")), True).over(upto))
    parts = rows.groupBy("file", "part").agg(F.sum("n").alias("n"), F.max_by("last", "line_no").alias("last"))
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("begin", F.coalesce(F.sum("n").over(before), F.lit(0)))
    parts = parts.withColumn("held", F.last(F.when(F.col("last").isNotNull(), F.struct(F.col("last.named").alias("named"), (F.col("begin") + F.col("last.sum")).alias("sum"))), True).over(before))
    t = rows.join(parts.select("file", "part", "begin", "held"), ["file", "part"]).where("n > 0")
    here = F.col("last").isNotNull()
    chrom = F.when(here, F.col("last.named")).otherwise(F.col("held.named"))
    at = F.col("begin") + F.col("sum") - F.col("n") - F.when(here, F.col("begin") + F.col("last.sum")).otherwise(F.col("held.sum"))
    t = t.select(chrom.alias("chrom"), at.alias("at"), F.col("body").alias("line")).where("chrom is not null")
    first, last = F.floor(F.col("at") / chunk), F.floor((F.col("at") + F.length("line") - 1) / chunk)
    p = t.select("chrom", "at", "line", F.explode(F.sequence(first, last)).alias("chunk_id"))
    lo = F.greatest(F.col("chunk_id") * chunk - F.col("at"), F.lit(0))
    hi = F.least((F.col("chunk_id") + 1) * chunk - F.col("at"), F.length("line"))
    p = p.select("chrom", "chunk_id", "at", F.substring(F.col("line"), (lo + 1).cast("int"), (hi - lo).cast("int")).alias("part"))
    return p.groupBy("chrom", "chunk_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), "").alias("seq"))


def sam(text: DataFrame) -> DataFrame:
    """The alignment table (name, flag, chrom, pos, mapq, cigar, mate_pos, tlen, seq, qual, sa) of SAM lines; positions 0-based."""
    body = text.where(~F.col("line").startswith("@") & (F.size(F.split("line", "\t")) >= 11))
    rest = F.slice(F.split("line", "\t"), 12, 1000)
    sa = F.get(F.filter(rest, lambda x: x.startswith("SA:Z:")), F.lit(0))
    star = lambda c: F.nullif(c, F.lit("*"))
    return body.select("line_no", _field(0).alias("name"), _field(1).cast("int").alias("flag"), star(_field(2)).alias("chrom"), (_field(3).cast("bigint") - 1).alias("pos"), _field(4).cast("int").alias("mapq"), star(_field(5)).alias("cigar"), (_field(7).cast("bigint") - 1).alias("mate_pos"), _field(8).cast("int").alias("tlen"), _field(9).alias("seq"), _field(10).alias("qual"), F.substring(sa, 6, 2**31 - 1).alias("sa"))
