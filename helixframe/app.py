"""From files to files: python -m helixframe.app simulate|validate|merge|dup-report|recovery ...

Alignments are a .sam or .bam file or a Parquet table with the alignment columns; the reference
is FASTA, events are specs and variant files, exons BED. All paths are Hadoop paths or URIs,
but BAM files, which pyarrow opens. CRAM has to be converted first.
"""

from __future__ import annotations

import argparse
import posixpath
import shlex
import sys
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import recovery
from .functions import specs
from .functions.reads import primary
from .operators import pileup, pool, rng
from .operators.intervals import overlap_join
from .plans import dup_report, simulate, validate
from .sources import bam, bgzf, fasta, sinks, text

EVENTS = "event_id long, sv_type string, chrom string, start long, end long, chrom_b string, bp_b long, inverted boolean, ins_seq string, ins_len long, ref_allele string, alt_allele string, gene string, gene_b string, exons array<string>, allele_fraction double"
ORDER = ["chrom", "pos", "name", "flag"]
_HET_SHAPE = 40.0
#: Bases beyond an event's flanks that new fragments may reach: twice the longest usable insert.
_AROUND = 20_000


class InputError(ValueError):
    pass


def alignments(spark: SparkSession, path: str) -> DataFrame:
    """(name, flag, chrom, pos, mapq, cigar, mate_pos, tlen, seq, qual, sa) of a file or table."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "cram":
        raise InputError(f"CRAM is not read; convert it: samtools view -b -T REFERENCE -o OUT.bam {shlex.quote(path)}")
    if kind == "bam":
        return bam.read(spark, path)
    return text.sam(text.lines(spark, path)).drop("line_no") if kind == "sam" else spark.read.parquet(path)


#: Records with one of these flags are no evidence: unmapped, secondary, failed, duplicate, supplementary.
_NOT_PRIMARY = 4 | 256 | 512 | 1024 | 2048


def region_alignments(spark: SparkSession, path: str, events: DataFrame, flank: int, min_mapq: int) -> DataFrame:
    """The primary records of a BAM file near the events, read by its index.

    Events with their flanks are read first, for the longest template; then the same regions
    widened by that and 200, or by 1000 at least, so that mates outside are there as well.
    """
    spans = [(r.chrom, r.start, r.end) for r in sinks.event_regions(events, flank).toLocalIterator()]
    wanted = {"mapq": min_mapq, "no_flags": _NOT_PRIMARY}
    longest = bam.read(spark, path, ["tlen"], spans, **wanted).agg(F.max(F.abs(F.col("tlen").cast("long")))).first()[0] or 0
    pad = max(1000, longest + 200)
    return bam.read(spark, path, regions=[(c, max(0, s - pad), e + pad) for c, s, e in spans], **wanted)


def fraction(spec: specs.Fraction | None, key: int, seed: int) -> float | None:
    """An event's allele fraction: exact, 1, or for het a draw of a Beta distribution around one half that seed and event decide."""
    if spec is None:
        return None
    if spec.kind != "het":
        return 1.0 if spec.kind == "hom" else spec.value
    import numpy as np

    return float(np.random.Generator(np.random.Philox(key=[seed, key])).beta(_HET_SHAPE, _HET_SHAPE))


def load_events(spark: SparkSession, given: list[str], vcf: str | None, exon_bed: str | None, seed: int) -> DataFrame:
    """Events of specs, then those of a variant file in its order, numbered from 1."""
    exons = [r.asDict() for r in text.exons(text.lines(spark, exon_bed)).orderBy("line_no").toLocalIterator()] if exon_bed else []  # a gene panel, whose genes specs name
    rows = []
    for i, spec in enumerate(given, 1):
        e = specs.parse_event(spec, exons)
        rows.append((i, e.sv_type, e.chrom, e.start, e.end, e.chrom_b, e.bp_b, e.inverted, e.ins_seq, e.ins_len, e.ref_allele, e.alt_allele, e.gene, e.gene_b, list(e.exons), fraction(e.fraction, i, seed)))
    out = spark.createDataFrame(rows, EVENTS)
    if vcf:
        read = text.events(text.lines(spark, vcf)).withColumn("exons", F.array().cast("array<string>"))
        # numbered in the file's own order; a run's events are a small table
        numbered = read.withColumn("event_id", F.row_number().over(Window.orderBy("line_no")).cast("long") + len(rows))
        out = out.unionByName(numbered.select(*out.columns))
    return out


def haplotype_evidence(aln: DataFrame, events: DataFrame, gvcf: DataFrame | None, default_fraction: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """votes (event_id, name, side) and alleles (event_id, chrom, p, allele) of deletions and duplications near one half.

    Heterozygous sites come from gvcf (chrom, p, ref, alt), else from the pileup over the events.
    """
    near = events.withColumn("vaf", F.coalesce("allele_fraction", F.lit(default_fraction))).where(F.col("sv_type").isin("DEL", "DUP") & F.col("vaf").between(0.3, 0.7))
    spans = near.select("event_id", F.col("chrom").alias("g_chrom"), F.col("start").alias("g_start"), F.col("end").alias("g_end"))
    known = gvcf is not None
    if known:
        het = gvcf.select("chrom", "p", F.col("ref").alias("allele1"), F.col("alt").alias("allele2"))
    else:
        het = pileup.het_sites(pileup.piled(validate.covering(aln, spans.drop("event_id"))))
    sites = overlap_join(het.withColumn("p_end", F.col("p") + 1), spans, ("chrom", "p", "p_end"), ("g_chrom", "g_start", "g_end"))
    u = rng.uniform(F.concat_ws(":", F.col("event_id").cast("string"), "chrom", F.col("p").cast("string")), f"{seed}:target")
    target, other = F.when(u < 0.5, F.col("allele1")).otherwise(F.col("allele2")), F.when(u < 0.5, F.col("allele2")).otherwise(F.col("allele1"))
    sites = sites.select("event_id", "chrom", "p", target.alias("target"), other.alias("other"))
    votes = pileup.votes(pileup.at_sites(aln, sites, ["name"]), "any" if known else "listed", ["event_id", "name"])
    return votes.select("event_id", "name", "side"), sites.select("event_id", "chrom", "p", F.col("target").alias("allele"))


def write_text(spark: SparkSession, path: str, lines) -> None:
    """A small text file at a Hadoop path, from lines as they come."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        for line in lines:
            out.write(bytearray((line + "\n").encode()))
    finally:
        out.close()


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def run_simulate(spark: SparkSession, a: argparse.Namespace) -> None:
    if not a.event and not a.vcf:
        raise InputError("no events: give --event or --vcf")
    events = load_events(spark, a.event, a.vcf, a.exon_bed, a.seed)
    region = specs.parse_region(a.region) if a.region else None
    aln = alignments(spark, a.bam)
    order = [c for c in ORDER if c in aln.columns]
    if a.bam.lower().endswith(".bam"):
        first = bam.head(spark, a.bam, validate.HEAD["insert"], no_flags=_NOT_PRIMARY)
        if bam.indexed(a.bam):
            aln = region_alignments(spark, a.bam, events, a.flank, a.min_mapq)
    else:
        first = pool.head(aln.where(primary(F.col("flag"), F.col("mapq"), 0)), order, validate.HEAD["insert"])
    read_length = round(pool.alignment_stats(first, 0).first().read_length)
    config = simulate.Config(a.allele_fraction, a.flank, read_length, a.min_mapq, a.seed, a.indel_error_rate, a.dup_model, a.allow_overlap, region)
    if fasta.indexed(a.reference):  # only what the events' surroundings need
        lengths = fasta.lengths(spark, a.reference)
        chunks = fasta.chunks(spark, a.reference, sinks.event_regions(events, a.flank + _AROUND).join(lengths, "chrom", "left_semi"))
    else:
        lengths, chunks = None, text.fasta_chunks(text.lines(spark, a.reference))
    usable = pool.usable(aln, a.min_mapq)
    spans = [(r.chrom, r.start, r.end) for r in sinks.event_regions(events, 0).toLocalIterator()]
    gvcf = text.het_snps(text.lines(spark, a.gvcf, spans)) if a.gvcf else None
    votes, alleles = haplotype_evidence(aln.where(primary(F.col("flag"), F.col("mapq"), a.min_mapq)), events, gvcf, a.allele_fraction, a.seed)
    out = simulate.run(events, pool.paired(usable, [c for c in ("chrom", "pos") if c in aln.columns]), chunks, config, votes, alleles, lengths)
    at = lambda name: posixpath.join(a.output, name)
    # both files and the count read the pairs from one table, so that the simulation runs once
    out["pairs"].write.mode("overwrite").parquet(at("_pairs"))
    pairs = spark.read.parquet(at("_pairs"))
    sinks.write_fastq(pairs, a.output, a.partitions)
    total = pairs.count()
    remove(spark, at("_pairs"))
    now = datetime.now(timezone.utc)
    records = sinks.truth_lines(sinks.truth_records(events, a.allele_fraction)).orderBy("event_id", "part")
    write_text(spark, at("truth.vcf"), [*sinks.truth_header(a.reference, now.strftime("%Y%m%d")), *(r.line for r in records.toLocalIterator())])
    regions = sinks.event_regions(events, a.flank).orderBy("chrom", "start", "end").toLocalIterator()
    write_text(spark, at("events.bed"), (f"{r.chrom}\t{r.start}\t{r.end}" for r in regions))
    write_text(spark, at("align.sh"), [sinks.align_script(a.aligner, a.reference, at("R1"), at("R2"), at("sim.bam"), a.threads, a.samtools)])
    write_text(spark, at("merge.sh"), [sinks.merge_script(a.bam, at("events.bed"), at("sim.bam"), at("merged.bam"), a.threads, a.samtools)])
    rows = [r.line for r in sinks.run_log_rows(events, out["dispositions"], a.allele_fraction).orderBy("event_id").toLocalIterator()]
    files = {"R1, R2": "read pairs, gzip FASTQ in parts", "truth.vcf": "the events", "events.bed": "the events' regions", "align.sh": "aligns the pairs", "merge.sh": "puts the aligned pairs in place of the regions' reads"}
    write_text(spark, at("README.md"), sinks.run_log(shlex.join(a.command), {"Alignments": a.bam, "Reference": a.reference, "Flank": a.flank}, rows, total, files, now.strftime("%Y-%m-%d %H:%M:%S UTC")).split("\n"))


def run_checks(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, dict[str, str]]:
    """The checks' rows, and the errors of those that could not be run."""
    aln = alignments(spark, a.bam)
    truth = text.truth(text.lines(spark, a.truth)).withColumn("event_id", F.col("line_no"))
    good = aln.where(primary(F.col("flag"), F.col("mapq"), a.min_mapq))
    end = F.array_max(F.transform(pileup.aligned_blocks(F.col("cigar"), F.col("pos")), lambda b: b["ref"] + b["len"]))
    reads = good.select("name", "chrom", F.col("pos").alias("ref_start"), end.alias("ref_end"), F.col("sa").isNotNull().alias("has_sa")).where("ref_end is not null")
    return validate.run_each(validate.parts(truth, reads, aln, [c for c in ORDER if c in aln.columns], a.flank, min_mapq=a.min_mapq))


def run_validate(spark: SparkSession, a: argparse.Namespace) -> bool:
    """Prints the report; whether all checks pass."""
    checks, errors = run_checks(spark, a)
    for r in sinks.check_lines(checks, a.json).toLocalIterator():
        print(r.line)
    n = validate.summary(checks).first()
    print(f"{n.passed}/{n.total} checks passed" + (f", {len(errors)} could not be run" if errors else ""), file=sys.stderr)
    return validate.passed(checks)


def run_dup_report(spark: SparkSession, a: argparse.Namespace) -> None:
    """The duplications' report as a tab-separated file."""
    dups = text.truth_duplications(text.lines(spark, a.truth), a.truth_1based)
    dups = dups.withColumn("event_id", F.row_number().over(Window.orderBy("line_no")) - 1)  # a run's events: a small table
    if dups.isEmpty():
        raise InputError("no duplication in the truth file")
    if a.event:
        parts = a.event.replace("-", ":").split(":")
        if len(parts) != 3 or not all(x.isdigit() for x in parts[1:]):
            raise InputError(f"an event is chr:start-end, not {a.event!r}")
        dups = dups.where((F.col("chrom") == parts[0]) & (F.col("start") >= int(parts[1])) & (F.col("end") <= int(parts[2])))
        if dups.isEmpty():
            raise InputError("no duplication is the event")
    dups = dups.orderBy("event_id").limit(a.max_events) if a.max_events > 0 else dups
    if a.bam.lower().endswith(".bam") and bam.indexed(a.bam):
        wide = max(a.coverage_flank, a.junction_window)
        spans = [(r.chrom, max(0, r.start - wide), r.end + wide) for r in dups.select("chrom", "start", "end").toLocalIterator()]
        aln = bam.read(spark, a.bam, regions=spans, mapq=a.min_mapq, no_flags=4 | 256)
    else:
        aln = alignments(spark, a.bam)
    snps = text.snp_list(text.lines(spark, a.snp_list), a.snp_list_1based) if a.snp_list else None
    rows = dup_report.report(dups, aln, snps, a.junction_window, a.coverage_flank, a.min_mapq, a.min_baseq, a.min_baf_depth)
    write_text(spark, a.out, ["\t".join(dup_report.COLUMNS), *(r.line for r in dup_report.lines(rows).orderBy("event_id").toLocalIterator())])


def run_merge(spark: SparkSession, a: argparse.Namespace, show: bool = True) -> None:
    """The original records outside the events' regions and the new alignments, as a folder of sorted, indexed BAM files."""
    if not a.bam.lower().endswith(".bam"):
        raise InputError("merge takes its chromosomes from a BAM file's header: give --bam a .bam")
    names, lengths, _ = bam.read_header(bgzf.files(a.bam, ".bam")[0])
    regions = text.lines(spark, a.bed).where("trim(line) <> '' and line not like '#%'").select(*[F.get(F.split("line", "\t"), F.lit(i)).cast(t).alias(c) for i, (c, t) in enumerate((("chrom", "string"), ("start", "long"), ("end", "long")))])
    merged = sinks.merged_alignments(alignments(spark, a.bam), regions, alignments(spark, a.aligned))
    bam.write(merged, a.output, list(zip(names, lengths)), a.partitions, mode="overwrite")
    for r in sinks.part_bounds(bam.read(spark, a.output, ["chrom", "pos", "file", "voffset"])).orderBy("file").toLocalIterator() if show else ():
        print(f"{posixpath.basename(r.file)}\t{r.records}\t{r.first_chrom}:{r.first_pos}\t{r.last_chrom}:{r.last_pos}")


def parser() -> argparse.ArgumentParser:
    # Option names and defaults of a published command line.
    top = argparse.ArgumentParser(prog="helixframe")
    sub = top.add_subparsers(dest="what", required=True)
    s = sub.add_parser("simulate")
    s.add_argument("--bam", required=True)
    s.add_argument("--reference", required=True)
    s.add_argument("--event", action="append", default=[])
    s.add_argument("--vcf")
    s.add_argument("--exon-bed")
    s.add_argument("--allele-fraction", type=float, default=0.5)
    s.add_argument("--output", required=True)
    s.add_argument("--seed", type=int, default=42)
    s.add_argument("--threads", type=int, default=4)
    s.add_argument("--region")
    s.add_argument("--flank", type=int, default=10_000)
    s.add_argument("--min-mapq", type=int, default=20)
    s.add_argument("--aligner", default="bwa-mem2")
    s.add_argument("--samtools", default="samtools")
    s.add_argument("--indel-error-rate", type=float, default=0.0)
    s.add_argument("--gvcf")
    s.add_argument("--allow-overlap", action="store_true")
    s.add_argument("--dup-model", default="full", choices=("full", "junction"))
    s.add_argument("--partitions", type=int, default=8, help="parts of each FASTQ folder")
    v = sub.add_parser("validate")
    v.add_argument("--bam", required=True)
    v.add_argument("--truth", required=True)
    v.add_argument("--min-mapq", type=int, default=20)
    v.add_argument("--flank", type=int, default=5000)
    v.add_argument("--json", action="store_true")
    m = sub.add_parser("merge")
    m.add_argument("--bam", required=True)
    m.add_argument("--aligned", required=True)
    m.add_argument("--bed", required=True)
    m.add_argument("--output", required=True)
    m.add_argument("--partitions", type=int, default=8)
    d = sub.add_parser("dup-report")
    d.add_argument("--bam", required=True)
    d.add_argument("--truth", required=True)
    d.add_argument("--out", default="dup_realism_report.tsv")
    d.add_argument("--junction-window", type=int, default=500)
    d.add_argument("--coverage-flank", type=int, default=5000)
    d.add_argument("--min-mapq", type=int, default=20)
    d.add_argument("--min-baseq", type=int, default=20)
    d.add_argument("--min-baf-depth", type=int, default=10)
    d.add_argument("--snp-list")
    d.add_argument("--snp-list-1based", action="store_true")
    d.add_argument("--truth-1based", action="store_true")
    d.add_argument("--max-events", type=int, default=0)
    d.add_argument("--event")
    r = sub.add_parser("recovery")
    r.add_argument("--bam", required=True, help="the background")
    r.add_argument("--reference", required=True)
    r.add_argument("--truth", required=True)
    r.add_argument("--benchmark")
    r.add_argument("--output", required=True)
    r.add_argument("--fractions", default="0.5,0.25,0.1")
    r.add_argument("--chrom")
    r.add_argument("--least", type=int, default=500)
    r.add_argument("--most", type=int, default=50_000)
    r.add_argument("--seed", type=int, default=42)
    r.add_argument("--flank", type=int, default=10_000)
    r.add_argument("--min-mapq", type=int, default=20)
    r.add_argument("--distance", type=int, default=500)
    r.add_argument("--ratio", type=float, default=0.5)
    r.add_argument("--skip-to", type=int, default=1, help="a stage's number; those before are taken as they are")
    r.add_argument("--stop-after", choices=("truth", "simulate", "merge", "validate", "score", "summary"))
    return top


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    """The exit status: 0, or 1 if a check fails, none could be run or the input is wrong."""
    a = parser().parse_args(argv)
    a.command = ["helixframe", *argv]
    spark = spark or SparkSession.builder.appName("helixframe").getOrCreate()
    try:
        if a.what == "simulate":
            run_simulate(spark, a)
            return 0
        if a.what in ("merge", "dup-report"):
            (run_merge if a.what == "merge" else run_dup_report)(spark, a)
            return 0
        if a.what == "recovery":
            print("stages run: " + (", ".join(recovery.Recovery(spark, a).run()) or "none"))
            return 0
        return 0 if run_validate(spark, a) else 1
    except (InputError, simulate.EventError, specs.SpecError, validate.NoChecks, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
