"""How real simulated duplications look: depth, reads across the junction and allele balance, a row for each event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.reads import globally_counted, primary
from ..operators import pileup
from ..operators.intervals import overlap_join

COLUMNS = (
    "event_id", "chrom", "start", "end", "len", "expected_vaf", "event_depth", "left_depth", "right_depth", "flank_depth", "coverage_ratio",
    "junction_sa_reads", "junction_softclip_reads", "window_reads", "baf_sites", "baf_used", "baf_mean", "baf_median", "baf_max_dev",
)
#: Records of the junction counts: duplicates count, others that are not primary don't.
_FAILED = 512


def good_only(aln: DataFrame, least_quality: int) -> DataFrame:
    """aln with N for every base below least_quality; bases without a quality become N too."""
    q = F.split("qual", "")
    base = F.zip_with(F.split("seq", ""), q, lambda b, x: F.when((b != "") & (F.ascii(F.coalesce(x, F.lit(""))) - 33 >= least_quality), b).otherwise(F.when(b.isNull(), "").otherwise("N")))
    return aln.withColumn("seq", F.array_join(base, ""))


def report(dups: DataFrame, aln: DataFrame, snps: DataFrame | None = None, window: int = 500, flank: int = 5000, min_mapq: int = 20, min_quality: int = 20, least: int = 10) -> DataFrame:
    """COLUMNS of every duplication (event_id from 0 in file order, chrom, start, end, vaf).

    Depth is good bases of primary records for each base of the event and of both flanks;
    flank_depth is the flanks' mean, coverage_ratio null without any. Junction reads are
    distinct names with a split alignment or a soft clip at an end, among all records of
    window_reads that overlap the event widened by window. Allele balance is over snps (chrom,
    p, ref, alt) within the event with at least `least` good bases of both alleles together;
    its figures are null without any, baf_sites without a list. An empty event counts as one base.
    """
    e = dups.select("event_id", "chrom", F.greatest("start", F.lit(0)).alias("start"), "vaf", "end").withColumn("end", F.greatest("end", F.col("start") + 1))
    s, n = F.col("start"), F.col("end")
    w = F.array(*[F.struct(F.lit(k).alias("kind"), a.alias("g_start"), b.alias("g_end")) for k, a, b in (("event", s, n), ("left", F.greatest(s - flank, F.lit(0)), s), ("right", n, n + flank))])
    windows = e.select("event_id", F.col("chrom").alias("g_chrom"), F.explode(w).alias("w")).select(F.struct("event_id", "w.kind").alias("key"), "g_chrom", "w.g_start", "w.g_end")
    good = aln.where(primary(F.col("flag"), F.col("mapq"), min_mapq))
    bases = pileup.good_bases(good, windows, "key", min_quality)
    width = windows.select("key", (F.col("g_end") - F.col("g_start")).alias("width"))
    depth = width.join(bases, "key", "left").select("key.*", F.when(F.col("width") > 0, F.coalesce("n", F.lit(0)) / F.col("width")).otherwise(0.0).alias("d"))
    of = lambda k: F.max(F.when(F.col("kind") == k, F.col("d"))).alias(f"{k}_depth")
    depth = depth.groupBy("event_id").agg(of("event"), of("left"), of("right"))

    near = aln.where(globally_counted(F.col("flag")) & (F.col("flag").bitwiseAND(_FAILED) == 0) & (F.col("mapq") >= min_mapq))
    end = F.array_max(F.transform(pileup.aligned_blocks(F.col("cigar"), F.col("pos")), lambda b: b["ref"] + b["len"]))
    near = near.select("name", F.col("chrom").alias("a_chrom"), "pos", end.alias("a_end"), F.col("sa").isNotNull().alias("split"), F.col("cigar").rlike("^([0-9]+H)?[0-9]+S|[0-9]+S([0-9]+H)?$").alias("soft"))
    around = e.select("event_id", F.col("chrom").alias("g_chrom"), F.greatest(s - window, F.lit(0)).alias("g_start"), (n + window).alias("g_end"))
    met = overlap_join(near, around, ("a_chrom", "pos", "a_end"), ("g_chrom", "g_start", "g_end"))
    names = lambda c: F.count_distinct(F.when(F.col(c), F.col("name")))
    junction = met.groupBy("event_id").agg(names("split").alias("junction_sa_reads"), names("soft").alias("junction_softclip_reads"), F.count("*").alias("window_reads"))

    out = e.join(depth, "event_id").join(junction, "event_id", "left")
    if snps is not None:
        inside = overlap_join(snps.withColumn("p_end", F.col("p") + 1), e.select("event_id", F.col("chrom").alias("g_chrom"), F.col("start").alias("g_start"), F.col("end").alias("g_end")), ("chrom", "p", "p_end"), ("g_chrom", "g_start", "g_end")).select("event_id", "chrom", "p", "ref", "alt")
        pile = pileup.piled_at(good_only(good, min_quality), inside.select("chrom", "p"))
        balance = pileup.allele_balance(pile, inside, ["event_id"], least)
        out = out.join(inside.groupBy("event_id").agg(F.count("*").alias("baf_sites")), "event_id", "left").join(balance, "event_id", "left").withColumn("baf_sites", F.coalesce("baf_sites", F.lit(0)))
    else:
        out = out.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("baf_sites", "long"), ("n_sites", "long"), ("mean", "double"), ("median", "double"), ("max_deviation", "double"))])
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    both = (F.col("left_depth") + F.col("right_depth")) / 2
    return out.select(
        "event_id", "chrom", "start", "end", (n - s).alias("len"), F.col("vaf").alias("expected_vaf"), "event_depth", "left_depth", "right_depth", both.alias("flank_depth"), F.when(both > 0, F.col("event_depth") / both).alias("coverage_ratio"),
        zero("junction_sa_reads"), zero("junction_softclip_reads"), zero("window_reads"), "baf_sites", F.coalesce("n_sites", F.lit(0)).alias("baf_used"), F.col("mean").alias("baf_mean"), F.col("median").alias("baf_median"), F.col("max_deviation").alias("baf_max_dev"),
    )


def lines(rows: DataFrame) -> DataFrame:
    """(event_id, line): the report's tab-separated lines; NA for what is not there."""
    four = lambda c: F.when(F.col(c).isNull(), "NA").otherwise(F.format_string("%.4f", F.col(c)))
    shown: list[Column] = []
    for c in COLUMNS:
        decimal = c in ("expected_vaf", "coverage_ratio") or c.endswith("_depth") or c in ("baf_mean", "baf_median", "baf_max_dev")
        shown.append(F.concat(F.lit("dup_"), (F.col(c) + 1).cast("string")) if c == "event_id" else four(c) if decimal else F.coalesce(F.col(c).cast("string"), F.lit("NA")))
    return rows.select("event_id", F.concat_ws("\t", *shown).alias("line"))
