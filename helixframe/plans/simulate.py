"""All events of a run in one plan: pools, haplotypes, suppression, new reads, sinks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import emission, haplotype, intervals, pool, quality, simulate


@dataclass(frozen=True)
class Config:
    allele_fraction: float = 0.5
    flank: int = 10_000
    read_length: int = 150
    min_mapq: int = 20
    seed: int = 42
    indel_rate: float = 0.0
    dup_model: str = "full"
    allow_overlap: bool = False
    region: tuple[str, int, int] | None = None

    def __post_init__(self):
        if not 0 < self.allele_fraction <= 1 or self.dup_model not in ("full", "junction"):
            raise ValueError("the allele fraction lies in (0, 1] and dup_model is full or junction")


def allowed_fraction(value: Column) -> Column:
    """Whether an allele fraction lies in (0, 1]."""
    return F.coalesce((value > 0) & (value <= 1), F.lit(False))


class EventError(ValueError):
    pass


def _footprints(events: DataFrame) -> DataFrame:
    """(event_id, chrom, start, end): what events may not share, one base at each of a fusion's breakpoints."""
    own = events.select("event_id", "chrom", "start", "end")
    if "chrom_b" not in events.columns:
        return own
    return own.unionByName(events.where("sv_type = 'BND'").select("event_id", F.col("chrom_b").alias("chrom"), F.col("bp_b").alias("start"), F.col("bp_b").alias("end")))


def violations(events: DataFrame, lengths: DataFrame, chunks: DataFrame, allow_overlap: bool = False) -> DataFrame:
    """(event_id, problem): events outside their chromosome, empty ones, alleles unlike the reference, overlaps."""
    j = events.join(lengths, "chrom", "left")
    outside = F.col("length").isNull() | (F.col("start") < 0) | (F.col("end") > F.col("length")) | (F.col("start") >= F.col("length"))
    empty = F.col("sv_type").isin("DEL", "DUP", "INV") & (F.col("start") >= F.col("end"))
    bad = j.withColumn("problem", F.when(outside, "outside its chromosome").when(empty, "empty")).where("problem is not null").select("event_id", "problem")
    if "chrom_b" in events.columns:
        far = events.where("sv_type = 'BND'").select("event_id", "chrom_b", "bp_b").join(lengths.select(F.col("chrom").alias("chrom_b"), "length"), "chrom_b", "left")
        far = far.where(F.col("length").isNull() | (F.col("bp_b") < 0) | (F.col("bp_b") >= F.col("length"))).select("event_id", F.lit("outside its chromosome").alias("problem"))
        bad = bad.unionByName(far).distinct()
    small = events.where("sv_type = 'SNP'").select("event_id", "chrom", F.col("start").alias("ref_start"), (F.col("start") + F.length("ref_allele")).alias("ref_end"), F.upper("ref_allele").alias("ref_allele"))
    unlike = haplotype.reference_slices(small, chunks).where("sequence <> ref_allele").select("event_id", F.lit("its allele is not the reference's").alias("problem"))
    out = bad.unionByName(unlike)
    if not allow_overlap:
        out = out.unionByName(intervals.self_overlaps(_footprints(events)).where("id_a <> id_b").distinct().select(F.col("id_a").alias("event_id"), F.concat(F.lit("overlaps event "), F.col("id_b").cast("string")).alias("problem")))
    return out


def chrom_lengths(chunks: DataFrame, chunk: int = haplotype.CHUNK) -> DataFrame:
    """(chrom, length) of a reference in chunks."""
    return chunks.groupBy("chrom").agg(F.max(F.col("chunk_id") * chunk + F.length("seq")).alias("length"))


def checked(events: DataFrame, lengths: DataFrame, chunks: DataFrame, allow_overlap: bool = False) -> DataFrame:
    """events, or an error that names the first ten problems, or that there is no event."""
    if events.isEmpty():
        raise EventError("no events")
    first = violations(events, lengths, chunks, allow_overlap).orderBy("event_id", "problem").limit(10).collect()
    if first:
        raise EventError("; ".join(f"event {r.event_id}: {r.problem}" for r in first))
    return events


def event_pairs(events: DataFrame, pairs: DataFrame, flank: int, region: tuple[str, int, int] | None = None) -> DataFrame:
    """Pairs with the events whose scanned region they overlap; a fusion scans around both breakpoints, and a pair in both counts twice.

    Regions on the chromosome of region (0-based, half-open) are widened to hold it.
    """
    def around(c, s, e):
        lo, hi = F.greatest(s - flank, F.lit(0)), e + flank
        if region:
            there = c == region[0]
            lo, hi = F.when(there, F.least(lo, F.lit(region[1]))).otherwise(lo), F.when(there, F.greatest(hi, F.lit(region[2]))).otherwise(hi)
        return F.struct(c.alias("g_chrom"), lo.alias("g_start"), hi.alias("g_end"))

    one, other = around(F.col("chrom"), F.col("start"), F.col("end")), around(F.col("chrom_b"), F.col("bp_b"), F.col("bp_b"))
    regions = events.select("event_id", F.explode(F.when(F.col("sv_type") == "BND", F.array(one, other)).otherwise(F.array(one))).alias("g")).select("event_id", "g.*")
    return intervals.overlap_join(pairs, regions, ("chrom", "ref_start", "ref_end"), ("g_chrom", "g_start", "g_end"), max(intervals.BIN, flank)).drop("g_chrom", "g_start", "g_end")


def copy_fragments(copies: DataFrame, chunks: DataFrame, alleles: DataFrame | None, read_length: int) -> DataFrame:
    """(event_id, name, fragment) of jittered depth copies: the reference there, with the alleles of the event's haplotype."""
    spans = copies.select("event_id", F.xxhash64("name").alias("seg"), F.concat(F.format_string("ev%04d_dup_depth_", "event_id"), "name").alias("name"), "chrom", F.col("new_start").alias("ref_start"), (F.col("new_start") + F.col("new_len")).alias("ref_end"), F.lit(False).alias("reverse"))
    own = haplotype.reference_slices(spans, chunks).withColumn("len", F.length("sequence").cast("bigint"))
    if alleles is not None:
        own = haplotype.applied(own, alleles)
    return own.where(F.col("len") >= read_length).select("event_id", "name", F.col("sequence").alias("fragment"))


def run(events: DataFrame, pairs: DataFrame, chunks: DataFrame, config: Config, votes: DataFrame | None = None, alleles: DataFrame | None = None, lengths: DataFrame | None = None) -> dict[str, DataFrame]:
    """pairs and dispositions of a simulation.

    events as haplotype.segments() takes them, with allele_fraction; pairs as pool.paired()
    gives them; votes (event_id, name, side) where haplotypes are known, and alleles (event_id,
    chrom, p, allele) of the haplotype that a duplication doubles, which its new reads carry.
    Events are checked first. Returns "pairs" (originals that stay and new ones, one for each
    name) and "dispositions" (kept, suppressed, chimeric).

    Qualities follow a profile of each event's own pairs, which meets its fragments in a join.
    """
    checked(events, chrom_lengths(chunks) if lengths is None else lengths, chunks, config.allow_overlap)
    e = events.withColumn("vaf", F.coalesce("allele_fraction", F.lit(config.allele_fraction)))
    e = e.withColumn("ins_seq", F.when((F.col("sv_type") == "INS") & F.col("ins_seq").isNull(), simulate.random_bases(F.col("event_id"), F.col("ins_len"), config.seed)).otherwise(F.col("ins_seq")))
    segs = haplotype.with_sequences(haplotype.segments(e, config.dup_model), chunks)
    if alleles is not None:
        doubled = e.where((F.col("sv_type") == "DUP") & simulate.by_haplotype(F.col("sv_type"), F.col("vaf"))).select("event_id")
        alleles = alleles.join(doubled, "event_id", "left_semi")
        segs = haplotype.applied(segs, alleles).drop("n_variants")
    haps = haplotype.haplotypes(segs)
    own = event_pairs(e, pairs, config.flank, config.region)
    lengths = pool.fragment_lengths(own, ["event_id"])
    sides = own.withColumn("side", F.lit(None).cast("string")) if votes is None else own.join(votes.select("event_id", "name", "side"), ["event_id", "name"], "left")
    placed = sides.join(e.select("event_id", "sv_type", "vaf", F.col("start").alias("sv_lo"), F.col("end").alias("sv_hi")), "event_id").join(haps.select("event_id", F.col("ref_lo").alias("hap_lo"), F.col("ref_hi").alias("hap_hi")), "event_id")
    judged = simulate.suppression(placed, config.seed, config.dup_model)

    first_bp = haps.select("event_id", F.greatest(F.get("breakpoints", F.lit(0)) - 1, F.lit(0)).alias("hap_pos"))
    at = haplotype.to_reference(first_bp, segs).join(e.select("event_id", "chrom", "start"), "event_id").select("event_id", "chrom", F.coalesce("ref_pos", "start").alias("pos"))
    cover = intervals.coverage_at(pairs, at, "event_id")
    plan = haps.join(lengths, "event_id").join(cover, "event_id").join(e.select("event_id", "sv_type", "vaf"), "event_id")
    plan = plan.withColumn("near_breakpoints", simulate.additive(F.col("sv_type"), config.dup_model))
    plan = plan.withColumn("n_tiles", simulate.tile_count(F.col("coverage"), F.col("vaf"), F.greatest("mean", F.lit(simulate.LEAST_FRAGMENT)), F.col("total_len"), F.col("ref_len"), F.size("breakpoints"), F.col("near_breakpoints")))
    tiles = simulate.tiles(plan, config.read_length, config.seed)
    frags = tiles.join(haps.select("event_id", "sequence"), "event_id").select("event_id", F.format_string("ev%04d_hap_%06d", "event_id", "attempt").alias("name"), F.substring(F.col("sequence"), (F.col("hap_start") + 1).cast("int"), F.col("frag_len").cast("int")).alias("fragment"))
    if config.dup_model == "junction":
        copies = simulate.depth_copies(placed, config.seed).join(lengths.select("event_id", "lengths"), "event_id")
        moved = simulate.jittered(copies, read_length=config.read_length, seed=config.seed)
        frags = frags.unionByName(copy_fragments(moved, chunks, alleles, config.read_length))
    bins = quality.bins(quality.histograms(quality.observations(own, config.read_length, ["event_id"]), ["event_id"]), ["event_id"])
    new = emission.emitted(frags, bins, config.read_length, config.seed, config.indel_rate)
    kept = judged.where("disposition = 'kept'").select("event_id", "name", "seq1", "qual1", "seq2", "qual2", F.lit("kept").alias("disposition"))
    every = kept.unionByName(new.withColumn("disposition", F.lit("chimeric")))
    dispositions = judged.select("event_id", "name", "disposition").unionByName(frags.select("event_id", "name", F.lit("chimeric").alias("disposition")))
    return {"pairs": simulate.without_repeats(every, "event_id"), "dispositions": dispositions}
