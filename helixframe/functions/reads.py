"""Predicates and derived columns of alignments, read pairs and events."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# SAM flag bits
PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, FIRST, LAST = 0x2, 0x4, 0x8, 0x10, 0x40, 0x80
SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 0x100, 0x200, 0x400, 0x800


def flagged(flag: Column, bits: int) -> Column:
    """Any of bits is set."""
    return flag.bitwiseAND(F.lit(bits)) != 0


def primary(flag: Column, mapq: Column, min_mapq: int) -> Column:
    """Mapped, primary, not a duplicate, not failed, and of at least min_mapq (missing: 0)."""
    return ~flagged(flag, UNMAPPED | SECONDARY | SUPPLEMENTARY | DUPLICATE | QC_FAIL) & (F.coalesce(mapq, F.lit(0)) >= min_mapq)


def proper_pair(flag: Column) -> Column:
    """Properly paired, mate mapped, first or last of its pair."""
    return flagged(flag, PROPER) & ~flagged(flag, MATE_UNMAPPED) & flagged(flag, FIRST | LAST)


def globally_counted(flag: Column) -> Column:
    """As the global checks count: mapped and primary; duplicates and failed reads stay."""
    return ~flagged(flag, UNMAPPED | SECONDARY | SUPPLEMENTARY)


def usable_insert(size: Column) -> Column:
    return (F.abs(size) > 0) & (F.abs(size) < 10000)


def pair_end(pos1: Column, len1: Column, tlen1: Column, pos2: Column, len2: Column, tlen2: Column) -> Column:
    """End of a fragment: its start plus the first template length that is not 0, else the farther read's end."""
    start = F.least(pos1, pos2)
    return F.when(tlen1 != 0, start + F.abs(tlen1)).when(tlen2 != 0, start + F.abs(tlen2)).otherwise(F.greatest(pos1 + len1, pos2 + len2))


def primary_region(sv_type: Column, start: Column, end: Column, ref_allele: Column) -> tuple[Column, Column]:
    """An event's own interval: a point for insertions, REF's length for small variants, none for fusions."""
    lo = F.when(sv_type != "BND", start)
    hi = F.when(sv_type == "INS", start).when(sv_type == "SNP", start + F.length(ref_allele)).when(sv_type != "BND", end)
    return lo, hi


def event_label(sv_type: Column, chrom: Column, start: Column, end: Column) -> Column:
    return F.concat(sv_type, F.lit(" "), chrom, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def run_label(sv_type: Column, chrom: Column, start: Column, end: Column, gene: Column) -> Column:
    return F.concat(event_label(sv_type, chrom, start, end), F.when(gene.isNull() | (gene == "unknown"), "").otherwise(F.concat(F.lit(" ("), gene, F.lit(")"))))


def allele_fraction(kind: Column, value: Column, default: float, het_draw: Column) -> Column:
    """An event's fraction: exact value, 1 for hom, the draw for het, else the run's default."""
    return F.when(kind == "exact", value).when(kind == "hom", 1.0).when(kind == "het", het_draw).otherwise(F.lit(default))


def genotype(vaf: Column) -> Column:
    return F.when(vaf >= 0.9, "1/1").otherwise("0/1")
