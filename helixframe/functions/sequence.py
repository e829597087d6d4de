"""Bases and qualities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BASES = "ACGT"


def revcomp(seq: Column) -> Column:
    """Reverse complement, case kept; other symbols stay as they are."""
    return F.translate(F.reverse(seq), "ACGTacgt", "TGCAtgca")


def complement(base: Column) -> Column:
    """Complement of upper-case bases only."""
    return F.translate(base, BASES, "TGCA")


def orient(seq: Column, qual: Column, reverse: Column) -> tuple[Column, Column]:
    """Sequence and qualities as sequenced: turned around for reads on the reverse strand."""
    return F.when(reverse, revcomp(seq)).otherwise(seq), F.when(reverse, F.reverse(qual)).otherwise(qual)


def fetch_upper(seq: Column, start: Column, end: Column) -> Column:
    """Bases [start, end) of seq in upper case; empty if the range is."""
    return F.when(start >= end, "").otherwise(F.upper(F.substring(seq, (start + 1).cast("int"), (end - start).cast("int"))))


def is_dna(allele: Column) -> Column:
    """Not empty, and bases only in either case; N is none."""
    return F.coalesce(allele.rlike("^[ACGTacgt]+$"), F.lit(False))


def base_index(base: Column) -> Column:
    """0 to 3 for A, C, G, T in either case, else null."""
    at = F.locate(F.upper(base), F.lit(BASES)) if isinstance(base, str) else F.instr(F.lit(BASES), F.upper(base))
    return F.when((F.length(base) == 1) & (at > 0), at - 1)


def phred(symbol: Column) -> Column:
    return F.greatest(F.ascii(symbol) - 33, F.lit(0))


def previous_bin(quality: Column) -> Column:
    """0-9: 0, 10-19: 1, 20-29: 2, else 3."""
    return F.least(F.floor(quality / 10), F.lit(3)).cast("int")


def error_probability(quality: Column) -> Column:
    return F.pow(F.lit(10.0), -F.greatest(quality, F.lit(0)) / 10.0)


def mean_phred(qual: Column) -> Column:
    """Mean quality of a string of symbols; 0 if empty."""
    n = F.length(qual)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0).cast("bigint"), lambda a, i: a + phred(F.substring(qual, i, F.lit(1))))
    return F.when(n > 0, total / n).otherwise(0.0)


def truncated(text: Column, most: int) -> Column:
    """The first most characters, three of them dots if any are cut."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 3), F.lit("...")))


def json_escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
