"""Fields of variant records as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def info_value(info: Column, key: str) -> Column:
    """The first value of key in an INFO string, null without one."""
    hit = F.get(F.filter(F.split(info, ";"), lambda x: x.startswith(key + "=")), F.lit(0))
    return F.substring(hit, len(key) + 2, 2**31 - 1)


def info_long(info: Column, key: str) -> Column:
    return info_value(info, key).try_cast("bigint")


def info_fraction(info: Column) -> Column:
    """The first of SIM_VAF, VAF, AF that is a number in (0, 1]."""
    found = [info_value(info, k).try_cast("double") for k in ("SIM_VAF", "VAF", "AF")]
    return F.coalesce(*[F.when((v > 0) & (v <= 1), v) for v in found])


def end_of(pos: Column, info: Column) -> Column:
    """END, else pos + |SVLEN|, else pos + 1."""
    return F.coalesce(info_long(info, "END"), pos + F.abs(info_long(info, "SVLEN")), pos + 1)


def inserted(alt: Column, info: Column) -> tuple[Column, Column]:
    """(sequence, length) of an insertion: ALT without its first base if it is spelled out, else |SVLEN|; null length: no insertion."""
    seq = F.when(~alt.startswith("<") & (F.length(alt) > 1), F.substring(alt, 2, 2**31 - 1))
    size = F.abs(F.coalesce(info_long(info, "SVLEN"), F.lit(0)))
    return seq, F.coalesce(F.length(seq).cast("bigint"), F.when(size > 0, size))


def partner(alt: Column) -> tuple[Column, Column, Column]:
    """(chromosome, 0-based position, inverted) of a breakend's ALT; inverted if both brackets are ]."""
    inner = r"[\[\]]([^:\[\]]+):([0-9]+)[\[\]]"
    chrom = F.nullif(F.regexp_extract(alt, inner, 1), F.lit(""))
    pos = F.greatest(F.regexp_extract(alt, inner, 2).try_cast("bigint") - 1, F.lit(0))
    return chrom, pos, alt.rlike(r"\][^\[\]]*\]")
