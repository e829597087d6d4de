"""The command line's small languages: regions, fractions, events.

Parsers of single strings run on the driver; event_columns() reads a column of event specs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, functions as F


class SpecError(ValueError):
    pass


@dataclass(frozen=True)
class Fraction:
    """kind is exact, het or hom."""

    kind: str
    value: float | None = None


@dataclass(frozen=True)
class Event:
    sv_type: str
    chrom: str | None = None
    start: int | None = None
    end: int | None = None
    chrom_b: str | None = None
    bp_b: int | None = None
    inverted: bool = False
    ins_seq: str | None = None
    ins_len: int | None = None
    ref_allele: str | None = None
    alt_allele: str | None = None
    gene: str = "unknown"
    gene_b: str | None = None
    exons: tuple[str, ...] = ()
    fraction: Fraction | None = None


def _number(text: str, what: str) -> int:
    if not re.fullmatch(r"[0-9]+", text):
        raise SpecError(f"{what} is not a number: {text!r}")
    return int(text)


def parse_region(text: str) -> tuple[str, int, int]:
    """CHR:A-B, 1-based and inclusive with optional commas, as a 0-based half-open interval."""
    m = re.fullmatch(r"([^:]+):([0-9,]+)-([0-9,]+)", text.strip())
    if not m:
        raise SpecError(f"a region is CHR:START-END, not {text!r}")
    a, b = (_number(x.replace(",", ""), "region bound") for x in m.groups()[1:])
    if a == 0 or a > b:
        raise SpecError(f"region bounds must be at least 1 and in order: {text!r}")
    return m[1], a - 1, b


def parse_fraction(text: str) -> Fraction:
    """het, hom, or a number in (0, 1]."""
    t = text.strip().lower()
    if t in ("het", "hom"):
        return Fraction(t)
    try:
        v = float(t)
    except ValueError:
        raise SpecError(f"an allele fraction is a number, het or hom, not {text!r}") from None
    if not 0 < v <= 1:
        raise SpecError(f"an allele fraction lies in (0, 1]: {text!r}")
    return Fraction("exact", v)


def parse_exon(text: str) -> int:
    return _number(re.sub(r"(?i)^exon", "", text.strip()), "exon")


class Genes:
    """Exons by gene, found whatever the case; of genes with equal names the first counts."""

    def __init__(self, exons: list[dict]):
        self.by_name: dict[str, dict] = {}
        for row in sorted(exons, key=lambda r: (r["chrom"], r["start"])):
            g = self.by_name.setdefault(row["gene"].lower(), {"gene": row["gene"], "chrom": row["chrom"], "exons": []})
            if g["chrom"] == row["chrom"]:
                g["exons"].append(row)

    def exon(self, gene: str, number: int) -> tuple[dict, dict]:
        g = self.by_name.get(gene.lower())
        if g is None:
            raise SpecError(f"gene {gene!r} is not among the exons given")
        if not 1 <= number <= len(g["exons"]):
            raise SpecError(f"{gene} has no exon {number}")
        return g, g["exons"][number - 1]


_DNA = re.compile(r"[ACGTacgt]+")


def _interval(kind: str, args: list[str], genes: Genes) -> Event:
    if len(args) < 2:
        raise SpecError(f"{kind} takes CHR:START-END or GENE:exonN-exonM")
    lo, dash, hi = args[1].partition("-")
    if not dash:
        raise SpecError(f"{kind} takes a range, not {args[1]!r}")
    if lo.isdigit() and hi.isdigit():
        a, b = int(lo), int(hi)
        if a == 0 or a >= b:
            raise SpecError(f"{kind} needs 1 <= start < end: {args[1]!r}")
        return Event(kind.upper(), args[0], a, b)
    n, m = sorted((parse_exon(lo), parse_exon(hi)))
    g, first = genes.exon(args[0], n)
    _, last = genes.exon(args[0], m)
    return Event(kind.upper(), g["chrom"], first["start"], last["end"], gene=g["gene"], exons=tuple(x["name"] for x in g["exons"][n - 1 : m]))


def _fusion(args: list[str], genes: Genes) -> Event:
    if len(args) < 4:
        raise SpecError("fusion takes GENE_A:exonN:GENE_B:exonM[:inv]")
    a, exon_a = genes.exon(args[0], parse_exon(args[1]))
    b, exon_b = genes.exon(args[2], parse_exon(args[3]))
    return Event("BND", a["chrom"], exon_a["end"], exon_a["end"], b["chrom"], exon_b["start"], len(args) > 4 and args[4].lower() == "inv", gene=a["gene"], gene_b=b["gene"])


def _insertion(args: list[str], _: Genes) -> Event:
    if len(args) < 3:
        raise SpecError("ins takes CHR:POS:LENGTH or CHR:POS:SEQUENCE")
    pos = _number(args[1], "position")
    if args[2].isdigit():
        if int(args[2]) == 0:
            raise SpecError("an insertion has at least one base")
        return Event("INS", args[0], pos, pos, ins_len=int(args[2]))
    if not _DNA.fullmatch(args[2]):
        raise SpecError(f"an insertion is a length or bases, not {args[2]!r}")
    return Event("INS", args[0], pos, pos, ins_seq=args[2].upper(), ins_len=len(args[2]))


def _small(args: list[str], _: Genes) -> Event:
    if len(args) < 3:
        raise SpecError("snp takes CHR:POS:REF:ALT or CHR:POS:REF>ALT")
    pos = _number(args[1], "position")
    ref, alt = (args[2], args[3]) if len(args) > 3 else args[2].partition(">")[::2]
    if pos == 0 or not _DNA.fullmatch(ref) or not _DNA.fullmatch(alt) or ref == alt:
        raise SpecError(f"snp needs a position from 1 and two unlike alleles of bases: {args!r}")
    return Event("SNP", args[0], pos - 1, pos - 1 + len(ref), ref_allele=ref.upper(), alt_allele=alt.upper())


_KINDS = {"del": lambda a, g: _interval("del", a, g), "dup": lambda a, g: _interval("dup", a, g), "inv": lambda a, g: _interval("inv", a, g), "fusion": _fusion, "ins": _insertion, "snp": _small}


def parse_event(text: str, exons: list[dict] = ()) -> Event:
    """One event spec: KIND:ARGS[;af=VALUE]. Kinds are read in any case; other options are errors."""
    body, *options = text.split(";")
    kind, *args = body.split(":")
    if kind.lower() not in _KINDS:
        raise SpecError(f"unknown event type {kind!r}")
    event = _KINDS[kind.lower()](args, Genes(list(exons)))
    for option in filter(None, map(str.strip, options)):
        key, eq, value = option.partition("=")
        if not eq or key.strip().lower() != "af":
            raise SpecError(f"unknown event option {option!r}")
        event = replace(event, fraction=parse_fraction(value))
    return event


def event_columns(spec: Column) -> dict[str, Column]:
    """Coordinates and fraction of a column of del, dup, inv, ins and snp specs, for tables of many events."""
    parts = F.split(F.get(F.split(spec, ";"), F.lit(0)), ":")
    part = lambda i: F.get(parts, F.lit(i))
    kind = F.upper(part(0))
    bounds = F.split(part(2), "-")
    option = F.lower(F.trim(F.get(F.split(spec, ";"), F.lit(1))))
    af = F.when(option.startswith("af="), F.substring(option, 4, 1000))
    number = af.try_cast("double")
    start = F.when(kind == "SNP", part(2).try_cast("bigint") - 1).when(kind == "INS", part(2).try_cast("bigint")).otherwise(F.get(bounds, F.lit(0)).try_cast("bigint"))
    end = F.when(kind == "SNP", start + F.length(part(3))).when(kind == "INS", start).otherwise(F.get(bounds, F.lit(1)).try_cast("bigint"))
    return {
        "sv_type": kind,
        "chrom": part(1),
        "start": start,
        "end": end,
        "ins_len": F.when(kind == "INS", F.coalesce(part(3).try_cast("bigint"), F.length(part(3)).cast("bigint"))),
        "af_kind": F.when(af.isin("het", "hom"), af).when((number > 0) & (number <= 1), "exact"),
        "af_value": F.when((number > 0) & (number <= 1), number),
    }
