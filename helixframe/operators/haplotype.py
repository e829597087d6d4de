"""Variant haplotypes as ordered segments of the reference and of new sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.sequence import complement, revcomp
from .intervals import overlap_join

FLANK = 2000
CHUNK = 32
#: Chunks of the reference that meet segments as one row.
BLOCK = 64
#: Segments that an event's haplotype has at most, as segments() makes them.
USUAL = 4


def _segment(chrom, start, end, reverse=False, novel=None):
    """A struct of one segment; novel sequence has no origin."""
    none = F.lit(None)
    return F.struct(
        (none.cast("string") if novel is not None else chrom).alias("chrom"),
        (none.cast("bigint") if novel is not None else start).alias("ref_start"),
        (none.cast("bigint") if novel is not None else end).alias("ref_end"),
        (F.lit(False) if isinstance(reverse, bool) and not reverse else F.lit(reverse) if isinstance(reverse, bool) else reverse).alias("reverse"),
        (novel if novel is not None else none.cast("string")).alias("novel"),
    )


def segments(events: DataFrame, dup_model: str = "full", flank: int = FLANK) -> DataFrame:
    """(event_id, seg, chrom, ref_start, ref_end, reverse, novel) in haplotype order.

    events: event_id, sv_type (DEL, DUP, INV, INS, BND, SNP), chrom, start, end, chrom_b, bp_b,
    inverted, ins_seq, ref_allele, alt_allele. Left flanks stop at 0; right flanks do not stop
    at the chromosome's end here, only their sequence does.
    """
    c, s, e = F.col("chrom"), F.col("start"), F.col("end")
    left, right = lambda at: F.greatest(at - flank, F.lit(0)), lambda at: at + flank
    after = s + F.length("ref_allele")
    same = F.length("ref_allele") == F.length("alt_allele")
    inverted = F.coalesce(F.col("inverted"), F.lit(False))
    small = F.struct(F.when(same, c).alias("chrom"), F.when(same, s).alias("ref_start"), F.when(same, after).alias("ref_end"), F.lit(False).alias("reverse"), F.col("alt_allele").alias("novel"))
    dup = [_segment(c, left(s), s), _segment(c, s, e), _segment(c, s, e), _segment(c, e, right(e))] if dup_model == "full" else [_segment(c, left(e), e), _segment(c, s, right(s))]
    built = {
        "DEL": [_segment(c, left(s), s), _segment(c, e, right(e))],
        "DUP": dup,
        "INV": [_segment(c, left(s), s), _segment(c, s, e, True), _segment(c, e, right(e))],
        "INS": [_segment(c, left(s), s), _segment(c, s, s, novel=F.col("ins_seq")), _segment(c, s, right(s))],
        "BND": [_segment(c, left(s), s), _segment(F.col("chrom_b"), F.col("bp_b"), F.col("bp_b") + flank, inverted)],
        "SNP": [_segment(c, left(s), s), small, _segment(c, after, right(after))],
    }
    chosen = None
    for kind, parts in built.items():
        branch = F.array(*parts)
        chosen = F.when(F.col("sv_type") == kind, branch) if chosen is None else chosen.when(F.col("sv_type") == kind, branch)
    return events.select("event_id", F.posexplode(chosen).alias("seg", "s")).select("event_id", "seg", "s.*")


def _blocks(chunks: DataFrame, chunk: int, texts: bool) -> DataFrame:
    """(chrom, __block, __first, __whole, __apart): BLOCK chunks as one text, or its length, and where it begins; one with gaps as its chunks."""
    own = F.col("seq") if texts else F.length("seq").cast("bigint")
    size = lambda x: F.length(x["own"]) if texts else x["own"]
    g = chunks.groupBy("chrom", F.floor(F.col("chunk_id") / BLOCK).alias("__block")).agg(F.sort_array(F.collect_list(F.struct("chunk_id", own.alias("own")))).alias("c"))
    first = F.get("c", F.lit(0))["chunk_id"]
    gaps = F.exists(F.transform("c", lambda x, i: (x["chunk_id"] != first + i) | ((i < F.size("c") - 1) & (size(x) != chunk))), lambda x: x)
    whole = F.array_join(F.transform("c", lambda x: x["own"]), "") if texts else F.aggregate("c", F.lit(0).cast("bigint"), lambda a, x: a + x["own"])
    return g.select("chrom", "__block", (first * chunk).alias("__first"), whole.alias("__whole"), F.when(gaps, F.col("c")).alias("__apart"))


def _sliced(wanted: DataFrame, chunks: DataFrame, chunk: int, texts: bool, by: str | None = None, needed: Column | None = None) -> DataFrame:
    """wanted plus sequence, or len alone: its blocks meet those of the reference, and its parts come to one row by one shuffle, of by where given.

    Joins are hinted: what the planner takes for small here is a table with its texts still to come.
    """
    keys, s, e, wide = wanted.columns, F.col("ref_start"), F.col("ref_end"), chunk * BLOCK
    touched = (e > s) if needed is None else (e > s) & needed
    lo, hi = F.floor(s / wide), F.floor((e - 1) / wide)
    rows = wanted.withColumn("__block", F.explode_outer(F.when(touched, F.sequence(lo, hi))))
    j = rows.join(_blocks(chunks, chunk, texts).hint("merge"), ["chrom", "__block"], "left")
    from_, upto = F.greatest(s - F.col("__first"), F.lit(0)), e - F.col("__first")
    inner = lambda x, n: (F.greatest(s - x["chunk_id"] * chunk, F.lit(0)), F.least(e - x["chunk_id"] * chunk, n))

    def cut(x: Column) -> Column:
        a, b = inner(x, F.length(x["own"]))
        return F.substring(x["own"], (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))

    def counted(x: Column) -> Column:
        a, b = inner(x, x["own"])
        return F.greatest(b - a, F.lit(0))

    if texts:
        part = F.when(F.col("__apart").isNull(), F.substring(F.col("__whole"), (from_ + 1).cast("int"), F.greatest(upto - from_, F.lit(0)).cast("int"))).otherwise(F.array_join(F.transform("__apart", cut), ""))
    else:
        part = F.when(F.col("__apart").isNull(), F.greatest(F.least(upto, F.col("__whole")) - from_, F.lit(0))).otherwise(F.aggregate("__apart", F.lit(0).cast("bigint"), lambda a, x: a + counted(x)))
    parts = j.select(*keys, "__block", part.alias("__part"))
    parts = parts.repartition(by) if by else parts
    # a row that wanted has more than once has each of its blocks as often
    times = (F.col("__n") / F.when(touched, hi - lo + 1).otherwise(1)).cast("int")
    if texts:
        g = parts.groupBy(*keys).agg(F.count("*").alias("__n"), F.sort_array(F.collect_list(F.struct("__block", "__part"))).alias("__p"))
        once = F.when(times > 1, F.array_distinct("__p")).otherwise(F.col("__p"))
        out = F.upper(F.array_join(F.transform(once, lambda x: x["__part"]), "")).alias("sequence")
    else:
        g = parts.groupBy(*keys).agg(F.count("*").alias("__n"), F.sum("__part").alias("__p"))
        out = F.coalesce((F.col("__p") / times).cast("bigint"), F.lit(0).cast("bigint")).alias("len")
    return g.select(*keys, out, F.explode(F.sequence(F.lit(1), times)).alias("__time")).drop("__time")


def reference_slices(wanted: DataFrame, chunks: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """wanted (with chrom, ref_start, ref_end) plus sequence: upper-case bases, clamped to what chunks (chrom, chunk_id, seq) have."""
    return _sliced(wanted, chunks, chunk, True)


def with_sequences(segs: DataFrame, chunks: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Segments with their sequence, length and offset in the haplotype."""
    own = _sliced(segs, chunks, chunk, True, "event_id", F.col("novel").isNull())
    text = F.when(F.col("novel").isNotNull(), F.col("novel")).when(F.col("reverse"), revcomp(F.col("sequence"))).otherwise(F.col("sequence"))
    return with_offsets(own.withColumn("sequence", text).withColumn("len", F.length("sequence").cast("bigint")))


def with_lengths(segs: DataFrame, chunks: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Segments with their length and offset in the haplotype as with_sequences has them; no bases are carried."""
    own = _sliced(segs, chunks, chunk, False, "event_id", F.col("novel").isNull())
    return with_offsets(own.withColumn("len", F.when(F.col("novel").isNotNull(), F.length("novel").cast("bigint")).otherwise(F.col("len"))))


def with_offsets(segs: DataFrame) -> DataFrame:
    before = Window.partitionBy("event_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    return segs.withColumn("hap_offset", F.coalesce(F.sum("len").over(before), F.lit(0)).cast("bigint"))


def haplotypes(segs: DataFrame) -> DataFrame:
    """(event_id, total_len, ref_len, ref_lo, ref_hi, breakpoints, segs, sequence); no sequence where segs have none.

    segs: an array of hap_offset, len, chrom, ref_start, ref_end, reverse, from the same
    grouping, so that places on a haplotype, and theirs on the reference, need no second pass
    over the reference.
    """
    texts = ["sequence"] if "sequence" in segs.columns else []
    g = segs.groupBy("event_id").agg(
        F.sum("len").alias("total_len"),
        F.coalesce(F.sum(F.when(F.col("chrom").isNotNull(), F.col("ref_end") - F.col("ref_start"))), F.lit(0)).alias("ref_len"),
        F.min("ref_start").alias("ref_lo"),
        F.max("ref_end").alias("ref_hi"),
        F.sort_array(F.collect_list(F.struct("seg", *texts, "hap_offset", "len", "chrom", "ref_start", "ref_end", "reverse"))).alias("s"),
    )
    ends = F.transform("s", lambda x: x["hap_offset"] + x["len"])
    laid = F.transform("s", lambda x: F.struct(*[x[c].alias(c) for c in ("hap_offset", "len", "chrom", "ref_start", "ref_end", "reverse")])).alias("segs")
    whole = [F.array_join(F.transform("s", lambda x: x["sequence"]), "").alias("sequence") for _ in texts]
    return g.select("event_id", "total_len", "ref_len", "ref_lo", "ref_hi", F.slice(ends, F.lit(1), F.size("s") - 1).alias("breakpoints"), laid, *whole)


def to_reference(points: DataFrame, segs: DataFrame) -> DataFrame:
    """points (event_id, hap_pos) with ref_chrom and ref_pos; null in new sequence and past the end."""
    s = segs.select(F.col("event_id").alias("s_event"), "hap_offset", "len", "chrom", "ref_start", "ref_end", "reverse")
    j = points.join(s.hint("merge"), (F.col("event_id") == F.col("s_event")) & (F.col("hap_pos") >= F.col("hap_offset")) & (F.col("hap_pos") < F.col("hap_offset") + F.col("len")), "left")
    into = F.col("hap_pos") - F.col("hap_offset")
    at = F.when(F.col("reverse"), F.col("ref_end") - 1 - into).otherwise(F.col("ref_start") + into)
    return j.select(*points.columns, F.col("chrom").alias("ref_chrom"), F.when(F.col("chrom").isNotNull(), at).alias("ref_pos"))


def origin(seg: Column, pos: Column) -> Column:
    """The place on the reference of a place on a haplotype that lies in a segment; null in new sequence."""
    into = pos - seg["hap_offset"]
    return F.when(seg["chrom"].isNotNull(), F.when(seg["reverse"], seg["ref_end"] - 1 - into).otherwise(seg["ref_start"] + into))


def applied(segs: DataFrame, variants: DataFrame) -> DataFrame:
    """Segments with alleles (chrom, p, allele) put in place; the complement on reversed ones, none in new sequence.

    variants may have event_id, then each counts for its event only. A segment's variants
    come to it as one sorted array; its bases stay one string.
    """
    own = "event_id" in variants.columns
    n = F.length("sequence")
    lo = F.when(F.col("reverse"), F.col("ref_end") - n).otherwise(F.col("ref_start"))
    spans = segs.where("chrom is not null and len > 0").select("event_id", "seg", "chrom", "reverse", lo.alias("lo"), (lo + n).alias("hi"))
    places = variants.select(F.col("chrom").alias("v_chrom"), F.col("p").alias("v_lo"), (F.col("p") + 1).alias("v_hi"), "allele", *([F.col("event_id").alias("v_event")] if own else [])).distinct()
    hit = overlap_join(spans, places, ("chrom", "lo", "hi"), ("v_chrom", "v_lo", "v_hi"))
    if own:
        hit = hit.where("event_id = v_event")
    at = F.when(F.col("reverse"), F.col("hi") - 1 - F.col("v_lo")).otherwise(F.col("v_lo") - F.col("lo"))
    base = F.when(F.col("reverse"), complement(F.col("allele"))).otherwise(F.col("allele"))
    edits = hit.groupBy("event_id", "seg").agg(F.sort_array(F.collect_list(F.struct(at.cast("int").alias("at"), base.alias("base")))).alias("edits"))
    begin = F.struct(F.lit(0).alias("done"), F.lit("").alias("out"))

    def put(a, e):
        between = F.substring(F.col("sequence"), a["done"] + 1, e["at"] - a["done"])
        after = F.struct((e["at"] + 1).alias("done"), F.concat(a["out"], between, e["base"]).alias("out"))
        return F.when(e["at"] < a["done"], a).otherwise(after)

    whole = F.aggregate("edits", begin, put, lambda a: F.concat(a["out"], F.substring(F.col("sequence"), a["done"] + 1, F.length("sequence"))))
    out = segs.join(edits.hint("merge"), ["event_id", "seg"], "left").withColumn("sequence", F.when(F.col("edits").isNull(), F.col("sequence")).otherwise(whole))
    return out.withColumn("n_variants", F.coalesce(F.size("edits"), F.lit(0)).cast("bigint")).withColumn("n_variants", F.greatest("n_variants", F.lit(0))).drop("edits")


def segment_at(segs: Column | str, pos: Column) -> Column:
    """The segment (with hap_offset, len) of an array that holds a place; null past the end. The first USUAL ones are looked at by compiled code."""
    holds = lambda s: (s["hap_offset"] <= pos) & (pos < s["hap_offset"] + s["len"])
    usual = [F.get(segs, F.lit(i)) for i in range(USUAL)]
    return F.coalesce(*[F.when(holds(s), s) for s in usual], F.when(F.size(segs) > USUAL, F.get(F.filter(segs, holds), F.lit(0))))


def overlaps_reference(start: Column, length: Column, segs: Column) -> Column:
    """Whether [start, start + length) of a haplotype touches any segment (hap_offset, len, chrom) that has an origin."""
    return F.exists(segs, lambda s: s["chrom"].isNotNull() & (s["hap_offset"] < start + length) & (s["hap_offset"] + s["len"] > start))


def within_one(start: Column, length: Column, segs: Column) -> Column:
    return F.exists(segs, lambda s: (s["hap_offset"] <= start) & (s["hap_offset"] + s["len"] >= start + length))
