"""Interval joins and merges over (chrom, start, end), 0-based and half-open.

Overlap joins are equi-joins on (chrom, level, bin): bins of some lengths, of which an interval
touches nine at most at its own level. No pair meets twice, and a crowded chromosome is spread
over its bins instead of being compared as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BIN = 4096
#: As many regions may be broadcast; with more, both sides are dealt by their bins.
FEW = 100_000


#: Widths of bins grow by 2^6 a level; an interval belongs to the first level of which it is at most 2^3 widths long, so the last one holds any chromosome.
_STEP, _LONG, LEVELS = 6, 3, 4


def _level(start: str, end: str, width: int) -> Column:
    """The level of an interval, of whose bins it touches nine at most."""
    size = F.greatest(F.col(end) - F.col(start), F.lit(1))
    out = F.when(size <= width << _LONG, 0)
    for k in range(1, LEVELS - 1):
        out = out.when(size <= width << (_STEP * k + _LONG), k)
    return out.otherwise(LEVELS - 1)


def _listed(df: DataFrame, start: str, end: str, width: int, levels: Column, side: str) -> DataFrame:
    """df once for each of levels and each bin of that level which the interval touches."""
    wide = F.element_at(F.array(*[F.lit(width << (_STEP * k)).cast("long") for k in range(LEVELS)]), F.col(f"__level_{side}") + 1)
    last = F.greatest(F.col(end) - 1, F.col(start))
    each = df.withColumn(f"__level_{side}", F.explode(levels)).withColumn("__wide", wide)
    return each.withColumn(f"__bin_{side}", F.explode(F.sequence(F.floor(F.col(start) / F.col("__wide")), F.floor(last / F.col("__wide"))))).drop("__wide")


def overlap_join(left: DataFrame, right: DataFrame, left_on: tuple[str, str, str], right_on: tuple[str, str, str], width: int = BIN) -> DataFrame:
    """Pairs with equal chromosomes and a.start < b.end and b.start < a.end; column names of both sides must differ.

    Empty intervals meet what they lie strictly inside of. Each interval belongs to the level
    whose bins suit its length; a pair meets at the level of its longer side, where both touch
    nine bins at most, and is kept in the bin of the larger start. So an interval of any length
    is a few rows: the left ones are listed at their own level and at higher ones that the
    right side has, for which its levels are counted first (at most four rows); right is the
    side of regions. With more than FEW of them the join is hinted to merge, as the planner's
    estimate does not know how many rows a region is listed as.
    """
    (lc, ls, le), (rc, rs, re) = left_on, right_on
    counted = right.where(f"{rs} is not null and {re} is not null").groupBy(_level(rs, re, width).alias("l")).count().collect()
    known, few = sorted(r["l"] for r in counted), sum(r["count"] for r in counted) <= FEW
    own_l, own_r = _level(ls, le, width), _level(rs, re, width)
    upper = [k for k in known if k > 0]

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        on = (F.col(lc) == F.col(rc)) & (F.col("__level_l") == F.col("__level_r")) & (F.col("__bin_l") == F.col("__bin_r"))
        joined = a.join(b if few else b.hint("merge"), on & (F.col(ls) < F.col(re)) & (F.col(rs) < F.col(le)))
        wide = F.lit(width).cast("long") * F.pow(F.lit(2.0), F.col("__level_l") * _STEP).cast("long")
        return joined.where(F.col("__bin_l") == F.floor(F.greatest(ls, rs) / wide)).drop("__level_l", "__level_r", "__bin_l", "__bin_r")

    # the left side is the longer one, or both are alike
    out = met(_listed(left, ls, le, width, F.array(own_l), "l"), _listed(right, rs, re, width, F.sequence(own_r, F.lit(LEVELS - 1)), "r"))
    if upper:  # the right side is longer
        above = F.filter(F.array(*map(F.lit, upper)), lambda k: k > own_l)
        out = out.unionByName(met(_listed(left, ls, le, width, above, "l"), _listed(right, rs, re, width, F.array(own_r), "r")))
    return out


def overlapping(left: DataFrame, right: DataFrame, key: str, left_on=("chrom", "start", "end"), right_on=("r_chrom", "r_start", "r_end"), keep: bool = True, width: int = BIN) -> DataFrame:
    """Rows of left that overlap (keep) or don't overlap any row of right."""
    hit = overlap_join(left.select(key, *left_on), right.select(*right_on), left_on, right_on, width).select(key).distinct()
    return left.join(hit, key, "left_semi" if keep else "left_anti")


def self_overlaps(events: DataFrame, id_col: str = "event_id", on=("chrom", "start", "end"), width: int = BIN) -> DataFrame:
    """(id_a, id_b) of all overlapping pairs, id_a < id_b; a point counts as one base, touching is no overlap."""
    e = events.select(F.col(id_col).alias("id"), F.col(on[0]).alias("c"), F.col(on[1]).alias("s"), F.greatest(F.col(on[2]), F.col(on[1]) + 1).alias("e"))
    a, b = (e.select(*[F.col(c).alias(f"{c}_{x}") for c in e.columns]) for x in "ab")
    return overlap_join(a, b, ("c_a", "s_a", "e_a"), ("c_b", "s_b", "e_b"), width).where("id_a < id_b").select("id_a", "id_b")


def relation(start: Column, end: Column, lo: Column, hi: Column) -> Column:
    """outside, inside or overlapping: how [start, end) lies to [lo, hi)."""
    return F.when((end <= lo) | (start >= hi), "outside").when((start >= lo) & (end <= hi), "inside").otherwise("overlapping")


def overlap_share(start: Column, end: Column, lo: Column, hi: Column) -> Column:
    """Share of [start, end) within [lo, hi); 1 if inside."""
    shared = F.greatest(F.least(end, hi) - F.greatest(start, lo), F.lit(0))
    return F.when(relation(start, end, lo, hi) == "inside", 1.0).otherwise(shared / F.greatest(end - start, F.lit(1)).cast("double"))


def merged(intervals: DataFrame, on=("chrom", "start", "end"), width: int = 1 << 20) -> DataFrame:
    """Union of the intervals of each chromosome; touching ones join.

    Intervals are ordered within bins of their starts. How far the bins before reach, and how
    many unions they begin, comes from a table of one row a bin, so no chromosome is ordered in
    one task.
    """
    c, s, e = on
    rows = intervals.select(c, s, e).withColumn("__bin", F.floor(F.col(s) / width))
    reach = rows.groupBy(c, "__bin").agg(F.max(e).alias("__most"))
    earlier = Window.partitionBy(c).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    reach = reach.select(c, "__bin", F.max("__most").over(earlier).alias("__most"))
    before = Window.partitionBy(c, "__bin").orderBy(s, e).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(c, "__bin").orderBy(s, e).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = rows.join(reach, [c, "__bin"])
    marked = marked.withColumn("__new", F.coalesce((F.col(s) > F.greatest("__most", F.max(e).over(before))).cast("int"), F.lit(1))).withColumn("__island", F.sum("__new").over(upto))
    # a bin's part of a union, then the union of such parts
    part = marked.groupBy(c, "__bin", "__island").agg(F.min(s).alias(s), F.max(e).alias(e), F.count("*").alias("n"), F.max("__new").alias("__new"))
    begun = part.groupBy(c, "__bin").agg(F.sum("__new").alias("__begun"))
    begun = begun.select(c, "__bin", F.coalesce(F.sum("__begun").over(earlier), F.lit(0)).alias("__begun"))
    named = part.join(begun, [c, "__bin"]).withColumn("__island", F.col("__begun") + F.col("__island"))
    return named.groupBy(c, "__island").agg(F.min(s).alias(s), F.max(e).alias(e), F.sum("n").alias("n")).drop("__island")


def scan_bounds(events: DataFrame, regions: DataFrame, flank: int) -> DataFrame:
    """(event_id, chrom, lo, hi): each event with its flanks, widened by the regions given for its chromosome."""
    r = regions.groupBy(F.col("chrom").alias("rc")).agg(F.min("start").alias("r_lo"), F.max("end").alias("r_hi"))
    j = events.join(r, F.col("chrom") == F.col("rc"), "left")
    return j.select("event_id", "chrom", F.least(F.greatest(F.col("start") - flank, F.lit(0)), "r_lo").alias("lo"), F.greatest(F.col("end") + flank, "r_hi").alias("hi"))


def depth(reads: DataFrame, regions: DataFrame, key: list[str], width: int = BIN) -> DataFrame:
    """regions with n_reads and depth: reads that overlap it for each base of the region; 0 for an empty one."""
    hit = overlap_join(reads.select("chrom", "ref_start", "ref_end"), regions.select(*key, F.col("chrom").alias("g_chrom"), F.col("start").alias("g_start"), F.col("end").alias("g_end")), ("chrom", "ref_start", "ref_end"), ("g_chrom", "g_start", "g_end"), width)
    n = hit.groupBy(*key).agg(F.count("*").alias("n_reads"))
    out = regions.join(n.hint("merge"), key, "left").withColumn("n_reads", F.coalesce("n_reads", F.lit(0)))
    return out.withColumn("depth", F.when(F.col("end") > F.col("start"), F.col("n_reads") / (F.col("end") - F.col("start"))).otherwise(0.0))


def coverage_at(reads: DataFrame, points: DataFrame, key: str, window: int = 2000, samples: int = 50, chrom: bool = True, width: int = BIN) -> DataFrame:
    """(key, coverage): mean number of fragments over up to samples evenly spaced places in a window around each point (chrom, pos)."""
    lo = F.greatest(F.col("pos") - window // 2, F.lit(0))
    span = F.col("pos") + window // 2 - lo
    n = F.greatest(F.least(span, F.lit(samples)), F.lit(1))
    step = F.when(n > 1, F.floor(span / n)).otherwise(1)
    places = points.select(key, F.col("chrom").alias("p_chrom"), lo.alias("lo"), n.alias("n"), step.alias("step"))
    # a fragment meets a window once; how many of its places lie in the fragment is arithmetic
    places = places.withColumn("p_end", F.col("lo") + (F.col("n") - 1) * F.col("step") + 1)
    hit = overlap_join(reads.select("chrom", "ref_start", "ref_end"), places, ("chrom", "ref_start", "ref_end"), ("p_chrom", "lo", "p_end"), width)
    before = lambda c: F.greatest(F.lit(0), F.least(F.col("n"), F.ceil((F.col(c) - F.col("lo")) / F.col("step"))))
    total = hit.groupBy(key, "n").agg(F.sum(before("ref_end") - before("ref_start")).alias("met")).select(key, (F.col("met") / F.col("n")).alias("coverage"))
    return points.select(key).join(total.hint("merge"), key, "left").select(key, F.coalesce("coverage", F.lit(0.0)).alias("coverage"))
