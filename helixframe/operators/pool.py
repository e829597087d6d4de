"""From alignments to read pairs, and what is counted over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.reads import FIRST, LAST, REVERSE, flagged, pair_end, primary, proper_pair, usable_insert
from ..functions.sequence import orient
from .intervals import overlap_join


def usable(aln: DataFrame, min_mapq: int = 20) -> DataFrame:
    return aln.where(primary(F.col("flag"), F.col("mapq"), min_mapq) & proper_pair(F.col("flag")))


def last_by(df: DataFrame, keys: list[str], order: list[str], first: bool = False) -> DataFrame:
    """The last (or first) row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).asc() if first else F.col(c).desc() for c in order])
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def paired(aln: DataFrame, order: list[str]) -> DataFrame:
    """Read pairs by name: the last record of each name and segment counts, pairs are turned to sequencing orientation.

    Both segments come from one pass and one shuffle by name; of records that order alike the
    largest by position and bases counts.
    """
    last = lambda bit: F.max(F.when(flagged(F.col("flag"), bit), F.struct(*order, F.struct("chrom", "pos", "tlen", "flag", "seq", "qual").alias("__read"))))
    both = aln.groupBy("name").agg(last(FIRST).alias("a"), last(LAST).alias("b")).where("a is not null and b is not null").select("name", "a.__read", F.col("b.__read").alias("__mate"))
    one, two = (lambda c, r=r: F.col(f"{r}.{c}") for r in ("__read", "__mate"))
    (seq1, qual1), (seq2, qual2) = (orient(r("seq"), r("qual"), flagged(r("flag"), REVERSE)) for r in (one, two))
    end = pair_end(*(f for r in (one, two) for f in (r("pos"), F.length(r("seq")), r("tlen"))))
    start = F.least(one("pos"), two("pos"))
    return both.select("name", seq1.alias("seq1"), qual1.alias("qual1"), seq2.alias("seq2"), qual2.alias("qual2"), start.alias("ref_start"), end.alias("ref_end"), (end - start).alias("insert_size"), one("chrom").alias("chrom"))


def rescued(aln: DataFrame, region: DataFrame, order: list[str]) -> DataFrame:
    """(event_id, name, mate_pos): mates outside a region of reads inside it that have no partner there.

    They are looked for in the region widened on both sides by the largest of 1000 and 200
    more than any template length inside; of several the first by position counts.
    """
    inside = overlap_join(aln.select("name", "flag", "chrom", "pos", "tlen", (F.col("pos") + 1).alias("__next")), region, ("chrom", "pos", "__next"), ("g_chrom", "g_start", "g_end"))
    side = F.when(flagged(F.col("flag"), FIRST), 1).otherwise(2)
    inside = inside.withColumn("side", side)
    pad = inside.groupBy("event_id").agg(F.greatest(F.max(F.abs("tlen")) + 200, F.lit(1000)).alias("pad"))
    own = ["event_id", "name", "g_chrom", "g_start", "g_end"]
    single = inside.groupBy(*own).agg(F.min("side").alias("have"), F.max("side").alias("__most")).where("have = __most").drop("__most")
    wide = single.join(pad.hint("merge"), "event_id")
    mates = aln.select("name", "chrom", "pos", side.alias("side"), *[F.col(c).alias("o_" + c) for c in order])
    hit = wide.join(mates.hint("merge"), "name").where((F.col("side") != F.col("have")) & (F.col("chrom") == F.col("g_chrom")) & (F.col("pos") >= F.col("g_start") - F.col("pad")) & (F.col("pos") < F.col("g_end") + F.col("pad")))
    return last_by(hit, ["event_id", "name"], ["pos", *["o_" + c for c in order]], first=True).select("event_id", "name", F.col("pos").alias("mate_pos"))


def fragment_lengths(pairs: DataFrame, keys: list[str], default: tuple[float, float] = (400.0, 80.0)) -> DataFrame:
    """(keys, n, mean, stddev, lengths): the usable insert sizes; the default mean and deviation without any.

    lengths is their histogram in order: (len, n, upto), upto counting the sizes up to this
    one. Sizes are below 10,000, so that is the most entries a key has, however many pairs.
    """
    size = F.abs("insert_size")
    counted = pairs.groupBy(*keys, F.when(usable_insert(F.col("insert_size")), size.cast("bigint")).alias("len")).agg(F.count("*").alias("n"))
    counted = counted.withColumn("n", F.when(F.col("len").isNotNull(), F.col("n")))  # a key without usable sizes has one row, of none
    upto = Window.partitionBy(*keys).orderBy("len").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    entry = F.when(F.col("len").isNotNull(), F.struct("len", "n", F.sum("n").over(upto).alias("upto"))).alias("entry")
    g = counted.select(*keys, entry).groupBy(*keys).agg(F.sum("entry.n").alias("n"), (F.sum(F.col("entry.len") * F.col("entry.n")) / F.sum("entry.n")).alias("mean"), F.sort_array(F.collect_list("entry")).alias("lengths"))
    around = F.aggregate("lengths", F.lit(0.0), lambda a, x: a + x["n"] * F.pow(x["len"] - F.col("mean"), F.lit(2.0)))
    g = g.withColumn("stddev", F.sqrt(around / F.col("n")))
    none = F.expr("cast(array() as array<struct<len:bigint,n:bigint,upto:bigint>>)")
    return g.select(*keys, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean", F.lit(default[0])).alias("mean"), F.coalesce("stddev", F.lit(default[1])).alias("stddev"), F.coalesce("lengths", none).alias("lengths"))


def histogram(values: Column) -> Column:
    """A sorted array of single lengths in the form of fragment_lengths."""
    return F.transform(values, lambda x, i: F.struct(x.cast("bigint").alias("len"), F.lit(1).cast("bigint").alias("n"), (i + 1).cast("bigint").alias("upto")))


def in_range(lengths: Column, lo: int, hi: int) -> Column:
    """The histogram's lengths from lo to hi; without any, the end of the range nearest to the longest."""
    ok = F.filter(lengths, lambda x: (x["len"] >= lo) & (x["len"] <= hi))
    longest = F.coalesce(F.get(lengths, F.size(lengths) - 1)["len"], F.lit(400).cast("bigint"))
    one = F.lit(1).cast("bigint")
    nearest = F.array(F.struct(F.greatest(F.lit(lo), F.least(F.lit(hi), longest)).cast("bigint").alias("len"), one.alias("n"), one.alias("upto")))
    return F.when(F.size(ok) > 0, ok).otherwise(nearest)


def drawn(lengths: Column, u: Column) -> Column:
    """The length at place floor(u * number) of all those that a histogram counts, by binary search."""
    base = F.get(lengths, F.lit(0))["upto"] - F.get(lengths, F.lit(0))["n"]
    total = F.get(lengths, F.size(lengths) - 1)["upto"] - base
    k = base + F.least(F.floor(u * total), total - 1)
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(14))])
    at = F.aggregate(steps, F.lit(0), lambda a, s: F.when((a + s < F.size(lengths)) & (F.coalesce(F.get(lengths, a + s - 1)["upto"], F.lit(2**62)) <= k), a + s).otherwise(a))
    return F.get(lengths, at)["len"]


def head(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n records of a file whose order is given; Spark keeps n rows of each partition only."""
    return df.orderBy(*order).limit(n)


def alignment_stats(aln: DataFrame, genome_size: int) -> DataFrame:
    """One row: template length mean and deviation of forward proper pairs, read length, records for each base."""
    tlen = F.when(proper_pair(F.col("flag")) & (F.col("tlen") > 0), F.col("tlen"))
    g = aln.agg(F.count("*").alias("n"), F.coalesce(F.avg(tlen), F.lit(350.0)).alias("insert_mean"), F.coalesce(F.stddev_pop(tlen), F.lit(50.0)).alias("insert_sd"), F.coalesce(F.avg(F.length("seq")), F.lit(150.0)).alias("read_length"))
    return g.withColumn("coverage", F.lit(0.0) if not genome_size else F.col("n") * F.col("read_length") / F.lit(float(genome_size)))
