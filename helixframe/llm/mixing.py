"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import DataFrame, Window, functions as F

from .common import cut

#: Words of a block.
BLOCK_WORDS = 64
#: Slot numbers are taken apart into LIMBS of BITS bits each, so that a point keeps 40 bits of its fraction up to 2**48 slots.
BITS, LIMBS = 12, 4
#: The golden ratio's fractional part to 2**-120.
GOLDEN = Fraction(math.isqrt(5 << 240) - (1 << 120), 1 << 121)
_WORD = r"[^\x20\x09-\x0D]+"


def text_words(text):
    """Number of words [^\\x20\\x09-\\x0D]+; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: int = 3) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size).

    Sources in code-point order, null last, get the weights in turn and share the sum of all
    sizes by them. A target stops at most times its source's size; the excess is reshared by
    weight until none is above. That is the level L with sum(least(most * size, L * weight))
    = total, found by one pass over the sources in order of most * size / weight. The table
    has one row a source: it is the one thing here that a single task orders.
    """
    ranked = sizes.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").isNull(), F.expr("cast(source as binary)"))) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("k", F.lit(len(weights))) + 1).cast("int"))
    s = ranked.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * most).cast("double"))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "k")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(every).cast("double"))
    s = s.withColumn("open", F.sum("weight").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    # the level if exactly the sources before this one stop at their cap; the first that holds is right
    s = s.withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
    s = s.withColumn("found", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "k", "level"))).over(every))
    return s.select("source", "source_size", "weight", F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(F.col("cap"), F.col("found.level") * F.col("weight"))).alias("target"), "k")


def point(number):
    """The fraction of number times the golden ratio, for a column of whole numbers."""
    total = None
    for i in range(LIMBS):
        limb = F.shiftright(number, BITS * i).bitwiseAND(F.lit((1 << BITS) - 1)).cast("double")
        step = limb * F.lit(float(GOLDEN * (1 << BITS * i) % 1))
        total = step if total is None else total + step
    return total - F.floor(total)


def prefix_sums(counts: DataFrame, key: str, place: str, n: str, bits: int = 12) -> DataFrame:
    """counts with base: the sum of n over the key's rows with a smaller place.

    Places are summed in groups of 2**bits first, so a key's rows are not ordered in one task
    but its groups'.
    """
    wide = counts.withColumn("__group", F.shiftright(place, bits))
    groups = wide.groupBy(key, "__group").agg(F.sum(n).alias("__n"))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(key, "__group", F.coalesce(F.sum("__n").over(before(key).orderBy("__group")), F.lit(0)).alias("__first"))
    inside = wide.withColumn("__own", F.coalesce(F.sum(n).over(before(key, "__group").orderBy(place)), F.lit(0)))
    return inside.join(groups, [key, "__group"]).withColumn("base", F.col("__first") + F.col("__own")).drop("__group", "__first", "__own")


def schedule(targets: DataFrame, n_sources: int, total: int, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(slot, k, rank): the slots of the mix, each with its source and its rank among that source's slots.

    Slot j is the point frac((j + 1) * golden ratio), mapped through the cumulative target
    weights. Points find their source by equal cells of [0, 1), so it is an equi-join. Ranks
    are counted in chunks of slots first, so a hot source is never ordered in one task. A
    source takes no slot past its target; the few that it lacks at the end close the mix.
    """
    n_slots = math.ceil(total / block_words)
    n_cells = 4 * max(1, n_sources)
    up = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wanted = F.ceil(words_wanted(F.col("target")) / block_words)
    bounds = targets.where("target > 0").select("k", wanted.alias("wanted"), (F.sum("target").over(up) / F.lit(float(total))).alias("hi"), (F.col("target") / F.lit(float(total))).alias("share"))
    last = Window.orderBy("k")
    bounds = bounds.withColumn("lo", F.coalesce(F.lag("hi").over(last), F.lit(0.0))).withColumn("hi", F.when(F.lead("k").over(last).isNull(), F.lit(2.0)).otherwise(F.col("hi")))
    cells = bounds.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * n_cells), F.floor(F.least(F.col("hi"), F.lit(0.9999999999)) * n_cells)))).select("cell", "lo", "hi", "k")
    spark = targets.sparkSession
    slots = spark.range(n_slots).withColumn("u", point(F.col("id") + 1)).withColumn("cell", F.floor(F.col("u") * n_cells))
    slots = slots.join(cells, "cell").where("u >= lo and u < hi").select(F.col("id").alias("slot"), "k", F.shiftright("id", 12).alias("chunk"))
    counts = slots.groupBy("k", "chunk").agg(F.count("*").alias("n"))
    within = slots.withColumn("r", F.row_number().over(Window.partitionBy("k", "chunk").orderBy("slot")) - 1)
    ranked = within.join(prefix_sums(counts, "k", "chunk", "n").select("k", "chunk", "base"), ["k", "chunk"]).select("slot", "k", (F.col("base") + F.col("r")).alias("rank"))
    ranked = ranked.join(bounds.select("k", "wanted"), "k").where("rank < wanted").select("slot", "k", "rank")
    had = counts.groupBy("k").agg(F.sum("n").alias("had"))
    short = bounds.select("k", "wanted").join(had, "k", "left").withColumn("had", F.coalesce("had", F.lit(0))).where("had < wanted")
    closing = short.select(F.lit(n_slots).cast("long").alias("slot"), "k", F.explode(F.sequence("had", F.col("wanted") - 1)).alias("rank"))
    return ranked.unionByName(closing)


def words_wanted(target):
    """The whole number of words nearest to a target."""
    return F.floor(target + 0.5)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: int = 3, block_words: int = BLOCK_WORDS, seed: int = 0, by_cycle: bool = True) -> DataFrame:
    """(id, source, size, source_size, target, cycle, taken, h) for every row of docs; cycle and taken are null where the mix takes nothing.

    Each source's rows in a fixed pseudo-random order (a hash h of seed, id and text) are one
    stream of words, cut into blocks of block_words and begun again up to most times. The
    schedule's slots of a source take its blocks in order, the last one up to the target: a
    source's taken words are the whole number next to its target, at most most times its size.
    A row of the result is one row of docs in one cycle of its stream: taken of its size words,
    which are its first ones unless a block before it ends the mix. With by_cycle false there
    is one row for each row of docs, cycle is left out, and taken sums all cycles (0: none).

    Rows without words and sources without words are never taken. Null sources are a source,
    null ids are like any other. Repeated rows are rows of their own. Positions in a stream
    are summed within buckets of its order first, about the square root of all rows each, so
    no source is ordered in one task. Only docs' id, text and source are read; running again
    gives the same mix. Without any words nothing is taken, and an empty table gives no rows.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), text_words(F.col(text_col)).alias("size"), F.xxhash64(F.lit(seed), id_col, text_col).alias("h"))
    slim = cut(slim)
    n_rows, total = slim.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = cut(source_targets(sizes, weights, most))
    n_sources = targets.count()
    rows = slim.join(targets, slim["source"].eqNullSafe(targets["source"])).select("id", slim["source"], "size", "h", "k", "source_size", "target")
    if not total:
        none = F.lit(None).cast("long")
        if not by_cycle:
            return rows.select("id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), "h")
        return rows.select("id", "source", "size", "source_size", "target", none.alias("cycle"), none.alias("taken"), "h")

    bits = max(1, math.ceil(math.log2(max(2, n_rows)) / 2))
    rows = rows.withColumn("bucket", F.shiftrightunsigned("h", 64 - bits))
    sums = prefix_sums(rows.groupBy("k", "bucket").agg(F.sum("size").alias("n")), "k", "bucket", "n")
    inner = Window.partitionBy("k", "bucket").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("at", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(sums.select("k", "bucket", "base"), ["k", "bucket"])
    placed = placed.withColumn("at", F.col("base") + F.col("at")).drop("base", "bucket")

    slots = schedule(targets, n_sources, total, block_words).select("k", "rank")
    # the part of the stream's cycles that a row's words lie in, up to the source's target
    wanted = words_wanted(F.col("target"))
    cycles = placed.where("size > 0 and target > 0").withColumn("cycle", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    cycles = cycles.withColumn("from", F.col("cycle") * F.col("source_size") + F.col("at")).withColumn("to", F.least(F.col("from") + F.col("size"), wanted)).where("`from` < `to`")
    pieces = cycles.select("k", "cycle", "h", "from", "to", "source_size", F.explode(F.sequence(F.expr(f"`from` div {block_words}"), F.expr(f"(`to` - 1) div {block_words}"))).alias("rank"))
    piece = F.least("to", (F.col("rank") + 1) * block_words) - F.greatest("from", F.col("rank") * block_words)
    # (source, place in the stream) is a row's own unless it has no words
    place = (F.col("from") - F.col("cycle") * F.col("source_size")).alias("t_at")
    taken = pieces.join(slots, ["k", "rank"])
    if by_cycle:
        t = taken.groupBy(F.col("k").alias("t_k"), F.col("h").alias("t_h"), F.col("cycle").cast("long").alias("cycle"), place).agg(F.sum(piece).alias("taken"))
    else:
        t = taken.groupBy(F.col("k").alias("t_k"), F.col("h").alias("t_h"), place).agg(F.sum(piece).alias("taken"))
    out = placed.join(t, (F.col("k") == F.col("t_k")) & (F.col("at") == F.col("t_at")) & (F.col("h") == F.col("t_h")) & (F.col("size") > 0), "left")
    if not by_cycle:
        return out.select("id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "h")
    return out.select("id", "source", "size", "source_size", "target", "cycle", "taken", "h")
