"""Does an aligned result show the events of its truth? Checks as rows of one table."""

from __future__ import annotations

import functools
import warnings
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.reads import DUPLICATE, event_label, flagged, globally_counted, primary, proper_pair
from ..operators import intervals, pileup, pool
from ..shared import stored

# Tolerances and numbers of records that results have to agree with.
COVERAGE_TOLERANCE, FRACTION_TOLERANCE = 0.3, 0.15
SPLIT_FLANK = 500
LEAST_DEPTH = 5
INSERT_MEAN, INSERT_SD = (50.0, 1000.0), (5.0, 300.0)
MOST_DUPLICATES, LEAST_MAPQ = 0.5, 20.0
HEAD = {"insert": 50_000, "duplicates": 200_000, "mapq": 100_000}


def windows(truth: DataFrame, flank: int) -> DataFrame:
    """(event_id, kind, chrom, start, end): an event's own region and both flanks."""
    w = lambda kind, s, e: F.struct(F.lit(kind).alias("kind"), s.alias("start"), e.alias("end"))
    s, e = F.col("start"), F.col("end")
    three = F.array(w("event", s, e), w("left", F.greatest(s - flank, F.lit(0)), s), w("right", e, e + flank))
    return truth.select("event_id", "chrom", F.explode(three).alias("w")).select("event_id", "chrom", "w.*")


def coverage(truth: DataFrame, reads: DataFrame, flank: int = 5000, min_flank_depth: float = 1.0) -> DataFrame:
    """(event_id, check, ratio, expected, pass) of deletions and duplications.

    Depth is reads for each base. Flanks without reads don't count; if their mean is below
    min_flank_depth the check passes without a ratio. All windows are counted in one join.
    """
    t = truth.where(F.col("sv_type").isin("DEL", "DUP"))
    d = intervals.depth(reads, windows(t, flank), ["event_id", "kind"])
    g = d.groupBy("event_id").agg(F.max(F.when(F.col("kind") == "event", F.col("depth"))).alias("own"), F.avg(F.when((F.col("kind") != "event") & (F.col("depth") > 0), F.col("depth"))).alias("flank"))
    j = t.join(g.hint("merge"), "event_id").withColumn("flank", F.coalesce("flank", F.lit(0.0)))
    ok = (F.col("flank") >= min_flank_depth) & (F.col("flank") > 0)
    expected = F.when(F.col("sv_type") == "DEL", 1 - F.col("vaf")).otherwise(1 + F.col("vaf"))
    ratio = F.when(ok, F.col("own") / F.col("flank"))
    return j.select("event_id", event_label(*(F.col(c) for c in ("sv_type", "chrom", "start", "end"))).alias("event"), F.lit("coverage").alias("check"), ratio.alias("ratio"), expected.alias("expected"), F.coalesce(F.abs(ratio - expected) < COVERAGE_TOLERANCE, F.lit(True)).alias("pass"))


def split_reads(truth: DataFrame, reads: DataFrame, flank: int = SPLIT_FLANK) -> DataFrame:
    """(event_id, check, n, pass): reads with a supplementary alignment around all but small variants."""
    t = truth.where("sv_type <> 'SNP'")
    w = t.select("event_id", "sv_type", "chrom", F.greatest(F.col("start") - flank, F.lit(0)).alias("start"), (F.col("end") + flank).alias("end"))
    d = intervals.depth(reads.where("has_sa"), w, ["event_id"])
    return d.select("event_id", F.lit("split_reads").alias("check"), F.col("n_reads").cast("bigint").alias("n"), (F.col("n_reads") > 0).alias("pass"))


def allele_fractions(truth: DataFrame, pile: DataFrame) -> DataFrame:
    """(event_id, check, observed, depth, pass) of single-base variants; other lengths pass, no coverage fails, a depth under 5 passes."""
    t = truth.where("sv_type = 'SNP'").select("event_id", "chrom", F.col("start").alias("p"), F.upper("alt_allele").alias("alt"), ((F.length("ref_allele") == 1) & F.upper("alt_allele").isin("A", "C", "G", "T")).alias("single"), "vaf")
    j = t.join(pile, ["chrom", "p"], "left").withColumn("depth", F.coalesce(F.col("n_a") + F.col("n_c") + F.col("n_g") + F.col("n_t"), F.lit(0)))
    own = F.coalesce(*[F.when(F.col("alt") == b.upper(), F.col("n_" + b)) for b in "acgt"])
    observed = F.when(F.col("single") & (F.col("depth") > 0), own / F.col("depth"))
    ok = F.when(~F.col("single"), True).when(F.col("depth") == 0, False).when(F.col("depth") < LEAST_DEPTH, True).otherwise(F.abs(observed - F.col("vaf")) < FRACTION_TOLERANCE)
    return j.select("event_id", F.lit("allele_fraction").alias("check"), observed.alias("observed"), F.col("depth").cast("bigint").alias("depth"), ok.alias("pass"))


def insert_size(aln: DataFrame, order: list[str], n: int = HEAD["insert"]) -> DataFrame:
    """(check, mean, sd, pass) of the first n usable insert sizes."""
    usable = globally_counted(F.col("flag")) & proper_pair(F.col("flag")) & (F.col("tlen") > 0)
    s = pool.alignment_stats(pool.head(aln.where(usable), order, n), 0)
    return s.select(F.lit("insert_size").alias("check"), F.col("insert_mean").alias("mean"), F.col("insert_sd").alias("sd"), (F.col("insert_mean").between(*INSERT_MEAN) & F.col("insert_sd").between(*INSERT_SD)).alias("pass"))


def duplicate_rate(aln: DataFrame, order: list[str], n: int = HEAD["duplicates"]) -> DataFrame:
    s = pool.head(aln.where(globally_counted(F.col("flag"))), order, n).agg(F.coalesce(F.avg(flagged(F.col("flag"), DUPLICATE).cast("int")), F.lit(0.0)).alias("rate"))
    return s.select(F.lit("duplicate_rate").alias("check"), "rate", (F.col("rate") < MOST_DUPLICATES).alias("pass"))


def mapping_quality(aln: DataFrame, order: list[str], n: int = HEAD["mapq"]) -> DataFrame:
    s = pool.head(aln.where(globally_counted(F.col("flag"))), order, n).agg(F.coalesce(F.avg("mapq"), F.lit(0.0)).alias("mean"))
    return s.select(F.lit("mapping_quality").alias("check"), "mean", (F.col("mean") > LEAST_MAPQ).alias("pass"))


def covering(aln: DataFrame, places: DataFrame) -> DataFrame:
    """Rows of aln whose span on the reference, up to its last aligned block's end, meets a place (g_chrom, g_start, g_end); each as often as it is in aln."""
    end = F.array_max(F.transform(pileup.aligned_blocks(F.col("cigar"), F.col("pos")), lambda b: b["ref"] + b["len"]))
    spans = aln.withColumn("__row", F.monotonically_increasing_id()).withColumn("__end", end)
    met = intervals.overlap_join(spans, places, ("chrom", "pos", "__end"), ("g_chrom", "g_start", "g_end"))
    return met.dropDuplicates(["__row"]).select(*aln.columns)


def parts(truth: DataFrame, reads: DataFrame, aln: DataFrame, order: list[str], flank: int = 5000, min_flank_depth: float = 1.0, min_mapq: int = 20) -> dict[str, Callable[[], DataFrame]]:
    """Each check's rows (event, check, expected, observed, pass), made when asked for."""
    text = lambda c: F.when(c.isNull(), "N/A").otherwise(F.format_string("%.3f", c))
    names = truth.select("event_id", event_label(*(F.col(c) for c in ("sv_type", "chrom", "start", "end"))).alias("event"))
    whole = lambda df, expected, value: df.select(F.lit("global").alias("event"), "check", F.lit(expected).alias("expected"), text(F.col(value)).alias("observed"), "pass")

    def fractions() -> DataFrame:
        pile = pileup.piled_at(aln.where(primary(F.col("flag"), F.col("mapq"), min_mapq)), truth.where("sv_type = 'SNP'").select("chrom", F.col("start").alias("p")))
        return allele_fractions(truth, pile).join(truth.select("event_id", "vaf").hint("merge"), "event_id").join(names.hint("merge"), "event_id").select("event", "check", text(F.col("vaf")).alias("expected"), text(F.col("observed")).alias("observed"), "pass")

    return {
        "coverage": lambda: coverage(truth, reads, flank, min_flank_depth).select("event", "check", text(F.col("expected")).alias("expected"), text(F.col("ratio")).alias("observed"), "pass"),
        "split_reads": lambda: split_reads(truth, reads).join(names.hint("merge"), "event_id").select("event", "check", F.lit("> 0").alias("expected"), F.col("n").cast("string").alias("observed"), "pass"),
        "allele_fraction": fractions,
        "insert_size": lambda: whole(insert_size(aln, order), "50-1000", "mean"),
        "duplicate_rate": lambda: whole(duplicate_rate(aln, order), "< 0.5", "rate"),
        "mapping_quality": lambda: whole(mapping_quality(aln, order), "> 20", "mean"),
    }


def run(truth: DataFrame, reads: DataFrame, aln: DataFrame, order: list[str], flank: int = 5000, min_flank_depth: float = 1.0, min_mapq: int = 20) -> DataFrame:
    """(event, check, expected, observed, pass) of all checks as one plan: those of each event by its type, and the global ones."""
    return functools.reduce(DataFrame.unionByName, (make() for make in parts(truth, reads, aln, order, flank, min_flank_depth, min_mapq).values()))


def run_each(checks: dict[str, Callable[[], DataFrame]], at_once: int = 3) -> tuple[DataFrame, dict[str, str]]:
    """(the rows of all checks that could be run, the errors of the others by check).

    Each check is a job group of its own and its rows a table in the shared folder, at_once of
    them at the same time; one that fails is a warning and leaves the others' rows. That none
    could be run is an error.
    """
    spark = SparkSession.active()
    if not checks:
        raise NoChecks("no check could be run")

    def one(name: str) -> DataFrame | Exception:
        spark.sparkContext.setJobGroup(f"check-{name}", f"validation check {name}", interruptOnCancel=True)
        try:
            return stored(checks[name](), f"check-{name}")[0]
        except Exception as e:  # noqa: BLE001  whatever a check fails by, the others go on
            return e

    with ThreadPoolExecutor(at_once) as pool_:
        done = dict(zip(checks, pool_.map(inheritable_thread_target(spark)(one), checks)))
    errors = {name: str(e).split("\n")[0] or type(e).__name__ for name, e in done.items() if isinstance(e, Exception)}
    for name, message in errors.items():
        warnings.warn(f"{name} could not be checked: {message}", stacklevel=2)
    rows = [df for df in done.values() if isinstance(df, DataFrame)]
    if not rows:
        raise NoChecks(f"all {len(errors)} checks failed to run: " + "; ".join(errors.values()))
    return functools.reduce(DataFrame.unionByName, rows), errors


def summary(checks: DataFrame) -> DataFrame:
    return checks.agg(F.count("*").alias("total"), F.count_if("pass").alias("passed"), F.count_if(~F.col("pass")).alias("failed"))


class NoChecks(RuntimeError):
    pass


def passed(checks: DataFrame) -> bool:
    """Whether every check passes; that none ran is an error."""
    n = summary(checks).first()
    if not n.total:
        raise NoChecks("no check could be run")
    return n.failed == 0


def _nearest(j: DataFrame) -> DataFrame:
    """Pairs that are the nearest of both their truth event and their call."""
    best = lambda own, other: F.row_number().over(Window.partitionBy(own).orderBy("far", other))
    j = j.withColumn("of_truth", best("event_id", "call_id")).withColumn("of_call", best("call_id", "event_id"))
    return j.where("of_truth = 1 and of_call = 1").drop("of_truth", "of_call")


def matched_calls(truth: DataFrame, calls: DataFrame, most: int = 500, least_ratio: float = 0.5, rounds: int | None = 1) -> DataFrame:
    """(event_id, call_id, start_distance, end_distance, size_ratio): truth events (event_id, chrom, start, end) and calls (call_id, chrom, start, end) that match.

    Both ends lie within most bases and the shorter is at least least_ratio of the longer. Of
    several candidates the nearest by both ends counts, ties by id; a match is best for both
    sides, so each event and each call has one at most. With rounds None, the pairs left when
    the matched ones are gone are matched in the same way, until there is none: that is what
    taking all pairs in order of their distance gives, each if both of its sides are free.
    """
    t = truth.select("event_id", "chrom", "start", "end", (F.col("start") - most).alias("lo"), (F.col("start") + most + 1).alias("hi"))
    c = calls.select("call_id", F.col("chrom").alias("c_chrom"), F.col("start").alias("c_start"), F.col("end").alias("c_end")).withColumn("c_next", F.col("c_start") + 1)
    j = intervals.overlap_join(t, c, ("chrom", "lo", "hi"), ("c_chrom", "c_start", "c_next"))
    size, own = F.col("end") - F.col("start"), F.col("c_end") - F.col("c_start")
    j = j.select("event_id", "call_id", F.abs(F.col("start") - F.col("c_start")).alias("start_distance"), F.abs(F.col("end") - F.col("c_end")).alias("end_distance"), (F.least(size, own) / F.greatest(size, own, F.lit(1))).cast("double").alias("size_ratio"))
    j = j.where((F.col("end_distance") <= most) & (F.col("size_ratio") >= least_ratio)).withColumn("far", F.col("start_distance") + F.col("end_distance"))
    if rounds == 1:
        return _nearest(j).drop("far")
    left, remove = stored(j, "candidates")
    found: list[DataFrame] = []
    while len(found) != rounds and not left.isEmpty():
        found.append(stored(_nearest(left), "matches")[0])
        rest = left.join(found[-1].select("event_id"), "event_id", "left_anti").join(found[-1].select("call_id"), "call_id", "left_anti")
        (left, following) = stored(rest.select(*j.columns), "candidates")
        remove()
        remove = following
    return functools.reduce(DataFrame.unionByName, found or [left]).drop("far")


def call_score(truth: DataFrame, calls: DataFrame, most: int = 500, least_ratio: float = 0.5, rounds: int | None = 1) -> DataFrame:
    """(tp, fp, fn, recall, precision, f1) of one row; shares without a base are 0."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    one = n(matched_calls(truth, calls, most, least_ratio, rounds), "tp").join(n(truth, "t")).join(n(calls, "c"))  # one row each
    one = one.select("tp", (F.col("c") - F.col("tp")).alias("fp"), (F.col("t") - F.col("tp")).alias("fn"))
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return one.select("tp", "fp", "fn", share(tp, tp + fn).alias("recall"), share(tp, tp + fp).alias("precision"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


def score(true_positive: int, false_positive: int, false_negative: int) -> dict[str, float]:
    """Recall, precision and F1 of counts; 0 where undefined."""
    share = lambda a, b: a / b if b else 0.0
    r, p = share(true_positive, true_positive + false_negative), share(true_positive, true_positive + false_positive)
    return {"recall": r, "precision": p, "f1": share(2 * r * p, r + p)}
