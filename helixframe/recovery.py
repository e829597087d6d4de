"""Are simulated deletions found again? Stages from a truth set to a summary table, each of which can be resumed.

A stage writes its files first and its manifest last: the fingerprint of its parameters, of its
input files and of the stage before. A stage whose manifest still fits is not run again.
Aligning and calling are left to the tools that the scripts of simulate name; what they make
(sim.bam and calls.vcf or calls.vcf.gz in a fraction's folder) is taken up by the next run.
"""

from __future__ import annotations

import argparse
import hashlib
import json
import posixpath
import sys

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .functions import vcf
from .operators.intervals import overlapping
from .plans import validate
from .sources import text

STAGES = ("truth", "simulate", "merge", "validate", "score", "summary")
# The columns of the summary.
SUMMARY = ("VAF", "N_truth", "N_calls", "TP", "FP", "FN", "Recall", "Precision", "F1", "Validate")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def state(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(name, bytes, time of change) of a file or of a folder's files; empty where there is none."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p) if not s.getPath().getName().startswith(("_", ".")))


def read_json(spark: SparkSession, path: str):
    fs, p = _fs(spark, path)
    return json.loads("\n".join(r.value for r in spark.read.text(path).collect())) if fs.exists(p) else None


def deletions(spark: SparkSession, truth_vcf: str, chrom: str | None, benchmark: str | None, least: int, most: int) -> DataFrame:
    """(chrom, pos, line): heterozygous deletions of a size range, one at a position, within the benchmark's regions."""
    whole = text.lines(spark, truth_vcf)
    found = text.het_deletions(whole, least, most).join(whole.select("line_no", "line"), "line_no")
    found = found.where(F.col("chrom") == chrom) if chrom else found
    first = F.row_number().over(Window.partitionBy("chrom", "pos").orderBy("line"))
    found = found.withColumn("n", first).where("n = 1").select("chrom", "pos", "line").withColumn("key", F.concat_ws(":", "chrom", "pos"))
    if benchmark:
        bed = text.lines(spark, benchmark).where("trim(line) <> '' and line not like '#%'")
        f = lambda i: F.get(F.split("line", "\t"), F.lit(i))
        regions = bed.select(f(0).alias("r_chrom"), f(1).cast("long").alias("r_start"), f(2).cast("long").alias("r_end"))
        length = F.greatest(F.length(F.get(F.split("line", "\t"), F.lit(3))), F.lit(1))
        spans = found.withColumn("start", F.col("pos") - 1).withColumn("end", F.col("pos") - 1 + length)
        found = overlapping(spans, regions, "key").select("chrom", "pos", "line", "key")
    return found.drop("key")


class Recovery:
    """One run of the stages over a folder."""

    def __init__(self, spark: SparkSession, a: argparse.Namespace):
        self.spark, self.a = spark, a
        self.fractions = [float(x) for x in a.fractions.split(",")]

    def at(self, *names: str) -> str:
        return posixpath.join(self.a.output, *names)

    def folder(self, fraction: float, *names: str) -> str:
        return self.at(f"vaf_{fraction:g}", *names)

    def calls(self, fraction: float) -> str | None:
        return next((self.folder(fraction, n) for n in ("calls.vcf.gz", "calls.vcf") if state(self.spark, self.folder(fraction, n))), None)

    def inputs(self, stage: str) -> list[str]:
        """What a stage reads besides the results of the one before."""
        a = self.a
        per = lambda name: [self.folder(f, name) for f in self.fractions]
        return {"truth": [a.truth, *([a.benchmark] if a.benchmark else [])], "simulate": [a.bam, a.reference], "merge": [a.bam, *per("sim.bam")], "validate": [], "score": [c for f in self.fractions if (c := self.calls(f))], "summary": []}[stage]

    def fingerprint(self, stage: str, before: str) -> str:
        a = self.a
        options = {"truth": [a.chrom, a.least, a.most], "simulate": [self.fractions, a.seed, a.flank, a.min_mapq], "merge": [self.fractions], "validate": [a.min_mapq, a.flank], "score": [a.distance, a.ratio], "summary": []}[stage]
        return hashlib.sha256(json.dumps([stage, before, options, [(p, state(self.spark, p)) for p in self.inputs(stage)]]).encode()).hexdigest()

    def run(self) -> list[str]:
        """The stages that were run; those before skip_to have to be there already."""
        from .app import InputError, write_text

        ran, before = [], ""
        for k, stage in enumerate(STAGES, 1):
            path, now = self.at(f"{k}-{stage}.json"), self.fingerprint(stage, before)
            known = read_json(self.spark, path)
            if k < self.a.skip_to and known is None:
                raise InputError(f"stage {k} ({stage}) has not been run in {self.a.output}")
            if known is None or k >= self.a.skip_to and known["fingerprint"] != now:
                result = getattr(self, stage)()
                write_text(self.spark, path, [json.dumps({"fingerprint": now, "result": result})])
                ran.append(stage)
            else:
                now = known["fingerprint"]
            before = now
            if self.a.stop_after == stage:
                break
        return ran

    def result(self, stage: str):
        return read_json(self.spark, self.at(f"{STAGES.index(stage) + 1}-{stage}.json"))["result"]

    def truth(self) -> int:
        from .app import write_text

        found = deletions(self.spark, self.a.truth, self.a.chrom, self.a.benchmark, self.a.least, self.a.most).orderBy("chrom", "pos")
        header = [r.line for r in text.lines(self.spark, self.a.truth).where("line like '#%'").orderBy("line_no").select("line").toLocalIterator()]
        rows = [r.line for r in found.toLocalIterator()]  # a run's events: a small list
        write_text(self.spark, self.at("events.vcf"), [*header, *rows])
        return len(rows)

    def simulate(self) -> list[float]:
        from .app import parser, run_simulate

        for f in self.fractions:
            args = ["simulate", "--bam", self.a.bam, "--reference", self.a.reference, "--vcf", self.at("events.vcf"), "--allele-fraction", str(f), "--output", self.folder(f), "--seed", str(self.a.seed), "--flank", str(self.a.flank), "--min-mapq", str(self.a.min_mapq), "--allow-overlap"]
            a = parser().parse_args(args)
            a.command = ["helixframe", *args]
            run_simulate(self.spark, a)
        return self.fractions

    def merge(self) -> list[float]:
        """Fractions whose aligned reads are there."""
        from .app import parser, run_merge

        done = []
        for f in self.fractions:
            if state(self.spark, self.folder(f, "sim.bam")):
                run_merge(self.spark, parser().parse_args(["merge", "--bam", self.a.bam, "--aligned", self.folder(f, "sim.bam"), "--bed", self.folder(f, "events.bed"), "--output", self.folder(f, "merged.bam")]), show=False)
                done.append(f)
            else:
                print(f"{self.folder(f)}: no sim.bam; run align.sh, then this again", file=sys.stderr)
        return done

    def validate(self) -> dict[str, str]:
        """Passed and all checks of each merged fraction."""
        from .app import parser, run_checks

        out = {}
        for f in self.result("merge"):
            checks, _ = run_checks(self.spark, parser().parse_args(["validate", "--bam", self.folder(f, "merged.bam"), "--truth", self.folder(f, "truth.vcf"), "--min-mapq", str(self.a.min_mapq)]))
            n = validate.summary(checks).first()
            out[f"{f:g}"] = f"{n.passed}/{n.total}"
        return out

    def score(self) -> dict[str, list]:
        """Calls, and matched calls' figures, of each fraction that has calls."""
        out = {}
        for f in self.fractions:
            if not (path := self.calls(f)):
                continue
            truth = text.truth(text.lines(self.spark, self.folder(f, "truth.vcf"))).where("sv_type = 'DEL'").select(F.col("line_no").alias("event_id"), "chrom", "start", "end")
            r = text.lines(self.spark, path).where("line not like '#%'")
            c = lambda i: F.get(F.split("line", "\t"), F.lit(i))
            good = (c(6).isin("PASS", ".")) & (vcf.info_value(c(7), "SVTYPE") == "DEL")
            called = r.where(good).select(F.col("line_no").alias("call_id"), c(0).alias("chrom"), c(1).cast("long").alias("start"), vcf.end_of(c(1).cast("long"), c(7)).alias("end")).where(F.col("end") - F.col("start") >= self.a.least)
            s = validate.call_score(truth, called, self.a.distance, self.a.ratio, rounds=None).first()
            out[f"{f:g}"] = [r.count(), s.tp, s.fp, s.fn, s.recall, s.precision, s.f1]
        return out

    def summary(self) -> list[str]:
        from .app import write_text

        n, score, checks = self.result("truth"), self.result("score"), self.result("validate")
        rows = ["\t".join(SUMMARY)]
        for f in (f"{x:g}" for x in self.fractions):
            calls, tp, fp, fn, *shares = score.get(f, [0, 0, 0, 0, None, None, None])
            rows.append("\t".join([f, str(n), str(calls), str(tp), str(fp), str(fn), *("N/A" if x is None else f"{x:.4f}" for x in shares), checks.get(f, "N/A")]))
        write_text(self.spark, self.at("validation_summary.tsv"), rows)
        return rows
