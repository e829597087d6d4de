"""The duplications' report and the recovery stages, through files made by the tests."""

import json
import random
import re
import shutil
import statistics

import pytest
from helixframe import app
from helixframe.plans import dup_report
from helixframe.sources import bam


def blocks(cigar, pos):
    out, r, q = [], pos, 0
    for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar):
        n = int(n)
        if op in "M=X":
            out.append((r, q, n))
        r += n if op in "MDN=X" else 0
        q += n if op in "MIS=X" else 0
    return out


def made_reads(seed=3, n=3000):
    r = random.Random(seed)
    out = []
    for i in range(n):
        cigar = r.choice(["50M", "50M", "50M", "5S45M", "40M10S", "20M5D30M", "3H50M", "20M2I28M"])
        seq = "".join(r.choice("ACGTN") for _ in range(50))
        qual = "".join(chr(33 + r.choice([5, 19, 20, 35])) for _ in range(50))
        out.append((f"r{i // 2}", r.choice([99, 147, 99, 147, 1123, 355, 2147, 611, 4]), r.choice(["chr1", "chr1", "chr2"]), r.randrange(0, 9000), r.choice([60, 60, 19, 20]), cigar, 0, 0, seq, qual, "chr1,1,+,5M,1,0;" if r.random() < 0.2 else None))
    return out


def plain_report(dups, rows, snps, window, flank):
    primary = [x for x in rows if not x[1] & (4 | 256 | 512 | 1024 | 2048) and x[4] >= 20]
    near = [x for x in rows if not x[1] & (4 | 256 | 512 | 2048) and x[4] >= 20]

    def depth(c, s, e):
        hit = sum(1 for x in primary if x[2] == c for a, q, n in blocks(x[5], x[3]) for k in range(n) if s <= a + k < e and ord(x[9][q + k]) - 33 >= 20)
        return hit / (e - s) if e > s else 0.0

    lines = ["\t".join(dup_report.COLUMNS)]
    for i, (c, s, e, vaf) in enumerate(dups):
        own, left, right = depth(c, s, e), depth(c, max(0, s - flank), s), depth(c, e, e + flank)
        both = (left + right) / 2
        inside = [x for x in near if x[2] == c and x[3] < e + window and max(a + n for a, _, n in blocks(x[5], x[3])) > max(0, s - window)]
        shares, tested = [], 0
        for c2, p, ref, alt in snps or ():
            if c2 == c and s <= p < e:
                tested += 1
                seen = [x[8][q + p - a] for x in primary if x[2] == c for a, q, n in blocks(x[5], x[3]) if a <= p < a + n and ord(x[9][q + p - a]) - 33 >= 20]
                if seen.count(ref) + seen.count(alt) >= 3:
                    shares.append(seen.count(alt) / (seen.count(ref) + seen.count(alt)))
        f = lambda v: f"{v:.4f}"
        balance = [f(statistics.mean(shares)), f(statistics.median(shares)), f(max(abs(v - 0.5) for v in shares))] if shares else ["NA"] * 3
        lines.append("\t".join(map(str, [f"dup_{i + 1}", c, s, e, e - s, f(vaf), f(own), f(left), f(right), f(both), f(own / both) if both else "NA", len({x[0] for x in inside if x[10]}), len({x[0] for x in inside if re.search(r"^(\d+H)?\d+S|\d+S(\d+H)?$", x[5])}), len(inside), tested if snps is not None else "NA", len(shares), *balance])))
    return lines


@pytest.mark.parametrize("kind", ["bam", "parquet"])
def test_duplication_report(spark, tmp_path, kind):
    rows = made_reads()
    df = spark.createDataFrame(rows, bam.SCHEMA)
    path = str(tmp_path / f"in.{kind}")
    bam.write(df, path, [("chr1", 10_000), ("chr2", 10_000)], 2) if kind == "bam" else df.write.parquet(path)
    dups = [("chr1", 100, 900, 0.5), ("chr1", 3000, 5000, 0.25), ("chr2", 8800, 9900, 0.5), ("chr3", 50, 60, 1.0)]
    truth = ["##x", *(f"{c}\t{s}\t.\tN\t<DUP>\t.\tPASS\tSVTYPE=DUP;END={e};SIM_VAF={v}" for c, s, e, v in dups), "chr1\t5\t.\tN\t<DEL>\t.\tPASS\tSVTYPE=DEL;END=90"]
    (tmp_path / "truth.vcf").write_text("\n".join(truth) + "\n")
    r = random.Random(1)
    snps = [("chr1", p, *r.sample("ACGT", 2)) for p in r.sample(range(0, 6000), 300)]
    (tmp_path / "snps.txt").write_text("# made up\n" + "".join(f"{c} {p}\t{a.lower()} {b}\n" for c, p, a, b in snps))
    out = tmp_path / "report.tsv"
    args = ["dup-report", "--bam", path, "--truth", str(tmp_path / "truth.vcf"), "--out", str(out), "--coverage-flank", "700", "--junction-window", "100", "--min-baf-depth", "3"]
    assert app.main([*args, "--snp-list", str(tmp_path / "snps.txt")], spark) == 0
    assert out.read_text().splitlines() == plain_report(dups, rows, snps, 100, 700)
    assert app.main(args, spark) == 0
    whole = out.read_text().splitlines()
    assert whole == plain_report(dups, rows, None, 100, 700)
    assert app.main([*args, "--event", "chr1:2000-6000"], spark) == 0 and out.read_text().splitlines() == [whole[0], whole[2]]
    assert app.main([*args, "--max-events", "1"], spark) == 0 and out.read_text().splitlines() == whole[:2]
    assert app.main([*args, "--event", "chr9:1-2"], spark) == 1 and app.main([*args, "--event", "chr9"], spark) == 1


def test_recovery_goes_on_where_it_was_left(spark, tmp_path, capsys):
    r = random.Random(5)
    whole = "".join(r.choice("ACGT") for _ in range(30_000))
    (tmp_path / "ref.fa").write_text(">chr1\n" + "\n".join(whole[i : i + 60] for i in range(0, len(whole), 60)) + "\n")
    (tmp_path / "ref.fa.fai").write_text(f"chr1\t{len(whole)}\t6\t60\t61\n")
    rows = []
    for i in range(1500):
        s = r.randrange(100, 29_000)
        e = s + r.randint(250, 400)
        for flag, p, m, t in ((99, s, e - 50, e - s), (147, e - 50, s, s - e)):
            rows.append((f"p{i}", flag, "chr1", p, 60, "50M", m, t, whole[p : p + 50], "I" * 50, None))
    bam.write(spark.createDataFrame(rows, bam.SCHEMA), str(tmp_path / "background.bam"), [("chr1", len(whole))], 2)
    line = lambda p, n, gt, ref: f"chr1\t{p}\t.\t{ref}\t{ref[0]}\t9\tPASS\tSVTYPE=DEL;SVLEN=-{n}\tGT:AD\t{gt}:1,2"
    dels = [(10_000, 800, "0/1"), (20_000, 600, "1|0"), (5000, 700, "1/1"), (15_000, 100, "0/1"), (25_000, 900, "0|1")]
    truth = ["##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS", *(line(p, n, gt, whole[p - 1 : p + n]) for p, n, gt in dels), line(10_000, 900, "0/1", whole[9999:10_900])]
    (tmp_path / "truth.vcf").write_text("\n".join(truth) + "\n")
    (tmp_path / "bench.bed").write_text("chr1\t9000\t22000\n")
    common = ["recovery", "--bam", str(tmp_path / "background.bam"), "--reference", str(tmp_path / "ref.fa"), "--truth", str(tmp_path / "truth.vcf"), "--benchmark", str(tmp_path / "bench.bed"), "--fractions", "0.5", "--flank", "1000"]

    def run(out, *more):
        assert app.main([*common, "--output", str(out), *more], spark) == 0
        return capsys.readouterr().out.strip().split("stages run: ")[-1]

    one, two = tmp_path / "one", tmp_path / "two"
    assert run(one, "--stop-after", "truth") == "truth"
    events = [x for x in (one / "events.vcf").read_text().splitlines() if x[0] != "#"]
    assert [(x.split("\t")[1], x.split("\t")[7]) for x in events] == [("10000", "SVTYPE=DEL;SVLEN=-800"), ("20000", "SVTYPE=DEL;SVLEN=-600")]
    assert run(one, "--stop-after", "simulate") == "simulate" and run(one, "--stop-after", "simulate") == "none"
    made = (one / "vaf_0.5" / "truth.vcf").read_text()
    shutil.copytree(one, two)
    assert run(one) == "merge, validate, score, summary"
    assert (one / "validation_summary.tsv").read_text().splitlines()[1].split("\t") == ["0.5", "2", "0", "0", "0", "0", "N/A", "N/A", "N/A", "N/A"]
    # an aligner's and a caller's results come in; only what depends on them is made again
    bam.write(spark.createDataFrame(rows[:600], bam.SCHEMA), str(one / "vaf_0.5" / "sim.bam"), [("chr1", len(whole))], 1)
    (one / "vaf_0.5" / "calls.vcf").write_text("##x\nchr1\t10010\t.\tN\t<DEL>\t9\tPASS\tSVTYPE=DEL;END=10790\nchr1\t3000\t.\tN\t<DEL>\t9\tPASS\tSVTYPE=DEL;END=3900\nchr1\t20000\t.\tN\t<DEL>\t9\tLowQual\tSVTYPE=DEL;END=20600\n")
    assert run(one) == "merge, validate, score, summary" and (one / "vaf_0.5" / "truth.vcf").read_text() == made
    last = (one / "validation_summary.tsv").read_text().splitlines()
    assert last[1].split("\t")[:9] == ["0.5", "2", "3", "1", "1", "1", "0.5000", "0.5000", "0.5000"] and re.fullmatch(r"\d+/\d+", last[1].split("\t")[9])
    assert run(one) == "none" and run(one, "--skip-to", "6") == "none"
    assert json.loads((one / "3-merge.json").read_text())["result"] == [0.5]
    # with all results there at once the summary is the same
    bam.write(spark.createDataFrame(rows[:600], bam.SCHEMA), str(two / "vaf_0.5" / "sim.bam"), [("chr1", len(whole))], 1)
    (two / "vaf_0.5" / "calls.vcf").write_text((one / "vaf_0.5" / "calls.vcf").read_text())
    run(two)
    assert (two / "validation_summary.tsv").read_text().splitlines() == last
    assert app.main([*common, "--output", str(tmp_path / "three"), "--skip-to", "3"], spark) == 1 and "has not been run" in capsys.readouterr().err
