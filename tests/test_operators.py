"""Operators on small tables whose results are known."""

import gzip
import hashlib
import itertools
import random
import struct
import zlib

import numpy as np
import pytest
from helixframe.functions import specs
from helixframe.functions.sequence import revcomp
from helixframe.operators import emission, haplotype, intervals, pileup, pool, quality, rng, simulate
from helixframe.plans import simulate as plan, validate
from helixframe.sources import bam, bgzf, sinks, text
from pyspark.sql import functions as F

EXONS = [{"chrom": "chr1", "start": 1000 + 500 * i, "end": 1200 + 500 * i, "name": f"A{i}", "gene": "GENEA"} for i in range(8)] + [{"chrom": "chr2", "start": 10000 + 2000 * i, "end": 10300 + 2000 * i, "name": f"B{i}", "gene": "GENEB"} for i in range(5)]


# --- specs


@pytest.mark.parametrize(
    "spec, expected",
    [
        ("del:chr20:300-500", ("DEL", "chr20", 300, 500)),
        ("DUP:chr1:5-6;af=0.25", ("DUP", "chr1", 5, 6)),
        ("inv:genea:exon2-exon4", ("INV", "chr1", 1500, 2700)),
        ("del:GENEA:exon4-exon2", ("DEL", "chr1", 1500, 2700)),
        ("ins:chr1:7:12", ("INS", "chr1", 7, 7)),
        ("ins:chr1:7:acgt", ("INS", "chr1", 7, 7)),
        ("snp:chr1:100:A:T", ("SNP", "chr1", 99, 100)),
        ("snp:chr1:100:ACG>a", ("SNP", "chr1", 99, 102)),
        ("fusion:GENEA:exon2:geneb:3:inv", ("BND", "chr1", 1700, 1700)),
    ],
)
def test_event_specs(spec, expected):
    e = specs.parse_event(spec, EXONS)
    assert (e.sv_type, e.chrom, e.start, e.end) == expected


def test_event_spec_details():
    assert specs.parse_event("ins:c:7:acgt").ins_seq == "ACGT" and specs.parse_event("ins:c:7:12").ins_len == 12
    f = specs.parse_event("fusion:GENEA:exon2:geneb:3:inv", EXONS)
    assert (f.chrom_b, f.bp_b, f.inverted) == ("chr2", 14000, True)
    assert specs.parse_event("del:c:1-2;af=het").fraction.kind == "het" and specs.parse_event("del:c:1-2; af=1 ").fraction.value == 1


@pytest.mark.parametrize("spec", ["xyz:1", "del:chr1", "del:chr1:0-5", "del:chr1:5-5", "del:chr1:9-5", "del:NOGENE:exon1-exon2", "del:GENEA:exon1-exon9", "ins:c:1:0", "ins:c:1:AXG", "snp:c:0:A:T", "snp:c:5:A:A", "snp:c:5:A", "del:c:1-2;af=0", "del:c:1-2;af=1.1", "del:c:1-2;x=1", "del:c:1-2;af", "fusion:GENEA:exon1:GENEB"])
def test_wrong_event_specs(spec):
    with pytest.raises(specs.SpecError):
        specs.parse_event(spec, EXONS)


def test_regions():
    assert specs.parse_region("chr1:1,001-2,000") == ("chr1", 1000, 2000) and specs.parse_region("c:5-5") == ("c", 4, 5)
    for bad in ("c:0-5", "c:9-5", "c", "c:a-b"):
        with pytest.raises(specs.SpecError):
            specs.parse_region(bad)


def test_revcomp(spark):
    assert spark.range(1).select(revcomp(F.lit("ACGTNN"))).first()[0] == "NNACGT"


# --- intervals


def some_intervals(n, seed):
    r = random.Random(seed)
    return [(i, f"c{r.randrange(3)}", s, s + r.choice([0, 1, 10, 500, 9000])) for i in range(n) for s in [r.randrange(20000)]]


@pytest.mark.parametrize("width", [64, 4096, 100000])
def test_overlap_join(spark, width):
    a, b = some_intervals(150, 1), some_intervals(150, 2)
    left = spark.createDataFrame(a, "i long, c long, s long, e long".replace("c long", "c string"))
    right = spark.createDataFrame(b, "j long, c2 string, s2 long, e2 long")
    got = intervals.overlap_join(left, right, ("c", "s", "e"), ("c2", "s2", "e2"), width).select("i", "j").collect()
    expected = [(x[0], y[0]) for x, y in itertools.product(a, b) if x[1] == y[1] and x[2] < y[3] and y[2] < x[3]]
    assert sorted(map(tuple, got)) == sorted(expected)


def test_overlap_join_of_all_widths(spark):
    r = random.Random(9)
    make = lambda n: [(i, f"c{r.randrange(2)}", s, s + w) for i in range(n) for s, w in [(r.randrange(2 * 10**8), int(10 ** r.uniform(0, 8.2)))]] + [(n, "c0", 4096, 4096), (n + 1, "c1", 0, 1 << 36), (n + 2, "c0", 4095, 4096 + 4097)]
    a, b = make(120), make(90)
    left, right = spark.createDataFrame(a, "i long, c string, s long, e long"), spark.createDataFrame(b, "j long, c2 string, s2 long, e2 long")
    got = intervals.overlap_join(left, right, ("c", "s", "e"), ("c2", "s2", "e2")).select("i", "j").collect()
    expected = [(x[0], y[0]) for x, y in itertools.product(a, b) if x[1] == y[1] and x[2] < y[3] and y[2] < x[3]]
    assert sorted(map(tuple, got)) == sorted(expected)
    for df, on in ((left, ("s", "e")), (right, ("s2", "e2"))):  # rows are bounded by the levels, whatever the widths
        listed = intervals._listed(df, *on, intervals.BIN, F.sequence(intervals._level(*on, intervals.BIN), F.lit(intervals.LEVELS - 1)), "l")
        assert listed.count() <= (9 + 2 * (intervals.LEVELS - 1)) * df.count()
        assert intervals._listed(df, *on, intervals.BIN, F.array(intervals._level(*on, intervals.BIN)), "l").count() <= 9 * df.count()


def test_touching_events_do_not_overlap(spark):
    e = spark.createDataFrame([(1, "c", 100, 200), (2, "c", 200, 300), (3, "c", 250, 250), (4, "d", 100, 300)], "event_id long, chrom string, start long, end long")
    assert [tuple(r) for r in intervals.self_overlaps(e).collect()] == [(2, 3)]


def test_merge(spark):
    rows = [("c", 0, 10), ("c", 10, 20), ("c", 5, 8), ("c", 21, 30), ("d", 0, 5)]
    got = intervals.merged(spark.createDataFrame(rows, "chrom string, start long, end long"))
    assert sorted(map(tuple, got.collect())) == [("c", 0, 20, 3), ("c", 21, 30, 1), ("d", 0, 5, 1)]


def test_relation_and_share(spark):
    rows = [(0, 10), (10, 20), (15, 25), (20, 30), (5, 40), (12, 12)]
    d = spark.createDataFrame(rows, "s long, e long").select("s", intervals.relation(F.col("s"), F.col("e"), F.lit(10), F.lit(20)).alias("r"), intervals.overlap_share(F.col("s"), F.col("e"), F.lit(10), F.lit(20)).alias("x"))
    assert [(r.r, round(r.x, 3)) for r in d.collect()] == [("outside", 0), ("inside", 1), ("overlapping", 0.5), ("outside", 0), ("overlapping", round(10 / 35, 3)), ("inside", 1)]


# --- pools and pileups

ALN = "name string, flag int, chrom string, pos long, mapq int, cigar string, tlen int, seq string, qual string, ord long"


def test_pairs_by_name(spark):
    rows = [("a", 99, "c", 100, 60, "4M", 420, "ACGT", "IIII", 1), ("a", 147, "c", 300, 60, "4M", -420, "AACC", "ABCD", 2), ("z", 99, "c", 100, 60, "4M", 0, "A" * 150, "I" * 150, 3), ("z", 147, "c", 260, 60, "4M", 0, "C" * 150, "I" * 150, 4), ("a", 99, "c", 100, 60, "4M", 420, "TTTT", "IIII", 5)]
    got = {r.name: r for r in pool.paired(spark.createDataFrame(rows, ALN), ["ord"]).collect()}
    assert (got["a"].ref_start, got["a"].ref_end, got["a"].insert_size) == (100, 520, 420)
    assert (got["a"].seq1, got["a"].seq2, got["a"].qual2) == ("TTTT", "GGTT", "DCBA")
    assert got["z"].ref_end == 410


def test_pileup_of_cigars(spark):
    rows = [("a", 99, "c", 10, 60, "2S3M1I2M2D1M3N1M1S", 0, "NNACGTTACTN", "IIIIIIIIIII", 1)]
    got = pileup.bases(spark.createDataFrame(rows, ALN), ["name"])
    assert sorted((r.p, r.base) for r in got.collect()) == [(10, "A"), (11, "C"), (12, "G"), (13, "T"), (14, "A"), (17, "C"), (21, "T")]


def test_pileup_adds_up_before_the_shuffle(spark):
    """Any CIGARs against single bases; a crowded bin is few rows a task."""
    r = random.Random(3)
    cigars = ["50M", "5S45M", "20M2I28M", "10M5D40M", "25M100N25M", "60M", "2H50M", "50I", "10=1X39M"]
    rows = [(f"r{i}", 99, r.choice(["c", "d"]), r.choice([r.randrange(5000), 1000, 1020]), 60, r.choice(cigars), 0, "".join(r.choice("ACGTNacgt") for _ in range(r.choice([50, 50, 30, 0]))), "I" * 50, i) for i in range(4000)]
    rows += [("x", 99, None, 5, 60, "50M", 0, "A" * 50, "", 1), ("y", 99, "c", 5, 60, None, 0, "A" * 50, "", 1), ("z", 99, "c", 5, 60, "5M", 0, None, "", 1)]
    aln = spark.createDataFrame(rows, ALN).repartition(3)
    expected = sorted(map(tuple, pileup.counts(pileup.bases(aln.where("name not in ('x', 'y', 'z')"), [])).collect()))
    for most, ordered in ((1024, False), (0, False), (2, True)):
        assert sorted(map(tuple, pileup.piled(aln, 256, most, ordered).collect())) == expected
    assert pileup.piled(aln.limit(0)).count() == 0
    deep = spark.range(200_000).select(F.lit("c").alias("chrom"), (F.col("id") % 30).alias("pos"), F.lit("50M").alias("cigar"), F.lit("ACGTA" * 10).alias("seq")).repartition(4)
    plan = pileup.piled(deep)
    assert plan.agg(F.sum(F.expr("n_a + n_c + n_g + n_t"))).first()[0] == 200_000 * 50 and plan.count() == 79
    counts = pileup.Counts(1024, 10)
    for b in deep.toArrow().to_batches():
        counts.add(b)
    assert sum(b.num_rows for b in counts.rows()) == 79  # what a task gives away, whatever the depth


def test_het_sites_and_votes(spark):
    pile = spark.createDataFrame([("c", 1, 5, 5, 0, 0), ("c", 2, 9, 1, 0, 0), ("c", 3, 4, 4, 0, 0), ("c", 4, 0, 2, 8, 0), ("c", 5, 8, 0, 0, 2)], "chrom string, p long, n_a long, n_c long, n_g long, n_t long")
    assert sorted((r.p, r.allele1, r.allele2) for r in pileup.het_sites(pile).collect()) == [(1, "A", "C"), (4, "G", "C"), (5, "A", "T")]
    each = spark.createDataFrame([("r", "c", 1, "A"), ("r", "c", 4, "C"), ("s", "c", 1, "G"), ("s", "c", 4, "N"), ("t", "c", 1, "A")], "name string, chrom string, p long, base string")
    sites = spark.createDataFrame([("c", 1, "A", "C"), ("c", 4, "G", "C")], "chrom string, p long, target string, other string")
    assert sorted((r.name, r.side) for r in pileup.read_votes(each, sites).collect()) == [("r", "tie"), ("t", "target")]
    assert sorted((r.name, r.side) for r in pileup.read_votes(each, sites, "any").collect()) == [("r", "tie"), ("s", "other"), ("t", "target")]


# --- haplotypes

EVENT = "event_id long, sv_type string, chrom string, start long, end long, chrom_b string, bp_b long, inverted boolean, ins_seq string, ins_len long, ref_allele string, alt_allele string, gene string, allele_fraction double"


def event(i, kind, s, e, **more):
    base = {"chrom_b": None, "bp_b": None, "inverted": None, "ins_seq": None, "ins_len": None, "ref_allele": None, "alt_allele": None, "gene": "g", "allele_fraction": None} | more
    return (i, kind, "chr1", s, e, *base.values())


@pytest.fixture(scope="module")
def reference(spark):
    r = random.Random(7)
    whole = {c: "".join(r.choice("ACGT") for _ in range(6000)) for c in ("chr1", "chr2")}
    rows = [(c, k, s[32 * k : 32 * k + 32]) for c, s in whole.items() for k in range((len(s) + 31) // 32)]
    return whole, spark.createDataFrame(rows, "chrom string, chunk_id long, seq string").cache()


def turned(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_haplotypes(spark, reference):
    whole, chunks = reference
    g, h = whole["chr1"], whole["chr2"]
    events = [event(1, "DEL", 3000, 3500), event(2, "DUP", 1000, 2000), event(3, "INV", 3000, 3300), event(4, "INS", 3000, 3000, ins_seq="ACGTACGT"), event(5, "BND", 3000, 3000, chrom_b="chr2", bp_b=1000, inverted=True), event(6, "SNP", 3000, 3002, ref_allele=g[3000:3002], alt_allele="T"), event(7, "DEL", 5000, 5500)]
    segs = haplotype.with_sequences(haplotype.segments(spark.createDataFrame(events, EVENT), flank=500), chunks)
    got = {r.event_id: r for r in haplotype.haplotypes(segs).collect()}
    assert got[1].sequence == g[2500:3000] + g[3500:4000] and got[1].breakpoints == [500]
    assert got[2].sequence == g[500:1000] + g[1000:2000] * 2 + g[2000:2500] and got[2].breakpoints == [500, 1500, 2500] and got[2].total_len == 3000
    assert got[3].sequence == g[2500:3000] + turned(g[3000:3300]) + g[3300:3800]
    assert got[4].sequence == g[2500:3000] + "ACGTACGT" + g[3000:3500] and got[4].ref_len == 1000
    assert got[5].sequence == g[2500:3000] + turned(h[1000:1500])
    assert got[6].sequence == g[2500:3000] + "T" + g[3002:3502] and got[6].ref_len == 1000
    assert got[7].sequence == g[4500:5000] + g[5500:6000] and got[7].ref_len == 1000
    pts = spark.createDataFrame([(2, 500), (2, 1500), (3, 500), (4, 503), (5, 500), (2, 3000)], "event_id long, hap_pos long")
    at = {(r.event_id, r.hap_pos): (r.ref_chrom, r.ref_pos) for r in haplotype.to_reference(pts, segs).collect()}
    assert at == {(2, 500): ("chr1", 1000), (2, 1500): ("chr1", 1000), (3, 500): ("chr1", 3299), (4, 503): (None, None), (5, 500): ("chr2", 1499), (2, 3000): (None, None)}
    junction = haplotype.haplotypes(haplotype.with_sequences(haplotype.segments(spark.createDataFrame(events[1:2], EVENT), "junction", 500), chunks)).first()
    assert junction.sequence == g[1500:2000] + g[1000:1500]


def test_variants_on_both_strands(spark, reference):
    whole, chunks = reference
    segs = haplotype.with_sequences(haplotype.segments(spark.createDataFrame([event(3, "INV", 3000, 3300)], EVENT), flank=500), chunks)
    v = spark.createDataFrame([("chr1", 2600, "A"), ("chr1", 3010, "A")], "chrom string, p long, allele string")
    got = haplotype.haplotypes(haplotype.applied(segs, v)).first().sequence
    g = whole["chr1"]
    assert got[100] == "A" and got[500 + 289] == "T" and len(got) == 1300 and got[:100] == g[2500:2600]


# --- simulation


@pytest.mark.parametrize("args, expected", [((30, 0.5, 400, 4000, 4000, 1, False), 150), ((30, 0.5, 400, 4500, 4000, 2, False), 150), ((30, 0.5, 400, 9000, 9000, 2, False), 338), ((30, 0.5, 400, 4000, 4000, 1, True), 30), ((0.1, 0.1, 400, 100, 100, 1, False), 2), ((30, 0.5, 400, 0, 0, 0, False), 0)])
def test_tile_counts(spark, args, expected):
    cov, vaf, frag, total, ref, n, near = args
    assert spark.range(1).select(simulate.tile_count(F.lit(float(cov)), F.lit(vaf), F.lit(float(frag)), F.lit(total), F.lit(ref), F.lit(n), F.lit(near))).first()[0] == expected


def test_suppression_rates(spark):
    base = spark.range(4000).select(F.concat(F.lit("r"), "id").alias("name"), F.lit(1).cast("long").alias("event_id"))
    cols = {"sv_type": F.lit("DEL"), "vaf": F.lit(0.5), "hap_lo": F.lit(1000), "hap_hi": F.lit(5000), "sv_lo": F.lit(2000), "sv_hi": F.lit(4000)}
    rate = lambda lo, hi, side: base.withColumns(cols | {"ref_start": F.lit(lo), "ref_end": F.lit(hi), "side": F.lit(side).cast("string")}).transform(simulate.suppression).where("disposition = 'suppressed'").count() / 4000
    assert abs(rate(2100, 2500, None) - 0.5) < 0.04 and rate(0, 1000, None) == 0
    assert abs(rate(950, 1350, None) - 0.4375) < 0.04
    assert rate(2100, 2500, "target") == 1 and rate(2100, 2500, "other") == 0 and rate(2100, 2500, "tie") == 0


@pytest.mark.parametrize("new", [5000, 20000])
def test_long_insertions_get_all_their_fragments(spark, new):
    n, flank, total = 150, 2000, 4000 + new
    segs = [(0, flank, "chr1"), (flank, new, None), (flank + new, flank, "chr1")]
    haps = spark.createDataFrame([(i, total, [flank, flank + new], n, [400], False, segs) for i in range(4)], "event_id long, total_len long, breakpoints array<long>, n_tiles long, lengths array<long>, near_breakpoints boolean, segs array<struct<hap_offset:long,len:long,chrom:string>>")
    got = simulate.tiles(haps, 150).collect()
    assert all(sum(r.event_id == i for r in got) == n for i in range(4))
    for p in (x for r in got for x in (r.hap_start, r.hap_start + r.frag_len - 1)):
        assert 0 <= p < flank or flank + new <= p < total
    # without new sequence there is one draw, as before
    plain = haps.withColumn("segs", F.transform("segs", lambda s: s.withField("chrom", F.lit("chr1"))))
    u = rng.uniform(F.col("event_id"), F.concat(F.lit("42:start:"), F.col("attempt").cast("string")))
    assert simulate.tiles(plain, 150).where(F.col("hap_start") != F.floor(u * (total - 400 + 1))).count() == 0


def _placed(event, total, breakpoints, n, lengths, near, segs, seed=42):
    """tiles() for one event, attempt by attempt."""
    u = lambda what, i: int(hashlib.md5(f"{event}|{seed}:{what}:{i}".encode()).hexdigest()[:8], 16) / 2**32
    at = lambda xs, v: xs[min(int(v * len(xs)), len(xs) - 1)]
    known = lambda p: any(c and o <= p < o + m for o, m, c in segs)
    out = []
    for i in range(2 * n):
        size, near_ = at(lengths, u("len", i)), near and bool(breakpoints)
        bp = at(breakpoints, u("bp", i)) if near_ else None
        lo, hi = (max(bp - size + 1, 0), min(bp - 1, total - size)) if near_ else (0, total - size)
        if size > total or lo > hi:
            continue
        again = not near_ and any(not c for _, _, c in segs)
        for what in ["start", *[f"start{k}" for k in range(1, 11)]][: 11 if again else 1]:
            p = lo + min(int(u(what, i) * (hi - lo + 1)), hi - lo)
            if any(c and p < o + m and p + size > o for o, m, c in segs):
                if known(p) and known(p + size - 1):
                    out.append((event, i, size, p))
                break
    return out[:n]


def test_places_of_fragments_attempt_by_attempt(spark):
    lengths = [100, 200, 350]
    haps = [
        (1, 4000, [1500], simulate.ATTEMPTS + 3, lengths, False, [(0, 1500, "chr1"), (1500, 2500, "chr1")]),
        (2, 3000, [1500], 40, lengths, True, [(0, 1500, "chr1"), (1500, 1500, "chr2")]),
        (3, 3000, [500, 2500], 60, lengths, False, [(0, 500, "chr1"), (500, 2000, None), (2500, 500, "chr1")]),
        (4, 300, [120], 50, lengths, False, [(0, 120, "chr1"), (120, 180, "chr1")]),
        (5, 700, [700], 30, lengths, True, [(0, 700, "chr1"), (700, 0, "chr2")]),
        (6, 90, [40], 5, lengths, False, [(0, 40, "chr1"), (40, 50, "chr1")]),
        (7, 0, [], 0, lengths, False, []),
    ]
    df = spark.createDataFrame(haps, "event_id long, total_len long, breakpoints array<long>, n_tiles long, lengths array<long>, near_breakpoints boolean, segs array<struct<hap_offset:long,len:long,chrom:string>>")
    want = [r for h in haps for r in _placed(*h)]
    got = simulate.tiles(df, 50)
    assert sorted(map(tuple, got.collect())) == want
    counted = df.withColumn("lengths", F.transform("lengths", lambda x, i: F.struct(x.alias("len"), F.lit(1).cast("long").alias("n"), (i + 1).cast("long").alias("upto"))))
    assert sorted(map(tuple, simulate.tiles(counted, 50).collect())) == want
    # attempts that cannot fail are rows: they are not drawn in arrays, put in order or filtered
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "md5" in next(x for x in plan.splitlines() if "Project" in x and "42:len:" in x and "transform" not in x)
    assert not any("md5" in x for x in plan.splitlines() if "Filter" in x or "Generate" in x)


def test_last_of_repeated_names(spark):
    rows = [("dup", 10, 0), ("keep", 20, 1), ("dup", 90, 2)]
    got = simulate.without_repeats(spark.createDataFrame(rows, "name string, ref_start long, k long"), "k").collect()
    assert sorted((r.name, r.ref_start) for r in got) == [("dup", 90), ("keep", 20)]


def test_uniform_is_uniform_and_keyed(spark):
    u = [r[0] for r in spark.range(5000).select(rng.uniform(F.col("id"), "s")).collect()]
    assert abs(np.mean(u) - 0.5) < 0.02 and 0 <= min(u) and max(u) < 1
    assert u == [r[0] for r in spark.range(5000).repartition(7).select("id", rng.uniform(F.col("id"), "s").alias("u")).orderBy("id").select("u").collect()]


def test_quality_levels_and_draws(spark):
    rows = [("x", "AC", "I#", "AC", "I#")] * 30 + [("x", "GT", "5+", "GT", "5+")] * 5
    pairs = spark.createDataFrame(rows, "name string, seq1 string, qual1 string, seq2 string, qual2 string")
    b = quality.bins(quality.histograms(quality.observations(pairs, 2)))
    wanted = spark.createDataFrame([(1, 1, 1, 3), (1, 1, 0, 3), (1, 1, 3, 2), (1, 0, 0, None), (1, 0, 2, None), (1, 7, 0, None)], "read_num int, cycle int, base int, prev_bin int")
    got = {(r.cycle, r.base, r.prev_bin): r.level for r in quality.chosen_level(wanted, b).collect()}
    assert got == {(1, 1, 3): "markov_base", (1, 0, 3): "markov_cycle", (1, 3, 2): "cycle", (0, 0, None): "base", (0, 2, None): "cycle", (7, 0, None): "none"}
    run = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(n).cast("bigint").alias("n")) for q, n in ((10, 1), (20, 3))])
    assert [spark.range(1).select(quality.draw(run, F.lit(4), F.lit(u))).first()[0] for u in (0.0, 0.24, 0.25, 0.99)] == [10, 10, 20, 20]


def test_emission_follows_qualities():
    gen = np.random.Generator(np.random.Philox(1))
    rows = [(level, 1, c, b, p, [(10, 50)]) for c in range(40) for level, b, p in [("cycle", None, None)]]
    profile = emission.Profile(rows)
    template = "".join("ACGT"[i % 4] for i in range(60))
    errors = n = 0
    for _ in range(400):
        seq, qual = emission.emit(template, 1, 40, profile, gen)
        assert len(seq) == len(qual) == 40 and set(qual) == {chr(43)}
        errors += sum(a != b for a, b in zip(seq, template))
        n += 40
    assert abs(errors / n - 0.1) < 0.02
    short, q = emission.emit("ACG", 1, 10, emission.Profile([]), gen)
    assert short[3:] == "N" * 7 and q[3:] == "#" * 7


def test_a_whole_run(spark, reference):
    whole, chunks = reference
    r = random.Random(3)
    pairs = []
    for i in range(1500):
        s = r.randrange(0, 5500)
        e = s + r.randint(250, 400)
        f = whole["chr1"][s:e].ljust(50, "A")
        pairs.append((f"p{i}", f[:50], "I" * 50, turned(f[-50:]), "I" * 50, s, e, e - s, "chr1"))
    table = spark.createDataFrame(pairs, "name string, seq1 string, qual1 string, seq2 string, qual2 string, ref_start long, ref_end long, insert_size long, chrom string")
    events = spark.createDataFrame([event(1, "DEL", 2500, 3500), event(2, "BND", 1000, 1000, chrom_b="chr2", bp_b=1000, inverted=False)], EVENT)
    lengths = spark.createDataFrame([("chr1", 6000), ("chr2", 6000)], "chrom string, length long")
    plan.checked(events, lengths, chunks)
    with pytest.raises(plan.EventError):
        plan.checked(spark.createDataFrame([event(1, "DEL", 5000, 7000)], EVENT), lengths, chunks)
    out = plan.run(events, table, chunks, plan.Config(read_length=50, flank=1000))
    d = {(x.event_id, x.disposition): x["count"] for x in out["dispositions"].groupBy("event_id", "disposition").count().collect()}
    assert d[1, "kept"] > 0 and d[1, "suppressed"] > 0 and d[1, "chimeric"] >= 2 and (2, "suppressed") not in d
    got = out["pairs"].collect()
    assert len({x.name for x in got}) == len(got) and all(len(x.seq1) == 50 for x in got)
    with pytest.raises(ValueError):
        plan.Config(allele_fraction=0)


def made_pairs(whole, n, lo, hi, seed=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        s = r.randrange(lo, hi)
        e = s + r.randint(250, 400)
        f = whole["chr1"][s:e].ljust(50, "A")
        rows.append((f"p{i}", f[:50], "I" * 50, turned(f[-50:]), "I" * 50, s, e, e - s, "chr1"))
    return rows


PAIRS = "name string, seq1 string, qual1 string, seq2 string, qual2 string, ref_start long, ref_end long, insert_size long, chrom string"


def test_junction_duplications_get_depth_copies_with_their_alleles(spark, reference):
    whole, chunks = reference
    rows = made_pairs(whole, 1200, 500, 5000)
    table = spark.createDataFrame(rows, PAIRS)
    events = spark.createDataFrame([event(1, "DUP", 2000, 3500)], EVENT)
    votes = spark.createDataFrame([(1, r[0], "target" if i % 2 else "other") for i, r in enumerate(rows)], "event_id long, name string, side string")
    other = {"A": "C", "C": "G", "G": "T", "T": "A"}
    alleles = [(1, "chr1", p, other[whole["chr1"][p]]) for p in range(2100, 3400, 10)]
    out = plan.run(events, table, chunks, plan.Config(read_length=50, flank=1000, dup_model="junction"), votes, spark.createDataFrame(alleles, "event_id long, chrom string, p long, allele string"))
    got = out["pairs"].collect()
    copies = [r for r in got if "_dup_depth_" in r.name]
    inside = [r for i, r in enumerate(rows) if i % 2 and 2 * (min(r[6], 3500) - max(r[5], 2000)) >= r[6] - r[5]]
    assert {r.name for r in copies} == {f"ev0001_dup_depth_{r[0]}" for r in inside} and all(r.disposition == "chimeric" for r in copies)
    assert out["dispositions"].where("disposition = 'suppressed'").count() == 0
    changed = list(whole["chr1"])
    for _, _, p, b in alleles:
        changed[p] = b
    changed = "".join(changed)
    exact = sum(r.seq1 in changed for r in copies)
    assert exact >= 0.8 * len(copies) and sum(r.seq1 in whole["chr1"] for r in copies) < 0.3 * len(copies)


def test_a_run_checks_its_events(spark, reference):
    whole, chunks = reference
    table = spark.createDataFrame(made_pairs(whole, 20, 500, 5000), PAIRS)
    run = lambda rows, **more: plan.run(spark.createDataFrame(rows, EVENT), table, chunks, plan.Config(read_length=50, flank=1000, **more))
    with pytest.raises(plan.EventError, match="overlaps event 2"):
        run([event(1, "DEL", 2000, 3000), event(2, "INV", 2500, 3500)])
    with pytest.raises(plan.EventError, match="outside"):
        run([event(1, "BND", 1000, 1000, chrom_b="chr2", bp_b=9000, inverted=False)])
    with pytest.raises(plan.EventError, match="overlaps event 2"):
        run([event(1, "BND", 1000, 1000, chrom_b="chr1", bp_b=2500, inverted=False), event(2, "DEL", 2000, 3000)])
    with pytest.raises(plan.EventError, match="no events"):
        run([])
    assert run([event(1, "DEL", 2000, 3000), event(2, "INV", 2500, 3500)], allow_overlap=True)["dispositions"].count() > 0


def test_events_have_their_own_errors_and_profiles(spark):
    """Equal fragments of two events get other draws, and each event the qualities of its own pairs."""
    frags = spark.createDataFrame([(e, f"ev{e:04d}_hap_{i:06d}", "ACGT" * 20) for e in (1, 2, 3) for i in range(40)], "event_id long, name string, fragment string")
    runs = [(e, level, r, c, None, None, [(q, 20), (q + 2, 20)]) for e, q in ((1, 10), (2, 10), (3, 30)) for level in ("cycle",) for r in (1, 2) for c in range(50)]
    bins = spark.createDataFrame(runs, "event_id long, level string, read_num int, cycle int, base int, prev_bin int, run array<struct<q:int,n:long>>")
    got = {r.name: r for r in emission.emitted(frags, bins, 50).collect()}
    assert len(got) == 120
    assert all(got[f"ev0001_hap_{i:06d}"].qual1 != got[f"ev0002_hap_{i:06d}"].qual1 for i in range(40))
    assert {q for i in range(40) for q in got[f"ev0003_hap_{i:06d}"].qual2} == {"?", "A"} and {q for i in range(40) for q in got[f"ev0001_hap_{i:06d}"].qual1} == {"+", "-"}
    again = {r.name: r for r in emission.emitted(frags.repartition(7), bins.repartition(3), 50).collect()}
    assert got == again
    few = emission.emitted(frags, bins, 50).where("event_id = 1").collect()
    assert {r.name: r.seq1 for r in few} == {n: r.seq1 for n, r in got.items() if r.event_id == 1}


def test_emission_without_errors_and_with_indels():
    keys = np.arange(300, dtype=np.uint64) * np.uint64(977)
    template = b"ACGTTGCANACCGGTT" * 5
    bases, quals = emission.emit_many([template] * 300, 1, 60, emission.Profile([]), keys, errors=False)
    assert all(r.tobytes() == template[:60] for r in bases) and (quals == 20).all()
    low = emission.Profile([("cycle", 1, c, None, None, [(3, 1)]) for c in range(60)])
    plain, _ = emission.emit_many([template] * 300, 1, 60, low, keys)
    mixed, _ = emission.emit_many([template] * 300, 1, 60, low, keys, indel_rate=0.5)
    same = lambda rows, a, b: np.mean(rows[:, a:b] == np.frombuffer(template[a:b], np.uint8))
    assert abs(same(plain, 0, 8) - 0.5) < 0.06 and same(mixed, 40, 60) < same(plain, 40, 60) - 0.1
    assert (plain[:, 8] == ord("N")).all()


# --- validation


def test_allele_fractions_of_long_and_equal_alignments(spark):
    truth = spark.createDataFrame([(1, "SNP", "c", 5000, 5001, 0.5, "A", "T"), (2, "SNP", "c", 5002, 5003, 0.5, "A", "T")], "event_id long, sv_type string, chrom string, start long, end long, vaf double, ref_allele string, alt_allele string")
    reads = spark.createDataFrame([("c", 0, 50, False)], "chrom string, ref_start long, ref_end long, has_sa boolean")
    long = [(f"l{i}", 0, "c", 10, 60, cigar, 0, 0, "T" * n, "I" * n, i) for i, (cigar, n) in enumerate([("6000M", 6000), ("5S10M4900N200M", 215), ("10M4900D200M", 210)])]
    same = [("s", 0, "c", 4990, 60, "50M", 0, 0, "A" * 50, "I" * 50, 9)] * 3
    aln = spark.createDataFrame(long + same, "name string, flag int, chrom string, pos long, mapq int, cigar string, mate_pos long, tlen int, seq string, qual string, ord long")
    got = validate.run(truth, reads, aln, ["ord"]).where("check = 'allele_fraction'").collect()
    assert [(r.observed, r["pass"]) for r in got] == [("0.500", True)] * 2
    pile = pileup.counts(pileup.bases(validate.covering(aln, spark.createDataFrame([("c", 5000, 5001), ("c", 5002, 5003)], "g_chrom string, g_start long, g_end long")), ["name"]))
    assert [(r.n_a, r.n_t) for r in pile.where("p = 5000").collect()] == [(3, 3)]


def test_insert_sizes_are_counted_and_not_records(spark):
    aln = spark.range(40).select(F.when(F.col("id") % 2 == 0, 99).otherwise(147).alias("flag"), F.when(F.col("id") % 2 == 0, F.col("id") + 100).otherwise(-100).alias("tlen"), F.lit("A").alias("seq"), "id")
    assert validate.insert_size(aln, ["id"], 10).first()["mean"] == 109


def test_validation(spark):
    truth = spark.createDataFrame([(1, "DEL", "c", 10000, 11000, 0.5, None, None), (2, "SNP", "c", 500, 501, 0.5, "A", "T")], "event_id long, sv_type string, chrom string, start long, end long, vaf double, ref_allele string, alt_allele string")
    reads = spark.range(20000).select(F.lit("c").alias("chrom"), F.col("id").alias("ref_start"), (F.col("id") + 1).alias("ref_end"), (F.col("id") == 10200).alias("has_sa"))
    reads = reads.where("ref_start < 10000 or ref_start >= 11000 or ref_start % 2 = 0")
    c = validate.coverage(truth, reads).first()
    assert c["pass"] and abs(c.ratio - 0.5) < 0.01
    assert validate.split_reads(truth, reads).first().n == 1
    pile = spark.createDataFrame([("c", 500, 6, 0, 0, 4)], "chrom string, p long, n_a long, n_c long, n_g long, n_t long")
    a = validate.allele_fractions(truth, pile).first()
    assert a["pass"] and a.observed == 0.4
    assert not validate.allele_fractions(truth, pile.where("p < 0")).first()["pass"]
    assert validate.score(8, 2, 2) == {"recall": 0.8, "precision": 0.8, "f1": pytest.approx(0.8)} and validate.score(0, 0, 0)["f1"] == 0


# --- files


def test_truth_file_round_trip(spark, tmp_path):
    events = [event(1, "DEL", 100, 200, allele_fraction=0.25), event(2, "BND", 50, 50, chrom_b="chr2", bp_b=70, inverted=False), event(3, "INS", 10, 10, ins_len=5), event(4, "SNP", 20, 21, ref_allele="A", alt_allele="T", allele_fraction=0.95)]
    e = spark.createDataFrame(events, EVENT).withColumn("gene_b", F.lit("h")).withColumn("exons", F.array(F.lit("e1"), F.lit("e2")))
    rec = sinks.truth_records(e)
    got = [r.line for r in sinks.truth_lines(rec).orderBy("event_id", "part").collect()]
    assert got[0] == "chr1\t100\tsim_del_1\tN\t<DEL>\t999\tPASS\tSVTYPE=DEL;END=200;SVLEN=-100;SIM_VAF=0.250;SIM_GENE=g;SIM_EXONS=e1,e2\tGT\t0/1"
    assert got[1].split("\t")[:5] == ["chr1", "51", "sim_fus_2", "N", "N[chr2:71["] and got[2].split("\t")[4] == "]chr1:51]N" and got[4].endswith("1/1")
    path = tmp_path / "truth.vcf.gz"
    with gzip.open(path, "wt") as f:
        f.write("\n".join([*sinks.truth_header("ref.fa", "20260101"), *got]) + "\n")
    back = text.events(text.lines(spark, str(path))).orderBy("line_no").collect()
    assert [(r.sv_type, r.start, r.end) for r in back] == [("DEL", 100, 200), ("BND", 50, 50), ("INS", 10, 10), ("SNP", 20, 21)]
    assert text.truth(text.lines(spark, str(path))).count() == 4


def test_fastq_parts_match(spark, tmp_path):
    rows = [(f"n{i}", "AC", "II", "GT", "HH") for i in range(20)]
    pairs = spark.createDataFrame(rows, "name string, seq1 string, qual1 string, seq2 string, qual2 string").repartition(3)
    sinks.write_fastq(pairs, str(tmp_path / "fq"), 2)
    names = []
    for n in (1, 2):
        found = []
        for p in sorted((tmp_path / "fq" / f"R{n}").glob("*.gz")):
            found.append([x[1:].split("/")[0] for x in gzip.open(p, "rt").read().split("\n") if x.startswith("@n")])
        names.append(found)
    assert names[0] == names[1] and sum(map(len, names[0])) == 20


def test_fastq_parts_as_they_come_and_read_again(spark, tmp_path):
    """The join by name is the only shuffle of writing, reading has none; what is out of step is an error."""
    rows = [(f"n{i}/1" if i % 3 else f"n {i}", "AC" * (i % 5), "@+" * (i % 5), "GT", "H/") for i in range(30_000)]
    pairs = spark.createDataFrame(rows, "name string, seq1 string, qual1 string, seq2 string, qual2 string")
    sinks.write_fastq(pairs.repartition(3), str(tmp_path / "fq"))
    back = sinks.read_fastq(spark, str(tmp_path / "fq"))
    assert len(list((tmp_path / "fq" / "R1").glob("*.gz"))) == 3 == back.rdd.getNumPartitions()
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    assert "Exchange" not in back._jdf.queryExecution().executedPlan().toString()

    def written(n, *lines):
        w = bgzf.Writer(open(tmp_path / "fq" / f"R{n}" / "part-00000.fastq.gz", "wb"))
        w.write("".join(f"{x}\n" for x in lines).encode())
        w.close()

    written(1, "@a/1 x", "AC", "+", "II", "@b", "A", "+b", "I")
    for second, match in ((("@a/1 x", "AC", "+", "II", "@c/2", "A", "+", "I"), "differ"), (("@a/1 x", "AC", "+", "II"), "without mates"), (("@a/1 x", "AC", "+", "II", "@b", "A", "+"), "cut"), (("@a/1 x", "AC", "-", "II", "@b", "A", "+", "I"), "not a FASTQ")):
        written(2, *second)
        with pytest.raises(Exception, match=match):
            sinks.read_fastq(spark, str(tmp_path / "fq")).collect()
    (tmp_path / "fq" / "R2" / "part-00001.fastq.gz").unlink()
    with pytest.raises(Exception, match="different parts"):
        sinks.read_fastq(spark, str(tmp_path / "fq")).collect()


def test_bed_and_scripts(spark):
    bad = spark.createDataFrame([(0, "chr1\t5\t9")], "line_no long, line string")
    with pytest.raises(Exception, match="fewer than 4"):
        text.exons(bad).collect()
    assert "bwa-mem2 mem -t 4 'r f.fa' a b" in sinks.align_script("bwa-mem2", "r f.fa", "a", "b", "o.bam")
    assert "view" in sinks.merge_script("b.bam", "r.bed", "a.bam", "o.bam")


def bam_bytes(names, records):
    def rec(name, flag, chrom, pos, seq, sa):
        raw = name.encode() + b"\0"
        code = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0] * (len(seq) % 2)
        tags = b"NMC\x01" + (b"SAZ" + sa.encode() + b"\0" if sa else b"")
        body = struct.pack("<iiBBHHHiiii", chrom, pos, len(raw), 60, 0, 1, flag, len(seq), chrom, pos + 100, 150) + raw + struct.pack("<I", len(seq) << 4) + bytes(code[i] << 4 | code[i + 1] for i in range(0, len(code), 2)) + bytes([30] * len(seq)) + tags
        return struct.pack("<i", len(body)) + body

    head = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", len(names)) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", 1000000) for n in names)
    data = head + b"".join(rec(*r) for r in records)
    out = b""
    for i in range(0, len(data), 3000):
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        part = c.compress(data[i : i + 3000]) + c.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(part) + 25) + part + struct.pack("<II", zlib.crc32(data[i : i + 3000]), len(data[i : i + 3000]))
    return out + bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


@pytest.mark.parametrize("size", [1 << 20, 4000, 700])
def test_bam(spark, tmp_path, size):
    records = [(f"read{i}", 99 if i % 2 else 147, i % 2, 50 * i, "ACGTN"[: 1 + i % 5] * 7, "chr2,1,+,5M,1,0;" if i % 3 == 0 else None) for i in range(600)]
    path = tmp_path / "x.bam"
    path.write_bytes(bam_bytes(["chr1", "chr2"], records))
    spark.dataSource.register(bam.Bam)
    got = spark.read.format("bam").option("rangebytes", str(size)).load(str(path)).collect()
    assert sorted((r.name, r.flag, r.chrom, r.pos, r.seq, r.sa) for r in got) == sorted((n, f, ["chr1", "chr2"][c], p, s, sa) for n, f, c, p, s, sa in records)
    assert got[0].cigar == f"{len(got[0].seq)}M" and set(got[0].qual) == {"?"}


# --- whole runs over files


def sam_lines(whole, n, lo, hi, gone=None):
    r = random.Random(11)
    out = ["@HD\tVN:1.6"]
    for i in range(n):
        s = r.randrange(lo, hi)
        e = s + r.randint(250, 400)
        if gone and s < gone[1] and gone[0] < e and i % 2:
            continue
        a, b = whole["chr1"][s : s + 50], whole["chr1"][e - 50 : e]
        out.append(f"p{i}\t99\tchr1\t{s + 1}\t60\t50M\t=\t{e - 49}\t{e - s}\t{a}\t{'I' * 50}")
        out.append(f"p{i}\t147\tchr1\t{e - 49}\t60\t50M\t=\t{s + 1}\t{s - e}\t{b}\t{'I' * 50}" + ("\tSA:Z:chr1,1,+,5M,1,0;" if i % 40 == 0 else ""))
    return "\n".join(out) + "\n"


def test_simulate_and_validate_files(spark, reference, tmp_path, capsys):
    from helixframe import app

    whole, _ = reference
    (tmp_path / "in.sam").write_text(sam_lines(whole, 1500, 100, 5500))
    (tmp_path / "ref.fa").write_text("".join(f">{c} made up\n" + "".join(s[i : i + 70].lower() + "\n" for i in range(0, len(s), 70)) for c, s in whole.items()))
    (tmp_path / "in.vcf").write_text("##fileformat=VCFv4.3\nchr1\t4000\tx\tN\t<INV>\t50\tPASS\tSVTYPE=INV;END=4400;SIM_VAF=0.4\n")
    out = tmp_path / "out"
    args = ["simulate", "--bam", str(tmp_path / "in.sam"), "--reference", str(tmp_path / "ref.fa"), "--event", "del:chr1:2000-3000;af=het", "--vcf", str(tmp_path / "in.vcf"), "--output", str(out), "--flank", "800", "--partitions", "2"]
    assert app.main(args, spark) == 0
    truth = [x.split("\t") for x in (out / "truth.vcf").read_text().splitlines() if not x.startswith("#")]
    assert [(r[0], r[1], r[4]) for r in truth] == [("chr1", "2000", "<DEL>"), ("chr1", "4000", "<INV>")]
    assert 0.2 < float(truth[0][7].split("SIM_VAF=")[1].split(";")[0]) < 0.8
    names = {n: [x for x in spark.read.text(str(out / n)).collect() if x[0].startswith("@")] for n in ("R1", "R2")}
    assert len(names["R1"]) == len(names["R2"]) > 300 and any("ev0001_hap_" in x[0] for x in names["R1"])
    log = (out / "README.md").read_text()
    assert "| 1 | DEL chr1:2000-3000" in log and f"{len(names['R1'])} read pairs" in log
    assert (out / "events.bed").read_text().splitlines()[0] == "chr1\t1200\t3800" and "sim.bam" in (out / "align.sh").read_text()
    assert app.main([*args[:5], "--event", "del:chr1:5000-9000", "--output", str(out)], spark) == 1
    assert app.main(["simulate", "--bam", "x.cram", "--reference", "r", "--event", "del:chr1:1-5", "--output", "o"], spark) == 1
    assert "samtools view" in capsys.readouterr().err

    (tmp_path / "sim.sam").write_text(sam_lines(whole, 3000, 100, 5500, gone=(2000, 3000)))
    (tmp_path / "truth.vcf").write_text("\n".join("\t".join(r) for r in truth[:1]) + "\n")
    check = ["validate", "--bam", str(tmp_path / "sim.sam"), "--truth", str(tmp_path / "truth.vcf"), "--flank", "1000", "--json"]
    assert app.main(check, spark) == 0
    assert len(capsys.readouterr().out.splitlines()) == 5
    (tmp_path / "plain.sam").write_text(sam_lines(whole, 3000, 100, 5500))
    assert app.main([*check[:2], str(tmp_path / "plain.sam"), *check[3:]], spark) == 1


def test_fasta_of_many_stretches(spark, tmp_path):
    r = random.Random(2)
    whole = {f"c{i}": "".join(r.choice("ACGTN") for _ in range(n)) for i, n in enumerate((500, 0, 3, 97, 1200))}
    for name, keys in (("a.fa", ["c0", "c1", "c2"]), ("b.fa", ["c3", "c4"])):
        (tmp_path / name).write_text("".join(f">{c} x\n" + "".join(whole[c][i : i + 60] + "\n\n" for i in range(0, len(whole[c]), 60)) for c in keys))
    lines = text.lines(spark, str(tmp_path / "*.fa"))
    for width in (50, 300, 1 << 20):
        got = {}
        for x in sorted(text.fasta_chunks(lines, width=width).collect(), key=lambda x: x.chunk_id):
            got[x.chrom] = got.get(x.chrom, "") + x.seq
        assert got == {c: s for c, s in whole.items() if s}


def test_lines_of_split_files_are_in_order(spark, tmp_path):
    body = [f"{i:06d} " + "x" * (i % 50) for i in range(20000)]
    (tmp_path / "a.txt").write_text("\n".join(body))
    (tmp_path / "b.txt").write_text("\n".join(body[:10]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        rows = text.lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name, n in (("a.txt", 20000), ("b.txt", 10)):
        own = [r for r in rows if r.file.endswith(name)]
        assert len({r.line_no for r in own}) == len(own) == n and [r.line for r in sorted(own, key=lambda r: r.line_no)] == body[:n]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merges_across_bins(spark, seed):
    r = random.Random(seed)
    rows = [(c, s, s + r.choice([1, 5, 40, 400])) for c in ("a", "b") for s in (r.randrange(0, 3000) for _ in range(60))]
    expected = []
    for c, s, e in sorted(rows):
        if expected and expected[-1][0] == c and s <= expected[-1][2]:
            expected[-1] = (c, expected[-1][1], max(e, expected[-1][2]), expected[-1][3] + 1)
        else:
            expected.append((c, s, e, 1))
    got = intervals.merged(spark.createDataFrame(rows, "chrom string, start long, end long"), width=100).select("chrom", "start", "end", "n").collect()
    assert sorted(map(tuple, got)) == expected


def test_calls_match_once_each(spark):
    truth = spark.createDataFrame([(1, "c", 1000, 2000), (2, "c", 1100, 2100), (3, "c", 9000, 9400)], "event_id long, chrom string, start long, end long")
    calls = spark.createDataFrame([(10, "c", 1010, 2010), (11, "c", 1400, 2400), (12, "c", 9000, 9900), (13, "d", 1000, 2000)], "call_id long, chrom string, start long, end long")
    got = validate.matched_calls(truth, calls).collect()
    assert [(r.event_id, r.call_id) for r in got] == [(1, 10)]
    s = validate.call_score(truth, calls).first()
    assert (s.tp, s.fp, s.fn) == (1, 3, 2) and s.recall == pytest.approx(1 / 3) and s.precision == 0.25
    assert validate.call_score(truth.limit(0), calls.limit(0)).first().f1 == 0
    with pytest.raises(validate.NoChecks):
        validate.passed(spark.createDataFrame([], "event string, pass boolean"))


@pytest.mark.parametrize("seed", [1, 2])
def test_all_calls_are_matched_in_rounds(spark, seed):
    """Equal to taking all pairs in order of distance, each if both sides are free."""
    r = random.Random(seed)
    make = lambda n: [(i, r.choice("cd"), s, s + 1000 + r.randint(0, 60) * 10) for i in range(n) for s in [r.randrange(0, 4000, 10)]]
    t, c = make(60), [*make(50), (50, "c", 0, 1000)]
    pairs = [(abs(x[2] - y[2]) + abs(x[3] - y[3]), x[0], y[0]) for x, y in itertools.product(t, c) if x[1] == y[1] and abs(x[2] - y[2]) <= 500 and abs(x[3] - y[3]) <= 500 and min(x[3] - x[2], y[3] - y[2]) * 2 >= max(x[3] - x[2], y[3] - y[2])]
    used, expected = (set(), set()), []
    for _, a, b in sorted(pairs):
        if a not in used[0] and b not in used[1]:
            expected.append((a, b))
            used[0].add(a)
            used[1].add(b)
    truth, calls = spark.createDataFrame(t, "event_id long, chrom string, start long, end long"), spark.createDataFrame(c, "call_id long, chrom string, start long, end long")
    got = validate.matched_calls(truth, calls, rounds=None).collect()
    assert sorted((x.event_id, x.call_id) for x in got) == sorted(expected) and validate.matched_calls(truth, calls).count() < len(got)
    assert validate.call_score(truth, calls, rounds=None).first().tp == len(expected)
    small = spark.createDataFrame([(1, "c", 100, 1100), (2, "c", 150, 1150)], truth.schema), spark.createDataFrame([(1, "c", 110, 1110), (2, "c", 400, 1400)], calls.schema)
    assert sorted((x.event_id, x.call_id) for x in validate.matched_calls(*small, rounds=None).collect()) == [(1, 1), (2, 2)]
    assert validate.matched_calls(truth.limit(0), calls, rounds=None).count() == 0


def test_a_failing_check_leaves_the_others(spark):
    good = lambda n: lambda: spark.createDataFrame([("e", n, "x", "y", True)], "event string, check string, expected string, observed string, pass boolean")
    bad = lambda: good("b")().withColumn("observed", F.raise_error(F.lit("no such file")).cast("string"))
    with pytest.warns(UserWarning, match="b could not be checked"):
        rows, errors = validate.run_each({"a": good("a"), "b": bad, "c": good("c"), "d": lambda: good("d")().select("nothing")})
    assert sorted(r.check for r in rows.collect()) == ["a", "c"] and sorted(errors) == ["b", "d"] and "no such file" in errors["b"]
    with pytest.raises(validate.NoChecks, match="all 1 checks failed"), pytest.warns(UserWarning):
        validate.run_each({"b": bad})
    with pytest.raises(validate.NoChecks):
        validate.run_each({})


def test_slices_over_gaps_blocks_and_repeats(spark):
    bases = "".join("ACGT"[(i * i + i // 7) % 4] for i in range(32 * 200))
    rows = [("chr1", k, bases[32 * k : 32 * k + (20 if k == 199 else 32)]) for k in range(200) if k not in (3, 64, 70)]
    whole = {c: s for _, c, s in rows}
    chunks = spark.createDataFrame(rows, "chrom string, chunk_id long, seq string")
    spans = [(0, 10), (90, 130), (2000, 4100), (2040, 2060), (6300, 9000), (50, 50), (60, 40), (7000, 7100), (0, 6400), (2000, 4100)]
    wanted = spark.createDataFrame([(i % 9, "chr1", a, b) for i, (a, b) in enumerate(spans)], "id long, chrom string, ref_start long, ref_end long")
    expected = sorted((i % 9, "".join(whole.get(k, "")[max(a - 32 * k, 0) : max(b - 32 * k, 0)] for k in range(a // 32, max((b - 1) // 32, 0) + 1) if b > a)) for i, (a, b) in enumerate(spans))
    assert sorted((r.id, r.sequence) for r in haplotype.reference_slices(wanted, chunks).collect()) == expected
    twice = wanted.where("id = 2").unionByName(wanted.where("id = 2"))
    assert [len(r.sequence) for r in haplotype.reference_slices(twice, chunks).collect()] == [len(expected[3][1])] * 2
    events = [event(1, "DEL", 2100, 2600), event(2, "INS", 90, 90, ins_seq="ACGTAC"), event(3, "INV", 3000, 6500), event(4, "DUP", 60, 4000)]
    segs = haplotype.segments(spark.createDataFrame(events, EVENT), flank=500)
    place = lambda df: sorted((r.event_id, r.seg, r.len, r.hap_offset) for r in df.collect())
    assert place(haplotype.with_lengths(segs, chunks)) == place(haplotype.with_sequences(segs, chunks))


def test_haplotypes_are_not_broadcast(spark):
    """Few rows by the planner's estimate, but with all their bases."""
    chunks = spark.range(200).selectExpr("'chr1' chrom", "id chunk_id", "repeat('ACGT', 8) seq")
    own = zip(EVENT.split(", "), event(1, "DEL", 2100, 2600))
    events = spark.range(1).select(*[F.lit(x).cast(kind.split(" ")[1]).alias(kind.split(" ")[0]) for kind, x in own])
    segs = haplotype.with_sequences(haplotype.segments(events), chunks)
    points = haplotype.haplotypes(segs).select("event_id", F.lit(0).cast("long").alias("hap_pos"))
    assert "BroadcastHashJoin" not in haplotype.to_reference(points, segs)._jdf.queryExecution().executedPlan().toString()


def test_rescued_mates_meet_regions_by_bins(spark):
    """A chromosome's reads are not all compared with all of its regions."""
    rows = [("a", 67, "chr1", 1000, 300, 1), ("a", 131, "chr1", 1250, -300, 1), ("b", 67, "chr1", 1100, 700, 1), ("b", 131, "chr1", 1750, -700, 1), ("c", 67, "chr1", 1499, 2000, 1), ("c", 131, "chr1", 3449, -2000, 1), ("d", 67, "chr1", 1500, 300, 1)]
    aln = spark.createDataFrame(rows, "name string, flag int, chrom string, pos long, tlen int, ord long")
    region = spark.createDataFrame([(1, "chr1", 1000, 1500), (2, "chr1", 1100, 1100)], "event_id long, g_chrom string, g_start long, g_end long")
    got = pool.rescued(aln, region, ["ord"])
    assert sorted(map(tuple, got.collect())) == [(1, "b", 1750), (1, "c", 3449)]
    assert "__bin" in got._jdf.queryExecution().executedPlan().toString()


def test_many_regions_are_not_broadcast(spark, monkeypatch):
    reads = spark.range(300).selectExpr("'chr1' chrom", "id * 37 ref_start", "id * 37 + 100 ref_end")
    regions = spark.range(50).selectExpr("id event_id", "'chr1' g_chrom", "id * 210 g_start", "id * 210 + 40000 * (id % 2) + 50 g_end")
    join = lambda: intervals.overlap_join(reads, regions, ("chrom", "ref_start", "ref_end"), ("g_chrom", "g_start", "g_end"))
    expected = sorted((37 * i, k) for i in range(300) for k in range(50) if 37 * i < 210 * k + 40000 * (k % 2) + 50 and 210 * k < 37 * i + 100)
    assert sorted((r.ref_start, r.event_id) for r in join().collect()) == expected
    monkeypatch.setattr(intervals, "FEW", 49)
    assert "Broadcast" not in join()._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.ref_start, r.event_id) for r in join().collect()) == expected
