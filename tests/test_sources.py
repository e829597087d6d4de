"""Indexed and split files: BAM, block-gzip text, FASTA; made by the tests, read in parts."""

import gzip
import io
import json
import os
import random
import struct

import numpy as np
import pytest
from helixframe.sources import bam, bgzf
from pyspark.sql import functions as F

CHROMS = [("chr1", 3_000_000), ("chr2", 200_000), ("chrEmpty", 1000)]
FIELDS = [c.strip().split(" ")[0] for c in bam.SCHEMA.split(",")]


def made_alignments(n=24000, seed=2):
    r, out = random.Random(seed), []
    for i in range(n):
        chrom, size = CHROMS[r.random() < 0.3]
        seq = "".join(r.choice("ACGTN") for _ in range(r.randint(0, 60)))
        cigar = r.choice([f"{len(seq)}M", f"3S{max(len(seq) - 3, 1)}M", "10M5000N20M", "5=1X10M2D3M", "1M100000N1M"]) if seq else None
        qual = "".join(chr(33 + r.randint(10, 60)) for _ in seq) if r.random() < 0.9 else ""
        out.append((f"read{i // 2}", r.choice([99, 147, 83, 163, 1123, 355]), chrom, r.randrange(size), r.randint(0, 60), cigar, r.randrange(size), r.randint(-500, 500), seq, qual, "chr2,1,+,5M,1,0;" if i % 9 == 0 else None))
    return out + [(f"lost{i}", 77, None, None, 0, None, None, 0, "ACGT", "IIII", None) for i in range(40)]


@pytest.fixture(scope="module")
def alignments(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bam") / "out")
    rows = made_alignments()
    bam.write(spark.createDataFrame(rows, bam.SCHEMA).repartition(5), path, CHROMS, 3)
    return path, [tuple(-1 if x is None and FIELDS[i] in ("pos", "mate_pos") else x for i, x in enumerate(row)) for row in rows]


def end_of(row):
    n = sum(int(k) for k, op in __import__("re").findall(r"(\d+)([MIDNSHP=X])", row[5] or "") if op in "MDN=X")
    return row[3] + max(1, n)


def test_written_and_read_again(spark, alignments):
    path, rows = alignments
    assert sorted(n for n in os.listdir(path) if n[0] not in "._") == sorted(f"part-{i:05d}.bam{e}" for i in range(3) for e in ("", ".bai"))
    for size in (1 << 26, 9000):
        got = bam.read(spark, path).collect() if size > 1 << 20 else spark.read.format("bam").option("rangebytes", size).load(path).collect()
        assert sorted(map(tuple, got), key=str) == sorted(rows, key=str)
    rank = {c: i for i, (c, _) in enumerate(CHROMS)}
    order = bam.read(spark, path, ["chrom", "pos", "name", "flag", "file", "voffset", "end_pos"]).orderBy("file", "voffset").collect()
    key = lambda r: (rank.get(r[0], 9), r[1], r[2], r[3])
    assert [tuple(r[:4]) for r in order] == sorted([(r[2], r[3], r[0], r[1]) for r in rows], key=key)
    assert sorted(r.end_pos for r in order) == sorted(map(end_of, rows))


@pytest.mark.parametrize("regions", [[("chr1", 1_000_000, 1_040_000)], [("chr2", 5, 6), ("chr1", 2_900_000, 3_000_000), ("chr1", 2_950_000, 9_000_000)], [("chrEmpty", 0, 1000)], [("chrX", 0, 10)], [], [("chr1", 0, 1 << 29)], [("chr1", 500, 500)]])
def test_regions(spark, alignments, regions):
    path, rows = alignments
    got = bam.read(spark, path, regions=regions).collect()
    expected = [r for r in rows if any(r[2] == c and r[3] < e and s < end_of(r) and s < e for c, s, e in regions)]
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


class Counting(io.FileIO):
    read_bytes = 0

    def read(self, n=-1):
        data = super().read(n)
        Counting.read_bytes += len(data)
        return data


def test_a_region_reads_only_its_chunks(alignments, monkeypatch, tmp_path):
    path, rows = alignments
    one = bgzf.files(path, ".bam")[0]
    total = os.path.getsize(one)
    met = []
    inner = bgzf.blocks
    monkeypatch.setattr(bgzf, "blocks", lambda f, a, b: (met.append(x[0]) or x for x in inner(f, a, b)))

    def blocks_of(regions, size=1 << 26):
        reader = bam.BamReader(one, size, ["name"], bam.Conditions(regions))
        parts = reader.partitions()
        met.clear()
        n = sum(b.num_rows for p in parts for b in reader.read(p))
        return len(parts), len(met), n

    _, everything, n = blocks_of(None)
    assert n > 5000 and everything > 12
    _, few, n = blocks_of([("chr1", 1000, 3000)])
    assert 0 < few <= everything // 3 and n == sum(r[2] == "chr1" and r[3] < 3000 and end_of(r) > 1000 for r in rows)
    parts, _, n = blocks_of([("chr1", 0, 3_000_000)], 1 << 15)
    assert parts > 1 and n == blocks_of([("chr1", 0, 3_000_000)])[2] and total > 1 << 15


def test_conditions_in_the_source(spark, alignments):
    path, rows = alignments
    got = bam.read(spark, path, mapq=20, flags=2 | 64, no_flags=1024 | 256)
    good = lambda r: r[4] >= 20 and r[1] & 66 == 66 and not r[1] & 1280
    assert sorted(map(tuple, got.collect()), key=str) == sorted(filter(good, rows), key=str)
    got = bam.read(spark, path, ["flag", "name"], [("chr1", 5000, 900_000)], 30)
    assert sorted(map(tuple, got.collect())) == sorted((r[1], r[0]) for r in rows if r[4] >= 30 and r[2] == "chr1" and r[3] < 900_000 and end_of(r) > 5000)
    df = bam.read(spark, path)  # one relation asked twice
    assert df.where("chrom = 'chr2'").count() < df.count() == len(rows)


def test_head_stops_early(spark, alignments, monkeypatch):
    path, rows = alignments
    rank = {c: i for i, (c, _) in enumerate(CHROMS)}
    ordered = sorted(rows, key=lambda r: (rank.get(r[2], 9), r[3], r[0], r[1]))
    for n, condition, holds in ((10, None, lambda r: True), (700, "pos % 3 = 0", lambda r: r[3] >= 0 and r[3] % 3 == 0), (10**6, F.col("flag") == 99, lambda r: r[1] == 99)):
        got = bam.head(spark, path, n, condition, ["chrom", "pos", "name", "flag"], first=20_000)
        assert [tuple(r) for r in got.collect()] == [(r[2], r[3], r[0], r[1]) for r in ordered if holds(r)][:n]
    got = bam.head(spark, path, 500, columns=["pos", "name"], first=20_000, no_flags=1024, mapq=7).collect()
    assert [tuple(r) for r in got] == [(r[3], r[0]) for r in ordered if not r[1] & 1024 and r[4] >= 7][:500]
    spans = []
    inner = bam.BamReader.partitions
    monkeypatch.setattr(bam.BamReader, "partitions", lambda self: spans.append(self.span) or inner(self))
    reader = bam.BamReader(path, 10_000, ["name"], bam.Conditions(), 20_000)
    assert sum(p.end - (p.start << 16) for p in reader.partitions()) <= 20_000 << 16


def test_rows_out_of_order_or_a_failed_task_leave_nothing(spark, tmp_path):
    rows = made_alignments(50)
    df = spark.createDataFrame(rows, bam.SCHEMA).coalesce(1)
    bam._reader(spark, None)
    path = str(tmp_path / "wrong")
    with pytest.raises(Exception, match="not in order"):
        df.write.format("bam").option("chroms", json.dumps(CHROMS)).mode("append").save(path)
    assert not os.path.exists(path) or os.listdir(path) == []
    bam.write(df, path, CHROMS, 1)
    with pytest.raises(Exception, match="FileExists|wrong"):
        bam.write(df, path, CHROMS, 1)
    bam.write(df.limit(3), path, CHROMS, 1, mode="overwrite")
    assert bam.read(spark, path).count() == 3
    bam.write(df.limit(0), str(tmp_path / "none"), CHROMS, 1)
    assert bam.read(spark, str(tmp_path / "none")).count() == 0


def test_simulation_by_the_index_is_that_of_all_alignments(spark, tmp_path):
    from helixframe import app

    r = random.Random(5)
    whole = "".join(r.choice("ACGT") for _ in range(60_000))
    (tmp_path / "ref.fa").write_text(">chr1\n" + "\n".join(whole[i : i + 70] for i in range(0, len(whole), 70)) + "\n")
    rows = []
    for i in range(3000):
        s = r.randrange(100, 59_000)
        e = s + r.randint(250, 400)
        for flag, p, m, t in ((99, s, e - 50, e - s), (147, e - 50, s, s - e)):
            rows.append((f"p{i}", flag, "chr1", p, 60, "50M", m, t, whole[p : p + 50], "I" * 50, None))
    df = spark.createDataFrame(rows, bam.SCHEMA)
    bam.write(df, str(tmp_path / "parts"), [("chr1", 60_000)], 1)
    folder = tmp_path / "parts"
    for name in ("part-00000.bam", "part-00000.bam.bai"):
        os.rename(folder / name, tmp_path / name.replace("part-00000", "in"))
    sam = [f"{n}\t{f}\t{c}\t{p + 1}\t{q}\t{g}\t=\t{m + 1}\t{t}\t{s}\t{u}" for n, f, c, p, q, g, m, t, s, u, _ in sorted(rows, key=lambda x: (x[3], x[0], x[1]))]
    (tmp_path / "in.sam").write_text("@HD\tVN:1.6\n" + "\n".join(sam) + "\n")
    out = {}
    for kind in ("sam", "bam"):
        at = tmp_path / kind
        args = ["simulate", "--bam", str(tmp_path / f"in.{kind}"), "--reference", str(tmp_path / "ref.fa"), "--event", "del:chr1:20000-21000;af=0.5", "--event", "dup:chr1:40000-41500", "--output", str(at), "--flank", "2000", "--partitions", "2"]
        assert app.main(args, spark) == 0
        out[kind] = sorted(line for k in ("R1", "R2") for f in sorted((at / k).glob("*.gz")) for line in gzip.open(f, "rt"))
    assert out["bam"] == out["sam"] and len(out["sam"]) > 1000


def test_results_are_merged_record_by_record(spark, tmp_path, capsys):
    from helixframe import app

    rows = [("a", 99, "chr1", 100, 60, "50M", 400, 350, "A" * 50, "I" * 50, None), ("a", 147, "chr1", 400, 60, "50M", 100, -350, "C" * 50, "I" * 50, None), ("b", 99, "chr1", 449, 60, "10M100N40M", 900, 0, "", "", None), ("c", 0, "chr1", 450, 60, "50M", -1, 0, "G" * 50, "I" * 50, None), ("u", 77, None, None, 0, None, None, 0, "T", "I", None), ("d", 0, "chr2", 10, 60, "50M", -1, 0, "G" * 50, "I" * 50, None)]
    new = [("n", 99, "chr1", 420, 60, "50M", 430, 60, "T" * 50, "I" * 50, None), ("n", 147, "chr1", 430, 60, "50M", 420, -60, "T" * 50, "I" * 50, None)]
    for name, some in (("original.bam", rows), ("sim.bam", new)):
        bam.write(spark.createDataFrame(some, bam.SCHEMA), str(tmp_path / name), CHROMS, 2)
    (tmp_path / "events.bed").write_text("chr1\t420\t450\nchr1\t430\t440\nchr3\t0\t5\n\n")
    args = ["merge", "--bam", str(tmp_path / "original.bam"), "--aligned", str(tmp_path / "sim.bam"), "--bed", str(tmp_path / "events.bed"), "--output", str(tmp_path / "out"), "--partitions", "3"]
    assert app.main(args, spark) == 0
    got = bam.read(spark, str(tmp_path / "out"), ["name", "flag", "chrom", "pos", "file", "voffset"]).orderBy("file", "voffset").collect()
    # a's second read and b overlap the region; a's first read stays without its mate, c begins where the region ends
    assert [tuple(r[:4]) for r in got] == [("a", 99, "chr1", 100), ("n", 99, "chr1", 420), ("n", 147, "chr1", 430), ("c", 0, "chr1", 450), ("d", 0, "chr2", 10), ("u", 77, None, -1)]
    out = [x.split("\t") for x in capsys.readouterr().out.strip().split("\n")]
    assert [x[0] for x in out] == sorted(x[0] for x in out) and sum(int(x[1]) for x in out) == 6 and out[0][2] == "chr1:100" and out[-1][3] == "None:-1"
    assert app.main([*args[:2], "x.sam", *args[3:]], spark) == 1


def test_binning():
    r = random.Random(1)
    for _ in range(2000):
        s = r.randrange(1 << 29)
        e = min(1 << 29, s + r.choice([1, 100, 20_000, 10**6, 10**8]))
        a = r.randrange(1 << 29)
        b = min(1 << 29, a + r.choice([1, 1000, 10**7]))
        if s < b and a < e:
            assert bgzf.bin_of(s, e) in set(bgzf.bins_of(a, b)) and bgzf._place(bgzf.bin_of(s, e))[0] < b
    s = bgzf.Sequence()
    s.add(5, 50_000, 7 << 16, 8 << 16)
    s.add(100_000, 100_010, 8 << 16, 9 << 16)
    t, at = bgzf.unpack_index(bgzf.pack_index([s, bgzf.Sequence()]), 0, 2)
    assert t[0].bins == s.bins and t[0].chunks(100_001, 100_002) == [(8 << 16, 9 << 16)] and not t[1].chunks(0, 10)
    assert gzip.decompress(bgzf.EOF) == b"" and struct.calcsize("<iiBBHHHiiii") == np.dtype(bam._FIXED).itemsize - 4


# --- lines of block-gzip files


def blocked(data: bytes, step=997) -> bytes:
    """A block-gzip file of small blocks, which end anywhere."""
    out = io.BytesIO()
    out.close, whole = lambda: None, out
    w = bgzf.Writer(whole)
    for i in range(0, len(data), step):
        w.held += data[i : i + step]
        w._flush(len(w.held))
    w.close()
    return whole.getvalue()


@pytest.mark.parametrize("body", [[f"{i} " + "x" * (i % 90) for i in range(2000)], ["", "", "a", ""] * 300, ["y" * 20_000, "z", "w" * 5000, ""], [], ["one"], ["é日本"] * 700])
@pytest.mark.parametrize("ending", ["\n", ""])
def test_lines_of_any_ranges(spark, tmp_path, body, ending):
    from helixframe.sources import gztext

    path = tmp_path / "a.txt.gz"
    data = ("\n".join(body) + ending).encode()
    path.write_bytes(blocked(data))
    assert gzip.decompress(path.read_bytes()) == data and gztext.is_blocked(str(path))
    expected = data.decode().split("\n")
    expected = expected[:-1] if expected[-1] == "" else expected
    for size in (1 << 20, 3000, 400, 57):
        reader = gztext.LineReader(str(path), size, None)
        parts = reader.partitions()
        got = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
        assert [r["line"] for r in sorted(got, key=lambda r: r["line_no"])] == expected and len({r["line_no"] for r in got}) == len(got), size
    if len(body) == 2000:
        from helixframe.sources import text

        df = gztext.lines(spark, str(path), range_bytes=3000)
        assert df.rdd.getNumPartitions() >= 4 and [r.line for r in df.orderBy("line_no").collect()] == expected
        assert [r.line for r in text.lines(spark, str(path)).orderBy("line_no").collect()] == expected


def test_plain_gzip_is_read_as_before(spark, tmp_path):
    from helixframe.sources import gztext, text

    path = tmp_path / "b.txt.gz"
    path.write_bytes(gzip.compress(b"a\nb\n"))
    assert not gztext.is_blocked(str(path)) and not gztext.is_blocked("viewfs:///x.gz") and not gztext.is_blocked(str(tmp_path / "*.gz"))
    assert [r.line for r in text.lines(spark, str(path)).orderBy("line_no").collect()] == ["a", "b"]


def test_variants_by_tabix(spark, tmp_path, monkeypatch):
    from helixframe.sources import gztext, text

    r = random.Random(4)
    rows = []
    for i in range(30_000):
        chrom, p = r.choice(["chr1", "chr2", "chr10"]), r.randrange(3_000_000)
        ref = "ACGT"[: r.randint(1, 4)]
        info = f"SVTYPE=DEL;END={p + 1 + r.choice([50, 90_000])}" if i % 50 == 0 else "DP=3"
        rows.append((chrom, p, p + len(ref) if i % 50 else int(info[15:]), "\t".join([chrom, str(p + 1), f"v{i}", ref, r.choice("ACGT"), "9", "PASS", info, "GT", r.choice(["0/1", "1|0", "1/1"])])))
    path = str(tmp_path / "out")
    gztext.write_variants(spark.createDataFrame([(x[3],) for x in rows], "line string").repartition(5), path, 3, ["##fileformat=VCFv4.2", "#CHROM\tPOS"])
    names = sorted(n for n in os.listdir(path) if n[0] not in "._")
    assert len(names) == 6 and names[0] == "part-00000.vcf.gz" and names[1] == "part-00000.vcf.gz.tbi"
    whole = gztext.lines(spark, path)
    assert sorted(x.line for x in whole.collect() if x.line[0] != "#") == sorted(x[3] for x in rows) and whole.where("line like '#%'").count() == 6
    for regions in ([("chr1", 1_000_000, 1_020_000)], [("chr2", 0, 10), ("chr10", 2_999_000, 1 << 29)], [("chrX", 0, 9)], [("chr1", 0, 3_100_000)]):
        got = gztext.lines(spark, path, regions, 1 << 15)
        assert sorted(x.line for x in got.collect()) == sorted(x[3] for x in rows if any(x[0] == c and x[1] < e and s < x[2] for c, s, e in regions)), regions
    region = ("chr1", 1_000_000, 1_020_000)
    one = os.path.join(path, "part-00000.vcf.gz")
    het = text.het_snps(text.lines(spark, one, [region]), region)
    assert [tuple(x) for x in het.collect()] == [tuple(x) for x in text.het_snps(gztext.lines(spark, one), region).collect()]
    met, inner = [], bgzf.blocks
    monkeypatch.setattr(bgzf, "blocks", lambda f, a, b: (met.append(x[0]) or x for x in inner(f, a, b)))
    counts = []
    for regions in (None, [region]):
        reader = gztext.LineReader(one, 1 << 26, regions)
        parts = reader.partitions()
        met.clear()
        list(reader._lines(parts[0]))
        counts.append(len(met))
    assert counts[1] * 4 <= counts[0]
    with pytest.raises(Exception, match="regions need an index"):
        (tmp_path / "no.vcf.gz").write_bytes(blocked(b"chr1\t5\n"))
        gztext.lines(spark, str(tmp_path / "no.vcf.gz"), [region]).collect()


# --- FASTA by its index


def test_fasta_slices_and_chunks(spark, tmp_path, monkeypatch):
    from helixframe.sources import fasta

    r = random.Random(6)
    whole = {c: "".join(r.choice("ACGTNacgtn") for _ in range(n)) for c, n in (("chr1", 100_003), ("chr2", 61), ("chr3", 60), ("empty", 0), ("chr4", 3_300_000))}
    body, index = "", ""
    for c, s in whole.items():
        body += f">{c} made up\n"
        index += f"{c}\t{len(s)}\t{len(body)}\t60\t61\n"
        body += "".join(s[i : i + 60] + "\n" for i in range(0, len(s), 60))
    for k, name in enumerate(("a.fa.fai", "b.fasta.fai", "c.fa.fai")):
        file = tmp_path / ("a.fa", "b.fasta", "c.fasta")[k]
        file.write_text(body)
        (tmp_path / name).write_text(index)
        assert fasta.indexed(str(file)) and fasta.read_index(str(file))["chr2"].length == 61
    path = str(tmp_path / "a.fa")
    wanted = [(i, c, a, b) for i, (c, a, b) in enumerate([("chr1", 0, 10), ("chr1", 55, 130), ("chr1", 99_990, 200_000), ("chr1", -20, 5), ("chr2", 59, 61), ("chr2", 60, 70), ("chr3", 0, 60), ("chr3", 60, 80), ("empty", 0, 5), ("chr1", 7, 7), ("chr4", 1_000_000, 2_500_000)])]
    got = fasta.slices(spark.createDataFrame(wanted, "id long, chrom string, ref_start long, ref_end long").repartition(3), path).collect()
    assert {x.id: x.sequence for x in got} == {i: whole[c][max(a, 0) : max(b, 0)].upper() for i, c, a, b in wanted}
    with pytest.raises(Exception, match="chrX"):
        fasta.slices(spark.createDataFrame([("chrX", 0, 5)], "chrom string, ref_start long, ref_end long"), path).collect()
    with pytest.raises(Exception, match="no .fai"):
        (tmp_path / "d.fa").write_text(body)
        fasta.read_index(str(tmp_path / "d.fa"))
    assert not fasta.indexed(str(tmp_path / "d.fa")) and not fasta.indexed(str(tmp_path / "none.fa"))
    all_chunks = {(x.chrom, x.chunk_id): x.seq for x in fasta.chunks(spark, path).collect()}
    assert all_chunks == {(c, i // 32): s[i : i + 32].upper() for c, s in whole.items() for i in range(0, len(s), 32)}
    windows = spark.createDataFrame([("chr1", 100, 200), ("chr1", 150, 300), ("chr1", -5, 3), ("chr4", 1_048_570, 1_048_600), ("chr2", 40, 500)], "chrom string, start long, end long")
    part = {(x.chrom, x.chunk_id): x.seq for x in fasta.chunks(spark, path, windows).collect()}
    keys = {("chr1", 0), *(("chr1", i) for i in range(3, 10)), ("chr4", 32767), ("chr4", 32768), ("chr2", 1)}
    assert part == {k: all_chunks[k] for k in keys}
    with pytest.raises(Exception, match="does not have chromosome chrX"):
        fasta.chunks(spark, path, spark.createDataFrame([("chrX", 0, 5)], "chrom string, start long, end long")).collect()
    # a slice reads little more than itself
    read, inner = [], fasta.opened

    def counted(p):
        f, n = inner(p)

        class File:
            seek, close = f.seek, f.close

            def read(self, k):
                read.append(k)
                return f.read(k)

        return File(), n

    files = fasta.Files(fasta.read_index(path))
    monkeypatch.setattr(fasta, "opened", counted)
    assert files.bases("chr4", 2_000_000, 2_001_000) == whole["chr4"][2_000_000:2_001_000].upper() and sum(read) < 1030


def test_fasta_written_with_its_index(spark, tmp_path):
    from helixframe.sources import fasta

    r = random.Random(7)
    whole = {f"c{i}": "".join(r.choice("ACGT") for _ in range(n)) for i, n in enumerate((500, 60, 59, 97, 1200))}
    rows = [(c, i // 32, s[i : i + 32]) for c, s in whole.items() for i in range(0, len(s), 32)]
    fasta.write(spark.createDataFrame(rows, "chrom string, chunk_id long, seq string").repartition(4), str(tmp_path / "ref"), 3)
    got = fasta.slices(spark.createDataFrame([(c, 0, 5000) for c in whole], "chrom string, ref_start long, ref_end long"), str(tmp_path / "ref")).collect()
    assert {x.chrom: x.sequence for x in got} == whole
