"""Queries of interval, join, aggregation, window, sort and set operators."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import reads as R
from ..operators import intervals as I, pool as P, simulate as M
from ..shared import temporary
from ..sources import bam, sinks
from . import validate as V
from .registry import Registry

QUERIES = Registry()
q = QUERIES.add

_OVER = 'r.chrom = s.chrom AND r.ref_start < s."end" AND s.start < r.ref_end'
_SV_ON = ("g_chrom", "g_start", "g_end")
_USABLE = "(flag & 3844) = 0 AND mapq >= 20 AND (flag & 2) <> 0 AND (flag & 8) = 0 AND (flag & 192) <> 0"
ORDER = ["ord", "read_num"]


def regions(sv, *more):
    return sv.select("event_id", *more, F.col("chrom").alias("g_chrom"), F.col("start").alias("g_start"), F.col("end").alias("g_end"))


@q("src_bam_region", f'SELECT event_id, count(*) AS n, CAST(min(pos) AS BIGINT) AS lo, CAST(max(pos) AS BIGINT) AS hi FROM aln r JOIN sv s ON r.chrom = s.chrom AND r.pos < s."end" AND r.pos + 50 > s.start WHERE {_USABLE} GROUP BY event_id')
def _(v):
    a = P.usable(v.aln).withColumn("a_end", F.col("pos") + 50).select("chrom", "pos", "a_end")
    return I.overlap_join(a, regions(v.sv), ("chrom", "pos", "a_end"), _SV_ON).groupBy("event_id").agg(F.count("*").alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))


@q("src_bam_full", "SELECT count(*) AS n, round(avg(tlen), 6) AS m FROM (SELECT * FROM aln WHERE (flag & 2308) = 0 ORDER BY chrom, pos, name, read_num LIMIT 5000)")
def _(v):
    h = P.head(v.aln.where(R.globally_counted(F.col("flag"))), ["chrom", "pos", "name", "read_num"], 5000)
    return h.agg(F.count("*").alias("n"), F.round(F.avg("tlen"), 6).alias("m"))


_SPAN = "CASE cigar WHEN '5S45M' THEN 45 WHEN '45M5S' THEN 45 WHEN '20M2I28M' THEN 48 WHEN '48M2S' THEN 48 WHEN '20M3D30M' THEN 53 WHEN '30M1D20M' THEN 51 WHEN '25M100N25M' THEN 150 ELSE 50 END"
_CHROMS = [(f"chr{i}", 1 << 28) for i in range(1, 6)]


def _bam_of(v, name: str) -> str:
    """The alignment view as a folder of indexed BAM files."""
    path = temporary(v.spark, name)
    columns = [c.strip().split(" ")[0] for c in bam.SCHEMA.split(",")]
    bam.write(v.aln.select(*columns), path, _CHROMS, v.spark.sparkContext.defaultParallelism)
    return path


@q("src_bam_index", f"""SELECT DISTINCT name, flag, r.chrom, pos, pos + {_SPAN} AS end_pos, mapq, cigar, mate_pos, tlen, seq, qual, sa FROM aln r JOIN sv s ON r.chrom = s.chrom AND r.pos < s."end" AND r.pos + {_SPAN} > s.start
 WHERE s."end" > s.start AND gene = 'GENE7' AND mapq >= 20 AND (flag & 3844) = 0 AND (flag & 2) <> 0""")
def _(v):
    """The records near the events of one gene, from BAM files by their index; the regions of a run's events are a small list."""
    spans = [(r.chrom, r.start, r.end) for r in v.sv.where("gene = 'GENE7'").select("chrom", "start", "end").distinct().toLocalIterator()]
    columns = ["name", "flag", "chrom", "pos", "end_pos", "mapq", "cigar", "mate_pos", "tlen", "seq", "qual", "sa"]
    return bam.read(v.spark, _bam_of(v, "index"), columns, spans, mapq=20, flags=2, no_flags=3844)


@q("src_bam_head", "SELECT count(*) AS n, round(avg(tlen), 6) AS m, max(pos) AS last, CAST(sum(mapq) AS BIGINT) AS q FROM (SELECT * FROM aln WHERE (flag & 3844) = 0 ORDER BY chrom, pos, name, flag LIMIT 50000)")
def _(v):
    """The first 50,000 primary records in file order; only the files' beginnings are read."""
    h = bam.head(v.spark, _bam_of(v, "head"), 50_000, columns=["tlen", "pos", "mapq"], no_flags=3844)
    return h.agg(F.count("*").alias("n"), F.round(F.avg("tlen"), 6).alias("m"), F.max("pos").alias("last"), F.sum("mapq").alias("q"))


@q("join_overlap", f"SELECT event_id, count(*) AS n, CAST(sum(r.ref_start) AS BIGINT) AS t FROM reads r JOIN sv s ON {_OVER} GROUP BY event_id")
def _(v):
    j = I.overlap_join(v.reads.select("chrom", "ref_start", "ref_end"), regions(v.sv), ("chrom", "ref_start", "ref_end"), _SV_ON)
    return j.groupBy("event_id").agg(F.count("*").alias("n"), F.sum("ref_start").alias("t"))


@q("join_event_self", """SELECT a.event_id AS id_a, b.event_id AS id_b FROM sv a JOIN sv b ON a.event_id < b.event_id AND a.chrom = b.chrom AND a.start < greatest(b."end", b.start + 1) AND b.start < greatest(a."end", a.start + 1)""")
def _(v):
    return I.self_overlaps(v.sv)


@q("limit_errors", """SELECT a.event_id AS id_a, b.event_id AS id_b FROM sv a JOIN sv b ON a.event_id < b.event_id AND a.chrom = b.chrom AND a.start < greatest(b."end", b.start + 1) AND b.start < greatest(a."end", a.start + 1) ORDER BY 1, 2 LIMIT 10""")
def _(v):
    return I.self_overlaps(v.sv).orderBy("id_a", "id_b").limit(10)


@q("join_extract_bounds", """WITH g AS (SELECT chrom, min(start) AS lo, max("end") AS hi FROM sv WHERE sv_type = 'INS' GROUP BY chrom) SELECT event_id, s.chrom, least(greatest(start - 10000, 0), g.lo) AS lo, greatest("end" + 10000, g.hi) AS hi FROM sv s LEFT JOIN g USING (chrom)""")
def _(v):
    return I.scan_bounds(v.sv, v.sv.where("sv_type = 'INS'").select("chrom", "start", "end"), 10000)


@q("join_region_reads", """WITH g AS (SELECT event_id, chrom, greatest(start - 1000, 0) AS lo, CASE WHEN sv_type = 'BND' THEN start ELSE "end" END + 1000 AS hi FROM sv UNION ALL SELECT event_id, chrom_b, greatest(bp_b - 1000, 0), bp_b + 1000 FROM sv WHERE sv_type = 'BND')
 SELECT event_id, count(*) AS n FROM pairs r JOIN g ON r.chrom = g.chrom AND r.ref_start < g.hi AND g.lo < r.ref_end GROUP BY event_id""")
def _(v):
    from .simulate import event_pairs

    return event_pairs(v.sv, v.pairs.select("name", "chrom", "ref_start", "ref_end"), 1000).groupBy("event_id").agg(F.count("*").alias("n"))


@q("set_union_fusion", """SELECT event_id, 'a' AS side, count(*) AS n FROM pairs r JOIN sv s ON r.chrom = s.chrom AND r.ref_start < s.start + 500 AND r.ref_end > s.start - 500 WHERE sv_type = 'BND' GROUP BY event_id
 UNION ALL SELECT event_id, 'b', count(*) FROM pairs r JOIN sv s ON r.chrom = s.chrom_b AND r.ref_start < s.bp_b + 500 AND r.ref_end > s.bp_b - 500 WHERE sv_type = 'BND' GROUP BY event_id""")
def _(v):
    b = v.sv.where("sv_type = 'BND'")
    two = F.array(F.struct(F.lit("a").alias("side"), F.col("chrom").alias("g_chrom"), F.col("start").alias("p")), F.struct(F.lit("b").alias("side"), F.col("chrom_b").alias("g_chrom"), F.col("bp_b").alias("p")))
    g = b.select("event_id", F.explode(two).alias("x")).select("event_id", "x.side", "x.g_chrom", (F.col("x.p") - 500).alias("g_start"), (F.col("x.p") + 500).alias("g_end"))
    g = g.withColumn("g_start", F.col("g_start"))
    shifted = g.withColumn("g_start", F.greatest("g_start", F.lit(0)))
    return I.overlap_join(v.pairs.select("chrom", "ref_start", "ref_end"), shifted, ("chrom", "ref_start", "ref_end"), _SV_ON).groupBy("event_id", "side").agg(F.count("*").alias("n"))


@q("set_distinct_chrom", "SELECT DISTINCT c FROM (SELECT chrom AS c FROM sv UNION ALL SELECT chrom_b FROM sv WHERE chrom_b IS NOT NULL)")
def _(v):
    return v.sv.select(F.explode(F.array_compact(F.array("chrom", "chrom_b"))).alias("c")).distinct()


@q("join_mate", f"""WITH a AS (SELECT * FROM aln WHERE {_USABLE}), o AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY name, read_num ORDER BY ord DESC) = 1)
 SELECT x.name, least(x.pos, y.pos) AS ref_start, least(x.pos, y.pos) + abs(x.tlen) AS ref_end, x.seq AS seq1, translate(reverse(y.seq), 'ACGTacgt', 'TGCAtgca') AS seq2 FROM o x JOIN o y ON x.name = y.name AND x.read_num = 1 AND y.read_num = 2""")
def _(v):
    return P.paired(P.usable(v.aln), ["ord"]).select("name", "ref_start", "ref_end", "seq1", "seq2")


@q("fn_ref_end", "SELECT x.name, least(x.pos, y.pos) + abs(x.tlen) AS e FROM aln x JOIN aln y ON x.name = y.name AND x.read_num = 1 AND y.read_num = 2 QUALIFY row_number() OVER (PARTITION BY x.name ORDER BY x.ord DESC) = 1")
def _(v):
    return P.paired(v.aln, ["ord"]).select("name", F.col("ref_end").alias("e"))


@q("join_mate_rescue", """WITH i AS (SELECT s.event_id, s.chrom, s.start, s."end" AS e, a.name, a.read_num, a.tlen FROM aln a JOIN sv s ON a.chrom = s.chrom AND a.pos >= s.start AND a.pos < s."end" WHERE (a.flag & 3844) = 0 AND a.mapq >= 20 AND (a.flag & 2) <> 0),
 pad AS (SELECT event_id, greatest(max(abs(tlen)) + 200, 1000) AS pad FROM i GROUP BY event_id),
 one AS (SELECT event_id, name, min(read_num) AS have, any_value(chrom) AS chrom, any_value(start) AS start, any_value(e) AS e FROM i GROUP BY event_id, name HAVING count(DISTINCT read_num) = 1)
 SELECT event_id, m.name, min(m.pos) AS mate_pos FROM one JOIN pad USING (event_id) JOIN aln m ON m.name = one.name AND m.read_num <> one.have AND m.chrom = one.chrom AND m.pos >= one.start - pad AND m.pos < one.e + pad AND (m.flag & 3844) = 0 AND m.mapq >= 20 AND (m.flag & 2) <> 0 GROUP BY event_id, m.name""")
def _(v):
    return P.rescued(P.usable(v.aln), regions(v.sv), ["ord"])


@q("join_bed_intersect", """SELECT event_id FROM sv s WHERE EXISTS (SELECT 1 FROM exons x WHERE x.chrom = s.chrom AND x.start < s."end" AND s.start < x."end")""")
def _(v):
    from ..sources import text

    x = text.exons(v.bed).select(F.col("chrom").alias("r_chrom"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return I.overlapping(v.sv, x, "event_id").select("event_id")


@q("join_outside", """SELECT name FROM reads r WHERE NOT EXISTS (SELECT 1 FROM sv s WHERE s.sv_type = 'DEL' AND r.chrom = s.chrom AND r.ref_start < s."end" AND s.start < r.ref_end)""")
def _(v):
    d = v.sv.where("sv_type = 'DEL'").select(F.col("chrom").alias("r_chrom"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return I.overlapping(v.reads, d, "name", ("chrom", "ref_start", "ref_end"), keep=False).select("name")


@q("sink_merge", """SELECT name, 'background' AS origin FROM reads r WHERE NOT EXISTS (SELECT 1 FROM sv s WHERE s.sv_type = 'INV' AND r.chrom = s.chrom AND r.ref_start < s."end" AND s.start < r.ref_end) UNION ALL SELECT concat('new', event_id), 'aligned' FROM sv WHERE sv_type = 'INV'""")
def _(v):
    d = v.sv.where("sv_type = 'INV'")
    g = d.select(F.col("chrom").alias("r_chrom"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    kept = I.overlapping(v.reads, g, "name", ("chrom", "ref_start", "ref_end"), keep=False).select("name", F.lit("background").alias("origin"))
    return kept.unionByName(d.select(F.concat(F.lit("new"), "event_id").alias("name"), F.lit("aligned").alias("origin")))


_NEW = "SELECT concat('new', event_id) AS name, 99 AS flag, chrom, start AS pos, '50M' AS cigar FROM sv WHERE sv_type = 'INV'"


@q("sink_merge_sorted", f"""SELECT name, flag, chrom, pos, row_number() OVER (ORDER BY chrom, pos, name, flag) AS place FROM (SELECT name, flag, chrom, pos FROM aln r WHERE NOT EXISTS (SELECT 1 FROM sv s WHERE s.sv_type = 'INV' AND r.chrom = s.chrom AND r.pos < s."end" AND s.start < r.pos + {_SPAN}) UNION ALL SELECT name, flag, chrom, pos FROM ({_NEW}))""")
def _(v):
    """A result's records in one order over all parts, as they stand in its files: place counts on from part to part."""
    g = v.sv.where("sv_type = 'INV'")
    columns = [c.strip().split(" ")[0] for c in bam.SCHEMA.split(",")]
    new = g.select(F.concat(F.lit("new"), "event_id").alias("name"), F.lit(99).alias("flag"), "chrom", F.col("start").alias("pos"), F.lit(60).alias("mapq"), F.lit("50M").alias("cigar"), F.col("start").alias("mate_pos"), F.lit(0).alias("tlen"), F.lit("A" * 50).alias("seq"), F.lit("I" * 50).alias("qual"), F.lit(None).cast("string").alias("sa"))
    path = temporary(v.spark, "result")
    bam.write(sinks.merged_alignments(v.aln.select(*columns), g.select("chrom", "start", "end"), new), path, _CHROMS, v.spark.sparkContext.defaultParallelism)
    rows = bam.read(v.spark, path, ["name", "flag", "chrom", "pos", "file", "voffset"])
    before = sinks.part_bounds(rows).select("file", F.coalesce(F.sum("records").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # one row a part
    here = F.row_number().over(Window.partitionBy("file").orderBy("voffset"))
    return rows.withColumn("here", here).join(F.broadcast(before), "file").select("name", "flag", "chrom", "pos", (F.col("before") + F.col("here")).alias("place"))


@q("join_gene", """SELECT s.event_id, g.lo, g.hi FROM sv s JOIN (SELECT lower(gene) AS k, min(lo) AS lo, arg_min(hi, chrom) AS hi FROM (SELECT gene, chrom, min(start) AS lo, max("end") AS hi FROM exons GROUP BY ALL) GROUP BY 1 HAVING true) g ON lower(replace(s.gene, 'GENE', 'g')) = g.k""")
def _(v):
    from ..sources import text

    g = text.genes(text.exons(v.bed)).groupBy(F.lower("gene").alias("k")).agg(F.min("start").alias("lo"), F.min_by("end", "chrom").alias("hi"))
    return v.sv.join(g, F.lower(F.replace("gene", F.lit("GENE"), F.lit("g"))) == F.col("k")).select("event_id", "lo", "hi")


@q("join_fusion_gene", """WITH x AS (SELECT *, row_number() OVER (PARTITION BY gene, chrom ORDER BY start, line_no) AS number FROM exons), f AS (SELECT gene, min(chrom) AS chrom FROM exons GROUP BY gene), e AS (SELECT x.* FROM x JOIN f USING (gene, chrom))
 SELECT event_id, a."end" AS bp_a, b.start AS bp_b FROM sv s JOIN e a ON a.gene = concat('G', s.event_id % 25) AND a.number = 1 JOIN e b ON b.gene = concat('G', (s.event_id + 7) % 25) AND b.number = 2 WHERE sv_type = 'BND'""")
def _(v):
    from ..sources import text

    x = text.numbered_exons(text.exons(v.bed))
    first = x.groupBy("gene").agg(F.min("chrom").alias("chrom"))
    e = x.join(first, ["gene", "chrom"])
    a = e.where("number = 1").select(F.col("gene").alias("ga"), F.col("end").alias("bp_a"))
    b = e.where("number = 2").select(F.col("gene").alias("gb"), F.col("start").alias("bp_b"))
    s = v.sv.where("sv_type = 'BND'").select("event_id", F.concat(F.lit("G"), F.col("event_id") % 25).alias("ga"), F.concat(F.lit("G"), (F.col("event_id") + 7) % 25).alias("gb"))
    return s.join(a, "ga").join(b, "gb").select("event_id", "bp_a", "bp_b")


# --- aggregations

_DEPTH = 'SELECT s.event_id, s.chrom, s.start, s."end", count(r.name) AS n, CASE WHEN s."end" > s.start THEN count(r.name)::DOUBLE / (s."end" - s.start) ELSE 0 END AS depth FROM {w} s LEFT JOIN reads r ON r.chrom = s.chrom AND r.ref_start < s."end" AND s.start < r.ref_end GROUP BY s.event_id, s.chrom, s.start, s."end"'


@q("agg_depth", f"SELECT event_id, n AS n_reads, round(depth, 9) AS depth FROM ({_DEPTH.format(w='sv')})")
def _(v):
    return I.depth(v.reads, v.sv.select("event_id", "chrom", "start", "end"), ["event_id"]).select("event_id", "n_reads", F.round("depth", 9).alias("depth"))


@q("agg_sa", """SELECT s.event_id, count(r.name) AS n FROM sv s LEFT JOIN reads r ON r.has_sa AND r.chrom = s.chrom AND r.ref_start < s."end" + 500 AND greatest(s.start - 500, 0) < r.ref_end WHERE sv_type <> 'SNP' GROUP BY s.event_id""")
def _(v):
    return V.split_reads(v.sv, v.reads).select("event_id", "n")


@q("chk_split", """SELECT s.event_id, count(r.name) AS n, count(r.name) > 0 AS pass FROM sv s LEFT JOIN reads r ON r.has_sa AND r.chrom = s.chrom AND r.ref_start < s."end" + 500 AND greatest(s.start - 500, 0) < r.ref_end WHERE sv_type <> 'SNP' GROUP BY s.event_id""")
def _(v):
    return V.split_reads(v.sv, v.reads).select("event_id", "n", "pass")


_COVER = """WITH w AS (SELECT event_id, 'event' AS kind, chrom, start, "end" FROM sv WHERE sv_type IN ('DEL', 'DUP') UNION ALL SELECT event_id, 'left', chrom, greatest(start - 5000, 0), start FROM sv WHERE sv_type IN ('DEL', 'DUP') UNION ALL SELECT event_id, 'right', chrom, "end", "end" + 5000 FROM sv WHERE sv_type IN ('DEL', 'DUP')),
 d AS (SELECT w.event_id, w.kind, CASE WHEN w."end" > w.start THEN count(r.name)::DOUBLE / (w."end" - w.start) ELSE 0 END AS depth FROM w LEFT JOIN reads r ON r.chrom = w.chrom AND r.ref_start < w."end" AND w.start < r.ref_end GROUP BY w.event_id, w.kind, w.start, w."end"),
 g AS (SELECT event_id, max(CASE WHEN kind = 'event' THEN depth END) AS own, coalesce(avg(CASE WHEN kind <> 'event' AND depth > 0 THEN depth END), 0) AS flank FROM d GROUP BY event_id),
 c AS (SELECT s.event_id, CASE WHEN flank > 0 THEN own / flank END AS ratio, CASE WHEN sv_type = 'DEL' THEN 1 - vaf ELSE 1 + vaf END AS expected FROM sv s JOIN g USING (event_id))
 SELECT event_id, round(ratio, 6) AS ratio, round(expected, 6) AS expected, coalesce(abs(ratio - expected) < 0.3, true) AS pass FROM c"""


def _coverage(v):
    return V.coverage(v.sv, v.reads, min_flank_depth=0.0).select("event_id", F.round("ratio", 6).alias("ratio"), F.round("expected", 6).alias("expected"), "pass")


q("chk_coverage", _COVER)(_coverage)


@q("agg_check_summary", f"WITH k AS ({_COVER}) SELECT count(*) AS total, count_if(pass) AS passed, count_if(NOT pass) AS failed FROM k")
def _(v):
    return V.summary(_coverage(v))


@q("sink_report", f"WITH k AS ({_COVER}) SELECT event_id, pass FROM k")
def _(v):
    c = _coverage(v).select("event_id", F.col("event_id").cast("string").alias("event"), F.lit("coverage").alias("check"), F.col("expected").cast("string").alias("expected"), F.col("ratio").cast("string").alias("observed"), "pass")
    lines = sinks.check_lines(c, as_json=True)
    return lines.select(F.get_json_object("line", "$.event").cast("bigint").alias("event_id"), F.get_json_object("line", "$.pass").cast("boolean").alias("pass"))


_HEAD = "(SELECT * FROM aln WHERE (flag & 2308) = 0 ORDER BY chrom, pos, name, read_num LIMIT {n})"
_KEYS = ["chrom", "pos", "name", "read_num"]


@q("agg_bam_stats", "SELECT count(*) AS n, round(avg(CASE WHEN tlen > 0 AND (flag & 2) <> 0 THEN tlen END), 6) AS insert_mean, round(stddev_pop(CASE WHEN tlen > 0 AND (flag & 2) <> 0 THEN tlen END), 6) AS insert_sd, round(avg(length(seq)), 6) AS read_length FROM aln")
def _(v):
    return P.alignment_stats(v.aln, 10**6).select("n", *[F.round(c, 6).alias(c) for c in ("insert_mean", "insert_sd", "read_length")])


@q("chk_insert", f"SELECT round(m, 6) AS mean, round(s, 6) AS sd, m BETWEEN 50 AND 1000 AND s BETWEEN 5 AND 300 AS pass FROM (SELECT avg(CASE WHEN tlen > 0 AND (flag & 2) <> 0 THEN tlen END) AS m, stddev_pop(CASE WHEN tlen > 0 AND (flag & 2) <> 0 THEN tlen END) AS s FROM {_HEAD.format(n=50000)})")
def _(v):
    # its SQL stops at records, validate.run at usable sizes
    return V.insert_size(P.head(v.aln.where(R.globally_counted(F.col("flag"))), _KEYS, V.HEAD["insert"]), _KEYS).select(F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "pass")


@q("agg_dup_rate", f"SELECT round(avg(CASE WHEN flag & 1024 <> 0 THEN 1 ELSE 0 END), 9) AS rate FROM {_HEAD.format(n=200000)}")
def _(v):
    return V.duplicate_rate(v.aln, _KEYS).select(F.round("rate", 9).alias("rate"))


@q("chk_dup", f"SELECT avg(CASE WHEN flag & 1024 <> 0 THEN 1 ELSE 0 END) < 0.5 AS pass FROM {_HEAD.format(n=200000)}")
def _(v):
    return V.duplicate_rate(v.aln, _KEYS).select("pass")


@q("agg_mapq", f"SELECT round(avg(mapq), 9) AS mean FROM {_HEAD.format(n=100000)}")
def _(v):
    return V.mapping_quality(v.aln, _KEYS).select(F.round("mean", 9).alias("mean"))


@q("chk_mapq", f"SELECT avg(mapq) > 20 AS pass FROM {_HEAD.format(n=100000)}")
def _(v):
    return V.mapping_quality(v.aln, _KEYS).select("pass")


@q("limit_head", "SELECT name, read_num FROM aln WHERE (flag & 2308) = 0 ORDER BY chrom, pos, name, read_num LIMIT 1000")
def _(v):
    return P.head(v.aln.where(R.globally_counted(F.col("flag"))), _KEYS, 1000).select("name", "read_num")


@q("limit_events", "SELECT event_id FROM sv WHERE sv_type = 'DUP' ORDER BY event_id LIMIT 20")
def _(v):
    return v.sv.where("sv_type = 'DUP'").select("event_id").orderBy("event_id").limit(20)


@q("agg_frag_dist", "SELECT s.event_id, count(*) AS n, round(avg(insert_size), 6) AS mean, round(stddev_pop(insert_size), 6) AS stddev, min(insert_size) AS lo, max(insert_size) AS hi FROM pairs r JOIN sv s ON r.chrom = s.chrom AND r.ref_start < s.start + 300 AND s.start < r.ref_end GROUP BY s.event_id")
def _(v):
    g = v.sv.select("event_id", F.col("chrom").alias("g_chrom"), F.col("start").alias("g_start"), (F.col("start") + 300).alias("g_end"))
    j = I.overlap_join(v.pairs.select("chrom", "ref_start", "ref_end", "insert_size"), g, ("chrom", "ref_start", "ref_end"), _SV_ON)
    f = P.fragment_lengths(j, ["event_id"])
    return f.select("event_id", "n", F.round("mean", 6).alias("mean"), F.round("stddev", 6).alias("stddev"), F.get("lengths", F.lit(0))["len"].alias("lo"), F.get("lengths", F.size("lengths") - 1)["len"].alias("hi"))


@q("agg_cov_at", """WITH p AS (SELECT event_id, chrom, greatest(start - 1000, 0) AS lo, start + 1000 - greatest(start - 1000, 0) AS span FROM sv), x AS (SELECT event_id, chrom, greatest(least(span, 50), 1) AS n, unnest(list_transform(range(0, greatest(least(span, 50), 1)), lambda i: lo + i * CASE WHEN least(span, 50) > 1 THEN span // least(span, 50) ELSE 1 END)) AS p FROM p)
 SELECT x.event_id, round(count(r.name)::DOUBLE / any_value(n), 6) AS coverage FROM x LEFT JOIN reads r ON r.chrom = x.chrom AND r.ref_start <= x.p AND r.ref_end > x.p GROUP BY x.event_id""")
def _(v):
    return I.coverage_at(v.reads, v.sv.select("event_id", "chrom", F.col("start").alias("pos")), "event_id").select("event_id", F.round("coverage", 6).alias("coverage"))


@q("agg_region_merge", """WITH m AS (SELECT *, CASE WHEN start > max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM spans), i AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS k FROM m)
 SELECT chrom, min(start) AS start, max("end") AS "end", count(*) AS n FROM i GROUP BY chrom, k""")
def _(v):
    return I.merged(v.spans)


@q("agg_distinct_sa_soft", """SELECT s.event_id, count(DISTINCT a.name) FILTER (a.sa IS NOT NULL) AS n_sa, count(DISTINCT a.name) FILTER (regexp_matches(a.cigar, '^[0-9]+S|[0-9]+S$')) AS n_soft, count(*) AS n FROM sv s JOIN aln a ON a.chrom = s.chrom AND a.pos < s.start + 500 AND a.pos + 50 > s.start - 500 WHERE s.sv_type = 'DUP' AND (a.flag & 2308) = 0 GROUP BY s.event_id""")
def _(v):
    g = v.sv.where("sv_type = 'DUP'").select("event_id", F.col("chrom").alias("g_chrom"), F.greatest(F.col("start") - 500, F.lit(0)).alias("g_start"), (F.col("start") + 500).alias("g_end"))
    a = v.aln.where(R.globally_counted(F.col("flag"))).withColumn("a_end", F.col("pos") + 50).select("name", "chrom", "pos", "a_end", "sa", F.col("cigar").rlike("^[0-9]+S|[0-9]+S$").alias("soft"))
    j = I.overlap_join(a, g, ("chrom", "pos", "a_end"), _SV_ON)
    return j.groupBy("event_id").agg(F.count_distinct(F.when(F.col("sa").isNotNull(), F.col("name"))).alias("n_sa"), F.count_distinct(F.when(F.col("soft"), F.col("name"))).alias("n_soft"), F.count("*").alias("n"))


# --- windows, order, sets


@q("win_dedup_last", "SELECT name, ref_start FROM (SELECT concat('n', hap, '_', chrom, '_', ref_start % 100) AS name, ref_start, ord FROM pairs) QUALIFY row_number() OVER (PARTITION BY name ORDER BY ord DESC, ref_start DESC) = 1")
def _(v):
    p = v.pairs.select(F.concat(F.lit("n"), "hap", F.lit("_"), "chrom", F.lit("_"), F.col("ref_start") % 100).alias("name"), "ref_start", "ord")
    return P.last_by(p, ["name"], ["ord", "ref_start"]).select("name", "ref_start")


@q("sort_pool", "SELECT name, ref_start FROM pairs ORDER BY ref_start, name")
def _(v):
    return v.pairs.select("name", "ref_start").orderBy("ref_start", "name")


@q("search_sorted", "SELECT event_id, count(r.name) AS n FROM sv s LEFT JOIN reads r ON r.chrom = s.chrom AND r.ref_start <= s.start AND r.ref_end > s.start GROUP BY event_id")
def _(v):
    p = v.sv.select("event_id", F.col("chrom").alias("g_chrom"), F.col("start").alias("g_start"), (F.col("start") + 1).alias("g_end"))
    n = I.overlap_join(v.reads.select("chrom", "ref_start", "ref_end"), p, ("chrom", "ref_start", "ref_end"), _SV_ON).groupBy("event_id").agg(F.count("*").alias("n"))
    return v.sv.select("event_id").join(n, "event_id", "left").select("event_id", F.coalesce("n", F.lit(0)).alias("n"))


_REL = """CASE WHEN r.ref_end <= s.start OR r.ref_start >= s."end" THEN 'outside' WHEN r.ref_start >= s.start AND r.ref_end <= s."end" THEN 'inside' ELSE 'overlapping' END"""


@q("sim_relation", f"""SELECT event_id, {_REL} AS relation, count(*) AS n FROM sv s JOIN reads r ON r.chrom = s.chrom AND r.ref_start < s."end" + 500 AND r.ref_end > greatest(s.start - 500, 0) GROUP BY 1, 2""")
def _(v):
    g = v.sv.select("event_id", "start", "end", F.col("chrom").alias("g_chrom"), F.greatest(F.col("start") - 500, F.lit(0)).alias("g_start"), (F.col("end") + 500).alias("g_end"))
    j = I.overlap_join(v.reads.select("chrom", "ref_start", "ref_end"), g, ("chrom", "ref_start", "ref_end"), _SV_ON)
    return j.groupBy("event_id", I.relation(*(F.col(c) for c in ("ref_start", "ref_end", "start", "end"))).alias("relation")).agg(F.count("*").alias("n"))


@q("sim_overlap_frac", f"""SELECT event_id, round(sum(CASE WHEN {_REL} = 'inside' THEN 1 ELSE greatest(least(r.ref_end, s."end") - greatest(r.ref_start, s.start), 0)::DOUBLE / greatest(r.ref_end - r.ref_start, 1) END), 6) AS share FROM sv s JOIN reads r ON {_OVER} GROUP BY event_id""")
def _(v):
    j = I.overlap_join(v.reads.select("chrom", "ref_start", "ref_end"), regions(v.sv), ("chrom", "ref_start", "ref_end"), _SV_ON)
    return j.groupBy("event_id").agg(F.round(F.sum(I.overlap_share(*(F.col(c) for c in ("ref_start", "ref_end", "g_start", "g_end")))), 6).alias("share"))


@q("sim_additive", "SELECT event_id, sv_type = 'BND' AS full_model, sv_type IN ('BND', 'DUP') AS junction_model FROM sv")
def _(v):
    return v.sv.select("event_id", M.additive(F.col("sv_type"), "full").alias("full_model"), M.additive(F.col("sv_type"), "junction").alias("junction_model"))


@q("sim_loh_gate", "SELECT event_id, sv_type IN ('DEL', 'DUP') AND vaf >= 0.3 AND vaf <= 0.7 AS gate FROM sv")
def _(v):
    return v.sv.select("event_id", M.by_haplotype(F.col("sv_type"), F.col("vaf")).alias("gate"))
