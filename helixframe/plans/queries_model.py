"""Queries of pileups, haplotypes, qualities and simulation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import reads as R
from ..operators import haplotype as H, intervals as I, pileup, pool as P, quality as Q, rng, simulate as M
from . import validate as V
from .registry import Registry

QUERIES = Registry()
q = QUERIES.add

# --- pileups. The oracle walks CIGARs by windowed sums over their operations.

_WALK = """a0 AS (SELECT * FROM aln WHERE (flag & 3844) = 0 AND mapq >= 20), tok AS (SELECT name, read_num, ord, pos, chrom, seq, qual, unnest(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]')) AS t, unnest(range(len(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]')))) AS k FROM a0),
 op AS (SELECT *, right(t, 1) AS o, CAST(left(t, length(t) - 1) AS BIGINT) AS n FROM tok),
 wk AS (SELECT *, pos + coalesce(sum(CASE WHEN o IN ('M', '=', 'X', 'D', 'N') THEN n ELSE 0 END) OVER w, 0) AS rs, coalesce(sum(CASE WHEN o IN ('M', '=', 'X', 'I', 'S') THEN n ELSE 0 END) OVER w, 0) AS ss FROM op WINDOW w AS (PARTITION BY name, read_num, ord ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 bs AS (SELECT name, chrom, CAST(rs + i AS BIGINT) AS p, substr(seq, CAST(ss + i + 1 AS INT), 1) AS base, ascii(substr(qual, CAST(ss + i + 1 AS INT), 1)) - 33 AS q FROM (SELECT *, unnest(range(n)) AS i FROM wk WHERE o IN ('M', '=', 'X'))),
 pile AS (SELECT chrom, p, count_if(base = 'A') AS n_a, count_if(base = 'C') AS n_c, count_if(base = 'G') AS n_g, count_if(base = 'T') AS n_t FROM bs WHERE base IN ('A', 'C', 'G', 'T') GROUP BY ALL)"""
_RANK = """rk AS (SELECT chrom, p, tot, list_sort([{'n': -n_a, 'i': 0, 'b': 'A'}, {'n': -n_c, 'i': 1, 'b': 'C'}, {'n': -n_g, 'i': 2, 'b': 'G'}, {'n': -n_t, 'i': 3, 'b': 'T'}]) AS r FROM (SELECT *, n_a + n_c + n_g + n_t AS tot FROM pile)),
 het AS (SELECT chrom, p, r[1].b AS allele1, r[2].b AS allele2 FROM rk WHERE tot >= 10 AND -r[1].n / tot BETWEEN 0.2 AND 0.8 AND -r[2].n / tot BETWEEN 0.2 AND 0.8)"""


def _aln(v):
    return v.aln.where(R.primary(F.col("flag"), F.col("mapq"), 20))


def _pile(v):
    return pileup.piled(_aln(v))


@q("agg_pileup", f"WITH {_WALK} SELECT * FROM pile")
def _(v):
    return _pile(v)


@q("win_cigar_offset", f"WITH {_WALK} SELECT name, read_num, CAST(rs AS BIGINT) AS ref_at, CAST(ss AS BIGINT) AS seq_at, n FROM wk WHERE o IN ('M', '=', 'X')")
def _(v):
    b = _aln(v).select("name", "read_num", F.explode(pileup.aligned_blocks(F.col("cigar"), F.col("pos"))).alias("b"))
    return b.select("name", "read_num", F.col("b.ref").alias("ref_at"), F.col("b.seq").alias("seq_at"), F.col("b.len").alias("n"))


@q("agg_het_call", f"WITH {_WALK}, {_RANK} SELECT * FROM het")
def _(v):
    return pileup.het_sites(_pile(v))


@q("topk_alleles", f"WITH {_WALK}, {_RANK} SELECT chrom, p, r[1].b AS first_base, r[2].b AS second_base FROM rk")
def _(v):
    p = _pile(v)
    r = F.slice(F.array_sort(F.array(*[F.struct((-F.col("n_" + b)).alias("n"), F.lit(i).alias("i"), F.lit(b.upper()).alias("b")) for i, b in enumerate("acgt")])), 1, 2)
    return p.select("chrom", "p", F.get(r, F.lit(0))["b"].alias("first_base"), F.get(r, F.lit(1))["b"].alias("second_base"))


_U = "(('0x' || substr(md5(concat({k}, '|', {s})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
_PICK = "tg AS (SELECT chrom, p, CASE WHEN " + _U.format(k="concat(chrom, ':', p)", s="'42:target'") + " < 0.5 THEN allele1 ELSE allele2 END AS target, CASE WHEN " + _U.format(k="concat(chrom, ':', p)", s="'42:target'") + " < 0.5 THEN allele2 ELSE allele1 END AS other FROM het)"
_VOTE = "vt AS (SELECT name, count_if(base = target) AS target_n, count_if(base = other) AS other_n FROM bs JOIN tg USING (chrom, p) GROUP BY name HAVING count_if(base = target) + count_if(base = other) > 0)"


def _targets(v):
    het = pileup.het_sites(_pile(v))
    u = rng.uniform(F.concat("chrom", F.lit(":"), F.col("p").cast("string")), "42:target")
    return het.select("chrom", "p", F.when(u < 0.5, F.col("allele1")).otherwise(F.col("allele2")).alias("target"), F.when(u < 0.5, F.col("allele2")).otherwise(F.col("allele1")).alias("other"))


def _votes(v):
    return pileup.votes(pileup.at_sites(_aln(v), _targets(v), ["name"]))


@q("hap_target_pick", f"WITH {_WALK}, {_RANK}, {_PICK} SELECT * FROM tg")
def _(v):
    return _targets(v)


@q("join_variant_pos", f"WITH {_WALK}, {_RANK}, {_PICK} SELECT name, chrom, p, base FROM bs JOIN tg USING (chrom, p)")
def _(v):
    return pileup.at_sites(_aln(v), _targets(v), ["name"]).select("name", "chrom", "p", "base")


@q("agg_hap_vote", f"WITH {_WALK}, {_RANK}, {_PICK}, {_VOTE} SELECT name, target_n, other_n, CASE WHEN target_n > other_n THEN 'target' WHEN target_n < other_n THEN 'other' ELSE 'tie' END AS side FROM vt")
def _(v):
    return _votes(v)


@q("join_loh_semi", f"WITH {_WALK}, {_RANK}, {_PICK}, {_VOTE} SELECT name, CASE WHEN target_n IS NULL THEN 'unclassified' WHEN target_n > other_n THEN 'target' ELSE 'other' END AS side FROM pairs LEFT JOIN vt USING (name)")
def _(v):
    j = v.pairs.select("name").join(_votes(v), "name", "left")
    return j.select("name", F.when(F.col("side").isNull(), "unclassified").when(F.col("side") == "target", "target").otherwise("other").alias("side"))


@q("agg_baf", f"""WITH {_WALK}, st AS (SELECT s.event_id, x.p, x.ref_n, x.alt_n FROM sv s JOIN (SELECT t.chrom, t.start AS p, CASE t.ref_allele WHEN 'A' THEN n_a WHEN 'C' THEN n_c WHEN 'G' THEN n_g ELSE n_t END AS ref_n, CASE t.alt_allele WHEN 'A' THEN n_a WHEN 'C' THEN n_c WHEN 'G' THEN n_g ELSE n_t END AS alt_n FROM sv t JOIN pile ON pile.chrom = t.chrom AND pile.p = t.start WHERE t.sv_type = 'SNP') x ON s.sv_type = 'DUP' AND x.chrom_ = s.chrom AND x.p >= s.start AND x.p < s."end" WHERE x.ref_n + x.alt_n >= 10)
 SELECT event_id, count(*) AS n_sites, round(avg(b), 6) AS mean, round(median(b), 6) AS median, round(max(abs(b - 0.5)), 6) AS max_deviation FROM (SELECT event_id, alt_n::DOUBLE / (ref_n + alt_n) AS b FROM st) GROUP BY event_id""".replace("SELECT t.chrom, t.start", "SELECT t.chrom AS chrom_, t.start"))
def _(v):
    snp = v.sv.where("sv_type = 'SNP'").select("chrom", F.col("start").alias("p"), (F.col("start") + 1).alias("p_end"), F.col("ref_allele").alias("ref"), F.col("alt_allele").alias("alt"))
    dup = v.sv.where("sv_type = 'DUP'").select("event_id", F.col("chrom").alias("g_chrom"), F.col("start").alias("g_start"), F.col("end").alias("g_end"))
    sites = I.overlap_join(snp, dup, ("chrom", "p", "p_end"), ("g_chrom", "g_start", "g_end")).select("event_id", "chrom", "p", "ref", "alt")
    b = pileup.allele_balance(pileup.piled_at(_aln(v), snp), sites, ["event_id"])
    return b.select("event_id", "n_sites", *[F.round(c, 6).alias(c) for c in ("mean", "median", "max_deviation")])


@q("agg_mean_depth", f"""WITH {_WALK}, good AS (SELECT chrom, p, count(*) AS d FROM bs WHERE q >= 20 GROUP BY ALL) SELECT s.event_id, round(coalesce(sum(d), 0)::DOUBLE / (s."end" - s.start), 6) AS depth FROM sv s LEFT JOIN good g ON g.chrom = s.chrom AND g.p >= s.start AND g.p < s."end" WHERE s.sv_type = 'DUP' GROUP BY s.event_id, s.start, s."end" """)
def _(v):
    dup = v.sv.where("sv_type = 'DUP'").select("event_id", F.col("chrom").alias("g_chrom"), F.col("start").alias("g_start"), F.col("end").alias("g_end"))
    t = pileup.good_bases(_aln(v), dup, "event_id")
    return dup.join(t, "event_id", "left").select("event_id", F.round(F.coalesce("n", F.lit(0)) / (F.col("g_end") - F.col("g_start")), 6).alias("depth"))


@q("chk_af", f"""WITH {_WALK} SELECT event_id, round(CASE WHEN d > 0 THEN own::DOUBLE / d END, 6) AS observed, coalesce(d, 0) AS depth, CASE WHEN coalesce(d, 0) = 0 THEN false WHEN d < 5 THEN true ELSE abs(own::DOUBLE / d - vaf) < 0.15 END AS pass
 FROM (SELECT event_id, vaf, n_a + n_c + n_g + n_t AS d, CASE alt_allele WHEN 'A' THEN n_a WHEN 'C' THEN n_c WHEN 'G' THEN n_g ELSE n_t END AS own FROM sv s LEFT JOIN pile ON pile.chrom = s.chrom AND pile.p = s.start WHERE sv_type = 'SNP')""")
def _(v):
    c = V.allele_fractions(v.sv, pileup.piled_at(_aln(v), v.sv.where("sv_type = 'SNP'").select("chrom", F.col("start").alias("p"))))
    return c.select("event_id", F.round("observed", 6).alias("observed"), "depth", "pass")


@q("chk_dup_realism", f"""WITH {_WALK}, n AS (SELECT s.event_id, s.kind, count(r.name)::DOUBLE / greatest(s.hi - s.lo, 1) AS d FROM (SELECT event_id, 'event' AS kind, chrom, start AS lo, "end" AS hi FROM sv WHERE sv_type = 'DUP' UNION ALL SELECT event_id, 'left', chrom, greatest(start - 5000, 0), start FROM sv WHERE sv_type = 'DUP' UNION ALL SELECT event_id, 'right', chrom, "end", "end" + 5000 FROM sv WHERE sv_type = 'DUP') s LEFT JOIN reads r ON r.chrom = s.chrom AND r.ref_start < s.hi AND s.lo < r.ref_end GROUP BY s.event_id, s.kind, s.lo, s.hi)
 SELECT event_id, round(max(CASE WHEN kind = 'event' THEN d END), 6) AS own, round(avg(CASE WHEN kind <> 'event' AND d > 0 THEN d END), 6) AS flank FROM n GROUP BY event_id""")
def _(v):
    d = I.depth(v.reads, V.windows(v.sv.where("sv_type = 'DUP'"), 5000), ["event_id", "kind"])
    return d.groupBy("event_id").agg(F.round(F.max(F.when(F.col("kind") == "event", F.col("depth"))), 6).alias("own"), F.round(F.avg(F.when((F.col("kind") != "event") & (F.col("depth") > 0), F.col("depth"))), 6).alias("flank"))


# --- haplotypes. The oracle cuts segments from whole chromosomes.

_FL = 2000
_SEG = f"""whole AS (SELECT chrom, string_agg(seq, '' ORDER BY chunk_id) AS s FROM ref GROUP BY chrom),
 lst AS (SELECT event_id, unnest(CASE sv_type
  WHEN 'DEL' THEN [{{'c': chrom, 'a': greatest(start - {_FL}, 0), 'b': start, 'r': false, 'n': NULL::VARCHAR}}, {{'c': chrom, 'a': "end", 'b': "end" + {_FL}, 'r': false, 'n': NULL}}]
  WHEN 'DUP' THEN [{{'c': chrom, 'a': greatest(start - {_FL}, 0), 'b': start, 'r': false, 'n': NULL}}, {{'c': chrom, 'a': start, 'b': "end", 'r': false, 'n': NULL}}, {{'c': chrom, 'a': start, 'b': "end", 'r': false, 'n': NULL}}, {{'c': chrom, 'a': "end", 'b': "end" + {_FL}, 'r': false, 'n': NULL}}]
  WHEN 'INV' THEN [{{'c': chrom, 'a': greatest(start - {_FL}, 0), 'b': start, 'r': false, 'n': NULL}}, {{'c': chrom, 'a': start, 'b': "end", 'r': true, 'n': NULL}}, {{'c': chrom, 'a': "end", 'b': "end" + {_FL}, 'r': false, 'n': NULL}}]
  WHEN 'INS' THEN [{{'c': chrom, 'a': greatest(start - {_FL}, 0), 'b': start, 'r': false, 'n': NULL}}, {{'c': NULL, 'a': NULL, 'b': NULL, 'r': false, 'n': ins_seq}}, {{'c': chrom, 'a': start, 'b': start + {_FL}, 'r': false, 'n': NULL}}]
  WHEN 'SNP' THEN [{{'c': chrom, 'a': greatest(start - {_FL}, 0), 'b': start, 'r': false, 'n': NULL}}, {{'c': chrom, 'a': start, 'b': start + 1, 'r': false, 'n': alt_allele}}, {{'c': chrom, 'a': start + 1, 'b': start + 1 + {_FL}, 'r': false, 'n': NULL}}]
  ELSE [{{'c': chrom, 'a': greatest(start - {_FL}, 0), 'b': start, 'r': false, 'n': NULL}}, {{'c': chrom_b, 'a': bp_b, 'b': bp_b + {_FL}, 'r': inverted, 'n': NULL}}] END) AS x, unnest(range(4)) AS seg FROM sv),
 sgm AS (SELECT event_id, CAST(seg AS INT) AS seg, x.c AS chrom, x.a AS ref_start, x.b AS ref_end, x.r AS rev, coalesce(x.n, CASE WHEN x.r THEN translate(reverse(substr(s, CAST(x.a + 1 AS INT), CAST(x.b - x.a AS INT))), 'ACGT', 'TGCA') ELSE substr(s, CAST(x.a + 1 AS INT), CAST(x.b - x.a AS INT)) END) AS sequence FROM lst LEFT JOIN whole w ON w.chrom = x.c WHERE x IS NOT NULL),
 off AS (SELECT *, length(sequence) AS len, CAST(coalesce(sum(length(sequence)) OVER (PARTITION BY event_id ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS hap_offset FROM sgm),
 hp AS (SELECT event_id, CAST(sum(len) AS BIGINT) AS total_len, CAST(coalesce(sum(CASE WHEN chrom IS NOT NULL THEN ref_end - ref_start END), 0) AS BIGINT) AS ref_len, min(ref_start) AS ref_lo, max(ref_end) AS ref_hi, list(hap_offset + len ORDER BY seg)[:-2] AS bps, string_agg(sequence, '' ORDER BY seg) AS sequence FROM off GROUP BY event_id)"""


def _segs(v):
    return H.with_sequences(H.segments(v.sv), v.ref)


def _laid(v):
    return H.with_lengths(H.segments(v.sv), v.ref)


def _hap(kind: str):
    @q(f"hap_{'fusion' if kind == 'BND' else 'small' if kind == 'SNP' else 'dup_full' if kind == 'DUP' else kind.lower()}", f"WITH {_SEG} SELECT event_id, total_len, md5(h.sequence) AS h FROM hp h JOIN sv USING (event_id) WHERE sv_type = '{kind}'")
    def _(v):
        s = H.with_sequences(H.segments(v.sv.where(F.col("sv_type") == kind)), v.ref)
        return H.haplotypes(s).select("event_id", "total_len", F.md5(F.col("sequence").cast("binary")).alias("h"))


for _kind in ("DEL", "DUP", "INV", "INS", "BND", "SNP"):
    _hap(_kind)


@q("hap_dup_junction", f"""WITH whole AS (SELECT chrom, string_agg(seq, '' ORDER BY chunk_id) AS s FROM ref GROUP BY chrom) SELECT event_id, md5(concat(substr(s, CAST(greatest("end" - {_FL}, 0) + 1 AS INT), CAST("end" - greatest("end" - {_FL}, 0) AS INT)), substr(s, CAST(start + 1 AS INT), {_FL}))) AS h FROM sv JOIN whole USING (chrom) WHERE sv_type = 'DUP'""")
def _(v):
    s = H.with_sequences(H.segments(v.sv.where("sv_type = 'DUP'"), "junction"), v.ref)
    return H.haplotypes(s).select("event_id", F.md5(F.col("sequence").cast("binary")).alias("h"))


@q("hap_dispatch", f"WITH {_SEG} SELECT event_id, count(*) AS n FROM off GROUP BY event_id")
def _(v):
    return H.segments(v.sv).groupBy("event_id").agg(F.count("*").alias("n"))


@q("win_hap_offset", f"WITH {_SEG} SELECT event_id, seg, hap_offset, len FROM off")
def _(v):
    return _laid(v).select("event_id", "seg", "hap_offset", "len")


@q("win_breakpoints", f"WITH {_SEG} SELECT event_id, unnest(bps) AS bp FROM hp")
def _(v):
    return H.haplotypes(_laid(v)).select("event_id", F.explode("breakpoints").alias("bp"))


@q("hap_ref_len", f"WITH {_SEG} SELECT event_id, ref_len FROM hp")
def _(v):
    return H.haplotypes(_laid(v)).select("event_id", "ref_len")


@q("hap_ref_range", f"WITH {_SEG} SELECT event_id, ref_lo, ref_hi FROM hp")
def _(v):
    return H.haplotypes(_laid(v)).select("event_id", "ref_lo", "ref_hi")


@q("hap_primary_chrom", f"WITH {_SEG} SELECT event_id, coalesce(arg_min(coalesce(chrom, '?'), seg), '?') AS chrom FROM off GROUP BY event_id")
def _(v):
    return H.segments(v.sv).groupBy("event_id").agg(F.min_by(F.coalesce("chrom", F.lit("?")), "seg").alias("chrom"))


@q("hap_subseq", f"WITH {_SEG} SELECT event_id, md5(substr(sequence, 1901, 200)) AS h FROM hp")
def _(v):
    return H.haplotypes(_segs(v)).select("event_id", F.md5(F.substring("sequence", 1901, 200).cast("binary")).alias("h"))


_PTS = "pts AS (SELECT event_id, unnest([0, bps[1] - 1, bps[1], bps[1] + 10, total_len - 1, total_len]) AS hap_pos, unnest(range(6)) AS k FROM hp)"


def _points(v):
    h = H.haplotypes(_laid(v))
    b = F.get("breakpoints", F.lit(0))
    return h.select("event_id", F.posexplode(F.array(F.lit(0).cast("bigint"), b - 1, b, b + 10, F.col("total_len") - 1, F.col("total_len"))).alias("k", "hap_pos"))


@q("join_point", f"WITH {_SEG}, {_PTS} SELECT p.event_id, CAST(k AS INT) AS k, o.chrom AS ref_chrom, CASE WHEN o.chrom IS NULL THEN NULL WHEN rev THEN ref_end - 1 - (hap_pos - hap_offset) ELSE ref_start + hap_pos - hap_offset END AS ref_pos FROM pts p LEFT JOIN off o ON o.event_id = p.event_id AND hap_pos >= hap_offset AND hap_pos < hap_offset + len")
def _(v):
    return H.to_reference(_points(v), _laid(v)).select("event_id", "k", "ref_chrom", "ref_pos")


def _covered(v):
    s = _laid(v).groupBy("event_id").agg(F.collect_list(F.struct("hap_offset", "len", "chrom")).alias("s"))
    return _points(v).join(s.hint("merge"), "event_id")


@q("hap_overlaps_ref", f"WITH {_SEG}, {_PTS} SELECT p.event_id, CAST(k AS INT) AS k, count(o.seg) > 0 AS hit FROM pts p LEFT JOIN off o ON o.event_id = p.event_id AND o.chrom IS NOT NULL AND hap_offset < hap_pos + 10 AND hap_offset + len > hap_pos GROUP BY 1, 2")
def _(v):
    return _covered(v).select("event_id", "k", H.overlaps_reference(F.col("hap_pos"), F.lit(10), F.col("s")).alias("hit"))


@q("hap_within_one", f"WITH {_SEG}, {_PTS} SELECT p.event_id, CAST(k AS INT) AS k, count(o.seg) > 0 AS hit FROM pts p LEFT JOIN off o ON o.event_id = p.event_id AND hap_offset <= hap_pos AND hap_offset + len >= hap_pos + 10 GROUP BY 1, 2")
def _(v):
    return _covered(v).select("event_id", "k", H.within_one(F.col("hap_pos"), F.lit(10), F.col("s")).alias("hit"))


@q("join_variant_apply", f"""WITH {_SEG}, vr AS (SELECT DISTINCT chrom, start AS p, alt_allele AS al FROM sv WHERE sv_type = 'SNP'), ch AS (SELECT o.event_id, o.seg, count(*) AS n FROM off o JOIN vr ON vr.chrom = o.chrom AND vr.p >= o.ref_start AND vr.p < o.ref_start + o.len GROUP BY ALL) SELECT o.event_id, o.seg, len, coalesce(n, 0) AS n_variants FROM off o LEFT JOIN ch USING (event_id, seg) JOIN sv USING (event_id) WHERE sv_type = 'DUP'""")
def _(v):
    variants = v.sv.where("sv_type = 'SNP'").select("chrom", F.col("start").alias("p"), F.col("alt_allele").alias("allele")).distinct()
    s = H.with_sequences(H.segments(v.sv.where("sv_type = 'DUP'")), v.ref)
    return H.applied(s, variants).select("event_id", "seg", "len", "n_variants")


# --- simulation

_COV = "cv AS (SELECT event_id, CAST(10 + event_id % 30 AS DOUBLE) AS cov, CAST(300 + event_id % 200 AS DOUBLE) AS mf FROM sv)"


@q("sim_tile_count", f"""WITH {_SEG}, {_COV} SELECT event_id, CASE WHEN total_len = 0 THEN 0 ELSE greatest(CAST(floor(cov * vaf * (CASE WHEN sv_type = 'BND' AND len(bps) > 0 THEN least(len(bps) * floor(2 * mf), total_len) WHEN ref_len > 0 THEN ref_len ELSE total_len END) / mf + 0.5) AS BIGINT), 2) END AS n FROM hp JOIN sv USING (event_id) JOIN cv USING (event_id)""")
def _(v):
    h = H.haplotypes(_laid(v)).join(v.sv.select("event_id", "sv_type", "vaf").hint("merge"), "event_id")
    cov, mf = (F.col("event_id") % 30 + 10).cast("double"), (F.col("event_id") % 200 + 300).cast("double")
    return h.select("event_id", M.tile_count(cov, F.col("vaf"), mf, F.col("total_len"), F.col("ref_len"), F.size("breakpoints"), M.additive(F.col("sv_type"), "full")).alias("n"))


@q("sim_cov_site", f"""WITH {_SEG}, ps AS (SELECT h.event_id, s.chrom, coalesce(CASE WHEN o.chrom IS NULL THEN NULL WHEN rev THEN o.ref_end - 1 - (bps[1] - 1 - hap_offset) ELSE o.ref_start + bps[1] - 1 - hap_offset END, s.start) AS pos FROM hp h JOIN sv s USING (event_id) LEFT JOIN off o ON o.event_id = h.event_id AND greatest(bps[1] - 1, 0) >= hap_offset AND greatest(bps[1] - 1, 0) < hap_offset + len),
 w AS (SELECT event_id, chrom, greatest(pos - 1000, 0) AS lo, pos + 1000 - greatest(pos - 1000, 0) AS span FROM ps), x AS (SELECT event_id, chrom, least(span, 50) AS n, unnest(list_transform(range(0, least(span, 50)), lambda i: lo + i * (span // least(span, 50)))) AS p FROM w)
 SELECT x.event_id, round(count(r.name)::DOUBLE / any_value(n), 6) AS coverage FROM x LEFT JOIN reads r ON r.chrom = x.chrom AND r.ref_start <= x.p AND r.ref_end > x.p GROUP BY x.event_id""")
def _(v):
    s = _laid(v)
    first = H.haplotypes(s).select("event_id", F.greatest(F.get("breakpoints", F.lit(0)) - 1, F.lit(0)).alias("hap_pos"))
    at = H.to_reference(first, s).join(v.sv.select("event_id", "chrom", "start").hint("merge"), "event_id").select("event_id", "chrom", F.coalesce("ref_pos", "start").alias("pos"))
    return I.coverage_at(v.reads, at, "event_id").select("event_id", F.round("coverage", 6).alias("coverage"))


_SHARE = "CASE WHEN r.ref_start >= hap_lo AND r.ref_end <= hap_hi THEN 1 ELSE greatest(least(r.ref_end, hap_hi) - greatest(r.ref_start, hap_lo), 0)::DOUBLE / greatest(r.ref_end - r.ref_start, 1) END"
_SUP = """pr AS (SELECT event_id, r.name, r.ref_start, r.ref_end, r.hap, s.sv_type, s.vaf, greatest(s.start - 300, 0) AS hap_lo, s."end" + 300 AS hap_hi, s.start AS sv_lo, s."end" AS sv_hi FROM pairs r JOIN sv s ON r.chrom = s.chrom AND r.ref_start < s."end" + 500 AND greatest(s.start - 500, 0) < r.ref_end)"""
_USUP = _U.format(k="name", s="concat('42:', event_id, ':suppress')")
_UCOPY = _U.format(k="name", s="concat('42:', event_id, ':copy')")


def _pool(v):
    g = v.sv.select("event_id", "sv_type", "vaf", F.col("start").alias("sv_lo"), F.col("end").alias("sv_hi"), F.col("chrom").alias("g_chrom"), F.greatest(F.col("start") - 500, F.lit(0)).alias("g_start"), (F.col("end") + 500).alias("g_end"))
    j = I.overlap_join(v.pairs.select("name", "chrom", "ref_start", "ref_end", "hap"), g, ("chrom", "ref_start", "ref_end"), ("g_chrom", "g_start", "g_end"))
    return j.withColumn("hap_lo", F.greatest(F.col("sv_lo") - 300, F.lit(0))).withColumn("hap_hi", F.col("sv_hi") + 300)


@q("sim_suppress", f"WITH {_SUP} SELECT event_id, name, CASE WHEN sv_type <> 'BND' AND NOT (r.ref_end <= hap_lo OR r.ref_start >= hap_hi) AND {_USUP} <= vaf * {_SHARE} THEN 'suppressed' ELSE 'kept' END AS disposition FROM pr r")
def _(v):
    p = _pool(v).withColumn("side", F.lit(None).cast("string"))
    return M.suppression(p).select("event_id", "name", "disposition")


_LOH = f"CASE WHEN sv_type IN ('DEL', 'DUP') AND vaf >= 0.3 AND vaf <= 0.7 AND NOT (r.ref_end <= sv_lo OR r.ref_start >= sv_hi) THEN {_USUP} < (CASE WHEN hap = 1 THEN least(2 * vaf, 1) ELSE greatest(2 * vaf - 1, 0) END) * {_SHARE} ELSE {_USUP} <= vaf * {_SHARE} END"


@q("sim_suppress_loh", f"WITH {_SUP} SELECT event_id, name, CASE WHEN sv_type <> 'BND' AND NOT (r.ref_end <= hap_lo OR r.ref_start >= hap_hi) AND ({_LOH}) THEN 'suppressed' ELSE 'kept' END AS disposition FROM pr r")
def _(v):
    p = _pool(v).withColumn("side", F.when(F.col("hap") == 1, "target").otherwise("other"))
    return M.suppression(p).select("event_id", "name", "disposition")


@q("agg_event_stats", f"WITH {_SUP}, d AS (SELECT event_id, CASE WHEN sv_type <> 'BND' AND NOT (r.ref_end <= hap_lo OR r.ref_start >= hap_hi) AND {_USUP} <= vaf * {_SHARE} THEN 'suppressed' ELSE 'kept' END AS x FROM pr r) SELECT event_id, count_if(x = 'kept') AS kept, count_if(x = 'chimeric') AS chimeric, count_if(x = 'suppressed') AS suppressed FROM d GROUP BY event_id")
def _(v):
    from ..sources import sinks

    return sinks.event_summary(M.suppression(_pool(v).withColumn("side", F.lit(None).cast("string"))))


@q("sink_readme", f"""WITH {_SUP}, d AS (SELECT event_id, CASE WHEN sv_type <> 'BND' AND NOT (r.ref_end <= hap_lo OR r.ref_start >= hap_hi) AND {_USUP} <= vaf * {_SHARE} THEN 'suppressed' ELSE 'kept' END AS x FROM pr r), n AS (SELECT event_id, count_if(x = 'kept') AS kept, count_if(x = 'suppressed') AS gone FROM d GROUP BY event_id)
 SELECT s.event_id, concat('| ', s.event_id, ' | ', s.sv_type, ' ', s.chrom, ':', s.start, '-', s."end", ' (', s.gene, ') | ', printf('%.3f', s.vaf), ' | ', coalesce(kept, 0), ' | 0 | ', coalesce(gone, 0), ' |') AS line FROM sv s LEFT JOIN n ON n.event_id = s.event_id""")
def _(v):
    from ..sources import sinks

    judged = M.suppression(_pool(v).withColumn("side", F.lit(None).cast("string")))
    return sinks.run_log_rows(v.sv.withColumn("allele_fraction", F.col("vaf")), judged)


_COPY = f"sv_type = 'DUP' AND least(r.ref_end, sv_hi) - greatest(r.ref_start, sv_lo) > 0 AND 2 * (least(r.ref_end, sv_hi) - greatest(r.ref_start, sv_lo)) >= greatest(r.ref_end - r.ref_start, 1) AND {_UCOPY} < CASE WHEN hap = 1 THEN least(2 * vaf, 1) ELSE greatest(2 * vaf - 1, 0) END"


def _copies(v):
    return M.depth_copies(_pool(v).withColumn("side", F.when(F.col("hap") == 1, "target").otherwise("other")))


@q("syn_depth_copy", f"WITH {_SUP} SELECT event_id, name FROM pr r WHERE {_COPY}")
def _(v):
    return _copies(v).select("event_id", "name")


@q("syn_jitter", f"WITH {_SUP} SELECT event_id, name, greatest(ref_start + least(CAST(floor({_U.format(k='name', s=chr(39) + '42:' + chr(39) + ' || event_id || ' + chr(39) + ':jitter' + chr(39))} * 41) AS BIGINT), 40) - 20, 0) AS new_start FROM pr r WHERE {_COPY}")
def _(v):
    c = _copies(v).withColumn("lengths", F.array(F.lit(300).cast("bigint")))
    return M.jittered(c).select("event_id", "name", "new_start")


@q("set_union_output", f"WITH {_SUP} SELECT event_id, name, 'kept' AS origin FROM pr r WHERE NOT (sv_type <> 'BND' AND NOT (r.ref_end <= hap_lo OR r.ref_start >= hap_hi) AND {_USUP} <= vaf * {_SHARE}) UNION ALL SELECT event_id, name || '_copy', 'copy' FROM pr r WHERE {_COPY}")
def _(v):
    k = M.suppression(_pool(v).withColumn("side", F.lit(None).cast("string"))).where("disposition = 'kept'").select("event_id", "name", F.lit("kept").alias("origin"))
    return k.unionByName(_copies(v).select("event_id", F.concat("name", F.lit("_copy")).alias("name"), F.lit("copy").alias("origin")))


_ULEN = _U.format(k="event_id", s="'42:len'")


@q("samp_cdf", f"WITH l AS (SELECT event_id, list_sort(list(r.insert_size)) AS ls FROM pairs r JOIN sv s ON r.chrom = s.chrom AND r.ref_start < s.start + 300 AND s.start < r.ref_end GROUP BY event_id) SELECT event_id, ls[CAST(least(floor({_ULEN} * len(ls)), len(ls) - 1) AS INT) + 1] AS x FROM l")
def _(v):
    return _lengths(v).select("event_id", P.drawn(F.col("lengths"), rng.uniform(F.col("event_id"), "42:len")).alias("x"))


def _lengths(v):
    g = v.sv.select("event_id", F.col("chrom").alias("g_chrom"), F.col("start").alias("g_start"), (F.col("start") + 300).alias("g_end"))
    return P.fragment_lengths(I.overlap_join(v.pairs.select("chrom", "ref_start", "ref_end", "insert_size"), g, ("chrom", "ref_start", "ref_end"), ("g_chrom", "g_start", "g_end")), ["event_id"])


@q("samp_cdf_range", f"WITH l AS (SELECT event_id, list_sort(list(r.insert_size)) AS al FROM pairs r JOIN sv s ON r.chrom = s.chrom AND r.ref_start < s.start + 300 AND s.start < r.ref_end GROUP BY event_id), f AS (SELECT event_id, CASE WHEN len(list_filter(al, lambda x: x BETWEEN 200 AND 400)) > 0 THEN list_filter(al, lambda x: x BETWEEN 200 AND 400) ELSE [greatest(200, least(400, list_max(al)))] END AS ls FROM l) SELECT event_id, ls[CAST(least(floor({_ULEN} * len(ls)), len(ls) - 1) AS INT) + 1] AS x FROM f")
def _(v):
    return _lengths(v).select("event_id", P.drawn(P.in_range(F.col("lengths"), 200, 400), rng.uniform(F.col("event_id"), "42:len")).alias("x"))


@q("agg_frag_normal", "SELECT CAST(i AS BIGINT) AS i, round(greatest(50, 400 + 80 * sqrt(-2 * ln(greatest(" + _U.format(k="i", s="'0:u'") + ", 1e-12))) * cos(6.283185307179586 * " + _U.format(k="i", s="'0:v'") + ")), 4) AS x FROM range(10000) t(i)")
def _(v):
    return v.spark.range(10000).select(F.col("id").alias("i"), F.round(F.greatest(F.lit(50.0), rng.normal(F.col("id"), "0", 400.0, 80.0)), 4).alias("x"))


@q("syn_rand_base", "SELECT event_id, substr(replace('ACGT', ref_allele, ''), CAST(least(floor(" + _U.format(k="event_id", s="'42:other'") + " * 3), 2) AS INT) + 1, 1) AS b FROM sv WHERE sv_type = 'SNP'")
def _(v):
    return v.sv.where("sv_type = 'SNP'").select("event_id", M.other_base(F.col("ref_allele"), rng.uniform(F.col("event_id"), "42:other")).alias("b"))


def _tiles(v, carry=(), haps=None):
    h = (H.haplotypes(_laid(v)) if haps is None else haps).join(v.sv.select("event_id", "sv_type", "vaf").hint("merge"), "event_id")
    near = M.additive(F.col("sv_type"), "full")
    h = h.withColumn("near_breakpoints", near).withColumn("n_tiles", M.tile_count(F.lit(10.0), F.col("vaf"), F.lit(400.0), F.col("total_len"), F.col("ref_len"), F.size("breakpoints"), near))
    return M.tiles(h.withColumn("lengths", F.sequence(F.lit(200).cast("bigint"), F.lit(600).cast("bigint"), F.lit(25).cast("bigint"))), 50, carry=carry)


def _ut(what: str) -> str:
    return _U.format(k="event_id", s=f"concat('42:{what}:', attempt)")


_TILE = f"""{_SEG}, nt AS (SELECT h.*, sv_type = 'BND' AS near, greatest(CAST(floor(10 * vaf * (CASE WHEN sv_type = 'BND' AND len(bps) > 0 THEN least(len(bps) * 800, total_len) WHEN ref_len > 0 THEN ref_len ELSE total_len END) / 400.0 + 0.5) AS BIGINT), 2) AS n_tiles FROM hp h JOIN sv USING (event_id) WHERE total_len > 0),
 att AS (SELECT *, unnest(range(0, 2 * n_tiles)) AS attempt FROM nt), fl AS (SELECT *, 200 + 25 * CAST(least(floor({_ut('len')} * 17), 16) AS BIGINT) AS frag_len, CASE WHEN len(bps) > 0 THEN bps[CAST(least(floor({_ut('bp')} * len(bps)), len(bps) - 1) AS INT) + 1] END AS bp FROM att),
 rg AS (SELECT *, CASE WHEN near AND len(bps) > 0 THEN greatest(bp - frag_len + 1, 0) ELSE 0 END AS lo, CASE WHEN near AND len(bps) > 0 THEN least(bp - 1, total_len - frag_len) ELSE total_len - frag_len END AS hi FROM fl WHERE frag_len <= total_len),
 st AS (SELECT event_id, attempt, n_tiles, frag_len, CAST(lo + least(floor({_ut('start')} * (hi - lo + 1)), hi - lo) AS BIGINT) AS hap_start FROM rg WHERE lo <= hi),
 ok AS (SELECT st.* FROM st WHERE EXISTS (SELECT 1 FROM off o WHERE o.event_id = st.event_id AND o.chrom IS NOT NULL AND hap_offset <= hap_start AND hap_start < hap_offset + len) AND EXISTS (SELECT 1 FROM off o WHERE o.event_id = st.event_id AND o.chrom IS NOT NULL AND hap_offset <= hap_start + frag_len - 1 AND hap_start + frag_len - 1 < hap_offset + len)),
 til AS (SELECT event_id, attempt, frag_len, hap_start FROM ok QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY attempt) <= n_tiles)"""


@q("sim_tile_place", f"WITH {_TILE} SELECT * FROM til")
def _(v):
    return _tiles(v)


@q("syn_pair", f"WITH {_TILE} SELECT event_id, attempt, hap_start AS r1_start, hap_start + frag_len - 50 AS r2_start FROM til WHERE frag_len >= 50")
def _(v):
    return M.pair_geometry(_tiles(v), 50).select("event_id", "attempt", "r1_start", "r2_start")


_AT = "LEFT JOIN off {a} ON {a}.event_id = t.event_id AND {p} >= {a}.hap_offset AND {p} < {a}.hap_offset + {a}.len"
_REFP = "CASE WHEN {a}.chrom IS NULL THEN NULL WHEN {a}.rev THEN {a}.ref_end - 1 - ({p} - {a}.hap_offset) ELSE {a}.ref_start + {p} - {a}.hap_offset END"


@q("syn_hap_pair", f"WITH {_TILE} SELECT t.event_id, attempt, x.chrom AS chrom, least({_REFP.format(a='x', p='hap_start')}, {_REFP.format(a='y', p='(hap_start + frag_len - 1)')}) AS ref_start, greatest({_REFP.format(a='x', p='hap_start')}, {_REFP.format(a='y', p='(hap_start + frag_len - 1)')}) + 1 AS ref_end FROM til t {_AT.format(a='x', p='hap_start')} {_AT.format(a='y', p='(hap_start + frag_len - 1)')}")
def _(v):
    """Both ends are looked up in their haplotype's segments, which come with the fragment."""
    last = F.col("hap_start") + F.col("frag_len") - 1
    t = _tiles(v, ("segs",)).withColumns({"x": H.segment_at("segs", F.col("hap_start")), "y": H.segment_at("segs", last)})
    t = t.withColumns({"a": H.origin(F.col("x"), F.col("hap_start")), "b": H.origin(F.col("y"), last)})
    return t.select("event_id", "attempt", F.col("x.chrom").alias("chrom"), F.least("a", "b").alias("ref_start"), (F.greatest("a", "b") + 1).alias("ref_end"))


# --- qualities

_OBS = """ob AS (SELECT read_num, CAST(i AS INT) AS cycle, CASE substr(s, CAST(i + 1 AS INT), 1) WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 END AS base, CASE WHEN i > 0 THEN least(CAST(floor((ascii(substr(ql, CAST(i AS INT), 1)) - 33) / 10.0) AS INT), 3) END AS prev_bin, ascii(substr(ql, CAST(i + 1 AS INT), 1)) - 33 AS q
 FROM (SELECT read_num, CASE WHEN read_num = 2 THEN translate(reverse(seq), 'ACGT', 'TGCA') ELSE seq END AS s, CASE WHEN read_num = 2 THEN reverse(qual) ELSE qual END AS ql, unnest(range(50)) AS i FROM (SELECT * FROM aln QUALIFY row_number() OVER (PARTITION BY name, read_num ORDER BY ord DESC) = 1))),
 hs AS (SELECT 'cycle' AS level, read_num, cycle, NULL::INT AS base, NULL::INT AS prev_bin, q, count(*) AS n FROM ob GROUP BY ALL UNION ALL SELECT 'base', read_num, cycle, base, NULL, q, count(*) FROM ob WHERE base IS NOT NULL GROUP BY ALL UNION ALL SELECT 'markov_cycle', read_num, cycle, NULL, prev_bin, q, count(*) FROM ob WHERE prev_bin IS NOT NULL GROUP BY ALL UNION ALL SELECT 'markov_base', read_num, cycle, base, prev_bin, q, count(*) FROM ob WHERE prev_bin IS NOT NULL AND base IS NOT NULL GROUP BY ALL)"""


def _obs(v):
    return Q.observations(P.paired(v.aln, ["ord"]), 50)


@q("agg_quality", f"WITH {_OBS} SELECT * FROM hs")
def _(v):
    return Q.histograms(_obs(v))


@q("win_prev_q", f"WITH {_OBS} SELECT read_num, cycle, prev_bin, count(*) AS n FROM ob WHERE prev_bin IS NOT NULL GROUP BY ALL")
def _(v):
    return _obs(v).where("prev_bin is not null").groupBy("read_num", "cycle", "prev_bin").agg(F.count("*").alias("n"))


_BINS = "bn AS (SELECT level, read_num, cycle, base, prev_bin, CAST(sum(n) AS BIGINT) AS total FROM hs GROUP BY ALL)"


@q("agg_quality_cov", f"WITH {_OBS}, {_BINS} SELECT level, count_if(total >= 30) AS usable, CAST(CASE level WHEN 'cycle' THEN 100 WHEN 'base' THEN 400 WHEN 'markov_cycle' THEN 400 ELSE 1600 END AS BIGINT) AS bins FROM bn GROUP BY level")
def _(v):
    return Q.usable_share(Q.bins(Q.histograms(_obs(v))), 50).select("level", "usable", "bins")


@q("samp_quality", f"""WITH {_OBS}, {_BINS}, wt AS (SELECT DISTINCT read_num, cycle, base, prev_bin FROM ob)
 SELECT w.read_num, w.cycle, w.base, w.prev_bin, CASE WHEN a.total >= 30 THEN 'markov_base' WHEN b.total >= 30 THEN 'markov_cycle' WHEN c.total >= 30 THEN 'base' WHEN d.total > 0 THEN 'cycle' ELSE 'none' END AS level FROM wt w
 LEFT JOIN bn a ON a.level = 'markov_base' AND a.read_num = w.read_num AND a.cycle = w.cycle AND a.base = w.base AND a.prev_bin = w.prev_bin LEFT JOIN bn b ON b.level = 'markov_cycle' AND b.read_num = w.read_num AND b.cycle = w.cycle AND b.prev_bin = w.prev_bin
 LEFT JOIN bn c ON c.level = 'base' AND c.read_num = w.read_num AND c.cycle = w.cycle AND c.base = w.base LEFT JOIN bn d ON d.level = 'cycle' AND d.read_num = w.read_num AND d.cycle = w.cycle""")
def _(v):
    obs = _obs(v)
    wanted = obs.select("read_num", "cycle", "base", "prev_bin").distinct()
    return Q.chosen_level(wanted, Q.bins(Q.histograms(obs))).select("read_num", "cycle", "base", "prev_bin", "level")


def _fragments(v):
    h = H.haplotypes(H.with_sequences(H.segments(v.sv), v.ref))
    f = _tiles(v).join(h.select("event_id", "sequence").hint("merge"), "event_id")
    return f.select("event_id", F.concat(F.lit("ev"), "event_id", F.lit("_"), "attempt").alias("name"), F.substring(F.col("sequence"), (F.col("hap_start") + 1).cast("int"), F.col("frag_len").cast("int")).alias("fragment"))


def _read_ends(v, read_length=50):
    """Fragments as both their ends, which is all that reads are made of, from one pass over the reference.

    Bases are cut as bytes, by place; a fragment below two reads stays whole.
    """
    h = H.haplotypes(H.with_sequences(H.segments(v.sv), v.ref)).withColumn("bases", F.col("sequence").cast("binary")).drop("sequence")
    t = _tiles(v, ("bases",), h)
    cut = lambda at, n: F.substring(F.col("bases"), (F.col("hap_start") + at + 1).cast("int"), n.cast("int"))
    length, one = F.col("frag_len"), F.lit(read_length)
    ends = F.when(length > 2 * read_length, F.concat(cut(F.lit(0), one), cut(length - read_length, one))).otherwise(cut(F.lit(0), length))
    return t.select("event_id", F.concat(F.lit("ev"), "event_id", F.lit("_"), "attempt").alias("name"), ends.cast("string").alias("fragment"))


@q("syn_read")
def _(v):
    """Emitted read pairs of all tiled fragments, by one profile of all pairs; their bases are tested by statistics."""
    from ..operators import emission

    bins = Q.bins(Q.histograms(_obs(v))).collect()
    profile = [(r.level, r.read_num, r.cycle, r.base, r.prev_bin, [(x.q, x.n) for x in r.run]) for r in bins]
    return emission.emitted(_read_ends(v), profile, 50)


@q("syn_read_seq", f"WITH {_TILE} SELECT event_id, concat('ev', event_id, '_', attempt) AS name, substr(sequence, CAST(hap_start + 1 AS INT), 50) AS seq1, translate(reverse(substr(sequence, CAST(hap_start + frag_len - 49 AS INT), 50)), 'ACGT', 'TGCA') AS seq2 FROM til JOIN hp USING (event_id)")
def _(v):
    """Both reads as their haplotype has them, without errors."""
    from ..operators import emission

    return emission.emitted(_fragments(v), [], 50, errors=False).select("event_id", "name", "seq1", "seq2")


# --- checks of a whole result, and calls against the truth

_CALLS = "cl AS (SELECT event_id AS call_id, concat('chr', event_id % 5 + 1) AS chrom, start + event_id * 37 % 1300 - 650 AS start, \"end\" + event_id * 53 % 1300 - 650 + CASE WHEN event_id % 7 = 0 THEN 2000 ELSE 0 END AS stop FROM sv WHERE sv_type = 'DEL' AND event_id % 5 <> 0)"
_MATCH = f"""{_CALLS}, cand AS (SELECT s.event_id, c.call_id, abs(s.start - c.start) AS start_distance, abs(s."end" - c.stop) AS end_distance, least(s."end" - s.start, c.stop - c.start)::DOUBLE / greatest(s."end" - s.start, c.stop - c.start) AS size_ratio FROM sv s JOIN cl c ON s.sv_type = 'DEL' AND c.chrom = s.chrom AND abs(s.start - c.start) <= 500 AND abs(s."end" - c.stop) <= 500),
 rk AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY start_distance + end_distance, call_id) AS of_truth, row_number() OVER (PARTITION BY call_id ORDER BY start_distance + end_distance, event_id) AS of_call FROM cand WHERE size_ratio >= 0.5), mt AS (SELECT event_id, call_id, start_distance, end_distance, size_ratio FROM rk WHERE of_truth = 1 AND of_call = 1)"""


def _calls(v):
    d = v.sv.where("sv_type = 'DEL' and event_id % 5 <> 0")
    return d.selectExpr("event_id call_id", "concat('chr', event_id % 5 + 1) chrom", "start + event_id * 37 % 1300 - 650 start", "`end` + event_id * 53 % 1300 - 650 + CASE WHEN event_id % 7 = 0 THEN 2000 ELSE 0 END `end`")


@q("join_truth_call", f"WITH {_MATCH} SELECT event_id, call_id, start_distance, end_distance, round(size_ratio, 9) AS size_ratio FROM mt")
def _(v):
    m = V.matched_calls(v.sv.where("sv_type = 'DEL'"), _calls(v))
    return m.withColumn("size_ratio", F.round("size_ratio", 9))


@q("agg_prf", f"""WITH {_MATCH}, n AS (SELECT (SELECT count(*) FROM mt) AS tp, (SELECT count(*) FROM cl) - (SELECT count(*) FROM mt) AS fp, (SELECT count(*) FROM sv WHERE sv_type = 'DEL') - (SELECT count(*) FROM mt) AS fn)
 SELECT tp, fp, fn, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1 FROM n""")
def _(v):
    s = V.call_score(v.sv.where("sv_type = 'DEL'"), _calls(v))
    return s.select("tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("recall", "precision", "f1")])


_GREEDY = f"""WITH {_MATCH} -- recursive
, o AS (SELECT *, row_number() OVER (ORDER BY start_distance + end_distance, event_id, call_id) AS k FROM cand WHERE size_ratio >= 0.5),
 g AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS es, CAST([] AS BIGINT[]) AS cs UNION ALL
  SELECT o.k, CASE WHEN list_contains(es, event_id) OR list_contains(cs, call_id) THEN es ELSE list_append(es, event_id) END, CASE WHEN list_contains(es, event_id) OR list_contains(cs, call_id) THEN cs ELSE list_append(cs, call_id) END FROM g JOIN o ON o.k = g.k + 1),
 taken AS (SELECT unnest(es) AS event_id, unnest(cs) AS call_id FROM (SELECT * FROM g ORDER BY k DESC LIMIT 1)), gm AS (SELECT o.* FROM o JOIN taken USING (event_id, call_id))"""


@q("join_truth_call_all", f"{_GREEDY} SELECT event_id, call_id, start_distance, end_distance, round(size_ratio, 9) AS size_ratio FROM gm")
def _(v):
    """Truth events and calls matched one to one until no pair is left, which is what taking pairs by distance gives."""
    m = V.matched_calls(v.sv.where("sv_type = 'DEL'"), _calls(v), rounds=None)
    return m.withColumn("size_ratio", F.round("size_ratio", 9))


@q("agg_prf_all", f"""{_GREEDY}, n AS (SELECT (SELECT count(*) FROM gm) AS tp, (SELECT count(*) FROM cl) - (SELECT count(*) FROM gm) AS fp, (SELECT count(*) FROM sv WHERE sv_type = 'DEL') - (SELECT count(*) FROM gm) AS fn)
 SELECT tp, fp, fn, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1 FROM n""")
def _(v):
    s = V.call_score(v.sv.where("sv_type = 'DEL'"), _calls(v), rounds=None)
    return s.select("tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("recall", "precision", "f1")])


def _driver_sql() -> str:
    from .queries_intervals import QUERIES as I_Q, _COVER

    def one(name: str, sql: str) -> str:
        return f"SELECT '{name}' AS \"check\", count(*) AS total, count(CASE WHEN pass THEN 1 END) AS passed FROM ({sql})"

    usable = "SELECT avg(tlen) BETWEEN 50 AND 1000 AND stddev_pop(tlen) BETWEEN 5 AND 300 AS pass FROM (SELECT tlen FROM aln WHERE (flag & 2308) = 0 AND (flag & 2) <> 0 AND (flag & 8) = 0 AND (flag & 192) <> 0 AND tlen > 0 ORDER BY chrom, pos, name, read_num LIMIT 50000)"
    parts = [("coverage", _COVER), ("split_reads", I_Q["chk_split"][1]), ("allele_fraction", QUERIES["chk_af"][1]), ("insert_size", usable), ("duplicate_rate", I_Q["chk_dup"][1]), ("mapping_quality", I_Q["chk_mapq"][1])]
    return " UNION ALL ".join(one(*p) for p in parts)


@q("chk_driver", _driver_sql())
def _(v):
    """Which checks run for which events, and how many of each pass."""
    c = V.run(v.sv, v.reads, v.aln, ["chrom", "pos", "name", "read_num"], min_flank_depth=0.0)
    return c.groupBy("check").agg(F.count("*").alias("total"), F.count_if("pass").alias("passed"))


@q("chk_driver_each", _driver_sql())
def _(v):
    """The same checks, each as a job of its own, so that one that fails leaves the others."""
    checks, _ = V.run_each(V.parts(v.sv, v.reads, v.aln, ["chrom", "pos", "name", "read_num"], min_flank_depth=0.0))
    return checks.groupBy("check").agg(F.count("*").alias("total"), F.count_if("pass").alias("passed"))
