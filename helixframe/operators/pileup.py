"""Bases by position, heterozygous sites and what they say of each read."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..shipping import ship
from .intervals import overlap_join


#: Positions of one vector of counts, a power of two, and those that one row of sites covers.
BIN, SITES = 1024, 64


def aligned_blocks(cigar: Column, pos: Column) -> Column:
    """An array of (ref, seq, len): the stretches of M, = and X, by one pass over the CIGAR's operations in the row."""
    number = F.substring(cigar, F.lit(1), F.length(cigar) - 1).cast("bigint")
    whole = F.array(F.struct(pos.cast("bigint").alias("ref"), F.lit(0).cast("bigint").alias("seq"), number.alias("len")))
    ops = F.transform(F.regexp_extract_all(cigar, F.lit("([0-9]+)([MIDNSHP=X])"), F.lit(0)), lambda x: F.struct(F.expr("1").alias("_"), F.substring(x, -1, 1).alias("op"), F.regexp_replace(x, "[^0-9]", "").cast("bigint").alias("n")))
    start = F.struct(pos.cast("bigint").alias("ref"), F.lit(0).cast("bigint").alias("seq"), F.expr("cast(array() as array<struct<ref:bigint,seq:bigint,len:bigint>>)").alias("out"))

    def step(a, x):
        both, seq_only, ref_only = x["op"].isin("M", "=", "X"), x["op"].isin("I", "S"), x["op"].isin("D", "N")
        block = F.array(F.struct(a["ref"].alias("ref"), a["seq"].alias("seq"), x["n"].alias("len")))
        return F.struct((a["ref"] + F.when(both | ref_only, x["n"]).otherwise(0)).alias("ref"), (a["seq"] + F.when(both | seq_only, x["n"]).otherwise(0)).alias("seq"), F.when(both, F.concat(a["out"], block)).otherwise(a["out"]).alias("out"))

    return F.when(cigar.rlike("^[0-9]+[M=X]$"), whole).otherwise(F.aggregate(ops, start, step)["out"])


def blocks(aln: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each aligned block: keep, chrom, ref (0-based, of its first base), bases, quals. Blocks are cut at the sequence's end."""
    each = aln.select(*keep, "chrom", "seq", "qual", F.explode(aligned_blocks(F.col("cigar"), F.col("pos"))).alias("b"))
    part = lambda c: F.substring(F.col(c), (F.col("b.seq") + 1).cast("int"), F.col("b.len").cast("int"))
    return each.select(*keep, "chrom", F.col("b.ref").alias("ref"), F.upper(part("seq")).alias("bases"), part("qual").alias("quals"))


def _cut(blocks_: DataFrame, keep: list[str], width: int) -> DataFrame:
    """Blocks cut at multiples of width: keep, chrom, bin, ref, bases."""
    n = F.length("bases")
    each = blocks_.select(*keep, "chrom", "ref", "bases", F.explode(F.when(n > 0, F.sequence(F.floor(F.col("ref") / width), F.floor((F.col("ref") + n - 1) / width)))).alias("bin"))
    lo = F.greatest("ref", F.col("bin") * width)
    hi = F.least(F.col("ref") + n, (F.col("bin") + 1) * width)
    return each.select(*keep, "chrom", "bin", lo.alias("ref"), F.substring("bases", (lo - F.col("ref") + 1).cast("int"), (hi - lo).cast("int")).alias("bases"))


def bases(aln: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each aligned base: keep, chrom, p (0-based), base, q. Filter alignments to regions before."""
    each = blocks(aln, keep).select(*keep, "chrom", "ref", "bases", "quals", F.explode(F.when(F.length("bases") > 0, F.sequence(F.lit(1), F.length("bases")))).alias("i"))
    return each.select(*keep, "chrom", (F.col("ref") + F.col("i") - 1).alias("p"), F.substring(F.col("bases"), F.col("i"), F.lit(1)).alias("base"), (F.ascii(F.substring(F.col("quals"), F.col("i"), F.lit(1))) - 33).alias("q"))


def _counted(each: DataFrame, *keys: str) -> DataFrame:
    n = [F.count_if(F.col("base") == b).alias("n_" + b.lower()) for b in "ACGT"]
    return each.where(F.col("base").isin("A", "C", "G", "T")).groupBy(*keys).agg(*n)


def counts(each: DataFrame) -> DataFrame:
    """(chrom, p, n_a, n_c, n_g, n_t): bases by position; other symbols don't count."""
    return _counted(each, "chrom", "p")


def _offsets(cigar: str) -> tuple[np.ndarray, np.ndarray]:
    """For each aligned base how far it lies from the alignment's start, on the reference and in the sequence."""
    ref, seq, at_ref, at_seq = [], [], 0, 0
    for n, op in re.findall("([0-9]+)([MIDNSHP=X])", cigar):
        n = int(n)
        if op in "M=X":
            ref.append(np.arange(at_ref, at_ref + n))
            seq.append(np.arange(at_seq, at_seq + n))
        at_ref += n if op in "MDN=X" else 0
        at_seq += n if op in "MIS=X" else 0
    return (np.concatenate(ref), np.concatenate(seq)) if ref else (np.zeros(0, np.int64),) * 2


_CODE = np.full(256, 4, np.uint8)
for _i, _b in enumerate("ACGT"):
    _CODE[[ord(_b), ord(_b.lower())]] = _i


class Counts:
    """Counts of the four bases at each position, one vector for each (chromosome, bin) met; at most `most` of them."""

    def __init__(self, width: int, most: int):
        self.width, self.most = width, most
        self.chroms: dict[str, int] = {}
        self.held: dict[tuple[int, int], np.ndarray] = {}
        self.known: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, batch: pa.RecordBatch) -> None:
        seqs = batch.column("seq").cast(pa.large_binary())
        _, offsets, data = seqs.buffers()
        begin = np.frombuffer(offsets, np.int64)[seqs.offset : seqs.offset + len(seqs) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        length, pos = np.diff(begin), batch.column("pos").to_numpy()
        chroms = batch.column("chrom").dictionary_encode()
        number = np.array([self.chroms.setdefault(c, len(self.chroms)) for c in chroms.dictionary.to_pylist()], np.int64)[chroms.indices.to_numpy()]
        cigars = batch.column("cigar").dictionary_encode()
        which = cigars.indices.to_numpy()
        order = np.argsort(which, kind="stable")
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(which[order])) + 1, [len(order)]]) if len(order) else np.zeros(1, np.int64)
        keys, size = [], 0
        for a, b in zip(cuts[:-1], cuts[1:]):
            cigar = cigars.dictionary[int(which[order[a]])].as_py()
            if cigar not in self.known:
                if len(self.known) > 4096:
                    self.known.clear()
                self.known[cigar] = _offsets(cigar)
            ref, seq = self.known[cigar]
            step = max(1, (1 << 20) // max(1, len(ref)))
            for k in range(int(a), int(b), step):
                rows = order[k : min(k + step, int(b))]
                there = seq < length[rows][:, None]
                code = _CODE[data[np.where(there, begin[rows][:, None] + seq, 0)]] if len(data) else np.full(there.shape, 4, np.uint8)
                place = (number[rows][:, None] << 40 | pos[rows][:, None] + ref) << 2 | code
                keys.append(place[there & (code < 4)])
                size += keys[-1].size
                if size > 1 << 21:
                    self._count(keys)
                    keys, size = [], 0
        self._count(keys)

    def _count(self, keys: list[np.ndarray]) -> None:
        every = np.concatenate([np.zeros(0, np.int64), *keys])
        low = every.min(initial=1 << 62)
        if len(every) and every.max() - low < 8 * len(every):  # in order, so the range is narrow
            n = np.bincount(every - low)
            found = np.flatnonzero(n)
            n, found = n[found], found + low
        else:
            found, n = np.unique(every, return_counts=True)
        bins = (found >> 2) // self.width  # chromosomes begin at multiples of the width, a power of two
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(bins)) + 1, [len(found)]]) if len(found) else np.zeros(1, np.int64)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            k = int(bins[a])
            if k not in self.held:
                self.held[k] = np.zeros(4 * self.width, np.int64)
            self.held[k][found[a:b] - 4 * self.width * k] += n[a:b]

    def full(self) -> bool:
        return len(self.held) > self.most

    def rows(self) -> Iterator[pa.RecordBatch]:
        """(chrom, p, n_a, n_c, n_g, n_t) of all positions with a base; the counts begin anew."""
        names = list(self.chroms)
        keys = sorted(self.held)
        for i in range(0, len(keys), 64):
            some = keys[i : i + 64]
            n = np.stack([self.held[k].reshape(self.width, 4) for k in some])
            at, place = np.nonzero(n.any(2))
            p = np.array(some, np.int64)[at] * self.width + place
            chrom = pa.DictionaryArray.from_arrays(pa.array((p >> 40).astype(np.int32)), pa.array(names, pa.string())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([chrom, pa.array(p & (1 << 40) - 1), *(pa.array(n[at, place, b]) for b in range(4))], ["chrom", "p", "n_a", "n_c", "n_g", "n_t"])
        self.held.clear()


def piled(aln: DataFrame, width: int = BIN, most: int = 1024, ordered: bool = False) -> DataFrame:
    """counts() of all aligned bases.

    Alignments are dealt by stretches of the chromosome, of which AQE splits crowded ones over
    several tasks, and put in order; those that come in order, as a BAM file has them, need
    neither (ordered). A task adds its bases up in a vector for each (chrom, bin), and gives
    them away when it holds more than `most`; then positions are added up over the tasks. So a
    place of any depth is one row a task.
    """
    ship(aln.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counts(width, most)
        for batch in batches:
            held.add(batch)
            if held.full():
                yield from held.rows()
        yield from held.rows()

    rows = aln.select("chrom", F.col("pos").cast("long").alias("pos"), "cigar", "seq").where("chrom is not null and pos >= 0 and cigar is not null and seq is not null")
    if not ordered:
        rows = rows.withColumn("__bin", F.shiftright("pos", 16)).hint("rebalance", F.col("chrom"), F.col("__bin")).sortWithinPartitions("chrom", "pos").drop("__bin")
    part = rows.mapInArrow(count, "chrom string, p long, n_a long, n_c long, n_g long, n_t long")
    return part.groupBy("chrom", "p").agg(*[F.sum("n_" + b).alias("n_" + b) for b in "acgt"])


def at_sites(aln: DataFrame, sites: DataFrame, keep: list[str]) -> DataFrame:
    """keep, chrom, p, base and the other columns of sites (chrom, p, ...): the bases that alignments have at the sites.

    Blocks meet the sites of a bin as one array, so bases elsewhere never become rows.
    """
    more = [c for c in sites.columns if c != "chrom"]
    binned = sites.groupBy("chrom", F.floor(F.col("p") / SITES).alias("bin")).agg(F.collect_list(F.struct(*more)).alias("sites"))
    met = _cut(blocks(aln, keep), keep, SITES).join(binned, ["chrom", "bin"])
    inside = F.filter("sites", lambda s: (s["p"] >= F.col("ref")) & (s["p"] < F.col("ref") + F.length("bases")))
    each = met.select(*keep, "chrom", "ref", "bases", F.explode(inside).alias("s")).select(*keep, "chrom", "s.*", "ref", "bases")
    return each.withColumn("base", F.substring("bases", (F.col("p") - F.col("ref") + 1).cast("int"), F.lit(1))).drop("ref", "bases")


def piled_at(aln: DataFrame, sites: DataFrame) -> DataFrame:
    """counts() at the given sites (chrom, p) only."""
    return counts(at_sites(aln, sites.select("chrom", "p").distinct(), []))


def good_bases(aln: DataFrame, regions: DataFrame, key: str, least_quality: int = 20) -> DataFrame:
    """(key, n): aligned bases of at least least_quality in each region (key, g_chrom, g_start, g_end); regions without any are left out."""
    b = blocks(aln, []).withColumn("stop", F.col("ref") + F.length("bases")).select("chrom", "ref", "stop", "quals")
    j = overlap_join(b, regions, ("chrom", "ref", "stop"), ("g_chrom", "g_start", "g_end"))
    lo, hi = F.greatest("ref", "g_start"), F.least("stop", "g_end")
    inside = F.substring("quals", (lo - F.col("ref") + 1).cast("int"), (hi - lo).cast("int"))
    return j.groupBy(key).agg(F.sum(F.regexp_count(inside, F.lit(f"[\\x{33 + least_quality:02X}-~]"))).alias("n"))


def het_sites(pile: DataFrame, least: int = 10, lo: float = 0.2, hi: float = 0.8) -> DataFrame:
    """(chrom, p, allele1, allele2): at least least bases, and the two commonest ones each from lo to hi of them; ties by base."""
    total = sum((F.col("n_" + b) for b in "acgt"), F.lit(0))
    ranked = F.array_sort(F.array(*[F.struct((-F.col("n_" + b)).alias("n"), F.lit(i).alias("i"), F.lit(b.upper()).alias("b")) for i, b in enumerate("acgt")]))
    d = pile.withColumn("total", total).withColumn("r", ranked)
    share = lambda k: -F.col("r")[k]["n"] / F.col("total")
    return d.where((F.col("total") >= least) & share(0).between(lo, hi) & share(1).between(lo, hi)).select("chrom", "p", F.col("r")[0]["b"].alias("allele1"), F.col("r")[1]["b"].alias("allele2"))


def read_votes(each: DataFrame, sites: DataFrame, other_alleles: str = "listed") -> DataFrame:
    """(name, target_n, other_n, side): how many sites of a read carry the target allele or another one.

    sites: chrom, p, target, other. other_alleles "listed" counts the site's other allele
    only, "any" every base but N, as sites known beforehand are counted.
    """
    return votes(each.join(sites, ["chrom", "p"]), other_alleles)


def votes(j: DataFrame, other_alleles: str = "listed", by: list[str] | None = None) -> DataFrame:
    """read_votes() of bases that already stand beside their sites, as at_sites() gives them, for each name or each of by."""
    other = F.col("base") == F.col("other") if other_alleles == "listed" else ~F.col("base").isin("N") & (F.col("base") != F.col("target"))
    v = j.groupBy(*(by or ["name"])).agg(F.count_if(F.col("base") == F.col("target")).alias("target_n"), F.count_if(other).alias("other_n")).where("target_n + other_n > 0")
    return v.withColumn("side", F.when(F.col("target_n") > F.col("other_n"), "target").when(F.col("target_n") < F.col("other_n"), "other").otherwise("tie"))


def allele_balance(pile: DataFrame, snps: DataFrame, keys: list[str], least: int = 10) -> DataFrame:
    """(keys, n_sites, mean, median, max_deviation): alternative share of the given SNPs (keys, chrom, p, ref, alt) with enough of both bases."""
    pick = lambda c: F.coalesce(*[F.when(F.col(c) == b.upper(), F.col("n_" + b)) for b in "acgt"])
    j = snps.join(pile, ["chrom", "p"]).withColumn("r", pick("ref")).withColumn("a", pick("alt")).where(F.col("r") + F.col("a") >= least)
    j = j.withColumn("baf", F.col("a") / (F.col("r") + F.col("a")))
    return j.groupBy(*keys).agg(F.count("*").alias("n_sites"), F.avg("baf").alias("mean"), F.median("baf").alias("median"), F.max(F.abs(F.col("baf") - 0.5)).alias("max_deviation"))
