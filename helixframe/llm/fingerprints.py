"""Document fingerprints by locally consistent parsing.

Deterministic coin tossing gives every symbol of a text a small label that depends only on
the few symbols before it; local minima of the labels cut the text into phrases, a phrase's
name is a hash of its symbols, and the names are the symbols of the next level. Equal
substrings so have the same phrases inside, wherever they stand.
"""

from __future__ import annotations

import base64
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import prepare
from .textblocks import BLOCK_BYTES, mix, powers

#: Names that a fingerprint keeps of levels 1, 2 and 3: the least hashes, 32 bits of each.
KEPT = (16, 32, 48)
#: A level is compared if both texts kept so many names of it, else a lower one.
LEAST_NAMES = 8
#: Rounds of coin tossing: 64-bit symbols become labels under 128, 14, 8.
ROUNDS = 3


def labels(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Labels below 8 of symbols that differ from their predecessors within rows."""
    heads = at[:-1][at[:-1] < at[1:]]
    for _ in range(ROUNDS):
        d = np.empty_like(x)
        d[1:] = x[1:] ^ x[:-1]
        d[heads] = 1
        d[d == 0] = 1
        low = np.bitwise_count((d & (~d + np.uint64(1))) - np.uint64(1)).astype(np.uint64)
        x = low * np.uint64(2) + ((x >> low) & np.uint64(1))
    return x.astype(np.int8)


def parse(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The names of one level's phrases and the rows' bounds; x are the symbols of all rows, at their bounds."""
    if not len(x):
        return x, at
    heads = at[:-1][at[:-1] < at[1:]]
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    new[heads] = True
    first = np.flatnonzero(new)
    length = np.diff(first, append=len(x)).astype(np.uint64)
    y = x[first]
    y = np.where(length > 1, mix(y + length * np.uint64(0x9E3779B97F4A7C15)), y)  # a run is one symbol
    at = np.searchsorted(first, at)
    heads = at[:-1][at[:-1] < at[1:]]
    lab = labels(y, at)
    start = np.zeros(len(y), bool)
    start[1:-1] = (lab[1:-1] < lab[:-2]) & (lab[1:-1] < lab[2:])
    tails = heads[1:] - 1
    start[tails] = False  # a row's last symbol has no right neighbour in it
    start[heads] = True
    first = np.flatnonzero(start)
    end = np.append(first[1:], len(y))
    up, down = powers(len(y) + 1)
    total = np.zeros(len(y) + 1, np.uint64)
    np.cumsum(y * up[: len(y)], out=total[1:])
    return mix((total[end] - total[first]) * down[first] + (end - first).astype(np.uint64)), np.searchsorted(first, at)


def levels(texts: list[str], n: int = len(KEPT)) -> list[tuple[np.ndarray, np.ndarray]]:
    """Names and row bounds of levels 1 to n."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=at[1:])
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    x = mix(points.astype(np.uint64) + np.uint64(1))
    out = []
    for _ in range(n):
        x, at = parse(x, at)
        out.append((x, at))
    return out


def fingerprints(texts: list[str], kept: tuple[int, ...] = KEPT) -> list[list[np.ndarray]]:
    """Of each text, the least distinct names of every level, as sorted 32-bit numbers."""
    found = [[] for _ in texts]
    for k, (names, at) in zip(kept, levels(texts, len(kept))):
        names = mix(names + np.uint64(k)) >> np.uint64(32)
        for i in range(len(texts)):
            found[i].append(np.unique(names[at[i] : at[i + 1]])[:k].astype(np.uint32))
    return found


def spelled(fp: list[np.ndarray]) -> str:
    """A fingerprint as text: the levels' names in base64, separated by dots."""
    return ".".join(base64.b64encode(x.tobytes()).decode() for x in fp)


def read_spelled(s: str) -> list[np.ndarray]:
    return [np.frombuffer(base64.b64decode(x), np.uint32) for x in s.split(".")]


def likeness(x: list[np.ndarray], y: list[np.ndarray], kept: tuple[int, ...] = KEPT) -> float:
    """Estimated share of common phrases among all, from 0 to 1, on the highest level that has LEAST_NAMES of both, else the first."""
    for k, a, b in reversed(list(zip(kept, x, y))):
        if min(len(a), len(b)) >= LEAST_NAMES or a is x[0]:
            break
    if not len(a) and not len(b):
        return 1.0
    union = np.union1d(a, b)[:k]
    return float(len(np.intersect1d(np.intersect1d(a, b, True), union, True)) / len(union))


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) for every row of docs, without a shuffle; null texts count as empty, whose fingerprint has no names."""
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            out = []
            for texts in _chunks(x or "" for x in batch.column(1).to_pylist()):
                out += [spelled(f) for f in fingerprints(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["id", "fingerprint"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"id {dict(slim.dtypes)['id']}, fingerprint string")


def _chunks(texts, size: int = BLOCK_BYTES // 2):
    out, n = [], 0
    for t in texts:
        out.append(t)
        n += len(t)
        if n >= size:
            yield out
            out, n = [], 0
    if out:
        yield out


def followed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, tail, id, h, text): rows in partitions by ranges of id, each range with the row that follows it as its tail.

    Ranges end at approximate quantiles of id, so their number is that of shuffle partitions
    and their sizes are alike however ids are spread; the largest id's range is followed by
    the smallest id. Rows that share an id come in the order of a hash of the text. Rows with
    a null id come first, in the range of the smallest id; across the end only rows with an id
    follow. If no row has an id, the first row in the order of the hashes follows the last.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts = slim.agg(F.percentile_approx("id", [i / n for i in range(1, n)] or [1.0], 10 * n)).first()[0] or []
    cuts = sorted(set(cuts))
    bounds = F.expr("cast(array(" + ",".join(f"{c}L" for c in cuts) + ") as array<bigint>)")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, len(cuts).bit_length())))])
    # how many cuts are at most id, by binary search
    bucket = F.aggregate(steps, F.lit(0), lambda lo, s: F.when((lo + s <= len(cuts)) & (F.coalesce(F.get(bounds, lo + s - 1), F.lit(2**63 - 1)) <= F.col("id")), lo + s).otherwise(lo))
    rows = slim.withColumn("bucket", bucket)
    firsts = [(r.bucket, r.id) for r in rows.where("id is not null").groupBy("bucket").agg(F.min("id").alias("id")).orderBy("bucket").collect()]  # one row for each partition
    after = spark.createDataFrame([(b, firsts[(i + 1) % len(firsts)][1]) for i, (b, _) in enumerate(firsts)], "before int, id long")
    tails = slim.join(F.broadcast(after), "id").select("id", "text", F.col("before").alias("bucket"))
    if not firsts:
        tails = slim.orderBy(F.xxhash64("text")).limit(1).select("id", "text", F.lit(0).alias("bucket"))
    rows = rows.withColumn("bucket", F.when(F.col("id").isNull(), firsts[0][0] if firsts else 0).otherwise(F.col("bucket")))
    both = rows.withColumn("tail", F.lit(0)).unionByName(tails.withColumn("tail", F.lit(1)))
    both = both.select("bucket", "tail", "id", F.xxhash64("text").alias("h"), "text")
    return both.repartitionByRange(n, "bucket").sortWithinPartitions("bucket", "tail", "id", "h")


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_text_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row of docs.

    The edited text has the last n_chars div 4 code points replaced by the first as many, or
    all, of the next row's text by ascending id (after the last: the first). near_edited and
    near_next are the likenesses of the row's fingerprint to those of its edited text and of
    the next row. Null texts count as empty; a single row is its own next. For repeated ids
    and null ids see followed(). Further columns are not read.
    """
    prepare(docs.sparkSession)

    def run(batches):
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)))

        def finish(held):
            """All of held but the last, which is only the next of those before."""
            texts = [r[3] for r in held]
            own = fingerprints(texts)
            here = [i for i in range(len(held) - 1) if not held[i][1] and held[i][0] == held[i + 1][0]]
            edited = []
            for i in here:
                q = len(texts[i]) // 4
                edited.append(texts[i][: len(texts[i]) - q] + texts[i + 1][:q] if q else texts[i])
            new = fingerprints(edited)
            return [(held[i][2], len(texts[i]), hashlib.sha256(e.encode()).hexdigest(), spelled(own[i]), spelled(f), likeness(own[i], f), likeness(own[i], own[i + 1])) for i, e, f in zip(here, edited, new)]

        held, n = [], 0
        for r in rows():
            held.append(r)
            n += len(r[3])
            if n >= BLOCK_BYTES // 2 and len(held) > 1:
                yield batch_of(finish(held))
                held, n = held[-1:], len(held[-1][3])
        yield batch_of(finish(held) if held else [])

    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def batch_of(rows):
        columns = list(zip(*rows)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return followed(docs, id_col, text_col).mapInArrow(run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
