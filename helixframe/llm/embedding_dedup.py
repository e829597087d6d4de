"""Near-duplicate vectors by random-hyperplane signs, exact cosines and components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, prepare
from .graph import components

#: Recall aimed at for pairs exactly at the least cosine; nearer pairs are found oftener.
RECALL = 0.999
#: Vectors that a bucket has on average, and that one block of a bucket's pairs takes from each side.
BUCKET, TILE = 64, 512


def tables_for(n: int, least_cosine: float, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a signature, tables): buckets of about BUCKET vectors, and as many tables as reach recall."""
    bits = max(6, min(60, math.ceil(math.log2(max(2, n) / BUCKET))))
    p = (1 - math.acos(least_cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def signatures(v: np.ndarray, bits: int, tables: int, seed: int = 7) -> np.ndarray:
    """One code a table for each row of v; hyperplanes are fixed by seed, table and dimension."""
    out = np.empty((len(v), tables), np.int64)
    for t in range(tables):
        planes = np.random.Generator(np.random.Philox(key=[seed, t])).standard_normal((v.shape[1], bits))
        out[:, t] = ((v @ planes) > 0) @ (1 << np.arange(bits, dtype=np.int64))
    return out


def _vectors(column: pa.Array) -> tuple[list[int], list[bytes]]:
    """Rows that can link (not null, no null or non-finite component, not zero), and their values' bytes."""
    good, out = [], []
    for i, x in enumerate(column):
        if x.is_valid and len(x.values) and not x.values.null_count:
            v = x.values.to_numpy(zero_copy_only=False)
            if np.isfinite(v).all() and v.any():
                good.append(i)
                out.append(v.tobytes())
    return good, out


def _units(packed: list[bytes], dtype) -> np.ndarray:
    """Vectors of one length in double precision, scaled so that no square overflows or vanishes, with norm 1."""
    v = np.stack([np.frombuffer(x, dtype) for x in packed]).astype(np.float64)
    v /= np.abs(v).max(1)[:, None]
    return v / np.sqrt((v * v).sum(1))[:, None]


def near_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least_cosine: float = 0.9, recall: float = RECALL) -> DataFrame:
    """(id, n_links, component_id) for every row of table.

    Rows link whose cosine in double precision is at least least_cosine. n_links counts the
    other rows linked directly, component_id is the smallest id reachable. Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing, nor do vectors
    of different lengths. Rows that repeat an id are vectors of their own and each gets what
    they have together: the sum of their links and the smallest of their components. Rows with
    a null id link with nothing. Further columns are not read.

    Equal vectors form a class that travels once. Candidates share a signature in one of the
    tables (tables_for gives their number for the recall). A bucket is cut into tiles, and its
    pairs are judged where two tiles meet, in the first table that has the pair together.
    Only counts and one edge for each joined part of a tile leave it, not its pairs.
    """
    spark = table.sparkSession
    prepare(spark)

    dtype = {"array<float>": np.float32}.get(dict(table.dtypes)[vector_col], np.float64)
    element = "float" if dtype is np.float32 else "double"

    def pack(batches):
        for batch in batches:
            good, vs = _vectors(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good, pa.int64())), pa.array(vs, pa.binary())], ["id", "v"])

    packed = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{element}>").alias("v")).where("id is not null").mapInArrow(pack, "id long, v binary")
    packed = cut(packed.withColumn("class", F.md5("v")))
    classes = packed.groupBy("class").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v"))
    classes = cut(classes.withColumn("node", F.xxhash64("class")))  # tells classes apart that have one representative
    n = classes.count()
    bits, tables = tables_for(n, least_cosine, recall)

    def sign(batches):
        for batch in batches:
            vs = batch.column(3).to_pylist()
            codes = np.empty((len(vs), tables), np.int64)
            length = np.array([len(v) for v in vs], np.int64)
            for d in np.unique(length):
                at = np.flatnonzero(length == d)
                codes[at] = signatures(_units([vs[i] for i in at], dtype), bits, tables)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(length), pa.array(list(codes), pa.list_(pa.int64()))], ["rep", "node", "n", "v", "d", "codes"])

    signed = cut(classes.select("rep", "node", "n", "v").mapInArrow(sign, "rep long, node long, n long, v binary, d long, codes array<long>"))
    entries = signed.select("rep", "d", F.posexplode("codes").alias("t", "code"))
    sizes = entries.groupBy("t", "code", "d").agg(F.count("*").alias("size")).where("size > 1")
    tiled = cut(sizes.select("t", "code", "d", F.ceil(F.col("size") / TILE).cast("int").alias("g")))
    placed = signed.select("rep", "node", "n", "v", "d", F.posexplode("codes").alias("t", "code")).join(tiled, ["t", "code", "d"])
    placed = placed.withColumn("i", F.pmod(F.xxhash64("node", "t"), F.col("g")).cast("int"))
    met = placed.select("t", "code", "d", "rep", "node", "n", "v", "i", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("j"))
    met = met.withColumn("x", F.least("i", "j")).withColumn("y", F.greatest("i", "j"))

    def judge(key, rows):
        rep, node, n, tile = (rows.column(c).to_numpy() for c in ("rep", "node", "n", "i"))
        v = _units(rows.column("v").to_pylist(), dtype)
        t, x, y = key[0].as_py(), key[3].as_py(), key[4].as_py()
        links, edges = np.zeros(len(rep), np.int64), []
        left = np.flatnonzero(tile == x)
        right = left if x == y else np.flatnonzero(tile == y)
        for a0 in range(0, len(left), 256):
            a = left[a0 : a0 + 256]
            near = (v[a] @ v[right].T) >= least_cosine
            if x == y:
                near &= a[:, None] < right[None, :]
            i, j = np.nonzero(near)
            i, j = a[i], right[j]
            if t and len(i):  # pairs that an earlier table has together were judged there
                used, back = np.unique(np.concatenate([i, j]), return_inverse=True)
                codes = signatures(v[used], bits, t)
                first = np.ones(len(i), bool)
                for s in range(t):
                    first &= codes[back[: len(i)], s] != codes[back[len(i) :], s]
                i, j = i[first], j[first]
            np.add.at(links, i, n[j])
            np.add.at(links, j, n[i])
            edges.append((i, j))
        root = np.arange(len(rep))

        def find(k):
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        joined = []
        for i, j in edges:
            for p, q in zip(i.tolist(), j.tolist()):
                p, q = find(p), find(q)
                if p != q:
                    root[max(p, q)] = min(p, q)
                    joined.append((p, q))
        hit = np.flatnonzero(links)
        none = np.zeros(0, np.int64)
        a, b = (np.array(z, np.int64) for z in zip(*joined)) if joined else (none, none)
        return pa.table({"a": np.concatenate([node[hit], rep[a]]), "links": pa.array([*links[hit].tolist(), *[None] * len(a)], pa.int64()), "b": pa.array([*[None] * len(hit), *rep[b].tolist()], pa.int64())})

    judged = cut(met.groupBy("t", "code", "d", "x", "y").applyInArrow(judge, "a long, links long, b long"))
    found = components(judged.where("b is not null").select("a", "b"))
    counts = judged.where("links is not null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    per_class = classes.join(counts, "node", "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    per_class = per_class.select("class", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = packed.join(per_class, "class").groupBy("id").agg(F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = table.select(F.col(id_col).alias("id")).join(linked, "id", "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").cast("long").alias("component_id"))
