"""Centroid clustering against plain rounds in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from helixframe.llm import centroids, queries


def plain(rows, k, rounds, dimension, scale=256, seed="2"):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [max(-centroids.MOST, min(centroids.MOST, math.floor(scale * float(np.float32(x))))) for x in v]))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    c = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, sha(f"{seed}:{r[0]}") if r[0] is not None else "", r[1]))[:k]]
    assign = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, row)), j) for j, row in enumerate(c))
    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(assign(v)[1], []).append(v)
        for j, vs in members.items():
            c[j] = [sum(col) // len(vs) for col in zip(*vs)]
    at = [(i, *assign(v)) for i, v in kept]
    inertia = {}
    for _, d, j in at:
        inertia[j] = inertia.get(j, 0) + d
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), sha(",".join(map(str, c[j])))) for i, d, j in at), key=str)


def table(seed, n, dimension, groups):
    r = random.Random(seed)
    middle = [[r.uniform(-1, 1) for _ in range(dimension)] for _ in range(groups)]
    rows = [(i, [x + r.gauss(0, 0.3) for x in r.choice(middle)]) for i in range(n)]
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1])]  # repeated and null ids, equal vectors
    rows += [(n + i, rows[7][1]) for i in range(30)]
    rows += [(n + 50, None), (n + 51, []), (n + 52, rows[0][1][:-1]), (n + 53, [None, *rows[0][1][1:]]), (n + 54, [float("nan"), *rows[0][1][1:]]), (n + 55, [float("inf"), *rows[0][1][1:]]), (n + 56, [0.0] * dimension), (n + 57, [-1e30, *rows[0][1][1:]])]
    return rows


@pytest.mark.parametrize("dimension,k,rounds,groups", [(8, 40, 5, 9), (3, 17, 8, 30), (2, 5, 3, 2), (4, 1, 2, 3)])
def test_rounds_by_definition(spark, dimension, k, rounds, groups):
    rows = table(dimension, 400, dimension, groups)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, cluster int, x int").repartition(3)
    got = centroids.clusters(df, k=k, rounds=rounds, dimension=dimension)
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, k, rounds, dimension)


def test_ties_few_and_no_vectors(spark):
    square = [(i, [float(i % 5), float(i // 5)]) for i in range(25)] * 2  # many equal distances
    df = spark.createDataFrame(square, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, centroids.clusters(df, k=9, rounds=6, dimension=2, scale=2).collect()), key=str) == plain(square, 9, 6, 2, 2)
    few = square[:3]
    df = spark.createDataFrame(few, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, centroids.clusters(df, k=40, rounds=2, dimension=2).collect()), key=str) == plain(few, 40, 2, 2)
    assert centroids.clusters(df, dimension=64).count() == 0


def test_bounds_hold_and_save_rescans():
    """Every round's bounds are true for all centroids, and most vectors need no full rescan once the centroids settle."""
    r = np.random.Generator(np.random.Philox(4))
    middle = r.normal(0, 200, (60, 16))
    x = np.floor(middle[r.integers(0, 60, 4000)] + r.normal(0, 40, (4000, 16))).astype(np.int64)
    c, b = x[:40].copy(), 10
    bounds, _ = centroids.scan(x, c, b)
    rescans = []
    for _ in range(15):
        new = np.stack([x[bounds.cluster == j].sum(0) // max(1, (bounds.cluster == j).sum()) for j in range(40)])
        moved = np.sqrt(((new - c) ** 2).sum(1).astype(float))
        c = new
        bounds, need = centroids.reassign(x, c, moved, bounds, b)
        d = np.sqrt(((x[:, None] - c[None]) ** 2).sum(2).astype(float))
        assert (bounds.cluster == d.argmin(1)).all() and (bounds.upper >= d[np.arange(4000), bounds.cluster]).all()
        assert (bounds.lower <= np.take_along_axis(d, bounds.near, 1)).all()
        others = np.ones_like(d, bool)
        np.put_along_axis(others, bounds.near, False, 1)
        others[np.arange(4000), bounds.cluster] = False
        assert (np.where(others, d, np.inf).min(1) >= bounds.rest).all()
        rescans.append((need == b).mean())
        b = max(5, min(b, int(need.max())))
    assert rescans[-1] < 0.2 and (need < 0).mean() > 0.3


def test_query_matches_definition(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = queries.op11_centroids(spark, sf).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, 40, 5, 64)
