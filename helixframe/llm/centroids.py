"""Exact k-means on integer vectors, with Drake's adaptive distance bounds."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, prepare, stored

#: Scaled components beyond this are set to it, so that every squared distance of up to 512 components fits a long.
MOST = 1 << 26
#: Bounds are moved apart by this share, far more than double and single precision lose.
SLACK = 1e-6
_STATE = "id long, x array<int>, cluster int, upper double, near array<smallint>, lower array<float>, rest double, need int, distance long"


@dataclass
class Bounds:
    """What is known of the distances of m vectors: at most `upper` to their own centroid `cluster`, at least lower[:, r] to near[:, r], at least `rest` to all others."""

    cluster: np.ndarray
    upper: np.ndarray
    near: np.ndarray
    lower: np.ndarray
    rest: np.ndarray


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row of x to every row of c."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= 1 << 20 and x.shape[1] <= 512:  # no sum reaches 2^53
        xf, cf = x.astype(np.float64), c.astype(np.float64)
        return ((xf * xf).sum(1)[:, None] - 2 * (xf @ cf.T) + (cf * cf).sum(1)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], 1)


def scan(x: np.ndarray, c: np.ndarray, b: int) -> tuple[Bounds, np.ndarray]:
    """All distances: the nearest centroid (ties: the smaller number), bounds of the b next ones and of the remainder; and the squared distance."""
    d = squares(x, c)
    order = np.argsort(d, 1, kind="stable")
    rows = np.arange(len(x))[:, None]
    root = np.sqrt(d[rows, order[:, : b + 2]].astype(np.float64))
    rest = root[:, b + 1] * (1 - SLACK) if len(c) > b + 1 else np.full(len(x), np.inf)
    cluster = order[:, 0]
    return Bounds(cluster, root[:, 0] * (1 + SLACK), order[:, 1 : b + 1], root[:, 1 : b + 1] * (1 - SLACK), rest), d[rows[:, 0], cluster]


def own(x: np.ndarray, c: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The squared distance of each row of x to the centroid that which names for it."""
    diff = x - c[which]
    return np.einsum("ij,ij->i", diff, diff)


def reassign(x: np.ndarray, c: np.ndarray, moved: np.ndarray, old: Bounds, b: int) -> tuple[Bounds, np.ndarray]:
    """The exact assignment after every centroid went moved[j] far, and how many of its ordered bounds each vector needed (-1: none, b: a full rescan).

    A vector stays where its upper bound is below all lower bounds. Else its own distance is
    made exact; then only the first centroids of its list are measured, up to the place after
    which all bounds, the remainder's included, are above that distance; where the remainder's
    is not, all centroids are. Bounds beyond the first b of the list join the remainder.
    """
    cluster, upper = old.cluster.copy(), old.upper + moved[old.cluster] * (1 + SLACK)
    lower = old.lower - moved[old.near] * (1 + SLACK)
    rest = np.minimum(old.rest - moved.max(initial=0) * (1 + SLACK), lower[:, b:].min(1, initial=np.inf))
    near, lower = old.near[:, :b].copy(), lower[:, :b]
    width = near.shape[1]
    # above[:, r]: the least bound of the list from place r on, and of the remainder
    above = np.minimum.accumulate(np.concatenate([lower, rest[:, None]], 1)[:, ::-1], 1)[:, ::-1]
    need = np.full(len(x), -1)
    open_ = np.flatnonzero(upper >= above[:, 0])
    mine = own(x[open_], c, cluster[open_])
    upper[open_] = np.sqrt(mine.astype(np.float64)) * (1 + SLACK)
    still = upper[open_] >= above[open_, 0]
    open_, mine = open_[still], mine[still]
    places = (upper[open_][:, None] >= above[open_]).sum(1)  # above ascends, so these are the first ones
    need[open_] = np.minimum(places, b)
    known = places <= width
    some, places, mine = open_[known], places[known], mine[known]
    best, number = mine.copy(), cluster[some].copy()
    exact = np.zeros((len(some), width), np.int64)
    for r in range(int(places.max(initial=0))):
        at = np.flatnonzero(places > r)
        j = near[some[at], r]
        d = exact[at, r] = own(x[some[at]], c, j)
        closer = (d < best[at]) | (d == best[at]) & (j < number[at])
        best[at[closer]], number[at[closer]] = d[closer], j[closer]
    for r in range(int(places.max(initial=0))):  # measured ones get their distance as bound; the new own centroid's place goes to the old one
        at = np.flatnonzero(places > r)
        won = near[some[at], r] == number[at]
        lower[some[at], r] = np.sqrt(np.where(won, mine[at], exact[at, r]).astype(np.float64)) * (1 - SLACK)
        near[some[at[won]], r] = cluster[some[at[won]]]
    cluster[some] = number
    upper[some] = np.sqrt(best.astype(np.float64)) * (1 + SLACK)
    order = np.argsort(lower[some], 1, kind="stable")
    near[some], lower[some] = near[some[:, None], order], lower[some[:, None], order]
    new = Bounds(cluster, upper, near, lower, rest)
    full = open_[~known]
    if len(full):
        found, _ = scan(x[full], c, width)
        for name in ("cluster", "upper", "near", "lower", "rest"):
            getattr(new, name)[full] = getattr(found, name)
    return new, need


def integers(column: pa.Array, dimension: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are kept, floor(scale * component) of each): exactly dimension components, none null or non-finite."""
    at = np.flatnonzero([v.is_valid and len(v.values) == dimension and not v.values.null_count for v in column])
    values = column.take(pa.array(at, pa.int64())).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dimension)
    good = np.isfinite(values).all(1)
    return at[good], np.clip(np.floor(scale * values[good]), -MOST, MOST).astype(np.int64)


def _lists(rows: np.ndarray, kind) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(rows).reshape(-1).astype(kind))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), flat)


def _matrix(column: pa.Array, kind) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _round(c: np.ndarray, moved: np.ndarray | None, b: int, last: bool) -> Callable:
    """One assignment of all vectors as a mapInArrow function; without moved it is the first, with last the distances are made exact."""

    def assign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"), np.int64)
            if moved is None:
                bounds, _ = scan(x, c, b)
                need = np.full(len(x), -1)
            else:
                old = Bounds(*(batch.column(n).to_numpy(zero_copy_only=False).astype(t) for n, t in (("cluster", np.int64), ("upper", np.float64))), _matrix(batch.column("near"), np.int64), _matrix(batch.column("lower"), np.float64), batch.column("rest").to_numpy())
                bounds, need = reassign(x, c, moved, old, b)
            distance = own(x, c, bounds.cluster) if last else np.zeros(len(x), np.int64)
            lower = np.nextafter(bounds.lower.astype(np.float32), np.float32(-np.inf))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("x"), pa.array(bounds.cluster.astype(np.int32)), pa.array(bounds.upper), _lists(bounds.near, np.int16), _lists(lower, np.float32), pa.array(bounds.rest), pa.array(need.astype(np.int32)), pa.array(distance)],
                ["id", "x", "cluster", "upper", "near", "lower", "rest", "need", "distance"],
            )

    return assign


def clusters(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 40, rounds: int = 5, dimension: int = 64, scale: int = 256, seed: str = "2") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every vector that is kept.

    Kept are vectors of exactly dimension (at most 512) components, none null or non-finite;
    a component x becomes floor(scale * x), and what lies beyond +-2^26 becomes +-2^26. The
    centroids begin as the k vectors with the smallest sha256 of '<seed>:<id>', in that order;
    ids that repeat are vectors of their own, ordered by their components; those with a null
    id come last. With fewer than k vectors there are as many centroids. Each round assigns
    every vector to the nearest centroid (squared distance; ties: the smaller number) and puts
    floor(sum / count) in the place of every centroid that has vectors. One more assignment
    follows, which the columns describe; sums of distances beyond a long are cut to the
    largest one. No vectors give no rows. Further columns are not read.

    A round is one pass over a table of the vectors with their bounds, in the shared folder:
    the vectors are never shuffled, only one row of sums a task and cluster is. The driver
    holds k centroids.
    Lists begin with k / 4 bounds; a round keeps as many as any vector needed in the one
    before, but k / 8 at least.
    """
    spark = table.sparkSession
    prepare(spark)

    def keep(batches):
        for batch in batches:
            rows, x = integers(batch.column(1), dimension, scale)
            if len(rows):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), _lists(x, np.int32)], ["id", "x"])

    state, remove = stored(table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(keep, "id long, x array<int>"))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = state.select("x", order.alias("h")).orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()
    if not first:
        remove()
        none = spark.createDataFrame([], "id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
        return none
    c = np.array([r.x for r in first], np.int64)
    b, least, moved = math.ceil(len(c) / 4), max(1, len(c) // 8), None
    for r in range(rounds + 1):
        made = state.mapInArrow(_round(c, moved, b, r == rounds), _STATE)
        if r == rounds:
            state = cut(made.select("id", "cluster", "distance"))
            remove()
            break
        state, following = stored(made)
        remove()
        remove = following
        sums = state.groupBy("cluster").agg(F.count("*").alias("n"), F.max("need").alias("need"), *[F.sum(F.col("x")[i].cast("long")).alias(f"s{i}") for i in range(dimension)]).collect()
        new = c.copy()
        for s in sums:
            new[s.cluster] = [s[f"s{i}"] // s.n for i in range(dimension)]
        moved = np.sqrt(own(new, c, np.arange(len(c))).astype(np.float64))
        if r:
            b = min(b, max(least, *(s.need for s in sums)))
        c = new
    inertia = {s.cluster: int(s.total) for s in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    cap = lambda n: min(n, (1 << 63) - 1)
    digest = [hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest() for row in c]
    each = F.array(*[F.lit(cap(inertia.get(j, 0))).cast("long") for j in range(len(c))])
    return state.select(
        "id", "cluster", "distance", F.get(each, F.col("cluster")).alias("cluster_inertia"), F.lit(cap(sum(inertia.values()))).cast("long").alias("inertia"), F.get(F.array(*map(F.lit, digest)), F.col("cluster")).alias("centroid_sha256")
    )
