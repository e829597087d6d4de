"""Connected components of an edge table, distributed."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, prepare, release, split_join, stored

#: Edges that a task contracts at once, about.
EDGES = 1 << 18


def contracted(edges: DataFrame, tasks: int) -> DataFrame:
    """(node, component) for the nodes of edges (a, b), by the edges that each of so many tasks holds."""

    def run(batches):
        up: dict[int, int] = {}

        def find(x):
            root = x
            while (y := up.setdefault(root, root)) != root:
                root = y
            while up[x] != root:
                up[x], x = root, up[x]
            return root

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = find(a), find(b)
                if x != y:
                    up[max(x, y)] = min(x, y)
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["node", "component"])
        release()

    prepare(edges.sparkSession)
    return edges.coalesce(tasks).mapInArrow(run, "node long, component long")


def components(edges: DataFrame, most_rounds: int = 60, task_edges: int = EDGES) -> DataFrame:
    """(node, component) for every node of edges (a, b), a table in the shared folder; component is the smallest node reachable.

    Edges are read twice. Tasks of about task_edges edges contract what they hold to stars. If it takes more than one,
    the large-star and small-star steps of Kiveris et al. (2014) alternate: each node links
    its neighbours to the smallest of them, so that trees become stars after O(log^2 n) rounds
    whatever their diameter. Every round is one grouped minimum (combined before the shuffle)
    and one join on the node, whose hot keys AQE can split; nothing is gathered for a node.
    Null ends and loops are left out. Edges that never change end the loop.
    """
    kept = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    tasks = max(1, -(-kept.count() // task_edges))
    found = contracted(kept, tasks)
    return cut(found) if tasks == 1 else _starred(found.selectExpr("node a", "component b").where("a <> b"), most_rounds)


def _starred(edges: DataFrame, most_rounds: int) -> DataFrame:
    kept, remove = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    for _ in range(most_rounds):
        both = kept.union(kept.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # large star: neighbours above the node go to the least of its neighbourhood
        large = split_join(both.where("b > a"), least, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: the node and its neighbours below go to the least of those
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = split_join(large, small_least, ["a"]).selectExpr("explode(array(struct(a, m), struct(b as a, m))) e").selectExpr("e.a", "e.m as b").where("a <> b").distinct()
        (kept, following) = stored(small)
        remove()
        remove = following
        now = kept.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == last:
            break
        last = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    found = cut(kept.select(F.col("a").alias("node"), F.col("b").alias("component")).union(kept.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()))
    remove()
    return found
