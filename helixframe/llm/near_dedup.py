"""Near-duplicate documents by bottom-k sketches.

Every document's set of word shingles is hashed with one hash function; the k smallest
values are its sketch. Inverted lists of retained values generate overlaps, the sketch of a
pair's union estimates its Jaccard similarity, and the full sets of what passes decide.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bits import maybe_in
from .common import cut, prepare, release, split_join
from .graph import components
from .textblocks import blocks, mix, ngrams, word_hashes, words

SKETCH = 64
#: Standard errors that the filter leaves below the similarity asked for. Of a pair exactly at 0.8 and 64 values it
#: loses those with at most 33 in common, odds of 3e-7; nearer pairs are lost far more rarely.
SLACK = 5.5
#: Documents of an unresolved inverted list that meet in one block of pairs, from each side: by sketches, by texts.
SKETCH_GRID, GRID = 1024, 256
#: Documents compared with one copy of the text they share as partner.
HUB = 256


def shingle_sets(block, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each row's shingles; a row of fewer words is one shingle, one without words none."""
    w = words(block)
    h = word_hashes(block, w, fold=True)
    grams = ngrams(h, size)
    for i in range(len(block)):
        a, b = w.at[i], w.at[i + 1]
        n = b - a
        if n >= size:
            yield np.unique(grams[a : b - size + 1])
        elif n:
            yield mix(ngrams(h[a:b], int(n)) + np.uint64(n))
        else:
            yield np.zeros(0, np.uint64)


def row_key(id_col, text_col):
    """What tells rows apart that repeat an id with other texts: a 64-bit hash of both."""
    return F.xxhash64(F.col(id_col).cast("long"), text_col)


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int, k: int) -> DataFrame:
    """(id, key, n, class, sketch): the row's key, the set's size, a 128-bit digest of the whole set, its k least hashes as bytes (signed order)."""

    def run(batches):
        for batch in batches:
            n, cls, sk = [], [], []
            for block in blocks(batch.column(2)):
                for s in shingle_sets(block, size):
                    n.append(len(s))
                    cls.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    sk.append(s[:k].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(sk, pa.binary())], ["id", "key", "n", "class", "sketch"])
        release()

    prepare(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text")).mapInArrow(run, "id long, key long, n long, class binary, sketch binary")


def _matrix(column: pa.Array, k: int) -> np.ndarray:
    """Sketches as rows of k values; the places of short ones stay at the largest value."""
    out = np.full((len(column), k), np.iinfo(np.uint64).max, np.uint64)
    for i, s in enumerate(column.to_pylist()):
        v = np.frombuffer(s, np.uint64)
        out[i, : len(v)] = v
    return out


def union_estimate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of rows of two sketch matrices: the share of both sketches among the k least values of their union."""
    k = x.shape[1]
    top = np.iinfo(np.uint64).max
    s = np.sort(np.concatenate([x, y], 1), 1)
    twin = np.zeros(s.shape, bool)
    twin[:, 1:] = (s[:, 1:] == s[:, :-1]) & (s[:, 1:] != top)
    rank = np.cumsum(~twin & (s != top), 1)
    inside = rank <= k
    return (twin & inside).sum(1) / np.maximum(1, np.minimum(k, rank[:, -1]))


def least_estimate(similarity: float, k: int) -> float:
    return max(0.0, similarity - SLACK * math.sqrt(similarity * (1 - similarity) / k))


def verified(pairs: DataFrame, reps: DataFrame, texts: DataFrame, size: int, similarity: tuple[int, int], k: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar: filtered by the union sketch first, then counted exactly on the texts.

    A document a that many are compared with is sent once for each HUB of them, ahead of their texts.
    """
    up, down = similarity
    floor = least_estimate(up / down, k)
    s = reps.select("id", "n", "sketch")
    both = pairs.join(s.selectExpr("id a", "n na", "sketch sa"), "a").join(s.selectExpr("id b", "n nb", "sketch sb"), "b")
    both = both.where(F.least("na", "nb") * down >= F.greatest("na", "nb") * up)

    def estimate(batches):
        for batch in batches:
            t = batch.schema.names.index
            keep = np.zeros(len(batch), bool)
            for i in range(0, len(batch), 2048):
                part = batch.slice(i, 2048)
                keep[i : i + 2048] = union_estimate(_matrix(part.column(t("sa")), k), _matrix(part.column(t("sb")), k)) >= floor
            yield pa.RecordBatch.from_arrays([batch.column(t("a")), batch.column(t("b"))], ["a", "b"]).filter(pa.array(keep))
        release()

    likely = cut(both.select("a", "b", "sa", "sb").mapInArrow(estimate, "a long, b long"))
    keyed = split_join(likely, likely.groupBy("a").agg(F.ceil(F.count("*") / HUB).alias("g")), ["a"])
    keyed = keyed.select("a", "b", "g", F.pmod(F.xxhash64("b"), F.col("g")).cast("int").alias("part"))
    members = keyed.select("a", "part", F.lit(1).alias("turn"), "b").join(texts.selectExpr("id b", "text"), "b").select("a", "part", "turn", "b", "text")
    hubs = keyed.select("a", "part").distinct().join(texts.selectExpr("id a", "text"), "a").select("a", "part", F.lit(0).alias("turn"), F.col("a").alias("b"), "text")

    def exact(batches):
        hub, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, part, turn, b = (batch.column(i).to_numpy() for i in range(4))
            keep = np.zeros(len(batch), bool)
            for block in blocks(batch.column(4)):
                for i, s in enumerate(shingle_sets(block, size), block.first):
                    if turn[i] == 0:
                        hub, own = (a[i], part[i]), s
                    elif hub == (a[i], part[i]) and len(s):
                        common = len(np.intersect1d(own, s, assume_unique=True))
                        keep[i] = common * down >= (len(own) + len(s) - common) * up
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3)], ["a", "b"]).filter(pa.array(keep))
        release()

    rows = members.unionByName(hubs).repartition("a", "part").sortWithinPartitions("a", "part", "turn")
    return cut(rows.mapInArrow(exact, "a long, b long"))


def _lists(reps: DataFrame, k: int, similarity: tuple[int, int]) -> DataFrame:
    """(v, id, weight): the inverted lists that every similar pair still meets in; weight: how many entries the lists of an id's values have before they are cut.

    A pair as similar as asked for shares at least c retained values (c: half of the smaller
    sketch, 6 standard errors below what is expected of a full one and under the exact bound
    of a short one). Of each sketch only the m - c + 1 values with the shortest lists are
    needed, by the prefix principle under the common order (list length, value). Passages
    that many unlike documents share have long lists and fall out, and nothing is capped.
    """
    prepare(reps.sparkSession)

    def values(batches):
        for batch in batches:
            rows = [np.frombuffer(s, np.int64) for s in batch.column(1).to_pylist()]
            if rows:
                n = [len(r) for r in rows]  # least(size of the set, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.array(np.repeat(batch.column(0).to_numpy(), n)), pa.array(np.repeat(np.array(n, np.int32), n))], ["v", "id", "m"])

    every = reps.select("id", "sketch").mapInArrow(values, "v long, id long, m int")
    shared = every.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    m = F.col("m")
    c = F.greatest(F.lit(1), F.floor(m / 2))
    own = split_join(every, shared, ["v"]).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("l"), F.first("m").alias("m"))
    take = (m - c + 1) - (m - F.size("l"))  # single values come first in the order and meet nobody
    own = own.where(take > 0).select("id", F.slice("l", 1, take.cast("int")).alias("l"))
    weight = F.aggregate("l", F.lit(0).cast("long"), lambda x, e: x + e["df"])
    return own.select("id", weight.alias("weight"), F.explode("l").alias("e")).selectExpr("e.v", "id", "weight")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: tuple[int, int] = (80, 100), k: int = SKETCH, with_key: bool = False) -> DataFrame:
    """(id, n_shingles, component_id) for every row of docs; with_key also key, which tells rows apart that repeat an id, and group, which tells components apart (null: alone).

    Rows are linked whose shingle sets have down * |intersection| >= up * |union| with
    (up, down) = similarity; component_id is the smallest id of all rows reachable. Rows with
    equal sets form a class that its smallest id stands for, so copies are never expanded into
    pairs. Null or word-free texts have the empty set and link with nothing. Rows that repeat
    an id with other texts are rows of their own, linked by their texts only; equal rows get
    equal results. Rows with a null id link with nothing and have a null component_id. Further
    columns of docs are not read.

    Candidates are documents that share an inverted list. Each list has a hub: its document
    with the most entries in the lists of all its values, as the original of many edited
    copies has. Hubs are compared with the documents of their lists first. Other documents of
    a hub's lists that are still in different components then meet in blocks of tiles of about
    SKETCH_GRID or GRID: their sketches first, and of those with a likely partner the full sets,
    from which only edges that join components come out. Documents of a hub's commonest
    component only meet the others, not each other.
    """
    spark = docs.sparkSession
    prepare(spark)
    every = cut(sketches(docs, id_col, text_col, shingle, k))
    classes = every.where("class is not null and id is not null").groupBy("class").agg(F.min(F.struct("id", "key", "n", "sketch")).alias("r"))
    # from here on a class's node is its row's key
    reps = cut(classes.select("class", F.col("r.id").alias("doc"), F.col("r.key").alias("id"), "r.n", "r.sketch"))
    lists = cut(_lists(reps, k, similarity))

    hubs = lists.groupBy("v").agg(F.max_by("id", F.struct("weight", F.bitwise_not("id"))).alias("hub"))
    groups = cut(split_join(lists.select("v", "id"), hubs, ["v"]).select("hub", "id").distinct())

    involved = cut(groups.select("id").distinct())
    texts = docs.where(F.col(id_col).isNotNull()).select(row_key(id_col, text_col).alias("id"), F.col(text_col).alias("text"))
    texts = cut(maybe_in(texts, "id", involved, involved.count()).join(involved, "id", "left_semi").dropDuplicates(["id"]))
    links = verified(groups.where("hub <> id").selectExpr("hub a", "id b"), reps, texts, shingle, similarity, k)
    found = components(links)

    named = groups.join(found.withColumnRenamed("node", "id"), "id", "left").select("hub", "id", F.coalesce("component", "id").alias("c"))
    mixed = named.groupBy("hub").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("hub")
    rest = cut(split_join(named.where("hub <> id"), mixed, ["hub"]))
    if not rest.isEmpty():
        likely = cut(_likely(rest, reps, similarity, k))
        if not likely.isEmpty():
            found = components(links.union(_grid_links(likely, texts, shingle, similarity)))
    named = reps.select("class", "doc", "id").join(found.withColumnRenamed("node", "id"), "id", "left").select("class", "doc", "id", "component")
    least = named.where("component is not null").groupBy("component").agg(F.min("doc").alias("least"))
    by_class = split_join(named.where("component is not null"), least, ["component"]).select("class", F.col("least").alias("component_id"), F.col("component").alias("group"))
    by_class = by_class.unionByName(named.where("component is null").select("class", F.col("doc").alias("component_id"), F.col("id").alias("group")))
    out = every.select("id", "key", "n", "class").join(by_class, "class", "left")
    known = F.col("id").isNotNull()
    out = out.select("id", F.col("n").alias("n_shingles"), F.when(known, F.coalesce("component_id", "id")).alias("component_id"), "key", F.when(known, F.col("group")).alias("group"))
    return out if with_key else out.drop("key", "group")


def _meet(rest: DataFrame, more: DataFrame, grid: int) -> DataFrame:
    """rest (hub, id, c) with the columns of more by id, in all blocks (hub, kind, x, y) of its hub; tile tells a block's sides apart.

    Kind 0 are blocks of two tiles of the documents outside the hub's commonest component (or
    of one), kind 1 those of such a tile and one of the commonest component. So a document of
    a component of any size is sent once for each grid of the others.
    """
    sizes = rest.groupBy("hub", "c").agg(F.count("*").alias("n"))
    roles = sizes.groupBy("hub").agg(F.max(F.struct("n", "c")).alias("top"), F.sum("n").alias("all"))
    tiles = lambda n: F.greatest(F.lit(1), F.ceil(n / grid)).cast("int")
    roles = roles.select("hub", F.col("top.c").alias("common"), tiles(F.col("all") - F.col("top.n")).alias("few"), tiles(F.col("top.n")).alias("many"), (F.col("all") > F.col("top.n")).alias("mixed")).where("mixed").drop("mixed")
    placed = split_join(rest.select("hub", "id", "c"), roles, ["hub"]).join(more, "id")
    usual = F.col("c") == F.col("common")
    i = F.pmod(F.xxhash64("id", "hub"), F.when(usual, F.col("many")).otherwise(F.col("few"))).cast("int")
    placed = placed.withColumn("i", i)
    block = lambda kind, x, y, tile: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"), tile.alias("tile"))
    each = lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    own = F.col("i")
    as_usual = each("few", lambda j: block(1, j, own, F.lit(-1)))
    as_other = F.concat(each("few", lambda j: block(0, F.least(own, j), F.greatest(own, j), own)), each("many", lambda j: block(1, own, j, own)))
    return placed.withColumn("b", F.explode(F.when(usual, as_usual).otherwise(as_other))).select("hub", "b.*", "id", "c", *[c for c in more.columns if c != "id"])


class _Shared:
    """Values that the rows of a block have in common, by inverted lists."""

    def __init__(self, sets: list[np.ndarray]):
        n = np.array([len(s) for s in sets])
        self.at = np.concatenate([[0], np.cumsum(n)])
        _, self.value = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
        order = np.argsort(self.value, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), n)[order]
        self.first = np.searchsorted(self.value[order], np.arange(self.value.max() + 2)) if len(self.value) else np.zeros(1, np.int64)

    def with_all(self, a: int) -> np.ndarray:
        """How many values row a shares with each row."""
        v = self.value[self.at[a] : self.at[a + 1]]
        begin, count = self.first[v], self.first[v + 1] - self.first[v]
        step = np.cumsum(count) - count
        return np.bincount(self.owner[np.arange(int(count.sum())) - np.repeat(step - begin, count)], minlength=len(self.at) - 1)


def _sides(key, table) -> tuple:
    """A block's ids, components, rows to compare with the others (those outside its commonest component), and what a row may be compared with."""
    ids, c, tile = (table.column(n).to_numpy() for n in ("id", "c", "tile"))
    within = key[1].as_py() == 0 and key[2].as_py() == key[3].as_py()
    kind, usual = np.unique(c, return_counts=True)
    some = np.flatnonzero(c != kind[usual.argmax()]) if len(kind) > 1 else np.zeros(0, np.int64)
    return ids, c, some, lambda a: (c != c[a]) if within else (c != c[a]) & (tile != tile[a])


def _likely(rest: DataFrame, reps: DataFrame, similarity: tuple[int, int], k: int) -> DataFrame:
    """The rows of rest that have, by their sketches, a likely partner of their hub in another component."""
    up, down = similarity
    floor = least_estimate(up / down, k)

    def judge(key, table):
        ids, c, some, others = _sides(key, table)
        active = np.zeros(len(ids), bool)
        if len(some):
            n = table.column("n").to_numpy()
            held = np.minimum(n, k)
            matrix = _matrix(table.column("sketch"), k)
            shared = _Shared([row[:m] for row, m in zip(matrix, held)])
            for a in some.tolist():
                near = others(a) & (np.minimum(n, n[a]) * down >= np.maximum(n, n[a]) * up)
                if active[a]:
                    near &= ~active
                if near.any():
                    near &= shared.with_all(a) >= np.maximum(1, np.minimum(held, held[a]) // 2)
                b = np.flatnonzero(near)
                if len(b):
                    b = b[union_estimate(np.repeat(matrix[a : a + 1], len(b), 0), matrix[b]) >= floor]
                    active[b] = True
                    active[a] |= len(b) > 0
        hit = np.flatnonzero(active)
        return pa.table({"hub": pa.array([key[0].as_py()] * len(hit), pa.int64()), "id": pa.array(ids[hit], pa.int64()), "c": pa.array(c[hit], pa.int64())})

    met = _meet(rest, reps.select("id", "n", "sketch"), SKETCH_GRID)
    return met.groupBy("hub", "kind", "x", "y").applyInArrow(judge, "hub long, id long, c long").distinct()


def _grid_links(rest: DataFrame, texts: DataFrame, size: int, similarity: tuple[int, int]) -> DataFrame:
    """Edges between components of rest (hub, id, c): a hub's documents are judged on full sets, where their blocks meet."""
    up, down = similarity

    def judge(key, table):
        ids, c, some, others = _sides(key, table)
        joined: list[tuple[int, int]] = []
        if len(some):
            sets = [s for block in blocks(table.column("text")) for s in shingle_sets(block, size)]
            n = np.array([len(s) for s in sets])
            shared = _Shared(sets)
            root = {x: x for x in c.tolist()}

            def find(x):
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for a in some[n[some] > 0].tolist():
                common = shared.with_all(a)
                for b in np.flatnonzero(others(a) & (common * down >= (n + n[a] - common) * up)).tolist():
                    x, y = find(c[a].item()), find(c[b].item())
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        joined.append((ids[a].item(), ids[b].item()))
        a, b = zip(*joined) if joined else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return cut(_meet(rest, texts, GRID).groupBy("hub", "kind", "x", "y").applyInArrow(judge, "a long, b long"))
