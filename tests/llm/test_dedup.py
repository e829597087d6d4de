"""Near duplicates, passages, lines and vectors against brute force."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from helixframe.llm import bits, embedding_dedup, graph, line_dedup, near_dedup, substring_dedup

SPACE = re.compile("[\x20\x09-\x0d]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def split(t):
    return [w for w in SPACE.split(t or "") if w]


def shingles(text, n):
    w = split(lower(text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def components(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates(docs, corpus, n):
    sets = {r[0]: shingles(r[1], n) for r in corpus}
    edges = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    expected = components(sets, edges)
    got = {r.id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, shingle=n).collect()}
    assert got == {i: (len(sets[i]), expected[i]) for i in sets}
    assert len(set(expected.values())) < len(expected) - 10


def test_blocks_of_unresolved_groups(spark, word, monkeypatch):
    """A chain of edits in which no document is near all others; small blocks, so that pairs meet across them."""
    monkeypatch.setattr(near_dedup, "GRID", 4)
    monkeypatch.setattr(near_dedup, "SKETCH_GRID", 6)
    monkeypatch.setattr(near_dedup, "HUB", 3)
    w = word(3, 200).split()
    texts = []
    for i in range(30):
        w = list(w)
        for k in range(4):
            w[(17 * i + 53 * k) % 200] = f"new{i}x{k}"
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    random.Random(1).shuffle(rows)
    sets = {i: shingles(t, 5) for i, t in rows}
    edges = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    got = {r.id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components(sets, edges)


def test_near_duplicates_of_nothing(spark, empty, odd_columns, docs):
    assert near_dedup.near_duplicates(empty).count() == 0
    blank = spark.createDataFrame([(1, None), (2, ""), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, near_dedup.near_duplicates(blank).collect())) == [(1, 0, 1), (2, 0, 2), (2, 0, 2)]
    assert sorted(map(tuple, near_dedup.near_duplicates(odd_columns).collect())) == sorted(map(tuple, near_dedup.near_duplicates(docs).collect()))


def by_rows(rows, n):
    """Components of rows, whatever ids they repeat: (id, text) -> smallest id reachable."""
    keys = sorted({r for r in rows if r[0] is not None}, key=str)
    sets = [shingles(t, n) for _, t in keys]
    edges = [(a, b) for a, b in itertools.combinations(range(len(keys)), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    c = components(range(len(keys)), edges)
    least = {}
    for i, x in c.items():
        least[x] = min(least.get(x, keys[i][0]), keys[i][0])
    return {k: least[c[i]] for i, k in enumerate(keys)}


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_near_duplicates_of_repeated_and_null_ids(spark, word, seed):
    a, b = word(300, 60), word(301, 60)
    rows = [(5, a), (5, b), (7, b + " x"), (8, a + " y"), (3, word(302, 40)), (3, word(302, 40)), (None, a), (None, a), (9, None), (None, None), (2, word(303, 50)), (4, word(303, 50)), (4, a + " z")]
    random.Random(seed).shuffle(rows)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), with_key=True)
    keys = {(r.doc_id, r.text): r.key for r in spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", near_dedup.row_key("doc_id", "text")).collect()}
    expected = by_rows(rows, 5)
    assert sorted(((r.id or -1, r.key, r.component_id or -1) for r in got.collect())) == sorted((i or -1, keys[i, t], expected.get((i, t)) or -1) for i, t in rows)


@pytest.mark.parametrize("grid", [3, 8])
def test_clusters_that_share_their_hub(spark, word, monkeypatch, grid):
    """Several groups of near copies around one long passage, and unlike documents that have it: links between texts that are not the hub's."""
    monkeypatch.setattr(near_dedup, "GRID", grid)
    monkeypatch.setattr(near_dedup, "SKETCH_GRID", 2 * grid)
    passage, rows = word(500, 60), []
    for g in range(5):
        own = word(510 + g, 70).split()
        for i in range(7):
            w = list(own)
            w[(11 * i) % 70] = f"e{i}"
            rows.append((len(rows), passage + " " + " ".join(w)))
    rows += [(100 + i, passage + " " + word(600 + i, 30 + 5 * i)) for i in range(12)]
    random.Random(4).shuffle(rows)
    got = {r.id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()}
    assert got == {i: c for (i, _), c in by_rows(rows, 4).items()} and len(set(got.values())) < 20


def test_union_estimate_counts_the_smallest():
    import numpy as np

    x, y = np.array([[1, 3, 5, 7]], np.uint64), np.array([[1, 2, 3, 9]], np.uint64)
    assert near_dedup.union_estimate(x, y)[0] == 2 / 4  # of 1 2 3 5 both have 1 and 3


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)] + [(200, x) for x in range(201, 240)]
    random.Random(2).shuffle(edges)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    assert got == components(nodes, edges)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def jobs(spark, action):
    """How many jobs action runs."""
    count = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    before = count()
    action()
    return count() - before


@pytest.mark.parametrize("task_edges", [7, 1000])
def test_components_by_tasks_and_rounds(spark, task_edges):
    """Edges of one task need no rounds; those of several meet in them."""
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(None, 3), (4, None)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(20)
    got = {r.node: r.component for r in graph.components(df, task_edges=task_edges).collect()}
    edges = [e for e in edges if None not in e and e[0] != e[1]]
    assert got == components({x for e in edges for x in e}, edges)


def test_few_edges_take_few_jobs(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert jobs(spark, lambda: graph.components(edges)) <= 4


def test_an_array_of_hashes_is_fetched_in_few_jobs(spark):
    held = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", 50)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        out = []
        cells = spark.range(0, 1 << 20, 999, 2).toDF("cell")
        assert jobs(spark, lambda: out.extend(bits.collect(cells, 1, 20))) < 25
        assert np.flatnonzero(bits.test(out[0], np.arange(1 << 20))).tolist() == list(range(0, 1 << 20, 999))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held[1])


def passages(rows, window):
    first = {}
    for i, t in rows:
        w = split(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = split(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


@pytest.mark.parametrize("window", [5, 50])
def test_passages(docs, corpus, window):
    got = sorted(map(tuple, substring_dedup.repeated_passages(docs, window=window).collect()))
    assert got == passages([(r[0], r[1]) for r in corpus], window)
    assert sum(r[2] for r in got) > 300


def test_passages_with_the_sketch_as_a_table(docs, corpus, monkeypatch):
    """Wider than the bit array that may be broadcast, the sketch is joined; every estimate still holds."""
    monkeypatch.setattr(substring_dedup.bit_arrays, "MOST_BITS", 8)
    got = sorted(map(tuple, substring_dedup.repeated_passages(docs, window=5).collect()))
    assert got == passages([(r[0], r[1]) for r in corpus], 5)


def test_runs_cover_all_windows(word):
    import numpy as np
    import pyarrow as pa
    from helixframe.llm.textblocks import blocks

    texts = [word(1, 130), None, "a b", word(2, 50), word(3, 49), word(1, 130)]
    (block,) = blocks(pa.array(texts))
    w, runs, at = substring_dedup.anchor_runs(block, 50)
    for i, t in enumerate(texts):
        own = runs[at[i] : at[i + 1]]
        places = np.concatenate([np.zeros(0, int), *(np.arange(r["first"], r["first"] + r["n"]) for r in own)])
        assert places.tolist() == list(range(max(0, len(split(t)) - 49)))
    assert runs[at[0] : at[1]].tobytes() == runs[at[5] :].tobytes()


def test_passages_of_nothing(spark, empty, odd_columns, docs):
    assert substring_dedup.repeated_passages(empty).count() == 0
    rows = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (7, None)], "doc_id long, text string")
    got = sorted(substring_dedup.repeated_passages(rows, window=2).collect(), key=str)
    assert sorted(((r.id, r.n_words, r.n_removed) for r in got), key=str) == sorted([(None, 3, 0), (5, 3, 0), (5, 3, 0), (7, 0, 0)], key=str)
    assert sorted(map(tuple, substring_dedup.repeated_passages(odd_columns).collect())) == sorted(map(tuple, substring_dedup.repeated_passages(docs).collect()))


def lines(rows, least_chars, least_docs):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least_chars:
                held.setdefault(key(x), set()).add(i)
    out = []
    for i, t in rows:
        kept = [x for x in (t or "").split("\n") if not (len(held.get(key(x), ())) >= least_docs and min(held[key(x)]) < i)]
        n = (t or "").count("\n") + 1
        out.append((i, "\n".join(kept), n, n - len(kept)))
    return sorted(out)


@pytest.mark.parametrize("least_docs", [2, 3])
def test_lines(docs, corpus, least_docs):
    got = line_dedup.repeated_lines(docs, least_docs=least_docs).select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert sorted(map(tuple, got)) == lines([(r[0], r[1]) for r in corpus], 10, least_docs)


def test_lines_keep_other_columns(spark, empty, odd_columns):
    assert line_dedup.repeated_lines(empty).count() == 0
    out = line_dedup.repeated_lines(odd_columns)
    assert set(odd_columns.columns) < set(out.columns) and out.count() == odd_columns.count()
    rows = spark.createDataFrame([(None, "a common line"), (4, "a common line"), (4, "a common line"), (9, "x\na common line\na common line")], "doc_id long, text string")
    got = {(r.doc_id, r.text, r.n_dropped) for r in line_dedup.repeated_lines(rows).collect()}
    assert got == {(None, "a common line", 0), (4, "a common line", 0), (9, "x", 2)}


def vectors():
    rng = random.Random(4)
    out = []
    for g in range(6):
        centre = [rng.gauss(0, 1) for _ in range(16)]
        for _ in range(12):
            out.append([c + rng.gauss(0, 0.28) for c in centre])
    out += [out[0], out[0], [2 * x for x in out[1]], [0.0] * 16, None, [], [math.nan] * 16, [math.inf] + [1.0] * 15, [None] + [1.0] * 15, [1e30] * 16, [1e-30] * 16, [1.0, 2.0]]
    return [(7 * i % 101, v, i) for i, v in enumerate(out)]


def test_vectors(spark):
    import numpy as np

    rows = vectors()
    good = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    unit = {i: (v / abs(v).max()) / np.linalg.norm(v / abs(v).max()) for i, v in good.items()}
    edges = [(a, b) for a, b in itertools.combinations(unit, 2) if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9]
    n = {i: sum(i in e for e in edges) for i, _, _ in rows}
    c = components([r[0] for r in rows], edges)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(table).collect()}
    assert got == {i: (n[i], c[i]) for i in n}
    assert sum(n.values()) > 100


def test_vectors_meet_across_tiles(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 5)
    rows = [(i, [1.0 + 0.001 * i, 2.0, 3.0], 0) for i in range(40)]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(39, 0)} and len(got) == 40


def test_vectors_with_null_and_repeated_ids_and_other_columns(spark):
    rows = [(None, [1.0, 0.0], 1, 2, b"x"), (None, [1.0, 0.0], 1, 2, b"x"), (4, [1.0, 0.01], 1, 2, b"x"), (4, [0.0, 1.0], 1, 2, b"x"), (6, [0.01, 1.0], 1, 2, b"x"), (6, [0.01, 1.0], 1, 2, b"x"), (8, [-1.0, 0.0], 1, 2, b"x")]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, id long, n long, v binary")).collect()
    # 4 is two vectors, one of them near both rows of 6, which are equal
    assert sorted(((r.id or 0, r.n_links, r.component_id or 0) for r in got)) == [(0, 0, 0), (0, 0, 0), (4, 2, 4), (4, 2, 4), (6, 4, 4), (6, 4, 4), (8, 0, 8)]


def test_vectors_of_nothing(spark):
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_hashes_follow_equality(word):
    """Word and n-gram hashes do not depend on where a text lies in a block."""
    import numpy as np
    import pyarrow as pa
    from helixframe.llm.textblocks import blocks, ngrams, word_hashes, words

    texts = [word(1, 30), None, "", word(2, 5), word(1, 30)]
    (block,) = blocks(pa.array(texts))
    w = words(block)
    h = word_hashes(block, w)
    assert np.diff(w.at).tolist() == [30, 0, 0, 5, 30]
    assert (h[:30] == h[35:]).all()
    assert (ngrams(h[:30], 7) == ngrams(h[35:], 7)).all()
    assert hashlib.sha256(h.tobytes()).hexdigest() == hashlib.sha256(word_hashes(block, words(block)).tobytes()).hexdigest()
