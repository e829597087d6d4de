"""Repeated passages: every window of words that an earlier document has as well."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import bits as bit_arrays
from .bits import collect, divided, maybe_in, test, width
from .common import cut, prepare, release, split_join, stored
from .textblocks import Words, blocks, inside_rows, mix, ngrams, word_hashes, words

#: Words of the phrase that stands for a window in the sketch.
ANCHOR = 8
#: Rows of the sketch that is broadcast; the width of each is bounded as bits.width() says.
DEPTH = 2
_RUN = np.dtype([("anchor", np.uint64), ("first", np.int32), ("n", np.int32)])


def window_anchors(h: np.ndarray, w: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows within rows, their anchors' hashes, and the rows.

    A window's anchor is its phrase of ANCHOR words with the least hash. Equal windows have
    equal anchors, so an anchor is found at least as often as any window it stands for.
    """
    q = min(ANCHOR, window)
    grams = ngrams(h, q)
    span = window - q + 1
    if len(h) < window:
        z = np.zeros(0, np.int64)
        return z, np.zeros(0, np.uint64), z
    # sliding minimum by doubling
    low, width = grams, 1
    while width * 2 <= span:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    n = len(h) - window + 1
    low = np.minimum(low[:n], low[span - width : span - width + n])
    at = np.flatnonzero(inside_rows(w.at, window))
    return at, low[at], np.searchsorted(w.at, at, "right") - 1


def cells(anchors: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each anchor in every row of the sketch."""
    return [(mix(anchors + np.uint64(r * 0x632BE59BD9B4E019 % 2**64)) >> np.uint64(64 - bits)).astype(np.int64) for r in range(DEPTH)]


def anchor_runs(block, window: int) -> tuple[Words, np.ndarray, np.ndarray]:
    """The block's words, runs of consecutive windows with one anchor (_RUN: first is a place in the row), and where each row's runs begin."""
    w = words(block)
    at, anchor, row = window_anchors(word_hashes(block, w), w, window)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    runs = np.empty(len(begin), _RUN)
    runs["anchor"], runs["first"], runs["n"] = anchor[begin], at[begin] - w.at[row[begin]], np.diff(begin, append=len(at))
    return w, runs, np.searchsorted(row[begin], np.arange(len(block) + 1))


def _distinct(anchors: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Anchors of rows, each once a row."""
    order = np.lexsort((anchors, row))
    anchors, row = anchors[order], row[order]
    new = np.ones(len(anchors), bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (row[1:] != row[:-1])
    return anchors[new]


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All rows' runs, and the row of each."""
    packed = [np.frombuffer(x, _RUN) for x in column.to_pylist()]
    return np.concatenate([np.zeros(0, _RUN), *packed]), np.repeat(np.arange(len(packed)), [len(x) for x in packed])


def _hits(rows: DataFrame, n_runs: int, id_type: str) -> DataFrame:
    """(id, x, runs): of rows (id, x, runs), the runs whose anchor is estimated to be in two rows or more.

    Partial sketches of batches, sparse, are merged by cell; estimates are never below the true
    counts. A sketch that fits a bounded bit array is broadcast; beyond that its repeated cells
    stay a table, of any width, that the runs are joined with.
    """
    send = rows.sparkSession.sparkContext.broadcast
    wide = bit_arrays.needed(n_runs)
    small = wide <= bit_arrays.MOST_BITS
    depth, bits = (DEPTH, width(n_runs)) if small else (1, wide)

    def partial(batches):
        for batch in batches:
            runs, row = _unpacked(batch.column(0))
            for r, c in enumerate(cells(_distinct(runs["anchor"], row), bits)[:depth]):
                cell, n = np.unique(c, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell * depth + r), pa.array(n)], ["cell", "n"])
        release()

    repeated = rows.select("runs").mapInArrow(partial, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where("n > 1").select("cell")
    if small:
        sketch = send(collect(repeated, depth, bits))

        def tested(batches):
            for batch in batches:
                runs, row = _unpacked(batch.column(2))
                hit = np.ones(len(runs), bool)
                for t, c in zip(sketch.value, cells(runs["anchor"], bits)):
                    hit &= test(t, c)
                at = np.searchsorted(row[hit], np.arange(len(batch) + 1))
                some = np.flatnonzero(np.diff(at))
                kept = runs[hit]
                if len(some):
                    packed = [kept[at[i] : at[i + 1]].tobytes() for i in some.tolist()]
                    where = pa.array(some)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), pa.array(packed, pa.binary())], ["id", "x", "runs"])
            release()

        return rows.select("id", "x", "runs").mapInArrow(tested, f"id {id_type}, x long, runs binary")

    def each(batches):
        for batch in batches:
            runs, row = _unpacked(batch.column(2))
            where = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(cells(runs["anchor"], bits)[0]), batch.column(0).take(where), batch.column(1).take(where), pa.array([r.tobytes() for r in runs], pa.binary())], ["cell", "id", "x", "run"])

    met = split_join(rows.select("id", "x", "runs").mapInArrow(each, f"cell long, id {id_type}, x long, run binary"), repeated, ["cell"])
    return met.groupBy("id", "x").agg(F.expr("unhex(array_join(transform(collect_list(run), r -> hex(r)), ''))").alias("runs"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """(id, n_words, n_removed, text_kept) for every row of docs.

    A window is so many consecutive words of one row. Each word is removed that stands in a
    window which also starts in a row with a smaller id; windows are judged on the input.
    text_kept is the other words joined by one space. Null and empty texts have no words and
    keep ''; a row with a null id neither loses words nor makes others lose them. Rows that
    repeat an id count as one document: a place found in one is removed in all. Further
    columns of docs are not read.

    First every row's runs of windows with one anchor are written
    to a table, about an eighth of the text. A row whose text has an exact copy with a smaller
    id loses all its words if they fill a window, and is left out from there on. Count-min
    sketches of the others' anchors, merged, tell which runs may be repeated (_hits). Only
    rows with such runs are read then and only their windows are grouped, by
    96-bit hashes, with minima combined before the shuffle. At last words go; only rows that
    lose some are shuffled for that.
    """
    spark = docs.sparkSession
    prepare(spark)
    id_type = dict(docs.dtypes)[id_col]
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    slim = slim.select("id", F.xxhash64("text").alias("x"), "text")

    def parse(batches):
        for batch in batches:
            packed = []
            for block in blocks(batch.column(3)):
                _, runs, at = anchor_runs(block, window)
                packed += [runs[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(packed, pa.binary())], ["id", "x", "d", "runs"])
        release()

    parsed = slim.where("id is not null").select("id", "x", F.md5("text").alias("d"), "text").mapInArrow(parse, f"id {id_type}, x long, d string, runs binary")
    parsed, remove = stored(parsed)
    copies = parsed.select("id", "x", "d")
    first = copies.groupBy("x", "d").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("x", "d", "lo")
    later = cut(split_join(copies, first, ["x", "d"]).where("id > lo").select("id", "x").distinct())
    rows = parsed.where("length(runs) > 0").join(later, ["id", "x"], "left_anti")
    n_runs = parsed.agg(F.coalesce(F.sum(F.expr(f"length(runs) div {_RUN.itemsize}")), F.lit(0))).first()[0]
    hits = cut(_hits(rows.select("id", "x", "runs"), n_runs, id_type).withColumn("key", F.xxhash64("id", "x")))
    remove()

    def candidates(batches):
        for batch in batches:
            ids, packed = batch.column(0), batch.column(2)
            for block in blocks(batch.column(1)):
                w = words(block)
                h = word_hashes(block, w)
                runs, row = _unpacked(packed.slice(block.first, len(block)))
                n = runs["n"].astype(np.int64)
                begin = np.cumsum(n) - n
                place = np.arange(int(n.sum())) - np.repeat(begin - runs["first"], n)
                row = np.repeat(row, n)
                at = w.at[row] + place
                inside = at + window <= w.at[row + 1]
                place, row, at = place[inside], row[inside], at[inside]
                if len(at):
                    one, two = ngrams(h, window)[at], ngrams(h, window, 1)[at]
                    yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array((two >> np.uint64(32)).astype(np.uint32).view(np.int32)), ids.take(pa.array(block.first + row)), pa.array(place.astype(np.int32))], ["h", "c", "id", "pos"])
        release()

    read = maybe_in(slim.where("id is not null").withColumn("key", F.xxhash64("id", "x")), "key", hits.select("key"), hits.count())
    read = read.join(hits.select("id", "x", "runs"), ["id", "x"]).select("id", "text", "runs")
    found = read.mapInArrow(candidates, f"h long, c int, id {id_type}, pos int")
    earliest = found.groupBy("h", "c").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("h", "c", "lo")
    gone = split_join(found, earliest, ["h", "c"]).where("id > lo").groupBy("id").agg(F.collect_set("pos").alias("places"))
    lost = cut(later.groupBy("id").agg(F.collect_set("x").alias("copies")).join(gone, "id", "full"))
    some, others = divided(slim, "id", lost.select("id"), lost.count())
    placed = some.join(lost, "id", "left").select("id", "text", F.coalesce(F.array_contains("copies", F.col("x")), F.lit(False)).alias("whole"), "places")
    placed = placed.unionByName(others.select("id", "text", F.lit(False).alias("whole"), F.lit(None).cast("array<int>").alias("places")))
    return placed.mapInArrow(lambda batches: _keep(batches, window), f"id {id_type}, n_words long, n_removed long, text_kept string")


def _keep(batches, window: int):
    for batch in batches:
        whole, places = batch.column(2).to_pylist(), batch.column(3)
        n_words, n_removed, kept = [], [], []
        for block in blocks(batch.column(1)):
            w = words(block)
            for i in range(len(block)):
                a, b = w.at[i], w.at[i + 1]
                n, row = int(b - a), block.first + i
                gone = np.zeros(n, bool)
                if whole[row]:
                    gone[:] = n >= window
                elif places[row].is_valid:
                    at = places[row].values.to_numpy()
                    at = at[at <= n - window]
                    step = np.zeros(n + 1, np.int64)
                    np.add.at(step, at, 1)
                    np.add.at(step, at + window, -1)
                    gone = np.cumsum(step)[:n] > 0
                text = block.text(i)
                found = text.split()  # bytes.split() splits at the same six bytes
                kept.append(b" ".join([found[k] for k in np.flatnonzero(~gone).tolist()] if gone.any() else found).decode())
                n_words.append(n)
                n_removed.append(int(gone.sum()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "text_kept"])
    release()
