"""Periodic runs of words, found by probing a harmonic grid."""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import prepare, release

#: Words that are compared at once when a survivor is extended; doubled at every step.
CHUNK = 64
#: Words of the documents that are probed together.
TOGETHER = 1 << 20
_DIGESTS = "id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_WHOLE = ", runs array<struct<start:long,length:long,period:long>>, collapsed string"


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p) where the document's words from a on are made to repeat with period p; None where they stay as they are."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return None
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _reach_right(w: np.ndarray, i: int, p: int, end: int) -> int:
    """The first place from i on whose word differs from the one p later, or end - p."""
    step, last = CHUNK, end - p
    while i < last:
        m = min(step, last - i)
        differ = w[i : i + m] != w[i + p : i + p + m]
        k = int(differ.argmax())
        if differ[k]:
            return i + k
        i, step = i + m, 2 * step
    return max(i, last)


def _reach_left(w: np.ndarray, i: int, p: int) -> int:
    """The smallest place from which on all words up to i equal the one p later; the word before w[0] differs from all."""
    step = CHUNK
    while i > 0:
        m = min(step, i)
        differ = (w[i - m : i] != w[i - m + p : i + p])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            return i - k
        i, step = i - m, 2 * step
    return i


def find_runs(w: np.ndarray, longest: np.ndarray, repeats: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """All (start, length, period) of w with length >= max(least, repeats * period), by period, then start.

    w holds the word numbers of several documents, longest first, each followed by a number
    of its own; longest[p] is how many of its places belong to documents in which a run of
    period p has room. A run of period p covers `repeats` places jp in a row, so the words at
    jp and (j+1)p are equal repeats - 1 times in a row; only there are words compared on both
    sides, in chunks. Periods come in ascending order. Two full periods of a new run never
    lie within a run of a smaller period, or both would have a still smaller one in common:
    grid places of which that holds are passed over. Nor is a stretch compared twice.
    """
    out = []
    reach = np.zeros(len(w), np.int64)  # the largest end of a found run that holds the place
    for p in range(1, len(longest)):
        end = int(longest[p])
        if end < repeats * p:
            continue
        grid = w[:end:p]
        same = grid[1:] == grid[:-1]
        hit = same[: len(same) - repeats + 2].copy()
        for r in range(1, repeats - 1):
            hit &= same[r : r + len(hit)]
        done = -1
        at = np.flatnonzero(hit) * p
        if len(at):
            at = at[reach[at] < at + 2 * p]
        for i in at.tolist():
            if i < done:
                continue
            left, right = _reach_left(w, i, p), _reach_right(w, i, p, end)
            done = right + 1
            length = right - left + p
            if length >= max(least, repeats * p) and reach[left] < left + length:
                out.append((left, length, p))
                np.maximum(reach[left : left + length], left + length, out=reach[left : left + length])
    return out


def _document(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """The columns of a document from its words and its runs in order of start, then period."""
    n = len(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = np.zeros(n + 1, np.int64)
    for s, length, p in runs:
        gone[s + p] += 1
        gone[s + length] -= 1
    stays = np.cumsum(gone[:n]) == 0
    kept = b" ".join(words if not runs else [words[i] for i in np.flatnonzero(stays).tolist()])
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    figures = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *figures, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(), [{"start": s, "length": length, "period": p} for s, length, p in runs], kept.decode("utf-8", "surrogatepass"))


def _together(ids: list, words: list[list[bytes]], repeats: int, least: int) -> list[tuple]:
    """The columns of some documents, probed as one array of word numbers."""
    order = sorted(range(len(words)), key=lambda i: -len(words[i]))
    flat = [x for i in order for x in words[i]]
    codes = pa.array(flat, pa.large_binary()).dictionary_encode().indices.to_numpy() if flat else np.zeros(0, np.int64)
    n = np.array([len(words[i]) for i in order], np.int64)
    begin = np.concatenate([[0], np.cumsum(n + 1)])
    w = np.empty(int(begin[-1]), np.int64)
    wordy = np.ones(len(w), bool)
    wordy[begin[1:] - 1] = False
    w[wordy], w[~wordy] = codes, -1 - np.arange(len(n))
    enough = n >= least
    periods = np.arange(1 + (int(n[enough].max(initial=0)) // repeats))
    longest = begin[np.searchsorted(-n, -np.maximum(least, repeats * periods), "right")]
    found: list[list] = [[] for _ in order]
    runs = find_runs(w, longest, repeats, least)
    if runs:
        of = np.searchsorted(begin, [r[0] for r in runs], "right") - 1
        for d, (s, length, p) in zip(of.tolist(), runs):
            found[d].append((s - int(begin[d]), length, p))
    out: list = [None] * len(words)
    for d, i in enumerate(order):
        out[i] = _document(words[i], sorted(found[d], key=lambda r: (r[0], r[2])))
    return out


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False, repeats: int = 4, least: int = 6, whole: bool = True) -> DataFrame:
    """(id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, runs, collapsed) for every row of docs.

    Words are runs [^\\x20\\x09-\\x0D]+ of the whole text (null: none), numbered from 0. A run
    is a stretch of words with smallest period q, of at least max(least, repeats * q) words,
    that cannot grow with that period. start, length, period and exponent_milli
    (floor(1000 * length / period)) are those of the run with the greatest length / period
    (ties: smallest start, then period), null where there is none. runs lists all, by start,
    then period; runs_sha256 is the digest of their lines `start,length,period`. collapsed has
    the words joined by one space without those that a run contains after its first period;
    collapsed_sha256 is its digest; without whole, runs and collapsed are left out. With plant, documents are first made to repeat as
    planted() says, those with a null id never. Rows are judged one by one: repeated ids stay
    rows, an empty table gives none, and further columns are not read.

    There is no shuffle. Short documents of a batch are probed together, a long one by itself.
    """
    prepare(docs.sparkSession)

    def probe(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            waiting, size, rows = [], 0, []
            for k in range(len(ids)):
                words = (texts[k].as_py() or "").encode("utf-8", "surrogatepass").split()
                if plant and (made := planted(ids[k], len(words))):
                    a, p = made
                    n = len(words) - a
                    words = words[:a] + (words[a : a + p] * (n // p + 1))[:n]
                if waiting and size + len(words) > TOGETHER:
                    rows += _together(ids, waiting, repeats, least)
                    waiting, size = [], 0
                waiting.append(words)
                size += len(words)
            rows += _together(ids, waiting, repeats, least)
            if rows:
                columns = list(zip(*rows))
                kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])), pa.string()]
                names = ["id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed"]
                out = [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))]
                yield pa.RecordBatch.from_arrays(out if whole else out[:-2], names if whole else names[:-2])
        release()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(probe, _DIGESTS + (_WHOLE if whole else ""))
