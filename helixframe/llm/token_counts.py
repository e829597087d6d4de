"""Token counts with a two-tier lookup beside each text."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import prepare
from .textblocks import blocks, word_hashes, words

#: Pre-token groups in the broadcast table, and in a worker's cache before it starts anew (16 bytes each, twice).
TABLE, CACHE = 1 << 16, 1 << 20
#: Bytes of the longest word that may be in the table; longer ones, however frequent, are left to the workers' caches.
LONGEST = 256
_workers: dict = {}


def worker(path: str) -> dict:
    """This worker's encoder of a tokenizer and what it has encoded so far."""
    if path not in _workers:
        _workers[path] = {"encode": _encoder(path), "cache": Lengths(np.zeros(0, np.uint64), np.zeros(0, np.int64))}
    return _workers[path]


class Lengths:
    """Sorted hashes and their token counts; a lookup is one binary search for many words."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts

    def get(self, h: np.ndarray) -> np.ndarray:
        """The counts of h; -1 where unknown."""
        if not len(self.keys):
            return np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.counts[at], -1)

    def add(self, h: np.ndarray, counts: np.ndarray) -> Lengths:
        keys, counts = np.concatenate([self.keys, h]), np.concatenate([self.counts, counts])
        order = np.argsort(keys)
        return Lengths(keys[order], counts[order])


def _encoder(path: str):
    """The library's counts of a list of texts, as it gives them without begin, end or special tokens of its own."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread for each task
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return lambda texts: [len(x.ids) for x in t.encode_batch(texts, add_special_tokens=False)]


def splits_at_spaces(path: str) -> bool:
    """Whether a text's tokens are those of its ASCII-space-separated parts.

    True of a tokenizer whose normaliser only works within such parts (composition, lower
    case, any run of white space to one space) and whose pre-tokenizer drops white space; its
    special strings hold none. Other tokenizers are run on whole texts.
    """
    import json

    if not path.endswith(".json"):
        return False
    with open(path) as f:
        t = json.load(f)
    steps = (t.get("normalizer") or {}).get("normalizers") or [t.get("normalizer") or {}]
    local = all(s.get("type") in ("NFC", "Lowercase") or s.get("type") == "Replace" and s.get("pattern") == {"Regex": "\\s+"} and s.get("content") == " " for s in steps)
    pre = t.get("pre_tokenizer") or {}
    parts = pre.get("pretokenizers") or [pre]
    cut = parts[0].get("type") == "Split" and parts[0].get("behavior") == "Removed" and parts[0].get("invert") and parts[0].get("pattern", {}).get("Regex", "").endswith("[^\\s\\p{L}\\p{N}]+")
    whole = all(p.get("type") == "ByteLevel" and not p.get("add_prefix_space") and not p.get("use_regex") for p in parts[1:])
    plain = all(not any(c.isspace() for c in a["content"]) and not (a["lstrip"] or a["rstrip"] or a["single_word"]) for a in t.get("added_tokens") or [])
    return bool(local and cut and whole and plain and t.get("post_processor") is None)


def frequent_lengths(texts: DataFrame, path: str, size: int = TABLE) -> Lengths:
    """The counts of the size most frequent space-separated words: each task keeps those of its
    own counts that reach 1/size of its words, and only their sums meet."""

    def partial(batches):
        known = np.zeros(0, np.uint64)
        n = np.zeros(0, np.int64)
        spelled: dict[int, bytes] = {}

        def trim(least):
            nonlocal known, n
            keep = np.argsort(-n, kind="stable")[: size // 4]
            keep = np.sort(keep[n[keep] >= least])
            known, n = known[keep], n[keep]

        total = 0
        for batch in batches:
            for block in blocks(batch.column(0)):
                w = words(block)
                h, at, c = np.unique(word_hashes(block, w), return_index=True, return_counts=True)
                total += len(w.start)
                often = (c > 1) & ((w.end - w.start)[at] <= LONGEST)
                for x, i in zip(h[often].tolist(), at[often].tolist()):
                    if x not in spelled:
                        spelled[x] = block.data[w.start[i] : w.end[i]].tobytes()
                h, c = np.concatenate([known, h[often]]), np.concatenate([n, c[often]])
                known, back = np.unique(h, return_inverse=True)
                n = np.bincount(back, c).astype(np.int64) if len(back) else np.zeros(0, np.int64)
                if len(known) > size:
                    trim(2)
                    keep = set(known.tolist())
                    spelled = {k: v for k, v in spelled.items() if k in keep}
        trim(max(2, total // size))
        yield pa.RecordBatch.from_arrays([pa.array([spelled[x].decode() for x in known.tolist()], pa.string()), pa.array(n)], ["w", "n"])

    counted = texts.mapInArrow(partial, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    top = [r.w for r in counted.orderBy(F.desc("n"), "w").limit(size).collect()]
    return table_of(top, _encoder(path))


def table_of(texts: list[str], encode) -> Lengths:
    if not texts:
        return Lengths(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    hashes = []
    for block in blocks(pa.array(texts, pa.string())):
        hashes.append(word_hashes(block, words(block)))
    h, at = np.unique(np.concatenate(hashes), return_index=True)
    return Lengths(h, np.array(encode(texts), np.int64)[at])


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", table_size: int = TABLE) -> DataFrame:
    """(id, n_bytes, n_tokens) for every row of docs, as the tokenizer's own library counts.

    A compact table (64-bit word hash, count) of the most frequent words is broadcast, at most
    16 * table_size bytes; on its way it passes the driver, as table_size words of LONGEST bytes
    at most. Words it lacks are encoded once by each worker and cached there, up
    to CACHE of them; no word is ever shuffled. A word here is what stands between ASCII
    spaces; where a tokenizer does not allow that (splits_at_spaces) whole texts are encoded.
    Null and empty texts have 0 bytes and 0 tokens. Repeated rows give repeated results, and
    further columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {dict(slim.dtypes)['id']}, n_bytes long, n_tokens long"
    if not splits_at_spaces(tokenizer_path):

        def whole(batches):
            encode = worker(tokenizer_path)["encode"]
            for batch in batches:
                texts = [x or "" for x in batch.column(1).to_pylist()]
                n = [c for i in range(0, len(texts), 64) for c in encode(texts[i : i + 64])]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

        return slim.mapInArrow(whole, schema)
    table = frequent_lengths(slim.select("text"), tokenizer_path, table_size)
    frequent = spark.sparkContext.broadcast((table.keys, table.counts))

    def run(batches):
        first = Lengths(*frequent.value)
        state = worker(tokenizer_path)
        encode, cache = state["encode"], state["cache"]
        for batch in batches:
            n_bytes, n_tokens = [], []
            for block in blocks(batch.column(1), 4 << 20):
                w = words(block)
                h, at, back = np.unique(word_hashes(block, w), return_index=True, return_inverse=True)
                n = first.get(h)
                miss = np.flatnonzero(n < 0)
                n[miss] = cache.get(h[miss])
                miss = miss[n[miss] < 0]
                if len(miss):
                    data = block.data.tobytes()
                    new = encode([data[s:e].decode() for s, e in zip(w.start[at[miss]].tolist(), w.end[at[miss]].tolist())])
                    n[miss] = new
                    if len(cache.keys) + len(miss) > CACHE:
                        cache = Lengths(np.zeros(0, np.uint64), np.zeros(0, np.int64))
                    cache = cache.add(h[miss], n[miss])
                total = np.zeros(len(w.start) + 1, np.int64)
                np.cumsum(n[back], out=total[1:])
                n_tokens.append(total[w.at[1:]] - total[w.at[:-1]])
                n_bytes.append(np.diff(block.at))
            state["cache"] = cache
            z = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([z, *n_bytes])), pa.array(np.concatenate([z, *n_tokens]))], ["id", "n_bytes", "n_tokens"])

    return slim.mapInArrow(run, schema)
