"""Toxicity by a support vector machine with a subsequence string kernel and Nyström landmarks.

The kernel of two tokens counts their common subsequences of four letters (token bounds are
letters too) that span at most six places, each weighed by DECAY for every place it skips.
So a word with characters inserted, or with some left between, is still near the word. The
span bound makes the feature space finite: a trained machine, a weighted sum of kernels with
its landmarks, is the same function as one table of 2**20 weights, and a token is scored by
adding the entries of its own subsequences. Two words in a row are a token as well, with a
bound between them, where the labelled texts show that words are toxic only together.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import prepare, release
from .textblocks import blocks, mix, word_hashes, words
from .token_counts import Lengths

ORDER, SPAN, DECAY = 4, 6, 0.6
LANDMARKS, ROUNDS = 240, 4
#: Rows of each label that the machine is fitted on at most; the sample is by a hash of the id.
SAMPLE = {1: 1000, 0: 2000}
THRESHOLD = 0.7
#: Pairs of words that a machine learns as toxic together at most.
PHRASES = 200
CACHE = 1 << 19
#: Tokens that the driver weighs at once while it trains, beside Spark's own memory.
WEIGHED = 4000

_BOUND = 31
_LETTER = np.zeros(256, np.uint8)
_LETTER[97:123] = _LETTER[65:91] = np.arange(1, 27)
for _c, _l in zip(b"0134578@$!", b"oieastbasi"):  # look-alikes
    _LETTER[_c] = _l - 96
_LETTER[32] = _BOUND  # between the words of a phrase; words have no spaces
_EDGE = np.ones(256, bool)  # not part of a token's core: punctuation and look-alikes at its ends
_EDGE[48:58] = _EDGE[65:91] = _EDGE[97:123] = _EDGE[0x80:] = False

_OFFSETS = [(0, *o) for o in combinations(range(1, SPAN), ORDER - 1)]
_WEIGHTS = np.array([DECAY ** (o[-1] + 1 - ORDER) for o in _OFFSETS], np.float32)
_workers: dict = {}


def _symbol(point: int) -> int:
    """The letter of a character beyond ASCII, in either case: one of four of their own for accented Latin ones, one of 30 by its code point in other scripts (neighbours differ); 0 if it is no letter or digit."""
    c = ord(chr(point).lower()[0])
    return 0 if not chr(c).isalnum() else 27 + (c & 3) if c < 0x250 else 1 + c % 30


_POINT = np.array([_symbol(p) for p in range(0x600)], np.int64)


def symbols(raw: np.ndarray) -> np.ndarray:
    """The letter of each character at its first byte, 0 elsewhere."""
    out = _LETTER[raw].astype(np.int64)
    lead = np.flatnonzero(raw >= 0xC0)
    if len(lead):
        b = [np.append(raw, np.zeros(3, np.uint8))[lead + k].astype(np.int64) for k in range(4)]
        two, three = (b[0] & 0x1F) << 6 | b[1] & 0x3F, (b[0] & 0x0F) << 12 | (b[1] & 0x3F) << 6 | b[2] & 0x3F
        four = (b[0] & 0x07) << 18 | (b[1] & 0x3F) << 12 | (b[2] & 0x3F) << 6 | b[3] & 0x3F
        point = np.where(b[0] < 0xE0, two, np.where(b[0] < 0xF0, three, four))
        mark = (point >= 0x2000) & (point < 0x2C00) | (point >= 0x3000) & (point < 0x3040) | (point >= 0xFE00) & (point < 0xFF10)
        out[lead] = np.where(point < len(_POINT), _POINT[np.minimum(point, len(_POINT) - 1)], np.where(mark, 0, 1 + point % 30))
    return out


def letters(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens' letters, each token between two bounds, and where tokens begin."""
    joined = b"\n".join(tokens) + b"\n"
    raw = np.frombuffer(joined, np.uint8)
    ends = np.flatnonzero(raw == 10)
    # strip what is not alphanumeric from both ends
    core = np.where(_EDGE[raw], -1, np.arange(len(raw)))
    last = np.maximum.accumulate(core)
    first = np.minimum.accumulate(np.where(core < 0, len(raw), core)[::-1])[::-1]
    start = np.concatenate([[0], ends[:-1] + 1])
    token = np.repeat(np.arange(len(tokens)), ends - start + 1)
    place = np.arange(len(raw))
    letter = symbols(raw)
    inside = (place >= first[start][token]) & (place <= last[ends][token]) & (letter > 0)
    kept = np.flatnonzero(inside)
    n = np.bincount(token[kept], minlength=len(tokens)) + 2
    at = np.zeros(len(tokens) + 1, np.int64)
    np.cumsum(n, out=at[1:])
    out = np.full(at[-1], _BOUND, np.int64)
    mask = np.ones(at[-1], bool)
    mask[at[:-1]] = mask[at[1:] - 1] = False
    out[mask] = letter[kept]
    return out, at


def features(tokens: list[bytes]):
    """For each way to skip: (token, subsequence, weight). A token's sums over these are its feature vector."""
    x, at = letters(tokens)
    token = np.repeat(np.arange(len(tokens)), np.diff(at))
    for o, weight in zip(_OFFSETS, _WEIGHTS):
        n = len(x) - o[-1]
        if n <= 0:
            continue
        ok = np.flatnonzero(token[:n] == token[o[-1] :])
        key = x[ok]
        for k in o[1:]:
            key = key << 5 | x[ok + k]
        yield token[ok], key, weight


def scale(tokens: list[bytes]) -> np.ndarray:
    """The kernel's norm of each token, by its length: that of a token whose subsequences all differ."""
    _, at = letters(tokens)
    n = np.diff(at)
    return np.sqrt(sum(float(w) ** 2 * np.maximum(0, n - o[-1]) for o, w in zip(_OFFSETS, _WEIGHTS)) + 1e-9)


def weigh(tokens: list[bytes], table: np.ndarray) -> np.ndarray:
    """The product of each token's normalised feature vector with a table of weights."""
    total = np.zeros(len(tokens))
    for token, key, weight in features(tokens):
        total += np.bincount(token, table[key], len(tokens)) * weight
    return total / scale(tokens)


def kernel(tokens: list[bytes], landmarks: list[bytes]) -> np.ndarray:
    """The normalised kernel of tokens and landmarks."""
    own = [(t, k, np.full(len(t), w)) for t, k, w in features(landmarks)]
    t, k, w = (np.concatenate(z) for z in zip(*own))
    keys, k = np.unique(k, return_inverse=True)
    dense = np.zeros((len(keys) + 1, len(landmarks)), np.float32)
    np.add.at(dense, (k, t), w)
    dense /= scale(landmarks)
    out = np.zeros((len(tokens), len(landmarks)), np.float32)
    for token, key, weight in features(tokens):
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = keys[at] == key
        np.add.at(out, token[hit], dense[at[hit]] * weight)
    return out / scale(tokens)[:, None]


def spaced(found: list[bytes]) -> list[bytes]:
    out, run = [], []
    for t in [*found, b"  "]:
        if len(t) <= 2 and sum(48 <= c < 58 or 97 <= c < 123 or 65 <= c < 91 or c in b"@$!" for c in t) == 1:
            run.append(t)
        else:
            if len(run) >= 3:
                out.append(b"".join(run))
            run = []
    return out


@dataclass
class Machine:
    """weights and bias of a token's decision; slope and shift of a text's probability; landmarks for the record; whether pairs of words are scored."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    landmarks: list[bytes]
    phrases: bool = False

    def probability(self, decision: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * decision + self.shift, -30, 30)))


def squared_hinge(z: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weights (bias last) of the linear machine with squared hinge loss, by Newton steps on the support vectors."""
    z = np.hstack([z, np.ones((len(z), 1))]).astype(np.float64)
    v = np.zeros(z.shape[1])
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-4
    active = None
    for _ in range(rounds):
        now = y * (z @ v) < 1
        if active is not None and (now == active).all():
            break
        active = now
        s = z[now] * cost[now][:, None]
        v = np.linalg.solve(ridge + s.T @ z[now], s.T @ y[now])
    return v


def fit(tokens: list[bytes], rows: list[np.ndarray], toxic: np.ndarray, calibrate: np.ndarray, sequences: list[np.ndarray] = (), n_landmarks: int = LANDMARKS) -> Machine:
    """Fit on labelled texts, each given by the numbers of its distinct tokens, and of all in order (-1: a break) in sequences.

    A text is toxic if one of its tokens is, so the tokens that make it so are found along
    with the machine. Tokens that toxic texts have and clean ones lack, oftener than chance
    explains, are positive from the start (telling_tokens). To them every round adds the highest
    token of each toxic text, first by naive Bayes on subsequences, then by the machine so
    far, against tokens of clean texts, high and other. Telling tokens also come with a letter
    inserted. Pairs of words that tell, though neither word does, become tokens of their texts,
    beside pairs of clean texts that share a word with one. Texts marked calibrate only fit the
    probability; near copies of an earlier text are left out. Without both labels every text
    gets 0.
    """
    fresh = unlike(tokens, rows)
    sequences = [d for d, f in zip(sequences, fresh) if f]
    rows, toxic, calibrate = [d for d, f in zip(rows, fresh) if f], toxic[fresh], calibrate[fresh]
    y = toxic.astype(bool)
    train = ~calibrate
    if not train.any() or y[train].all() or not y[train].any():
        return Machine(np.zeros(1 << 5 * ORDER, np.float32), 0.0, 0.0, -30.0, [])
    telling = telling_tokens([rows[d] for d in np.flatnonzero(train)], y[train], len(tokens))
    phrases = telling_pairs([sequences[d] for d in np.flatnonzero(train)], y[train], telling, len(tokens)) if len(sequences) else np.zeros(0, np.int64)
    if len(phrases):
        tokens, rows, own = with_pairs(tokens, rows, sequences, y, phrases)
        telling = np.concatenate([telling, own])
    seen = np.zeros((2, 1 << 5 * ORDER), np.float32)
    for d, label in zip(np.flatnonzero(train), y[train]):
        own = [tokens[i] for i in rows[d]]
        if own:
            seen[int(label), np.unique(np.concatenate([k for _, k, _ in features(own)] or [np.zeros(0, np.int64)]))] += 1
    n1, n0 = int(y[train].sum()), int((~y[train]).sum())
    table = (np.log((seen[1] + 0.5) / (n1 + 1)) - np.log((seen[0] + 0.5) / (n0 + 1))).astype(np.float32)
    # subsequences too rare in toxic texts say nothing
    table[seen[1] < max(2, 0.004 * n1)] = np.minimum(0, table)[seen[1] < max(2, 0.004 * n1)]

    def score_all(table):
        return np.concatenate([weigh(tokens[i : i + WEIGHED], table) for i in range(0, len(tokens), WEIGHED)]) if tokens else np.zeros(0)

    top = lambda score, d, n: rows[d][np.argsort(-score[rows[d]], kind="stable")[:n]]
    score, bias, marks = score_all(table), 0.0, []
    gapped = [v for i in telling for v in inserted(tokens[i])]
    order = mix(np.arange(len(tokens), dtype=np.uint64))
    for _ in range(ROUNDS):
        good = [top(score, d, 1) for d in np.flatnonzero(train & y) if len(rows[d])]
        bad = [np.concatenate([top(score, d, 2), rows[d][np.argsort(order[rows[d]])[:3]]]) for d in np.flatnonzero(train & ~y) if len(rows[d])]
        good += [telling] * 3
        pos, n_pos = np.unique(np.concatenate(good), return_counts=True)
        neg, n_neg = np.unique(np.concatenate(bad), return_counts=True)
        keep = ~np.isin(pos, neg[n_neg > 1])  # common in clean texts as well
        pos, n_pos = (pos[keep], n_pos[keep]) if keep.any() else (pos, n_pos)
        by_count = pos[np.argsort(-n_pos, kind="stable")]
        high = neg[np.argsort(-score[neg], kind="stable")]
        marks = [tokens[i] for i in dict.fromkeys([*by_count[: n_landmarks * 2 // 3].tolist(), *high[: n_landmarks // 3].tolist()])]
        own = kernel(marks, marks).astype(np.float64)
        value, vector = np.linalg.eigh((own + own.T) / 2)
        root = vector[:, value > 1e-6] / np.sqrt(value[value > 1e-6])
        both = np.concatenate([pos, neg])
        z = kernel([tokens[i] for i in both] + gapped, marks) @ root
        side = np.r_[np.ones(len(pos)), -np.ones(len(neg)), np.ones(len(gapped))]
        cost = np.r_[np.sqrt(n_pos) / np.sqrt(n_pos).sum(), np.sqrt(n_neg) / np.sqrt(n_neg).sum(), np.full(len(gapped), 0.5 / max(1, len(gapped)))] * 200
        v = squared_hinge(z, side, cost)
        share = root @ v[:-1]
        table = np.zeros(1 << 5 * ORDER)
        size = scale(marks)
        for t, k, w in features(marks):
            np.add.at(table, k, share[t] / size[t] * w)
        table, bias = table.astype(np.float32), float(v[-1])
        score = score_all(table) + bias
    best = np.array([score[r].max() if len(r) else min(bias, -1.0) for r in rows])
    use = calibrate if calibrate.any() and y[calibrate].any() and not y[calibrate].all() else np.ones(len(y), bool)
    slope, shift = platt(best[use], y[use])
    return Machine(table, bias, slope, shift, marks, len(phrases) > 0)


def core(token: bytes) -> bytes:
    """A token without what is not alphanumeric at its ends."""
    return token.strip(bytes(np.flatnonzero(_EDGE).astype(np.uint8)))


def unlike(tokens: list[bytes], rows: list[np.ndarray], bands: int = 4) -> np.ndarray:
    """Which texts share with no earlier one the two least hashes of any band of their long tokens."""
    h = mix(np.array([int.from_bytes(t[:16].ljust(16), "little") % (2**64 - 59) for t in tokens], np.uint64))
    long = np.array([len(t) >= 7 for t in tokens], bool)
    seen, out = set(), np.ones(len(rows), bool)
    for i, r in enumerate(rows):
        own = np.sort(h[r[long[r]]])
        keys = {(b, *own[own % np.uint64(bands) == b][:2].tolist()) for b in range(bands)} if len(own) >= 16 else set()
        keys = {k for k in keys if len(k) == 3}
        out[i] = not keys & seen
        seen |= keys
    return out


def telling_tokens(rows: list[np.ndarray], y: np.ndarray, n: int) -> np.ndarray:
    """Tokens in so many toxic texts and hardly any clean one that chance gives less than one such token in a hundred fits."""
    if not len(rows):
        return np.zeros(0, np.int64)
    count = lambda side: np.bincount(np.concatenate([np.zeros(0, np.int64), *(r for r, t in zip(rows, y) if t == side)]), minlength=n)
    t, c = count(True), count(False)
    least = np.log(0.01 / max(1, n)) / np.log(y.mean())
    return np.flatnonzero((t >= least) & (c <= 0.02 * t))


def _pairs(sequence: np.ndarray, n: int) -> np.ndarray:
    """The distinct pairs of neighbours of a text, as first * n + second."""
    a, b = sequence[:-1].astype(np.int64), sequence[1:].astype(np.int64)
    ok = (a >= 0) & (b >= 0)
    return np.unique(a[ok] * n + b[ok])


def telling_pairs(sequences: list[np.ndarray], y: np.ndarray, telling: np.ndarray, n: int) -> np.ndarray:
    """Pairs of neighbours without a telling token, at most PHRASES, that tell as single tokens do in telling_tokens."""
    each = [_pairs(s, n) for s in sequences]
    found, count = np.unique(np.concatenate([np.zeros(0, np.int64), *(p for p, t in zip(each, y) if t)]), return_counts=True)
    every = np.unique(np.concatenate([found, *each]))
    least = np.log(0.01 / max(1, len(every))) / np.log(y.mean())
    ok = (count >= least) & ~np.isin(found // max(1, n), telling) & ~np.isin(found % max(1, n), telling)
    found, count = found[ok], count[ok]
    clean = np.zeros(len(found), np.int64)
    for p, t in zip(each, y):
        if not t:
            clean += np.isin(found, p)
    ok = clean <= 0.02 * count
    return found[ok][np.argsort(-count[ok], kind="stable")[:PHRASES]]


def with_pairs(tokens: list[bytes], rows: list[np.ndarray], sequences: list[np.ndarray], y: np.ndarray, phrases: np.ndarray) -> tuple[list[bytes], list[np.ndarray], np.ndarray]:
    """tokens and rows with the phrases, and with up to eight other pairs of each clean text, first those that share a word with a phrase; the phrases' numbers."""
    n = len(tokens)
    number = {p: n + i for i, p in enumerate(phrases.tolist())}
    out = []
    for own, s, t in zip(rows, sequences, y):
        p = _pairs(s, n)
        chosen = p[np.isin(p, phrases)].tolist()
        if not t:
            near = np.isin(p // n, phrases // n) | np.isin(p % n, phrases % n)
            chosen += p[np.lexsort((mix(p.astype(np.uint64)), ~near))][:8].tolist()
        out.append(np.unique(np.concatenate([own, [number.setdefault(x, n + len(number)) for x in chosen]]).astype(np.int64)))
    spelled = [tokens[p // n] + b" " + tokens[p % n] for p in number]
    return tokens + spelled, out, n + np.arange(len(phrases))


def inserted(token: bytes) -> list[bytes]:
    """The token with another letter put in at each inner place."""
    return [token[:p] + bytes([97 + (sum(token) + 7 * p) % 26]) + token[p:] for p in range(1, len(token))] if len(token) >= 4 else []


def platt(x: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and shift of the sigmoid that fits labels y best, with Platt's smoothed targets."""
    n1, n0 = y.sum(), (~y).sum()
    t = np.where(y, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    v = np.array([1.0, 0.0])
    a = np.stack([x, np.ones_like(x)], 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ v, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + 1e-4 * np.eye(2), a.T @ (t - p) - 1e-4 * v)
        v = v + step * min(1.0, 4 / np.abs(step).max())
        if np.abs(step).max() < 1e-9:
            break
    return float(v[0]), float(v[1])


def training_tokens(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE) -> tuple[list[bytes], list[np.ndarray], np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct tokens of a bounded sample of labelled texts that are not held out, the texts by their tokens, their labels, which calibrate, and their tokens in order.

    Rows arrive one partition at a time and are kept as token numbers only. Texts with equal tokens count once.
    """
    pick = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = pick.withColumn("r", F.xxhash64(F.lit("sample"), "doc_id"))
    picked = [pick.where(F.col("toxic") == k).orderBy("r", "doc_id").limit(n) for k, n in sample.items()]
    both = docs.select("doc_id", "text").join(F.broadcast(picked[0].union(picked[1])), "doc_id").select("r", "toxic", "text")

    def run(batches):
        for batch in batches:
            out = []
            for block in blocks(batch.column(2)):
                w, data = words(block), block.data.tobytes()
                for i in range(len(block)):
                    a, b = w.at[i], w.at[i + 1]
                    found = [data[s:e].lower() for s, e in zip(w.start[a:b].tolist(), w.end[a:b].tolist())]
                    out.append(b"\n".join(map(core, [*found, b"", *spaced(found)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["r", "toxic", "tokens"])
        release()

    number: dict[bytes, int] = {}
    texts: dict[bytes, tuple] = {}
    for r in both.mapInArrow(run, "r long, toxic int, tokens binary").toLocalIterator():
        seq = np.array([number.setdefault(t, len(number)) if t else -1 for t in bytes(r.tokens).split(b"\n")], np.int32)
        same = np.unique(seq[seq >= 0]).tobytes()
        if same not in texts or (r.r, r.toxic) < texts[same][:2]:
            texts[same] = (r.r, r.toxic, seq)
    found = sorted(texts.values(), key=lambda x: (x[0], x[1], len(x[2])))
    tokens = sorted(number)
    place = np.full(len(tokens) + 1, -1, np.int32)  # the last for breaks
    for i, t in enumerate(tokens):
        place[number[t]] = i
    sequences = [place[seq] for _, _, seq in found]
    return tokens, [np.unique(s[s >= 0]) for s in sequences], np.array([x[1] for x in found], np.int64), np.array([x[0] % 4 == 0 for x in found], bool), sequences


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    prepare(docs.sparkSession)
    machine = fit(*training_tokens(docs, labels))
    release()
    return machine


def worker_cache(key: str) -> dict:
    """This worker's decisions of tokens, of the one machine last used."""
    if key not in _workers:
        _workers.clear()
        _workers[key] = {"known": Lengths(np.zeros(0, np.uint64), np.zeros(0))}
    return _workers[key]


def toxicity(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row of docs: the probability that the text is toxic, that of its highest token or pair of words.

    Only the text is read. Null and empty texts score as a text without any toxic token. Equal
    texts score alike wherever they stand. The machine (4 MB) is broadcast; workers keep the
    decisions of tokens they have seen, at most CACHE.
    """
    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(machine)
    key = f"{mix(machine.weights.view(np.uint32).astype(np.uint64)).sum()}:{machine.bias}"
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(lambda batches: _score(batches, sent.value, key), f"id {dict(slim.dtypes)['id']}, score double")


def _values(state: dict, machine: Machine, h: np.ndarray, spell) -> np.ndarray:
    """The decisions of tokens with the hashes h, from the worker's cache where it has them; spell gives the bytes of some of them by number."""
    h, at, back = np.unique(h, return_index=True, return_inverse=True)
    known = state["known"]
    place = np.minimum(np.searchsorted(known.keys, h), max(0, len(known.keys) - 1))
    got = known.keys[place] == h if len(known.keys) else np.zeros(len(h), bool)
    value = np.zeros(len(h))
    value[got] = known.counts[place[got]]
    miss = np.flatnonzero(~got)
    for i in range(0, len(miss), 20000):
        part = miss[i : i + 20000]
        value[part] = weigh(spell(at[part]), machine.weights) + machine.bias
    if len(miss):
        state["known"] = (known if len(known.keys) + len(miss) <= CACHE else Lengths(np.zeros(0, np.uint64), np.zeros(0))).add(h[miss], value[miss])
    return value[back]


def _score(batches, machine: Machine, key: str):
    state = worker_cache(key)
    for batch in batches:
        out = [np.zeros(0)]
        for block in blocks(batch.column(1)):
            w, data = words(block), block.data.tobytes()
            h = word_hashes(block, w, fold=True)
            spell = lambda at: [data[s:e] for s, e in zip(w.start[at].tolist(), w.end[at].tolist())]  # noqa: B023, E731
            each = _values(state, machine, h, spell)
            if machine.phrases and len(h) > 1:
                first = np.ones(len(h), bool)  # words that have a next one in their row
                first[w.at[1:][w.at[1:] > 0] - 1] = False
                first = np.flatnonzero(first)
                both = lambda at: [core(a) + b" " + core(b) for a, b in zip(spell(first[at]), spell(first[at] + 1))]  # noqa: B023, E731
                each = each.copy()
                each[first] = np.maximum(each[first], _values(state, machine, mix(h[first] * np.uint64(3) + h[first + 1]), both))
            best = np.full(len(block), min(machine.bias, -1.0))
            some = np.flatnonzero(np.diff(w.at))
            if len(some):
                best[some] = np.maximum.reduceat(each, w.at[some])
            # letters set apart by spaces
            short = w.end - w.start <= 2
            run = np.flatnonzero(short[2:] & short[1:-1] & short[:-2]) if len(short) > 2 else np.zeros(0, np.int64)
            for i in np.unique(np.searchsorted(w.at, run, "right") - 1).tolist():
                apart = spaced([data[s:e].lower() for s, e in zip(w.start[w.at[i] : w.at[i + 1]].tolist(), w.end[w.at[i] : w.at[i + 1]].tolist())])
                if apart:
                    best[i] = max(best[i], (weigh(apart, machine.weights) + machine.bias).max())
            out.append(machine.probability(best))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out))], ["id", "score"])
    release()
