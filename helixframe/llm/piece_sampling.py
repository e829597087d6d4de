"""Distinct sampled segmentations of texts into pieces, by Gumbel top-k on the lattice.

Every path through a text's lattice of vocabulary pieces has a probability: the product of
its pieces' weights over the sum for all paths. Perturbing each path's log-probability by
independent Gumbel noise and taking the k highest gives k distinct paths sampled without
replacement. The paths are never listed: the perturbed value of a node, the highest of the
paths below it, is exact and known before they are (its children's values follow from it by
top-down conditioning), so an A* search that always opens the highest node finds the k
highest paths first. The search runs for many texts at a time on arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import prepare, release
from .textblocks import Block, Words, blocks, mix, powers, word_hashes

#: Segmentations of a text, and the exponent of the pieces' weights (0: all alike, 1: as the vocabulary ranks them).
SAMPLES, SMOOTHING = 2, 0.5
#: Bytes of texts whose lattices are laid out at once, some 200 bytes for each.
SIZE = 1 << 19
#: Units whose lattices a worker keeps (about 0.5 KB each).
UNITS = 1 << 17
_SPACE, _LINE = 0x20, 0x0A
_WIDTH = np.repeat(np.array([1, 2, 3, 4]), [0xC0, 0x20, 0x10, 0x10])
_workers: dict = {}
_compiled: dict = {}


@dataclass(eq=False)
class Vocabulary:
    """Pieces by the hash of their bytes, with a space for the mark of word starts."""

    spelling: list[bytes]
    log_weight: np.ndarray
    of_byte: np.ndarray
    single: np.ndarray  # pieces of one byte
    prefixes: np.ndarray
    piece_at: np.ndarray
    bucket: np.ndarray  # first prefix whose hash begins with these 18 bits
    deepest: int
    longest: int
    one_space_run: bool

    def __post_init__(self):
        size = np.array([len(x) for x in self.spelling])
        self.spelled = np.frombuffer(b"".join(self.spelling), np.uint8)
        self.size, self.spelled_at = size, np.cumsum(size) - size

    def spell(self, pieces: np.ndarray) -> bytes:
        """The bytes of pieces, one after the other."""
        at, _ = flatten(self.spelled_at[pieces], self.size[pieces])
        return self.spelled[at].tobytes()

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash among the prefixes, or -1."""
        at = self.bucket[h >> np.uint64(46)]
        out = np.where(self.prefixes[at] == h, at, -1)
        for k in range(1, self.deepest):
            left = np.flatnonzero(out < 0)
            near = np.minimum(at[left] + k, len(self.prefixes) - 1)
            hit = self.prefixes[near] == h[left]
            out[left[hit]] = near[hit]
        return out


def load(path: str, smoothing: float = SMOOTHING) -> Vocabulary:
    """Read a sentencepiece model. A piece with score -r of a merge list weighs (1 + r) ** -smoothing."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    spelling, weight, of_byte, plain = [b""] * n, np.zeros(n), np.full(256, -1, np.int32), []
    for i in range(n):
        if m.is_byte(i):
            value = int(m.id_to_piece(i)[3:-1], 16)
            spelling[i], of_byte[value] = bytes([value]), i
        elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
            spelling[i] = m.id_to_piece(i).replace("▁", " ").encode()
            weight[i] = -smoothing * np.log1p(max(0.0, -m.get_score(i)))
            plain.append(i)
    if (of_byte < 0).any():
        raise ValueError("the model has no byte pieces, so not every text can be decoded again")
    weight[of_byte] = -smoothing * np.log1p(n)
    single = np.full(256, -1, np.int32)
    found: dict[bytes, int] = {}
    for i in plain:
        if len(spelling[i]) == 1:
            single[spelling[i][0]] = i
        for k in range(1, len(spelling[i])):
            found.setdefault(spelling[i][:k], -1)
        found[spelling[i]] = i
    joined = b"".join(found)
    ends = np.cumsum([len(x) for x in found])
    h = word_hashes(Block(0, np.frombuffer(joined, np.uint8), np.array([0, len(joined)])), Words(np.concatenate([[0], ends[:-1]]), ends, np.array([0, len(ends)])))
    order = np.argsort(h)
    at_space = all(not x.strip(b" ") or b" " not in x[1:].lstrip(b" ") and (x[0] == _SPACE or b" " not in x) and b"\n" not in x for x in (spelling[i] for i in plain))
    begins = h[order] >> np.uint64(46)
    bucket = np.minimum(np.searchsorted(begins, np.arange(1 << 18, dtype=np.uint64)), len(h) - 1).astype(np.int32)
    return Vocabulary(spelling, weight, of_byte, single, h[order], np.array(list(found.values()), np.int32)[order], bucket, int(np.bincount(begins.astype(np.int64)).max()), max(map(len, found)), at_space)


def vocabulary(path: str, smoothing: float) -> Vocabulary:
    if (path, smoothing) not in _workers:
        _workers[path, smoothing] = load(path, smoothing)
    return _workers[path, smoothing]


@dataclass
class Lattices:
    """Nodes are byte places of distinct units, each unit followed by its end; edge[n]:edge[n + 1] leave node n."""

    edge: np.ndarray
    to: np.ndarray
    piece: np.ndarray
    p: np.ndarray
    upto: np.ndarray  # sum of p of a node's edges up to this one
    head: np.ndarray  # first node of each unit


class Store:
    """Lattices of many units in arrays that grow by doubling, so that adding units copies none of those before."""

    KINDS = {"edge": np.int32, "to": np.int32, "piece": np.int32, "p": np.float64, "upto": np.float64, "head": np.int64}

    def __init__(self):
        self.arrays = {k: np.zeros(1 << 16, t) for k, t in self.KINDS.items()}
        self.size = (0, 0, 0)  # nodes, edges, units

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        have = self.arrays[name]
        if at + len(values) > len(have):
            self.arrays[name] = np.concatenate([have[:at], np.zeros(max(len(have), at + len(values) - len(have)) + len(have) - at, have.dtype)])
        self.arrays[name][at : at + len(values)] = values

    def add(self, y: Lattices) -> None:
        nodes, edges, units = self.size
        self._put("edge", nodes + 1, y.edge[1:] + np.int32(edges))
        for name, values in (("to", y.to + np.int32(nodes)), ("piece", y.piece), ("p", y.p), ("upto", y.upto)):
            self._put(name, edges, values)
        self._put("head", units, y.head + nodes)
        self.size = (nodes + len(y.edge) - 1, edges + len(y.to), units + len(y.head))

    def lattices(self) -> Lattices:
        nodes, edges, units = self.size
        own = self.arrays
        return Lattices(own["edge"][: nodes + 1], *(own[k][:edges] for k in ("to", "piece", "p", "upto")), own["head"][:units])


class Compiled:
    """A worker's lattices of units that it has met twice in a block, at most UNITS, and the hashes they are found by."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.hashes, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.store = Store()

    def of(self, data: np.ndarray, w: Words) -> tuple[Lattices, np.ndarray]:
        """Lattices that have all units of a block, and each unit's first node. They hold until the next block, whose units take the place of those not kept."""
        every = word_hashes(Block(0, data, np.array([0, len(data)])), w)
        order = np.argsort(every)
        new = np.ones(len(every), bool)
        new[1:] = every[order[1:]] != every[order[:-1]]
        which = np.empty(len(every), np.int64)
        which[order] = np.cumsum(new) - 1
        one = order[new]
        h, n = every[one], np.diff(np.flatnonzero(new), append=len(every))
        unit = np.full(len(h), -1)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            unit = np.where(self.hashes[at] == h, self.number[at], -1)
        kept = self.store.size
        for often in (True, False):
            new = np.flatnonzero((unit < 0) & ((n > 1) == often))
            unit[new] = self.store.size[2] + np.arange(len(new))
            self.store.add(compile_units(self.v, data, w.start[one[new]], w.end[one[new]]))
            if often and len(self.hashes) + len(new) <= UNITS:
                kept = self.store.size
                if len(new):
                    hashes, number = np.concatenate([self.hashes, h[new]]), np.concatenate([self.number, unit[new]])
                    order = np.argsort(hashes)
                    self.hashes, self.number = hashes[order], number[order]
        known = self.store.lattices()
        self.store.size = kept
        return known, known.head[unit[which]]


def compile_units(v: Vocabulary, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Lattices:
    """The lattices of byte spans of data, with each edge's probability among those that leave its node."""
    length = end - start
    head = np.zeros(len(start) + 1, np.int64)
    np.cumsum(length + 1, out=head[1:])
    count = np.arange(int(length.sum()))
    unit = np.repeat(np.arange(len(start)), length)
    byte_at = count + (start - head[:-1] + np.arange(len(start)))[unit]
    node = count + unit
    room = end[unit] - byte_at
    lead = data[byte_at]
    up, down = powers(len(data) + 1)
    total = _totals(data, up)
    is_first = (lead & 0xC0) != 0x80
    known = v.single[lead] >= 0  # characters that are pieces
    one = np.flatnonzero(known)
    edges = [(node[one], np.ones(len(one), np.int64), v.single[lead[one]])]
    active = np.flatnonzero(is_first)
    width = _WIDTH[lead]
    for n in range(2, v.longest + 1):
        active = active[room[active] >= n]
        if not len(active):
            break
        s = byte_at[active]
        at = v.find(mix((total[s + n] - total[s]) * down[s] + np.uint64(n)))
        hit = at >= 0
        active, piece = active[hit], v.piece_at[at[hit]]
        whole = np.flatnonzero(piece >= 0)
        found = active[whole]
        edges.append((node[found], np.full(len(found), n), piece[whole]))
        if n <= 4:
            known[found[width[found] == n]] = True
    # a character that is no piece is spelled by its bytes
    owner = np.maximum.accumulate(np.where(is_first, count, 0))
    spelled = np.flatnonzero(~known[owner])
    edges.append((node[spelled], np.ones(len(spelled), np.int64), v.of_byte[lead[spelled]]))
    origin, step, piece = (np.concatenate(z) for z in zip(*reversed(edges)))  # long pieces first, which are the likelier ones
    order = np.argsort(origin, kind="stable")
    origin, step, piece = origin[order], step[order], piece[order]
    edge = np.zeros(head[-1] + 1, np.int32)
    np.cumsum(np.bincount(origin, minlength=head[-1]), out=edge[1:])
    to = (origin + step).astype(np.int32)
    weight = v.log_weight[piece]
    # sums over all paths from a node to its unit's end, from the end backwards
    ahead = np.zeros(int(head[-1]))
    most = int(length.max(initial=0))
    far = np.repeat(head[1:] - 1, length + 1)[origin] - origin
    turn = np.argsort(far.astype(np.uint16) if most < 1 << 16 else far, kind="stable")
    cuts = np.searchsorted(far[turn], np.arange(1, most + 2))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if a < b:
            e = turn[a:b]
            new = np.flatnonzero(np.concatenate([[True], origin[e][1:] != origin[e][:-1]]))
            ahead[origin[e][new]] = np.logaddexp.reduceat(weight[e] + ahead[to[e]], new)
    p = np.exp(weight + ahead[to] - ahead[origin])
    # sums within nodes: only single edges' place in their node counts, so a node's own total is taken off
    upto = np.cumsum(p)
    upto -= np.repeat(np.concatenate([[0.0], upto])[edge[:-1]], np.diff(edge)) if len(edge) > 1 else 0
    return Lattices(edge, to, piece, p, upto, head[:-1])


def _totals(data: np.ndarray, up: np.ndarray) -> np.ndarray:
    from .textblocks import _BYTE

    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return total


def node_key(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """What a node's draws depend on: a descent's key and a byte place of its text."""
    return mix(key + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def exponential(x: np.ndarray, which: int | np.ndarray) -> np.ndarray:
    """Unit exponentials, another one for each which."""
    return -np.log(uniform(mix(x + np.asarray(which).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))))


@dataclass
class Descent:
    """Per node passed, in the order of texts and places: its text, place, lattice node, edge taken and its log-probability, that of all before it, and its best other edge's gap."""

    row: np.ndarray
    place: np.ndarray
    node: np.ndarray
    edge: np.ndarray
    log_p: np.ndarray
    before: np.ndarray
    gap: np.ndarray
    at: np.ndarray


def flatten(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers first[i]..first[i] + count[i] - 1 for all i, and where each i begins."""
    begin = np.cumsum(count) - count
    return np.arange(int(count.sum())) - np.repeat(begin - first, count), begin


def descend(lat: Lattices, row: np.ndarray, place: np.ndarray, node: np.ndarray, key: np.ndarray, base: np.ndarray, n_rows: int) -> Descent:
    """From the given nodes (one a unit, in order) to the units' ends, each time along the highest child. base: each row's log-probability before.

    With E = exp(-perturbed value), children race as exponentials of rates p. So the highest
    child is child c with chance p[c], and given that, the lead over the others' best is an
    exponential of the rate of all others: two draws for each node, however many edges it has.
    """
    parts = []
    active = np.argsort(node)  # equal units side by side, so that their edges are read from near places
    now, here = node[active], place[active]
    while len(active):
        count = lat.edge[now + 1] - lat.edge[now]
        go = count > 0
        active, now, here, count = active[go], now[go], here[go], count[go]
        if not len(active):
            break
        chosen, gap = lat.edge[now].copy(), np.full(len(now), np.inf)
        many = np.flatnonzero(count > 1)
        if len(many):
            x = node_key(key[row[active[many]]], here[many])
            u, e = uniform(x), chosen[many]
            last = e + count[many] - 1
            behind = np.flatnonzero((lat.upto[e] <= u) & (e < last))
            while len(behind):
                e[behind] += 1
                behind = behind[(lat.upto[e[behind]] <= u[behind]) & (e[behind] < last[behind])]
            chosen[many] = e
            gap[many] = exponential(x, 1) / np.maximum(1 - lat.p[e], 1e-300)
        parts.append((active, here, now, chosen, gap))
        to = lat.to[chosen]
        here = here + (to - now)
        now = to
    if not parts:
        z = np.zeros(0, np.int64)
        return Descent(z, z, z, z, np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(n_rows + 1, np.int64))
    # a unit's nodes one after the other
    steps = np.zeros(len(node) + 1, np.int64)
    for unit, *_ in parts:
        steps[unit + 1] += 1
    steps = np.cumsum(steps)
    places, nodes, edges = (np.empty(steps[-1], np.int64) for _ in range(3))
    gaps = np.empty(steps[-1])
    for turn, (unit, *columns) in enumerate(parts):
        spot = steps[unit] + turn
        places[spot], nodes[spot], edges[spot], gaps[spot] = columns
    rows = np.repeat(row, np.diff(steps))
    at = np.searchsorted(rows, np.arange(n_rows + 1))
    log_p = np.log(lat.p[edges])
    total = np.concatenate([[0.0], np.cumsum(log_p)])
    before = total[:-1] - total[at[rows]] + base[rows]
    with np.errstate(divide="ignore"):
        return Descent(rows, places, nodes, edges, log_p, before, np.log(gaps), at)


def others(lat: Lattices, d: Descent, nodes: np.ndarray, key: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, log E, number in the descent, edge) of all edges not taken at some of a descent's nodes; E = exp(-perturbed value)."""
    if not len(nodes):
        z = np.zeros(0, np.int64)
        return z, np.zeros(0), z, z
    n = d.node[nodes]
    count = lat.edge[n + 1] - lat.edge[n]
    e, begin = flatten(lat.edge[n], count)
    r = d.row[nodes]
    x = node_key(key[r], d.place[nodes])
    free = e != np.repeat(d.edge[nodes], count)
    # which of the others is best, by its rate; each of the rest comes after it as if the race began there
    share = np.where(free, lat.p[e], 0.0)
    upto = np.cumsum(share)
    before = np.concatenate([[0.0], upto])[begin]
    total = np.add.reduceat(share, begin)
    cross = before + uniform(mix(x + np.uint64(0x632BE59BD9B4E019))) * total
    i = np.repeat(np.arange(len(n)), count)
    first = np.full(len(n), -1)
    past = np.flatnonzero(free & (upto > cross[i]))
    group, at = np.unique(i[past], return_index=True)
    first[group] = past[at]
    lost = np.flatnonzero(first < 0)  # the sum's last digit
    for k in lost.tolist():
        first[k] = np.flatnonzero((i == k) & free)[-1]
    lead = np.exp(d.gap[nodes])
    gap = lead[i] + exponential(x[i], 2 + e - lat.edge[n][i]) / np.maximum(share, 1e-300)
    gap[first] = lead
    keep = np.flatnonzero(free)
    with np.errstate(divide="ignore"):
        log_e = np.logaddexp(low[r][i[keep]], np.log(gap[keep]) - d.before[nodes][i[keep]])
    return r[i[keep]], log_e, nodes[i[keep]], e[keep]


def best_nodes(d: Descent, k: int) -> np.ndarray:
    """Each row's k nodes whose best edge not taken has the least E; the k least edges of a row are all at these."""
    full = np.flatnonzero(np.diff(d.at))
    if not len(full):
        return np.zeros(0, np.int64)
    log_e = d.gap - d.before  # in the order of E within a row, to which each adds the same
    out = []
    for _ in range(k):
        least = np.full(len(d.at) - 1, np.inf)
        least[full] = np.minimum.reduceat(log_e, d.at[full])
        hit = np.flatnonzero((log_e == least[d.row]) & (log_e < np.inf))
        if not len(hit):
            break
        hit = hit[np.concatenate([[True], d.row[hit[1:]] != d.row[hit[:-1]]])]
        out.append(hit)
        log_e[hit] = np.inf
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def units_of(v: Vocabulary, block: Block) -> tuple[np.ndarray, Words]:
    """The block's bytes with a space before each text that has any, and its units: parts of which no piece crosses the bounds."""
    n = np.diff(block.at)
    some = n > 0
    at = np.zeros(len(block) + 1, np.int64)
    np.cumsum(n + some, out=at[1:])
    data = np.full(at[-1], _SPACE, np.uint8)
    inside = np.ones(at[-1], bool)
    inside[at[:-1][some]] = False
    data[inside] = block.data
    head = np.zeros(len(data), bool)
    head[at[:-1][some]] = True
    if v.one_space_run and len(data):
        space, line = data == _SPACE, data == _LINE
        head[1:] |= space[1:] & ~space[:-1] | line[1:] | line[:-1]
    start = np.flatnonzero(head)
    return data, Words(start, np.append(start[1:], len(data)) if len(start) else start, np.searchsorted(start, at))


def sample_block(v: Vocabulary, block: Block, keys: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each row its up to k segmentations, the highest first: (pieces, log-probability, perturbed value, log of the inclusion score)."""
    n_rows = len(block)
    data, w = units_of(v, block)
    if v not in _compiled:
        _compiled.clear()
        _compiled[v] = Compiled(v)
    lat, node = _compiled[v].of(data, w)
    row = w.row
    text_at = np.zeros(n_rows + 1, np.int64)
    text_at[:] = np.append(w.start, len(data))[w.at]
    place = w.start - text_at[row]
    low = np.log(exponential(mix(keys + np.uint64(1)), 0))  # log E of each text's root
    key = mix(keys + np.uint64(2))
    d = descend(lat, row, place, node, key, np.zeros(n_rows), n_rows)
    every = [d]
    # frontier: row, log E, descent, node's number in it, edge
    frontier = _rows(others(lat, d, best_nodes(d, k), key, low), 0)
    found: list[list] = [[(0, low[i])] for i in range(n_rows)]
    origin = [(np.full(n_rows, -1), np.zeros(n_rows, np.int64), np.zeros(n_rows, np.int64))]
    kappa = np.full(n_rows, np.inf)
    for s in range(1, k + 1):
        order = np.lexsort((frontier["e"], frontier["row"]))
        frontier = frontier[order]
        first = np.flatnonzero(np.concatenate([[True], frontier["row"][1:] != frontier["row"][:-1]])) if len(frontier) else np.zeros(0, np.int64)
        top = frontier[first]
        if s == k:
            kappa[top["row"]] = top["e"]
            break
        frontier = np.delete(frontier, first)
        parent, number, edge = (np.full(n_rows, -1), np.zeros(n_rows, np.int64), np.zeros(n_rows, np.int64))
        parent[top["row"]], number[top["row"]], edge[top["row"]] = top["d"], top["i"], top["edge"]
        origin.append((parent, number, edge))
        low_s = np.full(n_rows, np.inf)
        low_s[top["row"]] = top["e"]
        # nodes from the edge's end to the unit's, then the later units
        start_node, start_place, base = np.zeros(n_rows, np.int64), np.zeros(n_rows, np.int64), np.zeros(n_rows)
        for t in range(s):
            r = np.flatnonzero(parent == t)
            i = number[r]
            start_node[r] = lat.to[edge[r]]
            start_place[r] = every[t].place[i] + lat.to[edge[r]] - every[t].node[i]
            base[r] = every[t].before[i] + np.log(lat.p[edge[r]])
        r = np.flatnonzero(parent >= 0)
        later = np.flatnonzero((parent[row] >= 0) & (place >= start_place[row]))
        u_row, u_place, u_node = np.concatenate([r, row[later]]), np.concatenate([start_place[r], place[later]]), np.concatenate([start_node[r], node[later]])
        order = np.lexsort((np.arange(len(u_row)), u_row))
        key = mix(keys + np.uint64(2 + s))
        d = descend(lat, u_row[order], u_place[order], u_node[order], key, base, n_rows)
        every.append(d)
        frontier = np.concatenate([frontier, _rows(others(lat, d, best_nodes(d, k), key, low_s), s)])
        for x in r.tolist():
            found[x].append((s, low_s[x]))
    out = []
    for x in range(n_rows):
        rows = []
        for s, e in found[x]:
            edges, logs = _path(lat, every, origin, s, x)
            total = float(logs.sum())
            rows.append((lat.piece[edges], total, -float(e), inclusion(total + float(kappa[x]))))
        out.append(rows)
    return out


def inclusion(x: float) -> float:
    """log(1 - exp(-exp(x))), the log of the chance to pass a perturbed value x below the log-probability; 0 for an infinite x."""
    return x if x < -30 else float(np.log(-np.expm1(-np.exp(min(50.0, x)))))


_FRONTIER = np.dtype([("row", np.int64), ("e", np.float64), ("d", np.int64), ("i", np.int64), ("edge", np.int64)])


def _rows(found, s: int) -> np.ndarray:
    row, log_e, i, edge = found
    out = np.empty(len(row), _FRONTIER)
    out["row"], out["e"], out["d"], out["i"], out["edge"] = row, log_e, s, i, edge
    return out


def _path(lat: Lattices, every: list[Descent], origin, s: int, x: int):
    """The edges of row x's sample s and their log-probabilities: those it shares with the one it left, its own edge, then its own nodes."""
    d = every[s]
    a, b = int(d.at[x]), int(d.at[x + 1])
    edges, logs = d.edge[a:b], d.log_p[a:b]
    parent, number, edge = (int(z[x]) for z in origin[s])
    if parent < 0:
        return edges, logs
    e0, l0 = _path(lat, every, origin, parent, x)
    keep = len(e0) - int(every[parent].at[x + 1]) + number  # the parent's own nodes are the last of its path
    return np.concatenate([e0[:keep], [edge], edges]), np.concatenate([l0[:keep], [np.log(lat.p[edge])], logs])


def decode(v: Vocabulary, pieces: list[int]) -> str:
    """The text of a segmentation: its pieces' bytes without the first space."""
    return v.spell(np.asarray(pieces, np.int64))[1:].decode()


_SCHEMA = "id {}, sample int, pieces array<int>, log_prob double, perturbed double, log_inclusion double"


def sample_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES, smoothing: float = SMOOTHING, seed: int = 0) -> DataFrame:
    """(id, sample, pieces, log_prob, perturbed, log_inclusion): each text's samples distinct segmentations, highest first.

    Drawn without replacement, each time in proportion to exp(log_prob). log_inclusion is the
    log of the chance that a segmentation of that log-probability passes the (samples + 1)-th
    highest perturbed value, 0 where there is none; dividing by that chance makes sums over
    the samples unbiased. The noise depends on seed, the row's id and places in the text only, so
    neither other rows nor partitions change a result; rows that repeat an id and a text get
    the same one. A text with fewer segmentations gives all it has. Null and empty texts have
    one, without pieces. Characters that are no piece are spelled in bytes. There is no
    shuffle, and further columns are not read.
    """
    prepare(docs.sparkSession)

    def run(batches):
        for ids, texts, rows in _sampled(batches, model_path, samples, smoothing):
            who = [i for i, r in enumerate(rows) for _ in r]
            flat = [x for r in rows for x in r]
            numbers = [pa.array([k for r in rows for k in range(len(r))], pa.int32()), _lists(rows), *(pa.array([x[c] for x in flat], pa.float64()) for c in (1, 2, 3))]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(who, pa.int64())), *numbers], ["id", "sample", "pieces", "log_prob", "perturbed", "log_inclusion"])

    slim = _keyed(docs, id_col, text_col, seed)
    return slim.mapInArrow(run, _SCHEMA.format(dict(slim.dtypes)["id"]))


def decode_pieces(encoded: DataFrame, model_path: str, pieces_col: str = "pieces") -> DataFrame:
    """encoded with the column decoded: the text that pieces_col spells (null: null). A column of that name is replaced."""
    prepare(encoded.sparkSession)

    @F.pandas_udf("string")
    def spell(column):
        v = vocabulary(model_path, SMOOTHING)
        return column.map(lambda x: None if x is None else decode(v, x.tolist()))

    return encoded.withColumn("decoded", spell(F.col(pieces_col)))


def encode_and_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES, smoothing: float = SMOOTHING, seed: int = 0) -> DataFrame:
    """(id, sample, n_tokens, log_prob, perturbed, log_inclusion, pieces, pieces_sha256, decodes): sample_pieces, and decode_pieces compared with the text, at once.

    pieces_sha256 is that of the piece numbers as little-endian 32-bit integers, decodes
    whether they spell the text again.
    """
    import hashlib

    prepare(docs.sparkSession)

    def run(batches):
        for ids, texts, rows in _sampled(batches, model_path, samples, smoothing):
            v = vocabulary(model_path, smoothing)
            out = [(i, k, len(x[0]), x[1], x[2], x[3], hashlib.sha256(x[0].astype("<i4").tobytes()).hexdigest(), v.spell(x[0])[1:] == texts(i)) for i, r in enumerate(rows) for k, x in enumerate(r)]
            c = list(zip(*out)) or [[]] * 8
            kinds = [pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string(), pa.bool_()]
            columns = [ids.take(pa.array(c[0], pa.int64())), *(pa.array(x, k) for x, k in zip(c[1:], kinds))]
            yield pa.RecordBatch.from_arrays([*columns[:6], _lists(rows), *columns[6:]], ["id", "sample", "n_tokens", "log_prob", "perturbed", "log_inclusion", "pieces", "pieces_sha256", "decodes"])

    slim = _keyed(docs, id_col, text_col, seed)
    return slim.mapInArrow(run, f"id {dict(slim.dtypes)['id']}, sample int, n_tokens long, log_prob double, perturbed double, log_inclusion double, pieces array<int>, pieces_sha256 string, decodes boolean")


def _lists(rows) -> pa.ListArray:
    """The pieces of all rows' samples, one list each."""
    flat = [x[0] for r in rows for x in r]
    n = np.cumsum([0, *(len(x) for x in flat)])
    return pa.ListArray.from_arrays(pa.array(n, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *flat]), pa.int32()))


def _keyed(docs: DataFrame, id_col: str, text_col: str, seed: int) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("key"))


def _sampled(batches, model_path: str, samples: int, smoothing: float):
    """Blocks of the batches: their ids, a function that gives a row's bytes, and the rows' segmentations."""
    v = vocabulary(model_path, smoothing)
    for batch in batches:
        keys = batch.column(2).to_numpy().view(np.uint64)
        for block in blocks(batch.column(1), SIZE):
            yield batch.column(0).slice(block.first, len(block)), block.text, sample_block(v, block, keys[block.first : block.first + len(block)], samples)
    release()
