"""Distinct sampled segmentations by Gumbel top-k without replacement over the lattice, and decoding.

A text's segmentations into pieces have the weights of a unigram model over the SentencePiece vocabulary (its BPE ranks,
read as Zipf's law). Backward sums over the lattice give each node's total, hence the exact chance of each next piece.
The k segmentations with the largest perturbed log-probabilities (log p + Gumbel noise) are a sample without replacement;
they are found by perturbed A-star search from the top: the whole set's largest value is a Gumbel variable at log 1 = 0,
and belongs to a segmentation drawn piece by piece. The rest splits into subsets that leave this path at one place; the
largest value of each is a Gumbel variable at the subset's log-mass, cut off at the value above. The best subset is
opened next. Uniform numbers are hashes of the row's key and the place, so a row's samples depend on nothing else.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_right
from heapq import heappop, heappush
from itertools import accumulate, chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .common import documents, schema_with, workers_see_package

#: Weight of the piece of rank r: 1 / (r + SHIFT).
SHIFT = 10.0
#: Edges of lattices that a worker keeps before it starts anew.
POOL_EDGES = 8_000_000
#: Characters of units whose lattices are built at a time, unless one unit has more.
ADD_CHARS = 100_000
#: Characters of the longest unit whose sums over ways are far from the smallest double.
LINEAR = 50
#: Of the hash by which pieces are found.
BASE = 0x9E3779B97F4A7C15
BATCH_CHARS = 1_000_000


_M64 = 2**64 - 1
_C1, _C2, _C3 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def seed_of(*parts: int) -> int:
    """One 64-bit number from several."""
    x = _C1
    for p in parts:
        x = ((x ^ (p & _M64)) * _C2) & _M64
        x ^= x >> 29
        x = (x * _C3) & _M64
        x ^= x >> 32
    return x


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers between 0 and 1, exclusive; x is used up."""
    for shift, factor in ((30, _C2), (27, _C3)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    x >>= np.uint64(11)
    out = x.astype(np.float64)
    out += 0.5
    out *= 2.0**-53
    return out


def uniform(seed, place) -> np.ndarray:
    """Numbers between 0 and 1, exclusive, from seeds and places (numbers or arrays)."""
    return _mixed(np.asarray(place).astype(np.uint64) * np.uint64(_C1) + np.asarray(seed, np.uint64))


#: Multiples of _C1, for places from 0 on.
_STEPS = np.arange(1 << 14, dtype=np.uint64) * np.uint64(_C1)


def uniform_row(seed: int, n: int) -> np.ndarray:
    """uniform(seed, place) for the places below n."""
    return _mixed(_STEPS[:n] + np.uint64(seed)) if n <= len(_STEPS) else uniform(np.uint64(seed), np.arange(n))


def uniform_one(seed: int) -> float:
    return float(uniform(np.array([seed], np.uint64), np.array([1]))[0])


class Lattices:
    """Lattices of a vocabulary's units (a word with the blanks before it), in common arrays of nodes and edges."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: dict[str, tuple[int, float]] = {}
        self.bytes = {}
        self.text: list[bytes] = []
        for i in range(sp.get_piece_size()):
            piece, score = sp.id_to_piece(i), sp.get_score(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.text.append(bytes([int(piece[3:5], 16)]))
            else:
                # blanks alone, one or several, have no rank in the file, but texts need them
                usable = not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) and (score > -1e8 or not piece.strip("▁"))
                score = max(score, -float(sp.get_piece_size()))
                if usable:
                    self.pieces[piece] = (i, -float(np.log(-score + SHIFT)))
                self.text.append(piece.replace("▁", " ").encode() if usable else b"")
        self.longest = max(map(len, self.pieces))
        self.byte_weight = -float(np.log(sp.get_piece_size() + SHIFT))
        self._index()
        self.reset()

    def _index(self) -> None:
        """An open table of all beginnings of pieces by hash; those that are no piece themselves have id -1."""
        known: dict[str, tuple[int, float]] = {p[:n]: (-1, 0.0) for p in self.pieces for n in range(1, len(p))}
        known.update(self.pieces)
        bits = (4 * len(known)).bit_length()
        self.shift, self.slots = np.uint64(64 - bits), np.zeros(1 << bits, np.uint64)
        self.slot_ids, self.slot_weights = np.zeros(1 << bits, np.int32), np.zeros(1 << bits)
        for text, (i, log) in known.items():
            h = self._hash(text)
            at = ((h * _C2) & _M64) >> int(self.shift)
            while self.slots[at]:
                at = (at + 1) % len(self.slots)
            self.slots[at], self.slot_ids[at], self.slot_weights[at] = h, i, math.exp(log)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        """Each hash's slot, -1 for what begins no piece."""
        at = ((h * np.uint64(_C2)) >> self.shift).astype(np.int64)
        found = self.slots[at]
        open_ = np.flatnonzero((found != h) & (found != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.slots) - 1)
            found[open_] = self.slots[at[open_]]
            open_ = open_[(found[open_] != h[open_]) & (found[open_] != 0)]
        return np.where(found == h, at, -1)

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * BASE + ord(c) + 1) % 2**64
        return h

    def reset(self) -> None:
        self.units: dict[str, int] = {}  # first node by the unit without its first blank
        self.nodes, self.edges = 0, 0
        if hasattr(self, "first"):  # the arrays are written over
            return
        self.first = np.zeros(1 << 16, np.int64)  # a node's first edge; the next node's ends it
        self.cum = np.zeros(1 << 18)  # node + cumulative chance up to and with the edge
        self.log = np.zeros(1 << 18)  # of the edge's chance
        self.rest = np.zeros(1 << 18)  # log of the chance of the node's other edges
        self.target = np.zeros(1 << 18, np.int32)  # next node, -1 at the end
        self.owner = np.zeros(1 << 18, np.int32)  # the node that the edge leaves
        self.ids = np.zeros(1 << 18, np.int32)  # piece, or -1 - code point for a character in bytes

    @staticmethod
    def normal(text: str) -> str:
        return "▁" + text.replace(" ", "▁") if text else ""

    @staticmethod
    def units_of(normal: str) -> list[str]:
        """No piece has a blank behind another character, so the text's segmentations are those of its units, joined."""
        return re.findall("▁+[^▁]*", normal)

    def keys_of(self, text: str) -> list[str]:
        """The text's units, each without its first blank."""
        if not text:
            return []
        words = text.split(" ")
        return words if "" not in words and "▁" not in text else [u[1:] for u in self.units_of(self.normal(text))]

    def add(self, keys: list[str]) -> None:
        """Lattices of new units (without their first blank), all at once: a node before each character and one at the end.

        Rows of matrices are nodes, columns the lengths of the pieces that may follow, falling.
        """
        sizes = np.fromiter(map(len, keys), np.int64, len(keys)) + 1
        begin = np.concatenate([[0], np.cumsum(sizes + 1)])
        longest = int(sizes.max())
        n, width = int(begin[-1]), min(self.longest, longest)
        node = np.arange(n)
        end = np.repeat(begin[1:] - 1, sizes + 1)  # each node's last node
        left = end - node  # characters to the end
        code = np.zeros(n, np.uint64)
        code[left > 0] = np.frombuffer(("▁" + "▁".join(keys)).encode("utf-32-le", "surrogatepass"), np.uint32)
        chance, piece = np.zeros(n * width), np.zeros(n * width, np.int32)
        at = np.flatnonzero(left)
        h = np.zeros(len(at), np.uint64)
        for size in range(1, width + 1):
            fits = left[at] >= size
            at, h = at[fits], h[fits] * np.uint64(BASE)
            if not len(at):
                break
            h += code[at + size - 1] + np.uint64(1)
            slot = self._slot(h)
            ids = np.where(slot >= 0, self.slot_ids[slot], -1)
            hit = np.flatnonzero(ids >= 0)
            cell = at[hit] * width + (width - size)  # long pieces first: the likelier ones, mostly
            chance[cell] = self.slot_weights[slot[hit]]
            piece[cell] = ids[hit]
            if size == 1:
                rest = at[ids < 0]
                c = code[rest].astype(np.int64)
                chance[rest * width + (width - 1)] = np.exp(self.byte_weight * (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)))
                piece[rest * width + (width - 1)] = -1 - c
            on = np.flatnonzero(slot >= 0)
            at, h = at[on], h[on]
        chance = chance.reshape(n, width)
        # sums over ways to the end, from the last node backwards, in all units at once; as logs where they get too small
        total = np.zeros(n) if longest > LINEAR else np.ones(n)
        by_left = np.argsort(left.astype(np.uint16 if longest < 65536 else np.int64), kind="stable")
        steps = np.searchsorted(left[by_left], np.arange(1, longest + 2)).tolist()
        for k, (a, b) in enumerate(zip(steps, steps[1:]), 1):
            if b > a:
                at, m = by_left[a:b], min(k, width)
                w, behind = chance[at, width - m :], total[at[:, None] + np.arange(m, 0, -1)]
                if longest > LINEAR:
                    top = behind.max(1)
                    w *= np.exp(behind - top[:, None])
                    ways = w.sum(1)
                    total[at] = top + np.log(ways)
                else:
                    w *= behind
                    total[at] = ways = w.sum(1)
                chance[at, width - m :] = w / ways[:, None]
        flat = np.flatnonzero(chance)
        start = flat // width
        stop = start + width - (flat - start * width)
        chance, piece = chance.ravel()[flat], piece[flat]
        logs = np.log(chance)
        first = np.concatenate([[0], np.cumsum(np.bincount(start, minlength=n))])
        heads = np.flatnonzero(np.diff(start, prepend=-1))
        size = np.diff(np.append(heads, len(start)))
        sums = np.cumsum(chance)
        sums -= np.repeat(sums[heads] - chance[heads], size)
        sums[heads + size - 1] = 1.0
        with np.errstate(divide="ignore"):
            rest = np.log1p(-np.minimum(chance, 1.0))
        rest[heads[size == 1]] = -np.inf
        old, edge = self.nodes, self.edges
        self.units.update(zip(keys, (old + begin[:-1]).tolist(), strict=True))
        self.first = self._grown(self.first, old, edge + first[:-1], 1)
        target = np.where(stop == end[start], -1, stop + old)
        new = ((self.cum, old + start + np.minimum(sums, 1.0)), (self.log, logs), (self.rest, rest), (self.target, target), (self.owner, old + start), (self.ids, piece))
        self.cum, self.log, self.rest, self.target, self.owner, self.ids = (self._grown(a, edge, x, 0) for a, x in new)
        self.nodes, self.edges = old + n, edge + len(start)
        self.first[self.nodes] = self.edges

    @staticmethod
    def _grown(array: np.ndarray, used: int, new: np.ndarray, spare: int) -> np.ndarray:
        if used + len(new) + spare > len(array):
            array = np.concatenate([array[:used], np.zeros(max(len(array), len(new) + spare), array.dtype)])
        array[used : used + len(new)] = new
        return array

    def ids_of(self, edges: np.ndarray) -> np.ndarray:
        ids = self.ids[edges]
        odd = np.flatnonzero(ids < 0)
        if len(odd):
            raw = [chr(-1 - i).encode() for i in ids[odd].tolist()]
            size = np.ones(len(ids), np.int64)
            size[odd] = [len(r) for r in raw]
            ids = np.repeat(ids, size)
            ids[ids < 0] = [self.bytes[b] for r in raw for b in r]
        return ids

    def starts(self, keys: list[str]) -> np.ndarray:
        new = sorted(set(keys).difference(self.units), key=len)
        at = 0
        while at < len(new):  # matrices of some MB
            n, end = 0, at
            while end < len(new) and (end == at or n + len(new[end]) < ADD_CHARS):
                n, end = n + len(new[end]) + 2, end + 1
            self.add(new[at:end])
            at = end
        return np.fromiter(map(self.units.__getitem__, keys), np.int64, len(keys))

    def walk(self, node: np.ndarray, seed: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draws edges from each node (-1: none) to its unit's end; (which of the nodes, edge), in order."""
        at = np.flatnonzero(node >= 0)
        node = node[at]
        state = ((place[at] << 24).astype(np.uint64)) * np.uint64(_C1) + seed[at]  # uniform(seed, (place << 24) + step)
        whose, edges = [], []
        cum = self.cum
        while len(at):
            x = _mixed(state.copy())
            x += node
            e = self.first[node]
            behind = np.flatnonzero(cum[e] < x)
            while len(behind):  # the likeliest edges come first
                e[behind] += 1
                behind = behind[cum[e[behind]] < x[behind]]
            whose.append(at)
            edges.append(e)
            nxt = self.target[e]
            go = np.flatnonzero(nxt >= 0)
            at, node, state = at[go], nxt[go].astype(np.int64), state[go]
            state += np.uint64(_C1)
        if not whose:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        whose, edges = np.concatenate(whose), np.concatenate(edges)
        order = np.argsort(whose.astype(np.uint16) if len(node) and whose.max() < 65536 else whose, kind="stable")
        return whose[order], edges[order]


class Search:
    """The search of one text: the paths found so far and, for each of their places, the subset that leaves it there.

    A subset of log-mass m below a path of value v has the largest perturbed value -log(exp(-v) + exp(g - m)) with
    g = log(-log(uniform)); so the best subset of a path is that with the smallest g - m.
    """

    def __init__(self, lattices: Lattices, key: int, starts: np.ndarray):
        self.l, self.key, self.starts = lattices, key, starts
        self.paths: list[tuple[np.ndarray, np.ndarray, float, float]] = []  # edges, units, log p, perturbed
        self.gaps: list[np.ndarray] = []  # g - m of each place
        self.logs: list[np.ndarray] = []  # log-probability up to each place
        self.heap: list[tuple[float, int, int]] = []  # (-value, path, place), of each path the best place, and places opened before
        self.taken: dict[tuple[int, int], set[int]] = {}

    def _put_best(self, i: int) -> None:
        """The best place left of path i."""
        if len(self.gaps[i]):
            t = int(self.gaps[i].argmin())
            gap = float(self.gaps[i][t])
            if gap < math.inf:
                heappush(self.heap, (float(np.logaddexp(-self.paths[i][3], gap)), i, t))
                self.gaps[i][t] = math.inf

    def add(self, edges: np.ndarray, units: np.ndarray, perturbed: float, branch: int) -> None:
        """A path that is new from place `branch` on."""
        log = self.l.log[edges]
        sums = np.cumsum(log)
        before = sums - log
        gaps = np.log(uniform_row(seed_of(self.key, len(self.paths), 0x47), len(edges)))
        np.log(np.negative(gaps, out=gaps), out=gaps)
        gaps -= before
        gaps -= self.l.rest[edges]
        gaps[: branch + 1] = math.inf
        self.paths.append((edges, units, float(sums[-1]) if len(sums) else 0.0, perturbed))
        self.logs.append(before)
        self.gaps.append(gaps)
        self._put_best(len(self.paths) - 1)

    def best(self) -> float:
        """Value of the best subset left."""
        return -self.heap[0][0] if self.heap else -math.inf

    def leave(self) -> tuple[int, int, int, float] | None:
        """Opens the best subset: (path, place, edge taken there, value)."""
        if not self.heap:
            return None
        value, i, t = heappop(self.heap)
        value = -value
        edge = int(self.paths[i][0][t])
        node = int(self.l.owner[edge])
        taken = self.taken.get((i, t))
        if taken is None:
            taken = self.taken[i, t] = {edge}
            self._put_best(i)
        free = [e for e in range(int(self.l.first[node]), int(self.l.first[node + 1])) if e not in taken]
        chance = [math.exp(self.l.log[e]) for e in free]
        u = uniform_one(seed_of(self.key, len(self.paths), t, 0x1F)) * sum(chance)
        sums = list(accumulate(chance))
        pick = min(bisect_right(sums, u), len(free) - 1)
        taken.add(free[pick])
        rest = sum(c for j, c in enumerate(chance) if j != pick)
        if rest > 0:  # what is left of the subset stays below this value
            gap = math.log(-math.log(uniform_one(seed_of(self.key, len(self.paths), t, 0x47, 1)))) - float(self.logs[i][t]) - math.log(rest)
            heappush(self.heap, (float(np.logaddexp(-value, gap)), i, t))
        return i, t, free[pick], value


def sample(lattices: Lattices, keys: list[int], texts: list[str], k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """Per text up to k of (ids, log p, perturbed log p, chance of inclusion), best first."""
    l = lattices  # noqa: E741
    if l.edges > POOL_EDGES:
        l.reset()
    units = [l.keys_of(t) for t in texts]
    cuts = np.cumsum([0, *map(len, units)])
    starts = l.starts(list(chain.from_iterable(units)))
    searches = [Search(l, key & _M64, starts[a:b]) for key, a, b in zip(keys, cuts.tolist(), cuts[1:].tolist())]

    def drawn(which: list[int], nodes: list[np.ndarray], places: list[np.ndarray], round_: int):
        """Edges and units of each text's remaining units."""
        n = np.array([len(x) for x in nodes])
        seeds = np.array([seed_of(searches[i].key, round_) for i in which], np.uint64)
        at = np.concatenate(places)
        whose, edges = l.walk(np.concatenate(nodes), np.repeat(seeds, n), at)
        ends = np.searchsorted(whose, np.concatenate([[0], np.cumsum(n)])).tolist()
        at = at[whose]
        return [(edges[a:b], at[a:b]) for a, b in zip(ends, ends[1:], strict=False)]

    every = list(range(len(texts)))
    if every:
        for s, (edges, at) in zip(searches, drawn(every, [s.starts for s in searches], [np.arange(len(s.starts)) for s in searches], 0), strict=True):
            s.add(edges, at, -math.log(-math.log(uniform_one(seed_of(s.key, 0x52)))), -1)
    for r in range(1, k):
        opened = [(i, x) for i in every if (x := searches[i].leave()) is not None]
        if not opened:
            break
        nodes, places = [], []
        for i, (path, t, e, _) in opened:
            unit = int(searches[i].paths[path][1][t])
            nodes.append(np.concatenate([[l.target[e]], searches[i].starts[unit + 1 :]]))
            places.append(np.arange(unit, len(searches[i].starts)))
        for (i, (path, t, e, value)), (edges, at) in zip(opened, drawn([i for i, _ in opened], nodes, places, r), strict=True):
            old, old_at = searches[i].paths[path][:2]
            searches[i].add(np.concatenate([old[:t], [e], edges]), np.concatenate([old_at[: t + 1], at]), value, t)
    out = []
    for s in searches:
        limit = s.best() if len(s.paths) == k else -math.inf
        rows = []
        for edges, _, logp, perturbed in s.paths:
            inclusion = 1.0 if limit == -math.inf else -math.expm1(-math.exp(min(logp - limit, 50.0)))
            rows.append((l.ids_of(edges), logp, perturbed, inclusion))
        out.append(rows)
    return out


def decoded(lattices: Lattices, ids) -> bytes:
    """The bytes of piece ids, one behind the other, with the blank that was put before the text."""
    return b"".join(map(lattices.text.__getitem__, ids))


def decode(lattices: Lattices, ids) -> str:
    """The text of piece ids, without the blank put before it."""
    return decoded(lattices, ids).decode("utf-8", "replace")[1:]


_LATTICES: dict[str, Lattices] = {}


def lattices(name: str) -> Lattices:
    if name not in _LATTICES:
        _LATTICES[name] = Lattices(name if "/" in name else public_tokenizers.path(name))
    return _LATTICES[name]


def sampled_segmentations(df: DataFrame, key: str, model: str = "piece_bpe_32k.model", k: int = 3, seed: int = 9, keep_ids: bool = False) -> DataFrame:
    """For each row of df up to k distinct segmentations of its whole text (column text; others kept, but for text).

    sample int (from 0, by perturbed log-probability), n_pieces long, ids_crc32 long (of little-endian 32-bit ids),
    log_prob, perturbed, inclusion double, decoded boolean (the ids decode to the text), and ids (array) if asked for;
    such columns of df are replaced. inclusion is the chance to be among the sample given the best one that is not.
    A null text counts as empty: one segmentation without pieces. A text with fewer than k segmentations gives all. Rows
    with equal keys and texts give equal samples; a null key counts as 'None'. A very long text is sampled whole, by
    itself; an empty df gives no rows.
    """
    workers_see_package(df.sparkSession)
    df = df.drop("sample", "n_pieces", "ids_crc32", "log_prob", "perturbed", "inclusion", "decoded", "ids")
    names = df.schema.fieldNames()
    at, key_at = names.index("text"), names.index(key)
    schema = schema_with(df.drop("text"), "sample int, n_pieces long, ids_crc32 long, log_prob double, perturbed double, inclusion double, decoded boolean" + ", ids array<int>" * keep_ids)

    def some(b, start: int, end: int):
        l = lattices(model)  # noqa: E741
        part = b.slice(start, end - start)
        texts = [t or "" for t in part.column(at).to_pylist()]
        raw = [b" " + t.encode() if t else b"" for t in texts]
        keys = [xxhash.xxh3_64_intdigest(str(x), seed) for x in part.column(key_at).to_pylist()]
        row, cols = [], [[] for _ in range(7 + keep_ids)]
        for i, found in enumerate(sample(l, keys, texts, k)):
            for j, (ids, logp, perturbed, inclusion) in enumerate(found):
                row.append(i)
                new = (j, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), logp, perturbed, inclusion, decoded(l, ids.tolist()) == raw[i], ids)
                for c, v in zip(cols, new, strict=False):
                    c.append(v)
        kept = pa.RecordBatch.from_arrays([c for x, c in enumerate(part.columns) if x != at], names=[n for n in names if n != "text"]).take(pa.array(row, pa.int64()))
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_(), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(c, t) for c, t in zip(cols, kinds, strict=False))], names=schema.fieldNames())

    def run(batches):
        for b in batches:
            start = n = 0
            for i, t in enumerate(b.column(at)):
                n += len(t.as_py() or "")
                if n >= BATCH_CHARS:
                    yield some(b, start, i + 1)
                    start, n = i + 1, 0
            if start < b.num_rows:
                yield some(b, start, b.num_rows)

    return df.mapInArrow(run, schema)


def op9_gumbel_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled_segmentations(documents(spark, sf_dir).select("doc_id", "text"), "doc_id")
