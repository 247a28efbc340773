"""Packing of tokenised documents into sequences of a fixed capacity by linear grouping.

Token counts are whole numbers up to the capacity, so the bin-packing problem is its histogram, whatever the number of
documents. The driver solves it from that: large lengths are sorted and cut into groups of equal cardinality, each
rounded up to its largest; the configurations of these few sizes are optimised by column generation; actual lengths
replace the rounded ones in order of rank; what is left over and the small lengths go where they fit best. Sequences
that are filled alike form one run, and the number of runs depends on the capacity and the number of groups only. A
document finds its place by its length and its rank among documents of this length; ranks are found in parallel.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, insort

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CACHE_ENTRIES, documents, ranked, schema_with, workers_see_package, written
from .words import sliced


class IdBytes:
    """Token ids of byte_bpe_50k.json as little-endian 32-bit numbers, by a library that holds the same vocabulary.

    Texts are cut at single spaces between other characters, where a token always begins; pieces are kept in a cache.
    """

    SPECIAL = "<|endoftext|>"
    #: A space beside other white space or at an end of the text: there a cut at every space would not be right.
    ODD_EDGE = re.compile(r" \s|[^\S ] |^ | $")

    def __init__(self, name: str):
        import base64

        import tiktoken

        with open(public_tokenizers.path(name.replace(".json", ".tiktoken")), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(
            "ids", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={self.SPECIAL: len(ranks)}
        )
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        ids = self.encoding.encode(text, allowed_special="all")
        return struct.pack(f"<{len(ids)}I", *ids)

    def of(self, text: str) -> bytes:
        if self.SPECIAL in text or "  " in text:
            return self.whole(text)
        first, *rest = text.split(" ")
        if not rest or self.ODD_EDGE.search(text):
            return self.whole(text)
        known = self.known
        try:
            return self.whole(first) + b"".join(map(known.__getitem__, rest))
        except KeyError:
            pass
        if len(known) > CACHE_ENTRIES:
            known.clear()
        encode = self.encoding.encode_ordinary
        for part in set(rest).difference(known):
            ids = encode(" " + part)
            known[part] = struct.pack(f"<{len(ids)}I", *ids)
        return self.whole(first) + b"".join(map(known.__getitem__, rest))


_IDS: dict[str, IdBytes] = {}


def _ids(name: str) -> IdBytes:
    if name not in _IDS:
        _IDS[name] = IdBytes(name)
    return _IDS[name]


def token_pieces(df: DataFrame, tokenizer: str, end_id: int, capacity: int, keep_ids: bool = False) -> DataFrame:
    """df (text string, others kept but for text) with a row per piece: piece int, start, length, ids_crc32 long[, ids].

    A document is its ids and end_id. If longer than capacity, it is cut into pieces of that length, the first being
    shorter where they don't come out even. A null text counts as empty: one piece that holds end_id.
    """
    workers_see_package(df.sparkSession)
    df = df.drop("piece", "start", "length", "ids_crc32", "ids")
    at = df.schema.fieldNames().index("text")
    schema = schema_with(df.drop("text"), "piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)

    def cut(batches):
        ids, end = _ids(tokenizer), struct.pack("<I", end_id)
        for b in (part for whole in batches for part in sliced(whole, at)):
            row, piece, start, length, crc, raw = [], [], [], [], [], []
            for i, text in enumerate(b.column(at).to_pylist()):
                data = ids.of(text or "") + end
                n = len(data) // 4
                s, e, k = 0, n % capacity or capacity, 0
                while s < n:
                    part = data[4 * s : 4 * e]
                    row.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(e - s)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        raw.append(part)
                    s, e, k = e, e + capacity, k + 1
            kept = pa.RecordBatch.from_arrays([c for j, c in enumerate(b.columns) if j != at], names=[c for c in b.schema.names if c != "text"]).take(pa.array(row, pa.int64()))
            new = [pa.array(v, k) for v, k in ((piece, pa.int32()), (start, pa.int64()), (length, pa.int64()), (crc, pa.int64()), *([(raw, pa.binary())] if keep_ids else []))]
            yield pa.RecordBatch.from_arrays([*kept.columns, *new], names=schema.fieldNames())

    return df.mapInArrow(cut, schema)


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[float, np.ndarray]]:
    """The configuration LP by column generation: (times, copies of each size) that meet the demand in fewest sequences."""
    k = len(sizes)
    s, b = np.array(sizes), np.array(demand, float)
    basis = np.diag((capacity // s).astype(float))
    for _ in range(60 * k):
        y = np.linalg.solve(basis.T, np.ones(k))
        # unbounded knapsack for the most valuable configuration
        best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        order = np.argsort(s)
        by_size, values = s[order], y[order]
        for c in range(int(by_size[0]), capacity + 1):
            m = int(np.searchsorted(by_size, c, "right"))
            v = best[c - by_size[:m]] + values[:m]
            j = int(v.argmax())
            if v[j] > best[c - 1]:
                best[c], pick[c] = v[j], order[j]
            else:
                best[c] = best[c - 1]
        if best[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(k), capacity
        while c > 0:
            if pick[c] < 0:
                c -= 1
                continue
            column[pick[c]] += 1
            c -= int(s[pick[c]])
        x, d = np.linalg.solve(basis, b), np.linalg.solve(basis, column)
        up = d > 1e-9
        ratio = np.where(up, x / np.where(up, d, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    x = np.linalg.solve(basis, b)
    return [(max(0.0, t), basis[:, j].astype(int)) for j, t in enumerate(x)]


class Plan:
    """Runs of sequences that are filled alike: [number, room left, [(length, first rank)]]."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room: dict[int, list[list]] = {}
        self.rooms: list[int] = []
        self.used = [0] * (capacity + 1)

    def add(self, n: int, room: int, slots: list) -> None:
        if n:
            if room not in self.by_room:
                self.by_room[room] = []
                insort(self.rooms, room)
            self.by_room[room].append([n, room, slots])

    def pop(self, room: int) -> list:
        run = self.by_room[room].pop()
        if not self.by_room[room]:
            del self.by_room[room]
            self.rooms.pop(bisect_left(self.rooms, room))
        return run

    def take(self, length: int, n: int) -> int:
        first = self.used[length]
        self.used[length] += n
        return first

    def best_fit(self, length: int, count: int) -> None:
        """Puts `count` documents where the least room that is enough is left; opens new sequences at last."""
        while count:
            i = bisect_left(self.rooms, length)
            if i < len(self.rooms):
                n, room, slots = self.pop(self.rooms[i])
            else:
                n, room, slots = -(-count // (self.capacity // length)), self.capacity, []
            each = room // length
            full = min(n, count // each)
            rest = min(count - full * each, each) if full < n else 0
            if full:
                more = [(length, self.take(length, full)) for _ in range(each)]
                self.add(full, room - each * length, [*slots, *more])
            if rest:
                more = [(length, self.take(length, 1)) for _ in range(rest)]
                self.add(1, room - rest * length, [*((ln, r + full) for ln, r in slots), *more])
            done = full + bool(rest)
            if n > done and slots:
                self.add(n - done, room, [(ln, r + done) for ln, r in slots])
            count -= full * each + rest


def plan(counts: np.ndarray, capacity: int, groups: int, large: int) -> Plan:
    """Packs counts[length] documents of each length below capacity; lengths of `large` or more are grouped."""
    out = Plan(capacity)
    lengths = [ln for ln in range(capacity - 1, 0, -1) if counts[ln]]
    left = counts.astype(np.int64).copy()
    n_large = int(sum(counts[ln] for ln in lengths if ln >= large))
    if n_large:
        each, members, size = -(-n_large // groups), [], 0
        parts: list[list[list[int]]] = []
        for ln in (x for x in lengths if x >= large):
            n = int(counts[ln])
            while n:
                m = min(n, each - size)
                members.append([ln, m])
                size, n = size + m, n - m
                if size == each:
                    parts.append(members)
                    members, size = [], 0
        if members:
            parts.append(members)
        merged: dict[int, list[list[int]]] = {}
        for p in parts:  # groups that round up to one size are one
            merged.setdefault(p[0][0], []).extend(p)
        sizes = sorted(merged, reverse=True)
        queues = [list(merged[s]) for s in sizes]
        demand = [sum(m for _, m in q) for q in queues]
        for times, config in sorted(configurations(sizes, demand, capacity), key=lambda x: -x[0]):
            n = int(times + 1e-6)
            if not n:
                continue
            # each slot of the n sequences takes the next n of its group, longest first
            slots = []
            for i, copies in enumerate(config):
                for _ in range(copies):
                    got, need = [], n
                    while need and queues[i]:
                        ln, m = queues[i][0]
                        m = min(m, need)
                        got.append((ln, m))
                        need -= m
                        queues[i][0][1] -= m
                        if not queues[i][0][1]:
                            queues[i].pop(0)
                    if need:
                        got.append((0, need))
                    slots.append(got)
            cuts = sorted({0, n, *(int(x) for g in slots for x in np.cumsum([m for _, m in g]))})
            for a, b in zip(cuts, cuts[1:]):
                here = [next(ln for ln, e in zip((x[0] for x in g), np.cumsum([m for _, m in g])) if e > a) for g in slots]
                here = [ln for ln in here if ln]
                if here:
                    out.add(b - a, capacity - sum(here), [(ln, out.take(ln, b - a)) for ln in here])
                    for ln in here:
                        left[ln] -= b - a
    for ln in lengths:
        if left[ln]:
            out.best_fit(ln, int(left[ln]))
    return out


def best_plan(counts: np.ndarray, capacity: int, groups: tuple[int, ...], shares: tuple[int, ...]) -> Plan:
    plans = [plan(counts, capacity, g, max(2, capacity // s)) for g in groups for s in shares]
    return min(plans, key=lambda p: sum(r[0] for runs in p.by_room.values() for r in runs))


def pack(
    pieces: DataFrame, capacity: int, groups: tuple[int, ...] = (24, 96), shares: tuple[int, ...] = (4, 8), rows_per_cell: int = 4096
) -> DataFrame:
    """pieces (doc_id, piece, length 1 to capacity; others kept) with sequence_id and offset (long).

    No sequence holds more than capacity tokens; its pieces lie one behind the other from 0. Of several numbers of groups
    and bounds of "large" (capacity divided by shares) the plan with fewest sequences is taken. pieces is evaluated more
    than once and must give the same rows each time. An empty table gives an empty one.
    """
    spark = pieces.sparkSession
    workers_see_package(spark)
    pieces = pieces.drop("sequence_id", "offset")
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # capacity rows at most
        counts[r["length"]] = r["n"]
    solved = best_plan(counts, capacity, groups, shares)
    rows, base = [], 0
    for room in sorted(solved.by_room):
        for n, _, slots in solved.by_room[room]:
            offset = 0
            for ln, rank in slots:
                rows.append((ln, rank, base, offset))
                offset += ln
            base += n
    rows.append((capacity, 0, base, 0))
    rows.sort()
    keys = np.array([(r[0] << 44) + r[1] for r in rows], np.int64)
    first, seqs, offsets = (np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3))
    cells = "array(" + ",".join(str(max(1, -(-int(c) // rows_per_cell))) for c in counts) + ")"
    spread = pieces.withColumn("__cell", F.expr(f"cast(pmod(xxhash64(doc_id, piece), {cells}[length]) as int)"))
    placed = ranked(spread, ["length"], "__cell", [F.col("doc_id"), F.col("piece")], "__rank").drop("__cell")
    order = [*pieces.columns, "__rank"]
    schema = schema_with(pieces, "sequence_id long, offset long")
    i_len = order.index("length")

    def place(batches):
        for b in batches:
            rank = b.column(len(order) - 1).to_numpy()
            at = np.searchsorted(keys, (b.column(i_len).to_numpy() << 44) + rank, "right") - 1
            new = [pa.array(seqs[at] + rank - first[at]), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], names=schema.fieldNames())

    return placed.select(*order).mapInArrow(place, schema)


def pack_documents(df: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, capacity: int = 1024, keep_ids: bool = False) -> DataFrame:
    """df's documents (doc_id, text) tokenised, cut into pieces and packed; see token_pieces and pack."""
    pieces = written(df.sparkSession, token_pieces(df, tokenizer, end_id, capacity, keep_ids), "pieces")
    return pack(pieces, capacity)


def op7_linear_grouping_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack_documents(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
