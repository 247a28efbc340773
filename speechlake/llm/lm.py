"""N-gram language model in Elias-Fano tries, one per shard of the n-grams, and scores of whole texts.

p1(w) = (c(w) + 1) / (N + V + 1); for longer n-grams p(w | context) = (c(context, w) + prior * p(w | shorter context)) /
(c(context) + prior): each order is smoothed towards the next shorter one by a Dirichlet prior. The tries hold, in a byte
per n-gram, its joint log-probability log(c / N) up to the constant log N, exact for counts to 64; conditional
probabilities are differences of two such levels, smoothed as above.

Texts are worked on in chunks. A chunk sends each distinct n-gram that it holds, once, to the n-gram's bucket, with its
count in the training texts; so counting and looking up are one exchange, and a frequent n-gram costs a bucket one entry
per chunk. A bucket adds up the counts, builds its trie in a memory-mapped block, and looks up what the chunks asked for.
The answers meet their chunk's texts again and become scores. What is gathered grows with the corpus, and no task holds
the whole model.
"""

from __future__ import annotations

import mmap

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, first_of_runs, pack, pack_sorted, schema_with, unpack, unpack_sorted, workers_see_package, written
from .words import Distinct, Words, blocks, chunks, mixed, n_buckets, order_of, rows_of

#: Strength of the words' own probabilities against bigram counts, and of the shorter n-gram's against longer ones'.
PRIOR, LONGER_PRIOR = 100.0, 5.0
ORDER = 3
#: The end of a text is a token that no word can be; its beginning is a context only.
END = b"\n"
END_HASH, START = np.uint64(0x9FB21C651E98DF25), np.uint64(0x5851F42D4C957F2D)
#: Counts that a byte stands for: exact to 64, then in equal ratios.
GRID = np.concatenate([np.arange(65), np.geomspace(66, 2.0**40, 191)])

_ZEROS = np.array([[([i for i in range(8) if not b >> i & 1] + [8] * 8)[k] for k in range(8)] for b in range(256)], np.uint8)
_ONES = np.array([[([i for i in range(8) if b >> i & 1] + [8] * 8)[k] for k in range(8)] for b in range(256)], np.uint8)
_COUNT = np.array([bin(b).count("1") for b in range(256)], np.uint8)


class EliasFano:
    """A sorted sequence of unsigned numbers in one block: low bits one behind the other, high bits in unary.

    The i-th number v sets bit (v >> width) + i of the high bits, so the zeros before it count its high part. A directory
    holds the ones before each byte of the high bits.
    """

    @staticmethod
    def build(values: np.ndarray, universe: int) -> list[np.ndarray]:
        """The levels: [count and width, high bits, directory, low bits]."""
        n = len(values)
        width = min(56, max(0, (universe // max(1, n)).bit_length() - 1))
        at = ((values >> np.uint64(width)) + np.arange(n, dtype=np.uint64)).astype(np.int64)
        size = (n + (universe >> width) + 2 + 7) // 8
        high = np.bincount(at >> 3, np.left_shift(1, at & 7), size).astype(np.uint8)
        ones = np.concatenate([[0], np.cumsum(_COUNT[high], dtype=np.uint32)]).astype(np.uint32)
        # eight numbers take `width` bytes: number j of them begins at bit j * width
        rows = -(-n // 8)
        low = np.zeros(rows * width + 8, np.uint8)  # and room to read eight bytes anywhere
        part = np.zeros(rows * 8, np.uint64)
        part[:n] = values & np.uint64((1 << width) - 1)
        for j in range(8):
            byte, shift = divmod(j * width, 8)
            x = part[j::8]
            for k in range((shift + width + 7) // 8 if width else 0):
                piece = (x << np.uint64(shift)) >> np.uint64(8 * k) if k < 8 else x >> np.uint64(64 - shift)
                low[: rows * width][byte + k :: width] |= (piece & np.uint64(255)).astype(np.uint8)
        return [np.array([n, width], np.uint64), high, ones, low]

    def __init__(self, levels: list[np.ndarray]):
        (self.n, self.width), self.high, self.ones, low = (int(x) for x in levels[0]), *levels[1:]
        self.eight = np.ndarray((max(0, len(low) - 7),), "<u8", low, strides=(1,))
        self.mask = np.uint64((1 << self.width) - 1)
        self.zeros = 8 * np.arange(len(self.ones), dtype=np.int64) - self.ones

    def _select(self, k: np.ndarray, before: np.ndarray, table: np.ndarray) -> np.ndarray:
        byte = np.searchsorted(before, k, "right") - 1
        return 8 * byte + table[self.high[byte], k - before[byte]]

    def _lows(self, i: np.ndarray) -> np.ndarray:
        bit = i * self.width
        return (self.eight[bit >> 3] >> (bit & 7).astype(np.uint64)) & self.mask

    def access(self, i: np.ndarray) -> np.ndarray:
        high = (self._select(i, self.ones, _ONES) - i).astype(np.uint64)
        return (high << np.uint64(self.width)) | self._lows(i)

    def find(self, x: np.ndarray, at_least: np.ndarray | None = None, below: np.ndarray | None = None) -> np.ndarray:
        """Place of each x, found by successor search in the numbers of its high part; -1 if it isn't there."""
        if not self.n or not len(x):
            return np.full(len(x), -1)
        part = (x >> np.uint64(self.width)).astype(np.int64)
        end = self._select(part, self.zeros, _ZEROS) - part
        start = np.where(part > 0, self._select(np.maximum(part - 1, 0), self.zeros, _ZEROS) - (part - 1), 0)
        if at_least is not None:
            start, end = np.maximum(start, at_least), np.minimum(end, below)
        low = x & self.mask
        lo, hi = start.copy(), np.maximum(end, start)
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._lows(mid) < low[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        hit = (lo < end) & (self._lows(np.minimum(lo, self.n - 1)) == low)
        return np.where(hit, lo, -1)


class Trie:
    """N-grams of a shard: contexts, pointers to their successors, successors relative to the context, weights.

    The levels lie one behind the other in a memory-mapped block.
    """

    def __init__(self, keys: np.ndarray, weights: np.ndarray):
        """keys: sorted; the context in the upper 32 bits, the successor in the lower ones."""
        new = first_of_runs(keys >> np.uint64(32))
        first = np.flatnonzero(new)
        rank = np.cumsum(new).astype(np.uint64) - np.uint64(1)
        relative = (rank << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))
        levels = [
            *EliasFano.build(keys[first] >> np.uint64(32), 1 << 32),
            *EliasFano.build(np.append(first, len(keys)).astype(np.uint64), len(keys) + 1),
            *EliasFano.build(relative, max(1, len(first)) << 32),
            weights,
        ]
        starts = np.cumsum([0, *(-(-x.nbytes // 8) * 8 for x in levels)])
        self.block = mmap.mmap(-1, max(1, int(starts[-1])))
        views = []
        for x, at in zip(levels, starts.tolist()):
            self.block[at : at + x.nbytes] = x.tobytes()
            views.append(np.frombuffer(self.block, x.dtype, x.size, at))
        self.contexts, self.pointers, self.successors = (EliasFano(views[i : i + 4]) for i in (0, 4, 8))
        self.weights = views[12]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Weight of each n-gram, 0 for an unknown one."""
        out = np.zeros(len(keys), np.uint8)
        at = self.contexts.find(keys >> np.uint64(32))
        known = np.flatnonzero(at >= 0)
        at = at[known]
        x = (at.astype(np.uint64) << np.uint64(32)) | (keys[known] & np.uint64(0xFFFFFFFF))
        start, end = (self.pointers.access(at + d).astype(np.int64) for d in (0, 1))
        place = self.successors.find(x, start, end)
        out[known[place >= 0]] = self.weights[place[place >= 0]]
        return out


def weight_of(counts: np.ndarray) -> np.ndarray:
    """The byte whose count in GRID is nearest in ratio."""
    logs = np.log(GRID[1:])
    at = np.searchsorted((logs[1:] + logs[:-1]) / 2, np.log(np.maximum(counts, 1)))
    return np.where(counts > 0, at + 1, 0).astype(np.uint8)


def swapped(keys: np.ndarray) -> np.ndarray:
    """Upper and lower halves change places: successors first, as buckets are ranges of them, or contexts first, as in a trie."""
    return (keys << np.uint64(32)) | (keys >> np.uint64(32))


class Tokens:
    """The tokens of a chunk's texts: words and ends. before(), grams(): what precedes and what ends at each."""

    def __init__(self, words: Words):
        n = len(words.lens)
        self.lens = words.lens + 1
        self.first = words.first[:-1] + np.arange(n)
        self.h = np.full(len(words.h) + n, END_HASH)
        self.h[np.arange(len(words.h)) + words.text] = words.h
        self.place = np.arange(len(self.h)) - np.repeat(self.first, self.lens)

    def before(self, values: np.ndarray, at_first) -> np.ndarray:
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.first] = at_first
        return out

    def grams(self, order: int):
        """(k, tokens at which a k-gram ends, their keys) for k up to order; the first bigram of a text begins with START."""
        h = self.h
        yield 1, np.arange(len(h)), h
        for k in range(2, order + 1):
            context = self.before(h, START)
            h = mixed((context ^ np.uint64(k)) * np.uint64(0xC2B2AE3D27D4EB4F) + self.h)
            at = np.flatnonzero(self.place >= k - 2)
            yield k, at, ((h >> np.uint64(32)) << np.uint64(32) | (context >> np.uint64(32)))[at]


def _digest(keys: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(keys, initial=np.uint64(len(keys))).view(np.int64))


def lm_scores(df: DataFrame, train: Column, order: int = ORDER) -> DataFrame:
    """df (text string; others kept, but for text) with n_tokens, n_known, train_tokens (long), base_score and score (double).

    Tokens: words, A to Z in lower case, and an end. The model learns from rows for which `train` holds (null: it
    doesn't). base_score is the sum of log10((c + 1) / (N + V + 1)), score the model's log10 probability. A null or
    empty text is its end alone. Without training rows N = V = 0. Equal texts have equal scores; a very long text is a
    chunk of its own; an empty df gives no rows. df must give the same rows in the same partitions each time (a scan
    does); other rows than were asked for raise an error. Columns of df with these names are replaced.
    """
    spark = df.sparkSession
    workers_see_package(spark)
    df = df.drop("n_tokens", "n_known", "train_tokens", "base_score", "score")
    buckets = n_buckets(df, order)
    asked = ["chunk", "bucket", "kind", "keys", "counts"]
    asked_kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]

    def ask(batches):
        for number, rows, words in chunks(batches, 0, True):
            t, out = Tokens(words), []
            learn = np.repeat(rows.column(1).to_numpy(zero_copy_only=False), t.lens).astype(np.uint64)
            for k, at, keys in t.grams(order):
                d = Distinct(keys)
                counts, edges = d.sums(learn[at]), d.edges(buckets).tolist()
                out += [(number, b, k, pack_sorted(d.keys[s:e]), pack(counts[s:e])) for b, (s, e) in enumerate(zip(edges, edges[1:])) if e > s]
            yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*out, strict=True), asked_kinds, strict=True)], names=asked)

    def answer(rows: list[dict]):
        each = [unpack_sorted(r["keys"]) for r in rows]
        keys, counts = np.concatenate(each), np.concatenate([unpack(r["counts"]) for r in rows])
        order_ = order_of(keys)
        new = first_of_runs(keys[order_])
        counts = np.add.reduceat(counts[order_], np.flatnonzero(new))
        keys = keys[order_][new]
        known = counts > 0
        tokens = distinct = 0
        if rows[0]["kind"] == 1:
            tokens, distinct, found = int(counts.sum()), int(known.sum()), counts
        else:
            own, weights = swapped(keys[known]), weight_of(counts[known].astype(float))
            by_context = order_of(own)
            found = Trie(own[by_context], weights[by_context])(swapped(keys))
        spread = np.empty(len(order_), found.dtype)
        spread[order_] = found[np.cumsum(new) - 1]
        parts = np.split(spread, np.cumsum([len(x) for x in each])[:-1])
        squeeze = pack if rows[0]["kind"] == 1 else lambda x: zstandard.ZstdCompressor(level=1).compress(x.tobytes())
        for i, (r, part, e) in enumerate(zip(rows, parts, each, strict=True)):
            yield r["chunk"], r["bucket"], r["kind"], squeeze(part), _digest(e), 0 if i else tokens, 0 if i else distinct

    def serve(batches):
        rows: list[dict] = []

        def done():
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            cols = zip(*answer(rows), strict=True)
            names = ["chunk", "bucket", "kind", "answer", "digest", "tokens", "distinct"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        for b in batches:
            for r in b.to_pylist():
                if rows and (rows[0]["bucket"], rows[0]["kind"]) != (r["bucket"], r["kind"]):
                    yield done()
                    rows = []
                rows.append(r)
        if rows:
            yield done()

    questions = df.select("text", F.coalesce(train, F.lit(False)).alias("learn")).mapInArrow(ask, "chunk long, bucket int, kind int, keys binary, counts binary")
    dealt = questions.repartition(buckets, "bucket", "kind").sortWithinPartitions("bucket", "kind")
    answers = dealt.mapInArrow(serve, "chunk long, bucket int, kind int, answer binary, digest long, tokens long, distinct long")
    answers = written(spark, answers, "answers")
    totals = answers.agg(F.sum("tokens"), F.sum("distinct")).first()
    n, v = (int(x or 0) for x in totals)
    text = df.schema.fieldNames().index("text")
    out = schema_with(df.drop("text"), "n_tokens long, n_known long, train_tokens long, base_score double, score double")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = rows_of(left.column("rows")[0].as_py())
        t = Tokens(Words(rows.column(text), True))
        found = {(r["kind"], r["bucket"]): r for r in right.to_pylist()}
        before = p = np.empty(0)
        for k, at, keys in t.grams(order):
            d = Distinct(keys)
            edges, parts = d.edges(buckets).tolist(), []
            for b, (s, e) in enumerate(zip(edges, edges[1:])):
                if e > s:
                    r = found.get((k, b))
                    if r is None or r["digest"] != _digest(d.keys[s:e]):
                        raise RuntimeError("a chunk's texts changed between two reads")
                    parts.append(unpack(r["answer"]) if k == 1 else np.frombuffer(zstandard.ZstdDecompressor().decompress(r["answer"]), np.uint8))
            own = np.zeros(len(t.h))
            values = np.concatenate(parts) if parts else np.empty(0, np.uint8)
            own[at] = (values.astype(float) if k == 1 else GRID[values])[d.place]
            if k == 1:
                known, base = own > 0, (own + 1) / (n + v + 1)
                quantised = GRID[weight_of(own)]
                p, before = base, t.before(quantised, quantised[t.lens[0] - 1])  # there are as many beginnings as ends
            else:
                prior = PRIOR if k == 2 else LONGER_PRIOR
                p, before = (own + prior * p) / (before + prior), t.before(own, 0.0)
        total = lambda x: np.add.reduceat(x, t.first)
        new = [
            pa.array(t.lens.astype(np.int64)), pa.array(total(known.astype(np.int64))), pa.array(np.full(len(t.lens), n)),
            pa.array(total(np.log10(base))), pa.array(total(np.log10(p))),
        ]
        return pa.table([*(c for i, c in enumerate(rows.columns) if i != text), *new], names=out.fieldNames())

    return blocks(df).groupBy("chunk").cogroup(answers.drop("tokens", "distinct").groupBy("chunk")).applyInArrow(score, out)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def op8_elias_fano_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = lm_scores(docs, ~held_out(F.col("doc_id")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
