"""Words of many texts at once as arrays, and the exchange of chunks of texts with buckets of hashes.

Words are found and hashed in the texts' bytes as Arrow holds them: no object per word.

Operators that hold a text's n-grams against the whole corpus work on chunks, some texts of a few MB. A chunk sends each
distinct n-gram once to the bucket of its hash; a bucket gathers and answers; the answers meet their chunk, whose rows
travel as one compressed block. A frequent n-gram costs a bucket one entry per chunk, and no task holds more than a
bucket or a chunk. The number of buckets follows from the counted bytes of the texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_of

#: Bytes and words of a chunk, unless one text has more.
CHUNK_BYTES, CHUNK_WORDS = 4_500_000, 750_000
#: Distinct n-grams that a bucket gathers, about.
BUCKET_ENTRIES = 1_500_000
#: Longer words are hashed one by one.
LONG_WORD = 256

_SOLID = np.ones(256, bool)
_SOLID[[9, 10, 11, 12, 13, 32]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Bases of two independent Rabin-Karp hashes and their inverses modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= _P2
    x ^= x >> np.uint64(29)
    x *= _P1
    x ^= x >> np.uint64(32)
    return x


class Words:
    """Words of a column of texts: start and end in data (bytes), text (its row), h (hash), lens (words of each row)."""

    #: Bytes that words consist of.
    solid = _SOLID

    def __init__(self, column: pa.Array | pa.ChunkedArray, lower: bool = False):
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
        column = pc.fill_null(column, "").cast(pa.large_string())
        _, offsets, data = column.buffers()
        cuts = np.zeros(1, np.int64) if not len(column) else np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(data, np.uint8)[cuts[0] : cuts[-1]] if data is not None and cuts[-1] > cuts[0] else np.empty(0, np.uint8)
        cuts = cuts - cuts[0]
        self.cuts, self.data = cuts, _LOWER[data] if lower else data
        solid = self.solid[self.data]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        full = cuts[1:] > cuts[:-1]
        first[cuts[:-1][full]] = solid[cuts[:-1][full]]
        last[cuts[1:][full] - 1] = solid[cuts[1:][full] - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, cuts)  # the row's first word; the next row's ends it
        self.lens = np.diff(self.first)
        self.text = np.repeat(np.arange(len(self.lens), dtype=np.int32), self.lens)
        self.h = self._hashed()

    def _hashed(self) -> np.ndarray:
        size = self.end - self.start
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(self.data) + 1,), "<u8", padded, strides=(1,))
        x = eight[self.start]
        x &= _MASKS[np.minimum(size, 8)]
        h = mixed(x ^ (size.astype(np.uint64) * _P1))
        left = np.flatnonzero((size > 8) & (size <= LONG_WORD))
        at = 8
        while len(left):
            x = eight[self.start[left] + at] & _MASKS[np.minimum(size[left] - at, 8)]
            h[left] = mixed(h[left] * _P1 + x)
            at += 8
            left = left[size[left] > at]
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            h[i] = xxhash.xxh3_64_intdigest(self.data[self.start[i] : self.end[i]].tobytes())
        return h


class Terms(Words):
    """Words of digits, letters A to Z in lower case, and all characters beyond ASCII."""

    solid = np.zeros(256, bool)
    solid[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

    def __init__(self, column: pa.Array | pa.ChunkedArray, lower: bool = True):
        super().__init__(column, lower)


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base ** 2 and so on, modulo 2**64."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        step = np.full(max(n, 1 << 16), base, np.uint64)
        step[0] = 1
        known = np.cumprod(step, dtype=np.uint64)
        if n <= 1 << 21:
            _POWERS[base] = known
    return known[:n]


def rolling(h: np.ndarray, width: int, base: int = BASES[0]) -> np.ndarray:
    """Rabin-Karp hash, modulo 2**64, of every `width` consecutive numbers, whatever their count."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    inverse = pow(base, -1, 1 << 64)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _powers(inverse, len(h)), dtype=np.uint64, out=sums[1:])
    return mixed((sums[width:] - sums[:-width]) * _powers(base, n))


def order_of(h: np.ndarray) -> np.ndarray:
    """Stable order of hashes: their upper bits and the place are sorted as one number; ties beyond that are mended."""
    n = len(h)
    bits = np.uint64(max(1, (n - 1).bit_length()))
    key = ((h >> bits) << bits) | np.arange(n, dtype=np.uint64)
    key.sort()
    order = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    moved = h[order]
    return np.argsort(h, kind="stable") if n and (moved[1:] < moved[:-1]).any() else order


class Distinct:
    """Distinct keys, ascending, of an array; place: which of them each element is."""

    def __init__(self, h: np.ndarray):
        self.order = order_of(h)
        moved = h[self.order]
        new = np.ones(len(h), bool)
        new[1:] = moved[1:] != moved[:-1]
        self.heads = np.flatnonzero(new)  # into order
        self.keys = moved[self.heads]
        self.run = np.cumsum(new) - 1

    @property
    def place(self) -> np.ndarray:
        out = np.empty(len(self.order), np.int64)
        out[self.order] = self.run
        return out

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values[self.order], self.heads) if len(self.heads) else np.zeros(0, values.dtype)

    def edges(self, buckets: int) -> np.ndarray:
        """Where each bucket's keys begin."""
        return np.searchsorted(buckets_of(self.keys, buckets), np.arange(buckets + 1, dtype=np.uint64))


def n_buckets(df: DataFrame, per_word: int = 1) -> int:
    """Buckets for df's texts, of which each word gives `per_word` n-grams, from the counted bytes."""
    size = df.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(1, -(-int(size) * per_word // (6 * BUCKET_ENTRIES)))


def chunks(batches, text: int, lower: bool = False, kind: type[Words] = Words):
    """(number, rows, their words) of each chunk of a partition. The same rows give the same chunks again."""
    number = TaskContext.get().partitionId() << 24
    held: list[pa.RecordBatch] = []
    size = 0

    def done(rows: pa.RecordBatch):
        words = kind(rows.column(text), lower)
        if len(words.h) <= CHUNK_WORDS or rows.num_rows == 1:
            yield rows, words
            return
        # short words: by counted words
        start = 0
        while start < rows.num_rows:
            end = max(start + 1, int(np.searchsorted(words.first, words.first[start] + CHUNK_WORDS, "right")) - 1)
            part = rows.slice(start, min(end, rows.num_rows) - start)
            yield part, kind(part.column(text), lower)
            start = end

    def flush():
        nonlocal number
        one = pa.Table.from_batches(held).combine_chunks().to_batches()
        held.clear()
        for rows in one:
            for part, words in done(rows):
                yield number, part, words
                number += 1

    for b in batches:
        if not b.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total, start = np.concatenate([[0], np.cumsum(lengths)]), 0
        while start < b.num_rows:
            # as many rows as fit into what is left of the chunk
            end = int(np.searchsorted(total, total[start] + CHUNK_BYTES - size, "right")) - 1
            if end <= start:
                if held:
                    yield from flush()
                    size = 0
                    continue
                end = start + 1
            held.append(b.slice(start, end - start))
            size += int(total[end] - total[start])
            start = end
    if held:
        yield from flush()


def sliced(batch: pa.RecordBatch, text: int):
    """The batch in parts of CHUNK_BYTES of text at most, or of one row."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, start = np.concatenate([[0], np.cumsum(lengths)]), 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(total, total[start] + CHUNK_BYTES, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


_OPTIONS = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))


def block(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=_OPTIONS) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def rows_of(data: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(data) as stream:
        return stream.read_next_batch()


def blocks(df: DataFrame, text: str = "text") -> DataFrame:
    """(chunk, rows): each chunk's rows, compressed."""
    at = df.schema.fieldNames().index(text)

    def pack_up(batches):
        for number, rows, _ in chunks(batches, at):
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([block(rows)], pa.binary())], names=["chunk", "rows"])

    return df.mapInArrow(pack_up, "chunk long, rows binary")


def bits_of(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def flags_of(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)

