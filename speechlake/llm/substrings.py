"""Exact removal of repeated word windows.

Every window of `width` consecutive words gets two Rabin-Karp hashes, 96 bits together. A chunk of texts keeps, for each
hash, its smallest doc_id, and sends both to the hash's bucket; a larger doc_id in the same chunk is already known to be
a repeat. A bucket finds each hash's smallest doc_id overall and answers with one bit per entry: whether an earlier
document holds it. So a window that a third of all documents share costs a bucket one entry per chunk. The answers meet
their chunk, whose texts travel compressed, and overlapping windows merge into maximal intervals.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets_of, documents, first_of_runs, pack, pack_sorted, schema_with, unpack, unpack_sorted, workers_see_package
from .words import BASES, Words, bits_of, blocks, chunks, flags_of, n_buckets, order_of, rolling, rows_of


#: Hashes that are sorted at once.
RANGE_ENTRIES = 250_000


def split_words(text: str | None) -> list[bytes]:
    """Runs of bytes other than space and 9 to 13; no word for a null text. Words finds the same in a column."""
    return text.encode().split() if text else []


def grouped(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): a stable order by (hi, lo) and where a new pair begins in it."""
    order = order_of(hi)
    a, b = hi[order], lo[order]
    new = first_of_runs(a)
    if (~new & first_of_runs(b)).any():  # 64 bits agree, the others don't
        order = np.lexsort((lo, hi))
        new = first_of_runs(hi[order]) | first_of_runs(lo[order])
    return order, new


class Windows:
    """The windows of a chunk's documents and, by ascending hash, the distinct ones with their smallest doc_id."""

    def __init__(self, rows: pa.RecordBatch, words: Words, doc_at: int, text_at: int, width: int):
        ids = rows.column(doc_at)
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(-(2**63)).to_numpy(zero_copy_only=False)
        if (ids[1:] < ids[:-1]).any():  # places in ascending doc_id, so that the first of equal windows has the smallest
            by_id = np.argsort(ids, kind="stable")
            rows, ids, known = rows.take(pa.array(by_id)), ids[by_id], known[by_id]
            words = Words(rows.column(text_at))
        self.rows, self.words = rows, words
        hi, lo = (rolling(words.h, width, base) for base in BASES)
        text = words.text[: len(hi)]
        self.at = np.flatnonzero((text == words.text[width - 1 :]) & known[text]) if len(hi) else np.empty(0, np.int64)
        doc = ids[text[self.at]] if len(hi) else np.empty(0, np.int64)
        hi, lo = hi[self.at], (lo[self.at] >> np.uint64(32)).astype(np.uint32)
        self.order, new = grouped(hi, lo)
        first = self.order[new]
        self.hi, self.lo, self.doc = hi[first], lo[first], doc[first]
        self.run = np.cumsum(new) - 1
        self.later = doc[self.order] > self.doc[self.run]  # than the smallest of this chunk

    def gone(self, earlier: np.ndarray) -> np.ndarray:
        """First words of the windows to remove; earlier: the distinct windows that an earlier document holds."""
        return self.at[self.order[self.later | earlier[self.run]]]


def _digest(hi: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(hi, initial=np.uint64(len(hi))).view(np.int64))


def held_earlier(hi: list[np.ndarray], lo: list[np.ndarray], doc: list[np.ndarray], low: list[int]) -> list[np.ndarray]:
    """For the hashes (hi, lo) of each chunk, hi ascending, with doc_id doc + low: whether another has the hash with a smaller doc_id.

    Ranges of some RANGE_ENTRIES hashes are sorted one after the other, so that a bucket costs little beside itself.
    """
    earlier = [np.zeros(len(x), bool) for x in hi]
    least, most = min(int(x[0]) for x in hi), max(int(x[-1]) for x in hi)
    ranges = max(1, -(-sum(map(len, hi)) // RANGE_ENTRIES))
    edges = np.array([least + (most - least) * k // ranges for k in range(1, ranges)], np.uint64)
    cuts = [np.concatenate([[0], np.searchsorted(x, edges), [len(x)]]) for x in hi]
    for k in range(ranges):
        at = [slice(c[k], c[k + 1]) for c in cuts]
        ids = np.concatenate([x[s].astype(np.int64) + n for x, s, n in zip(doc, at, low, strict=True)])
        if not len(ids):
            continue
        order, new = grouped(*(np.concatenate([x[s] for x, s in zip(each, at, strict=True)]) for each in (hi, lo)))
        by_hash = ids[order]
        ids[order] = np.minimum.reduceat(by_hash, np.flatnonzero(new))[np.cumsum(new) - 1] < by_hash
        start = 0
        for x, s in zip(earlier, at, strict=True):
            x[s] = ids[start : start + s.stop - s.start]
            start += s.stop - s.start
    return earlier


def repeated_windows(df: DataFrame, width: int, buckets: int) -> DataFrame:
    """(chunk, bucket, earlier, digest): of each chunk's distinct windows, which also start in a document with a smaller doc_id.

    df has doc_id (long) and text.
    """
    names = ["chunk", "bucket", "low", "hi", "lo", "doc"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def send(batches):
        for number, rows, words in chunks(batches, 1):
            w = Windows(rows, words, 0, 1, width)
            if not len(w.hi):
                continue
            edges = np.searchsorted(buckets_of(w.hi, buckets), np.arange(buckets + 1, dtype=np.uint64)).tolist()
            low = int(w.doc.min())
            doc = (w.doc - low).astype(np.uint64)
            out = [(number, k, low, pack_sorted(w.hi[a:b]), w.lo[a:b].tobytes(), pack(doc[a:b])) for k, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def answer(rows: list[tuple]):
        number, bucket, low, packed, lows, docs = zip(*rows, strict=True)
        hi = [unpack_sorted(x.as_buffer()) for x in packed]
        lo = [np.frombuffer(x.as_buffer(), np.uint32) for x in lows]
        doc = [unpack(x.as_buffer()) for x in docs]
        earlier = held_earlier(hi, lo, doc, [x.as_py() for x in low])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([x.as_py() for x in number], pa.int64()), pa.array([x.as_py() for x in bucket], pa.int32()),
                pa.array([bits_of(x) for x in earlier], pa.binary()), pa.array([_digest(x) for x in hi], pa.int64()),
            ],
            names=["chunk", "bucket", "earlier", "digest"],
        )

    def receive(batches):
        rows: list[tuple] = []
        for b in batches:
            for r in zip(*b.columns, strict=True):  # the values stay where Arrow has them
                if rows and rows[0][1] != r[1]:
                    yield answer(rows)
                    rows = []
                rows.append(r)
        if rows:
            yield answer(rows)

    sent = df.select("doc_id", "text").mapInArrow(send, "chunk long, bucket int, low long, hi binary, lo binary, doc binary")
    dealt = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(receive, "chunk long, bucket int, earlier binary, digest long")


def _spans(words: Words, starts: np.ndarray, width: int) -> tuple[np.ndarray, pa.ListArray]:
    """Which words go, and each row's maximal intervals [start, end) of them, for windows that begin at `starts`."""
    change = np.zeros(len(words.h) + 1, np.int32)
    change[starts] += 1
    change[starts + width] -= 1
    gone = np.cumsum(change[:-1]) > 0
    begins, ends = gone.copy(), gone.copy()
    new = first_of_runs(words.text)
    begins[1:] &= ~gone[:-1] | new[1:]
    ends[:-1] &= ~gone[1:] | new[1:]
    at, to = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    before = words.first[words.text[at]]
    spans = pa.StructArray.from_arrays([pa.array(at - before, pa.int32()), pa.array(to - before, pa.int32())], names=["start", "end"])
    return gone, pa.ListArray.from_arrays(pa.array(np.searchsorted(at, words.first), pa.int32()), spans)


def _kept_texts(words: Words, gone: np.ndarray) -> pa.Array:
    """Each row's words that stay, joined by one space."""
    stays = np.flatnonzero(~gone)
    text = words.text[stays]
    more = np.zeros(len(stays), bool)  # another one follows in the text, hence a blank behind the word
    more[:-1] = text[1:] == text[:-1]
    start, end = words.start[stays], words.end[stays]
    data = words.data.copy()
    data[end[more]] = 32
    change = np.zeros(len(data) + 1, np.int8)
    change[start] += 1
    change[end[~more]] -= 1
    change[end[more] + 1] -= 1
    kept = np.cumsum(change[:-1], dtype=np.int8).astype(bool)
    cuts = np.concatenate([[0], np.cumsum(kept)])[words.cuts]
    buffers = [None, pa.py_buffer(cuts.astype(np.int64).tobytes()), pa.py_buffer(data[kept].tobytes())]
    return pa.LargeStringArray.from_buffers(len(words.lens), *buffers[1:]).cast(pa.string())


def remove_repeats(df: DataFrame, width: int = 13) -> DataFrame:
    """Each row of df (doc_id long, text string, others kept) without the words that repeat an earlier document.

    A word goes if a window of `width` words covers it whose sequence also starts in a document with a smaller doc_id;
    windows are judged on the input. Adds n_words, n_removed (long), removed_spans (array of [start, end) word
    intervals, maximal) and kept_text (the kept words joined by one space); columns of df with these names are replaced.
    A null or empty text has no words and kept_text ''. A null doc_id is smaller than none: such a row neither loses
    words nor makes others lose theirs. Rows that share a doc_id are one document: none removes from the other. A very
    long text is a chunk of its own; an empty df gives no rows. df must give the same rows in the same partitions each
    time (a scan does); other rows than were hashed raise an error.
    """
    workers_see_package(df.sparkSession)
    df = df.drop("n_words", "n_removed", "removed_spans", "kept_text")
    names = df.schema.fieldNames()
    doc_at, text_at = names.index("doc_id"), names.index("text")
    buckets = n_buckets(df)
    found = repeated_windows(df, width, buckets)
    out = schema_with(df, "n_words long, n_removed long, removed_spans array<struct<start:int,end:int>>, kept_text string")

    def clean(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = rows_of(left.column("rows")[0].as_py())
        w = Windows(rows, Words(rows.column(text_at)), doc_at, text_at, width)
        edges = np.searchsorted(buckets_of(w.hi, buckets), np.arange(buckets + 1, dtype=np.uint64)).tolist()
        earlier = np.zeros(len(w.hi), bool)
        answers = {r["bucket"]: r for r in right.to_pylist()}
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            if b > a:
                if k not in answers or answers[k]["digest"] != _digest(w.hi[a:b]):
                    raise RuntimeError("a chunk's texts changed between two reads")
                earlier[a:b] = flags_of(answers[k]["earlier"], b - a)
        words = w.words
        gone, spans = _spans(words, w.gone(earlier), width)
        n_removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.first])
        new = [pa.array(words.lens, pa.int64()), pa.array(n_removed, pa.int64()), spans, _kept_texts(words, gone)]
        return pa.table([*w.rows.columns, *new], names=out.fieldNames())

    return blocks(df).groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(clean, out)


def op4_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = remove_repeats(docs, 13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


#: DuckDB: the rows of op4_repeated_substrings.
OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS t FROM s
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY t) AS least FROM g) WHERE least < doc_id
), c AS (
  SELECT DISTINCT doc_id, i + o AS k FROM r, (SELECT unnest(range(0, 13)) AS o)
), p AS (
  SELECT doc_id, list(k) AS gone, count(*) AS n_removed FROM c GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN p USING (doc_id)
"""
