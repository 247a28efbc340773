"""Benchmark passages in documents, by a prefix-filtered set join.

1. Every item gives its windows of `width` consecutive words (a shorter one itself). A window is the set of its
   SHINGLE-word shingles. These are ordered by rarity: a pass over all documents counts how often each one occurs.
2. A text that holds a window holds all its shingles, so, of the window in that order, a prefix of one shingle is
   necessary: the rarest. Texts meet windows by that one alone, and a frequent shingle is hardly ever looked up.
3. A meeting fixes the place that the window would have in the text. Length and position rule out places that reach over
   the text's ends; the rest are verified word by word, in bytes, over as many words as the window has.

Windows are the stated query set: blocks of them, bounded by count, go to the tasks, so texts are not shuffled, and a
passage that a third of all documents hold costs no task more than its own texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, first_of_runs, schema_with, workers_see_package
from .ranking import terms_of
from .words import Terms, rolling, sliced

#: Words of a shingle, of a window's own length if that is less.
SHINGLE = 3
#: Windows that go to the tasks at once.
BLOCK_WINDOWS = 250_000
#: Words that are compared byte by byte at once.
_VERIFIED = 200_000
_RANGE = "array<struct<start:int,end:int>>"


def item_windows(items: DataFrame, width: int) -> DataFrame:
    """(window array<string>, items array<long>): the distinct windows of items (item_id long, text) and who holds them."""
    words = items.where("item_id is not null").select("item_id", terms_of(F.col("text")).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    each = words.select("item_id", F.explode(F.array_distinct(F.transform(starts, lambda i: F.slice("w", i, width)))).alias("window"))
    return each.groupBy("window").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


class Windows:
    """A block of windows: their words and shingles as hashes, and who holds them."""

    def __init__(self, rows: list):
        self.items = [r["items"] for r in rows]
        self.words = Terms(pa.array([" ".join(r["window"]) for r in rows], pa.string()))
        self.lens, self.first = self.words.lens.astype(np.int64), self.words.first[:-1].astype(np.int64)
        self.wide = np.minimum(self.lens, SHINGLE)
        window, offset, h = [], [], []
        for size in np.unique(self.wide).tolist():
            rolled = shingles(self.words.h, size)
            own = np.flatnonzero(self.wide == size)
            n = self.lens[own] - size + 1
            each = np.repeat(own, n)
            at = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            window.append(each)
            offset.append(at)
            h.append(rolled[self.first[each] + at])
        self.window, self.offset, self.h = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (window, offset, h))
        self.keys = np.unique(self.h.astype(np.uint64))

    def choose(self, counts: np.ndarray) -> None:
        """Keeps the prefix of each window: its rarest shingle, the first of equally rare ones."""
        n = counts[np.searchsorted(self.keys, self.h)]
        order = np.lexsort((self.offset, n, self.window))
        chosen = order[first_of_runs(self.window[order])]
        chosen = chosen[np.argsort(self.h[chosen], kind="stable")]
        self.prefix_window, self.prefix_offset = self.window[chosen], self.offset[chosen]
        h = self.h[chosen]
        begins = np.flatnonzero(first_of_runs(h))
        self.prefixes, self.begins = h[begins], np.append(begins, len(h))
        self.sizes = np.unique(self.wide).tolist()
        del self.window, self.offset, self.h, self.keys


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    return rolling(h, size) ^ np.uint64(size)


def places(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where h holds a key, which key)."""
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    found = np.flatnonzero(keys[at] == h)
    return found, at[found]


def equal_words(a: Terms, i: np.ndarray, b: Terms, j: np.ndarray) -> np.ndarray:
    """Whether word i of a is word j of b, byte by byte."""
    size = a.end[i] - a.start[i]
    same = size == b.end[j] - b.start[j]
    for lo in range(0, len(i), _VERIFIED):
        k = lo + np.flatnonzero(same[lo : lo + _VERIFIED])
        n = size[k]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        differ = a.data[np.repeat(a.start[i[k]], n) + step] != b.data[np.repeat(b.start[j[k]], n) + step]
        same[np.repeat(k, n)[differ]] = False
    return same


def occurrences(words: Terms, w: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of all places in the texts where a window of the block stands."""
    starts, windows = [], []
    for size in w.sizes:
        at, key = places(w.prefixes, shingles(words.h, size))
        n = w.begins[key + 1] - w.begins[key]
        which = np.repeat(w.begins[key] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        window = w.prefix_window[which]
        start = np.repeat(at, n) - w.prefix_offset[which]
        text = words.text[np.repeat(at, n)]
        fits = (w.wide[window] == size) & (start >= words.first[text]) & (start + w.lens[window] <= words.first[text + 1])
        start, window = start[fits], window[fits]
        for k in range(int(w.lens[window].max(initial=0))):
            long = np.flatnonzero(w.lens[window] > k)
            good = np.ones(len(start), bool)
            i, j = start[long] + k, w.first[window[long]] + k
            good[long] = words.h[i] == w.words.h[j]
            good[long[good[long]]] = equal_words(words, i[good[long]], w.words, j[good[long]])
            start, window = start[good], window[good]
        starts.append(start)
        windows.append(window)
    return (np.concatenate(x) if x else np.empty(0, np.int64) for x in (starts, windows))


def _counted(docs: DataFrame, keys: np.ndarray, sizes: list[int]) -> np.ndarray:
    """How often each shingle occurs in all documents."""

    def count(batches):
        seen = np.zeros(len(keys), np.int64)
        for b in (part for whole in batches for part in sliced(whole, 0)):
            words = Terms(b.column(0))
            for size in sizes:
                at, key = places(keys, shingles(words.h, size))
                own = at[words.text[at] == words.text[at + size - 1]]
                seen += np.bincount(key[words.text[at] == words.text[at + size - 1]], minlength=len(keys)) if len(own) else 0
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(seen[some])], names=["key", "n"])

    out = np.zeros(len(keys), np.int64)
    for r in docs.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect():
        out[r["key"]] = r["n"]
    return out


def _marked(df: DataFrame, w: Windows) -> DataFrame:
    """df with n_words, hit_spans and items, those that it has already with them."""
    names = df.schema.fieldNames()
    text, more = names.index("text"), "hit_spans" in names
    kept = [c for c in names if c not in ("n_words", "hit_spans", "items")]
    schema = schema_with(df.select(*[f"`{c}`" for c in kept]), f"n_words long, hit_spans {_RANGE}, items array<long>")

    def mark(batches):
        for b in (part for whole in batches for part in sliced(whole, text)):
            words = Terms(b.column(text))
            start, window = occurrences(words, w)
            change = np.zeros(len(words.h) + 1, np.int64)
            np.add.at(change, start, 1)
            np.add.at(change, start + w.lens[window], -1)
            row = words.text[start]
            held: dict[int, set] = {}
            for pair in np.unique(row.astype(np.int64) * len(w.lens) + window).tolist():
                held.setdefault(pair // len(w.lens), set()).update(w.items[pair % len(w.lens)])
            if more:
                for i, (spans, items) in enumerate(zip(b.column(names.index("hit_spans")).to_pylist(), b.column(names.index("items")).to_pylist())):
                    for s in spans:
                        change[words.first[i] + s["start"]] += 1
                        change[words.first[i] + s["end"]] -= 1
                    if items:
                        held.setdefault(i, set()).update(items)
            hit = np.cumsum(change[:-1]) > 0
            begins, ends, new = hit.copy(), hit.copy(), first_of_runs(words.text)
            begins[1:] &= ~hit[:-1] | new[1:]
            ends[:-1] &= ~hit[1:] | new[1:]
            at, to = np.flatnonzero(begins), np.flatnonzero(ends) + 1
            before = words.first[words.text[at]]
            spans = pa.StructArray.from_arrays([pa.array(at - before, pa.int32()), pa.array(to - before, pa.int32())], names=["start", "end"])
            out = [
                pa.array(words.lens, pa.int64()), pa.ListArray.from_arrays(pa.array(np.searchsorted(at, words.first), pa.int32()), spans),
                pa.array([sorted(held[i]) if i in held else [] for i in range(b.num_rows)], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([*(b.column(names.index(c)) for c in kept), *out], names=schema.fieldNames())

    return df.mapInArrow(mark, schema)


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """docs (text; others kept) with n_words, n_hit (long), hit_spans (array of [start, end) word intervals, maximal), items
    (array of the item_ids whose windows stand in the text, ascending) and contaminated (n_hit > 0).

    Words are digits, letters (A to Z in lower case) and characters beyond ASCII. A window is `width` consecutive words of
    an item (item_id long, text), or a shorter item as a whole. A null or empty text has no words and is not contaminated;
    as an item it has no windows, nor has a row without item_id. Rows that share an item_id add up. Equal texts get equal
    results, also in repeated rows. Columns of docs named like an output are replaced. A very long text is worked on in one
    piece. Empty docs give no rows; without items no document is contaminated.
    """
    spark = docs.sparkSession
    workers_see_package(spark)
    tables = Scratch(spark)
    docs = docs.drop("n_words", "n_hit", "hit_spans", "items", "contaminated")
    windows = tables.written(item_windows(items, width), "windows")
    blocks = max(1, -(-windows.count() // BLOCK_WINDOWS))
    out = docs
    for i in range(blocks):
        w = Windows(windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == i).collect())
        sizes = np.unique(w.wide).tolist()
        w.choose(_counted(docs, w.keys, sizes) if len(w.keys) else np.empty(0, np.int64))
        out = _marked(out, w)
        if i < blocks - 1:
            out = tables.written(out, "marked")
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.withColumn("n_hit", hit).withColumn("contaminated", F.col("n_hit") > 0)


def op13_prefix_filtered_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    out = decontaminate(documents(spark, sf_dir).select("doc_id", "text"), items, 10)
    named = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(named, 256).alias("items_sha256"), "contaminated"
    )


#: DuckDB: the rows of op13_prefix_filtered_decontamination.
OP13_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS MATERIALIZED (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), i AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)
), g AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)
), m AS MATERIALIZED (
  SELECT doc_id, s, n, t FROM g WHERE t IN (SELECT t FROM i)
), h AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS k FROM m) GROUP BY doc_id
), e AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM m JOIN i USING (t, n)) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN e USING (doc_id)
"""
