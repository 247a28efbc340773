"""Ranked lexical search over document-sharded postings with precomputed integer impacts.

1. A shard is some MB of documents. Its postings are one CSR matrix: the terms it holds (sorted by hash, with their
   spelling), where each one's postings begin, the documents in them, and their impacts, whole numbers that hold
   everything of a score but the term's weight. Numbers and lengths of all documents, which impacts need, are counted
   before. Shards are rows of a table in the shared folder; building them shuffles nothing.
2. Queries come in blocks of a bounded number of terms. A first look at the shards' dictionaries alone sums the document
   frequencies of a block's terms, which gives the weights.
3. A task goes through its shards, and through a query term by term: it adds weight * impact to one accumulator per
   document of the shard. argpartition finds the k-th score; all above it stay, and of those that equal it the smallest
   doc_ids, so no tie is broken by chance. A task keeps k documents per query, and Spark merges these.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, documents, first_of_runs, pack, pack_sorted, unpack, unpack_sorted, workers_see_package
from .words import Terms, chunks, order_of, sliced

#: Terms of the queries, with repeats, that are answered at once.
BLOCK_TERMS = 200_000
#: Characters that are in no term.
OTHER = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
_SHARD = "shard long, n_docs long, docs binary, ids binary, terms binary, spelled binary, lengths binary, rows binary, impacts binary"


def terms_of(text: Column) -> Column:
    """Terms of a text in order: digits, letters (A to Z in lower case) and characters beyond ASCII."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit(f"[^{OTHER}]+"), F.lit(0))


def impact(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term that occurs tf times gives, but for its weight, to a document of n terms."""
    m = 10 + (90 * n_docs * n) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Postings:
    """CSR postings of one shard: terms ascending by hash; those of term i are rows[cuts[i]:cuts[i + 1]] with their impacts."""

    def __init__(self, row: dict, whole: bool = True):
        self.terms = unpack_sorted(row["terms"])
        self.spelled = zstandard.ZstdDecompressor().decompress(row["spelled"])
        lengths = unpack(row["lengths"]).astype(np.int64).reshape(2, -1)
        self.ends, self.sizes = np.cumsum(lengths[0]), lengths[0]
        self.cuts = np.concatenate([[0], np.cumsum(lengths[1])])
        if whole:
            self.ids = np.frombuffer(row["ids"], np.int64)
            self.known = np.unpackbits(np.frombuffer(row["docs"], np.uint8), count=row["n_docs"]).astype(bool)
            self.rows, self.impacts = unpack_sorted(row["rows"]).astype(np.int64), unpack(row["impacts"]).astype(np.int64)

    def find(self, hashes: np.ndarray, spelled: list[bytes]) -> np.ndarray:
        """Place of each term, -1 if the shard doesn't hold it."""
        if not len(self.terms):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        at[self.terms[at] != hashes] = -1
        for i in np.flatnonzero(at >= 0).tolist():
            end = self.ends[at[i]]
            if self.spelled[end - self.sizes[at[i]] : end] != spelled[i]:  # another term with this hash
                at[i] = -1
        return at


def index(docs: DataFrame, tables: Scratch) -> tuple[DataFrame, int, int]:
    """(shards, documents with terms, all their terms) of docs (doc_id long, text); the shards are a table."""
    workers_see_package(docs.sparkSession)
    docs = docs.select("doc_id", "text")

    def count(batches):
        n = np.zeros(2, np.int64)
        for b in (part for whole in batches for part in sliced(whole, 1)):
            lens = Terms(b.column(1)).lens
            n += (np.count_nonzero(lens), lens.sum())
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in n.tolist()], names=["docs", "terms"])

    sums = docs.mapInArrow(count, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    n_docs, n_terms = (int(x or 0) for x in sums)

    def build(batches):
        for number, rows, words in chunks(batches, 1, True, Terms):
            order = order_of(words.h)
            h, text = words.h[order], words.text[order]
            begins = np.flatnonzero(first_of_runs(h) | first_of_runs(text))
            tf = np.diff(np.append(begins, len(h)))
            row = text[begins].astype(np.int64)
            new = np.flatnonzero(first_of_runs(h[begins]))  # where a term's postings begin
            word = order[begins[new]]
            spelled = [words.data[a:b].tobytes() for a, b in zip(words.start[word].tolist(), words.end[word].tolist())]
            lengths = np.concatenate([words.end[word] - words.start[word], np.diff(np.append(new, len(begins)))])
            got = impact(tf, words.lens[row].astype(np.int64), n_docs, max(n_terms, 1))
            ids = rows.column(0)
            out = [
                number, rows.num_rows, np.packbits(ids.is_valid().to_numpy(zero_copy_only=False)).tobytes(),
                ids.fill_null(2**63 - 1).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(), pack_sorted(h[begins[new]]),
                zstandard.ZstdCompressor(level=1).compress(b"".join(spelled)), pack(lengths.astype(np.uint64)),
                pack_sorted(row.astype(np.uint64)), pack(got.astype(np.uint64)),
            ]
            kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 7]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(out, kinds)], names=[x.split()[0] for x in _SHARD.split(", ")])

    return tables.written(docs.mapInArrow(build, _SHARD), "postings"), n_docs, n_terms


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0, equal ones by ascending id, best first."""
    at = np.flatnonzero(scores > 0)
    if len(at) > k:
        kth = scores[at[np.argpartition(scores[at], len(at) - k)[len(at) - k]]]
        at = at[scores[at] >= kth]  # with all that equal the k-th
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _frequencies(shards: DataFrame, hashes: np.ndarray, spelled: list[bytes]) -> np.ndarray:
    """Documents that hold each term; reads the shards' dictionaries only."""

    def count(batches):
        found = np.zeros(len(hashes), np.int64)
        for b in batches:
            for row in b.to_pylist():
                p = Postings(row, False)
                at = p.find(hashes, spelled)
                here = np.flatnonzero(at >= 0)
                found[here] += p.cuts[at[here] + 1] - p.cuts[at[here]]
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(found[some])], names=["term", "df"])

    out = np.zeros(len(hashes), np.int64)
    for r in shards.select("terms", "spelled", "lengths").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]
    return out


def _answers(shards: DataFrame, hashes: np.ndarray, spelled: list[bytes], weights: np.ndarray, queries: list[tuple], k: int) -> DataFrame:
    """(item_id, doc_id, score): of each task its k best documents for each query (item_id, its terms)."""

    def score(batches):
        top = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))] * len(queries)
        for b in batches:
            for row in b.to_pylist():
                p = Postings(row)
                at = p.find(hashes, spelled)
                for q, (_, own) in enumerate(queries):
                    sums = np.zeros(len(p.ids), np.int64)
                    for t in own:
                        if at[t] >= 0:
                            span = slice(p.cuts[at[t]], p.cuts[at[t] + 1])
                            sums[p.rows[span]] += weights[t] * p.impacts[span]
                    new = best(sums, p.ids, k)
                    if len(new):
                        joined = [np.concatenate(x) for x in zip(top[q], (sums[new], p.ids[new], p.known[new]))]
                        keep = best(joined[0], joined[1], k)
                        top[q] = tuple(x[keep] for x in joined)
        items = [i for (i, _), (s, _, _) in zip(queries, top) for _ in range(len(s))]
        s, d, known = (np.concatenate([x[i] for x in top]) if top else np.empty(0) for i in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(d.astype(np.int64), mask=~known.astype(bool)), pa.array(s.astype(np.int64))], names=["item_id", "doc_id", "score"])

    return shards.mapInArrow(score, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (int, from 1), doc_id, score (long): the k best documents of docs (doc_id long, text) for each item of
    items (item_id long, text); all with a score above 0, if they are fewer. Other columns are not looked at.

    A null or empty text has no terms: as a document it's found by none and doesn't count, as an item it gives no rows.
    Rows of items that share an item_id are one item with the terms of all, those without one as well. Each row of docs is
    a document: rows that share a doc_id may take several ranks; equal scores go by doc_id, a null last. A very long text
    is in a shard of its own. Empty docs or items give no rows. The result reads tables in the shared folder.
    """
    spark = docs.sparkSession
    tables = Scratch(spark)
    asked = items.select("item_id", F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term"))
    asked = tables.written(asked.distinct(), "asked")
    blocks = -(-asked.count() // BLOCK_TERMS)
    shards, n_docs, _ = index(docs, tables)
    found = []
    for i in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i)
        own = own.groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms")).collect()
        words = sorted({t for r in own for t in r["terms"]})
        place = {t: j for j, t in enumerate(words)}
        hashes, spelled = Terms(pa.array(words, pa.string())).h, [t.encode() for t in words]
        weights = np.array([weight(int(x), n_docs) for x in _frequencies(shards, hashes, spelled)], np.int64)
        queries = [(r["item_id"], [place[t] for t in r["terms"]]) for r in own]
        found.append(tables.written(_answers(shards, hashes, spelled, weights, queries, k), "answers"))
    tables.free(*found)
    out = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for df in found:
        out = out.unionByName(df)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op11_impact_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return search(documents(spark, sf_dir), items, 10)


#: DuckDB: the rows of op11_impact_ranked_search.
OP11_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), q AS MATERIALIZED (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), s AS (
  SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0
), t AS MATERIALIZED (
  SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf, CAST(any_value(n) AS BIGINT) AS n
  FROM (SELECT doc_id, unnest(w) AS term, len(w) AS n FROM d) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term
), f AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight FROM t, s GROUP BY term
), p AS (
  SELECT doc_id, t.term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))) AS part FROM t JOIN f USING (term), s
), r AS (
  SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM q JOIN p USING (term) GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM r WHERE score > 0 QUALIFY rank <= 10
"""
