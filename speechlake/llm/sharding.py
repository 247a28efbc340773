"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

A uniformly random assignment of all rows to shards of given sizes restricts, on each input partition, to a draw from
the multivariate hypergeometric law. So: draw how many rows of each partition go to each shard, deal these labels to the
partition's rows in random order, exchange, and permute each shard again.

The matrix has one row per input partition. It is never built as a whole: a task gets the partitions' sizes (one number
each) and draws its own row by halving the list of partitions, some twenty draws from seeds that depend on the halves
alone. So a task that runs again after an executor was lost deals the same labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, ranked, workers_see_package

#: numpy draws from the hypergeometric law below this size; above, two binomial draws are repeated until their sum fits.
EXACT_BELOW = 1_000_000_000


def _one(rng: np.random.Generator, good: int, bad: int, take: int) -> int:
    total = good + bad
    if total < EXACT_BELOW:
        return int(rng.hypergeometric(good, bad, take))
    # binomial draws of good and bad at one rate, given their sum, follow the hypergeometric law, whatever the rate
    rate = take / total
    tries = int(4 * np.sqrt(total * rate * (1 - rate))) + 16
    while True:
        x = rng.binomial(good, rate, tries)
        fits = np.flatnonzero(x + rng.binomial(bad, rate, tries) == take)
        if len(fits):
            return int(x[fits[0]])


def draw(rng: np.random.Generator, capacity: np.ndarray, take: int) -> np.ndarray:
    """`take` of sum(capacity) balls without replacement; the count of each colour."""
    out, left = np.zeros(len(capacity), np.int64), int(capacity.sum())
    for i, c in enumerate(capacity.tolist()):
        if take == 0:
            break
        left -= c
        out[i] = _one(rng, c, left, take) if left else take
        take -= int(out[i])
    return out


def matrix_row(prefix: np.ndarray, sizes: np.ndarray, p: int, seed: int) -> np.ndarray:
    """Row p of the communication matrix; prefix[i] rows lie before partition i, sizes are the shards' sizes."""
    lo, hi, left = 0, len(prefix) - 1, sizes.astype(np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        half = draw(np.random.default_rng([seed, lo, hi]), left, int(prefix[mid] - prefix[lo]))
        lo, hi, left = (lo, mid, half) if p < mid else (mid, hi, left - half)
    return left


def shard_sizes(rows: int, n_shards: int) -> np.ndarray:
    return np.array([rows // n_shards + (s < rows % n_shards) for s in range(n_shards)], np.int64)


def hypergeometric_shuffle(
    df: DataFrame, n_shards: int, seed: int = 17, rows_per_cell: int = 4096, shard: str = "shard", slot: str = "slot"
) -> DataFrame:
    """df with the columns shard (int) and slot (long, gapless from 0 in the shard), shuffled uniformly.

    Shards' row counts differ by one at most. Rows count by their place in df, so nulls, empty or very long texts, ties
    and repeated rows need no care. An empty df gives no rows. Columns of df named like an output are replaced; its others
    may have any name, and come first, in their order. df must
    give the same rows in the same partitions each time (a scan does); a task that finds another number of rows than was
    counted fails rather than deal a wrong size.
    """
    spark = df.sparkSession
    workers_see_package(spark)
    names = [c for c in df.columns if c not in (shard, slot)]
    # in one struct no name of theirs can meet one of ours
    df = df.select((F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.lit(None).cast("int")).alias("row"))
    counted = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    counts = np.zeros(1 + max([r["p"] for r in counted], default=0), np.int64)
    for r in counted:
        counts[r["p"]] = r["n"]
    prefix = np.concatenate([[0], np.cumsum(counts)])
    rows = int(prefix[-1])
    sizes = shard_sizes(rows, n_shards)
    cells = max(1, -(-rows // (n_shards * rows_per_cell)))

    def deal(batches):
        p = TaskContext.get().partitionId()
        row = matrix_row(prefix, sizes, p, seed) if p < len(counts) else np.zeros(n_shards, np.int64)
        labels = np.repeat(np.arange(n_shards, dtype=np.int32), row)
        np.random.default_rng([seed, p, 1]).shuffle(labels)
        at = 0
        for b in batches:
            if at + b.num_rows > len(labels):
                at += b.num_rows
                break
            mine = labels[at : at + b.num_rows]
            place = (p << 33) + np.arange(at, at + b.num_rows, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(mine), pa.array(place)], names=["row", "shard", "place"]
            )
            at += b.num_rows
        if at != len(labels):
            raise RuntimeError(f"partition {p} had {len(labels)} rows when counted; its rows changed meanwhile")

    schema = T.StructType([*df.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("place", T.LongType())])
    dealt = df.mapInArrow(deal, schema).withColumn("key", F.xxhash64(F.lit(seed), "place"))
    dealt = dealt.withColumn("cell", F.pmod("key", F.lit(cells)).cast("int"))
    out = ranked(dealt, ["shard"], "cell", [F.col("key"), F.col("place")], "slot")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in names], F.col("shard").alias(shard), F.col("slot").alias(slot))


def op1_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of equal row count, in uniformly random order. A null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = documents(spark, sf_dir).select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    out = hypergeometric_shuffle(docs, 40)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
