"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from pathlib import Path

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = str(Path(__file__).resolve().parents[2])
#: Entries that a worker's word cache may hold before it starts anew.
CACHE_ENTRIES = 400_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def workers_see_package(spark: SparkSession) -> None:
    """Python workers that start from another folder find this package, too."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one of our own, on a single machine only."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="speechlake-checkpoint-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)
    except Exception:  # the session has ended: nothing is left to ask
        pass


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends here and lost executors cost nothing before it."""
    path = f"{shared_dir(spark)}/speechlake-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


class Scratch:
    """Tables in the shared folder that go as soon as free() is called, but for those it names; these stay for the session."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        out = written(self.spark, df, name)
        self.paths.append(out.table_path)
        return out

    def free(self, *keep: DataFrame) -> None:
        kept = {df.table_path for df in keep}
        for path in self.paths:
            if path not in kept:
                _remove(self.spark, path)
        self.paths = [p for p in self.paths if p in kept]


def fitted(df: DataFrame, rows: int) -> DataFrame:
    """df in no more partitions than the rows of its largest input need, so that small tables cost few tasks.

    coalesce() also narrows the stage that computes df: `rows` must count the larger side of a join.
    """
    return df.coalesce(max(8, rows // 50_000))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def schema_with(df: DataFrame, ddl: str) -> T.StructType:
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(ddl).fields])


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ranked(df: DataFrame, group: list[str], cell: str, order: list[Column], name: str) -> DataFrame:
    """Gapless positions from 0 within each group, in (cell, order), without any task holding a whole group.

    Rows are numbered in their (group, cell); the cells' sizes, summed before the shuffle, give the offsets. df is
    evaluated twice and must give the same rows both times.
    """
    cells = df.groupBy(*group, cell).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*group, cell, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*group, cell).orderBy(*order)
    return (
        df.join(cells, [*group, cell])
        .withColumn(name, F.row_number().over(within) - 1 + F.col("__before"))
        .drop("__before")
    )


def buckets_of(h: np.ndarray, n: int) -> np.ndarray:
    """Contiguous, equal ranges of the hash space."""
    return ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def pack(values: np.ndarray) -> bytes:
    """Unsigned 64-bit values, byte plane by byte plane, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(
        np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()
    )


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def first_of_runs(values: np.ndarray) -> np.ndarray:
    """True where a sorted array's value differs from the one before."""
    first = np.ones(len(values), bool)
    if len(values):
        first[1:] = values[1:] != values[:-1]
    return first
