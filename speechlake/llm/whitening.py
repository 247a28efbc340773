"""Whitening of embeddings: covariance as a distributed Gram matrix, eigenvectors on the driver, projection in the tasks.

1. Entries become whole numbers, so counts, sums and centring are exact. The fit list is each distinct vector once.
2. With n vectors and sums S, n * x - S is an exact multiple of the centred vector; these rows, divided by n, make a
   RowMatrix, whose computeGramianMatrix divided by n is the covariance. Only that matrix (dimension squared) comes to the
   driver, for eigh.
3. A second Gram matrix, of the fit list's whitened and again centred vectors, shows how far they are from the identity.
4. Tasks get the means, the components and their eigenvalues, and project all rows in batches.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, schema_with, workers_see_package

#: An eigenvalue below this share of the largest one is rounding, not variance.
LEAST_SHARE = 1e-12


def whole(embedding: Column) -> Column:
    """The vector's entries times 256, rounded down, as longs; null if it is null, empty, or holds null, NaN or an infinity."""
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    x = F.transform(embedding, lambda c: F.floor(256 * c.cast("double")))
    return F.when(F.size(embedding) > 0, F.when(~F.exists(embedding, odd), x))


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.empty((0, 0), np.int64)


def fit_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """(n, S) of fit (x array<long>): number of vectors and sum of each dimension, exact."""

    def part(batches):
        n, low, high = 0, None, None
        for b in batches:
            if b.num_rows:
                x = np.stack(b.column(0).to_numpy(zero_copy_only=False)).astype(np.int64)
                halves = (x & 0xFFFFFFFF).sum(0), (x >> 32).sum(0)  # neither overflows in a batch
                n += len(x)
                low, high = ([int(v) for v in h] if s is None else [s_ + int(v) for s_, v in zip(s, h)] for s, h in zip((low, high), halves))
        if n:
            sums = [Decimal(h * 2**32 + v) for h, v in zip(high, low)]
            at = [-1, *range(len(sums))]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([Decimal(n), *sums], pa.decimal128(38, 0))], names=["at", "sum"])

    got = fit.select("x").mapInArrow(part, "at int, sum decimal(38,0)").groupBy("at").agg(F.sum("sum").alias("sum")).collect()
    by = {r["at"]: int(r["sum"]) for r in got}
    return by.get(-1, 0), [by[i] for i in range(len(by) - 1)]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: 64-bit numbers if all, squared and summed, fit; else Python's."""
    most = n * int(np.abs(x.astype(object)).max(initial=0)) + max(map(abs, sums), default=0)
    small = most * most * max(1, len(sums)) < 2**63
    kind = np.int64 if small else object
    return n * x.astype(kind) - np.array(sums, kind)


def _gramian(rows: DataFrame) -> np.ndarray:
    """Gram matrix of rows (v array<double>)."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector("v").alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray()


def _centred(fit: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """(v array<double>): each vector of fit minus the mean, from the exact n * x - S."""

    def centre(frames):
        for f in frames:
            if len(f):
                yield pd.DataFrame({"v": list((deviations(_matrix(f["x"]), n, sums) / n).astype(np.float64))})

    return fit.select("x").mapInPandas(centre, "v array<double>")


class Whitening:
    """Means, components (rows, unit length, by falling eigenvalue), their eigenvalues and shares of the variance."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray, k: int):
        values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
        trace = float(np.trace(covariance))
        self.n, self.sums = n, sums
        self.values, self.components = values[::-1][:k].copy(), vectors[:, ::-1].T[:k].copy()
        self.shares = self.values / trace if trace > 0 else np.zeros(len(self.values))
        self.scales = np.where(self.values > LEAST_SHARE * max(values.max(initial=0), 0), np.sqrt(np.maximum(self.values, 0)), 0)

    def project(self, deviation: np.ndarray) -> np.ndarray:
        """Whitened vectors of n * x - S; NaN for a component without variance."""
        out = (deviation / self.n).astype(np.float64) @ self.components.T
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.scales > 0, out / self.scales, np.nan)


def fit_whitening(x: DataFrame, tables: Scratch, k: int) -> tuple[Whitening | None, float | None]:
    """The model of x (x array<long>), and the largest entry of the fit list's whitened covariance minus the identity."""
    fit = tables.written(x.select("x").distinct(), "fit")
    sizes = [r[0] for r in fit.select(F.size("x").alias("d")).distinct().limit(2).collect()]
    if len(sizes) > 1:
        raise ValueError(f"vectors of different dimensions: {sorted(sizes)}")
    if not sizes:
        return None, None
    n, sums = fit_sums(fit)
    model = Whitening(n, sums, _gramian(_centred(fit, n, sums)) / n, k)
    real = np.flatnonzero(model.scales > 0)
    if not len(real):
        return model, None

    def whiten(frames):
        for f in frames:
            if len(f):
                yield pd.DataFrame({"v": list(model.project(deviations(_matrix(f["x"]), n, sums))[:, real])})

    white = tables.written(fit.mapInPandas(whiten, "v array<double>"), "white")
    means = np.array(white.agg(*[F.avg(F.get("v", F.lit(i))) for i in range(len(real))]).first())
    centred = white.select(F.zip_with("v", F.array(*[F.lit(float(m)) for m in means]), lambda a, m: a - m).alias("v"))
    return model, float(np.abs(_gramian(centred) / n - np.eye(len(real))).max())


def whiten(df: DataFrame, k: int = 4) -> DataFrame:
    """df (embedding array<float or double>; others kept) with n (long: distinct vectors), deviation (decimal(38,0): sum of
    squares of n * x - S), whitened (array of up to k doubles, by falling eigenvalue), explained (array<double>: share of
    the variance) and identity_error (double, one value).

    x is floor(256 * entry). Rows whose vector is null, empty, or holds null, NaN or an infinity go. Repeated vectors count
    once in the fit and get equal results in all their rows. Vectors of different dimensions raise, as does a deviation of more
    than 38 digits. A component without
    variance has whitened null and explained 0; if there is none with variance, identity_error is null. Columns of df named
    like an output are replaced. An empty df gives no rows. The result reads no table but df.
    """
    spark = df.sparkSession
    workers_see_package(spark)
    added = ["n", "deviation", "whitened", "explained", "identity_error"]
    df = df.drop(*added)
    tables = Scratch(spark)
    model, error = fit_whitening(df.select(whole(F.col("embedding")).alias("x")).where("x is not null"), tables, k)
    tables.free()
    schema = schema_with(df, "n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double")
    if model is None:
        return spark.createDataFrame([], schema)
    at, shares = len(df.columns), [float(s) for s in np.maximum(model.shares, 0)]
    # all of df's columns travel under numbers, so that none clashes with x
    given = df.select(F.struct(*[F.col(f"`{c}`").alias(str(i)) for i, c in enumerate(df.columns)]).alias("row"), whole(F.col("embedding")).alias("x")).where("x is not null")

    def project(batches):
        for b in batches:
            if not b.num_rows:
                continue
            d = deviations(np.stack(b.column(1).to_numpy(zero_copy_only=False)), model.n, model.sums)
            white = model.project(d)
            new = [
                pa.array([model.n] * len(d), pa.int64()), pa.array([Decimal(int(v)) for v in (d * d).sum(1)], pa.decimal128(38, 0)),
                pa.array([[None if np.isnan(v) else v for v in r] for r in white.tolist()], pa.list_(pa.float64())),
                pa.array([shares] * len(d), pa.list_(pa.float64())), pa.array([error] * len(d), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays([*(b.column(0).field(i) for i in range(at)), *new], names=schema.fieldNames())

    return given.mapInArrow(project, T.StructType(schema.fields))


def op12_gramian_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per vector and component."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    out = whiten(df, 4).select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return out.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", F.col("deviation").cast("long").alias("deviation"),
        F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error",
    )


def embedding_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can state of op12: the fit list's size and each vector's exact deviation."""
    return op12_gramian_whitening(spark, sf_dir).where("component = 1").select("vec_id", "n", "deviation")


#: DuckDB: the rows of embedding_deviations.
OP12_BASE_SQL = r"""
WITH e AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS HUGEINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), f AS MATERIALIZED (
  SELECT DISTINCT x FROM e
), s AS (
  SELECT list(t ORDER BY i) AS sums FROM (SELECT i, CAST(sum(x[i]) AS HUGEINT) AS t FROM f, (SELECT unnest(range(1, (SELECT max(len(x)) FROM f) + 1)) AS i) GROUP BY i)
), c AS (
  SELECT CAST(count(*) AS HUGEINT) AS n FROM f
)
SELECT vec_id, CAST(n AS BIGINT) AS n, CAST(list_sum(list_transform(list_zip(x, sums), lambda p: (n * p[1] - p[2]) * (n * p[1] - p[2]))) AS BIGINT) AS deviation
FROM e, s, c
"""
