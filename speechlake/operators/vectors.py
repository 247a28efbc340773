"""Vector similarity: cosine, element-wise means, and the exact two nearest prints."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block; two blocks meet as one matrix product.
BLOCK = 1024


def cosine(a: Column, b: Column) -> Column:
    """0.0 where the lengths differ, a side is null or empty, or a norm is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms), F.lit(0.0))


def clean_vector(v: Column) -> Column:
    """The vector, or null if it is empty or holds a number that is not finite."""
    fine = F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when((F.size(v) > 0) & fine, v)


def vector_mean(df: DataFrame, by: list[str], vector: str = "embedding") -> DataFrame:
    """Element-wise mean per group, as long as the group's shortest vector."""
    sized = df.where(F.size(vector) > 0).select(*by, vector)
    each = sized.select(*by, F.size(vector).alias("__n"), F.posexplode(F.transform(vector, lambda x: x.cast("double"))).alias("pos", "x"))
    per = each.groupBy(*by, "pos").agg(F.avg("x").alias("mean"), F.count(F.lit(1)).alias("n"))
    whole = sized.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return per.join(whole, [*by, "n"]).select(*by, F.col("pos").cast("bigint").alias("pos"), "mean")


def weighted_mean(a: Column, n: Column, b: Column, m: Column) -> Column:
    """(a * n + b * m) / (n + m), element by element."""
    return F.zip_with(a, b, lambda x, y: (x.cast("double") * n + y.cast("double") * m) / (n + m))


#: Bytes of prints that are broadcast at most, and lots into which a larger join is dealt at most.
BROADCAST_BYTES, MOST_LOTS = 32_000_000, 64
#: Blocks of a lot, so that copies of the other side stay few.
LOT_BLOCKS = 8


def lots_of(rows: int, block: int) -> int:
    return min(MOST_LOTS, max(1, -(-rows // (LOT_BLOCKS * block))))


def matrix_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of lists of one length as a matrix, without an object per number."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def unit(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _float_type(df: DataFrame, vector: str) -> str:
    return "float" if df.schema[vector].dataType.simpleString() == "array<float>" else "double"


def _blocks(df: DataFrame, key: str, space: str, vector: str, prefix: str, rows: int) -> DataFrame:
    """Rows (space, ids, dim, matrix) of at most a few BLOCK vectors of one length, by ascending id; floats stay floats."""
    number = _float_type(df, vector)

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        m = matrix_of(t.column("v"))
        ids = pa.array([t.column("id").to_pylist()], pa.list_(t.schema.field("id").type))
        return pa.table({"space": t.column("space").slice(0, 1), f"{prefix}_ids": ids, f"{prefix}_dim": [m.shape[1]], f"{prefix}_m": [m.tobytes()]})

    cut = df.select(F.col(space).alias("space"), F.col(key).alias("id"), F.col(vector).cast(f"array<{number}>").alias("v"))
    cut = cut.where(F.size("v") > 0).withColumn("dim", F.size("v"))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-rows // BLOCK)))))
    kind = df.schema[key].dataType.simpleString()
    schema = f"space {df.schema[space].dataType.simpleString()}, {prefix}_ids array<{kind}>, {prefix}_dim bigint, {prefix}_m binary"
    return cut.groupBy("space", "dim", "part").applyInArrow(build, schema)


class _TwoBest:
    """The two best of all columns seen so far, for each row: by similarity to 12 digits, equal ones by id, NaN last."""

    def __init__(self, rows: int):
        self.rank, self.sim = np.full((rows, 2), -3.0), np.full((rows, 2), np.nan)
        self.id = np.full((rows, 2), None, object)

    def add(self, sims: np.ndarray, ids: np.ndarray) -> None:
        """ids: of the columns, ascending, as objects."""
        rank, rows = np.round(sims, 12), np.arange(len(sims))
        rank[np.isnan(rank)] = -2
        for _ in range(min(2, sims.shape[1])):
            j = rank.argmax(1)
            self._put(rank[rows, j], sims[rows, j], ids[j])
            rank[rows, j] = -4

    def _beats(self, rank: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
        out = rank > self.rank[:, k]
        for i in np.flatnonzero(rank == self.rank[:, k]).tolist():
            out[i] = ids[i] < self.id[i, k]
        return out

    def _put(self, rank: np.ndarray, sims: np.ndarray, ids: np.ndarray) -> None:
        first, second = self._beats(rank, ids, 0), self._beats(rank, ids, 1)
        for held, new in ((self.rank, rank), (self.sim, sims), (self.id, ids)):
            held[:, 1] = np.where(first, held[:, 0], np.where(second, new, held[:, 1]))
            held[:, 0] = np.where(first, new, held[:, 0])


def nearest_two(obs: DataFrame, prints: DataFrame, obs_key: str, print_key: str, space: str, vector: str = "embedding") -> DataFrame:
    """Per row of obs: best and second best print of the same space by cosine, ties to the smaller key.

    Columns obs_key, best_id, best, second_id, second (null without such a print). Exact: every row meets every print of
    its space, block by block as matrix products; a task holds two blocks and the two best so far, which alone go on. A
    null space is one of its own. Vectors of other lengths have similarity 0.0.
    """
    n_obs = obs.count()
    n_prints, dim = prints.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(vector)), F.lit(0))).first()
    a = _blocks(obs, obs_key, space, vector, "a", n_obs).withColumnRenamed("space", "a_space")
    b = _blocks(prints, print_key, space, vector, "b", n_prints)
    a_number, b_number = (np.dtype(np.float32 if _float_type(x, vector) == "float" else np.float64) for x in (obs, prints))
    if b_number.itemsize * n_prints * dim <= BROADCAST_BYTES:
        a = a.repartition(min(MOST_LOTS, max(1, -(-n_obs // BLOCK))))
        met = a.join(F.broadcast(b), F.col("a_space").eqNullSafe(F.col("space")))
    else:  # a space may hold most rows: its parts of obs lie apart, and each meets its own copy of the prints
        lots = lots_of(n_obs, BLOCK)
        a = a.withColumn("a_lot", F.pmod(F.xxhash64("a_ids"), F.lit(lots)))
        b = b.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1)))).withColumn("lot", F.col("lot").cast("long"))
        met = a.join(b, F.col("a_space").eqNullSafe(F.col("space")) & (F.col("a_lot") == F.col("lot")))
    met = met.select("a_ids", "a_dim", "a_m", "b_ids", "b_dim", "b_m")

    def products(batches):
        held = best = x = None

        def done():
            own, which = np.nonzero(best.rank > -3)
            ids = pa.array(held[0], kinds[0]).take(pa.array(own))
            return pa.RecordBatch.from_arrays([ids, pa.array(best.id[own, which].tolist(), kinds[1]), pa.array(best.sim[own, which])], names=[obs_key, "id", "sim"])

        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i] for c in batch.schema.names}
                mine = r["a_ids"].as_py(), r["a_m"].as_py()
                if mine != held:  # the blocks that one of obs meets come one after the other
                    if held:
                        yield done()
                    held, best = mine, _TwoBest(len(mine[0]))
                    x = unit(np.frombuffer(mine[1], a_number).reshape(len(mine[0]), -1))
                keys = np.array([*r["b_ids"].as_py(), None], object)[:-1]
                y = np.frombuffer(r["b_m"].as_buffer(), b_number).reshape(len(keys), -1)
                best.add(x @ unit(y).T if r["a_dim"].as_py() == r["b_dim"].as_py() else np.zeros((len(x), len(keys))), keys)
        if held:
            yield done()

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = to_arrow_type(obs.schema[obs_key].dataType), to_arrow_type(prints.schema[print_key].dataType)
    a_kind, b_kind = obs.schema[obs_key].dataType.simpleString(), prints.schema[print_key].dataType.simpleString()
    each = met.mapInArrow(products, f"{obs_key} {a_kind}, id {b_kind}, sim double")
    every = each.groupBy(obs_key).agg(F.sort_array(F.collect_list(F.struct((-F.round("sim", 12)).alias("neg"), "id", "sim"))).alias("t"))
    out = every.select(
        obs_key, F.get("t", F.lit(0))["id"].alias("best_id"), F.get("t", F.lit(0))["sim"].alias("best"),
        F.get("t", F.lit(1))["id"].alias("second_id"), F.get("t", F.lit(1))["sim"].alias("second"),
    )
    return obs.select(obs_key).join(out, obs_key, "left")
