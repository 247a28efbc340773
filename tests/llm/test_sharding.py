import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from speechlake.llm import sharding as S


def check(out, n, shards):
    sizes = np.bincount([r["shard"] for r in out], minlength=shards)
    assert len(out) == n and sizes.max() - sizes.min() <= 1
    for s in range(shards):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sizes[s]))


def test_exact_sizes_and_gapless_slots(docs, rows):
    for cells in (4096, 5):
        out = S.hypergeometric_shuffle(docs, 7, rows_per_cell=cells).collect()
        check(out, len(rows), 7)
        assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r[0]) for r in rows)


def test_awkward_empty_and_clashing(awkward, nothing):
    clash = awkward.withColumn("shard", F.lit("x")).withColumn("slot", F.lit(1.5))
    check(S.hypergeometric_shuffle(clash, 4).collect(), awkward.count(), 4)
    assert S.hypergeometric_shuffle(nothing, 4).count() == 0


def test_same_result_each_time(docs):
    a, b = (sorted((r["doc_id"], r["shard"], r["slot"]) for r in S.hypergeometric_shuffle(docs, 5).collect()) for _ in range(2))
    assert a == b


def test_other_rows_than_were_counted_raise(spark, tmp_path):
    """Surplus rows that begin a batch of their own are no less an error than missing ones."""
    for change in (500, -500):
        mark = tmp_path / f"seen{change}"

        def rows(batches, mark=mark, change=change):
            n = 10_000 + change if mark.exists() else 10_000
            mark.touch()
            list(batches)
            for start in range(0, n, 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(range(start, min(n, start + 10_000)), pa.int64())], names=["id"])

        with pytest.raises(Exception, match="changed meanwhile"):
            S.hypergeometric_shuffle(spark.range(0, 10, 1, 1).mapInArrow(rows, "id long"), 7).collect()


def test_matrix_margins_and_law():
    counts, sizes = np.array([5, 0, 17, 3, 40]), S.shard_sizes(65, 4)
    prefix = np.concatenate([[0], np.cumsum(counts)])
    total = np.zeros((5, 4))
    for seed in range(300):
        m = np.array([S.matrix_row(prefix, sizes, p, seed) for p in range(5)])
        assert (m.sum(1) == counts).all() and (m.sum(0) == sizes).all() and (m >= 0).all()
        total += m
    assert np.abs(total / 300 - np.outer(counts, sizes) / 65).max() < 0.5
    big = S.draw(np.random.default_rng(1), np.array([3 * 10**9, 10**9]), 2 * 10**9)
    assert big.sum() == 2 * 10**9 and abs(big[0] / 1.5e9 - 1) < 1e-3


def test_large_draws_follow_the_law():
    """Ten of two billion, a hundredth taken: two or more in 0.43 of 100 draws; a rounded normal draw never gives them."""
    rng = np.random.default_rng(3)
    n, x = 2000, []
    for _ in range(n):
        x.append(S._one(rng, 10, 2 * 10**9 - 10, 2 * 10**7))
    for value, law in ((0, 0.99**10), (1, 10 * 0.01 * 0.99**9)):
        assert abs(x.count(value) / n - law) < 4 * (law * (1 - law) / n) ** 0.5
    assert 1 <= sum(v >= 2 for v in x) <= 22
    assert [S._one(rng, 2 * 10**9, 3, t) for t in (0, 2 * 10**9 + 3)] == [0, 2 * 10**9]


def test_query(spark, sf, rows):
    out = S.op1_hypergeometric_shards(spark, sf).collect()
    check(out, len(rows), 40)
    text = {i: (t or "").encode() for i, t, *_ in rows}
    assert all(r["size"] == len(text[r["doc_id"]]) + 16 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]]) and r["law"] == "rows" for r in out)


def test_columns_of_any_name(spark):
    df = spark.range(200).select("id", *[F.col("id").alias(c) for c in ("__key", "__cell", "__place", "key", "cell", "place", "row", "a.b", "__n")]).withColumn("slot", F.lit("old"))
    out = S.hypergeometric_shuffle(df.repartition(3), 7)
    assert out.columns == [*df.columns[:-1], "shard", "slot"]
    for r in out.collect():
        assert len({r[c] for c in out.columns[:-2]}) == 1
    assert S.hypergeometric_shuffle(df.select("slot"), 7).columns == ["shard", "slot"]
