import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from speechlake.llm import whitening
from speechlake.llm.whitening import op12_gramian_whitening, whiten

DDL = "vec_id long, embedding array<float>, label int"


def vectors(seed=2, n=200, dim=7):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(dim, dim)) * np.linspace(3, 0.2, dim)
    rows = [(i, [float(x) for x in np.float32(v)], 0) for i, v in enumerate(rng.normal(size=(n, dim)) @ mix + 5)]
    rows += [(1000 + i, rows[3][1], 1) for i in range(80)]  # a vector in a third of the rows
    rows += [(2000, [rows[0][1][0] + 0.0001, *rows[0][1][1:]], 1)]
    odd = [None, [None, *rows[0][1][1:]], [math.nan, *rows[0][1][1:]], [math.inf, *rows[0][1][1:]], [-math.inf, *rows[0][1][1:]], []]
    return rows + [(3000 + i, v, None) for i, v in enumerate(odd)] + [(None, rows[5][1], None), (5, rows[5][1], None)]


def brute(rows, k=4):
    good = [(r[0], tuple(math.floor(256 * c) for c in r[1])) for r in rows if r[1] and all(c is not None and math.isfinite(c) for c in r[1])]
    fit = np.array(sorted({x for _, x in good}), dtype=object)
    n, sums = len(fit), fit.sum(0)
    centred = np.array(fit - sums / n, float)
    values, components = np.linalg.eigh(centred.T @ centred / n)
    out = {}
    for vec_id, x in good:
        d = np.array([n * a - b for a, b in zip(x, sums)], dtype=object)
        out.setdefault(vec_id, []).append((int((d * d).sum()), [abs(float((d / n) @ components[:, -1 - j])) / math.sqrt(values[-1 - j]) for j in range(k)]))
    return n, out, values[::-1][:k] / values.sum()


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(vectors(), DDL).repartition(5)


def test_every_row_against_brute_force(table):
    n, want, shares = brute(vectors())
    got = whiten(table).collect()
    assert len(got) == sum(map(len, want.values())) and {r["n"] for r in got} == {n}
    signs = []
    for r in got:
        deviation, white = want[r["vec_id"]][0]
        assert int(r["deviation"]) == deviation
        assert np.allclose(np.abs(r["whitened"]), white, rtol=1e-8, atol=1e-9) and np.allclose(r["explained"], shares, rtol=1e-9)
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9
    del signs


def test_whitened_fit_list_has_unit_covariance(table):
    rows = {tuple(r["embedding"]): r["whitened"] for r in whiten(table).collect()}
    seen = {}
    for e, w in rows.items():
        seen[tuple(math.floor(256 * c) for c in e)] = w
    w = np.array(list(seen.values()))
    w -= w.mean(0)
    assert np.abs(w.T @ w / len(w) - np.eye(4)).max() < 1e-9


def test_query(spark, table, tmp_path):
    table.withColumn("component", F.lit(1)).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op12_gramian_whitening(spark, str(tmp_path))
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    n, want, shares = brute(vectors())
    rows = got.collect()
    assert len(rows) == 4 * sum(map(len, want.values()))
    for r in rows:
        deviation, white = want[r["vec_id"]][0]
        j = r["component"] - 1
        assert r["deviation"] == deviation and abs(abs(r["whitened"]) - white[j]) < 1e-8 and abs(r["explained"] - shares[j]) < 1e-9
    per_sign = {(r["vec_id"], r["component"]): r["whitened"] for r in rows}
    assert per_sign[(3, 1)] == per_sign[(1005, 1)]


def test_clashing_columns_and_nulls(table):
    df = table.withColumn("x", F.lit("x")).withColumn("row", F.lit("r")).withColumn("n", F.lit("old")).withColumn("0", F.lit("zero")).withColumn("v.w", F.lit(1))
    out = whiten(df)
    assert out.columns.count("n") == 1 and out.where("x = 'x' and row = 'r' and `0` = 'zero' and `v.w` = 1").count() == out.count() > 200


def test_degenerate_tables(spark):
    of = lambda rows: spark.createDataFrame(rows, DDL)
    assert whiten(of([])).count() == 0 and whiten(of([(1, None, 1), (2, [], 1)])).count() == 0
    one = whiten(of([(1, [0.5, 0.25], 1), (2, [0.5, 0.25], 1)])).collect()
    assert [(r["n"], int(r["deviation"]), list(r["whitened"]), list(r["explained"]), r["identity_error"]) for r in one] == [(1, 0, [None, None], [0.0, 0.0], None)] * 2
    line = whiten(of([(i, [float(i), 2.0 * i, 1.0], 1) for i in range(5)])).collect()
    assert all(r["whitened"][1] is None and r["whitened"][2] is None and abs(r["explained"][0] - 1) < 1e-12 for r in line) and line[0]["identity_error"] < 1e-9
    with pytest.raises(ValueError, match="dimensions"):
        whiten(of([(1, [1.0], 1), (2, [1.0, 2.0], 1)]))
    zero = whiten(of([(1, [0.0, 1.0], 1), (2, [-0.0, 1.0], 1), (3, [1.0, 0.0], 1)]))
    assert {r["n"] for r in zero.collect()} == {2}


def test_numbers_beyond_64_bits(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) * 2.0**k for k in (2, 30, 42)], None) for i in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    n, want, _ = brute(rows, 3)
    got = whiten(table, 3).collect()
    assert {r["vec_id"]: int(r["deviation"]) for r in got} == {i: v[0][0] for i, v in want.items()}
    x = np.array([[3 * 2**40, -7], [2**41, 5]])
    assert whitening.deviations(x, 2, [2**42, 0]).dtype == object and whitening.deviations(x, 2, [0, 0])[0, 1] == -14
