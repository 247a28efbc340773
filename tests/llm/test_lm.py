import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from speechlake.llm import lm as L


def tokens(text):
    return [*(text or "").encode().lower().split(), L.END]


#: Stated apart from the module: what a byte can stand for, and the strength of shorter n-grams.
STEPS = [*range(65), *(66 * (2.0**40 / 66) ** (i / 190) for i in range(191))]
STRENGTH = {2: 100.0, 3: 5.0}


def stepped(c):
    """The step nearest to c in ratio."""
    return 0.0 if not c else float(min(STEPS[1:], key=lambda s: abs(math.log(s / c))))


def brute(rows, train, order=3):
    counts, starts = Counter(), 0
    for i, t, *_ in rows:
        if train(i):
            w = tokens(t)
            starts += 1
            counts.update((x,) for x in w)
            padded = [None, *w]
            for k in range(2, order + 1):
                counts.update(tuple(padded[j : j + k]) for j in range(len(padded) - k + 1))
    n = sum(c for g, c in counts.items() if len(g) == 1)
    v = sum(len(g) == 1 for g in counts)
    counts[(None,)] = starts
    for i, t, *_ in rows:
        w = tokens(t)
        padded, base, score = [None, *w], 0.0, 0.0
        for j, x in enumerate(w, 1):
            p = (counts[(x,)] + 1) / (n + v + 1)
            base += math.log10(p)
            for k in range(2, order + 1):
                gram = tuple(padded[j - k + 1 : j + 1]) if j >= k - 1 else None
                c, context = (stepped(counts[gram]), stepped(counts[gram[:-1]])) if gram else (0.0, 0.0)
                p = (c + STRENGTH[k] * p) / (context + STRENGTH[k])
            score += math.log10(p)
        yield i, len(w), sum(counts[(x,)] > 0 for x in w), n, base, score


def compare(out, expected):
    expected = {e[0]: e for e in expected}
    assert len(out) == len(expected)
    for r in out:
        e = expected[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == e[1:4]
        assert r["base_score"] == pytest.approx(e[4], rel=1e-9) and r["score"] == pytest.approx(e[5], rel=1e-9)


def test_equals_brute_force(spark, sf, rows, monkeypatch):
    compare(L.op8_elias_fano_lm_scores(spark, sf).collect(), brute(rows, lambda i: zlib.crc32(str(i).encode()) % 7 != 2))


def test_elias_fano_finds_what_is_there():
    rng = np.random.default_rng(1)
    for n, universe in ((1, 5), (50, 60), (3000, 1 << 20), (3000, 1 << 45), (7, 1 << 63), (0, 10)):
        values = np.unique(rng.integers(0, universe, n, dtype=np.uint64))
        e = L.EliasFano(L.EliasFano.build(values, universe))
        assert (e.access(np.arange(len(values))) == values).all()
        asked = np.concatenate([values, rng.integers(0, universe, 500, dtype=np.uint64)])
        at = {int(v): i for i, v in enumerate(values)}
        assert e.find(asked).tolist() == [at.get(int(x), -1) for x in asked]


def test_trie_is_compact_and_exact():
    rng = np.random.default_rng(2)
    keys = np.unique((rng.integers(0, 5000, 200_000, dtype=np.uint64) * np.uint64(858_993) << np.uint64(32)) | rng.integers(0, 1 << 32, 200_000, dtype=np.uint64))
    weights = rng.integers(1, 256, len(keys)).astype(np.uint8)
    trie = L.Trie(keys, weights)
    assert (trie(keys) == weights).all() and not trie(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)].any()
    assert len(trie.block) < 6.5 * len(keys)


def test_orders(spark, sf, rows):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    for order in (1, 2):
        out = L.lm_scores(df, F.col("doc_id") % 2 == 0, order).collect()
        compare(out, brute([r for r in rows], lambda i: i is not None and i % 2 == 0, order))


def test_probabilities_sum_to_one_without_quantising():
    counts, prior = np.array([3.0, 1.0, 0.0, 6.0]), L.PRIOR
    single = np.array([0.4, 0.3, 0.2, 0.1])
    assert (prior / (counts.sum() + prior) * (single + counts / prior)).sum() == pytest.approx(1)
    assert (L.GRID[L.weight_of(np.arange(65.0))] == np.arange(65)).all()
    big = np.array([1e3, 1e6, 1e9])
    assert np.allclose(L.GRID[L.weight_of(big)], big, rtol=0.07)


def test_awkward_empty_and_clashing(awkward, nothing):
    out = L.lm_scores(awkward.withColumn("score", F.lit("x")), F.col("doc_id") > 7).collect()
    assert len(out) == awkward.count() and all(math.isfinite(r["score"]) for r in out)
    assert {r["n_tokens"] for r in out if not r["score"] > 0 and r["n_chars"] in (0, None)} == {1}
    assert L.lm_scores(nothing, F.lit(True)).count() == 0
    assert all(r["train_tokens"] == 0 for r in L.lm_scores(awkward, F.lit(None).cast("boolean")).collect())
