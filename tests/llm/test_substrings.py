import hashlib

import numpy as np
from pyspark.sql import functions as F
from speechlake.llm import substrings as B


def brute(rows, width=13):
    least = {}
    words = [(i, B.split_words(t)) for i, t, *_ in rows]
    for i, w in words:
        if i is not None:
            for k in range(len(w) - width + 1):
                g = tuple(w[k : k + width])
                least[g] = min(i, least.get(g, i))
    for i, w in words:
        gone = set()
        if i is not None:
            for k in range(len(w) - width + 1):
                if least[tuple(w[k : k + width])] < i:
                    gone.update(range(k, k + width))
        yield i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()


def result(df, width=13):
    return [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in B.remove_repeats(df, width).collect()]


def key(rows):
    return sorted(rows, key=str)


def test_equals_brute_force(docs, rows, monkeypatch):
    assert key(result(docs)) == key(brute(rows))
    assert key(result(docs, 3)) == key(brute(rows, 3))


def test_spans_are_maximal(docs):
    for r in B.remove_repeats(docs).collect():
        spans = [tuple(s) for s in r["removed_spans"]]
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:])) and sum(b - a for a, b in spans) == r["n_removed"]


def test_awkward_empty_and_clashing(spark, awkward, nothing):
    more = awkward.unionByName(spark.createDataFrame([(9, "the same long row " * 20, None, None, None), (10, "the same long row " * 20, None, None, None), (None, "the same long row " * 20, None, None, None)], awkward.schema))
    clash = more.withColumn("n_words", F.lit("x"))
    assert key(result(clash)) == key(brute([tuple(r) for r in more.collect()]))
    assert result(nothing) == []


def test_query(spark, sf, rows):
    out = {(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in B.op4_repeated_substrings(spark, sf).collect()}
    assert out == {(i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in brute(rows)}


def test_a_bucket_is_answered_in_ranges():
    """Beside the bucket itself a range of it is held, and the answers are those of one sort."""
    import tracemalloc

    rng = np.random.default_rng(8)
    pool = np.unique(rng.integers(0, 2**63, 900_000).astype(np.uint64))
    hi = [np.sort(rng.choice(pool, 400_000, replace=False)) for _ in range(5)]
    lo = [(x % np.uint64(7)).astype(np.uint32) for x in hi]
    doc = [rng.integers(0, 1000, len(x)).astype(np.uint64) for x in hi]
    low = [-500, 0, 3, 10, 2**40]
    tracemalloc.start()
    got = B.held_earlier(hi, lo, doc, low)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    ids, every = np.concatenate([d.astype(np.int64) + n for d, n in zip(doc, low, strict=True)]), np.concatenate(hi)
    least = np.full(len(pool), 2**62)
    place = np.searchsorted(pool, every)
    np.minimum.at(least, place, ids)
    assert (np.concatenate(got) == (ids > least[place])).all() and 0 < np.concatenate(got).mean() < 1
    assert peak < 40_000_000
