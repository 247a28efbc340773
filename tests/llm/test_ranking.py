import math
import re
from collections import Counter

import numpy as np
import pytest
from speechlake.llm import ranking
from speechlake.llm.ranking import best, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ITEMS = [(1, "an TARO be, and lume; 中文 text"), (2, "one"), (3, None), (4, ""), (5, "no-such-term-zzz"), (6, "x x x taroki"), (1, "added so naso"), (None, "robe")]


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, k):
    tf = [(d, Counter(terms(t))) for d, t in docs]
    tf = [(d, c) for d, c in tf if c]
    n_docs, n_terms = len(tf), sum(sum(c.values()) for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, own in asked.items():
        scores = []
        for d, c in tf:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in own if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(i, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def test_all_documents_against_brute_force(docs, rows, items):
    got = found(search(docs, items, 10))
    assert got == brute([(r[0], r[1]) for r in rows], ITEMS, 10) and len(got) > 20


def test_blocks_of_queries_give_the_same(docs, items, monkeypatch):
    whole = found(search(docs, items, 3))
    monkeypatch.setattr(ranking, "BLOCK_TERMS", 4)
    assert found(search(docs, items, 3)) == whole


def test_a_shard_for_each_partition_or_many_give_the_same(docs, items, monkeypatch):
    whole = found(search(docs.coalesce(1), items, 10))
    assert found(search(docs.repartition(7), items, 10)) == whole


def test_ties_go_by_doc_id_across_shards(spark):
    docs = spark.createDataFrame([(100 - i, "same words here") for i in range(90)] + [(200, "else")], "doc_id long, text string").repartition(6)
    items = spark.createDataFrame([(1, "words"), (2, "else")], "item_id long, text string")
    got = [(r["item_id"], r["rank"], r["doc_id"]) for r in search(docs, items, 4).orderBy("item_id", "rank").collect()]
    assert got == [(1, 1, 11), (1, 2, 12), (1, 3, 13), (1, 4, 14), (2, 1, 200)]


def test_nulls_repeats_and_other_columns(spark, awkward):
    items = spark.createDataFrame([(1, "twice some", 7)], "item_id long, text string, score int")
    got = found(search(awkward.withColumnRenamed("lang", "rank"), items, 10))
    want = brute([(r["doc_id"], r["text"]) for r in awkward.collect()], [(1, "twice some")], 10)
    assert got == want and [r[2] for r in sorted(got, key=lambda r: r[1])] == [None, 7, 7]


def test_nothing(spark, nothing, docs, items):
    empty = items.limit(0)
    assert search(nothing, items).count() == 0 and search(docs, empty).count() == 0
    assert search(nothing, empty).columns == ["item_id", "rank", "doc_id", "score"]


def test_very_long_text_and_term(spark):
    text = " ".join(f"w{i % 977}" for i in range(300_000)) + " " + "é" * 600_000
    docs = spark.createDataFrame([(1, text), (2, "w1 w2"), (3, "é" * 600_000)], "doc_id long, text string")
    items = [(1, "w1"), (2, "é" * 600_000)]
    got = found(search(docs, spark.createDataFrame(items, "item_id long, text string")))
    assert got == brute([(1, text), (2, "w1 w2"), (3, "é" * 600_000)], items, 10)


def test_best_keeps_the_smallest_ids_of_a_tie():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(0, 40))
        scores, ids = rng.integers(0, 5, n), rng.permutation(100)[:n]
        want = sorted((i for i in range(n) if scores[i] > 0), key=lambda i: (-scores[i], ids[i]))[:6]
        assert best(scores, ids, 6).tolist() == want


def test_another_term_with_the_same_hash_is_not_taken(spark, docs):
    from speechlake.llm.common import Scratch

    tables = Scratch(spark)
    shard = ranking.Postings(ranking.index(docs.coalesce(1), tables)[0].first().asDict())
    h = shard.terms[:3]
    spelled = [shard.spelled[e - s : e] for e, s in zip(shard.ends[:3], shard.sizes[:3])]
    assert shard.find(h, spelled).tolist() == [0, 1, 2] and shard.find(h, [b"?", *spelled[1:]]).tolist() == [-1, 1, 2]
    tables.free()
