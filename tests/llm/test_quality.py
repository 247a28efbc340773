import re
import struct
from collections import Counter
from math import log

import pytest
import xxhash
from pyspark.sql import functions as F
from speechlake.llm import quality as Q


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def buckets(text):
    tokens = [m[0] for m in re.finditer(r"[^\W]+|[^\w \t-\r]+", (text or "").lower())]
    h = [xxhash.xxh64_intdigest(t.encode(), 42) for t in tokens]
    two = [xxhash.xxh64_intdigest(struct.pack("<Q", b), xxhash.xxh64_intdigest(struct.pack("<Q", a), 42)) for a, b in zip(h, h[1:])]
    return [signed(x) % Q.BUCKETS for x in h + two]


def base(text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    runs = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


TEXTS = ["a b c d e f g h i j a b c d e f g h z", "q " * 40, "same line\nsame line\n\n \nother <b> & # $", "x|y * z % w"]


def test_base_rules(spark, rows):
    texts = [t for _, t, *_ in rows] + TEXTS
    out = spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", Q.base_rules(F.coalesce("text", F.lit(""))).alias("b")).collect()
    assert all(tuple(r["b"]) == base(texts[r["i"]]) for r in out)


def test_scores_equal_brute_force(spark, docs, rows):
    good = {i for i, *_ in rows if i % 3}
    target = Q.target_ids(spark.createDataFrame([(i, int(i in good)) for i, *_ in rows], "doc_id long, quality int"))
    raw, fine = Counter(), Counter()
    for i, t, *_ in rows:
        raw.update(buckets(t))
        fine.update(buckets(t) if i in good else [])
    n, m = sum(raw.values()) + Q.BUCKETS, sum(fine.values()) + Q.BUCKETS
    ratio = lambda b: log((fine[b] + 1) / m) - log((raw[b] + 1) / n)
    out = Q.quality_rules(docs, target).collect()
    assert len(out) == len(rows)
    text = {i: t for i, t, *_ in rows}
    for r in out:
        b = buckets(text[r["doc_id"]])
        score = sum(map(ratio, b)) / len(b) if b else 0.0
        assert r["score"] == pytest.approx(score, abs=1e-9)
        failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["score"] >= Q.THRESHOLD)


def test_awkward_empty_and_clashing(spark, awkward, nothing):
    labels = spark.createDataFrame([(7, 1), (7, 0), (None, 1), (9, 1), (9, 1)], "doc_id long, quality int")
    clash = awkward.withColumn("score", F.lit("x")).withColumn("kept", F.lit(3))
    out = Q.quality_rules(clash, Q.target_ids(labels)).collect()
    assert len(out) == awkward.count() and all(r["base_failed"] for r in out if r["text"] in (None, "", "twice"))
    assert [r[0] for r in Q.target_ids(labels).collect()] == [9]
    assert Q.quality_rules(nothing, Q.target_ids(labels)).count() == 0
    assert Q.quality_rules(awkward, Q.target_ids(labels.where("false"))).count() == awkward.count()


def test_separates_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    out = Q.op2_importance_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").collect()
    good, bad = [r for r in out if r["quality"] == 1], [r for r in out if r["quality"] == 0]
    assert sum(r["kept"] for r in good) >= 0.99 * len(good) and sum(r["kept"] for r in bad) <= 0.1 * len(bad)
