import hashlib
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F
from speechlake.llm import fingerprints as P


def h64(x, seed=42):
    return xxhash.xxh64_intdigest(struct.pack("<Q", x % 2**64), seed)


def hint(x, seed):
    return xxhash.xxh64_intdigest(struct.pack("<I", x), seed)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute(text, k=3):
    w = [xxhash.xxh64_intdigest(x.encode(), 42) for x in re.findall("[^\x20\x09-\x0d]+", text or "")]
    if len(w) >= k:
        mers = [h64(w[i + 2], h64(w[i + 1], h64(w[i]))) for i in range(len(w) - k + 1)]
    else:
        seed = 42
        for x in w:
            seed = h64(x, seed)
        mers = [seed] if w else []
    seen, keyed = {}, []
    for p, m in enumerate(mers):
        seen[m] = seen.get(m, -1) + 1
        keyed.append((signed(hint(seen[m], h64(m))), p))
    out = []
    for slot in range(-P.SLOTS // 2, P.SLOTS // 2):
        two = sorted(x for x in keyed if x[0] >> (64 - P.SLOT_BITS) == slot)[:2]
        two.sort(key=lambda x: x[1])
        out.append(None if not two else signed(h64(two[0][0])) if len(two) == 1 else signed(h64(two[1][0], h64(two[0][0]))))
    return out


def like(a, b):
    held = [i for i in range(P.SLOTS) if a[i] is not None or b[i] is not None]
    return sum(a[i] == b[i] and a[i] is not None for i in held) / len(held) if held else 1.0


def test_signatures_equal_brute_force(spark, docs, rows):
    text = {i: t for i, t, *_ in rows}
    for r in P.fingerprints(docs.withColumn("signature", F.lit("x"))).collect():
        assert r["signature"] == brute(text[r["doc_id"]])


def test_order_and_repeats_show(spark):
    a = " ".join(f"w{i}" for i in range(400))
    w = a.split()
    texts = [a, " ".join(w[200:] + w[:200]), " ".join(w[:390] + ["x"] * 10), a + " " + a, ""]
    s = [r["signature"] for r in P.fingerprints(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)).collect()]
    same = [like(s[0], x) for x in s]
    assert same[0] == 1 and same[2] > 0.8 > same[1] and same[2] > same[3] and same[4] == 0


def test_query(spark, sf, rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {r["doc_id"]: r for r in P.op10_order_minhash_fingerprints(spark, sf).collect()}
    assert len(out) == len(rows)
    for k, (i, t, *_) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        r = out[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["sampled_near_edited"] == pytest.approx(like(brute(t), brute(edited))) and r["sampled_near_next"] == pytest.approx(like(brute(t), brute(nxt)))
        assert len(r["fingerprint"]) == 8 * P.SLOTS


def test_awkward_and_empty(awkward, nothing):
    cols = awkward.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = P.with_next(cols, ["doc_id", "text"]).collect()
    assert len(out) == awkward.count() and {r["next_doc_id"] for r in out} == {None, 7, 8, 9}
    assert P.with_next(nothing.select("doc_id", "text"), ["text"]).count() == 0


def test_columns_of_any_name(spark):
    rows = [(i, f"text {i}", "r", True, f"old {i}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __range string, __added boolean, next_text string").withColumn("a.b", F.col("doc_id") + 1)
    out = P.with_next(df, ["text", "a.b"]).collect()
    assert len(out) == 20 and {(r["doc_id"], r["__range"], r["next_text"], r["next_a.b"]) for r in out} == {(i, "r", f"text {(i - 1) % 20}", (i - 1) % 20 + 1) for i in range(20)}


def test_one_doc_id_alone(spark):
    df = spark.createDataFrame([(5, t) for t in "abcab"], "doc_id long, text string")
    out = P.with_next(df, ["text"], {"n": F.length("text")})
    assert sorted((r["text"], r["next_text"], r["n"]) for r in out.collect()) == [("a", "a", 1), ("a", "c", 1), ("b", "a", 1), ("b", "b", 1), ("c", "b", 1)]


def brute_filled(text, k=3):
    """Slots of fewer than two k-mers take the two minima of all k-mers by a hash of their own."""
    w = [xxhash.xxh64_intdigest(x.encode(), 42) for x in re.findall("[^\x20\x09-\x0d]+", text or "")]
    mers = [h64(w[i + 2], h64(w[i + 1], h64(w[i]))) for i in range(len(w) - k + 1)]
    if w and len(w) < k:
        seed = 42
        for x in w:
            seed = h64(x, seed)
        mers = [seed]
    seen, keyed = {}, []
    for p, m in enumerate(mers):
        seen[m] = seen.get(m, -1) + 1
        keyed.append((signed(hint(seen[m], h64(m))), p))
    out = brute(text, k)
    for i, slot in enumerate(range(-P.SLOTS // 2, P.SLOTS // 2)):
        if sum(x[0] >> (64 - P.SLOT_BITS) == slot for x in keyed) < 2:
            two = sorted((signed(h64(slot, h64(h))), p) for h, p in keyed)[:2]
            two.sort(key=lambda x: x[1])
            out[i] = None if not two else signed(h64(two[0][0])) if len(two) == 1 else signed(h64(two[1][0], h64(two[0][0])))
    return out


def test_filled_signatures_equal_brute_force(spark, docs, rows):
    text = {i: t for i, t, *_ in rows}
    for r in P.fingerprints(docs, fill=True).collect():
        assert r["signature"] == brute_filled(text[r["doc_id"]])


def test_order_shows_in_short_texts(spark):
    """Two halves swapped: most pairs of k-mers change their order, in texts of a dozen words as in long ones."""
    pairs = [(" ".join(w), " ".join(w[n // 2 :] + w[: n // 2])) for n in (12, 20, 33, 55) for d in range(40) for w in [[f"w{d}x{i}" for i in range(n)]]]
    df = spark.createDataFrame(pairs, "a string, b string").coalesce(1)
    out = df.select(P.likeness(P.signature(F.col("a"), fill=True), P.signature(F.col("b"), fill=True)).alias("x"), F.size(F.split("a", " ")).alias("n")).groupBy("n").agg(F.avg("x").alias("x"))
    for r in out.collect():
        n = r["n"]  # of n k-mers in either text two are not in the other; a pair agrees if both are of the same half
        law = sum((x - 2) * (x - 3) for x in (n // 2, n - n // 2)) / (n * (n - 1))
        assert abs(r["x"] - law) < 0.05


def test_query_compares_filled_signatures(spark, sf, rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {r["doc_id"]: r for r in P.op10_order_minhash_fingerprints(spark, sf).collect()}
    for k, (i, t, *_) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        r = out[i]
        assert r["near_edited"] == pytest.approx(like(brute_filled(t), brute_filled(edited)))
        assert r["near_next"] == pytest.approx(like(brute_filled(t), brute_filled(nxt)))
        assert r["fingerprint"].count(".") == (0 if t.split() else 8 * P.SLOTS)
