import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F
from speechlake.llm import decontamination
from speechlake.llm.decontamination import decontaminate, op13_prefix_filtered_decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(text, items, width=10):
    w, hit, who = words(text), set(), set()
    for i, t in items:
        own = words(t)
        n = min(width, len(own))
        if i is None or not n:
            continue
        windows = {tuple(own[s : s + n]) for s in range(len(own) - n + 1)}
        for s in range(len(w) - n + 1):
            if tuple(w[s : s + n]) in windows:
                hit.update(range(s, s + n))
                who.add(i)
    return len(w), len(hit), sorted(who)


@pytest.fixture(scope="module")
def items(rows):
    long = [r[1] for r in rows if r[1] and len(words(r[1])) > 100]
    cut = lambda t, a, b: "; ".join(words(t)[a:b]).upper()
    out = [(i, cut(t, 7 * i, 7 * i + 9 + i)) for i, t in enumerate(long[:8])]
    # shorter than a window, one word, repeated words, nothing, shared by two, an id twice, no id
    return [*out, (20, cut(long[9], 3, 7)), (21, "one"), (22, "x " * 12), (23, None), (24, " ,;"), (25, out[5][1]), (21, cut(long[2], 0, 30)), (None, long[3]), (26, "never seen " * 8)]


def check(df, items, width=10):
    for r in df.collect():
        n, hit, who = brute(r["text"], items, width)
        assert (r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"]) == (n, hit, who, hit > 0), r["doc_id"]
        assert sum(s["end"] - s["start"] for s in r["hit_spans"]) == hit


def test_every_document_against_brute_force(spark, docs, items):
    table = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate(docs, table).cache()
    check(out, items)
    assert out.where("contaminated").count() > 10 and out.where("size(items) > 1").count() > 2


@pytest.mark.parametrize("width", [1, 2, 5])
def test_other_widths(spark, docs, items, width):
    check(decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"), width), items, width)


def test_blocks_of_windows_add_up(spark, docs, items, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_WINDOWS", 40)
    check(decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")), items)


def test_a_passage_that_most_texts_hold(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(3))
    passage = [word() for _ in range(25)]
    texts = [[word() for _ in range(rng.randint(0, 60))] for _ in range(300)]
    for t in texts[::2]:
        at = rng.randint(0, len(t))
        t[at:at] = passage[: rng.choice([9, 10, 25])]
    items = [(1, " ".join(passage)), (2, " ".join(passage[:10])), (3, " ".join(passage[1:10]))]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    check(decontaminate(df, spark.createDataFrame(items, "item_id long, text string")), items)


def test_nulls_repeats_and_clashing_columns(spark, awkward):
    items = [(1, "the same long row the same long row the"), (2, "twice"), (3, "words")]
    df = awkward.withColumn("n_hit", F.lit("x")).withColumn("items", F.lit(1)).withColumn("windows", F.lit(2))
    out = decontaminate(df, spark.createDataFrame(items, "item_id long, text string"))
    assert out.count() == awkward.count() and out.columns.count("n_hit") == 1 and out.agg(F.sum("windows")).first()[0] == 2 * awkward.count()
    check(out, items)


def test_nothing(spark, nothing, docs):
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert decontaminate(nothing, items).count() == 0
    assert decontaminate(docs, items.limit(0)).where("contaminated or size(items) > 0").count() == 0


def test_very_long_text(spark):
    w = [f"w{i % 1013}" for i in range(400_000)]
    text = " ".join(w) + " " + "q" * 1_000_000
    items = [(1, " ".join(w[5:25])), (2, "q" * 1_000_000), (3, " ".join(w[:10][::-1]))]
    check(decontaminate(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")), items)


def test_only_the_rarest_shingle_of_a_window_is_joined(spark):
    w = decontamination.Windows([{"window": "a b c d".split(), "items": [1]}, {"window": "b c d e".split(), "items": [2]}])
    counts = {"a b c": 9, "b c d": 50, "c d e": 1}
    of = {h: n for s, n in counts.items() for h in decontamination.shingles(decontamination.Terms(decontamination.pa.array([s])).h, 3).tolist()}
    w.choose(decontamination.np.array([of[h] for h in w.keys.tolist()]))
    got = dict(zip(w.prefix_window.tolist(), w.prefix_offset.tolist()))
    assert got == {0: 0, 1: 1} and len(w.prefixes) == 2


def test_query_digest(spark, sf, rows, tmp_path):
    import os

    os.symlink(f"{sf}/documents.parquet", f"{tmp_path}/documents.parquet")
    items = [(9, " ".join(words(rows[3][1])[:10])), (10, " ".join(words(rows[3][1])[:11])), (100, " ".join(words(rows[3][1])[1:12]))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for r in op13_prefix_filtered_decontamination(spark, str(tmp_path)).collect():
        n, hit, who = brute(rows[r["doc_id"]][1], items)
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(map(str, who))).encode()).hexdigest() and r["n_items"] == len(who) and r["n_hit"] == hit
