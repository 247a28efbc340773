"""The index against SQLite's FTS5, which has the same query language and snippets."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F
from speechlake import search, store

WORDS = "um like because the search index über naïve Señor one two three four-five x_y it's go. stop: Ends".split()
QUERIES = [
    "um", "um AND like", "um like", "um OR search index", "um NOT like", "(um OR two) AND NOT_x", '"search index"', "sea*", '"um li" *', "um + like", "NEAR(um like, 2)",
    "NEAR(um like two)", 'NEAR("one two" um, 3)', "naive", "uber OR senor", "ÜBER", "^um", "^um AND like", "(um NOT like) OR (two NOT three)", "um NOT (like OR two)", "a* OR t*",
    "nothing", '"four five"', "x_y", "NEAR(sea* um, 1)", '"it s"', "um AND um", '"um um"', "one OR two OR three OR four", '"search index" OR index', "NEAR(um um, 4)", '"two three" OR "three four"',
]
BAD = ["", '"open', "um AND", "OR um", "NOT um", "(um", "um)", "um (like)", "(um) like", "NEAR(um, x)", "NEAR()", "a-b", "*", "um ** like", "+ um"]
SP, T = "transcript_id string, speaker_id string, fingerprint_id string, display_name string", "transcript_id string, duration_ms long, created_at string"


def corpus(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        k = rng.choice([0, 1, 3, 8, 20, 60, 90])
        text = "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", ", ", ".\n", "  "]) for _ in range(k))
        out.append((f"t{i // 5:02d}", i % 5, f"s{i % 5}", f"S{i % 2}", rng.choice(["", " ", "..."]) + text))
    return out


def sqlite(rows):
    c = sqlite3.connect(":memory:")
    c.execute("create virtual table f using fts5(text, transcript_id unindexed, seq unindexed)")
    c.executemany("insert into f values (?, ?, ?)", [(r[4], r[0], r[1]) for r in rows])
    return lambda q: sorted(c.execute("select transcript_id, cast(seq as integer), snippet(f, 0, '<<', '>>', '...', 16) from f where f match ?", (q,)).fetchall())


def saved(spark, path, rows):
    db = store.Store(spark, path)
    s = spark.createDataFrame(rows, "transcript_id string, seq long, segment_id string, speaker_id string, text string")
    ids = sorted({r[0] for r in rows})
    db.save(spark.createDataFrame([(i, 1, "c") for i in ids], T), spark.createDataFrame([(i, f"S{k}", None, None) for i in ids for k in (0, 1)], SP), s)
    return db


@pytest.fixture(scope="module")
def rows():
    return corpus(1, 120)


@pytest.fixture(scope="module")
def db(spark, rows, tmp_path_factory):
    return saved(spark, str(tmp_path_factory.mktemp("db")), rows)


def found(df):
    return sorted((r["transcript_id"], r["seq"], r["snippet"]) for r in df.collect())


@pytest.mark.parametrize("q", QUERIES)
def test_same_rows_and_snippets_as_fts5(db, rows, q):
    assert found(db.search(q, None)) == sqlite(rows)(q)


@pytest.mark.parametrize("q", BAD)
def test_malformed_queries(db, rows, q):
    with pytest.raises(ValueError, match="malformed"):
        db.search(q)


def test_limit_is_by_transcript_and_seq(db):
    whole, some = found(db.search("um", None)), db.search("um", 7)
    assert found(some) == whole[:7] and some.columns == ["transcript_id", "seq", "segment_id", "speaker_id", "snippet"]
    assert db.search("um", 0).count() == 0 and found(db.search("um", 5000)) == whole


def test_saves_and_deletes_reach_the_index(spark, rows, tmp_path):
    db = saved(spark, str(tmp_path), rows)
    one = [("t03", 0, "s0", "S0", "quite another text of um")]
    db.save(spark.createDataFrame([("t03", 1, "c")], T), spark.createDataFrame([("t03", "S0", None, None)], SP), spark.createDataFrame(one, "transcript_id string, seq long, segment_id string, speaker_id string, text string"))
    db.delete(spark.createDataFrame([("t05",)], "transcript_id string"))
    now = [r for r in rows if r[0] not in ("t03", "t05")] + one
    for q in ("um", "quite", "NEAR(um like, 3)", "t*"):
        assert found(db.search(q, None)) == sqlite(now)(q)
    before = found(db.search("um OR one", None))
    db.log.compact("postings", True)
    assert found(db.search("um OR one", None)) == before


def test_files_read_depend_on_the_terms(spark, tmp_path):
    rows = [(f"t{i:03d}", 0, "s0", "S0", " ".join(f"{a}{i % 50:02d}" for a in "abcdefgh") + " common") for i in range(400)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        db = saved(spark, str(tmp_path), rows)
        db.log.compact("postings", True)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    state = db.log.state()
    files = lambda **k: len(db.log.read("postings", state=state, **k).inputFiles())
    whole = files()
    assert whole >= 4 and files(values=["a07"]) == 1 and files(prefixes=["b1"]) <= 2 and files(values=["a07", "h49"]) == 2 and files(values=["zzz"]) == 0
    segments = lambda q: search.hits_of(db.log, q, state).inputFiles()
    q = search.Query("a07 AND a08")
    q.resolve(spark)
    assert len(segments(q)) < whole and db.search("a07 AND common", None).count() == 8


def test_a_term_of_many_segments_lies_in_many_files(spark, tmp_path):
    rows = [(f"t{i:04d}", 0, "s0", "S0", "common") for i in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        db = saved(spark, str(tmp_path), rows)
        db.log.compact("postings", True)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(db.log.read("postings", values=["common"]).inputFiles()) >= 4


def test_postings_of_nulls_and_empty_texts(spark):
    s = spark.createDataFrame([("t", 0, None), ("t", 1, ""), ("t", 2, "..."), ("t", 3, "B a b B")], "transcript_id string, seq long, text string")
    got = {r["term"]: r["gaps"] for r in search.postings(s).collect()}
    assert got == {"b": [0, 2, 1], "a": [1]} and search.postings(s.limit(0)).count() == 0


def test_a_very_long_text(spark):
    s = spark.createDataFrame([("t", 0, " ".join(f"w{i % 999}" for i in range(60_000)))], "transcript_id string, seq long, text string")
    p = search.postings(s)
    assert p.agg(F.sum(F.size("gaps"))).first()[0] == 60_000 and p.count() == 999
