"""The commit log and the store on it: crashes, two writers, small saves, upkeep."""

import os
import threading

import pytest
from pyspark.sql import functions as F
from speechlake import store
from speechlake.log import Change, Conflict, Log

T = "transcript_id string, n int, raw_json string, created_at string"
SP = "transcript_id string, speaker_id string, fingerprint_id string"
SG = "transcript_id string, seq long, segment_id string, speaker_id string, text string"


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def transcript(spark, i, n=1, raw=None, at="first", text="some words"):
    return (
        spark.createDataFrame([(i, n, raw, at)], T), spark.createDataFrame([(i, "S1", None)], SP),
        spark.createDataFrame([(i, k, f"s{k}", "S1", f"{text} {k}") for k in range(3)], SG),
    )


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


@pytest.fixture
def db(spark, tmp_path):
    out = store.Store(spark, str(tmp_path / "db"))
    many = [transcript(spark, f"t{i}") for i in range(4)]
    out.save(*[a.unionByName(b).unionByName(c).unionByName(d).coalesce(1) for a, b, c, d in zip(*many)])
    return out


def test_raw_json_and_first_time_are_kept(spark, db):
    db.save(*transcript(spark, "t1", 2, "{}", "second"))
    db.save(*transcript(spark, "t1", 3, None, "third"))
    assert rows(db.read("transcripts").where("transcript_id = 't1'"), "n", "raw_json", "created_at") == [(3, "{}", "first")]
    assert db.read("transcripts").count() == 4 and db.read("segments").count() == 12


def test_a_save_writes_files_of_its_transcript_only(spark, db):
    before = files(db.path)
    db.save(*transcript(spark, "t2", 9, text="fresh"))
    new = files(db.path) - before
    assert before <= files(db.path) and new
    data = [f for f in new if "-gone" not in f]
    for f in data:
        df = spark.read.parquet(f)
        assert "transcript_id" not in df.columns or {r[0] for r in df.select("transcript_id").distinct().collect()} <= {"t2"}
    assert len(data) <= 6 and len(db.of("segments", db.read("transcripts").where("transcript_id = 't2'")).inputFiles()) <= 3  # with the one of keys that went
    assert rows(db.read("segments").where("transcript_id = 't2'"), "seq", "text") == [(k, f"fresh {k}") for k in range(3)]


def test_leftovers_of_a_crash_are_no_obstacle(spark, db):
    n = db.log.newest()
    os.makedirs(f"{db.path}/data/transcripts/half")
    open(f"{db.path}/data/transcripts/half/part-0.parquet", "w").write("half a file")
    open(f"{db.path}/log/.abc.tmp", "w").write('{"commit"')
    real, db.log._publish = db.log._publish, lambda *a: (_ for _ in ()).throw(OSError("killed"))
    with pytest.raises(OSError):
        db.save(*transcript(spark, "t9"))
    db.log._publish = real
    assert db.log.newest() == n and db.read("transcripts").count() == 4 and not db.search("words", None).where("transcript_id = 't9'").count()
    db.save(*transcript(spark, "t9"))
    assert db.log.newest() == n + 1 and db.read("transcripts").count() == 5
    t = store.Table(spark, f"{db.path}/table")
    t.write(spark.range(3))
    os.makedirs(f"{db.path}/table/data/rows/left")
    assert t.write(spark.range(5)) == 2 and t.read().count() == 5


def test_two_writers_of_one_commit(spark, db):
    state = db.log.state()
    df = spark.createDataFrame([("x", 1)], "transcript_id string, k int")
    db.log.commit({"more": Change(df)}, state=state)
    before = files(db.path)
    with pytest.raises(Conflict):
        db.log.commit({"more": Change(df.withColumn("k", F.lit(2)))}, state=state)
    assert rows(db.read("more"), "k") == [(1,)] and files(db.path) == before
    done = []
    threads = [threading.Thread(target=lambda i=i: done.append(db.save(*transcript(spark, f"p{i}"), attempts=9))) for i in range(3)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert len(set(done)) == 3 and {f"p{i}" for i in range(3)} <= {r[0] for r in db.read("transcripts").select("transcript_id").collect()}
    assert db.read("segments").count() == 21


def test_delete_restore_and_old_commits(spark, db):
    full = db.log.newest()
    db.save(*transcript(spark, "t0", 7), more={"speaker_metrics": spark.createDataFrame([("t0", "S1", 5)], "transcript_id string, speaker_id string, talk_time_ms int")})
    db.delete(spark.createDataFrame([("t0",), ("t3",), (None,), ("unknown",)], "transcript_id string"))
    assert rows(db.read("transcripts"), "transcript_id") == [("t1",), ("t2",)]
    assert db.read("segments").count() == 6 and db.read("speaker_metrics").count() == 0 and db.search("words", None).count() == 6
    assert db.read("transcripts", full).count() == 4
    db.log.restore(full)
    assert db.read("segments").count() == 12 and "speaker_metrics" not in db.log.tables()
    db.save(*transcript(spark, "t0", 8))
    assert rows(db.read("transcripts").where("transcript_id = 't0'"), "n") == [(8,)]
    with pytest.raises(ValueError, match="no such commit"):
        db.log.restore(99)


def test_compaction_and_vacuum(spark, db):
    for i in range(5):
        db.save(*transcript(spark, f"t{i % 3}", 10 + i))
    db.delete(spark.createDataFrame([("t3",)], "transcript_id string"))
    want = rows(db.read("segments"), "transcript_id", "seq", "text"), rows(db.read("transcripts"), "transcript_id", "n")
    parts = lambda name: len(db.log.state()["tables"][name]["parts"])
    many = parts("segments")
    db.log.compact("segments")
    assert 1 <= parts("segments") < many and rows(db.read("segments"), "transcript_id", "seq", "text") == want[0]
    for name in ("transcripts", "segments", "speakers", "postings"):
        db.log.compact(name, whole=True)
    assert parts("segments") == 1 and not db.log.state()["tables"]["segments"]["gone"]
    assert (rows(db.read("segments"), "transcript_id", "seq", "text"), rows(db.read("transcripts"), "transcript_id", "n")) == want
    before = files(db.path)
    assert db.log.vacuum(keep=2) == [] and files(db.path) == before  # all of it may still be somebody's work
    assert db.log.vacuum(keep=1, grace_s=0) and len(files(db.path)) < len(before) and db.log.numbers() == [db.log.newest()]
    assert rows(db.read("segments"), "transcript_id", "seq", "text") == want[0] and db.search("words", None).count() == 9
    db.save(*transcript(spark, "t1", 99))
    assert rows(db.read("transcripts").where("transcript_id = 't1'"), "n") == [(99,)] and db.read("transcripts").count() == 3


def test_columns_may_be_added(spark, db):
    t, sp, sg = transcript(spark, "t1", 5)
    db.save(t.withColumn("language", F.lit("en")).drop("raw_json").withColumn("n", F.col("n").cast("long")), sp, sg)
    assert rows(db.read("transcripts"), "transcript_id", "language") == [("t0", None), ("t1", "en"), ("t2", None), ("t3", None)]
    assert dict(db.read("transcripts").dtypes)["n"] == "int" and "language" in db.log.tables()["transcripts"]


def test_reading_only(spark, db):
    other = store.Store(spark, db.path, read_only=True)
    assert other.read("transcripts").count() == 4
    for act in (lambda: other.save(*transcript(spark, "t1")), lambda: other.delete(other.read("transcripts")), lambda: other.log.vacuum(), lambda: other.log.compact("segments")):
        with pytest.raises(ValueError, match="reading only"):
            act()


def test_prints_that_did_not_change_are_not_written(spark, db):
    ddl = "fingerprint_id string, status string, embedding array<double>"
    lib = spark.createDataFrame([(f"P{i}", "active", [float(i), 1.0]) for i in range(20)], ddl)
    db.save(*transcript(spark, "t1"), prints=lib)
    new = lib.where("fingerprint_id <> 'P3'").withColumn("status", F.when(F.col("fingerprint_id") == "P5", "discarded").otherwise(F.col("status"))).unionByName(spark.createDataFrame([("P99", "active", [0.5, 0.5])], ddl))
    db.save(*transcript(spark, "t2"), prints=new)
    assert rows(db.read("prints"), "fingerprint_id", "status") == rows(new, "fingerprint_id", "status")
    last = db.log.state()["tables"]["prints"]["parts"][-1]
    assert rows(spark.read.parquet(f"{db.path}/data/prints/{last['at']}"), "fingerprint_id") == [("P5",), ("P99",)]


def test_ranges_of_many_files(spark, tmp_path, monkeypatch):
    from speechlake import log as module

    monkeypatch.setattr(module, "INLINE_FILES", 1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        log = Log(spark, str(tmp_path / "l"))
        log.commit({"t": Change(spark.range(1000).select(F.format_string("k%04d", "id").alias("k"), "id"), key="k", order=["k", "id"])})
        log.compact("t", True)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert log.state()["tables"]["t"]["parts"][0]["files"] is None
    some = log.read("t", values=["k0007", "k0999"])
    assert rows(some, "id") == [(7,), (999,)] and 1 <= len(some.inputFiles()) <= 2 < len(log.read("t").inputFiles())
    assert log.read("t", prefixes=["k00"]).count() == 100 and log.read("t", values=[]).count() == 0
    log.commit({"t": Change(spark.createDataFrame([(None, 5)], "k string, id long"), key="k", order=["k", "id"])})
    assert log.read("t").count() == 1001 and log.read("t", values=["k0007"]).count() == 1
