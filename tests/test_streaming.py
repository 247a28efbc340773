import datetime as dt

from pyspark.sql import functions as F
from speechlake.operators import vectors
from speechlake.streaming import sessions as S


def at(minute):
    return dt.datetime(2024, 1, 1, 10) + dt.timedelta(minutes=minute)


def write(spark, folder, name, rows):
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, value double").coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def stream(spark, folder):
    schema = "event_id long, user_id long, ts timestamp_ntz, value double"
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(folder)


def test_closed_sessions_are_appended_once(spark, tmp_path):
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    write(spark, folder, "a", [(1, 7, at(0), 1.0), (2, 7, at(30), 2.0), (3, 8, at(300), 4.0)])
    S.append_to_table(S.sessions(stream(spark, folder)), out, check)
    write(spark, folder, "b", [(4, 7, at(330), 8.0), (5, 9, at(900), 16.0)])
    S.append_to_table(S.sessions(stream(spark, folder)), out, check)
    got = sorted((r["user_id"], r["n_events"], r["total"]) for r in spark.read.parquet(out).collect())
    assert got == [(7, 1, 8.0), (7, 2, 3.0), (8, 1, 4.0)]  # the session of user 9 is still open


def test_repeated_audio_comes_once(spark, tmp_path):
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    spark.createDataFrame([("a", "f1", at(0)), ("b", "f1", at(1)), ("c", "f2", at(2))], "transcript_id string, content_audio_fp string, recorded_at timestamp").coalesce(1).write.parquet(folder)
    raw = spark.readStream.schema("transcript_id string, content_audio_fp string, recorded_at timestamp").parquet(folder)
    S.new_transcripts(raw).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["content_audio_fp"] for r in spark.read.parquet(out).collect()) == ["f1", "f2"]


def test_two_nearest_with_and_without_broadcast(spark, monkeypatch):
    o = spark.createDataFrame([(i, "m" if i % 3 else None, [float(i % 7) + 1, float(i % 5), 1.0]) for i in range(40)], "k long, model string, embedding array<double>")
    p = spark.createDataFrame([(f"P{i:02d}", "m" if i % 2 else None, [float(i % 4), float(i % 9), 2.0]) for i in range(30)], "fingerprint_id string, model string, embedding array<double>")
    found = lambda: sorted(map(tuple, vectors.nearest_two(o, p, "k", "fingerprint_id", "model").select(F.col("k"), "best_id", F.round("best", 9), "second_id").collect()))
    one = found()
    monkeypatch.setattr(vectors, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(vectors, "BLOCK", 4)
    assert found() == one and len(one) == 40
