"""Store changes, library commits, sources and exports on small frames."""

import io
import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F
from speechlake import export, store
from speechlake.operators import identity, voice
from speechlake.sources import engines, meetings

T = "transcript_id string, duration_ms long, created_at string"
SP = "transcript_id string, speaker_id string, fingerprint_id string, display_name string"
SG = "transcript_id string, seq long, speaker_id string, text string"
PR = "fingerprint_id string, model string, display_name string, status string, embedding array<double>, sample_count int"


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_a_save_is_seen_whole(spark, tmp_path):
    db = store.Store(spark, str(tmp_path / "db"))
    with pytest.raises(ValueError):
        db.read("transcripts")
    t = spark.createDataFrame([("a", 10, "first"), ("b", 20, "first")], T)
    sp = spark.createDataFrame([("a", "S1", "P1", None), ("b", "S1", "P2", None)], SP)
    sg = spark.createDataFrame([("a", 0, "S1", "x"), ("a", 1, "S1", "y"), ("b", 0, "S1", "z")], SG)
    prints = spark.createDataFrame([("P1", "m", None, "active", [1.0], 1), ("P2", "m", None, "discarded", [1.0], 1)], PR)
    db.save(t, sp, sg, prints)
    assert rows(db.read("speakers"), "transcript_id", "fingerprint_id") == [("a", "P1"), ("b", None)]
    with pytest.raises(ValueError, match="unknown speakers"):
        db.save(t, sp, sg.withColumn("speaker_id", F.lit("S9")))
    assert db.read("segments").count() == 3  # nothing of the failed save is seen
    again = spark.createDataFrame([("a", 99, "second"), ("c", 30, "second")], T)
    db.save(again, spark.createDataFrame([("a", "S2", None, None), ("c", "S1", None, None)], SP), spark.createDataFrame([("a", 0, "S2", "new"), ("c", 0, "S1", "c")], SG))
    assert rows(db.read("transcripts"), "transcript_id", "duration_ms", "created_at") == [("a", 99, "first"), ("b", 20, "first"), ("c", 30, "second")]
    assert rows(db.read("segments"), "transcript_id", "text") == [("a", "new"), ("b", "z"), ("c", "c")]
    db.delete(t.where("transcript_id = 'b'"))
    assert rows(db.read("speakers"), "transcript_id") == [("a",), ("c",)]
    assert store.exists(db.read("transcripts"), "a") and not store.exists(db.read("transcripts"), "b")


def test_guard_has_three_modes(spark):
    new, old = spark.createDataFrame([("a",), ("b",)], "transcript_id string"), spark.createDataFrame([("a",)], "transcript_id string")
    on, said = store.guarded(new, old, "skip")
    assert rows(on, "transcript_id") == [("b",)] and json.loads(said.first()["message"]) == {"transcript_id": "a", "skipped": True, "reason": "exists"}
    assert store.guarded(new, old, "force")[0].count() == 2 and store.guarded(new.where("transcript_id = 'b'"), old)[0].count() == 1
    for mode in ("error", "other"):
        with pytest.raises(ValueError):
            store.guarded(new, old, mode)


def test_a_committed_print_is_found_again(spark):
    obs = "speaker_key long, transcript_id string, speaker_id string, model string, fingerprint_id string, display_name string, embedding array<double>, duration_ms long"
    library = spark.createDataFrame([("P1", "m", "Ann", "active", [1.0, 0.0], 3)], PR)
    first = spark.createDataFrame([(1, "t1", "S1", "m", None, None, [0.99, 0.01], 60000), (2, "t1", "S2", "m", None, "Bo", [0.0, 1.0], 60000), (3, "t1", "S3", "m", None, None, None, 60000)], obs)
    found = identity.match_kinds(first, library)
    library, sources = identity.committed(library, first, found)
    got = {r["fingerprint_id"]: r for r in library.collect()}
    new = next(i for i in got if i != "P1")
    assert new == identity.print_id([0.0, 1.0], "m") and got[new]["display_name"] == "Bo" and got[new]["sample_count"] == 1
    assert got["P1"]["sample_count"] == 4 and got["P1"]["embedding"] == pytest.approx([(3 + 0.99) / 4, 0.01 / 4])
    assert rows(sources, "fingerprint_id", "speaker_id") == sorted([("P1", "S1"), (new, "S2")])
    again = spark.createDataFrame([(9, "t2", "S1", "m", None, None, [0.01, 0.99], 60000)], obs)
    assert rows(identity.match_kinds(again, library), "kind", "matched_id") == [("strong", new)]
    named = identity.labelled(library, spark.createDataFrame([("P1", "Anna")], "fingerprint_id string, name string"))
    assert dict(rows(named, "fingerprint_id", "display_name"))["P1"] == "Anna"
    with pytest.raises(ValueError, match="P7"):
        identity.labelled(library, spark.createDataFrame([("P7", "x")], "fingerprint_id string, name string"))


def test_engine_output_is_checked(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"words": [{"word": "x"}], "segments": []}')
    ddl = "words array<struct<word:string>>, segments array<string>"
    assert engines.json_files(spark, str(tmp_path / "a.json"), "asr", ddl, ("words",)).first()["value"]["words"][0]["word"] == "x"
    (tmp_path / "b.json").write_text('{"words": []}')
    with pytest.raises(Exception, match="missing required"):
        engines.json_files(spark, str(tmp_path / "b.json"), "asr", ddl, ("words", "segments")).collect()
    with pytest.raises(Exception, match="JSON object"):
        engines.metadata(spark.createDataFrame([("[1]",)], "text string")).collect()
    assert [r["metadata"] for r in engines.metadata(spark.createDataFrame([("",), ('{"a":1}',)], "text string").coalesce(1)).collect()] == ["{}", '{"a":1}']
    with pytest.raises(ValueError, match="hybrid"):
        engines.engine_named("none")
    assert engines.engine_named("hybrid") is engines.hybrid


def test_spans_and_embeddings(spark):
    tracks = spark.createDataFrame([("t", "b", 1.00049, 2.0), ("t", "a", 0.5, 0.9), ("t", "b", 0.1, 0.2)], "transcript_id string, label string, start_s double, end_s double")
    matrix = spark.createDataFrame([("t", 0, [1.0, 2.0]), ("t", 1, [float("nan")]), ("t", 5, [1.0])], "transcript_id string, i int, embedding array<double>")
    aligned = engines.aligned_embeddings(tracks, matrix)
    assert rows(aligned, "label", "embedding") == [("a", [1.0, 2.0])]
    out = engines.span_documents(tracks, aligned)
    assert rows(out, "span_idx", "speaker", "start_s", "duration_s") == [(0, "Speaker 1", 0.1, 0.1), (1, "Speaker 0", 0.5, 0.4), (2, "Speaker 1", 1.0, 1.0)]
    d = spark.createDataFrame([(0, 7), (5, 7), (None, 7), (None, None)], "d long, e long").coalesce(1)
    assert [r[0] for r in d.select(engines.duration_or_last(F.col("d"), F.col("e"))).collect()] == [7, 5, 7, 0]


def test_wav_files_and_voices(spark, tmp_path):
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as w:
        w.setparams((2, 2, 1000, 0, "NONE", ""))
        w.writeframes(np.repeat(np.arange(0, 16384, 8, dtype="<i2"), 2).tobytes())
    (tmp_path / "x.wav").write_bytes(buffer.getvalue())
    (tmp_path / "y.wav").write_bytes(b"no sound")
    assert rows(meetings.wav_files(spark, str(tmp_path)), "rate", "channels", "bits", "frames", "duration_ms") == [(1000, 2, 16, 2048, 2048), (None, None, None, None, None)]
    audio = spark.read.format("binaryFile").load(str(tmp_path / "x.wav")).select(F.lit("t").alias("transcript_id"), F.lit(1000).alias("rate"), meetings.wav_samples("content").alias("samples"))
    spans = spark.createDataFrame([("t", "A", 600, 1000), ("t", "A", 0, 300), ("t", "B", 0, 100), ("t", "C", 1500, 9000)], "transcript_id string, speaker_id string, start_ms long, end_ms long")
    out = voice.speaker_samples(spans, audio).collect()
    assert [(r["speaker_id"], len(r["samples"])) for r in out] == [("A", 700)] and out[0]["samples"][300] == pytest.approx(600 * 8 / 32768)
    m = spark.createDataFrame([("t", "A"), ("t", "B")], "transcript_id string, speaker_id string")
    v = spark.createDataFrame([("t", "A", 100.0)], "transcript_id string, speaker_id string, f0_mean_hz double")
    assert rows(voice.attach(m, v), "speaker_id", "f0_mean_hz") == [("A", 100.0), ("B", None)] and voice.attach(m, v, "off").columns == m.columns
    with pytest.raises(Exception, match="t/B"):
        voice.attach(m, v, "required").collect()
    x = spark.createDataFrame([([0.01, 0.012, 0.01],), ([1.0],)], "p array<double>").coalesce(1).select(F.round(voice.perturbation(F.col("p")), 4)).collect()
    assert [r[0] for r in x] == [0.1875, 0.0]


def test_exports_know_their_formats(spark):
    with pytest.raises(ValueError, match="unknown format"):
        export.rendered("yaml", {})
    with pytest.raises(ValueError, match="unknown detail"):
        export.rendered("csv", {}, "huge")
    csv = export.csv_text(spark.createDataFrame([("t", "B", 'a "q", b'), ("t", "A", None)], "transcript_id string, speaker_id string, speaker_name string")).first()["document"]
    assert csv == 'transcript_id,speaker_id,speaker_name\r\nt,A,\r\nt,B,"a ""q"", b"'


def test_readiness():
    assert [r["status"] for r in meetings.readiness({"feed": (True, "ok"), "db": (False, "no file")})] == ["missing", "ready"]


def test_csv_numbers_as_sql_writes_them(spark):
    import duckdb

    numbers = [8e-4, 1e-4, 1.2345678901234567e-4, 5e-5, 1.5e-7, 0.0, -0.0006, 0.25, 300.0, 9999999.5, 1e7, 12345678.25, 1e15, 1.5e16, 1e100, float("nan"), float("-inf"), None]
    rows = spark.createDataFrame([("t", f"{i:02d}", x) for i, x in enumerate(numbers)], "transcript_id string, speaker_id string, talk_ratio double")
    got = [line.split(",")[2] for line in export.csv_text(rows).first()["document"].split("\r\n")[1:]]
    assert got == [duckdb.execute("SELECT coalesce(CAST(?::DOUBLE AS VARCHAR), '')", [x]).fetchone()[0] for x in numbers]


def test_ties_are_rounded_as_sql_rounds_them(spark):
    import duckdb
    from speechlake.catalog import near

    ties = [0.14125, 0.37675, *((2 * i + 1) / 20000 for i in range(10000)), 0.25, 0.0, 1e300, float("nan"), float("inf"), None]
    d = spark.createDataFrame([(i, x, x) for i, x in enumerate(ties)], "i long, a double, b double")
    got = near(near(d, "a", n=4), "b", n=2).orderBy("i").toArrow()
    assert got.select(["a", "b"]).to_pylist()[:2] == [{"a": 0.1412, "b": 0.14}, {"a": 0.3767, "b": 0.38}]
    want = duckdb.execute("SELECT round(x, 4) AS a, round(x, 2) AS b FROM (SELECT unnest($x::DOUBLE[]) AS x)", {"x": ties}).to_arrow_table()
    assert repr(got.select(["a", "b"]).to_pylist()) == repr(want.to_pylist())
