import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F
from speechlake import export, schemas, store
from speechlake.plans import fingerprints as plans
from speechlake.sources import readers

LIB = "fingerprint_id string, embedding array<float>, display_name string, sample_count int, embedding_model string, embedding_dimension int, status string, discard_reason string, created_at string"


@pytest.fixture(scope="module")
def library(spark):
    return spark.createDataFrame(
        [("A", [1.0, 0.0], None, 1, "m", 2, "active", None, "old"), ("B", [0.0, 1.0], "Bea", 3, "m", 2, "active", None, "old"), ("C", [1.0, 1.0], None, 1, None, None, "active", None, "old"), ("D", [1.0], "Dan", 1, "m", 1, "discarded", "noise", "old")],
        LIB,
    ).coalesce(1)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_versions_and_upsert(spark, tmp_path):
    t = store.Table(spark, str(tmp_path / "t"))
    with pytest.raises(ValueError):
        t.read()
    old = spark.createDataFrame([("a", 1, "raw"), ("b", 2, None)], "transcript_id string, n int, raw string")
    t.write(old)
    new = spark.createDataFrame([("a", 9, None), ("c", 3, "x")], old.schema)
    t.write(store.upsert(t.read(), new, ["transcript_id"], keep=["raw"]))
    assert rows(t.read(), "transcript_id", "n", "raw") == [("a", 9, "raw"), ("b", 2, None), ("c", 3, "x")]
    assert rows(store.delete({"t": t.read()}, new)["t"], "transcript_id") == [("b",)]
    assert rows(store.new_only(new, old), "transcript_id") == [("c",)]
    assert store.upgrade(old, "transcript_id string, added double").columns == ["transcript_id", "added"]


def test_plans(spark, library):
    incoming = library.where("fingerprint_id = 'A'").withColumn("display_name", F.lit("New")).withColumn("created_at", F.lit(None).cast("string"))
    assert rows(plans.import_plan(incoming, library), "action") == [("skip",)]
    applied = plans.apply_import(library, incoming, plans.import_plan(incoming, library, True))
    assert ("A", "New", "old") in rows(applied, "fingerprint_id", "display_name", "created_at") and applied.count() == 4
    assert rows(plans.adopt_plan(library), "fingerprint_id") == [("C",)]
    adopted = plans.apply_adopt(library, plans.adopt_plan(library), "m2")
    assert ("C", "m2", 2) in [(r["fingerprint_id"], r["embedding_model"], r["embedding_dimension"]) for r in adopted.collect()]
    bad = incoming.withColumn("embedding", F.array(F.lit(float("nan")).cast("float")))
    assert rows(plans.invalid_rows(bad), "problem") == [("embedding not finite",)] and plans.invalid_rows(incoming).count() == 0


def test_actions_and_merge(spark, library):
    speakers = spark.createDataFrame([("t", "S1", "A", "x"), ("t", "S2", "B", "y")], "transcript_id string, speaker_id string, fingerprint_id string, display_name string")
    plan = plans.action_plan(library, speakers, "discard", "noise")
    assert rows(plan, "fingerprint_id", "will_write", "speaker_rows") == [("A", True, 1), ("B", True, 1), ("C", True, 0), ("D", False, 0)]
    assert rows(plans.apply_action(library, plans.action_plan(library, speakers, "restore"), "restore"), "status") == [("active",)] * 4
    assert plans.apply_action(library, plan, "destroy").count() == 0
    with pytest.raises(ValueError):
        plans.action_plan(library, speakers, "discard", " ")
    pairs = spark.createDataFrame([("A", "B"), ("A", "C"), ("D", "B")], "source string, target string")
    m = plans.merge_plan(library, pairs)
    assert [(r["source"], r["target"], r["sample_count"], r["display_name"], list(r["embedding"])) for r in m.collect()] == [("A", "B", 4, "Bea", [0.25, 0.75])]
    lib, spk = plans.apply_merge(library, speakers, m)
    assert rows(lib, "fingerprint_id") == [("B",), ("C",), ("D",)] and rows(spk, "speaker_id", "fingerprint_id", "display_name") == [("S1", "B", "Bea"), ("S2", "B", "Bea")]


def test_message(spark):
    t = spark.createDataFrame([("ready-1", None)], "transcript_id string, recorded_at string").withColumn("p", export.payload("lake:s"))
    r = t.withColumn("sig", export.signature(F.col("p"), "key")).first()
    assert list(json.loads(r["p"])) == ["event", "transcript_id", "source", "recorded_at", "store_ref"]
    assert r["sig"] == "sha256=" + hmac.new(b"key", r["p"].encode(), hashlib.sha256).hexdigest()
    gate = lambda **k: export.emit_reason(*[F.lit(v) for v in ({"e": True, "u": "u", "s": "s", "n": 1, "d": False, "st": "ok"} | k).values()])
    got = spark.range(1).select(gate(e=False), gate(u=""), gate(s=None), gate(n=0), gate(st="failed"), gate(st="failed", d=True), gate()).first()
    assert list(got) == ["disabled", "missing-url", "missing-secret", "no-segments", "diarization-failed", "ok", "ok"]


def test_documents_by_detail(spark):
    t = spark.createDataFrame([("t", 5)], "transcript_id string, duration_ms long")
    s = spark.createDataFrame([("t", 0, "hi")], "transcript_id string, seq long, text string")
    m = spark.createDataFrame([("t", "S1", 1, 2.0)], "transcript_id string, speaker_id string, talk_time_ms long, f0_mean_hz double")
    doc = lambda d: json.loads(export.documents(t, s, m, d).first()["document"])
    assert "f0_mean_hz" in doc("full")["speaker_metrics"][0] and "f0_mean_hz" not in doc("standard")["speaker_metrics"][0] and "speaker_metrics" not in doc("minimal")
    with pytest.raises(ValueError):
        export.documents(t, s, m, "most")


def test_sources(spark, tmp_path):
    raw = {"transcript_id": "t", "duration_ms": 5, "language": "en", "engine": "e", "speakers": [{"speaker_id": "S1"}], "segments": [{"segment_id": "a", "speaker_id": "S1", "start_ms": 0, "end_ms": 5, "text": "hi", "words": []}]}
    (tmp_path / "r.json").write_text(json.dumps(raw))
    df = readers.raw_transcripts(spark, str(tmp_path / "r.json"))
    assert rows(readers.raw_segments(df), "seq", "text") == [(0, "hi")] and rows(readers.raw_speakers(df), "speaker_id") == [("S1",)]
    item = lambda t, k: f"<item><title>{t}</title><guid>g</guid><pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate><enclosure url='u{t}' type='{k}'/></item>"
    feed = spark.createDataFrame([("f", "<rss><channel>" + item("1", "video/mp4") + item("2", "audio/mpeg") + "</channel></rss>")], "feed string, xml string")
    assert rows(readers.episodes(spark, feed), "idx", "url") == [(1, "u2")]
    got = readers.episodes(spark, feed).select(readers.iso_or_text(F.col("pub_date")), readers.iso_or_text(F.lit("soon"))).first()
    assert tuple(got) == ("2024-01-01T10:00:00Z", "soon")
    p = spark.createDataFrame([("c", 1, "p1"), ("c", 2, "p2")], "conference string, ord int, ref string")
    e = spark.createDataFrame([("c", 0, "p2"), ("c", 1, "x"), ("c", 2, ""), ("c", 3, "x"), ("c", 4, "")], "conference string, i int, ref string")
    assert [r["speaker_id"] for r in readers.entry_speakers(e, p).orderBy("i").collect()] == ["S2", "S_unk_0", "S_unk_1", "S_unk_0", "S_unk_2"]
    rec = spark.createDataFrame([("c", "ENDED", "f1", None, "2"), ("c", "STARTED", "f9", None, "9"), ("c", "FILE_GENERATED", "f2", "3", None)], "conference string, state string, file string, start_time string, end_time string")
    assert readers.best_recording(rec).first()["file"] == "f2"
    kinds = spark.range(1).select(*[readers.connector(F.lit(u)) for u in ("https://youtu.be/x", "https://a.b/feed.rss", "https://a.b/c")]).first()
    assert list(kinds) == ["youtube", "podcast", "web"]
    assert schemas.json_schema(schemas.RAW_TRANSCRIPT)["type"] == "struct"


def test_episodes_are_listed_and_chosen(spark):
    item = lambda t, k, d="": f"<item><title>{t}</title><enclosure url='u{k}' type='audio/mpeg'/>{d}</item>"
    feeds = [("a", "<rss><channel>" + item("One", 0, "<itunes:duration> 1:02:03 </itunes:duration>") + "<item><title>No sound</title></item>" + item(" ", 2) + item("Two ONES", 3) + "</channel></rss>"), ("b", "<rss/>")]
    found = readers.episodes(spark, spark.createDataFrame([(f, x.replace("<rss>", "<rss xmlns:itunes='i'>")) for f, x in feeds], "feed string, xml string"))
    assert rows(found, "idx", "title", "duration") == [(0, "One", "1:02:03"), (2, "Episode 3", None), (3, "Two ONES", None)]
    assert rows(readers.listed_episodes(found, 2), "place", "url") == [(0, "u0"), (1, "u2")]
    wishes = spark.createDataFrame([("a", 1, None, None), ("a", 2, 2, ""), ("a", 3, 3, None), ("a", 4, 0, "oNeS"), ("a", 5, None, "zzz"), ("b", 1, None, None), ("a", 6, -1, None)], "feed string, wish int, episode int, title_contains string")
    got = {(r["feed"], r["wish"]): (r["url"], r["problem"]) for r in readers.chosen_episodes(found, wishes).collect()}
    assert got == {("a", 1): ("u0", None), ("a", 2): ("u3", None), ("a", 3): (None, "place out of range"), ("a", 4): ("u3", None), ("a", 5): (None, "no title contains it"), ("b", 1): (None, "no audio in the feed"), ("a", 6): (None, "place out of range")}
