import json
from dataclasses import replace

import pytest
from speechlake import schemas
from speechlake.config import Config, resolved
from speechlake.plans.finalize import finalize

#: Three people about a bridge; the second is cut short by the third, who never stops to breathe.
SAID = [
    ("north", 0, 2500, "good morning please find a seat by the stove"),
    ("east", 2900, 6100, "like the bridge is closed because ice and snow caused trouble"),
    ("north", 6000, 8200, "perhaps we wait"),
    ("south", 7400, 12000, "no we must drive around the lake without stopping"),
]
BREATHS = [("no", 7400, 7600, 0.5), ("we", 8000, 8100, 0.9), ("must", 8500, 8700, None)]
RAW = {
    "transcript_id": "bridge", "duration_ms": 12000, "language": "en", "engine": "hand-made", "model_versions": {"embedding": "m"},
    "speakers": [{"speaker_id": n, "embedding": v} for n, v in (("north", [0.0, 0.0, 1.0]), ("east", [0.6, 0.8, 0.0]), ("south", [1.0, 0.0, 0.0]))],
    "segments": [
        {"segment_id": f"said-{i}", "speaker_id": who, "start_ms": a, "end_ms": b, "text": text, "words": [{"text": w, "start_ms": x, "end_ms": y, "confidence": c} for w, x, y, c in BREATHS] if who == "south" else []}
        for i, (who, a, b, text) in enumerate(SAID)
    ],
}


def test_the_whole_chain(spark, tmp_path):
    (tmp_path / "raw.json").write_text(json.dumps(RAW) + "\n" + json.dumps({**RAW, "transcript_id": "silence", "speakers": [], "segments": []}))
    raw = spark.read.schema(schemas.RAW_TRANSCRIPT).json(str(tmp_path / "raw.json"))
    titles = spark.createDataFrame([("bridge", "Monday stand-up of the road crew"), ("silence", None)], "transcript_id string, title string")
    prints = spark.createDataFrame([("P7", "m", "Nora", "active", [0.0, 0.1, 1.0], 4), ("P8", "m", None, "active", [0.9, -0.3, 0.0], 2)], "fingerprint_id string, model string, display_name string, status string, embedding array<double>, sample_count int")
    out = finalize(raw, titles, prints, Config(min_talk_seconds=0))
    m = {r["speaker_id"]: r for r in out.metrics.collect()}
    assert (m["south"]["interruptions_made"], m["north"]["interruptions_received"], m["east"]["interruptions_received"]) == (1, 1, 0)
    assert (m["south"]["pause_count"], m["south"]["avg_pause_ms"], m["north"]["talk_time_ms"], m["east"]["filler_count"]) == (2, 400.0, 4700, 1)
    by = {r["segment_id"]: r for r in out.segments.collect()}
    assert len(by) == 4 and by["said-3"]["overlap_with_prev_ms"] == 800 and by["said-3"]["asr_confidence"] == pytest.approx(0.7)
    assert (by["said-2"]["overlap_with_prev_ms"], by["said-2"]["is_interruption"], by["said-1"]["gap_before_ms"]) == (100, False, 400)
    assert by["said-1"]["fillers"] == ["like"] and (by["said-1"]["linguistic"]["causation"], by["said-1"]["linguistic"]["inclusive"], by["said-2"]["linguistic"]["tentative"]) == (2, 1, 1)
    who = {r["speaker_id"]: r for r in out.speakers.collect()}
    assert {n: r["kind"] for n, r in who.items()} == {"north": "strong", "east": "no_enroll", "south": "strong"}
    assert (who["north"]["display_name"], who["south"]["matched_id"]) == ("Nora", "P8")
    t = {r["transcript_id"]: r for r in out.transcripts.collect()}
    assert t["bridge"]["meeting_type"] == "huddle" and t["bridge"]["confidence"] == pytest.approx(0.9) and t["silence"]["meeting_type"] == "unknown"
    assert [t[i]["diarization_state"] for i in ("silence", "bridge")] == ["incomplete", "ok"] and len(t["bridge"]["content_text_simhash"]) == 16


def test_toggles_details_and_voices(spark, tmp_path):
    (tmp_path / "raw.json").write_text(json.dumps(RAW) + "\n" + json.dumps({**RAW, "transcript_id": "again"}))
    raw = spark.read.schema(schemas.RAW_TRANSCRIPT).json(str(tmp_path / "raw.json"))
    details = spark.createDataFrame([("bridge", "/a.wav", '{"clientName": 1, "kind": "x"}', "degraded", "panel", "f1"), ("again", None, None, None, None, "f2")], "transcript_id string, source_path string, source_metadata string, diarization_state string, meeting_type string, content_audio_fp string")
    voices = spark.createDataFrame([("bridge", "east", 120.0)], "transcript_id string, speaker_id string, f0_mean_hz double")
    off = Config(min_talk_seconds=0, enable_turn_taking=False, enable_fillers=False, enable_linguistic=False, enable_meeting_type=False)
    known = spark.createDataFrame([("old", "f2")], "transcript_id string, content_audio_fp string")
    out = finalize(raw, cfg=off, details=details, voices=voices, collapse=False, known=known)
    (t,) = out.transcripts.collect()
    assert (t["transcript_id"], t["diarization_state"], t["meeting_type"], t["confidence"], t["source_metadata"]) == ("bridge", "degraded", "panel", 1.0, '{"kind":"x"}')
    s = out.segments.collect()
    assert all(r["fillers"] == [] and r["linguistic"] is None and not r["is_interruption"] and r["overlap_with_prev_ms"] == 0 for r in s)
    m = {r["speaker_id"]: r for r in out.metrics.collect()}
    assert (m["east"]["filler_count"], m["south"]["interruptions_made"], m["east"]["f0_mean_hz"], m["north"]["f0_mean_hz"]) == (0, 0, 120.0, None)
    one = finalize(raw, cfg=replace(off, voice_metrics="required"), expected_speakers=1)
    assert one.metrics.where("transcript_id = 'bridge'").count() == 1


def test_settings_are_resolved_in_order():
    env = {"SPEECHLAKE_TURN_GAP_MS": "0", "SPEECHLAKE_MIN_TALK_SECONDS": "2.5", "SPEECHLAKE_ENABLE_FILLERS": "off", "SPEECHLAKE_OUTPUT_DETAIL": ""}
    cfg = resolved({"min_talk_seconds": 0, "min_gap_ms": None, "output_format": ""}, env)
    assert (cfg.turn_gap_ms, cfg.min_talk_seconds, cfg.enable_fillers, cfg.min_gap_ms, cfg.output_detail, cfg.output_format) == (0, 0.0, False, 250, "standard", "json")
    for bad in ({"no_such": 1}, {"turn_gap_ms": "x"}, {"enable_fillers": "maybe"}):
        with pytest.raises(ValueError):
            resolved(bad)
