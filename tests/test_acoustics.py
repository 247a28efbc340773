import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F
from speechlake.operators import acoustics, voice
from speechlake.sources import meetings

RATE = acoustics.RATE


def tone(hz, n=RATE, odd=0.0, loud=0.0):
    period, i = RATE / hz, np.arange(n)
    into = i - np.floor(i / (2 * period)) * 2 * period
    second = into >= period * (1 + odd)
    t = np.where(second, into - period * (1 + odd), into)
    return (np.where(second, 1 - loud, 1 + loud) * np.exp(-6 * t / period) * np.sin(t * 2 * np.pi * 900 / RATE) * 0.5).astype(np.float32)


@pytest.mark.parametrize("hz", [80, 100, 137, 220, 300, 450])
def test_pitch_of_tones(hz):
    f0 = acoustics.pitch(tone(hz), RATE)
    assert len(f0) == 97 and (abs(f0 - hz) < 0.1).all()


def test_what_has_no_pitch():
    rng = np.random.default_rng(2)
    assert not acoustics.pitch((rng.normal(size=RATE) * 0.1).astype(np.float32), RATE).any() and not acoustics.pitch(np.zeros(RATE, np.float32), RATE).any()
    assert len(acoustics.pitch(tone(100, 300), RATE)) == 0 and acoustics.marks(tone(100, 300), RATE, np.empty(0)) == ([], [])
    both = np.concatenate([tone(120, 8000), np.zeros(8000, np.float32), tone(200, 8000)])
    f0 = acoustics.pitch(both, RATE)
    assert abs(f0[:40] - 120).max() < 1 and not f0[58:90].any() and abs(f0[105:-3] - 200).max() < 1
    periods, _ = acoustics.marks(both, RATE, f0)
    assert periods.count(None) == 2 and abs(np.array([p for p in periods if p and p < 0.007]) - 1 / 200).max() < 1e-4


def test_a_path_does_not_leap_an_octave_for_one_frame():
    x = tone(150, RATE)
    x[8000:8160] *= -0.3
    f0 = acoustics.pitch(x, RATE)
    assert abs(f0[f0 > 0] - 150).max() < 8


def test_level():
    x = (0.1 * np.sin(np.arange(RATE) * 2 * np.pi * 200 / RATE)).astype(np.float32)
    assert abs(acoustics.intensity(x, RATE) - 10 * np.log10(0.005 / 4e-10)).max() < 0.1
    assert len(acoustics.intensity(x[:500], RATE)) == 0 and acoustics.intensity(np.zeros(RATE, np.float32), RATE).max() < 0


def metrics(spark, x, rate=RATE):
    df = spark.createDataFrame([("t", "S", rate, [float(v) for v in x] if x is not None else None)], "transcript_id string, speaker_id string, rate int, samples array<float>")
    return voice.voice_metrics(acoustics.analysed(df)).first()


def test_jitter_and_shimmer(spark):
    got = metrics(spark, tone(110, odd=0.01))
    assert got["f0_mean_hz"] == pytest.approx(110, abs=0.2) and got["jitter_local"] == pytest.approx(0.02, abs=0.001) and got["shimmer_local"] < 0.005
    got = metrics(spark, tone(120, loud=0.05))
    assert got["jitter_local"] < 0.001 and got["shimmer_local"] == pytest.approx(0.1, abs=0.003) and got["voiced_duration_s"] == pytest.approx(0.97)


def test_syllables_of_a_sound(spark):
    swell = (0.5 + 0.5 * np.sin(np.arange(2 * RATE) * 2 * np.pi * 4 / RATE - np.pi / 2)) * 0.98 + 0.02
    got = metrics(spark, tone(130, 2 * RATE) * swell.astype(np.float32))
    assert got["articulation_rate"] * got["voiced_duration_s"] == pytest.approx(8, abs=1)


def test_odd_recordings(spark):
    for x in (None, [], [0.0] * 10, [float("nan")] * RATE):
        got = metrics(spark, x)
        assert (got["f0_mean_hz"], got["articulation_rate"], got["jitter_local"], got["shimmer_local"]) == (0.0, 0.0, 0.0, 0.0)
    assert metrics(spark, np.interp(np.arange(0, RATE, 2), np.arange(RATE), tone(140)), RATE // 2)["f0_mean_hz"] == pytest.approx(140, abs=0.5)


def test_pairs_across_gaps_and_leaps_do_not_count(spark):
    df = spark.createDataFrame([([0.01, 0.011, None, 0.02, 0.02, 0.05],), ([None],), ([],)], "p array<double>")
    got = [r[0] for r in df.select(voice.perturbation(F.col("p"), 1.3)).collect()]
    assert got[0] == pytest.approx((0.001 + 0) / 2 / ((0.0105 + 0.02) / 2)) and got[1:] == [0.0, 0.0]


def test_speakers_end_to_end(spark):
    x = np.concatenate([tone(100, RATE), tone(200, RATE)])
    audio = spark.createDataFrame([("t", RATE, [float(v) for v in x])], "transcript_id string, rate int, samples array<float>")
    spans = spark.createDataFrame([("t", "A", 0, 500), ("t", "B", 1000, 1400), ("t", "A", 500, 1000), ("t", "B", 1400, 2000), ("t", "C", 0, 300), ("t", "B", 1900, 9000)], "transcript_id string, speaker_id string, start_ms long, end_ms long")
    got = {r["speaker_id"]: r for r in acoustics.voices(spans, audio).collect()}
    assert set(got) == {"A", "B"} and got["A"]["f0_mean_hz"] == pytest.approx(100, abs=0.2) and got["B"]["f0_mean_hz"] == pytest.approx(200, abs=0.4)
    talk = spark.createDataFrame([("t", s, 1) for s in "ABC"], "transcript_id string, speaker_id string, talk_time_ms int")
    joined = {r["speaker_id"]: r["f0_mean_hz"] for r in voice.attach(talk, acoustics.voices(spans, audio)).collect()}
    assert joined["C"] is None and joined["A"] == pytest.approx(100, abs=0.2)


@pytest.mark.parametrize("size", [1, 2, 3, 4])
def test_wav_of_every_width(spark, size):
    x = tone(100, 800)
    ints = np.round(np.clip(x, -1, 1) * (2 ** (8 * size - 1) - 1)).astype(np.int64)
    data = (ints + 128).astype(np.uint8).tobytes() if size == 1 else ints.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :size].tobytes()
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(size), w.setframerate(RATE), w.writeframes(data)
    df = spark.createDataFrame([(bytearray(out.getvalue()),), (bytearray(b"RIFF"),), (None,)], "content binary").coalesce(1)
    got = [r[0] for r in df.select(meetings.wav_samples("content")).collect()]
    assert abs(np.array(got[0]) - x).max() < 2.0 ** (2 - 8 * size) + 1e-6 and got[1:] == [None, None]
