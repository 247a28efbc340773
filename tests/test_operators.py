"""Small literal cases of the transcript operators, and random ones against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from speechlake.config import Config
from speechlake.operators import identity, metrics, ranges, segments, vectors

DDL = "transcript_id string, seq long, segment_id string, speaker_id string, start_ms long, end_ms long, text string, diarization_quality double"


def frame(spark, rows):
    """rows: (speaker, start, end[, text[, quality]]) of one transcript, or of several keyed by a first str with ':'."""
    full = []
    for i, r in enumerate(rows):
        spk, s, e, text, q = (*r, *("", None)[len(r) - 3 :])
        full.append(("t", i, f"s{i}", spk, s, e, text, q))
    return spark.createDataFrame(full, DDL)


def test_talk_time_is_the_union(spark):
    s = frame(spark, [("A", 0, 1000), ("A", 500, 1500), ("A", 1500, 1700), ("A", 3000, 3200)])
    assert metrics.talk_time(s).first()["talk_time_ms"] == 1900


def test_interruptions(spark):
    quick = segments.with_turn_taking(frame(spark, [("A", 0, 1000), ("B", 1100, 1800)])).orderBy("seq").collect()[1]
    assert (quick["gap_before_ms"], quick["is_interruption"]) == (100, True)
    short = segments.with_turn_taking(frame(spark, [("A", 0, 1000), ("B", 1100, 1650)])).orderBy("seq").collect()[1]
    assert not short["is_interruption"]
    over = segments.with_turn_taking(frame(spark, [("S1", 0, 1000), ("S2", 700, 2200)]))
    counts = {r["speaker_id"]: (r["interruptions_made"], r["interruptions_received"]) for r in segments.interruption_counts(over).collect()}
    assert counts == {"S1": (0, 1), "S2": (1, 0)}


def test_merge_text_and_quality(spark):
    one = segments.merge_turns(frame(spark, [("S1", 0, 1000, "low", 0.1), ("S1", 1000, 3000, "high", 0.9)]), Config(turn_gap_ms=0)).collect()
    assert len(one) == 1 and one[0]["text"] == "low high" and one[0]["diarization_quality"] == pytest.approx((100 + 1800) / 3000)
    hull = segments.merge_turns(frame(spark, [("S", 0, 1000, "a", 0.1), ("S", 1500, 2500, "b", 0.9), ("S", 3000, 4000, "c", 0.8)])).first()
    assert hull["diarization_quality"] == pytest.approx((0.5 * 2500 + 0.8 * 1000) / 3500)
    assert segments.merge_turns(frame(spark, [("S", 0, 1, "a", 0.8), ("S", 1, 2, "b", None)])).first()["diarization_quality"] is None


def merged(rows, gap):
    out = []
    for spk, s, e in rows:
        if out and out[-1][0] == spk and s - out[-1][2] <= gap:
            out[-1][2] = max(out[-1][2], e)
        else:
            out.append([spk, s, e])
    return [tuple(x) for x in out]


def test_merge_equals_the_rule_on_random_turns(spark):
    rng = random.Random(3)
    for _ in range(6):
        rows, t = [], 0
        for _ in range(80):
            t += rng.randint(-900, 1500)
            rows.append((rng.choice("AB"), t, t + rng.randint(0, 2000)))
        got = segments.merge_turns(frame(spark, rows)).orderBy("seq").collect()
        assert [(r["speaker_id"], r["start_ms"], r["end_ms"]) for r in got] == merged(rows, 800)


def test_sessions_cut_strictly_above_the_gap(spark):
    w = spark.createDataFrame([("t", 1, 0, 1000), ("t", 2, 2500, 2600), ("t", 3, 4101, 4200)], "transcript_id string, word_seq long, start_ms long, end_ms long")
    assert [r["session"] for r in segments.sessionise_words(w, ["transcript_id"]).orderBy("word_seq").collect()] == [1, 1, 2]


def test_words_meet_their_spans_as_by_brute_force(spark):
    rng = random.Random(5)
    spans = sorted((rng.uniform(0, 60), i) for i in range(25))
    spans = [(s, s + rng.choice([0.0, 0.7, 3.0, 14.0])) for s, _ in spans]
    words = [(x := rng.uniform(-5, 90), x + rng.uniform(0, 2)) for _ in range(400)]
    sp = spark.createDataFrame([("t", i, a, b) for i, (a, b) in enumerate(spans)], "transcript_id string, span_idx long, start_s double, end_s double")
    wd = spark.createDataFrame([("t", i, a, b) for i, (a, b) in enumerate(words)], "transcript_id string, word_id long, start_s double, end_s double")
    got = {r["word_id"]: (r["span_idx"], r["how"]) for r in ranges.words_to_spans(wd, sp).collect()}
    for i, (a, b) in enumerate(words):
        mid = (a + b) / 2
        held = [k for k, (s, e) in enumerate(spans) if s <= mid <= e]
        best = max(held, key=lambda k: min(spans[k][1], b) - max(spans[k][0], a)) if held else min(range(len(spans)), key=lambda k: min(abs(spans[k][0] - mid), abs(spans[k][1] - mid)))
        assert got[i] == (best, "owner" if held else "nearest")


def test_overlap_map(spark):
    ddl = "transcript_id string, span_idx long, label string, start_s double, end_s double"
    sort = spark.createDataFrame([("t", 0, "Speaker 0", 0.0, 3.0)], ddl)
    process = spark.createDataFrame([("t", 0, "S1", 0.0, 1.0), ("t", 1, "S2", 1.0, 3.0)], ddl)
    assert ranges.overlap_map(sort, process).first()["speaker"] == "S2"


def test_cosine_and_means(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.99, 0.01]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] > 0.99 and got[1:] == [0.0, 0.0, 0.0]
    m = spark.createDataFrame([("x", [1.0, 2.0, 9.0]), ("x", [3.0, 4.0])], "k string, embedding array<double>")
    assert [r["mean"] for r in vectors.vector_mean(m, ["k"]).orderBy("pos").collect()] == [2.0, 3.0]


PRINTS = "fingerprint_id string, model string, display_name string, status string, embedding array<double>, sample_count int"
SPEAKERS = "speaker_key long, model string, fingerprint_id string, display_name string, embedding array<double>, duration_ms long"


def test_match_kinds(spark):
    prints = spark.createDataFrame([("P1", "m", "Alex", "active", [1.0, 0.0, 0.0], 1), ("P2", "m", None, "active", [0.0, 1.0, 0.0], 1), ("P3", "m", None, "discarded", [0.0, 0.0, 1.0], 1)], PRINTS)
    speakers = spark.createDataFrame(
        [(1, "m", "given", None, [1.0, 0.0, 0.0], None), (2, "m", None, " alex ", None, None), (3, "m", None, None, None, None), (4, "m", None, None, [0.99, 0.01, 0.0], 30000), (5, "m", None, None, [0.70, 0.0, 0.714], 30000), (6, "m", None, None, [-1.0, 0.0, 0.0], 2000), (7, "m", None, None, [0.0, 0.0, 1.0], 20000), (8, "n", None, None, [1.0, 0.0, 0.0], 1000)],
        SPEAKERS,
    )
    got = {r["speaker_key"]: r for r in identity.match_kinds(speakers, prints).collect()}
    assert [got[i]["kind"] for i in range(1, 9)] == ["preassigned", "name_match", "no_embedding", "strong", "margin", "no_enroll", "new", "no_enroll"]
    assert got[5]["margin"] >= 0.15 and not got[5]["folds"] and got[4]["folds"] and got[2]["matched_id"] == "P1"
    assert got[8]["similarity"] is None


def test_assignment_in_order(spark):
    ddl = "model string, transcript_id string, ord int, speaker_key long, embedding array<double>, duration_ms long"
    s = spark.createDataFrame([("m", "a", 0, 1, [1.0, 0.0], 16000), ("m", "b", 0, 2, [0.99, 0.01], 16000), ("n", "a", 0, 3, [1.0, 0.0], 16000)], ddl)
    got = {r["speaker_key"]: r for r in identity.assign_in_order(s, spark.createDataFrame([], PRINTS)).collect()}
    assert got[1]["kind"] == "new" and got[2]["kind"] == "strong" and got[2]["matched_id"] == got[1]["matched_id"] and got[2]["second_similarity"] is None
    assert got[3]["kind"] == "new" and got[3]["matched_id"] != got[1]["matched_id"] and got[1]["matched_id"].startswith("VP-")


def test_collapse():
    two = [{"speaker_id": "S1", "embedding": [1.0, 0.0]}, {"speaker_id": "S2", "embedding": [0.99, 0.01]}, {"speaker_id": "S3", "embedding": [0.0, 1.0]}]
    assert identity.collapse(two, {"S1": 2.0, "S2": 1.9, "S3": 5.0}) == {"S1": "S1", "S2": "S1", "S3": "S3"}
    assert identity.collapse(two, {"S1": 2.0, "S2": 1.9, "S3": 1.0})["S3"] == "S1"
    assert identity.collapse(two, {"S1": 2.0, "S3": 9.0, "ghost": 1.0})["ghost"] == "S3"
    assert set(identity.collapse(two, {"S1": 2.0, "S3": 9.0}, target=1).values()) == {"S3"}


def test_two_best_of_blocks():
    rng = np.random.default_rng(3)
    sims = np.round(rng.normal(size=(40, 60)), 1) + rng.normal(size=(40, 60)) * 1e-14  # many are equal to 12 digits
    sims[:, 7] = np.nan
    ids = np.array([f"P{i:03d}" for i in rng.permutation(60)], object)
    best = vectors._TwoBest(40)
    for part in np.array_split(np.arange(60), 7):
        part = part[np.argsort(ids[part])]
        best.add(sims[:, part], ids[part])
    for row, got in zip(sims, best.id, strict=True):
        assert list(got) == [i for _, i in sorted((-round(x, 12), i) for x, i in zip(row, ids, strict=True) if x == x)[:2]]


def test_equal_to_12_digits_goes_by_id(spark):
    """Three prints whose similarities differ by less than is told apart: the smaller ids are the two best."""
    prints = [("A", "m", [1.0, 1e-7]), ("B", "m", [1.0, 5e-8]), ("C", "m", [1.0, 0.0])]
    got = vectors.nearest_two(spark.createDataFrame([(1, "m", [1.0, 0.0])], "k long, model string, embedding array<double>"), spark.createDataFrame(prints, "i string, model string, embedding array<double>"), "k", "i", "model").first()
    assert (got["best_id"], got["second_id"]) == ("A", "B")


def test_a_lot_holds_several_blocks():
    assert [vectors.lots_of(n, 1024) for n in (0, 8192, 8193, 10**9)] == [1, 1, 2, vectors.MOST_LOTS] and vectors.MOST_LOTS <= 64
