"""Assignment in rounds against one pass in order."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from speechlake import catalog
from speechlake import testdata as td
from speechlake.operators import identity, sequence

OBS = "speaker_key long, model string, transcript_id string, ord int, embedding array<double>, duration_ms long"
LIB = "fingerprint_id string, model string, status string, embedding array<double>, sample_count int"


def crowd(seed, people=8, transcripts=30, dim=6, noise=0.35):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(people, dim))
    obs, key = [], 0
    for t in range(transcripts):
        for o in range(int(rng.integers(1, 5))):
            v = centres[rng.integers(people)] + rng.normal(size=dim) * noise * rng.choice([0.2, 1, 2])
            v = list(map(float, rng.choice([0, 1], p=[0.03, 0.97]) * v)) if rng.random() > 0.03 else [1.0, 2.0]
            obs.append((key, str(rng.choice(["m0", "m1"])) if key % 9 else None, f"t{t:03d}", o, None if rng.random() < 0.05 else v, [None, 500, 5000, 60000][rng.integers(4)]))
            key += 1
    lib = [(f"P{i}", ["m0", "m1", None][i % 3], "active" if i % 5 else "discarded", list(map(float, centres[i % people] + rng.normal(size=dim) * 0.3)), int(i % 4 + 1)) for i in range(9)]
    return obs, lib


def rows(df):
    return sorted((r["speaker_key"], r["kind"], r["matched_id"], r["similarity"], r["second_similarity"]) for r in df.collect())


@pytest.mark.parametrize("seed,noise", [(1, 0.35), (2, 0.15), (3, 0.6)])
def test_equal_to_one_pass(spark, seed, noise):
    obs, lib = crowd(seed, noise=noise)
    o, p = spark.createDataFrame(obs, OBS).repartition(5), spark.createDataFrame(lib, LIB)
    got, want = rows(sequence.assign_by_rounds(o, p)), rows(identity.assign_in_order(o, p))
    assert got == want and len(got) > 50 and {"new", "strong"} <= {r[1] for r in got}


def test_blocks_and_lots_give_the_same(spark, monkeypatch):
    obs, lib = crowd(4)
    o, p = spark.createDataFrame(obs, OBS).repartition(3), spark.createDataFrame(lib, LIB)
    want = rows(identity.assign_in_order(o, p))
    monkeypatch.setattr(sequence, "BLOCK", 7)
    monkeypatch.setattr(sequence, "BROADCAST_BYTES", 0)
    assert rows(sequence.assign_by_rounds(o, p)) == want


def test_a_print_takes_nearly_all_samples(spark):
    rng = np.random.default_rng(5)
    obs = [(i, "m0", f"t{i // 3:03d}", i % 3, list(map(float, np.array([1.0, 0.2, 0.1]) + rng.normal(size=3) * 0.1)), 60000) for i in range(90)]
    o, p = spark.createDataFrame(obs, OBS), spark.createDataFrame([], LIB)
    got = rows(sequence.assign_by_rounds(o, p))
    assert got == rows(identity.assign_in_order(o, p)) and [r[1] for r in got].count("new") == 1


def test_an_id_that_is_taken(spark):
    v = [0.5, 0.25, 1.0]
    taken = identity.print_id(v, "m0")
    obs = [(1, "m0", "t1", 0, v, 60000), (2, "m0", "t2", 0, [0.0] * 3, 60000), (3, "m0", "t2", 1, [0.0] * 3, 60000), (4, "m0", "t3", 0, [0.0] * 3, None)]
    lib = [(taken, "m0", "active", [-1.0, 0.0, 0.0], 5), (identity.print_id([0.0] * 3, "m0", 1), "m0", "active", [0.0, -1.0, 0.0], 2)]
    o, p = spark.createDataFrame(obs, OBS), spark.createDataFrame(lib, LIB)
    got = rows(sequence.assign_by_rounds(o, p))
    assert got == rows(identity.assign_in_order(o, p)) and got[0][2] == identity.print_id(v, "m0", 1) and len({r[2] for r in got}) == 4


def test_nothing(spark):
    obs, lib = crowd(6, transcripts=3)
    o, p = spark.createDataFrame(obs, OBS), spark.createDataFrame(lib, LIB)
    assert sequence.assign_by_rounds(o.limit(0), p).count() == 0 and rows(sequence.assign_by_rounds(o, p.limit(0))) == rows(identity.assign_in_order(o, p.limit(0)))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    o = td.observations(spark, sf).withColumn("transcript_id", F.floor(F.col("speaker_key") / 8)).withColumn("ord", F.col("speaker_key") % 8)
    assert rows(catalog.QUERIES["assign_sequential"](spark, sf)) == rows(identity.assign_in_order(o, td.prints(spark, sf)))


def test_a_block_meets_others_in_little_memory():
    """Two blocks as arrays take a few products' worth, and the two best over several blocks are those of all pairs."""
    import tracemalloc

    rng = np.random.default_rng(9)
    m, v = rng.normal(size=(1024, 64)), rng.normal(size=(2048, 64)).astype(np.float32).astype(float)
    v[5:9] = v[4]  # equal vectors: the smaller place
    m[:3], m[3] = v[4], 0
    place, start = rng.permutation(2048), rng.integers(-1, 900, 2048)
    end = start + rng.integers(0, 900, 2048)
    tracemalloc.start()
    block = sequence._Block(np.arange(1024), m)
    for k in (0, 1024):
        block.meet(place[k : k + 1024], start[k : k + 1024], end[k : k + 1024], v[k : k + 1024])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for i in [0, 1, 2, 3, 500, 1023]:
        pairs = [(-identity.Library._cosine(m[i], v[j]), int(place[j])) for j in range(2048) if start[j] < i <= end[j]]
        assert block.best[i] == sorted(pairs)[:2]
    assert peak < 60_000_000


def test_later_rounds_meet_what_came(spark, monkeypatch):
    """With few versions kept and small blocks the rows are the same, and only the first two rounds meet many versions."""
    obs, lib = crowd(7, transcripts=24)
    o, p = spark.createDataFrame(obs, OBS).repartition(3), spark.createDataFrame(lib, LIB)
    met, rounds, plain, judged = [], [], sequence._met, sequence._judged
    monkeypatch.setattr(sequence, "_met", lambda blocks, versions, total: met.append((len(rounds), versions.count())) or plain(blocks, versions, total))
    monkeypatch.setattr(sequence, "_judged", lambda *a: rounds.append(1) or judged(*a))
    monkeypatch.setattr(sequence, "BLOCK", 16)
    monkeypatch.setattr(sequence, "KEEP", 2)
    assert rows(sequence.assign_by_rounds(o, p)) == rows(identity.assign_in_order(o, p))
    usual = {r: [n for k, n in met if k == r][0] for r, _ in met}
    assert len(rounds) > 2 and usual[len(rounds) - 1] < max(usual.values()) and len(met) > len(rounds)


def test_copies_meet_in_few_comparisons(monkeypatch):
    """Of many equal vectors only those with the smallest places are compared exactly."""
    m = np.tile(np.random.default_rng(3).normal(size=32), (1024, 1))
    calls, exact = [], sequence._exact
    monkeypatch.setattr(sequence, "_exact", lambda a, b: calls.append(1) or exact(a, b))
    block = sequence._Block(np.arange(1024), m)
    place = np.random.default_rng(4).permutation(1024)
    block.meet(place, np.full(1024, -1), np.full(1024, 5000), m)
    assert all([x[1] for x in b] == [0, 1] for b in block.best) and len(calls) <= 8 * 1024
