import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from speechlake.llm import packing as G
from tokenizers import Tokenizer


def encode(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_ids_are_the_tokenizers(rows):
    rng, parts = random.Random(2), [" ", "  ", "a", "the", "\n", " x", "'s", "é", "中", "😀", "1", "!!", "\t", " ", " ", "\x1c", "<|endoftext|>", "Q"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(2000)] + [t for _, t, *_ in rows if t is not None]
    ids = G.IdBytes("byte_bpe_50k.json")
    for t, e in zip(texts, encode(texts)):
        assert np.frombuffer(ids.of(t), "<u4").tolist() == e


def valid(placed, capacity):
    by = {}
    for s, o, n in placed:
        by.setdefault(s, []).append((o, n))
    for pieces in by.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def test_query(spark, sf, rows):
    out = G.op7_linear_grouping_packs(spark, sf).collect()
    ids = {i: e + [2] for (i, *_), e in zip(rows, encode([t or "" for _, t, *_ in rows]))}
    seen = {i: 0 for i in ids}
    for r in sorted(out, key=lambda r: (r["doc_id"], r["piece"])):
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == seen[r["doc_id"]] and len(part) == r["length"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        assert r["piece"] == 0 or r["length"] == 1024
        seen[r["doc_id"]] += r["length"]
    assert seen == {i: len(e) for i, e in ids.items()}
    n = valid([(r["sequence_id"], r["offset"], r["length"]) for r in out], 1024)
    assert n <= -(-sum(map(len, ids.values())) // 1024) + 8


def test_plans_are_near_the_bound():
    rng = np.random.default_rng(5)
    for shape in ("uniform", "large", "small", "one"):
        x = {"uniform": rng.integers(1, 1024, 20000), "large": rng.integers(300, 700, 20000), "small": rng.integers(1, 90, 20000), "one": np.full(1000, 400)}[shape]
        counts = np.bincount(x, minlength=1025)
        p = G.best_plan(counts, 1024, (24, 96), (4, 8))
        runs = [r for rs in p.by_room.values() for r in rs]
        ranks = {}
        for n, room, slots in runs:
            assert room == 1024 - sum(ln for ln, _ in slots) >= 0
            for ln, first in slots:
                ranks.setdefault(ln, []).extend(range(first, first + n))
        assert all(sorted(ranks[ln]) == list(range(counts[ln])) for ln in range(1, 1024) if counts[ln])
        used, bound = sum(r[0] for r in runs), x.sum() / 1024
        limit = {"uniform": 1.02, "small": 1.002, "large": 1.12, "one": 1.3}[shape]
        assert used <= limit * bound + 1
        assert len(runs) < 6000


def test_awkward_empty_and_clashing(awkward, nothing):
    out = G.pack_documents(awkward.withColumn("offset", F.lit("x")).withColumn("length", F.lit(1.0)), keep_ids=True).collect()
    assert len(out) == awkward.count() and valid([(r["sequence_id"], r["offset"], r["length"]) for r in out], 1024)
    assert all(np.frombuffer(r["ids"], "<u4")[-1] == 2 for r in out)
    assert G.pack_documents(nothing).count() == 0
