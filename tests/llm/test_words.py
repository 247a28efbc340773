import random

import numpy as np
import pyarrow as pa
from speechlake.llm import words as V

TEXTS = ["", None, "  \t ", "one", " two words\n", "Ünï cödé no break wide", "x" * 300 + " " + "y" * 257, "a\x0bb\x0cc\rd", "tail", "Head", "\x1c \x85", "abcdefgh abcdefghi ABCDEFGH", "😀 中文 text"]


def expected(texts, lower):
    return [(t or "").encode().lower().split() if lower else (t or "").encode().split() for t in texts]


def test_words_are_those_of_the_texts():
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice("ab \t\nAé") for _ in range(rng.randint(0, 30))) for _ in range(400)]
    for lower in (False, True):
        for column in (pa.array(texts), pa.array(["skipped words", *texts]).slice(1), pa.chunked_array([texts[:200], texts[200:]]), pa.array([], pa.string())):
            w = V.Words(column, lower)
            own = column.to_pylist()
            assert w.lens.tolist() == list(map(len, expected(own, lower)))
            flat = [x for t in expected(own, lower) for x in t]
            assert [w.data[a:b].tobytes() for a, b in zip(w.start, w.end)] == flat
            assert len(set(zip(w.h.tolist(), flat))) == len(set(flat)) == len(set(w.h.tolist()))


def test_rolling_hash_depends_on_the_window_alone():
    h = np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64)
    twice = np.concatenate([h, h[:3], h])
    for base in V.BASES:
        for width in (1, 5, 13):
            r = V.rolling(twice, width, base)
            assert (r[: len(h) - width + 1] == r[len(h) + 3 :]).all() and len(set(r[: len(h) - width + 1].tolist())) == len(h) - width + 1
            assert (V.rolling(h[40:], width, base) == V.rolling(h, width, base)[40:]).all()
        assert len(V.rolling(h[:4], 5, base)) == 0


def test_order_is_stable_also_where_upper_bits_agree():
    rng = np.random.default_rng(2)
    for h in (rng.integers(0, 50, 3000).astype(np.uint64), rng.integers(0, 2**64, 3000, dtype=np.uint64), np.empty(0, np.uint64), np.array([7], np.uint64)):
        assert (V.order_of(h) == np.argsort(h, kind="stable")).all()
        d = V.Distinct(h)
        assert (d.keys == np.unique(h)).all() and (d.keys[d.place] == h).all() and d.sums(np.ones(len(h), np.int64)).sum() == len(h)


def test_chunks_are_bounded_whole_and_do_not_depend_on_batches(monkeypatch):
    class Context:
        def partitionId(self):  # noqa: N802
            return 3

    monkeypatch.setattr(V.TaskContext, "get", staticmethod(Context))
    monkeypatch.setattr(V, "CHUNK_BYTES", 100)
    monkeypatch.setattr(V, "CHUNK_WORDS", 20)
    rng = random.Random(5)
    texts = [None if rng.random() < 0.1 else "".join(rng.choice("ab ") for _ in range(rng.choice([0, 5, 60, 250]))) for _ in range(200)]

    def cut(size):
        batches = [pa.record_batch([pa.array(range(i, min(200, i + size))), pa.array(texts[i : i + size], pa.string())], names=["i", "text"]) for i in range(0, 200, size)]
        return [(n, r.column(0).to_pylist(), w.lens.tolist()) for n, r, w in V.chunks(batches, 1)]

    one = cut(200)
    assert cut(1) == one == cut(7) and [i for _, rows, _ in one for i in rows] == list(range(200)) and len({n for n, *_ in one}) == len(one)
    assert all(len(rows) == 1 or (sum(len(texts[i] or "") for i in rows) <= 100 and sum(lens) <= 20) for _, rows, lens in one)
    whole = pa.record_batch([pa.array(texts, pa.string())], names=["text"])
    parts = list(V.sliced(whole, 0))
    assert pa.Table.from_batches(parts).column(0).to_pylist() == texts and all(p.num_rows == 1 or sum(len(t or "") for t in p.column(0).to_pylist()) <= 100 for p in parts)
    assert V.rows_of(V.block(whole)).equals(whole)
