import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from speechlake.llm import sampling as M


@pytest.fixture(scope="module")
def lattices():
    return M.Lattices(public_tokenizers.path("piece_bpe_32k.model"))


def every(l, unit):
    """All segmentations of a unit with their weights."""
    if not unit:
        return {(): 1.0}
    out = {}
    for j in range(1, len(unit) + 1):
        p = l.pieces.get(unit[:j])
        if p is None and j == 1:
            raw = unit[0].encode()
            p = (tuple(l.bytes[b] for b in raw), l.byte_weight * len(raw))
        elif p is not None:
            p = ((p[0],), p[1])
        if p:
            for ids, w in every(l, unit[j:]).items():
                out[p[0] + ids] = out.get(p[0] + ids, 0) + np.exp(p[1]) * w
    return out


def test_log_probabilities_are_exact(lattices):
    found = [[(tuple(r[0].tolist()), *r[1:]) for r in x] for x in M.sample(lattices, [1, 2], ["hello wörld", "the cat"], 4)]
    for text, rows in zip(["hello wörld", "the cat"], found):
        units = [every(lattices, u) for u in lattices.units_of(lattices.normal(text))]
        both = {a + b: x * y for a, x in units[0].items() for b, y in units[1].items()}
        total = sum(both.values())
        assert len({r[0] for r in rows}) == 4
        assert all(r[1] == pytest.approx(np.log(both[r[0]] / total), abs=1e-9) for r in rows)
        assert [r[2] for r in rows] == sorted((r[2] for r in rows), reverse=True)


def test_first_and_second_follow_the_law(lattices):
    """Sampling without replacement: p(a) for the first, p(b) / (1 - p(a)) for the second."""
    whole = every(lattices, lattices.units_of(lattices.normal("cats"))[0])
    total, n = sum(whole.values()), 20000
    p = {k: v / total for k, v in whole.items()}
    rows = [[(tuple(r[0].tolist()), *r[1:]) for r in x] for x in M.sample(lattices, list(range(n)), ["cats"] * n, 2)]
    one, two = (Counter(r[i][0] for r in rows) for i in (0, 1))
    second = {b: sum(p[a] * p[b] / (1 - p[a]) for a in p if a != b) for b in p}
    for law, seen in ((p, one), (second, two)):
        for k in p:
            assert abs(seen[k] / n - law[k]) < 5 * (law[k] * (1 - law[k]) / n) ** 0.5 + 1e-3
    estimate = np.mean([sum(np.exp(r[1]) / r[3] for r in x) for x in M.sample(lattices, list(range(3000)), ["cats"] * 3000, 3)])
    assert abs(estimate - 1) < 0.05


def test_few_segmentations_and_all_of_them(lattices):
    whole = every(lattices, "▁at")
    rows = M.sample(lattices, [5], ["at"], 50)[0]
    assert {tuple(r[0].tolist()) for r in rows} == set(whole) and all(r[3] == 1.0 for r in rows)
    assert [len(r[0]) for r in M.sample(lattices, [5], [""], 3)[0]] == [0]


def test_round_trip_and_digests(docs, rows, lattices):
    out = M.sampled_segmentations(docs, "doc_id", k=3, keep_ids=True).collect()
    text = {i: t or "" for i, t, *_ in rows}
    assert all(r["decoded"] and M.decode(lattices, r["ids"]) == text[r["doc_id"]] for r in out)
    assert all(r["n_pieces"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(r['ids'])}I", *r["ids"])) for r in out)
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(tuple(r["ids"]))
    assert set(by) == set(text) and all(len(set(v)) == len(v) for v in by.values())
    assert all(len(v) == 3 for i, v in by.items() if len(text[i].strip()) > 5)


def test_query_equals_brute_force(spark, sf, rows, lattices):
    """Ids, probabilities and order of every short text's samples against all its segmentations."""
    out = M.sampled_segmentations(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "doc_id", keep_ids=True).collect()
    query = {(r["doc_id"], r["sample"]): r for r in M.op9_gumbel_segmentations(spark, sf).collect()}
    assert len(query) == len(out) and all(query[r["doc_id"], r["sample"]]["ids_crc32"] == r["ids_crc32"] for r in out)
    text, seen = {i: t or "" for i, t, *_ in rows}, 0
    for i, t in text.items():
        mine = sorted((r for r in out if r["doc_id"] == i), key=lambda r: r["sample"])
        assert [r["perturbed"] for r in mine] == sorted((r["perturbed"] for r in mine), reverse=True) and all(0 <= r["inclusion"] <= 1 for r in mine)
        if len(t) <= 30:
            law = {(): 1.0}
            for u in lattices.units_of(lattices.normal(t)):
                law = {a + b: x * y for a, x in law.items() for b, y in every(lattices, u).items()} if len(law) < 20_000 else {}
            if law:
                seen += 1
                total = sum(law.values())
                assert len({tuple(r["ids"]) for r in mine}) == min(3, len(law))
                assert all(r["log_prob"] == pytest.approx(np.log(law[tuple(r["ids"])] / total), abs=1e-9) for r in mine)
    assert seen > 5


def test_awkward_empty_and_clashing(awkward, nothing):
    out = M.sampled_segmentations(awkward.withColumn("sample", F.lit("x")), "doc_id", k=2).collect()
    assert len(out) == 3 + 2 * (awkward.count() - 3) and all(r["decoded"] for r in out)
    assert M.sampled_segmentations(nothing, "doc_id").count() == 0


def test_runs_of_blanks_have_their_pieces(lattices):
    """Pieces of several blanks are sampled, with exact probabilities."""
    text = " a    b "
    units = [every(lattices, u) for u in lattices.units_of(lattices.normal(text))]
    law = {(): 1.0}
    for u in units:
        law = {a + b: x * y for a, x in law.items() for b, y in u.items()}
    total, blanks = sum(law.values()), {lattices.pieces["▁" * n][0] for n in range(2, 17) if "▁" * n in lattices.pieces}
    rows = M.sample(lattices, [3], [text], len(law) + 1)[0]
    assert len(blanks) == 14 and {tuple(r[0].tolist()) for r in rows} == set(law)
    assert all(r[1] == pytest.approx(np.log(law[tuple(r[0].tolist())] / total), abs=1e-9) and M.decode(lattices, r[0].tolist()) == text for r in rows)
    assert any(blanks & set(r[0].tolist()) for r in rows)


def test_library_decodes_to_the_text(spark, docs, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert not any("▁" in sp.id_to_piece(i).lstrip("▁") for i in range(sp.get_piece_size()))
    code = [(10**6 + i, "if x:\n" + " " * n + "y  =   1" + " " * n) for i, n in enumerate([1, 2, 4, 8, 15, 16, 17, 40])]
    text = {**{i: t or "" for i, t, *_ in rows}, **dict(code)}
    both = docs.select("doc_id", "text").union(spark.createDataFrame(code, "doc_id long, text string"))
    for r in M.sampled_segmentations(both, "doc_id", k=2, keep_ids=True).where("n_pieces > 0").collect():
        assert sp.decode(r["ids"]) == text[r["doc_id"]] and r["decoded"]


def test_query_gives_three_segmentations(spark, sf, rows):
    out = M.op9_gumbel_segmentations(spark, sf).collect()
    samples = {}
    for r in out:
        samples.setdefault(r["doc_id"], []).append(r["sample"])
    assert all(r["decoded"] for r in out) and set(samples) == {i for i, *_ in rows}
    assert all(sorted(samples[i]) == [0, 1, 2] for i, t, *_ in rows if len((t or "").strip()) > 5)
