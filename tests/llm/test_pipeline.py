import zlib
from collections import Counter
from math import log

import corpus_pipeline as C
import duckdb
import pytest
from pyspark.sql import functions as F
from speechlake.llm import quality as Q
from speechlake.llm import toxicity as X
from test_near import brute as near_brute
from test_packing import encode, valid
from test_quality import base, buckets
from test_substrings import brute as substring_brute

DDL = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_in_order(spark, sf, docs, rows):
    assert [n for n, _ in C.STAGES] == ["quality_rules", "toxicity", "near_duplicates", "repeated_substrings", "packing"] and C.ORACLE_SQL is None
    kept = C.quality_stage(spark, docs, sf)
    assert kept.columns == DDL and 0 < kept.count() < len(rows)
    clean = C.toxicity_stage(spark, kept, sf)
    assert clean.columns == DDL and clean.count() <= kept.count()


def test_near_duplicate_and_substring_stages_equal_brute_force(spark, sf, docs, rows):
    one = C.near_duplicate_stage(spark, docs, sf)
    expected = {i for i, _, _, keep in near_brute(rows) if keep}
    got = [tuple(r) for r in one.collect()]
    assert one.columns == DDL and {r[0] for r in got} == expected and len(got) == len(expected)
    two = C.substring_stage(spark, one, sf)
    assert two.columns == DDL
    text = {r[0]: r[1] for r in got}
    for r in two.collect():
        i, _, removed, kept = next(x for x in substring_brute(got) if x[0] == r["doc_id"])
        assert r["text"] == (kept if removed else text[i]) and (not removed or r["n_chars"] == len(kept))


def test_packing_stage_holds_all_tokens(spark, sf, docs, rows):
    out = C.packing_stage(spark, docs, sf).collect()
    ids = [e + [2] for e in encode([t or "" for _, t, *_ in rows])]
    assert sum(r["length"] for r in out) == sum(map(len, ids))
    valid([(r["sequence_id"], r["offset"], r["length"]) for r in out], 1024)


def test_empty_and_awkward(spark, sf, awkward, nothing):
    d = nothing
    for _, stage in C.STAGES:
        d = stage(spark, d, sf)
        assert d.count() == 0
    n = awkward.count()
    assert C.quality_stage(spark, awkward, sf).count() == 0  # all are too short or repeat themselves
    assert C.near_duplicate_stage(spark, awkward, sf).count() == n
    assert sorted(r["text"] or "" for r in C.substring_stage(spark, awkward, sf).collect()) == sorted(r["text"] or "" for r in awkward.collect())
    assert C.packing_stage(spark, awkward, sf).count() == n
    assert all(r["text"] is None or r["text"] for r in C.toxicity_stage(spark, awkward.where("text is null"), sf).collect())


CLASHING = ["score", "kept", "k", "n_words", "n_removed", "predicted", "component_id", "digest", "rest", "earlier", "b.c", "base_failed", "kept_text", "chunk"]


def test_other_columns_come_back_unchanged(spark, sf, docs):
    wide = docs.select("*", *[F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")).alias(c) for c in CLASHING])
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, wide, sf)
        assert out.columns == wide.columns, name
        found = out.collect()
        assert found and all(r[c] == (f"{c}-{r['doc_id']}" if r["doc_id"] is not None else None) for r in found for c in CLASHING), name


def brute_quality(rows, good):
    raw, fine = Counter(), Counter()
    for i, t, *_ in rows:
        raw.update(buckets(t))
        fine.update(buckets(t) if i in good else [])
    n, m = sum(raw.values()) + Q.BUCKETS, sum(fine.values()) + Q.BUCKETS
    for r in rows:
        words, *_, repeated = base(r[1])
        b = buckets(r[1])
        score = sum(log((fine[x] + 1) / m) - log((raw[x] + 1) / n) for x in b) / len(b) if b else 0.0
        if words >= 20 and 100 * repeated <= 30 * words and score >= Q.THRESHOLD:
            yield r


def test_run_equals_brute_force(spark, sf, rows):
    """Every stage stated apart: which documents and words stay, and the ids of all pieces."""
    left = list(brute_quality(rows, {i for i, *_ in rows if i % 3}))
    learn = {r[0]: r[1] for r in left if zlib.crc32(str(r[0]).encode()) % 5 and r[1]}
    model = X.fit(*([t for _, t in sorted(learn.items()) if ("idiot" in t) == toxic] for toxic in (True, False)))
    left = [r for r in left if model.a * model.worst(X.sentences(r[1])) + model.b < 0]
    first = {i for i, _, _, keep in near_brute(left) if keep}
    left = [r for r in left if r[0] in first]
    texts = {i: (kept if removed else next(r[1] for r in left if r[0] == i)) for i, _, removed, kept in substring_brute(left)}
    expected = {i: e + [2] for i, e in zip(texts, encode(list(texts.values())))}
    out = C.run(spark, sf).collect()
    assert len(expected) > 20 and {r["doc_id"] for r in out} == set(expected)
    for r in out:
        ids = expected[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))
    assert sum(r["length"] for r in out) == sum(map(len, expected.values()))
    valid([(r["sequence_id"], r["offset"], r["length"]) for r in out], 1024)


def test_toxicity_stage_keeps_clean_and_drops_toxic(spark):
    """Labelled documents of sf0.1, held out ones included. Some that are labelled toxic hold no insult at all."""
    at = "/root/testdata/sf0.1"
    after = {r["doc_id"] for r in C.toxicity_stage(spark, spark.read.parquet(f"{at}/documents.parquet"), at).select("doc_id").collect()}
    insults = "trash|pathetic|worthless|idiot|disgusting|loser|scum|clown|moron|stupid"
    labelled = duckdb.sql(f"SELECT doc_id, toxic = 1, regexp_matches(lower(text), '{insults}') FROM '{at}/documents.parquet' JOIN '{at}/labels.parquet' USING (doc_id)").fetchall()
    caught = [i not in after for i, toxic, plain in labelled if toxic and plain]
    clean = [i in after for i, toxic, plain in labelled if not toxic and not plain]
    assert sum(caught) / len(caught) > 0.9 and sum(clean) / len(clean) > 0.97
    assert sum(i not in after for i, toxic, _ in labelled if toxic) / sum(toxic for _, toxic, _ in labelled) > 0.75


@pytest.mark.parametrize("name", ["op4_repeated_substrings", "op5_minhash_near_duplicates", "quality_base_columns", "token_byte_counts"])
def test_queries_equal_their_sql(spark, name):
    from speechlake.llm import registry

    at = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet'")
    sides = [registry.QUERIES[name](spark, at).toArrow(), con.sql(registry.ORACLES[name]).to_arrow_table()]
    one, two = (sorted(zip(*[t[c].to_pylist() for c in sorted(t.column_names)], strict=True), key=repr) for t in sides)
    assert one and one == two and sorted(sides[0].column_names) == sorted(sides[1].column_names)
