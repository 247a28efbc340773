import pytest
from pyspark.sql import functions as F
from speechlake.functions import text as tx
from speechlake.functions import urls


def values(spark, rows, *cols):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string").coalesce(1)
    return [tuple(r)[1:] for r in df.select("i", *cols).orderBy("i").collect()]


def test_fillers_and_lexicons(spark):
    (f, lx), = values(spark, ["Umm I mean, you know it's Like right? because I think and decide"], tx.fillers(F.col("x")), tx.linguistic(F.col("x")))
    assert f == ["umm", "i mean", "you know", "like", "right?"] and (lx["cognitive_process"], lx["causation"], lx["inclusive"], lx["word_count"]) == (3, 1, 1, 13)


def test_titles(spark):
    got = values(spark, ["Happy Hour", "HH", "happy hour", "Weekly huddle", None], tx.title_type(F.col("x")))
    assert [r[0] and (r[0]["meeting_type"], r[0]["confidence"]) for r in got] == [None, ("community", 0.95), ("community", 0.95), ("huddle", 0.95), None]


def test_signatures(spark):
    texts = ["the harbour crane lifted nine green containers onto the quay before noon", "the harbour crane lifted nine green containers on the quay before noon", "violins and a lone oboe opened an evening of forgotten chamber music", "too few", None]
    s = [r[0] for r in values(spark, texts, tx.text_signature(F.col("x")))]
    assert s[3] is None and s[4] is None and all(len(x) == 16 for x in s[:3])
    d = spark.createDataFrame([(s[0], s[1]), (s[0], s[2]), (s[0], s[0])], "a string, b string").coalesce(1).select(tx.hamming_hex(F.col("a"), F.col("b"))).collect()
    assert d[0][0] < d[1][0] and d[2][0] == 0
    assert values(spark, ["a b c d", "a b c d e"], tx.shingles(tx.signature_tokens(F.col("x")))) == [(["a b c d"],), (["a b c d", "b c d e"],)]


def test_formats(spark):
    assert values(spark, ["59999", "3600000"], tx.timestamp(F.col("x").cast("bigint"))) == [("00:59",), ("01:00:00",)]
    assert values(spark, ["..My file (1)!", "???"], tx.safe_stem(F.col("x"))) == [("My-file-1",), ("audio",)]
    assert values(spark, ["abc"], tx.stable_id(F.col("x"))) == [("a9993e364706816a",)]


def test_search(spark):
    s = spark.createDataFrame([("m", 0, "seg1", "S1", "hello there, World"), ("m", 1, "seg2", "S2", "other things")], "transcript_id string, seq long, segment_id string, speaker_id string, text string")
    found = lambda q: [(r["segment_id"], r["snippet"]) for r in tx.search(s, q).collect()]
    assert found("hello") == [("seg1", "<<hello>> there, World")] and [x[0] for x in found('"there world" OR thing*')] == ["seg1", "seg2"] and found("hello NOT world") == []
    for bad in ("", "AND", "(a", 'a "', "NOT a"):
        with pytest.raises(ValueError):
            tx.search(s, bad)


def test_url_identity_and_kind(spark):
    got = values(spark, ["https://u:p@Site.example:443/a?token=one&b=2&a=1#f", "https://site.example/a?X-Amz-Date=1", "plain"], urls.url_identity(F.col("x")))
    assert got == [("https://site.example:443/a?a=1&b=2",), ("https://site.example/a",), ("plain",)]
    kind = urls.candidate_kind(F.lit(None).cast("string"), F.lit("x"), F.col("x"), F.lit(None).cast("string"))
    assert [r[0] for r in values(spark, ["https://m.youtube.com/watch?v=1", "https://a.b/c.MP3?x", "https://a.b/c"], kind)] == ["external-video", "podcast-enclosure", "generic-media"]


def test_privacy_and_redaction(spark):
    m = F.map_filter(F.create_map(F.lit("clientName"), F.col("x"), F.lit("file"), F.col("x")), lambda k, v: v.isNotNull())
    assert values(spark, ["a"], urls.public_entries(m)) == [({"file": "a"},)]
    texts = {
        "x Bearer sk_live_abc": "x Bearer [redacted]",
        "sk_test_abc123": "sk_[redacted]",
        "see https://u:p@h.example:8080/a/Ab1Cd2Ef3Gh4Ij5Kl6Mn7Op8Qr9?q=1#f, ok": "see https://h.example:8080/a/[redacted] ok",
        "https://www.youtube.com/watch?v=abc&t=1": "https://www.youtube.com/watch?v=abc",
        "https://h.example:999999/long-slug-with-many-words-in-it": "https://h.example/long-slug-with-many-words-in-it",
        "(http://A.b/c%20d/e+f%2Fg/ü) and http://x.y": "(http://a.b/c%20d/e+f%2Fg/%C3%BC) and http://x.y",
        "header12.payload3.signature": "[redacted]",
        "Ab1Cd2Ef3Gh4Ij5Kl6Mn7Op8Qr9": "[redacted]",
        "aaaaaaaaaaaaaaaaaaaaaaaaaA1": "aaaaaaaaaaaaaaaaaaaaaaaaaA1",
        "ftp://u@h/p?x#y": "ftp://h/p",
        "": "",
        None: None,
    }
    assert [r[0] for r in values(spark, list(texts), urls.redacted(F.col("x")))] == list(texts.values())
    assert values(spark, ["aab", "abcd"], F.round(urls.bits_per_character(F.col("x")), 4)) == [(0.9183,), (2.0,)]
    assert values(spark, ["clientName", "CRM-Owner", "x_y2Z", "HTTPServer"], urls.key_parts(F.col("x"))) == [(["client", "name"],), (["crm", "owner"],), (["x", "y2", "z"],), (["httpserver"],)]
