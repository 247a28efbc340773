import datetime as dt

from pyspark.sql import functions as F
from speechlake.functions import scalars as sc


def values(spark, rows, *cols):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string").coalesce(1)
    out = [tuple(r)[1:] for r in df.select("i", *cols).orderBy("i").collect()]
    return [r[0] if len(cols) == 1 else r for r in out]



def test_times(spark):
    texts = ["2024-05-06T07:08:09Z", "20240506", "2024-05-06T09:08:09+02:00", "2024-05-06T07:08:09", "soon", "", None]
    ms = [1714979289000, 1714953600000, 1714979289000, 1714979289000, 0, 0, 0]
    assert values(spark, texts, sc.epoch_ms(F.col("x"))) == ms
    got = values(spark, ["2024-05-06T07:08:10Z", "2024-05-06T07:00:00Z"], sc.relative_ms(F.col("x"), F.lit("2024-05-06T07:08:11Z"), F.lit(1714979289000)))
    assert [tuple(r) for r in got] == [(1000, 2000), (0, 2000)]
    assert values(spark, ["59999", "3600000", None, "61000"], sc.clock(F.col("x").cast("long"))) == ["0:59", "1:00:00", "-", "1:01"]
    assert values(spark, ["20240101", "2024.1", "20240506-x", "99999999"], sc.is_stale(F.col("x"), F.lit(dt.date(2024, 6, 1)))) == [True, None, False, None]
    at = values(spark, ["/m/a-FINAL-1700000000.5-1700000100.0-mic.m4a", "/m/other.m4a"], F.unix_millis(sc.file_recorded_at(F.col("x"))))
    assert at == [1700000000500, None]


def test_names(spark):
    assert values(spark, ["/a/b/Call one.wav", "/a/.hidden", "x/"], sc.title_hint(F.lit("{}"), F.col("x"))) == ["Call one", ".hidden", "x"]
    assert values(spark, ['{"title": "T"}', '{"title": ""}', None], sc.title_hint(F.col("x"), F.lit("p.q.mp3"))) == ["T", "p.q", "p.q"]
    assert values(spark, ["https://a.b/c/d.MP3?x=1", "https://a.b/c", "https://a.b/.x"], sc.ending(F.col("x"), F.lit("audio/mpeg"))) == [".MP3", ".mp3", ".mp3"]
    assert values(spark, ["3.1", "", None, "own/model"], sc.model_name(F.col("x"))) == ["pyannote/speaker-diarization-3.1", "pyannote/speaker-diarization-community-1", "pyannote/speaker-diarization-community-1", "own/model"]
    assert values(spark, ["1.5", "", None, "x", " 2 "], sc.number_or_null(F.col("x"))) == [1.5, None, None, None, 2.0]


def test_tools_output(spark):
    text = "codec_name=pcm_s16le\nsample_rate=16000\r\nchannels=2\nduration=N/A\n"
    assert tuple(values(spark, [text], sc.probe(F.col("x")))[0]) == ("pcm_s16le", 16000, 2, None)
    got = values(spark, ["DURATION=3\nFINGERPRINT=1,2,3\nFINGERPRINT=9", "DURATION=3", None], sc.audio_signature(F.col("x")))
    assert got == ["9d33a2c8c1bd16f41a5b6bd7a94dcd2d", None, None] or (len(got[0]) == 32 and got[1:] == [None, None])


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, -2.5],), (None,)], "v array<double>").coalesce(1)
    rows = df.select(sc.vector_bytes("v").alias("b")).select("b", sc.vector_of("b").alias("v")).collect()
    assert bytes(rows[0]["b"]).hex() == "0000803f000020c0" and rows[0]["v"] == [1.0, -2.5] and rows[1]["v"] is None


def test_public_urls(spark):
    good = ["https://example.com/x", "http://8.8.8.8/", "https://u@Example.com:99"]
    bad = ["ftp://example.com", "http://localhost:8080", "https://a.local/x", "http://10.0.0.1/", "http://[::1]/", "http://127.0.0.1", "https://", "x", None]
    assert values(spark, good + bad, sc.is_public_url(F.col("x"))) == [True] * 3 + [False] * len(bad)


def test_nested_json(spark):
    text = '{"fileName": "a", "clientName": 1, "deep": [{"project_id": 2, "x": {"Owner": 3, "y": null}}]}'
    assert values(spark, [text, "[1]", "no", None], sc.public_json(F.col("x"))) == ['{"fileName":"a","deep":[{"x":{"y":null}}]}', None, None, None]
    link = '{"a": ["see https://u:p@h.example/x?token=1", 5, true], "k \\"q\\"": {"Bearer abc": "sk_live_1a"}}'
    assert values(spark, [link, "[]", None], sc.redacted_json(F.col("x"))) == ['{"a": ["see https://h.example/x", 5, true], "k \\"q\\"": {"Bearer [redacted]": "sk_[redacted]"}}', "[]", None]
