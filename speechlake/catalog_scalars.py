"""Registered queries of feeds, casts, codecs and checks, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import testdata as td
from .catalog import FP, STORE, query
from .functions import scalars
from .plans import fingerprints as plans
from .sources import engines, readers

#: A feed per conversation, an item per turn: of every third the enclosure is a video, of every seventh it's missing; some titles and durations are blank.
ITEMS = """
item AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, length(text) AS n, role FROM conversations),
episode AS (SELECT 'feed-' || conv_id AS feed, CAST(idx AS BIGINT) AS idx, CASE WHEN turn % 4 = 1 THEN 'Episode ' || (idx + 1) ELSE 'Talk of ' || role || ' ' || n END AS title,
  'https://cdn.example/' || conv_id || '/' || turn || '.mp3' AS url, CASE WHEN turn % 5 <> 2 THEN printf('%02d:%02d', n // 60, n % 60) END AS duration,
  row_number() OVER (PARTITION BY conv_id ORDER BY idx) - 1 AS place FROM item WHERE turn % 3 <> 2 AND turn % 7 <> 6)"""


def _episodes(spark, sf_dir):
    c = td.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    turn, s = F.col("turn"), lambda c: c.cast("string")
    url = F.concat(F.lit("https://cdn.example/"), s(F.col("conv_id")), F.lit("/"), s(turn), F.lit(".mp3"))
    enclosure = F.when(turn % 7 == 6, "").otherwise(F.concat(F.lit("<enclosure url='"), url, F.lit("' type='"), F.when(turn % 3 == 2, "video/mp4").otherwise("audio/mpeg"), F.lit("'/>")))
    title = F.when(turn % 4 == 1, " ").otherwise(F.concat(F.lit("Talk of "), "role", F.lit(" "), s(F.col("n"))))
    length = F.when(turn % 5 == 2, " ").otherwise(F.format_string("%02d:%02d", F.floor(F.col("n") / 60), F.col("n") % 60))
    item = F.concat(F.lit("<item><title>"), title, F.lit("</title>"), enclosure, F.lit("<itunes:duration>"), length, F.lit("</itunes:duration></item>"))
    feeds = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", item.alias("x")))).alias("items"))
    xml = F.concat(F.lit("<rss xmlns:itunes='urn:i'><channel>"), F.array_join(F.transform("items", lambda i: i["x"]), ""), F.lit("</channel></rss>"))
    return readers.episodes(spark, feeds.select(F.concat(F.lit("feed-"), F.col("conv_id").cast("string")).alias("feed"), xml.alias("xml")))


@query("SELECT feed, idx, title, url, duration, place FROM episode WHERE place < 3", ITEMS)
def feed_episodes(spark, sf_dir):
    """The first three episodes of each feed, with their durations."""
    return readers.listed_episodes(_episodes(spark, sf_dir), 3).select("feed", "idx", "title", "url", "duration", "place")


@query(
    """SELECT f.feed, w.wish, e.idx, e.url, CASE WHEN h.n IS NULL THEN 'no audio in the feed' WHEN e.idx IS NOT NULL THEN NULL WHEN w.wish = 'title' THEN 'no title contains it' ELSE 'place out of range' END AS problem
    FROM (SELECT DISTINCT 'feed-' || conv_id AS feed FROM conversations) f, (SELECT unnest(['first', 'second', 'title']) AS wish) w
    LEFT JOIN (SELECT feed, count(*) AS n FROM episode GROUP BY feed) h ON h.feed = f.feed
    LEFT JOIN LATERAL (SELECT idx, url FROM episode e WHERE e.feed = f.feed AND CASE w.wish WHEN 'first' THEN place = 0 WHEN 'second' THEN place = 1 ELSE contains(lower(title), 'assistant 1') END ORDER BY idx LIMIT 1) e ON true""", ITEMS)  # fmt: skip
def feed_choices(spark, sf_dir):
    """Of each feed the first episode, the second, and the first whose title contains a text; or why there is none."""
    feeds = td.table(spark, sf_dir, "conversations").select(F.concat(F.lit("feed-"), F.col("conv_id").cast("string")).alias("feed")).distinct()
    wish = F.array(*[F.struct(F.lit(w).alias("wish"), F.lit(e).cast("int").alias("episode"), F.lit(t).cast("string").alias("title_contains")) for w, e, t in (("first", None, None), ("second", 1, ""), ("title", None, "ASSISTANT 1"))])
    return readers.chosen_episodes(_episodes(spark, sf_dir), feeds.select("feed", F.inline(wish)))


@query("SELECT vec_id, CAST(4 * len(embedding) AS BIGINT) AS n_bytes, embedding[1] AS first, embedding[len(embedding)] AS last, list_max(embedding) AS most FROM embeddings")
def vector_codec(spark, sf_dir):
    """Vectors as bytes and back."""
    e = td.table(spark, sf_dir, "embeddings").select("vec_id", scalars.vector_bytes("embedding").alias("b"))
    v = e.select("vec_id", F.length("b").cast("bigint").alias("n_bytes"), scalars.vector_of("b").alias("v"))
    return v.select("vec_id", "n_bytes", F.get("v", F.lit(0)).alias("first"), F.element_at("v", -1).alias("last"), F.array_max("v").alias("most"))


@query("SELECT transcript_id, CASE substr(transcript_id, 6)::BIGINT % 3 WHEN 0 THEN duration_ms WHEN 1 THEN duration_ms + 7 ELSE 0 END AS duration_ms FROM transcripts", STORE)
def duration_fallback(spark, sf_dir):
    """The engine's duration, or the end of the last segment, or 0."""
    t = td.transcripts(spark, sf_dir).withColumn("k", F.substring("transcript_id", 6, 20).cast("bigint") % 3)
    given = F.when(F.col("k") == 1, F.col("duration_ms") + 7).when(F.col("k") == 0, F.lit(0).cast("bigint"))
    end = F.when(F.col("k") < 2, F.col("duration_ms"))
    return t.select("transcript_id", engines.duration_or_last(given, end).alias("duration_ms"))


@query(
    """SELECT event_id, CAST(trunc(value * 1000) AS BIGINT) AS ms, CASE WHEN event_id % 3 = 0 THEN value WHEN event_id % 3 = 1 THEN NULL END AS number,
    DATE '2024-06-01' - CAST(ts AS DATE) > 120 AS stale, CASE event_id % 4 WHEN 0 THEN 'pyannote/speaker-diarization-community-1' WHEN 1 THEN 'pyannote/speaker-diarization-3.1' WHEN 2 THEN event_type ELSE 'pyannote/speaker-diarization-community-1' END AS model FROM events""")  # fmt: skip
def event_casts(spark, sf_dir):
    """Seconds as milliseconds, texts as numbers, stale releases and short model names."""
    e, k = td.table(spark, sf_dir, "events"), F.col("event_id")
    number = scalars.number_or_null(F.when(k % 3 == 0, F.col("value").cast("string")).when(k % 3 == 1, F.col("event_type")))
    name = F.when(k % 4 == 0, "community-1").when(k % 4 == 1, "3.1").when(k % 4 == 2, F.col("event_type")).otherwise("")
    stale = scalars.is_stale(F.date_format("ts", "yyyyMMdd'.1'"), F.lit("2024-06-01").cast("date"))
    return e.select("event_id", readers.to_ms(F.col("value")).alias("ms"), number.alias("number"), stale.alias("stale"), scalars.model_name(name).alias("model"))


@query(
    r"""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'youtube' WHEN page_id % 4 = 1 THEN 'podcast' ELSE 'web' END AS kind FROM pages""")  # fmt: skip
def connector_kinds(spark, sf_dir):
    """Which connector an address belongs to: video hosts, files and feeds by their ending, all others."""
    k, url = F.col("page_id") % 4, F.regexp_extract("url", r"^([^?#]*)", 1)
    ref = F.when(k == 0, F.concat(F.lit("https://www.youtube.com/watch?v="), F.col("page_id").cast("string"))).when(k == 1, F.concat(url, F.lit(".MP3?x=1"))).otherwise(F.col("url"))
    return td.table(spark, sf_dir, "pages").select("page_id", readers.connector(ref).alias("kind"))


@query(
    """SELECT fingerprint_id, CASE WHEN vec_id % 10 = 0 THEN 'no id' WHEN n > 1 THEN 'repeated id' WHEN vec_id % 10 = 2 THEN 'no embedding' WHEN vec_id % 10 = 4 THEN 'embedding not finite' WHEN vec_id % 10 = 6 THEN 'dimension differs' END AS problem
    FROM (SELECT *, count(*) OVER (PARTITION BY fingerprint_id) AS n FROM (SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN ' ' WHEN vec_id % 30 = 12 THEN 'VP-same-' || vec_id // 60 ELSE fingerprint_id END AS fingerprint_id FROM prints)) WHERE vec_id % 10 <> 8 OR n > 1""", FP)  # fmt: skip
def import_problems(spark, sf_dir):
    """Rows of an import that can't be taken, repeated ids among them."""
    k = F.col("vec_id") % 10
    p = td.prints(spark, sf_dir).select(
        F.when(k == 0, " ").when(F.col("vec_id") % 30 == 12, F.concat(F.lit("VP-same-"), F.floor(F.col("vec_id") / 60).cast("string"))).otherwise(F.col("fingerprint_id")).alias("fingerprint_id"),
        F.when(k == 2, F.array().cast("array<float>")).when(k == 4, F.transform("embedding", lambda x: F.lit(float("inf")).cast("float"))).otherwise(F.col("embedding")).alias("embedding"),
        F.when(k == 6, 1).otherwise(F.size("embedding")).alias("embedding_dimension"), "status",
    )
    return plans.invalid_rows(p)
