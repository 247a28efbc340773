"""Readers: transcripts and engine output as JSON, podcast feeds as XML, tables; and the choices between sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas


def raw_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Transcripts as JSON documents; a malformed one fails the read."""
    return spark.read.schema(schemas.RAW_TRANSCRIPT).option("multiLine", True).option("mode", "FAILFAST").json(path)


def raw_segments(raw: DataFrame) -> DataFrame:
    """A row per segment, seq by its place in the document."""
    return raw.select("transcript_id", F.posexplode("segments").alias("seq", "s")).select("transcript_id", F.col("seq").cast("bigint").alias("seq"), "s.*")


def raw_speakers(raw: DataFrame) -> DataFrame:
    return raw.select("transcript_id", F.posexplode("speakers").alias("ord", "s")).select("transcript_id", "ord", "s.*")


def to_ms(seconds: Column) -> Column:
    """Whole milliseconds, cut off."""
    return (seconds * 1000).cast("bigint")


FEED = "title string, guid string, pubDate string, enclosure struct<_url:string,_type:string>, duration string"


def episodes(spark: SparkSession, feed_xml: DataFrame) -> DataFrame:
    """Episodes of feeds (feed, xml): feed, idx (place in the feed), title, guid, pub_date, url, duration (as it stands there).

    An item counts if it has an enclosure whose type, if given, is audio; idx counts the others, too. Blank texts are null,
    but a title, which is then made of the place.
    """
    item = F.transform(F.regexp_extract_all("xml", F.lit(r"(?s)(<item\b.*?</item>)"), F.lit(1)), lambda x: F.from_xml(x, FEED, {"ignoreNamespace": "true"}))
    rows = feed_xml.select("feed", F.posexplode(item).alias("idx", "i"))
    rows = rows.where("i.enclosure._url is not null and (i.enclosure._type is null or i.enclosure._type like 'audio/%')")
    text = lambda c: F.when(F.trim(c) != "", F.trim(c))
    title = F.coalesce(text("i.title"), F.concat(F.lit("Episode "), (F.col("idx") + 1).cast("string")))
    return rows.select(
        "feed", F.col("idx").cast("bigint").alias("idx"), title.alias("title"), text("i.guid").alias("guid"), text("i.pubDate").alias("pub_date"),
        F.col("i.enclosure._url").alias("url"), text("i.duration").alias("duration"),
    )


def listed_episodes(found: DataFrame, limit: int = 20) -> DataFrame:
    """The first `limit` episodes of each feed, with place (from 0) among those that count."""
    order = Window.partitionBy("feed").orderBy("idx")
    return found.withColumn("place", (F.row_number().over(order) - 1).cast("bigint")).where(F.col("place") < limit)


def chosen_episodes(found: DataFrame, wishes: DataFrame) -> DataFrame:
    """(feed, wish, idx, url, problem) of wishes (feed, wish, episode int, title_contains): for each the first episode whose
    title contains the text (in any case) or, without a text, that at the place, by default the first. problem says why
    there is none."""
    order = Window.partitionBy("feed").orderBy("idx")
    placed = found.withColumn("place", F.row_number().over(order) - 1)
    held = placed.groupBy("feed").agg(F.count(F.lit(1)).alias("n"))
    needle = F.when(F.col("title_contains") != "", F.lower("title_contains"))
    w = wishes.withColumns({"needle": needle, "at": F.coalesce("episode", F.lit(0))}).join(held, "feed", "left")
    fits = F.when(F.col("needle").isNotNull(), F.contains(F.lower(F.col("title")), F.col("needle"))).otherwise(F.col("place") == F.col("at"))
    first = w.join(placed, "feed").where(fits).groupBy("feed", "wish").agg(F.min_by(F.struct("idx", "url"), "idx").alias("e"))
    problem = (
        F.when(F.col("n").isNull(), "no audio in the feed")
        .when(F.col("e").isNotNull(), None)
        .when(F.col("needle").isNotNull(), "no title contains it")
        .otherwise("place out of range")
    )
    return w.join(first, ["feed", "wish"], "left").select("feed", "wish", "e.idx", "e.url", problem.alias("problem"))


def iso_or_text(rfc822: Column) -> Column:
    """An RFC 822 date as ISO 8601; anything else as it is."""
    t = F.try_to_timestamp(F.regexp_replace(rfc822, r"^[A-Za-z]{3}, *", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.coalesce(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ssXXX"), rfc822)


def meetings(table: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest meetings with the first title that is known."""
    out = table.select("id", F.coalesce("manualTitle", "eventTitle", "title", "llmTitle").alias("title"), "word_count", "start")
    return out if limit is None else out.orderBy(F.col("start").desc(), "id").limit(limit)


def best_recording(recordings: DataFrame) -> DataFrame:
    """Per conference its last recording that is ready and has a file."""
    ready = recordings.where("state in ('ENDED', 'FILE_GENERATED') and file is not null and file <> ''")
    when = F.coalesce("end_time", "start_time", F.lit(""))
    return ready.groupBy("conference").agg(F.max_by("file", F.struct(when, "file")).alias("file"))


def entry_speakers(entries: DataFrame, participants: DataFrame) -> DataFrame:
    """Entries (conference, i, ref) with speaker_id: S1, S2, ... by participant, S_unk_0, ... by first appearance.

    An unknown ref is one speaker wherever it comes; every entry without ref is another.
    """
    known = Window.partitionBy("conference").orderBy("ord")
    p = participants.select("conference", "ref", F.concat(F.lit("S"), F.row_number().over(known).cast("string")).alias("sid"))
    e = entries.join(p, ["conference", "ref"], "left")
    e = e.withColumn("who", F.when(F.col("sid").isNull(), F.when(F.col("ref") != "", F.concat(F.lit("r"), "ref")).otherwise(F.concat(F.lit("i"), F.col("i").cast("string")))))
    first = e.where("who is not null").groupBy("conference", "who").agg(F.min("i").alias("first"))
    n = F.row_number().over(Window.partitionBy("conference").orderBy("first"))
    first = first.select("conference", "who", F.concat(F.lit("S_unk_"), (n - 1).cast("string")).alias("unknown"))
    out = e.join(first, ["conference", "who"], "left")
    return out.select(*entries.columns, F.coalesce("sid", "unknown").alias("speaker_id"))


def connector(ref: Column) -> Column:
    """youtube, podcast or web, by the address."""
    from ..functions.urls import host_of, is_video_host, part

    feed = F.lower(part(ref, 1)).isin("http", "https", "file") & F.lower(part(ref, 5)).rlike(r"\.(mp3|m4a|wav|aac|ogg|opus|flac|xml|rss)$")
    return F.when(is_video_host(host_of(ref)), "youtube").when(feed, "podcast").otherwise("web")
