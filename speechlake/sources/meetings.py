"""Meetings: which audio stands for one, transcripts of its text record, paged lists, WAV headers, and readiness."""

from __future__ import annotations

import io
import wave

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import blank_to_null, epoch_ms, file_recorded_at, relative_ms
from .readers import best_recording, entry_speakers, meetings


def meeting(table: DataFrame, meeting_id: str) -> DataFrame:
    """The row of one meeting; empty if there is none."""
    return meetings(table.where(F.col("id") == meeting_id))


def meeting_audio(files: DataFrame) -> DataFrame:
    """(id, source, paths, recorded_at, problem) of meetings' audio files (path .../<name>-<id>/<name>-<variant>.m4a).

    A combined file wins; else microphone and system together; else problem says that there is no audio.
    """
    at = F.regexp_extract(F.col("path"), r"-([^/-]+)/[^/]*-(combined|mic|system)\.m4a$", 1)
    variant = F.regexp_extract(F.col("path"), r"-([^/-]+)/[^/]*-(combined|mic|system)\.m4a$", 2)
    known = files.select("path", at.alias("id"), variant.alias("variant")).where("id <> ''")
    by = known.groupBy("id").pivot("variant", ["combined", "mic", "system"]).agg(F.min("path"))
    both = F.col("mic").isNotNull() & F.col("system").isNotNull()
    source = F.when(F.col("combined").isNotNull(), "combined").when(both, "mic+system")
    paths = F.when(F.col("combined").isNotNull(), F.array("combined")).when(both, F.array("mic", "system"))
    when = file_recorded_at(F.coalesce("combined", "mic", "system"))
    return by.select("id", source.alias("source"), paths.alias("paths"), when.alias("recorded_at"), F.when(source.isNull(), F.concat(F.lit("no audio found for meeting "), "id")).alias("problem"))


def chosen_source(conferences: DataFrame, recordings: DataFrame, entries: DataFrame, allow_text: bool = True) -> DataFrame:
    """(conference, source_kind, ref, audio_priority, problem): a local file, else the best recording, else the text.

    conferences: conference, local_audio (may be null).
    """
    c = conferences.join(best_recording(recordings), "conference", "left")
    c = c.join(entries.select("conference").distinct().withColumn("__text", F.lit(True)), "conference", "left")
    local, recorded = blank_to_null(F.col("local_audio")), F.col("file")
    text = F.coalesce("__text", F.lit(False)) & F.lit(allow_text)
    kind = F.when(local.isNotNull(), "local-audio").when(recorded.isNotNull(), "meet-recording").when(text, "meet-text-fallback")
    priority = F.when(local.isNotNull(), "explicit-local").when(recorded.isNotNull(), "meet-recording").when(text, "meet-text-fallback")
    problem = F.when(kind.isNull(), F.concat(F.lit("no local or downloadable recording for "), "conference"))
    return c.select("conference", kind.alias("source_kind"), F.coalesce(local, recorded).alias("ref"), priority.alias("audio_priority"), problem.alias("problem"))


def record_segments(records: DataFrame, entries: DataFrame, participants: DataFrame) -> DataFrame:
    """Segments of text records: transcript_id, seq, segment_id, speaker_id, start_ms, end_ms, text.

    records: conference, start_time; entries: conference, i, ref, text, start_time, end_time; participants: conference,
    ref, ord. Times count from the conference's start, or where that is missing from its first entry. Blank entries go.
    """
    first = entries.groupBy("conference").agg(F.min_by("start_time", "i").alias("first"))
    base = records.join(first, "conference", "left").select("conference", F.coalesce(F.nullif(epoch_ms(F.col("start_time")), F.lit(0).cast("long")), epoch_ms(F.col("first"))).alias("base"))
    told = entries.withColumn("text", F.btrim("text", F.lit(" \t\r\n"))).where("text <> ''")
    e = entry_speakers(told, participants).join(base, "conference")
    e = e.withColumn("t", relative_ms(F.col("start_time"), F.col("end_time"), F.col("base")))
    n = F.row_number().over(Window.partitionBy("conference").orderBy("i"))
    return e.select(
        F.col("conference").alias("transcript_id"), (n - 1).cast("bigint").alias("seq"), F.concat(F.lit("meet-"), n.cast("string")).alias("segment_id"),
        "speaker_id", "t.start_ms", "t.end_ms", "text",
    )


def pages(first: DataFrame, limit: int | None = None) -> DataFrame:
    """Items of saved result pages (query, page, items array) in order, at most `limit` of each query."""
    rows = first.select("query", "page", F.posexplode("items").alias("i", "item"))
    n = F.row_number().over(Window.partitionBy("query").orderBy("page", "i"))
    rows = rows.withColumn("n", n.cast("bigint"))
    return (rows if limit is None else rows.where(F.col("n") <= limit)).select("query", "n", "item")


HEADER = T.StructType([T.StructField("rate", T.IntegerType()), T.StructField("channels", T.IntegerType()), T.StructField("bits", T.IntegerType()), T.StructField("frames", T.LongType())])


@F.pandas_udf(HEADER)
def wav_header(content: pd.Series) -> pd.DataFrame:
    """Rate, channels, bits and frames from the first bytes of a WAV file; nulls for what is none."""

    def one(data):
        try:
            with wave.open(io.BytesIO(data)) as w:
                return w.getframerate(), w.getnchannels(), 8 * w.getsampwidth(), w.getnframes()
        except (wave.Error, EOFError, TypeError):
            return None, None, None, None

    return pd.DataFrame([one(x) for x in content], columns=["rate", "channels", "bits", "frames"], dtype=object)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def wav_samples(content: pd.Series) -> pd.Series:
    """Samples of PCM WAV files of 8, 16, 24 or 32 bits, -1 to 1, channels averaged; null for others."""
    import numpy as np

    def one(data):
        try:
            with wave.open(io.BytesIO(data)) as w:
                size, raw = w.getsampwidth(), np.frombuffer(w.readframes(w.getnframes()), np.uint8)
                channels = w.getnchannels()
        except (wave.Error, EOFError, TypeError, ValueError):
            return None
        raw = raw[: len(raw) - len(raw) % (size * channels)].reshape(-1, size)
        if size == 1:  # the only width without a sign
            x = raw[:, 0].astype(np.float64) - 128
        else:
            wide = np.zeros((len(raw), 4), np.uint8)
            wide[:, 4 - size :] = raw
            x = wide.view("<i4")[:, 0] / 256.0 ** (4 - size)
        return (x.reshape(-1, channels).mean(1) / 2 ** (8 * size - 1)).astype("float32")

    return content.map(one)


def wav_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, rate, channels, bits, frames, duration_ms) of WAV files."""
    files = spark.read.format("binaryFile").load(path).select("path", wav_header("content").alias("h")).select("path", "h.*")
    return files.withColumn("duration_ms", F.floor(1000 * F.col("frames") / F.col("rate")).cast("bigint"))


def readiness(found: dict[str, tuple[bool, str]]) -> list[dict]:
    """Status rows of sources: name, ready, detail."""
    return [{"source": name, "ready": bool(ok), "status": "ready" if ok else "missing", "detail": detail} for name, (ok, detail) in sorted(found.items())]


def distinct_speakers(*tracks: DataFrame) -> DataFrame:
    """(transcript_id, speaker_id) of any of the tracks, once each, in order."""
    out = tracks[0].select("transcript_id", "speaker_id")
    for t in tracks[1:]:
        out = out.unionByName(t.select("transcript_id", "speaker_id"))
    return out.distinct().orderBy("transcript_id", "speaker_id")


