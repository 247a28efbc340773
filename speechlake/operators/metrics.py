"""Per-speaker aggregates of a transcript."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.text import fillers
from .segments import in_order, tokens, with_islands

KEYS = ["transcript_id", "speaker_id"]


def talk_time(segments: DataFrame) -> DataFrame:
    """talk_time_ms: length of the union of a speaker's spans; touching spans merge."""
    w = Window.partitionBy(*KEYS).orderBy("start_ms", "end_ms")
    reach = F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = segments.select(*KEYS, "start_ms", "end_ms", reach.alias("__reach"))
    cut = (F.col("__reach").isNull() | (F.col("start_ms") > F.col("__reach"))).cast("bigint")
    s = s.withColumn("__cut", cut).withColumn("__island", F.sum("__cut").over(w))
    spans = s.groupBy(*KEYS, "__island").agg((F.max("end_ms") - F.min("start_ms")).alias("ms"))
    return spans.groupBy(*KEYS).agg(F.sum("ms").alias("talk_time_ms"))


def word_counts(segments: DataFrame) -> DataFrame:
    return segments.groupBy(*KEYS).agg(F.sum(F.size(tokens(F.col("text")))).cast("bigint").alias("word_count"))


def per_minute(words: Column, ms: Column) -> Column:
    return F.when(ms > 0, words / (ms / 60000)).otherwise(0.0)


def durations(segments: DataFrame) -> DataFrame:
    return segments.groupBy("transcript_id").agg(F.max("end_ms").alias("duration_ms"))


def talk_balance(segments: DataFrame) -> DataFrame:
    """talk_time_ms, talk_ratio, word_count and wpm per transcript and speaker."""
    out = talk_time(segments).join(word_counts(segments), KEYS).join(durations(segments), "transcript_id")
    ratio = F.when(F.col("duration_ms") > 0, F.col("talk_time_ms") / F.col("duration_ms")).otherwise(0.0)
    wpm = per_minute(F.col("word_count"), F.col("talk_time_ms"))
    return out.select(*KEYS, "talk_time_ms", ratio.alias("talk_ratio"), "word_count", wpm.alias("wpm"))


def pause_profile(words: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """pause_count and avg_pause_ms: gaps of min_gap_ms and more between words of one merged turn.

    words: transcript_id, speaker_id, island, seq, word_seq, word_start_ms, word_end_ms.
    """
    w = Window.partitionBy("transcript_id", "island").orderBy("seq", "word_seq")
    gaps = words.withColumn("gap", F.col("word_start_ms") - F.lag("word_end_ms").over(w)).where(F.col("gap") >= cfg.min_gap_ms)
    return gaps.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("pause_count"), F.avg("gap").alias("avg_pause_ms"))


def filler_rates(segments: DataFrame) -> DataFrame:
    """filler_count and filler_rate, fillers per 100 words."""
    s = segments.groupBy(*KEYS).agg(
        F.sum(F.size(fillers(F.col("text")))).cast("bigint").alias("filler_count"),
        F.sum(F.size(tokens(F.col("text")))).cast("bigint").alias("n"),
    )
    rate = F.when(F.col("n") > 0, F.col("filler_count") / F.col("n") * 100).otherwise(0.0)
    return s.select(*KEYS, "filler_count", rate.alias("filler_rate"))


def asr_confidence(words: DataFrame) -> DataFrame:
    """Mean of a segment's known word confidences; null if none is known."""
    return words.groupBy("transcript_id", "segment_id").agg(F.avg("confidence").alias("asr_confidence"))


def speaker_metrics(annotated: DataFrame, words: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """All metrics of every speaker with a segment. annotated has turn taking; words as even_words makes them.

    Segments are dealt by transcript once: windows and the aggregation by speaker need no other exchange. A span adds to
    the talk time what lies behind the speaker's spans so far; a speaker is interrupted by the segment that follows.
    """
    islands = with_islands(annotated, cfg).select("transcript_id", "seq", "island")
    pauses = pause_profile(words.join(islands, ["transcript_id", "seq"]), cfg)
    own = Window.partitionBy(*KEYS).orderBy("start_ms", "end_ms").rowsBetween(Window.unboundedPreceding, -1)
    s = annotated.withColumns(
        {"__cut": F.lead("is_interruption").over(in_order()), "__total": F.max("end_ms").over(Window.partitionBy("transcript_id")), "__reach": F.max("end_ms").over(own)}
    )
    added = F.greatest(F.col("end_ms") - F.greatest("start_ms", F.coalesce("__reach", "start_ms")), F.lit(0).cast("bigint"))
    out = s.groupBy(*KEYS).agg(
        F.sum(added).alias("talk_time_ms"), F.max("__total").alias("__total"), F.sum(F.size(tokens(F.col("text")))).cast("bigint").alias("word_count"),
        F.sum(F.size(fillers(F.col("text")))).cast("bigint").alias("filler_count"),
        F.count_if("is_interruption").alias("interruptions_made"), F.count_if("__cut").alias("interruptions_received"),
    )
    ratio = F.when(F.col("__total") > 0, F.col("talk_time_ms") / F.col("__total")).otherwise(0.0)
    rate = F.when(F.col("word_count") > 0, F.col("filler_count") / F.col("word_count") * 100).otherwise(0.0)
    out = out.withColumns({"talk_ratio": ratio, "wpm": per_minute(F.col("word_count"), F.col("talk_time_ms")), "filler_rate": rate})
    out = out.join(pauses, KEYS, "left").fillna({"pause_count": 0, "avg_pause_ms": 0.0})
    return out.select(
        *KEYS, "talk_time_ms", "talk_ratio", "word_count", "wpm", "pause_count", "avg_pause_ms", "filler_count", "filler_rate",
        "interruptions_made", "interruptions_received",
    )
