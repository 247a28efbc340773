"""Operators over speaker-attributed segments.

A segments frame has transcript_id, seq (order in the transcript), segment_id, speaker_id, start_ms, end_ms, text and
diarization_quality. Neighbours are neighbours by seq, never by time. All windows share the partitioning by transcript,
so a chain of these operators shuffles once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config

def in_order():
    return Window.partitionBy("transcript_id").orderBy("seq")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """Stretches without white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def with_turn_taking(segments: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Adds overlap_with_prev_ms, gap_before_ms (bigint) and is_interruption."""
    prev = lambda c: F.lag(c).over(in_order())
    s = segments.withColumns(
        {
            "__delta": F.col("start_ms") - prev("end_ms"),
            "__other": F.col("speaker_id") != prev("speaker_id"),
            "__before": prev("end_ms") - prev("start_ms"),
        }
    )
    delta = F.col("__delta")
    cut_in = F.col("__other") & (-delta >= cfg.overlap_threshold_ms)
    rapid = (
        F.col("__other")
        & (delta <= cfg.rapid_switch_threshold_ms)
        & (F.col("__before") <= cfg.prev_short_turn_max_ms)
        & (F.col("end_ms") - F.col("start_ms") >= cfg.min_response_ms)
    )
    zero = F.lit(0).cast("bigint")
    return s.withColumns(
        {
            "overlap_with_prev_ms": F.when(delta < 0, -delta).otherwise(zero),
            "gap_before_ms": F.when(delta >= 0, delta).otherwise(zero),
            "is_interruption": F.coalesce(F.when(delta < 0, cut_in).otherwise(rapid), F.lit(False)),
        }
    ).drop("__delta", "__other", "__before")


def interruption_counts(annotated: DataFrame) -> DataFrame:
    """interruptions_made and interruptions_received per transcript and speaker that has any."""
    pairs = annotated.withColumn("previous", F.lag("speaker_id").over(in_order())).where("is_interruption")
    sides = F.array(
        F.struct(F.col("speaker_id").alias("speaker_id"), F.lit(1).alias("made"), F.lit(0).alias("received")),
        F.struct(F.col("previous").alias("speaker_id"), F.lit(0).alias("made"), F.lit(1).alias("received")),
    )
    each = pairs.select("transcript_id", F.inline(sides))
    return each.groupBy("transcript_id", "speaker_id").agg(
        F.sum("made").alias("interruptions_made"), F.sum("received").alias("interruptions_received")
    )


def find_gaps(segments: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Silences of min_gap_ms and more between neighbours."""
    nxt = lambda c: F.lead(c).over(in_order())
    out = segments.select(
        "transcript_id",
        F.col("segment_id").alias("after_segment_id"),
        nxt("segment_id").alias("before_segment_id"),
        F.col("speaker_id").alias("speaker_before"),
        nxt("speaker_id").alias("speaker_after"),
        F.col("end_ms").alias("gap_start_ms"),
        nxt("start_ms").alias("gap_end_ms"),
    )
    out = out.withColumn("duration_ms", F.col("gap_end_ms") - F.col("gap_start_ms"))
    return out.where(F.col("duration_ms") >= cfg.min_gap_ms)


def with_islands(segments: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Adds island: the number, within the transcript, of the merged turn that a segment belongs to.

    A segment joins the one before if the speaker is the same and it starts at most turn_gap_ms after the largest end so
    far of the same speaker's unbroken run. Segments must not end before they start.
    """
    s = segments.withColumn("__turn", (F.lag("speaker_id").over(in_order()) != F.col("speaker_id")).cast("int"))
    s = s.withColumn("__run", F.sum(F.coalesce("__turn", F.lit(0))).over(in_order()))
    in_run = Window.partitionBy("transcript_id", "__run").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("__reach", F.max("end_ms").over(in_run))
    cut = F.col("__reach").isNull() | (F.col("start_ms") - F.col("__reach") > cfg.turn_gap_ms)
    return s.withColumn("island", F.sum(cut.cast("bigint")).over(in_order())).drop("__turn", "__run", "__reach")


def fold_quality(parts: Column) -> Column:
    """Duration-weighted quality of structs (s, e, q) in order, each weighed against the hull so far; null absorbs."""
    length = lambda x: F.greatest(x["e"] - x["s"], F.lit(0).cast("bigint"))

    def step(a: Column, x: Column) -> Column:
        total = length(a) + length(x)
        q = F.when(total > 0, (a["q"] * length(a) + x["q"] * length(x)) / total)
        return F.struct(a["s"].alias("s"), F.greatest(a["e"], x["e"]).alias("e"), q.alias("q"))

    return F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), parts[0], step)["q"]


def fold_text(parts: Column) -> Column:
    """Texts joined by blanks, stripped after every step; a single text stays as it is."""
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.aggregate(rest, parts[0], lambda a, x: strip(F.concat(a, F.lit(" "), x)))


def merge_turns(segments: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One row per merged turn: the first segment's id, seq and start, the largest end, folded text and quality."""
    tagged = with_islands(segments, cfg)
    row = F.struct("seq", "segment_id", "speaker_id", "start_ms", "end_ms", "text", "diarization_quality")
    rows = tagged.groupBy("transcript_id", "island").agg(F.sort_array(F.collect_list(row)).alias("r"))
    span = F.transform("r", lambda x: F.struct(x["start_ms"].alias("s"), x["end_ms"].alias("e"), x["diarization_quality"].alias("q")))
    return rows.select(
        "transcript_id",
        "island",
        F.col("r")[0]["seq"].alias("seq"),
        F.col("r")[0]["segment_id"].alias("segment_id"),
        F.col("r")[0]["speaker_id"].alias("speaker_id"),
        F.col("r")[0]["start_ms"].alias("start_ms"),
        F.array_max(F.col("r.end_ms")).alias("end_ms"),
        fold_text(F.col("r.text")).alias("text"),
        fold_quality(span).alias("diarization_quality"),
        F.size("r").cast("bigint").alias("n_segments"),
    )


def even_words(segments: DataFrame) -> DataFrame:
    """A row per word: the segment's time in equal slices, cut to whole milliseconds; none where end <= start."""
    n = F.size("w")
    slice_ms = (F.col("end_ms") - F.col("start_ms")) / n
    each = segments.where("end_ms > start_ms").withColumn("w", tokens(F.col("text")))
    each = each.select("*", F.posexplode("w").alias("word_seq", "word"))
    return each.withColumns(
        {
            "word_start_ms": (F.col("start_ms") + F.col("word_seq") * slice_ms).cast("bigint"),
            "word_end_ms": (F.col("start_ms") + (F.col("word_seq") + 1) * slice_ms).cast("bigint"),
            "word_seq": F.col("word_seq").cast("bigint"),
        }
    ).drop("w")


def sessionise_words(words: DataFrame, by: list[str], cfg: Config = DEFAULT) -> DataFrame:
    """Adds session: from 1, a new one where a word starts more than word_gap_ms after the previous one's end."""
    w = Window.partitionBy(*by).orderBy("start_ms", "word_seq")
    cut = F.coalesce(F.col("start_ms") - F.lag("end_ms").over(w) > cfg.word_gap_ms, F.lit(True))
    return words.withColumn("__cut", cut.cast("bigint")).withColumn("session", F.sum("__cut").over(w)).drop("__cut")


def merge_dual_track(a: DataFrame, b: DataFrame) -> DataFrame:
    """Segments of two tracks in one order of start (ties: first track, then seq), renumbered fa-1, fa-2, ..."""
    both = a.withColumn("__track", F.lit(0)).unionByName(b.withColumn("__track", F.lit(1)))
    n = F.row_number().over(Window.partitionBy("transcript_id").orderBy("start_ms", "__track", "seq"))
    both = both.withColumn("position", n.cast("bigint"))
    return both.withColumn("segment_id", F.concat(F.lit("fa-"), F.col("position").cast("string"))).drop("__track")
