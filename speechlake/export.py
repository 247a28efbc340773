"""Renderings of transcripts: JSON lines, CSV rows, text; and the message that tells of a new one."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.text import timestamp

# The columns of the CSV export in their order, those of the full one, and the details of exports.
DETAILS = ("minimal", "standard", "full")
ACOUSTIC = ["articulation_rate", "f0_mean_hz", "f0_stdev_hz", "jitter_local", "shimmer_local", "voiced_duration_s"]
CSV_FIELDS = [
    "transcript_id", "speaker_id", "speaker_name", "fingerprint_id", "match_kind", "match_similarity", "match_second_similarity",
    "match_margin", "match_similarity_threshold", "match_embedding_model", "talk_time_ms", "talk_ratio", "word_count", "wpm", "pause_count",
    "avg_pause_ms", "filler_count", "filler_rate", "interruptions_made", "interruptions_received",
]


#: A segment's fields that say what it is; the rest of the enrichment columns follow at standard and full detail.
MATCH = ["match_kind", "match_similarity", "match_second_similarity", "match_margin", "match_similarity_threshold", "match_embedding_model"]
ENRICHMENT = ["overlap_with_prev_ms", "gap_before_ms", "is_interruption", "fillers", "linguistic"]


def _checked(detail: str) -> None:
    if detail not in DETAILS:
        raise ValueError(f"unknown detail: {detail}")


def speaker_name() -> Column:
    """Name, else print, else id; an empty one counts as none."""
    full = lambda c: F.when(F.col(c) != "", F.col(c))
    return F.coalesce(full("display_name"), full("fingerprint_id"), F.col("speaker_id"))


def jsonl(segments: DataFrame, speakers: DataFrame, detail: str = "standard") -> DataFrame:
    """(transcript_id, seq, line): a JSON object per segment, nulls included, with its speaker's print, name and match.

    standard adds the enrichment, full also the words; what the segments don't have is null or left out of these.
    """
    _checked(detail)
    known = lambda df, c, kind="string": F.col(c) if c in df.columns else F.lit(None).cast(kind)
    of = {"speaker_fingerprint_id": "fingerprint_id", "speaker_display_name": "display_name", **{f"speaker_{c}": c for c in MATCH}}
    s = speakers.select("transcript_id", "speaker_id", *[known(speakers, c).alias(name) for name, c in of.items()])
    out = segments.join(s, ["transcript_id", "speaker_id"], "left")
    fields = [F.col(c) for c in ("transcript_id", "segment_id", "speaker_id", "start_ms", "end_ms", "text")]
    fields += [known(segments, c, "double").alias(c) for c in ("asr_confidence", "diarization_quality")] + [F.col(c) for c in of]
    if detail == "full" and "words" in segments.columns:
        fields.append(F.col("words"))
    enrichment = [c for c in ENRICHMENT if c in segments.columns]
    if detail != "minimal" and enrichment:
        fields.append(F.struct(*enrichment).alias("enrichment"))
    return out.select("transcript_id", "seq", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("line"))


def raw_documents(raw: DataFrame, speakers: DataFrame, detail: str = "standard") -> DataFrame:
    """(transcript_id, document): raw transcripts as JSON, their speakers with the print, name and match that were found.

    raw: a row per transcript as schemas.RAW_TRANSCRIPT. A speaker's keys without value are left out, a segment's are
    null; embeddings and words come with full detail only. A segment's missing confidence is the mean of its words'.
    """
    _checked(detail)
    full = detail == "full"
    found = speakers.select("transcript_id", F.struct("speaker_id", *[F.col(c) if c in speakers.columns else F.lit(None).cast("string").alias(c) for c in ("fingerprint_id", "display_name", "match_kind")]).alias("f"))
    out = raw.join(found.groupBy("transcript_id").agg(F.collect_list("f").alias("found")), "transcript_id", "left")

    def speaker(s: Column) -> Column:
        f = F.get(F.filter("found", lambda x: x["speaker_id"] == s["speaker_id"]), F.lit(0))
        fields = [s["speaker_id"].alias("speaker_id"), F.coalesce(f["fingerprint_id"], s["fingerprint_id"]).alias("fingerprint_id"), F.coalesce(f["display_name"], s["display_name"]).alias("display_name"), f["match_kind"].alias("match_kind")]
        return F.to_json(F.struct(*fields, *([s["embedding"].alias("embedding")] if full else [])))

    def segment(s: Column) -> Column:
        sure = F.filter(F.transform(s["words"], lambda w: w["confidence"]), lambda c: c.isNotNull())
        mean = F.when(F.size(sure) > 0, F.aggregate(sure, F.lit(0.0), lambda a, c: a + c) / F.size(sure))
        fields = [s[c].alias(c) for c in ("segment_id", "speaker_id", "start_ms", "end_ms", "text")]
        fields += [F.coalesce(s["asr_confidence"], mean).alias("asr_confidence"), s["diarization_quality"].alias("diarization_quality")]
        return F.to_json(F.struct(*fields, *([s["words"].alias("words")] if full else [])), {"ignoreNullFields": "false"})

    head = F.to_json(F.struct("duration_ms", "language", "engine"), {"ignoreNullFields": "false"})
    rows = lambda c, f: F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(c, F.array()), f), ","), F.lit("]"))
    body = F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"speakers":'), rows(F.col("speakers"), speaker), F.lit(',"segments":'), rows(F.col("segments"), segment), F.lit("}"))
    return out.select("transcript_id", body.alias("document"))


def csv_rows(metrics: DataFrame, speakers: DataFrame, full: bool = False) -> DataFrame:
    """A row per speaker metric with the columns of the CSV export; absent ones are null."""
    s = speakers.select("transcript_id", "speaker_id", *[c for c in speakers.columns if c not in metrics.columns])
    out = metrics.join(s, ["transcript_id", "speaker_id"], "left")
    for c in ("display_name", "fingerprint_id"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    out = out.withColumn("speaker_name", speaker_name())
    names = CSV_FIELDS + ACOUSTIC * full
    return out.select(*[F.col(c) if c in out.columns else F.lit(None).cast("string").alias(c) for c in names])


def text_lines(annotated: DataFrame, speakers: DataFrame) -> DataFrame:
    """(transcript_id, seq, header, line): a header where the speaker changes among lines that are shown."""
    s = annotated.join(speakers.select("transcript_id", "speaker_id", "display_name", "fingerprint_id"), ["transcript_id", "speaker_id"], "left")
    s = s.withColumn("shown", F.regexp_replace("text", r"(?U)^\s+|\s+$", "")).where("shown <> ''")
    before = F.lag("speaker_id").over(Window.partitionBy("transcript_id").orderBy("seq"))
    header = F.when(~before.eqNullSafe(F.col("speaker_id")), F.concat(F.lit("["), timestamp(F.col("start_ms")), F.lit("] "), speaker_name()))
    line = F.concat(F.when(F.col("is_interruption"), "  [INT] ").otherwise("  "), F.col("shown"))
    return s.select("transcript_id", "seq", header.alias("header"), line.alias("line"))


def plain_number(x: Column) -> Column:
    """A double as text, without an exponent from 0.0001 up to 1e16, else with one as in 1e-05 and 1.5e+16; nan, inf, -inf."""
    shown = x.cast("string")
    plain = F.regexp_replace(shown.cast("decimal(38,20)").cast("string"), "0+$", "")
    digits = F.regexp_replace(F.regexp_extract(shown, "E-?(.*)$", 1), "^([0-9])$", "0$1")
    power = F.concat(F.regexp_extract(shown, r"^(.*?)(\.0)?E", 1), F.when(shown.contains("E-"), "e-").otherwise("e+"), digits)
    odd = F.replace(F.lower(shown), F.lit("infinity"), F.lit("inf"))
    size = F.abs(x)
    out = F.when(F.isnan(x) | (size == float("inf")), odd).when(~shown.contains("E"), shown)
    return out.when((size >= 1e-4) & (size < 1e16), F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)).otherwise(power)


def csv_text(rows: DataFrame) -> DataFrame:
    """(transcript_id, document): the CSV of each transcript, a header and a row per speaker by id, lines ended by CR LF."""
    number = {f.name for f in rows.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    plain = [F.coalesce(plain_number(F.col(c)) if c in number else F.col(c).cast("string"), F.lit("")) for c in rows.columns]
    cell = lambda x: F.when(x.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)
    line = rows.select("transcript_id", "speaker_id", F.concat_ws(",", *map(cell, plain)).alias("line"))
    lines = line.groupBy("transcript_id").agg(F.sort_array(F.collect_list(F.struct("speaker_id", "line"))).alias("l"))
    text = F.concat_ws("\r\n", F.lit(",".join(rows.columns)), F.transform("l", lambda x: x["line"]))
    return lines.select("transcript_id", text.alias("document"))


def _speaker_lines(metrics: DataFrame, speakers: DataFrame, line: Column) -> DataFrame:
    """(transcript_id, lines): a line per speaker, who talked most first, then by id."""
    out = metrics.join(speakers.select("transcript_id", "speaker_id", "display_name", "fingerprint_id"), ["transcript_id", "speaker_id"], "left")
    rows = out.select("transcript_id", F.struct((-F.col("talk_ratio")).alias("r"), "speaker_id", line.alias("line")).alias("x"))
    return rows.groupBy("transcript_id").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]).alias("lines"))


def _spoken_lines(annotated: DataFrame, speakers: DataFrame, head, line) -> DataFrame:
    """(transcript_id, spoken): lines of the segments in order, each run of a speaker under its head."""
    rows = text_lines(annotated, speakers)
    at = rows.select("transcript_id", F.struct("seq", F.when(F.col("header").isNotNull(), F.concat(head(F.col("header")), line(F.col("line")))).otherwise(line(F.col("line"))).alias("line")).alias("x"))
    return at.groupBy("transcript_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]), "\n").alias("spoken"))


def _told(c: str, shape: str, metrics: DataFrame, zero_is_none: bool = True) -> Column:
    if c not in metrics.columns:
        return F.lit("-")
    some = F.col(c).isNotNull() & (F.col(c) != 0 if zero_is_none else F.lit(True))
    return F.when(some, F.format_string(shape, F.col(c))).otherwise("-")


def text_documents(transcripts: DataFrame, annotated: DataFrame, metrics: DataFrame, speakers: DataFrame, detail: str = "standard") -> DataFrame:
    """(transcript_id, document): a readable transcript with a head, a table of speakers and the spoken lines."""
    _checked(detail)
    line = F.concat(F.lit("  "), speaker_name(), F.format_string(": %.1f%% | %d words | %.0f wpm", F.col("talk_ratio") * 100, "word_count", "wpm"))
    if detail == "full":
        line = F.concat(line, F.lit(" | f0="), _told("f0_mean_hz", "%.0fHz", metrics), F.lit(" | ar="), _told("articulation_rate", "%.1f", metrics), F.lit(" | jitter="), _told("jitter_local", "%.4f", metrics, False))
    if detail != "minimal":
        line = F.concat(line, F.format_string(" | fillers=%d | interruptions=%d/%d", "filler_count", "interruptions_made", "interruptions_received"))
    wide, narrow = "=" * 70, "-" * 40
    spoken = _spoken_lines(annotated, speakers, lambda h: F.concat(F.lit("\n"), h, F.lit("\n")), lambda x: x)
    out = transcripts.join(_speaker_lines(metrics, speakers, line), "transcript_id", "left").join(spoken, "transcript_id", "left")
    head = F.concat(F.format_string("%.1f min | ", F.col("duration_ms") / 60000), F.coalesce(F.col("engine") if "engine" in transcripts.columns else F.lit(None).cast("string"), F.lit("-")))
    parts = F.flatten(F.array(
        F.array(F.lit(wide), F.col("transcript_id"), head, F.lit(wide), F.lit(""), F.lit("SPEAKERS"), F.lit(narrow)), F.coalesce("lines", F.array().cast("array<string>")),
        F.array(F.lit(""), F.lit("TRANSCRIPT"), F.lit(narrow)), F.when(F.col("spoken").isNotNull(), F.array("spoken")).otherwise(F.array().cast("array<string>")),
    ))
    return out.select("transcript_id", F.array_join(parts, "\n").alias("document"))


def markdown_documents(transcripts: DataFrame, annotated: DataFrame, metrics: DataFrame, speakers: DataFrame, detail: str = "standard") -> DataFrame:
    """(transcript_id, document): the transcript as Markdown; speakers as a list, a heading where the speaker changes."""
    _checked(detail)
    line = F.concat(F.lit("- **"), speaker_name(), F.format_string("**: %.1f%% talk, %d words, %.0f wpm", F.col("talk_ratio") * 100, "word_count", "wpm"))
    if detail == "full":
        line = F.concat(line, F.lit(", f0 "), _told("f0_mean_hz", "%.0fHz", metrics), F.lit(", jitter "), _told("jitter_local", "%.4f", metrics, False))
    elif detail == "standard":
        line = F.concat(line, F.format_string(", fillers %d", "filler_count"))
    heading = lambda h: F.concat(F.lit("### "), F.regexp_replace(h, r"^\[([0-9:]+)\]", "$1"), F.lit("\n"))
    spoken = _spoken_lines(annotated, speakers, heading, lambda x: F.concat(F.regexp_replace(F.regexp_replace(x, "^ {2}", ""), r"^\[INT\] ", "**[INT]** "), F.lit("\n")))
    out = transcripts.join(_speaker_lines(metrics, speakers, line), "transcript_id", "left").join(spoken, "transcript_id", "left")
    value = lambda c: F.coalesce(F.col(c).cast("string") if c in transcripts.columns else F.lit(None).cast("string"), F.lit("-"))
    parts = F.flatten(F.array(
        F.array(F.concat(F.lit("# Transcript "), "transcript_id"), F.lit(""), F.concat(F.lit("- Engine: `"), value("engine"), F.lit("`")), F.format_string("- Duration: `%.1fs`", F.col("duration_ms") / 1000),
                F.concat(F.lit("- Meeting type: `"), value("meeting_type"), F.lit("`")), F.lit(""), F.lit("## Speakers"), F.lit("")),
        F.coalesce("lines", F.array().cast("array<string>")), F.array(F.lit(""), F.lit("## Transcript"), F.lit(""), F.coalesce("spoken", F.lit(""))),
    ))
    return out.select("transcript_id", F.regexp_replace(F.array_join(parts, "\n"), r"\s+$", "").alias("document"))


def fingerprint_lines(library: DataFrame) -> DataFrame:
    """(fingerprint_id, line): the library as JSON lines by id, nulls included."""
    return library.select("fingerprint_id", F.to_json(F.struct(*library.columns), {"ignoreNullFields": "false"}).alias("line")).orderBy("fingerprint_id")


def rendered(fmt: str, tables: dict[str, DataFrame], detail: str = "standard") -> DataFrame:
    """One of the formats json, raw-json, jsonl, csv, text, markdown from the tables raw, transcripts, speakers, segments
    (with turn taking) and metrics."""
    _checked(detail)
    t = tables
    makers = {
        "json": lambda: documents(t["transcripts"], t["segments"], t["metrics"], detail),
        "raw-json": lambda: raw_documents(t["raw"], t["speakers"], detail),
        "jsonl": lambda: jsonl(t["segments"], t["speakers"], detail),
        "csv": lambda: csv_text(csv_rows(t["metrics"], t["speakers"], detail == "full")),
        "text": lambda: text_documents(t["transcripts"], t["segments"], t["metrics"], t["speakers"], detail),
        "markdown": lambda: markdown_documents(t["transcripts"], t["segments"], t["metrics"], t["speakers"], detail),
    }
    if fmt not in makers:
        raise ValueError(f"unknown format: {fmt}; known: {', '.join(makers)}")
    return makers[fmt]()


def documents(transcripts: DataFrame, segments: DataFrame, metrics: DataFrame, detail: str = "full") -> DataFrame:
    """(transcript_id, document): the whole transcript as JSON; minimal has no metrics, only full has acoustic ones."""
    _checked(detail)
    rows = lambda df, order: df.groupBy("transcript_id").agg(
        F.sort_array(F.collect_list(F.struct(order, *[c for c in df.columns if c not in (order, "transcript_id")]))).alias("rows")
    )
    seg = rows(segments, "seq").withColumnRenamed("rows", "segments")
    m = metrics if detail == "full" else metrics.drop(*ACOUSTIC)
    met = rows(m, "speaker_id").withColumnRenamed("rows", "speaker_metrics")
    out = transcripts.join(seg, "transcript_id", "left").join(met, "transcript_id", "left")
    if detail == "minimal":
        out = out.drop("speaker_metrics")
    return out.select("transcript_id", F.to_json(F.struct(*out.columns), {"ignoreNullFields": "false"}).alias("document"))


# What a segment's enrichment holds, and the metadata that a minimal document keeps where it's known.
SEGMENT_ENRICHMENT = ["sentiment", "sentiment_confidence", "tone_tags", "is_interruption", "overlap_with_prev_ms", "gap_before_ms", "fillers", "linguistic"]
MINIMAL_METADATA = ["source_path", "source_url", "duration_ms", "language", "meeting_type", "recorded_at", "engine", "diarization_state"]


def transcript_documents(transcripts: DataFrame, speakers: DataFrame, segments: DataFrame, metrics: DataFrame, detail: str = "full") -> DataFrame:
    """(transcript_id, document): each transcript as one JSON object of transcript_id, metadata, speakers, segments and
    speaker_metrics.

    All columns of transcripts but the id and those of raw JSON are metadata; speakers come by ord (or id), segments by
    seq, metrics by speaker. full: everything, nulls included. standard: segments without words, metrics without acoustic
    values. minimal: segments without enrichment, too, no metrics, and of the metadata what MINIMAL_METADATA names and is
    known. Transcripts without rows in a table have an empty array there.
    """
    _checked(detail)

    def listed(df: DataFrame, order: str, drop: list[str], name: str, nested: list[str] = ()) -> DataFrame:
        inner = [c for c in nested if c in df.columns]
        plain = [c for c in df.columns if c not in {"transcript_id", *drop, *inner}]
        fields = [F.col(f"`{c}`") for c in plain] + ([F.struct(*inner).alias("enrichment")] if inner else [])
        rows = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("__order"), F.struct(*fields).alias("row")))), lambda x: x["row"])
        return df.groupBy("transcript_id").agg(F.to_json(rows, {"ignoreNullFields": "false"}).alias(name))

    less, minimal = detail != "full", detail == "minimal"
    known = [c for c in transcripts.columns if c not in ("transcript_id", "raw_json", "raw_transcript_json") and (not minimal or c in MINIMAL_METADATA)]
    if minimal:
        known = [c for c in MINIMAL_METADATA if c in known]
    metadata = F.to_json(F.struct(*[F.col(f"`{c}`") for c in known]), {"ignoreNullFields": str(minimal).lower()}) if known else F.lit("{}")
    out = transcripts.select("transcript_id", metadata.alias("metadata"))
    tables = {
        "speakers": listed(speakers, "ord" if "ord" in speakers.columns else "speaker_id", ["ord"], "speakers"),
        "segments": listed(segments, "seq", ["seq"] + ["words"] * less + SEGMENT_ENRICHMENT * minimal, "segments", [] if minimal else SEGMENT_ENRICHMENT),
    }
    if not minimal:
        tables["speaker_metrics"] = listed(metrics, "speaker_id", ACOUSTIC * less, "speaker_metrics")
    parts = [F.lit('{"transcript_id":'), F.to_json(F.array("transcript_id")).substr(F.lit(2), F.length(F.to_json(F.array("transcript_id"))) - 2), F.lit(',"metadata":'), F.col("metadata")]
    for name in ("speakers", "segments", "speaker_metrics"):
        if name in tables:
            out = out.join(tables[name], "transcript_id", "left")
        parts += [F.lit(f',"{name}":'), F.coalesce(F.col(name) if name in tables else F.lit("[]"), F.lit("[]"))]
    return out.select("transcript_id", F.concat(*parts, F.lit("}")).alias("document"))


def emit_reason(enabled: Column, url: Column, secret: Column, n_segments: Column, degraded: Column, state: Column) -> Column:
    """Why a message would not be sent, or ok."""
    blank = lambda c: F.coalesce(c == "", F.lit(True))
    low = F.lower(F.coalesce(state, F.lit("")))
    return (
        F.when(~F.coalesce(enabled, F.lit(False)), "disabled")
        .when(blank(url), "missing-url")
        .when(blank(secret), "missing-secret")
        .when(n_segments == 0, "no-segments")
        .when(degraded, "ok")
        .when((low == "incomplete") | low.startswith("failed"), F.concat(F.lit("diarization-"), low))
        .otherwise("ok")
    )


def payload(store: str) -> Column:
    """The message of a ready transcript, its keys in fixed order."""
    ref = F.concat(F.lit(f"{store}#"), F.col("transcript_id"))
    fields = [F.lit("meeting.transcript.ready").alias("event"), F.col("transcript_id"), F.lit("speechlake").alias("source"), F.col("recorded_at"), ref.alias("store_ref")]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def signature(body: Column, secret: str) -> Column:
    """sha256= and the HMAC of the body."""

    @F.pandas_udf(T.StringType())
    def sign(x: pd.Series) -> pd.Series:
        return x.map(lambda b: None if b is None else "sha256=" + hmac.new(secret.encode(), b.encode(), hashlib.sha256).hexdigest())

    return sign(body)
