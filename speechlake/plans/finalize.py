"""From raw transcripts to enriched ones: the whole chain as lazy frames, written only when a caller writes them.

Order: collapse over-detected speakers, turn taking on the turns as they came, merge turns, then everything else on the
merged turns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import text as tx
from ..functions.scalars import public_json
from ..operators import identity, metrics, segments, voice
from ..sources.readers import raw_segments, raw_speakers


@dataclass
class Enriched:
    """Frames of enriched transcripts."""

    transcripts: DataFrame
    speakers: DataFrame
    segments: DataFrame
    metrics: DataFrame


#: What a caller may know of a transcript beside its raw form; carried as given, metadata without private keys.
DETAILS = [
    "recorded_at", "source_path", "source_url", "video_path", "source_metadata", "diarization_error_code", "diarization_error_detail", "content_audio_fp",
    "content_audio_fp_algorithm", "audio_format", "asr_backend", "diarization_backend", "vad_backend", "embedding_backend", "fingerprint_backend",
]


def finalize(
    raw: DataFrame, titles: DataFrame | None = None, library: DataFrame | None = None, cfg: Config = DEFAULT, details: DataFrame | None = None,
    voices: DataFrame | None = None, collapse: bool = True, expected_speakers: int | None = None, known: DataFrame | None = None,
) -> Enriched:
    """Enriches raw transcripts (schemas.RAW_TRANSCRIPT).

    titles: transcript_id, title. library: prints as identity.match_kinds takes them, with the model in `model`; without
    one, speakers stay unmatched. A transcript without speakers or segments has diarization_state incomplete. details:
    transcript_id and any of DETAILS, diarization_state and meeting_type; the last two win over what is found. voices:
    voice metrics per speaker, attached as cfg.voice_metrics says. expected_speakers bounds the speakers that are left;
    collapse=False leaves them as they came. Features that cfg turns off give zeros, empty lists or nulls. known:
    saved transcripts; those with the audio of one of them are left out.
    """
    if known is not None and details is not None and "content_audio_fp" in details.columns:
        old = known.where("content_audio_fp is not null").select("content_audio_fp").distinct()
        raw = raw.join(details.join(old, "content_audio_fp", "left_semi").select("transcript_id"), "transcript_id", "left_anti")
    seg, spk = raw_segments(raw), raw_speakers(raw)
    if collapse:
        kept = identity.collapse_speakers(spk, seg, cfg, expected_speakers)
        seg = seg.join(kept, ["transcript_id", "speaker_id"], "left").withColumn("speaker_id", F.coalesce("kept_id", "speaker_id")).drop("kept_id")
        spk = spk.join(kept.select("transcript_id", F.col("kept_id").alias("speaker_id")).distinct(), ["transcript_id", "speaker_id"], "left_semi")

    annotated = segments.with_turn_taking(seg, cfg)
    tagged = segments.with_islands(annotated, cfg)
    first = annotated.select("transcript_id", "seq", "overlap_with_prev_ms", "gap_before_ms", "is_interruption")
    if not cfg.enable_turn_taking:
        none = F.lit(0).cast("bigint")
        first = first.withColumns({"overlap_with_prev_ms": none, "gap_before_ms": none, "is_interruption": F.lit(False)})
    merged = segments.merge_turns(annotated, cfg).join(first, ["transcript_id", "seq"])
    words = tagged.select("transcript_id", "speaker_id", "island", "seq", F.posexplode("words").alias("word_seq", "w")).select(
        "transcript_id", "speaker_id", "island", "seq", F.col("word_seq").cast("bigint").alias("word_seq"), F.col("w.start_ms").alias("word_start_ms"),
        F.col("w.end_ms").alias("word_end_ms"), F.col("w.confidence").alias("confidence"),
    )
    sure = words.groupBy("transcript_id", "island").agg(F.avg("confidence").alias("asr_confidence"))
    merged = merged.join(sure, ["transcript_id", "island"], "left").withColumns({"fillers": tx.fillers(F.col("text")), "linguistic": tx.linguistic(F.col("text"))})
    if not cfg.enable_fillers:
        merged = merged.withColumn("fillers", F.array().cast("array<string>"))
    if not cfg.enable_linguistic:
        merged = merged.withColumn("linguistic", F.lit(None).cast(merged.schema["linguistic"].dataType))

    length = raw.select("transcript_id", "duration_ms")
    talk = metrics.talk_time(merged).join(metrics.word_counts(merged), metrics.KEYS).join(length, "transcript_id", "left")
    ratio = F.when(F.col("duration_ms") > 0, F.col("talk_time_ms") / F.col("duration_ms")).otherwise(0.0)
    talk = talk.select(*metrics.KEYS, "talk_time_ms", ratio.alias("talk_ratio"), "word_count", metrics.per_minute(F.col("word_count"), F.col("talk_time_ms")).alias("wpm"))
    for part in (metrics.pause_profile(words, cfg), metrics.filler_rates(merged), segments.interruption_counts(merged)):
        talk = talk.join(part, metrics.KEYS, "left")
    numbers = ["pause_count", "avg_pause_ms", "filler_count", "filler_rate", "interruptions_made", "interruptions_received"]
    talk = talk.fillna(0, numbers)
    if not cfg.enable_fillers:
        talk = talk.withColumns({"filler_count": F.lit(0).cast("bigint"), "filler_rate": F.lit(0.0)})
    if voices is not None:
        talk = voice.attach(talk, voices, cfg.voice_metrics)

    if library is not None:
        model = F.element_at("model_versions", "embedding")
        spoken = metrics.talk_time(merged).withColumnRenamed("talk_time_ms", "duration_ms")
        s = spk.join(raw.select("transcript_id", model.alias("model")), "transcript_id").join(spoken, metrics.KEYS, "left")
        s = s.withColumn("speaker_key", F.concat_ws("\x1f", "transcript_id", "speaker_id"))
        s = identity.match_kinds(s, library, cfg)
        names = library.select(F.col("fingerprint_id").alias("matched_id"), F.col("display_name").alias("print_name"))
        s = s.join(names, "matched_id", "left").withColumn("display_name", F.coalesce("display_name", "print_name"))
        spk = s.drop("print_name", "speaker_key")

    whole = merged.groupBy("transcript_id").agg(F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("t"), F.count(F.lit(1)).alias("n_segments"))
    whole = whole.select("transcript_id", "n_segments", F.array_join(F.col("t.text"), " ").alias("t"))
    kinds = tx.meeting_types(merged, titles)
    t = raw.select("transcript_id", "duration_ms", "language", "engine").join(whole, "transcript_id", "left").join(kinds, "transcript_id", "left")
    n = spk.groupBy("transcript_id").agg(F.count(F.lit(1)).alias("n_speakers"))
    t = t.join(n, "transcript_id", "left").fillna(0, ["n_segments", "n_speakers"])
    state = F.when((F.col("n_segments") > 0) & (F.col("n_speakers") > 0), "ok").otherwise("incomplete")
    t = t.withColumns({"diarization_state": state, "meeting_type": F.coalesce("meeting_type", F.lit("unknown")), "confidence": F.coalesce("confidence", F.lit(0.0))})
    t = t.withColumn("content_text_simhash", tx.text_signature(F.col("t"))).drop("t")
    if not cfg.enable_meeting_type:
        t = t.withColumns({"meeting_type": F.lit("unknown"), "confidence": F.lit(0.0)})
    if details is not None:
        t = _with_details(t, details)
    return Enriched(t, spk, merged, talk)


def _with_details(t: DataFrame, details: DataFrame) -> DataFrame:
    given = [c for c in DETAILS if c in details.columns]
    forced = {c: f"__{c}" for c in ("diarization_state", "meeting_type") if c in details.columns}
    d = details.select("transcript_id", *given, *[F.col(c).alias(n) for c, n in forced.items()])
    out = t.join(d, "transcript_id", "left")
    if "source_metadata" in given:
        out = out.withColumn("source_metadata", public_json("source_metadata"))
    if "meeting_type" in forced:
        out = out.withColumn("confidence", F.when(F.col("__meeting_type").isNotNull(), 1.0).otherwise(F.col("confidence")))
    return out.withColumns({c: F.coalesce(n, c) for c, n in forced.items()}).drop(*forced.values())


def model_versions(engine, raw_versions, asr: str, diarization: str, vad: str, embedding: str, fingerprint: str):
    """The versions of a transcript's models: defaults for known engines, then the raw ones; a blank embedding counts as none."""
    from pyspark.sql import functions as F

    ours = F.create_map(*[F.lit(x) for kv in {"asr": asr, "diarization": diarization, "vad": vad, "embedding": embedding, "fingerprint": fingerprint}.items() for x in kv])
    base = F.when(engine.startswith("fluidaudio"), ours).otherwise(F.create_map().cast("map<string,string>"))
    given = F.map_filter(F.coalesce(raw_versions, F.create_map().cast("map<string,string>")), lambda k, v: (k != "embedding") | (F.btrim(v) != ""))
    fresh = F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(given), k))
    return F.map_concat(fresh, given)
