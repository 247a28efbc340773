"""Output of speech engines: checked JSON, diarization spans, words and spans to transcripts, and the engines by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import blank_to_null
from ..operators import ranges, vectors
from ..operators.vectors import clean_vector

ENGINES: dict[str, Callable[..., DataFrame]] = {}


def engine(name: str):
    """Registers a function that makes segments of an engine's output tables."""

    def add(f):
        ENGINES[name] = f
        return f

    return add


def engine_named(name: str) -> Callable[..., DataFrame]:
    if name not in ENGINES:
        raise ValueError(f"unknown engine: {name}; known: {', '.join(sorted(ENGINES))}")
    return ENGINES[name]


def problem(text: Column, producer: str, required: tuple[str, ...] = ()) -> Column:
    """Why text isn't the JSON object that a tool should give; null if it is."""
    parsed = F.try_parse_json(text)
    kind = F.schema_of_variant(parsed)
    keys = F.json_object_keys(text)
    # The messages.
    missing = F.filter(F.array(*map(F.lit, required)) if required else F.array().cast("array<string>"), lambda k: ~F.array_contains(keys, k))
    return (
        F.when(text.isNull(), f"{producer} did not produce JSON output")
        .when(F.btrim(text, F.lit(" \t\r\n")) == "", f"{producer} produced empty JSON")
        .when(parsed.isNull(), f"{producer} produced invalid JSON")
        .when(~kind.startswith("OBJECT"), f"{producer} produced non-object JSON")
        .when(F.size(missing) > 0, F.concat(F.lit(f"{producer} JSON is missing required key(s): "), F.array_join(missing, ", ")))
    )


def checked_json(df: DataFrame, producer: str, ddl: str, required: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """df with the struct `value` of its JSON; a row whose text has a problem raises it when it is read."""
    why = problem(F.col(text), producer, required)
    sound = F.when(why.isNotNull(), F.raise_error(why).cast("string")).otherwise(F.col(text))
    return df.withColumn("value", F.from_json(sound, ddl))


def json_files(spark: SparkSession, path: str, producer: str, ddl: str, required: tuple[str, ...] = ()) -> DataFrame:
    """(path, value) of whole files."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return checked_json(files, producer, ddl, required).select("path", "value")


def span_documents(tracks: DataFrame, embeddings: DataFrame | None = None) -> DataFrame:
    """Diarization tracks (transcript_id, label, start_s, end_s) as spans: transcript_id, span_idx, speaker, speaker_index,
    start_s, end_s, duration_s, to three digits, by start; with embeddings (transcript_id, label, embedding) the speaker's.

    Speakers are numbered by label. An embedding that is empty or not finite is null.
    """
    labels = tracks.select("transcript_id", "label").distinct()
    index = (F.row_number().over(Window.partitionBy("transcript_id").orderBy("label")) - 1).cast("int")
    labels = labels.withColumn("speaker_index", index)
    t = tracks.join(labels, ["transcript_id", "label"])
    if embeddings is not None:
        t = t.join(embeddings.select("transcript_id", "label", clean_vector(F.col("embedding")).alias("embedding")), ["transcript_id", "label"], "left")
    r = lambda c: F.round(c, 3)
    t = t.withColumns({"duration_s": r(F.col("end_s") - F.col("start_s")), "start_s": r("start_s"), "end_s": r("end_s"), "speaker": F.concat(F.lit("Speaker "), F.col("speaker_index").cast("string"))})
    order = Window.partitionBy("transcript_id").orderBy("start_s", "end_s", "speaker_index")
    t = t.withColumn("span_idx", (F.row_number().over(order) - 1).cast("bigint"))
    return t.select("transcript_id", "span_idx", "speaker", "speaker_index", "start_s", "end_s", "duration_s", *(["embedding"] if embeddings is not None else []))


def aligned_embeddings(labels: DataFrame, matrix: DataFrame) -> DataFrame:
    """(transcript_id, label, embedding): row i of matrix (transcript_id, i, embedding) is that of the i-th label by name."""
    i = F.row_number().over(Window.partitionBy("transcript_id").orderBy("label")) - 1
    named = labels.select("transcript_id", "label").distinct().withColumn("i", i)
    out = named.join(matrix.select("transcript_id", "i", clean_vector(F.col("embedding")).alias("embedding")), ["transcript_id", "i"])
    return out.where("embedding is not null").drop("i")


def duration_or_last(duration_ms: Column, last_end_ms: Column) -> Column:
    """The engine's duration, or where that is 0 or missing the end of the last segment, else 0."""
    return F.coalesce(F.nullif(duration_ms, F.lit(0).cast("long")), last_end_ms, F.lit(0).cast("long"))


def speakers_of(spans: DataFrame) -> DataFrame:
    """(transcript_id, speaker_id, embedding): mean embedding of each speaker's spans, null without any.

    spans: transcript_id, speakerId, embedding (others ignored). Where a transcript has embeddings at all, speakers
    without one are left out.
    """
    s = spans.select("transcript_id", F.col("speakerId").alias("speaker_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    mean = vectors.vector_mean(s.where("size(embedding) > 0"), ["transcript_id", "speaker_id"])
    mean = mean.groupBy("transcript_id", "speaker_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "mean"))), lambda x: x["mean"]).alias("embedding"))
    some = mean.select("transcript_id").distinct()
    silent = s.select("transcript_id", "speaker_id").distinct().join(some, "transcript_id", "left_anti")
    return mean.unionByName(silent.withColumn("embedding", F.lit(None).cast("array<double>")))


@engine("words-and-spans")
def words_and_spans(words: DataFrame, spans: DataFrame) -> DataFrame:
    """Segments (transcript_id, span_idx, label, text, n_words, times of the span) of word timings and diarization spans.

    words: transcript_id, word_id, word, start_s, end_s; spans: transcript_id, span_idx, label, start_s, end_s.
    """
    return ranges.span_texts(words, ranges.words_to_spans(words, spans), spans)


@engine("hybrid")
def hybrid(words: DataFrame, spans: DataFrame, process: DataFrame) -> DataFrame:
    """words_and_spans with the speakers and quality of a second diarization (process: also quality), by overlap."""
    segments = words_and_spans(words, spans)
    speaker = ranges.overlap_map(spans, process).drop("seconds")
    quality = ranges.overlap_quality(spans, process).select("transcript_id", "span_idx", "quality")
    out = segments.join(speaker, ["transcript_id", "label"], "left").join(quality, ["transcript_id", "span_idx"], "left")
    return out.withColumn("speaker", F.coalesce("speaker", "label"))


def metadata(df: DataFrame, text: str = "text") -> DataFrame:
    """df with `metadata`, the text if it is a JSON object; null and '' give {}, anything else raises."""
    why = problem(F.col(text), "source metadata")
    value = F.when(blank_to_null(F.col(text)).isNull(), F.lit("{}")).when(why.isNotNull(), F.raise_error(F.lit("source metadata must be a JSON object")).cast("string"))
    return df.withColumn("metadata", value.otherwise(F.col(text)))
