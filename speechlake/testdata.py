"""Deterministic adapters from the generic tables to the speech schemas, by integer arithmetic.

SEGMENTS_SQL and the others state the same frames for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators.segments import even_words


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seasoned(text):
    """Some frequent words become fillers and causal words, so that the lexicons find something."""
    swap = lambda x: F.when(x == "the", "um").when(x == "of", "like").when(x == "to", "because").otherwise(x)
    return F.array_join(F.transform(F.split(text, " "), swap), " ")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segment per line of a turn, timed by its words, with overlaps, quick switches and silences."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    lines = c.select("conv_id", "turn", "role", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    lines = lines.where(F.trim("text") != "")
    n = F.greatest(F.size(F.filter(F.split("text", " "), lambda x: x != "")), F.lit(1)).cast("bigint")
    order = Window.partitionBy("conv_id").orderBy("turn", "line")
    gap = (31 * F.col("conv_id") + 17 * F.col("turn") + 7 * F.col("line")) % 23 * 100 - 600
    s = lines.withColumns({"dur": 320 * n, "gap": gap})
    before = F.coalesce(F.sum(F.col("dur") + F.col("gap")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = s.withColumns({"start_ms": (before + 5000).cast("bigint"), "seq": (F.row_number().over(order) - 1).cast("bigint")})
    text = F.concat(seasoned(F.col("text")), F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, " you know next steps").otherwise(""))
    quality = F.when(F.col("seq") % 6 != 0, (F.col("conv_id") * 7 + F.col("seq") * 13) % 100 / 100.0)
    return s.select(
        "conv_id", "turn", "role", F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("transcript_id"), "seq",
        F.concat(F.lit("seg-"), F.col("seq").cast("string")).alias("segment_id"),
        F.concat("role", F.lit("-"), (F.col("turn") % 3).cast("string")).alias("speaker_id"),
        "start_ms", (F.col("start_ms") + F.col("dur")).alias("end_ms"), text.alias("text"), quality.alias("diarization_quality"),
    )


SEGMENTS_SQL = """
seg_p AS (SELECT conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS parts FROM conversations),
seg_l AS (SELECT conv_id, turn, role, parts, unnest(range(len(parts))) AS line FROM seg_p),
seg_t AS (SELECT conv_id, turn, role, line, parts[line + 1] AS text FROM seg_l WHERE trim(parts[line + 1]) <> ''),
seg_d AS (SELECT *, 320 * greatest(len(list_filter(string_split(text, ' '), lambda x: x <> '')), 1) AS dur, (31 * conv_id + 17 * turn + 7 * line) % 23 * 100 - 600 AS gap FROM seg_t),
seg_s AS (SELECT *, CAST(5000 + coalesce(sum(dur + gap) OVER (PARTITION BY conv_id ORDER BY turn, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms,
  CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, line) - 1 AS BIGINT) AS seq FROM seg_d),
segments AS (SELECT conv_id, turn, role, 'conv-' || conv_id AS transcript_id, seq, 'seg-' || seq AS segment_id, role || '-' || (turn % 3) AS speaker_id, start_ms, CAST(start_ms + dur AS BIGINT) AS end_ms,
  array_to_string(list_transform(string_split(text, ' '), lambda x: CASE x WHEN 'the' THEN 'um' WHEN 'of' THEN 'like' WHEN 'to' THEN 'because' ELSE x END), ' ')
    || CASE WHEN (conv_id + turn) % 5 = 0 THEN ' you know next steps' ELSE '' END AS text,
  CASE WHEN seq % 6 <> 0 THEN ((conv_id * 7 + seq * 13) % 100) / 100.0::DOUBLE END AS diarization_quality FROM seg_s)"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in even slices; every seventh starts 300 ms late; some confidences unknown."""
    w = even_words(segments(spark, sf_dir))
    late = F.when(F.col("word_seq") % 7 == 6, F.lit(300)).otherwise(F.lit(0))
    known = F.when(F.col("word_seq") % 11 != 0, F.col("word_seq") * 13 % 100 / 100.0)
    return w.withColumn("word_start_ms", F.col("word_start_ms") + late).withColumn("confidence", known).drop("text", "diarization_quality")


WORDS_SQL = SEGMENTS_SQL + r""",
word_l AS (SELECT *, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM segments WHERE end_ms > start_ms),
word_i AS (SELECT *, unnest(range(len(w))) AS word_seq FROM word_l),
words AS (SELECT conv_id, transcript_id, seq, segment_id, speaker_id, start_ms, end_ms, word_seq, w[word_seq + 1] AS word,
  CAST(trunc(start_ms + word_seq * ((end_ms - start_ms)::DOUBLE / len(w))) AS BIGINT) + CASE WHEN word_seq % 7 = 6 THEN 300 ELSE 0 END AS word_start_ms,
  CAST(trunc(start_ms + (word_seq + 1) * ((end_ms - start_ms)::DOUBLE / len(w))) AS BIGINT) AS word_end_ms,
  CASE WHEN word_seq % 11 <> 0 THEN (word_seq * 13 % 100) / 100.0::DOUBLE END AS confidence FROM word_i)"""


def process_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    return s.select(
        "transcript_id", "conv_id", "seq", F.col("seq").alias("span_idx"), F.col("speaker_id").alias("label"),
        (F.col("start_ms") / 1000.0).alias("start_s"), (F.col("end_ms") / 1000.0).alias("end_s"), F.col("diarization_quality").alias("quality"),
    )


def sort_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same spans as another diarization sees them: shifted, under other labels."""
    from .operators.ranges import indexed_spans

    s = segments(spark, sf_dir)
    shift = F.col("seq") % 5 * 120
    label = F.concat(F.lit("Speaker "), F.col("role"), F.lit(" "), ((F.col("turn") + 1) % 3).cast("string"))
    return indexed_spans(
        s.select("transcript_id", "seq", label.alias("label"), ((F.col("start_ms") + shift) / 1000.0).alias("start_s"), ((F.col("end_ms") + shift) / 1000.0).alias("end_s"))
    )


SPANS_SQL = """
process AS (SELECT transcript_id, conv_id, seq, seq AS span_idx, speaker_id AS label, start_ms / 1000.0::DOUBLE AS start_s, end_ms / 1000.0::DOUBLE AS end_s, diarization_quality AS quality FROM segments),
sort0 AS (SELECT transcript_id, seq, 'Speaker ' || role || ' ' || ((turn + 1) % 3) AS label, (start_ms + seq % 5 * 120) / 1000.0::DOUBLE AS start_s, (end_ms + seq % 5 * 120) / 1000.0::DOUBLE AS end_s FROM segments),
sort AS (SELECT *, CAST(row_number() OVER (PARTITION BY transcript_id ORDER BY start_s, seq) - 1 AS BIGINT) AS span_idx FROM sort0)"""


def prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where("vec_id % 2 = 0")
    model = F.when(F.col("vec_id") % 20 != 0, F.concat(F.lit("m"), (F.col("label") % 2).cast("string")))
    return e.select(
        "vec_id", F.format_string("VP-%06d", "vec_id").alias("fingerprint_id"), F.col("embedding"),
        F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit("Name "), F.col("label").cast("string"))).alias("display_name"),
        (F.col("vec_id") % 9 + 1).cast("int").alias("sample_count"), model.alias("model"),
        F.when(F.col("vec_id") % 14 == 0, "discarded").otherwise("active").alias("status"),
    )


PRINTS_SQL = """
prints AS (SELECT vec_id, printf('VP-%06d', vec_id) AS fingerprint_id, embedding, CASE WHEN vec_id % 3 = 0 THEN 'Name ' || label END AS display_name, CAST(vec_id % 9 + 1 AS INTEGER) AS sample_count,
  CASE WHEN vec_id % 20 <> 0 THEN 'm' || (label % 2) END AS model, CASE WHEN vec_id % 14 = 0 THEN 'discarded' ELSE 'active' END AS status FROM embeddings WHERE vec_id % 2 = 0)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers to match: some near a print, some between two, some new; some without embedding or with an id."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("o"))
    a = F.when(F.col("vec_id") % 4 == 0, 0.95).otherwise(0.7)
    mixed = F.zip_with("embedding", "o", lambda x, y: x.cast("double") * a + y.cast("double") * (0.95 - a + 0.05))
    s = e.join(other, "vec_id")
    return s.select(
        F.col("vec_id").alias("speaker_key"), F.when(F.col("vec_id") % 20 > 1, F.concat(F.lit("m"), (F.col("label") % 2).cast("string"))).alias("model"),
        F.when(F.col("vec_id") % 23 == 5, F.lit("VP-given")).alias("fingerprint_id"),
        F.when(F.col("vec_id") % 18 < 9, F.concat(F.lit(" NAME "), F.col("label").cast("string"), F.lit(" "))).alias("display_name"),
        F.when(F.col("vec_id") % 9 != 0, mixed).alias("embedding"), F.when(F.col("vec_id") % 5 == 0, 2000).when(F.col("vec_id") % 5 < 4, 20000).cast("bigint").alias("duration_ms"),
    )


OBSERVATIONS_SQL = """
obs AS (SELECT a.vec_id AS speaker_key, CASE WHEN a.vec_id % 20 > 1 THEN 'm' || (a.label % 2) END AS model, CASE WHEN a.vec_id % 23 = 5 THEN 'VP-given' END AS fingerprint_id,
  CASE WHEN a.vec_id % 18 < 9 THEN ' NAME ' || a.label || ' ' END AS display_name,
  CASE WHEN a.vec_id % 9 <> 0 THEN list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * CASE WHEN a.vec_id % 4 = 0 THEN 0.95::DOUBLE ELSE 0.7::DOUBLE END + z[2]::DOUBLE * (0.95::DOUBLE - CASE WHEN a.vec_id % 4 = 0 THEN 0.95::DOUBLE ELSE 0.7::DOUBLE END + 0.05::DOUBLE)) END AS embedding,
  CAST(CASE WHEN a.vec_id % 5 = 0 THEN 2000 WHEN a.vec_id % 5 < 4 THEN 20000 END AS BIGINT) AS duration_ms
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""


def speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers of the transcripts with the print that stands for them."""
    s = segments(spark, sf_dir).groupBy("conv_id", "transcript_id", "speaker_id").agg(F.min("seq").alias("ord"))
    i = (F.col("conv_id") * 7 + F.col("ord") * 3) % F.lit(table(spark, sf_dir, "embeddings").count())
    return s.select(
        "transcript_id", "speaker_id", "ord", F.when(i % 4 != 1, F.format_string("VP-%06d", i - i % 2)).alias("fingerprint_id"),
        F.when(i % 6 == 0, F.lit("Old Name")).alias("display_name"),
    )


SPEAKERS_SQL = """
spk_o AS (SELECT conv_id, transcript_id, speaker_id, min(seq) AS ord FROM segments GROUP BY conv_id, transcript_id, speaker_id),
spk0 AS (SELECT *, (conv_id * 7 + ord * 3) % (SELECT count(*) FROM embeddings) AS i FROM spk_o),
speakers AS (SELECT transcript_id, speaker_id, ord, CASE WHEN i % 4 <> 1 THEN printf('VP-%06d', i - i % 2) END AS fingerprint_id, CASE WHEN i % 6 = 0 THEN 'Old Name' END AS display_name FROM spk0)"""


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).groupBy("conv_id", "transcript_id").agg(F.max("end_ms").alias("duration_ms"))
    day = F.format_string("2024-%02d-%02dT10:00:00", F.col("conv_id") % 12 + 1, F.col("conv_id") % 28 + 1)
    return s.select(
        "transcript_id", "duration_ms", F.concat(F.lit("/Audio/Call_"), F.col("conv_id").cast("string"), F.lit(".wav")).alias("source_path"),
        F.when(F.col("conv_id") % 3 == 0, F.lit("huddle")).otherwise(F.lit("sales")).alias("meeting_type"),
        F.when(F.col("conv_id") % 4 != 0, day).alias("recorded_at"), F.lit("2024-06-01 00:00:00").alias("created_at"),
        F.when(F.col("conv_id") % 5 == 0, "failed").otherwise("ok").alias("diarization_state"), F.md5((F.col("conv_id") % 11).cast("string").cast("binary")).alias("content_audio_fp"),
    )


TRANSCRIPTS_SQL = """
transcripts AS (SELECT transcript_id, max(end_ms) AS duration_ms, '/Audio/Call_' || conv_id || '.wav' AS source_path, CASE WHEN conv_id % 3 = 0 THEN 'huddle' ELSE 'sales' END AS meeting_type,
  CASE WHEN conv_id % 4 <> 0 THEN printf('2024-%02d-%02dT10:00:00', conv_id % 12 + 1, conv_id % 28 + 1) END AS recorded_at, '2024-06-01 00:00:00' AS created_at,
  CASE WHEN conv_id % 5 = 0 THEN 'failed' ELSE 'ok' END AS diarization_state, md5((conv_id % 11)::VARCHAR) AS content_audio_fp FROM segments GROUP BY conv_id, transcript_id)"""
