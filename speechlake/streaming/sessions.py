"""Structured Streaming: sessions of events, and ingest of transcripts without repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """The events table as a file stream."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions per user: events at most `gap` apart; an event exactly at the gap belongs to the session."""
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return e.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total"))


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over a finite folder; the result, open sessions included, is the last version under path.

    The state of all sessions stays. For a stream without end take append_to_table.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    q = stream.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def append_to_table(stream: DataFrame, path: str, checkpoint: str, **trigger) -> None:
    """Appends each session once, when the watermark has passed it, and drops its state; waits for a trigger that ends.

    Files under path are those that the sink's log names, so a batch that is repeated after a failure counts once.
    """
    flat = stream.select(*[c for c in stream.columns if c != "w"], F.col("w.start").alias("start"), F.col("w.end").alias("end"))
    q = flat.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    q.trigger(**(trigger or {"availableNow": True})).start().awaitTermination()


def new_transcripts(raw: DataFrame, at: str = "recorded_at", late: str = "1 day") -> DataFrame:
    """Transcripts whose audio fingerprint did not come before within the watermark."""
    return raw.withWatermark(at, late).dropDuplicatesWithinWatermark(["content_audio_fp"])
