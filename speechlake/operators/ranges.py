"""Range joins of words and spans without nested loops.

Spans are cut into time buckets; a word meets only the spans of its own bucket. Times are seconds (doubles).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_S = 10.0


def indexed_spans(spans: DataFrame) -> DataFrame:
    """Adds span_idx (bigint): position by start, ties by seq."""
    w = Window.partitionBy("transcript_id").orderBy("start_s", "seq")
    return spans.withColumn("span_idx", (F.row_number().over(w) - 1).cast("bigint"))


def _bucket(x):
    return F.floor(x / BUCKET_S)


def _bucketed(spans: DataFrame) -> DataFrame:
    return spans.withColumn("__b", F.explode(F.sequence(_bucket(F.col("start_s")), _bucket(F.greatest("start_s", "end_s")))))


def words_to_spans(words: DataFrame, spans: DataFrame) -> DataFrame:
    """Each word (transcript_id, word_id, start_s, end_s) with span_idx and how.

    owner: of the spans that hold the word's middle, the one with the largest overlap (ties: first). nearest: without
    such a span, the one whose start or end is nearest to the middle (ties: first). A transcript without spans gives no
    row. spans: transcript_id, span_idx, start_s, end_s.
    """
    w = words.withColumn("mid", (F.col("start_s") + F.col("end_s")) / 2)
    s = spans.select("transcript_id", "span_idx", F.col("start_s").alias("s0"), F.col("end_s").alias("s1"))
    held = _bucketed(spans).select("transcript_id", "span_idx", "__b", F.col("start_s").alias("s0"), F.col("end_s").alias("s1"))
    met = w.withColumn("__b", _bucket(F.col("mid"))).join(held, ["transcript_id", "__b"])
    met = met.where("s0 <= mid and mid <= s1").withColumn("over", F.least("s1", "end_s") - F.greatest("s0", "start_s"))
    owner = met.groupBy("transcript_id", "word_id").agg(F.max_by("span_idx", F.struct("over", -F.col("span_idx"))).alias("span_idx"))
    owner = owner.withColumn("how", F.lit("owner"))

    # The nearest span of a word that none holds ends before it or starts after it: the last end and the next start.
    none, no_time = F.lit(None).cast("bigint"), F.lit(None).cast("double")
    rest = w.join(owner, ["transcript_id", "word_id"], "left_anti")
    events = (
        rest.select("transcript_id", "word_id", F.col("mid").alias("t"), F.lit(1).alias("kind"), none.alias("i"))
        .unionByName(s.select("transcript_id", F.lit(None).cast(rest.schema["word_id"].dataType).alias("word_id"), F.col("s1").alias("t"), F.lit(0).alias("kind"), F.col("span_idx").alias("i")))
        .unionByName(s.select("transcript_id", F.lit(None).cast(rest.schema["word_id"].dataType).alias("word_id"), F.col("s0").alias("t"), F.lit(2).alias("kind"), F.col("span_idx").alias("i")))
    )
    order = Window.partitionBy("transcript_id").orderBy("t", "kind")
    back = F.max(F.when(F.col("kind") == 0, F.struct("t", (-F.col("i")).alias("i")))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.min(F.when(F.col("kind") == 2, F.struct("t", "i"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    near = events.withColumns({"back": back, "ahead": ahead}).where("kind = 1")
    d0, d1 = F.coalesce(F.col("t") - F.col("back.t"), F.lit(float("inf"))), F.coalesce(F.col("ahead.t") - F.col("t"), F.lit(float("inf")))
    i0, i1 = -F.col("back.i"), F.col("ahead.i")
    pick = F.when(d0 < d1, i0).when(d1 < d0, i1).otherwise(F.least(i0, i1))
    near = near.select("transcript_id", "word_id", pick.alias("span_idx"), F.lit("nearest").alias("how"))
    return owner.unionByName(near.where("span_idx is not null"))


def span_texts(words: DataFrame, owners: DataFrame, spans: DataFrame) -> DataFrame:
    """Every span with the text of its words in word order; '' without words."""
    w = words.join(owners, ["transcript_id", "word_id"])
    said = w.groupBy("transcript_id", "span_idx").agg(F.sort_array(F.collect_list(F.struct("word_id", "word"))).alias("w"))
    out = spans.join(said, ["transcript_id", "span_idx"], "left")
    text = F.coalesce(F.array_join(F.transform("w", lambda x: x["word"]), " "), F.lit(""))
    return out.withColumn("text", text).withColumn("n_words", F.coalesce(F.greatest(F.size("w"), F.lit(0)), F.lit(0)).cast("bigint")).drop("w")


def _overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of a and b (columns a_*, b_*) that overlap strictly, with their overlap in seconds; each pair once."""
    one = _bucketed(a).select("transcript_id", "__b", *[F.col(c).alias(f"a_{c}") for c in a.columns if c != "transcript_id"])
    two = _bucketed(b).select("transcript_id", "__b", *[F.col(c).alias(f"b_{c}") for c in b.columns if c != "transcript_id"])
    both = one.join(two, ["transcript_id", "__b"]).where("b_end_s > a_start_s and b_start_s < a_end_s")
    both = both.where(F.col("__b") == F.greatest(_bucket(F.col("a_start_s")), _bucket(F.col("b_start_s"))))
    over = F.least("a_end_s", "b_end_s") - F.greatest("a_start_s", "b_start_s")
    return both.withColumn("over", over).where("over > 0").drop("__b")


def overlap_map(sort: DataFrame, process: DataFrame) -> DataFrame:
    """Per label of sort the speaker of process that it overlaps longest in total; ties: the pair met first."""
    pairs = _overlaps(sort, process).groupBy("transcript_id", "a_label", "b_label").agg(
        F.sum("over").alias("seconds"), F.min(F.struct("a_span_idx", "b_span_idx")).alias("first")
    )
    order = Window.partitionBy("transcript_id", "a_label").orderBy(F.round("seconds", 9).desc(), "first")
    best = pairs.withColumn("r", F.row_number().over(order)).where("r = 1")
    return best.select("transcript_id", F.col("a_label").alias("label"), F.col("b_label").alias("speaker"), "seconds")


def overlap_quality(sort: DataFrame, process: DataFrame) -> DataFrame:
    """Per span of sort the overlap-weighted mean quality of process; null where no known quality overlaps."""
    q = _overlaps(sort, process.where("quality is not null")).groupBy("transcript_id", "a_span_idx").agg(
        (F.sum(F.col("over") * F.col("b_quality")) / F.sum("over")).alias("quality")
    )
    return sort.drop("quality").join(q.withColumnRenamed("a_span_idx", "span_idx"), ["transcript_id", "span_idx"], "left")
