"""Quality by importance weight: hashed n-gram log-likelihood ratio of trusted target and raw corpus.

Words and runs of marks (lower case) and pairs of neighbours are hashed into BUCKETS. Two multinomials over the buckets,
with additive smoothing, describe the trusted target (documents labelled good) and the raw corpus (all documents). A
document's score is the mean, over its n-grams, of log(target / raw); it is kept if the score reaches a fixed threshold.
DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, let
from .fingerprints import words_of

BUCKETS = 10_000
#: Documents of the target at most; the trusted model is a multinomial over BUCKETS, which more would not sharpen.
TARGET_DOCS = 20_000
#: Mean log-ratio per n-gram from which a document is kept.
THRESHOLD = -0.25
SMOOTHING = 1.0


def repeated_words(w: Column) -> Column:
    """Words of w in windows of 8 that occur twice or more in w, the first occurrence included."""

    def joined(step: int):
        return lambda h: F.transform(F.slice(h, 1, F.size(h) - step), lambda x, i: F.xxhash64(x, F.get(h, i + step)))

    def covered(s: Column) -> Column:
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        twice = F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))
        places = F.sort_array(F.transform(twice, lambda x: x["p"]))
        gaps = lambda q: F.transform(q, lambda x, i: F.least(F.lit(8), F.coalesce(F.get(q, i + 1) - x, F.lit(8))))
        return F.aggregate(let(places, gaps), F.lit(0), lambda a, x: a + x)

    def count(h8: Column) -> Column:
        by_hash = F.sort_array(F.transform(h8, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h8)) == F.size(h8), F.lit(0)).otherwise(let(by_hash, covered))

    h = F.transform(w, lambda x: F.xxhash64(x))
    h8 = let(let(let(h, joined(1)), joined(2)), joined(4))
    return F.when(F.size(w) < 9, F.lit(0)).otherwise(let(h8, count))


def base_rules(text: Column) -> Column:
    """Struct n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long)."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    values = lambda w: {
        "n_words": F.size(w),
        "word_chars": F.char_length(F.array_join(w, "")),
        "n_symbols": F.char_length(F.regexp_replace(text, F.lit("[^#*$%&|<>]+"), F.lit(""))),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": repeated_words(w),
    }
    return let(words_of(text), lambda w: F.struct(*[c.cast("long").alias(k) for k, c in values(w).items()]))


def ngram_buckets(text: Column) -> Column:
    """Buckets of the text's words and runs of marks and of pairs of neighbours."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"), F.lit(0))

    def both(h: Column) -> Column:
        pairs = F.transform(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1)))
        return F.transform(F.concat(h, pairs), lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int"))

    return let(F.transform(tokens, lambda t: F.xxhash64(t)), both)


def target_ids(labels: DataFrame, limit: int = TARGET_DOCS) -> DataFrame:
    """doc_id of at most `limit` documents labelled good and never bad, chosen by a hash of the id."""
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1")
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).select("doc_id")


def log_ratios(docs: DataFrame, target: DataFrame) -> list[float]:
    """log(target / raw) of each bucket; raw counts cover all of docs. BUCKETS rows reach the driver."""
    marked = docs.join(F.broadcast(target.withColumn("__t", F.lit(1))), "doc_id", "left")  # TARGET_DOCS ids at most
    grams = marked.select("__t", F.explode(ngram_buckets(F.coalesce("text", F.lit("")))).alias("b"))
    counts = grams.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.count("__t").alias("target")).collect()
    raw, good = [SMOOTHING] * BUCKETS, [SMOOTHING] * BUCKETS
    for r in counts:
        raw[r["b"]] += r["raw"]
        good[r["b"]] += r["target"]
    n_raw, n_good = sum(raw), sum(good)
    return [math.log(g / n_good) - math.log(r / n_raw) for g, r in zip(good, raw, strict=True)]


def quality_rules(df: DataFrame, target: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """df (doc_id, text; others kept) with the base columns, base_failed, score and kept; such columns of df are replaced.

    base_failed: fewer than 20 words, or over 30 % of the words in repeated windows of 8. kept: not base_failed and the
    score reaches the threshold. A null text counts as empty: no words, base_failed, score 0.0. Without labelled
    documents the target is uniform over the buckets. A doc_id may be null (never a target) or repeated.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    df = df.drop(*names, "base_failed", "score", "kept", "__t")
    table = ",".join(repr(x) for x in log_ratios(df.select("doc_id", "text"), target))
    ratios = F.from_json(F.lit(f"[{table}]"), "array<double>")
    text = F.coalesce("text", F.lit(""))
    mean = lambda b: F.when(F.size(b) > 0, F.aggregate(b, F.lit(0.0), lambda a, x: a + F.get(ratios, x)) / F.size(b)).otherwise(F.lit(0.0))
    out = df.withColumn("__base", base_rules(text)).withColumn("score", let(ngram_buckets(text), mean))
    out = out.select(*df.columns, "__base.*", "score")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def op2_importance_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    out = quality_rules(documents(spark, sf_dir).select("doc_id", "text"), target_ids(labels))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )


def quality_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op2_importance_quality that SQL can state."""
    return op2_importance_quality(spark, sf_dir).drop("kept", "score")


#: DuckDB: the rows of quality_base_columns.
OP2_BASE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM g) WHERE n > 1
), c AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM r, (SELECT unnest(range(0, 8)) AS o) GROUP BY doc_id
), l AS (
  SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: len(x))), 0) AS BIGINT) AS word_chars,
       CAST(len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(w) < 20 OR 100 * coalesce(c.n, 0) > 30 * len(w) AS base_failed
FROM d LEFT JOIN c USING (doc_id) JOIN l USING (doc_id)
"""
