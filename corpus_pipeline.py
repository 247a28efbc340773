"""From raw documents to packed training sequences: quality rules, toxicity, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the columns of documents; the last
one returns packed pieces. run() writes every stage's result to the shared folder and reads it again for the next one.

In all stages: rows with a null in any column, a null or empty text, a very long text, equal doc_ids or repeated rows go
the way that the stage's operator states for them, and a null or empty text alone removes no row but by the quality
rules; an empty table gives an empty table; columns beside doc_id and text travel in one struct, so that none of them
can clash with a column of an operator, and come back unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlake.llm import near, packing, quality, substrings, toxicity
from speechlake.llm.common import documents, written

#: Ids (some 16 bytes each) that are broadcast at most.
BROADCAST_IDS = 1_000_000


def bundled(docs: DataFrame) -> DataFrame:
    """doc_id, text and, in the struct `rest`, the other columns."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*others).alias("rest") if others else F.lit(None).cast("int").alias("rest"))


def unbundled(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs in their order, from doc_id, text and rest."""
    return found.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the raw corpus is docs, the target those labelled good.

    A null or empty text has too few words and goes.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return unbundled(quality.quality_rules(bundled(docs), quality.target_ids(labels)).where("kept"), docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic; learns from those of docs whose labels are not held out.

    A null or empty text is not toxic, nor is any without labels of both classes to learn from.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    learned = labels.where(~toxicity.held_out(F.col("doc_id")))
    model = toxicity.trained(docs.select("doc_id", "text"), learned)
    return unbundled(toxicity.toxicity(bundled(docs), model).where("predicted = 0"), docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id, with all rows that have this doc_id.

    Rows without a doc_id or without words stay.
    """
    found = near.near_duplicates(docs.select("doc_id", "text"))
    gone = found.where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept")
    gone = written(spark, gone.select("doc_id"), "gone")
    found.tables.free()
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 13 words and more that an earlier one holds; others keep text and n_chars.

    No row goes; a text that loses all its words stays as an empty one.
    """
    out = substrings.remove_repeats(bundled(docs), 13)
    changed = F.col("n_removed") > 0
    out = out.withColumn("text", F.when(changed, F.col("kept_text")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        n_chars = F.when(changed, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("rest.n_chars"))
        out = out.withColumn("rest", F.col("rest").withField("n_chars", n_chars))
    return unbundled(out, docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids and their places in sequences of at most 1024. A null or empty text is its end alone."""
    out = packing.pack_documents(docs.select("doc_id", "text"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_substrings", substring_stage),
    ("packing", packing_stage),
]

#: Hashed n-grams, a trained classifier, and a tokenizer: SQL can't express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
