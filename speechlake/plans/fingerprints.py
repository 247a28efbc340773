"""Plans for changes to the print library. A plan is a frame; apply_* turn library and plan into a new version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def import_plan(incoming: DataFrame, library: DataFrame, replace: bool = False) -> DataFrame:
    """(fingerprint_id, action): insert, replace or skip. Ids in incoming must be unique."""
    known = library.select("fingerprint_id", F.lit(True).alias("known"))
    out = incoming.select("fingerprint_id").join(known, "fingerprint_id", "left")
    action = F.when(F.col("known").isNull(), "insert").otherwise("replace" if replace else "skip")
    return out.select("fingerprint_id", action.alias("action"))


def apply_import(library: DataFrame, incoming: DataFrame, plan: DataFrame) -> DataFrame:
    """The library with planned rows put in or replaced; a replaced row keeps its created_at where the new one has none."""
    rows = incoming.join(plan.where("action <> 'skip'").select("fingerprint_id"), "fingerprint_id")
    old = library.select("fingerprint_id", F.col("created_at").alias("old_created_at"))
    rows = rows.join(old, "fingerprint_id", "left").withColumn("created_at", F.coalesce("created_at", "old_created_at"))
    return library.join(rows.select("fingerprint_id"), "fingerprint_id", "left_anti").unionByName(rows.select(*library.columns))


def invalid_rows(incoming: DataFrame) -> DataFrame:
    """(fingerprint_id, problem) of rows that cannot be imported."""
    n = incoming.groupBy("fingerprint_id").agg(F.count(F.lit(1)).alias("n"))
    s = incoming.join(n, "fingerprint_id", "left")
    finite = F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    problem = (
        F.when(F.coalesce(F.btrim("fingerprint_id") == "", F.lit(True)), "no id")
        .when(F.col("n") > 1, "repeated id")
        .when(F.coalesce(F.size("embedding") <= 0, F.lit(True)), "no embedding")
        .when(~finite, "embedding not finite")
        .when(F.col("embedding_dimension") != F.size("embedding"), "dimension differs")
        .when(~F.coalesce("status", F.lit("active")).isin("active", "discarded"), "unknown status")
    )
    return s.select("fingerprint_id", problem.alias("problem")).where("problem is not null")


def adopt_plan(library: DataFrame, only_legacy: bool = True) -> DataFrame:
    """Active prints, without a model only if asked so, that would get one."""
    out = library.where("status = 'active'")
    if only_legacy:
        out = out.where("embedding_model is null")
    return out.select("fingerprint_id", "display_name", "sample_count", "embedding_model", "status")


def apply_adopt(library: DataFrame, plan: DataFrame, model: str) -> DataFrame:
    hit = plan.select("fingerprint_id", F.lit(True).alias("__hit"))
    out = library.join(hit, "fingerprint_id", "left")
    dimension = F.when(F.col("__hit"), F.coalesce("embedding_dimension", F.size("embedding"))).otherwise(F.col("embedding_dimension"))
    return out.withColumns(
        {"embedding_model": F.when(F.col("__hit"), F.lit(model)).otherwise(F.col("embedding_model")), "embedding_dimension": dimension}
    ).select(*library.columns)


def action_plan(library: DataFrame, speakers: DataFrame, action: str, reason: str | None = None) -> DataFrame:
    """What discard, restore or destroy would do to each print: will_write, target_status, target_reason, speaker_rows."""
    if action not in ("discard", "restore", "destroy"):
        raise ValueError(f"unknown action: {action}")
    if action == "discard" and not (reason or "").strip():
        raise ValueError("discard needs a reason")
    target = {"discard": "discarded", "restore": "active", "destroy": None}[action]
    why = reason.strip() if action == "discard" else None
    refs = speakers.where("fingerprint_id is not null").groupBy("fingerprint_id").agg(F.count(F.lit(1)).alias("speaker_rows"))
    differs = ~F.col("status").eqNullSafe(F.lit(target)) | ~F.col("discard_reason").eqNullSafe(F.lit(why).cast("string"))
    out = library.join(refs, "fingerprint_id", "left")
    return out.select(
        "fingerprint_id", F.col("status").alias("current_status"), F.lit(target).cast("string").alias("target_status"),
        F.lit(why).cast("string").alias("target_reason"), (F.lit(True) if action == "destroy" else differs).alias("will_write"),
        F.coalesce("speaker_rows", F.lit(0).cast("bigint")).alias("speaker_rows"),
    )


def apply_action(library: DataFrame, plan: DataFrame, action: str) -> DataFrame:
    if action == "destroy":
        return library.join(plan.select("fingerprint_id"), "fingerprint_id", "left_anti")
    change = plan.where("will_write").select("fingerprint_id", "target_status", "target_reason", F.lit(True).alias("__hit"))
    out = library.join(change, "fingerprint_id", "left")
    return out.withColumns(
        {
            "status": F.when(F.col("__hit"), F.col("target_status")).otherwise(F.col("status")),
            "discard_reason": F.when(F.col("__hit"), F.col("target_reason")).otherwise(F.col("discard_reason")),
        }
    ).select(*library.columns)


def merge_plan(library: DataFrame, pairs: DataFrame) -> DataFrame:
    """For pairs (source, target) that may be merged: merged embedding, sample_count and display_name.

    Both must be active, of one model (null is one) and dimension; the target's name wins, then the source's.
    """
    one = library.select(*[F.col(c).alias(f"s_{c}") for c in library.columns])
    two = library.select(*[F.col(c).alias(f"t_{c}") for c in library.columns])
    both = pairs.join(one, F.col("source") == F.col("s_fingerprint_id")).join(two, F.col("target") == F.col("t_fingerprint_id"))
    both = both.where("s_status = 'active' and t_status = 'active' and s_embedding_model <=> t_embedding_model and source <> target")
    both = both.where(F.size("s_embedding") == F.size("t_embedding"))
    n, m = F.col("t_sample_count"), F.col("s_sample_count")
    mean = F.zip_with("t_embedding", "s_embedding", lambda x, y: (x.cast("double") * n + y.cast("double") * m) / (n + m))
    name = F.coalesce(F.when(F.col("t_display_name") != "", F.col("t_display_name")), F.col("s_display_name"))
    return both.select("source", "target", mean.alias("embedding"), (n + m).alias("sample_count"), name.alias("display_name"))


def apply_merge(library: DataFrame, speakers: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Library without sources and with merged targets; speakers that follow. Each print may be in one pair only."""
    new = plan.select(F.col("target").alias("fingerprint_id"), F.col("embedding").alias("__e"), F.col("sample_count").alias("__n"), F.col("display_name").alias("__d"))
    kept = library.join(plan.select(F.col("source").alias("fingerprint_id")), "fingerprint_id", "left_anti").join(new, "fingerprint_id", "left")
    kept = kept.withColumns(
        {
            "embedding": F.coalesce(F.col("__e").cast("array<float>"), "embedding"),
            "sample_count": F.coalesce("__n", "sample_count").cast(library.schema["sample_count"].dataType),
            "display_name": F.when(F.col("__n").isNotNull(), F.col("__d")).otherwise(F.col("display_name")),
        }
    ).select(*library.columns)
    moved = plan.select(F.explode(F.array("source", "target")).alias("fingerprint_id"), F.col("target").alias("__t"), F.col("display_name").alias("__d"))
    s = speakers.join(moved, "fingerprint_id", "left")
    s = s.withColumn("display_name", F.when(F.col("__t").isNotNull(), F.col("__d")).otherwise(F.col("display_name")))
    s = s.withColumn("fingerprint_id", F.coalesce("__t", "fingerprint_id"))
    return kept, s.select(*speakers.columns)
