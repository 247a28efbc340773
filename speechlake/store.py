"""A relational store of transcripts: tables that change together, its guards, and its read queries.

Tables lie in a log of commits (see log.py): a save writes the rows that it brings and the ids that it replaces, whatever
the tables hold already, and it keeps the positional index of all segment texts (see search.py) in the same commit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import search
from .log import LOOKED_UP, Change, Conflict, Log

#: Order of the rows in a table's files; the first column is what readers look up.
ORDER = {"segments": ["transcript_id", "seq"], "speakers": ["transcript_id", "speaker_id"], "prints": ["fingerprint_id"], "postings": ["term", "transcript_id", "seq"]}
#: Transcripts of a small save that share a file.
FEW = 16
#: Columns of a transcript that stay as they were where a later save has null; created_at stays that of the first save.
KEPT = ("raw_json", "raw_transcript_json")


class Table:
    """Versions of one table under a path that Hadoop's file systems reach."""

    def __init__(self, spark: SparkSession, path: str):
        self._log = Log(spark, path)

    def version(self) -> int:
        """Number of the newest version, 0 if there is none."""
        return self._log.newest()

    def read(self) -> DataFrame:
        if not self.version():
            raise ValueError(f"no such table: {self._log.path}")
        return self._log.read("rows")

    def write(self, df: DataFrame) -> int:
        """The next version; raises Conflict if another writer published it first."""
        return self._log.commit({"rows": Change(df, whole=True, key="")})


class Store:
    """Transcripts, speakers, segments, other tables of transcripts, the print library, and the index of texts."""

    def __init__(self, spark: SparkSession, path: str, read_only: bool = False):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = Log(spark, self.path, read_only)

    def versions(self) -> dict[str, int]:
        """The commit that last changed each table."""
        return {name: max([x["seq"] for x in t["parts"] + t["gone"]], default=0) for name, t in self.log.state()["tables"].items()}

    def read(self, name: str, commit: int | None = None) -> DataFrame:
        return self.log.read(name, commit)

    def of(self, name: str, ids: DataFrame, state: dict | None = None) -> DataFrame:
        """The table's rows of some transcripts; of few, only the files that can hold them are opened."""
        few = [r[0] for r in ids.select("transcript_id").distinct().limit(LOOKED_UP + 1).collect()]
        if len(few) <= LOOKED_UP:
            return self.log.read(name, values=few, state=state)
        return self.log.read(name, state=state).join(ids.select("transcript_id"), "transcript_id", "left_semi")

    def commit(self, changed: dict[str, DataFrame]) -> int:
        """New content of these tables."""
        return self.log.commit({name: Change(df, whole=True, order=ORDER.get(name, [])) for name, df in changed.items()})

    def save(
        self, transcripts: DataFrame, speakers: DataFrame, segments: DataFrame, prints: DataFrame | None = None,
        more: dict[str, DataFrame] | None = None, attempts: int = 3,
    ) -> int:
        """Transcripts with their speakers and segments (and rows of other tables with a transcript_id, such as metrics), in
        place of what these transcripts had; one commit, which costs what it brings.

        created_at stays that of the first save, and the raw JSON where the new one is null. Segments of unknown speakers
        raise. With prints, the library after this assignment, ids of discarded prints are taken from the speakers, and
        the prints that differ from the library's are written. If another writer commits meanwhile, the save is made again.
        """
        if prints is not None:
            speakers = without_discarded(speakers, prints)
        ids = transcripts.select("transcript_id")
        few = ids.distinct().limit(LOOKED_UP + 1).count()
        files = -(-few // FEW) or 1 if few <= LOOKED_UP else None
        for attempt in range(attempts):
            state = self.log.state()
            new = {"transcripts": self._kept(transcripts, state), "speakers": speakers, "segments": segments, **(more or {})}
            if {"seq", "text"} <= set(segments.columns):
                new["postings"] = lambda written: search.postings(written["segments"])
            changes = {name: Change(df, ids, order=ORDER.get(name, ["transcript_id"]), files=files) for name, df in new.items()}
            if prints is not None:
                changes |= self._library(prints, state)
            try:
                return self.log.commit(changes, "save", state, lambda written: check_orphans(written["segments"], written["speakers"]))
            except Conflict:
                if attempt == attempts - 1:
                    raise
        raise ValueError("attempts must be positive")

    def _kept(self, transcripts: DataFrame, state: dict) -> DataFrame:
        """Transcripts with the values that outlast a save."""
        if "transcripts" not in state["tables"]:
            return transcripts
        old = self.of("transcripts", transcripts, state)
        cols = [c for c in ("created_at", *KEPT) if c in transcripts.columns and c in old.columns]
        if not cols:
            return transcripts
        before = old.select("transcript_id", *[F.col(c).alias(f"__{c}") for c in cols])
        first = {c: F.coalesce(f"__{c}", c) if c == "created_at" else F.coalesce(c, f"__{c}") for c in cols}
        return transcripts.join(before, "transcript_id", "left").withColumns(first).select(*transcripts.columns)

    def _library(self, prints: DataFrame, state: dict) -> dict[str, Change]:
        """The prints that are new or differ, and the ids of those and of such as aren't there any more."""
        if "prints" not in state["tables"]:
            return {"prints": Change(prints, key="fingerprint_id", order=ORDER["prints"])}
        digest = lambda df: F.xxhash64(*[f"`{c}`" for c in sorted(df.columns)])
        old = self.log.read("prints", state=state)
        old = old.select("fingerprint_id", digest(old).alias("__old"))
        both = prints.select("fingerprint_id", digest(prints).alias("__new")).join(old, "fingerprint_id", "full_outer").where("not (__new <=> __old)")
        changed = both.where("__new is not null").select("fingerprint_id")
        rows = prints.join(changed, "fingerprint_id", "left_semi")
        return {"prints": Change(rows, both.select("fingerprint_id"), key="fingerprint_id", order=ORDER["prints"])}

    def delete(self, ids: DataFrame) -> int:
        """Takes transcripts from all tables that hold some of theirs; prints stay."""
        state = self.log.state()
        gone = ids.select("transcript_id")
        return self.log.commit({name: Change(None, gone) for name, t in state["tables"].items() if t["key"] == "transcript_id"}, "delete", state)

    def search(self, query: str, limit: int | None = 20) -> DataFrame:
        """Segments that match, by the index; see search.search."""
        return search.search(self.log, query, limit)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] = ()) -> DataFrame:
    """Old rows without a new one, and the new rows; columns in keep stay as they were where the new value is null."""
    if keep:
        before = old.select(*keys, *[F.col(c).alias(f"__{c}") for c in keep])
        new = new.join(before, keys, "left").withColumns({c: F.coalesce(c, f"__{c}") for c in keep}).select(*old.columns)
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*old.columns))


def replace_children(old: DataFrame, new: DataFrame, parent: str = "transcript_id") -> DataFrame:
    """Old rows of other parents, and the new rows."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new.select(*old.columns))


def delete(tables: dict[str, DataFrame], ids: DataFrame, key: str = "transcript_id") -> dict[str, DataFrame]:
    """All tables without the rows of these parents."""
    return {name: df.join(ids.select(key), key, "left_anti") for name, df in tables.items()}


def new_only(incoming: DataFrame, old: DataFrame, key: str = "transcript_id") -> DataFrame:
    return incoming.join(old.select(key), key, "left_anti")


def orphan_segments(segments: DataFrame, speakers: DataFrame) -> DataFrame:
    """Segments whose speaker the transcript doesn't have."""
    return segments.join(speakers.select("transcript_id", "speaker_id"), ["transcript_id", "speaker_id"], "left_anti")


def check_orphans(segments: DataFrame, speakers: DataFrame) -> None:
    """Raises if segments name speakers that their transcript doesn't have; tells of one transcript and up to five ids."""
    found = orphan_segments(segments, speakers).groupBy("transcript_id").agg(
        F.count(F.lit(1)).alias("n"), F.slice(F.array_sort(F.collect_set("speaker_id")), 1, 5).alias("ids")
    )
    first = found.orderBy("transcript_id").limit(1).collect()
    if first:
        raise ValueError(f"transcript {first[0]['transcript_id']} has {first[0]['n']} segments of unknown speakers {first[0]['ids']}")


def exists(df: DataFrame, value: str, key: str = "transcript_id") -> bool:
    return not df.where(F.col(key) == value).limit(1).isEmpty()


def guarded(incoming: DataFrame, old: DataFrame, mode: str = "error", key: str = "transcript_id") -> tuple[DataFrame, DataFrame]:
    """(rows to go on with, skip messages). mode: skip leaves out ids that are known, force keeps them, error raises on them."""
    known = incoming.join(old.select(key).distinct(), key, "left_semi")
    message = F.to_json(F.struct(F.col(key), F.lit(True).alias("skipped"), F.lit("exists").alias("reason")))
    if mode == "skip":
        return new_only(incoming, old, key), known.select(key, message.alias("message"))
    if mode == "error":
        first = known.select(key).orderBy(key).limit(1).collect()
        if first:
            raise ValueError(f"transcript already exists: {first[0][0]}; choose force or skip")
    elif mode != "force":
        raise ValueError(f"mode must be skip, force or error, not {mode!r}")
    return incoming, known.select(key, message.alias("message")).limit(0)


def without_discarded(speakers: DataFrame, prints: DataFrame) -> DataFrame:
    """Speakers whose print is discarded lose its id."""
    gone = prints.where("status = 'discarded'").select("fingerprint_id", F.lit(True).alias("__gone"))
    out = speakers.join(gone, "fingerprint_id", "left")
    return out.withColumn("fingerprint_id", F.when(F.col("__gone").isNull(), F.col("fingerprint_id"))).select(*speakers.columns)


def guarded_sources(sources: DataFrame, prints: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(fingerprint_id, transcript_id, speaker_id) of active prints only, each once; with known, those that are new."""
    keys = ["fingerprint_id", "transcript_id", "speaker_id"]
    out = sources.select(*keys).dropDuplicates(keys).join(prints.where("status = 'active'").select("fingerprint_id"), "fingerprint_id", "left_semi")
    return out if known is None else out.join(known.select(*keys), keys, "left_anti")


def with_status(prints: DataFrame, which: str = "active") -> DataFrame:
    """Prints that are active, discarded, or all."""
    if which not in ("active", "discarded", "all"):
        raise ValueError(f"status must be active, discarded or all, not {which!r}")
    return prints if which == "all" else prints.where(F.coalesce("status", F.lit("active")) == which)


def unnamed(prints: DataFrame) -> DataFrame:
    return prints.where("display_name is null or display_name = ''")


def encoded_segments(segments: DataFrame, nested: tuple[str, ...] = ("words",)) -> DataFrame:
    """Segments with nested columns as JSON text, nulls included."""
    return segments.withColumns({c: F.to_json(c, {"ignoreNullFields": "false"}) for c in nested})


def decoded_segments(rows: DataFrame, ddl: dict[str, str]) -> DataFrame:
    """The reverse, with the columns' types."""
    return rows.withColumns({c: F.from_json(c, t) for c, t in ddl.items()})


def loaded(transcripts: DataFrame, speakers: DataFrame, segments: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """A row per transcript with its speakers (by place) and segments (by seq) as arrays; of some ids or all."""
    t = transcripts if ids is None else transcripts.where(F.col("transcript_id").isin(ids))

    def nested(df: DataFrame, order: str, name: str) -> DataFrame:
        rest = [c for c in df.columns if c not in (order, "transcript_id")]
        return df.groupBy("transcript_id").agg(F.sort_array(F.collect_list(F.struct(order, *rest))).alias(name))

    out = t
    for df, order, name in ((speakers, "ord" if "ord" in speakers.columns else "speaker_id", "speakers"), (segments, "seq", "segments")):
        own = df if ids is None else df.where(F.col("transcript_id").isin(ids))
        out = out.join(nested(own, order, name), "transcript_id", "left")
    return out


def audio_duplicates(transcripts: DataFrame) -> DataFrame:
    """(transcript_id, duplicate_of): for each transcript the earliest other one with the same audio fingerprint."""
    t = transcripts.where("content_audio_fp is not null")
    order = Window.partitionBy("content_audio_fp").orderBy("created_at", "transcript_id")
    n = t.withColumn("r", F.row_number().over(order))
    firsts = n.where("r <= 2").groupBy("content_audio_fp").agg(F.max(F.when(F.col("r") == 1, F.col("transcript_id"))).alias("one"), F.max(F.when(F.col("r") == 2, F.col("transcript_id"))).alias("two"))
    out = t.join(firsts, "content_audio_fp").where("two is not null")
    return out.select("transcript_id", F.when(F.col("transcript_id") == F.col("one"), F.col("two")).otherwise(F.col("one")).alias("duplicate_of"))


def list_transcripts(
    transcripts: DataFrame, speakers: DataFrame, segments: DataFrame, source: str | None = None, meeting_type: str | None = None,
    diarization_state: str | None = None, limit: int | None = 50, offset: int = 0,
) -> DataFrame:
    """Transcripts with their numbers of speakers and segments, newest first; source, which may hold % and _, is looked for
    in the path and, if there is such a column, in the URL."""
    t = transcripts
    if source:
        at = [F.coalesce(F.col(c).ilike(f"%{source}%"), F.lit(False)) for c in ("source_path", "source_url") if c in t.columns]
        t = t.where(at[0] | at[1] if len(at) > 1 else at[0])
    if meeting_type:
        t = t.where(F.col("meeting_type") == meeting_type)
    if diarization_state:
        t = t.where(F.col("diarization_state") == diarization_state)
    n = lambda df, k, c: df.groupBy("transcript_id").agg(F.count_distinct(k).alias(c))
    out = t.join(n(speakers, "speaker_id", "speaker_count"), "transcript_id", "left").join(n(segments, "segment_id", "segment_count"), "transcript_id", "left")
    out = out.fillna(0, ["speaker_count", "segment_count"])
    if limit is None:
        return out
    return out.orderBy(F.coalesce("recorded_at", "created_at").desc(), "transcript_id").offset(offset).limit(limit)


def stats(transcripts: DataFrame, speakers: DataFrame, segments: DataFrame, prints: DataFrame) -> DataFrame:
    """One row of counts and total duration."""
    minutes = F.round(F.coalesce(F.sum("duration_ms"), F.lit(0)) / 60000, 3)
    t = transcripts.agg(F.count(F.lit(1)).alias("transcript_count"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("total_duration_ms"), minutes.alias("total_duration_minutes"))
    for df, name in ((speakers, "speaker_count"), (segments, "segment_count"), (prints, "fingerprint_count")):
        t = t.join(F.broadcast(df.agg(F.count(F.lit(1)).alias(name))), how="inner")  # one row each
    return t


def status_counts(prints: DataFrame) -> DataFrame:
    return prints.groupBy(F.coalesce("status", F.lit("active")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def status_report(prints: DataFrame) -> DataFrame:
    """One row: total and, as a map by status, the counts."""
    by = status_counts(prints).agg(F.sum("n").alias("total"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n")))).alias("by_status"))
    return by.select(F.coalesce("total", F.lit(0)).alias("total"), "by_status")


def model_counts(prints: DataFrame, active: str) -> DataFrame:
    """Active prints per namespace: legacy (no model), compatible (the active one), incompatible."""
    kind = F.when(F.col("model").isNull(), "legacy").when(F.col("model") == active, "compatible").otherwise("incompatible")
    return prints.where("status = 'active'").groupBy(kind.alias("namespace")).agg(F.count(F.lit(1)).alias("n"))


def excerpts(speakers: DataFrame, segments: DataFrame, prints: DataFrame, k: int = 3, unnamed_only: bool = False) -> DataFrame:
    """The first k segments, by transcript and start, of each print."""
    s = speakers.where("fingerprint_id is not null").select("transcript_id", "speaker_id", "fingerprint_id")
    if unnamed_only:
        named = prints.where("display_name is not null and display_name <> ''").select("fingerprint_id")
        s = s.join(named, "fingerprint_id", "left_anti")
    g = s.join(segments.select("transcript_id", "speaker_id", "segment_id", "seq", "start_ms", "end_ms", "text"), ["transcript_id", "speaker_id"])
    order = Window.partitionBy("fingerprint_id").orderBy("transcript_id", "start_ms", "seq")
    return g.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k).drop("seq")


def upgrade(df: DataFrame, ddl: str) -> DataFrame:
    """df with the columns of a newer schema: missing ones are null."""
    from .schemas import struct

    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in struct(ddl)])
