"""Speaker identity: decisions against a library of voice prints, and clean-up of over-detected speakers."""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, Config
from .vectors import nearest_two


def decide(cfg: Config = DEFAULT) -> Column:
    """Kind of match from best, second (raw similarities) and duration_ms (null: unknown)."""
    best = F.greatest(F.coalesce("best", F.lit(0.0)), F.lit(0.0))
    second = F.greatest(F.coalesce("second", F.lit(0.0)), F.lit(0.0))
    known = F.col("best_id").isNotNull()
    strong = known & (best >= cfg.similarity_threshold)
    margin = known & (best >= cfg.margin_similarity) & (best - second >= cfg.margin_delta)
    short = F.coalesce(F.col("duration_ms") < cfg.min_enroll_ms, F.lit(False))
    return F.when(strong, "strong").when(margin, "margin").when(short, "no_enroll").otherwise("new")


def match_kinds(speakers: DataFrame, prints: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Each speaker's match against a library that stays as it is.

    speakers: speaker_key, model, fingerprint_id, display_name, embedding, duration_ms. prints: fingerprint_id, model,
    display_name, status, embedding. Order of decision: an id given before, then for speakers without embedding an equal
    name (case and edges aside; smallest id) or nothing, then similarity. Adds kind, matched_id, similarity,
    second_similarity, margin and folds (the sample may update the print).
    """
    active = prints.where("status = 'active'")
    given = F.coalesce(F.col("fingerprint_id") != "", F.lit(False))
    silent = F.coalesce(F.size("embedding") <= 0, F.lit(True))
    heard = speakers.where(~given & ~silent)
    two = nearest_two(heard, active, "speaker_key", "fingerprint_id", "model")
    name = F.lower(F.btrim("display_name"))
    named = active.where(F.coalesce(F.col("display_name") != "", F.lit(False))).groupBy(F.col("model").alias("m"), name.alias("name"))
    named = named.agg(F.min("fingerprint_id").alias("name_id"))
    s = speakers.join(two, "speaker_key", "left").withColumn("__name", F.when(silent & (F.col("display_name") != ""), name))
    s = s.join(named, F.col("model").eqNullSafe(F.col("m")) & (F.col("__name") == F.col("name")), "left")
    by_name = F.when(F.col("name_id").isNotNull(), "name_match").otherwise("no_embedding")
    kind = F.when(given, "preassigned").when(silent, by_name).otherwise(decide(cfg))
    s = s.withColumn("kind", kind)
    like = F.col("kind").isin("strong", "margin")
    matched = F.when(F.col("kind") == "preassigned", F.col("fingerprint_id")).when(F.col("kind") == "name_match", F.col("name_id"))
    matched = matched.when(like, F.col("best_id"))
    long_enough = F.coalesce(F.col("duration_ms") >= cfg.min_update_ms, F.lit(True))
    return s.select(
        *speakers.columns, "kind", matched.alias("matched_id"), F.col("best").alias("similarity"), F.col("second").alias("second_similarity"),
        (F.col("best") - F.col("second")).alias("margin"), ((F.col("kind") == "strong") & long_enough).alias("folds"),
    )


def print_id(vector, model: str | None, salt: int = 0) -> str:
    """VP- and the 8-byte BLAKE2b of the vector as 32-bit floats, the model and, from 1 on, the salt."""
    h = hashlib.blake2b(struct.pack(f"{len(vector)}f", *vector) + b"\0" + (model or "").encode(), digest_size=8)
    if salt:
        h.update(b"\0" + str(salt).encode())
    return f"VP-{h.hexdigest()}"


class Library:
    """The prints of one model, as they change while speakers are assigned one after the other."""

    def __init__(self, model: str | None, rows: list[dict], cfg: Config):
        self.model, self.cfg = model, cfg
        self.ids = [r["fingerprint_id"] for r in rows]
        self.vectors = [np.array(r["embedding"], np.float32) for r in rows]
        self.counts = [r["sample_count"] for r in rows]
        self.known = set(self.ids)

    def transcript(self, speakers: list[dict]) -> list[tuple]:
        """(speaker_key, kind, matched_id, similarity, second_similarity) of one transcript's speakers, in order.

        New prints serve later speakers of the transcript at once; samples are folded in after it.
        """
        out, folds = [], []
        frozen = [v.astype(float) for v in self.vectors]
        for s in speakers:
            v = np.array(s["embedding"], float)
            sims = [self._cosine(v, w) for w in frozen]
            order = sorted(range(len(sims)), key=lambda i: -sims[i])[:2]
            best, second = (sims[order[0]] if order else None), (sims[order[1]] if len(order) > 1 else None)
            b, c, d = max(best or 0.0, 0.0), max(second or 0.0, 0.0), s["duration_ms"]
            if order and b >= self.cfg.similarity_threshold:
                kind = "strong"
                if d is None or d >= self.cfg.min_update_ms:
                    folds.append((order[0], v))
            elif order and b >= self.cfg.margin_similarity and b - c >= self.cfg.margin_delta:
                kind = "margin"
            elif d is not None and d < self.cfg.min_enroll_ms:
                out.append((s["speaker_key"], "no_enroll", None, best, second))
                continue
            else:
                salt, i = 0, print_id(v, self.model)
                while i in self.known:
                    salt += 1
                    i = print_id(v, self.model, salt)
                self.known.add(i)
                self.ids.append(i)
                self.vectors.append(v.astype(np.float32))
                self.counts.append(1)
                frozen.append(v)
                out.append((s["speaker_key"], "new", i, best, second))
                continue
            out.append((s["speaker_key"], kind, self.ids[order[0]], best, second))
        for i, v in folds:
            if len(v) == len(self.vectors[i]):
                n = self.counts[i]
                self.vectors[i] = ((self.vectors[i].astype(float) * n + v) / (n + 1)).astype(np.float32)
                self.counts[i] = n + 1
        return out

    @staticmethod
    def _cosine(a: np.ndarray, b: np.ndarray) -> float:
        norm = float(np.sqrt(a @ a) * np.sqrt(b @ b)) if len(a) == len(b) else 0.0
        return float(a @ b) / norm if norm else 0.0


def assign_in_order(speakers: DataFrame, prints: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Assignment where every transcript sees the library as earlier ones left it.

    speakers: model, transcript_id, ord, speaker_key, embedding, duration_ms. The result depends on the order, so a
    model's speakers form one group; models run side by side. Use match_kinds for a library that may stay frozen.
    """

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        model = key[0].as_py() or None
        library = Library(model, sorted(right.to_pylist(), key=lambda r: r["fingerprint_id"]), cfg)
        rows, out = sorted(left.to_pylist(), key=lambda r: (r["transcript_id"], r["ord"])), []
        start = 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or rows[i]["transcript_id"] != rows[start]["transcript_id"]:
                out += library.transcript(rows[start:i])
                start = i
        names = ["speaker_key", "kind", "matched_id", "similarity", "second_similarity"]
        kinds = [left.schema.field("speaker_key").type, pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.table([pa.array([r[j] for r in out], k) for j, k in enumerate(kinds)], names=names)

    space = F.coalesce("model", F.lit("")).alias("space")
    a = speakers.where(F.size("embedding") > 0).select(space, "transcript_id", "ord", "speaker_key", "duration_ms", F.col("embedding").cast("array<double>"))
    b = prints.where("status = 'active'").select(space, "fingerprint_id", F.col("embedding").cast("array<double>"), "sample_count")
    kind = speakers.schema["speaker_key"].dataType.simpleString()
    schema = f"speaker_key {kind}, kind string, matched_id string, similarity double, second_similarity double"
    return a.groupBy("space").cogroup(b.groupBy("space")).applyInArrow(run, schema)


def collapse(speakers: list[dict], talk: dict[str, float], cfg: Config = DEFAULT, target: int | None = None) -> dict[str, str]:
    """speaker_id -> kept speaker_id for one transcript; speakers: speaker_id and embedding, talk: seconds per id.

    By falling talk time each speaker joins the most similar kept one from merge_threshold on, or is kept. Then kept ones
    below min_talk_seconds, the longest aside, go to the most similar that is left, or without embedding to the longest
    talker; then those beyond target likewise. Ids without a speaker go to the longest talker.
    """
    vectors = {s["speaker_id"]: np.array(s["embedding"], float) for s in speakers if s["embedding"] is not None and len(s["embedding"])}
    goes: dict[str, str] = {}
    by_talk = lambda ids, t: sorted(ids, key=lambda i: -t.get(i, 0.0))  # noqa: E731  stable

    def nearest(i: str, among: list[str], least: float) -> str | None:
        found, top = None, least
        for k in among:
            if i in vectors and k in vectors:
                sim = Library._cosine(vectors[i], vectors[k])
                if sim > top:
                    found, top = k, sim
        return found

    def settled(t: dict[str, float]) -> dict[str, float]:
        out: dict[str, float] = {}
        for i, sec in t.items():
            k = goes.get(i, i)
            out[k] = out.get(k, 0.0) + sec
        return out

    kept: list[str] = []
    for i in by_talk([s["speaker_id"] for s in speakers], talk):
        k = nearest(i, kept, np.nextafter(cfg.merge_threshold, 0))
        if k is None:
            kept.append(i)
        else:
            goes[i] = k
    now = settled(talk)
    if cfg.min_talk_seconds > 0 and kept:
        protected = by_talk(kept, now)[0]
        low = [i for i in kept if i != protected and now.get(i, 0.0) < cfg.min_talk_seconds]
        kept = [i for i in kept if i not in low]
        if low:
            dominant = max(now, key=now.get) if now else kept[0]
            ids = {s["speaker_id"] for s in speakers}
            for i in [*low, *(x for x in now if x not in kept and x not in low)]:
                to = (nearest(i, kept, -1.0) if i in ids else None) or dominant
                for j in [i, *(x for x, k in goes.items() if k == i)]:
                    goes[j] = to
    now = settled(talk)
    if target is not None and len(kept) > target:
        ranked = by_talk(kept, now)
        kept, extra = ranked[:target], ranked[target:]
        for i in extra:
            to = nearest(i, kept, -1.0) or max(kept, key=lambda k: now.get(k, 0.0))
            for j in [i, *(x for x, k in goes.items() if k == i)]:
                goes[j] = to
    now = settled(talk)
    if kept:
        fallback = max(kept, key=lambda k: now.get(k, 0.0))
        for i in talk:
            if goes.get(i, i) not in kept:
                goes[i] = fallback
    return {i: goes.get(i, i) for i in dict.fromkeys([*(s["speaker_id"] for s in speakers), *talk])}


def collapse_speakers(speakers: DataFrame, segments: DataFrame, cfg: Config = DEFAULT, target: int | None = None) -> DataFrame:
    """(transcript_id, speaker_id, kept_id) by collapse(); a transcript's speakers are one small group."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = sorted(left.to_pylist(), key=lambda r: r["ord"])
        talk = {r["speaker_id"]: r["seconds"] for r in sorted(right.to_pylist(), key=lambda r: r["first"])}
        found = collapse(rows, talk, cfg, target)
        return pa.table({"transcript_id": pa.array([key[0].as_py()] * len(found)), "speaker_id": pa.array(list(found)), "kept_id": pa.array(list(found.values()))})

    talk = segments.groupBy("transcript_id", "speaker_id").agg(
        F.sum((F.col("end_ms") - F.col("start_ms")) / 1000.0).alias("seconds"), F.min("seq").alias("first")
    )
    s = speakers.select("transcript_id", "ord", "speaker_id", F.col("embedding").cast("array<double>"))
    both = s.groupBy("transcript_id").cogroup(talk.groupBy("transcript_id"))
    return both.applyInArrow(run, "transcript_id string, speaker_id string, kept_id string")


def folded_centroids(prints: DataFrame, samples: DataFrame) -> DataFrame:
    """(fingerprint_id, pos, value, sample_count): prints after samples (matched_id, embedding) are folded in, all at once.

    (old * n + sum of samples) / (n + k), for samples of the print's length only.
    """
    sized = samples.select(F.col("matched_id").alias("fingerprint_id"), F.col("embedding").alias("s"), F.size("embedding").alias("dim"))
    s = sized.select("fingerprint_id", "dim", F.posexplode("s").alias("pos", "x")).groupBy("fingerprint_id", "dim", "pos")
    s = s.agg(F.sum(F.col("x").cast("double")).alias("total"), F.count(F.lit(1)).alias("k"))
    p = prints.select("fingerprint_id", "sample_count", F.size("embedding").alias("dim"), F.posexplode("embedding").alias("pos", "old"))
    out = p.join(s, ["fingerprint_id", "dim", "pos"])
    value = (F.col("old").cast("double") * F.col("sample_count") + F.col("total")) / (F.col("sample_count") + F.col("k"))
    return out.select("fingerprint_id", F.col("pos").cast("bigint").alias("pos"), value.alias("value"), (F.col("sample_count") + F.col("k")).alias("sample_count"))


def minted(embedding: Column, model: Column) -> Column:
    """print_id of each vector."""

    @F.pandas_udf(T.StringType())
    def ids(v: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else print_id(x, y) for x, y in zip(v, m, strict=True)])

    return ids(embedding, model)


def committed(prints: DataFrame, speakers: DataFrame, decisions: DataFrame, cfg: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(library, sources) after an assignment, whose decisions are keyed by speaker_key.

    New speakers become prints with one sample; then samples of strong matches that are long enough are folded into
    their prints, new ones included; other prints stay. Sources name, for each print that is active afterwards, the
    speakers it was heard as. prints: fingerprint_id, model, display_name, status, embedding, sample_count; speakers:
    speaker_key, transcript_id, speaker_id, model, display_name, embedding, duration_ms.
    """
    columns = ["fingerprint_id", "model", "display_name", "status", "embedding", "sample_count"]
    s = speakers.join(decisions.select("speaker_key", "kind", "matched_id"), "speaker_key")
    floats = F.col("embedding").cast("array<double>").alias("embedding")
    fresh = s.where("kind = 'new'").select(
        F.coalesce("matched_id", minted(F.col("embedding"), F.col("model"))).alias("fingerprint_id"), "model", "display_name",
        F.lit("active").alias("status"), floats, F.lit(1).alias("sample_count"),
    )
    old = prints.select(*[floats if c == "embedding" else c for c in columns])
    library = old.unionByName(fresh.dropDuplicates(["fingerprint_id"]).join(old, "fingerprint_id", "left_anti"))
    long_enough = F.coalesce(F.col("duration_ms") >= cfg.min_update_ms, F.lit(True))
    active = library.where("status = 'active'")
    folded = folded_centroids(active, s.where((F.col("kind") == "strong") & long_enough)).groupBy("fingerprint_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("__new"), F.max("sample_count").alias("__n")
    )
    out = library.join(folded, "fingerprint_id", "left").withColumns(
        {"embedding": F.coalesce("__new", "embedding"), "sample_count": F.coalesce("__n", "sample_count").cast("int")}
    )
    heard = s.where("kind in ('strong', 'margin', 'name_match', 'preassigned', 'new')")
    names = F.coalesce("matched_id", F.when(F.col("kind") == "new", minted(F.col("embedding"), F.col("model"))))
    sources = heard.select(names.alias("fingerprint_id"), "transcript_id", "speaker_id").dropDuplicates()
    return out.select(*columns), sources.join(active.select("fingerprint_id"), "fingerprint_id", "left_semi")


def labelled(prints: DataFrame, names: DataFrame) -> DataFrame:
    """Prints with the display names of names (fingerprint_id, name); an id that no print has raises."""
    missing = names.join(prints, "fingerprint_id", "left_anti").select("fingerprint_id").orderBy("fingerprint_id").limit(1).collect()
    if missing:
        raise ValueError(f"fingerprint not found: {missing[0][0]}")
    new = names.select("fingerprint_id", F.col("name").alias("__name"))
    return prints.join(new, "fingerprint_id", "left").withColumn("display_name", F.coalesce("__name", "display_name")).select(*prints.columns)


def relabels(speakers: DataFrame, prints: DataFrame) -> DataFrame:
    """Speakers whose print has another name than they: transcript_id, speaker_id, fingerprint_id, old_name, new_name."""
    names = prints.select("fingerprint_id", F.col("display_name").alias("new_name"))
    s = speakers.select("transcript_id", "speaker_id", "fingerprint_id", F.col("display_name").alias("old_name"))
    out = s.where("fingerprint_id <> ''").join(names, "fingerprint_id", "left")
    old = F.when(F.col("old_name") != "", F.col("old_name"))
    return out.where(F.col("new_name").isNotNull() & ~old.eqNullSafe(F.col("new_name")))


def first_seen(df: DataFrame, by: str, key: str, order: str, name: str) -> DataFrame:
    """Adds name: 1, 2, ... in the order in which key first appears in each group."""
    firsts = df.groupBy(by, key).agg(F.min(order).alias("__first"))
    firsts = firsts.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy("__first", key)).cast("bigint")).drop("__first")
    return df.join(firsts, [by, key])
