"""Assignment in order, where every transcript sees the library as earlier ones left it, without one group per model.

The verdicts of all speakers are a fixpoint: given all verdicts, the library at any moment is known (prints minted before
it, and samples folded in before it), and given the library at every moment, all verdicts are. So: judge all speakers
against the library that there was at first, derive the library's versions from these verdicts, judge again, and repeat
until nothing changes. A verdict depends on earlier ones alone, so every round settles at least all speakers up to the
first change, which are not judged again, and the fixpoint is what one pass in order gives.

The first round is one product of speakers' blocks with versions' blocks, each version masked to the moments it's valid
at. It keeps the KEEP best of each speaker; a later round drops from them what is no longer valid, adds what the versions
that came offer, and meets all versions only for speakers that have fewer than two left above those that were not kept.
Blocks are cut by time, and those that share no moment don't meet. A task holds the speakers' blocks of one lot, which all
versions pass once; only the samples folded into one and the same print stand in a row in one task, as each fold rounds
what the one before left.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, Config
from ..shared import shared_folder
from .identity import decide, print_id
from .vectors import BROADCAST_BYTES, MOST_LOTS, unit  # noqa: F401  (tests set the first)

#: Rows of a block.
BLOCK = 1024
#: Places of minted prints begin here; those of the library's, in order of their ids, lie below.
MINTED = 1 << 62
END = (1 << 63) - 1
#: Best versions of a speaker that are known from round to round.
KEEP = 8
#: Estimates of a cosine that lie so near are told apart by the exact value.
_CLOSE = 1e-11


class _Tables:
    """Tables in the shared folder that live as long as they are needed."""

    def __init__(self, spark):
        self.spark, self.at = spark, shared_folder(spark, "sequence")

    def written(self, df: DataFrame) -> DataFrame:
        path = f"{self.at}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def _placed(df: DataFrame, *order: str) -> DataFrame:
    """df with pos: a number that ascends in this order over all partitions."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id())


def _in_turn(tables: _Tables, df: DataFrame, *order: str) -> DataFrame:
    """df with pos: 0, 1, 2, ... in this order."""
    df, low = tables.written(_placed(df, *order)), (1 << 33) - 1
    sizes = df.groupBy(F.shiftright("pos", 33).alias("p")).agg(F.count(F.lit(1)).alias("n"))  # a row per partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = F.broadcast(sizes.select("p", before.alias("before")))
    return df.withColumn("p", F.shiftright("pos", 33)).join(sizes, "p").withColumn("pos", F.col("before") + F.col("pos").bitwiseAND(F.lit(low))).drop("p", "before")


def _cut(df: DataFrame, by: list[str], cols: list[str], side: int) -> DataFrame:
    """(by, side, lo, hi, narrow, the columns cols, else null, and m as bytes) in blocks of at most BLOCK rows of one length and part.

    Vectors whose numbers all are 32-bit floats travel as such, in blocks of their own.
    """
    every = ["pos", "place", "start", "end", "mark"]

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by(cols[0])
        dim, narrow = t.column("dim")[0].as_py(), t.column("narrow")[0].as_py()
        out = []
        for i in range(0, t.num_rows, BLOCK):
            s = t.slice(i, BLOCK)
            m = s.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(s.num_rows, dim)
            longs = [s.column(c).to_numpy().astype(np.int64).tobytes() if c in cols else None for c in every]
            lo, hi = s.column("lo").to_numpy().min(), s.column("hi").to_numpy().max()
            out.append((*(s.column(c)[0].as_py() for c in by), side, int(lo), int(hi), narrow, *longs, m.astype(np.float32 if narrow else np.float64).tobytes()))
        kinds = [*(t.schema.field(c).type for c in by), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), *[pa.binary()] * 6]
        names = [*by, "side", "lo", "hi", "narrow", *every, "m"]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=True)], names=names)

    narrow = F.coalesce(F.forall("vec", lambda x: x.cast("float").cast("double") == x), F.lit(False))
    cut = df.select(*by, "lo", "hi", *cols, "vec", F.coalesce(F.size("vec"), F.lit(0)).cast("long").alias("dim"), narrow.alias("narrow"), "part")
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)
    schema = f"{kinds}, side long, lo long, hi long, narrow boolean, {', '.join(f'{c} binary' for c in every)}, m binary"
    return cut.groupBy(*by, "dim", "narrow", "part").applyInArrow(build, schema)


def _exact(a: np.ndarray, b: np.ndarray) -> float:
    norm = float(np.sqrt(a @ a) * np.sqrt(b @ b))
    return float(a @ b) / norm if norm else 0.0


def _vectors(raw, narrow: bool, rows: int) -> np.ndarray:
    return np.frombuffer(raw, np.float32 if narrow else np.float64).astype(np.float64).reshape(rows, -1 if len(raw) else 0)


class _Block:
    """A block of speakers with the most similar versions that each has met so far, equal ones by their print's place."""

    def __init__(self, pos: np.ndarray, m: np.ndarray, keep: int = 2):
        self.pos, self.m, self.keep = pos, m, keep
        self.x = unit(m)
        self.narrow, self.zero = self.x.astype(np.float32), ~self.x.any(1)
        self.best: list[list[tuple]] = [[] for _ in pos]
        self.least = np.full(len(pos), -np.inf)

    def _candidates(self, y: np.ndarray, start: np.ndarray, end: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns that may be among the best, from products of this kind of number."""
        x = self.narrow if kind is np.float32 else self.x
        alike = x.shape[1] == y.shape[1]
        sims = x @ y.astype(kind, copy=False).T if alike else np.zeros((len(x), len(y)), kind)
        if start.max() >= self.pos.min() or end.min() < self.pos.max():
            sims[(self.pos[:, None] <= start[None, :]) | (self.pos[:, None] > end[None, :])] = -np.inf
        off = _CLOSE if kind is np.float64 else float(np.finfo(np.float32).eps) * (x.shape[1] + 4)
        least = np.maximum(self.least - off, -2)
        own, other = np.nonzero(sims >= least.astype(kind)[:, None])
        if len(own) > self.keep * len(x) and len(y) > self.keep:  # the block's own best set a higher bar
            rows = np.unique(own)
            top = np.partition(sims[rows], len(y) - self.keep, axis=1)[:, len(y) - self.keep]
            least[rows] = np.maximum(least[rows], top.astype(np.float64) - 2 * off)
            own, other = np.nonzero(sims >= least.astype(kind)[:, None])
        return own, other

    def meet(self, place: np.ndarray, start: np.ndarray, end: np.ndarray, m: np.ndarray, mark: np.ndarray | None = None) -> None:
        """Versions are valid for speakers with start < pos <= end; their marks are kept with them."""
        y, alike = unit(m), m.shape[1] == self.m.shape[1]
        own, other = self._candidates(y, start, end, np.float32)
        if len(own) > 4 * self.keep * len(self.m):
            own, other = self._candidates(y, start, end, np.float64)
        if len(own) > 2 * self.keep * len(self.m):  # many are as similar: of equal vectors those with the smallest places are enough
            group = np.unique(m, axis=0, return_inverse=True)[1].reshape(-1)[other] if alike else np.zeros(len(other), np.int64)
            group = np.where(self.zero[own], -1, group)
            order = np.lexsort((place[other], group, own))
            own, other, group = own[order], other[order], group[order]
            far = np.ones(len(own), bool)
            k = self.keep
            far[k:] = (own[k:] != own[:-k]) | (group[k:] != group[:-k])
            own, other = own[far], other[far]
        for i, j in zip(own.tolist(), other.tolist(), strict=True):
            found = (0.0 - (_exact(self.m[i], m[j]) if alike else 0.0), int(place[j]))
            self.best[i].append(found if mark is None else (*found, int(mark[j])))
        for i in np.unique(own).tolist():
            self.best[i] = sorted(self.best[i])[: self.keep]
            if len(self.best[i]) == self.keep:
                self.least[i] = -self.best[i][-1][0]


_KEPT = "array<struct<neg: double, place: bigint, mark: bigint>>"


def _speaker_blocks(speakers: DataFrame, total: int) -> DataFrame:
    """Blocks of speakers in lots of a few that lie side by side; total: places that there are."""
    n = speakers.count()
    part = F.floor(F.col("pos") / (BLOCK * max(1, total // max(1, n))))
    lot = F.floor(part / max(1, -(-n // (MOST_LOTS * BLOCK))))
    pos = F.col("pos")
    return _cut(speakers.select("space", "pos", pos.alias("lo"), pos.alias("hi"), "vec", part.alias("part"), lot.alias("lot")), ["space", "lot"], ["pos"], 0)


def _met(blocks: DataFrame, versions: DataFrame, total: int) -> DataFrame:
    """(pos, t): the KEEP best of the versions that are valid at the place of each speaker of the blocks, best first."""
    n, m = blocks.count(), versions.count()
    lots = blocks.groupBy("space", "lot").agg(F.min("lo").alias("first"), F.max("hi").alias("last"))
    # by time: versions that live shortly, the library's, those until a time, those from a time on, others
    tall = BLOCK * max(1, total // max(1, m))
    short, always = F.col("end") < F.col("start") + BLOCK, (F.col("start") < 0) & (F.col("end") == END)
    part = F.when(always, F.pmod(F.xxhash64("place"), F.lit(-(-m // BLOCK) or 1))).when(F.col("start") < 0, F.floor(F.col("end") / tall)).otherwise(F.floor(F.col("start") / tall))
    sort = F.when(always, 0).when(short, 1).when(F.col("start") < 0, 2).when(F.col("end") == END, 3).otherwise(4)
    b = versions.select("space", "place", "start", "end", "mark", "vec", F.col("start").alias("lo"), F.col("end").alias("hi"), F.struct(sort.alias("sort"), part.alias("part")).alias("part"))
    b = _cut(b, ["space"], ["place", "start", "end", "mark"], 1).join(F.broadcast(lots), "space").where("lo < last and hi >= first").drop("first", "last")
    met = blocks.unionByName(b).repartition(min(4 * MOST_LOTS, max(1, 4 * n)), "space", "lot").sortWithinPartitions("space", "lot", "side", "lo")

    def products(batches):
        held, blocks = None, []

        def done():
            for b in blocks:
                rows = [[{"neg": x, "place": p, "mark": k} for x, p, k in t] for t in b.best]
                kind = pa.list_(pa.struct([("neg", pa.float64()), ("place", pa.int64()), ("mark", pa.int64())]))
                yield pa.RecordBatch.from_arrays([pa.array(b.pos, pa.int64()), pa.array(rows, kind)], names=["pos", "t"])

        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i] for c in batch.schema.names}
                key = r["space"].as_py(), r["lot"].as_py()
                if key != held:  # a lot's speakers come first, then the versions
                    yield from done()
                    held, blocks = key, []
                longs = lambda *names: [np.frombuffer(r[c].as_buffer(), np.int64) for c in names]  # noqa: B023, E731
                if r["side"].as_py() == 0:
                    (pos,) = longs("pos")
                    blocks.append(_Block(pos, _vectors(r["m"].as_buffer(), r["narrow"].as_py(), len(pos)), KEEP))
                    continue
                place, start, end, mark = longs("place", "start", "end", "mark")
                vec, lo, hi = _vectors(r["m"].as_buffer(), r["narrow"].as_py(), len(place)), r["lo"].as_py(), r["hi"].as_py()
                for b in blocks:
                    if lo < b.pos[-1] and hi >= b.pos[0]:
                        b.meet(place, start, end, vec, mark)
        yield from done()

    return met.mapInArrow(products, f"pos long, t {_KEPT}")


def _best(tables: _Tables, speakers: DataFrame, blocks: DataFrame, versions: DataFrame, total: int, known: tuple | None) -> DataFrame:
    """(pos, t, bound): the best valid versions, and what those that are not in t come after; null if t holds all.

    blocks: of all speakers at least. known: what this gave in the round before, that round's versions, and the places of
    the prints whose versions may differ from them (null: all).
    """
    last = F.get("t", F.lit(KEEP - 1))
    full = F.when(last.isNotNull(), F.struct(last["neg"].alias("neg"), last["place"].alias("place")))
    if known is None:
        return tables.written(_met(blocks, versions, total).withColumn("bound", full))
    before, old, touched = known
    before = before.join(speakers.select("pos"), "pos", "left_semi")
    each = before.select("pos", F.inline("t"))
    now = versions
    if touched is None:
        as_it_was = each.limit(0)
    else:
        as_it_was = each.join(touched, "place", "left_anti").select(*each.columns)
        each, old, now = (x.join(touched, "place", "left_semi") for x in (each, old, now))
    o, v = old.alias("o"), now.alias("v")
    same = (F.col("o.place") == F.col("v.place")) & (F.col("o.mark") == F.col("v.mark"))
    added = tables.written(v.join(o.select("place", "mark", "start", "end"), same & (F.col("o.start") <= F.col("v.start")) & (F.col("o.end") >= F.col("v.end")), "left_anti"))
    lives = now.select("place", "mark", "start", "end")
    valid = each.join(lives, ["place", "mark"]).where("start < pos and pos <= end").select("pos", "neg", "place", "mark")
    fresh = _met(blocks, added, total).select("pos", F.inline("t"))
    every = as_it_was.unionByName(valid).unionByName(fresh).groupBy("pos").agg(F.sort_array(F.collect_set(F.struct("neg", "place", "mark"))).alias("t"))
    sure = F.filter(F.coalesce("t", F.array().cast(_KEPT)), lambda x: F.col("bound").isNull() | (F.struct(x["neg"].alias("neg"), x["place"].alias("place")) <= F.col("bound")))
    out = before.select("pos", "bound").join(every, "pos", "left").withColumn("t", F.slice(sure, 1, KEEP))
    out = tables.written(out.select("pos", "t", F.coalesce(full, "bound").alias("bound")))
    few = F.col("bound").isNotNull() & (F.size("t") < 2)
    again = tables.written(speakers.join(out.where(few), "pos", "left_semi"))
    if again.isEmpty():
        return out
    more = _met(tables.written(_speaker_blocks(again, total)), versions, total).withColumn("bound", full)
    return tables.written(out.where(~few).unionByName(more))


def _judged(tables: _Tables, speakers: DataFrame, best: DataFrame, cfg: Config) -> DataFrame:
    """speakers with kind, place, best and second against the versions that are valid at their places."""
    at = lambda i, c: F.get("t", F.lit(i))[c]
    out = speakers.join(best, "pos", "left").withColumns({"best": F.lit(0.0) - at(0, "neg"), "second": F.lit(0.0) - at(1, "neg"), "best_id": at(0, "place")})
    kind = decide(cfg)
    place = F.when(kind.isin("strong", "margin"), F.col("best_id")).when(kind == "new", F.lit(MINTED) + F.col("pos"))
    long_enough = F.coalesce(F.col("duration_ms") >= cfg.min_update_ms, F.lit(True))
    out = out.withColumns({"kind": kind, "place": place}).withColumn("folds", (F.col("kind") == "strong") & long_enough)
    return tables.written(out.select(*speakers.columns, "kind", "place", "best", "second", "folds"))


def _versions(tables: _Tables, library: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(space, place, start, end, vec, mark): what each print is for speakers with start < pos <= end; marks tell its vectors apart."""
    rounded = F.transform("vec", lambda x: x.cast("float").cast("double"))
    fresh = verdicts.where("kind = 'new'")
    # within its own transcript a new print is the speaker's vector as it came
    early = fresh.select("space", "place", F.col("pos").alias("start"), F.col("last").alias("end"), "vec").where("start < end")
    minted = fresh.select("space", "place", F.lit(1).alias("n"), rounded.alias("vec"), F.col("last").alias("start"))
    start = library.select("space", "place", "n", "vec", F.lit(-1).cast("long").alias("start")).unionByName(minted)
    folds = verdicts.where("folds").select("space", "place", "pos", "last", "vec")
    touched = folds.select("place").distinct()
    whole = start.join(touched, "place", "left_anti").select("space", "place", "start", F.lit(END).alias("end"), "vec")
    ddl = "space string, place long, start long, end long, vec array<double>"

    def chain(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []

        def lived(*version):
            if out and out[-1][1] == version[1] and out[-1][4] == version[4]:  # as it was: one version
                version = (*out.pop()[:3], *version[3:])
            out.append(version)

        for r in left.to_pylist():
            space, n, vec, begin = r["space"], r["n"], np.array(r["vec"], np.float64), r["start"]
            rows = sorted(right.to_pylist(), key=lambda f: f["pos"])
            for f in rows:
                v = np.array(f["vec"], np.float64)
                if len(v) == len(vec):
                    if f["last"] > begin:  # the first fold of a transcript ends a version
                        lived(space, r["place"], begin, f["last"], vec.tolist())
                        begin = f["last"]
                    vec, n = ((vec * n + v) / (n + 1)).astype(np.float32).astype(np.float64), n + 1
            lived(space, r["place"], begin, END, vec.tolist())
        cols = list(zip(*out)) or [()] * 5
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64())]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=["space", "place", "start", "end", "vec"])

    tasks = start.sparkSession.sparkContext.defaultParallelism  # many small groups: as few bytes as they have, they take long
    changed = start.join(touched, "place", "left_semi").repartition(tasks, "place").groupBy("place")
    changed = changed.cogroup(folds.repartition(tasks, "place").groupBy("place")).applyInArrow(chain, ddl)
    return tables.written(whole.unionByName(changed).unionByName(early).withColumn("mark", F.xxhash64("vec")))


def _named(tables: _Tables, library: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(place, matched_id): ids of the library's prints, and the first free one of every minted print."""

    @F.pandas_udf(T.StringType())
    def ids(vec: pd.Series, space: pd.Series, salt: pd.Series) -> pd.Series:
        return pd.Series([print_id(v, s or None, int(k)) for v, s, k in zip(vec, space, salt, strict=True)])

    fresh = verdicts.where("kind = 'new'").select("space", "place", "vec", ids("vec", "space", F.lit(0)).alias("plain"))
    fresh = tables.written(fresh.withColumn("salt", F.row_number().over(Window.partitionBy("space", "plain").orderBy("place")) - 1))
    while True:
        named = fresh.withColumn("matched_id", ids("vec", "space", "salt"))
        taken = named.join(library.select("space", F.col("fingerprint_id").alias("matched_id")), ["space", "matched_id"], "left_semi")
        taken = taken.groupBy("space", "plain").agg(F.min("salt").alias("least"))
        if taken.isEmpty():
            break
        moved = fresh.join(taken, ["space", "plain"], "left").withColumn("salt", F.col("salt") + F.coalesce((F.col("salt") >= F.col("least")).cast("int"), F.lit(0)))
        fresh = tables.written(moved.drop("least"))
    return tables.written(named.select("place", "matched_id").unionByName(library.select("place", F.col("fingerprint_id").alias("matched_id"))))


def assign_by_rounds(speakers: DataFrame, prints: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """speaker_key, kind, matched_id, similarity, second_similarity: what identity.assign_in_order gives, in rounds.

    speakers: model, transcript_id, ord, speaker_key, embedding, duration_ms; prints: fingerprint_id, model, status,
    embedding, sample_count. Speakers without an embedding (null or empty) are left out; a null model is one of its own;
    vectors of other lengths, and zero vectors, have similarity 0. Empty speakers give no rows.
    """
    tables = _Tables(speakers.sparkSession)
    space, floats = F.coalesce("model", F.lit("")).alias("space"), F.col("embedding").cast("array<double>").alias("vec")
    own = speakers.where(F.size("embedding") > 0).select(space, "transcript_id", "ord", "speaker_key", "duration_ms", floats)
    own = tables.written(_in_turn(tables, own, "space", "transcript_id", "ord", "speaker_key"))
    last = own.groupBy(F.col("space").alias("s"), F.col("transcript_id").alias("t")).agg(F.max("pos").alias("last"))
    own = own.join(last, (F.col("space") == F.col("s")) & F.col("transcript_id").eqNullSafe(F.col("t"))).select("space", "pos", "last", "speaker_key", "duration_ms", "vec")
    own = tables.written(own)
    active = prints.where("status = 'active'").select(space, "fingerprint_id", F.col("sample_count").alias("n"), F.transform("embedding", lambda x: x.cast("float").cast("double")).alias("vec"))
    library = tables.written(_placed(active, "fingerprint_id", "space").withColumnRenamed("pos", "place"))

    settled, left, before, known, total = None, own, None, None, own.count()
    live = blocks = tables.written(_speaker_blocks(own, total))
    versions = library.select("space", "place", F.lit(-1).cast("long").alias("start"), F.lit(END).alias("end"), "vec", F.xxhash64("vec").alias("mark"))
    whole = touched = None
    while True:
        best = _best(tables, left, live, versions, total, known)
        now = _judged(tables, left, best, cfg)
        if before is not None:
            was = before.select("pos", F.struct("kind", "place", "folds", "best", "second").alias("was"))
            differ = now.join(was, "pos").where(~F.struct("kind", "place", "folds", "best", "second").eqNullSafe(F.col("was")))
            differ = tables.written(differ.select("space", "pos", "place", F.col("was.place").alias("old"), "folds", F.col("was.folds").alias("folded"), "kind", F.col("was.kind").alias("was")))
            first = tables.written(differ.groupBy("space").agg(F.min("pos").alias("first")))
            if first.isEmpty():
                break
            # prints whose samples are others than when all versions were built
            other = differ.where("not (kind <=> was and place <=> old and folds <=> folded)").select(F.explode(F.array("place", "old")).alias("place")).where("place is not null")
            touched = tables.written((other if touched is None else touched.unionByName(other)).distinct())
            # all up to a space's first change are right; spaces without a change are settled
            now = now.join(first, "space", "left")
            done, now = (tables.written(now.where(c).drop("first")) for c in ("first is null or pos <= first", "pos > first"))
            settled = done if settled is None else settled.unionByName(done)
            live = blocks.join(F.broadcast(first), "space").where("hi > first").select(*blocks.columns)
        before, known = now, (best, versions, touched)
        left = now.select(*own.columns)
        verdicts = now if settled is None else settled.unionByName(now)
        if whole is None:
            whole = versions = _versions(tables, library, verdicts)
        else:
            some = _versions(tables, library.join(touched, "place", "left_semi"), verdicts.join(touched, "place", "left_semi"))
            versions = whole.join(touched, "place", "left_anti").select(*whole.columns).unionByName(some.select(*whole.columns))
    verdicts = now if settled is None else settled.unionByName(now)
    named = _named(tables, library, verdicts)
    return verdicts.join(named, "place", "left").select("speaker_key", "kind", "matched_id", F.col("best").alias("similarity"), F.col("second").alias("second_similarity"))
