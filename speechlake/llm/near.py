"""Near-duplicates: MinHash with banding, verification, and connected components.

1. Every text gets the set of its 5-word shingles (64-bit hashes), PERMUTATIONS minima under universal hashes, and a
   128-bit digest of its words. Texts with one digest are one class; the smallest doc_id stands for it.
2. Representatives meet in BANDS bands of ROWS minima. In each band's bucket all are held against its hub, the
   member that shares most buckets with others; a pair is compared by signature, then confirmed on the full sets. So a
   bucket of n costs n pairs. A pair of similarity 0.75 shares ten bands on average, and none with a chance of 5e-6.
3. Confirmed links make components. Texts in buckets that still hold several are compared across components, block by
   block: no link between members other than the hub is lost, and no pair becomes a row.
4. Components of all links; copies take their class's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, first_of_runs, fitted, schema_with, workers_see_package
from .components import connected_components
from .words import Words, rolling, sliced

WIDTH = 5
PERMUTATIONS, ROWS = 128, 4
BANDS = PERMUTATIONS // ROWS
#: Similarity from which texts are linked, in hundredths.
LINK = 75
#: Texts of a block that is compared as a whole.
BLOCK = 128
#: Signatures that agree in fewer places are not looked at further: five standard deviations below 0.75.
LEAST_AGREEING = int(PERMUTATIONS * (0.75 - 5 * (0.75 * 0.25 / PERMUTATIONS) ** 0.5))
#: Rows (doc_id and digest, some 40 bytes each) that are broadcast at most.
BROADCAST_ROWS = 500_000
_RNG = np.random.default_rng(20)
_A = _RNG.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)


def shingle_sets(texts: pa.Array) -> tuple[list[np.ndarray], list[bytes]]:
    """Of each text the sorted distinct hashes of its 5-word shingles, A to Z in lower case (of fewer words, of the whole
    sequence; none without words), and a 128-bit digest of its words."""
    w = Words(texts, True)
    h, rolled, sets, digests = w.h, rolling(w.h, WIDTH), [], []
    for a, b in zip(w.first.tolist(), w.first[1:].tolist()):
        width = min(WIDTH, b - a)
        runs = rolled[a : b - WIDTH + 1] if width == WIDTH else rolling(h[a:b], width) if width else h[:0]
        sets.append(np.unique(runs) ^ np.uint64(width))
        digests.append(xxhash.xxh3_128_digest(h[a:b].tobytes()))
    return sets, digests


def lowered(text: str | None) -> list[bytes]:
    """Words, A to Z in lower case (bytes.lower changes no others)."""
    return text.encode().lower().split() if text else []


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Row of PERMUTATIONS minima (32 bits) for each set; zeros for an empty one."""
    out = np.zeros((len(sets), PERMUTATIONS), np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(full):
        n, end = 0, at
        while end < len(full) and (end == at or n + len(sets[full[end]]) <= 100_000):
            n, end = n + len(sets[full[end]]), end + 1
        x = np.concatenate([sets[i] for i in full[at:end]])
        starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full[at:end]])[:-1]])
        v = np.empty_like(x)
        for k in range(PERMUTATIONS):
            np.multiply(x, _A[k], out=v)
            np.add(v, _B[k], out=v)
            out[full[at:end], k] = np.minimum.reduceat(v, starts) >> np.uint64(32)
        at = end
    return out


def described(df: DataFrame) -> DataFrame:
    """df's other columns than text with n_shingles, digest (binary) and signature (binary)."""
    workers_see_package(df.sparkSession)
    text = df.schema.fieldNames().index("text")
    schema = schema_with(df.drop("text"), "n_shingles long, digest binary, signature binary")

    def describe(batches):
        for b in (part for whole in batches for part in sliced(whole, text)):
            sets, digests = shingle_sets(b.column(text))
            new = [
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array([s.tobytes() for s in signatures(sets)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(b.columns) if i != text), *new], names=schema.fieldNames())

    return df.mapInArrow(describe, schema)


def _agreeing(pairs: DataFrame) -> DataFrame:
    """(a, b) of pairs with signatures sa, sb that may reach the similarity."""

    def compare(batches):
        for b in batches:
            sa, sb = (np.frombuffer(b"".join(c.to_pylist()), np.uint32).reshape(-1, PERMUTATIONS) for c in (b.column(2), b.column(3)))
            near = (sa == sb).sum(1) >= LEAST_AGREEING
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(near))

    return pairs.select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long")


def _sets(docs: DataFrame, classes: DataFrame, ids: DataFrame, wanted_rows: int, rows: int) -> DataFrame:
    """(rep, shingles as bytes) of the representatives in ids. Few of them are sent to the texts, many meet them in a join."""

    def build(batches):
        for b in (part for whole in batches for part in sliced(whole, 1)):
            sets, digests = shingle_sets(b.column(1))
            own = [i for i, (mine, wanted) in enumerate(zip(digests, b.column(2).to_pylist(), strict=True)) if mine == wanted]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own, pa.int64())), pa.array([sets[i].tobytes() for i in own], pa.binary())], names=["rep", "shingles"])

    wanted = fitted(classes.join(ids, "rep"), rows).select(F.col("rep").alias("doc_id"), "digest")
    wanted = F.broadcast(wanted) if wanted_rows <= BROADCAST_ROWS else wanted
    found = docs.join(wanted, "doc_id").select("doc_id", "text", "digest").mapInArrow(build, "rep long, shingles binary")
    return found.dropDuplicates(["rep"])


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets reach the similarity."""
    if 100 * min(len(x), len(y)) < LINK * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    union = int(first_of_runs(both).sum())
    return 100 * (len(x) + len(y) - union) >= LINK * union


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v) of pairs whose full sets reach the similarity."""

    def confirm(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                keep.append(similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("xa"))
    two = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("xb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "xa", "xb").mapInArrow(confirm, "u long, v long")


def _links(tables: Scratch, classes: DataFrame, sets: DataFrame, pairs: DataFrame, rows: int) -> DataFrame:
    """Confirmed (u, v) of candidate pairs (a, b)."""
    one = classes.select(F.col("rep").alias("a"), F.col("signature").alias("sa"), F.col("n_shingles").alias("na"))
    two = classes.select(F.col("rep").alias("b"), F.col("signature").alias("sb"), F.col("n_shingles").alias("nb"))
    sized = fitted(fitted(pairs.join(one, "a"), rows).join(two, "b"), rows)
    sized = sized.where(100 * F.least("na", "nb") >= LINK * F.greatest("na", "nb"))
    return tables.written(_confirmed(_agreeing(sized), sets), "links")


def _cross_links(tables: Scratch, classes: DataFrame, sets: DataFrame, mixed: DataFrame, rows: int) -> DataFrame:
    """Confirmed (u, v) across the components of mixed (band, rep, component): buckets that hold several components.

    Texts that meet in such buckets, directly or by others, form a group. A group is cut into blocks of BLOCK texts, and
    blocks are compared in pairs: signatures as matrices, then the full sets of those that may be near. So a pair of
    texts costs 128 comparisons of numbers and no row, and a task holds a few blocks, whatever the size of the group.
    """
    spark = tables.spark
    first = mixed.groupBy("band").agg(F.min("rep").alias("v"))
    n = mixed.count()
    edges = fitted(mixed.join(tables.written(fitted(first, n), "first"), "band"), n).select(F.col("rep").alias("u"), "v")
    groups = connected_components(edges).select(F.col("node").alias("rep"), F.col("component").alias("g"))
    each = fitted(mixed.select("rep", "component").distinct(), n).join(groups, "rep")
    each = tables.written(fitted(each, n), "grouped")
    size = tables.written(fitted(each.groupBy("g").agg(F.count(F.lit(1)).alias("n")), n), "sizes")
    texts = fitted(fitted(each.join(size, "g"), n).join(sets, "rep"), rows).join(classes.select("rep", "signature"), "rep")
    part = F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / BLOCK)).cast("int")
    texts = fitted(texts.select("g", part.alias("part"), "rep", "component", "signature", "shingles"), rows)

    def block(t: pa.Table) -> pa.Table:
        cols = {"g": t.column("g").slice(0, 1), "part": t.column("part").slice(0, 1)}
        lists = {new: [t.column(c).to_pylist()] for c, new in (("rep", "reps"), ("component", "components"), ("signature", "signatures"), ("shingles", "sets"))}
        return pa.table({**cols, **lists})

    kinds = "g long, part int, reps array<long>, components array<long>, signatures array<binary>, sets array<binary>"
    blocks = tables.written(texts.groupBy("g", "part").applyInArrow(block, kinds), "blocks")

    def compare(batches):
        for b in batches:
            for r in b.to_pylist():
                us, vs = [], []
                sig = [np.frombuffer(b"".join(r[k]), np.uint32).reshape(-1, PERMUTATIONS) for k in ("a_signatures", "b_signatures")]
                comp = [np.array(r[k]) for k in ("a_components", "b_components")]
                for i, row in enumerate(sig[0]):
                    near = ((sig[1] == row).sum(1) >= LEAST_AGREEING) & (comp[1] != comp[0][i])
                    if near.any():
                        x = np.frombuffer(r["a_sets"][i], np.uint64)
                        for j in np.flatnonzero(near).tolist():
                            if similar(x, np.frombuffer(r["b_sets"][j], np.uint64)):
                                us.append(r["a_reps"][i])
                                vs.append(r["b_reps"][j])
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    named = lambda x: blocks.select("g", *[F.col(c).alias(f"{x}_{c}") for c in ("part", "reps", "components", "signatures", "sets")])
    met = named("a").join(named("b"), "g").where("a_part <= b_part")
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "4")  # a row holds two blocks
    try:
        return tables.written(met.mapInArrow(compare, "u long, v long"), "links")
    finally:
        spark.conf.set(batch, before)


def near_duplicates(df: DataFrame) -> DataFrame:
    """df (doc_id long, text; others kept, but for text) with n_shingles, component_id (long) and kept (boolean).

    Texts are linked from a similarity of 0.75 on; component_id is the smallest doc_id that links reach, kept marks the
    row that has it. A text without words (or null) is linked with nothing, as is a row without doc_id (component_id
    null); both are kept. Rows that share a doc_id count as one node of the graph, so that all of a kept document's rows
    are kept. Columns of df named like an output are replaced. A very long text is one set, built in one task; an empty df
    gives no rows. The result reads tables in the shared folder; its attribute `tables` frees them before the session ends.
    """
    spark = df.sparkSession
    tables = Scratch(spark)
    df = df.drop("n_shingles", "component_id", "kept", "digest", "signature", "component")
    base = tables.written(described(df), "described")
    rows = base.count()
    docs = df.select("doc_id", "text").where("doc_id is not null")
    classes = base.where("doc_id is not null and n_shingles > 0").groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")
    )
    classes = tables.written(fitted(classes, 4 * rows), "classes")
    band = [F.xxhash64(F.lit(i), F.substring("signature", 4 * ROWS * i + 1, 4 * ROWS)) for i in range(BANDS)]
    banded = classes.select("rep", F.explode(F.array(*band)).alias("band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = tables.written(fitted(shared, BANDS * rows // 4), "shared")
    members = tables.written(fitted(banded.join(shared, "band"), BANDS * rows // 4), "members")
    # the hub of a bucket: the text that shares most elsewhere, an original rather than one of its copies
    reach = tables.written(fitted(members.groupBy("rep").agg(F.sum("n").alias("reach")), rows), "reach")
    sets = tables.written(_sets(docs, classes, reach.select("rep"), reach.count(), rows), "sets")
    members = tables.written(fitted(members.select("rep", "band").join(reach, "rep"), BANDS * rows // 4), "members")
    hub = members.groupBy("band").agg(F.max_by("rep", F.struct("reach", -F.col("rep"))).alias("hub"))
    hub = tables.written(fitted(hub, BANDS * rows // 4), "hubs")
    pairs = members.join(hub, "band").where("rep <> hub").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"))
    pairs = fitted(fitted(pairs, BANDS * rows // 4).distinct(), rows)
    links = _links(tables, classes, sets, pairs, rows)
    found = connected_components(links)

    of = found.select(F.col("node").alias("rep"), "component")
    placed = members.join(of, "rep", "left").select("band", "rep", F.coalesce("component", "rep").alias("component"))
    members = members.select("band", "rep")
    met = members.count()
    placed = tables.written(fitted(placed, met), "placed")
    mixed = placed.groupBy("band").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1")
    mixed = fitted(placed.join(tables.written(fitted(mixed.select("band"), met), "mixed"), "band"), met)
    mixed = tables.written(mixed, "mixed-members")
    more = _cross_links(tables, classes, sets, mixed, rows)
    if not more.isEmpty():
        found = connected_components(links.unionByName(more))

    of = found.select(F.col("node").alias("rep"), "component")
    named = classes.join(of, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    named = tables.written(fitted(named, rows), "named")
    tables.free(base, named)
    out = base.join(named, "digest", "left").drop("digest", "signature")
    own = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    out = out.withColumn("component_id", F.when(own, F.col("component")).otherwise(F.col("doc_id"))).drop("component")
    out = out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
    out.tables = tables
    return out


def op5_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))


#: DuckDB: the rows of op5_minhash_near_duplicates.
OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: hash(array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [hash(array_to_string(w, ' '))] ELSE [] END) AS h
  FROM d
), n AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), e AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS MATERIALIZED (
  SELECT a, b FROM e JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT b, r.c FROM r JOIN l ON l.a = r.doc_id
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""
