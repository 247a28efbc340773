"""Order MinHash fingerprints, sensitive to edit distance, in DataFrame functions only.

A document's k-mers are its runs of `kmer` words, numbered by occurrence: the second "a b c" differs from the first. The
hash of (k-mer, number) sends each to one of SLOTS ranges of the hash space, a min-wise sample each. A slot takes its
two minimal hashes, puts them in text order, and hashes the pair. So a slot agrees if both documents hold the same two
k-mers in the same order: swapped, repeated or replaced passages show, as they do in the edit distance and not in a set.

A short text leaves ranges with one k-mer or none, and one k-mer has no order. The filled signature takes the two minima
of such a slot over all k-mers, by a hash of the slot's own; where a slot of both texts lacks k-mers they are compared
by that sample, and where only one lacks them they differ, since the other's pair is not in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, let, shuffle_partitions

SLOT_BITS = 5
SLOTS = 1 << SLOT_BITS
SPACE = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    """Runs of characters other than space and 9 to 13."""
    bare = F.btrim(text, F.lit(SPACE))
    return F.when(F.length(bare) > 0, F.split(bare, "[\\x20\\x09-\\x0D]+")).otherwise(F.array().cast("array<string>"))


def _keyed(kmers: Column) -> Column:
    """(h, p) of every k-mer: the hash of k-mer and occurrence number, the place in the text."""
    plain = F.transform(kmers, lambda x, i: F.struct(F.xxhash64(x, F.lit(0)).alias("h"), i.alias("p")))

    def numbered(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~F.get(s, i - 1)["h"].eqNullSafe(F.get(s, i)["h"]))

        def runs(b: Column) -> Column:
            return F.flatten(
                F.transform(
                    b,
                    lambda a, j: F.transform(
                        F.slice(s, a + 1, F.coalesce(F.get(b, j + 1), n) - a),
                        lambda x, o: F.struct(F.xxhash64(x["h"], o).alias("h"), x["p"].alias("p")),
                    ),
                )
            )

        return let(starts, runs)

    by_kmer = F.sort_array(F.transform(kmers, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    return F.when(F.size(F.array_distinct(kmers)) == F.size(kmers), plain).otherwise(let(by_kmer, numbered))


def _slot(x: Column) -> Column:
    return F.shiftright(x["h"], 64 - SLOT_BITS)


def signatures(text: Column, kmer: int = 3) -> Column:
    """Struct of two arrays of SLOTS longs. A text of 1 to kmer - 1 words is one k-mer; an empty or null one has none.

    signature: of each slot's own k-mers; null where it got none. filled: slots with fewer than two take theirs from all
    k-mers; null as a whole if no slot needs that, as it equals signature then.
    """

    def kmers(h: Column) -> Column:
        n = F.size(h)
        runs = F.transform(F.slice(h, 1, F.greatest(n - (kmer - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, kmer)]))
        return F.when(n >= kmer, runs).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<long>"))

    def minima(s: Column) -> Column:
        return F.filter(s, lambda x, i: ~_slot(F.get(s, i - 2)).eqNullSafe(_slot(x)))

    def tuples(m: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            y = F.get(m, i + 1)
            pair = F.when(x["p"] <= y["p"], F.xxhash64(x["h"], y["h"])).otherwise(F.xxhash64(y["h"], x["h"]))
            value = F.when(_slot(y).eqNullSafe(_slot(x)), pair).otherwise(F.xxhash64(x["h"]))
            first = ~_slot(F.get(m, i - 1)).eqNullSafe(_slot(x))
            return F.when(first, F.struct(_slot(x).alias("slot"), value.alias("value")))

        return F.filter(F.transform(m, one), lambda x: x.isNotNull())

    def dense(t: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(-SLOTS // 2), F.lit(SLOTS // 2 - 1)),
            lambda j: F.get(F.transform(F.filter(t, lambda x: x["slot"] == j.cast("long")), lambda x: x["value"]), F.lit(0)),
        )

    def rehashed(k: Column, slot: Column) -> Column:
        """The value of a slot whose two minima are over all k-mers."""

        def value(m: Column) -> Column:
            x, y = F.get(m, F.lit(0)), F.get(m, F.lit(1))
            pair = F.when(x["p"] <= y["p"], F.xxhash64(x["h"], y["h"])).otherwise(F.xxhash64(y["h"], x["h"]))
            return F.when(y.isNotNull(), pair).when(x.isNotNull(), F.xxhash64(x["h"]))

        return let(F.sort_array(F.transform(k, lambda x: F.struct(F.xxhash64(x["h"], slot).alias("h"), x["p"].alias("p")))), value)

    def filled(k: Column, m: Column, own: Column) -> Column:
        def one(value: Column, i: Column) -> Column:
            slot = (i - SLOTS // 2).cast("long")
            return F.when(F.size(F.filter(m, lambda x: _slot(x) == slot)) == 2, value).otherwise(rehashed(k, slot))

        return F.when(F.size(m) < 2 * SLOTS, F.transform(own, one))

    def both(k: Column) -> Column:
        def of(m: Column) -> Column:
            return let(let(tuples(m), dense), lambda own: F.struct(own.alias("signature"), filled(k, m, own).alias("filled")))

        return let(minima(k), of)

    hashes = F.transform(words_of(F.coalesce(text, F.lit(""))), lambda w: F.xxhash64(w))
    return let(let(let(hashes, kmers), lambda k: F.sort_array(_keyed(k))), both)


def signature(text: Column, kmer: int = 3, fill: bool = False) -> Column:
    """Array of SLOTS longs: with fill, null only for a text without words, else also where a slot got no k-mer."""
    both = signatures(text, kmer)
    return let(both, lambda s: F.coalesce(s["filled"], s["signature"])) if fill else both["signature"]


def signature_text(signature: Column) -> Column:
    """SLOTS groups of 8 hexadecimal digits; '........' for a slot without k-mers."""
    digits = lambda x: F.coalesce(F.lpad(F.lower(F.hex(F.shiftrightunsigned(x, 32))), 8, "0"), F.lit("." * 8))
    return F.array_join(F.transform(signature, digits), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of agreeing slots among those in which either has k-mers; 1.0 for two documents without words."""
    held = F.size(F.filter(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.get(a, i).isNotNull() | F.get(b, i).isNotNull()))
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.get(a, i) == F.get(b, i)))
    return F.when(held == 0, F.lit(1.0)).otherwise(same / held)


def fingerprints(df: DataFrame, text: str = "text", kmer: int = 3, name: str = "signature", fill: bool = False) -> DataFrame:
    """df with the column `name` (replaced if there): the Order MinHash signature of each whole text.

    Null and empty texts have all slots null; equal texts have equal signatures. Without `fill`, slots of texts of up to
    some hundred words lack the order of k-mers.
    """
    return df.withColumn(name, signature(F.col(text), kmer, fill))


def with_next(df: DataFrame, columns: list[str], derived: dict[str, Column] | None = None) -> DataFrame:
    """df (doc_id, text and the columns) with next_<column>: those of the next row by descending (doc_id, text).

    After the last row comes the first. Null doc_ids come last; of rows with equal doc_id and text either may be first.
    Rows are dealt into ranges of doc_id between quantiles; each range also gets the first row of the next range, so that
    it finds every successor by itself. `derived` columns are added once the rows are in their ranges: what is costly to
    compute or wide is neither computed for the ranges' first rows twice nor exchanged. An empty df gives no rows; rows of
    one doc_id are one range. Columns of df named like an output are replaced; its others may have any name.
    """
    given = [c for c in df.columns if c not in ("doc_id", "text") and c not in (derived or {}) and not c.startswith("next_")]
    df = df.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in given], F.lit(0).alias("__")).alias("given"))
    spark = df.sparkSession
    n = 2 * shuffle_partitions(spark)
    lowest = F.lit(-(2**63)).cast("long")
    ids = df.select(F.percentile_approx(F.coalesce("doc_id", lowest), [i / n for i in range(1, n)], 20 * n).alias("q"))
    cuts = sorted(set(ids.first()["q"] or []))
    bounds = F.array(*map(F.lit, cuts)).cast("array<long>")
    ranged = df.withColumn("__range", F.size(F.filter(bounds, lambda q: q <= F.coalesce("doc_id", lowest))))
    key = F.struct(F.coalesce("doc_id", lowest).alias("d"), F.coalesce("text", F.lit("")).alias("t"))
    heads = ranged.groupBy("__range").agg(F.max_by(F.struct(*df.columns), key).alias("head"))
    down = Window.orderBy(F.col("__range").desc())  # a row for each range
    whole = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("__range", F.coalesce(F.lead("head").over(down), F.first("head").over(whole)).alias("head"))
    added = heads.select("head.*", "__range", F.lit(True).alias("__added"))
    both = ranged.withColumn("__added", F.lit(False)).unionByName(added).repartition("__range").withColumns(derived or {})
    order = Window.partitionBy("__range").orderBy("__added", F.coalesce("doc_id", lowest).desc(), F.coalesce("text", F.lit("")).desc())
    own = {"doc_id", "text", *(derived or {})}
    following = [F.lead(F.col(c) if c in own else F.col(f"given.`{c}`")).over(order).alias(f"next_{c}") for c in columns]
    out = both.select("*", *following).where("not __added")
    return out.select("doc_id", "text", *[F.col(f"given.`{c}`").alias(c) for c in given], *[f"`{c}`" for c in derived or {}], *[f"`next_{c}`" for c in columns])


def op10_order_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns are of the filled signatures, which keep the order of k-mers in texts of any length; those
    named sampled_ are of the slots' own k-mers alone."""
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    docs = documents(spark, sf_dir).select("doc_id", text)
    both = with_next(docs, ["text", "both"], {"both": signatures(F.col("text"))})
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    both = both.select("doc_id", n.cast("long").alias("n_chars"), "both", "next_both", edited.alias("edited"))
    both = both.withColumn("edited_both", signatures(F.col("edited")))
    own, edited_own, next_own = (F.col(c)["signature"] for c in ("both", "edited_both", "next_both"))
    ordered, edited_ordered, next_ordered = (F.coalesce(F.col(c)["filled"], F.col(c)["signature"]) for c in ("both", "edited_both", "next_both"))
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), signature_text(ordered).alias("fingerprint"),
        signature_text(edited_ordered).alias("edited_fingerprint"),
        likeness(ordered, edited_ordered).alias("near_edited"),
        likeness(ordered, next_ordered).alias("near_next"),
        signature_text(own).alias("sampled_fingerprint"), signature_text(edited_own).alias("edited_sampled_fingerprint"),
        likeness(own, edited_own).alias("sampled_near_edited"),
        likeness(own, next_own).alias("sampled_near_next"),
    )
