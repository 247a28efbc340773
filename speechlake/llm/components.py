"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fitted, written


def _least(tables: Scratch, edges: DataFrame, rows: int) -> DataFrame:
    """Smallest neighbour of each u, as a table of its own so that a join with a hot u can be split."""
    return tables.written(fitted(edges.groupBy("u").agg(F.min("v").alias("m")), rows), "least")


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of links (u, v longs): the smallest node that can be reached.

    Edges point from a larger node u to a smaller one v. Large-star ties each larger neighbour of a node to the node's
    smallest neighbour; small-star ties a node's smaller neighbours to the smallest. When both leave the edges as they
    are, every component is a star around its smallest node. Each round is written to the shared folder.
    """
    spark = links.sparkSession
    tables = Scratch(spark)
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    rows = edges.count()
    edges = tables.written(fitted(edges.distinct(), rows), "edges")
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(tables, both, rows).select("u", F.least("u", "m").alias("m"))
        large = fitted(both.where("v > u").join(least, "u"), rows).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = tables.written(fitted(large.distinct(), rows), "large")
        least = _least(tables, large, rows)
        tied = fitted(large.join(least, "u"), rows).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = tables.written(fitted(tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), rows), "edges")
        before, state = state, _state(edges)
        tables.free(edges)
        if state == before:
            break
    roots = fitted(edges.select(F.col("v").alias("node")).distinct(), rows).withColumn("component", F.col("node"))
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    found = written(spark, found, "components")
    tables.free()
    return found
