"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the smallest of its neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands itself and its smaller neighbours to the smallest of them. Needs u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> tuple[DataFrame, list[str]]:
    """(node, root) for every node of edges (u long, v long) that is not itself the least of its component.

    Each round is written to the shared folder, so its lineage ends there; a hub is only ever pre-aggregated or the
    split side of a join. The paths returned hold the result; the caller drops them when it is consumed.
    """
    spark = edges.sparkSession
    oriented = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current, path = materialize(oriented, "edges")
    mark = None
    while True:
        rows = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(rows) == mark or rows[0] == 0:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")), [path]
        mark = tuple(rows)
        following, new = materialize(_small_star(_large_star(current)), "edges")
        drop_path(spark, path)
        current, path = following, new
