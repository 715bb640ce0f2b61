"""Cross-validation folds: stratified, and stratified by groups."""

from __future__ import annotations

from collections import defaultdict
from statistics import pstdev

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import BROADCAST_ROWS, written


def seeded(seed, *columns) -> Column:
    """A pseudo-random order that any engine with SHA-256 repeats."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns]), 256)


def rank_within(keys: DataFrame, by: str, order: list[str], rank: str = "rank") -> DataFrame:
    """keys with the rank, from 1, of each row among those of its `by` in the order given, without one task for each value of `by`.

    Rows are range-partitioned by (by, order) and written; a row's rank is its place among its partition's rows of the same value plus
    the counts of the partitions before, one row for each partition and value that it holds. Null is a value.
    """
    spark = keys.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ranged = written(keys.repartitionByRange(parts, by, *order).withColumn("__part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy(by, "__part").agg(F.count("*").alias("__n"))  # at most partitions + values rows
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy(by, "__part").orderBy(*order))
    placed = ranged.withColumn("__own", own)
    before = before.select(F.col(by).alias("__by"), F.col("__part").alias("__p"), "__before")
    return placed.join(before, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__part") == F.col("__p"))).select(*keys.columns, (F.col("__own") + F.col("__before")).alias(rank))


def stratified_folds(df: DataFrame, k: int = 5, seed: int = 42, label: str = "label") -> DataFrame:
    """df with fold_id: within each label the seeded order, dealt round. Only ids and labels are ranked; rows that share an id share its
    fold (that of its least label), so that no copy of a sample is trained on."""
    ids = df.groupBy("id").agg(F.min(label).alias("__label")).withColumn("__order", seeded(seed, "id"))
    ranked = rank_within(ids, "__label", ["__order", "id"], "__rank").select(F.col("id").alias("__id"), ((F.col("__rank") - 1) % k).cast("int").alias("fold_id"))
    return df.join(ranked, F.col("id").eqNullSafe(F.col("__id"))).drop("__id")


def assign_groups(counts: dict[str, dict[str, int]], k: int, seed: int) -> dict[str, int]:
    """Fold of each group: in seeded order, groups with the most uneven class counts first, each goes where the spread
    of the classes over folds stays least. counts: rows by group and label."""
    import hashlib

    labels = sorted({x for c in counts.values() for x in c})
    totals = {x: sum(c.get(x, 0) for c in counts.values()) for x in labels}
    order = sorted(counts, key=lambda g: hashlib.sha256(f"{seed}|{g}".encode()).hexdigest())
    order.sort(key=lambda g: -pstdev([counts[g].get(x, 0) for x in labels]) if len(labels) > 1 else -sum(counts[g].values()))
    folds = [defaultdict(int) for _ in range(k)]
    out = {}
    for g in order:
        def cost(f: int) -> tuple:
            spread = 0.0
            for x in labels:
                spread += pstdev([(folds[i][x] + (counts[g].get(x, 0) if i == f else 0)) / totals[x] for i in range(k)])
            return (round(spread, 12), sum(folds[f].values()), f)
        best = min(range(k), key=cost)
        out[g] = best
        for x, n in counts[g].items():
            folds[best][x] += n
    return out


def grouped_folds(df: DataFrame, k: int = 5, seed: int = 42, max_groups: int = 100_000) -> DataFrame:
    """df with fold_id, no group in two folds. Only (group, label) counts come to the driver, of max_groups at most."""
    cells = df.groupBy("template_group", "label").agg(F.count("*").alias("n"))
    if cells.select("template_group").distinct().count() > max_groups:
        raise ValueError(f"more than {max_groups} groups")
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for g, x, n in cells.collect():
        counts[g][x] = n
    rows = sorted(assign_groups(counts, k, seed).items())
    folds = df.sparkSession.createDataFrame(rows, "template_group string, fold_id int")
    return df.join(F.broadcast(folds) if len(rows) <= BROADCAST_ROWS else folds, "template_group")


def fold_records(assigned: DataFrame, k: int) -> DataFrame:
    """The long form, a row for each fold and sample, of rows with fold_id."""
    folds = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold")
    long = assigned.select(F.col("id").alias("sample_id"), "label", "template_group", F.col("fold_id").alias("own"), folds)
    return long.select("sample_id", F.col("fold").alias("fold_id"), F.when(F.col("fold") == F.col("own"), "validation").otherwise("train").alias("split_role"), "label", "template_group")


def fold_imbalance(assigned: DataFrame) -> DataFrame:
    """Per fold and label, and per fold in all: groups, samples and the sizes of the groups as text."""
    groups = assigned.groupBy("fold_id", "label", "template_group").agg(F.count("*").alias("n"))
    cube = groups.groupingSets([["fold_id", "label"], ["fold_id"]], "fold_id", "label")
    return cube.agg(
        F.countDistinct("template_group").alias("groups"), F.sum("n").alias("samples"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("template_group", "label", "n"))), lambda x: F.concat(x["template_group"], F.lit(":"), x["n"].cast("string"))), ";").alias("breakdown"),
        F.grouping("label").alias("g"),
    ).select("fold_id", F.when(F.col("g") == 1, "ALL").otherwise(F.col("label")).alias("label"), "groups", "samples", "breakdown")


IMBALANCE = ("data_hash", "fold_artifact_hash", "fold_id", "label", "groups", "samples", "breakdown")


def imbalance_summary(rows: DataFrame) -> DataFrame:
    """One row about a fold imbalance table (columns IMBALANCE, as of fold_imbalance): cells, how many cells have how many
    groups ("1:18;2:2"), least and most groups and samples of a cell and samples of a fold. An error if a column is missing,
    rows are of several inputs, or cells or totals are missing."""
    if missing := set(IMBALANCE) - set(rows.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    every, cell = F.col("label") == "ALL", F.col("label") != "ALL"
    total = lambda f, c: f(F.when(every, F.col(c)))
    of = lambda f, c: f(F.when(cell, F.col(c)))
    one = rows.agg(
        F.countDistinct("data_hash").alias("data"), F.countDistinct("fold_artifact_hash").alias("folds"), F.count_if(every).alias("totals"), F.count_if(cell).alias("cells"),
        of(F.min, "groups").alias("least_groups"), of(F.max, "groups").alias("most_groups"), of(F.min, "samples").alias("least_samples"), of(F.max, "samples").alias("most_samples"),
        total(F.min, "samples").alias("least_fold"), total(F.max, "samples").alias("most_fold"),
    )
    sizes = rows.where(cell).groupBy("groups").agg(F.count("*").alias("n")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("groups", "n"))), lambda x: F.concat_ws(":", x["groups"].cast("string"), x["n"].cast("string"))), ";").alias("distribution"))
    wrong = F.when(F.col("data") != 1, "rows of several corpora").when(F.col("folds") != 1, "rows of several fold tables").when((F.col("totals") == 0) | (F.col("cells") == 0), "cells or totals are missing")
    checked = F.when(wrong.isNotNull(), F.raise_error(wrong).cast("long")).otherwise(F.col("cells"))
    return one.crossJoin(F.broadcast(sizes)).select(checked.alias("cells"), "distribution", "least_groups", "most_groups", "least_samples", "most_samples", "least_fold", "most_fold")  # two single rows
