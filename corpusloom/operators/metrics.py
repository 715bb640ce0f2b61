"""Metrics of out-of-fold predictions: (sample_id, condition, model, fold_id, true_label, predicted_label)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import nearest_rank, safe_divide

CELL = ["condition", "model"]


def label_counts(oof: DataFrame, by: list[str]) -> DataFrame:
    """tp, support and predicted of every label that a cell has as true or predicted. One pass: each row counts for its
    true and its predicted label, pre-aggregated."""
    same = F.col("true_label") == F.col("predicted_label")
    parts = F.array(
        F.struct(F.col("true_label").alias("label"), F.lit(1).alias("s"), F.lit(0).alias("p"), same.cast("int").alias("t")),
        F.struct(F.col("predicted_label").alias("label"), F.lit(0).alias("s"), F.lit(1).alias("p"), F.lit(0).alias("t")),
    )
    long = oof.select(*by, F.explode(parts).alias("x")).select(*by, "x.*")
    return long.groupBy(*by, "label").agg(F.sum("t").alias("tp"), F.sum("s").alias("support"), F.sum("p").alias("predicted"))


def metrics_long(oof: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, metric, value): accuracy, macro_f1, weighted_f1 and precision, recall, f1 of each label; 0 for 0/0."""
    by = by or [*CELL, "fold_id"]
    c = label_counts(oof, by)
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    scored = c.withColumns({"precision": safe_divide(tp, predicted), "recall": safe_divide(tp, support), "f1": safe_divide(2 * tp, support + predicted)})
    each = scored.select(*by, F.explode(F.array(*[F.struct(F.concat(F.lit(m + "_"), "label").alias("metric"), F.col(m).alias("value")) for m in ("precision", "recall", "f1")])).alias("x")).select(*by, "x.*")
    whole = scored.groupBy(*by).agg(F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"), (F.sum("tp") / F.sum("support")).alias("accuracy"))
    return each.unionByName(whole.unpivot(by, ["accuracy", "macro_f1", "weighted_f1"], "metric", "value"))


def cv_summary(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean, population deviation and number of folds."""
    return metrics.groupBy(*(by or CELL), "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("*").alias("n_folds"))


def confusion_long(oof: DataFrame, by: list[str] | None = None) -> DataFrame:
    return oof.groupBy(*(by or CELL), "true_label", "predicted_label").agg(F.count("*").alias("count"))


def confusion_pivot(oof: DataFrame, labels: list[str], by: list[str] | None = None) -> DataFrame:
    counts = [F.count_if(F.col("predicted_label") == x).alias(f"predicted_{x}") for x in labels]
    return oof.groupBy(*(by or CELL), "true_label").agg(*counts)


def paired_differences(metrics: DataFrame, baseline: str, by: str = "condition", over: list[str] | None = None, observed_only: bool = False) -> DataFrame:
    """Differences to the baseline over folds: mean, deviation, numbers of better and worse folds. Every combination of
    observed values must be there, else an error; with observed_only, of the observed cells."""
    over = over or ["model"]
    keys = [*over, "metric", "fold_id"]
    base = metrics.where(F.col(by) == baseline).select(*keys, F.col("value").alias("base"))
    rest = metrics.where(F.col(by) != baseline).select(by, *keys, "value")
    if observed_only:
        grid = rest.select(by, *keys)
    else:
        grid = rest.select(by).distinct().crossJoin(metrics.select(*over).distinct()).crossJoin(metrics.select("metric").distinct()).crossJoin(metrics.select("fold_id").distinct())
    both = grid.join(rest, [by, *keys], "left").join(base, keys, "left")
    lost = F.raise_error(F.lit("a fold has no pair")).cast("double")
    diff = both.select(by, *over, "metric", F.when(F.col("value").isNull() | F.col("base").isNull(), lost).otherwise(F.col("value") - F.col("base")).alias("d"))
    return diff.groupBy(by, *over, "metric").agg(F.avg("d").alias("mean_difference"), F.stddev_pop("d").alias("std_difference"), F.count_if(F.col("d") > 0).alias("n_improved"), F.count_if(F.col("d") < 0).alias("n_worsened"), F.count("*").alias("n_folds"))


def best_cell(summary: DataFrame, metric: str = "macro_f1") -> DataFrame:
    """The cell of the largest mean; ties go to the last by name."""
    return summary.where(F.col("metric") == metric).agg(F.max(F.struct("mean", *CELL)).alias("b")).select("b.*")


def required_metrics(metrics: DataFrame, labels: list[str]) -> DataFrame:
    """Accuracy, macro precision, macro recall, macro F1 and weighted F1 of each cell, means over its folds; an error that names the cell
    where a metric of the cell, or the precision or recall of one label, is missing."""
    whole = ["accuracy", "macro_f1", "weighted_f1"]
    needed = [*whole, *[f"{m}_{x}" for m in ("precision", "recall") for x in labels]]
    pick = lambda names: F.avg(F.when(F.col("metric").isin(names), F.col("value")))
    found = metrics.groupBy(*CELL).agg(
        pick(["accuracy"]).alias("accuracy"), pick([f"precision_{x}" for x in labels]).alias("macro_precision"), pick([f"recall_{x}" for x in labels]).alias("macro_recall"),
        pick(["macro_f1"]).alias("macro_f1"), pick(["weighted_f1"]).alias("weighted_f1"),
        F.collect_set(F.when(F.col("value").isNotNull() & F.col("metric").isin(needed), F.col("metric"))).alias("seen"),
    )
    absent = F.array_except(F.array(*map(F.lit, needed)), "seen")
    lost = F.raise_error(F.concat(F.lit("required metrics are missing in "), *[F.concat(F.coalesce(F.col(c), F.lit("null")), F.lit(" ")) for c in CELL], F.array_join(absent, ", "))).cast("double")
    checked = lambda c: F.when(F.size(absent) > 0, lost).otherwise(F.col(c)).alias(c)
    return found.select(*CELL, *[checked(c) for c in ("accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1")])


def external_summary(folds: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean and deviation of each metric column of an external model's fold table."""
    return folds.unpivot(["fold_id"], metrics, "metric", "value").groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("*").alias("n_folds"))


def accuracy_by(df: DataFrame, dimension: Column, by: list[str] | None = None) -> DataFrame:
    """Accuracy and rows by any Column of the predictions joined with their records."""
    return df.groupBy(*(by or CELL), dimension.alias("value")).agg(F.avg((F.col("true_label") == F.col("predicted_label")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def group_agreement(left: DataFrame, right: DataFrame, threshold: float = 0.5) -> DataFrame:
    """2 x 2 counts of groups (group, accuracy) by which side is at the threshold; groups of the left side only."""
    both = left.join(right.select("group", F.col("accuracy").alias("other")), "group", "left")
    a, b = F.col("accuracy") >= threshold, F.coalesce("other", F.lit(0.0)) >= threshold
    return both.agg(F.count_if(a & b).alias("both_high"), F.count_if(a & ~b).alias("left_only"), F.count_if(~a & b).alias("right_only"), F.count_if(~a & ~b).alias("both_low"))


def paired_cells(base: DataFrame, other: DataFrame) -> DataFrame:
    """(true_label, p0, p1, n): shared samples of two tables (sample_id, true_label, predicted_label) by what both predicted."""
    both = base.select("sample_id", "true_label", F.col("predicted_label").alias("p0")).join(other.select("sample_id", F.col("predicted_label").alias("p1")), "sample_id")
    return both.groupBy("true_label", "p0", "p1").agg(F.count("*").alias("n"))


def bootstrap_macro_f1(base: DataFrame, other: DataFrame, replicates: int, seed: int = 42, max_cells: int = 1_000_000) -> DataFrame:
    """Paired bootstrap over samples of the macro F1 difference (other - base) of two tables (sample_id, true_label, predicted_label):
    observed, mean, ends of the 95 % interval (nearest ranks), share at or below 0.

    Drawing n of n samples with replacement is one multinomial draw over the cells (true label, both predictions), which are all that
    a score needs: labels cubed at most, however many samples there are. Replicates are dealt over tasks, each with a generator of its
    own number. Labels are the true ones; rows with a null label or prediction count as a label of their own.
    """
    cells = paired_cells(base, other).fillna("").orderBy("true_label", "p0", "p1")
    rows = cells.limit(max_cells + 1).collect()
    if not rows:
        raise ValueError("no shared samples")
    if len(rows) > max_cells:
        raise ValueError(f"more than {max_cells} combinations of labels")
    names = sorted({x for r in rows for x in r[:3]})
    number = {x: i for i, x in enumerate(names)}
    t, p0, p1 = (np.array([number[r[i]] for r in rows]) for i in range(3))
    n, truth = np.array([r["n"] for r in rows], np.int64), sorted(set(t.tolist()))

    def difference(weights: np.ndarray) -> np.ndarray:
        """Of each row of cell weights."""
        def total(at: np.ndarray, w: np.ndarray) -> np.ndarray:
            out = np.zeros((len(w), len(names)))
            np.add.at(out.T, at, w.T)
            return out
        def macro(p: np.ndarray) -> np.ndarray:
            size = total(t, weights) + total(p, weights)
            hit = total(t, weights * (t == p))
            return np.divide(2 * hit, size, out=np.zeros_like(hit), where=size > 0)[:, truth].mean(axis=1)
        return macro(p1) - macro(p0)

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            drawn = np.stack([np.random.default_rng([seed, r]).multinomial(n.sum(), n / n.sum()) for r in frame["id"]]) if len(frame) else np.zeros((0, len(n)), np.int64)
            yield pd.DataFrame({"d": difference(drawn)})

    spark = base.sparkSession
    drawn = spark.range(replicates).mapInPandas(run, "d double").agg(F.avg("d").alias("mean"), F.array_sort(F.collect_list("d")).alias("v"), F.avg((F.col("d") <= 0).cast("double")).alias("share_not_better"))
    return drawn.select(F.lit(float(difference(n[None, :])[0])).alias("observed"), "mean", nearest_rank(F.col("v"), 0.025).alias("low"), nearest_rank(F.col("v"), 0.975).alias("high"), "share_not_better")
