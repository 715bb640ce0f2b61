"""Constraints on rows and tables. Every check is a DataFrame of violations; require_empty() makes it an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LABELS = ("delivery", "billing", "technical", "account")
DIFFICULTIES = ("easy", "medium", "hard", "ambiguous")
ROLES = ("train", "validation")


def require_empty(violations: DataFrame, what: str) -> None:
    first = violations.limit(5).collect()
    if first:
        raise ValueError(f"{what}: {[tuple(r) for r in first]}")


def row_violations(df: DataFrame, nonblank=(), enums: dict[str, tuple[str, ...]] | None = None, nonnegative=(), declared=None) -> DataFrame:
    """(row as JSON, rule) for each broken constraint."""
    if declared is not None and (extra := set(df.columns) - set(declared)):
        raise ValueError(f"undeclared columns {sorted(extra)}")
    rules: dict[str, Column] = {f"{c} is blank": F.coalesce(F.trim(c) == "", F.lit(True)) for c in nonblank}
    rules |= {f"{c} is not allowed": ~F.coalesce(F.col(c).isin(*v), F.lit(False)) for c, v in (enums or {}).items()}
    rules |= {f"{c} is negative": F.coalesce(F.col(c) < 0, F.lit(True)) for c in nonnegative}
    broken = F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    return df.select(F.to_json(F.struct(*df.columns)).alias("row"), F.explode(broken).alias("rule"))


def fold_violations(records: DataFrame, n_splits: int) -> DataFrame:
    """(rule, fold_id, key, n): folds out of range, a sample twice in a fold, a group in two roles of a fold."""
    outside = records.where(~F.col("fold_id").between(0, n_splits - 1)).groupBy("fold_id").agg(F.count("*").alias("n")).select(F.lit("fold_range").alias("rule"), "fold_id", F.lit(None).cast("string").alias("key"), "n")
    twice = records.groupBy("fold_id", F.col("sample_id").cast("string").alias("key")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("sample_twice").alias("rule"), "fold_id", "key", "n")
    mixed = records.groupBy("fold_id", F.col("template_group").alias("key")).agg(F.countDistinct("split_role").alias("n")).where("n > 1").select(F.lit("group_in_two_roles").alias("rule"), "fold_id", "key", "n")
    return outside.unionByName(twice).unionByName(mixed)


def coverage(folds: DataFrame, corpus: DataFrame, key: str = "sample_id") -> DataFrame:
    """One row of counts: missing in folds, unknown to the corpus, disagreeing in label or group, validated not once."""
    validated = folds.where("split_role = 'validation'").groupBy(key).agg(F.count("*").alias("times"), *[f(c).alias(f"{c}_{n}") for c in ("label", "template_group") for n, f in (("least", F.min), ("most", F.max))])
    both = corpus.select(F.col(key), F.col("label"), F.col("template_group")).join(validated, key, "full")
    differs = lambda c: F.count_if((F.col(c) != F.col(f"{c}_least")) | (F.col(c) != F.col(f"{c}_most")))
    return both.agg(
        F.count_if(F.col("times").isNull()).alias("missing"), F.count_if(F.col("label").isNull()).alias("unknown"),
        F.count_if(F.col("times") > 1).alias("repeated"), differs("label").alias("label_differs"),
        differs("template_group").alias("group_differs"),
    )


def alignment(predictions: DataFrame, folds: DataFrame, key: str = "sample_id") -> DataFrame:
    """How an external prediction table fits the validation folds: unknown ids, missing ids, ids in another fold."""
    own = folds.where("split_role = 'validation'").select(key, F.col("fold_id").alias("own_fold"))
    both = predictions.select(key, "fold_id").join(own, key, "full")
    return both.agg(
        F.count_if(F.col("own_fold").isNull()).alias("unknown"), F.count_if(F.col("fold_id").isNull()).alias("missing"), F.count_if(F.col("fold_id") != F.col("own_fold")).alias("other_fold")
    )


def _halves(columns: list[str]) -> list[Column]:
    """Two 64-bit numbers of a row: halves of the SHA-256 of its values as text, nulls told from empty texts."""
    told = F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in columns])
    digest = F.sha2(told, 256)
    return [F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(28,0)") for at in (1, 17)]


def table_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row (n, table_hash): the number of rows and a 128-bit hash of the multiset of their values. Row hashes are added up, so the
    order of rows and their partitions do not matter and tasks add first; repeated rows count each. 32 zeros for an empty table."""
    one = df.select(*[h.alias(f"h{i}") for i, h in enumerate(_halves(columns))]).agg(F.count("*").alias("n"), *[F.coalesce(F.sum(f"h{i}"), F.lit(0)).cast("decimal(38,0)").alias(f"s{i}") for i in (0, 1)])
    text = [F.lpad(F.lower(F.conv((F.col(f"s{i}") % F.lit(str(1 << 64)).cast("decimal(20,0)")).cast("string"), 10, 16)), 16, "0") for i in (0, 1)]
    return one.select("n", F.concat(*text).alias("table_hash"))


def with_witnesses(offending: DataFrame, key: str, n: int = 5) -> DataFrame:
    """(check, n, first_ids) of rows (check, key): how many rows each check objects to and its n least keys, joined by commas. Tasks keep n
    keys of a check, however many there are."""
    counts = offending.groupBy("check").agg(F.count("*").alias("n"))
    w = Window.partitionBy("check").orderBy(key)
    few = offending.select("check", key).distinct().withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n)
    ids = few.groupBy("check").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__rank", key))), lambda x: x[key].cast("string")), ",").alias("first_ids"))
    return counts.join(ids, "check").select("check", "n", "first_ids")


COVERAGE_CHECKS = ("unknown_id", "missing_id", "repeated_id", "other_fold", "other_label", "other_group")


def alignment_report(predictions: DataFrame, folds: DataFrame, key: str = "sample_id") -> DataFrame:
    """(check, n, first_ids) for each of COVERAGE_CHECKS, as far as the tables have its columns, that an external prediction table (key,
    fold_id, label, template_group) breaks against the validation folds; a check without objections has no row."""
    shared = [c for c in ("fold_id", "label", "template_group") if c in predictions.columns and c in folds.columns]
    own = folds.where("split_role = 'validation'").select(key, F.lit(True).alias("__own"), *[F.col(c).alias(f"__{c}") for c in shared])
    both = predictions.select(key, F.lit(True).alias("__there"), *shared).join(own, key, "full")
    names = {"fold_id": "other_fold", "label": "other_label", "template_group": "other_group"}
    marks = [F.when(F.col("__own").isNull(), F.lit("unknown_id")), F.when(F.col("__there").isNull(), F.lit("missing_id"))]
    marks += [F.when(F.col("__own") & F.col("__there") & ~F.col(c).eqNullSafe(F.col(f"__{c}")), F.lit(names[c])) for c in shared]
    found = both.select(key, F.explode(F.filter(F.array(*marks), lambda x: x.isNotNull())).alias("check"))
    twice = predictions.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key, F.lit("repeated_id").alias("check"))
    return with_witnesses(found.unionByName(twice), key)


AUDIT_CHECKS = ("row_count", "no_duplicate_ids", "no_missing_ids", "class_counts", "confusion_sum", "fold_sizes_sum", "fold_hash", "same_ids", "unit_interval")


def independent_audit(oof: DataFrame, fold_metrics: DataFrame, folds: DataFrame, expected_rows: int, expected_class_rows: int | None, fold_hash: str, key: str = "sample_id") -> DataFrame:
    """(check, passed, value) for each of AUDIT_CHECKS of predictions oof (key, fold_id, true_label, predicted_label) against the fold table
    (key, fold_id, split_role), and both averages of the accuracy, over folds and pooled, as values of their own.

    fold_metrics: (fold_id, n_val and metric columns). fold_hash: the table_hash of (key, fold_id) of the validation rows that the
    predictions were made for. expected_class_rows: rows of every class, None if classes differ in size.
    """
    same = (F.col("true_label") == F.col("predicted_label")).cast("double")
    classes = oof.groupBy("true_label").agg(F.count("*").alias("n")).agg(F.min("n").alias("least"), F.max("n").alias("most"))
    confusion = oof.where("true_label IS NOT NULL AND predicted_label IS NOT NULL").groupBy("true_label", "predicted_label").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("confusion"))
    whole = oof.agg(F.count("*").alias("rows"), F.countDistinct(key).alias("ids"), F.count_if(F.col(key).isNull()).alias("absent"), F.avg(same).alias("pooled"))
    by_fold = oof.groupBy("fold_id").agg(F.avg(same).alias("a")).agg(F.avg("a").alias("fold_mean"))
    values = [c for c in fold_metrics.columns if c not in ("fold_id", "n_val")]
    sizes = fold_metrics.agg(F.coalesce(F.sum("n_val"), F.lit(0)).alias("n_val"), F.count_if(~F.coalesce(F.least(*values, F.lit(1.0)) >= 0, F.lit(False)) | ~F.coalesce(F.greatest(*values, F.lit(0.0)) <= 1, F.lit(False))).alias("outside"))
    validation = folds.where("split_role = 'validation'")
    hashed = table_hash(validation, [key, "fold_id"]).select("table_hash")
    lone = oof.select(key).distinct().withColumn("a", F.lit(1)).join(validation.select(key).distinct().withColumn("b", F.lit(1)), key, "full").agg(F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("lone"))
    row = whole
    for part in (classes, confusion, by_fold, sizes, hashed, lone):
        row = row.crossJoin(F.broadcast(part))  # single rows
    c = F.col
    even = F.lit(True) if expected_class_rows is None else (c("least") == expected_class_rows) & (c("most") == expected_class_rows)
    checks = {
        "row_count": (c("rows") == expected_rows, c("rows")), "no_duplicate_ids": (c("ids") + c("absent") == c("rows"), c("rows") - c("ids") - c("absent")), "no_missing_ids": (c("absent") == 0, c("absent")),
        "class_counts": (even, c("most") - c("least")), "confusion_sum": (c("confusion") == expected_rows, c("confusion")), "fold_sizes_sum": (c("n_val") == expected_rows, c("n_val")),
        "fold_hash": (c("table_hash") == fold_hash, F.lit(None)), "same_ids": (c("lone") == 0, c("lone")), "unit_interval": (c("outside") == 0, c("outside")),
        "fold_mean_accuracy": (F.lit(None), c("fold_mean")), "pooled_accuracy": (F.lit(None), c("pooled")),
    }
    made = [F.struct(F.lit(k).alias("check"), F.coalesce(p, F.lit(False)).alias("passed") if k in AUDIT_CHECKS else F.lit(None).cast("boolean").alias("passed"), v.cast("double").alias("value")) for k, (p, v) in checks.items()]
    return row.select(F.explode(F.array(*made)).alias("c")).select("c.*")


def one_value(df: DataFrame, column: str) -> DataFrame:
    """Whether all non-null values of a column are one."""
    return df.agg((F.countDistinct(column) == 1).alias("consistent"), F.countDistinct(column).alias("n_values"))


def metric_audit(oof: DataFrame, expected_rows: int, n_labels: int) -> DataFrame:
    """Independent checks of an OOF table and both ways to average: (check, passed, value)."""
    per_fold = oof.groupBy("fold_id").agg(F.avg((F.col("true_label") == F.col("predicted_label")).cast("double")).alias("accuracy"))
    whole = oof.agg(
        F.count("*").alias("n"), F.countDistinct("sample_id").alias("ids"), F.countDistinct("true_label").alias("labels"),
        F.count_if(F.col("predicted_label").isNull()).alias("missing"), F.avg((F.col("true_label") == F.col("predicted_label")).cast("double")).alias("pooled"),
    )
    mean = per_fold.agg(F.avg("accuracy").alias("fold_mean"), F.min("accuracy").alias("low"), F.max("accuracy").alias("high"))
    row = whole.crossJoin(F.broadcast(mean))
    checks = [
        ("row_count", F.col("n") == expected_rows, F.col("n")), ("no_duplicate", F.col("n") == F.col("ids"), F.col("ids")), ("no_missing", F.col("missing") == 0, F.col("missing")),
        ("label_count", F.col("labels") == n_labels, F.col("labels")), ("in_unit_interval", (F.col("low") >= 0) & (F.col("high") <= 1), F.col("high")),
        ("fold_mean_accuracy", F.lit(True), F.col("fold_mean")), ("pooled_accuracy", F.lit(True), F.col("pooled")),
    ]
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), p.alias("passed"), v.cast("double").alias("value")) for n, p, v in checks])).alias("c")).select("c.*")


def approval_problems(decision: dict, required: dict, corpus_sha256: str) -> list[str]:
    """What keeps a decision document from approving a corpus."""
    problems = [f"{k} is missing" for k in (*required, "sha256") if k not in decision]
    problems += [f"{k} is {decision[k]!r}, not {v!r}" for k, v in required.items() if k in decision and decision[k] != v]
    if decision.get("sha256") not in (None, corpus_sha256):
        problems.append("the corpus is not the approved one")
    return problems
