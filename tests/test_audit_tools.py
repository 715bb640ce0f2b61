"""Table hashes, witnesses, ranks, bootstrap, required metrics and the covering review against plain versions."""

import hashlib
import random
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import audit as U
from corpusloom.operators import folds as K
from corpusloom.operators import metrics as M
from corpusloom.operators import quality as Q
from corpusloom.operators import validation as A


def plain_hash(rows):
    sums = [0, 0]
    for row in rows:
        h = hashlib.sha256("\x1f".join("" if v is None else f"={v}" for v in row).encode()).hexdigest()
        sums = [(s + int(h[at : at + 16], 16)) % (1 << 64) for s, at in zip(sums, (0, 16))]
    return "".join(f"{s:016x}" for s in sums)


def test_table_hash(spark):
    rows = [(1, "a"), (2, None), (2, ""), (None, "b"), (1, "a"), (3, "x" * 50_000)]
    make = lambda r, n=3: A.table_hash(spark.createDataFrame(r, "id long, t string").repartition(n), ["id", "t"]).first()
    assert tuple(make(rows)) == (6, plain_hash(rows)) == tuple(make(rows[::-1], 1))
    assert len({make(r)["table_hash"] for r in (rows, rows[1:], rows + rows[:1], [(1, "a="), *rows[1:]], [(2, "a"), *rows[1:]])}) == 5
    assert tuple(make([])) == (0, "0" * 32)


def test_alignment_report_names_the_least_ids(spark):
    folds = spark.createDataFrame([(i, i % 3, "validation", f"l{i % 2}", "g") for i in range(30)] + [(0, 1, "train", "l0", "g")], "sample_id long, fold_id int, split_role string, label string, template_group string")
    rows = [(i, i % 3, f"l{i % 2}") for i in range(8, 30)] + [(40, 0, "l0"), (9, 0, "l1"), (10, 2, "l0"), (11, 2, None)]
    got = {r["check"]: (r["n"], r["first_ids"]) for r in A.alignment_report(spark.createDataFrame(rows, "sample_id long, fold_id int, label string"), folds).collect()}
    assert got == {"missing_id": (8, "0,1,2,3,4"), "unknown_id": (1, "40"), "repeated_id": (3, "9,10,11"), "other_fold": (1, "10"), "other_label": (1, "11")}
    own = folds.where("split_role = 'validation'").select("sample_id", "fold_id", "label", "template_group")
    assert A.alignment_report(own, folds).count() == 0


def test_nine_checks(spark):
    rows = [(i, i % 3, "ab"[i % 2], "ab"[i % 2] if i % 4 else "a") for i in range(12)]
    oof = spark.createDataFrame(rows, "sample_id long, fold_id int, true_label string, predicted_label string")
    folds = K.fold_records(oof.select(F.col("sample_id").alias("id"), F.col("true_label").alias("label"), F.lit("g").alias("template_group"), "fold_id"), 3)
    sizes = spark.createDataFrame([(f, 4, 0.5) for f in range(3)], "fold_id int, n_val int, accuracy double")
    digest = plain_hash([(r[0], r[1]) for r in rows])
    audit = lambda o, m=sizes, n=12, c=6, h=digest: {r["check"]: r["passed"] for r in A.independent_audit(o, m, folds, n, c, h).collect()}
    fine = audit(oof)
    assert all(fine[c] for c in A.AUDIT_CHECKS) and fine["pooled_accuracy"] is None
    failed = lambda found: {c for c in A.AUDIT_CHECKS if not found[c]}
    assert failed(audit(oof.where("sample_id < 11"))) == {"row_count", "class_counts", "confusion_sum", "same_ids"}
    assert failed(audit(oof.unionByName(oof.where("sample_id = 1")), c=None)) == {"row_count", "no_duplicate_ids", "confusion_sum"}
    assert failed(audit(oof, h="0" * 32)) == {"fold_hash"}
    assert failed(audit(oof, sizes.withColumn("accuracy", F.lit(1.5)))) == {"unit_interval"}
    assert failed(audit(oof, sizes.withColumn("n_val", F.lit(5)))) == {"fold_sizes_sum"}
    lost = oof.withColumn("sample_id", F.when(F.col("sample_id") > 0, F.col("sample_id"))).withColumn("predicted_label", F.when(F.col("fold_id") > 0, F.col("predicted_label")))
    assert {"no_missing_ids", "confusion_sum", "same_ids"} <= failed(audit(lost))


def test_ranks_within_a_hot_label(spark):
    rows = [(i, "hot" if i % 3 else f"l{i % 5}" if i % 2 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, label string")
    keyed = df.withColumn("h", K.seeded(42, "id"))
    want = defaultdict(list)
    for i, label in rows:
        want[label].append((hashlib.sha256(f"42|{i}".encode()).hexdigest(), i))
    expected = {i: n for own in want.values() for n, (_, i) in enumerate(sorted(own), 1)}
    assert {r["id"]: r["rank"] for r in K.rank_within(keyed, "label", ["h", "id"]).collect()} == expected
    folds = K.stratified_folds(df.unionByName(df.limit(5)), 5).collect()
    assert len(folds) == 405 and all(r["fold_id"] == (expected[r["id"]] - 1) % 5 for r in folds)
    assert K.stratified_folds(df.limit(0), 5).count() == 0


def macro(rows, at):
    truth, total = sorted({r[0] for r in rows}), 0.0
    for x in truth:
        size = sum(r[0] == x for r in rows) + sum(r[at] == x for r in rows)
        total += 2 * sum(r[0] == x == r[at] for r in rows) / size if size else 0
    return total / len(truth)


def test_bootstrap_agrees_with_resampling(spark):
    r = random.Random(1)
    rows = [(x := r.choice("aab"), r.choice([x, x, "b"]), r.choice([x, x, x, "c"])) for _ in range(120)]
    table = lambda at: spark.createDataFrame([(i, row[0], row[at]) for i, row in enumerate(rows)], "sample_id long, true_label string, predicted_label string")
    got = M.bootstrap_macro_f1(table(1), table(2), 1500).first()
    assert got["observed"] == pytest.approx(macro(rows, 2) - macro(rows, 1))
    drawn = []
    for _ in range(1500):
        own = [rows[r.randrange(len(rows))] for _ in rows]
        drawn.append(macro(own, 2) - macro(own, 1))
    drawn.sort()
    assert got["mean"] == pytest.approx(np.mean(drawn), abs=0.01)
    assert got["low"] == pytest.approx(drawn[37], abs=0.02) and got["high"] == pytest.approx(drawn[1462], abs=0.02)
    assert tuple(got) == tuple(M.bootstrap_macro_f1(table(1).repartition(3), table(2), 1500).first())
    with pytest.raises(ValueError, match="no shared"):
        M.bootstrap_macro_f1(table(1).limit(0), table(2), 5)


def test_required_metrics_name_what_is_missing(spark):
    oof = spark.createDataFrame([(i, "D0", "m", i % 2, "xy"[i % 2], "x") for i in range(8)], "sample_id long, condition string, model string, fold_id int, true_label string, predicted_label string")
    long = M.metrics_long(oof, ["condition", "model", "fold_id"]).unionByName(M.metrics_long(oof, ["condition", "model", "fold_id"]).where("metric LIKE '%_y'").withColumn("fold_id", F.lit(0)))
    row = M.required_metrics(long, ["x", "y"]).first()
    assert row["weighted_f1"] is not None and row["macro_recall"] is not None
    with pytest.raises(Exception, match="required metrics are missing in D0 m precision_z, recall_z"):
        M.required_metrics(long, ["x", "y", "z"]).collect()
    with pytest.raises(Exception, match="weighted_f1"):
        M.required_metrics(long.where("metric <> 'weighted_f1'"), ["x", "y"]).collect()


def greedy(groups, pairs):
    """The covering review by plain loops: the records chosen for findings, by group."""
    left, taken = {(i, f) for i, f in pairs}, {}
    while left:
        gain = Counter(i for i, _ in left)
        nominated = {min((-gain[i], i) for i, g in left if g == f) for f in {f for _, f in left}}
        by_group = {}
        for n, i in sorted(nominated):
            by_group.setdefault(groups[i], i)
        taken |= by_group
        seen = {f for i, f in left if i in by_group.values()}
        left = {(i, f) for i, f in left if f not in seen and groups[i] not in taken}
    return taken


def test_covering_review(spark):
    r = random.Random(7)
    for case in range(2):
        groups = {i: f"g{r.randrange(6)}" for i in range(30)}
        pairs = [(r.randrange(30), f"f{r.randrange(9)}") for _ in range(25)]
        df = spark.createDataFrame([(i, g, "t" * (5 + i % 7)) for i, g in groups.items()], "id long, template_group string, raw_text string")
        records = spark.createDataFrame(pairs + pairs[:3] + [(99, "f0")], "id long, feature string")
        got = {x["template_group"]: x["id"] for x in Q.covering_review(df, records, ["feature"]).collect()}
        want = greedy(groups, set(pairs))
        base = {x["template_group"]: x["id"] for x in Q.spot_review(df).collect()}
        assert got == base | want and all(groups[i] == g for g, i in got.items())
        shown = {f for i, f in pairs if i in got.values()}
        # a finding that is not shown has no record in a group that its round left free
        assert all(f in shown or all(groups[i] in want for i, g in pairs if g == f) for _, f in pairs)
    assert Q.covering_review(df, records.limit(0), ["feature"]).count() == len(set(groups.values()))


def test_finding_records_by_broadcast_and_by_shuffle(spark, monkeypatch):
    rows = [(i, "ab"[i % 2], f"word{i % 2} shared text", f"word{i % 2} shared text", f"g{i % 3}", f"t{i}", "easy", False, False, False, i % 2) for i in range(24)]
    df = spark.createDataFrame(rows, "id long, label string, raw_text string, body_text string, template_group string, template_id string, difficulty string, has_header boolean, has_signature boolean, has_quoted_reply boolean, urgency int")
    findings = U.leakage(df, ["word1"], U.Thresholds())
    few = sorted(map(str, U.finding_records(df, findings, ["word1"]).collect()))
    monkeypatch.setattr(U, "BROADCAST_ROWS", 0)
    assert few and sorted(map(str, U.finding_records(df, findings, ["word1"]).collect())) == few


def test_every_combination_of_labels_is_a_cell(spark):
    rows = [(i, *p) for i, p in enumerate(product("ab", repeat=3))]
    side = lambda at: spark.createDataFrame([(r[0], r[1], r[at]) for r in rows] + [(100 + at, "a", "a")], "sample_id long, true_label string, predicted_label string")
    assert M.paired_cells(side(2), side(3)).count() == 8
