"""Operators on hand-built rows, each against values worked out here."""

import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import stats as S
from corpusloom.functions import text as X
from corpusloom.operators import audit as U
from corpusloom.operators import contamination as C
from corpusloom.operators import errors as E
from corpusloom.operators import features as V
from corpusloom.operators import folds as K
from corpusloom.operators import metrics as M
from corpusloom.operators import models as L
from corpusloom.operators import neardup as N
from corpusloom.operators import quality as Q
from corpusloom.operators import validation as A
from corpusloom.plans import report as R
from corpusloom.sources import generation as G
from corpusloom.sources import tables as T

MAIL = "id string, raw_text string, body_text string, label string, template_group string, difficulty string, has_header boolean, has_signature boolean, has_quoted_reply boolean, template_id string, variation_id long"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


CLEAN = [
    ("Ｈｅｌｌｏ　Ｗｏｒｌｄ １２", "hello world 12"), ("a <b>bold</b> &amp; more", "a bold & more"), ("see https://a.b/c?d now", "see <url> now"), ("mail me@x.org!", "mail <email>!"),
    ("From: a\nSubject: b\nbody", "body"), ("body\n--\nA. User", "body"), ("> quoted\nanswer", "answer"), ("text\nOn Monday Bob wrote:\nold", "text"), ("it’s “so” – yes…", "it's \"so\" - yes..."), ("  \t\n ", ""), ("", ""),
]


@pytest.mark.parametrize("raw,want", CLEAN)
def test_clean_and_normalize(spark, raw, want):
    assert one(spark, X.normalize(X.clean(F.lit(raw)))) == want


def test_japanese_profile(spark):
    config = X.CleanConfig(profile=X.JA)
    assert one(spark, X.normalize(X.clean(F.lit("件名：テスト\nカタカナーー １２ です\n次のように書きました：\n古い"), config), config)) == "カタカナー12です"
    assert one(spark, X.clean(F.lit("見てhttps://a.jp/xくださいa@b.jp"), config)) == "見て<URL>ください<EMAIL>"
    assert one(spark, X.segment(F.lit("ab c"), "char2")) == ["ab", "bc"]
    with pytest.raises(ValueError):
        X.segment(F.lit("x"), "none")


def test_tokens(spark):
    config = X.CleanConfig(remove_stop_words=True)
    assert one(spark, X.tokens(F.lit("The <URL> isn't not for_us é1"), config)) == ["<URL>", "isn't", "not", "us", "é1"]
    with pytest.raises(NotImplementedError):
        X.CleanConfig(lemmatize=True)
    with pytest.raises(ValueError):
        X.CleanConfig(version="0")


def test_shingles_and_ngrams(spark):
    words = F.split(F.lit("a b c a b c"), " ")
    assert one(spark, X.word_shingles(words)) == ["a b c", "b c a", "c a b"]
    assert one(spark, X.word_shingles(F.split(F.lit("a b"), " "))) == ["a b"]
    assert one(spark, X.char_shingles(F.lit("abcdef"), 5)) == ["abcde", "bcdef"] and one(spark, X.char_shingles(F.lit(""), 5)) == []
    assert one(spark, X.char_wb_ngrams(F.array(F.lit("ab")), 2, 3)) == [" a", "ab", "b ", " ab", "ab "]
    assert one(spark, X.salted_hash(F.lit("x y"), 42, 7)) == hashlib.sha256(b"42:7:x y").hexdigest()[:16]


def test_insertion(spark):
    body = "one\n\ntwo\n\nthree"
    at = lambda p: one(spark, X.insert_paragraph(F.lit(body), F.lit("NEW"), F.lit(p)))
    assert at("early") == "one\n\nNEW\n\ntwo\n\nthree" and at("mid") == "one\n\nNEW\n\ntwo\n\nthree" and at("end") == body + "\n\nNEW"
    assert one(spark, X.splice_body(F.lit("head\nbody\ntail"), F.lit("body"), F.lit("other"))) == "head\nother\ntail"
    for bad in (X.insert_paragraph(F.col("b"), F.lit("n"), F.lit("top")), X.splice_body(F.lit("x"), F.col("b"), F.lit("z"))):
        with pytest.raises(Exception, match="position|part of"):
            spark.createDataFrame([("y",)], "b string").select(bad).collect()


def test_statistics(spark):
    b, c = F.lit(10), F.lit(3)
    assert one(spark, S.mcnemar_statistic(b, c)) == pytest.approx(36 / 13)
    assert one(spark, S.mcnemar_p(b, c)) == pytest.approx(math.erfc(math.sqrt(36 / 13 / 2)))
    assert one(spark, S.mcnemar_p(F.lit(0), F.lit(0))) == 1.0
    z = (0.3 - 0.5) / math.sqrt(0.4 * 0.6 * 0.2)
    assert one(spark, S.two_proportion_z(F.lit(3), F.lit(10), F.lit(5), F.lit(10))) == pytest.approx(z)
    assert one(spark, S.two_proportion_p(F.lit(0), F.lit(10), F.lit(0), F.lit(10))) == 1.0
    assert one(spark, S.nearest_rank(F.array(*map(F.lit, (1, 2, 3, 4))), 0.5)) == 3  # round(1.5) is 2


def oof(spark, rows):
    return spark.createDataFrame([(str(i), "D0", "m", f, t, p) for i, (f, t, p) in enumerate(rows)], T.OOF)


def test_metrics(spark):
    m = {(r["fold_id"], r["metric"]): r["value"] for r in M.metrics_long(oof(spark, [(0, "a", "a"), (0, "a", "b"), (0, "b", "b"), (1, "a", "a"), (1, "a", "c")])).collect()}
    assert m[0, "precision_b"] == 0.5 and m[0, "recall_a"] == 0.5 and m[0, "f1_a"] == pytest.approx(2 / 3) and m[0, "macro_f1"] == pytest.approx(2 / 3) and m[0, "accuracy"] == pytest.approx(2 / 3)
    assert m[1, "f1_c"] == 0 and m[1, "precision_c"] == 0 and m[1, "macro_f1"] == pytest.approx((2 / 3) / 2) and m[1, "weighted_f1"] == pytest.approx(2 / 3) and (1, "f1_b") not in m


def test_paired_differences_need_every_pair(spark):
    rows = [("D0", "m", 0, "x", 0.5), ("D0", "m", 1, "x", 0.5), ("D1", "m", 0, "x", 0.7), ("D1", "m", 1, "x", 0.4)]
    frame = lambda r: spark.createDataFrame(r, "condition string, model string, fold_id int, metric string, value double")
    got = M.paired_differences(frame(rows), "D0").first()
    assert got["mean_difference"] == pytest.approx(0.05) and (got["n_improved"], got["n_worsened"], got["n_folds"]) == (1, 1, 2)
    with pytest.raises(Exception, match="no pair"):
        M.paired_differences(frame(rows[:3]), "D0").collect()
    assert M.paired_differences(frame(rows[:3]), "D0", observed_only=True).first()["n_folds"] == 1


def test_best_cell_and_required(spark):
    s = spark.createDataFrame([("D0", "a", "macro_f1", 0.5), ("D0", "b", "macro_f1", 0.5)], "condition string, model string, metric string, mean double")
    assert M.best_cell(s).first()["model"] == "b"
    m = spark.createDataFrame([("D0", "a", 0, "macro_f1", 0.5)], "condition string, model string, fold_id int, metric string, value double")
    with pytest.raises(Exception, match="missing"):
        M.required_metrics(m, ["x"]).collect()


def test_bootstrap(spark):
    base = spark.createDataFrame([(str(i), "ab"[i % 2], "ab"[i % 2] if i % 3 else "a") for i in range(30)], "sample_id string, true_label string, predicted_label string")
    same = M.bootstrap_macro_f1(base, base, 20).first()
    assert same["observed"] == same["mean"] == same["low"] == 0 and same["share_not_better"] == 1
    right = base.withColumn("predicted_label", F.col("true_label"))
    better = M.bootstrap_macro_f1(base, right, 20).first()
    assert better["observed"] > 0 and better["low"] <= better["mean"] <= better["high"]


def mails(spark, rows):
    return spark.createDataFrame([(i, raw, raw, label, group, "easy", h, False, False, group + "-t", n) for n, (i, raw, label, group, h) in enumerate(rows)], MAIL)


def test_quality(spark):
    df = mails(spark, [("1", "Same  text", "a", "g1", True), ("2", "Same text", "b", "g1", False), ("3", "From: x@y.org\nhello g2", "a", "g2", True), ("4", "Same text", "b", "g3", True)])
    groups = {(r["match_type"], r["source_field"]): r["record_ids"] for r in Q.duplicate_groups(df).collect()}
    assert groups["exact", "raw_text"] == "2|4" and groups["normalized", "body_text"] == "1|2|4"
    assert [r["feature"] for r in Q.mixed_groups(df).collect()] == ["g1"]
    assert {(r["feature"], r["record_ids"]) for r in Q.template_literals(df).collect()} == {("g2", "3")}
    assert {r["feature"] for r in Q.header_features(df, 1).collect()} == {"from=x@y.org", "sender_domain=y.org"}
    assert {r["category"] for r in Q.concentrated_groups(df, 2, 0.4).collect()} == {"template_concentration"}
    assert {r["template_group"]: r["reason"] for r in Q.spot_review(df).collect()} == {"g1": "shortest", "g2": "longest", "g3": "group"}


def findings(df, **bounds):
    return {(r["category"], r["feature"], r["record_id"]): r for r in U.leakage(df, ["refund"], U.Thresholds(**{"min_groups": 1, "max_group_share": 1.0, "max_length_ratio": 99.0, **bounds}), "variation_id").collect()}


def test_audit(spark):
    texts = ["From: Ann@x@Shop.ORG\nSubject: Hi\nplease refund\n--\nAnn Bee\n\nmore", "from: b@shop.org\nabout g1", "other words", None]
    df = mails(spark, [(str(i), t, "aabb"[i], "g1" if i < 3 else "g2", i < 2) for i, t in enumerate(texts)] + [("4", "no label", None, "g3", True)])
    got = findings(df, min_count=2)
    assert ("label_literal", "refund", "0") in got and ("template_literal", "g1", "1") in got
    assert got["template_group_label_mixing", "g1", ""]["labels"] == "a|b" and got["template_group_label_mixing", "g1", ""]["count"] == 3
    assert got["metadata_one_to_one", "has_header=True", ""]["count"] == 2 and ("metadata_one_to_one", "difficulty=easy", "") not in got
    assert got["class_specific_sender_domain", "shop.org", ""]["count"] == 2 and ("class_specific_subject", "hi", "") not in got
    assert got["class_specific_token", "shop", ""]["labels"] == "a" and got["class_specific_bigram", "shop org", ""]["count"] == 2
    assert got["shared_component_distribution", "variation_id=3", ""]["details"] == "records by label: a=0/2, b=1/2"
    assert not {"template_count", "template_concentration", "class_length_difference"} & {k[0] for k in got}
    strict = findings(df, min_count=1, min_groups=2, max_group_share=0.6, max_length_ratio=1.0)
    assert strict["class_specific_signature", "ann bee", ""]["count"] == 1 and strict["class_specific_subject", "hi", ""]["count"] == 1
    assert ("template_count", "a", "") in strict and ("template_count", "b", "") not in strict and ("template_concentration", "a", "") in strict
    assert strict["class_length_difference", "raw_text_mean", ""]["labels"] == "a|b"
    keys = list(strict)
    assert sorted(keys, key=lambda k: (strict[k]["severity"], *k)) == keys
    found = U.leakage(df, ["refund"], U.Thresholds(min_count=2), "variation_id")
    ids = {(r["category"], r["feature"]): r["record_ids"] for r in U.with_record_ids(found, U.finding_records(df, found, ["refund"], "variation_id")).collect()}
    assert ids["template_group_label_mixing", "g1"] == "0|1|2" and ids["class_specific_token", "shop"] == "0|1" and ids["class_length_difference", "raw_text_mean"] == ""
    assert not findings(df.where("false"))
    assert U.Thresholds().of_stage("smoke").min_groups == 1 and U.Thresholds().of_stage("full").min_count == 50 and U.Thresholds().of_stage("pilot") == U.Thresholds()


def test_review_reasons(spark):
    df = mails(spark, [("1", "copy", "a", "g1", True), ("2", "copy", "b", "g1", False), ("3", "a long one", "b", "g2", False)])
    got = {r["id"]: r["selection_reasons"] for r in Q.review_samples(df, 1, {"duplicate_finding": Q.duplicate_records(df)}).collect()}
    assert got == {"1": "class_sample:a|difficulty:easy|duplicate_finding|has_header|shortest", "2": "class_sample:b|duplicate_finding", "3": "longest"}


def test_share_text(spark):
    shares = [0.155, 0.125, 0.375, 0.005, 0.0, 1.0, 1 / 3, 0.995, 0.285, 0.0049, *[k / 200 for k in range(200)]]
    got = spark.createDataFrame([(x,) for x in shares], "x double").select("x", S.share_text(F.col("x")).alias("t")).collect()
    assert [r["t"] for r in got] == [f"{r['x']:.2f}" for r in got]


def test_imbalance_summary(spark):
    schema = "data_hash string, fold_artifact_hash string, fold_id int, label string, groups int, samples int, breakdown string"
    rows = [("d", "f", 0, "a", 1, 4, "g:4"), ("d", "f", 0, "b", 2, 6, "h:2;i:4"), ("d", "f", 0, "ALL", 3, 10, ""), ("d", "f", 1, "a", 1, 5, "k:5"), ("d", "f", 1, "ALL", 1, 5, "")]
    frame = lambda r: spark.createDataFrame(r, schema)
    assert tuple(K.imbalance_summary(frame(rows)).first()) == (3, "1:2;2:1", 1, 2, 4, 6, 5, 10)
    for broken, message in (([*rows, ("e", *rows[0][1:])], "corpora"), ([*rows, ("d", "e", *rows[0][2:])], "fold tables"), (rows[:2], "totals")):
        with pytest.raises(Exception, match=message):
            K.imbalance_summary(frame(broken)).collect()
    with pytest.raises(ValueError, match="breakdown"):
        K.imbalance_summary(frame(rows).drop("breakdown"))


def test_subtopic_features_and_levels(spark):
    sentences = spark.createDataFrame([("x", "The refund now"), ("y", "a Refund the bill")], "subtopic string, text string")
    features = spark.createDataFrame([("refund",), ("bill",), ("the",), ("zebra",), (None,)], "feature string")
    got = {r["feature"]: r["subtopics"] for r in C.subtopic_features(features, sentences, ("the",)).collect()}
    assert got == {"refund": "x|y", "bill": "y", "the": "", "zebra": "", None: ""}
    text = "one two three four five six seven eight"
    df = mails(spark, [("1", text, "a", "g1", True), ("2", text, "b", "g2", True), ("3", "quite another text about other things", "b", "g2", True)])
    got = {r["contamination_level"]: (r["total_pairs"], r["cross_label"]) for r in N.summary_by_level({"C0": df, "C10": df.where("id <> '2'")}).collect()}
    assert got == {"C0": (1, 1), "C10": (0, 0)}


def test_folds(spark):
    df = mails(spark, [(str(i), f"t{i}", "ab"[i % 2], f"g{i // 4}", True) for i in range(80)])
    sizes = {(r["label"], r["fold_id"]): r["count"] for r in K.stratified_folds(df).groupBy("label", "fold_id").count().collect()}
    assert set(sizes.values()) == {8} and len(sizes) == 10
    grouped = K.grouped_folds(df)
    assert A.fold_violations(K.fold_records(grouped, 5), 5).count() == 0
    per = [r["n"] for r in grouped.groupBy("fold_id").agg(F.count("*").alias("n")).collect()]
    assert len(per) == 5 and max(per) - min(per) <= 4
    broken = K.fold_records(grouped, 5).limit(1).select("sample_id", F.lit(9).alias("fold_id"), "split_role", "label", "template_group")
    assert A.fold_violations(broken, 5).first()["rule"] == "fold_range"
    with pytest.raises(ValueError):
        A.require_empty(A.fold_violations(broken, 5), "folds")


def test_row_validation(spark):
    df = mails(spark, [("1", " ", "z", "g", True)])
    rules = {r["rule"] for r in A.row_violations(df, nonblank=["raw_text"], enums={"label": ("a", "b")}, nonnegative=["variation_id"]).collect()}
    assert rules == {"raw_text is blank", "label is not allowed"}
    with pytest.raises(ValueError):
        A.row_violations(df, declared=["id"])


def test_must_match(spark):
    o = oof(spark, [(0, "a", "b")])
    with pytest.raises(Exception, match="no record"):
        E.misclassified(o, spark.createDataFrame([("9", "x")], "sample_id string, body string")).collect()


def test_japanese_categories(spark):
    rec = spark.createDataFrame([("0", "easy", False, False, False, False, False, "出来ます"), ("1", "easy", False, False, False, False, False, "ＡＢ 12"), ("2", "easy", False, False, False, False, False, "見てhttps://x"), ("3", "easy", False, False, False, False, False, "だけ")], "sample_id string, difficulty string, has_header boolean, has_signature boolean, has_quoted_reply boolean, multi_intent boolean, contains_negation boolean, body_text string")
    got = {r["sample_id"]: r for r in E.with_categories(rec, ja=True).collect()}
    assert [got[str(i)]["primary_category"] for i in range(4)] == ["orthographic_variation", "orthographic_variation", "mixed_ja_en", "uncategorized"]
    assert got["2"]["cat_morphological_segmentation"] and got["3"]["cat_uncategorized"]


def test_tfidf(spark):
    df = spark.createDataFrame([(1, "aa bb aa"), (2, "bb cc")], "id long, text string")
    counts = V.term_counts(df, V.analyze(F.col("text")))
    w = {(r["id"], r["term"]): r["weight"] for r in V.tfidf(counts, V.fit_idf(counts, df.agg(F.count("*").alias("n")))).collect()}
    rare, common = math.log(3 / 2) + 1, 1.0
    norm = math.hypot(2 * rare, common)
    assert w[1, "aa"] == pytest.approx(2 * rare / norm) and w[1, "bb"] == pytest.approx(common / norm)
    ranked = V.coefficient_rankings(spark.createDataFrame([("x", f, c) for f, c in (("p", 1.0), ("q", -2.0), ("r", 1.0))], "label string, feature string, coefficient double"), ["label"], 2)
    assert [(r["rank_type"], r["feature"]) for r in ranked.orderBy("rank_type", "rank").collect()] == [("top_absolute", "q"), ("top_absolute", "p"), ("top_negative", "q"), ("top_negative", "p"), ("top_positive", "p"), ("top_positive", "r")]


def test_near_duplicates(spark):
    text = "one two three four five six seven eight nine ten"
    df = mails(spark, [("a", text, "x", "g", True), ("b", text + " eleven", "y", "g", True), ("c", "none of these words are shared here at all", "x", "h", True), ("d", "", "x", "h", True)])
    rows = N.near_duplicates(df).collect()
    assert [(r["sample_id_a"], r["sample_id_b"], r["same_label"], r["same_template_group"]) for r in rows] == [("a", "b", False, True)] and rows[0]["jaccard_similarity"] == pytest.approx(8 / 9)
    assert N.summary(N.near_duplicates(df)).first()["cross_label"] == 1
    with pytest.raises(ValueError):
        N.lsh_candidates(N.with_shingles(df), num_perm=10, bands=4)
    want = [min(hashlib.sha256(f"42:{k}:{s}".encode()).hexdigest()[:16] for s in {" ".join(text.split()[i : i + 3]) for i in range(8)}) for k in range(64)]
    assert N.with_shingles(df).where("id = 'a'").select(N.signature(F.col("__shingles")).alias("s")).first()["s"] == want


def test_contamination(spark):
    df = G.generate(G.templates(spark), G.GenerationConfig(per_label=40)).withColumn("multi_intent", F.lit(True)).cache()
    a = C.assignment(df).cache()
    by = {(r["main_label"], r["min_level"]): r["n"] for r in a.groupBy("main_label", "min_level").agg(F.count("*").alias("n")).collect()}
    assert set(by.values()) == {4} and len(by) == 12
    assert a.where("main_label = subtopic_label").count() == 0 and {r["n"] for r in a.groupBy("main_label", "subtopic_label").agg(F.count("*").alias("n")).collect()} == {4}
    sentences = spark.createDataFrame([(x, i, "fact", f"{x} {i}.") for x in ("delivery", "billing", "technical", "account") for i in range(12)], "subtopic string, variant_id int, style string, text string")
    made = C.contaminate(df, a, sentences)
    counts = {r["contamination_level"]: r["n"] for r in made.where("contaminated").groupBy("contamination_level").agg(F.count("*").alias("n")).collect()}
    assert counts == {"C10": 16, "C20": 32, "C30": 48}
    assert made.where("contamination_level = 'C0'").join(df.select("id", F.col("raw_text").alias("r")), "id").where("raw_text <> r").count() == 0
    with pytest.raises(ValueError):
        C.assignment(df.where("label = 'billing'"))


def test_generation(spark):
    df = G.generate(G.templates(spark))
    assert G.gate_warnings(df, 200) == [] and df.count() == 800
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, G.generate(G.templates(spark)).collect()))
    assert df.where(~F.contains("raw_text", "body_text")).count() == 0


def test_linear_models(spark):
    df = K.stratified_folds(G.generate(G.templates(spark), G.GenerationConfig(per_label=30)))
    for model in L.MODELS:
        cell = L.fit_cell(df.select("id", "label", "fold_id", F.col("body_text").alias("text")), V.analyze(F.col("text")), L.FitConfig(model, steps=8))
        assert cell.oof.where("true_label = predicted_label").count() > 110 and cell.oof.count() == 120
        assert cell.scores.count() == 480 and cell.fold_runs.agg(F.sum("n_test")).first()[0] == 120
    with pytest.raises(ValueError):
        L.FitConfig("forest")


def test_sources(spark, tmp_path):
    rows = spark.createDataFrame([("b", "x", None), ("a", 'q"\nz', 1.5)], "id string, text string, v double")
    digest = T.write_jsonl(rows, f"{tmp_path}/m.jsonl")
    data = (tmp_path / "m.jsonl").read_bytes()
    assert hashlib.sha256(data).hexdigest() == digest and [json.loads(x)["id"] for x in data.splitlines()] == ["a", "b"]
    schema = "id string, text string, v double"
    assert T.read_verified_jsonl(spark, f"{tmp_path}/m.jsonl", digest, schema).count() == 2
    with pytest.raises(ValueError):
        T.read_verified_jsonl(spark, f"{tmp_path}/m.jsonl", "0" * 64, schema)
    (tmp_path / "bad.jsonl").write_text('{"id": "a"}\n\nnot json\n')
    with pytest.raises(Exception):
        T.read_jsonl(spark, f"{tmp_path}/bad.jsonl", schema).collect()
    T.write_csv(rows, f"{tmp_path}/c", ["v", "id", "text"])
    assert sorted(map(tuple, T.read_csv(spark, f"{tmp_path}/c", "v double, id string, text string").select("id", "v").collect())) == [("a", 1.5), ("b", None)]
    with pytest.raises(ValueError):
        T.write_csv(rows, f"{tmp_path}/d", ["id"])
    assert T.run_manifest("r", {}, {})["run_id"] == "r" and T.canonical_json({"b": "é", "a": 1}).startswith('{\n  "a": 1')


def test_report(spark):
    s = spark.createDataFrame([("D0", "m", "macro_f1", 0.5, 0.1), ("D1", "m", "macro_f1", 0.6, 0.1)], "condition string, model string, metric string, mean double, std double")
    assert R.mean_std_pivot(s, "macro_f1").splitlines()[2] == "| D0 | 0.500 ± 0.100 |"
    with pytest.raises(ValueError):
        R.mean_std_pivot(s, "none")
    html = R.to_html("# T\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n")
    assert "<table>" in html and html.count("<tr>") == 2 and 'id="t-' in html
    assert R.bar_chart("t", {"a": {"x": 0.5}}).count("<rect") == 1


def test_streaming(spark, tmp_path):
    from corpusloom.streaming import online

    spark.createDataFrame([("2024-01-01 00:00:00", "x"), ("2024-01-01 00:01:00", "x"), ("2024-01-01 00:02:00", "y")], "t string, text string").select(F.to_timestamp("t").alias("t"), "text").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("t timestamp, text string").parquet(f"{tmp_path}/in")
    online.score_batches(online.exact_duplicates(stream, "t"), lambda df: df.select("text"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert sorted(r["text"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["x", "y"]


def test_character_shingles_take_time_in_proportion(spark):
    """Of characters beyond the first plane too; the i-th of a long text is not searched for from its start."""
    text = "a\U0001f600ß" * 2 + "b"
    rows = spark.createDataFrame([(text,), ("ab",), ("",), (None,)], "t string").select(X.char_shingles("t", 3, distinct=False).alias("s")).collect()
    assert [r["s"] for r in rows] == [[text[i : i + 3] for i in range(5)], ["ab"], [], None] or rows[3]["s"] == []
    plan = spark.createDataFrame([("",)], "t string").select(X.char_shingles("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "substring" not in plan


def test_mails_from_given_texts(spark, tmp_path):
    """One mail a document, seeded, with its first three sentences and even difficulties; the query reads the table."""
    from corpusloom.plans.queries import QUERIES

    docs = [(i, None if i == 7 else f"First {i}. Second {i}? Third {i}!\nFourth.", "en" if i % 3 else "de", "s", 30) for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["synthetic_mail_generation"](spark, str(tmp_path)).collect()
    assert len(rows) == len({r["id"] for r in rows}) == 60 and sorted(r["variation_id"] for r in rows) == list(range(60))
    assert {r["id"] for r in rows if r["label"] == "de"} == {f"de-{i:05d}" for i in range(20)}
    for r in rows:
        i = r["variation_id"]
        assert i == 7 or f"\nFirst {i}.\nSecond {i}?\nThird {i}!\n" in r["body_text"] and "Fourth" not in r["raw_text"]
        assert r["body_text"] in r["raw_text"] and r["has_header"] == r["raw_text"].startswith("From: user")
    levels = [r["difficulty"] for r in rows if r["label"] == "en"]
    assert sorted(levels.count(x) for x in set(levels)) == [10, 10, 10, 10]
    assert sorted(map(str, rows)) == sorted(map(str, QUERIES["synthetic_mail_generation"](spark, str(tmp_path)).collect()))
