"""Steps whose cost grew faster than the input: the same results, and plans that move less."""

import hashlib
import os
from collections import Counter

from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import audit as U
from corpusloom.operators import contamination as C
from corpusloom.operators import features as V
from corpusloom.operators import models as L
from corpusloom.operators import neardup as N
from corpusloom.operators import sharded as S
from corpusloom.plans import queries as Q
from corpusloom.sources.scratch import shared_root


def plan(df):
    return df._jdf.queryExecution().toString()


def test_char_ngrams_are_not_shuffled_with_their_documents(spark):
    texts = [(1, "a bc 😀x 𝒳"), (1, "bc d"), (2, "bc bc\n\t😀x"), (3, ""), (4, None), (None, "bc"), (None, "x bc")]
    got = V.char_wb_counts(spark.createDataFrame(texts, "doc_id long, text string"))
    n, docs = Counter(), {}
    for key, text in texts:
        for word in (text or "").split():
            grams = [f" {word} "[i : i + k] for k in (2, 3) for i in range(len(word) + 3 - k)]
            n.update(grams)
            docs.setdefault(key, set()).update(grams)
    df = Counter(g for own in docs.values() for g in own)
    assert {r["term"]: (r["n"], r["df"]) for r in got.collect()} == {g: (n[g], df[g]) for g in n}
    assert "hashpartitioning(doc_id" not in "".join(line for line in plan(got).splitlines() if "term" in line)


def test_signature_compares_digests_and_cuts_one(spark):
    rows = [(1, ["a b c", "b c ß", ""]), (2, []), (3, ["x"])]
    df = spark.createDataFrame(rows, "id long, s array<string>").select("id", N.signature(F.col("s"), 4).alias("sig"))
    least = lambda s, salt: min((hashlib.sha256(f"42:{salt}:{x}".encode()).hexdigest()[:16] for x in s), default="0" * 16)
    assert {r["id"]: r["sig"] for r in df.collect()} == {i: [least(s, salt) for salt in range(4)] for i, s in rows}
    assert "substring(sha2" not in plan(df)
    words = spark.createDataFrame([(["a", "b"],), (["a", "b", "c", "a"],), ([],)], "w array<string>")
    assert [r[0] for r in words.select(X.word_shingles(F.col("w"), 3)).collect()] == [["a b"], ["a b c", "b c a"], []]


def test_rare_findings_meet_screened_marks_only(spark, monkeypatch):
    rows = [(i, f"w{i % 7} common x{i % 3} y{i}", "ab"[i % 7 > 2], "g", "t", "easy") for i in range(70)]
    df = spark.createDataFrame(rows, "id long, raw_text string, label string, template_group string, template_id string, difficulty string").withColumn("body_text", F.col("raw_text"))
    df = df.withColumns({f: F.lit(False) for f in U.FLAGS}).withColumn("urgency", F.col("id") % 4)
    found = U.leakage(df, ["w1"], U.Thresholds(min_count=2))
    every = sorted(map(str, U.finding_records(df, found, ["w1"]).collect()))
    monkeypatch.setattr(U, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(V, "HOT_TERMS", 1)
    marks = U._marked(df, ["w1"]).select("id", *U.KEYS)
    rare = found.where("category = 'class_specific_token'")
    passed = U._screened(marks, *U._bitmap(rare, rare.count()))
    assert passed.join(rare, U.KEYS, "left_semi").count() == marks.join(rare, U.KEYS, "left_semi").count() > 0
    assert passed.count() < marks.count() / 2
    assert sorted(map(str, U.finding_records(df, found, ["w1"]).collect())) == every
    judged = next(x for x in plan(U.leakage(df, ["w1"])).split("Physical Plan")[-1].splitlines() if "Aggregate" in x and "category" in x and "min(label" in x)
    assert "HashAggregate" in judged
    without = U.leakage(df, ["w1"], U.Thresholds(min_count=2), words=False)
    assert sorted(map(str, without.collect())) == sorted(map(str, found.where("category NOT IN ('class_specific_token', 'class_specific_bigram')").collect()))


def test_level_statistics_without_duplicates_reads_no_texts(spark, monkeypatch):
    rows = [(i, f"text {i % 5}\n\nmore", "ab"[i % 2], f"g{i % 4}", "easy") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, raw_text string, label string, template_group string, difficulty string").withColumn("body_text", F.col("raw_text"))
    sentences = spark.createDataFrame([(x, i, "fact", f"{x} {i}") for x in "ab" for i in range(12)], "subtopic string, variant_id int, style string, text string")
    assigned = C.assignment(df.drop("raw_text", "body_text"))
    both = C.level_statistics(df, assigned, sentences, ("C0", "C30"), near_duplicates=False)
    twins = {(r["level"], r["key"]): r["value"] for r in both.where("category = 'duplicates'").collect()}
    for level in ("C0", "C30"):
        texts = [r["raw_text"] for r in C.contaminate(df, assigned, sentences, (level,)).collect()]
        groups = 2.0 * sum(n > 1 for n in Counter(texts).values())
        assert twins[level, "exact_group_count"] == groups and twins[level, "normalized_group_count"] >= groups
    monkeypatch.setattr(C, "contaminate", None)  # makes the texts of a level
    plain = C.level_statistics(df, assigned, sentences, ("C0", "C30"), near_duplicates=False, duplicates=False)
    assert sorted(map(str, plain.collect())) == sorted(map(str, both.where("category <> 'duplicates'").collect()))


def test_unicode_steps_hold_no_arrow_batch(spark):
    df = spark.createDataFrame([("&lt;ﬁ&gt; ①",), (None,)], "t string").select(X.nfkc(X.unescape_html(F.col("t"))).alias("t"))
    assert [r["t"] for r in df.collect()] == ["<fi> 1", None]
    assert "ArrowEvalPython" not in plan(df)


def test_a_step_shuffles_neither_cells_nor_state(spark):
    rows = [(i, "ab"[i % 2], i % 2, " ".join(f"w{(i * j) % 23}" for j in range(1, 9))) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, label string, fold_id int, text string")
    with S.large_rows(spark):
        p = S.prepare(df, V.term_counts(df, V.analyze(F.col("text"))), "linear_svc", folds=2)
        try:
            state, _, told = S.fit(p, 2)
            joined = p.by_terms.join(p.idf.hint("shuffle_hash"), "tb")
            product = S._product(p, state.select("rb", F.col("a").alias("x")))
            again = state.join(product.withColumnRenamed("x", "product").hint("shuffle_hash"), "rb")
            for df in (joined, again):
                df.collect()
            moved = [x for x in plan(again).split("Physical Plan")[-1].splitlines() if "Exchange" in x and "ENSURE_REQUIREMENTS" in x]
        finally:
            p.close()
    scans = [x for x in plan(again).splitlines() if "Scan parquet" in x and "Bucketed: true" in x]
    assert told["steps"] == 2 and scans and moved


def test_covering_review_sees_words(spark, tmp_path):
    """One document has all words that its label has for itself, and nothing else that others of its group lack."""
    rows = [(i, "same words " + ("alone" if i % 2 else "other"), "en" if i % 2 else "de", "s" if i % 2 else "u", 20) for i in range(40)]
    rows += [(41, "same words alone rare", "en", "s", 21)] + [(43 + 2 * i, "rare", "en", "s", 4) for i in range(10)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    m = Q._sourced(spark, str(tmp_path))
    found = U.finding_records(m, U.leakage(m, ["idiot", "license"], Q._THRESHOLDS), ["idiot", "license"])
    words = found.where("category IN ('class_specific_token', 'class_specific_bigram')").select("feature").distinct()
    seen = found.join(Q.QUERIES["covering_spot_review"](spark, str(tmp_path)).select("id"), "id", "left_semi").select("feature").distinct()
    assert words.count() > 0 and words.join(seen, "feature", "left_anti").count() == 0


def test_minhash_signature_has_all_hashes(spark, tmp_path):
    spark.createDataFrame([(43, "rare", "en", "s", 4)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    signed = {r["id"]: r["signature"] for r in Q.QUERIES["minhash_signature"](spark, str(tmp_path)).collect()}
    assert signed[43] == "".join(hashlib.sha256(f"42:{salt}:rare".encode()).hexdigest()[:16] for salt in range(64))


def test_a_fit_leaves_no_states_behind(spark):
    rows = [(i, "ab"[i % 2], i % 2, " ".join(f"w{(i * j) % 23}" for j in range(1, 9))) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, label string, fold_id int, text string")
    root, tables = f"{shared_root(spark)}/corpusloom", {t.name for t in spark.catalog.listTables()}
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    cell = L.fit_cell(df, V.analyze(F.col("text")), L.FitConfig("linear_svc", folds=2, steps=3))
    left = {x.replace("-", "_").rsplit("_", 1)[0] for x in set(os.listdir(root)) - before}
    assert cell.oof.count() == 40 and "scores" in left and not {"state", "entries"} & left
    assert {t.name for t in spark.catalog.listTables()} == tables


def test_fast_signature_hashes_each_shingle_once(spark, monkeypatch):
    """The least of Spark's own xxhash64 of shingle and salt, whatever number of lists is salted at once."""
    rows = [(1, ["a b c", "b c ß", ""]), (2, []), (3, ["x"]), (4, None), (5, [f"w{i}" for i in range(300)])]
    df = spark.createDataFrame(rows, "id long, s array<string>").coalesce(1)
    plain = F.array(*[F.lpad(F.lower(F.hex(F.array_min(F.transform("s", lambda x: F.xxhash64(x, F.lit(salt + 42)))))), 16, "0") for salt in range(5)])
    want = {r["id"]: r["p"] for r in df.select("id", plain.alias("p")).collect()} | {2: ["0" * 16] * 5, 4: ["0" * 16] * 5}
    for hashes in (N.HASHES, 2):
        monkeypatch.setattr(N, "HASHES", hashes)
        found = N.signatures(df.withColumnRenamed("s", "__shingles"), "id", 5, family="xxhash64")
        assert {r["id"]: r["sig"] for r in found.collect()} == want
    assert plan(found).count("xxhash64(") <= 2 * plan(df.select(F.transform("s", lambda x: F.xxhash64(x)))).count("xxhash64(")
