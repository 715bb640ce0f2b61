"""The driver's tables seen as the engine's data model: mails, out-of-fold predictions, sentences; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABELS = ("de", "en", "es", "fr")
CONDITIONS, MODELS, LEVELS = ("D0", "D1", "D2"), ("linear_svc", "logreg"), ("C0", "C10", "C20", "C30")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as mails: the language is the label, language and source the group."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    n = F.col("n_chars")
    return d.select(
        i.alias("id"), F.col("text").alias("raw_text"), F.col("text").alias("body_text"), F.col("lang").alias("label"), F.concat_ws("-", "lang", "source").alias("template_group"),
        F.when(n < 400, "easy").when(n < 1200, "medium").when(n < 3000, "hard").otherwise("ambiguous").alias("difficulty"),
        (i % 2 == 0).alias("has_header"), (i % 3 == 0).alias("has_signature"), (i % 5 == 0).alias("has_quoted_reply"),
        F.concat("source", F.lit("-t"), (i % 4).cast("string")).alias("template_id"), (i % 50).alias("variation_id"), (i % 11 == 0).alias("multi_intent"), (i % 4).alias("urgency"),
    )


def _next_label():
    return F.element_at(F.create_map(*[F.lit(x) for a, b in zip(LABELS, (*LABELS[1:], LABELS[0])) for x in (a, b)]), F.col("lang"))


def oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of every cell that miss a known part of the documents."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("condition"), F.lit(m).alias("model"), F.lit(i).alias("c"), F.lit(j).alias("m")) for i, c in enumerate(CONDITIONS) for j, m in enumerate(MODELS)]))
    x = d.withColumn("x", cells)
    wrong = (F.col("doc_id") * 31 + F.col("x.c") * 7 + F.col("x.m") * 3) % 11 < 2 + F.col("x.c")
    return x.select(F.col("doc_id").alias("sample_id"), "x.condition", "x.model", (F.col("doc_id") % 5).cast("int").alias("fold_id"), F.col("lang").alias("true_label"), F.when(wrong, _next_label()).otherwise(F.col("lang")).alias("predicted_label"))


def oof_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    cells = F.explode(F.array(*[F.struct(F.lit(v).alias("contamination_level"), F.lit(m).alias("model"), F.lit(i).alias("v"), F.lit(j).alias("m")) for i, v in enumerate(LEVELS) for j, m in enumerate(MODELS)]))
    x = d.withColumn("x", cells)
    wrong = (F.col("doc_id") * 31 + F.col("x.m") * 3 + F.col("x.v") * 5) % 13 < 2 + F.col("x.v")
    return x.select(F.col("doc_id").alias("sample_id"), F.lit("D1").alias("condition"), "x.model", "x.contamination_level", (F.col("doc_id") % 5).cast("int").alias("fold_id"), F.col("lang").alias("true_label"), F.when(wrong, _next_label()).otherwise(F.col("lang")).alias("predicted_label"))


def sentences(spark: SparkSession) -> DataFrame:
    """Twelve sentences for each label in six styles."""
    styles = ("fact", "concise", "polite", "casual", "question", "story")
    return spark.createDataFrame([(x, i, styles[i % 6], f"By the way, {x} matter {i} is open.") for x in LABELS for i in range(12)], "subtopic string, variant_id int, style string, text string")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that engines which add in another order agree."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


MAILS_SQL = """mails AS (SELECT doc_id AS id, text AS raw_text, text AS body_text, lang AS label, lang || '-' || source AS template_group,
  CASE WHEN n_chars < 400 THEN 'easy' WHEN n_chars < 1200 THEN 'medium' WHEN n_chars < 3000 THEN 'hard' ELSE 'ambiguous' END AS difficulty,
  doc_id % 2 = 0 AS has_header, doc_id % 3 = 0 AS has_signature, doc_id % 5 = 0 AS has_quoted_reply, source || '-t' || CAST(doc_id % 4 AS VARCHAR) AS template_id,
  doc_id % 50 AS variation_id, doc_id % 11 = 0 AS multi_intent, doc_id % 4 AS urgency FROM documents)"""
_NEXT = "CASE lang WHEN 'de' THEN 'en' WHEN 'en' THEN 'es' WHEN 'es' THEN 'fr' ELSE 'de' END"
OOF_SQL = f"""oof AS (SELECT doc_id AS sample_id, condition, model, CAST(doc_id % 5 AS INTEGER) AS fold_id, lang AS true_label,
  CASE WHEN (doc_id * 31 + c * 7 + m * 3) % 11 < 2 + c THEN {_NEXT} ELSE lang END AS predicted_label
  FROM documents, (VALUES ('D0', 0), ('D1', 1), ('D2', 2)) AS a(condition, c), (VALUES ('linear_svc', 0), ('logreg', 1)) AS b(model, m))"""
LEVELS_SQL = f"""oofl AS (SELECT doc_id AS sample_id, 'D1' AS condition, model, contamination_level, CAST(doc_id % 5 AS INTEGER) AS fold_id, lang AS true_label,
  CASE WHEN (doc_id * 31 + m * 3 + v * 5) % 13 < 2 + v THEN {_NEXT} ELSE lang END AS predicted_label
  FROM documents, (VALUES ('C0', 0), ('C10', 1), ('C20', 2), ('C30', 3)) AS a(contamination_level, v), (VALUES ('linear_svc', 0), ('logreg', 1)) AS b(model, m))"""
METRICS_SQL = """lc AS (SELECT condition, model, fold_id, label, sum(t) AS tp, sum(s) AS support, sum(p) AS predicted FROM (
    SELECT condition, model, fold_id, true_label AS label, 1 AS s, 0 AS p, CASE WHEN true_label = predicted_label THEN 1 ELSE 0 END AS t FROM oof
    UNION ALL SELECT condition, model, fold_id, predicted_label, 0, 1, 0 FROM oof) GROUP BY ALL),
sc AS (SELECT *, coalesce(tp::DOUBLE / nullif(predicted, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(support, 0), 0) AS recall, coalesce(2.0 * tp / nullif(support + predicted, 0), 0)::DOUBLE AS f1 FROM lc),
ml AS (SELECT condition, model, fold_id, 'precision_' || label AS metric, precision AS value FROM sc UNION ALL SELECT condition, model, fold_id, 'recall_' || label, recall FROM sc
  UNION ALL SELECT condition, model, fold_id, 'f1_' || label, f1 FROM sc UNION ALL SELECT condition, model, fold_id, 'macro_f1', avg(f1) FROM sc GROUP BY ALL
  UNION ALL SELECT condition, model, fold_id, 'weighted_f1', sum(f1 * support)::DOUBLE / sum(support) FROM sc GROUP BY ALL
  UNION ALL SELECT condition, model, fold_id, 'accuracy', sum(tp)::DOUBLE / sum(support) FROM sc GROUP BY ALL)"""
