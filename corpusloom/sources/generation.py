"""Synthetic mails from templates: balanced, seeded, and the same on any engine with SHA-256."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators.folds import rank_within, seeded

#: Own templates: label, group, context, request, detail.
TEMPLATES = tuple(
    (label, f"{label}-{n}", context, request, detail)
    for label, texts in {
        "delivery": (("The parcel has not come.", "Where is it now?", "It was due on Monday."), ("The box came open.", "Send another one.", "Two cups are not inside.")),
        "billing": (("The invoice shows two fees.", "Take one of them off.", "I paid on the first."), ("My card was charged again.", "Return the second payment.", "The plan ended in May.")),
        "technical": (("The page stays white.", "Tell me what to try.", "A restart did not help."), ("The app stops at start.", "Is there a repair?", "It began with the update.")),
        "account": (("I cannot sign in.", "Reset my access.", "The code never arrives."), ("My address is wrong.", "Change it in the profile.", "We moved last week.")),
    }.items()
    for n, (context, request, detail) in enumerate(texts)
)
GREETINGS, CLOSINGS = ("Hello,", "Good day,", "Dear team,"), ("Thank you.", "Regards,", "Best wishes,")
URGENCY = ("", "This is urgent.", "Please answer today.", "There is no hurry.")
DIFFICULTIES = ("easy", "medium", "hard", "ambiguous")


@dataclass(frozen=True)
class GenerationConfig:
    per_label: int = 200
    seed: int = 42
    header: float = 0.55
    signature: float = 0.55
    quoted: float = 0.35


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES), "label string, template_group string, context string, request string, detail string")


def _uniform(seed: int, *columns) -> Column:
    """A number in [0, 1) from a seeded hash."""
    return F.conv(F.substring(seeded(seed, *columns), 1, 8), 16, 10).cast("double") / float(1 << 32)


def _pick(values: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values)).cast("int") + 1)


def generate(templates_: DataFrame, config: GenerationConfig = GenerationConfig()) -> DataFrame:
    """per_label mails of each label, as even over its groups and difficulties as can be."""
    variations = templates_.select("*", F.explode(F.sequence(F.lit(0), F.lit(config.per_label - 1))).alias("variation_id"))
    order = Window.partitionBy("label").orderBy("variation_id", seeded(config.seed, "template_group", "variation_id"))
    return _mails(variations.withColumn("serial", F.row_number().over(order) - 1).where(F.col("serial") < config.per_label), config)


def templates_of(texts: DataFrame) -> DataFrame:
    """texts (label, template_group, variation_id, text) with the first three sentences of each as context, request and detail; a null text
    is empty, as are sentences that a text lacks."""
    parts = F.filter(F.split(F.coalesce("text", F.lit("")), r"(?<=[.!?])\s+|\n"), lambda x: F.trim(x) != "")
    return texts.select("label", "template_group", "variation_id", X.let(parts, lambda p: F.struct(*[F.coalesce(F.get(p, F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(("context", "request", "detail"))])).alias("x")).select("label", "template_group", "variation_id", "x.*")


def generate_from(texts: DataFrame, config: GenerationConfig = GenerationConfig()) -> DataFrame:
    """One mail from each of texts (label, template_group, variation_id, text), those of a label numbered in a seeded order by range
    partitions, so that no label is one task; difficulties and urgencies are as even as can be within a label."""
    order = seeded(config.seed, "template_group", "variation_id")
    ranked = rank_within(templates_of(texts.where("label IS NOT NULL")).withColumn("order", order), "label", ["order", "variation_id"], "serial")
    return _mails(ranked.withColumn("serial", F.col("serial") - 1), config)


def _mails(rows: DataFrame, config: GenerationConfig) -> DataFrame:
    """Mails from rows (label, serial, template_group, variation_id, context, request, detail)."""
    key = ("label", "serial")
    u = lambda what: _uniform(config.seed, F.lit(what), *key)
    rows = rows.withColumns({
        "id": F.format_string("%s-%05d", "label", F.col("serial")), "difficulty": _pick(DIFFICULTIES, F.col("serial")), "urgency": _pick(URGENCY, F.col("serial")),
        "has_header": u("header") < config.header, "has_signature": u("signature") < config.signature, "has_quoted_reply": u("quoted") < config.quoted,
    })
    body = F.array_join(F.filter(F.array(_pick(GREETINGS, F.col("serial")), F.col("context"), F.col("request"), F.col("detail"), F.col("urgency"), _pick(CLOSINGS, F.floor(F.col("serial") / 3))), lambda x: x != ""), "\n")
    head = F.when(F.col("has_header"), F.concat(F.lit("From: user"), F.col("serial").cast("string"), F.lit("@example.com\nSubject: "), F.col("request"), F.lit("\n\n"))).otherwise("")
    tail = F.concat(F.when(F.col("has_signature"), "\n--\nA. User").otherwise(""), F.when(F.col("has_quoted_reply"), "\n> earlier message").otherwise(""))
    made = rows.withColumn("body_text", body).withColumn("raw_text", F.concat(head, F.col("body_text"), tail))
    negated = X.contains_any("raw_text", X.NEGATIONS)
    return made.select("id", "raw_text", "body_text", "label", "template_group", "difficulty", "has_header", "has_signature", "has_quoted_reply", F.lit(config.seed).cast("long").alias("generation_seed"), F.concat("template_group", F.lit("-t")).alias("template_id"), F.col("variation_id").cast("long").alias("variation_id"), "urgency", negated.alias("contains_negation"))


def gate_warnings(mails: DataFrame, per_label: int, tolerance: float = 0.05) -> list[str]:
    """What keeps a generated corpus from passing: duplicates, shares of classes, missing difficulties."""
    row = mails.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.countDistinct("label").alias("labels")).first()
    found = [] if row["n"] == row["ids"] else ["ids repeat"]
    for r in mails.groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("difficulty").alias("d")).collect():
        if abs(r["n"] / row["n"] - 1 / row["labels"]) > tolerance:
            found.append(f"{r['label']} has an uneven share")
        if r["n"] != per_label:
            found.append(f"{r['label']} has {r['n']} rows, not {per_label}")
        if r["d"] < len(DIFFICULTIES):
            found.append(f"{r['label']} lacks a difficulty")
    return found
