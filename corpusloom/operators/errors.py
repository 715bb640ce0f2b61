"""Misclassified samples and their categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import CELL

# Category patterns.
ORTHOGRAPHIC = "出来"
FULL_WIDTH, HALF_WIDTH = "[０-９Ａ-Ｚａ-ｚ]", "[0-9A-Za-z]"
LATIN_RUN, JAPANESE = "[A-Za-z]{2,}", "[぀-ヿ一-鿿]"
GLUED = rf"{JAPANESE}(?:https?://|www\.)|(?:https?://|www\.)\S*{JAPANESE}|{JAPANESE}[A-Za-z0-9._%+-]+@|@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}{JAPANESE}"
CATEGORIES = ("multi_intent", "ambiguous_difficulty", "structural_content", "negation_present")
JA_CATEGORIES = (*CATEGORIES, "orthographic_variation", "mixed_ja_en", "morphological_segmentation")


def must_match(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join in which every left row must have a partner, else an error."""
    joined = left.join(right.withColumn("__there", F.lit(True)), key, "left")
    lost = F.raise_error(F.concat(F.lit(f"no record for {key} "), F.col(key).cast("string"))).cast("boolean")
    return joined.where(F.coalesce("__there", lost)).drop("__there")


def misclassified(oof: DataFrame, records: DataFrame) -> DataFrame:
    """Rows of oof with another predicted than true label, with their records."""
    return must_match(oof.where(F.col("true_label") != F.col("predicted_label")), records, "sample_id")


def category_flags(ja: bool = False) -> dict[str, Column]:
    """Conditions of the categories over a record's columns, in order of priority."""
    flags = {
        "multi_intent": F.coalesce("multi_intent", F.lit(False)),
        "ambiguous_difficulty": F.col("difficulty").isin("hard", "ambiguous"),
        "structural_content": F.col("has_header") | F.col("has_signature") | F.col("has_quoted_reply"),
        "negation_present": F.coalesce("contains_negation", F.lit(False)),
    }
    if ja:
        body = F.col("body_text")
        flags["orthographic_variation"] = F.contains(body, F.lit(ORTHOGRAPHIC)) | (F.rlike(body, F.lit(FULL_WIDTH)) & F.rlike(body, F.lit(HALF_WIDTH)))
        flags["mixed_ja_en"] = F.rlike(body, F.lit(LATIN_RUN)) & F.rlike(body, F.lit(JAPANESE))
        flags["morphological_segmentation"] = F.rlike(body, F.lit(GLUED))
    return flags


def primary_category(ja: bool = False) -> Column:
    """The first category that holds."""
    out = None
    for name, flag in category_flags(ja).items():
        out = F.when(flag, name) if out is None else out.when(flag, name)
    return out.otherwise("uncategorized")


def with_categories(df: DataFrame, ja: bool = False) -> DataFrame:
    """df with a cat_ column for each category and for none, and primary_category."""
    flags = category_flags(ja)
    none = ~F.array_contains(F.array(*flags.values()), True)
    return df.withColumns({**{f"cat_{k}": v for k, v in flags.items()}, "cat_uncategorized": none, "primary_category": primary_category(ja)})


def primary_counts(errors: DataFrame) -> DataFrame:
    return errors.groupBy(*CELL, "primary_category").agg(F.count("*").alias("count"))


def overlap_counts(errors: DataFrame) -> DataFrame:
    """Errors of each category, which may overlap, and their share of the cell's; categories without errors are left out."""
    names = [c for c in errors.columns if c.startswith("cat_")]
    long = errors.select(*CELL, F.explode(F.array(*[F.when(F.col(c), F.lit(c[4:])) for c in names])).alias("category"))
    counts = long.where("category is not null").groupBy(*CELL, "category").agg(F.count("*").alias("count"))
    totals = errors.groupBy(*CELL).agg(F.count("*").alias("total"))
    return counts.join(totals, CELL).select(*CELL, "category", "count", (F.col("count") / F.col("total")).alias("share_of_misclassified"))
