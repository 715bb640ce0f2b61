"""A training-data pipeline of five stages over documents.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns the documents it keeps with their
columns, the last one packed pieces. Between stages documents are written as Parquet to the shared folder and read
back, so a lost executor costs no more than a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize, table
from corpusloom.llm.decontamination import decontaminate
from corpusloom.llm.line_dedup import dedup_lines, reference_state
from corpusloom.llm.packing import pack_documents
from corpusloom.llm.quality import quality_filter
from corpusloom.llm.shingle_dedup import one_of_each


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither their own rules nor their host's verdict reject. Null and empty texts have too few words and go;
    equal rows stay or go together; rows without a source are one host."""
    return quality_filter(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without its repeated lines; n_chars follows the text, and is null with it. Rows without a doc_id keep all
    lines; texts that lose all of them stay as empty ones."""
    refs, filters, shards, _ = reference_state(docs)
    clean = dedup_lines(docs, refs, filters, shards)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (SimHash; five-word shingles, similarity 0.8 or more): of those with the least
    doc_id, null ones last, one with the least hash of its text. Blank texts are one group; of equal rows one stays."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no verified overlap with a benchmark item. Rows are judged by id and text, so copies go together
    and another text under the id stays; null and empty texts stay."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents in sequences of at most 2048 tokens. Null and empty texts are a piece of the end id; rows
    are packed each; an empty table gives no rows."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SimHash, spaced seeds and the tokenizer have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, in order, over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
