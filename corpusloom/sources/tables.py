"""Sources and sinks: JSONL, CSV, fold artifacts, hash-gated inputs, manifests. All readers take explicit schemas."""

from __future__ import annotations

import hashlib
import json
import subprocess
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import written

METADATA = "struct<multi_intent: boolean, secondary_intent: string, contains_negation: boolean, component_indices: struct<greeting: bigint, closing: bigint, sender: bigint, subject: bigint, signature: bigint, quoted_reply: bigint, urgency: bigint>>"
MAIL = (
    "id string, raw_text string, body_text string, label string, template_group string, difficulty string, has_header boolean, has_signature boolean, "
    "has_quoted_reply boolean, generation_seed bigint, template_id string, variation_id bigint, generated_at timestamp, metadata " + METADATA
)
OOF = "sample_id string, condition string, model string, fold_id int, true_label string, predicted_label string"
FOLDS = "metadata struct<schema_version: string, created_at: string, splitter_name: string, n_splits: int, random_seed: bigint, label_column: string, group_column: string, data_hash: string>, records array<struct<sample_id: string, fold_id: int, split_role: string, label: string, template_group: string>>"


def read_jsonl(spark: SparkSession, path: str, schema: str = MAIL) -> DataFrame:
    """JSON lines; empty lines are skipped and a malformed row fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"', enforceSchema=False)


def read_oof(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, OOF)


def read_flags(spark: SparkSession, path: str, flags: tuple[str, ...] = ("has_header", "has_signature", "has_quoted_reply")) -> DataFrame:
    """sample_id and flags that a CSV has as "True" and "False"."""
    raw = read_csv(spark, path, "sample_id string, " + ", ".join(f"{f} string" for f in flags))
    return raw.select("sample_id", *[(F.lower(f) == "true").alias(f) for f in flags])


def read_folds(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Metadata (one row) and records of a fold artifact."""
    raw = spark.read.schema(FOLDS).json(path, multiLine=True)
    return raw.select("metadata.*"), raw.select(F.explode_outer("records").alias("r")).where("r is not null").select("r.*")


def content_sha256(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of each file, hashed where it is read."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def read_verified_jsonl(spark: SparkSession, path: str, approved_sha256: str, schema: str = MAIL) -> DataFrame:
    """JSON lines of one file whose bytes have the approved hash; else an error."""
    found = content_sha256(spark, path).collect()
    if len(found) != 1:
        raise FileNotFoundError(f"{path}: {len(found)} files")
    if found[0]["sha256"] != approved_sha256:
        raise ValueError(f"{path}: hash {found[0]['sha256']} is not the approved {approved_sha256}")
    return read_jsonl(spark, path, schema)


def write_jsonl(df: DataFrame, path: str, key: str = "id") -> str:
    """Sorted JSON lines in one file; returns the SHA-256 of its bytes. For the small corpora of an experiment."""
    lines = df.orderBy(key).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    digest = hashlib.sha256()
    with open(path, "w", encoding="utf-8") as out:
        for row in lines.toLocalIterator():
            line = row["value"] + "\n"
            digest.update(line.encode())
            out.write(line)
    return digest.hexdigest()


#: Bytes of a part of a hashed table, about.
PART_BYTES = 64 << 20


def _part_digests(spark: SparkSession, path: str) -> list[tuple[str, int, str]]:
    """(name, bytes, SHA-256) of the parts of a folder in order; a part is hashed in one task and is about PART_BYTES long."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/data")
    rows = found.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256")).collect()
    return sorted((r["name"], r["size"], r["sha256"]) for r in rows if r["size"])


def _tree(parts: list[tuple[str, int, str]]) -> str:
    """The digest of the parts' digests in order; their names do not matter."""
    return hashlib.sha256("".join(f"{n} {d}\n" for _, n, d in parts).encode()).hexdigest()


def write_hashed_jsonl(df: DataFrame, path: str, key: str = "id", part_bytes: int = PART_BYTES) -> str:
    """Sorted JSON lines in range parts under path/data, a manifest with a digest for each part under path/manifest; returns the digest of
    the part digests in order. Tasks write and hash; the driver gets a row for each part. The path must be new. Rows with equal keys
    are ordered by their text; an empty table has an empty manifest and the digest of nothing."""
    spark = df.sparkSession
    lines = written(df.select(F.col(key).alias("key"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value")), "lines")
    size = lines.agg(F.sum(F.octet_length("value") + 1)).first()[0] or 0
    ranged = lines.repartitionByRange(max(1, -(-size // part_bytes)), "key", "value").sortWithinPartitions("key", "value")
    ranged.select("value").write.text(f"{path}/data", lineSep="\n")
    parts = _part_digests(spark, path)
    spark.createDataFrame(parts, "name string, size long, sha256 string").coalesce(1).write.json(f"{path}/manifest")
    return _tree(parts)


def damaged_parts(spark: SparkSession, path: str) -> list[str]:
    """The parts of a hashed table that are missing, unknown or differ from the manifest."""
    want = {r["name"]: (r["size"], r["sha256"]) for r in spark.read.schema("name string, size long, sha256 string").json(f"{path}/manifest").collect()}
    have = {name: (size, digest) for name, size, digest in _part_digests(spark, path)}
    return sorted(name for name in want.keys() | have.keys() if want.get(name) != have.get(name))


def read_hashed_jsonl(spark: SparkSession, path: str, approved: str, schema: str = MAIL) -> DataFrame:
    """JSON lines of a hashed table, each part checked; an error that names the parts that are not as written, or if the whole is not the
    approved one."""
    if bad := damaged_parts(spark, path):
        raise ValueError(f"{path}: damaged parts {', '.join(bad)}")
    found = _tree(_part_digests(spark, path))
    if found != approved:
        raise ValueError(f"{path}: hash {found} is not the approved {approved}")
    return read_jsonl(spark, f"{path}/data", schema)


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """A CSV folder with the declared columns in their order; unknown ones are an error, nulls are empty."""
    if unknown := set(df.columns) - set(fields):
        raise ValueError(f"undeclared columns {sorted(unknown)}")
    df.select(*fields).coalesce(1).write.mode("overwrite").csv(path, header=True, lineSep="\r\n", nullValue="", emptyValue="", escape='"')


def write_partitioned(df: DataFrame, path: str, *columns: str) -> None:
    df.write.mode("overwrite").partitionBy(*columns).parquet(path)


def canonical_json(value) -> str:
    return json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n"


def _git(*args: str) -> str | None:
    try:
        return subprocess.run(["git", *args], capture_output=True, text=True, check=True, timeout=20).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return None


def run_manifest(run_id: str, metrics: dict, outputs: dict[str, str], **fields) -> dict:
    """What a run was made of; git fields are null where git fails."""
    status = _git("status", "--porcelain")
    return {
        "run_id": run_id, "created_at": datetime.now(timezone.utc).isoformat(), "git_commit": _git("rev-parse", "HEAD"), "git_dirty": None if status is None else bool(status),
        "metrics": metrics, "outputs": outputs, **fields,
    }


def struct_of(schema: str) -> T.StructType:
    return T._parse_datatype_string(schema)
