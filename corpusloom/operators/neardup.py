"""Near duplicates by MinHash, banded LSH and exact Jaccard similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.scratch import written
from . import setjoin

NUM_PERM, BANDS, THRESHOLD, SEED = 64, 16, 0.5, 42


def with_shingles(df: DataFrame, text: str = "body_text", k: int = 3, chars: bool = False) -> DataFrame:
    """df with __shingles: distinct word k-shingles of the casefolded text, or character ones."""
    folded = X.casefold(text)
    made = X.char_shingles(folded, k) if chars else X.word_shingles(F.filter(F.split(folded, r"\s+"), lambda w: w != ""), k)
    return df.withColumn("__shingles", made)


def signature(shingles: Column, num_perm: int = NUM_PERM, seed: int = SEED, family: str = "sha256") -> Column:
    """MinHash of a set of shingles: for each salt the least 64-bit hash, as 16 hex digits; zeros for an empty set.
    family "sha256" repeats published signatures, "xxhash64" is several times as fast."""
    def of(own: Column) -> Column:
        if family == "sha256":
            made = F.transform(F.array(*[F.lit(f"{seed}:{salt}:") for salt in range(num_perm)]), lambda prefix: X.least_hash(own, prefix))
        else:
            least = lambda salt: F.lpad(F.lower(F.hex(F.array_min(F.transform(own, lambda s: F.xxhash64(s, salt + seed))))), 16, "0")
            made = F.transform(F.sequence(F.lit(0), F.lit(num_perm - 1)), least)
        return F.when(F.size(own) > 0, made).otherwise(F.array_repeat(F.lit("0" * 16), num_perm))
    return X.let(shingles, of)


#: XXH64's primes.
P1, P2, P3, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
#: Hashes that are salted at once, about.
HASHES = 1 << 16


def salted(hashes: np.ndarray, n: int) -> np.ndarray:
    """XXH64 of an int under each seed of hashes (uint64), as Spark's xxhash64 goes on from one column to the next."""
    x = hashes + (P5 + np.uint64(4))
    x ^= np.uint64((n & 0xFFFFFFFF) * int(P1) & 0xFFFFFFFFFFFFFFFF)
    x = ((x << np.uint64(23)) | (x >> np.uint64(41))) * P2 + P3
    x = (x ^ (x >> np.uint64(33))) * P2
    x = (x ^ (x >> np.uint64(29))) * P3
    return x ^ (x >> np.uint64(32))


def _least_salted(column: pa.Array, num_perm: int, seed: int) -> pa.Array:
    """For each salt the least salted hash of each list of hashes, as signed numbers; null for an empty list."""
    ends, values = np.asarray(column.offsets), column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    out, full = np.zeros((len(column), num_perm), np.int64), np.flatnonzero(np.diff(ends))
    starts, stops, i = ends[full], ends[full + 1], 0
    while i < len(full):  # lists of HASHES in all, one at least
        j = max(i + 1, int(np.searchsorted(stops, starts[i] + HASHES, "right")))
        own = values[starts[i] : stops[j - 1]]
        for salt in range(num_perm):
            out[full[i:j], salt] = np.minimum.reduceat(salted(own, salt + seed).view(np.int64), starts[i:j] - starts[i])
        i = j
    return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, num_perm, dtype=np.int32)), pa.array(out.ravel()), mask=pa.array(np.diff(ends) == 0))


def signatures(df: DataFrame, key: str, num_perm: int = NUM_PERM, seed: int = SEED, family: str = "sha256") -> DataFrame:
    """(key, sig): the `signature` of __shingles. xxhash64(s, n) is the hash of n seeded with that of s, so that of family "xxhash64" each shingle
    is hashed once."""
    if family == "sha256":
        return df.select(key, signature(F.col("__shingles"), num_perm, seed).alias("sig"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _least_salted(batch.column(1), num_perm, seed)], names=["key", "least"])

    hashes = df.select(F.col(key).alias("key"), F.transform("__shingles", lambda s: F.xxhash64(s)).alias("hashes"))
    made = hashes.mapInArrow(run, f"key {dict(df.dtypes)[key]}, least array<bigint>")
    sig = F.transform("least", lambda x: F.lpad(F.lower(F.hex(x)), 16, "0"))
    return made.select(F.col("key").alias(key), F.coalesce(sig, F.array_repeat(F.lit("0" * 16), num_perm)).alias("sig"))


def lsh_candidates(df: DataFrame, key: str = "id", num_perm: int = NUM_PERM, bands: int = BANDS, seed: int = SEED, family: str = "sha256") -> DataFrame:
    """Pairs (a, b), a < b, of rows with __shingles that share a band of their signatures."""
    if num_perm % bands:
        raise ValueError("num_perm must be divisible by bands")
    rows = num_perm // bands
    signed = written(signatures(df, key, num_perm, seed, family), "signatures")
    parts = X.let(F.col("sig"), lambda sig: F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.unhex(F.array_join(F.slice(sig, b * rows + 1, F.lit(rows)), ""))))
    banded = signed.select(key, F.posexplode(parts).alias("band", "bucket"))
    # a bucket of one row makes no pair; what is left is a table, so that signatures are made once
    shared = banded.withColumn("n", F.count("*").over(Window.partitionBy("band", "bucket"))).where("n > 1").drop("n")
    held = written(shared, "buckets")
    left, right = held.select(F.col(key).alias("a"), "band", "bucket"), held.select(F.col(key).alias("b"), "band", "bucket")
    return left.join(right, ["band", "bucket"]).where("a < b").select("a", "b").distinct()


def jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection over that of the union; 1 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def near_duplicates(df: DataFrame, text: str = "body_text", k: int = 3, chars: bool = False, threshold: float = THRESHOLD, num_perm: int = NUM_PERM, bands: int = BANDS, family: str = "sha256") -> DataFrame:
    """Candidate pairs at or above the threshold with what they share. Only rows of candidates are read on, and of their shingles only hashes
    of different sets meet (`setjoin`)."""
    made = lambda rows: with_shingles(rows, text, k, chars).select("id", "__shingles")
    pairs = written(lsh_candidates(made(df.select("id", text)), "id", num_perm, bands, family=family), "pairs")
    rows = df.join(setjoin.few_ids(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "id", "left_semi")
    membership, sets = setjoin.classes(made(rows.select("id", text)), "id", "__shingles")
    plain = X.normalize(X.clean("raw_text", X.CleanConfig(unicode=False)), X.CleanConfig(unicode=False))
    own = rows.select("id", "label", "template_group", F.sha2("raw_text", 256).alias("raw"), F.sha2("body_text", 256).alias("body"), F.sha2(plain, 256).alias("norm"))
    about = written(own.join(membership.distinct(), "id"), "about-pairs")
    side = lambda s: about.select(F.col("id").alias(s), F.col("class_id").alias(f"class_{s}"), F.col("label").alias(f"label_{s}"), F.col("template_group").alias(f"group_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("raw", "body", "norm")])
    met = written(pairs.join(side("a"), "a").join(side("b"), "b").withColumns({"low": F.least("class_a", "class_b"), "high": F.greatest("class_a", "class_b")}), "met")
    classes = met.where("low < high").select(F.col("low").alias("a"), F.col("high").alias("b")).distinct()
    similar = setjoin.decided(classes, sets, rows.select("id", text), "id", "__shingles", threshold, made).select(F.col("a").alias("low"), F.col("b").alias("high"), "jaccard")
    both = met.join(similar, ["low", "high"], "left").withColumn("jaccard_similarity", F.when(F.col("low") == F.col("high"), 1.0).otherwise(F.col("jaccard"))).where("jaccard_similarity IS NOT NULL")
    return both.select(
        F.col("a").alias("sample_id_a"), F.col("b").alias("sample_id_b"), "label_a", "label_b", F.col("group_a").alias("template_group_a"), F.col("group_b").alias("template_group_b"),
        (F.col("label_a") == F.col("label_b")).alias("same_label"), (F.col("group_a") == F.col("group_b")).alias("same_template_group"), "jaccard_similarity",
        (F.col("raw_a") == F.col("raw_b")).alias("exact_raw_duplicate"), (F.col("body_a") == F.col("body_b")).alias("exact_body_duplicate"), (F.col("norm_a") == F.col("norm_b")).alias("normalized_duplicate"),
    )


def exact_near_duplicates(df: DataFrame, text: str = "body_text", k: int = 3, chars: bool = False, threshold: float = THRESHOLD) -> setjoin.SimilarSets:
    """Every pair of different shingle sets at or above the threshold, and the class of every row. MinHash is the fast way that
    misses pairs; this one misses none."""
    made = lambda rows: with_shingles(rows, text, k, chars).select("id", "__shingles")
    return setjoin.similar_sets(df.select("id", text), "id", "__shingles", threshold, made)


def exact_summary(df: DataFrame, text: str = "body_text", k: int = 3, chars: bool = False, threshold: float = THRESHOLD) -> DataFrame:
    """The columns of summary() over all pairs of rows, copies included, without making them: pairs are counted by class. A null text
    is empty."""
    found = exact_near_duplicates(df, text, k, chars, threshold)
    raw, body = F.coalesce("raw_text", F.lit("")), F.coalesce("body_text", F.lit(""))
    plain = X.normalize(X.clean(raw, X.CleanConfig(unicode=False)), X.CleanConfig(unicode=False))
    about = df.select("id", "label", "template_group", F.sha2(body, 256).alias("body"), F.sha2(plain, 256).alias("plain"))
    members = written(about.join(found.membership, "id"), "members")
    pairs = written(found.pairs, "similar-pairs")
    # texts equal as they are also agree when normalized
    wanted = {"total": [], "label": ["label"], "group": ["template_group"], "body": ["body"], "plain": ["plain"], "both": ["body", "plain"]}
    one = None
    for name, columns in wanted.items():
        n = setjoin.agreeing_pairs(members, pairs, columns).withColumnRenamed("n", name)
        one = n if one is None else one.crossJoin(F.broadcast(n))  # single rows
    c = F.col
    return one.select(c("total").alias("total_pairs"), (c("total") - c("body") - c("plain") + c("both")).alias("beyond_core"), (c("total") - c("label")).alias("cross_label"), c("group").alias("same_group"), (c("total") - c("group")).alias("different_group"))


def summary(pairs: DataFrame) -> DataFrame:
    """Pairs in all, beyond exact and normalized duplicates, across labels, in one and in two groups."""
    known = F.col("exact_raw_duplicate") | F.col("exact_body_duplicate") | F.col("normalized_duplicate")
    return pairs.agg(F.count("*").alias("total_pairs"), F.count_if(~known).alias("beyond_core"), F.count_if(~F.col("same_label")).alias("cross_label"), F.count_if(F.col("same_template_group")).alias("same_group"), F.count_if(~F.col("same_template_group")).alias("different_group"))


def summary_by_level(levels: dict[str, DataFrame], **options) -> DataFrame:
    """The near duplicates of each level's texts in numbers, with the level; options are those of exact_summary."""
    parts = [exact_summary(df, **options).select(F.lit(level).alias("contamination_level"), "*") for level, df in levels.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
