"""SimHash near-duplicates through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments A, B (23 bits) and C (18 bits, padded with zeros). A segment is decoded to
the indices of all codewords of the perfect binary Golay code [23,12,7] within distance 4: 5.3 on average, 6 at most.
Two segments that differ in at most two bits have a midpoint within 3 of some codeword, so they share an index.

At most 4 errors (a, b, c) fall on the segments, so one of these composite keys is shared by any two linked texts:

- a <= 2 and b <= 2: index of A with index of B
- a >= 3, hence b + c <= 1: exact B with index of C, or index of B with exact C
- b >= 3, hence a + c <= 1: exact A with index of C, or index of A with exact C

Rows with a shared key meet in one task, are verified by their bits and linked; no pair of a group is emitted.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, materialize, maybe_broadcast, small_batches, table, utf8, with_schema
from .components import components

SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: Generator polynomial of the binary Golay code [23,12,7].
GOLAY = 0xC75
#: Fingerprints with one key that a task compares at most; larger groups are dealt out as pairs of blocks.
BLOCK = 20_000
SKEW_SAMPLE = 16
#: Shingles hashed at a time.
CHUNK = 1 << 16
EDGES = "u long, v long"


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of UTF-8 text; 0 without words."""
    words = b" ".join(text.lower().split())
    if not words:
        return 0
    blanks = np.flatnonzero(np.frombuffer(words, np.uint8) == 32)
    n = max(1, len(blanks) + 2 - size)
    starts = np.concatenate([[0], blanks + 1])
    ends = np.concatenate([blanks, [len(words)]])
    starts, ends = starts[:n], ends[-n:]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        hashes = np.array([digest(words[s:e], SEED) for s, e in zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist())], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for low in range(0, len(bits), 255):
            ones += bits[low : low + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long) of docs (doc_id, text); null and blank texts have fingerprint 0."""
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, size) for t in utf8(batch, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])

    return with_schema(docs, "doc_id", "text").mapInArrow(run, "doc_id long, fp long")


class GolayDecoder:
    """indices(v): the 12-bit indices of all codewords within distance 4 of 23-bit vectors, -1 where there are fewer."""

    def __init__(self):
        syndromes = np.zeros(23, np.int64)
        for bit in range(23):
            value = 1 << bit
            for high in range(22, 10, -1):
                if value >> high & 1:
                    value ^= GOLAY << (high - 11)
            syndromes[bit] = value
        self.tables = [np.zeros(256, np.int64) for _ in range(3)]
        for k, values in enumerate(self.tables):
            for byte in range(256):
                for bit in range(8):
                    if byte >> bit & 1 and 8 * k + bit < 23:
                        values[byte] ^= syndromes[8 * k + bit]
        self.errors = np.full((2048, 6), -1, np.int64)
        filled = np.zeros(2048, np.int64)
        for weight in range(5):
            for bits in combinations(range(23), weight):
                s = 0
                for bit in bits:
                    s ^= int(syndromes[bit])
                self.errors[s, filled[s]] = sum(1 << bit for bit in bits)
                filled[s] += 1

    def indices(self, v: np.ndarray) -> np.ndarray:
        syndrome = self.tables[0][v & 255] ^ self.tables[1][v >> 8 & 255] ^ self.tables[2][v >> 16]
        errors = self.errors[syndrome]
        return np.where(errors < 0, -1, (v[:, None] ^ errors) >> 11)


_decoder: list[GolayDecoder] = []


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All composite keys of unsigned fingerprints: (key, row of fp), without repeats within a row."""
    if not _decoder:
        _decoder.append(GolayDecoder())
    a, b, c = ((fp >> np.uint64(shift) & np.uint64((1 << bits) - 1)).astype(np.int64) for shift, bits in ((0, 23), (23, 23), (46, 18)))
    near_a, near_b, near_c = (_decoder[0].indices(x) for x in (a, b, c))
    keys, rows = [], []

    def family(number: int, left: np.ndarray, right: np.ndarray, bits: int) -> None:
        both = (left[:, :, None] << bits | right[:, None, :]).reshape(len(fp), -1)
        good = ((left >= 0)[:, :, None] & (right >= 0)[:, None, :]).reshape(len(fp), -1)
        row, column = np.nonzero(good)
        keys.append(number << 48 | both[row, column])
        rows.append(row)

    family(1, near_a, near_b, 12)
    family(2, b[:, None], near_c, 12)
    family(3, near_b, c[:, None], 18)
    family(4, a[:, None], near_c, 12)
    family(5, near_a, c[:, None], 18)
    return np.concatenate(keys), np.concatenate(rows)


def _keyed(distinct: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            key, row = golay_keys(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], names=["key", "fp"])

    return distinct.select("fp").mapInArrow(run, "key long, fp long")


def differing(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints, each a row of unsigned 64-bit words."""
    count = np.bitwise_count(left[..., 0] ^ right[..., 0])
    for k in range(1, left.shape[-1]):
        count = count + np.bitwise_count(left[..., k] ^ right[..., k])
    return count


def group_links(nodes: np.ndarray, fp: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links (node, centre it is reached from) that connect exactly what all links of at most `bits` differing bits connect:
    one for each node reached. A search in breadth; what was reached is compared with the rest only, so a dense group costs little."""
    left, links = np.arange(len(nodes)), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            centre = queue.pop()
            near = differing(fp[left], fp[centre]) <= bits
            if near.any():
                reached = left[near]
                links += [(nodes[x], nodes[centre]) for x in reached]
                queue += list(reached)
                left = left[~near]
    return links


def _link_runs(bits: int):
    """mapInArrow function over rows (key, lo, hi, node and, if it is not the node, the fingerprint's words) sorted by key,
    lo, hi: links of each run."""

    def links_of(keys: np.ndarray, nodes: np.ndarray, fp: np.ndarray) -> np.ndarray:
        """keys: the runs' numbers, ascending."""
        cuts = np.flatnonzero(np.diff(keys)) + 1
        starts = np.concatenate([[0], cuts])
        sizes = np.diff(np.concatenate([starts, [len(keys)]]))
        found = []
        small = np.repeat(sizes <= 3, sizes)
        for lag in (1, 2):
            at = np.flatnonzero((keys[lag:] == keys[:-lag]) & small[lag:])
            at = at[differing(fp[at], fp[at + lag]) <= bits]
            found.append(np.stack([nodes[at + lag], nodes[at]], axis=1))
        for s, n in zip(starts[sizes > 3].tolist(), sizes[sizes > 3].tolist()):
            if more := group_links(nodes[s : s + n], fp[s : s + n], bits):
                found.append(np.array(more, np.int64).reshape(-1, 2))
        return np.concatenate(found) if found else np.zeros((0, 2), np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the run that is not over yet
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            if not len(rows):
                continue
            changes = np.flatnonzero((np.diff(rows[:, :3], axis=0) != 0).any(axis=1)) + 1
            if held and (held[-1][-1, :3] == rows[0, :3]).all() and not len(changes):
                held.append(rows)
                continue
            if held and (held[-1][-1, :3] == rows[0, :3]).all():
                done, rows = [*held, rows[: changes[-1]]], rows[changes[-1] :]
            else:
                cut = changes[-1] if len(changes) else 0
                done, rows = [*held, rows[:cut]], rows[cut:]
            held = [rows]
            yield from out(np.concatenate(done))
        if held:
            yield from out(np.concatenate(held))

    def out(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(rows) > 1:
            number = np.concatenate([[0], np.cumsum((np.diff(rows[:, :3], axis=0) != 0).any(axis=1))])
            fp = np.ascontiguousarray(rows[:, 4:] if rows.shape[1] > 4 else rows[:, 3:]).view(np.uint64)
            links = np.unique(links_of(number, np.ascontiguousarray(rows[:, 3]), fp), axis=0)
            if len(links):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(links[:, 0])), pa.array(np.ascontiguousarray(links[:, 1]))], names=["u", "v"])

    return run


def _stars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (u, v: the centres it is reached from, ascending) to links of u with the first of them, and of the first with the
    others: they connect the same, and the same few centres meet again and again."""
    for batch in batches:
        centres = batch.column(1)
        flat, ends = centres.flatten().to_numpy(zero_copy_only=False), np.cumsum(centres.value_lengths().to_numpy(zero_copy_only=False))
        sizes = np.diff(ends, prepend=0)
        if len(sizes):
            first = flat[ends - sizes]
            between = np.unique(np.stack([flat, np.repeat(first, sizes)], axis=1), axis=0)
            links = np.concatenate([np.stack([batch.column(0).to_numpy(zero_copy_only=False), first], axis=1), between[between[:, 0] != between[:, 1]]])
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(links[:, 0])), pa.array(np.ascontiguousarray(links[:, 1]))], names=["u", "v"])


def linked(keyed: DataFrame, bits: int, block: int = BLOCK) -> DataFrame:
    """Links (u, v) between nodes that share a key and differ in at most `bits` bits, or others that connect the same.
    keyed: key, node and, if it is not the node itself, the fingerprint's 64-bit words.

    A key with more than `block` nodes is dealt out as pairs of blocks, each a task of two blocks at most; so no task
    holds an unbounded group, and every pair still meets. Which keys are large is told by one node in SKEW_SAMPLE, which
    decides about the dealing only. A node is reached once for each of its keys, so its list of centres is bounded.
    """
    node, *fp = keyed.columns[1:]
    rate = SKEW_SAMPLE if block >= BLOCK else 1
    counted = keyed.where(F.pmod(F.xxhash64(node), F.lit(rate)) == 0).groupBy("key").agg((rate * F.count("*")).alias("count"))
    hot, hot_path = materialize(counted.where(F.col("count") > (block if rate == 1 else block // 2)), "hot-keys")
    n_hot = hot.count()
    if n_hot:
        keyed = keyed.join(maybe_broadcast(hot.select("key", F.ceil(F.col("count") / block).alias("blocks")), n_hot), "key", "left")
        own = F.pmod(F.xxhash64(node), F.col("blocks"))
        pairs = F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi")))).otherwise(
            F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.struct(F.least(own, j).alias("lo"), F.greatest(own, j).alias("hi")))
        )
        keyed = keyed.select("key", node, *fp, F.explode(pairs).alias("p")).select("key", "p.lo", "p.hi", node, *fp)
    else:
        drop_path(keyed.sparkSession, hot_path)
        zero = F.lit(0).cast("long")
        keyed = keyed.select("key", zero.alias("lo"), zero.alias("hi"), node, *fp)
    by = ["key"] if not n_hot else ["key", "lo", "hi"]
    return keyed.repartition(*by).sortWithinPartitions("key", "lo", "hi", node).mapInArrow(_link_runs(bits), EDGES).groupBy("u").agg(F.array_sort(F.collect_set("v")).alias("v")).mapInArrow(_stars, EDGES).distinct()


def golay_links(distinct: DataFrame, bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Links (u, v) between distinct fingerprints (fp) whose components are those of all links of at most `bits`
    (4 or fewer) differing bits."""
    if not 0 <= bits <= MAX_BITS:
        raise ValueError(f"the keys find at most {MAX_BITS} differing bits")
    return linked(_keyed(distinct), bits, block)


def near_duplicates(docs: DataFrame, size: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp, component_id (the least doc_id reachable by links) of docs (doc_id, text), a row for each row.

    Copies share a fingerprint and are linked through it, so only distinct fingerprints are searched. Rows without
    words have fingerprint 0 and are linked like any other. A null doc_id keeps its row; a component of such rows only
    has a null component_id.
    """
    spark = docs.sparkSession
    marked, _ = materialize(fingerprints(docs, size), "fingerprints")
    distinct, distinct_path = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    small_conf = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    roots, _ = components(golay_links(distinct, bits))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", small_conf)
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def op3_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of documents; see near_duplicates for nulls, blanks and repeats."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")
