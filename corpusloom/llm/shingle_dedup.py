"""SimHash near-duplicates at a shingle similarity: Golay-code fuzzy hashing for many differing bits, then exact sets.

At a Jaccard similarity of 0.8 the SimHash sums of two shingle sets correlate by 0.89, and 15 % of the bits differ, more
than the hard decoding of `simhash` bridges. So the sums themselves are decoded: each of SEGMENTS segments of 23 sums to the
NEAR codewords of the binary Golay code [23,12,7] that fit them best, which the little sums, whose bits flip, hardly move.
The errors of two texts are rarely spread over all segments (pigeonhole): a key is the indices of two segments, for each
two of them. Texts that share a key meet and are linked if their fingerprints differ in at most MOST_BITS of 128 bits;
linked texts form clusters, and within a cluster the exact sets decide. Of pairs at 0.8 exactly the keys miss 2 % (at
0.85 0.3 %, at 0.9 0.1 %), if nothing else links them. No pair of a group is emitted.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import drop_path, materialize, maybe_broadcast, small_batches, utf8
from .components import components
from .simhash import EDGES, GOLAY, differing, linked
from .words import WordHashes

SHINGLE = 5
#: Least Jaccard similarity of near duplicates, as a fraction.
SIMILARITY = (4, 5)
SEGMENTS, NEAR = 5, 3
#: Of 128 bits 19 differ at the least similarity, with a deviation of 4, and 64 between strangers, with a deviation of 6.
MOST_BITS = 34
SEED = 42
#: Rows and bytes of text of one cluster that a task verifies at most; larger clusters are dealt out as pairs of blocks.
BLOCK, BLOCK_BYTES = 4000, 16 << 20
#: Shingles hashed at a time.
CHUNK = 1 << 12
_PRIME = np.uint64(0x9E3779B97F4A7C15)
KEYS = len(list(combinations(range(SEGMENTS), 2))) * NEAR**2


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def shingle_set(text: bytes, hashed: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Ascending distinct hashes of the shingles of UTF-8 text; a shorter text is one shingle, a blank one has none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = hashed(words)
    size = min(size, len(h))
    n = len(h) - size + 1
    made = np.zeros(n, np.uint64)
    for k in range(size):
        made = made * _PRIME + h[k : k + n]
    return np.unique(_mixed(made))


def bit_sums(shingles: np.ndarray) -> np.ndarray:
    """For each of 128 bits how many more shingles of a set have it than have it not; the fingerprint has it if any."""
    sums = np.zeros(128, np.int64)
    for at in range(0, len(shingles), CHUNK):
        h = shingles[at : at + CHUNK]
        bits = np.unpackbits(np.stack([h, _mixed(h ^ _PRIME)], axis=1).view(np.uint8), axis=1, bitorder="little")
        for low in range(0, len(bits), 255):
            sums += bits[low : low + 255].sum(axis=0, dtype=np.uint8)
    return (2 * sums - len(shingles)).astype(np.float32)


_half: list[np.ndarray] = []


def soft_indices(sums: np.ndarray) -> np.ndarray:
    """For rows of 23 sums the numbers of the NEAR codewords with the largest sum of agreeing less disagreeing bits. With a
    codeword its complement is one, so half of them are computed: 2 * number of the half's, 1 more for the complement."""
    if not _half:
        words = np.zeros(2048, np.int64)
        for bit in range(11):  # those of even weight; the others are their complements
            words ^= np.where(np.arange(2048) >> bit & 1, (GOLAY ^ GOLAY << 1) << bit, 0)
        _half.append(((words >> np.arange(23)[:, None] & 1) * 2 - 1).astype(np.float32))
    fit = sums @ _half[0]
    best = np.argpartition(-np.abs(fit), NEAR, axis=1)[:, :NEAR]
    return 2 * best + (np.take_along_axis(fit, best, axis=1) < 0)


def golay_keys(sums: np.ndarray) -> np.ndarray:
    """The KEYS keys of rows of bit sums: the number of two segments, and an index of each."""
    near = [soft_indices(sums[:, 23 * k : 23 * k + 23]) for k in range(SEGMENTS)]
    keys = [(number << 24 | near[i][:, :, None] << 12 | near[j][:, None, :]).reshape(len(sums), -1) for number, (i, j) in enumerate(combinations(range(SEGMENTS), 2))]
    return np.concatenate(keys, axis=1)


def _shingled(docs: DataFrame) -> DataFrame:
    """row (a number), doc (all columns of docs), set_id (of the shingle set), f1, f2 (the fingerprint), keys (none of a
    blank text)."""
    small_batches(docs.sparkSession)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    places = {c: i for i, c in enumerate(docs.columns)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = WordHashes()
        for batch in batches:
            texts = batch.column(0).field(places["text"]).cast(pa.binary()).to_pylist()
            found = [shingle_set(t or b"", hashed) for t in texts]
            ids = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in found], np.uint64)
            sums = np.array([bit_sums(x) for x in found], np.float32).reshape(-1, 128)
            fp = np.packbits(sums > 0, axis=1, bitorder="little").view(np.int64).reshape(-1, 2)
            keys = golay_keys(sums) if len(found) else np.zeros((0, KEYS), np.int64)
            some = np.array([len(x) > 0 for x in found], bool)
            offsets = np.concatenate([[0], np.cumsum(some * KEYS)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[some].ravel()))
            columns = [batch.column(0), pa.array(ids.view(np.int64)), pa.array(np.ascontiguousarray(fp[:, 0])), pa.array(np.ascontiguousarray(fp[:, 1])), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "set_id", "f1", "f2", "keys"])

    schema = StructType([whole.schema["doc"], *StructType.fromDDL("set_id long, f1 long, f2 long, keys array<long>").fields])
    return whole.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())


def similar(centre: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of the ascending sets, none empty, reach SIMILARITY with the centre."""
    sizes = np.array([len(x) for x in others])
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(centre, flat), len(centre) - 1)
    common = np.add.reduceat((centre[at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    return common * SIMILARITY[1] >= (sizes + len(centre) - common) * SIMILARITY[0]


def set_links(ids: list[int], sets: list[np.ndarray], fp: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect exactly what all similar pairs connect. A search in breadth; what was reached is compared with
    the rest only."""
    sizes = np.array([len(s) for s in sets])
    left, links = np.arange(len(ids)), []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            c = queue.pop()
            fits = np.minimum(sizes[left], sizes[c]) * SIMILARITY[1] >= np.maximum(sizes[left], sizes[c]) * SIMILARITY[0]
            fits &= differing(fp[left], fp[c]) <= MOST_BITS
            near = np.flatnonzero(fits)
            for part in np.array_split(near, len(near) // 256 + 1) if len(near) else []:
                fits[part] = similar(sets[c], [sets[x] for x in left[part]])
            links += [(ids[c], ids[x]) for x in left[fits]]
            queue += left[fits].tolist()
            left = left[~fits]
    return links


def _verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each run of rows (cluster, lo, hi, set_id, f1, f2, text), sorted by the first four."""
    hashed, run = WordHashes(), None
    ids, sets, fp = [], [], []

    def out() -> Iterator[pa.RecordBatch]:
        links = set_links(ids, sets, np.array(fp, np.int64).view(np.uint64)) if len(ids) > 1 else []
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], names=["u", "v"])

    for batch in batches:
        heads = list(zip(*[batch.column(i).to_pylist() for i in range(6)]))
        for (*key, own, f1, f2), text in zip(heads, utf8(batch, "text")):
            if key != run:
                yield from out()
                run, ids, sets, fp = key, [], [], []
            ids.append(own)
            sets.append(shingle_set(text, hashed))
            fp.append((f1, f2))
    yield from out()


def _dealt(clustered: DataFrame, block: int, block_bytes: int) -> DataFrame:
    """clustered (cluster, set_id, f1, f2, text) with the pair of blocks (lo, hi) that a row of a large cluster is in."""
    sizes = clustered.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    large, _ = materialize(sizes.where((F.col("n") > block) | (F.col("bytes") > block_bytes)), "large-clusters")
    n_large, zero = large.count(), F.lit(0).cast("long")
    if not n_large:
        return clustered.select("cluster", zero.alias("lo"), zero.alias("hi"), "set_id", "f1", "f2", "text")
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("bytes") / block_bytes)).alias("blocks")
    joined = clustered.join(maybe_broadcast(large.select("cluster", blocks), n_large), "cluster", "left")
    own = F.pmod(F.xxhash64("set_id"), F.col("blocks"))
    pairs = F.when(F.col("blocks").isNull(), F.array(F.struct(zero.alias("lo"), zero.alias("hi")))).otherwise(
        F.transform(F.sequence(zero, F.col("blocks") - 1), lambda j: F.struct(F.least(own, j).alias("lo"), F.greatest(own, j).alias("hi")))
    )
    return joined.select("cluster", "set_id", "f1", "f2", "text", F.explode(pairs).alias("p")).select("cluster", "p.lo", "p.hi", "set_id", "f1", "f2", "text")


def _grouped(docs: DataFrame, block: int, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """The rows of _shingled and (set_id, root): sets of one root are connected by similar pairs."""
    spark = docs.sparkSession
    marked, _ = materialize(_shingled(docs), "shingled")
    sets, sets_path = materialize(marked.groupBy("set_id").agg(F.first("f1").alias("f1"), F.first("f2").alias("f2"), F.first("keys").alias("keys")), "shingle-sets")
    small = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    nodes, _ = components(linked(sets.select(F.explode("keys").alias("key"), "set_id", "f1", "f2"), MOST_BITS))
    drop_path(spark, sets_path)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", small)
    members, _ = materialize(nodes.select(F.col("node").alias("set_id"), F.col("root").alias("cluster")).unionByName(nodes.select(F.col("root").alias("set_id"), F.col("root").alias("cluster")).distinct()), "clusters")
    found = marked.select("set_id", "f1", "f2", F.col("doc.text").alias("text")).join(maybe_broadcast(members, members.count()), "set_id")
    one = found.groupBy("cluster", "set_id").agg(F.first("f1").alias("f1"), F.first("f2").alias("f2"), F.first("text").alias("text"))
    clustered, clustered_path = materialize(one, "clustered")
    dealt = _dealt(clustered, block, block_bytes).repartition("cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi", "set_id")
    roots, _ = components(dealt.mapInArrow(_verify, EDGES).distinct())
    drop_path(spark, clustered_path)
    rooted, _ = materialize(marked.select("set_id").distinct().join(roots, F.col("set_id") == F.col("node"), "left").select("set_id", F.coalesce("root", "set_id").alias("root")), "rooted")
    return marked, rooted


def similar_documents(docs: DataFrame, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, component_id of docs (doc_id, text), a row for each row: the least doc_id reachable by pairs of similarity
    SIMILARITY or more that the keys find.

    Rows with the same set, blank ones too, are alike and searched once. A component of null doc_ids only has a null
    component_id.
    """
    marked, rooted = _grouped(docs, block, block_bytes)
    ids = marked.select("set_id", F.col("doc.doc_id").alias("doc_id"))
    least = ids.groupBy("set_id").agg(F.min("doc_id").alias("least")).join(rooted, "set_id").groupBy("root").agg(F.min("least").alias("component_id"))
    return ids.join(rooted.join(least, "root").select("set_id", "component_id"), "set_id").select("doc_id", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component of docs (doc_id, text and any others): of the rows with the least doc_id, null the last, one
    with the least hash of its text. Other rows with its doc_id, or also without one, go like any."""
    marked, rooted = _grouped(docs, BLOCK, BLOCK_BYTES)
    rank = F.struct(F.col("doc.doc_id").isNull().alias("none"), F.col("doc.doc_id").alias("doc_id"), F.xxhash64("doc.text").alias("hash"), "row")
    first = marked.groupBy("set_id").agg(F.min(rank).alias("x")).join(rooted, "set_id").groupBy("root").agg(F.min("x").alias("x"))
    kept = marked.select("row", "doc").join(first.select(F.col("x.row").alias("row")), "row", "left_semi")
    return kept.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
