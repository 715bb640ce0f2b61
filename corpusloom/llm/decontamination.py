"""Benchmark decontamination by spaced-seed hashing.

Fixed masks pick some of up to eleven neighbouring words and ignore the rest, so a window with substituted words still
has an equal hash under some mask. Hashes of test items and of training texts are joined; around each hit the texts are
compared word by word on the diagonal. What counts as an overlap follows from the item's words:

- 13 or more: 13 words or more, four in five equal; the masks find every 13-word window with at most two substitutions
- 7 to 12: four in five of the item's words, 7 at least, with one substitution; the short mask finds all of them
- 4 to 6: the whole item as it is; one mask of that length
- under 4: too short as evidence, not searched
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize, maybe_broadcast, small_batches, table, utf8, with_schema
from .words import WordHashes, split_words

#: 1: the word counts; 0: it is ignored. For items of MIN_WORDS or more, of SHORT to MIN_WORDS - 1, and for each length below.
MASKS = ("1110111", "11010001011", "11011010001")
SHORT_MASK = "11011"
#: An overlap has so many words, or four in five words of a shorter item but SHORT at least; below SHORT the whole item.
MIN_WORDS, SHORT, LEAST_WORDS = 13, 7, 4
#: Words kept on each side of a hit for the comparison.
REACH = 256
#: Share of equal words in an overlap.
SIMILARITY = 0.8
#: Bits of the screening filter for each test hash, and the most it has: a worker holds 32 MB.
FILTER_BITS, MOST_BITS = 32, 1 << 28
PROBES = 3
SPANS = "doc_id long, item_id long, doc_start long, item_start long, n_words long, n_equal long"

#: All masks by number, and the numbers an item of a length has.
_ALL = (*MASKS, SHORT_MASK, *("1" * n for n in range(LEAST_WORDS, SHORT)))
_offsets = [np.flatnonzero([c == "1" for c in m]) for m in _ALL]
_factors = np.random.default_rng(13).integers(1 << 62, size=(len(_ALL), 16), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def masks_of(n_words: int) -> list[int]:
    """Numbers of the masks that find overlaps with an item of so many words."""
    if n_words >= MIN_WORDS:
        return list(range(len(MASKS)))
    if n_words >= SHORT:
        return [len(MASKS)]
    return [len(MASKS) + 1 + n_words - LEAST_WORDS] if n_words >= LEAST_WORDS else []


def seed_hashes(words: np.ndarray, masks: list[int]) -> list[np.ndarray]:
    """For each of the masks the hashes at all its places in an array of word hashes."""
    out = []
    for k in masks:
        n = len(words) - len(_ALL[k]) + 1
        if n <= 0:
            out.append(np.zeros(0, np.uint64))
            continue
        h = np.full(n, np.uint64(k + 1))
        for factor, i in zip(_factors[k], _offsets[k]):
            h += words[i : i + n] * factor
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        out.append(h)
    return out


def item_words(items: DataFrame, key: str = "item_id") -> DataFrame:
    """(item_id, words: word hashes) of items (item_id, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = WordHashes()
        for batch in batches:
            words = [hashed(split_words(t)).view(np.int64) for t in utf8(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.int64()))], names=["item_id", "words"])

    return with_schema(items, key, "text").mapInArrow(run, "item_id long, words array<long>")


def item_seeds(words: DataFrame) -> DataFrame:
    """(h, item_id, at, mask) of (item_id, words)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                masks = masks_of(len(own))
                for mask, h in zip(masks, seed_hashes(np.array(own, np.int64).view(np.uint64), masks)):
                    columns = [pa.array(h.view(np.int64)), pa.array([item] * len(h), pa.int64()), pa.array(np.arange(len(h), dtype=np.int64)), pa.array(np.full(len(h), mask, np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=["h", "item_id", "at", "mask"])

    return words.mapInArrow(run, "h long, item_id long, at long, mask int").distinct()


def _probes(h: np.ndarray, bits: int, probe: int) -> np.ndarray:
    return (h + np.uint64(probe) * (h >> np.uint64(32) | np.uint64(1)) & np.uint64(bits - 1)).astype(np.int64)


def screening_filter(seeds: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter, eight bits a byte, over the hashes of seeds; each of at most 8 tasks makes one and the driver ors
    them. It only screens: hits are joined exactly, so its bounded size never costs a result."""
    bits = 1 << 16
    while bits < min(n * FILTER_BITS, MOST_BITS):
        bits *= 2

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = np.zeros(bits, bool)
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for probe in range(PROBES):
                made[_probes(h, bits, probe)] = True
        if made.any():
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(made, bitorder="little").tobytes()], pa.binary())], names=["bits"])

    made = np.zeros(bits // 8, np.uint8)
    for row in seeds.select("h").coalesce(8).mapInArrow(run, "bits binary").collect():
        made |= np.frombuffer(row[0], np.uint8)
    return made


def candidate_regions(docs: DataFrame, screen: np.ndarray, masks: list[int]) -> DataFrame:
    """Stretches of docs (doc_id, text) around places that pass the screen: (doc_id, text_hash, start, words, hits: places
    in the stretch, h: their hashes, region: a number for the stretch)."""
    shared = docs.sparkSession.sparkContext.broadcast(screen)
    bits = 8 * len(screen)
    names = ["doc_id", "text_hash", "start", "words", "hits", "h"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, table_ = WordHashes(), shared.value
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for doc_id, text_hash, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch, "text")):
                words = hashed(split_words(text))
                places, hashes = [], []
                for h in seed_hashes(words, masks):
                    at = np.arange(len(h))
                    for probe in range(PROBES):
                        if len(at):
                            bit = _probes(h[at] if probe else h, bits, probe)
                            at = at[table_[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 > 0]
                    places.append(at)
                    hashes.append(h[at])
                at, h = np.concatenate(places), np.concatenate(hashes)
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, h = at[order], h[order]
                cuts = np.flatnonzero(np.diff(at) > 2 * REACH) + 1
                for own, hs in zip(np.split(at, cuts), np.split(h, cuts)):
                    start = max(0, int(own[0]) - REACH)
                    for column, value in zip(rows, (doc_id, text_hash, start, words[start : int(own[-1]) + REACH + 16].view(np.int64), own - start, hs.view(np.int64))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=names)

    keyed = with_schema(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    found = keyed.mapInArrow(run, "doc_id long, text_hash long, start long, words array<long>, hits array<long>, h array<long>")
    return found.withColumn("region", F.xxhash64("doc_id", "text_hash", "start", "words"))


def best_overlap(doc: np.ndarray, item: np.ndarray, diagonal: int, similarity: float = SIMILARITY) -> tuple[int, int, int]:
    """Start in the item, words and equal words of the longest stretch on a diagonal (document place - item place) with
    this share of equal words or more, without unequal words at its ends."""
    low, high = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    if high <= low:
        return 0, 0, 0
    same = doc[low + diagonal : high + diagonal] == item[low:high]
    if not same.any():
        return 0, 0, 0
    share = round(similarity * 1000)
    total = np.concatenate([[0], np.cumsum(np.where(same, 1000 - share, -share))])
    starts = np.flatnonzero(same)
    ends = starts + 1
    ahead = np.maximum.accumulate(total[ends][::-1])[::-1]  # falls, and where it last is a total or more, the total itself is
    last = np.searchsorted(-ahead, -total[starts], side="right") - 1
    best = int(np.argmax(ends[last] - starts))
    start, end = int(starts[best]), int(ends[last[best]])
    return low + start, end - start, int(same[start:end].sum())


def short_overlap(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """As best_overlap for an item under MIN_WORDS: the longest stretch with at most one unequal word, not at its ends."""
    low, high = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    same = doc[low + diagonal : high + diagonal] == item[low:high] if high > low else np.zeros(0, bool)
    gaps = [-1, *np.flatnonzero(~same).tolist(), len(same)]  # a stretch lies between two of them, with one inside
    best = (0, 0, 0)
    for before, gap, after in zip(gaps, gaps[1:], [*gaps[2:], gaps[-1]]):
        start, end = before + 1 if before + 1 < gap else gap + 1, after if gap + 1 < after else gap
        if end - start > best[1]:
            best = (low + start, end - start, int(same[start:end].sum()))
    return best


def needed_words(item_length: int) -> int:
    """Words an overlap must have."""
    return MIN_WORDS if item_length >= MIN_WORDS else max(SHORT, -(-item_length * 4 // 5)) if item_length >= SHORT else item_length


def overlap(doc: np.ndarray, item: np.ndarray, diagonals: list[int]) -> tuple[int, int, int, int] | None:
    """(place in doc, place in item, words, equal words) of the overlap that counts with the most equal words, of several
    the longest, then the first in doc, then in item."""
    best = None
    for diagonal in sorted(diagonals):
        at, n, equal = best_overlap(doc, item, diagonal) if len(item) >= MIN_WORDS else short_overlap(doc, item, diagonal)
        if n and n >= needed_words(len(item)) and (len(item) >= SHORT or equal == n):
            key = (equal, n, -(at + diagonal), -at)
            best = max(best, key) if best else key
    return (-best[2], -best[3], best[1], best[0]) if best else None


def _spans(docs: DataFrame, items: DataFrame) -> DataFrame:
    """SPANS with text_hash: the best overlap of each distinct (doc_id, text) and item."""
    spark = docs.sparkSession
    small_batches(spark)
    words, _ = materialize(item_words(items).distinct(), "item-words")
    seeds, _ = materialize(item_seeds(words), "item-seeds")
    masks = sorted(r[0] for r in seeds.select("mask").distinct().collect())
    n_seeds, n_items = seeds.count(), words.count()
    if not n_seeds:
        return spark.createDataFrame([], "doc_id long, text_hash long, " + SPANS.split(", ", 1)[1])
    screen = screening_filter(seeds, n_seeds)
    regions, _ = materialize(candidate_regions(docs, screen, masks), "regions")
    hits = regions.select("region", F.explode(F.arrays_zip("hits", "h")).alias("x")).select("region", F.col("x.hits").alias("place"), F.col("x.h").alias("h"))
    met = hits.join(maybe_broadcast(seeds.select("h", "item_id", "at"), n_seeds), "h").select("region", "item_id", (F.col("place") - F.col("at")).alias("diagonal"))
    pairs = met.groupBy("region", "item_id").agg(F.collect_set("diagonal").alias("diagonals"))
    pairs = pairs.join(regions.select("region", "doc_id", "text_hash", "start", F.col("words").alias("doc")).dropDuplicates(["region"]), "region")
    pairs = pairs.join(maybe_broadcast(words.select("item_id", F.col("words").alias("item")), n_items), "item_id")

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                found = overlap(np.array(r["doc"], np.int64), np.array(r["item"], np.int64), r["diagonals"])
                if found:
                    rows.append((r["doc_id"], r["text_hash"], r["item_id"], r["start"] + found[0], *found[1:]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 7)], names=["doc_id", "text_hash", "item_id", "doc_start", "item_start", "n_words", "n_equal"])

    spans = pairs.select("doc_id", "text_hash", "start", "doc", "diagonals", "item_id", "item").mapInArrow(verify, "doc_id long, text_hash long, " + SPANS.split(", ", 1)[1])
    best = F.max_by(F.struct("doc_start", "item_start", "n_words", "n_equal"), F.struct("n_equal", "n_words", -F.col("doc_start"), -F.col("item_start")))
    return spans.groupBy("doc_id", "text_hash", "item_id").agg(best.alias("x")).select("doc_id", "text_hash", "item_id", "x.*")


def contaminated_spans(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The best verified overlap of each document and item: SPANS.

    docs (doc_id, text), items (item_id, text). Repeated rows give one result, different texts under one id or without one a
    result each; null texts, empty tables and items of under LEAST_WORDS words or without an id none. A passage that many
    documents share costs a row for each of them, never a pair of documents.
    """
    return _spans(docs, items).drop("text_hash")


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows that share a verified overlap with an item. A row is known by doc_id and text: others under
    its id, or also without one, stay; copies of it go with it."""
    id_, hash_, own = (free_name(docs, n) for n in ("found_id", "found_hash", "own_hash"))
    found, _ = materialize(_spans(docs, items).select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).distinct(), "contaminated")
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(hash_))
    return docs.withColumn(own, F.xxhash64("text")).join(maybe_broadcast(found, found.count()), same, "left_anti").drop(own)


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    """Contaminated documents with the items and places: one row for each document and item. Null and empty texts share
    nothing; see contaminated_spans for repeats and null ids."""
    return contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
