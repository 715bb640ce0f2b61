"""Phrase collocations: n-grams of deduplicated pieces, counted out of core in duckdb for each hash bucket.

Equal pieces of text are merged into one with its multiplicity before anything is counted. A task counts the n-grams of its
pieces, weighted, and Spark deals these counts out by hash; the task of a bucket adds them up in duckdb, which spills beyond
its memory. Longer n-grams are counted after shorter ones and only where both of their halves are frequent, which a Bloom
filter of fixed size tells: whatever it lets through is counted exactly, and a phrase is never more frequent than its parts.
A candidate asks for the counts of its parts by lookup requests, shuffled to where these counts are.
"""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import UPPER, arrow_batches, drop_path, materialize, scratch_path, shared_root, table, utf8, with_schema

LEAST, LONGEST, TOP = 10, 3, 2000
#: Words that a task counts at once, and bits of the filter of frequent n-grams (16 MB), with this many set for each.
FLUSH_WORDS, FILTER_BITS, FILTER_HASHES = 1_500_000, 1 << 27, 4
#: Memory of one bucket's duckdb; beyond it spills.
BUCKET_MEMORY = "256MB"
#: Parts that a language's candidates are ranked in before they meet.
RANK_PARTS = 64
#: Exact: up to 10^16 occurrences the products stay within 38 digits.
SCORE = "(a_ * a_ * 1000000bd) div (l_ * r_)"
COUNTS = "lang string, size int, phrase string, n long"
#: A-Z to a-z, tabs to blanks and the marks that end a piece to line ends.
_FOLD = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if chr(b) in UPPER else b for b in range(256))


def pieces(docs: DataFrame) -> DataFrame:
    """Distinct pieces (lang, piece, n): words joined by single blanks, with how often they occur. Pieces of one document
    are merged before the shuffle, hot ones again by Spark; a null lang is `und`, a null text empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, bytes], int] = {}
            for lang, text in zip(batch.column(0).to_pylist(), utf8(batch, "text")):
                for piece in text.translate(_FOLD).split(b"\n"):
                    words = [w for w in piece.split(b" ") if w]
                    if words:
                        key = (lang, b" ".join(words))
                        found[key] = found.get(key, 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "piece", "n"]
            )

    plain = with_schema(docs, "lang", "text").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    return plain.mapInArrow(run, "lang string, piece string, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


class FrequentFilter:
    """A Bloom filter of fixed size over (lang, phrase) hashes."""

    def __init__(self, bits: int = FILTER_BITS, data: np.ndarray | None = None):
        self.bits = bits
        self.data = np.zeros(bits // 8, np.uint8) if data is None else data

    def places(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        step = (hashes >> np.uint64(32)) | np.uint64(1)
        for k in range(FILTER_HASHES):
            yield (hashes + np.uint64(k) * step) % np.uint64(self.bits)

    def add(self, hashes: np.ndarray) -> None:
        for at in self.places(hashes):
            np.bitwise_or.at(self.data, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in self.places(hashes):
            out &= (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def _hash(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh32_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _joined(hashes: list[np.ndarray]) -> np.ndarray:
    """One hash for the hashes of a phrase's words, in order."""
    out = hashes[0]
    for h in hashes[1:]:
        out = (out * np.uint64(0x9E3779B97F4A7C15) ^ h) * np.uint64(0xC2B2AE3D27D4EB4F)
        out ^= out >> np.uint64(29)
    return out


def _filter_of(counts: DataFrame, size: int) -> FrequentFilter:
    """The filter of the phrases of `size` words of counts, made in tasks and put together by the driver from a few."""
    bits = FILTER_BITS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = FrequentFilter(bits)
        for batch in batches:
            by_lang: dict[str, list[list[bytes]]] = {}
            for lang, phrase in zip(batch.column(0).to_pylist(), utf8(batch, "phrase")):
                by_lang.setdefault(lang, []).append(phrase.split(b" "))
            for lang, found in by_lang.items():
                made.add(_joined([_hash(lang, list(words)) for words in zip(*found)]))
        at = np.flatnonzero(made.data)
        yield pa.RecordBatch.from_arrays([pa.array([at.astype("<u4").tobytes()]), pa.array([made.data[at].tobytes()])], names=["at", "bits"])

    whole = FrequentFilter(bits)
    for row in counts.where(F.col("size") == size).select("lang", "phrase").coalesce(8).mapInArrow(run, "at binary, bits binary").collect():
        whole.data[np.frombuffer(row["at"], "<u4")] |= np.frombuffer(row["bits"], np.uint8)
    return whole


def _task_counts(distinct: DataFrame, size: int, screen: FrequentFilter | None) -> DataFrame:
    """(lang, phrase, n) of the n-grams of `size` words, counted in each task; a phrase goes on only if both halves pass the
    screen. Words become numbers, so that counting sorts integers."""
    shared = distinct.sparkSession.sparkContext.broadcast(screen.data) if screen is not None else None
    bits = FILTER_BITS

    def count(lang: str, texts: pa.Array, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
        split = pc.split_pattern(texts, " ")
        lengths = pc.list_value_length(split).to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        ids, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        start = np.flatnonzero(np.arange(len(ids)) < np.repeat(np.cumsum(lengths) - size + 1, lengths))  # where a phrase can start
        weight = np.repeat(weights, lengths)[start]
        if shared is not None and len(start):
            hashes, known = _hash(lang, words.cast(pa.binary()).to_pylist()), FrequentFilter(bits, shared.value)
            at = [hashes[ids[start + k]] for k in range(size)]
            keep = known.has(_joined(at[:-1])) & known.has(_joined(at[1:]))
            start, weight = start[keep], weight[keep]
        if not len(start):
            return
        columns = [ids[start + k] for k in range(size)]
        base, code = len(words), columns[0]
        for c in columns[1:]:
            if base >= 1 << 40:  # no room: number the phrases so far
                code = np.unique(code, return_inverse=True)[1]
                base = len(code)
            code, base = code * len(words) + c, base * len(words)
        order = np.argsort(code)
        first = np.flatnonzero(np.diff(code[order], prepend=-1))
        sums, rows = np.add.reduceat(weight[order], first), order[first]
        for at in range(0, len(rows), 1 << 16):
            part = rows[at : at + (1 << 16)]
            made = [words.take(pa.array(c[part])) for c in columns]
            text = pc.binary_join_element_wise(*made, " ") if size > 1 else made[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), text, pa.array(sums[at : at + (1 << 16)])], names=["lang", "phrase", "n"])

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        for lang in pc.unique(rows["lang"]).to_pylist():
            own = rows.filter(pc.equal(rows["lang"], lang))
            yield from count(lang, pa.concat_arrays(own["piece"].chunks), own["n"].to_numpy())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows + (pc.sum(pc.count_substring(batch.column(1), " ")).as_py() or 0)
            if n >= FLUSH_WORDS:
                yield from flush(held)
                held, n = [], 0
        if held:
            yield from flush(held)

    return distinct.select("lang", "piece", "n").mapInArrow(run, "lang string, phrase string, n long")


def _spill_folder(root: str) -> str:
    """Where a bucket may spill: the shared folder if duckdb can open it, else a folder of the task's own."""
    path = root.removeprefix("file://").removeprefix("file:")
    if path.startswith("/") and "://" not in path:
        Path(path, "corpusloom").mkdir(parents=True, exist_ok=True)
        return tempfile.mkdtemp(prefix="spill-", dir=f"{path}/corpusloom")
    return tempfile.mkdtemp(prefix="spill-")


def bucket_counts(parts: DataFrame, size: int, least: int = LEAST) -> DataFrame:
    """COUNTS of partial counts (lang, phrase, n): phrases with `least` occurrences or more; and for each bucket and lang the
    sum of all, as size 0 and an empty phrase. Each hash bucket is one task with its own duckdb, which takes the rows as a
    stream and spills, so that a bucket may be larger than memory."""
    root = shared_root(parts.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        folder = _spill_folder(root)
        try:
            db = duckdb.connect(config={"threads": 1, "memory_limit": BUCKET_MEMORY, "temp_directory": folder, "preserve_insertion_order": False})
            schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])
            rows = pa.RecordBatchReader.from_batches(schema, (b.cast(schema) for b in batches))  # noqa: F841, read by name
            db.execute("CREATE TEMP TABLE counted AS SELECT lang, phrase, CAST(sum(n) AS BIGINT) AS n FROM rows GROUP BY lang, phrase")
            query = f"SELECT lang, {size}::INTEGER AS size, phrase, n FROM counted WHERE n >= {least} UNION ALL SELECT lang, 0, '', CAST(sum(n) AS BIGINT) FROM counted GROUP BY lang"
            for batch in db.sql(query).to_arrow_reader(1 << 16):
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1).cast(pa.int32()), batch.column(2).cast(pa.string()), batch.column(3).cast(pa.int64())], names=["lang", "size", "phrase", "n"])
            db.close()
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    return parts.repartition(F.xxhash64("lang", "phrase")).mapInArrow(run, COUNTS)


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(COUNTS of the phrases of 1 to `longest` words with `least` occurrences or more, n words by lang)."""
    spark = docs.sparkSession
    with arrow_batches(spark):
        distinct, distinct_path = materialize(pieces(docs), "pieces")
        path, screen = scratch_path(spark, "phrases"), None
        for size in range(1, longest + 1):
            bucket_counts(_task_counts(distinct, size, screen), size, least).write.mode("append").parquet(path)
            counts = spark.read.schema(COUNTS).parquet(path)
            if size == 1:  # before longer phrases add rows of size 0
                words, _ = materialize(counts.where("size = 0").groupBy("lang").agg(F.sum("n").alias("n")), "words")
            if size < longest:
                screen = _filter_of(counts, size)
    drop_path(spark, distinct_path)
    return counts.where("size > 0"), words


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The `top` phrases of each lang by score: lang, rank, phrase, a, l, r, n, score.

    Texts that are null or empty have no words, a null lang is `und`, repeated rows count each, ties are ordered by a and
    the phrase's bytes, an empty table gives no row; other columns are left out. A part that many candidates ask for is the
    split side of a join.
    """
    counts, totals = frequent_phrases(docs, longest, least)
    phrases = counts.where("size > 1").withColumn("w", F.split("phrase", " "))
    part = lambda k, n: F.array_join(F.slice("w", k, n), " ")
    cuts = F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.array(
        F.struct(k.alias("k"), F.lit(True).alias("first"), F.array_join(F.slice("w", F.lit(1), k), " ").alias("part")),
        F.struct(k.alias("k"), F.lit(False).alias("first"), F.array_join(F.slice("w", k + 1, F.col("size") - k), " ").alias("part")),
    ))))
    requests = phrases.select("lang", "phrase", F.col("n").alias("a"), cuts.alias("x")).select("lang", "phrase", "a", "x.*")
    answers = requests.join(counts.select("lang", F.col("phrase").alias("part"), F.col("n").alias("found")), ["lang", "part"])
    one = answers.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("first"), F.col("found"))).alias("l"), F.max(F.when(~F.col("first"), F.col("found"))).alias("r"))
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    scored = one.withColumns({"a_": wide("a"), "l_": wide("l"), "r_": wide("r")}).withColumn("score", F.expr(SCORE))
    cut = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.score", "c.l", "c.r")
    # every shorter phrase inside a longer one, with the longer one's count
    inside = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda k: part(k, n)))))
    covers = phrases.where("size > 2").select("lang", inside.alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = cut.join(covers, ["lang", "phrase"], "left").where("longer IS NULL OR 100 * longer < 50 * a")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    near = kept.withColumn("r0", F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))).orderBy(*order))).where(F.col("r0") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each lang of documents; nulls, repeats, ties and empty tables as in collocations."""
    return collocations(table(spark, sf_dir, "documents"))


SQL = {
    "op12_phrase_collocations": r"""WITH pieces AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
f1 AS (SELECT lang, phrase, count(*) AS f FROM (SELECT lang, unnest(w) AS phrase FROM pieces) GROUP BY ALL),
f2 AS (SELECT lang, phrase, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS phrase FROM pieces WHERE len(w) > 1) GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, phrase, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS phrase FROM pieces WHERE len(w) > 2) GROUP BY ALL HAVING count(*) >= 10),
s2 AS (SELECT *, split_part(phrase, ' ', 1) AS w1, split_part(phrase, ' ', 2) AS w2 FROM f2),
s3 AS (SELECT *, split_part(phrase, ' ', 1) AS w1, split_part(phrase, ' ', 2) AS w2, split_part(phrase, ' ', 3) AS w3 FROM f3),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, 1 AS k, x.f AS l, y.f AS r FROM s2 c JOIN f1 x ON x.lang = c.lang AND x.phrase = w1 JOIN f1 y ON y.lang = c.lang AND y.phrase = w2
  UNION ALL SELECT c.lang, c.phrase, c.f, 1, x.f, y.f FROM s3 c JOIN f1 x ON x.lang = c.lang AND x.phrase = w1 JOIN f2 y ON y.lang = c.lang AND y.phrase = w2 || ' ' || w3
  UNION ALL SELECT c.lang, c.phrase, c.f, 2, x.f, y.f FROM s3 c JOIN f2 x ON x.lang = c.lang AND x.phrase = w1 || ' ' || w2 JOIN f1 y ON y.lang = c.lang AND y.phrase = w3),
scored AS (SELECT *, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, w1 || ' ' || w2 AS phrase, f FROM s3 UNION ALL SELECT lang, w2 || ' ' || w3, f FROM s3) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.f IS NULL OR 100 * o.f < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, rank, phrase, a, l, r.r AS r, n, score FROM ranked r JOIN total t ON t.lang = r.lang WHERE rank <= 2000"""
}
