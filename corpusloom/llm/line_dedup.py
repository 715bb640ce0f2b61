"""Reversible line deduplication: sharded cuckoo filters backed by exact reference-count tables.

State of a corpus: `postings` (line key, doc_id), one row for each document that holds a line; `refs` (line key,
n_docs, keeper), the exact reference counts; `filters` (shard, cuckoo filter), which hold the keys found in min_docs
documents or more. Insertions and deletions of documents change all three and undo each other. To clean documents,
their lines are screened by the filters, which lets few lines through, and what passes is joined with the exact counts.

Rows without a doc_id are no documents: they count nowhere and keep their lines. Rows that share one count once, and each
loses its lines. Null and empty texts are one empty line.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, free_name, lower_ascii, materialize, small_batches, strings, table, with_schema

MIN_CHARS = 20
MIN_DOCS = 3
#: Fixed: the white space stripped from a line's ends.
BLANKS = " \t\n\x0b\x0c\r"
SEED = 42
#: Keys of one shard's filter when a state is built; a shard that outgrows its filter is rebuilt from the counts.
SHARD_KEYS = 200_000
#: The filters are broadcast while all of them together have fewer bytes; beyond, lines are sent to their shard's filter.
FILTER_BYTES = 32 << 20
#: A shard's lines are dealt to so many copies of its filter; a key with more than one in HOT_SHARE of all references is
#: none of them: these keys, fewer than HOT_SHARE, are broadcast with their counts.
SALTS, HOT_SHARE = 8, 2000
KEY = ["k1", "k2"]


def lines_of(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(k1, k2, doc_id) of docs (doc_id, text): the 128-bit hash of every line key long enough, once a document row."""
    # the outer form, as Spark would compute the array once more to leave out empty ones
    keys = F.array_distinct(F.filter(F.transform(F.split("text", "\n", -1), lambda x: lower_ascii(F.btrim(x, F.lit(BLANKS)))), lambda x: F.length(x) >= min_chars))
    line = with_schema(docs, "doc_id", "text").select("doc_id", F.explode_outer(keys).alias("line")).where(F.col("line").isNotNull() & F.col("doc_id").isNotNull())
    return line.select(F.xxhash64("line").alias("k1"), F.xxhash64(F.concat(F.lit("\x01"), "line")).alias("k2"), "doc_id")


def line_keys(text: str, min_chars: int = MIN_CHARS) -> tuple[list[str], list[tuple[int, int] | None]]:
    """The lines of a text and their keys (None: too short), equal to those of lines_of."""
    lines = text.split("\n")
    keys: list[tuple[int, int] | None] = []
    for line in lines:
        key = line.strip(BLANKS)
        if len(key) < min_chars:
            keys.append(None)
        else:
            data = key.encode().lower()
            keys.append((_signed(xxhash.xxh64_intdigest(data, SEED)), _signed(xxhash.xxh64_intdigest(b"\x01" + data, SEED))))
    return lines, keys


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def count_references(postings: DataFrame) -> DataFrame:
    """refs (k1, k2, n_docs, keeper) of postings; rows with one doc_id count once. The first aggregation spreads a key
    by its documents, the second pre-aggregates, so a line that a third of the documents hold is no hot spot."""
    return postings.groupBy(*KEY, "doc_id").agg(F.lit(1).alias("one")).groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))


def _shard(shards: int):
    return F.pmod(F.xxhash64("k2", "k1"), F.lit(shards)).cast("int")


def build_filters(refs: DataFrame, shards: int, min_docs: int = MIN_DOCS) -> DataFrame:
    """filters (shard, n_keys, filter) over the keys of refs in min_docs documents or more."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        from .cuckoo import CuckooFilter

        made = CuckooFilter.of(pdf["k1"].to_numpy(np.int64), pdf["k2"].to_numpy(np.int64), room=len(pdf) // 4)
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "n_keys": [len(pdf)], "filter": [made.to_bytes()]})

    keys = refs.where(F.col("n_docs") >= min_docs).select(*KEY, _shard(shards).alias("shard"))
    return keys.groupBy("shard").applyInPandas(build, "shard int, n_keys long, filter binary")


def screen(lines: DataFrame, filters: dict[int, bytes], shards: int) -> DataFrame:
    """The rows of lines (k1, k2, doc_id) that the filters let through: every line at the threshold, few others."""
    shared = lines.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .cuckoo import CuckooFilter

        own = {k: CuckooFilter.from_bytes(v) for k, v in shared.value.items()}
        for batch in batches:
            low, high, shard = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
            keep = np.zeros(len(low), bool)
            for k, f in own.items():
                at = np.flatnonzero(shard == k)
                keep[at] = f.contains(low[at], high[at])
            yield batch.select(["k1", "k2", "doc_id"]).filter(pa.array(keep))

    return lines.select(*KEY, "doc_id", _shard(shards).alias("shard")).mapInArrow(run, "k1 long, k2 long, doc_id long")


def screen_by_shard(lines: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """As screen, for filters of any size: every line meets the filter of its shard, and no task holds more than one."""
    schema = "shard int, salt int, filter binary, k1 long, k2 long, doc_id long"
    salted = lines.select(_shard(shards).alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"), F.lit(None).cast("binary").alias("filter"), *KEY, "doc_id")
    none = F.lit(None).cast("long")
    copies = filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "filter", none.alias("k1"), none.alias("k2"), none.alias("doc_id"))
    dealt = salted.to(_schema(schema)).unionByName(copies.to(_schema(schema))).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("filter").isNull())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .cuckoo import CuckooFilter

        place, own = None, None
        for batch in batches:
            shard, salt = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(salt) != 0)) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard)]):
                if start == end:
                    continue
                part = batch.slice(start, end - start)
                if place != (shard[start], salt[start]):
                    place, own = (shard[start], salt[start]), None
                if part.column(2)[0].is_valid:
                    own, part = CuckooFilter.from_bytes(part.column(2)[0].as_py()), part.slice(1)
                if own is not None and len(part):
                    low, high = (part.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 4))
                    yield part.select(["k1", "k2", "doc_id"]).filter(pa.array(own.contains(low, high)))

    return dealt.mapInArrow(run, "k1 long, k2 long, doc_id long")


def _schema(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


def _decisions(docs: DataFrame, refs: DataFrame, filters: DataFrame, shards: int, min_chars: int, min_docs: int) -> DataFrame:
    """(doc_id, drop: array of k1 and k2 in turn): the line keys that each document loses."""
    lines = lines_of(docs, min_chars)
    held = refs.where(F.col("n_docs") >= min_docs).select(*KEY, "keeper")
    size = filters.agg(F.coalesce(F.sum(F.length("filter")), F.lit(0))).first()[0]
    if size <= FILTER_BYTES:
        lost = screen(lines, {r["shard"]: bytes(r["filter"]) for r in filters.collect()}, shards).join(held, KEY)
    else:
        total = refs.agg(F.sum("n_docs")).first()[0]
        hot = refs.where(F.col("n_docs") > total // HOT_SHARE).where(F.col("n_docs") >= min_docs).select(*KEY, "keeper")
        plain = screen_by_shard(lines.join(F.broadcast(hot), KEY, "left_anti"), filters, shards).join(held, KEY)
        lost = plain.unionByName(lines.join(F.broadcast(hot), KEY))
    lost = lost.where(F.col("doc_id") != F.col("keeper"))
    return lost.groupBy("doc_id").agg(F.flatten(F.collect_set(F.array("k1", "k2"))).alias("drop"))


def _rewrite(docs: DataFrame, decisions: DataFrame, min_chars: int, schema: str, emit) -> DataFrame:
    """docs with their decisions through emit(doc batch, texts, rows of (lines, keep flags))."""
    small_batches(docs.sparkSession)
    id_, drop_ = free_name(docs, "lost_id"), free_name(docs, "lost_lines")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            at = batch.schema.get_field_index(drop_)
            for text, drop in zip(strings(batch, "text"), batch.column(at).to_pylist()):
                if not drop:
                    lines = text.split("\n")
                    done.append((lines, [True] * len(lines)))
                else:
                    lost = set(zip(drop[::2], drop[1::2]))
                    lines, keys = line_keys(text, min_chars)
                    done.append((lines, [k not in lost for k in keys]))
            yield emit(batch.select([n for n in batch.schema.names if n != drop_]), done)

    named = decisions.select(F.col("doc_id").alias(id_), F.col("drop").alias(drop_))
    joined = docs.join(named, F.col("doc_id") == F.col(id_), "left").drop(id_)
    return joined.mapInArrow(run, schema)


def _kept_text(lines: list[str], keep: list[bool]) -> str:
    return "\n".join(line for line, k in zip(lines, keep) if k)


class LineDedup:
    """The state of a growing corpus under a folder: insert(), delete(), clean()."""

    def __init__(self, spark, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS):
        """A shard's filter has about shard_keys keys: shards are made by count, and anew when there are twice as many."""
        self.spark, self.min_chars, self.min_docs, self.shard_keys, self.shards = spark, min_chars, min_docs, shard_keys, 1
        self.postings = self.refs = self.filters = None
        self._paths: dict[str, str] = {}

    def _store(self, name: str, df: DataFrame) -> None:
        old = self._paths.get(name)
        made, self._paths[name] = materialize(df, f"line-{name}")
        setattr(self, name, made)
        if old:
            self._old.append(old)

    def _step(self, postings: DataFrame, changed: DataFrame) -> None:
        """Take over new postings; only the counts of changed keys (k1, k2) are made anew."""
        self._old: list[str] = []
        self._store("postings", postings)
        fresh = count_references(self.postings.join(changed, KEY, "left_semi"))
        before = self.refs
        if before is None:
            self._store("refs", fresh)
            self._rebuild()
        else:
            touched = before.join(changed, KEY, "left_semi")
            crossing, path = materialize(self._crossing(touched, fresh), "line-crossing")
            self._store("refs", before.join(changed, KEY, "left_anti").unionByName(fresh))
            keys = self.filters.agg(F.sum("n_keys")).first()[0] or 0
            if keys + (crossing.agg(F.sum("step")).first()[0] or 0) > 2 * self.shards * self.shard_keys:
                self._rebuild()
            else:
                self._store("filters", self._updated(self.filters, crossing))
            drop_path(self.spark, path)
        for path in self._old:
            drop_path(self.spark, path)

    def _rebuild(self) -> None:
        self.shards = max(1, -(-self.refs.where(F.col("n_docs") >= self.min_docs).count() // self.shard_keys))
        self._store("filters", build_filters(self.refs, self.shards, self.min_docs))

    def _crossing(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """Keys that pass the threshold upwards (step 1) or downwards (step -1)."""
        at = lambda df, name: df.select(*KEY, (F.col("n_docs") >= self.min_docs).alias(name))
        both = at(old, "was").join(at(new, "is"), KEY, "full").na.fill(False, ["was", "is"])
        return both.where("was <> is").select(*KEY, F.when(F.col("is"), 1).otherwise(-1).alias("step"), _shard(self.shards).alias("shard"))

    def _updated(self, filters: DataFrame, crossing: DataFrame) -> DataFrame:
        """A shard's filter with its crossing keys removed and added; one that is full is rebuilt twice as large from
        the exact counts."""

        def update(old: pd.DataFrame, moved: pd.DataFrame) -> pd.DataFrame:
            from .cuckoo import SLOTS, CuckooFilter

            shard = int((old if len(old) else moved)["shard"].iloc[0])
            made = CuckooFilter.from_bytes(bytes(old["filter"].iloc[0])) if len(old) else CuckooFilter(1)
            n = int(old["n_keys"].iloc[0]) if len(old) else 0
            pick = lambda step: [moved.loc[moved["step"] == step, k].to_numpy(np.int64) for k in KEY]
            gone, come = pick(-1), pick(1)
            made.remove_all(*gone)
            n += len(come[0]) - len(gone[0])
            full = n * 8 > made.buckets * SLOTS * 7 or not made.add_all(*come)
            return pd.DataFrame({"shard": [shard], "n_keys": [n], "filter": [b"" if full else made.to_bytes()]})

        schema = "shard int, n_keys long, filter binary"
        updated, path = materialize(filters.groupBy("shard").cogroup(crossing.groupBy("shard")).applyInPandas(update, schema), "line-updated")
        full = updated.where(F.length("filter") == 0).select("shard")
        rebuilt = build_filters(self.refs, self.shards, self.min_docs).join(full, "shard", "left_semi")
        self._old.append(path)
        return updated.where(F.length("filter") > 0).unionByName(rebuilt)

    def insert(self, docs: DataFrame) -> "LineDedup":
        """Take documents in; a document that is there already counts once."""
        new, path = materialize(lines_of(docs, self.min_chars).distinct(), "line-new")
        known = self.postings.unionByName(new).distinct() if self.postings is not None else new
        self._step(known, new.select(*KEY).distinct())
        drop_path(self.spark, path)
        return self

    def delete(self, docs: DataFrame) -> "LineDedup":
        """Take documents (doc_id) out; what others hold is as if these had never come."""
        if self.postings is None:
            return self
        ids = docs.select("doc_id").distinct()
        changed, path = materialize(self.postings.join(ids, "doc_id", "left_semi").select(*KEY).distinct(), "line-changed")
        self._step(self.postings.join(ids, "doc_id", "left_anti"), changed)
        drop_path(self.spark, path)
        return self

    def clean(self, docs: DataFrame) -> DataFrame:
        """docs with their lines that the state says to drop taken out; all columns stay."""
        return dedup_lines(docs, self.refs, self.filters, self.shards, self.min_chars, self.min_docs)


def reference_state(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame, int, list[str]]:
    """refs at or above the threshold, filters and their number of shards for one whole corpus, and their folders."""
    refs, refs_path = materialize(count_references(lines_of(docs, min_chars)).where(F.col("n_docs") >= min_docs), "line-refs")
    shards = max(1, -(-refs.count() // SHARD_KEYS))
    filters, filters_path = materialize(build_filters(refs, shards, min_docs), "line-filters")
    return refs, filters, shards, [refs_path, filters_path]


def dedup_lines(docs: DataFrame, refs: DataFrame, filters: DataFrame, shards: int, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs (doc_id, text and any others) without the lines whose key min_docs documents hold, but in its keeper."""
    decisions = _decisions(docs, refs, filters, shards, min_chars, min_docs)
    schema = docs.schema

    def emit(batch: pa.RecordBatch, done: list) -> pa.RecordBatch:
        at = batch.schema.get_field_index("text")
        was_null = batch.column(at).is_null().to_pylist()
        texts = [None if null else _kept_text(*x) for x, null in zip(done, was_null)]
        columns = [pa.array(texts, batch.schema.field(at).type) if i == at else c for i, c in enumerate(batch.columns)]
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return _rewrite(docs, decisions, min_chars, schema, emit)


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Per row of documents: n_lines, n_dropped and the digest of what stays. Null and empty texts are one empty line; rows
    without a doc_id keep all; of rows that share one each loses the same lines; an empty table gives no row."""
    docs = with_schema(table(spark, sf_dir, "documents"), "doc_id", "text")
    refs, filters, shards, _ = reference_state(docs)
    decisions = _decisions(docs, refs, filters, shards, MIN_CHARS, MIN_DOCS)

    def emit(batch: pa.RecordBatch, done: list) -> pa.RecordBatch:
        columns = [
            batch.column(0),
            pa.array([len(lines) for lines, _ in done], pa.int64()),
            pa.array([keep.count(False) for _, keep in done], pa.int64()),
            pa.array([hashlib.sha256(_kept_text(*x).encode()).hexdigest() for x in done], pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return _rewrite(docs, decisions, MIN_CHARS, "doc_id long, n_lines long, n_dropped long, kept_sha256 string", emit)


SQL = {
    "op8_line_dedup": r"""
WITH lines AS (
  SELECT r, doc_id, n, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT r, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS n
        FROM (SELECT r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)))),
lost AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT r, doc_id, n, line, coalesce(doc_id <> keeper, false) AS dropped FROM lines LEFT JOIN lost ON lines.k = lost.k)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""
}
