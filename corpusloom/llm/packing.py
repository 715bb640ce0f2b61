"""Bounded-space online best-fit packing of token pieces into fixed sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table, utf8, with_schema
from .tokenization import WordEncoder, default_path

SEQUENCE_TOKENS = 2048
#: Open bins of one packing task; and pieces it takes in at a time, the longest of them first. No more pieces than bins,
#: so that a round's long pieces never close bins which its short ones could fill.
OPEN_BINS = 4096
ROUND = 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


class BestFit:
    """Online best fit over a fixed number of open bins, in a bitset keyed by free space.

    The bitset is an integer whose bit f says that a bin with f free tokens is open, so the tightest bin that takes a
    piece is the lowest bit at or above its length. When one more bin would be open than allowed, the fullest closes.
    """

    def __init__(self, capacity: int = SEQUENCE_TOKENS, open_bins: int = OPEN_BINS):
        self.capacity, self.limit = capacity, open_bins
        self.free = 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.n_open = 0
        self.n_bins = 0

    def _take(self, free: int) -> int:
        bins = self.bins[free]
        number = bins.pop()
        if not bins:
            self.free ^= 1 << free
        self.n_open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """The bin of a piece and the piece's offset there."""
        if not 0 < length <= self.capacity:
            raise ValueError(f"a piece of {length} tokens does not fit {self.capacity}")
        fits = self.free >> length
        if fits:
            free = (fits & -fits).bit_length() - 1 + length
            number = self._take(free)
        else:
            free, number = self.capacity, self.n_bins
            self.n_bins += 1
        left = free - length
        if left:
            if self.n_open == self.limit:
                fullest = (self.free & -self.free).bit_length() - 1
                if fullest >= left:  # the bin just filled is the fullest itself
                    return number, self.capacity - free
                self._take(fullest)
            self.bins[left].append(number)
            self.free |= 1 << left
            self.n_open += 1
        return number, self.capacity - free


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = SEQUENCE_TOKENS) -> DataFrame:
    """Pieces of each document (doc_id, text): ids with the end id, cut only where a document is longer than capacity.
    Null text is empty: a piece of the end id alone."""
    small_batches(docs.sparkSession)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        step = 4 * capacity
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch, "text")):
                data = memoryview(np.frombuffer(encoder.encode_utf8(text), encoder.type).astype("<u4").tobytes() + end)
                for piece, at in enumerate(range(0, len(data), step)):
                    part = data[at : at + step]
                    for column, value in zip(rows, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return with_schema(docs, "doc_id", "text").mapInArrow(cut, PIECES)


def pack(pieces: DataFrame, capacity: int = SEQUENCE_TOKENS, open_bins: int = OPEN_BINS) -> DataFrame:
    """Adds sequence_id and offset to pieces (PIECES). Only piece lengths are shuffled, never ids.

    rebalance() lets Spark choose tasks by their size, so small inputs meet in one task and large ones spread. Each
    task streams its pieces in a fixed pseudo-random order through BestFit in rounds of ROUND pieces, the longest first,
    so a repeated task repeats its result. Sequence ids are unique: the task's number in the high bits.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = BestFit(capacity, open_bins)
        base = TaskContext.get().partitionId() << 40
        held, n = [], 0

        def placed() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            order = np.argsort(-rows.column("length").to_numpy(), kind="stable")
            rows = rows.take(pa.array(order)).combine_chunks().to_batches()[0]
            at = np.array([fit.place(x) for x in rows.column("length").to_pylist()], np.int64)
            return pa.RecordBatch.from_arrays([*rows.columns, pa.array(at[:, 0] + base), pa.array(at[:, 1])], names=[*rows.schema.names, "sequence_id", "offset"])

        for batch in batches:
            for start in range(0, batch.num_rows, ROUND):
                part = batch.slice(start, ROUND)
                if n + part.num_rows > ROUND:
                    yield placed()
                    held.clear()
                    n = 0
                held.append(part)
                n += part.num_rows
        if n:
            yield placed()

    mixed = pieces.hint("rebalance", "doc_id").sortWithinPartitions(F.xxhash64("doc_id", "piece"), "doc_id", "piece", "ids_crc32", "length")
    return mixed.mapInArrow(run, PACKED)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, capacity: int = SEQUENCE_TOKENS, open_bins: int = OPEN_BINS) -> DataFrame:
    """Documents to packed pieces. An empty table gives no rows; repeated rows are packed each."""
    return pack(token_pieces(docs, tokenizer or default_path(), end_id, capacity), capacity, open_bins)


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """The pieces of every row of documents and their places. Null and empty texts are a piece of the end id alone, repeated
    rows and null doc_ids have pieces of their own, equal lengths keep a fixed order, an empty table gives no row."""
    return pack_documents(table(spark, sf_dir, "documents"))
