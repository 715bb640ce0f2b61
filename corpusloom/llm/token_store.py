"""Token-id files: independent zstandard frames, a document index and a trailing seek table.

Layout of a file: frames of FRAME_TOKENS ids each (the last may be shorter), every one a complete zstandard frame
with its content checksum; a skippable frame with the document index; a skippable frame with the seek table of the
zstandard seekable format (sizes and the low 32 bits of XXH64 for each frame). Any zstandard decoder reads the ids
as one stream; TokenFile decompresses only the frames a requested document touches.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, scratch_path, small_batches, utf8, with_schema
from .tokenization import WordEncoder, default_path

FRAME_TOKENS = 16_384
#: Bytes of text in a file, about; and those from which another file is made while the session's tasks are not all used.
FILE_BYTES, LEAST_BYTES = 256 << 20, 16 << 20
#: Fixed values of the zstandard seekable format.
SEEK_SKIPPABLE = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
#: A skippable frame that other decoders pass over.
INDEX_SKIPPABLE = 0x184D2A5A
INDEX_HEADER = struct.Struct("<IIQ")  # bytes of an id, ids of a frame, documents


class TokenFileWriter:
    """add() documents one by one, then close(). One frame of ids is held and the index, 17 bytes a document of the file."""

    def __init__(self, out, width: int, frame_tokens: int = FRAME_TOKENS):
        self.out, self.width, self.frame_tokens = out, width, frame_tokens
        self.compressor = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
        self.held, self.held_bytes = [], 0
        self.frames: list[tuple[int, int, int]] = []
        self.ids: list[int] = []
        self.nulls = bytearray()
        self.starts: list[int] = [0]

    def add(self, doc_id: int | None, data: bytes) -> None:
        """data: the document's ids, little-endian, `width` bytes each."""
        self.ids.append(0 if doc_id is None else doc_id)
        self.nulls.append(doc_id is None)
        self.starts.append(self.starts[-1] + len(data) // self.width)
        self.held.append(data)
        self.held_bytes += len(data)
        size = self.frame_tokens * self.width
        if self.held_bytes >= size:
            data = b"".join(self.held)
            whole = len(data) - len(data) % size
            for at in range(0, whole, size):
                self._frame(data[at : at + size])
            self.held, self.held_bytes = [data[whole:]], len(data) - whole

    def _frame(self, data: bytes) -> None:
        packed = self.compressor.compress(data)
        self.out.write(packed)
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def close(self) -> tuple[int, int]:
        """Documents and ids written."""
        if self.held_bytes:
            self._frame(b"".join(self.held))
        n = len(self.ids)
        index = INDEX_HEADER.pack(self.width, self.frame_tokens, n) + np.array(self.ids, "<i8").tobytes() + np.array(self.starts, "<u8").tobytes() + bytes(self.nulls)
        self.out.write(struct.pack("<II", INDEX_SKIPPABLE, len(index)) + index)
        seek = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SEEK_SKIPPABLE, len(seek)) + seek)
        return n, self.starts[-1]


class TokenFile:
    """Random access to one file; source needs size(), seek() and read()."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        frames, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or not flags & 0x80:
            raise ValueError("no seek table with checksums")
        seek_bytes = 12 * frames + 9
        kind, length = struct.unpack("<II", self._at(size - seek_bytes - 8, 8))
        if kind != SEEK_SKIPPABLE or length != seek_bytes:
            raise ValueError("the seek table is damaged")
        entries = np.frombuffer(self._at(size - seek_bytes, 12 * frames), "<u4").reshape(-1, 3)
        self.packed, self.plain, self.sums = entries.T.astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.packed)])
        at = int(self.offsets[-1])
        kind, length = struct.unpack("<II", self._at(at, 8))
        if kind != INDEX_SKIPPABLE:
            raise ValueError("no document index")
        index = self._at(at + 8, length)
        self.width, self.frame_tokens, n = INDEX_HEADER.unpack_from(index)
        body = INDEX_HEADER.size
        self.doc_ids = np.frombuffer(index, "<i8", n, body)
        self.starts = np.frombuffer(index, "<u8", n + 1, body + 8 * n).astype(np.int64)
        self.nulls = np.frombuffer(index, "u1", n, body + 8 * n + 8 * (n + 1)).astype(bool)
        self._held: tuple[int, bytes] = (-1, b"")

    def _at(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def frame(self, k: int) -> bytes:
        """The ids of frame k, held until another is asked for."""
        if self._held[0] != k:
            data = zstandard.ZstdDecompressor().decompress(self._at(int(self.offsets[k]), int(self.packed[k])), max_output_size=int(self.plain[k]))
            if len(data) != self.plain[k] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"frame {k}: wrong checksum")
            self._held = (k, data)
        return self._held[1]

    def tokens(self, i: int) -> np.ndarray:
        """The ids of the i-th document; only the frames that hold them are decompressed."""
        start, end = int(self.starts[i]), int(self.starts[i + 1])
        parts = []
        while start < end:
            k, within = divmod(start, self.frame_tokens)
            take = min(end - start, self.frame_tokens - within)
            parts.append(np.frombuffer(self.frame(k), f"<u{self.width}", take, within * self.width))
            start += take
        return np.concatenate(parts).astype("<u4") if parts else np.zeros(0, "<u4")

    def find(self, doc_id: int) -> list[np.ndarray]:
        """The ids of every document with this doc_id."""
        return [self.tokens(int(i)) for i in np.flatnonzero((self.doc_ids == doc_id) & ~self.nulls)]


def qualified(spark, path: str) -> str:
    """The path with the scheme that Spark reads and writes it by: one without takes that of fs.defaultFS."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a qualified path and the path there; Hadoop's name for S3 is mapped, schemes that only Hadoop knows are an
    error rather than another place."""
    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    if scheme in ("s3a", "s3n"):
        uri = f"s3:{rest}"
    try:
        return pafs.FileSystem.from_uri(uri)
    except (pa.ArrowInvalid, OSError) as e:
        raise ValueError(f"token files cannot be kept under {uri}: use a folder under file:, s3a: or gs:, or hdfs: with libhdfs") from e


def _replace(fs: pafs.FileSystem, source: str, target: str) -> None:
    """Rename; where a store does not overwrite, the file of an earlier attempt at the same task goes first."""
    try:
        fs.move(source, target)
    except OSError:
        if fs.get_file_info(target).type == pafs.FileType.NotFound:
            raise
        fs.delete_file(target)
        fs.move(source, target)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, frame_tokens: int = FRAME_TOKENS) -> DataFrame:
    """Encode docs (doc_id, text) into files under path in ascending doc_id order; returns the manifest
    (file_no, file, n_docs, n_tokens), one row a file, whose computation writes the files.

    Null text is empty, null doc_ids come first, rows with one doc_id are ordered by the text's hash, so that they can be
    parted between files; equal rows are written each. Files have about FILE_BYTES of text. A file is written under a
    name of its own and then renamed, so repeated and speculative tasks leave one whole file.
    """
    small_batches(docs.sparkSession)
    path = qualified(docs.sparkSession, path)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _filesystem(path)
        number = TaskContext.get().partitionId()
        name = f"part-{number:08d}.tokens"
        writer = out = None
        temporary = f"{folder}/.{name}-{uuid.uuid4().hex}"
        encoder = WordEncoder.of(tokenizer)
        width = encoder.width if end_id < 1 << 16 else 4
        end = end_id.to_bytes(width, "little")
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch, "text")):
                if writer is None:
                    fs.create_dir(folder, recursive=True)
                    out = fs.open_output_stream(temporary)
                    writer = TokenFileWriter(out, width, frame_tokens)
                ids = encoder.encode_utf8(text)
                writer.add(doc_id, (ids if width == encoder.width else np.frombuffer(ids, encoder.type).astype("<u4").tobytes()) + end)
        if writer is not None:
            n, tokens = writer.close()
            out.close()
            _replace(fs, temporary, f"{folder}/{name}")
            yield pa.RecordBatch.from_pylist([{"file_no": number, "file": name, "n_docs": n, "n_tokens": tokens}])

    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(spark.sparkContext.defaultParallelism, -(-size // LEAST_BYTES)))
    files = max(tasks, -(-size // FILE_BYTES))
    keys = [F.col("doc_id"), F.xxhash64("text")]
    ordered = with_schema(docs, "doc_id", "text").repartitionByRange(files, *keys).sortWithinPartitions(*keys, "text")
    return ordered.mapInArrow(write, "file_no long, file string, n_docs long, n_tokens long")


def read_token_files(spark, path: str, manifest: list[tuple[int, str, int, int]]) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.
    manifest: a row a file, the only thing the driver holds."""
    path, before, rows = qualified(spark, path), 0, []
    for number, file, n, tokens in sorted(manifest):
        rows.append((number, file, before))
        before += tokens
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not rows:
        return spark.createDataFrame([], schema)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _filesystem(path)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{folder}/{row['file']}") as source:
                    store = TokenFile(source)
                    n = len(store.doc_ids)
                    for at in range(0, n, 4096):
                        to = min(n, at + 4096)
                        crcs = [zlib.crc32(store.tokens(i)) for i in range(at, to)]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(store.doc_ids[at:to], pa.int64(), mask=store.nulls[at:to]),
                                pa.array(store.starts[at:to] + row["before"], pa.int64()),
                                pa.array(np.diff(store.starts[at : to + 1]), pa.int64()),
                                pa.array(crcs, pa.int64()),
                            ],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    files = spark.createDataFrame(rows, "file_no long, file string, before long")
    return files.repartitionByRange(len(rows), "file_no").mapInArrow(read, schema)


def op1_token_store(spark, sf_dir: str) -> DataFrame:
    """Every document of documents through the token files: doc_id, start, n_tokens, ids_crc32, read back from them.
    Empty and null texts hold the end id alone; an empty table gives no file and no row."""
    path = scratch_path(spark, "tokens")
    manifest, at = None, scratch_path(spark, "tokens-manifest")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, default_path(), end_id=2).write.parquet(at)
    manifest = [tuple(r) for r in spark.read.schema("file_no long, file string, n_docs long, n_tokens long").parquet(at).collect()]
    drop_path(spark, at)
    return read_token_files(spark, path, manifest)


