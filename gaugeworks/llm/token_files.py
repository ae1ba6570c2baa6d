"""Token-ID files: independent zstandard frames, a document index and a trailing seek table.

A file is a sequence of ordinary zstandard frames, each with its content checksum and the ids of some
whole documents (little-endian, 16 bits where the vocabulary allows it, else 32); then a skippable
frame with the document index (which doc_ids are null, doc_id, number of ids; zstandard again); then the seek table of the
public zstandard seekable format in another skippable frame: compressed size, decompressed size and
the low 32 bits of the content's xxh64 for each frame, and a footer. Any zstandard decoder reads the
whole file; `TokenFile` decompresses only the frames of the documents asked for. Frames go to the file as
they fill, so a writer holds one frame and the index.

Cases: a null text counts as empty and yields the end id alone; rows with null doc_id come first, as
equal doc_ids they stay next to each other, by text hash, and may go over several files; any 64-bit doc_id is
kept as it is; an empty table yields no file; columns other than doc_id and text are not read. A document longer
than a frame has a frame of its own.
"""

from __future__ import annotations

import contextlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.llm import tokens
from gaugeworks.llm.words import pieces, texts_of
from gaugeworks.llm.workspace import Workspace, filesystem, new_file, tidy

#: Bytes of ids after which a frame ends.
FRAME_BYTES = 1 << 20
SKIPPABLE, SEEK_TABLE, INDEX_FRAME = 0x184D2A5E, 0x8F92EAB1, 0x184D2A5D
DESCRIPTOR = 0x80  # checksums are present
MANIFEST = "part long, uri string, docs long, ids long"
#: Files whose ids are summed at once: the driver gets one sum for each so many.
FILES_A_RUN = 1000


class TokenFileWriter:
    """Writes documents in order to a stream (anything with write); `finish` ends the file."""

    def __init__(self, out, width: int, frame_bytes: int = FRAME_BYTES, level: int = 1):
        self.dtype, self.frame_bytes = np.dtype("<u2" if width == 2 else "<u4"), frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.out, self.table = out, []
        self.held, self.held_bytes = [], 0
        self.docs: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def add(self, doc_ids: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> None:
        """Documents with their ids back to back. A frame ends with the document that fills it."""
        ids = ids.astype(self.dtype)
        at = 0
        while at < len(doc_ids):
            room = max(0, self.frame_bytes - self.held_bytes) // self.dtype.itemsize
            to = min(len(doc_ids), int(np.searchsorted(offsets, offsets[at] + room)))
            to = max(to, at + 1)
            self.held.append(ids[offsets[at] : offsets[to]])
            self.held_bytes += self.held[-1].nbytes
            if self.held_bytes >= self.frame_bytes:
                self._end_frame()
            at = to
        self.docs.append(doc_ids.fill_null(0).to_numpy(zero_copy_only=False))
        self.nulls.append(doc_ids.is_null().to_numpy(zero_copy_only=False))
        self.sizes.append(np.diff(offsets))

    def _end_frame(self) -> None:
        raw = np.concatenate(self.held).tobytes()
        frame = self.zstd.compress(raw)
        self.table.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.out.write(frame)
        self.held, self.held_bytes = [], 0

    def finish(self) -> None:
        if self.held:
            self._end_frame()
        docs, nulls, sizes = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.docs, self.nulls, self.sizes))
        marks = np.packbits(nulls.astype(bool), bitorder="little").tobytes()
        index = self.zstd.compress(struct.pack("<BQ", self.dtype.itemsize, len(docs)) + marks + docs.astype("<i8").tobytes() + sizes.astype("<i8").tobytes())
        self.out.write(struct.pack("<II", INDEX_FRAME, len(index)) + index)
        rows = b"".join(struct.pack("<III", *row) for row in self.table)
        self.out.write(struct.pack("<II", SKIPPABLE, len(rows) + 9) + rows + struct.pack("<IBI", len(self.table), DESCRIPTOR, SEEK_TABLE))


class TokenFile:
    """Reads a file by its seek table. `file`: anything with seek, read and a known end."""

    def __init__(self, file):
        self.file = file
        size = file.seek(0, 2)
        file.seek(size - 9)
        count, descriptor, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEK_TABLE or descriptor != DESCRIPTOR:
            raise ValueError("no seek table with checksums at the end of this file")
        file.seek(size - 9 - 12 * count - 8)
        head, length = struct.unpack("<II", file.read(8))
        if head != SKIPPABLE or length != 12 * count + 9:
            raise ValueError("the seek table is damaged")
        self.table = np.frombuffer(file.read(12 * count), "<u4").reshape(count, 3)
        self.at = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        raw_at = np.concatenate([[0], np.cumsum(self.table[:, 1], dtype=np.int64)])
        file.seek(int(self.at[-1]))
        head, length = struct.unpack("<II", file.read(8))
        if head != INDEX_FRAME:
            raise ValueError("the document index is missing")
        index = zstandard.ZstdDecompressor().decompress(file.read(length))
        width, docs = struct.unpack_from("<BQ", index)
        self.dtype = np.dtype(f"<u{width}")
        at = 9 + -(-docs // 8)
        self.nulls = np.unpackbits(np.frombuffer(index, np.uint8, at - 9, 9), count=docs, bitorder="little").astype(bool)
        self.doc_ids = np.frombuffer(index, "<i8", docs, at)
        self.offsets = np.concatenate([[0], np.cumsum(np.frombuffer(index, "<i8", docs, at + 8 * docs), dtype=np.int64)])
        self.frame_ids = raw_at // width

    def frame(self, k: int) -> np.ndarray:
        """The ids of frame k, its checksums verified."""
        self.file.seek(int(self.at[k]))
        raw = zstandard.ZstdDecompressor().decompress(self.file.read(int(self.table[k, 0])))
        if len(raw) != self.table[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"frame {k} doesn't match its checksum")
        return np.frombuffer(raw, self.dtype)

    def read(self, rows: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(row in the index, ids) of the asked documents in file order; only their frames are decompressed."""
        rows = np.arange(len(self.doc_ids)) if rows is None else np.sort(rows)
        frame, held = -1, None
        for row in rows.tolist():
            lo, hi = int(self.offsets[row]), int(self.offsets[row + 1])
            k = min(int(np.searchsorted(self.frame_ids, lo, "right")) - 1, len(self.table) - 1)
            if lo == hi:
                yield row, np.zeros(0, self.dtype)
                continue
            if k != frame:
                frame, held = k, self.frame(k)
            yield row, held[lo - self.frame_ids[k] : hi - self.frame_ids[k]]


def _write_part(path: str, end_id: int, folder: str, frame_bytes: int):
    @tidy
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path)
        width = 2 if max(len(encoder.ends_word), end_id + 1) <= 1 << 16 else 4
        part = TaskContext.get().partitionId()
        uri = f"{folder}/part-{part:05d}-{uuid.uuid4().hex}.ids.zst"  # a second attempt writes another file; the manifest has the one that counts
        writer, docs, total = None, 0, 0
        with contextlib.ExitStack() as stack:
            for batch in batches:
                doc_ids = batch.column("doc_id").cast(pa.int64())
                for at, some in pieces(texts_of(batch.column("text"))):
                    ids, offsets = encoder.encode(some)
                    ids = np.insert(ids, offsets[1:], np.uint32(end_id))
                    offsets = offsets + np.arange(len(offsets))
                    writer = writer or TokenFileWriter(stack.enter_context(new_file(uri)), width, frame_bytes)
                    writer.add(doc_ids.slice(at, len(some)), ids, offsets)
                    docs, total = docs + len(some), total + len(ids)
            if writer:
                writer.finish()
        if writer:  # the file is closed, and so whole
            yield pa.RecordBatch.from_pydict({"part": [part], "uri": [uri], "docs": [docs], "ids": [total]})

    return write


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 1, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Write all documents in ascending doc_id, a file for each range; return the manifest (part, uri, docs, ids)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())  # a doc_id may stand on very many rows
    ordered = rows.repartitionByRange("doc_id", "hash", "row").sortWithinPartitions("doc_id", "hash", "row")
    manifest = ordered.mapInArrow(_write_part(tokenizer or tokens.default_path(), end_id, f"{folder}/files", frame_bytes), MANIFEST)
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, manifest: DataFrame, wanted: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked, ids of each document, a
    task for each file. wanted: only these doc_ids; other frames stay compressed."""
    runs = manifest.groupBy(F.floor(F.col("part") / FILES_A_RUN).alias("run")).agg(F.sum("ids").alias("ids")).orderBy("run").collect()  # a row for each FILES_A_RUN files
    starts, total = [], 0
    for r in runs:
        starts.append((r["run"], total))
        total += r["ids"]
    ask = None if wanted is None else np.array(sorted(wanted), np.int64)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    @tidy
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, first in zip(batch.column("uri").to_pylist(), batch.column("base").to_pylist(), strict=True):
                fs, path = filesystem(uri)
                with fs.open_input_file(path) as raw:
                    file = TokenFile(raw)
                    rows = None if ask is None else np.flatnonzero(np.isin(file.doc_ids, ask) & ~file.nulls)
                    yield from _emit(file, rows, first, with_ids)

    if not runs:
        return spark.createDataFrame([], schema)
    before = Window.partitionBy("run").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    listing = manifest.withColumn("run", F.floor(F.col("part") / FILES_A_RUN)).join(F.broadcast(spark.createDataFrame(starts, "run long, start long")), "run")
    listing = listing.select("part", "uri", (F.col("start") + F.coalesce(F.sum("ids").over(before), F.lit(0))).alias("base"))
    return listing.repartition(max(1, manifest.count()), "part").mapInArrow(read, schema)


def _emit(file: TokenFile, rows: np.ndarray | None, first: int, with_ids: bool, most: int = 4096) -> Iterator[pa.RecordBatch]:
    at, crcs, ids = [], [], []

    def batch() -> pa.RecordBatch:
        docs = file.doc_ids[at]
        columns = {
            "doc_id": pa.array(docs, mask=file.nulls[at]),
            "start": pa.array(file.offsets[at] + first),
            "n_tokens": pa.array(file.offsets[np.array(at, np.int64) + 1] - file.offsets[at]),
            "ids_crc32": pa.array(crcs, pa.int64()),
        }
        if with_ids:
            columns["ids"] = pa.array(ids, pa.list_(pa.int64()))
        return pa.RecordBatch.from_pydict(columns)

    size = 0
    for row, got in file.read(rows):
        at.append(row)
        crcs.append(zlib.crc32(got.astype("<u4").tobytes()))
        if with_ids:
            ids.append(got.astype(np.int64))
        size += len(got) if with_ids else 1
        if len(at) == most or size > 1 << 18:
            yield batch()
            at, crcs, ids, size = [], [], [], 0
    if at:
        yield batch()


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written in the file format and read back: doc_id, start, n_tokens, ids_crc32."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    work = Workspace(spark, "token-files")
    return read_token_files(spark, write_token_files(docs, work.root), with_ids=False)
