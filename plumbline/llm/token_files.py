"""Token files: independent zstandard frames, a directory of documents, and a trailing seek table.

A file holds whole documents in ascending order of id. Each frame is compressed by itself and holds the 32-bit
little-endian ids of one or more documents. Behind the frames stand two skippable frames, which any zstandard
reader passes over: the directory (id, frame, first token in the frame and number of tokens of each document)
and the seek table of the seekable format (compressed size, decompressed size and a 32-bit checksum of the
content of each frame, then the number of frames, a descriptor byte and a magic number). A reader takes the
tail first and then decompresses only the frames of the documents it wants.

Files are written by the tasks into the shared folder under a name of their own, so a task that runs twice
leaves an orphan that no manifest row names. The order over files is that of their numbers.

Inputs: a null text is empty: one end id. Rows that repeat an id stand one after the other; null ids come first.
Extra columns are ignored. An empty table gives files without documents or none.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import slices, stored
from plumbline.llm.encoding import default_path, encoder
from plumbline.session import shared_dir

END_ID = 2
FRAME_TOKENS = 65_536
LEVEL = 1
#: Fixed by the zstandard formats.
SKIPPABLE, SEEKABLE_FOOTER, CHECKSUM_FLAG = 0x184D2A5E, 0x8F92EAB1, 0x80
DIRECTORY = 0x184D2A5D

_DIRECTORY_ROW = np.dtype([("doc_id", "<i8"), ("has_id", "<u1"), ("frame", "<u4"), ("first", "<u8"), ("tokens", "<u8")])
_SEEK_ROW = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Writer:
    def __init__(self, stream, frame_tokens: int = FRAME_TOKENS, level: int = LEVEL):
        self.stream, self.frame_tokens = stream, frame_tokens
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.directory: list[tuple] = []
        self.table: list[tuple[int, int, int]] = []
        self.held: list[bytes] = []
        self.tokens = self.total = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        if self.tokens and self.tokens + n > self.frame_tokens:
            self._close_frame()
        self.directory.append((doc_id or 0, doc_id is not None, len(self.table), self.tokens, n))
        self.held.append(ids)
        self.tokens += n
        self.total += n

    def _close_frame(self) -> None:
        content = b"".join(self.held)
        packed = self.packer.compress(content)
        self.table.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.stream.write(packed)
        self.held, self.tokens = [], 0

    def close(self) -> None:
        if self.tokens:
            self._close_frame()
        directory = zstandard.ZstdCompressor(level=3).compress(np.array(self.directory, _DIRECTORY_ROW).tobytes())
        self.stream.write(struct.pack("<II", DIRECTORY, len(directory)) + directory)
        rows = np.array(self.table, _SEEK_ROW).tobytes()
        self.stream.write(struct.pack("<II", SKIPPABLE, len(rows) + 9) + rows + struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, SEEKABLE_FOOTER))
        self.stream.close()


class Reader:
    """Random access by document number; only the frames asked for are read and decompressed."""

    def __init__(self, file):
        self.file, end = file, file.size()
        frames, flag, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEKABLE_FOOTER or flag != CHECKSUM_FLAG:
            raise ValueError("the file has no seek table")
        begin = end - 9 - frames * _SEEK_ROW.itemsize - 8
        if struct.unpack("<II", self._at(begin, 8)) != (SKIPPABLE, end - begin - 8):
            raise ValueError("the seek table is damaged")
        self.table = np.frombuffer(self._at(begin + 8, frames * _SEEK_ROW.itemsize), _SEEK_ROW)
        self.starts = np.concatenate(([0], np.cumsum(self.table["packed"].astype(np.int64))))
        at = int(self.starts[-1])
        magic, size = struct.unpack("<II", self._at(at, 8))
        if magic != DIRECTORY:
            raise ValueError("the file has no directory")
        self.documents = np.frombuffer(zstandard.ZstdDecompressor().decompress(self._at(at + 8, size)), _DIRECTORY_ROW)
        self.frames_read = 0
        self._held: tuple[int, np.ndarray] | None = None

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def frame(self, number: int) -> np.ndarray:
        if self._held is None or self._held[0] != number:
            row = self.table[number]
            content = zstandard.ZstdDecompressor().decompress(self._at(int(self.starts[number]), int(row["packed"])), max_output_size=int(row["size"]))
            if len(content) != row["size"] or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != row["check"]:
                raise ValueError(f"frame {number} does not match its checksum")
            self.frames_read += 1
            self._held = number, np.frombuffer(content, "<u4")
        return self._held[1]

    def ids(self, document: int) -> np.ndarray:
        row = self.documents[document]
        first = int(row["first"])
        return self.frame(int(row["frame"]))[first: first + int(row["tokens"])]

    def find(self, doc_id: int) -> list[int]:
        return np.nonzero((self.documents["doc_id"] == doc_id) & (self.documents["has_id"] == 1))[0].tolist()


def write_files(docs: DataFrame, folder: str, path: str | None = None, frame_tokens: int = FRAME_TOKENS, level: int = LEVEL) -> DataFrame:
    """Writes all documents below ``folder``; returns the manifest (file, path, documents, tokens), one row per file."""
    path, end = path or default_path(), np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        name = f"{folder}/part-{number:07d}-{uuid.uuid4().hex}.zst"
        system, target = _filesystem(name)
        system.create_dir(target.rsplit("/", 1)[0], recursive=True)
        out = Writer(system.open_output_stream(target, compression=None), frame_tokens, level)
        for batch in batches:
            for cut in slices(batch, "text"):
                for doc_id, ids in zip(cut.column(0).to_pylist(), encoder(path).ids([t or "" for t in cut.column(1).to_pylist()])):
                    out.add(doc_id, ids + end)
        out.close()
        yield pa.record_batch([pa.array([number]), pa.array([name]), pa.array([len(out.directory)]), pa.array([out.total])],
                              names=["file", "path", "documents", "tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Rows that share an id are spread by their text as well, so one id cannot fill a task.
    spread = [F.col("doc_id"), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*spread).sortWithinPartitions(*spread)
    return stored(ordered.mapInArrow(run, "file long, path string, documents long, tokens long"), "manifest")


def read_files(manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32, file."""
    spark = manifest.sparkSession
    base, rows = 0, []
    for r in manifest.orderBy("file").collect():  # one row per file
        rows.append((r["file"], r["path"], base))
        base += r["tokens"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, path, base in zip(*(c.to_pylist() for c in batch.columns)):
                system, target = _filesystem(path)
                with system.open_input_file(target) as file:
                    reader = Reader(file)
                    starts = base + np.concatenate(([0], np.cumsum(reader.documents["tokens"].astype(np.int64))))
                    for lo in range(0, len(reader.documents), 4096):
                        part = reader.documents[lo: lo + 4096]
                        crc = [zlib.crc32(reader.ids(i).tobytes()) for i in range(lo, lo + len(part))]
                        yield pa.record_batch([
                            pa.array(part["doc_id"].astype(np.int64), mask=part["has_id"] == 0), pa.array(starts[lo: lo + len(part)]),
                            pa.array(part["tokens"].astype(np.int64)), pa.array(crc, pa.int64()), pa.array([number] * len(part), pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32", "file"])

    files = spark.createDataFrame(rows, "file long, path string, base long").repartition(max(1, len(rows)), "file")
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, file long")


def round_trip(docs: DataFrame, path: str | None = None, frame_tokens: int = FRAME_TOKENS) -> DataFrame:
    """Encodes, writes and reads back every document."""
    folder = shared_dir(docs.sparkSession, "tokens")
    if "://" not in folder and folder.startswith("file:"):
        folder = "file://" + folder.removeprefix("file:")
    return read_files(write_files(docs, folder, path, frame_tokens))
