"""Files of token ids in bit or byte planes, as a data source of Spark.

``ids.write.format("idplanes").save(folder)`` writes rows (doc_id, tokens) in
their order, ``spark.read.format("idplanes").load(folder)`` gives (doc_id, start,
n_tokens, tokens) back.

A file holds chunks of ``CHUNK`` ids. A chunk is transposed: all first bytes of
its ids, all second ones and so on (or 32 planes of bits), each plane compressed
by zstandard. Behind the chunks stand the table of the file's documents (ids and
lengths, in byte planes too) and the chunk index: where each plane of each chunk
begins. So a range of ids is read by seeking to its chunks alone.

Every task writes files of its own under a name that no other attempt has. Only
when all tasks are done does the commit write the folder's index, with the ids
before each file; files of lost attempts are not in it.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .packing import encode_ids
from .shared import shared_dir
from .textops import blocks

MAGIC = b"IDPLANE1"
#: Ids of a chunk.
CHUNK = 1 << 16
#: Ids and documents from which on a task begins another file.
FILE_IDS, FILE_DOCS = 1 << 26, 1 << 20
#: Bytes of tokens in one batch that is read, about.
BATCH_BYTES = 1 << 23
LEVEL = 3
INDEX = "_index.parquet"


def to_planes(values: np.ndarray, kind: str) -> list[bytes]:
    """The bit or byte planes of integers, lowest first."""
    octets = values.view(np.uint8).reshape(len(values), values.dtype.itemsize)
    if kind == "byte":
        return [octets[:, k].tobytes() for k in range(octets.shape[1])]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(bits.shape[1])]


def from_planes(planes: list[bytes], n: int, kind: str, dtype: str) -> np.ndarray:
    if kind == "byte":
        out = np.empty((n, len(planes)), np.uint8)
        for k, plane in enumerate(planes):
            out[:, k] = np.frombuffer(plane, np.uint8)
    else:
        bits = np.empty((n, len(planes)), np.uint8)
        for k, plane in enumerate(planes):
            bits[:, k] = np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little")
        out = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(out).reshape(-1).view(dtype)


class IdFileWriter:
    """One file: chunks as they fill up, then documents and index."""

    def __init__(self, sink, kind: str = "byte", chunk: int = CHUNK):
        self.sink, self.kind, self.chunk, self.at = sink, kind, chunk, 0
        self.press = zstandard.ZstdCompressor(level=LEVEL)
        self.open: list[np.ndarray] = []
        self.waiting = self.n_ids = 0
        self.sizes: list[int] = []  # compressed bytes of each plane of each chunk
        self.docs: list[int | None] = []
        self.lengths: list[int] = []
        self._put(MAGIC)

    def _put(self, data: bytes) -> int:
        self.sink.write(data)
        self.at += len(data)
        return len(data)

    def _planes(self, values: np.ndarray, kind: str) -> list[int]:
        return [self._put(self.press.compress(p)) for p in to_planes(values, kind)]

    def add(self, doc: int | None, tokens: bytes) -> None:
        ids = np.frombuffer(tokens, "<u4")
        self.docs.append(doc)
        self.lengths.append(len(ids))
        self.n_ids += len(ids)
        while self.waiting + len(ids) >= self.chunk:
            take = self.chunk - self.waiting
            self._flush([*self.open, ids[:take]])
            ids = ids[take:]
        if len(ids):
            self.open.append(ids)
            self.waiting += len(ids)

    def _flush(self, parts: list[np.ndarray]) -> None:
        self.sizes += self._planes(np.concatenate(parts), self.kind)
        self.open, self.waiting = [], 0

    def close(self) -> None:
        if self.waiting:
            self._flush(self.open)
        known = np.array([d is not None for d in self.docs], np.uint8)
        table = [self._planes(x, "byte") for x in (np.array([d or 0 for d in self.docs], "<i8"), known, np.array(self.lengths, "<u4"))]
        index = self.press.compress(np.array([*self.sizes, *sum(table, [])], "<u4").tobytes())
        self._put(index)
        self._put(struct.pack("<QQIIB", len(self.docs), self.n_ids, self.chunk, len(index), self.kind == "bit") + MAGIC)


_TAIL = struct.calcsize("<QQIIB") + len(MAGIC)


class IdFile:
    """A file's documents and chunk index, and the ids of any range."""

    def __init__(self, source):
        self.source, size = source, source.size()
        tail = self._get(size - _TAIL, _TAIL)
        if tail[-len(MAGIC) :] != MAGIC:
            raise ValueError("no file of id planes")
        n_docs, self.n_ids, self.chunk, n_index, bit = struct.unpack("<QQIIB", tail[: -len(MAGIC)])
        self.kind = "bit" if bit else "byte"
        self.width = 32 if bit else 4
        sizes = np.frombuffer(zstandard.decompress(self._get(size - _TAIL - n_index, n_index)), "<u4").astype(np.int64)
        self.sizes = sizes
        self.places = len(MAGIC) + np.concatenate([[0], np.cumsum(sizes)])
        self.n_chunks = -(-self.n_ids // self.chunk)
        at, table = self.n_chunks * self.width, []
        for planes, kind in ((8, "<i8"), (1, "<u1"), (4, "<u4")):
            table.append(from_planes(self._load(at, planes, n_docs), n_docs, "byte", kind))
            at += planes
        self.doc_ids, self.known, self.lengths = table[0], table[1].astype(bool), table[2].astype(np.int64)
        self.chunks_read = 0

    def _get(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _load(self, at: int, planes: int, n: int) -> list[bytes]:
        data = self._get(int(self.places[at]), int(self.places[at + planes] - self.places[at]))
        cuts = (self.places[at : at + planes + 1] - self.places[at]).tolist()
        return [zstandard.decompress(data[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)] if n else []

    def read_chunk(self, k: int) -> np.ndarray:
        n = min(self.chunk, self.n_ids - k * self.chunk)
        self.chunks_read += 1
        return from_planes(self._load(k * self.width, self.width, n), n, self.kind, "<u4")

    def documents(self, first: int = 0, end: int | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, ids of the file before it, its ids) of each document that begins in [first, end)."""
        starts = np.concatenate([[0], np.cumsum(self.lengths)])
        end = self.n_ids + 1 if end is None else end
        have, ids = -1, np.zeros(0, "<u4")
        for d in range(*np.searchsorted(starts[:-1], [first, end]).tolist()):
            at, stop, parts = int(starts[d]), int(starts[d + 1]), []
            while at < stop:
                k = at // self.chunk
                if k != have:
                    have, ids = k, self.read_chunk(k)
                part = ids[at - k * self.chunk : stop - k * self.chunk]
                parts.append(part.tobytes())
                at += len(part)
            yield (int(self.doc_ids[d]) if self.known[d] else None), int(starts[d]), b"".join(parts)


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    """Any file system that Arrow knows; a local path is one on storage that all share."""
    if folder.startswith("s3a://"):
        folder = "s3://" + folder[6:]
    if folder.startswith("file:/"):
        folder = "/" + folder[5:].lstrip("/")
    return pafs.FileSystem.from_uri(folder)


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[int, int, str, int, int]]  # partition, number, name, documents, ids


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.kind, self.chunk = options["path"], options.get("planes", "byte"), int(options.get("chunk", CHUNK))
        if self.kind not in ("bit", "byte"):
            raise ValueError(f"planes must be bit or byte, not {self.kind}")
        fs, path = _open(self.folder)
        there = fs.get_file_info(f"{path}/{INDEX}").type != pafs.FileType.NotFound
        if there and not overwrite:
            raise ValueError(f"{self.folder} has ids already; rows have one order over all files, so none can be appended")
        fs.create_dir(path, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, path = _open(self.folder)
        partition, files, out, sink, name = TaskContext.get().partitionId(), [], None, None, ""

        def close() -> None:
            out.close()
            sink.close()
            files.append((partition, len(files), name, len(out.docs), out.n_ids))

        for batch in iterator:
            docs, tokens = batch.column("doc_id").to_pylist(), batch.column("tokens")
            for doc, x in zip(docs, tokens, strict=True):
                if out is not None and (out.n_ids >= FILE_IDS or len(out.docs) >= FILE_DOCS):
                    close()
                    out = None
                if out is None:
                    name = f"ids-{partition:06d}-{uuid.uuid4().hex}.idp"
                    sink = fs.open_output_stream(f"{path}/{name}")
                    out = IdFileWriter(sink, self.kind, self.chunk)
                out.add(doc, x.as_py() or b"")
        if out is not None:
            close()
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        """Writes the folder's index: one row per file, some hundred thousand for 100 TB."""
        rows = sorted(f for m in messages if m for f in m.files)
        counts = np.array([f[4] for f in rows], np.int64)
        starts = np.concatenate([[0], np.cumsum(counts)])[:-1].astype(np.int64)
        table = pa.table({
            "name": pa.array([f[2] for f in rows], pa.string()), "n_docs": pa.array([f[3] for f in rows], pa.int64()),
            "n_ids": pa.array(counts), "start": pa.array(starts),
        })
        fs, path = _open(self.folder)
        with fs.open_output_stream(f"{path}/{INDEX}") as f:
            pq.write_table(table, f)

    def abort(self, messages: list[_Written | None]) -> None:
        fs, path = _open(self.folder)
        for _, _, name, _, _ in (f for m in messages if m for f in m.files):
            fs.delete_file(f"{path}/{name}")


@dataclass
class _Part(InputPartition):
    name: str
    start: int
    first: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.first, self.end = int(options.get("first", 0)), int(options.get("end", 1 << 62))

    def partitions(self) -> list[_Part]:
        fs, path = _open(self.folder)
        with fs.open_input_file(f"{path}/{INDEX}") as f:
            rows = pq.read_table(f).to_pylist()
        parts = [_Part(r["name"], r["start"], max(0, self.first - r["start"]), self.end - r["start"]) for r in rows if r["start"] + r["n_ids"] >= self.first]
        return [p for p in parts if p.first < p.end] or [_Part("", 0, 0, 0)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        fs, path = _open(self.folder)
        with fs.open_input_file(f"{path}/{partition.name}") as source:
            rows, size = [], 0
            for doc, start, tokens in IdFile(source).documents(partition.first, partition.end):
                rows.append((doc, partition.start + start, len(tokens) // 4, tokens))
                size += len(tokens) + 64
                if size >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)


SCHEMA = "doc_id long, start long, n_tokens long, tokens binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])


class IdPlanes(DataSource):
    """Options: path; planes (byte or bit) and chunk to write; first and end (global positions) to read the documents that begin there."""

    @classmethod
    def name(cls) -> str:
        return "idplanes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, overwrite)


def encode_documents(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id and tokens (ids as little-endian 32-bit numbers, ``end_id`` last) of every row, in the order of ``docs``."""
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, b, off in blocks(batch.column(1)):
                raw = b.tobytes()
                ids = [encode_ids(raw[off[k] : off[k + 1]].decode("utf-8", "replace"), path) + end for k in range(j - i)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(ids, pa.binary())], ["doc_id", "tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, "doc_id long, tokens binary")


def write_token_ids(docs: DataFrame, path: str, folder: str, end_id: int = 2, planes: str = "byte", chunk: int = CHUNK) -> None:
    """Writes the ids of all documents to ``folder`` in ascending order of doc_id.

    A null or empty text is ``end_id`` alone. Documents with a null doc_id come
    first; rows that repeat a doc_id are all written, in the order in which Spark
    reads them. Their number is a part of the range that is dealt to a task, so
    one id with many rows is split. Other columns are ignored. An empty table
    gives an index without files. A task holds one chunk and one document's ids.
    ``folder`` is one that driver and executors share.
    """
    docs.sparkSession.dataSource.register(IdPlanes)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row")
    encode_documents(ordered, path, end_id).write.format("idplanes").option("planes", planes).option("chunk", chunk).mode("append").save(folder)


def read_token_ids(spark: SparkSession, folder: str, first: int = 0, end: int | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and tokens of the documents that begin in [first, end); only their chunks are read."""
    spark.dataSource.register(IdPlanes)
    reader = spark.read.format("idplanes").option("first", first)
    return (reader if end is None else reader.option("end", end)).load(folder)


def temporary_folder(spark: SparkSession) -> str:
    """A new path in the shared folder that is deleted when the application ends."""
    path = f"{shared_dir(spark)}/promolens/{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path
