"""Token ids as Arrow stream files with fixed-size-list batches.

A file (shard) holds the token stream of a run of documents in ascending doc_id, chopped into sequences of equal
length; only its last sequence is padded. A row of a record batch is one sequence:

  mask      fixed_size_list<bool>[L]    true where a token stands, false on padding
  tokens    fixed_size_list<uint16>[L]  (uint32 for vocabularies over 65,536)
  doc_ids   list<int64>                 documents that end in the sequence, in order
  doc_ends  list<int32>                 where each ends (exclusive, in this sequence)
  n_valid   int32                       tokens that are not padding

All sequences of a batch have the same width, so token i of a shard is at a computed place of a memory map, without a copy
(`open_shard`). Shards go out through Spark's own file writer, which commits each task once, to any store that Spark
reaches: the last column's last byte is always zero, so a batch is a line that ends in a zero byte. A shard is a fixed number of
lines, at which the file writer starts another file, so that a task's range makes as many files as it takes; the last line has what
is left of the shard's last document. A file has about SHARD_LINES MB, or more only by one document.

Defined results: null text is empty and has only its end id; null doc_id comes first; rows with the same doc_id are
documents of their own, ordered by a hash of the text; an empty table gives no files and no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm import tokens
from lodestar.llm.common import cut, shared_dir

BATCH_SEQUENCES = 512
SHARD_LINES = 256  #: of a file, each a batch
SHARD_NUMBERS = 1_000_000  #: numbers of shards for each task: as many files as Spark lets a task write


def schema(length: int, wide: bool = False) -> pa.Schema:
    return pa.schema([
        ("mask", pa.list_(pa.bool_(), length)),
        ("tokens", pa.list_(pa.uint32() if wide else pa.uint16(), length)),
        ("doc_ids", pa.list_(pa.int64())),
        ("doc_ends", pa.list_(pa.int32())),
        ("n_valid", pa.int32()),
    ])


class _Pieces:
    """A file object that keeps what was written until it is taken."""

    def __init__(self):
        self.data, self.closed, self.at = [], False, 0

    def write(self, b) -> int:
        b = bytes(b)
        self.data.append(b)
        self.at += len(b)
        return len(b)

    def tell(self) -> int:
        return self.at

    def flush(self) -> None:
        pass

    def close(self) -> None:
        self.closed = True

    def take(self) -> bytes:
        out, self.data = b"".join(self.data), []
        return out


class ShardWriter:
    """Turns documents into the bytes of one shard, a piece at a time; no more than a batch and a document is held."""

    def __init__(self, length: int, wide: bool = False):
        self.length, self.schema, self.kind = length, schema(length, wide), np.uint32 if wide else np.uint16
        self.sink = _Pieces()
        self.writer = pa.ipc.new_stream(self.sink, self.schema)
        self.parts: list[np.ndarray] = []
        self.held = self.base = 0  # tokens held; tokens written before
        self.ends: list[tuple[int | None, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[bytes]:
        self.parts.append(ids.astype(self.kind))
        self.held += len(ids)
        self.ends.append((doc_id, self.base + self.held))
        if self.held > self.length * BATCH_SEQUENCES:
            yield from self._flush(last=False)

    def close(self) -> Iterator[bytes]:
        yield from self._flush(last=True)

    def _flush(self, last: bool) -> Iterator[bytes]:
        flat = np.concatenate(self.parts) if self.parts else np.empty(0, self.kind)
        n = -(-len(flat) // self.length) if last else len(flat) // self.length
        for at in range(0, n, BATCH_SEQUENCES):
            yield self._batch(flat[at * self.length : min(n, at + BATCH_SEQUENCES) * self.length])
        rest = flat[n * self.length :]
        self.parts, self.held = [rest], len(rest)
        if last:
            self.writer.close()
            yield self.sink.take()

    def _batch(self, flat: np.ndarray) -> bytes:
        n = -(-len(flat) // self.length)
        full = np.zeros(n * self.length, self.kind)
        full[: len(flat)] = flat
        valid = np.clip(len(flat) - np.arange(n) * self.length, 0, self.length)
        stop = self.base + len(flat)
        k = next((i for i, (_, e) in enumerate(self.ends) if e > stop), len(self.ends))
        done, self.ends = self.ends[:k], self.ends[k:]
        place = np.array([e - 1 - self.base for _, e in done], dtype=np.int64)
        offsets = pa.array(np.searchsorted(place // self.length, np.arange(n + 1)).astype(np.int32))
        self.base = stop
        columns = [
            pa.FixedSizeListArray.from_arrays(pa.array(np.arange(n * self.length) < len(flat)), self.length),
            pa.FixedSizeListArray.from_arrays(pa.array(full), self.length),
            pa.ListArray.from_arrays(offsets, pa.array([d for d, _ in done], pa.int64())),
            pa.ListArray.from_arrays(offsets, pa.array((place % self.length + 1).astype(np.int32))),
            pa.array(valid.astype(np.int32)),
        ]
        self.writer.write_batch(pa.record_batch(columns, schema=self.schema))
        return self.sink.take()


def shard_lines(documents: Iterator[tuple[int | None, np.ndarray]], length: int, wide: bool, lines: int) -> Iterator[bytes]:
    """The bytes of the shards of documents (doc_id, ids), in lines: each shard has as many, the last one as many at most."""
    writer, done, held = None, 0, []
    for doc_id, ids in documents:
        writer = writer or ShardWriter(length, wide)
        for data in writer.add(doc_id, ids):
            if done < lines - 1:
                yield data
                done += 1
            else:
                held.append(data)
        if done == lines - 1:
            yield b"".join([*held, *writer.close()])
            writer, done, held = None, 0, []
    if writer:
        yield b"".join(writer.close())


def _line(data: bytes) -> pa.RecordBatch:
    if data[-1]:
        raise ValueError("a batch does not end in a zero byte")
    return pa.record_batch([pa.array([data[:-1]], pa.binary())], names=["value"])


def write_shards(docs: DataFrame, path: str, vocabulary: str, length: int = 1024, end_id: int = 0, wide: bool = False, lines: int = SHARD_LINES) -> None:
    """Writes the documents (doc_id, text) to path, shards of ranges of doc_id; file names are in order."""
    if lines < 1:
        raise ValueError("a shard has at least one line")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, np.ndarray]]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for doc_id, ids in zip(part.column(0).to_pylist(), tokens.encode(part.column(1).to_pylist(), vocabulary)):
                    yield doc_id, np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(_line, shard_lines(encoded(batches), length, wide, lines))

    ranged = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    rows = ranged.drop("h").mapInArrow(shards, "value binary").select(F.col("value").cast("string"))
    rows.write.option("lineSep", "\0").option("maxRecordsPerFile", lines).text(path)


def open_shard(source) -> list[pa.RecordBatch]:
    """The batches of a shard: source is a path (memory-mapped) or a buffer; columns are views, not copies."""
    stream = pa.memory_map(source) if isinstance(source, str) else pa.BufferReader(source)
    with pa.ipc.open_stream(stream) as reader:
        return list(reader)


def shard_number(path: Column) -> Column:
    """The number of a file in the order of documents, from its task and its place in the task (part-TASK-JOB-cPLACE.txt)."""
    task, place = (F.regexp_extract(path, pattern, 1).cast("long") for pattern in (r"part-(\d+)[^/]*$", r"-c(\d+)\.[^/]*$"))
    return task * SHARD_NUMBERS + place


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """For each document in the shards: shard, doc_id, local_start, n_tokens, ids_crc32."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, content in zip(b.column(0).to_pylist(), b.column(1)):
                out, at, left = [], 0, []
                with pa.ipc.open_stream(pa.BufferReader(content.as_buffer())) as reader:
                    for batch in reader:
                        row = batch.column(1).type.list_size
                        flat = batch.column(1).flatten().to_numpy(zero_copy_only=True)
                        ends = batch.column(3)
                        owner = np.repeat(np.arange(batch.num_rows), ends.value_lengths().to_numpy())
                        start = 0
                        for doc_id, end in zip(batch.column(2).flatten().to_pylist(), (owner * row + ends.flatten().to_numpy()).tolist()):
                            ids = np.concatenate([*left, flat[start:end]]).astype("<u4")
                            out.append((doc_id, at, len(ids), tokens.crc(ids.tobytes())))
                            at, start, left = at + len(ids), end, []
                        left.append(flat[start : int(np.asarray(batch.column(4)).sum())])
                ids, starts, sizes, crcs = map(list, zip(*out)) if out else ([], [], [], [])
                yield pa.record_batch([pa.array([shard] * len(out), pa.int64()), pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], names=["shard", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").load(path)
    return files.select(shard_number(F.col("path")).alias("shard"), "content").mapInArrow(documents, "shard long, doc_id long, local_start long, n_tokens long, ids_crc32 long")


def index(docs: DataFrame, vocabulary: str, length: int = 1024, lines: int = SHARD_LINES) -> DataFrame:
    """Writes docs as shards to the shared folder, reads them back: doc_id, start, n_tokens, ids_crc32, shard, local_start."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/arrow-shards-{uuid.uuid4().hex}"
    write_shards(docs, path, vocabulary, length, lines=lines)
    if not spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(spark._jvm.org.apache.hadoop.fs.Path(path)):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, shard long, local_start long")
    rows = cut(read_documents(spark, path))
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = totals.withColumn("before", F.sum("n").over(Window.orderBy("shard")) - F.col("n")).drop("n")
    return rows.join(before, "shard").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", "shard", "local_start")
