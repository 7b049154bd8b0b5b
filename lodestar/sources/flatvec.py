"""Flat binary vector files as a Spark data source, "flatvec".

A file is two little-endian 32-bit integers, rows and dimensions, then the rows one after another as 32-bit floats or
integers. A row's position is its id. Options: path, dtype (float32 or int32), rows_per_partition.

Reading splits a file into ranges of rows, each a task that seeks to its place. Writing (by `write_vectors`) puts the part of each
task at its place in one file, so rows are ordered by id first and ids become positions. Both go through the local
file interface; the path has to be one that all executors see.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

HEAD, HEAD_BYTES = "<ii", 8
KINDS = {"float32": ("<f4", "float"), "int32": ("<i4", "int")}
BATCH = 4096


def header(path: str, itemsize: int = 4) -> tuple[int, int]:
    """(rows, dimensions); ValueError if the header is short, a number is not positive or the body is too short."""
    with open(path, "rb") as f:
        head = f.read(HEAD_BYTES)
    if len(head) < HEAD_BYTES:
        raise ValueError(f"{path}: short header")
    n, dim = struct.unpack(HEAD, head)
    if n <= 0 or dim <= 0:
        raise ValueError(f"{path}: {n} rows of {dim} dimensions")
    if os.path.getsize(path) < HEAD_BYTES + n * dim * itemsize:
        raise ValueError(f"{path}: the body is shorter than {n} x {dim}")
    return n, dim


class Rows(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class FlatVectorReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.kind = options["path"], options.get("dtype", "float32")
        self.step = int(options.get("rows_per_partition", 100_000))
        if self.kind not in KINDS:
            raise ValueError(f"dtype {self.kind}")
        self.n, self.dim = header(self.path)

    def partitions(self):
        return [Rows(at, min(self.n, at + self.step)) for at in range(0, self.n, self.step)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        code, _ = KINDS[self.kind]
        with open(self.path, "rb") as f:
            f.seek(HEAD_BYTES + partition.start * self.dim * 4)
            for at in range(partition.start, partition.stop, BATCH):
                n = min(BATCH, partition.stop - at)
                flat = np.frombuffer(f.read(n * self.dim * 4), code)
                offsets = np.arange(0, (n + 1) * self.dim, self.dim, dtype=np.int32)
                yield pa.record_batch([pa.array(np.arange(at, at + n)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["vec_id", "embedding"])


class FlatVectorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "flatvec"

    def schema(self) -> str:
        return f"vec_id bigint, embedding array<{KINDS[self.options.get('dtype', 'float32')][1]}>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return FlatVectorReader(self.options)


def read_vectors(spark: SparkSession, path: str, dtype: str = "float32", rows_per_partition: int = 100_000) -> DataFrame:
    """vec_id (position), embedding."""
    spark.dataSource.register(FlatVectorSource)
    return spark.read.format("flatvec").option("dtype", dtype).option("rows_per_partition", rows_per_partition).load(path)


def read_groundtruth(spark: SparkSession, path: str) -> DataFrame:
    """qid (position), rk (from 1), vec_id: true neighbours, nearest first, from a file of integers."""
    rows = read_vectors(spark, path, "int32").select(F.col("vec_id").alias("qid"), F.posexplode("embedding").alias("p", "v"))
    return rows.select("qid", (F.col("p") + 1).alias("rk"), F.col("v").cast("long").alias("vec_id"))


def write_vectors(vectors: DataFrame, path: str, dtype: str = "float32") -> None:
    """Writes vectors (vec_id, embedding) in ascending vec_id. ValueError for none, or for vectors of different lengths.

    Rows of a task are consecutive in the order of vec_id. What stands before a task is known from the number of ids in
    each range, so each task writes its rows at their place; done again after a loss, it writes the same bytes.
    """
    code, _ = KINDS[dtype]
    rows = vectors.select("vec_id", "embedding").where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    total, low, high = rows.agg(F.count("*"), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if not total or low != high:
        raise ValueError("vectors have different lengths" if total else "no vectors")
    n = max(1, -(-total // 1_000_000))
    edges = rows.approxQuantile("vec_id", [i / n for i in range(1, n)], 0.01) if n > 1 else []  # a number for each million rows
    part = F.lit(0)
    for e in edges:
        part = part + (F.col("vec_id") > F.lit(e)).cast("int")
    cut = rows.withColumn("_p", part)
    counts = {r["_p"]: r["count"] for r in cut.groupBy("_p").count().collect()}
    starts, at = {}, 0
    for k in sorted(counts):
        starts[k], at = at, at + counts[k]
    with open(path, "wb") as f:
        f.write(struct.pack(HEAD, total, low))
        f.truncate(HEAD_BYTES + total * low * 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = dict(starts)
        with open(path, "r+b") as f:
            for b in batches:
                parts = np.asarray(b.column(0))
                for k in np.unique(parts).tolist():
                    own = b.filter(pa.array(parts == k))
                    f.seek(HEAD_BYTES + place[k] * low * 4)
                    f.write(own.column(2).flatten().to_numpy(zero_copy_only=False).astype(code).tobytes())
                    place[k] += own.num_rows
                yield pa.record_batch([pa.array([b.num_rows])], names=["n"])

    dealt = cut.repartition(n, "_p").sortWithinPartitions("_p", "vec_id").select("_p", "vec_id", "embedding")
    written = dealt.mapInArrow(run, "n long").agg(F.sum("n")).first()[0]
    if written != total:
        raise RuntimeError(f"wrote {written} of {total} rows")
