"""K-means and the inverted-file index.

Centroids (nlist x dim) live on the driver between rounds: their size is a parameter, not the data's. A round is one
pass over the vectors; each task sends one partial sum for each centroid. Vectors never move in a build.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.vectors import distances, matrix

CELLS = 4_000_000  #: rows of a batch times centroids held at once by the distance kernel
FILE_ROWS = 250_000  #: vectors of a file of a saved index
HEAD_ROWS = 1_000_000  #: ids of heads (12 bytes each) up to which they are broadcast


def finite(column: str) -> Column:
    """Whether the vector is there and all its elements are numbers: none null, NaN or infinite."""
    return F.coalesce(F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def valid(vectors: DataFrame) -> DataFrame:
    """Vectors that can be searched: vec_id is there and the embedding is finite. Others are left out, further columns dropped."""
    return vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & finite("embedding"))


def dimension(vectors: DataFrame) -> int:
    """The common length of all vectors; 0 without any. ValueError if lengths differ or an element is null."""
    size, holes = F.size("embedding"), F.exists("embedding", lambda x: x.isNull())
    low, high, bad = vectors.agg(F.min(size), F.max(size), F.bool_or(holes)).first()
    if low != high or bad:
        raise ValueError(f"vectors of {low} to {high} dimensions" + ", some with null elements" * bool(bad))
    return low or 0


def init_centroids(base: DataFrame, nlist: int, seed: int = 42) -> np.ndarray:
    """The first nlist vectors by a seeded hash of vec_id, all different rows; fewer if there are fewer vectors."""
    if nlist < 1:
        raise ValueError("nlist must be at least 1")
    picked = base.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string"))), "vec_id").limit(nlist).collect()
    return np.array([r["embedding"] for r in picked], np.float64) if picked else np.empty((0, 0))


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cid, squared distance) of the nearest centroid of each row; the lowest cid of equals."""
    cid, dist, step = np.empty(len(x), np.int32), np.empty(len(x)), max(1, CELLS // len(centroids))
    for at in range(0, len(x), step):
        d = distances(x[at : at + step], centroids)
        cid[at : at + step], dist[at : at + step] = d.argmin(axis=0), d.min(axis=0)
    return cid, dist


def assign(base: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cid, cdist, embedding: each vector with its nearest centroid."""
    if not len(centroids):
        return base.select("vec_id", F.lit(0).alias("cid"), F.lit(0.0).alias("cdist"), "embedding").limit(0)
    shared = base.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cid, dist = _nearest(matrix(b.column(1)), shared.value)
                yield pa.record_batch([b.column(0), pa.array(cid), pa.array(dist), b.column(1)], names=["vec_id", "cid", "cdist", "embedding"])

    kind = base.schema["embedding"].dataType.simpleString()
    return base.select("vec_id", "embedding").mapInArrow(run, f"vec_id long, cid int, cdist double, embedding {kind}")


def update(base: DataFrame, centroids: np.ndarray, turn: int, seed: int = 42) -> np.ndarray:
    """Centroids of the next round: means of their vectors. A centroid without vectors becomes the vector that comes
    first by a hash of round, cid and vec_id.
    """
    shared, n = base.sparkSession.sparkContext.broadcast(centroids), len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros_like(shared.value), np.zeros(n, np.int64)
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0))
                cid, _ = _nearest(x, shared.value)
                np.add.at(sums, cid, x)
                counts += np.bincount(cid, minlength=n)
        some = np.flatnonzero(counts)
        if len(some):
            yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(counts[some]), pa.array(list(sums[some]), pa.list_(pa.float64()))], names=["cid", "n", "s"])

    parts = base.select("embedding").mapInArrow(run, "cid int, n long, s array<double>")
    sums = parts.select("cid", "n", F.posexplode("s").alias("j", "x")).groupBy("cid", "j").agg((F.sum("x") / F.sum("n")).alias("m"))
    out, seen = centroids.copy(), np.zeros(n, bool)
    for r in sums.collect():  # nlist x dim numbers
        out[r["cid"], r["j"]], seen[r["cid"]] = r["m"], True
    for cid in np.flatnonzero(~seen).tolist():
        order = F.md5(F.concat(F.lit(f"{seed}:{turn}:{cid}:"), F.col("vec_id").cast("string")))
        out[cid] = np.array(base.orderBy(order, "vec_id").first()["embedding"], np.float64)
    return out


@dataclass
class IvfIndex:
    """centroids: (nlist, dim). lists: vec_id, cid, cdist, embedding, a row for each vector."""

    centroids: np.ndarray
    lists: DataFrame

    @property
    def nlist(self) -> int:
        return len(self.centroids)

    @property
    def dim(self) -> int:
        return self.centroids.shape[1] if len(self.centroids) else 0

    def centroid_table(self) -> DataFrame:
        rows = [(i, [float(v) for v in c]) for i, c in enumerate(self.centroids)]
        return self.lists.sparkSession.createDataFrame(rows, "cid int, centroid array<double>")

    def sizes(self) -> DataFrame:
        """cid, size of all clusters, empty ones as 0."""
        counted = self.lists.groupBy("cid").agg(F.count("*").alias("size"))
        every = self.lists.sparkSession.range(self.nlist).select(F.col("id").cast("int").alias("cid"))
        return every.join(counted, "cid", "left").select("cid", F.coalesce("size", F.lit(0)).alias("size"))

    def inverted_lists(self) -> DataFrame:
        """cid, vec_ids in ascending order. One row holds a cluster's ids; searches use `lists`."""
        return self.lists.groupBy("cid").agg(F.sort_array(F.collect_list("vec_id")).alias("vec_ids"))

    def heads(self, count: int) -> DataFrame:
        """The first `count` vectors of each cluster by vec_id: vec_id, cid, list_pos, embedding. Only ids are ranked; vectors stay
        where they are. Rows with the same id have its first place.
        """
        ids = self._first_ids(count).groupBy("cid", "vec_id").agg(F.min("list_pos").alias("list_pos"))
        few = self.nlist * count <= HEAD_ROWS
        return self.lists.join(F.broadcast(ids) if few else ids, ["cid", "vec_id"]).select("vec_id", "cid", "list_pos", "embedding")

    def head_ends(self, count: int) -> dict[int, int]:
        """The last id of the first `count` vectors of each cluster: a number for each cluster that has any."""
        return {r["cid"]: r["last"] for r in self._first_ids(count).groupBy("cid").agg(F.max("vec_id").alias("last")).collect()}

    def _first_ids(self, count: int) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("cid").orderBy("vec_id"))
        return self.lists.select("cid", "vec_id").withColumn("list_pos", place).where(F.col("list_pos") <= count)

    def save(self, path: str) -> None:
        """Lists partitioned by cluster, so a search reads the probed ones only; a cluster has a file for each FILE_ROWS vectors."""
        files = self.sizes().select("cid", F.ceil(F.col("size") / FILE_ROWS).cast("int").alias("_f"))
        dealt = self.lists.join(F.broadcast(files), "cid").withColumn("_f", F.pmod(F.xxhash64("vec_id"), "_f"))  # a row for each cluster
        dealt.repartition("cid", "_f").drop("_f").write.mode("overwrite").partitionBy("cid").parquet(f"{path}/lists")
        self.centroid_table().coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")

    @staticmethod
    def load(spark: SparkSession, path: str) -> IvfIndex:
        rows = spark.read.parquet(f"{path}/centroids").orderBy("cid").collect()
        lists = spark.read.schema("vec_id long, cdist double, embedding array<float>, cid int").parquet(f"{path}/lists").select("vec_id", "cid", "cdist", "embedding")
        return IvfIndex(np.array([r["centroid"] for r in rows]), lists)


def train(base: DataFrame, nlist: int = 256, iters: int = 10, seed: int = 42) -> np.ndarray:
    centroids = init_centroids(base, nlist, seed)
    for turn in range(iters if len(centroids) else 0):
        centroids = update(base, centroids, turn, seed)
    return centroids


def build_index(vectors: DataFrame, nlist: int = 256, iters: int = 10, seed: int = 42) -> IvfIndex:
    base = valid(vectors)
    dimension(base)
    centroids = train(base, nlist, iters, seed)
    return IvfIndex(centroids, assign(base, centroids))
