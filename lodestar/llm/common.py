"""What several of the operators need: lineage cuts, reading tables, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: rows and bytes of an Arrow batch between Spark and Python; texts are long, and a worker holds a batch whole
BATCH_ROWS, BATCH_BYTES = 1000, 16_000_000
BROADCAST_EDGES = 500_000  #: edges of a graph up to which its nodes' minima (two longs each, at most 32 MB) are broadcast
AT_ONCE = 500_000  #: edges (8 MB) that one task joins to components, where an operator asks for that


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches for rows with texts, unless it has limits of its own."""
    for key, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(name, None) in (None, "10000", str(2**63 - 1), "-1"):  # not set: Spark's defaults
            spark.conf.set(name, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where that is unset, as in tests, a temporary one."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="lodestar-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder, with its lineage cut. Lost executors do not matter to later reads."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """df as a Parquet table of the shared folder, and its path: smaller than a checkpoint, to be removed when it has served."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _at_once(edges: DataFrame) -> DataFrame:
    """components of few edges: one task joins the spanning forests of the partitions."""
    from lodestar.llm.golay_simhash import forest

    def joined(names: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) for b in batches if b.num_rows]
            if held:
                ids, place = np.unique(np.concatenate(held, axis=1), return_inverse=True)
                u, v = place.reshape(2, -1)
                yield pa.record_batch([pa.array(ids), pa.array(ids[forest(len(ids), u, v)])], names=names)

        return run

    return cut(edges.mapInArrow(joined(["u", "v"]), "u long, v long").repartition(1).mapInArrow(joined(["id", "component"]), "id long, component long"))


def components(edges: DataFrame, at_once: int = 0, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (u long, v long): a row (id, component) for each id with an edge, component the smallest id.

    Alternates two contractions (each node's larger neighbours, then its smaller ones, move to the smallest it
    knows) until the edges are stars. Only minima are grouped, so a hub is pre-aggregated before each shuffle; the
    minima are broadcast for up to BROADCAST_EDGES edges, so that a hub's edges stay where they are. Beyond, the joins
    have one row for each key on one side, and adaptive execution may split the other.
    Null ids and loops are left out; no edges give no rows. Up to at_once edges are joined by one task, without rounds.
    """
    pairs = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v")
    now = cut(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    n = now.count()
    if n <= at_once:
        return _at_once(now)
    few = n <= BROADCAST_EDGES  # a node has a row of minima; rounds add no nodes
    side = F.broadcast if few else lambda df: df
    seen = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(side(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(side(least), "u")
        small = moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = cut(small)
        stamp = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if stamp == seen:
            break
        seen = stamp
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
