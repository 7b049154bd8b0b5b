"""Embedding near-duplicates by sorted projection passes.

Each pass puts the vectors in lexicographic order of concatenated random hashes (signs of random projections, 64 to a
pass, drawn from a seed) and compares each with its next neighbours in that order. Verified pairs of all passes are united.

What passes find is the components; within a component all vectors are then compared, so that the links of a vector
are counted exactly, pairs included that no window held. A large component is compared by pairs of blocks, each a task.
Equal vectors are one candidate with a count.

The number of passes grows with the number of vectors (`enough_passes`): as many as find an isolated pair at the threshold with
probability RECALL if vectors are spread evenly, never less than PASSES.

Cosines are in double precision; vectors that are null, zero, or hold null or non-finite components link with nothing.

Defined results: vectors of different lengths never link; vec_id null counts as no id when the smallest is looked for
(a component without any id has a null component_id and is not kept); equal rows are rows of their own, linked with
each other; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import components, cut
from lodestar.llm.golay_simhash import forest

PASSES, WINDOW, BLOCK = 16, 32, 1024
RECALL = 0.99


def enough_passes(rows: int, threshold: float, window: int, recall: float = RECALL, least: int = PASSES) -> int:
    """Passes after which a pair at the threshold has shared a window with probability recall.

    Two vectors agree in a bit with probability 1 - angle / pi. About rows / 2^n vectors share the first n bits, so a pair that agrees
    in the first log2(rows / window) bits stands within a window.
    """
    bits = max(0.0, math.log2(max(1, rows) / window))
    once = (1 - math.acos(threshold) / math.pi) ** bits
    return least if once >= 1 else max(least, math.ceil(math.log(1 - recall) / math.log(1 - once)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors in double precision."""
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    scale = np.abs(v).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    v = v / scale
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _by_size(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    sizes = column.value_lengths().to_numpy()
    for dim in np.unique(sizes).tolist():
        yield dim, np.flatnonzero(sizes == dim)


def close_links(vectors: DataFrame, threshold: float, passes: int, window: int, seed: int) -> DataFrame:
    """vectors (cid long, embedding, valid): links (u, v) of close vectors, from all passes."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, at in _by_size(b.column(1)):
                own = b.take(pa.array(at))
                m = _matrix(own.column(1), dim)
                for p in range(passes):
                    planes = np.random.default_rng([seed, p, dim]).standard_normal((dim, 64))
                    bits = np.packbits(m @ planes > 0, axis=1)
                    key = pa.array([x.tobytes() for x in bits], pa.binary())
                    yield pa.record_batch([pa.array(np.full(len(at), p, np.int32)), pa.array(np.full(len(at), dim, np.int32)), key, own.column(0), own.column(1)], names=["p", "dim", "key", "cid", "embedding"])

    rows = vectors.select("cid", "embedding").mapInArrow(keyed, f"p int, dim int, key binary, cid long, embedding {vectors.schema['embedding'].dataType.simpleString()}")
    ordered = rows.repartitionByRange("p", "dim", "key", "cid").sortWithinPartitions("p", "dim", "key", "cid")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for b in batches:
            tail = pa.Table.from_batches([b]) if tail is None else pa.concat_tables([tail, pa.Table.from_batches([b])])
            t = tail.combine_chunks()
            p, dims, cid = (np.asarray(t.column(n)) for n in ("p", "dim", "cid"))
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                m = _matrix(t.column("embedding").combine_chunks().take(pa.array(at)), dim)
                turn, ids, n = p[at], cid[at], len(at)
                a, b_ = [], []
                for step in range(1, min(window, n - 1) + 1):
                    hit = np.flatnonzero((turn[:-step] == turn[step:]) & (np.einsum("ij,ij->i", m[:-step], m[step:]) >= threshold))
                    a.append(hit)
                    b_.append(hit + step)
                if not a:
                    continue
                label = forest(n, np.concatenate(a), np.concatenate(b_))
                some = label != np.arange(n)
                if some.any():
                    yield pa.record_batch([pa.array(ids[some]), pa.array(ids[label[some]])], names=["u", "v"])
            tail = t.slice(max(0, t.num_rows - window))

    return ordered.mapInArrow(compare, "u long, v long").where("u <> v")


def count_links(members: DataFrame, threshold: float, block: int) -> DataFrame:
    """members (component, cid, n, embedding): (cid, others), the rows of other vectors with a link to cid.

    Blocks of a component are dealt by hash; a vector stands in one task for each block of its component.
    """
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    many = members.join(sizes, "component").withColumn("nb", F.ceil(F.col("size") / block).cast("int"))
    mine = F.pmod(F.xxhash64("cid"), F.col("nb")).cast("int")
    spread = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda j: F.struct(F.least(mine, j).alias("i"), F.greatest(mine, j).alias("j")))
    dealt = many.withColumn("own", mine).withColumn("at", F.explode(spread))
    dealt = dealt.select("component", F.col("at.i").alias("i"), F.col("at.j").alias("j"), "own", "cid", "n", "embedding")

    def compare(table):
        m = _matrix(table.column("embedding").combine_chunks(), len(table.column("embedding")[0]))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        own, n = np.asarray(table.column("own")), np.asarray(table.column("n")).astype(np.int64)
        hit = m @ m.T >= threshold
        np.fill_diagonal(hit, False)
        if i != j:
            hit &= own[:, None] != own[None, :]
        return pa.table({"cid": table.column("cid"), "others": pa.array(hit @ n)})

    pairs = dealt.groupBy("component", "i", "j").applyInArrow(compare, "cid long, others long")
    return pairs.groupBy("cid").agg(F.sum("others").alias("others"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, passes: int | None = None, window: int = WINDOW, block: int = BLOCK, seed: int = 11) -> DataFrame:
    """vectors (vec_id, embedding array): vec_id, n_links, component_id, kept, a row for each row. Without a number of passes, there are enough."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = e.isNotNull() & finite & F.exists(e, lambda x: x != 0)
    rows = vectors.select("vec_id", "embedding", F.coalesce(good, F.lit(False)).alias("good"))
    # -0.0 and 0.0 are the same component
    classes = rows.where("good").withColumn("embedding", F.transform("embedding", lambda x: x + 0)).groupBy("embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()))
    passes = passes or enough_passes(classes.count(), threshold, window)
    comps = cut(components(close_links(classes, threshold, passes, window, seed)).select(F.col("id").alias("cid"), "component"))
    members = classes.join(comps, "cid")
    others = count_links(members.select("component", "cid", "n", "embedding"), threshold, block)
    first = members.groupBy("component").agg(F.min("least").alias("first"))
    known = comps.join(others, "cid").join(first, "component").select("cid", "others", "first")
    done = classes.join(known, "cid", "left").select("embedding", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.when(F.col("others").isNull(), F.col("least")).otherwise(F.col("first")).alias("component_id"))
    linked = rows.where("good").withColumn("embedding", F.transform("embedding", lambda x: x + 0)).join(done, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
