"""Nearest-neighbour search for whole sets of queries.

Queries go to the vectors, not the other way round: a block of queries of bounded size is broadcast, every task keeps
the k best for each query, and only these are shuffled. More queries take more blocks.

Ties go to the lower id everywhere. Fewer than k candidates give fewer rows. Queries with the same qid count once: the first by
the order of vectors.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.vectors import distances, matrix, pair_distances, slice_bounds
from lodestar.operators.kmeans import IvfIndex, dimension, valid
from lodestar.sources.shared import shared_folder

QUERY_CELLS = 8_000_000  #: numbers of a block of queries, 64 MB in double precision
CELLS = 4_000_000  #: distances held at once
SLACK = 1 + 1e-9  #: sums of slices may differ from whole sums in the last digits
RESULT = "qid long, vec_id long, dist double"


def _need(**least: int) -> None:
    for name, value in least.items():
        if value < 1:
            raise ValueError(f"{name} must be at least 1")


def query_set(vectors: DataFrame) -> DataFrame:
    """vectors (vec_id, embedding) as queries (qid, qv); null ones and those that aren't finite are no queries."""
    return valid(vectors).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))


def first_queries(queries: DataFrame, nq: int) -> DataFrame:
    """The first nq queries by qid; all if there are fewer."""
    return queries.orderBy("qid").limit(nq)


def _blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of blocks of queries in the order of qid, none larger than QUERY_CELLS."""
    ids, rows, size = [], [], 0
    last = None
    for r in queries.select("qid", "qv").orderBy("qid", "qv").toLocalIterator(prefetchPartitions=True):
        if r["qid"] == last:
            continue
        last = r["qid"]
        ids.append(r["qid"])
        rows.append(r["qv"])
        size += len(r["qv"])
        if size >= QUERY_CELLS:
            yield np.array(ids, np.int64), np.array(rows, np.float64)
            ids, rows, size = [], [], 0
    if ids:
        yield np.array(ids, np.int64), np.array(rows, np.float64)


class TopK:
    """The k best (distance, id) for each of n queries."""

    def __init__(self, n: int, k: int):
        self.k, self.dist, self.ids = k, [np.empty(0)] * n, [np.empty(0, np.int64)] * n

    def add(self, q: int, dist: np.ndarray, ids: np.ndarray) -> None:
        if len(self.dist[q]) == self.k:
            near = dist <= self.dist[q][-1]
            dist, ids = dist[near], ids[near]
        if not len(dist):
            return
        dist, ids = np.concatenate([self.dist[q], dist]), np.concatenate([self.ids[q], ids])
        if len(dist) > 4 * self.k:
            cut = np.partition(dist, self.k - 1)[self.k - 1]
            dist, ids = dist[dist <= cut], ids[dist <= cut]
        order = np.lexsort((ids, dist))[: self.k]
        self.dist[q], self.ids[q] = dist[order], ids[order]

    def worst(self, q: int) -> float:
        return self.dist[q][-1] if len(self.dist[q]) == self.k else np.inf

    def rows(self, qids: np.ndarray) -> pa.RecordBatch:
        count = [len(d) for d in self.dist]
        return pa.record_batch([pa.array(np.repeat(qids, count)), pa.array(np.concatenate(self.ids)), pa.array(np.concatenate(self.dist))], names=["qid", "vec_id", "dist"])


def top_k(candidates: DataFrame, k: int, by: str = "qid", dist: str = "dist", tie: str = "vec_id", rank: str = "rk") -> DataFrame:
    """The k rows of each group with the least distance, ranked from 1. Spark limits groups before it shuffles, too."""
    order = Window.partitionBy(by).orderBy(dist, tie)
    return candidates.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def exact_knn(base: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """qid, rk, vec_id, dist over all vectors."""
    _need(k=k)
    found = None
    for qids, q in _blocks(queries):
        shared = base.sparkSession.sparkContext.broadcast((qids, q))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qids, q = shared.value
            best, step = TopK(len(qids), k), max(1, CELLS // len(qids))
            for b in batches:
                for at in range(0, b.num_rows, step):
                    part = b.slice(at, step)
                    d, ids = distances(matrix(part.column(1)), q), np.asarray(part.column(0))
                    for i in range(len(qids)):
                        best.add(i, d[i], ids)
            yield best.rows(qids)

        part = base.select("vec_id", "embedding").mapInArrow(run, RESULT)
        found = part if found is None else found.unionByName(part)
    return top_k(found if found is not None else _none(base), k).select("qid", "rk", "vec_id", "dist")


def _none(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], RESULT)


def _nearest(q: np.ndarray, centroids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(clusters, distances) of the n nearest clusters of each query."""
    d = distances(q, centroids).T
    near = np.argsort(d, axis=1, kind="stable")[:, :n]
    return near, np.take_along_axis(d, near, axis=1)


def nearest_clusters(queries: DataFrame, index: IvfIndex, nprobe: int) -> DataFrame:
    """qid, prank (from 1), cid, cdist of the nprobe nearest clusters; all if there are fewer."""
    _need(nprobe=nprobe)
    if not index.nlist:
        return queries.sparkSession.createDataFrame([], "qid long, prank int, cid int, cdist double")
    shared = queries.sparkSession.sparkContext.broadcast(index.centroids)
    n = min(nprobe, index.nlist)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, max(1, CELLS // len(shared.value))):
                part = b.slice(at, max(1, CELLS // len(shared.value)))
                near, d = _nearest(matrix(part.column(1)), shared.value, n)
                yield pa.record_batch([pa.array(np.repeat(np.asarray(part.column(0)), n)), pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(near))), pa.array(near.ravel().astype(np.int32)), pa.array(d.ravel())], names=["qid", "prank", "cid", "cdist"])

    return queries.select("qid", "qv").mapInArrow(run, "qid long, prank int, cid int, cdist double")


def _probes(q: np.ndarray, index: IvfIndex, nprobe: int) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """The places in q of the queries that probe each cluster, and the nearest cluster of each query."""
    probed, nearest = defaultdict(list), np.full(len(q), -1)
    if index.nlist:
        for at in range(0, len(q), step := max(1, CELLS // index.nlist)):
            near = _nearest(q[at : at + step], index.centroids, min(nprobe, index.nlist))[0]
            nearest[at : at + step] = near[:, 0]
            for i, cids in enumerate(near.tolist(), at):
                for cid in cids:
                    probed[cid].append(i)
    return {c: np.array(v) for c, v in probed.items()}, nearest


def _by_cluster(batches: Iterator[pa.RecordBatch], probed: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(cid, ids, vectors) of batches (cid, vec_id, embedding), no more at once than CELLS pairs with the queries of the cluster."""
    for b in batches:
        cids = np.asarray(b.column(0))
        for c in np.unique(cids).tolist():
            at, step = np.flatnonzero(cids == c), max(1, CELLS // len(probed[c]))
            for lo in range(0, len(at), step):
                rows = b.take(pa.array(at[lo : lo + step]))
                yield c, np.asarray(rows.column(1)), matrix(rows.column(2))


def _seeded(c: int, ids: np.ndarray, nearest: np.ndarray, ends: dict[int, int]) -> np.ndarray:
    """(queries, vectors): whether a vector of cluster c is a seed of the query; nearest is the queries' nearest cluster."""
    if c not in ends:
        return np.zeros((len(nearest), len(ids)), bool)
    return (nearest == c)[:, None] & (ids <= ends[c])[None, :]


def ivf_search(index: IvfIndex, queries: DataFrame, nprobe: int, k: int, tau: DataFrame | None = None, b_dim: int = 1, abandon: bool = True, ends: dict[int, int] | None = None) -> DataFrame:
    """qid, rk, vec_id, dist over the vectors of the nprobe nearest clusters.

    With b_dim > 1, distances add up slice by slice, and a candidate is dropped once its sum is above its query's
    threshold: the least of tau (qid, tau) and the k-th distance met in the task, or never, if told not to abandon any. The
    result is the same. Seeds, which are vectors of the query's nearest cluster with an id up to the cluster's in ends, are
    skipped: the caller adds theirs.
    """
    _need(nprobe=nprobe, k=k, b_dim=b_dim)
    bounds, ends = slice_bounds(index.dim, b_dim), ends or {}
    found = None
    limits = {r["qid"]: r["tau"] for r in tau.collect()} if tau is not None else {}  # a number for each query
    for qids, q in _blocks(queries):
        probed, nearest = _probes(q, index, nprobe)
        start = np.array([limits.get(v, np.inf) for v in qids.tolist()])
        shared = queries.sparkSession.sparkContext.broadcast((qids, q, probed, nearest, start))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qids, q, probed, nearest, start = shared.value
            best = TopK(len(qids), k)
            for c, ids, x in _by_cluster(batches, probed):
                _scan(x, ids, q, probed[c], start, best, _seeded(c, ids, nearest[probed[c]], ends))
            yield best.rows(qids)

        def _scan(x, ids, q, who, start, best, known) -> None:
            if len(bounds) == 1:
                d = distances(x, q[who])
                for i, w in enumerate(who.tolist()):
                    new = ~known[i]
                    best.add(w, d[i][new], ids[new])
                return
            limit = np.array([min(start[w], best.worst(w)) if abandon else np.inf for w in who.tolist()]) * SLACK
            mine = q[who]
            first = distances(x, mine, *bounds[0])
            i, j = np.nonzero((first <= limit[:, None]) & ~known)
            sums = first[i, j]
            for lo, hi in bounds[1:]:
                sums = pair_distances(x, mine, lo, hi, sums, j, i)
                alive = sums <= limit[i]
                i, j, sums = i[alive], j[alive], sums[alive]
            cuts = np.searchsorted(i, np.arange(len(who) + 1))
            for n, w in enumerate(who.tolist()):
                best.add(w, sums[cuts[n] : cuts[n + 1]], ids[j[cuts[n] : cuts[n + 1]]])

        lists = index.lists.where(F.col("cid").isin([int(c) for c in probed])).select("cid", "vec_id", "embedding")
        part = lists.mapInArrow(run, RESULT)
        found = part if found is None else found.unionByName(part)
    return top_k(found if found is not None else _none(queries), k).select("qid", "rk", "vec_id", "dist")


def prewarm_seeds(index: IvfIndex, queries: DataFrame, prewarm: int) -> DataFrame:
    """qid, cid, list_pos, vec_id, dist: the first `prewarm` vectors, by vec_id, of each query's nearest cluster."""
    from lodestar.functions.vectors import l2_squared

    nearest = nearest_clusters(queries, index, 1).select("qid", "cid").join(queries, "qid")
    return nearest.join(index.heads(prewarm), "cid").select("qid", "cid", "list_pos", "vec_id", l2_squared(F.col("embedding"), F.col("qv")).alias("dist"))


def prewarm_tau(index: IvfIndex, queries: DataFrame, prewarm: int, k: int) -> DataFrame:
    """qid, tau: the k-th distance of the seeds, infinity with fewer than k seeds (or none at all)."""
    _need(k=k)
    ranked = top_k(prewarm_seeds(index, queries, prewarm), k) if prewarm > 0 else prewarm_seeds(index, queries, 0).withColumn("rk", F.lit(0))
    kth = ranked.where(F.col("rk") == k).select("qid", F.col("dist").alias("tau"))
    return queries.select("qid").join(kth, "qid", "left").select("qid", F.coalesce("tau", F.lit(float("inf"))).alias("tau"))


def ivf_search_pruned(index: IvfIndex, queries: DataFrame, nprobe: int, k: int, prewarm: int = 500, b_dim: int = 4, pruning: bool = True) -> DataFrame:
    """ivf_search with thresholds from seeds and early abandoning; without pruning, slices add up and nothing is dropped early.

    The k best seeds of each query are found once and written to the shared folder: they give the thresholds and are part of the result,
    and the search skips all seeds.
    """
    _need(nprobe=nprobe, k=k, b_dim=b_dim)
    if not pruning:
        return ivf_search(index, queries, nprobe, k, b_dim=b_dim, abandon=False)
    if prewarm < 1:
        return ivf_search(index, queries, nprobe, k, b_dim=b_dim)
    ends = index.head_ends(prewarm)
    seeds = _cut(nearest_seeds(index, queries, k, ends))
    rest = ivf_search(index, queries, nprobe, k, _kth(seeds, k), b_dim, ends=ends)
    return top_k(rest.unionByName(seeds).drop("rk"), k).select("qid", "rk", "vec_id", "dist")


def nearest_seeds(index: IvfIndex, queries: DataFrame, k: int, ends: dict[int, int]) -> DataFrame:
    """qid, rk, vec_id, dist: the k best seeds of each query. Seeds are the vectors of its nearest cluster up to the id in ends."""
    last = F.create_map(*[F.lit(v) for pair in ends.items() for v in pair]) if ends else F.create_map().cast("map<int,long>")
    heads = index.lists.where(F.col("vec_id") <= F.element_at(last, F.col("cid")))
    return ivf_search(IvfIndex(index.centroids, heads), queries, 1, k)


def _kth(seeds: DataFrame, k: int) -> DataFrame:
    return seeds.where(F.col("rk") == k).select("qid", F.col("dist").alias("tau"))


def _cut(df: DataFrame) -> DataFrame:
    """df, written to the folder that driver and executors share."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stage_counts(index: IvfIndex, queries: DataFrame, nprobe: int, k: int, prewarm: int, b_dim: int, pruning: bool = True) -> DataFrame:
    """cid, seeded, stages, n: how many candidates of each cluster stage_depth gives that number of slices, on the same thresholds.

    Queries are broadcast in blocks; a task counts in its kernel and sends a row for each cluster and number of slices.
    """
    _need(nprobe=nprobe, k=k, b_dim=b_dim)
    bounds = slice_bounds(index.dim, b_dim)
    ends = index.head_ends(prewarm) if prewarm > 0 else {}
    tau = _kth(nearest_seeds(index, queries, k, ends), k) if ends and pruning else None
    limits = {r["qid"]: r["tau"] for r in tau.collect()} if tau is not None else {}  # a number for each query
    kind, found = "cid int, seeded boolean, stages int, n long", None
    for qids, q in _blocks(queries):
        probed, nearest = _probes(q, index, nprobe)
        limit = np.array([limits.get(v, np.inf) for v in qids.tolist()]) * SLACK
        shared = queries.sparkSession.sparkContext.broadcast((q, probed, nearest, limit))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q, probed, nearest, limit = shared.value
            counts = {}
            for c, ids, x in _by_cluster(batches, probed):
                who = probed[c]
                known, mine, most = _seeded(c, ids, nearest[who], ends), q[who], limit[who]
                here = counts.setdefault(c, np.zeros(b_dim + 1, np.int64))
                here[0] += int(known.sum())
                i, j = np.nonzero(~known)
                sums = np.zeros(len(i))
                for stage, (lo, hi) in enumerate(bounds, 1):
                    sums = pair_distances(x, mine, lo, hi, sums, j, i)
                    alive = sums <= most[i] if stage < b_dim else np.zeros(len(i), bool)
                    here[stage] += len(i) - int(alive.sum())
                    i, j, sums = i[alive], j[alive], sums[alive]
            rows = [(c, s == 0, s, int(n)) for c, here in counts.items() for s, n in enumerate(here.tolist()) if n]
            if rows:
                yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*rows), (pa.int32(), pa.bool_(), pa.int32(), pa.int64()))], names=["cid", "seeded", "stages", "n"])

        lists = index.lists.where(F.col("cid").isin([int(c) for c in probed])).select("cid", "vec_id", "embedding")
        part = lists.mapInArrow(run, kind)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return queries.sparkSession.createDataFrame([], kind)
    return found.groupBy("cid", "seeded", "stages").agg(F.sum("n").alias("n"))


def stage_depth(index: IvfIndex, queries: DataFrame, nprobe: int, k: int, prewarm: int, b_dim: int, pruning: bool = True) -> DataFrame:
    """qid, cid, vec_id, seeded, stages: for each candidate of the probed clusters how many slices it is summed over with the
    fixed threshold of the seeds. Seeds, whose distance is known already, have 0. A row for each candidate, for a few queries;
    stage_counts counts without such rows.
    """
    _need(nprobe=nprobe, k=k, b_dim=b_dim)
    bounds = slice_bounds(index.dim, b_dim)
    tau = prewarm_tau(index, queries, prewarm if pruning else 0, k)
    probes = nearest_clusters(queries, index, nprobe).join(tau, "qid").join(queries, "qid").drop("cdist")
    place = index.heads(prewarm).select("vec_id", F.col("cid").alias("hc")) if prewarm > 0 else None
    c = probes.join(index.lists.select("cid", "vec_id", "embedding"), "cid")
    c = c.join(place, "vec_id", "left") if place is not None else c.withColumn("hc", F.lit(None).cast("int"))
    kernel = _depth_kernel(bounds)
    rows = c.select("qid", "cid", "vec_id", ((F.col("prank") == 1) & F.col("hc").isNotNull()).alias("seeded"), "tau", "qv", "embedding")
    return rows.mapInArrow(kernel, "qid long, cid int, vec_id long, seeded boolean, stages int")


def _depth_kernel(bounds: list[tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            tau, q, x = np.asarray(b.column(4)), matrix(b.column(5)), matrix(b.column(6))
            seeded = b.column(3).to_numpy(zero_copy_only=False).astype(bool)
            stages, sums, alive = np.zeros(len(x), np.int32), np.zeros(len(x)), np.flatnonzero(~seeded)
            for lo, hi in bounds:
                stages[alive] += 1
                sums[alive] = pair_distances(x, q, lo, hi, sums[alive], alive, alive)
                alive = alive[sums[alive] <= tau[alive] * SLACK]
            yield pa.record_batch([*b.columns[:4], pa.array(stages)], names=["qid", "cid", "vec_id", "seeded", "stages"])

    return run


def check_dimensions(index: IvfIndex, queries: DataFrame) -> None:
    """ValueError if queries and index differ in dimension."""
    dim = dimension(queries.select(F.col("qv").alias("embedding")))
    if dim and index.dim and dim != index.dim:
        raise ValueError(f"queries have {dim} dimensions, the index {index.dim}")
