"""Grids of workers (b_vec rows of clusters by b_dim columns of dimensions), their load and their cost.

Spark places data by itself; this says what a grid would cost, and `row` is a partitioning key for those who want it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.vectors import slice_bounds

MODES = ("hybrid", "vector", "dimension", "auto")
#: fixed values: share of the work left at so many slices
PRUNE_KNOTS = ((1, 1.00), (2, 0.62), (4, 0.51))


def resolve_grid(n_workers: int, mode: str = "hybrid", b_vec: int = 0, b_dim: int = 0) -> tuple[int, int]:
    """(b_vec, b_dim) whose product is n_workers. Given numbers go before the mode; auto starts as one row."""
    if n_workers < 1:
        raise ValueError("n_workers must be at least 1")
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    if b_vec > 0 or b_dim > 0:
        b_vec, b_dim = b_vec or n_workers // b_dim, b_dim or n_workers // b_vec
    elif mode == "vector":
        b_vec, b_dim = n_workers, 1
    elif mode == "hybrid":
        b_dim = max(d for d in divisors(n_workers) if d * d <= n_workers)
        b_vec = n_workers // b_dim
    else:
        b_vec, b_dim = 1, n_workers
    if b_vec < 1 or b_dim < 1 or b_vec * b_dim != n_workers:
        raise ValueError(f"a grid of {b_vec} x {b_dim} is not {n_workers} workers")
    return b_vec, b_dim


def divisors(n: int) -> list[int]:
    return [d for d in range(1, n + 1) if n % d == 0]


def prune_factor(b_dim: Column) -> Column:
    """Linear between the knots, flat outside."""
    b = b_dim.cast("double")
    out = F.when(b <= PRUNE_KNOTS[0][0], F.lit(PRUNE_KNOTS[0][1]))
    for (x0, y0), (x1, y1) in zip(PRUNE_KNOTS, PRUNE_KNOTS[1:]):
        out = out.when(b <= x1, y0 + (b - x0) / (x1 - x0) * (y1 - y0))
    return out.otherwise(F.lit(PRUNE_KNOTS[-1][1]))


def cluster_hits(probes: DataFrame, sizes: DataFrame) -> DataFrame:
    """cid, size, hits: how often the queries probe each cluster, 0 where never."""
    hits = probes.groupBy("cid").agg(F.count("*").alias("hits"))
    return sizes.join(hits, "cid", "left").select("cid", "size", F.coalesce("hits", F.lit(0)).alias("hits"))


def without_warmup(sizes: DataFrame) -> DataFrame:
    """Every cluster as one hit."""
    return sizes.select("cid", "size", F.lit(1).cast("long").alias("hits"))


def grid_layout(sizes: DataFrame, b_vec: int) -> DataFrame:
    """row, clusters, vectors: what each row of the grid holds; cluster c is in row c mod b_vec."""
    rows = sizes.sparkSession.range(b_vec).select(F.col("id").cast("int").alias("row"))
    held = sizes.groupBy((F.col("cid") % b_vec).alias("row")).agg(F.count("*").alias("clusters"), F.sum("size").alias("vectors"))
    return rows.join(held, "row", "left").na.fill(0)


def grid_cells(sizes: DataFrame, b_vec: int, b_dim: int, dim: int) -> DataFrame:
    """row, col, dim_start, dim_stop, vectors of each worker."""
    bounds = sizes.sparkSession.createDataFrame([(i, *b) for i, b in enumerate(slice_bounds(dim, b_dim))], "col int, dim_start int, dim_stop int")
    return grid_layout(sizes, b_vec).join(F.broadcast(bounds)).select("row", "col", "dim_start", "dim_stop", "vectors")  # b_dim rows


def row_loads(hits: DataFrame, b_vec: int, b_dim: int, dim: int) -> DataFrame:
    """row, load: hits x size x dimensions a worker sums; rows without clusters have 0."""
    rows = hits.sparkSession.range(b_vec).select(F.col("id").cast("int").alias("row"))
    load = hits.groupBy((F.col("cid") % b_vec).alias("row")).agg((F.sum(F.col("hits") * F.col("size")) * (dim / b_dim)).alias("load"))
    return rows.join(load, "row", "left").select("row", F.coalesce("load", F.lit(0.0)).alias("load"))


def plan_costs(hits: DataFrame, n_workers: int, dim: int, alpha: float = 0.3, comm_cost: float = 1.0) -> DataFrame:
    """b_vec, b_dim, work (share), imbalance, cost of every grid of n_workers, as one plan over all of them.

    cost = work / workers + comm_cost x bytes + alpha x imbalance, imbalance the population deviation of row loads.
    """
    spark = hits.sparkSession
    grids = spark.createDataFrame([(n_workers // d, d) for d in divisors(n_workers)], "b_vec int, b_dim int")
    rows = grids.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("b_vec") - 1)))
    placed = hits.join(F.broadcast(grids)).withColumn("row", F.col("cid") % F.col("b_vec"))  # clusters times divisors of n_workers
    held = placed.groupBy("b_vec", "b_dim", "row").agg(F.sum(F.col("hits") * F.col("size")).alias("w"))
    held = rows.join(held, ["b_vec", "b_dim", "row"], "left").withColumn("w", F.coalesce("w", F.lit(0)))
    b_dim = F.col("b_dim")
    per = held.groupBy("b_vec", "b_dim").agg(F.sum("w").alias("w"), F.stddev_pop(F.col("w") * dim / b_dim).alias("imbalance"))
    compute = F.col("w") * dim * prune_factor(b_dim) / (F.col("b_vec") * b_dim)
    return per.select("b_vec", "b_dim", prune_factor(b_dim).alias("work"), "imbalance", (compute + comm_cost * F.col("w") * b_dim * 4 + alpha * F.col("imbalance")).alias("cost"))


def choose_plan(costs: DataFrame) -> DataFrame:
    """The row of least cost; of equals the one with fewer columns."""
    return costs.orderBy("cost", "b_dim").limit(1)


def batch_schedule(probes: DataFrame, b_vec: int, b_dim: int) -> DataFrame:
    """qid, row, cid, prank, batch, start_col: a row of the grid takes b_dim of a query's clusters at a time, each of which
    starts at another column.
    """
    p = probes.withColumn("row", F.col("cid") % b_vec)
    at = F.row_number().over(Window.partitionBy("qid", "row").orderBy("prank")) - 1
    return p.select("qid", "row", "cid", "prank", F.floor(at / b_dim).cast("int").alias("batch"), (at % b_dim).cast("int").alias("start_col"))
