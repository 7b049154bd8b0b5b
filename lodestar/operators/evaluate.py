"""Recall, comparison of results, pruning report."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recall_at_k(result: DataFrame, truth: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """qid, recall: share of the first min(k, true neighbours) neighbours that the result has; 0 for a query without truth.

    result and truth have qid, rk, vec_id; ranks within the first k don't matter.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    wanted = truth.where(F.col("rk") <= k).select("qid", "vec_id")
    hits = wanted.join(result.where(F.col("rk") <= k).select("qid", "vec_id").distinct(), ["qid", "vec_id"], "left_semi").groupBy("qid").agg(F.count("*").alias("hits"))
    n = wanted.groupBy("qid").agg(F.count("*").alias("n"))
    both = queries.select("qid").join(n, "qid", "left").join(hits, "qid", "left")
    return both.select("qid", F.coalesce(F.coalesce("hits", F.lit(0)) / F.col("n"), F.lit(0.0)).alias("recall"))


def compare_results(a: DataFrame, b: DataFrame, digits: int = 9) -> DataFrame:
    """qid, same_ids, same_dists, verdict: equal, tie (other ids at equal distances) or different."""

    def lists(df: DataFrame, suffix: str) -> DataFrame:
        return df.groupBy("qid").agg(F.sort_array(F.collect_list("vec_id")).alias(f"i{suffix}"), F.sort_array(F.collect_list(F.round("dist", digits))).alias(f"d{suffix}"))

    both = lists(a, "a").join(lists(b, "b"), "qid", "full")
    ids, dists = F.col("ia").eqNullSafe(F.col("ib")), F.col("da").eqNullSafe(F.col("db"))
    return both.select("qid", ids.alias("same_ids"), dists.alias("same_dists"), F.when(ids, "equal").when(dists, "tie").otherwise("different").alias("verdict"))


def _n(depth: DataFrame) -> Column:
    """Candidates of a row: n in the rows of stage_counts, 1 in those of stage_depth."""
    return F.col("n") if "n" in depth.columns else F.lit(1)


def stage_survivors(depth: DataFrame, b_dim: int) -> DataFrame:
    """stage (from 1), processed: candidates of stage_counts or stage_depth that are summed over the stage's slice, seeds left out."""
    reached = depth.where("not seeded").groupBy("stages").agg(F.sum(_n(depth)).alias("n"))
    every = depth.sparkSession.range(1, b_dim + 1).select(F.col("id").cast("int").alias("stage"))
    joined = every.join(F.broadcast(reached), F.col("stages") >= F.col("stage"), "left")  # at most b_dim + 1 rows
    return joined.groupBy("stage").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("processed"))


def pruning_report(depth: DataFrame, b_dim: int) -> DataFrame:
    """stage, processed, skipped_pct, and for the whole: scanned, prewarmed, work_pct (executed of all slice sums)."""
    n = _n(depth)
    whole = depth.agg(F.sum(F.when(F.col("seeded"), 0).otherwise(n)).alias("scanned"), F.sum(F.when(F.col("seeded"), n).otherwise(0)).alias("prewarmed"), F.sum(F.col("stages") * n).alias("_done"))
    per = stage_survivors(depth, b_dim).join(F.broadcast(whole))  # one row
    return per.select(
        "stage", "processed",
        F.round(100 * (1 - F.col("processed") / F.col("scanned")), 6).alias("skipped_pct"),
        F.coalesce("scanned", F.lit(0)).alias("scanned"), F.coalesce("prewarmed", F.lit(0)).alias("prewarmed"),
        F.round(100 * F.col("_done") / (F.col("scanned") * b_dim), 6).alias("work_pct"),
    )


def timed(search: Callable[[], DataFrame], n_queries: int) -> tuple[DataFrame, dict[str, float]]:
    """Runs a search: (its rows, kept in memory; seconds, queries per second, ms per query)."""
    began = time.perf_counter()
    rows = search().cache()
    rows.count()
    s = time.perf_counter() - began
    return rows, {"seconds": s, "qps": n_queries / s, "ms_per_query": 1000 * s / max(1, n_queries)}
