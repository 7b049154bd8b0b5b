"""The whole experiment: build an index, plan a grid, search, check and report.

    python -m lodestar.run --base base.bin --query query.bin --gt gt.bin --nlist 256 --mode auto --n-workers 4

Paths that end in .bin are flat binary files, others are read as Parquet (vec_id, embedding; for the ground truth qid,
rk, vec_id). Without a ground truth, exact search gives it.
"""

from __future__ import annotations

import argparse
import sys
import time
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import evaluate, kmeans, search
from lodestar.plans import layout
from lodestar.sources import flatvec


@dataclass(frozen=True)
class Config:
    base: str = "Data/sift_base.bin"
    query: str = "Data/sift_query.bin"
    gt: str = "Data/sift_gt.bin"
    nlist: int = 256
    iters: int = 10
    mode: str = "hybrid"
    b_vec: int = 0
    b_dim: int = 0
    alpha: float = 0.3
    comm_cost: float = 1.0
    warmup: int = 1000
    nprobe: int = 32
    k: int = 100
    nq: int = 100
    prewarm: int = 500
    pruning: int = 1
    threads: int = 1
    n_workers: int = 4


def load(spark: SparkSession, path: str) -> DataFrame:
    return flatvec.read_vectors(spark, path) if path.endswith(".bin") else spark.read.parquet(path)


def load_truth(spark: SparkSession, path: str) -> DataFrame:
    return flatvec.read_groundtruth(spark, path) if path.endswith(".bin") else spark.read.parquet(path)


def plan(cfg: Config, index: kmeans.IvfIndex, queries: DataFrame) -> tuple[int, int]:
    """The grid: from the mode and given numbers, or in mode auto, unless numbers are given, the cheapest one."""
    if cfg.mode != "auto" or cfg.b_vec or cfg.b_dim:
        return layout.resolve_grid(cfg.n_workers, cfg.mode, cfg.b_vec, cfg.b_dim)
    sizes = index.sizes()
    if cfg.warmup > 0:
        hits = layout.cluster_hits(search.nearest_clusters(search.first_queries(queries, cfg.warmup), index, cfg.nprobe), sizes)
    else:
        hits = layout.without_warmup(sizes)
    best = layout.choose_plan(layout.plan_costs(hits, cfg.n_workers, index.dim, cfg.alpha, cfg.comm_cost)).first()
    return best["b_vec"], best["b_dim"]


def run(cfg: Config, base: DataFrame, queries: DataFrame, truth: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """base (vec_id, embedding), queries (qid, qv): (qid, rk, vec_id, dist), kept in memory, and a report (metric, value)."""
    spark, out = base.sparkSession, []
    say = lambda metric, value: out.append((metric, float(value)))
    began = time.perf_counter()
    index = kmeans.build_index(base, cfg.nlist, cfg.iters)
    index.lists = index.lists.persist()
    say("vectors", index.lists.count())
    say("dimensions", index.dim)
    say("build_seconds", time.perf_counter() - began)
    search.check_dimensions(index, queries)
    asked = search.first_queries(queries, cfg.nq).persist()
    nq = asked.count()
    say("queries", nq)
    b_vec, b_dim = plan(cfg, index, queries)
    say("b_vec", b_vec)
    say("b_dim", b_dim)
    found, speed = evaluate.timed(lambda: search.ivf_search_pruned(index, asked, cfg.nprobe, cfg.k, cfg.prewarm, b_dim, bool(cfg.pruning)), nq)
    for metric, value in speed.items():
        say(metric, value)
    truth = truth if truth is not None else search.exact_knn(kmeans.valid(base), asked, cfg.k)
    say("recall", evaluate.recall_at_k(found, truth, asked, cfg.k).agg(F.avg("recall")).first()[0] or 0)
    plain = search.ivf_search(index, asked, cfg.nprobe, cfg.k)
    verdicts = {r["verdict"]: r["count"] for r in evaluate.compare_results(found, plain).groupBy("verdict").count().collect()}
    say("differing", verdicts.get("different", 0))
    say("ties", verdicts.get("tie", 0))
    depth = search.stage_counts(index, asked, cfg.nprobe, cfg.k, cfg.prewarm, b_dim, bool(cfg.pruning))
    depth = depth.persist()
    for r in evaluate.pruning_report(depth, b_dim).orderBy("stage").collect():
        if r["stage"] == 1:
            for metric in ("scanned", "prewarmed", "work_pct"):
                say(metric, r[metric] or 0)
        say(f"skipped_pct_slice_{r['stage']}", r["skipped_pct"] or 0)
    for held in (depth, asked, index.lists):
        held.unpersist()
    return found, spark.createDataFrame(out, "metric string, value double")


def parse(args: list[str]) -> Config:
    p = argparse.ArgumentParser(description="Index, search and report.")
    for f in fields(Config):
        names = {f"--{f.name}", f"--{f.name.replace('_', '-')}", f"--{f.name.replace('_', '')}" if f.name != "n_workers" else "--n-workers"}
        p.add_argument(*sorted(names), dest=f.name, type=type(f.default), default=f.default, **({"choices": layout.MODES} if f.name == "mode" else {}))
    return Config(**vars(p.parse_args(args)))


def main(args: list[str]) -> None:
    cfg = parse(args)
    spark = SparkSession.builder.master(f"local[{cfg.threads}]").getOrCreate()
    truth = load_truth(spark, cfg.gt) if cfg.gt else None
    _, report = run(cfg, load(spark, cfg.base), search.query_set(load(spark, cfg.query)), truth)
    for r in report.collect():
        print(f"{r['metric']}: {r['value']:g}")


if __name__ == "__main__":
    main(sys.argv[1:])
