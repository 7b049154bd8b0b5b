"""Queries over the table embeddings, and the SQL that says the same.

Queries are the rows whose vec_id is divisible by 20; they are searched against all rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.vectors import l2_partial, l2_squared, register_sql, slice_bounds
from lodestar.operators import evaluate, kmeans, search
from lodestar.plans import layout
from lodestar.sources import flatvec
from lodestar.sources.shared import shared_folder

NLIST, ITERS, SEED, NPROBE, K, PREWARM, B_DIM, WORKERS, DIM = 16, 3, 42, 4, 10, 20, 4, 4, 64
MOST = 13  #: clusters of a search that finds some queries' exact neighbours, not all
Query = Callable[[SparkSession, str], DataFrame]


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.valid(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queried(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.query_set(vectors(spark, sf_dir).where("vec_id % 20 = 0"))


def index(spark: SparkSession, sf_dir: str) -> kmeans.IvfIndex:
    return kmeans.build_index(vectors(spark, sf_dir), NLIST, ITERS, SEED)


def dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("dim_min"), F.max(F.size("embedding")).alias("dim_max"))


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return v.join(queried(spark, sf_dir).select(F.col("qid").alias("vec_id")), "vec_id").select("vec_id", F.element_at("embedding", 1).cast("double").alias("first"), F.element_at("embedding", -1).cast("double").alias("last"))


def l2_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, r = F.col("embedding"), F.reverse("embedding")
    return vectors(spark, sf_dir).select("vec_id", l2_squared(e, r).alias("dist"), l2_partial(e, r, 0, 16).alias("part_0"), l2_partial(e, r, 48, 64).alias("part_3"))


def l2_sql_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_sql(spark)
    vectors(spark, sf_dir).createOrReplaceTempView("lodestar_vectors")
    return spark.sql("SELECT vec_id, l2sq(embedding, reverse(embedding)) AS dist FROM lodestar_vectors")


def query_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is the limit: the first 10 queries."""
    return search.exact_knn(vectors(spark, sf_dir), search.first_queries(queried(spark, sf_dir), 10), K)


def slice_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's slices of 10, which doesn't divide 64."""
    bounds = F.array(*[F.struct(F.lit(i).alias("s"), F.lit(a).alias("start"), F.lit(b).alias("stop")) for i, (a, b) in enumerate(slice_bounds(DIM, 10))])
    rows = vectors(spark, sf_dir).select("vec_id", "embedding", F.explode(bounds).alias("b"))
    return rows.select("vec_id", F.col("b.s").alias("slice"), F.col("b.start").alias("start"), F.col("b.stop").alias("stop"), F.slice("embedding", F.col("b.start") + 1, F.col("b.stop") - F.col("b.start")).alias("part"))


def exact_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.exact_knn(vectors(spark, sf_dir), queried(spark, sf_dir), K)


def _near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, v = queried(spark, sf_dir), vectors(spark, sf_dir)
    return exact_knn(spark, sf_dir).join(q, "qid").join(v, "vec_id")


def sliced_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, q = F.col("embedding"), F.col("qv")
    parts = F.array(*[F.struct(F.lit(i).alias("stage"), l2_partial(e, q, a, b).alias("partial")) for i, (a, b) in enumerate(slice_bounds(DIM, B_DIM))])
    return _near_pairs(spark, sf_dir).select("qid", "vec_id", F.inline(parts))


def running_partial_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    chain = Window.partitionBy("qid", "vec_id").orderBy("stage").rowsBetween(Window.unboundedPreceding, 0)
    return sliced_distance(spark, sf_dir).select("qid", "vec_id", "stage", F.round(F.sum("partial").over(chain), 9).alias("acc"))


def slice_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliced_distance(spark, sf_dir).groupBy("qid", "vec_id").agg(F.round(F.sum("partial"), 9).alias("dist"))


def centroid_init(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = kmeans.init_centroids(vectors(spark, sf_dir), NLIST, SEED)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(c)]
    return spark.createDataFrame(rows, "cid int, centroid array<double>")


def assign_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return kmeans.assign(v, kmeans.init_centroids(v, NLIST, SEED)).select("vec_id", "cid", "cdist")


def kmeans_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = index(spark, sf_dir).centroid_table()
    return t.select("cid", F.transform("centroid", lambda x: F.round(x, 6)).alias("centroid"))


def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).lists.select("vec_id", "cid", F.round("cdist", 6).alias("cdist"))


def inverted_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).inverted_lists()


def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).sizes()


def nearest_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.nearest_clusters(queried(spark, sf_dir), index(spark, sf_dir), NPROBE).select("qid", "prank", "cid", F.round("cdist", 6).alias("cdist"))


def ivf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ivf_search(index(spark, sf_dir), queried(spark, sf_dir), NPROBE, K)


def ivf_search_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices without seeds: thresholds come from what a task has met. Sums by slice follow the order of dimensions."""
    return search.ivf_search(index(spark, sf_dir), queried(spark, sf_dir), NPROBE, K, b_dim=B_DIM)


def ivf_search_all_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With all clusters probed the search is exact."""
    return search.ivf_search(index(spark, sf_dir), queried(spark, sf_dir), NLIST + 1, K)


def ivf_search_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ivf_search_pruned(index(spark, sf_dir), queried(spark, sf_dir), NPROBE, K, PREWARM, B_DIM)


def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, truth = ivf_search(spark, sf_dir), exact_knn(spark, sf_dir)
    return evaluate.recall_at_k(found, truth, queried(spark, sf_dir), K)


def mean_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall_at_k(spark, sf_dir).agg(F.round(F.avg("recall"), 6).alias("recall"), F.count("*").alias("queries"))


def result_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search in most clusters against the exact one: some queries' neighbours are equal, others differ."""
    found = search.ivf_search(index(spark, sf_dir), queried(spark, sf_dir), MOST, K)
    return evaluate.compare_results(found, exact_knn(spark, sf_dir))


def prewarm_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.prewarm_seeds(index(spark, sf_dir), queried(spark, sf_dir), PREWARM)


def prewarm_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.prewarm_tau(index(spark, sf_dir), queried(spark, sf_dir), PREWARM, K)


def _depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.stage_counts(index(spark, sf_dir), queried(spark, sf_dir), NPROBE, K, PREWARM, B_DIM)


def stage_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.stage_survivors(_depth(spark, sf_dir), B_DIM)


def pruning_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.pruning_report(_depth(spark, sf_dir), B_DIM)


def scanned_by_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _depth(spark, sf_dir).groupBy((F.col("cid") % 2).alias("row")).agg(F.sum("n").alias("scanned"))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = index(spark, sf_dir)
    return layout.cluster_hits(search.nearest_clusters(queried(spark, sf_dir), i, NPROBE), i.sizes())


def cluster_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir)


def grid_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    b_vec, _ = layout.resolve_grid(WORKERS, "hybrid")
    return layout.grid_layout(index(spark, sf_dir).sizes(), b_vec)


def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.grid_cells(index(spark, sf_dir).sizes(), *layout.resolve_grid(WORKERS, "hybrid"), DIM)


def row_load_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    loads = layout.row_loads(_hits(spark, sf_dir), 2, 2, DIM)
    return loads.agg(F.round(F.stddev_pop("load"), 6).alias("imbalance"), F.sum("load").alias("total"))


def imbalance_without_warmup(spark: SparkSession, sf_dir: str) -> DataFrame:
    loads = layout.row_loads(layout.without_warmup(index(spark, sf_dir).sizes()), 4, 1, DIM)
    return loads.agg(F.round(F.stddev_pop("load"), 6).alias("imbalance"), F.sum("load").alias("total"))


def ivf_search_unpruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ivf_search_pruned(index(spark, sf_dir), queried(spark, sf_dir), NPROBE, K, PREWARM, B_DIM, pruning=False)


def prune_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1, 9).select(F.col("id").cast("int").alias("b_dim"), F.round(layout.prune_factor(F.col("id")), 9).alias("work"))


def _costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.plan_costs(_hits(spark, sf_dir), WORKERS, DIM).withColumns({c: F.round(c, 6) for c in ("work", "imbalance", "cost")})


def plan_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _costs(spark, sf_dir)


def choose_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.choose_plan(_costs(spark, sf_dir))


def batch_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.batch_schedule(search.nearest_clusters(queried(spark, sf_dir), index(spark, sf_dir), NPROBE), 2, 2)


def flatvec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written to a flat file and read back: vec_id is the position, which equals the id where ids run from 0."""
    path = f"{shared_folder(spark).removeprefix('file://').removeprefix('file:')}/flatvec-{uuid.uuid4().hex}.bin"
    flatvec.write_vectors(vectors(spark, sf_dir), path)
    return flatvec.read_vectors(spark, path, rows_per_partition=1000)


def stored_index(spark: SparkSession, sf_dir: str) -> kmeans.IvfIndex:
    """The index, saved by cluster in the shared folder and loaded again: a search reads the probed clusters' files only."""
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    index(spark, sf_dir).save(path)
    return kmeans.IvfIndex.load(spark, path)


def ivf_search_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ivf_search_pruned(stored_index(spark, sf_dir), queried(spark, sf_dir), NPROBE, K, PREWARM, B_DIM)


ALL = (
    dataset_stats, point_lookup, l2_functions, l2_sql_function, query_limit, slice_plan, exact_knn, sliced_distance, running_partial_sum, slice_reassembly,
    centroid_init, assign_clusters, kmeans_centroids, kmeans_assign, inverted_lists, cluster_sizes, nearest_clusters,
    ivf_search, ivf_search_sliced, ivf_search_all_probes, ivf_search_pruned, ivf_search_unpruned, recall_at_k, mean_recall, result_compare,
    prewarm_seeds, prewarm_tau, stage_survivors, pruning_report, scanned_by_row, cluster_hits, grid_layout, grid_cells,
    row_load_imbalance, imbalance_without_warmup, prune_factor, plan_costs, choose_plan, batch_schedule, flatvec_roundtrip, ivf_search_stored,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in ALL}


# --- SQL for DuckDB


def _dist(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))"


_BASE = """v AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
q AS (SELECT vec_id AS qid, embedding AS qv FROM v WHERE vec_id % 20 = 0)"""


def _assigned(name: str, centroids: str) -> str:
    d = _dist("v.embedding", "c.c")
    return f"""{name} AS (SELECT vec_id, any_value(embedding) AS embedding, arg_min(cid, {{'d': d, 'c': cid}}) AS cid, min(d) AS cdist
  FROM (SELECT v.vec_id, v.embedding, c.cid, {d} AS d FROM v, {centroids} c) GROUP BY vec_id)"""


def _index(iters: int = ITERS) -> str:
    out = [
        _BASE,
        f"""c0 AS (SELECT CAST(row_number() OVER (ORDER BY md5('{SEED}:' || vec_id), vec_id) - 1 AS INTEGER) AS cid, embedding::DOUBLE[] AS c
  FROM v QUALIFY cid < {NLIST})""",
    ]
    for i in range(iters):
        out.append(_assigned(f"a{i}", f"c{i}"))
        out.append(f"""m{i} AS (SELECT cid, list(m ORDER BY j) AS c FROM (SELECT cid, j, avg(x) AS m
    FROM (SELECT cid, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS j FROM a{i}) GROUP BY cid, j) GROUP BY cid)""")
        out.append(f"""e{i} AS (SELECT c.cid, arg_min(v.embedding, {{'h': md5('{SEED}:{i}:' || c.cid || ':' || v.vec_id), 'v': v.vec_id}})::DOUBLE[] AS c
    FROM (SELECT cid FROM c{i} WHERE cid NOT IN (SELECT cid FROM m{i})) c, v GROUP BY c.cid)""")
        out.append(f"c{i + 1} AS (SELECT cid, coalesce(m.c, e.c) AS c FROM c{i} LEFT JOIN m{i} m USING (cid) LEFT JOIN e{i} e USING (cid))")
    out.append(_assigned("a", f"c{iters}"))
    out.append(f"cents AS (SELECT * FROM c{iters})")
    out.append("sizes AS (SELECT c.cid, count(a.vec_id) AS size FROM cents c LEFT JOIN a USING (cid) GROUP BY c.cid)")
    return ",\n".join(out)


def _probes(nprobe: int = NPROBE) -> str:
    return f"""pr AS (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY cdist, cid) AS INTEGER) AS prank, cid, cdist
  FROM (SELECT q.qid, c.cid, {_dist("q.qv", "c.c")} AS cdist FROM q, cents c) QUALIFY prank <= {nprobe})"""


def _exact() -> str:
    return f"""ex AS (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS INTEGER) AS rk, vec_id, dist
  FROM (SELECT q.qid, v.vec_id, {_dist("v.embedding", "q.qv")} AS dist FROM q, v) QUALIFY rk <= {K})"""


def _found() -> str:
    return f"""ca AS (SELECT pr.qid, pr.cid, pr.prank, a.vec_id, {_dist("a.embedding", "q.qv")} AS dist, a.embedding, q.qv
  FROM pr JOIN a USING (cid) JOIN q USING (qid)),
ivf AS (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS INTEGER) AS rk, vec_id, dist FROM ca QUALIFY rk <= {K})"""


def _seeds() -> str:
    return f"""po AS (SELECT vec_id, cid, CAST(row_number() OVER (PARTITION BY cid ORDER BY vec_id) AS INTEGER) AS list_pos FROM a),
se AS (SELECT ca.qid, ca.cid, po.list_pos, ca.vec_id, ca.dist FROM ca JOIN po USING (vec_id) WHERE ca.prank = 1 AND po.list_pos <= {PREWARM}),
ta AS (SELECT q.qid, coalesce(max(s.dist), 'infinity'::DOUBLE) AS tau FROM q LEFT JOIN (
  SELECT qid, dist FROM se QUALIFY row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) = {K}) s USING (qid) GROUP BY q.qid)"""


def _stages() -> str:
    bounds = slice_bounds(DIM, B_DIM)
    parts = [_dist(f"embedding[{a + 1}:{b}]", f"qv[{a + 1}:{b}]") for a, b in bounds]
    sums = ", ".join(f"{p} AS p{i}" for i, p in enumerate(parts))
    acc = ["0.0"] + [" + ".join(f"p{j}" for j in range(i + 1)) for i in range(B_DIM - 1)]
    alive = [" AND ".join(f"{acc[j]} <= tau * (1 + 1e-9)" for j in range(1, i + 1)) or "TRUE" for i in range(B_DIM)]
    depth = " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in alive)
    return f"""pa AS (SELECT ca.qid, ca.cid, ca.vec_id, ta.tau, se.vec_id IS NOT NULL AS seeded, {sums.replace("embedding[", "ca.embedding[").replace("qv[", "ca.qv[")}
  FROM ca JOIN ta USING (qid) LEFT JOIN se ON se.qid = ca.qid AND se.vec_id = ca.vec_id),
de AS (SELECT qid, cid, vec_id, seeded, CASE WHEN seeded THEN 0 ELSE {depth} END AS stages FROM pa),
st AS (SELECT s.stage::INTEGER AS stage, count(de.qid) AS processed FROM range(1, {B_DIM + 1}) s(stage) LEFT JOIN de ON NOT de.seeded AND de.stages >= s.stage GROUP BY s.stage)"""


def _plans() -> str:
    return f"""hi AS (SELECT s.cid, s.size, count(pr.qid) AS hits FROM sizes s LEFT JOIN pr USING (cid) GROUP BY s.cid, s.size),
gr AS (SELECT CAST({WORKERS} // d AS INTEGER) AS b_vec, CAST(d AS INTEGER) AS b_dim FROM range(1, {WORKERS + 1}) t(d) WHERE {WORKERS} % d = 0),
ro AS (SELECT b_vec, b_dim, unnest(range(0, b_vec)) AS r FROM gr),
lo AS (SELECT ro.b_vec, ro.b_dim, ro.r, coalesce(sum(hi.hits * hi.size), 0)::DOUBLE AS w FROM ro LEFT JOIN hi ON hi.cid % ro.b_vec = ro.r GROUP BY ALL),
pf AS (SELECT d, CASE WHEN d <= 1 THEN 1.0::DOUBLE WHEN d <= 2 THEN 1.0::DOUBLE + (d - 1) * (0.62::DOUBLE - 1.0::DOUBLE) WHEN d <= 4 THEN 0.62::DOUBLE + (d - 2) / 2.0::DOUBLE * (0.51::DOUBLE - 0.62::DOUBLE) ELSE 0.51::DOUBLE END AS f
  FROM (SELECT CAST(d AS INTEGER) AS d FROM range(1, 9) t(d))),
pc AS (SELECT b_vec, b_dim, round(any_value(f), 6) AS work, round(stddev_pop(w * {DIM} / b_dim), 6) AS imbalance,
  round(sum(w) * {DIM} * any_value(f) / (b_vec * b_dim) + 1.0 * sum(w) * b_dim * 4 + 0.3::DOUBLE * stddev_pop(w * {DIM} / b_dim), 6) AS cost
  FROM lo JOIN pf ON pf.d = b_dim GROUP BY b_vec, b_dim)"""


def oracle_sql() -> dict[str, str]:
    idx, pro, fnd, sed = _index(), _probes(), _found(), _seeds()
    with_ = lambda *parts: "WITH " + ",\n".join(parts) + "\n"
    pairs = with_(_BASE, _exact()) + "SELECT ex.qid, ex.vec_id, s.stage::INTEGER AS stage, CASE s.stage " + " ".join(
        f"WHEN {i} THEN {_dist(f'v.embedding[{a + 1}:{b}]', f'q.qv[{a + 1}:{b}]')}" for i, (a, b) in enumerate(slice_bounds(DIM, B_DIM))
    ) + f" END AS partial FROM ex JOIN q USING (qid) JOIN v USING (vec_id), range(0, {B_DIM}) s(stage)"
    ivf = with_(idx, pro, fnd) + "SELECT qid, rk, vec_id, dist FROM ivf"
    depth = with_(idx, pro, fnd, sed, _stages())
    rec = with_(idx, pro, fnd, _exact(), "re AS (SELECT q.qid, count(ivf.vec_id)::DOUBLE / greatest(count(ex.vec_id), 1) AS recall FROM q LEFT JOIN ex USING (qid) LEFT JOIN ivf ON ivf.qid = ex.qid AND ivf.vec_id = ex.vec_id GROUP BY q.qid)")
    return {
        "dataset_stats": with_(_BASE) + "SELECT count(*) AS n, min(len(embedding))::INTEGER AS dim_min, max(len(embedding))::INTEGER AS dim_max FROM v",
        "point_lookup": with_(_BASE) + "SELECT vec_id, embedding[1]::DOUBLE AS first, embedding[-1]::DOUBLE AS last FROM v WHERE vec_id IN (SELECT qid FROM q)",
        "l2_functions": with_(_BASE) + f"SELECT vec_id, {_dist('embedding', 'list_reverse(embedding)')} AS dist, {_dist('embedding[1:16]', 'list_reverse(embedding)[1:16]')} AS part_0, {_dist('embedding[49:64]', 'list_reverse(embedding)[49:64]')} AS part_3 FROM v",
        "slice_plan": with_(_BASE) + f"SELECT vec_id, s::INTEGER AS slice, (s * {DIM} // 10)::INTEGER AS start, ((s + 1) * {DIM} // 10)::INTEGER AS stop, embedding[s * {DIM} // 10 + 1:(s + 1) * {DIM} // 10] AS part FROM v, range(0, 10) t(s)",
        "exact_knn": with_(_BASE, _exact()) + "SELECT * FROM ex",
        "sliced_distance": pairs,
        "running_partial_sum": f"SELECT qid, vec_id, stage, round(sum(partial) OVER (PARTITION BY qid, vec_id ORDER BY stage ROWS UNBOUNDED PRECEDING), 9) AS acc FROM ({pairs})",
        "slice_reassembly": f"SELECT qid, vec_id, round(sum(partial), 9) AS dist FROM ({pairs}) GROUP BY qid, vec_id",
        "centroid_init": with_(_index(0)) + "SELECT cid, c AS centroid FROM cents",
        "assign_clusters": with_(_index(0)) + "SELECT vec_id, cid, cdist FROM a",
        "kmeans_centroids": with_(idx) + "SELECT cid, list_transform(c, lambda x: round(x, 6)) AS centroid FROM cents",
        "kmeans_assign": with_(idx) + "SELECT vec_id, cid, round(cdist, 6) AS cdist FROM a",
        "inverted_lists": with_(idx) + "SELECT cid, list(vec_id ORDER BY vec_id) AS vec_ids FROM a GROUP BY cid",
        "cluster_sizes": with_(idx) + "SELECT cid, size FROM sizes",
        "nearest_clusters": with_(idx, pro) + "SELECT qid, prank, cid, round(cdist, 6) AS cdist FROM pr",
        "ivf_search": ivf,
        "ivf_search_sliced": ivf,
        "ivf_search_all_probes": with_(_BASE, _exact()) + "SELECT * FROM ex",
        "ivf_search_pruned": ivf,
        "ivf_search_unpruned": ivf,
        "l2_sql_function": with_(_BASE) + f"SELECT vec_id, {_dist('embedding', 'list_reverse(embedding)')} AS dist FROM v",
        "query_limit": with_(_BASE, _exact()) + "SELECT * FROM ex WHERE qid IN (SELECT qid FROM q ORDER BY qid LIMIT 10)",
        "imbalance_without_warmup": with_(idx) + f"SELECT round(stddev_pop(l), 6) AS imbalance, sum(l) AS total FROM (SELECT cid % 4 AS r, sum(size)::DOUBLE * {DIM} AS l FROM sizes GROUP BY 1)",
        "recall_at_k": rec + "SELECT qid, recall FROM re",
        "mean_recall": rec + "SELECT round(avg(recall), 6) AS recall, count(*) AS queries FROM re",
        "ivf_search_stored": ivf,
        "result_compare": with_(idx, _probes(MOST), fnd, _exact(), *(f"l{t} AS (SELECT qid, list(vec_id ORDER BY vec_id) AS i, list(round(dist, 9) ORDER BY dist) AS d FROM {t} GROUP BY qid)" for t in ("ivf", "ex")))
        + "SELECT qid, a.i IS NOT DISTINCT FROM b.i AS same_ids, a.d IS NOT DISTINCT FROM b.d AS same_dists, CASE WHEN a.i IS NOT DISTINCT FROM b.i THEN 'equal' WHEN a.d IS NOT DISTINCT FROM b.d THEN 'tie' ELSE 'different' END AS verdict FROM livf a FULL JOIN lex b USING (qid)",
        "prewarm_seeds": with_(idx, pro, fnd, sed) + "SELECT qid, cid, list_pos, vec_id, dist FROM se",
        "prewarm_tau": with_(idx, pro, fnd, sed) + "SELECT qid, tau FROM ta",
        "stage_survivors": depth + "SELECT stage, processed FROM st",
        "pruning_report": depth + f"SELECT stage, processed, round(100 * (1 - processed / t.scanned), 6) AS skipped_pct, t.scanned::BIGINT AS scanned, t.prewarmed::BIGINT AS prewarmed, round(100 * t.done / (t.scanned * {B_DIM}), 6) AS work_pct FROM st, (SELECT sum((NOT seeded)::INT) AS scanned, sum(seeded::INT) AS prewarmed, sum(stages) AS done FROM de) t",
        "scanned_by_row": with_(idx, pro, fnd) + "SELECT cid % 2 AS row, count(*) AS scanned FROM ca GROUP BY 1",
        "cluster_hits": with_(idx, pro, _plans()) + "SELECT cid, size, hits FROM hi",
        "grid_layout": with_(idx) + "SELECT (cid % 2)::INTEGER AS row, count(*) AS clusters, sum(size)::BIGINT AS vectors FROM sizes GROUP BY 1",
        "grid_cells": with_(idx) + f"SELECT r.row, c.col::INTEGER AS col, (c.col * {DIM} // 2)::INTEGER AS dim_start, ((c.col + 1) * {DIM} // 2)::INTEGER AS dim_stop, r.vectors FROM (SELECT (cid % 2)::INTEGER AS row, sum(size)::BIGINT AS vectors FROM sizes GROUP BY 1) r, range(0, 2) c(col)",
        "row_load_imbalance": with_(idx, pro, _plans()) + f"SELECT round(stddev_pop(l), 6) AS imbalance, sum(l) AS total FROM (SELECT cid % 2 AS r, sum(hits * size)::DOUBLE * {DIM // 2} AS l FROM hi GROUP BY 1)",
        "prune_factor": with_(idx, pro, _plans()) + "SELECT d AS b_dim, round(f, 9) AS work FROM pf",
        "plan_costs": with_(idx, pro, _plans()) + "SELECT * FROM pc",
        "choose_plan": with_(idx, pro, _plans()) + "SELECT * FROM pc ORDER BY cost, b_dim LIMIT 1",
        "batch_schedule": with_(idx, pro) + "SELECT qid, cid % 2 AS row, cid, prank, CAST((row_number() OVER w - 1) // 2 AS INTEGER) AS batch, CAST((row_number() OVER w - 1) % 2 AS INTEGER) AS start_col FROM pr WINDOW w AS (PARTITION BY qid, cid % 2 ORDER BY prank)",
        "flatvec_roundtrip": "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL",
    }
