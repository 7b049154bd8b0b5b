import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import evaluate, kmeans, search


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")


def as_set(df):
    return sorted(map(tuple, df.select("qid", "rk", "vec_id", "dist").collect()))


@pytest.fixture(scope="module")
def setup(spark):
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((12, 10)) * 4
    x = (centers[rng.integers(0, 12, 400)] + rng.standard_normal((400, 10))).astype(np.float32)
    v = vectors(spark, x).cache()
    return x, v, kmeans.build_index(v, 8, 3), search.query_set(v.where("vec_id % 20 = 0"))


def test_exact_against_brute_force(setup):
    x, v, _, q = setup
    got = as_set(search.exact_knn(v, q, 7))
    want = []
    for i in range(0, 400, 20):
        d = np.zeros(400)
        for j in range(10):
            diff = x[:, j].astype(float) - float(x[i, j])
            d += diff * diff
        order = np.lexsort((np.arange(400), d))[:7]
        want += [(i, r + 1, int(n), d[n]) for r, n in enumerate(order)]
    assert got == sorted(want)


def test_all_clusters_probed_is_exact(setup):
    _, v, index, q = setup
    exact, found = search.exact_knn(v, q, 7), search.ivf_search(index, q, index.nlist + 5, 7)
    assert as_set(found) == as_set(exact)
    assert {r["recall"] for r in evaluate.recall_at_k(found, exact, q, 7).collect()} == {1.0}


@pytest.mark.parametrize("b_dim", [1, 2, 3, 4, 16])
@pytest.mark.parametrize("prewarm", [0, 3, 40])
def test_pruning_changes_nothing(setup, b_dim, prewarm):
    _, _, index, q = setup
    plain = as_set(search.ivf_search(index, q, 3, 5))
    assert as_set(search.ivf_search_pruned(index, q, 3, 5, prewarm, b_dim)) == plain
    assert as_set(search.ivf_search_pruned(index, q, 3, 5, prewarm, b_dim, pruning=False)) == plain


def test_blocks_of_queries_change_nothing(setup, monkeypatch):
    _, _, index, q = setup
    plain = as_set(search.ivf_search(index, q, 3, 5))
    monkeypatch.setattr(search, "QUERY_CELLS", 35)
    assert as_set(search.ivf_search(index, q, 3, 5)) == plain


def test_stages_and_report(setup):
    _, _, index, q = setup
    depth = search.stage_depth(index, q, 3, 5, 20, 4).cache()
    s = [r["processed"] for r in evaluate.stage_survivors(depth, 4).orderBy("stage").collect()]
    assert s == sorted(s, reverse=True) and s[0] == depth.where("not seeded").count() and s[-1] < s[0]
    r = evaluate.pruning_report(depth, 4).orderBy("stage").first()
    assert r["skipped_pct"] == 0 and 0 < r["prewarmed"] <= 20 * 20 and 0 < r["work_pct"] < 100
    whole = search.stage_depth(index, q, 3, 5, 20, 4, pruning=False)
    assert whole.where("not seeded").agg(F.min("stages")).first()[0] == 4


def test_ties_and_few_candidates(spark):
    v = vectors(spark, [[0, 0], [1, 0], [-1, 0], [0, 1], [5, 5]])
    q = search.query_set(v.where("vec_id = 0"))
    assert [r[2] for r in as_set(search.exact_knn(v, q, 3))] == [0, 1, 2]
    assert len(as_set(search.exact_knn(v, q, 50))) == 5


def test_tau_needs_k_seeds(setup):
    _, _, index, q = setup
    assert {r["tau"] for r in search.prewarm_tau(index, q, 3, 5).collect()} == {float("inf")}
    assert all(np.isfinite(r["tau"]) for r in search.prewarm_tau(index, q, 5, 5).collect())
    assert {r["tau"] for r in search.prewarm_tau(index, q, 0, 5).collect()} == {float("inf")}


def test_compare(spark):
    a = spark.createDataFrame([(1, 5, 1.0), (2, 6, 2.0), (3, 7, 1.0)], "qid long, vec_id long, dist double")
    b = spark.createDataFrame([(1, 5, 1.0), (2, 9, 2.0), (3, 8, 3.0)], "qid long, vec_id long, dist double")
    assert {r["qid"]: r["verdict"] for r in evaluate.compare_results(a, b).collect()} == {1: "equal", 2: "tie", 3: "different"}


def test_recall_rules(spark):
    truth = spark.createDataFrame([(1, 1, 10), (1, 2, 11)], "qid long, rk int, vec_id long")
    found = spark.createDataFrame([(1, 1, 11), (2, 1, 10)], "qid long, rk int, vec_id long")
    q = spark.createDataFrame([(1,), (2,)], "qid long")
    assert {r["qid"]: r["recall"] for r in evaluate.recall_at_k(found, truth, q, 5).collect()} == {1: 0.5, 2: 0.0}


def test_bad_arguments(setup):
    _, v, index, q = setup
    for call in (lambda: search.exact_knn(v, q, 0), lambda: search.ivf_search(index, q, 0, 3), lambda: search.ivf_search(index, q, 3, 0), lambda: kmeans.build_index(v, 0)):
        with pytest.raises(ValueError):
            call()


def test_dimensions_must_agree(spark, setup):
    _, _, index, _ = setup
    with pytest.raises(ValueError):
        search.check_dimensions(index, search.query_set(vectors(spark, [[1, 2]])))
    with pytest.raises(ValueError):
        kmeans.build_index(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>"), 1)


def test_empty_cluster_is_seeded_again(spark):
    v = vectors(spark, [[0, 0], [0, 0], [0, 0], [9, 9]])
    c = kmeans.update(v, np.array([[0.0, 0.0], [50.0, 50.0], [9.0, 9.0]]), 0)
    assert c[1].tolist() in ([0, 0], [9, 9])
    index = kmeans.build_index(v, 4, 2)
    assert sum(r["size"] for r in index.sizes().collect()) == 4 and index.sizes().count() == 4


def test_nulls_extra_columns_and_empty_tables(spark):
    rows = [(1, [1.0, 2.0], "a", 5), (None, [1.0, 2.0], "b", 6), (3, None, "c", 7), (4, [2.0, 2.0], None, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cid string, dist long")
    index = kmeans.build_index(v, 2, 1)
    assert index.lists.count() == 2
    assert len(as_set(search.ivf_search(index, search.query_set(v), 2, 5))) == 4
    none = kmeans.build_index(v.limit(0), 2, 1)
    assert none.nlist == 0 and as_set(search.ivf_search(none, search.query_set(v), 1, 1)) == []
    assert as_set(search.exact_knn(v.where("vec_id = 1"), search.query_set(v.limit(0)), 1)) == []


def test_save_and_load(spark, setup, tmp_path):
    _, _, index, q = setup
    index.save(str(tmp_path / "index"))
    again = kmeans.IvfIndex.load(spark, str(tmp_path / "index"))
    assert as_set(search.ivf_search(again, q, 3, 5)) == as_set(search.ivf_search(index, q, 3, 5))


def test_only_k_rows_leave_a_task(setup):
    _, v, _, q = setup
    plan = search.exact_knn(v, q, 3)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and plan.count("WindowGroupLimit") >= 2 and "NestedLoop" not in plan


def test_timed(setup):
    _, _, index, q = setup
    rows, report = evaluate.timed(lambda: search.ivf_search(index, search.first_queries(q, 3), 2, 2), 3)
    assert rows.count() == 6 and report["qps"] > 0


def test_vectors_that_are_not_finite_are_left_out(spark, setup):
    x, v, _, _ = setup
    nan, inf = float("nan"), float("inf")
    odd = spark.createDataFrame([(1000, [nan] * 10), (1001, [inf] + [0.0] * 9), (1002, [None] * 10)], "vec_id long, embedding array<float>")
    sizes = lambda t: sorted(map(tuple, kmeans.build_index(t, 8, 3).sizes().collect()))
    assert sizes(v.unionByName(odd)) == sizes(v)
    assert search.query_set(odd).count() == 0


def test_queries_with_the_same_id_count_once(setup):
    _, v, index, q = setup
    twice = q.unionByName(q)
    assert as_set(search.ivf_search(index, twice, 3, 5)) == as_set(search.ivf_search(index, q, 3, 5))
    assert as_set(search.exact_knn(v, twice, 5)) == as_set(search.exact_knn(v, q, 5))


def test_search_reads_only_probed_clusters(spark, setup, tmp_path):
    _, _, index, q = setup
    index.save(str(tmp_path / "index"))
    again = kmeans.IvfIndex.load(spark, str(tmp_path / "index"))
    found = search.ivf_search(again, search.first_queries(q, 1), 2, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cid" in plan or "PartitionFilters: [isnotnull(cid" in plan
    read = {f.split("cid=")[1].split("/")[0] for f in again.lists.where(F.col("cid").isin([r["cid"] for r in search.nearest_clusters(search.first_queries(q, 1), again, 2).collect()])).inputFiles()}
    assert len(read) >= 2 and as_set(found) == as_set(search.ivf_search(index, search.first_queries(q, 1), 2, 5))


def test_heads_rank_ids_alone(setup):
    _, _, index, _ = setup
    plan = index.heads(5)._jdf.queryExecution().optimizedPlan().toString()
    window = [line for line in plan.split("\n") if "Window" in line and "embedding" in line]
    assert not window and "Window" in plan


def test_counts_of_the_kernel_are_those_of_the_candidates(setup, monkeypatch):
    _, _, index, q = setup
    monkeypatch.setattr(search, "CELLS", 300)
    for prewarm, pruning, b_dim in ((20, True, 4), (0, True, 3), (3, True, 1), (20, False, 4)):
        rows = search.stage_depth(index, q, 3, 5, prewarm, b_dim, pruning)
        want = sorted(map(tuple, rows.groupBy("cid", "seeded", "stages").count().collect()))
        counts = search.stage_counts(index, q, 3, 5, prewarm, b_dim, pruning)
        assert sorted(map(tuple, counts.collect())) == want
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert search.stage_counts(index, q.limit(0), 3, 5, 20, 4).count() == 0


def test_seeds_are_skipped_by_the_search_and_added_once(spark, setup):
    x, v, index, q = setup
    ends = index.head_ends(20)
    seeds = search.nearest_seeds(index, q, 5, ends)
    every = search.top_k(search.prewarm_seeds(index, q, 20), 5)
    assert as_set(seeds) == as_set(every.select("qid", "rk", "vec_id", "dist"))
    rest = search.ivf_search(index, q, 3, 1000, b_dim=4, ends=ends)
    own = search.prewarm_seeds(index, q, 20).select("qid", "vec_id")
    assert rest.join(own, ["qid", "vec_id"], "left_semi").count() == 0
    assert rest.count() + own.count() == search.ivf_search(index, q, 3, 1000).count()
