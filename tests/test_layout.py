import pytest
from pyspark.sql import functions as F

from lodestar.plans import layout


def test_grids():
    assert [layout.resolve_grid(n) for n in (4, 6, 7, 1)] == [(2, 2), (3, 2), (7, 1), (1, 1)]
    assert layout.resolve_grid(6, "vector") == (6, 1) and layout.resolve_grid(6, "dimension") == layout.resolve_grid(6, "auto") == (1, 6)
    assert layout.resolve_grid(6, b_vec=3) == (3, 2) and layout.resolve_grid(6, b_dim=3) == (2, 3)
    for bad in (dict(b_vec=4), dict(b_vec=2, b_dim=2), dict(mode="square"), dict(b_dim=7)):
        with pytest.raises(ValueError):
            layout.resolve_grid(6, **bad)


def test_prune_factor(spark):
    got = [r[0] for r in spark.range(1, 9).orderBy("id").select(F.round(layout.prune_factor(F.col("id")), 9)).collect()]
    assert got == [1.0, 0.62, 0.565, 0.51, 0.51, 0.51, 0.51, 0.51]


@pytest.mark.parametrize("dim, want", [(128, [36, 27.84, 32.32]), (64, [20, 17.92, 24.16])])
def test_costs_by_hand(spark, dim, want):
    hits = spark.createDataFrame([(0, 10, 1), (1, 10, 1), (2, 10, 1), (3, 10, 1)], "cid int, size long, hits long")
    costs = layout.plan_costs(hits, 4, dim, alpha=0).orderBy("b_dim").collect()
    assert [round(r["cost"] / 40, 6) for r in costs] == want
    assert layout.choose_plan(layout.plan_costs(hits, 4, dim, alpha=0)).first()["b_dim"] == 2


def test_equal_costs_take_fewer_columns(spark):
    costs = spark.createDataFrame([(1, 4, 2.0), (4, 1, 2.0), (2, 2, 3.0)], "b_vec int, b_dim int, cost double")
    assert layout.choose_plan(costs).first()["b_dim"] == 1


def test_rows_without_clusters(spark):
    sizes = spark.createDataFrame([(0, 5), (1, 0)], "cid int, size long")
    assert [tuple(r) for r in layout.grid_layout(sizes, 3).orderBy("row").collect()] == [(0, 1, 5), (1, 1, 0), (2, 0, 0)]
    loads = layout.row_loads(layout.without_warmup(sizes), 3, 2, 10)
    assert [tuple(r) for r in loads.orderBy("row").collect()] == [(0, 25.0), (1, 0.0), (2, 0.0)]


def test_ragged_batches(spark):
    probes = spark.createDataFrame([(1, 1, 0), (1, 2, 2), (1, 3, 1), (1, 4, 4)], "qid long, prank int, cid int")
    got = [tuple(r) for r in layout.batch_schedule(probes, 2, 3).orderBy("row", "prank").select("row", "cid", "batch", "start_col").collect()]
    assert got == [(0, 0, 0, 0), (0, 2, 0, 1), (0, 4, 0, 2), (1, 1, 0, 0)]
