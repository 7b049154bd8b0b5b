import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.functions.vectors import distances, l2_partial, l2_squared, pair_distances, register_sql, slice_bounds


@given(st.integers(1, 300), st.integers(1, 40))
def test_slices_tile(dim, n):
    b = slice_bounds(dim, n)
    assert b[0][0] == 0 and b[-1][1] == dim and all(x[1] == y[0] for x, y in zip(b, b[1:]))


def test_uneven_and_empty_slices():
    assert slice_bounds(10, 4) == [(0, 2), (2, 5), (5, 7), (7, 10)]
    assert slice_bounds(2, 4) == [(0, 0), (0, 1), (1, 1), (1, 2)]
    with pytest.raises(ValueError):
        slice_bounds(4, 0)


def test_expression_and_kernel_agree_to_the_bit(spark):
    rng = np.random.default_rng(0)
    a, b = (rng.standard_normal((40, 13)).astype(np.float32) for _ in range(2))
    df = spark.createDataFrame([(i, a[i].tolist(), b[i].tolist()) for i in range(40)], "i int, a array<float>, b array<float>")
    got = {r["i"]: (r["d"], r["p"]) for r in df.select("i", l2_squared(F.col("a"), F.col("b")).alias("d"), l2_partial(F.col("a"), F.col("b"), 3, 9).alias("p")).collect()}
    x, y = a.astype(float), b.astype(float)
    assert [got[i][0] for i in range(40)] == np.diag(distances(x, y)).tolist()
    assert [got[i][1] for i in range(40)] == pair_distances(x, y, 3, 9, np.zeros(40)).tolist()


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 20), st.integers(1, 8))
def test_slices_add_up_to_the_bit(dim, n):
    rng = np.random.default_rng(dim * 31 + n)
    x, q = rng.standard_normal((5, dim)), rng.standard_normal((3, dim))
    out = np.zeros((3, 5))
    for lo, hi in slice_bounds(dim, n):
        out = distances(x, q, lo, hi, out)
    assert (out == distances(x, q)).all()


def test_unequal_lengths(spark):
    df = spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<float>, b array<float>")
    assert df.select(l2_squared(F.col("a"), F.col("b"))).first()[0] is None
    with pytest.raises(ValueError):
        distances(np.zeros((1, 2)), np.zeros((1, 3)))


def test_sql_function(spark):
    register_sql(spark)
    assert spark.sql("SELECT l2sq(array(1F, 2F), array(3F, 5F))").first()[0] == 13.0
