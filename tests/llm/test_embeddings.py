import numpy as np
import pytest

from lodestar.llm import sorted_projection as sp
from lodestar.llm.golay_simhash import forest


def brute(x, threshold=0.95):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = u @ u.T >= threshold
    np.fill_diagonal(hit, False)
    return hit.sum(axis=1), forest(len(x), *np.nonzero(hit))


@pytest.mark.parametrize("block", [1024, 16])
def test_against_brute_force(spark, block):
    rng = np.random.default_rng(1)
    centers = rng.standard_normal((40, 32))
    x = np.concatenate([c + rng.standard_normal((n, 32)) * s for c, n, s in zip(centers, [60, 25, *[3] * 38], [0.05, 0.12, *rng.uniform(0.02, 0.3, 38)])]).astype(np.float32)
    x = np.concatenate([x, x[:5], x[100:101]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in sp.near_duplicates(df, block=block).collect())
    n, c = brute(x.astype(float))
    assert got == [(i, int(n[i]), int(c[i]), bool(c[i] == i)) for i in range(len(x))]


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 0.01]), (8, [1.0, 0.0]), (8, [1.0, 0.0]), (9, []), (10, [1.0, 0.0, 0.0]), (11, [-0.0, 5.0]), (12, [0.0, 5.0])]
    df = spark.createDataFrame([(i, e, 1, 2, "x") for i, e in rows], "vec_id long, embedding array<float>, n int, cid int, component string")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in sp.near_duplicates(df).collect()), key=str)
    want = [(1, 4, 1, True), (2, 4, 1, False), (None, 4, 1, False), (8, 4, 1, False), (8, 4, 1, False), (10, 0, 10, True), (11, 1, 11, True), (12, 1, 11, False)]
    want += [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 9)]
    assert got == sorted(want, key=str)
    assert sp.near_duplicates(df.limit(0)).count() == 0


def test_passes_grow_with_the_rows():
    n = [sp.enough_passes(10**e, 0.95, sp.WINDOW) for e in (0, 3, 5, 7, 9, 11)]
    assert n[0] == n[1] == sp.PASSES and n == sorted(n) and 25 < n[3] < n[4] < 80 and n[5] < 140


@pytest.mark.parametrize("rows", [2000, 16000])
def test_recall_of_isolated_pairs(spark, rows):
    """Evenly spread vectors in 64 dimensions, each with one other at cosine 0.951; as many passes as the formula gives for a window of one."""
    rng, cos = np.random.default_rng(rows), 0.951
    a = rng.standard_normal((rows // 2, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal(a.shape)
    b -= (b * a).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    x = np.concatenate([a, cos * a + (1 - cos**2) ** 0.5 * b])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    passes = sp.enough_passes(rows, 0.95, 1, least=1)
    assert passes == {2000: 13, 16000: 18}[rows]
    got = sp.near_duplicates(df, passes=passes, window=1)
    assert got.where("n_links > 0").count() / rows >= 0.97
