import pytest
from oracle import rows_of, rows_of_sql

from lodestar.llm import mixing, queries


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_same_as_sql(spark, sf):
    d = f"/root/testdata/{sf}"
    assert rows_of(queries.queries()["op7_source_mixing"](spark, d)) == rows_of_sql(queries.oracle_sql()["op7_source_mixing"], d)


def test_shares_and_caps(small):
    rows = mixing.mix_report(small).collect()
    by = {}
    for r in rows:
        s = by.setdefault(r["source_size"], [r["target"], 0, 0])
        s[1] += r["taken"]
        s[2] = max(s[2], r["size"])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    total = sum(r["size"] for r in rows)
    assert sum(r["taken"] for r in rows) <= 1.5 * total
    assert all(abs(taken - target) <= biggest + 1e-6 for target, taken, biggest in by.values())


def test_mix_is_the_report(small):
    taken = {r["doc_id"]: r["taken"] // max(1, r["size"]) for r in mixing.mix_report(small).collect()}
    rows = mixing.mix(small)
    assert rows.columns == small.columns
    got = {r["doc_id"]: r["count"] for r in rows.groupBy("doc_id").count().collect()}
    assert got == {d: n for d, n in taken.items() if n}
    assert sorted(map(str, mixing.mix(small).collect())) == sorted(map(str, mixing.mix(small.repartition(7)).collect()))


def test_targets_by_hand(spark):
    sizes = spark.createDataFrame([("a", False, 10), ("b", False, 100), ("c", False, 100), ("", True, 90)], "_mx_s string, _mx_n boolean, source_size long")
    got = {(r["_mx_s"], r["_mx_n"]): r["target"] for r in mixing.source_targets(sizes).collect()}
    # a stops at 20; 430 are left for weights 2, 1, 5 (b, c, null), null stops at 180; 250 for 2 and 1
    assert got[("a", False)] == 20 and got[("", True)] == 180
    assert abs(got[("b", False)] - 250 * 2 / 3) < 1e-9 and abs(got[("c", False)] - 250 / 3) < 1e-9


def test_edges(edge, none):
    rows = mixing.mix_report(edge).collect()
    assert len(rows) == edge.count() and all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert mixing.mix_report(none).count() == 0 and mixing.mix(none).count() == 0
    assert mixing.mix(edge).columns == edge.columns
    empty = mixing.mix_report(edge.where("doc_id in (2, 3)")).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in empty] == [(0, 0.0, 0)] * 2


def test_buckets_grow_with_the_rows_and_change_nothing(small, monkeypatch):
    assert [mixing.n_buckets(n) for n in (0, 10**6, 1024 * 8192, 1024 * 8192 + 1, 2 * 10**10)] == [1024, 1024, 1024, 2048, 1 << 22]
    want = sorted(map(str, mixing.mix_report(small).collect()))
    for least, rows in ((1, 10**9), (1, 1), (1 << 30, 1)):
        monkeypatch.setattr(mixing, "BUCKETS", least)
        monkeypatch.setattr(mixing, "BUCKET_ROWS", rows)
        assert sorted(map(str, mixing.mix_report(small).collect())) == want
