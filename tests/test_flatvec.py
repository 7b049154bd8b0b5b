import struct

import pytest

from lodestar.operators.search import query_set
from lodestar.sources import flatvec


def test_round_trip_in_ranges(spark, tmp_path):
    rows = [(i * 3, [float(i), i / 7]) for i in range(50)]
    path = str(tmp_path / "v.bin")
    flatvec.write_vectors(spark.createDataFrame(rows[::-1], "vec_id long, embedding array<float>").repartition(5), path)
    got = flatvec.read_vectors(spark, path, rows_per_partition=7)
    assert got.rdd.getNumPartitions() == 8
    assert [(r["vec_id"], r["embedding"][0]) for r in got.orderBy("vec_id").collect()] == [(i, float(i)) for i in range(50)]


def test_groundtruth(spark, tmp_path):
    path = tmp_path / "gt.bin"
    path.write_bytes(struct.pack("<ii6i", 2, 3, 5, 6, 7, 8, 9, 10))
    assert [tuple(r) for r in flatvec.read_groundtruth(spark, str(path)).orderBy("qid", "rk").collect()] == [(0, 1, 5), (0, 2, 6), (0, 3, 7), (1, 1, 8), (1, 2, 9), (1, 3, 10)]


@pytest.mark.parametrize("data", [b"\1\0\0", struct.pack("<ii", 0, 3), struct.pack("<ii", 3, -1), struct.pack("<ii2f", 1, 3, 1, 2)])
def test_bad_files(tmp_path, data):
    path = tmp_path / "bad.bin"
    path.write_bytes(data)
    with pytest.raises(ValueError):
        flatvec.header(str(path))


def test_nothing_or_ragged_is_not_written(spark, tmp_path):
    for rows in ([], [(1, [1.0]), (2, [1.0, 2.0])]):
        with pytest.raises(ValueError):
            flatvec.write_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), str(tmp_path / "x.bin"))


def test_stream_of_queries(spark, tmp_path):
    from lodestar.operators import kmeans, search
    from lodestar.streaming.search import search_stream

    v = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(60)], "vec_id long, embedding array<float>")
    index = kmeans.build_index(v, 4, 1)
    v.where("vec_id % 20 = 0").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(v.schema).parquet(str(tmp_path / "in"))
    search_stream(stream, index, 2, 3, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("qid", "rk", "vec_id").collect())
    want = search.ivf_search(index, query_set(v.where("vec_id % 20 = 0")), 2, 3)
    assert got == sorted(tuple(r) for r in want.select("qid", "rk", "vec_id").collect())
