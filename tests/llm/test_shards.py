import glob
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestar.llm import arrow_shards, tokens


def expected(docs):
    from tokenizers import Tokenizer

    tok, at, out = Tokenizer.from_file(tokens.default_vocabulary()), 0, []
    for d, t in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        out.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def number(file):
    name = file.split("/")[-1]
    return int(name.split("-")[1]) * arrow_shards.SHARD_NUMBERS + int(name.split("-c")[-1][:3])


def test_round_trip(small):
    docs = [tuple(r) for r in small.select("doc_id", "text").collect()]
    for length in (1024, 7):
        got = arrow_shards.index(small.repartition(5), tokens.default_vocabulary(), length)
        assert sorted(tuple(r)[:4] for r in got.collect()) == expected(docs)


def test_random_access_without_a_copy(spark, small, tmp_path):
    path = str(tmp_path / "shards")
    arrow_shards.write_shards(small.coalesce(1), path, tokens.default_vocabulary(), length=64)
    rows = {r["doc_id"]: r for r in arrow_shards.read_documents(spark, path).collect()}
    files = sorted(glob.glob(path + "/part-*"))
    before = pa.total_allocated_bytes()
    shards = [arrow_shards.open_shard(f) for f in files]
    assert pa.total_allocated_bytes() - before < 1000
    r = rows[17]
    shard = shards[[number(f) for f in files].index(r["shard"])]
    flat = np.concatenate([b.column(1).flatten().to_numpy(zero_copy_only=True) for b in shard])
    mask = np.concatenate([np.asarray(b.column(0).flatten()) for b in shard])
    assert zlib.crc32(flat[r["local_start"] : r["local_start"] + r["n_tokens"]].astype("<u4").tobytes()) == r["ids_crc32"]
    assert mask.sum() == sum(x["n_tokens"] for x in rows.values() if x["shard"] == r["shard"]) and len(mask) % 64 == 0
    assert all(b.column(1).type.list_size == 64 for b in shard)


def test_files_are_plain_arrow_streams(small, tmp_path):
    path = str(tmp_path / "shards")
    arrow_shards.write_shards(small, path, tokens.default_vocabulary())
    for f in glob.glob(path + "/part-*"):
        with open(f, "rb") as g:
            assert pa.ipc.open_stream(g).read_all().schema == arrow_shards.schema(1024)


def test_edges(edge, none):
    docs = [tuple(r) for r in edge.select("doc_id", "text").collect()]
    got = arrow_shards.index(edge, tokens.default_vocabulary(), 128).collect()
    key = lambda r: (str(r[0]), r[2], r[3])
    assert sorted((key(r) for r in got)) == sorted(key(r) for r in expected(docs))
    spans = sorted((r["start"], r["start"] + r["n_tokens"]) for r in got)
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert arrow_shards.index(none, tokens.default_vocabulary()).count() == 0


def test_a_range_makes_several_files(spark, small, tmp_path):
    docs = [tuple(r) for r in small.select("doc_id", "text").collect()]
    long = " ".join(t or "" for _, t in docs)  # more lines than a shard has
    docs.append((docs[0][0] - 1, long))
    docs.append((10**9, long))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for lines in (1, 2, 5):
        got = arrow_shards.index(df, tokens.default_vocabulary(), 32, lines).collect()
        assert sorted(tuple(r)[:4] for r in got) == expected(docs)
    assert len({r["shard"] for r in got}) > 3
    path = str(tmp_path / "several")
    arrow_shards.write_shards(df, path, tokens.default_vocabulary(), 32, lines=5)
    files = sorted(glob.glob(path + "/part-*"))
    assert len(files) > 3
    for f in files:
        assert sum(b.num_rows for b in arrow_shards.open_shard(f)) > 0


def test_lines_of_shards():
    ids = [(i, np.full(n, i, "<u4")) for i, n in enumerate([3, 5000, 1, 1, 9000, 2])]
    for lines in (1, 2, 3, 7):
        out = list(arrow_shards.shard_lines(iter(ids), 4, False, lines))
        shards = [b"".join(out[at : at + lines]) for at in range(0, len(out), lines)]
        got = []
        for s in shards:
            got += [d for b in arrow_shards.open_shard(pa.py_buffer(s)) for d in b.column(2).flatten().to_pylist()]
        assert got == [i for i, _ in ids] and all(line[-1] == 0 for line in out)
    assert list(arrow_shards.shard_lines(iter([]), 4, False, 3)) == []


def test_numbers_of_shards(spark):
    names = ["/a/part-9-c1/part-00003-8f6c13eb-c123-4d7d-ae96-c5828c783109-c002.txt", "/a/part-00012-0f6c13eb-0761-4d7d-ae96-ab5828c78310-c1000.txt"]
    got = spark.createDataFrame([(n,) for n in names], "path string").select(arrow_shards.shard_number(F.col("path"))).collect()
    assert [r[0] for r in got] == [3 * arrow_shards.SHARD_NUMBERS + 2, 12 * arrow_shards.SHARD_NUMBERS + 1000]
