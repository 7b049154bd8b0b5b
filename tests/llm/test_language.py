import numpy as np
from pyspark.sql import functions as F

from lodestar.llm import lang_id


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lang_id.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert got.count() > 200
    assert got.where("lang_pred = lang").count() / got.count() > 0.99


def test_codewords_are_apart_and_bits_differ():
    for n in (2, 3, 4, 6, 7, 30):
        c = lang_id.codebook(n)
        assert len({tuple(r) for r in c.tolist()}) == n and (np.abs(c.sum(axis=0)) < n).all()
    four = lang_id.codebook(4)
    assert four.shape == (4, 7) and min((a != b).sum() for i, a in enumerate(four) for b in four[:i]) == 4


def test_a_wrong_bit_is_corrected():
    m = lang_id.Model(["a", "b", "c", "d"], lang_id.codebook(4), np.eye(7), np.zeros(7), np.full((4, 7), 1 / 7))
    for i, word in enumerate(m.code):
        for bit in range(7):
            f = word.astype(float) * 4
            f[bit] = -f[bit]
            assert m.scores(f[None, :]).argmax() == i


def test_edges(edge, none):
    got = lang_id.identify(edge).collect()
    assert len(got) == edge.count()
    by = [(r["doc_id"], r["lang_pred"], r["score"]) for r in got]
    assert all(p == "und" and s == 0 for d, p, s in by if d in (2, 3, 4, 8))
    assert all(p in ("en", "fr") and 0 < s <= 1 for d, p, s in by if d in (1, 5, 6, 7))
    assert {r["held_out"] for r in got if r["doc_id"] is None} == {False}
    assert lang_id.identify(none).count() == 0
    assert {r["lang_pred"] for r in lang_id.identify(edge.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_one_language(edge):
    got = lang_id.identify(edge.withColumn("lang", F.lit("en"))).where("doc_id in (1, 6)").collect()
    assert {(r["lang_pred"], r["score"]) for r in got} == {("en", 1.0)}


def test_pieces_of_a_long_text_count_as_one(monkeypatch):
    text = "Some words, and more of them. " * 50
    whole = lang_id.features(text)
    monkeypatch.setattr(lang_id, "_PIECE", 97)
    assert np.abs(lang_id.features(text) - whole).max() < 0.02


def test_only_text_is_looked_at(small):
    model = lang_id.train(small)
    a = lang_id.predict(small, model, ["doc_id"])
    b = lang_id.predict(small.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("zz")), model, ["doc_id"])
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
