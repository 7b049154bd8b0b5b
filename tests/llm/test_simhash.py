import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestar.llm import common
from lodestar.llm import golay_simhash as gs
from lodestar.llm import near_texts as nt


def test_words_two_bits_apart_share_an_index():
    """For every syndrome, which stands for all words, and every change of up to two bits."""
    base = np.arange(1 << 11)
    own = gs.codewords(base)
    assert {(x >= 0).sum() for x in own} == {1, 6}
    for n in (1, 2):
        for bits in combinations(range(23), n):
            other = gs.codewords(base ^ sum(1 << i for i in bits))
            assert ((own[:, :, None] == other[:, None, :]) & (own[:, :, None] >= 0)).any(axis=(1, 2)).all()


def test_keys_meet_for_all_pairs_in_reach():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    b = a.copy()
    for _ in range(2):
        b ^= np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)
    (ra, ka), (rb, kb) = gs.keys(a), gs.keys(b)
    sets = [set() for _ in a]
    for r, k in zip(ra.tolist(), ka.tolist()):
        sets[r].add(k)
    assert {r for r, k in zip(rb.tolist(), kb.tolist()) if k in sets[r]} == set(range(3000))


def slow_fingerprint(text, size=3):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    s = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(small, edge):
    for docs in (small, edge):
        for r in docs.select("doc_id", "text").collect():
            assert gs.fingerprint(gs.shingle_hashes(r["text"], 3)) == slow_fingerprint(r["text"])
    # Spark's own hash is the same function
    assert docs.sparkSession.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] == np.uint64(xxhash.xxh64_intdigest(b"a b c", 42)).astype(np.int64)


@pytest.mark.parametrize("block", [2048, 8])
def test_links_against_brute_force(spark, block):
    rng = np.random.default_rng(4)
    seeds = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = {int(x) for x in seeds}
    for x in seeds[:20].tolist():
        for _ in range(25):
            for _ in range(rng.integers(1, 4)):
                x ^= 1 << int(rng.integers(0, 64))
            fps.add(x)
    u = np.array(sorted(fps), np.uint64)
    df = spark.createDataFrame([(int(v),) for v in u.view(np.int64)], "fp long")
    at = {int(v): i for i, v in enumerate(u.view(np.int64))}
    got = [(at[r["u"]], at[r["v"]]) for r in gs.links(df, 2, block).collect()]
    want = gs.forest(len(u), *np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= 2))
    a, b = (np.array(x, dtype=np.int64) for x in zip(*got))
    assert (gs.forest(len(u), a, b) == want).all() and len(set(want.tolist())) < len(u)


def test_query_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = gs.near_duplicates(docs).toPandas()
    u = np.array([int(x, 16) for x in got.fingerprint], np.uint64)
    label = gs.forest(len(u), *np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= 2))
    assert (got.groupby(label).doc_id.transform("min") == got.component_id).all() and got.component_id.nunique() < len(got)


def test_edges(edge, none):
    got = gs.near_duplicates(edge).collect()
    assert len(got) == edge.count()
    zero = [r for r in got if r["fingerprint"] == "0" * 16]
    assert {r["doc_id"] for r in zero} == {2, 3, 4, None} and {r["component_id"] for r in zero} == {2}
    assert {r["component_id"] for r in got if r["doc_id"] in (6, 7)} == {6}
    assert gs.near_duplicates(none).count() == 0


def test_components(spark):
    from lodestar.llm.common import components

    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, i) for i in range(5001, 5100)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    label = gs.forest(6000, *map(np.array, zip(*edges)))
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    assert got == {n: int(label[n]) for n in nodes}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- near-duplicate texts


def test_near_texts_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    sets = [nt._shingle_set(r["text"], 5) for r in rows]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and nt.jaccard(sets[i], sets[j]) >= 0.8]
    want = gs.forest(len(sets), *map(np.array, zip(*pairs)))
    found = {r["doc_id"]: r["component"] for r in nt.groups(docs.withColumn("_d", F.xxhash64("doc_id", "text"))).collect()}
    got = [found[r["doc_id"]] for r in rows]
    linked = sum(got[i] == got[j] for i, j in pairs)
    assert linked >= 0.99 * len(pairs) and len(pairs) > 30
    together = {}
    for g, w in zip(got, want.tolist()):
        together.setdefault(g, set()).add(w)
    assert all(len(s) == 1 for s in together.values())  # nothing is linked that isn't


def test_one_of_each_group_stays(spark, edge, none):
    kept = nt.drop_near_duplicates(edge)
    assert kept.columns == edge.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert ids == sorted([1, 2, 5, 6, 8, 9, None], key=str)
    assert nt.drop_near_duplicates(none).count() == 0


def test_threes_share_no_pair():
    seen = [frozenset(p) for t in nt.THREES for p in combinations(t, 2)]
    assert len(seen) == len(set(seen)) and {s for t in nt.THREES for s in t} == set(range(nt.SEGMENTS))


def test_near_texts_where_the_nearest_fails(spark):
    """Template pages at about 0.7 to each other with pairs at 0.8 or more among them, against brute force."""
    rng = random.Random(4)
    base, texts = [f"b{i}" for i in range(400)], []
    for i in range(60):
        own = list(base)
        for p in rng.sample(range(0, 400, 5), 6):
            own[p] = f"x{i}_{p}"
        texts.append(" ".join(own))
        for p in rng.sample(range(2, 400, 5), 8):
            own[p] = f"y{i}_{p}"
        texts.append(" ".join(own))
    sets = [nt._shingle_set(t, 5) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if nt.jaccard(sets[a], sets[b]) >= 0.8]
    want = gs.forest(len(texts), *np.array(links).T)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"] for r in nt.drop_near_duplicates(docs).collect()}
    assert len(set(want.tolist())) > 1 and got == set(want.tolist())


def test_near_texts_keys_meet():
    """Pairs at exactly 0.8: hardly any shares no key."""
    rng, met = np.random.default_rng(8), 0
    for _ in range(4):
        h = [rng.integers(0, 1 << 63, 200, dtype=np.uint64) for _ in range(500)]
        a, b = (nt.soft_keys(nt.nearest_codewords(np.stack([nt.votes(x[s]) for x in h]))) for s in (slice(0, 180), slice(20, 200)))
        met += sum(len(np.intersect1d(x, y)) > 0 for x, y in zip(a, b))
    assert met >= 0.995 * 2000


@pytest.mark.parametrize("at_once", [0, 1_000])
def test_components_in_rounds_and_at_once(spark, at_once):
    r = random.Random(4)
    edges = [(r.randrange(-150, 150), r.randrange(-150, 150)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(200)] + [(7, 7), (None, 3)]
    label = {x: x for u, v in edges if u is not None and u != v for x in (u, v)}
    for _ in label:
        for u, v in edges:
            if u is not None and u != v:
                label[u] = label[v] = min(label[u], label[v])
    found = common.components(spark.createDataFrame(edges, "u long, v long").repartition(5), at_once).collect()
    assert len(found) == len(label) and {x["id"]: x["component"] for x in found} == label
    assert common.components(spark.createDataFrame([], "u long, v long"), at_once).collect() == []


@pytest.mark.parametrize("per_bucket", [nt.BUCKET_KEYS, 1])
def test_repeated_keys_are_counted_where_they_are_dealt(spark, monkeypatch, per_bucket):
    monkeypatch.setattr(nt, "TEXTS", 7)
    rng = np.random.default_rng(5)
    near = np.stack([np.stack([rng.permutation(9)[: nt.NEAREST] + (4087 if s % 2 else 0) for s in range(nt.SEGMENTS)]) for _ in range(40)]).astype(np.int16)
    count = np.unique(nt.soft_keys(near).ravel(), return_counts=True)
    found = nt.repeated_keys(spark.createDataFrame([(bytearray(x.tobytes()),) for x in near], "near binary").repartition(3), per_bucket)
    assert sorted(r["k"] for r in found.collect()) == count[0][count[1] > 1].tolist() and (count[1] == 1).any() and (count[1] > 2).any()
    assert "HashAggregate" not in found._jdf.queryExecution().executedPlan().toString()  # no table of all keys in the JVM
