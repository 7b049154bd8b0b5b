import random
from collections import defaultdict

import numpy as np

from lodestar.llm import compact_windows as cw
from lodestar.llm.golay_simhash import forest


def prose(n, seed):
    rng = random.Random(seed)
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def test_windows_against_the_definition():
    rng = np.random.default_rng(0)
    v = rng.integers(1, 1 << 40, 400).astype(np.uint64)
    v[[100, 180]], v[50:60] = 0, v[50]
    want = []
    for i in np.flatnonzero(v).tolist():
        a = b = i
        while a > 0 and i - a < cw.HORIZON and v[a - 1] > v[i]:
            a -= 1
        while b < len(v) - 1 and b - i < cw.HORIZON and v[b + 1] >= v[i]:
            b += 1
        if b - a + 1 >= 12:
            want.append((a, i, b))
    assert list(zip(*(x.tolist() for x in cw.windows(v, 12)))) == want and len(want) > 20


def test_planted_passages(spark):
    shared, edited = prose(60, 1), prose(120, 2)
    changed = list(edited)
    changed[40], changed[90] = "other", "another"
    rows = [(1, prose(200, 10) + shared + prose(90, 11)), (2, shared + prose(300, 12)), (3, prose(30, 13) + edited), (4, prose(70, 14) + changed + prose(9, 15)), (5, prose(400, 16)), (6, prose(100, 17) + shared[:40] + prose(100, 18))]
    got = cw.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == {1, 2, 3, 4}
    spans = {r["doc_id"]: (r["start_word"], r["n_words"]) for r in got}
    assert spans[1] == (200, 60) and spans[2] == (0, 60)
    assert spans[3] == (30, 120) and spans[4] == (70, 120)
    assert all(r["class_doc_id"] in (r["doc_id"], {1: 2, 2: 1, 3: 4, 4: 3}[r["doc_id"]]) for r in got)


def test_all_exact_repeats_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    where = defaultdict(set)
    for d, text in docs.select("doc_id", "text").collect():
        w = (text or "").encode().lower().split()
        for i in range(len(w) - 49):
            where[tuple(w[i : i + 50])].add(d)
    want = {d for s in where.values() if len(s) > 1 for d in s}
    got = cw.repeated_passages(docs)
    assert want and want <= {r["doc_id"] for r in got.select("doc_id").distinct().collect()}
    assert got.agg({"similarity": "min"}).first()[0] >= 0.8


def test_edges(spark, edge, none):
    got = cw.repeated_passages(edge)
    assert got.count() == 0 and cw.repeated_passages(none).count() == 0  # one long text, repeated nowhere else
    text = " ".join(prose(80, 3))
    twice = spark.createDataFrame([(None, text), (4, text), (4, text), (9, text + " " + text)], "doc_id long, text string")
    assert {r["doc_id"] for r in cw.repeated_passages(twice).collect()} == {None, 4, 9}
    alone = spark.createDataFrame([(1, text + " z " + text)], "doc_id long, text string")
    assert cw.repeated_passages(alone).count() == 0


def test_blocks_of_long_texts(spark, monkeypatch):
    w = prose(3000, 5)
    rows = [(1, " ".join(w)), (2, " ".join(prose(50, 6) + w[1400:1500]))]
    monkeypatch.setattr(cw, "BLOCK", 200)
    got = cw.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["start_word"], r["n_words"]) for r in got} == {(1, 1400, 100), (2, 50, 100)}


def test_representatives_dealt_to_many_tasks(spark, monkeypatch):
    shared = " ".join(prose(70, 8))
    df = spark.createDataFrame([(i, " ".join(prose(40, 100 + i)) + " " + shared) for i in range(30)], "doc_id long, text string")
    whole = sorted(map(tuple, cw.repeated_passages(df).collect()))
    monkeypatch.setattr(cw, "PER_TASK", 1)
    assert sorted(map(tuple, cw.repeated_passages(df).collect())) == whole and {r[0] for r in whole} == set(range(30))


def test_boilerplate_with_different_continuations(spark):
    """Documents with 40 common words, two and two of which go on with the same 12: whichever stands for a key, pairs are found."""
    line = prose(40, 9)
    rows = [(i, " ".join(prose(60, 1000 + i) + line + prose(12, 2000 + i // 2) + prose(60, 3000 + i))) for i in range(60)]
    got = cw.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["class_doc_id"] // 2) for r in got} == {(i, i // 2) for i in range(60)}
    assert all(50 <= r["n_words"] <= 52 for r in got)


def test_blocks_of_a_key(spark, monkeypatch):
    line = prose(40, 9)
    rows = [(i, " ".join(prose(60, 1000 + i) + line + prose(12, 2000 + i // 2) + prose(60, 3000 + i))) for i in range(40)]
    monkeypatch.setattr(cw, "GROUP", 4)
    got = cw.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == set(range(40))


def test_any_two_functions_make_a_key(spark):
    """Two windows around one passage, of opposite functions."""
    rows = [(j + 11, 5, (60 + j << 32) | 50 << 22 | 50 << 2 | j) for j in (0, 2)] + [(j + 11, 6, (60 + j << 32) | 50 << 22 | 50 << 2 | j) for j in (1, 3)]
    got = cw._candidate_keys(spark.createDataFrame(rows, "key long, _d long, w long"), 46).collect()
    assert sorted(r["_d"] for r in got) == [5, 6]


def copies_of(words, n, seed, low=0.8, high=0.86):
    """n edited copies, each at a similarity of five-word shingles from low to high with the original."""
    rng, out, sets = random.Random(seed), [], lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    while len(out) < n:
        own = list(words)
        for p in rng.sample(range(len(own)), rng.randrange(1, 6)):
            own[p] = f"x{rng.randrange(10**6)}"
        a, b = sets(words), sets(own)
        if low <= len(a & b) / len(a | b) <= high:
            out.append(own)
    return out


def test_families_of_edited_copies(spark):
    """A passage and 20 copies that are near it, but mostly not near each other, each in a document of its own: all are connected."""
    rows, family = [], {}
    for f in range(12):
        passage = prose(100, 50_000 + f)
        for w in [passage, *copies_of(passage, 20, f)]:
            i = len(rows)
            family[i] = f
            rows.append((i, " ".join(prose(50, 60_000 + i) + w + prose(50, 70_000 + i))))
    got = cw.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(family[r["doc_id"]] == family[r["class_doc_id"]] for r in got)
    links = np.array([(r["doc_id"], r["class_doc_id"]) for r in got])
    label = forest(len(rows), links[:, 0], links[:, 1])
    joined = sum(max(list(label[f * 21 : f * 21 + 21]).count(x) for x in label[f * 21 : f * 21 + 21]) for f in range(12))
    assert joined >= 0.97 * len(rows)


def test_pairs_near_the_threshold(spark):
    """Recall of single pairs at 0.8 to 0.86, passages of 60 to 150 words."""
    rows = []
    for f in range(150):
        passage = prose(60 + f % 90, 80_000 + f)
        for w in (passage, copies_of(passage, 1, f)[0]):
            rows.append((len(rows), " ".join(prose(40, 90_000 + len(rows)) + w + prose(40, 95_000 + len(rows)))))
    got = {(r["doc_id"], r["class_doc_id"]) for r in cw.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(a // 2 == b // 2 for a, b in got) and len({a // 2 for a, b in got if a != b}) >= 0.95 * 150


def test_passages_against_all_windows():
    """Whatever window of one text has a window of the other at 0.8 or more is found, edits at the ends and dense edits included."""
    rng, hit, want = random.Random(2), 0, 0
    for turn in range(120):
        base = prose(rng.randrange(50, 120), turn)
        own = list(base)
        for p in rng.sample(range(len(own)), rng.randrange(0, 7)):
            own[p] = f"x{p}"
        a, b = (cw.shingle_hashes(" ".join(w), 5) for w in (base, own))
        near = any(len(x & y) >= 0.8 * len(x | y) for i in range(len(a) - 45) for x in [set(a[i : i + 46].tolist())] for y in [set(b[i : i + 46].tolist())])
        found = cw.passages(a, b, 46, 0.8)
        assert all(len(set(a[s:e].tolist()) & set(b[x:y].tolist())) >= 0.8 * len(set(a[s:e].tolist()) | set(b[x:y].tolist())) and min(e - s, y - x) >= 37 for s, e, x, y, _ in found)
        want += near
        hit += near and bool(found)
    assert want > 60 and hit == want


def test_edit_near_the_start_and_dense_edits():
    base = prose(50, 1)
    own = list(base)
    own[3] = "x"
    a, b = (cw.shingle_hashes(" ".join(w), 5) for w in (base, own))
    assert cw.passages(a, b, 46, 0.8) and cw.passages(b, a, 46, 0.8)
    base = prose(200, 2)
    own = list(base)
    for p in [*range(5, 70, 9), 100, *range(135, 200, 9)]:
        own[p] = "x"
    a, b = (cw.shingle_hashes(" ".join(w), 5) for w in (base, own))
    assert any(s <= 75 and e >= 120 for s, e, *_ in cw.passages(a, b, 46, 0.8))


def test_rare_shingles_are_met_by_whatever_passes():
    """A window of 46 with 40 places and two thirds of its shingles that another region has: one of the chosen places is among them."""
    rng, hit = np.random.default_rng(3), 0
    for turn in range(400):
        a = rng.integers(0, rng.choice([8, 60, 4000]), rng.integers(46, 130))
        n = rng.integers(1, 9, 4000) * (rng.random(4000) < 0.9) + 2
        lacks = rng.random(4000) < 0.12
        n[lacks & (rng.random(4000) < 0.5)] = 1  # some that no other region has
        there = ~lacks[a]
        chosen = cw.rare_shingles(a, n[a], 46, 0.8)
        if any(there[i : i + 46].sum() >= 40 and lacks[np.unique(a[i : i + 46])].mean() <= 1 / 3 for i in range(len(a) - 45)):
            hit += 1
            assert there[chosen].any()
    assert hit > 50
    assert not len(cw.rare_shingles(np.arange(100), np.ones(100, np.int64), 46, 0.8)) and not len(cw.rare_shingles(np.arange(45), np.full(45, 9), 46, 0.8))


def test_a_common_line_is_not_compared_by_all_its_documents(spark, monkeypatch):
    """Of 300 regions with the same line, those two of other components that share more come to be compared, each once; before, all were."""
    from pyspark.sql import functions as F

    line = prose(14, 9)
    rows = [(i, " ".join(prose(60, 1000 + i // (2 if i < 2 else 1)) + line + prose(60, 3000 + i))) for i in range(300)]
    source = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_d", F.col("doc_id"))
    huge = source.select(F.lit(7).cast("long").alias("k"), "_d", F.col("_d").alias("c"), F.lit(300).cast("long").alias("kinds"), F.lit(129).cast("long").alias("ab"))
    monkeypatch.setattr(cw, "GROUP", 16)
    got, place = cw._by_rare_shingles(huge, source, 5, 46, 0.8)
    found = got.collect()
    cw.remove(spark, place)
    assert {r["_d"] for r in found} == {0, 1} and all(list(map(tuple, r["at"])) == [(-1, 0)] for r in found)


def test_blocks_of_a_rare_shingle(spark, monkeypatch):
    """More regions than a block holds share a rare shingle: each that has it as such meets each other one in some pair of blocks."""
    from pyspark.sql import functions as F

    shared = prose(60, 9)
    rows = [(i, " ".join(prose(20, 1000 + i) + shared + prose(20, 3000 + i))) for i in range(40)]
    source = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_d", F.col("doc_id"))
    huge = source.select(F.lit(7).cast("long").alias("k"), "_d", F.col("_d").alias("c"), F.lit(40).cast("long").alias("kinds"), F.lit(95).cast("long").alias("ab"))
    monkeypatch.setattr(cw, "GROUP", 8)
    got, place = cw._by_rare_shingles(huge, source, 5, 46, 0.8)
    met = defaultdict(set)
    for r in got.collect():
        for i, j in r["at"]:
            met[r["k"], i, j].add(r["_d"])
    cw.remove(spark, place)
    pairs = {(x, y) for s in met.values() for x in s for y in s}
    assert pairs == {(x, y) for x in range(40) for y in range(40)} and max(map(len, met.values())) < 40


def test_partners_from_either_side():
    """60 repeats of a shingle against 41 of it and others: found from the first region's side, whichever label is the most common."""
    a, b = np.full(60, 5, np.uint64), np.concatenate([np.full(41, 5), np.arange(100, 140)]).astype(np.uint64)
    other = np.arange(500, 560).astype(np.uint64)
    for sets, label in (([a, b, other], [1, 2, 2]), ([a, b, other], [1, 2, 1]), ([b, a], [1, 2]), ([a, b], [1, 2])):
        got = list(cw.partners(sets, label, 46, 0.8, every=True))
        assert len(got) == 1 and sets[got[0][0]] is a and sets[got[0][1]] is b


def test_a_key_split_by_rare_shingles(spark, monkeypatch):
    """Documents with 40 common words, two and two of which go on alike: found as from all pairs."""
    line = prose(40, 9)
    rows = [(i, " ".join(prose(60, 1000 + i) + line + prose(12, 2000 + i // 2) + prose(60, 3000 + i))) for i in range(40)]
    monkeypatch.setattr(cw, "GROUP", 4)
    got = cw.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["class_doc_id"] // 2) for r in got} == {(i, i // 2) for i in range(40)}


def test_texts_that_are_not_asked_for_are_not_shuffled(spark):
    """One text for each document asked for; the others go before the exchange."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)] * 2, "_d long, text string").repartition(3)
    got = cw._texts_of(docs, spark.createDataFrame([(7,), (7,), (9,), (60,)], "_d long"))
    assert sorted(map(tuple, got.collect())) == [(7, "text 7"), (9, "text 9")]
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("LeftSemi") > plan.index("Aggregate")  # below the aggregate, which shuffles
