from collections import Counter, defaultdict

from lodestar.llm import line_templates as lt


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_variable_fields(spark):
    texts = [f"own words {'abcdefghijkl'[i]} here\nPage 7{i} of the great book, printed in 19{i}0\nmore {'abcdefghijkl'[i]}" for i in range(12)]
    got = texts_of(lt.drop_lines(docs_of(spark, texts), min_docs=10))
    assert got[0] == texts[0] and all("Page" not in got[i] and got[i].count("\n") == 1 for i in range(1, 12))


def test_generalises_words_by_comparison(spark):
    names = "ann bob cy dan eve flo gus hal ida jon kim lou".split()
    texts = [f"{n} says x{n}\nPosted by the user {n} on our friendly local news forum" for n in names]
    got = texts_of(lt.drop_lines(docs_of(spark, texts), min_docs=10))
    assert sum("Posted" in t for t in got.values()) == 1


def test_prose_and_rare_lines_stay(spark):
    texts = [f"The cat {w} here\nand then {w}" for w in "runs sits eats naps hops digs hides plays".split()]
    assert texts_of(lt.drop_lines(docs_of(spark, texts), min_docs=10)) == dict(enumerate(texts))


def test_against_brute_force_for_exact_lines(small):
    """With a similarity of one, a template is a line with its digits masked."""
    rows = small.select("doc_id", "text").collect()
    docs, first = defaultdict(set), {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        for i, line in enumerate((r["text"] or "").split("\n")):
            if m := lt.masked(line):
                docs[m].add(r["doc_id"])
                first.setdefault(m, (r["doc_id"], i))
    want = Counter()
    for r in rows:
        for i, line in enumerate((r["text"] or "").split("\n")):
            m = lt.masked(line)
            want[r["doc_id"]] += bool(m) and len(docs[m]) >= 4 and first[m] != (r["doc_id"], i)
    got = lt.drop_lines(small, similarity=1.0, min_docs=4).collect()
    assert {r["doc_id"]: r["n_dropped"] for r in got} == dict(want) and sum(want.values()) > 20


def test_leaf_finds_what_a_scan_finds():
    import random

    rng = random.Random(1)
    lines = [[rng.choice("ab") + rng.choice("xy") for _ in range(9)] for _ in range(300)]
    leaf, leaders = lt.Leaf(9, 0.7), []
    for t in lines:
        want = next((i for i, o in enumerate(leaders) if sum(x != y for x, y in zip(t, o)) <= 2), len(leaders))
        if want == len(leaders):
            leaders.append(t)
        assert leaf.add(t) == want


def test_edges(edge, none):
    got = lt.drop_lines(edge.drop("n_dropped"), min_docs=2).collect()
    assert len(got) == edge.count() and {r["text"] for r in got if r["doc_id"] == 2} == {None}
    by = {r["doc_id"]: r for r in got}
    assert by[6]["text"].startswith("le chat") and by[7]["text"] == "" and by[7]["n_dropped"] == 1
    assert lt.drop_lines(none.drop("n_dropped")).count() == 0
    assert lt.drop_lines(edge, ("a", "b")).columns == [*edge.columns, "a", "b"]


def test_hot_leaf_does_not_depend_on_partitions(spark, monkeypatch):
    """A template with a word that changes, in a leaf of many parts and partitions."""
    names = ["".join(chr(97 + i // 26**j % 26) for j in range(3)) for i in range(3, 9000, 720)]
    texts = [f"{n} says x{n}\nPosted by the user {n} on our friendly local news forum" for n in names]
    other = [f"Posted by the q{chr(97 + i % 26)}{chr(97 + i // 26)} " + " ".join(f"{c}{chr(97 + i % 26)}{chr(97 + i // 26)}" for c in "abcdefg") for i in range(300)]
    whole = texts_of(lt.drop_lines(docs_of(spark, texts + other), min_docs=10))
    assert sum("Posted by the user" in t for t in whole.values()) == 1
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "12")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert texts_of(lt.drop_lines(docs_of(spark, texts + other), min_docs=10)) == whole
        monkeypatch.setattr(lt, "PART", 20, raising=False)
        assert texts_of(lt.drop_lines(docs_of(spark, texts + other), min_docs=10)) == whole
        monkeypatch.setattr(lt, "BLOCK", 8, raising=False)
        assert texts_of(lt.drop_lines(docs_of(spark, texts + other), min_docs=10)) == whole
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def slow_drop(rows, depth=3, similarity=0.7, min_docs=10, least_fixed=5):
    """The docstring read line by line: doc_id -> lines dropped."""
    places = defaultdict(list)
    for doc_id, text in rows:
        for i, line in enumerate((text or "").split("\n")):
            if m := lt.masked(line):
                t = m.split(" ")
                places[len(t), *t[:depth]].append((m, doc_id, i))
    docs, lines = defaultdict(set), defaultdict(list)
    for leaf, held in places.items():
        groups = []
        for m in sorted({m for m, _, _ in held}, key=lambda m: m.encode()):
            t = m.split(" ")
            most = int(len(t) * (1 - similarity) + 1e-9)
            g = next((g for g in groups if sum(x != y for x, y in zip(t, g[0])) <= most), None)
            if g is None:
                groups.append(g := (t, list(t), []))
            g[1][:] = [x if x == y else lt.FIELD for x, y in zip(g[1], t)]
            g[2].append(m)
        named = {m: " ".join(g[1]) if sum(x != lt.FIELD for x in g[1]) >= least_fixed else m for g in groups for m in g[2]}
        for m, doc_id, i in held:
            docs[leaf, named[m]].add(doc_id)
            lines[leaf, named[m]].append((doc_id, i))
    gone = Counter()
    for k, held in lines.items():
        if len(docs[k]) >= min_docs:
            gone.update(d for d, _ in sorted(held)[1:])
    return gone


def test_query_against_brute_force_at_its_own_parameters(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = slow_drop(docs.select("doc_id", "text").collect())
    got = {r["doc_id"]: r["n_dropped"] for r in lt.drop_lines(docs).collect() if r["n_dropped"]}
    assert got == dict(want) and sum(want.values()) > 20


def test_many_lines_of_one_leaf_against_brute_force(spark):
    """Words that change, in one leaf: the same at 1, 8 and 64 partitions without coalescing."""
    import random

    rng = random.Random(3)
    rows = [(i, f"alert from host {rng.choice('xyzuvw') * 3}{chr(97 + i % 26)} with state {rng.choice(['up', 'down', 'lost'])} in the north rack today") for i in range(100)]
    want = slow_drop(rows)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for n in (1, 8, 64):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            got = {r["doc_id"]: r["n_dropped"] for r in lt.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["n_dropped"]}
            assert got == dict(want) and sum(want.values()) == 99
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_leafs_time_grows_with_its_lines():
    import random

    rng = random.Random(5)
    words = [f"v{i}" for i in range(300)]

    def tried(n):
        calls, leaf = 0, lt.Leaf(12, 0.7, 3)
        for _ in range(n):
            tokens = ["a", "b", "c", *rng.choices(words, k=9)]
            parts = [" ".join(tokens[x:y]) for x, y in leaf.runs]
            calls += sum(len(leaf.found.get((k, *(parts[i] for i in k)), ())) for k in leaf.keys)
            leaf.add(tokens)
        return calls

    assert tried(4000) < 4000  # a group looked at for each line, at most


def test_names_that_clash(spark):
    df = spark.createDataFrame([(1, "a b", 5, 6, 7)], "doc_id long, text string, n_lines int, n_dropped int, n_lines_ int")
    got = lt.drop_lines(df)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped", "n_lines_", "n_lines__", "n_dropped_"] and got.count() == 1
