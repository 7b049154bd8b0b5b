from collections import Counter

import corpus_pipeline as cp
from lodestar.llm import lang_id, near_texts, tokens

SF = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "source_mixing", "best_fit_packing"]


def test_run_is_its_stages(spark, small, tmp_path):
    docs = small
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == small.columns and docs.dtypes == small.dtypes
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    last = cp.STAGES[-1][1](spark, docs, SF)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(map(tuple, last.select(names).collect())) == Counter(map(tuple, cp.run(spark, SF).select(names).collect()))


def test_first_three_stages_against_plain_python(spark, small):
    kept = cp.identify_language(spark, small, SF)
    sure = {r["doc_id"] for r in lang_id.identify(small).where("lang_pred <> 'und' and not ambiguous").collect()}
    assert {r["doc_id"] for r in kept.collect()} == sure and len(sure) >= 195
    cleaned = cp.drop_repeated_lines(spark, kept, SF)
    before = {r["doc_id"]: r["text"].split("\n") for r in kept.collect()}
    for r in cleaned.collect():
        lines = iter(before[r["doc_id"]])
        assert all(any(x == y for y in lines) for x in r["text"].split("\n")) and r["n_chars"] == len(r["text"])
    single = cp.drop_near_duplicates(spark, cleaned, SF).collect()
    sets = [near_texts._shingle_set(r["text"], 5) for r in single]
    close = sum(near_texts.jaccard(a, b) >= 0.8 for i, a in enumerate(sets) for b in sets[:i])
    assert close == 0 and len(single) >= 150


def test_last_stage_packs_what_it_gets(spark, small):
    mixed = cp.mix_sources(spark, small, SF).cache()
    rows = cp.pack_sequences(spark, mixed, SF).collect()
    texts = [r["text"] for r in mixed.collect()]
    assert sum(r["length"] for r in rows) == sum(len(x) // 4 + 1 for x in tokens.encode(texts, tokens.default_vocabulary()))


def test_edges(spark, edge, none):
    for docs in (edge, none):
        for _, stage in cp.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == edge.columns
        assert "sequence_id" in cp.STAGES[-1][1](spark, docs, SF).columns
    assert {r["doc_id"] for r in cp.identify_language(spark, edge, SF).collect()} <= {1, 5, 6, 7, 9, None}
