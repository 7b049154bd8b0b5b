import pytest
from oracle import rows_of, rows_of_sql

from lodestar.llm import preference, queries


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_same_as_sql(spark, sf):
    d = f"/root/testdata/{sf}"
    assert rows_of(queries.queries()["op3_preference_pairs"](spark, d)) == rows_of_sql(queries.oracle_sql()["op3_preference_pairs"], d)


def pair(spark, chosen, rejected):
    t = "array<struct<role string, text string>>".replace("role string", "role: string").replace("text string", "text: string")
    return preference.format_pairs(spark.createDataFrame([(1, chosen, rejected)], f"pair_id long, chosen {t}, rejected {t}")).first()


def test_prefix_and_masks(spark):
    r = pair(spark, [("user", "hi"), ("assistant", "yes"), ("user", "so")], [("user", "hi"), ("assistant", "no")])
    assert r["n_prefix"] == 1 and r["prompt"] == "<|user|>\nhi<|end|>\n"
    assert r["chosen"] == "<|assistant|>\nyes<|end|>\n<|user|>\nso<|end|>\n" and r["chosen_mask"] == "14-,11+,19-"
    assert sum(int(x[:-1]) for x in r["chosen_mask"].split(",")) == len(r["chosen"])
    assert r["chosen"][14 : 14 + 11] == "yes<|end|>\n"


def test_equal_longer_and_empty(spark):
    a = [("user", "hi"), ("assistant", "yes")]
    assert tuple(pair(spark, a, a))[1:] == (2, "<|user|>\nhi<|end|>\n<|assistant|>\nyes<|end|>\n", "", "", "", "")
    r = pair(spark, a, a[:1])
    assert (r["n_prefix"], r["rejected"], r["rejected_mask"]) == (1, "", "") and r["chosen_mask"] == "14-,11+"
    assert pair(spark, [], a)["n_prefix"] == 0


def test_edges(spark):
    rows = [
        (1, 2, "assistant", None, 0), (1, 1, None, "q", 0), (1, 2, "assistant", None, 0), (None, 1, "user", "lost", 0), (2, 0, "user", "only", 0),
        (3, None, "assistant", "first", 0), (3, 1, "assistant", "x" * 100_000, 0),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int")
    got = {r["pair_id"]: r for r in preference.format_pairs(preference.repeated_answer_pairs(turns)).collect()}
    assert set(got) == {1, 3}
    assert got[1]["n_prefix"] == 3 and got[1]["prompt"].startswith("<|user|>\nq") and got[1]["chosen"] == ""
    assert got[3]["n_prefix"] == 1 and got[3]["rejected"] == "<|assistant|>\nfirst<|end|>\n" and len(got[3]["chosen"]) == 100_000 + 22
    assert preference.format_pairs(preference.repeated_answer_pairs(turns.limit(0))).count() == 0
