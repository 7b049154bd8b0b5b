import pytest

LONG = " ".join(f"word{i % 977} the{i % 13} and{i % 7}" for i in range(20_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, fp long, k string, _d string, h string, sequence_id int, lang_pred int, n_dropped int, component long"
TEXTS = [
    (1, "the cat and the dog went to the house of the king", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, " \n\t ", "fr", "b"),
    (5, LONG, "en", None), (6, "le chat et le chien sont dans la maison", "fr", "b"), (7, "le chat et le chien sont dans la maison", "fr", "c"),
    (7, "le chat et le chien sont dans la maison", "fr", "c"), (8, "12345 !!! 678", "en", "d"), (None, "une ligne\nune autre", "fr", "b"), (9, "x", None, "a"), (None, None, None, None),
]


def rows(texts):
    return [(i, t, lang, s, len(t or ""), 1, None, "k", "d", "h", 4, 5, 6, None) for i, t, lang, s in texts]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and long texts, equal rows, extra columns with names that operators might use."""
    return spark.createDataFrame(rows(TEXTS), SCHEMA).cache()


@pytest.fixture(scope="session")
def none(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()
