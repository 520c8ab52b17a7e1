import pytest

# One short table of awkward rows for every operator: nulls in each column, empty, blank and very
# long texts, ties, repeated rows, and extra columns whose names clash with internal ones.
LONG = "word%d " * 3000 % tuple(range(3000))
ROWS = [
    (1, "the cat sat on the mat and the dog ran", "en", "a", 5, 7, "x"),
    (2, None, "en", "a", None, 7, None),
    (3, "", None, None, 0, None, "y"),
    (4, "  \n\t ", "fr", "b", 3, 1, "z"),
    (5, LONG, "en", "b", len(LONG), 1, "z"),
    (6, "the cat sat on the mat and the dog ran", "en", "a", 5, 7, "x"),
    (6, "the cat sat on the mat and the dog ran", "en", "a", 5, 7, "x"),
    (None, "sans identité ni source, élève", "fr", None, 1, 1, ""),
    (7, "x" * 20000, "de", "c", 1, 1, ""),
    (8, "mail me: jo.doe@mail.example.org or +1 (555) 123-4567 — 4111 1111 1111 1111\r\n#tag 10.0.0.255", "en", "c", 1, 1, ""),
    (9, "日本語 テキスト ٣٤ ﬁ \U0001F600\x00\x1c", "ja", "c", 1, 1, ""),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk long, word string"


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
