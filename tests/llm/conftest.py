import pytest

LONG = "word " * 30_000 + "end"
#: nulls in every column, empty and very long texts, ties and repeated rows, columns whose names an operator might use itself
EDGES = [
    (1, None, None, None, None, "a", 1), (2, "", "en", "b", 0, None, 2), (3, "Same  text\there", "en", "a", 1, "x", None), (4, "Same text here", "en", "a", 1, "x", 4),
    (5, LONG, "en", "b", 1, "x", 5), (6, LONG, "fr", None, 1, "x", 5), (7, "repeated row", "en", "a", 1, "x", 7), (7, "repeated row", "en", "a", 1, "x", 7),
    (8, " \n\t ", "en", "c", 1, "x", 8), (9, "été ÉTÉ œuf 😀", "en", "a", 1, "x", 9), (10, "one", "en", "b", 1, "x", 10), (11, "Same text  here ", "en", "a", 1, "x", 11),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size long"


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
