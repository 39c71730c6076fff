import pytest

LONG = "wordy tale of many things " * 4000
TEXT = ("Once the quick brown fox had jumped over the lazy dog, it ran into the dark green forest and slept. "
        "Nobody in the village saw where it went that night. The next morning a small child found its tracks near the river.\nThe end.")
EDGE = "doc_id long, text string, lang string, source string, n_chars long, score string, n_tokens string, node int, KEY int"


def edge_rows():
    return [(1, TEXT, "en", "a", 5, "s", "x", 1, 1), (2, TEXT, "en", "b", 5, None, None, None, None), (3, None, None, None, None, "s", "x", 1, 1),
            (4, "", "en", "a", 0, "s", "x", 1, 1), (None, TEXT.upper(), "en", "a", 5, "s", "x", 1, 1), (6, LONG, "en", "a", 5, "s", "x", 1, 1),
            (7, " \n\n ", None, "a", 3, "s", "x", 1, 1), (8, "12345 !!!", "de", None, 9, "s", "x", 1, 1), (1, TEXT, "en", "a", 5, "s", "x", 1, 1),
            (None, None, None, None, None, None, None, None, None), (9, "x" * 30_000, "en", "a", 1, "s", "x", 1, 1)]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), EDGE).repartition(2)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], EDGE)
