"""Documents with all that operators must take: nulls, empty and long texts, repeated rows, clashing names."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, fp string, score string, label string, id string, row string"
LONG = "lorem ipsum dolor sit amet " * 40_000


def rows():
    texts = [
        (1, "The quick brown fox jumps over the lazy dog. " * 5, "en", "a/x"),
        (2, "The quick brown fox jumps over the lazy dog. " * 5, "en", "a/y"),
        (3, None, "en", "b"),
        (4, "", None, "b"),
        (5, "   \n\t ", "de", None),
        (6, LONG, "en", "b"),
        (7, "Zürich grüßt 東京 🙂 naïve café", "de", "c"),
        (8, "short", "en", "c"),
        (8, "short", "en", "c"),
        (None, "no id here at all", "en", "c"),
        (9, "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" and more", "en", "d/1"),
    ]
    return [(i, t, g, s, len(t) if t is not None else None, "x", "y", "z", "l", "i", "r") for i, t, g, s in texts]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
