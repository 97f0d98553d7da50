import pytest

LONG = "the quick brown fox jumps over the lazy dog and runs away " * 2000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, fp string, spans string, text_id string, _key string, n_bytes string, shard string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and columns with clashing names."""
    rows = [(1, None, None, "a", 0), (2, "", "en", "a", 0), (3, LONG, "en", "b", len(LONG)), (4, "short text here", "en", None, 15), (4, "short text here", "en", None, 15),
            (None, "no key at all", None, "c", 13), (6, "Ünïcödé ß 漢字 İ \x00 sign", "de", "c", 18), (7, "short text here", "fr", "a", 15), (8, "12 34 -- !!", None, "a", 11)]
    return spark.createDataFrame([(*r, *["x"] * 7) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
