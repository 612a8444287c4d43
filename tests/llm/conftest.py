import pytest

LONG = " ".join(f"word{i % 997}" for i in range(30_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog.\nIt was seen by all.\nNobody minded at all.", "en", "a"),
    (2, None, None, None),
    (3, "", "en", ""),
    (4, "The quick brown fox jumps over the lazy dog.\nIt was seen by all.\nNobody minded at all.", "en", "a"),
    (4, "The quick brown fox jumps over the lazy dog.\nIt was seen by all.\nNobody minded at all.", "en", "a"),
    (None, "a text without an id", "en", "b"),
    (5, "   \n\n\t ", "de", "b"),
    (6, LONG, "en", "c"),
    (7, "é漢字 – ümlaut\n" * 4, None, "c"),
    (8, "x", "fr", None),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Rows that are awkward in every way, with columns whose names clash with those that operators use."""
    extra = [(*r, "row", 1.5, "gone", 3, 4) for r in ROWS]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, row string, fp double, c0 string, nth int, n_chars long").cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
