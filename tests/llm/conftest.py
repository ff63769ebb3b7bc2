import pytest

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today"),
    (3, None),
    (4, ""),
    (5, "   \n\t "),
    (6, "short"),
    (7, "word " * 30000),
    (8, "x" * 120000),
    (9, "Ünïcödé ß 日本語 😀 text\r\nwith\x0bbreaks &|<> #1\n\nword word\nword word"),
    (10, "THE QUICK brown fox jumps over the lazy dog near the river bank today"),
    (11, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"),
    (12, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twentyone"),
    (13, "short"),
    (None, "a text without an id, long enough to be cut by fifty byte windows if it counted"),
    (14, "a text without an id, long enough to be cut by fifty byte windows if it counted"),
]


@pytest.fixture
def docs(spark):
    """Nulls, blanks, very long texts, ties, repeated rows, and columns whose names clash with results."""
    rows = [(d, t, "en", "src", len(t) if t else 0, "x", "y", 1) for d, t in TEXTS]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words string, key int"
    return spark.createDataFrame([*rows, rows[0], rows[5]], schema)


@pytest.fixture
def empty(docs):
    return docs.filter("doc_id = -1")
