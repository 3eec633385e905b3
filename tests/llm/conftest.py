import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, digest string, copies int, row int, at int, line string, label int, score double, fp int, n int"
EXTRA = (1, "d", 3, 4, 5, "l", 6, 0.5, 7, 8)


@pytest.fixture
def frame(spark):
    """docs(rows): rows of (doc_id, text, lang, source) with further columns whose names operators use themselves."""
    return lambda rows: spark.createDataFrame([(i, t, g, s, None if t is None else len(t), *EXTRA) for i, t, g, s in rows], DOCS)


@pytest.fixture
def odd():
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    long = "one two three " * 20_000
    return [
        (None, None, None, None), (1, None, "en", "a"), (2, "", "en", None), (3, " \n\t", None, "b"), (4, "word", "en", "b"),
        (5, long, "en", "a"), (6, "the same text of some words", "en", "a"), (6, "the same text of some words", "en", "a"),
        (7, "the same text of some words", None, "c"), (None, "the same text of some words", "en", "c"), (8, "x" * 50_000, "de", "c"),
        (9, "12 34 !!", "de", "c"), (10, "ähnlich İstanbul ß 漢字 🎈", "de", "b"),
    ]
