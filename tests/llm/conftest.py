import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, line string, word string, n bigint, ids string, `meta.url` string, `__x` string, __text string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs, with columns whose names the operators use inside."""

    def docs(rows, langs=None, sources=None):
        full = [(d, t, (langs or {}).get(d, "en"), (sources or {}).get(d, "src"), len(t or ""), "k", "l", "w", 1, "i", "u", "x", "t") for d, t in rows]
        return spark.createDataFrame(full, DOCS)

    return docs


@pytest.fixture(scope="session")
def odd():
    """Texts and ids that are null, empty, repeated, tied, long or not ASCII."""
    long = " ".join(f"w{k % 977}" for k in range(30_000))
    return [(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (4, " \t\n\x0b\x0c\r"), (5, "A b C"), (6, "   é\U0001f600İ K"), (7, long), (8, long), (None, "a b c"), (9, "x" * 3000), (10, "one\n\n\none\ntwo\x00three")]
