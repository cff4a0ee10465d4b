import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, score string, _hash string, node string, _row string, _identity string"


def prose(n, seed=0):
    """Words of a small vocabulary in a fixed irregular order."""
    words = ["the", "river", "of", "stone", "and", "a", "lamp", "under", "green", "hills", "goes", "by", "night", "slow", "boats"]
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(words[x // 65536 % len(words)] + ("" if x % 3 else str(x % 97)))
    return " ".join(out)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text, lang, source), with further columns whose names the operators use themselves."""

    def make(rows):
        return spark.createDataFrame([(i, t, lang, s, 1, "r", "s", "h", "n", "w", "y") for i, t, lang, s in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null ids, texts, languages and sources, empty and blank texts, a very long text, copies and repeated rows."""
    long = prose(60_000, 5)
    return [
        (1, prose(80, 1), "en", "a"), (2, prose(80, 1), "en", "b"), (3, None, "en", "a"), (4, "", None, None), (5, " \t\n ", "de", None),
        (6, long, "en", "a"), (7, prose(60, 2) + "\n" + prose(60, 2), None, "b"), (None, prose(70, 3), "de", "a"),
        (None, None, None, None), (8, prose(90, 4), "de", "b"), (8, prose(90, 4), "de", "b"), (9, "one", "en", "é"), (10, "12 34 !", "de", "b"),
    ]


@pytest.fixture(scope="session")
def odd_docs(make_docs, odd_rows):
    return make_docs(odd_rows)


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])
