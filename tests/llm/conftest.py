import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that the operators use inside.
CLASHING = ("id", "node", "row", "plan", "size", "key", "rn", "label", "bands", "content", "word", "u", "e", "p")


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text, lang, source), with columns whose names clash."""

    def go(rows):
        df = spark.createDataFrame([(i, t, lang, s, None) for i, t, lang, s in rows], SCHEMA)
        for name in CLASHING:
            df = df.selectExpr("*", f"'x' AS `{name}`")
        return df

    return go


LONG = " ".join(f"word{i % 977} tail{i}" for i in range(6000))
ODD = [
    (1, "The quick brown fox jumps over the lazy dog. All Rights Reserved.", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "b"),
    (4, " \t\n ", "fr", "b"),
    (5, LONG, "en", "a"),
    (6, LONG, "en", "c"),
    (7, "one two three", "en", None),
    (7, "one two three", "en", None),
    (None, "le chat dort sur la table rouge", "fr", "c"),
    (9, "日本語 テスト ▁ \x00 é", None, "c"),
]


@pytest.fixture(scope="session")
def odd(make):
    return make(ODD)


@pytest.fixture(scope="session")
def odd_rows():
    return ODD


@pytest.fixture(scope="session")
def empty(make, odd):
    return odd.limit(0)
