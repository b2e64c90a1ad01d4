import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names that the operators use inside; as extra columns they must do no harm.
CLASHES = "id long, label int, score double, kept boolean, size int, a int, b int, of int, recipe int"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table from (doc_id, text) rows, with extra columns that clash."""

    def make(rows, lang="en"):
        base = [(i, t, lang, "s", None if t is None else len(t)) for i, t in rows]
        extra = CLASHES.split(", ")
        df = spark.createDataFrame([r + (None,) * len(extra) for r in base], f"{DOCUMENTS}, {CLASHES}")
        return df.repartition(3)

    return make


LONG = "One two three four five. " * 40_000
ODD = [
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "word"),
    (5, LONG),
    (6, LONG + "x"),
    (7, "same text twice, of more than five words"),
    (8, "same text twice, of more than five words"),
    (8, "same text twice, of more than five words"),
    (None, "a row without an id but with words"),
    (None, None),
    (9, "don't we'll ''s it’s 字 <|endoftext|> Ωσς İ 1234 5 x" + "y" * 70),
    (10, "\x00\x1c ﬁ é"),
    (11, "!!! ... 123"),
    (-5, "same text twice, of more than five words indeed"),
]
