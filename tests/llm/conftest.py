import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, n string, bin long, part long, g string, shard int, score string, kept string, text_sha256 string, y int, dig string, b int"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with columns whose names the operators use inside."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1, "x", 2, 3, "g", 4, "s", "k", "h", 1, "d", 5) for i, t in rows], SCHEMA)

    return make


LONG = " ".join(f"w{i * 7919 % 100_003}" for i in range(30_000))

#: Nulls, empty and blank texts, a repeated row, ties, a very long text, odd characters.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, LONG), (7, "a b c d e f g"), (7, "a b c d e f g"), (None, "no id here at all"), (8, LONG + " end"), (9, "é 漢字 🙂 \x00 ‏"), (10, "a  b\tc d e f g"), (11, "A B C D E F G"), (12, "x" * 50_000)]


@pytest.fixture(scope="session")
def odd(docs_of):
    return docs_of(ODD).cache()


@pytest.fixture(scope="session")
def none(docs_of):
    return docs_of([]).cache()


@pytest.fixture(scope="session")
def labels(spark):
    """None at all."""
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
