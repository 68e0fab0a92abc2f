import pytest

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Null in every column, empty and blank texts, ties, repeated rows, odd characters, a long text.
ODD = [
    (1, "the cat sat on the mat and the dog ran away from the cat", "en", "a", 5), (1, "the cat sat on the mat and the dog ran away from the cat", "en", "a", 5), (2, None, "en", None, None), (None, "no id here at all", None, "b", 1),
    (None, None, None, None, None), (3, "", "xx", "a", 0), (4, " \n\t \r\n", "fr", "b", 3), (5, "a\x00b é́ \U0001f600 <|endoftext|> can't x y z　w", "de", "c", 2), (6, "word " * 30_000, "en", "a", 150_000),
    (7, "x" * 20_000, "es", "c", 20_000), (8, "Released under the MIT License.\nReleased under the MIT License.\n", "en", "", 9), (-9, "negative id", "en", "a", 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, COLUMNS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def clashing(odd):
    """The odd rows with more columns, named like those the operators make."""
    from pyspark.sql import functions as F

    names = "size start length ids piece score key n f1 f2 rid bucket sketch media chunk target _text _words _row _key _bucket _h _salt place block slot kept copies mix_id toxic_score".split()
    return odd.withColumns({c: F.lit("clash") for c in names})


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}
