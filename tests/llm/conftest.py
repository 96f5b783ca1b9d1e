import pytest

from pyspark.sql import types as T

DOCUMENT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])

#: Nulls, empty and blank texts, one word, repeated rows and copies, a repeated line, one very long text, letters beyond ASCII.
EDGE_TEXTS = [None, "", "   ", "word", "Ünïcödé wörds hére", "same text " * 30, "same text " * 30, "a b c " * 2000, "line one two three four five six\n" * 40,
              "x" * 3000, "日本語のテキスト " * 50, "one two three four five six seven eight nine ten eleven"]


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        return spark.createDataFrame([(i, t) for i, t in rows], DOCUMENT)

    return make


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Odd documents, with further columns whose names the operators use themselves, and a repeated row."""
    rows = [*enumerate(EDGE_TEXTS), (3, "word"), (None, "no id")]
    fields = [*DOCUMENT.fields, *(T.StructField(c, T.StringType()) for c in ("passages", "secrets", "bpe", "tox", "score", "class_id", "n_words", "h", "key"))]
    return spark.createDataFrame([(i, t, *"abcdefghi") for i, t in rows], T.StructType(fields))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCUMENT)
