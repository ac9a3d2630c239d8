import pytest

SPACES = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `size` long, fp string, label string, score double, copy int, digest string, `__key` string, `_copies` int, piece int, `key` string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and white texts, ties, repeated rows, a very long text, special strings, clashing columns."""
    long = "lorem ipsum dolor " * 20_000 + "x" * 50_000
    secret = 'api_key = "abcdefghijkl0123" and  é AKIA' + "A1" * 10 + " deadbeefdeadbeef0 password: short"
    rows = [
        (None, None, None, None, None), (None, "null id text here now", "en", None, 21), (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \t\n", "en", "b", 3),
        (4, "one two three four five six", None, "b", 27), (4, "one two three four five six", None, "b", 27), (5, "one two three four five six", "en", "b", 27), (6, long, "en", "c", len(long)),
        (7, secret, "en", "c", len(secret)), (8, "<|endoftext|> a  b <|startoftext|>\r\nİstanbul ΣΑΣ é é \x1c   end", "en", None, 40), (9, "word", "en", "\U0001f600", 4), (9, "other words with the same id", "en", "a", 28), (10, secret, "en", "a", len(secret)),
    ]
    more = (3, "f", "l", 0.5, 1, "d", "k", 2, 7, "key")
    return spark.createDataFrame([r + more for r in rows], SCHEMA).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
