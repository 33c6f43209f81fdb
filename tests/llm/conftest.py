import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture
def documents(spark):
    """Makes a documents table with columns whose names the operators use themselves."""

    def make(rows):
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, body string, digest string, n int, words_ string, c0 int, hash bigint, rid int"
        more = ("en", "s", 1, "k", "b", "d", 1, "w", 0, 1, 1)
        return spark.createDataFrame([(i, t, *more) for i, t in rows], schema)

    return make


#: Null and empty texts, a null key, repeated rows, odd characters, white space only, a long text.
ODD = [
    (1, None), (2, ""), (None, "a row without a key"), (4, "repeated row"), (4, "repeated row"), (5, "tab\tand\x0bfeed\x0c ▁ \U0001f600 門 é\r\n"),
    (6, "  \n \t "), (7, "long " * 30_000), (8, "x" * 20_000), (9, "<html> 100% *#|"), (10, "repeated row"),
]


@pytest.fixture
def odd():
    return list(ODD)
