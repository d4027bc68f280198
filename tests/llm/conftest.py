import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conftest_data import passage  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n_words int, key string, spans string, fp long"


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text): nulls, empty and very long texts, ties, repeated rows, copies, shared passages, odd characters."""
    shared = passage(1, 90)
    rows = [
        (0, "one two three four five six seven eight nine ten eleven twelve"),
        (1, "ONE two, three four five six seven eight nine ten!"),
        (2, None),
        (3, ""),
        (4, " \t\n\x0b\x0c\r "),
        (5, passage(2, 120) + "\n" + shared),
        (6, passage(3, 60) + "\n" + shared + "\n" + passage(4, 30)),
        (7, passage(2, 120) + "\n" + shared),
        (8, "a" * 3000),
        (9, "a" * 1000 + "b" + "a" * 1000),
        (10, "É ñandú ÅNGSTRÖM Straße ΑΣ ΣΑΣ İstanbul ﬁne x y 한글 日本語 🙂 é"),
        (11, "<|endoftext|> it's we'll I'M 12345 ### $$$ <|startoftext|>x"),
        (12, passage(5, 4000)),
        (13, "same line\nsame line\nsame line\n\nother # * $"),
        (14, passage(6, 80) + "\nReleased under the MIT License."),
        (15, "x"),
        (16, "x"),
        (17, ("la la la " * 60).strip()),
    ]
    return [*rows, rows[5], (None, "no id " + passage(7, 70)), (None, None)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The rows with the columns of documents and more, some with names that operators use."""
    full = [(i, t, "en", f"src{(i or 0) % 3}", None if t is None else len(t), 1, "k", "s", 2) for i, t in odd_rows]
    return spark.createDataFrame(full, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
