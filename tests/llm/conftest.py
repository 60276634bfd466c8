import random

import pytest

from storelens.llm.shared import workers_find_library

DOCS = "doc_id long, text string, lang string, source string, n_chars int"


@pytest.fixture(autouse=True)
def library(spark):
    workers_find_library(spark)


def prose(seed, words, vocabulary=400):
    """Invented words, the same for the same seed."""
    draw = random.Random(seed)
    return " ".join(f"{draw.choice('bcdfglmnprst')}{draw.choice('aeiou')}{draw.randrange(vocabulary)}x" for _ in range(words))


def plain_words(text):
    """Words between white space, A-Z lower."""
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    for c in "\t\n\v\f\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


@pytest.fixture(scope="session")
def awkward(spark):
    """Rows that any operator has to live with, with a column that is called like one of its own."""
    long_text = prose(1, 60_000)
    rows = [
        (0, None, None, None, None), (1, "", "en", "a", 0), (2, " \n\t ", "en", "a", 4), (3, "one", "en", None, 3),
        (4, "one two", None, "b", 7), (5, "aé中\U0001f600 B!", "fr", "b", 7), (6, long_text, "en", "a", len(long_text)),
        (None, "no id at all here", "en", "a", 17), (7, prose(2, 90), "de", "c", 1), (7, prose(2, 90), "de", "c", 1),
        (8, prose(2, 90), "de", "c", 1), (9, "  x\x1cy \x85", "en", "a", 3),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    return docs.selectExpr("*", "'clash' as score", "1 as fp", "'k' as key", "2 as start", "3 as id", "4 as label", "5 as n")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
