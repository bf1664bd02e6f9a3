import random

import pytest
from pyspark.sql import DataFrame

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use within; inputs may have columns called the same.
CLASHES = ["body", "size", "digest", "fp", "piece", "start", "length", "first", "at", "label", "score", "found", "tail", "n_lines", "_drop", "code", "vector", "nth", "copies", "keep", "record", "range", "_rank"]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    return " ".join(rng.choice(words) + rng.choice(["", "", "", ".", ",", ".\n"]) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls, blanks, copies, near copies, repeated rows, shared passages and a long text."""
    base, passage = prose(1, 180), prose(2, 70)
    rows = [
        (1, base, "en", "a", len(base)),
        (2, base, "en", "b", len(base)),
        (3, base.replace("a", "A", 1), None, "b", None),
        (4, base + " tail", "en", None, -5),
        (5, None, None, None, None),
        (6, "", "en", "a", 0),
        (7, " \t\n \x0b", "fr", "c", 5),
        (8, "one", "en", "a", 3),
        (9, "one two three", "en", "a", 3),
        (10, prose(3, 40) + " " + passage + " " + prose(4, 30), "en", "a", 1),
        (11, passage + " " + prose(5, 60), "en", "c", 1),
        (12, prose(6, 3000), "en", "a", 1),
        (13, "word " * 400, "en", "c", 1),
        (14, "  runs   of  space  ", "en", "a", 1),
        (15, "naïve café Ünïcode 日本語 テキスト 😀 " * 20, "de", "é", 1),
        (16, passage, "en", "a", 1),
    ]
    return [*rows, rows[0], rows[4], rows[12], (None, base, "en", "a", 1), (None, None, None, None, None)]


def with_clashes(df: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES if c not in df.columns})


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    return with_clashes(odd)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
