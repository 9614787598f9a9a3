import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, id string, grp string, n long"


def row(doc_id, text, source="s"):
    return (doc_id, text, "en", source, len(text or ""), "clash", "clash", "clash", 1)


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, very long, repeated rows, ties, characters of all widths."""
    long = "\n".join(prose(i, 40) for i in range(300))
    return [
        row(1, None), row(2, ""), row(3, "a"), row(4, prose(1, 60)), row(5, prose(1, 60)), row(6, prose(1, 60) + " one more"), row(7, long), row(8, long.replace("a", "b", 3)),
        row(9, "  \n\t\n "), row(None, "no id"), row(None, None), row(10, "é日本語 🤣 ﬁ İ Σας"), row(4, prose(1, 60)), row(11, "x" * 5000), row(12, prose(2, 3)), row(13, None, None), row(14, prose(3, 80) + "\n" + prose(1, 60)),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(rows):
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, []).append(r)
    return out
