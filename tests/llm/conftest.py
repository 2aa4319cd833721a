import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, short and very long texts, copies, near copies, repeated rows, null ids and sources."""
    r = random.Random(5)
    base = words(r, 120).split()
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "one", "en", "b", 3), (5, "one Two three", "en", "b", 13), (6, "ONE two three", "en", None, 13), (7, words(r, 30_000), "en", "a", 1), (8, "x" * 200_000, "en", "c", 1), (None, "a text whose id is null and so on", "en", "c", 1), (None, None, None, None, None)]
    rows += [(10 + i, " ".join(base), "en", "a", 1) for i in range(5)]
    for i in range(40):
        copy = list(base)
        copy[r.randrange(len(copy))] = "changed"
        rows.append((20 + i, " ".join(copy), "en", "abc"[i % 3], 1))
    rows += [(100 + i, words(r, r.randint(5, 80)), "en", "abcd"[i % 4], 1) for i in range(60)]
    rows += [(50, " ".join(base), "en", "a", 1)] * 3
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """With columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows, DOCS)
    return df.select("*", *(F.lit(7).alias(c) for c in ("size", "shard", "index", "rank", "node", "label", "_part", "length", "score", "h", "id")))


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
