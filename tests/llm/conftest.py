import random

import pytest
from pyspark.sql import types as T

WORDS = [a + b for a in ("an", "be", "co", "du", "el", "fa", "go", "hi") for b in ("ra", "ten", "lo", "mi", "sun", "po")]

#: Names that the operators use themselves: they must not meet the input's.
CLASH = "key node n sig keys vec size k q v caps label found removed rest held text2 _t _x words".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    rng = random.Random(3)
    base = prose(rng, 80)
    return [
        (1, None, None, None), (2, "", "en", "s0"), (3, "  \n\t ", "en", "s1"), (4, prose(rng, 30_000), "en", "s0"), (5, base, "en", "s0"), (6, base, None, "s2"),
        (7, base + " more", "xx", None), (8, "word", "en", "s1"), (9, "# * | < > 1 2 3", "xx", "s2"), (9, "# * | < > 1 2 3", "xx", "s2"), (None, prose(rng, 40), "en", "s0"), (11, "é ß 中文 \U0001f600 ¿", "xx", "s1"),
        (12, "x " * 4000, "en", "s0"), (13, "line\nline\nline\n\nother", "en", None), (14, "<|endoftext|> and \x00 odd\x1f", "xx", "s0"),
    ]


def frame(spark, rows):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in CLASH]])
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *["z"] * len(CLASH)) for r in rows], schema).repartition(3)


@pytest.fixture(scope="session")
def edges(spark, edge_rows):
    return frame(spark, edge_rows)


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 1, 0), (9, 0, 0), (12, 0, None), (13, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def corpus():
    """Documents with copies, near copies, shared passages and junk."""
    rng = random.Random(5)
    rows, passage = [], prose(rng, 70)
    for i in range(120):
        words = prose(rng, rng.choice([1, 3, 4, 5, 6, 40, 90, 150])).split()
        if i % 5 == 0:
            words[len(words) // 2 : len(words) // 2] = passage.split()
        rows.append((i, " ".join(words), "en", f"s{i % 4}"))
    for i in range(120, 200):
        words = rows[rng.randrange(120)][1].split()
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            words[rng.randrange(len(words))] = rng.choice(WORDS).upper()
        rows.append((i, " ".join(words), "en", "s9"))
    return rows
