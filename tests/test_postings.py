import random

import pytest
from pyspark.sql import functions as F

from termloom.operators import postings


def check(blocks, want, size):
    rows = blocks.select("k", "block", "n", F.size("ids").alias("s"), postings.ids_of(blocks).alias("ids")).orderBy("k", "block").collect()
    got = {}
    for r in rows:
        assert 0 < r["n"] == r["s"] == len(r["ids"]) <= size
        got.setdefault(r["k"], []).extend(r["ids"])
    assert got == want
    assert len({r["block"] for r in rows}) == len(rows)


@pytest.mark.parametrize("kind,make", [("long", lambda i: i * 7 - 300), ("int", lambda i: i), ("string", lambda i: f"é{i}"), ("double", lambda i: i / 4)])
@pytest.mark.parametrize("size", [1, 5, 1024])
def test_blocks(spark, kind, make, size):
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None, ""]), make(rng.randrange(400)) if rng.random() > 0.02 else None) for _ in range(3000)]
    want = {}
    for k, i in rows:
        if i is not None:
            want.setdefault(k, set()).add(i)
    df = spark.createDataFrame(rows, f"k string, id {kind}").repartition(6)
    blocks = postings.postings(df, ["k"], block=size)
    check(blocks, {k: sorted(v) for k, v in want.items()}, size)
    assert {r["k"]: r["frequencia"] for r in postings.counted(blocks, ["k"]).collect()} == {k: len(v) for k, v in want.items()}
    text = {r["k"]: r["ids"] for r in postings.ids_text(blocks, ["k"], by_text=True).where("k is not null").collect()}
    assert all(len(t.split(",")) == len(want[k]) for k, t in text.items()) and text["hot"].split(",") == sorted(text["hot"].split(","))


def test_small_batches(spark):
    """A key goes on over many Arrow batches; its repeated ids are still one."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(500).selectExpr("if(id < 450, 'hot', 'b') as k", "id div 3 as id").repartition(4)
        check(postings.postings(df, ["k"], block=10), {"hot": list(range(150)), "b": list(range(150, 167))}, 10)
        assert postings.postings(df.limit(0), ["k"]).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_no_key(spark):
    df = spark.range(30).selectExpr("id % 9 as id")
    blocks = postings.postings(df, [], block=4)
    assert sorted(i for r in blocks.select(postings.ids_of(blocks).alias("i")).collect() for i in r["i"]) == list(range(9))
