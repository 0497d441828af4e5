import random

import pytest
from pyspark.sql import functions as F

from termloom.operators import aggregates, predicates
from termloom.plans.profile import profile


def test_repeated_values_need_no_count_of_all(spark, monkeypatch):
    """A column that repeats a value is no key: its hashes are not shuffled."""
    asked = []
    exact = predicates.exact_counts
    monkeypatch.setattr(predicates, "exact_counts", lambda df, names, *a: asked.append(list(names)) or exact(df, names, *a))
    df = spark.range(4000).select(F.col("id").alias("k"), (F.col("id") % 3990).alias("r"), F.when(F.col("id") > 0, F.col("id")).alias("two"), F.lit("x").alias("one"))
    rows = {r["coluna"]: r for r in predicates.column_stats(df, exact=False).collect()}
    assert asked == [["k", "two"]]
    assert {c: r["is_id"] for c, r in rows.items()} == {"k": True, "r": False, "two": True, "one": False}
    assert rows["r"]["n_distinct"] < 4000


@pytest.mark.parametrize("bits,words", [(63, 8), (3, 2)])
def test_distinct_keys_of_clusters(spark, monkeypatch, bits, words):
    """Repeated and null keys, both zeros, nulls, times, more clusters than words have bits."""
    monkeypatch.setattr(aggregates, "BITS", bits)
    monkeypatch.setattr(aggregates, "WORDS", words)
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(40)]), rng.choice("abcdefghijkl"), rng.choice([0.0, -0.0, 1.5, float("nan"), None]), rng.choice([1, 2, None]), rng.randrange(3)) for _ in range(300)]
    df = spark.createDataFrame(rows, "k int, s string, d double, n int, t int").withColumn("t", F.timestamp_seconds("t")).withColumn("o", F.monotonically_increasing_id()).repartition(3)
    counts = aggregates.counts_by_column(df, ["s", "d", "n", "t"], "o")
    got = {(r["coluna"], r["raw"]): r["n"] for r in counts.collect()}
    text = {c: F.col(c).cast("string") for c in ("s", "d", "n", "t")}
    cells = df.select("k", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), x.alias("v")) for c, x in text.items()])).alias("x")).select("k", "x.*").where("v is not null").collect()
    assert got == {key: sum((r["c"], r["v"]) == key for r in cells) for key in {(r["c"], r["v"]) for r in cells}}
    named = counts.select("coluna", "raw", F.pmod(F.hash("raw"), F.lit(7)).cast("long").alias("leader"))
    leader = {(r["coluna"], r["raw"]): r["leader"] for r in named.collect()}
    found = aggregates.keys_by_cluster(df.where("k is not null"), "k", named).collect()
    keys = {}
    for r in cells:
        if r["k"] is not None:
            keys.setdefault((r["c"], leader[r["c"], r["v"]]), set()).add(r["k"])
    assert {(r["coluna"], r["leader"]): r["frequencia"] for r in found if r["frequencia"]} == {c: len(k) for c, k in keys.items()}


def test_profile_with_a_repeated_key(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, "a"), (2, 2, "a"), (3, 3, "bbbb")], "k int, o int, s string")
    found = profile(df, order="o", key="k", ids=False).tables.where("coluna = 's'").collect()
    assert [(r["termo_base"], r["frequencia"]) for r in found] == [("A", 2), ("BBBB", 1)]
