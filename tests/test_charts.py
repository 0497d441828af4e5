import random

import pytest

from termloom.operators import charts


@pytest.mark.parametrize("parts", [1, 3, 7])
@pytest.mark.parametrize("turned", [False, True])
def test_ties_do_not_hang_on_where_rows_lie(spark, parts, turned):
    """The chart's last row is one of many with the same place in the order."""
    rows = [(1, float(i % 40), float(i), "ab"[i % 2]) for i in range(200)] + [(0, float(i), 0.0, "c") for i in range(5)]
    df = spark.createDataFrame(rows[::-1] if turned else rows, "k long, x double, y double, label string").repartition(parts)
    want = sorted((r[0], r[3], r[1], r[2]) for r in rows)
    points = charts.scatter(df.select("x", "y", "label", "k"), "label", ["k"]).collect()
    assert [tuple(r) for r in points] == [r[1:] for r in want[: charts.SCATTER]]
    line = charts.line(df, "label", "x", ["k"]).collect()
    assert [tuple(r) for r in line] == [r[1:3] for r in want[: charts.LINE]]
    bars = charts.bar(df.selectExpr("label as termo", "k as frequencia", "x", "y"), ["frequencia"]).collect()
    assert [r["label"] for r in bars] == [r[1] for r in want[: charts.BAR]]


@pytest.mark.parametrize("seed", range(4))
def test_ties_are_decided_by_one_reading(spark, seed):
    """With places the rows are those that one reading from front to back leaves, whatever the partitions."""
    rng = random.Random(seed)
    rows = [(rng.randrange(90 if seed else 2), float(i), rng.random(), "ab"[i % 2], i // 100, i % 100) for i in range(400)]
    kept = []
    for r in rows:
        if len(kept) == charts.SCATTER:
            last = max(k[0] for k in kept)
            if r[0] >= last:
                continue
            kept.remove(next(k for k in kept if k[0] == last))
        kept.append(r)
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "k long, x double, y double, label string, f long, i long").repartition(3)
    points = charts.scatter(df.select("x", "y", "label", "k", "f", "i"), "label", ["k"], ["f", "i"]).collect()
    assert sorted(tuple(r) for r in points) == sorted((r[3], r[1], r[2]) for r in kept)
