import math
import random

import numpy as np
import pytest

from termloom.operators import aggregates, quantiles

STEPS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def data(seed):
    rng = random.Random(seed)
    rows = [("wide", rng.uniform(-1, 1) * 10 ** rng.randrange(-300, 300)) for _ in range(900)]
    rows += [("far", v) for v in (1.7e308, -1.7e308, 0.0, 5e-324)] + [("powers", 2.0**k) for k in range(-500, 500)]
    rows += [("same", 3.0)] * 400 + [("two", 1.0)] * 300 + [("two", 2.0)] + [("one", 7.5)]
    rows += [("normal", rng.gauss(0, 1)) for _ in range(1500)] + [(None, float(i % 17)) for i in range(300)]
    rows += [("none", None), ("none", math.nan), ("normal", None), ("normal", math.nan)]
    return rows


@pytest.mark.parametrize("bins,few", [(64, 40), (1024, 1500), (1024, 4096)])
def test_quantiles(spark, monkeypatch, bins, few):
    monkeypatch.setattr(quantiles, "BINS", bins)
    monkeypatch.setattr(quantiles, "FEW", few)
    rows = data(3)
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {r["label"]: r["q"] for r in quantiles.quantiles(df, "g", "v", STEPS).collect()}
    assert got.keys() == {r[0] for r in rows} and got["none"] is None
    for g, q in got.items():
        mine = np.array([v for k, v in rows if k == g and v is not None and not math.isnan(v)])
        if len(mine):
            at = [(len(mine) - 1) * s for s in STEPS]
            s = np.sort(mine)
            want = [s[int(a)] if a == int(a) else (math.ceil(a) - a) * s[math.floor(a)] + (a - math.floor(a)) * s[math.ceil(a)] for a in at]
            assert q == want, g


def test_quartiles_of_nothing(spark):
    assert aggregates.quartiles(spark.createDataFrame([], "g string, v int"), "g", "v").count() == 0
    row = aggregates.quartiles(spark.createDataFrame([("a", None)], "g string, v int"), "g", "v").first()
    assert tuple(row) == ("a", None, None, None, None, None)
