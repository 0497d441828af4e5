import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from termloom import queries
from termloom.operators import terms, vectors


def rows_of(seed, n=160, size=6, spread=0.15):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(9)]
    rows = [(i, [m + rng.gauss(0, spread) for m in rng.choice(middles)]) for i in range(n)]
    rows += [(n + i, rows[rng.randrange(9)][1]) for i in range(30)]  # copies, one in many places
    odd = [None, [], [0.0] * size, [math.nan] * size, [None] + [1.0] * (size - 1), [math.inf] * size, [1.0, 2.0], [2.0, 4.1], [1e200] * size, [1e-200] * size, [-1.0] * size]
    return rows + [(n + 30 + i, v) for i, v in enumerate(odd)]


def fine(v):
    return v and all(x is not None and math.isfinite(x) for x in v) and any(v)


def cosine(a, b):
    if len(a) != len(b):
        return -2
    return float(vectors.unit(np.array([a]))[0] @ vectors.unit(np.array([b]))[0])


def frame(spark, rows):
    return spark.createDataFrame(rows, "pos long, v array<double>").repartition(3)


@pytest.mark.parametrize("threshold", [0.95, 0.6, 0.3, -0.2])
def test_links_equal_brute_force(spark, monkeypatch, threshold):
    monkeypatch.setattr(vectors, "CELL", 12)
    monkeypatch.setattr(vectors, "BLOCK", 7)
    monkeypatch.setattr(vectors, "STEP", 5)
    rows = rows_of(1)
    got = {r["pos"]: (r["class_id"], r["n_links"]) for r in vectors.link_counts(frame(spark, rows), threshold).collect()}
    good = [(i, v) for i, v in rows if fine(v)]
    want = {i: (None, None) for i, _ in rows}
    for i, v in good:
        want[i] = (min(j for j, w in good if w == v), sum(j != i and (w == v or cosine(v, w) >= threshold) for j, w in good))
    assert got == want
    pairs = {(r["pos"], r["earlier"]): r["cosine"] for r in terms.cosine_pairs(frame(spark, rows), threshold).collect()}
    first = [(i, v) for i, v in good if want[i][0] == i]
    wanted = {(max(i, j), min(i, j)): cosine(v, w) for n, (i, v) in enumerate(first) for j, w in first[:n] if cosine(v, w) >= threshold}
    assert pairs.keys() == wanted.keys() and all(abs(pairs[k] - c) < 1e-12 for k, c in wanted.items())


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 5), st.integers(1, 12), st.floats(-1, 1))
def test_linked_vectors_meet_once(seed, size, m, threshold):
    """Whatever the pivots and the threshold, every link's vectors lie together in one cell, where one is at home."""
    rng = np.random.default_rng(seed)
    x = vectors.unit(np.r_[rng.normal(size=(40, size)), np.repeat(rng.normal(size=(1, size)), 5, 0), np.eye(size)])
    pivots = x[rng.choice(len(x), m)]
    home = (x @ pivots.T).argmax(axis=1)
    angle = np.arccos(np.clip((x @ pivots.T)[np.arange(len(x)), home], -1, 1))
    narrow, wide = np.full(m, np.inf), np.full(m, -np.inf)
    np.minimum.at(narrow, home, angle), np.maximum.at(wide, home, angle)
    to = vectors.reached(x, home, pivots, narrow, wide, threshold)
    for i in range(len(x)):
        for j in range(i):
            both = [c for c in np.flatnonzero(to[i] & to[j]) if c in (home[i], home[j])]
            assert len(both) <= 1 and (len(both) == 1 or x[i] @ x[j] < threshold)


@pytest.mark.parametrize("threshold,most", [(0.9, 6), (0.0, 60)])
def test_copies_are_few(spark, monkeypatch, threshold, most):
    """On clusters a vector goes to few cells, never twice to one; where the threshold rules nothing out, to half the cells."""
    monkeypatch.setattr(vectors, "CELL", 20)
    classes, _ = vectors.vector_classes(frame(spark, rows_of(2, 2000, 32, 0.1)[:2000]))
    placed = vectors.in_cells(classes, 32, threshold)
    cells = [set(r["cells"]) for r in placed.select("cells").collect()]
    m = len(set().union(*cells))
    assert len(cells) == 2000 and m > 50
    assert vectors.dealt(placed).count() == sum(map(len, cells)) <= min(most, (m + 3) / 2) * 2000  # one block a cell
    monkeypatch.setattr(vectors, "BLOCK", 10)
    rows = [tuple(r) for r in vectors.dealt(placed).select("cell", "block", "kind", "pos").collect()]
    assert len(rows) == len(set(rows)) and sum(r[2] == 0 for r in rows) == 2000


@pytest.mark.parametrize("batch", [4, 40, 5000])
@pytest.mark.parametrize("threshold", [0.97, 0.5])
def test_leaders(spark, batch, threshold):
    rows = rows_of(3, 120)
    got = {r["pos"]: r["leader"] for r in vectors.leaders(frame(spark, rows), threshold, batch).collect()}
    heads, want = [], {}
    for i, v in sorted(rows):
        want[i] = next((j for j, w in heads if fine(v) and (v == w or cosine(v, w) >= threshold)), i)
        if want[i] == i and fine(v):
            heads.append((i, v))
    assert got == want


def test_no_vectors(spark):
    for rows in ([], [(1, None), (2, [0.0])]):
        df = frame(spark, rows)
        assert vectors.link_counts(df, 0.5).count() == len(rows)
        assert {r["pos"]: r["leader"] for r in vectors.leaders(df, 0.5).collect()} == {i: i for i, _ in rows}
        assert terms.cosine_pairs(df, 0.5).count() == 0


@pytest.mark.parametrize("threshold", [0.6, 0.3])
def test_pairs_of_rows(spark, monkeypatch, threshold):
    """Every pair of rows with its cosine, copies of a vector too; few are looked at before they leave a task."""
    monkeypatch.setattr(vectors, "CELL", 12)
    monkeypatch.setattr(vectors, "BLOCK", 7)
    monkeypatch.setattr(vectors, "LOOK", 20)
    rows = rows_of(4)
    got = [(r["pos"], r["earlier"], r["cosine"]) for r in vectors.row_pairs(frame(spark, rows), threshold).collect()]
    good = [(i, v) for i, v in rows if fine(v)]
    want = {(i, j): cosine(v, w) for i, v in good for j, w in good if j < i and cosine(v, w) >= threshold}
    assert len(got) == len(want) and all(abs(want[p, q] - c) < 1e-12 for p, q, c in got)


def test_query_lists_pairs(spark, tmp_path):
    """A row a pair with its cosine, not a row a vector."""
    spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [0.6, 0.8], 1), (4, [0.0, -1.0], 1)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert sorted(tuple(r) for r in queries.cosine_pairs(spark, str(tmp_path)).collect()) == [(2, 1, 1.0), (3, 1, 0.6), (3, 2, 0.6)]
