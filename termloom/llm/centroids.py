"""Centroid clustering: float32 products shortlist centroids within proven intervals; exact integers decide where they overlap."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from decimal import Decimal
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Integers beyond this count as this: sums of squares stay within 38 digits.
LARGEST = 2**44
#: Cells (rows x centroids x components) that one exact comparison holds at most.
CELLS = 1 << 21
#: Unit roundoffs of float32 and float64.
U32, U64 = 2.0**-24, 2.0**-53


def kept_rows(vectors: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, integers): the rows with ``dims`` components, none null or non-finite, and floor(scale * x) of these."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    starts = np.asarray(vectors.offsets)
    lengths = np.diff(starts)
    rows = np.flatnonzero((lengths == dims) & np.asarray(vectors.is_valid()))
    flat = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    values = flat[starts[rows][:, None] + np.arange(dims)]
    fine = np.isfinite(values).all(axis=1)
    with np.errstate(over="ignore"):
        return rows[fine], np.clip(np.floor(scale * values[fine]), -LARGEST, LARGEST).astype(np.int64)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, in int64 where these cannot overflow, else in Python's integers."""
    most = max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0)))
    if a.shape[1] * (2 * most) ** 2 >= 2**63:
        a = a.astype(object)
    return ((a - b) ** 2).sum(axis=1)


def screen(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """For each row the centroids that may be nearest: a boolean matrix, true for every nearest one at least.

    |x - c|^2 less |x|^2 is |c|^2 - 2 xc. The product of n components in float32, its inputs rounded too, is off by
    at most g |x| |c| with g = (n + 2) u / (1 - (n + 2) u), whatever the order of the sum; float64 adds a few
    roundings of |c|^2 and 2 |xc|. A centroid stays unless its interval lies beyond another's. What is not finite
    tells nothing, so it stays.
    """
    n = x.shape[1] + 3
    g = n * U32 / (1 - n * U32)
    with np.errstate(over="ignore", invalid="ignore"):
        products = (x.astype(np.float32) @ centroids.astype(np.float32).T).astype(np.float64)
        squares = np.array([float(sum(int(v) ** 2 for v in row)) for row in centroids])
        sizes = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        value = squares - 2 * products
        off = (2 * g * sizes[:, None] * np.sqrt(squares) + 8 * U64 * (squares + 2 * np.abs(products))) * (1 + 1e-6)
        low, high = value - off, value + off
    low[~np.isfinite(low)], high[~np.isfinite(high)] = -np.inf, np.inf
    return low <= high.min(axis=1, keepdims=True)


def assign(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, the smaller number where tied; its squared distance, exact) of each row of integers."""
    near, distance = np.zeros(len(x), np.int32), np.zeros(len(x), object)
    step = max(1, CELLS // centroids.size)
    for at in range(0, len(x), step):
        part = x[at : at + step]
        may = screen(part, centroids)
        first = may.argmax(axis=1)
        best = exact(part, centroids[first])
        open_ = np.flatnonzero(may.sum(axis=1) > 1)
        if len(open_):
            i, j = np.nonzero(may[open_])  # by row, then by number of the centroid
            d = exact(part[open_[i]], centroids[j])
            row = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
            least = np.minimum.reduceat(d, row)
            tied = np.flatnonzero(d == least[i])
            _, one = np.unique(i[tied], return_index=True)  # the first of equals
            first[open_], best = j[tied[one]], best.astype(object) if d.dtype == object else best
            best[open_] = least
        near[at : at + step], distance[at : at + step] = first, best
    return near, distance


def starts_of(vectors: DataFrame, k: int, dims: int, scale: int) -> np.ndarray:
    """The k kept vectors with the least hashes, in order of hash; each task hands on k rows at most."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list = []
        for batch in batches:
            rows, x = kept_rows(batch.column(1), dims, scale)
            ids = batch.column(0).take(pa.array(rows)).to_pylist()
            hashes = ["~" if i is None else sha256(f"1:{i}".encode()).hexdigest() for i in ids]  # "~" comes after any hash
            last = max(heapq.nsmallest(k, hashes), default="")
            best = heapq.nsmallest(k, best + [(h, x[n].tolist()) for n, h in enumerate(hashes) if h <= last])
        yield pa.RecordBatch.from_arrays([pa.array([b[0] for b in best], pa.string()), pa.array([b[1] for b in best], pa.list_(pa.int64()))], ["h", "x"])

    found = vectors.mapInArrow(least, "h string, x array<long>").orderBy("h", "x").limit(k).collect()
    return np.array([r["x"] for r in found], np.int64).reshape(len(found), dims)


def moved(vectors: DataFrame, centroids: np.ndarray, dims: int, scale: int) -> np.ndarray:
    """One round: every centroid with vectors becomes the floor of their mean. Tasks add up theirs before anything is shuffled."""
    k = len(centroids)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dims), object), np.zeros(k, np.int64)
        for batch in batches:
            _, x = kept_rows(batch.column(1), dims, scale)
            near, _ = assign(x, centroids)
            count += np.bincount(near, minlength=k)
            for c in np.unique(near):
                mine = x[near == c]
                total[c] += (mine if int(np.abs(mine).max()) * len(mine) < 2**62 else mine.astype(object)).sum(axis=0)
        there = [int(c) for c in np.flatnonzero(count)]
        columns = [pa.array(there, pa.int32()), pa.array([int(count[c]) for c in there], pa.int64()), pa.array([[Decimal(int(v)) for v in total[c]] for c in there], pa.list_(pa.decimal128(38, 0)))]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "n", "sums"])

    parts = vectors.mapInArrow(sums, "cluster int, n long, sums array<decimal(38,0)>").select("cluster", "n", F.posexplode("sums").alias("place", "part"))
    out = centroids.copy()
    for r in parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("part").alias("s")).collect():  # k x dims rows at most
        out[r["cluster"], r["place"]] = int(r["s"]) // r["n"]
    return out


def centroid_clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64) -> DataFrame:
    """vectors (vec_id, embedding) -> vec_id, cluster (int), distance, cluster_inertia, inertia (long), centroid (array<long>).

    Vectors with another number of components, or with one that is null or not finite, have no row; null vectors
    neither. Components become floor(scale * x); beyond 2^44 they count as 2^44, and distances and inertias beyond a
    long as the largest long, though they are compared exactly. Starts are the k vectors with the least sha256 of
    ``1:<vec_id>``; rows of one id are taken in order of their components, rows without an id last. With fewer than k
    kept vectors there are as many centroids; with none, or on an empty table, no rows. Ties go to the smaller
    number. Repeated rows count each. Other columns, whatever their names, are not read.

    The vectors are read k-means round by round and never shuffled; k x dims sums come to the driver.
    """
    scratch = Scratch(vectors.sparkSession, "op12")
    vectors = vectors.select("vec_id", "embedding")
    kind = vectors.schema["vec_id"].dataType.simpleString()
    centroids = starts_of(vectors, k, dims, scale)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>")
    for _ in range(rounds):
        centroids = moved(vectors, centroids, dims, scale)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = kept_rows(batch.column(1), dims, scale)
            near, distance = assign(x, centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(near), pa.array([Decimal(int(d)) for d in distance], pa.decimal128(38, 0))], ["vec_id", "cluster", "distance"])

    found = scratch.save(vectors.mapInArrow(nearest, f"vec_id {kind}, cluster int, distance decimal(38,0)"))
    inertia = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows at most
    long = lambda v: min(v, 2**63 - 1)
    named = [(c, long(s), long(sum(inertia.values())), centroids[c].tolist()) for c, s in inertia.items()]
    table = vectors.sparkSession.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    distance = F.least("distance", F.lit(Decimal(2**63 - 1))).cast("long").alias("distance")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", distance, "cluster_inertia", "inertia", "centroid")
