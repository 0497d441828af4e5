"""Embedding near-dedup: spherical-cap filters from random product codes bring vectors together, cosines verify.

A vector is rotated and cut into two blocks; each block has a codebook of random unit vectors, and every pair of
codes is a filter direction. A vector lies in the caps whose summed block scores exceed a bound; only codes that can
reach it are paired. Several such codes, independently rotated, even out how many caps a vector gets, and each gives
it at least its best ones. Vectors at the wanted cosine then share several caps with high probability. The codebooks
grow with the vectors of a label, so that a cap holds as many whatever the table's size: two vectors at cosine 0.93 that
are above a direction's bound together half the time at one cap in 5,000 still are in more than a quarter of the cases at one in
a hundred million.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected

COSINE = 0.93
CODES = 256  # of each of the two blocks, at least
#: Vectors that a cap holds on average, at most: beyond, the codebooks are doubled.
HELD = 32
CAPS = 12  # that a vector lies in, on average, by each code
LEAST = 2  # by each code
TABLES = 5  # independent codes
#: Vectors of a cap that one task compares; a larger cap is dealt out as pairs of blocks.
BLOCK = 1024


@cache
def codebook(d: int, codes: int, caps: int, table: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(rotation, two codebooks, bound on the summed block scores) for dimension d."""
    rng = np.random.default_rng([11, d, table])
    rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
    half = max(1, d // 2)
    books = []
    for width in (half, max(1, d - half)):
        c = rng.standard_normal((codes, width))
        books.append(c / np.linalg.norm(c, axis=1, keepdims=True))
    bound = NormalDist().inv_cdf(1 - min(0.5, caps / codes**2)) * np.sqrt(2.0 / d)
    return rotation, books[0], books[1], float(bound)


def codes_for(n: int, caps: int, codes: int = CODES) -> int:
    """Codes of a block so that a cap holds HELD of n vectors at most on average."""
    while n * caps > HELD * codes**2 and codes < 1 << 16:
        codes *= 2
    return codes


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that their squares neither overflow nor vanish; cosines stay the same to the bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def caps_of(unit: np.ndarray, codes: int, caps: int, tables: int, least: int = LEAST) -> list[np.ndarray]:
    """For each unit vector the sorted numbers of all caps it lies in."""
    d = unit.shape[1]
    out: list[list[np.ndarray]] = [[] for _ in unit]
    for table in range(tables):
        rotation, left, right, bound = codebook(d, codes, caps, table)
        x = unit @ rotation
        a = x[:, : left.shape[1]] @ left.T
        b = x[:, left.shape[1] :] @ right.T if d > 1 else np.zeros((len(x), codes))
        best_a, best_b = (np.partition(y, -least, axis=1)[:, -least:] for y in (a, b))
        reach = np.sort((best_a[:, :, None] + best_b[:, None, :]).reshape(len(x), -1), axis=1)[:, -least]
        for k, (s, t, low) in enumerate(zip(a, b, np.minimum(reach, bound), strict=True)):
            i, j = np.flatnonzero(s >= low - t.max() - 1e-12), np.flatnonzero(t >= low - s.max() - 1e-12)
            p, q = np.nonzero(s[i][:, None] + t[j][None, :] >= low - 1e-12)
            out[k].append(i[p] * codes + j[q] + table * codes**2)
    return [np.sort(np.concatenate(x)).astype(np.int64) for x in out]


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index that each of n items is joined to by pairs (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def embedding_dedup(embeddings: DataFrame, cosine: float = COSINE, codes: int | None = None, caps: int = CAPS, tables: int = TABLES) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row; only rows with equal, non-null labels and equal dimension link.

    A vector that is null, empty, zero or holds a null or non-finite component links with nothing, nor does a row
    with a null id (its component is null and it is not kept). Equal vectors with equal labels are one node that
    counts as many links as it has rows. No cap on partners: caps with many vectors are compared in blocks, and a
    pair counts in the least cap it shares. Cosines are taken in double precision from the components as they come,
    float or double. Without ``codes`` the largest label decides the size of the codebooks. An empty table gives no rows.
    """
    scratch = Scratch(embeddings.sparkSession, "op4")
    kind = "float" if embeddings.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    e = F.col("embedding").cast(f"array<{kind}>")
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", e.alias("v"), F.coalesce(fine, F.lit(False)).alias("fine"))
    rows = scratch.save(rows.withColumn("node", F.when(F.col("fine"), F.xxhash64("label", "v"))))
    nodes = rows.where("fine").groupBy("node").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("v").alias("v"))
    nodes = scratch.save(nodes)
    codes = codes or codes_for(nodes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0, caps)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("v").to_pylist()
            found: list = [None] * len(held)
            for d in {len(v) for v in held}:
                at = [k for k, v in enumerate(held) if len(v) == d]
                x = scaled(np.array([held[k] for k in at], np.float64))
                for k, c in zip(at, caps_of(x / np.linalg.norm(x, axis=1, keepdims=True), codes, caps, tables), strict=True):
                    found[k] = c
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("label").cast(pa.string()), batch.column("weight"), batch.column("v"), pa.array(found, pa.list_(pa.int64()))], ["node", "label", "weight", "v", "caps"])

    marked = scratch.save(nodes.select("node", "label", "weight", "v").mapInArrow(mark, f"node long, label string, weight long, v array<{kind}>, caps array<long>"))
    spread = marked.select("node", F.explode("caps").alias("cap"), F.xxhash64("label", F.size("v"), "cap").alias("bucket"))
    full = spread.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1").select("bucket", F.ceil(F.col("m") / F.lit(BLOCK)).cast("int").alias("blocks"))
    met = spread.join(full, "bucket").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("mine") == F.col("other"), -1).otherwise(F.when(F.col("mine") < F.col("other"), 0).otherwise(1))
    met = met.select(F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("task"), "node", "cap", side.alias("side")).join(marked, "node")

    def meet(node, weight, side, cap: int, x: np.ndarray, caps_at) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(node, links that count in this cap, least node joined here) of those that link; one cap's rows, or two blocks of it."""
        two = bool((side >= 0).any())
        left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if two else (np.arange(len(node)),) * 2
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        close = (x[left] @ x[right].T) / (norm[left][:, None] * norm[right][None, :]) >= cosine
        if not two:
            close = np.triu(close, 1)
        if not close.any():
            return None
        i, j = np.nonzero(close)
        i, j = left[i], right[j]
        used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        lower = [c[c < cap].tolist() for c in map(caps_at, used.tolist())]
        names = {c: n for n, c in enumerate(sorted({c for low in lower for c in low}))}
        inside = np.zeros((len(used), len(names)), np.float32)
        for n, low in enumerate(lower):
            inside[n, [names[c] for c in low]] = 1
        a, b = at[: len(i)], at[len(i) :]
        first = ~((inside @ inside.T)[a, b] > 0) if names else np.ones(len(a), bool)
        links = np.bincount(a[first], weight[used[b[first]]], len(used)) + np.bincount(b[first], weight[used[a[first]]], len(used))
        return node[used], links.astype(np.int64), node[used[roots(len(used), a, b)]]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by task; a batch's complete runs are compared, its last one waits for the next batch."""

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            table = table.combine_chunks()
            column = {c: table.column(c).combine_chunks() for c in table.column_names}
            task, node, weight, side, cap = (column[c].to_numpy() for c in ("task", "node", "weight", "side", "cap"))
            values, ends = column["v"].flatten().to_numpy(), np.concatenate(([0], np.cumsum(column["v"].value_lengths().to_numpy())))
            marks, cuts = column["caps"].flatten().to_numpy(), np.concatenate(([0], np.cumsum(column["caps"].value_lengths().to_numpy())))
            edges = np.concatenate(([0], np.flatnonzero(task[1:] != task[:-1]) + 1, [len(task)])).tolist()
            out = []
            for lo, hi in zip(edges, edges[1:], strict=False):
                if hi - lo > 1:
                    x = scaled(values[ends[lo] : ends[hi]].astype(np.float64).reshape(hi - lo, -1))
                    got = meet(node[lo:hi], weight[lo:hi], side[lo:hi], int(cap[lo]), x, lambda r, lo=lo: marks[cuts[lo + r] : cuts[lo + r + 1]])
                    if got is not None:
                        out.append(got)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out])) for i in range(3)], ["node", "links", "root"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            task = batch.column(0).to_numpy()
            edges = np.flatnonzero(task[1:] != task[:-1]) + 1
            if held and task[0] != held[-1].column(0)[-1].as_py():
                yield from done(pa.Table.from_batches(held))
                held = []
            if len(edges):
                yield from done(pa.Table.from_batches([*held, batch.slice(0, edges[-1])]))
                held = []
            held.append(batch.slice(edges[-1] if len(edges) else 0))
        if held:
            yield from done(pa.Table.from_batches(held))

    found = scratch.save(met.repartition("task").sortWithinPartitions("task").select("task", "node", "cap", "side", "weight", "v", "caps").mapInArrow(compare, "node long, links long, root long"))
    scratch.drop(marked)
    joined = connected(found.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)
    known = nodes.select("node", "least", "weight").join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(joined, "node", "left")
    known = known.withColumn("component", F.coalesce("component", "node"))
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(least, "component").select("node", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "node").join(known, "node", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
