"""Exact cosine self-join: vectors lie in cells around pivots, and only cells that the threshold can reach meet.

The angle between unit vectors is a metric. A vector x of another cell can be within the angle t of a vector of the
cell around p only if

- it is within t of the cell's ball: angle(x, p) <= widest angle of the cell + t, and no less than the narrowest - t;
- it is within t of the half-space nearer to p than to its own pivot q: x (q - p) <= sin t |q - p|.

Both hold of every pair that the threshold links, so no pair is lost, whatever the pivots. Pivots only decide how many
copies are made. Each pair of cells meets in one of the two, each pair of vectors is looked at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoints import cut

#: Vectors of a cell, about, and the most pivots: these go to every task, the bound is 4096 rows of a vector each.
CELL, PIVOTS = 4096, 4096
#: Vectors of a cell that a task holds; a larger cell lies in blocks of about so many. Others pass by STEP at a time.
BLOCK, STEP = 8192, 1024
#: Where pairs are told, at most so many are looked at before they leave a task.
LOOK = 1 << 20
#: Slack of all bounds, far above the rounding of a product of unit vectors.
SLACK = 1e-9


def matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), np.float64).reshape(-1, size)


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # first, so that no square overflows or vanishes
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def fine_vectors(vectors: DataFrame) -> DataFrame:
    """Those that a cosine can be told of: not null, zero or with a component that is null or not finite."""
    fine = vectors.where("v is not null and exists(v, x -> x <> 0) and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    return fine.select(F.col("pos").cast("long").alias("pos"), "v")  # in its own type: floats are half as long


def vector_classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """vectors (pos, v) -> (d, pos, v, n): each different vector once, at its first place, with its number of rows;
    and (pos, class_id): the class of every row. Vectors that are null, zero or not finite are left out of both."""
    fine = fine_vectors(vectors)
    classes = cut(fine.groupBy("v").agg(F.min("pos").alias("pos"), F.count("*").alias("n")).select(F.size("v").alias("d"), "pos", "v", "n"))
    return classes, fine.join(classes.select("v", F.col("pos").alias("class_id")), "v").select("pos", "class_id")


def pivots_of(vectors: DataFrame, n: int, size: int) -> np.ndarray:
    """About one vector in CELL, PIVOTS at most, chosen by a hash of the place; one at least."""
    share = min(1.0, min(PIVOTS // 2, -(-n // CELL)) / n)
    low = F.pmod(F.xxhash64("pos"), F.lit(1 << 40)) < int(share * (1 << 40))
    found = vectors.where(low).orderBy("pos").limit(PIVOTS).select("v").collect() or vectors.orderBy("pos").limit(1).select("v").collect()
    return unit(np.array([r["v"] for r in found], np.float64).reshape(len(found), size))


def goes(home: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Whether vectors of ``home`` go to ``cell`` and not the other way round: each pair of cells one way, evenly."""
    return (cell < home) == ((home + cell) % 2 == 1)


def reached(x: np.ndarray, home: np.ndarray, pivots: np.ndarray, narrow: np.ndarray, wide: np.ndarray, threshold: float) -> np.ndarray:
    """For each vector the cells it goes to: its own, and those of the others that the threshold can reach."""
    angle = math.acos(max(-1.0, min(1.0, threshold)))
    products = np.clip(x @ pivots.T, -1, 1)
    angles = np.arccos(products)
    to = (angles <= wide + angle + 1e-7) & (angles >= narrow - angle - 1e-7)  # arccos loses half the digits near 0
    if angle < math.pi / 2:
        apart = np.sqrt(np.maximum(0, 2 - 2 * np.clip(pivots @ pivots.T, -1, 1)))
        mine = products[np.arange(len(x)), home]
        to &= mine[:, None] - products <= math.sin(angle) * apart[home] + SLACK
    to &= goes(home[:, None], np.arange(len(pivots))[None, :])
    to[np.arange(len(x)), home] = True
    return to


def in_cells(vectors: DataFrame, size: int, threshold: float) -> DataFrame:
    """vectors (pos, v, n) of one size -> pos, v, n, home, cells: where each is and where it goes, cut."""
    vectors, kind = vectors.select("pos", "v", "n"), vectors.schema["v"].dataType.simpleString()
    pivots = pivots_of(vectors, max(1, vectors.count()), size)
    m = len(pivots)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            products = unit(matrix(batch.column(1), size)) @ pivots.T
            home = products.argmax(axis=1)
            angle = np.arccos(np.clip(products[np.arange(len(home)), home], -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int32)), pa.array(angle)], [*batch.schema.names, "home", "angle"])

    placed = cut(vectors.mapInArrow(nearest, f"pos long, v {kind}, n long, home int, angle double"))
    narrow, wide = np.full(m, np.inf), np.full(m, -np.inf)  # a cell without vectors is never reached
    for r in placed.groupBy("home").agg(F.min("angle").alias("a"), F.max("angle").alias("z")).collect():  # a row a pivot
        narrow[r["home"]], wide[r["home"]] = r["a"], r["z"]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, (1 << 22) // m)
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                to = reached(unit(matrix(part.column(1), size)), part.column(3).to_numpy(), pivots, narrow, wide, threshold)
                ends = np.r_[0, np.cumsum(to.sum(axis=1))]
                cells = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.nonzero(to)[1].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns[:4], cells], ["pos", "v", "n", "home", "cells"])

    return cut(placed.mapInArrow(spread, f"pos long, v {kind}, n long, home int, cells array<int>"))


def meetings(batches: Iterator[pa.RecordBatch], size: int, threshold: float, pairs: bool) -> Iterator[pa.RecordBatch]:
    """Rows by cell, block and kind -> the links of each block's own vectors (kind 0) among themselves and with those
    that come by (kind 1), batch by batch: pairs (pos, earlier, cosine), or how many each vector has (pos, k)."""
    key, own, x = None, [], None
    pos = n = k = None

    def step() -> int:
        return max(1, min(STEP, LOOK // len(x))) if pairs else STEP

    def told(a, b, n_a, n_b, like, cosines) -> Iterator[pa.RecordBatch]:
        if pairs:
            i, j = np.nonzero(like)
            p, q = a[i], b[j]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(p, q)), pa.array(np.minimum(p, q)), pa.array(cosines[i, j])], ["pos", "earlier", "cosine"])
        else:
            k[:] += like @ n_b
            yield from counted(b, n_a @ like)

    def counted(at, many) -> Iterator[pa.RecordBatch]:
        some = many > 0
        yield pa.RecordBatch.from_arrays([pa.array(at[some]), pa.array(many[some].astype(np.int64))], ["pos", "k"])

    def begin() -> Iterator[pa.RecordBatch]:
        """The block is complete: its vectors meet each other."""
        nonlocal x, pos, n, k
        x, pos, n = (np.concatenate(part) for part in zip(*own, strict=True))
        k = np.zeros(len(x))
        for at in range(0, len(x), step()):
            to = at + step()
            c = x @ x[at:to].T
            yield from told(pos, pos[at:to], n, n[at:to], (c >= threshold) & (pos[:, None] > pos[None, at:to]), c)

    def end() -> Iterator[pa.RecordBatch]:
        if own and x is None:
            yield from begin()
        if k is not None and not pairs:
            yield from counted(pos, k)

    for batch in batches:
        cell, block, kind = (batch.column(i).to_numpy() for i in range(3))
        cuts = np.flatnonzero(np.r_[True, (np.diff(cell) != 0) | (np.diff(block) != 0) | (np.diff(kind) != 0), True])
        for at, to in zip(cuts[:-1], cuts[1:], strict=True):
            if (cell[at], block[at]) != key:
                yield from end()
                key, own, x, k = (cell[at], block[at]), [], None, None
            part = batch.slice(at, to - at)
            v = unit(matrix(part.column(4), size))
            if not kind[at]:
                own.append((v, part.column(3).to_numpy(), part.column(5).to_numpy()))
                continue
            if own and x is None:
                yield from begin()
            for low in range(0, len(v) if own else 0, step() if own else 1):
                high = low + step()
                c = x @ v[low:high].T
                yield from told(pos, part.column(3).to_numpy()[low:high], n, part.column(5).to_numpy()[low:high], c >= threshold, c)
    yield from end()


def dealt(placed: DataFrame) -> DataFrame:
    """cell, block, kind, pos, v, n: a cell's own vectors once, in blocks (kind 0), and those that come to a block:
    each block's to the other blocks of its cell one way, and every vector to all blocks of the cells it goes to."""
    counts = placed.groupBy(F.col("home").alias("cell")).agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    # A row a pivot: PIVOTS at most.
    mine = F.pmod(F.xxhash64("pos"), F.col("blocks")).cast("int")
    own = placed.select(F.col("home").alias("cell"), "pos", "v", "n").join(F.broadcast(counts), "cell").select("cell", mine.alias("block"), F.lit(0).alias("kind"), "pos", "v", "n")
    come = placed.select(F.explode("cells").alias("cell"), "home", "pos", "v", "n").join(F.broadcast(counts), "cell").withColumn("mine", mine)
    to = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: (F.col("home") != F.col("cell")) | ((b < F.col("mine")) == ((b + F.col("mine")) % 2 == 1)) & (b != F.col("mine")))
    return own.union(come.select("cell", F.explode(to).alias("block"), F.lit(1).alias("kind"), "pos", "v", "n"))


def compared(placed: DataFrame, size: int, threshold: float, pairs: bool) -> DataFrame:
    """Links of vectors in cells, see ``meetings``. Only a block's own vectors are held, the others stream past them."""
    rows = dealt(placed).repartition("cell", "block").sortWithinPartitions("cell", "block", "kind")
    return rows.mapInArrow(lambda batches: meetings(batches, size, threshold, pairs), PAIRS if pairs else COUNTS)


PAIRS, COUNTS = "pos long, earlier long, cosine double", "pos long, k long"


def by_size(classes: DataFrame, threshold: float, pairs: bool) -> DataFrame:
    """Vectors of different sizes never meet: one join for each size."""
    out = classes.sparkSession.createDataFrame([], PAIRS if pairs else COUNTS)
    for d in [r["d"] for r in classes.select("d").distinct().collect()]:
        out = out.union(compared(in_cells(classes.where(F.col("d") == d), d, threshold), d, threshold, pairs))
    return out


def class_links(classes: DataFrame, threshold: float) -> DataFrame:
    """classes (d, pos, v, n) -> (pos, earlier, cosine) of all pairs of different vectors at the threshold or above."""
    return by_size(classes, threshold, True)


def row_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """vectors (pos, v) -> (pos, earlier, cosine) of all pairs of rows at the threshold or above, in double precision,
    copies of one vector among them. Vectors that are null, zero or not finite, and rows without a place, pair with
    nothing. Pairs leave the tasks in which vectors meet and are never shuffled or kept; there are as many as links."""
    rows = fine_vectors(vectors).where("pos is not null").select(F.size("v").alias("d"), "pos", "v", F.lit(1).cast("long").alias("n"))
    return class_links(rows, threshold).where("earlier < pos")


def link_counts(vectors: DataFrame, threshold: float) -> DataFrame:
    """vectors (pos, v) -> pos, class_id, n_links: the first place of the same vector, and how many other vectors have
    a cosine of the threshold or more, in double precision; equal vectors have. Null for vectors that are null, zero or
    not finite. Meetings tell counts, never pairs, so a group of like vectors of any size costs a row a vector."""
    classes, members = vector_classes(vectors)
    found = by_size(classes, threshold, False).groupBy("pos").agg(F.sum("k").alias("k"))
    total = classes.join(found, "pos", "left").select(F.col("pos").alias("class_id"), (F.coalesce("k", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    linked = members.join(total, "class_id").select("pos", "class_id", "n_links")
    return vectors.select(F.col("pos").cast("long").alias("pos")).join(linked, "pos", "left")


def leaders(vectors: DataFrame, threshold: float, batch: int = 2048) -> DataFrame:
    """vectors (pos, v) with distinct pos -> (pos, leader): every vector joins the earliest leader it is like, or leads.

    Equal vectors go with the first of them. The first open vectors, ``batch`` of them, decide among themselves; their
    leaders go to all others, and what is like one follows. As long as this settles a quarter of the open vectors, it
    is done again. What is then left has few links, for it is like no leader before it: these links are joined, and
    rounds decide.
    """
    from .clustering import leaders_by_rounds

    classes, members = vector_classes(vectors)
    open_, done = classes.select("d", "pos", "v", "n"), None
    left = open_.count()
    while left:
        first = open_.orderBy("pos").limit(batch).select("pos", "v").collect()  # ``batch`` rows at most
        heads: dict[int, list] = {}
        for r in first:
            x = unit(np.array([r["v"]]))
            before = heads.setdefault(len(r["v"]), [])
            if not any(float((x @ h.T)[0, 0]) >= threshold for _, h in before):
                before.append((r["pos"], x))
        held = {d: (np.array([p for p, _ in many]), np.concatenate([h for _, h in many])) for d, many in heads.items()}

        def follow(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sizes, pos = b.column(0).to_numpy(), b.column(1).to_numpy()
                leader, found = np.zeros(len(pos), np.int64), np.zeros(len(pos), bool)
                for d in np.unique(sizes):
                    if int(d) in held:
                        at, (heads, h) = np.flatnonzero(sizes == d), held[int(d)]
                        like = unit(matrix(b.column(2).take(pa.array(at)), int(d))) @ h.T >= threshold
                        like |= pos[at][:, None] == heads[None, :]
                        leader[at], found[at] = heads[like.argmax(axis=1)], like.any(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leader, mask=~found)], [*b.schema.names, "leader"])

        now = cut(open_.mapInArrow(follow, f"d int, pos long, v {open_.schema['v'].dataType.simpleString()}, n long, leader long"))
        settled = now.where("leader is not null").select("pos", "leader")
        done = settled if done is None else done.union(settled)
        open_ = now.where("leader is null").drop("leader")
        before, left = left, open_.count()
        if left > batch and left > 0.75 * before:
            break
    if left:
        rest = leaders_by_rounds(open_.select("pos"), class_links(open_, threshold))
        done = rest if done is None else done.union(rest)
    if done is None:
        return vectors.select(F.col("pos").cast("long").alias("pos")).withColumn("leader", F.col("pos"))
    of = members.join(done.withColumnRenamed("pos", "class_id"), "class_id").select("pos", "leader")
    return vectors.select(F.col("pos").cast("long").alias("pos")).join(of, "pos", "left").withColumn("leader", F.coalesce("leader", "pos"))
