"""N-gram Jaccard join: rare shingles bring texts together, a count-vector R-tree bounds their overlap, sets verify.

A shingle set becomes a vector of counts by hashing its members into groups. The summed coordinate minima of two
vectors are never below the overlap of the sets, nor are those of two boxes below any pair in them. Counts in many
more groups, of one bit each, bound the overlap of the pairs that the tree lets through once more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected
from .words import batches_of, mixed, shingles

WIDTH, NUMERATOR = 5, 75  # words a shingle; per cent of the union
GROUPS = 256
#: Bits of the finer vector: the power of two from this many a member, within these powers.
PER_MEMBER, FINE = 8, (12, 18)
#: Slots of the shingle frequencies that order a set's members; a fixed 4 MB whatever the input.
SLOTS = 1 << 20
#: Texts that one index task holds of a meeting; larger meetings are dealt out as pairs of blocks.
BLOCK = 1000
#: Meetings of more texts than this carry the finer vectors; of more than LARGE, they first give a forest of pairs.
FEW, LARGE = 8, 64
#: Keys below a meeting's own by which two members may see that they have met already.
BEFORE = 8


def needed(a, b, per_cent: int = NUMERATOR):
    """The least overlap of sets of sizes a and b with 100 * overlap >= per_cent * union."""
    return -(-per_cent * (a + b) // (100 + per_cent))


def rows_of(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    for i, j, words, first in batches_of(batch.column(batch.schema.get_field_index("text"))):
        for r in range(i, j):
            yield r, shingles(words[first[r - i] : first[r - i + 1]], width)


def frequencies(documents: DataFrame, width: int) -> np.ndarray:
    """How often shingles fall into each slot, over all documents. Only an order is taken from it, so any is right."""
    part = SLOTS // 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            held = [s for _, s in rows_of(batch, width)]
            if held:
                total += np.bincount((np.concatenate(held) >> np.uint64(44)).astype(np.int64), minlength=SLOTS)
        packed = [total[k * part : (k + 1) * part].astype("<i4" if total.max(initial=0) < 1 << 31 else "<i8") for k in range(64)]
        yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array([p.astype("<i8").tobytes() if p.itemsize == 8 else p.tobytes() for p in packed], pa.binary())], ["k", "x"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(part, np.int64)
        for batch in batches:
            for x in batch.column("x"):
                raw = x.as_buffer()
                total += np.frombuffer(raw, "<i4" if raw.size == 4 * part else "<i8")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.minimum(total, (1 << 31) - 1).astype("<i4").tobytes()], pa.binary())], ["k", "x"])

    out = np.zeros(SLOTS, np.int32)
    for row in documents.select("text").mapInArrow(count, "k int, x binary").groupBy("k").applyInArrow(add, "k int, x binary").toLocalIterator():
        out[row["k"] * part : (row["k"] + 1) * part] = np.frombuffer(row["x"], "<i4")
    return out


def vector(found: np.ndarray, groups: int = GROUPS) -> bytes:
    """Counts by group, in as few bytes a count as they need."""
    counts = np.bincount((found & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    return counts.astype("<u1" if counts.max(initial=0) < 1 << 8 else "<u2" if counts.max() < 1 << 16 else "<u4").tobytes()


def fine_vector(found: np.ndarray) -> bytes:
    """A bit for each group that holds a member. Groups are leading bits, so neighbouring bits merge into coarser groups."""
    power = min(max((PER_MEMBER * max(1, len(found)) - 1).bit_length(), FINE[0]), FINE[1])
    bits = np.zeros(1 << power, bool)
    bits[(mixed(found) >> np.uint64(64 - power)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


class Fine:
    """Finer vectors of many sets, and the most that two of them can share."""

    def __init__(self, raws: list, sizes: np.ndarray):
        self.sizes, self.widths, self.raws = sizes, np.array([len(r) for r in raws], np.int64), raws
        self.made: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def at(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of each set, bits as 64-bit words, members that share a bit with an earlier one) at this width or, for wider sets, merged to it."""
        if width not in self.made:
            held = np.flatnonzero(self.widths >= width)
            rows = np.zeros((len(held), width), np.uint8)
            for k, i in enumerate(held.tolist()):
                raw = np.frombuffer(self.raws[i], np.uint8)
                rows[k] = raw if len(raw) == width else np.packbits(np.unpackbits(raw).reshape(8 * width, -1).any(axis=1))
            place = np.full(len(self.raws), -1)
            place[held] = np.arange(len(held))
            words = rows.view(np.uint64)
            self.made[width] = place, words, self.sizes[held] - np.bitwise_count(words).sum(axis=1, dtype=np.int64)
        return self.made[width]

    def most(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Upper bounds on the overlaps of the pairs: a bit of one side that the other lacks is a member it lacks."""
        width, out = np.minimum(self.widths[i], self.widths[j]), np.zeros(len(i), np.int64)
        for w in np.unique(width).tolist():
            place, words, doubled = self.at(w)
            pick = np.flatnonzero(width == w)
            step = max(1, (1 << 22) // w)
            for lo in range(0, len(pick), step):
                at = pick[lo : lo + step]
                a, b = place[i[at]], place[j[at]]
                out[at] = np.bitwise_count(words[a] & words[b]).sum(axis=1, dtype=np.int64) + np.minimum(doubled[a], doubled[b])
        return out


class Box:
    """A node of the R-tree: the least and greatest counts of what it holds, and the least set size."""

    __slots__ = ("high", "kids", "members", "size")

    def __init__(self, points: np.ndarray, sizes: np.ndarray, members: np.ndarray, leaf: int = 16):
        self.high, self.size = points[members].max(axis=0), int(sizes[members].min())
        self.members, self.kids = members, []
        if len(members) > leaf:
            spread = points[members].max(axis=0) - points[members].min(axis=0)
            order = members[np.argsort(points[members, spread.argmax()], kind="stable")]
            half = len(order) // 2
            self.members, self.kids = members[:0], [Box(points, sizes, order[:half], leaf), Box(points, sizes, order[half:], leaf)]


def overlapping(points: np.ndarray, sizes: np.ndarray, per_cent: int, left: np.ndarray | None = None, right: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose summed minima reach the overlap they need: within all points, or between left and right."""
    n = len(points)
    everything = np.arange(n)
    a = Box(points, sizes, everything if left is None else left)
    b = a if right is None else Box(points, sizes, right)
    todo, out = [(a, b)], []
    while todo:
        x, y = todo.pop()
        if np.minimum(x.high, y.high).sum() < needed(x.size, y.size, per_cent):
            continue
        if x.kids or y.kids:
            if x is y:
                todo += [(x.kids[0], x.kids[0]), (x.kids[0], x.kids[1]), (x.kids[1], x.kids[1])]
            elif x.kids and (not y.kids or len(x.kids) >= len(y.kids)):
                todo += [(k, y) for k in x.kids]
            else:
                todo += [(x, k) for k in y.kids]
            continue
        i, j = np.meshgrid(x.members, y.members, indexing="ij")
        i, j = i.ravel(), j.ravel()
        if x is y:
            i, j = i[i < j], j[i < j]
        most = np.minimum(points[i], points[j]).sum(axis=1)
        good = most >= needed(sizes[i], sizes[j], per_cent)
        out.append((i[good], j[good]))
    if not out:
        return everything[:0], everything[:0]
    return np.concatenate([p[0] for p in out]), np.concatenate([p[1] for p in out])


def keyed(documents: DataFrame, width: int, per_cent: int) -> DataFrame:
    """doc_id, n, sig (a hash of the set), keys (its rarest members, as many as any linked set must share one of), vec, fine."""
    counts = documents.sparkSession.sparkContext.broadcast(frequencies(documents, width))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = counts.value
        for batch in batches:
            sizes, sigs, keys, vectors, fines = [], [], [], [], []
            for _, found in rows_of(batch, width):
                n = len(found)
                prefix = n - -(-per_cent * n // 100) + 1 if n else 0
                rare = np.lexsort((found, slots[(found >> np.uint64(44)).astype(np.int64)]))[:prefix]
                sizes.append(n)
                sigs.append(int(np.bitwise_xor.reduce(found * np.uint64(0xD6E8FEB86659FD93) ^ (found >> np.uint64(29))).astype(np.int64)) if n else None)
                keys.append(found[rare].view(np.int64))
                vectors.append(vector(found))
                fines.append(fine_vector(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(sigs, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(vectors, pa.binary()), pa.array(fines, pa.binary())], ["doc_id", "n", "sig", "keys", "vec", "fine"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(mark, "doc_id long, n long, sig long, keys array<long>, vec binary, fine binary")


def runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[pa.RecordBatch]]:
    """The rows of each value of the first column, which comes sorted, as batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1), len(key)]
        for a, b in zip(edges, edges[1:], strict=False):
            if held and key[a] != last:
                yield held
                held = []
            held.append(batch.slice(a, b - a))
            last = key[a]
    if held:
        yield held


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node) sorted by both -> (key, leader, node) for keys of two nodes or more; the leader is the least node."""
    last_key = leader = None
    tail: tuple | None = None  # the last row, if its key has shown one node so far
    for batch in batches:
        if not batch.num_rows:
            continue
        key, node = (batch.column(i).to_numpy() for i in (0, 1))
        first = np.empty(len(key), bool)
        first[0] = last_key is None or key[0] != last_key
        first[1:] = key[1:] != key[:-1]
        lead = np.where(first, node, 0)
        at = np.maximum.accumulate(np.where(first, np.arange(len(key)), -1))
        lead = np.where(at >= 0, node[np.maximum(at, 0)], leader if leader is not None else 0)
        member = ~first
        alone = first.copy()
        alone[:-1] &= first[1:]
        alone[-1] = False
        keep = member | (first & ~alone)
        if first[-1]:
            keep[-1] = False
        rows = [(key[keep], lead[keep], node[keep])]
        if tail is not None and not first[0]:
            rows.insert(0, tuple(np.array([x]) for x in tail))
        tail = (key[-1], node[-1], node[-1]) if first[-1] else None
        last_key, leader = key[-1], lead[-1]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([r[i] for r in rows])) for i in range(3)], ["key", "leader", "node"])


def points_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Count vectors as rows; a count has one byte, or more in large sets."""
    raws = [v.as_buffer() for v in column]
    return np.stack([np.frombuffer(r, f"<u{r.size // GROUPS}").astype(np.int32) for r in raws]) if raws else np.zeros((0, GROUPS), np.int32)


def bounded(pairs: DataFrame, own: DataFrame, per_cent: int) -> DataFrame:
    """The pairs whose sizes, summed coordinate minima and finer vectors allow the overlap they need."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
                most = np.minimum(points_of(batch.column("va")), points_of(batch.column("vb"))).sum(axis=1)
                good = (most >= needed(na, nb, per_cent)) & (100 * np.minimum(na, nb) >= per_cent * np.maximum(na, nb))
                batch, na, nb = batch.filter(pa.array(good)), na[good], nb[good]
                fine, k = Fine([x.as_buffer() for c in ("fa", "fb") for x in batch.column(c)], np.concatenate((na, nb))), len(na)
                yield batch.select(["a", "b"]).filter(pa.array(fine.most(np.arange(k), np.arange(k, 2 * k)) >= needed(na, nb, per_cent)))

    side = lambda x: own.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("vec").alias(f"v{x}"), F.col("fine").alias(f"f{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", "na", "nb", "va", "vb", "fa", "fb").mapInArrow(keep, "a long, b long").distinct()


#: Bits of the filter that keeps texts which surely need no verification from being moved; a fixed 1 MB.
BITS = 1 << 23


def bit_of(ids: np.ndarray) -> np.ndarray:
    return (mixed(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - 23)).astype(np.int64)


def marked(nodes: DataFrame) -> np.ndarray:
    """A bit for each node; whoever has none is not among them."""
    part = BITS // 16

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITS, bool)
        for batch in batches:
            bits[bit_of(batch.column(0).to_numpy())] = True
        yield pa.RecordBatch.from_arrays([pa.array(range(16), pa.int32()), pa.array([np.packbits(bits[k * part : (k + 1) * part]).tobytes() for k in range(16)], pa.binary())], ["k", "x"])

    def either(table: pa.Table) -> pa.Table:
        joined = np.bitwise_or.reduce([np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("x")])
        return pa.table({"k": table.column("k").slice(0, 1), "x": pa.array([joined.tobytes()], pa.binary())})

    out = np.zeros(BITS, bool)
    for row in nodes.mapInArrow(mark, "k int, x binary").groupBy("k").applyInArrow(either, "k int, x binary").collect():
        out[row["k"] * part : (row["k"] + 1) * part] = np.unpackbits(np.frombuffer(row["x"], np.uint8)).astype(bool)
    return out


def verified(pairs: DataFrame, documents: DataFrame, scratch: Scratch, width: int, per_cent: int) -> DataFrame:
    """The pairs (a, b) of doc_ids whose whole shingle sets reach the threshold."""
    pairs = scratch.save(pairs)
    nodes = scratch.save(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    bits = documents.sparkSession.sparkContext.broadcast(marked(nodes))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            batch = batch.filter(pa.array(bits.value[bit_of(batch.column(0).to_numpy())]))
            held = [found.tobytes() for _, found in rows_of(batch, width)]
            for at in range(0, len(held), 256):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256), pa.array(held[at : at + 256], pa.binary())], ["node", "s"])

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both > 0 and 100 * both >= per_cent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    made = documents.select(F.col("doc_id").cast("long").alias("node"), "text").mapInArrow(sets, "node long, s binary")
    held = scratch.save(made.join(nodes, "node", "left_semi"))
    scratch.release()
    both = pairs.join(held.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(held.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    out = scratch.save(both.select("a", "b", "sa", "sb").mapInArrow(share, "a long, b long"))
    scratch.drop(pairs, held, nodes)
    scratch.release()
    return out


def spanning(component: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs (i, j) of members, taken in order, join components that the pairs before have not joined."""
    names, at = np.unique(component, return_inverse=True)
    parent = list(range(len(names)))
    out = np.zeros(len(i), bool)
    for k, (x, y) in enumerate(zip(at[i].tolist(), at[j].tolist(), strict=True)):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[x] = y
            out[k] = True
    return out


def met_before(keys: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs have one of the keys in common that both had just before this meeting's (0: none)."""
    out, step = np.zeros(len(i), bool), 1 << 15
    for lo in range(0, len(i), step):
        a, b = keys[i[lo : lo + step]], keys[j[lo : lo + step]]
        out[lo : lo + step] = ((a[:, :, None] == b[:, None, :]) & (a != 0)[:, :, None]).any(axis=(1, 2))
    return out


def tree_pairs(apart: DataFrame, own: DataFrame, per_cent: int, more_than: int = 1, forest: bool = False) -> DataFrame:
    """The pairs of meetings (key, node, component) in different components that the R-tree's bounds let through.

    Of meetings with the same members one is looked at. Two texts that share many keys meet often; a meeting passes a
    pair over if it sees the pair share one of the keys (of those looked at, in order) just before its own, so the
    least key that they share always takes it and few others do. With ``forest`` only meetings of over ``more_than``
    members count, and a task gives as few pairs as join what all of its pairs would join.
    """
    open_ = apart.groupBy("key").agg(F.count("*").alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who")).where((F.col("lo") < F.col("hi")) & (F.col("m") > more_than))
    open_ = open_.groupBy("who", "m").agg(F.min("key").alias("key"))
    listed = apart.join(open_.select("key", "m"), "key").groupBy("node", "component").agg(F.sort_array(F.collect_list(F.struct("key", "m"))).alias("met"))
    rows = listed.join(own.select("node", "n", "vec", "fine"), "node").select("node", "component", "n", "vec", "fine", "met", F.posexplode("met").alias("at", "here"))
    before = F.transform(F.slice("met", F.greatest(F.col("at") - BEFORE + 1, F.lit(1)), F.least(F.col("at"), F.lit(BEFORE))), lambda x: x["key"])
    blocks = F.ceil(F.col("here.m") / F.lit(BLOCK)).cast("int")
    rows = rows.select("node", "component", "n", "vec", F.when(F.col("here.m") > FEW, F.col("fine")).alias("fine"), before.alias("before"), F.col("here.key").alias("key"), blocks.alias("blocks"))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("task"), "node", "component", "n", "vec", "fine", "before", F.when(F.col("mine") == F.col("other"), -1).otherwise(F.when(F.col("mine") < F.col("other"), 0).otherwise(1)).alias("side"))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, []):
            t = pa.Table.from_batches(run)
            node, component, n, side = (t.column(c).to_numpy() for c in ("node", "component", "n", "side"))
            if len(node) < 2 or component.min() == component.max():
                continue
            parts = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if (side >= 0).any() else ()
            if parts and not all(map(len, parts)):
                continue
            i, j = overlapping(points_of(t.column("vec")), n, per_cent, *parts)
            new = component[i] != component[j]
            i, j = i[new], j[new]
            before = t.column("before").combine_chunks()
            keys = np.zeros((len(node), BEFORE), np.int64)
            keys[np.arange(BEFORE)[None, :] < before.value_lengths().to_numpy()[:, None]] = before.flatten().to_numpy()
            new = ~met_before(keys, i, j)
            i, j = i[new], j[new]
            if t.column("fine").null_count == 0:
                good = Fine([x.as_buffer() for x in t.column("fine")], n).most(i, j) >= needed(n[i], n[j], per_cent)
                i, j = i[good], j[good]
            if forest:
                new = spanning(component, i, j)
                i, j = i[new], j[new]
            a, b = node[i], node[j]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return rows.repartition("task").sortWithinPartitions("task").mapInArrow(index, "a long, b long").distinct()


def jaccard_join(documents: DataFrame, width: int = WIDTH, per_cent: int = NUMERATOR, links: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id for every document; documents link at ``per_cent`` of the union or more.

    Words are runs without white space, A to Z lower-cased, of whole texts. A text with fewer words than a shingle is
    one shingle; a null, empty or wordless text has none and is alone. Equal sets are one node. The rows of a repeated
    doc_id are one document in the components: what any of them links with is reached from all, and all get the same
    component_id; n_shingles is each row's own. A row with a null id is alone with component null. An empty table
    gives no rows.

    Linked sets share one of each other's rarest members, so texts meet by these. In each meeting the least node
    stands for the others: pairs that their count vectors allow are verified, and whoever links with it needs no
    further look. What such stars leave apart goes through the count-vector R-tree: large meetings first give as few
    pairs as may join them, then all meetings give every pair that the bounds let through and that is still apart.
    All are verified on whole sets. Nothing is capped.

    With ``links`` no star stands for others: every pair that the bounds let through is verified, and the result is
    (a, b), a < b, all links between different sets, each set named by its least doc_id (so two sets that have the same
    one give no pair). Their number grows with the square of a group.
    """
    documents = documents.select("doc_id", "text")
    scratch = Scratch(documents.sparkSession, "op8")
    sets = scratch.save(keyed(documents, width, per_cent))
    slim = scratch.save(sets.select("doc_id", "n", "sig"))
    classes = scratch.save(slim.where("sig is not null and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("node")))
    first = classes.select("sig", F.col("node").alias("doc_id"))
    leads = sets.join(first, ["doc_id", "sig"], "left_semi")
    own = scratch.save(leads.dropDuplicates(["doc_id", "sig"]).select(F.col("doc_id").alias("node"), "n", "vec", "fine"), compression="zstd")
    spread = leads.select(F.explode("keys").alias("key"), F.col("doc_id").alias("node"))
    met = scratch.save(spread.repartition("key").sortWithinPartitions("key", "node").mapInArrow(stars, "key long, leader long, node long"))
    scratch.drop(sets)
    scratch.release()
    if links:
        apart = met.select("key", "node").distinct().withColumn("component", F.col("node"))
        return verified(tree_pairs(apart, own, per_cent), documents, scratch, width, per_cent)

    # The rows of an id belong together, whatever their sets.
    several = slim.where("doc_id is not null and sig is not null").groupBy("doc_id").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi")).where("lo < hi")
    same_id = slim.join(several, "doc_id", "left_semi").join(classes, "sig").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    tried = scratch.save(met.where("leader <> node").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct())
    edges = scratch.save(same_id.union(verified(bounded(tried, own, per_cent), documents, scratch, width, per_cent)))
    joined = scratch.save(connected(edges, scratch))
    for forest in (True, False):
        apart = met.select("key", "node").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
        found = scratch.save(tree_pairs(apart, own, per_cent, LARGE if forest else 1, forest).join(tried, ["a", "b"], "left_anti"))
        if not found.isEmpty():
            edges = scratch.save(edges.union(verified(found, documents, scratch, width, per_cent)))
            tried = scratch.save(tried.union(found))
            scratch.drop(joined)
            joined = scratch.save(connected(edges, scratch))
        scratch.drop(found)
    scratch.drop(met, own, tried)
    known = slim.join(classes, "sig").where("doc_id is not null").select("doc_id", "node").distinct().join(joined, "node", "left")
    known = known.groupBy("doc_id").agg(F.min(F.coalesce("component", "node")).alias("component"))
    out = slim.join(known, "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
