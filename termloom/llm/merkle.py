"""Merkle manifest: trees over all rows, built in aligned blocks; paths advance leaf by leaf with stacks of treehash nodes."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

#: Leaves of a block are 2 to this power.
HEIGHT = 10
#: What a leaf is made of, in this order.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def field(value: Column) -> Column:
    """A value as its number of bytes, a colon and itself; a null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(changed: dict[str, Column] | None = None) -> Column:
    """The hash of a row's fields, some of them ``changed``."""
    return F.sha2(F.concat(*[field((changed or {}).get(c, F.col(c))) for c in FIELDS]), 256)


def joined(*nodes: bytes) -> bytes:
    return sha256(b"".join(nodes)).hexdigest().encode()


class Treehash:
    """The node of ``height`` over the leaves from ``start``, by a stack of (height, node) and one step at a time.

    Where the leaves end inside, the last node of a level may be alone and is then hashed by itself. Without any leaf
    there is no node. Steps are pushes, merges and lifts; 2^(height + 1) - 1 at most.
    """

    __slots__ = ("at", "end", "height", "leaves", "stack")

    def __init__(self, leaves: list[bytes], start: int, height: int):
        self.leaves, self.at, self.height, self.end, self.stack = leaves, start, height, min(start + (1 << height), len(leaves)), []

    def advance(self, steps: int) -> None:
        stack = self.stack
        for _ in range(steps):
            if len(stack) > 1 and stack[-1][0] == stack[-2][0]:
                h, right = stack.pop()
                stack[-1] = (h + 1, joined(stack[-1][1], right))
            elif self.at < self.end:
                stack.append((0, self.leaves[self.at]))
                self.at += 1
            elif stack and stack[-1][0] < self.height:
                h, alone = stack[-1]
                stack[-1] = (h + 1, joined(alone))
            else:
                return

    def node(self) -> bytes:
        return self.stack[0][1] if self.stack else b""


def node(leaves: list[bytes], start: int, height: int) -> Treehash:
    out = Treehash(leaves, start, height)
    out.advance(2 << height)
    return out


def traverse(leaves: list[bytes], height: int) -> Iterator[list[bytes]]:
    """The path of each leaf in turn: at each level L or R, the sibling's side, and the sibling; empty without one.

    Between two leaves every stack takes two steps, and the level h of the path changes every 2^h leaves: by then
    its stack is ready. So what is held is the path and, for each level, a stack of as many nodes at most.
    """
    path = [node(leaves, 1 << h, h).node() for h in range(height)]
    stacks = [node(leaves, 0, h) for h in range(height)]
    for s in range(len(leaves)):
        yield [(b"L" if s >> h & 1 else b"R") + x if x else b"" for h, x in enumerate(path)]
        for h in range(min(height, ((s + 1) & -(s + 1)).bit_length())):
            path[h] = stacks[h].node()
            stacks[h] = Treehash(leaves, (s + 1 + (1 << h)) ^ (1 << h), h)
        for stack in stacks:
            stack.advance(2)


def levels(size: int, height: int) -> int:
    """Levels inside a block of a tree over ``size`` leaves."""
    return min(height, (size - 1).bit_length())


def ranked(rows: DataFrame, order: list, scratch: Scratch) -> DataFrame:
    """``rows`` of a saved table with tree, and pos and size: the place within the tree in the order given, the tree's rows.

    Rows are sorted by range, so a large tree lies in many tasks; counts by tree and task give each task's first
    place. The last key is the place in the saved table, so that equal rows part too.
    """
    by = ["tree", *order, "place"]
    saved = scratch.save(rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("place").select("*", F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("at")))
    spans = saved.groupBy("tree", "task").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(tree.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("tree", "task", (before - F.col("first")).alias("shift"), F.sum("n").over(tree).alias("size"))
    return saved.join(spans, ["tree", "task"]).withColumn("pos", F.col("at") + F.col("shift")).drop("task", "at", "shift")


def blocks_of(nodes: DataFrame, scratch: Scratch, height: int) -> DataFrame:
    """nodes (tree, pos, size, digest, more) -> tree, block, size, members (in order), top: the node over the block."""
    held = [c for c in nodes.columns if c not in ("tree", "size")]
    members = F.sort_array(F.collect_list(F.struct("pos", *[c for c in held if c != "pos"]))).alias("members")
    grouped = nodes.withColumn("block", F.shiftright("pos", height)).groupBy("tree", "block").agg(F.first("size").alias("size"), members)

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1)
                leaves = [x.encode() for x in row.column("members").flatten().field("digest").to_pylist()]
                top = node(leaves, 0, levels(row.column("size")[0].as_py(), height)).node().decode()
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([top])], [*row.schema.names, "top"])

    schema = T.StructType([*grouped.schema.fields, T.StructField("top", T.StringType())])
    return scratch.save(grouped.mapInArrow(tops, schema))


def unpacked(blocks: DataFrame, height: int) -> DataFrame:
    """blocks with path and root, what is above them -> each member's tree, columns, whole path and root."""

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1)
                leaves = [x.encode() for x in row.column("members").flatten().field("digest").to_pylist()]
                made = [list(map(bytes.decode, p)) for p in traverse(leaves, levels(row.column("size")[0].as_py(), height))]
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([made], pa.list_(pa.list_(pa.string())))], [*row.schema.names, "paths"])

    schema = T.StructType([*blocks.schema.fields, T.StructField("paths", T.ArrayType(T.ArrayType(T.StringType())))])
    each = blocks.mapInArrow(paths, schema).withColumn("m", F.explode(F.arrays_zip("members", "paths")))
    more = [c for c in blocks.columns if c not in ("tree", "block", "size", "members", "top", "path")]
    return each.select("tree", "size", "m.members.*", F.concat("m.paths", "path").alias("path"), *more)


def climb(nodes: DataFrame, scratch: Scratch, height: int) -> DataFrame:
    """nodes (tree, pos, size, digest, more) -> the blocks of these and, for each, path and root: what is above it in its tree.

    The blocks' nodes are the leaves of a tree again, until every tree has one block: a few steps for any number of rows.
    """
    blocks = blocks_of(nodes, scratch, height)
    above = blocks.select("tree", F.col("block").alias("pos"), F.ceil(F.col("size") / F.lit(1 << height)).alias("size"), F.col("top").alias("digest"))
    if above.where("size > 1").isEmpty():
        return blocks.withColumns({"path": F.array().cast("array<string>"), "root": F.col("top")})
    upper = unpacked(climb(above, scratch, height), height).select("tree", F.col("pos").alias("block"), "path", "root")
    return blocks.join(upper, ["tree", "block"])


def merkle_manifest(documents: DataFrame, more: dict[str, Column] | None = None, height: int = HEIGHT) -> DataFrame:
    """A row for each document: doc_id, lang, leaf, subroot, root, path (array<string>), and ``more``, computed from its columns.

    The documents of a lang form a tree in order of doc_id; the trees' roots, in order of lang, form the one above.
    In every tree two consecutive nodes become one, a last one alone is hashed by itself, until one is left; a lone
    leaf is its tree's root. ``path`` has every sibling from the leaf up, see ``traverse``; ``folded`` recomputes a root.

    Null ids come before all others, rows of one id are ordered by leaf, repeated rows are leaves of their own. A null
    lang is a tree of its own, the first. Null and empty texts are told apart by the leaf. An empty table gives no
    rows. Columns of other names are not read, whatever these are.

    Text is read once and only leaves are shuffled. A task holds blocks of 2^height leaves one after the other.
    """
    scratch = Scratch(documents.sparkSession, "op13")
    more = more or {}
    tree = F.coalesce(F.concat(F.lit("+"), F.col("lang").cast("string")), F.lit(""))
    leaves = scratch.save(documents.select(tree.alias("tree"), "doc_id", leaf_of().alias("digest"), *[c.alias(f"more_{k}") for k, c in more.items()]))
    blocks = climb(ranked(leaves, [F.asc_nulls_first("doc_id"), "digest"], scratch), scratch, height)
    blocks = scratch.save(blocks.withColumnRenamed("root", "subroot"))
    subroots = scratch.save(blocks.where("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("subroot").alias("digest")))
    above = unpacked(climb(ranked(subroots, ["name"], scratch), scratch, height), height)
    above = above.select(F.col("name").alias("tree"), F.col("path").alias("last"), "root")
    whole = blocks.join(above, "tree").withColumn("path", F.concat("path", "last")).drop("last")
    lang = F.when(F.col("tree") != "", F.substring("tree", 2, 2**31 - 1)).alias("lang")
    return unpacked(whole, height).select("doc_id", lang, F.col("digest").alias("leaf"), "subroot", "root", "path", *[F.col(f"more_{k}").alias(k) for k in more])


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    other = lambda p: F.substring(p, 2, 64)
    pair = lambda a, p: F.when(p == "", a).when(F.substring(p, 1, 1) == "L", F.concat(other(p), a)).otherwise(F.concat(a, other(p)))
    return F.aggregate(path, leaf, lambda a, p: F.sha2(pair(a, p).cast("binary"), 256))


def proof_hash(path: Column) -> Column:
    """The hash of all siblings of a path."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.substring(p, 2, 64)), "").cast("binary"), 256)


def tampered() -> Column:
    """The leaf as it is where one in seven documents, by crc32 of its id, has one character more."""
    more = (F.col("n_chars").cast("decimal(38,0)") + 1).cast("decimal(38,0)")
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    return F.when(hit, leaf_of({"n_chars": more})).otherwise(leaf_of())
