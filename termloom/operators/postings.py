"""Posting lists: the ids of a key in sorted blocks of a bounded size, however many they are and however hot the key is."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.checkpoints import cut

#: Ids in a block at most.
BLOCK = 1024


def postings(rows: DataFrame, keys: list[str], name: str = "id", block: int = BLOCK) -> DataFrame:
    """rows (keys, id) -> keys, block, n, first, ids: each key's distinct ids, sorted, in blocks of ``block`` at most.

    Whole numbers are held as their distance from the block's first. Blocks of a key follow each other in order of
    ``block``. Rows are sorted by range over keys and ids together, so a key's ids lie in as many tasks as they need,
    and a task only looks at where keys change. Rows without an id are left out; a null key is one like any other.
    """
    kind = rows.schema[name].dataType
    whole = isinstance(kind, T.IntegralType)
    by = [*keys, name]
    held = cut(rows.where(F.col(name).isNotNull()).select(*by))  # what range bounds are sampled from is what is sorted
    fields = [*[held.schema[k] for k in keys], T.StructField("block", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("first", kind), T.StructField("ids", T.ArrayType(T.LongType() if whole else kind))]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, last = TaskContext.get().partitionId() << 33, None
        for batch in batches:
            if not batch.num_rows:
                continue
            # Where a row is not the one before it, and where its keys are not: the batch before ends in ``last``.
            joined = pa.Table.from_batches([batch.slice(0, 1) if last is None else last, batch]).combine_chunks()
            new = [changes(joined.column(c).chunk(0)) for c in by]
            keep, start = np.logical_or.reduce(new), np.logical_or.reduce(new[:-1]) if keys else np.zeros(batch.num_rows, bool)
            if last is None:
                keep[0] = start[0] = True
            last = batch.slice(batch.num_rows - 1, 1)
            at = np.flatnonzero(keep)
            if not len(at):
                continue
            rows = batch.take(pa.array(at))
            heads = np.flatnonzero(start[at] | (np.arange(len(at)) == 0))
            cuts = np.unique(np.concatenate([np.arange(a, z, block) for a, z in zip(heads, [*heads[1:], len(at)], strict=True)] + [[len(at)]]))
            first, ids = rows.column(len(keys)).take(pa.array(cuts[:-1])), rows.column(len(keys))
            if whole:
                values = ids.cast(pa.int64()).to_numpy()
                ids = pa.array(values - np.repeat(values[cuts[:-1]], np.diff(cuts)))
            heads = rows.take(pa.array(cuts[:-1]))
            columns = [*heads.columns[: len(keys)], pa.array(number + np.arange(len(cuts) - 1)), pa.array(np.diff(cuts), pa.int32()), first, pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), ids)]
            number += len(cuts) - 1
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return held.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(blocks, T.StructType(fields))


def changes(values: pa.Array) -> np.ndarray:
    """Whether each value but the first is another than the one before it; nulls are equal."""
    a, b = values.slice(0, len(values) - 1), values.slice(1)
    same = pc.fill_null(pc.equal(a, b), False)
    return ~np.asarray(pc.or_(same, pc.and_(pc.is_null(a), pc.is_null(b))))


def ids_of(blocks: DataFrame) -> Column:
    """The ids of a block as they were."""
    kind = blocks.schema["first"].dataType
    return F.transform("ids", lambda x: (F.col("first") + x).cast(kind)) if isinstance(kind, T.IntegralType) else F.col("ids")


def counted(blocks: DataFrame, keys: list[str], name: str = "frequencia") -> DataFrame:
    """(keys, number of ids)."""
    return blocks.groupBy(*keys).agg(F.sum("n").alias(name))


def ids_text(blocks: DataFrame, keys: list[str], name: str = "ids", by_text: bool = False) -> DataFrame:
    """(keys, ids as one text), for a sink that wants a cell: here a key's ids come together. In their own order, or as texts are sorted."""
    listed = blocks.select(*keys, F.struct("block", F.transform(ids_of(blocks), lambda x: x.cast("string")).alias("t")).alias("b")).groupBy(*keys).agg(F.sort_array(F.collect_list("b")).alias("b"))
    flat = F.flatten(F.transform("b", lambda x: x["t"]))
    return listed.select(*keys, F.array_join(F.array_sort(flat) if by_text else flat, ",").alias(name))
