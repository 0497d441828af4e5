"""What the operators share: reading tables, the shared folder, held-out rows, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these bytes (space and 0x09 to 0x0D).
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A session on one machine that names none gets one; a cluster must."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='termloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def remainder(column: str, modulus: int):
    """crc32 of the id as text, modulo; a null id has remainder -1 and so is never held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus, F.lit(-1))


#: Long texts make large Arrow batches: they end at this size unless the session's own settings say otherwise.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def bound_batches(spark: SparkSession) -> None:
    if spark.sparkContext.getConf().get(BATCH_BYTES[0]) is None:
        spark.conf.set(*BATCH_BYTES)


class Scratch:
    """Written intermediate tables: they cut lineage, survive lost executors and are dropped by name when done with."""

    def __init__(self, spark: SparkSession, name: str):
        bound_batches(spark)
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0

    def save(self, df: DataFrame, **options) -> DataFrame:
        path = f"{self.root}/{self.n}"
        self.n += 1
        df.write.parquet(path, **options)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in tables:
            path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
            path.getFileSystem(conf).delete(path, True)

    def release(self) -> None:
        """Let the context cleaner remove the shuffle files of finished phases: Python lets go first, then the JVM."""
        import gc
        import time

        for _ in range(2):
            gc.collect()
            time.sleep(0.2)
            self.spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


#: Edges that one task joins by itself; more are shared out.
EDGES = 500_000


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of one task -> (a, b), each of their nodes but the least of its component with that least."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    a, b = (np.concatenate([x.column(i).to_numpy() for x in parts]) for i in (0, 1))
    names, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    parent = list(range(len(names)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    root = np.array([find(x) for x in range(len(names))])
    low = np.flatnonzero(root != np.arange(len(names)))
    yield pa.RecordBatch.from_arrays([pa.array(names[low]), pa.array(names[root[low]])], ["a", "b"])


def connected(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long): component is the least node reachable.

    In each round tasks of about EDGES edges turn theirs into stars around the least nodes; where there is but one
    task, that is the answer. Else alternating large-star and small-star steps join the stars across tasks, until no
    edge changes. A hub only meets the minimum of its neighbours, pre-aggregated, never a list of them.
    """
    now = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    mark = None
    for _ in range(rounds):
        tasks = max(1, -(-now.count() // EDGES))
        local = now.repartition(tasks).mapInArrow(forest, "a long, b long")
        if tasks == 1:
            now = scratch.save(local)
            break
        now = scratch.save(local)
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        new = scratch.save(small)
        seen = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        now = new
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    pairs = now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return pairs.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
