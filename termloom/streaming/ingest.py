"""Incremental reading: files as micro-batches with running counts, and the latest result as a view."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.progress import streaming


def read_files(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet", files: int = 1, **options) -> DataFrame:
    """A folder's files as a stream, ``files`` at a time; a single file is a stream of one."""
    stream = spark.readStream.format(kind).schema(schema).options(maxFilesPerTrigger=files, **options)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return stream.load(path)
    folder, _, name = path.rpartition("/")
    return stream.option("pathGlobFilter", name).load(folder)


def running_counts(stream: DataFrame, by: str, place: str, progress: Callable[[int], None] | None = None) -> DataFrame:
    """Runs the stream to its end and returns (by, n). ``progress`` gets the rows so far as the stream reports each batch.

    Each batch writes its own pre-aggregated counts under its number, so a batch that runs again replaces them; the
    total adds the batches up.
    """
    spark = stream.sparkSession

    def add(batch: DataFrame, number: int) -> None:
        batch.groupBy(by).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{place}/counts/batch={number}")

    with streaming(spark, progress) as follow:
        query = stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{place}/progress").trigger(availableNow=True).start()
        follow(query)
        query.awaitTermination()
    return spark.read.schema(T.StructType([stream.schema[by], T.StructField("n", T.LongType()), T.StructField("batch", T.LongType())])).parquet(f"{place}/counts").groupBy(by).agg(F.sum("n").alias("n"))


#: Versions that stay, so that a reader that has just looked up one can read it to its end.
KEPT = 3


def file_context(spark: SparkSession, place: str):
    """(files, path of a name below the place) in whatever store the place names."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(place)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    root = root.getFileSystem(conf).makeQualified(root)
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(root.toUri(), conf), lambda name: jvm.org.apache.hadoop.fs.Path(root, name)


def publish(df: DataFrame, place: str) -> str:
    """Writes ``df`` as the latest result below a place that sessions share; the new version's name.

    A version is written whole under a name of its own; then a pointer to it takes the old pointer's place in one
    rename. Readers see the old result or the new one, a failed write leaves the old one. The last KEPT versions stay.
    """
    spark = df.sparkSession
    version = f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(f"{place}/{version}")
    files, path = file_context(spark, place)
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    flags = jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE)
    made = path(f"_{version}")
    out = files.create(made, flags, gateway.new_array(jvm.org.apache.hadoop.fs.Options.CreateOpts, 0))
    out.write(bytearray(version.encode()))
    out.close()
    swap = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    swap[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(made, path("_latest"), swap)
    names = sorted(s.getPath().getName() for s in files.util().listStatus(path(".")) if s.getPath().getName().startswith("v"))
    for old in [n for n in names if n != version][: -(KEPT - 1)]:
        files.delete(path(old), True)
    return version


def latest(spark: SparkSession, place: str) -> DataFrame | None:
    """The latest result that any session has published there, or None while there is none."""
    files, path = file_context(spark, place)
    if not files.util().exists(path("_latest")):
        return None
    stream = files.open(path("_latest"))
    try:
        version = bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()
    return spark.read.parquet(f"{place}/{version}")
