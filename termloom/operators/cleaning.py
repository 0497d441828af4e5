"""Table shaping: empty rows and columns, names, cells, key columns, postal codes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_cell, format_cep, is_cep, py_str
from ..plans.checkpoints import cut


def drop_null_rows(df: DataFrame) -> DataFrame:
    some = [F.col(f"`{c}`").isNotNull() for c in df.columns]
    return df.where(reduce(lambda a, b: a | b, some)) if some else df


def null_columns(df: DataFrame) -> list[str]:
    """Names of columns without a value: one aggregation for all."""
    if not df.columns:
        return []
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(df.columns)]).first()
    return [c for c, n in zip(df.columns, counts, strict=True) if not n]


def drop_null_columns(df: DataFrame) -> DataFrame:
    return df.drop(*null_columns(df))


def trim_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def clean_cells(df: DataFrame, legacy_nulls: bool = False) -> DataFrame:
    """Text cells stripped and without control characters. ``legacy_nulls`` turns nulls into the text 'nan'."""
    names = text_columns(df)
    clean = {c: clean_cell(F.col(f"`{c}`")) for c in names}
    return df.withColumns({c: F.coalesce(e, F.lit("nan")) if legacy_nulls else e for c, e in clean.items()})


def ensure_id(df: DataFrame) -> DataFrame:
    """A first column ``id`` of random uuids unless one has exactly that name. Write or checkpoint it before reuse."""
    if "id" in df.columns:
        return df
    return df.select(F.uuid().alias("id"), "*")


def number_rows(df: DataFrame, order: list[str], name: str = "_id") -> DataFrame:
    """Texts "1" to "n" in the order given.

    Each partition of the sorted rows is numbered by itself and shifted by the rows before it, so no task holds all;
    the driver gets one count for each partition. The sorted rows are written first: counts and numbers are of the
    same partitions, however the sort is run.
    """
    placed = cut(df.sort(*order).withColumn("_part", F.spark_partition_id()).withColumn("_mono", F.monotonically_increasing_id()))
    counts = {r["_part"]: (r["n"], r["first"]) for r in placed.groupBy("_part").agg(F.count("*").alias("n"), F.min("_mono").alias("first")).collect()}
    before, shifts = 0, {}
    for part in sorted(counts):
        shifts[part] = before + 1 - counts[part][1]
        before += counts[part][0]
    if not shifts:
        return df.withColumn(name, F.lit(None).cast("string"))
    shift = F.element_at(F.create_map(*[x for p, s in shifts.items() for x in (F.lit(p), F.lit(s).cast("long"))]), F.col("_part"))
    return placed.withColumn(name, (F.col("_mono") + shift).cast("string")).drop("_part", "_mono")


def long_text(df: DataFrame, columns: list[str], order: str, keep: list[str] | None = None) -> DataFrame:
    """(coluna, _pos, v) of the columns, each value in Python's string form; nulls left out."""
    kinds = {f.name: f.dataType for f in df.schema}
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("coluna"), py_str(c, kinds[c]).alias("v")) for c in columns]))
    return df.select(F.col(f"`{order}`").alias("_pos"), *(keep or []), cells.alias("_c")).select("_c.coluna", "_pos", *(keep or []), "_c.v").where("v is not null")


def cep_columns(df: DataFrame, order: str, sample: int = 100, share: float = 0.8) -> DataFrame:
    """(coluna, n, hits, is_cep): how many of a column's first ``sample`` values have 7 or 8 digits."""
    values = long_text(df, df.columns, order)
    first = values.withColumn("rn", F.row_number().over(Window.partitionBy("coluna").orderBy("_pos"))).where(F.col("rn") <= sample)
    seen = first.groupBy("coluna").agg(F.count("*").alias("n"), F.count_if(is_cep(F.col("v"))).alias("hits"))
    names = df.sparkSession.createDataFrame([(c,) for c in df.columns], "coluna string")
    out = F.broadcast(names).join(seen, "coluna", "left").select("coluna", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))
    return out.withColumn("is_cep", F.col("hits") >= F.col("n") * share)


def normalize_cep(df: DataFrame, columns: list[str] | None = None, order: str | None = None) -> DataFrame:
    """The named columns, or those that ``cep_columns`` finds, as 8-digit texts."""
    if columns is None:
        columns = [r["coluna"] for r in cep_columns(df, order).where("is_cep").collect()]
    kinds = {f.name: f.dataType for f in df.schema}
    return df.withColumns({c: format_cep(py_str(c, kinds[c])) for c in columns})
