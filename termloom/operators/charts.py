"""Chart-ready tables over cluster or value tables: what a bar, pie, line, scatter or box chart shows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of label and value columns, in order of preference, and how many rows charts show.
LABELS, VALUES = ["termo_base", "termo"], ["valor", "valor_medio", "media"]
BAR, PIE, LINE, SCATTER = 8, 5, 8, 30


def label_column(df: DataFrame) -> str | None:
    return next((c for c in LABELS if c in df.columns), None)


def value_column(df: DataFrame) -> str | None:
    return next((c for c in VALUES if c in df.columns), None)


def head(df: DataFrame, n: int, order: list, shown: list[str], place: list[str] | None = None) -> DataFrame:
    """The first n rows in an order: a top-k of each partition, then of those. Where the order leaves open which rows
    these are, it does not hang on how rows lie in tasks: the values that the chart shows decide, or, where ``place``
    names columns that tell where a row stands in its table, one reading of the table from front to back. There, of
    n rows and more a row like the last one finds no place, and a row before it puts it out, of equals the one read first.
    """
    if not place:
        return df.orderBy(*order, *[F.col(f"`{c}`") for c in shown]).limit(n)
    first = df.orderBy(*order, *place).limit(2 * n - 1)  # fewer than n before the ties at the last place, and n of these
    first = first.withColumn("_rank", F.rank().over(Window.orderBy(*order))).where(F.col("_rank") <= n)
    return first.withColumn("_read", F.row_number().over(Window.orderBy(*place))).orderBy(*order, F.col("_read") > n, F.desc("_read")).limit(n)


def bar(df: DataFrame, order: list) -> DataFrame | None:
    """None, no chart, for a table without a label column."""
    label = label_column(df)
    if label is None:
        return None
    return head(df, BAR, order, [label, "frequencia"]).select(F.col(label).alias("label"), "frequencia")


def pie_sum(df: DataFrame, label: str, value: str = "frequencia") -> DataFrame:
    return df.groupBy(F.col(label).alias("label")).agg(F.sum(value).alias("value")).orderBy(F.desc("value"), "label").limit(PIE)


def pie_mean(df: DataFrame, label: str, value: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label")).agg(F.avg(value).alias("value")).orderBy(F.desc("value"), "label").limit(PIE)


def line(df: DataFrame, label: str, value: str, order: list, place: list[str] | None = None) -> DataFrame:
    return head(df, LINE, order, [label, value], place).select(F.col(label).alias("label"), F.col(value).alias("value"))


def scatter(df: DataFrame, label: str, order: list, place: list[str] | None = None) -> DataFrame:
    """The first two numeric columns, coloured by label; needs two."""
    numbers = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)][:2]
    if len(numbers) < 2:
        raise ValueError("a scatter chart needs two numeric columns")
    return head(df, SCATTER, order, [label, *numbers], place).select(F.col(label).alias("label"), F.col(numbers[0]).alias("x"), F.col(numbers[1]).alias("y"))


def remainder(df: DataFrame, shown: int = 8) -> DataFrame:
    return df.agg(F.greatest(F.count("*") - shown, F.lit(0)).alias("more"))
