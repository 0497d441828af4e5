"""Column statistics, value counts and groups of normalised values."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import to_date
from ..functions.text import normalize_generic, py_str, py_text, strip
from .predicates import all_iso, first_value
from .quantiles import quantiles


def date_stats(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """(coluna, min, max) as text; 'NaT' for a column without a readable date. Numbers are nanoseconds since 1970."""
    kinds = {f.name: f.dataType for f in df.schema}
    aggs = []
    for i, c in enumerate(columns):
        kind, v = kinds[c], F.col(f"`{c}`")
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            when = v.cast("timestamp_ntz")
        elif isinstance(kind, T.NumericType):
            when = F.timestamp_micros((v / 1000).cast("long")).cast("timestamp_ntz")
        else:
            when = to_date(v.cast("string"), all_iso(df, c, order).first()["all_iso"], first=first_value(df, c, order)).cast("timestamp_ntz")
        aggs += [F.min(when).alias(f"lo{i}"), F.max(when).alias(f"hi{i}")]
    text = lambda x: F.coalesce(F.date_format(x, "yyyy-MM-dd HH:mm:ss"), F.lit("NaT"))
    rows = [F.struct(F.lit(c).alias("coluna"), text(f"lo{i}").alias("min"), text(f"hi{i}").alias("max")) for i, c in enumerate(columns)]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def numeric_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(coluna, min, max, media) in double; null, not NaN, for a column without values. One aggregation."""
    aggs = [f(F.col(f"`{c}`").cast("double")).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max), ("m", F.avg))]
    rows = [F.struct(F.lit(c).alias("coluna"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"), F.col(f"m{i}").alias("media")) for i, c in enumerate(columns)]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def quartiles(df: DataFrame, by: str, column: str) -> DataFrame:
    """(label, lo, q1, median, q3, hi): exact, with a bounded state for any number of different values."""
    out = quantiles(df, by, column, [0.0, 0.25, 0.5, 0.75, 1.0])
    return out.select("label", *[F.col("q")[i].alias(n) for i, n in enumerate(["lo", "q1", "median", "q3", "hi"])])


def long_values(df: DataFrame, columns: list[str], key: str, order: str) -> DataFrame:
    """(coluna, _pos, id, v) with v and id not null, in Python's string form."""
    kinds = {f.name: f.dataType for f in df.schema}
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("coluna"), py_str(c, kinds[c]).alias("v")) for c in columns])).alias("c")
    return df.select(F.col(f"`{order}`").alias("_pos"), py_str(key, kinds[key]).alias("id"), cells).select("c.coluna", "_pos", "id", "c.v").where("v is not null and id is not null")


def value_counts(values: DataFrame) -> DataFrame:
    """(coluna, v, n, first) from long values; first: the least place, which orders equal counts."""
    return values.groupBy("coluna", "v").agg(F.count("*").alias("n"), F.min("_pos").alias("first"))


def zero(v: Column, kind: T.DataType) -> Column:
    """The text of a floating zero, null for all else: as keys of groups and joins the two zeros are one."""
    return F.when(v == 0, v.cast("string")) if isinstance(kind, (T.FloatType, T.DoubleType)) else F.lit(None).cast("string")


def counts_by_column(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """The same for whole columns of a table, and raw, the value's own text: columns of a type go together, values are
    counted as they are and only then written."""
    kinds, parts = {f.name: f.dataType for f in df.schema}, []
    for kind in dict.fromkeys(kinds[c] for c in columns):
        of = [c for c in columns if kinds[c] == kind]
        v = F.col("c.v") if isinstance(kind, NATIVE) else F.col("c.v").cast("string")
        cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").alias("v")) for i, c in enumerate(of)])).alias("c")
        found = df.select(F.col(f"`{order}`").alias("_pos"), cells).select("c.i", v.alias("v"), "_pos").where("v is not null").groupBy("i", "v", zero(F.col("v"), kind).alias("z")).agg(F.count("*").alias("n"), F.min("_pos").alias("first"))
        raw = F.coalesce("z", F.col("v").cast("string"))
        found = found.select(F.get(F.array(*[F.lit(c) for c in of]), F.col("i")).alias("coluna"), raw.alias("raw"), "n", "first")
        parts.append(found.withColumn("v", py_text(F.col("raw").cast(kind), kind)))
    return reduce(DataFrame.union, parts).groupBy("coluna", "v", "raw").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


#: Types whose values are counted and joined as they are; others are by their text.
NATIVE = (T.IntegralType, T.FractionalType, T.StringType, T.BooleanType, T.DateType)
#: Clusters are bits of words when keys are counted: bits of a word, and words that go through one shuffle.
BITS, WORDS = 63, 8


def keys_by_cluster(df: DataFrame, key: str, named: DataFrame) -> DataFrame:
    """named (coluna, raw, leader), some hundred rows a column -> (coluna, leader, frequencia): the distinct keys of each
    cluster's rows. The clusters of a row are bits, or-ed by key: a row for each of the table's is shuffled, not one for
    each of its cells (once for each BITS * WORDS clusters)."""
    found = named.select("coluna", "raw", "leader").distinct().orderBy("coluna", "leader", "raw").collect()
    spark, kinds = df.sparkSession, {f.name: f.dataType for f in df.schema}
    number: dict[tuple, int] = {}
    for r in found:
        number.setdefault((r["coluna"], r["leader"]), len(number))
    parts = []
    for start in range(0, len(number), BITS * WORDS):
        here = {k: n - start for k, n in number.items() if start <= n < start + BITS * WORDS}
        words, tables = -(-len(here) // BITS), {}
        for r in found:
            if (r["coluna"], r["leader"]) in here:
                n = here[r["coluna"], r["leader"]]
                tables.setdefault(r["coluna"], []).append((r["raw"], n // BITS, 1 << n % BITS))
        rows = df.select(F.col(f"`{key}`").alias("id"), *[(F.col(f"`{c}`") if isinstance(kinds[c], NATIVE) else F.col(f"`{c}`").cast("string")).alias(f"v{i}") for i, c in enumerate(tables)])
        for i, (c, held) in enumerate(tables.items()):
            kind = rows.schema[f"v{i}"].dataType
            table = spark.createDataFrame(held, "raw string, word int, bit long")
            table = table.select(F.col("raw").cast(kind).alias(f"k{i}"), zero(F.col("raw").cast(kind), kind).alias(f"z{i}"), F.col("word").alias(f"w{i}"), F.col("bit").alias(f"b{i}"))
            rows = rows.join(F.broadcast(table), (F.col(f"v{i}") == F.col(f"k{i}")) & zero(F.col(f"v{i}"), kind).eqNullSafe(F.col(f"z{i}")), "left")
        bits = lambda w: reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.col(f"w{i}") == w, F.col(f"b{i}")).otherwise(F.lit(0).cast("long")) for i in range(len(tables))])
        keys = rows.select("id", *[bits(w).alias(f"bits{w}") for w in range(words)]).groupBy("id").agg(*[F.bit_or(f"bits{w}").alias(f"bits{w}") for w in range(words)])

        def count(batches: Iterator[pa.RecordBatch], words=words, start=start) -> Iterator[pa.RecordBatch]:
            many = np.zeros((words, 64), np.int64)
            for batch in batches:
                for w in range(words):
                    many[w] += np.unpackbits(batch.column(w).to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            n = many[:, :BITS].ravel()
            yield pa.RecordBatch.from_arrays([pa.array(start + np.arange(len(n)), pa.int64()), pa.array(n)], ["number", "n"])

        parts.append(keys.drop("id").mapInArrow(count, "number long, n long"))
    names = spark.createDataFrame([(c, leader, n) for (c, leader), n in number.items()], "coluna string, leader long, number long")
    if not parts:
        return names.select("coluna", "leader", F.col("number").alias("frequencia"))
    sums = reduce(DataFrame.union, parts).groupBy("number").agg(F.sum("n").alias("frequencia"))
    return sums.join(F.broadcast(names), "number").select("coluna", "leader", "frequencia")


def top_counts(counts: DataFrame, most: int = 200, keep: int = 100) -> DataFrame:
    """Of value counts, those of columns with up to ``most`` distinct values, and the ``keep`` commonest of the others."""
    rank = F.row_number().over(Window.partitionBy("coluna").orderBy(F.desc("n"), "first", "v"))
    # Ranks stop at most + 1: that tells whether a column has more, and the window never keeps a longer list.
    ranked = counts.withColumn("rn", rank).where(F.col("rn") <= most + 1)
    over = ranked.groupBy("coluna").agg((F.max("rn") > most).alias("over"))
    return ranked.join(F.broadcast(over), "coluna").where(~F.col("over") | (F.col("rn") <= keep)).drop("rn", "over")


def top_values(values: DataFrame, most: int = 200, keep: int = 100) -> DataFrame:
    """The rows of columns with up to ``most`` distinct values, and of the ``keep`` commonest values of the others."""
    return values.join(top_counts(value_counts(values), most, keep).select("coluna", "v"), ["coluna", "v"], "left_semi")


def normalised(values: DataFrame) -> DataFrame:
    trimmed = values.withColumn("orig", strip(F.col("v")))
    return trimmed.withColumn("norm", normalize_generic(F.col("orig")))


def placed(groups: DataFrame) -> DataFrame:
    """pos as a number of its own for each group, by first place and value, so that groups with one first place stay
    apart. For columns cut to their commonest values, a few hundred rows each."""
    rank = F.row_number().over(Window.partitionBy("coluna").orderBy("pos", "norm")) - 1
    return groups.withColumn("pos", rank.cast("long"))


def counted_groups(counts: DataFrame) -> DataFrame:
    """(coluna, norm, pos, originais, n): each normalised value's originals, first place and rows, from value counts."""
    return normalised(counts).groupBy("coluna", "norm").agg(F.min("first").alias("pos"), F.sort_array(F.collect_set("orig")).alias("originais"), F.sum("n").alias("n"))


def norm_groups(values: DataFrame) -> DataFrame:
    """(coluna, norm, pos, originais): each normalised value's originals and first place. Its ids are ``postings``."""
    return normalised(values).groupBy("coluna", "norm").agg(F.min("_pos").alias("pos"), F.sort_array(F.collect_set("orig")).alias("originais"))
