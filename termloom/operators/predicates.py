"""What a column is: key, number, category, date. Decided from names, types and one row of aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import ISO
from ..functions.text import py_str, unaccent
from ..plans.checkpoints import cut

# Names that make a column the key, and parts of names that make it a date.
ID_NAMES = ["id", "codigo", "identificacao", "code"]
DATE_WORDS = ["data", "date", "day", "dia"]


def is_numerical(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.BooleanType))


def is_date_name(name: str) -> bool:
    import unicodedata

    bare = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c)).lower()
    return any(w in bare for w in DATE_WORDS)


def date_name(name: Column) -> Column:
    """The same of names held in rows."""
    bare = F.lower(unaccent(name))
    return reduce(lambda a, b: a | b, [bare.contains(w) for w in DATE_WORDS])


#: Distinct values, by the estimate, up to which a column's are gathered and counted exactly in the same scan.
FEW = 400
#: Twenty times the estimate's standard error: what it leaves open beyond that, no table will show.
ERROR = 0.02


def distinct_counts(df: DataFrame, names: list[str], exact: bool) -> dict[str, int]:
    """Distinct values of each column: estimates in one scan, then exact where a decision hangs on them, or for all.

    Columns with few values are counted exactly by sets of a bounded size, all in one more scan; the others that may be
    keys, by their estimate, go through ``exact_counts`` together.
    """
    column = {c: F.col(f"`{c}`") for c in names}
    got = df.agg(F.count("*").alias("n"), *[f(column[c]).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("c", F.count), ("d", lambda x: F.approx_count_distinct(x, ERROR)))]).first()
    out = {c: got[f"d{i}"] for i, c in enumerate(names)}
    few = [c for c in names if out[c] <= FEW]
    if few:
        sizes = df.agg(*[F.size(F.collect_set(column[c])).alias(f"s{i}") for i, c in enumerate(few)]).first()
        out |= {c: sizes[i] for i, c in enumerate(few)}
    close = lambda i, c: out[c] >= (1 - 20 * ERROR) * (got["n"] - 1) and got[f"c{i}"] >= got["n"] - 1
    rest = {c: got[f"c{i}"] for i, c in enumerate(names) if c not in few and (exact or close(i, c))}
    if not exact and rest:  # a column that repeats a value is no key: then any number below its rows will do
        out |= {c: min(out[c], rest.pop(c) - 1) for c in repeats(df, list(rest), got["n"])}
    return out | exact_counts(df, list(rest), exact)


#: Rows in which repeats are looked for first, about.
SLICE = 1 << 18


def cells_of(df: DataFrame, names: list[str]) -> list[Column]:
    """(i, h, v) of each column: its number, its value's hash and text."""
    kinds = {f.name: f.dataType for f in df.schema}
    as_text = lambda c: F.base64(F.col(f"`{c}`")) if isinstance(kinds[c], T.BinaryType) else F.col(f"`{c}`").cast("string")
    return [F.struct(F.lit(i).alias("i"), F.xxhash64(F.col(f"`{c}`")).alias("h"), as_text(c).alias("v")) for i, c in enumerate(names)]


def repeats(df: DataFrame, names: list[str], rows: int) -> list[str]:
    """Columns that surely repeat a value: all rows are read, those with values of some hashes are compared. A column that
    is not named may repeat values too; only ``exact_counts`` tells."""
    part = F.filter(F.array(*cells_of(df, names)), lambda x: x["v"].isNotNull() & (F.pmod(x["h"], F.lit(1 + rows // SLICE)) == 0))
    seen = df.select(F.explode(part).alias("x")).select("x.*").groupBy("i", "h", "v").agg(F.count("*").alias("n")).where("n > 1")
    return [names[r["i"]] for r in seen.select("i").distinct().collect()]  # a row a column


def exact_counts(df: DataFrame, names: list[str], whole: bool = True) -> dict[str, int]:
    """Exact distinct values of many columns with one shuffle of hashes, whatever their number.

    Every value becomes its 64-bit hash, a row for each column. A hash seen once is one value. Only the rows whose hash
    was seen again are looked at once more, as values: a key has next to none, and where copies abound they are counted
    before they are shuffled. Without ``whole`` a column with a repeated value counts its different hashes, fewer than
    its rows, and nothing more is looked at.
    """
    if not names:
        return {}
    floats = [f.name for f in df.schema if f.name in names and isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    df = df.withColumns({c: F.col(f"`{c}`") + F.lit(0.0).cast(df.schema[c].dataType) for c in floats})  # the two zeros are one value
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.when(F.col(f"`{c}`").isNotNull(), F.xxhash64(F.col(f"`{c}`"))).alias("h")) for i, c in enumerate(names)])).alias("x")
    seen = df.select(cells).select("x.*").where("h is not null").groupBy("i", "h").agg(F.count("*").alias("n"))
    seen = cut(seen) if whole else seen
    many = F.col("n") > 1
    found = {r["i"]: r for r in seen.groupBy("i").agg(F.count_if(~many).alias("once"), F.count_if(many).alias("again"), F.min(F.when(many, F.col("h"))).alias("h")).collect()}  # a row a column
    out = {c: found[i]["once"] if i in found else 0 for i, c in enumerate(names)}
    repeated = [i for i in found if found[i]["again"]]
    if not repeated:
        return out
    hashed = cells_of(df, names).__getitem__
    if not whole:  # one hash a column that was seen again: rows of the same value settle that it is no key
        cells = F.explode(F.filter(F.array(*[hashed(i) for i in repeated]), lambda x: F.array_contains(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(found[i]["h"]).cast("long").alias("h")) for i in repeated]), F.struct(x["i"].alias("i"), x["h"].alias("h")))))
        rows = df.select(cells.alias("x")).select("x.*").where("v is not null").groupBy("i", "v").agg(F.count("*").alias("n")).groupBy("i").agg(F.max("n").alias("n")).collect()
        sure = {r["i"] for r in rows if r["n"] > 1}
        out |= {names[i]: out[names[i]] + found[i]["again"] for i in sure}
        rest = [names[i] for i in repeated if i not in sure]
        return out | exact_counts(df, rest) if rest else out
    values = F.explode(F.array(*[hashed(i) for i in repeated])).alias("x")
    both = df.select(values).select("x.*").where("v is not null").join(seen.where(many).select("i", "h"), ["i", "h"], "left_semi")
    for r in both.groupBy("i", "v").agg(F.lit(1).alias("one")).groupBy("i").agg(F.count("*").alias("n")).collect():  # a row a column
        out[names[r["i"]]] += r["n"]
    return out


def column_stats(df: DataFrame, exact: bool = True) -> DataFrame:
    """One row for each column: n, n_nulls, n_distinct, is_id, is_numeric, is_categorical, is_date.

    A column is a key by name, or if no value repeats (two nulls do). A number is categorical with fewer distinct
    values than min(30, rows / 5). Without ``exact``, n_distinct is an estimate where nothing hangs on it. An empty
    table has no distinct values, and every column of it is a key.
    """
    columns = [f for f in df.schema if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType))]
    distinct = distinct_counts(df, [f.name for f in columns], exact)
    aggs = [F.count("*").alias("n")] + [F.count(F.col(f"`{f.name}`")).alias(f"c{i}") for i, f in enumerate(columns)]
    rows = [F.struct(F.lit(i).alias("ordinal"), F.lit(f.name).alias("coluna"), F.col("n"), (F.col("n") - F.col(f"c{i}")).alias("n_nulls"), F.lit(distinct[f.name]).cast("long").alias("n_distinct"), F.lit(is_numerical(f.dataType)).alias("is_numeric"), F.lit(is_date_name(f.name)).alias("is_date")) for i, f in enumerate(columns)]
    long = df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    unique = (F.col("n_nulls") <= 1) & (F.col("n_distinct") + F.col("n_nulls") == F.col("n"))
    named = F.lower("coluna").isin(*ID_NAMES)
    few = F.col("n_distinct") < F.least(F.lit(30), F.floor(F.col("n") / 5))
    return long.withColumns({"is_id": named | unique, "is_categorical": F.col("is_numeric") & few})


def first_id(df: DataFrame) -> str | None:
    found = column_stats(df).where("is_id").orderBy("ordinal").first()
    return found["coluna"] if found else None


def first_value(df: DataFrame, column: str, order: str) -> str | None:
    """The first value that is not null, as text."""
    kinds = {f.name: f.dataType for f in df.schema}
    row = df.select(py_str(column, kinds[column]).alias("v"), F.col(f"`{order}`").alias("o")).where("v is not null").orderBy("o").first()
    return row["v"] if row else None


def all_iso(df: DataFrame, column: str, order: str, sample: int = 50) -> DataFrame:
    """One row, ``all_iso``: whether the first values all begin like an ISO date; true without values."""
    kinds = {f.name: f.dataType for f in df.schema}
    first = df.select(py_str(column, kinds[column]).alias("v"), F.col(f"`{order}`").alias("o")).where("v is not null").orderBy("o").limit(sample)
    return first.agg(F.coalesce(F.bool_and(F.col("v").rlike(ISO)), F.lit(True)).alias("all_iso"))
