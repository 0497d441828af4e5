"""The profile of a table: routing of its columns, then one job for each kind of statistic."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import counted_groups, counts_by_column, date_stats, keys_by_cluster, long_values, norm_groups, normalised, numeric_stats, placed, top_counts, top_values
from ..operators.cleaning import number_rows
from ..operators.clustering import cluster_table, counted_cluster_table, fuzzy_clusters
from ..operators.dictionary import detect_column_types
from ..operators.postings import postings
from ..operators.predicates import column_stats
from .checkpoints import cut

UNKNOWN = "desconhecido"


@dataclass
class Profile:
    key: str
    rows: int
    columns: int
    kinds: dict[str, str]  # column -> date, number or terms
    types: dict[str, str]
    dates: DataFrame | None
    numbers: DataFrame | None
    tables: DataFrame | None  # coluna, termo_base, variantes, frequencia, and leader with ids
    ids: DataFrame | None = None  # if they are wanted: postings by coluna and leader

    def header(self) -> dict:
        return {"id_coluna": self.key, "total_linhas": self.rows, "total_colunas": self.columns}


def clusters_of(df: DataFrame, columns: list[str], key: str, order: str, threshold: int = 88, max_terms: int | None = 500) -> tuple[DataFrame, DataFrame]:
    """(table, ids): the cluster tables of the columns, all in one plan keyed by column, and the clusters' ids as postings."""
    values = top_values(long_values(df, columns, key, order))
    groups = cut(placed(norm_groups(values)))
    clusters = cut(fuzzy_clusters(groups, threshold, max_terms))
    named = clusters.select("coluna", "norm", "leader")
    ids = cut(postings(normalised(values).select("coluna", "norm", "id").join(named, ["coluna", "norm"]), ["coluna", "leader"]))
    return cluster_table(groups, clusters, ids), ids


def counted_clusters_of(df: DataFrame, columns: list[str], key: str, order: str, unique: bool, threshold: int = 88, max_terms: int = 500) -> DataFrame:
    """The same without the ids: values are counted before anything else, so what goes on from there is a few hundred
    rows a column. Only where rows share keys, their distinct keys are counted by cluster in one more pass."""
    known = df.where(F.col(f"`{key}`").isNotNull())
    counts = cut(top_counts(counts_by_column(known, columns, order)))
    groups = cut(placed(counted_groups(counts)))
    clusters = cut(fuzzy_clusters(groups, threshold, max_terms))
    table = counted_cluster_table(groups, clusters)
    if unique:
        return table.drop("leader")
    named = normalised(counts).join(clusters.select("coluna", "norm", "leader"), ["coluna", "norm"]).select("coluna", "raw", "leader")
    return table.drop("frequencia").join(keys_by_cluster(known, key, named), ["coluna", "leader"]).orderBy("coluna", F.desc("frequencia"), "leader").drop("leader")


def profile(df: DataFrame, order: str | None = None, key: str | None = None, terms: DataFrame | None = None, progress=None, ids: bool = True) -> Profile:
    """Names and types route columns, with one row of counts; then dates, numbers and terms are one plan each.

    ``order`` names a column that orders the rows (the key by default). Without a key column, rows are numbered.
    An empty column has no table. With ``ids`` the clusters' ids are in ``ids``, in blocks; ``clustering.with_ids`` writes
    them into the tables. With ``progress`` the parts are computed at once, and it gets (columns done, columns) when
    those of a kind are. Without ``ids`` the
    tables of terms have none, and a key without repeats makes them cheap.
    """
    stats = {r["coluna"]: r for r in column_stats(df, exact=False).collect()}
    key = key or next((c for c, r in stats.items() if r["is_id"]), None)
    if key is None:
        if order is None:
            raise ValueError("without a key column, name a column that orders the rows")
        df, key = number_rows(df, [order]), "_id"
    order = order or key
    names = [c for c in df.columns if c != key and c in stats]
    kinds = {c: "date" if stats[c]["is_date"] else "number" if stats[c]["is_numeric"] and not stats[c]["is_categorical"] else "terms" for c in names}
    found = detect_column_types(df, terms)
    of = lambda kind: [c for c in names if kinds[c] == kind]
    out = Profile(key, next(iter(stats.values()))["n"], len(df.columns), kinds, {c: found.get(c) or UNKNOWN for c in names}, None, None, None)
    done = 0
    for kind in ("date", "number", "terms"):
        columns = of(kind)
        if columns and kind == "date":
            out.dates = date_stats(df, columns, order)
        elif columns and kind == "number":
            out.numbers = numeric_stats(df, columns)
        elif columns:
            unique = key not in stats or stats[key]["n_distinct"] == stats[key]["n"] - stats[key]["n_nulls"]
            if ids:
                out.tables, out.ids = clusters_of(df, columns, key, order)
            else:
                out.tables = counted_clusters_of(df, columns, key, order, unique)
        done += len(columns)
        if progress and columns:
            part = {"date": "dates", "number": "numbers", "terms": "tables"}[kind]
            setattr(out, part, cut(getattr(out, part)))
            progress(done, len(names))
    return out


def long_report(found: Profile, spark) -> DataFrame:
    """(coluna, tipo, kind, item, value): every part of a profile in one table."""
    parts = []
    if found.dates is not None:
        parts.append(found.dates.select("coluna", F.explode(F.create_map(F.lit("min"), "min", F.lit("max"), "max")).alias("item", "value")))
    if found.numbers is not None:
        text = lambda c: F.format_string("%.4f", F.col(c))
        parts.append(found.numbers.select("coluna", F.explode(F.create_map(F.lit("min"), text("min"), F.lit("max"), text("max"), F.lit("media"), text("media"))).alias("item", "value")))
    if found.tables is not None:
        parts.append(found.tables.select("coluna", F.col("termo_base").alias("item"), F.concat_ws("|", "variantes", F.col("frequencia").cast("string")).alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    kinds = spark.createDataFrame([(c, found.types[c], k) for c, k in found.kinds.items()], "coluna string, tipo string, kind string")
    return out.join(F.broadcast(kinds), "coluna").select("coluna", "tipo", "kind", "item", "value")
