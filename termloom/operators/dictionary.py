"""Semantic column types: the first entry of an ordered dictionary with a synonym that the name begins with."""

from __future__ import annotations

import csv
from functools import cache
from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip, unaccent

# The whole vocabulary, in the order that decides.
VOCABULARY = resources.files(__package__) / "domain_terms.csv"


@cache
def domain_terms() -> dict[str, list[str]]:
    """The whole domain vocabulary in its order of priority; a key given twice has its first place and its last value."""
    out: dict[str, list[str]] = {}
    for row in csv.DictReader(VOCABULARY.read_text(encoding="utf-8").splitlines()):
        out.setdefault(row["tipo"], []).append(row["synonym"])
    return out


def dictionary(spark: SparkSession, terms: dict[str, list[str]] | None = None) -> DataFrame:
    """(prio, tipo, syn_prio, synonym), synonyms folded once. The mapping's order is the order of priority; without one, the whole vocabulary."""
    rows = [(i, t, j, s) for i, (t, many) in enumerate((domain_terms() if terms is None else terms).items()) for j, s in enumerate(many)]
    return folded(spark.createDataFrame(rows, "prio int, tipo string, syn_prio int, synonym string"))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """The same from a CSV with the columns prio, tipo, syn_prio, synonym."""
    return folded(spark.read.option("header", True).schema("prio int, tipo string, syn_prio int, synonym string").csv(path))


def folded(terms: DataFrame) -> DataFrame:
    return terms.withColumn("syn", strip(F.lower(unaccent(F.col("synonym")))))


def column_types(names: DataFrame, terms: DataFrame) -> DataFrame:
    """names (coluna) -> (coluna, tipo), null where no synonym is a prefix. Names may be as many as rows hold.

    Every prefix of a name, up to the longest synonym, is looked up as it is; of those found the first entry counts.
    """
    known = terms.groupBy("syn").agg(F.min(F.struct("prio", "syn_prio", "tipo")).alias("entry"))
    longest = terms.agg(F.max(F.length("syn"))).first()[0] or 0
    keyed = names.select("coluna").distinct().withColumn("_n", strip(F.lower(unaccent(F.col("coluna")))))
    prefixes = F.transform(F.sequence(F.lit(0), F.least(F.length("_n"), F.lit(longest))), lambda i: F.substring("_n", F.lit(1), i))
    first = keyed.select("coluna", F.explode(prefixes).alias("syn")).join(known, "syn").groupBy("coluna").agg(F.min("entry")["tipo"].alias("tipo"))
    return keyed.join(first, "coluna", "left").select("coluna", "tipo")


def detect_column_types(df: DataFrame, terms: DataFrame | None = None) -> dict[str, str | None]:
    spark = df.sparkSession
    names = spark.createDataFrame([(c,) for c in df.columns], "coluna string")
    return {r["coluna"]: r["tipo"] for r in column_types(names, terms if terms is not None else dictionary(spark)).collect()}
