"""Writing reports: summary JSON, one CSV folder by column, statistics text, console and HTTP."""

from __future__ import annotations

import json
import urllib.request

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import slugify
from ..operators.clustering import with_ids

SHOWN = 12


def report_json(table: DataFrame) -> DataFrame:
    """(coluna, tabela): each column's table as a JSON array of records, most frequent first."""
    row = F.struct((-F.col("frequencia")).alias("o"), "termo_base", "variantes", "frequencia", "ids")
    listed = F.sort_array(F.collect_list(row))
    records = F.transform(listed, lambda r: F.struct(r["termo_base"].alias("termo_base"), r["variantes"].alias("variantes"), r["frequencia"].alias("frequencia"), r["ids"].alias("ids")))
    return table.groupBy("coluna").agg(F.to_json(records).alias("tabela"))


def write_header(header: DataFrame, path: str) -> None:
    """The one row of a report's header as one JSON file, indented, nulls included."""
    row = header.first()
    spark, text = header.sparkSession, json.dumps(row.asDict() if row else {}, ensure_ascii=False, indent=2)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_tables(table: DataFrame, path: str, ids: DataFrame | None = None) -> None:
    """A folder for each column, named by its slug. ``ids``, a profile's postings, are written as a text beside each cluster."""
    table = with_ids(table, ids) if ids is not None else table
    table.withColumn("slug", slugify(F.col("coluna"))).write.mode("overwrite").partitionBy("slug").option("header", True).csv(path)


def write_stats(stats: DataFrame, path: str) -> None:
    """(coluna, estatisticas map) as 'key: value' lines, a folder for each column."""
    lines = stats.withColumn("slug", slugify(F.col("coluna"))).select("slug", F.explode("estatisticas").alias("k", "v"))
    lines.select("slug", F.concat_ws(": ", "k", "v").alias("value")).write.mode("overwrite").partitionBy("slug").text(path)


def shown_columns(names: list[str]) -> list[str]:
    if "termo_base" in names and "variantes" in names:
        return ["termo_base", "variantes", "frequencia"]
    return ["termo", "frequencia"] if "termo" in names else names[:3]


def show(table: DataFrame) -> str:
    """The first rows of a table as text: the most frequent, taken on the executors, or without frequencies as they come."""
    table = table.orderBy(F.desc("frequencia"), table.columns[0]) if "frequencia" in table.columns else table
    shown = [c for c in shown_columns(table.columns) if c in table.columns]
    return table.limit(SHOWN).select(*shown).toPandas().to_string(index=False)


def show_stats(stats: dict) -> str:
    """Statistics as lines, or that there are none."""
    return "\n".join(["• Estatísticas:", *(f"   - {k:<8}: {v}" for k, v in stats.items())]) if stats else "Sem dados agrupados nem estatísticas."


def push(report: dict, url: str, timeout: float = 5.0) -> int:
    """Posts a report; errors are raised, not swallowed."""
    body = json.dumps(report, ensure_ascii=False).encode()
    request = urllib.request.Request(url, body, {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return answer.status
