"""Greedy leader clustering: every term joins the earliest leader that is like it, or leads.

A term is a leader exactly if no earlier leader is like it. For the bounded fuzzy case a fold over neighbour lists
decides; for any number of terms rounds do: a term whose earlier neighbours are all decided decides itself.
``fuzzy`` and ``vectors`` find the neighbours of any number of terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import ratio_at_least
from ..plans.checkpoints import cut
from .fuzzy import fuzzy_leaders
from .postings import counted, ids_text


def fuzzy_clusters(terms: DataFrame, threshold: int = 88, max_terms: int | None = 500) -> DataFrame:
    """terms (coluna, norm, pos) -> the same and leader, the place of its cluster's leader.

    Columns with more than ``max_terms`` terms are not clustered: each leads itself. So the lists that the fold
    handles are bounded. With None all columns are, whatever their number of terms.
    """
    if max_terms is None:
        return fuzzy_leaders(terms, threshold)
    counts = terms.groupBy("coluna").agg(F.count("*").alias("_n"))
    small = terms.join(counts.where(F.col("_n") <= max_terms).select("coluna"), "coluna", "left_semi").select("coluna", "norm", "pos")
    a, b = small.select("coluna", F.col("pos").alias("pos"), F.col("norm").alias("a")), small.select("coluna", F.col("pos").alias("p2"), F.col("norm").alias("b"))
    near = a.join(b, "coluna").where("p2 < pos").where(ratio_at_least("a", "b", threshold)).groupBy("coluna", "pos").agg(F.collect_list("p2").alias("nb"))
    listed = small.join(near, ["coluna", "pos"], "left").withColumn("nb", F.coalesce("nb", F.array().cast("array<bigint>")))
    fold = "aggregate(sort_array(collect_list(struct(cast(pos as bigint) as pos, nb))), cast(array() as array<bigint>), (ld, t) -> if(arrays_overlap(ld, t.nb), ld, concat(ld, array(t.pos))))"
    leaders = listed.groupBy("coluna").agg(F.expr(fold).alias("ld"))
    found = listed.join(leaders, "coluna").select("coluna", "pos", F.coalesce(F.array_min(F.array_intersect("ld", "nb")), F.col("pos")).alias("leader"))
    return terms.join(found, ["coluna", "pos"], "left").withColumn("leader", F.coalesce("leader", "pos"))


def cluster_table(groups: DataFrame, clusters: DataFrame, ids: DataFrame) -> DataFrame:
    """(coluna, termo_base, variantes, frequencia, leader): the longest member in capitals, originals, number of distinct ids.

    ``ids`` are the clusters' ``postings`` by coluna and leader. In order of frequency and first place within a column.
    """
    joined = groups.select("coluna", "norm", "pos", "originais").join(clusters.select("coluna", "pos", "leader"), ["coluna", "pos"])
    base = F.upper(F.max_by("norm", F.struct(F.length("norm"), -F.col("pos"))))
    out = joined.groupBy("coluna", "leader").agg(base.alias("termo_base"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("originais")))), "; ").alias("variantes"))
    out = out.join(counted(ids, ["coluna", "leader"]), ["coluna", "leader"]).orderBy("coluna", F.desc("frequencia"), "leader")
    return out.select("coluna", "termo_base", "variantes", "frequencia", "leader")


def with_ids(table: DataFrame, ids: DataFrame) -> DataFrame:
    """A cluster table as it is written: the ids of each cluster joined in one text, and no leader."""
    out = table.join(ids_text(ids, ["coluna", "leader"]), ["coluna", "leader"]).orderBy("coluna", F.desc("frequencia"), "leader")
    return out.select("coluna", "termo_base", "variantes", "frequencia", "ids")


def counted_cluster_table(groups: DataFrame, clusters: DataFrame) -> DataFrame:
    """(coluna, leader, termo_base, variantes, frequencia) of groups with row counts, in order of frequency and first place."""
    joined = groups.select("coluna", "norm", "pos", "originais", "n").join(clusters.select("coluna", "pos", "leader"), ["coluna", "pos"])
    base = F.upper(F.max_by("norm", F.struct(F.length("norm"), -F.col("pos"))))
    variants = F.array_sort(F.array_distinct(F.flatten(F.collect_list("originais"))))
    out = joined.groupBy("coluna", "leader").agg(base.alias("termo_base"), F.array_join(variants, "; ").alias("variantes"), F.sum("n").alias("frequencia"))
    return out.orderBy("coluna", F.desc("frequencia"), "leader").select("coluna", "leader", "termo_base", "variantes", "frequencia")


def leaders_by_rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (pos), edges (pos, earlier) -> (pos, leader), for any number of nodes.

    In each round the open nodes without an open earlier neighbour lead, and their open neighbours follow. Only open
    nodes and the edges between them stay in play; at the end each follower takes its earliest leader.
    """
    every = cut(edges.select("pos", "earlier").where("earlier < pos").distinct())
    open_, left, leaders = cut(nodes.select("pos").distinct()), every, None
    while not open_.isEmpty():
        lead = cut(open_.join(left.select("pos").distinct(), "pos", "left_anti"))
        leaders = lead if leaders is None else leaders.union(lead)
        follow = left.join(lead.withColumnRenamed("pos", "earlier"), "earlier", "left_semi").select("pos").distinct()
        gone = cut(lead.union(follow))
        open_ = cut(open_.join(gone, "pos", "left_anti"))
        left = cut(left.join(gone, "pos", "left_anti").join(gone.withColumnRenamed("pos", "earlier"), "earlier", "left_anti"))
    if leaders is None:
        return nodes.select("pos", F.col("pos").alias("leader"))
    of = every.join(leaders.withColumnRenamed("pos", "earlier"), "earlier", "left_semi").join(leaders, "pos", "left_anti")
    return leaders.select("pos", F.col("pos").alias("leader")).union(of.groupBy("pos").agg(F.min("earlier").alias("leader")))


def first_seen(df: DataFrame, value: str, order: str) -> DataFrame:
    return df.groupBy(value).agg(F.min(order).alias("pos"))
