"""Similarities as Column expressions: Indel ratio by longest common subsequence, cosine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs(a: str, b: str) -> Column:
    """Length of the longest common subsequence of two string columns: one row of the table at a time."""
    row = f"aggregate(sequence(1, length({b})), array(0), (acc, j) -> concat(acc, array(case when ch = substring({b}, j, 1) then prev[j - 1] + 1 else greatest(prev[j], acc[j - 1]) end)))"
    return F.expr(f"case when length({a}) = 0 or length({b}) = 0 then 0 else aggregate(filter(split({a}, ''), c -> c <> ''), array_repeat(0, length({b}) + 1), (prev, ch) -> {row}, r -> element_at(r, -1)) end")


def indel_ratio(a: str, b: str) -> Column:
    """100 * 2 * LCS / (length a + length b); 100 if both are empty."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(200.0 * lcs(a, b) / F.greatest(total, F.lit(1)))


def ratio_at_least(a: str, b: str, threshold: int) -> Column:
    """indel_ratio >= threshold in whole numbers, after two cheap conditions that it implies."""
    total = F.length(a) + F.length(b)
    bound = (200 * F.least(F.length(a), F.length(b)) >= threshold * total) & (100 * F.levenshtein(a, b) <= (100 - threshold) * total)
    return F.when(~bound, F.lit(False)).otherwise(F.when(total == 0, F.lit(True)).otherwise(200 * lcs(a, b) >= threshold * total))


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null for a null or zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)
