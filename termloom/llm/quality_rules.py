"""Learned decision lists [native]: sequential covering over labelled statistics, emitted as a Spark CASE expression.

Everything that touches rows is a DataFrame aggregation; the driver only sees counts for each (feature, threshold).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, remainder
from .stats import BASE, FEATURES, features, statistics

#: A literal is (feature, "<=" or ">", threshold); a rule is a list of literals that reject a document.
Literal = tuple[str, str, float]


def holds(rule: list[Literal]) -> Column:
    """Null statistics do not occur; a rule of no literals holds everywhere."""
    tests = [(F.col(f"f_{f}") > t) if op == ">" else (F.col(f"f_{f}") <= t) for f, op, t in rule]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def tallies(rows: DataFrame, within: Column, cuts: dict[str, list[float]]) -> dict[Literal, tuple[float, float]]:
    """(bad, good) that each literal covers together with ``within``: one aggregation by (feature, bin) over all rows.

    A value's bin is the number of cuts below it, so sums over bins give every threshold at once.
    """
    cells = rows.where(within).select("bad", F.posexplode(F.array(*[f"b_{f}" for f in FEATURES])).alias("f", "bin"))
    got: dict[tuple[str, int], tuple[int, int]] = {(FEATURES[r["f"]], r["bin"]): (r["bads"], r["n"] - r["bads"]) for r in cells.groupBy("f", "bin").agg(F.count("*").alias("n"), F.count(F.when(F.col("bad"), 1)).alias("bads")).toLocalIterator()}
    out: dict[Literal, tuple[float, float]] = {}
    for f in FEATURES:
        each = [got.get((f, k), (0, 0)) for k in range(len(cuts[f]) + 1)]
        bad, good = (sum(x[i] for x in each) for i in (0, 1))
        low_bad = low_good = 0
        for k, t in enumerate(cuts[f]):
            low_bad, low_good = low_bad + each[k][0], low_good + each[k][1]
            out[f, "<=", t], out[f, ">", t] = (low_bad, low_good), (bad - low_bad, good - low_good)
    return out


def precision(bad: float, good: float) -> float:
    return (bad + 1) / (bad + good + 2)


def with_margin(rows: DataFrame, within: Column, rule: list[Literal], keep: float = 0.02) -> list[Literal]:
    """Thresholds moved half way to where the covered bad rows begin (but for a share ``keep``): what lies between the
    good rows and the bad ones is left to the good. One aggregation."""
    aggs = [F.percentile_approx(f"f_{f}", keep if op == ">" else 1 - keep, 2000).alias(f"p{i}") for i, (f, op, _) in enumerate(rule)]
    edge = rows.where(within & F.col("bad") & holds(rule)).agg(*aggs).first()
    return [(f, op, t if edge[i] is None else (t + edge[i]) / 2) for i, (f, op, t) in enumerate(rule)]


def learn(labelled: DataFrame, scratch: Scratch, max_rules: int = 6, max_literals: int = 3, bins: int = 16, least_precision: float = 0.8, least_cover: int = 5) -> list[list[Literal]]:
    """An ordered list of rejecting rules. ``labelled``: the f_ columns, bad boolean, fold int (0 prunes, others grow).

    Grow: add the literal with the best first-order information gain on the growing rows. Prune: cut trailing
    literals while that does not lower (bad - good) / (bad + good) on the pruning rows. A rule stays when it is
    precise and covers enough on all rows not yet covered; it gets a margin then. No labels, or none bad: no rules.
    """
    import math

    steps = [i / bins for i in range(1, bins)]
    found = labelled.agg(*[F.percentile_approx(f"f_{f}", steps, 2000).alias(f) for f in FEATURES], *[F.percentile_approx(F.when(F.col("bad"), F.col(f"f_{f}")), steps, 2000).alias(f"{f}_bad") for f in FEATURES]).first()
    cuts = {f: sorted({*(found[f] or []), *(found[f"{f}_bad"] or [])}) for f in FEATURES}
    rules: list[list[Literal]] = []
    if not any(cuts.values()):
        return rules
    below = [sum((F.when(F.col(f"f_{f}") > t, 1).otherwise(0) for t in cuts[f]), F.lit(0)).alias(f"b_{f}") for f in FEATURES]
    rows = scratch.save(labelled.select("*", *below))

    def total(within: Column) -> tuple[float, float]:
        r = rows.where(within).agg(F.count("*").alias("n"), F.count(F.when(F.col("bad"), 1)).alias("bads")).first()
        return r["bads"], r["n"] - r["bads"]

    left = F.lit(True)
    while len(rules) < max_rules:
        rule: list[Literal] = []
        base = total(left & (F.col("fold") != 0))
        if base[0] < least_cover:
            break
        while len(rule) < max_literals and base[1] > 0:
            gain = {x: b * (math.log2(precision(b, g)) - math.log2(precision(*base))) for x, (b, g) in tallies(rows, left & (F.col("fold") != 0) & holds(rule), cuts).items() if b >= least_cover}
            best = max(gain, key=lambda x: (gain[x], x), default=None)
            if best is None or gain[best] <= 1e-9:
                break
            rule = [*rule, best]
            base = total(left & (F.col("fold") != 0) & holds(rule))
        if not rule:
            break
        worth = [(b - g) / (b + g) if b + g else -1.0 for b, g in (total(left & (F.col("fold") == 0) & holds(rule[:n])) for n in range(1, len(rule) + 1))]
        rule = rule[: worth.index(max(worth)) + 1]
        b, g = total(left & holds(rule))
        if precision(b, g) < least_precision or b < least_cover:
            break
        rule = with_margin(rows, left, rule)
        rules.append(rule)
        left = left & ~holds(rule)
    scratch.drop(rows)
    return rules


def decide(rules: list[list[Literal]]) -> Column:
    """The decision list as one ordered expression: the number of the first rule that holds, 0 if none does."""
    out = F.lit(0)
    for i, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(holds(rule), i).otherwise(out)
    return out


def quality_rules(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Statistics and verdict of every whole text: doc_id, the base statistics, base_failed, kept, rule (0: none).

    A null text counts as empty and fails the base rule. Rows with a repeated or null doc_id each get their own
    verdict; a label that is null is not learned from, and of several labels of an id the least counts. An empty table gives an empty result, no labels no rules.
    """
    scratch = Scratch(documents.sparkSession, "op1")
    stats = scratch.save(statistics(documents).select("*", *features()))
    known = labels.select("doc_id", F.col("quality").alias("_q")).where("_q is not null").groupBy("doc_id").agg(F.min("_q").alias("_q"))
    labelled = stats.join(known, "doc_id").select(*[f"f_{f}" for f in FEATURES], (F.col("_q") == 0).alias("bad"), remainder("doc_id", 3).alias("fold"))
    labelled = scratch.save(labelled)
    rules = learn(labelled, scratch, **options)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.select("doc_id", *BASE, failed.alias("base_failed"), decide(rules).alias("rule")).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
