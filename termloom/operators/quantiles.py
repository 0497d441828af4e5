"""Exact quantiles by group: histograms narrow each wanted rank down to one value, with a bounded state whatever the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.checkpoints import cut

#: Bins of a histogram, and values of an interval that are few enough to be listed.
BINS, FEW = 1024, 4096


def quantiles(df: DataFrame, by: str, column: str, steps: list[float]) -> DataFrame:
    """(label, q): for each value of ``by`` the column's quantiles, array<double>, linear between neighbours.

    Nulls and NaN do not count; a group without other values has null quantiles. A null label is a group of its own.

    A rank's interval starts as the group's whole span. Each round counts the interval's values in BINS bins, one
    aggregation for all groups and ranks, and goes on with what its bin really spans. Intervals of one value are done,
    those of FEW values or less are listed. Where no group has many different values, Spark's own sets do. So a task never holds more than bins, whatever the number of different values.
    """
    values = df.select(F.col(by).alias("label"), F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)")
    spans = cut(values.groupBy("label").agg(F.count("*").alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.approx_count_distinct("v").alias("d")))
    if (spans.agg(F.max("d")).first()[0] or 0) <= FEW // 2:  # so few different values are a bounded state too
        direct = F.percentile(F.when(~F.isnan("v"), F.col("v")), steps).alias("q")
        return df.select(F.col(by).alias("label"), F.col(column).cast("double").alias("v")).groupBy("label").agg(direct)
    place = lambda q: (F.col("m") - 1) * F.lit(q)
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(q)), F.ceil(place(q))) for q in steps])))
    open_ = spans.select("label", F.explode(ranks).alias("r"), "lo", "hi", F.lit(0).cast("long").alias("before"), F.col("m").alias("n"))
    done = None
    while True:
        open_ = cut(open_)
        ready = open_.where("lo = hi").select("label", "r", F.col("lo").alias("x"))
        done = ready if done is None else done.union(ready)
        few, many = open_.where(f"lo < hi and n <= {FEW}"), open_.where(f"lo < hi and n > {FEW}")
        listed = inside(values, few).groupBy("label", "lo", "hi").agg(F.sort_array(F.collect_list("v")).alias("all"))
        found = same(few, listed).select("t.label", "t.r", F.get("b.all", (F.col("t.r") - F.col("t.before")).cast("int")).alias("x"))
        done = done.union(cut(found))
        if many.isEmpty():
            break
        bins = inside(values, many).groupBy("label", "lo", "hi", bin_of().alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("a"), F.max("v").alias("z"))
        upto = F.sum("c").over(Window.partitionBy("label", "lo", "hi").orderBy("bin"))  # BINS rows an interval
        bins = bins.withColumn("upto", upto)
        k = F.col("t.r") - F.col("t.before")
        next_ = same(many, bins).where((k < F.col("b.upto")) & (k >= F.col("b.upto") - F.col("b.c")))
        open_ = next_.select("t.label", "t.r", F.col("b.a").alias("lo"), F.col("b.z").alias("hi"), (F.col("t.before") + F.col("b.upto") - F.col("b.c")).alias("before"), F.col("b.c").alias("n"))
    at = lambda i: F.get("x", (F.array_position("rs", i) - 1).cast("int"))
    listed = done.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("r", "x"))).alias("f")).select("label", F.col("f.r").alias("rs"), F.col("f.x").alias("x"))
    between = lambda q: F.when(F.floor(place(q)) == F.ceil(place(q)), at(F.floor(place(q)))).otherwise((F.ceil(place(q)) - place(q)) * at(F.floor(place(q))) + (place(q) - F.floor(place(q))) * at(F.ceil(place(q))))
    every = df.select(F.col(by).alias("label")).distinct()
    out = spans.alias("s").join(listed.alias("l"), F.expr("s.label <=> l.label")).select("s.label", F.array(*[between(q) for q in steps]).alias("q"))
    return every.alias("e").join(out.alias("o"), F.expr("e.label <=> o.label"), "left").select("e.label", "o.q")


def bin_of() -> Column:
    """The bin of v in [lo, hi], never less for a larger v. Around zero the signs part first; where the bounds lie
    orders of magnitude apart bins are even in the logarithm, so a few rounds do for any doubles."""
    v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    even = lambda v, lo, hi: F.least(F.floor((v - lo) / (hi - lo) * BINS), F.lit(BINS - 1))
    signs = F.when((lo <= 0) & (hi >= 0), F.signum(v).cast("long"))
    return signs.when((lo > 0) & (hi / 4 > lo), even(F.log(v), F.log(lo), F.log(hi))).when((hi < 0) & (lo / 4 < hi), even(-F.log(-v), -F.log(-lo), -F.log(-hi))).otherwise(even(v, lo, hi))


def inside(values: DataFrame, intervals: DataFrame) -> DataFrame:
    """(label, lo, hi, v): the values of each different interval."""
    t = intervals.select("label", "lo", "hi").distinct()
    return values.alias("v").join(t.alias("t"), F.expr("v.label <=> t.label and v.v between t.lo and t.hi")).select("t.label", "t.lo", "t.hi", "v.v")


def same(a: DataFrame, b: DataFrame) -> DataFrame:
    """Intervals, t, joined with what is known of the same interval, b."""
    return a.alias("t").join(b.alias("b"), F.expr("t.label <=> b.label and t.lo = b.lo and t.hi = b.hi"))
