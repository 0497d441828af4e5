"""Mixing sources to target weights: entropy balancing solved by Newton steps on the convex dual, rounded into copies."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .stats import split_words

#: More sources than this are joined by shuffle instead of broadcast (a row is a name and three numbers).
BROADCAST_SOURCES = 5_000
#: A document's place in its source has LEVELS * BITS bits; a task sums at most 2^BITS buckets of a source at a time.
LEVELS, BITS = 3, 14
PLACES = 1 << (LEVELS * BITS)


def share_out(sizes: list[int], weights: list[int], most: float) -> list[float]:
    """Targets that share the total by weight, none above ``most`` times its size; the excess is shared again."""
    target, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    rest = float(sum(sizes))
    while open_:
        total = sum(weights[k] for k in open_)
        over = {k for k in open_ if rest * weights[k] / total > most * sizes[k]}
        if not over:
            for k in open_:
                target[k] = rest * weights[k] / total
            break
        for k in over:
            target[k] = most * sizes[k]
        rest -= sum(target[k] for k in sorted(over))
        open_ -= over
    return target


def balance(cells: DataFrame, targets: list[float], names: list[str], means: list[float], steps: int = 60, near: float = 1e-10):
    """Newton on the dual of entropy balancing. cells: k int (source), size double, and covariate columns ``names``.

    Rates are exp(lambda_k + mu . (x - mean)); the constraints are sum of size * rate over source k = targets[k], and
    weighted covariate means of the mix = ``means``. The Hessian is diagonal in the sources, so mu follows from its
    Schur complement. A step is one aggregation by source where mu has moved; lambda only scales the sums of a
    source, so without covariates the first aggregation serves all steps. Returns (lambda by source, mu).
    """
    n, c = len(targets), len(names)
    raw = None
    lam, mu = np.zeros(n), np.zeros(c)
    target = np.array(targets)
    z = [F.col(x) - m for x, m in zip(names, means, strict=True)]
    for _ in range(steps):
        if raw is None or c:
            tilt = sum((float(m) * x for m, x in zip(mu, z, strict=True)), F.lit(0.0))
            w = F.col("size") * F.exp(tilt)
            sums = [F.sum(w)] + [F.sum(w * a) for a in z] + [F.sum(w * z[i] * z[j]) for i in range(c) for j in range(c)]
            raw = np.zeros((n, 1 + c + c * c))
            for row in cells.groupBy("k").agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).collect():
                raw[row["k"]] = [row[f"s{i}"] for i in range(1 + c + c * c)]
        live = (target > 0) & (raw[:, 0] > 0)
        got = raw * np.exp(lam)[:, None]
        a, b, h = got[:, 0], got[:, 1 : 1 + c], got[:, 1 + c :].sum(axis=0).reshape(c, c)
        gap = np.where(live, a - target, 0.0)
        if np.all(np.abs(gap) <= near * np.maximum(1.0, target)) and np.all(np.abs(b.sum(axis=0)) <= near * max(1.0, target.sum())):
            break
        safe = np.where(live, a, 1.0)
        step_mu = np.zeros(c)
        if c:
            scaled = np.where(live[:, None], b / safe[:, None], 0.0)
            step_mu = np.linalg.solve(h - scaled.T @ b + 1e-9 * np.eye(c), -(b.sum(axis=0) - scaled.T @ gap))
        step = np.where(live, -(gap + b @ step_mu) / safe, 0.0)
        scale = min(1.0, 2.0 / max(1e-12, np.abs(step).max(initial=0.0), np.abs(step_mu).max(initial=0.0)))
        lam, mu = lam + scale * step, mu + scale * step_mu
    return lam, mu


def round_to(rows: DataFrame, left: list[float], levels: int = LEVELS, bits: int = BITS) -> tuple[list[int], list[tuple[int, int, int]]]:
    """For each source a cut, and one (q, u, times) more: rows with q < cut add up to at most its ``left`` words, and
    as many of the equal rows (q, u) beyond as come nearest to what is still wanting close the gap ((-1, 0, 0) where
    none does better).

    rows: k, q (levels * bits bits), u, size, n (equal rows). Each level is one aggregation into 2^bits buckets a source, refined in the
    bucket where the running sum passes ``left``; only that bucket of each source comes to the driver.
    """
    spark, n = rows.sparkSession, len(left)
    prefix, below, passed = [0] * n, [0] * n, set()
    for level in range(levels):
        shift = bits * (levels - 1 - level)
        state = spark.createDataFrame([(k, prefix[k], float(below[k]), float(left[k])) for k in range(n)], "k int, p long, below double, goal double")
        state = F.broadcast(state) if n <= BROADCAST_SOURCES else state
        sums = rows.join(state, "k").where(F.shiftright("q", shift + bits) == F.col("p")).groupBy("k", "below", "goal", F.shiftright("q", shift).alias("bucket")).agg(F.sum(F.col("size") * F.col("n")).alias("s"))
        run = sums.withColumn("upto", F.col("below") + F.sum("s").over(Window.partitionBy("k").orderBy("bucket")))
        crossed = {r["k"]: r["x"] for r in run.where("upto > goal").groupBy("k").agg(F.min_by(F.struct("bucket", "upto", "s"), "bucket").alias("x")).collect()}
        passed = passed or set(crossed)
        for k in range(n):
            if k in crossed and k in passed:
                prefix[k], below[k] = crossed[k]["bucket"], round(crossed[k]["upto"]) - crossed[k]["s"]
            else:
                prefix[k] = 1 << (bits * (level + 1))
    state = spark.createDataFrame([(k, prefix[k], float(left[k] - below[k])) for k in passed] or [(-1, 0, 0.0)], "k int, cut long, gap double")
    state = F.broadcast(state) if n <= BROADCAST_SOURCES else state
    times = F.greatest(F.lit(1), F.least(F.col("n"), F.round(F.col("gap") / F.col("size")).cast("long")))
    beyond = rows.join(state, "k").where(F.col("q") >= F.col("cut")).withColumn("times", times).withColumn("error", F.abs(F.col("size") * F.col("times") - F.col("gap")))
    closest = beyond.where("error < gap").groupBy("k").agg(F.min(F.struct("error", "q", "u", "times")).alias("x"))
    extra = [(-1, 0, 0)] * n
    for r in closest.collect():
        extra[r["k"]] = (r["x"]["q"], r["x"]["u"], r["x"]["times"])
    return prefix, extra


def mix(documents: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, covariates: dict[str, tuple[Column, float]] | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """doc_id, size, source_size, target, rate, copies, taken (copies * size) for every document.

    Sources in code point order, the null source last, weigh ``weights`` in turn. A null or empty text has size 0 and
    takes nothing. Copies are the rate rounded down, plus one for the documents that a hash of doc_id and text puts
    first, as many as the source's target needs, and those that close the gap: reruns agree. Wholly equal rows are
    counted and rounded together, so no more of them than needed get one more. One row for each source comes to the
    driver. An empty table gives no rows. Covariates (column, mean wanted) are balanced in the mix too; rates stop at ``most``.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "op9")
    extra = covariates or {}
    sized = documents.select(*keep, "source", F.size(split_words(F.coalesce("text", F.lit("")))).cast("long").alias("size"), F.xxhash64(F.col("doc_id"), F.col("text")).alias("_u"), *[c.cast("double").alias(f"x_{n}") for n, (c, _) in extra.items()])
    equal = [*keep, "source", "size", "_u", *[f"x_{n}" for n in extra]]
    sized = scratch.save(sized.groupBy(*equal).agg(F.count("*").alias("_n")))
    sources = [(r["source"], r["s"]) for r in sized.groupBy("source").agg(F.sum(F.col("size") * F.col("_n")).alias("s")).collect()]
    sources = sorted((s for s in sources if s[0] is not None), key=lambda s: s[0]) + [s for s in sources if s[0] is None]
    sizes = [s for _, s in sources]
    targets = share_out(sizes, [weights[k % len(weights)] for k in range(len(sizes))], most)
    known = spark.createDataFrame([(s, k, n, t) for k, ((s, n), t) in enumerate(zip(sources, targets, strict=True))], "s string, k int, source_size long, target double")
    known = F.broadcast(known) if len(sources) <= BROADCAST_SOURCES else known
    rows = sized.join(known, sized["source"].eqNullSafe(known["s"])).drop("s", "source")
    names = [f"x_{n}" for n in extra]
    cells = rows.groupBy("k", *names).agg(F.sum(F.col("size") * F.col("_n")).cast("double").alias("size"))
    lam, mu = balance(scratch.save(cells), targets, names, [m for _, m in extra.values()])
    tilt = spark.createDataFrame([(k, float(x)) for k, x in enumerate(lam)], "k int, lam double")
    tilt = F.broadcast(tilt) if len(sources) <= BROADCAST_SOURCES else tilt
    score = sum((float(m) * (F.col(x) - c) for m, x, (_, c) in zip(mu, names, extra.values(), strict=True)), F.col("lam"))
    rate = F.round(F.least(F.exp(score), F.lit(most)), 9)
    whole = F.floor("rate").cast("long")
    unit = F.pmod("_u", F.lit(PLACES)) / F.lit(float(PLACES))
    key = F.floor((unit - (F.col("rate") - whole) + 1) / 2 * F.lit(float(PLACES))).cast("long")
    rated = scratch.save(rows.join(tilt, "k").withColumn("rate", rate).withColumn("q", key).withColumn("whole", whole).drop("lam", *names))
    floors = {r["k"]: r["s"] for r in rated.groupBy("k").agg(F.sum(F.col("whole") * F.col("size") * F.col("_n")).alias("s")).collect()}
    left = [max(0.0, t - floors.get(k, 0)) for k, t in enumerate(targets)]
    cuts, extras = round_to(rated.where("size > 0 and rate < %r" % most).select("k", "q", F.col("_u").alias("u"), "size", F.col("_n").alias("n")), left)
    chosen = spark.createDataFrame([(k, c, *x) for k, (c, x) in enumerate(zip(cuts, extras, strict=True))], "k int, cut long, eq long, eu long, times long")
    chosen = F.broadcast(chosen) if len(sources) <= BROADCAST_SOURCES else chosen
    more = F.when(F.col("rate") >= most, 0).when(F.col("q") < F.col("cut"), F.col("_n")).when((F.col("q") == F.col("eq")) & (F.col("_u") == F.col("eu")), F.col("times")).otherwise(0)
    done = rated.join(chosen, "k").withColumn("_more", more).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    done = done.withColumn("copies", F.least(F.col("whole") + F.when(F.col("_i") <= F.col("_more"), 1).otherwise(0), F.lit(math.floor(most))).cast("long"))
    return done.select(*keep, "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))
