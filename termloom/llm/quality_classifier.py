"""Quality classifier: histogram gradient-boosted trees over document statistics, traversed as flat arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, remainder
from .stats import FEATURES, features, statistics


@dataclass
class Trees:
    """Complete binary trees of one depth; node k of a tree has children 2k+1 and 2k+2, leaves come last."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), "int64")
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - inner] if len(node) else 0.0
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 2.0, least: float = 1.0) -> Trees:
    """Level-wise growth on second-order gains; each level is one histogram of gradients by (node, feature, bin).

    Without rows, or with one class only, there are no splits and the score is the smoothed share of label 1.
    """
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    base, n, m = float(np.log(share / (1 - share))), len(y), x.shape[1]
    inner = (1 << depth) - 1
    out = Trees(np.zeros((0, inner), "int64"), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    if n < 2 or y.min() == y.max():
        return out
    steps = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins), method="nearest")) for j in range(m)]
    cuts = [(s[1:] + s[:-1]) / 2 for s in steps]  # between values seen, so that no class starts at the other's edge
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(m)], axis=1)  # > cut means right
    margin, grown = np.full(n, base), []
    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold, node = np.zeros(inner, "int64"), np.full(inner, np.inf), np.zeros(n, "int64")
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            best = np.full(width, 1e-9)
            at = node - first
            for j in range(m):
                if not len(cuts[j]):
                    continue
                key = at * bins + binned[:, j]
                sg = np.bincount(key, g, width * bins).reshape(width, bins).cumsum(axis=1)
                sh = np.bincount(key, h, width * bins).reshape(width, bins).cumsum(axis=1)
                tg, th = sg[:, -1:], sh[:, -1:]
                gain = sg**2 / (sh + l2) + (tg - sg) ** 2 / (th - sh + l2) - tg**2 / (th + l2)
                gain[(sh < least) | (th - sh < least)] = 0
                gain = gain[:, : len(cuts[j])]
                k = gain.argmax(axis=1)
                top = gain[np.arange(width), k]
                won = top > best
                feature[first : first + width][won] = j
                threshold[first : first + width][won] = cuts[j][k[won]]
                best = np.maximum(best, top)
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        at = node - inner
        leaf = -rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + l2)
        margin = margin + leaf[at]
        grown.append((feature, threshold, leaf))
    return Trees(*(np.stack([t[i] for t in grown]) for i in range(3)), base)


def classify(documents: DataFrame, labels: DataFrame, most_rows: int = 60_000, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (score >= threshold) for every whole text.

    Fitted on the driver from the statistics of at most about ``most_rows`` labelled rows that are not held out,
    chosen by a hash of their ids, a row for each id; scores cover all rows. A null text counts as empty; null labels
    teach nothing; of several labels of an id the least counts; a repeated doc_id is scored row by row. An empty table
    gives no rows.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "op6")
    stats = scratch.save(statistics(documents).select("doc_id", *features()))
    columns = [f"f_{f}" for f in FEATURES]
    held = remainder("doc_id", 5) == 0
    known = labels.select("doc_id", F.col("quality").cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held)
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"))
    keep = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fit")), F.lit(1 << 30)) < int((1 << 30) * min(1.0, most_rows / max(1, known.count())))
    rows = stats.join(known.where(keep), "doc_id").groupBy("doc_id").agg(F.min(F.struct(*columns, "y")).alias("r")).select("r.*").toPandas()
    model = fit(rows[columns].to_numpy(float), rows["y"].to_numpy(float), **options)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            yield pd.DataFrame({"doc_id": x["doc_id"], "held_out": x["held_out"], "score": model.score(x[columns].to_numpy(float))})

    id_type = documents.schema["doc_id"].dataType.simpleString()
    scored = stats.withColumn("held_out", held).mapInPandas(score, f"doc_id {id_type}, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
