"""Language ID: error-correcting output codes. Binary n-gram classifiers predict the bits of language codewords."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, remainder

#: Hashed n-grams of 1 to 3 letters.
BINS, ORDERS = 1 << 13, 3


@cache
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def profile(text: str) -> np.ndarray | None:
    """Shares of the hashed n-grams of a whole text, lower-cased, runs of other characters as one space; None without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    is_letter = letters()[codes]
    if not is_letter.any():
        return None
    codes = np.where(is_letter, codes, 32)
    keep = np.ones(len(codes), bool)
    keep[1:] = is_letter[1:] | is_letter[:-1]
    codes = np.concatenate(([32], codes[keep], [32])).astype(np.uint64)
    out = np.zeros(BINS)
    gram = np.zeros(len(codes), np.uint64)
    for n in range(1, ORDERS + 1):
        gram = (gram[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :]) if n > 1 else codes
        mixed = (gram + np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9)
        counts = np.bincount((mixed >> np.uint64(64 - 13)).astype(np.int64), minlength=BINS)
        out += counts / max(1, len(gram)) / ORDERS
    return out


def code_matrix(k: int, columns: int = 127, seed: int = 7) -> np.ndarray:
    """Codewords as rows of +1 and -1. Up to 7 classes: the exhaustive code. More: seeded random dense columns."""
    if k < 2:
        return np.ones((k, 1))
    if k <= 7:
        bits = [[1 if c == 0 or not (b >> (c - 1)) & 1 else -1 for b in range(1, 1 << (k - 1))] for c in range(k)]
        return np.array(bits, float)
    rng = np.random.default_rng(seed)
    found: dict[bytes, np.ndarray] = {}
    while len(found) < columns:
        column = np.where(rng.random(k) < 0.5, 1.0, -1.0) * 1.0
        column *= column[0]
        if abs(column.sum()) < k:
            found[column.tobytes()] = column
    return np.stack(list(found.values()), axis=1)


@dataclass
class Codes:
    names: list[str]
    matrix: np.ndarray  # languages x bits
    weights: np.ndarray  # n-gram bins x bits
    scale: np.ndarray  # of each bit's margin
    trust: np.ndarray  # of each bit's loss

    def bits(self, share: np.ndarray) -> np.ndarray:
        return share @ self.weights / self.scale

    def decode(self, share: np.ndarray) -> tuple[int, float, bool]:
        """(language, score, ambiguous): the codeword with the least weighted loss, its soft share, and whether that is no majority."""
        margin = np.clip(self.bits(share), -6, 6)
        loss = np.log1p(np.exp(-self.matrix * margin)) @ self.trust
        order = np.argsort(loss, kind="stable")
        share = np.exp(-(loss - loss[order[0]]))
        score = float(1.0 / share.sum())
        return int(order[0]), score, score < 0.5


def bit_weights(sums: np.ndarray, matrix: np.ndarray, smooth: float = 1e-6) -> np.ndarray:
    """For each bit the log ratio of n-gram shares in the languages on its two sides."""
    p = sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-300)
    out = np.zeros((sums.shape[1], matrix.shape[1]))
    for b in range(matrix.shape[1]):
        yes, no = (p[matrix[:, b] == s].mean(axis=0) if (matrix[:, b] == s).any() else np.full(p.shape[1], 1 / p.shape[1]) for s in (1, -1))
        out[:, b] = np.log(yes + smooth) - np.log(no + smooth)
    return out


def learn(documents: DataFrame, most_each: int = 3000) -> Codes | None:
    """Fit on whole texts of about ``most_each`` rows a language at most, chosen by a hash of the id. None without rows.

    ``documents``: doc_id, text, lang, not held out. Executors sum n-gram shares by language, then measure each bit:
    its margin's size (scale) and its error (trust); the driver gets one array a language.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "op2")
    counts = {r["lang"]: r["n"] for r in documents.groupBy("lang").agg(F.count("*").alias("n")).toLocalIterator()}
    if not counts:
        return None
    names = sorted(counts)
    limit = F.lit(1.0)
    for name in names:
        limit = F.when(F.col("lang") == name, min(1.0, most_each / counts[name])).otherwise(limit)
    chosen = documents.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fit")), F.lit(1 << 30)) < limit * (1 << 30))
    chosen = scratch.save(chosen.repartition(32))
    number = {n: i for i, n in enumerate(names)}

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), BINS))
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if (share := profile(text.as_py())) is not None:
                    total[number[lang]] += share
        yield pa.RecordBatch.from_arrays([pa.array(range(len(names)), pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())], ["k", "x"])

    def gathered(f, width: int) -> np.ndarray:
        total = np.zeros((len(names), width))
        for row in chosen.select("text", "lang").mapInArrow(f, "k int, x binary").toLocalIterator():
            total[row["k"]] += np.frombuffer(row["x"])
        return total

    matrix = code_matrix(len(names))
    model = Codes(names, matrix, bit_weights(gathered(sums, BINS), matrix), np.ones(matrix.shape[1]), np.ones(matrix.shape[1]))

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), 3, matrix.shape[1]))  # texts, margins the right way, errors
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if (share := profile(text.as_py())) is not None:
                    right = model.bits(share) * matrix[number[lang]]
                    total[number[lang]] += np.stack([np.ones_like(right), np.abs(right), right <= 0])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(names)), pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())], ["k", "x"])

    seen = gathered(margins, 3 * matrix.shape[1]).reshape(len(names), 3, -1).sum(axis=0)
    model.scale = np.maximum(seen[1] / np.maximum(seen[0], 1), 1e-6) / 3
    error = (seen[2] + 1) / (seen[0] + 2)
    model.trust = np.clip(0.5 * np.log((1 - error) / error), 0.05, 3.0)
    scratch.drop(chosen)
    return model


def identify(documents: DataFrame, model: Codes | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, lang_pred, score (0 to 1), ambiguous for every whole text; `und`, 0, true for null or letterless texts."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, doubts = [], [], []
            for text in batch.column(len(keep)):
                share = profile(text.as_py() or "") if model else None
                k, score, doubt = model.decode(share) if share is not None else (-1, 0.0, True)
                names.append(model.names[k] if k >= 0 else "und")
                scores.append(score)
                doubts.append(doubt)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(doubts, pa.bool_())], [*keep, "lang_pred", "score", "ambiguous"])

    kept = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    return documents.select(*keep, F.col("text").cast("string").alias("_text")).mapInArrow(predict, f"{kept}, lang_pred string, score double, ambiguous boolean")


def language_id(documents: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous. Learns only from text and lang of rows that are not held out.

    Ties between codewords go to the first language in code point order. Without rows to learn from, every text is
    `und`. With a single language known, every text with a letter is of it. Repeated ids are predicted row by row.
    """
    held = remainder("doc_id", 4) == 2
    model = learn(documents.where(~held & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang"), **options)
    return identify(documents.select("doc_id", "text"), model).withColumn("held_out", held)
