"""LM scoring: Katz backoff n-grams. Good-Turing discounts, exactly normalised backoff weights, written count tables.

Texts are read once into written chunks of token numbers. Counts live in buckets by hash: each chunk asks for its own
distinct words, n-grams and histories once, and gets totals over all training texts back in the same order, so what
moves is a key for each distinct entry of a chunk, not a row for each token. Backoff weights of an order need the
probabilities of the order below, so orders are normalised one after the other, each in a written table.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, remainder
from .words import STEP, batches_of, mixed

#: Tokens of a chunk and keys of a bucket: they bound a task's memory, whatever the input.
CHUNK, BUCKET = 2_000_000, 1_000_000
#: Counts up to this are discounted.
GT_MAX = 5
END, START = np.uint64(0x5E5E5E5E0E0E0E0E), np.uint64(0xA5A5A5A501010101)

TOKENS = "chunk long, docs array<long>, lens array<long>, held array<boolean>, idx binary, vocab binary"
ASK = "bucket int, chunk long, keys binary, x binary, y binary"
ANSWER = "chunk long, kind int, part int, x binary, y binary"


def squeeze(a: np.ndarray) -> bytes:
    """An array's bytes, first bytes first, compressed: small numbers take little room wherever they travel."""
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes(), 1) if len(a) else b""


def unsqueeze(raw: bytes, kind: str) -> np.ndarray:
    if not raw:
        return np.zeros(0, kind)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def tokens(documents: DataFrame, modulus: int, left_out: int) -> DataFrame:
    """Chunks of whole documents: ids, token counts, whether held out, token numbers, the word hashes they number."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n = TaskContext.get().partitionId() << 32, 0
        docs, lens, held, words, size = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal n
            every = np.concatenate(words) if words else np.zeros(0, np.uint64)
            vocab, idx, counts = np.unique(every, return_inverse=True, return_counts=True)
            order = np.argsort(-counts, kind="stable")  # frequent words get small numbers
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            vocab, idx = vocab[order], rank[idx]
            n += 1
            row = [[base + n], [docs], [lens], [held], [squeeze(idx.astype("<u4"))], [vocab.tobytes()]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], ["chunk", "docs", "lens", "held", "idx", "vocab"])

        for batch in batches:
            ids, out = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j, found, first in batches_of(batch.column(2)):
                counts = np.diff(first)
                docs += ids[i:j]
                held += out[i:j]
                lens += (counts + 1).tolist()
                words.append(np.insert(found, first[1:], END))
                size += len(words[-1])
                if size >= CHUNK:
                    yield flush()
                    docs, lens, held, words, size = [], [], [], [], 0
        if docs:
            yield flush()

    return documents.select(F.col("doc_id").cast("long"), (remainder("doc_id", modulus) == left_out).alias("held"), "text").mapInArrow(number, TOKENS)


class Chunk:
    """One chunk's tokens and, for each order, its distinct n-grams; answers are put back into this order."""

    def __init__(self, row: dict):
        self.id = row["chunk"]
        self.docs, self.held = row["docs"], np.array(row["held"], bool)
        self.lens = np.array(row["lens"], np.int64)
        self.idx = unsqueeze(row["idx"], "<u4").astype(np.int64)
        self.vocab = np.frombuffer(row["vocab"], np.uint64)
        self.first = np.cumsum(self.lens) - self.lens
        self.train = np.repeat(~self.held, self.lens)
        #: The n-gram that ends at each token; keys of n-grams; their histories and last words' lower n-grams; keys of histories.
        self.gram, self.keys = {1: self.idx}, {1: self.vocab}
        self.h: dict[int, np.ndarray] = {}
        self.lower: dict[int, np.ndarray] = {}
        self.heads: dict[int, np.ndarray] = {}

    def grams(self, order: int) -> Chunk:
        """A token's history is the n-gram below that ends just before it, from 1 in their order; at a text's start it is 0."""
        v = len(self.vocab)
        for k in range(2, order + 1):
            below = self.gram[k - 1]
            history = np.empty_like(below)
            history[1:] = below[:-1] + 1
            history[self.first] = 0
            both, at = np.unique(history * v + self.idx, return_inverse=True)
            self.h[k], w = np.divmod(both, v)
            self.lower[k] = np.empty(len(both), np.int64)
            self.lower[k][at] = below
            self.heads[k] = np.concatenate(([START], self.keys[k - 1]))
            self.keys[k] = mixed(self.heads[k][self.h[k]] * np.uint64(STEP) + self.vocab[w])
            self.gram[k] = at
        return self


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def places(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that occurs and where: time goes with the keys, however many buckets there are."""
    order = np.argsort(bucket, kind="stable")
    found, start = np.unique(bucket[order], return_index=True)
    yield from zip(found.tolist(), np.split(order, start[1:]), strict=True)


def asked(chunk: int, keys: np.ndarray, n: int, x: np.ndarray, y: np.ndarray | None = None) -> pa.RecordBatch:
    """A row for each bucket that a chunk asks: its keys there, in the chunk's order, and what it adds to them."""
    bucket = bucket_of(keys, n)
    rows = [(k, chunk, keys[o].tobytes(), squeeze(x[o]), squeeze(y[o]) if y is not None else b"") for k, o in places(bucket)]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "chunk", "keys", "x", "y"])


def put_back(keys: np.ndarray, n: int, parts: dict[int, bytes], kind: str) -> np.ndarray:
    out = np.zeros(len(keys), kind)
    for k, o in places(bucket_of(keys, n)):
        out[o] = unsqueeze(parts[k], kind)
    return out


def merged(kind: int, counts: bool) -> Callable[[tuple, pa.Table], pa.Table]:
    """Totals of a bucket, for each chunk in the order it asked. Counts also say who owns a key (its first training chunk)
    and, for chunk -1, how many keys have each small count, how many any, and their sum."""

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        sizes = [len(k.as_buffer()) // 8 for k in table.column("keys")]
        keys = np.concatenate([np.frombuffer(k.as_buffer(), np.uint64) for k in table.column("keys")])
        found, at = np.unique(keys, return_inverse=True)
        ends = np.cumsum(sizes)
        x = np.concatenate([unsqueeze(v, "<u4" if counts else "<f8") for v in table.column("x").to_pylist()])
        total = np.bincount(at, x, len(found))
        chunks, xs, ys = table.column("chunk").to_pylist(), [], []
        if counts:
            total = total.astype(np.int64)
            owner = np.zeros(len(keys), bool)
            has = np.flatnonzero(x > 0)
            owner[has[np.unique(at[has], return_index=True)[1]]] = True
            answer = (total[at] << 1 | owner).astype("<u8")
            small = np.bincount(np.minimum(total, GT_MAX + 2), minlength=GT_MAX + 3)
            stats = np.array([*small[1 : GT_MAX + 2], (total > 0).sum(), total.sum()], "<i8")
        else:
            answer = total[at]
            y = np.bincount(at, np.concatenate([unsqueeze(v, "<f8") for v in table.column("y").to_pylist()]), len(found))[at]
        for end, size in zip(ends, sizes, strict=True):
            part = answer[end - size : end]
            xs.append(squeeze(part))
            ys.append(b"" if counts else squeeze(y[end - size : end]))
        if counts:
            chunks, xs, ys = [*chunks, -1], [*xs, stats.tobytes()], [*ys, b""]
        n = len(chunks)
        return pa.table({"chunk": pa.array(chunks, pa.int64()), "kind": pa.array([kind] * n, pa.int32()), "part": pa.array([key[0].as_py()] * n, pa.int32()), "x": pa.array(xs, pa.binary()), "y": pa.array(ys, pa.binary())})

    return merge


def counts_back(keys: np.ndarray, n: int, parts: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
    out = put_back(keys, n, parts, "<u8").astype(np.int64)
    return out >> 1, (out & 1).astype(bool)


def discounts(n: np.ndarray) -> np.ndarray:
    """Katz's d_r for r = 0..GT_MAX (d_0 unused) from n[r - 1] entries of count r; 1 where Good-Turing gives none in (0, 1]."""
    d = np.ones(GT_MAX + 1)
    cut = (GT_MAX + 1) * n[GT_MAX] / n[0] if n[0] else 1.0
    for r in range(1, GT_MAX + 1):
        if n[r - 1] and cut < 1:
            value = ((r + 1) * n[r] / (r * n[r - 1]) - cut) / (1 - cut)
            if 0 < value <= 1:
                d[r] = value
    return d


class Model:
    """Totals and each order's discounts, and what follows from them; N training tokens of V kinds."""

    def __init__(self, n: int, v: int, texts: int, small: dict[int, np.ndarray]):
        self.n, self.v, self.texts, self.d = n, v, texts, {k: discounts(x) for k, x in small.items()}

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return (count + 0.5) / (self.n + 0.5 * (self.v + 1))

    def discounted(self, k: int, count: np.ndarray) -> np.ndarray:
        return np.where(count <= GT_MAX, self.d[k][np.minimum(count, GT_MAX)], 1.0) * count

    def room(self, histories: np.ndarray, taken: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(denominator, backoff weight) of each history: count, discounted mass taken, lower mass of its followers.

        A history whose discounts leave nothing gets one more in its denominator, so that unseen words keep a share.
        """
        whole = np.maximum(histories, 1).astype(float)
        none_left = taken >= whole * (1 - 1e-9)
        denominator = np.where(none_left, whole + 1, whole)
        return denominator, np.where(histories > 0, (1 - taken / denominator) / np.maximum(1 - seen, 1e-300), 1.0)


#: Answers to a chunk are told apart by kind: counts of order k are k, backoff masses of order k are ROOM + k.
ROOM = 1000


def answers(table: pa.Table) -> tuple[Chunk, dict[int, dict[int, tuple[bytes, bytes]]]]:
    got: dict[int, dict[int, tuple[bytes, bytes]]] = {}
    chunk = None
    for row in table.to_pylist():
        if row["kind"] == 0:
            chunk = Chunk(row)
        else:
            got.setdefault(row["kind"], {})[row["part"]] = row["x"], row["y"]
    return chunk, got


def katz_scores(documents: DataFrame, modulus: int = 5, left_out: int = 1, order: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10) for every whole text.

    ``order`` is the longest n-gram's length, 1 or more: an n-gram that training has not seen is left for the one below,
    recursively down to single words. Before a text's first token its history is as many start marks as the order asks.
    Learns from rows whose crc32(doc_id) modulo ``modulus`` is not ``left_out``. A null text is empty: its one token
    is the end. A null doc_id trains. Repeated ids are texts of their own. Without training rows every word is the
    unknown one. Words meet by 64-bit hashes. An empty table gives no rows.
    """
    scratch = Scratch(documents.sparkSession, "op3")
    corpus = scratch.save(tokens(documents, modulus, left_out), compression="zstd")
    sums = corpus.select(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x).alias("t"), F.size(F.filter("held", lambda x: ~x)).alias("d"), (F.length("vocab") / 8).alias("v")).agg(F.sum("t"), F.sum("d"), F.sum("v")).first()
    total, texts, kinds = (int(x or 0) for x in sums)
    buckets = {k: max(12, -(-(kinds if k == 1 else total) // BUCKET)) for k in range(1, order + 1)}

    def totals(k: int) -> DataFrame:
        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    c = Chunk(row).grams(k)
                    yield asked(c.id, c.keys[k], buckets[k], np.bincount(c.gram[k], c.train, len(c.keys[k])).astype("<u4"))

        return scratch.save(corpus.mapInArrow(ask, ASK).groupBy("bucket").applyInArrow(merged(k, True), ANSWER), compression="zstd")

    def stats(answer: DataFrame) -> np.ndarray:
        rows = [np.frombuffer(r["x"], "<i8") for r in answer.where("chunk = -1").select("x").toLocalIterator()]
        return np.sum(rows, axis=0) if rows else np.zeros(GT_MAX + 3, np.int64)

    counted = {k: totals(k) for k in buckets}
    scratch.release()
    found = {k: stats(x) for k, x in counted.items()}
    model = Model(int(found[1][-1]), int(found[1][-2]), texts, {k: found[k][: GT_MAX + 1] for k in range(2, order + 1)})

    def known(table: pa.Table, upto: int, ahead: bool):
        """A chunk, the counts of its n-grams and their probabilities up to an order; ``ahead`` adds the next order's n-grams."""
        c, got = answers(table)
        c.grams(upto + ahead)
        count = {k: counts_back(c.keys[k], buckets[k], {b: v[0] for b, v in got[k].items()}) for k in c.keys}
        p = {1: model.unigram(count[1][0])}
        for k in range(2, upto + 1):
            taken, seen = (put_back(c.heads[k], buckets[k - 1], {b: v[i] for b, v in got[ROOM + k].items()}, "<f8") for i in (0, 1))
            denominator, backoff = model.room(np.concatenate(([model.texts], count[k - 1][0])), taken, seen)
            here = count[k][0]
            p[k] = np.where(here > 0, model.discounted(k, here) / denominator[c.h[k]], backoff[c.h[k]] * p[k - 1][c.lower[k]])
        return c, count, p

    def ask_room(k: int) -> Callable[[pa.Table], pa.Table]:
        def ask(table: pa.Table) -> pa.Table:
            c, count, p = known(table, k - 1, True)
            here, owner = count[k]
            own = owner & (here > 0)
            taken = np.bincount(c.h[k][own], model.discounted(k, here[own]), len(c.heads[k]))
            seen = np.bincount(c.h[k][own], p[k - 1][c.lower[k][own]], len(c.heads[k]))
            return pa.Table.from_batches([asked(c.id, c.heads[k], buckets[k - 1], taken.astype("<f8"), seen.astype("<f8"))])

        return ask

    def score(table: pa.Table) -> pa.Table:
        c, count, p = known(table, order, False)
        add = lambda k, x: np.add.reduceat(x[c.gram[k]], c.first)
        n = len(c.docs)
        return pa.table({"doc_id": pa.array(c.docs, pa.int64()), "held_out": pa.array(c.held), "n_tokens": pa.array(c.lens), "n_known": pa.array(add(1, (count[1][0] > 0).astype(np.int64))), "train_tokens": pa.array([model.n] * n, pa.int64()), "base_score": pa.array(add(1, np.log10(p[1]))), "score": pa.array(add(order, np.log10(np.maximum(p[order], 1e-300))))})

    empty = ["cast(null as array<long>) as docs", "cast(null as array<long>) as lens", "cast(null as array<boolean>) as held", "cast(null as binary) as idx", "cast(null as binary) as vocab"]
    whole = corpus.selectExpr("chunk", "0 as kind", "0 as part", "cast(null as binary) as x", "cast(null as binary) as y", "docs", "lens", "held", "idx", "vocab")
    parts = {k: x.where("chunk >= 0").selectExpr("chunk", "kind", "part", "x", "y", *empty) for k, x in counted.items()}
    for k in range(2, order + 1):
        rows = functools.reduce(DataFrame.unionByName, [whole, *[x for j, x in parts.items() if j <= k or j > ROOM]])
        room = rows.groupBy("chunk").applyInArrow(ask_room(k), ASK).groupBy("bucket").applyInArrow(merged(ROOM + k, False), ANSWER)
        parts[ROOM + k] = scratch.save(room, compression="zstd").selectExpr("chunk", "kind", "part", "x", "y", *empty)
        scratch.release()
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return functools.reduce(DataFrame.unionByName, [whole, *parts.values()]).groupBy("chunk").applyInArrow(score, schema)
