"""Packing: first-fit decreasing on a tournament tree of bin capacities, in randomised groups of documents."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

LENGTH = 1024
#: Pieces that one packing task holds: bounds its memory, and is large enough for little padding.
GROUP = 8192
#: Outside these the two tokenizer libraries might class a character differently; such texts take the slower one.
PLAIN = re.compile("[\t\n\r -~¡-ɏͰ-ԯ‐-‧‰-⁞₠-₿ぁ-ゖァ-ヺ一-龥가-힣]*")
SPECIAL = "<|endoftext|>"
_loaded: dict = {}


def encoder(json_path: str, ranks_path: str | None, pattern: str | None):
    """text -> ids of the tokenizer in json_path, without special tokens added. Loaded once in each worker."""
    if (json_path, ranks_path) in _loaded:
        return _loaded[json_path, ranks_path]

    def exact(text: str) -> list[int]:
        if json_path not in _loaded:
            from tokenizers import Tokenizer

            _loaded[json_path] = Tokenizer.from_file(json_path)
        return _loaded[json_path].encode(text, add_special_tokens=False).ids

    encode = exact
    if ranks_path:
        import base64

        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> list[int]:
            return fast.encode_ordinary(text) if SPECIAL not in text and PLAIN.fullmatch(text) else exact(text)

    _loaded[json_path, ranks_path] = encode
    return encode


def pieces_of(ids: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of whole sequences, then of the rest."""
    raw = ids.astype("<u4").tobytes()
    return [(s, min(length, len(ids) - s), zlib.crc32(raw[4 * s : 4 * (s + length)])) for s in range(0, len(ids), length)]


class Tree:
    """A tournament over bin capacities: each node holds the largest capacity below it, so first fit is one descent."""

    def __init__(self, n: int, capacity: int):
        self.leaves = 1 << max(0, (n - 1).bit_length())
        self.most = [capacity] * (2 * self.leaves)

    def first_fit(self, size: int) -> tuple[int, int]:
        """The first bin with room for ``size``, and its room before; the room is taken."""
        most, k = self.most, 1
        while k < self.leaves:
            k += k
            if most[k] < size:
                k += 1
        room = most[k]
        most[k] = room - size
        leaf = k - self.leaves
        while k > 1:
            k >>= 1
            most[k] = max(most[2 * k], most[2 * k + 1])
        return leaf, room


def first_fit_decreasing(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item; items of equal size keep their order."""
    bins, offsets = np.zeros(len(sizes), "int64"), np.zeros(len(sizes), "int64")
    tree = Tree(len(sizes), length)
    for i in np.argsort(-sizes, kind="stable"):
        bins[i], room = tree.first_fit(int(sizes[i]))
        offsets[i] = length - room
    return bins, offsets


def pack(documents: DataFrame, json_path: str, ranks_path: str | None = None, pattern: str | None = None, length: int = LENGTH, group: int = GROUP, end: int = 0) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (all long).

    A document is its ids and then ``end``; a null or empty text is ``end`` alone. Whole sequences are cut off first
    and stand alone; the rests are packed in groups dealt by a hash of doc_id and place, so equal rows part too. Rows
    with the same doc_id are packed as documents of their own. An empty table gives no rows. Odd sequence ids are whole sequences, even ones mixed.
    """
    scratch = Scratch(documents.sparkSession, "op5")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(json_path, ranks_path, pattern)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, rows = batch.slice(at, 512), []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    ids = np.array([*encode(text.as_py() or ""), end])
                    rows += [(doc, s, n, crc, len(ids)) for s, n, crc in pieces_of(ids, length)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], names)

    pieces = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    pieces = scratch.save(pieces)
    whole = pieces.where(F.col("length") == length).select("*", (2 * F.monotonically_increasing_id() + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rests = pieces.where(F.col("length") < length)
    groups = max(1, -(-rests.count() // group))
    rests = rests.withColumn("g", F.pmod(F.xxhash64("doc_id", "ids_crc32", "length", F.monotonically_increasing_id()), F.lit(groups)))

    def fill(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = first_fit_decreasing(rows.column("length").to_numpy(), length)
        return rows.append_column("sequence_id", pa.array(2 * (bins + key[0].as_py() * (2 * group << 8)))).append_column("offset", pa.array(offsets)).drop_columns(["g"])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return whole.unionByName(rests.groupBy("g").applyInArrow(fill, schema))
