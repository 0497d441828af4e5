"""SentencePiece encoding and decoding by a table of distinct chunks: each marked word is segmented once for all texts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

pa.set_memory_pool(pa.system_memory_pool())  # it gives freed memory back
MARK = "▁"
#: A chunk is a run of markers and what follows up to the next one; every text begins with a marker.
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Texts of about this many bytes form a block with chunk numbers of its own; a longer text is one by itself.
BLOCK = 1 << 23
#: Bytes of text for which there is one bucket of chunks: what a task holds of all blocks' chunks at once.
SHARE = 1 << 24
#: Ids that are gathered at once.
GATHER = 1 << 20
_loaded: dict = {}


def processor(model: str):
    """The model, loaded once in each worker. Chunks are independent only if no piece goes on past a marker and texts are taken as they are."""
    if model not in _loaded:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model)
        across = [p for p in map(sp.id_to_piece, range(sp.get_piece_size())) if MARK in p.lstrip(MARK)]
        if across or sp.encode("") or sp.normalize(" a  \nﬁ　 ") != f"{MARK}{MARK}a{MARK}{MARK}\nﬁ　{MARK}":
            raise ValueError(f"the pieces of {model} cross white space markers, or it changes texts before it cuts them")
        _loaded[model] = sp
    return _loaded[model]


def chunks(text: str) -> list[str]:
    """The chunks of a text, each without its first marker."""
    return [c[1:] for c in CHUNK.findall(MARK + text.replace(" ", MARK))] if text else []


def cut_texts(texts: pa.Array) -> tuple[np.ndarray, pa.ListArray]:
    """(order, chunks): texts in another order, and the chunks of each. Where no two markers meet, and none starts a
    text, a chunk is what lies between two spaces."""
    odd = pc.fill_null(pc.match_substring_regex(texts, f"^$|^ |  |{MARK}"), True)
    rest, few = np.flatnonzero(~np.asarray(odd)), np.flatnonzero(np.asarray(odd))
    plain = pc.split_pattern(texts.take(pa.array(rest)), " ")
    slow = pa.array([chunks(t or "") for t in texts.take(pa.array(few)).to_pylist()], pa.list_(pa.string()))
    return np.r_[rest, few], pa.concat_arrays([plain.cast(slow.type), slow])


def squeezed(data: bytes) -> bytes:
    return pa.Codec("zstd", compression_level=5).compress(data, asbytes=True)


def packed(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, byte by byte of significance, compressed."""
    return squeezed(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpacked(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(raw.T).view("<u4").ravel()


#: Chunks of a block that lie in one bucket: how many, their lengths in bytes, their bytes.
ASKS = pa.list_(pa.struct([("bucket", pa.int32()), ("n", pa.int64()), ("lengths", pa.binary()), ("size", pa.int64()), ("words", pa.binary())]))


def strings(words: pa.Array) -> dict:
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = words.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0])) if words.buffers()[2] else b""
    return {"lengths": packed(np.diff(offsets)), "size": len(data), "words": squeezed(data)}


def unpacked_strings(row: dict) -> pa.Array:
    offsets = np.r_[0, np.cumsum(unpacked(row["lengths"], row["n"]))].astype(np.int32)
    return pa.StringArray.from_buffers(row["n"], pa.py_buffer(offsets), pa.decompress(row["words"], row["size"], "zstd"))


def numbered(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """(row, text) -> a row for each block: its rows, their numbers of chunks, the chunks' numbers in order of the texts,
    and the distinct chunks by bucket. A chunk's number is its place in order of bucket and text."""
    rows, size, at = [], 0, TaskContext.get().partitionId() << 33

    def block() -> pa.RecordBatch:
        ids, texts = (pa.concat_arrays([r.column(i) for r in rows]) for i in (0, 1))
        order, lists = cut_texts(texts)
        coded = lists.flatten().dictionary_encode()
        bucket = np.array([crc32(c.encode()) % buckets for c in coded.dictionary.to_pylist()], np.int32)
        by = pc.sort_indices(pa.table({"b": bucket, "c": coded.dictionary}), [("b", "ascending"), ("c", "ascending")]).to_numpy()
        rank = np.empty(len(by), np.uint32)
        rank[by] = np.arange(len(by))
        held = pa.StructArray.from_arrays([ids.take(pa.array(order)), pa.array(np.diff(np.asarray(lists.offsets)).astype(np.int64))], ["doc_id", "n"])
        words, bucket = coded.dictionary.take(pa.array(by)), bucket[by]
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else [0]
        asks = [{"bucket": int(bucket[a]), "n": int(z - a), **strings(words.slice(a, z - a))} for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
        one = pa.ListArray.from_arrays([0, len(held)], held)
        return pa.RecordBatch.from_arrays([pa.array([at]), one, pa.array([packed(rank[coded.indices.to_numpy()])], pa.binary()), pa.array([asks], ASKS)], ["block", "held", "places", "asks"])

    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
        first = 0
        while first < batch.num_rows:
            last = first + max(1, int(np.searchsorted(np.cumsum(lengths[first:]), BLOCK - size, "right")))
            rows.append(batch.slice(first, last - first))
            size, first = size + int(lengths[first:last].sum()), last
            if size >= BLOCK or first < batch.num_rows:
                yield block()
                rows, size, at = [], 0, at + 1
    if rows:
        yield block()


def answer(sp, asks: list[dict]) -> pa.RecordBatch:
    """What all blocks ask of one bucket -> for each block the ids of its chunks, in their order. Equal chunks are segmented once."""
    coded = pa.concat_arrays([unpacked_strings(r) for r in asks]).dictionary_encode()
    lists = []
    for at in range(0, len(coded.dictionary), 1 << 16):
        ids = sp.encode(coded.dictionary.slice(at, 1 << 16).to_pylist())  # the model puts the first marker back
        lists.append(pa.array([i or [sp.piece_to_id(MARK)] for i in ids], pa.list_(pa.int32())))
    table, numbers, rows, at = pa.concat_arrays(lists), coded.indices.to_numpy(), [], 0
    for r in asks:
        lengths, ids = gathered(table, numbers[at : at + r["n"]])
        rows.append((r["block"], r["bucket"], r["n"], len(ids), packed(lengths), squeezed(ids.astype(width_of(sp)).tobytes())))
        at += r["n"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["block", "bucket", "n", "n_ids", "lengths", "ids"])


def width_of(sp) -> str:
    return "<u2" if sp.get_piece_size() <= 1 << 16 else "<u4"


def gathered(lists: pa.ListArray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, values) of the lists at these places, one after the other."""
    starts = np.asarray(lists.offsets).astype(np.int64)
    lengths = np.diff(starts)[places]
    ends = np.cumsum(lengths)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[places] - ends + lengths, lengths)
    return lengths, np.asarray(lists.values)[at]


def surfaces(sp) -> list[bytes]:
    """What each id decodes to: a byte, or the piece with spaces for markers."""
    piece = lambda i: bytes([int(sp.id_to_piece(i)[1:-1], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else sp.id_to_piece(i).replace(MARK, " ").encode()
    return [piece(i) for i in range(sp.get_piece_size())]


def bucketed(df: DataFrame, scratch: Scratch, column: str) -> DataFrame:
    """``df`` written in buckets by ``column``, so that a join on it moves the other side only. The files stay, no name does."""
    spark = df.sparkSession
    name = f"pieces_{scratch.root.rpartition('-')[2]}"
    df.write.option("path", f"{scratch.root}/{name}").option("compression", "zstd").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), column).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"drop table {name}")
    return out


def sentencepieces(documents: DataFrame, model: str) -> DataFrame:
    """doc_id, ids (array<int>), decoded: each text as the model encodes it, without begin and end, and these ids decoded.

    A null or empty text has no ids and decodes to an empty text. Repeated rows have a row each, a null doc_id is one
    like any other. An empty table gives no rows. A text of any length is one row; without white space it is one
    chunk. Columns of other names are not read, whatever these are.

    Blocks of texts give numbers to their distinct chunks and keep the texts as these numbers. The distinct chunks of
    all blocks meet in buckets, as many as the texts are long; there each is segmented once, and what a block asked for
    goes back to it. The blocks themselves are written in buckets of a join and never shuffled.
    """
    scratch = Scratch(documents.sparkSession, "op11")
    processor(model)
    kind = documents.schema["doc_id"].dataType.simpleString()
    total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = -(-total // SHARE) or 1
    schema = f"block long, held array<struct<doc_id:{kind},n:long>>, places binary, asks array<struct<bucket:int,n:long,lengths:binary,size:long,words:binary>>"
    blocks = bucketed(documents.select("doc_id", "text").mapInArrow(lambda batches: numbered(batches, buckets), schema), scratch, "block")
    asked = blocks.select("block", F.explode("asks").alias("a")).select("block", "a.*")

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, held = processor(model), []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[-1]["bucket"] != row["bucket"]:
                    yield answer(sp, held)
                    held = []
                held.append(row)
        if held:
            yield answer(sp, held)

    answers = asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(segment, "block long, bucket int, n long, n_ids long, lengths binary, ids binary")
    answers = answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "n_ids", "lengths", "ids"))).alias("parts"))

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(model)
        surface, width = surfaces(sp), np.dtype(width_of(sp))
        for batch in batches:
            for row in (batch.slice(n, 1) for n in range(batch.num_rows)):
                held, parts = row.column("held").flatten(), row.column("parts")[0].as_py() or []
                lengths = np.concatenate([unpacked(p["lengths"], p["n"]) for p in parts] or [np.zeros(0, np.int64)]).astype(np.int64)
                values = np.concatenate([np.frombuffer(pa.decompress(p["ids"], p["n_ids"] * width.itemsize, "zstd"), width) for p in parts] or [np.zeros(0, width)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), pa.array(values))
                size = held.field("n").to_numpy()
                places = unpacked(row.column("places")[0].as_py(), int(size.sum()))
                ends, first = np.cumsum(size), 0
                while first < len(size):
                    low = int(ends[first] - size[first])
                    last = max(first + 1, int(np.searchsorted(ends, low + GATHER, "right")))
                    lengths, values = gathered(lists, places[low : ends[last - 1]])
                    cuts = np.r_[0, np.cumsum(lengths)][np.r_[0, ends[first:last] - low]]
                    every = values.tolist()
                    texts = [b"".join([surface[i] for i in every[a:z]])[1:].decode() for a, z in zip(cuts[:-1], cuts[1:], strict=True)]  # without the first marker
                    yield pa.RecordBatch.from_arrays([held.field("doc_id").slice(first, last - first), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values)), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])
                    first = last

    whole = blocks.drop("asks").join(answers, "block", "left")
    return whole.mapInArrow(assembled, f"doc_id {kind}, ids array<int>, decoded string")
