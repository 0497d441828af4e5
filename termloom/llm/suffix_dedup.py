"""Suffix-array dedup: bytes covered by a 200-byte string that starts anywhere else, found by column-wise suffix sorting.

Sorting the suffixes of all texts column by column takes as many rounds as the longest text has bytes, over the whole
collection each time. So texts first give up their anchors: of the k-byte substrings in each 200-byte string the one
with the least hash, and equal strings have equal anchors at equal places. Around anchors that occur again, the text
up to 200 bytes is a short document, and the anchor itself, known to be equal, is one symbol of it. Such collections
are built column-wise: each round inserts one symbol per document, merging the new suffixes into the collection's
order by the Burrows-Wheeler transform; then rounds over the finished transform find where neighbours differ within
the wanted length. A suffix that agrees with a neighbour that far is a repeated string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .words import chunks, mixed, powers, texts

LENGTH = 200
#: Bytes of an anchor: longer ones are rarer matches, shorter ones fewer.
ANCHOR = 150
#: Short documents whose suffixes one collection sorts, and places of an anchor that one task holds. Anchors with more
#: places are hot: their contexts are counted first, and groups of contexts are split by what members must agree in.
COLLECTION = 3000
#: Parts that the range of a group of contexts is split into.
SPLIT = 8
#: Up to so many keys (8 or 16 bytes each) are broadcast; more meet the texts by shuffle.
BROADCAST_KEYS = 500_000

#: No symbol is this: a string's end, seen from its first suffix.
CLOSED = np.uint16(0xFFFF)

BYTES = mixed(np.arange(256, dtype=np.uint64) + np.uint64(0xABCDEF))


def sliding(x: np.ndarray, width: int, better) -> np.ndarray:
    """better(x[i], ..., x[i + width - 1]) for every full window."""
    out, have = x, 1
    while 2 * have <= width:
        out = better(out[: len(out) - have], out[have:])
        have *= 2
    rest = width - have
    return better(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of all windows of ``length`` bytes within one text; texts stand end to end."""
    n, w = len(data), length - k + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    power, inverse = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTES[data] * power[:n], out=sums[1:])
    h = mixed((sums[k:] - sums[:-k]) * inverse[: n + 1 - k]) | np.uint64(1)  # 0 is kept for windows across texts
    least = sliding(h, w, np.minimum)  # of the window starting at s
    for end in offsets[1:-1]:
        least[max(0, end - length + 1) : end] = 0
    padded = np.concatenate((np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)))
    chosen = np.flatnonzero(sliding(padded, w, np.maximum) == h)
    return chosen, h[chosen]


def column_wise(strings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffix order of a collection of uint16 symbol strings, each ended by a terminator of its own.

    Returns (string, suffix length, first symbol, place of the suffix without its first symbol) in suffix order; the
    terminators come first, in string order.
    """
    n, most = len(strings), max(map(len, strings))
    column = np.full((n, most + 1), CLOSED, np.uint16)  # symbol before the suffix of that length
    for i, s in enumerate(strings):
        column[i, : len(s)] = s[::-1]
    column = column.ravel()
    ends = np.arange(n, dtype=np.int32) * np.int32(most + 1)
    suffix = ends  # in order, each as its string's row and its length
    while True:
        before = column[suffix]  # the transform, with this round's symbols filled in
        open_ = np.flatnonzero(before != CLOSED).astype(np.int32)
        order = open_[np.argsort(before[open_], kind="stable")]
        if n + len(order) == len(suffix):
            symbols = np.concatenate((np.full(n, -1, np.int32), before[order].astype(np.int32)))
            return suffix // (most + 1), suffix % (most + 1), symbols, np.concatenate((np.arange(n, dtype=np.int32), order))
        suffix = np.concatenate((ends, suffix[order] + np.int32(1)))


def repeated(strings: list[np.ndarray], width: int) -> list[np.ndarray]:
    """For each string the places where a suffix starts that shares ``width`` symbols with another suffix."""
    which, size, symbol, rest = column_wise(strings)
    n = len(strings)
    edge = np.ones(len(which) + 1, bool)  # whether a suffix differs from the one before it, within the rounds so far
    edge[n + 1 : -1] = symbol[n + 1 :] != symbol[n:-1]
    first, here, above = edge.copy(), rest[n + 1 :], rest[n:-1]
    for _ in range(width - 1):
        upto = np.cumsum(edge, dtype=np.int32)
        edge[n + 1 : -1] = first[n + 1 : -1] | (upto[here] > upto[above])
    again = np.flatnonzero(~edge[:-1] | ~edge[1:])
    again = again[again >= n]
    lengths = np.array([len(s) for s in strings])
    start = lengths[which[again]] - size[again]
    order = np.lexsort((start, which[again]))
    cut = np.searchsorted(which[again][order], np.arange(1, n))
    return np.split(start[order], cut)


def solve(groups: list[list[tuple[bytes, bytes]]], width: int) -> list[list[np.ndarray]]:
    """For each group of distinct (left, right) contexts of one anchor, the repeated starts of each, as columns of left."""
    strings = [np.concatenate((np.frombuffer(a, np.uint8).astype(np.uint16), [256 + g], np.frombuffer(b, np.uint8))).astype(np.uint16) for g, group in enumerate(groups) for a, b in group]
    found, out, at = repeated(strings, width), [], 0
    for group in groups:
        out.append(found[at : at + len(group)])
        at += len(group)
    return out


def places_of(marks: pa.Scalar) -> Iterator[tuple[int, int]]:
    """(h, place) of a text's marks, each an anchor with its first place and, if it has more, a list of those."""
    hs, ats = (marks.values.field(c).to_pylist() for c in ("h", "at"))
    if marks.values.field("more").null_count == len(hs):
        yield from zip(hs, ats, strict=True)
        return
    for h, at, more in zip(hs, ats, marks.values.field("more").to_pylist(), strict=True):
        yield h, at
        for at in more or ():
            yield h, at


def by_keys(table: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    """``table`` with or without the rows of these keys; the keys are broadcast if they are few."""
    return table.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, on, how)


def hot_spans(hot: DataFrame, documents: DataFrame, scratch: Scratch, length: int, k: int) -> DataFrame:
    """(key, found array<struct<start, end>>) around anchors with many places. hot: h, key, at, more.

    Equal contexts of a text and then of all texts become one row with a count before anything goes by anchor. Where
    a context has several places, all of it repeats. Others must share a string with another context of the anchor:
    i bytes of it to the left and width - 1 - i to the right. A group is an anchor and a range of i with the bytes
    that every such string has; one that is too large is split into parts of its range.
    """
    width = length - k + 1
    hot = hot.groupBy("key").agg(F.collect_list(F.struct("h", "at", "more")).alias("marks"))
    texts_ = by_keys(documents.select("key", "text"), hot.select("key"), ["key"], "left_semi").join(hot, "key")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, marks in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                raw, places = text.as_py().encode(), {}
                for h, at in places_of(marks):
                    places.setdefault((h, raw[max(0, at - width + 1) : at], raw[at + k : at + k + width - 1]), []).append(at)
                rows = [(h, xxhash.xxh3_64_intdigest(a + b, seed=len(a)) >> 1, key, at, a, b) for (h, a, b), at in places.items()]
                for lo in range(0, len(rows), 4096):
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[lo : lo + 4096], strict=True), kinds, strict=True)], ["h", "c", "key", "at", "a", "b"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by g: the first and last repeated start of each context of a group, the groups taken together."""
        groups: list[list[tuple]] = []
        last, size = None, 0

        def finish() -> pa.RecordBatch:
            found = solve([[(a, b) for *_, a, b in g] for g in groups], width) if groups else []
            out = [(h, c, int(starts[0]), int(starts[-1])) for g, each in zip(groups, found, strict=True) for (h, c, n, _, _), starts in zip(g, each, strict=True) if n == 1 and len(starts)]
            groups.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["h", "c", "first", "last"])

        for batch in batches:
            for g, *row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if g != last:
                    if size >= COLLECTION:
                        yield finish()
                        size = 0
                    groups.append([])
                    last = g
                groups[-1].append(tuple(row))
                size += 1
        if groups:
            yield finish()

    places = scratch.save(texts_.mapInArrow(contexts, "h long, c long, key long, at array<int>, a binary, b binary"), compression="zstd")
    kinds = scratch.save(places.groupBy("h", "c").agg(F.sum(F.size("at")).alias("n"), F.first("a").alias("a"), F.first("b").alias("b")))
    left, right = F.length("a"), F.length("b")
    decided = kinds.where("n > 1").select("h", "c", F.lit(0).alias("first"), F.least(left, left + 1 + right - width).alias("last")).where("last >= 0")
    level = kinds.select(F.col("h").alias("g"), F.lit(0).alias("lo"), F.lit(width - 1).alias("hi"), "h", "c", "n", "a", "b")
    while True:
        sizes = scratch.save(level.groupBy("g").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1").select("g", "m"))
        level = level.join(sizes, "g")
        fits = scratch.save(level.where(F.col("m") <= COLLECTION).select("g", "h", "c", "n", "a", "b").repartition("g").sortWithinPartitions("g").mapInArrow(search, "h long, c long, first int, last int"))
        whole = level.where((F.col("m") > COLLECTION) & (F.col("lo") == F.col("hi")) & (F.col("n") == 1)).select("h", "c", (left - F.col("lo")).alias("first"), (left - F.col("lo")).alias("last"))
        decided = decided.union(fits).union(whole)
        if sizes.where(F.col("m") > COLLECTION).isEmpty():
            break
        span = F.col("hi") - F.col("lo") + 1
        cut = lambda i: (F.col("lo") + F.floor(span * i / SPLIT)).cast("int")
        parts = F.filter(F.array(*[F.struct(cut(i).alias("lo"), (cut(i + 1) - 1).alias("hi")) for i in range(SPLIT)]), lambda x: x["lo"] <= x["hi"])
        level = level.where((F.col("m") > COLLECTION) & (F.col("lo") < F.col("hi"))).withColumn("part", F.explode(parts)).select("h", "c", "n", "a", "b", "part.lo", "part.hi")
        level = level.where((left >= F.col("lo")) & (right >= width - 1 - F.col("hi")))
        level = scratch.save(level.select(F.xxhash64("h", "lo", F.expr("right(hex(a), 2 * lo)"), F.expr(f"left(hex(b), 2 * ({width - 1} - hi))")).alias("g"), "lo", "hi", "h", "c", "n", "a", "b"))
        if level.isEmpty():
            break
    # Starts of a context are less than a string apart, so from the first to the last all is one run.
    decided = decided.groupBy("h", "c").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    around = places.select("h", "c", "key", "at", F.length("a").alias("left")).join(decided, ["h", "c"])
    run = lambda at: F.struct((at - F.col("left") + F.col("first")).alias("start"), (at - F.col("left") + F.col("last") + length).alias("end"))
    return scratch.save(around.groupBy("key").agg(F.flatten(F.collect_list(F.transform("at", run))).alias("found")))


def spans(documents: DataFrame, scratch: Scratch, length: int = LENGTH, k: int = ANCHOR) -> DataFrame:
    """(key, found array<struct<start, end>>) of repeated strings, merged around each anchor. documents: key long (one for
    each text), text."""
    width = length - k + 1

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column(1))
            keys = batch.column(0).to_numpy()
            for i, j in chunks(offsets):
                part = offsets[i : j + 1] - offsets[i]
                at, h = anchors(data[offsets[i] : offsets[j]], part, length, k)
                row = np.searchsorted(part, at, side="right") - 1
                # An anchor that a text has again and again is one row with a list.
                order = np.lexsort((h, row))
                h, row, at = h[order], row[order], (at - part[row])[order].astype(np.int32)
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                first = np.flatnonzero(new)
                ends = np.concatenate(([0], np.cumsum(np.diff(np.append(first, len(h))) - 1))).astype(np.int32)
                more = pa.ListArray.from_arrays(ends, pa.array(at[~new]), mask=pa.array(ends[1:] == ends[:-1]))
                yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(keys[i:j][row[first]]), pa.array(at[first]), more], ["h", "key", "at", "more"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by h: rows whose h has another place, and whether it has more than COLLECTION of them."""
        held: list[pa.RecordBatch] = []  # the last h's rows, if its places are few so far
        warm = None  # the last h, if its places are many

        def chosen(rows: pa.RecordBatch, places: np.ndarray) -> pa.RecordBatch:
            hot = (places > COLLECTION) | (rows.column(0).to_numpy() == warm if warm is not None else False)
            keep = pa.array((places > 1) | hot)
            return pa.RecordBatch.from_arrays([*(c.filter(keep) for c in rows.columns), pa.array(hot).filter(keep)], ["h", "key", "at", "more", "hot"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.concat_batches([*held, batch])
            h = rows.column(0).to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]))
            places = np.add.reduceat(1 + rows.column(3).value_lengths().fill_null(0).to_numpy(), cuts[:-1])
            many = places[-1] > COLLECTION or h[-1] == warm
            done = len(h) if many else int(cuts[-2])
            yield chosen(rows.slice(0, done), np.repeat(places, np.diff(cuts))[:done])
            warm = h[-1] if many else None
            held = [] if many else [rows.slice(done)]
            last = places[-1]
        if held:
            yield chosen(held[0], np.full(held[0].num_rows, last))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, text, marks in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                raw = text.as_py().encode()
                for h, at in places_of(marks):
                    low = max(0, at - width + 1)
                    left, right = raw[low:at], raw[at + k : at + k + width - 1]
                    out.append((h, xxhash.xxh3_64_intdigest(left + right, seed=len(left)) >> 1, key, at, left, right))
                while len(out) >= 4096:
                    yield packed(out[:4096])
                    out = out[4096:]
            yield packed(out)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [()] * 6, kinds, strict=True)], ["h", "c", "key", "at", "a", "b"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by h and c, the hash of a context. Where all contexts of an anchor are one, all of it repeats; other
        groups go into collections, each distinct context once."""
        held: list[tuple[list[tuple[bytes, bytes]], list[tuple[np.ndarray, np.ndarray]]]] = []
        size = 0

        def rows(keys: list[np.ndarray], starts: list[np.ndarray], ends: list[np.ndarray]) -> pa.RecordBatch:
            parts = ((keys, pa.int64()), (starts, pa.int32()), (ends, pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], t) for x, t in parts], ["key", "start", "end"])

        def finish() -> pa.RecordBatch:
            nonlocal held, size
            out: tuple[list, list, list] = ([], [], [])
            for (group, places), found in zip(held, solve([g for g, _ in held], width), strict=True):
                for (a, b), (keys, at), starts in zip(group, places, found, strict=True):
                    if len(keys) > 1:
                        starts = np.arange(min(len(a), len(a) + 1 + len(b) - width) + 1)
                    if len(starts):  # neighbouring starts are less than a string apart, so their strings are one run
                        out[0].append(keys)
                        out[1].append(at - len(a) + starts[0])
                        out[2].append(at - len(a) + starts[-1] + length)
            held, size = [], 0
            return rows(*out)

        def whole(table: pa.Table) -> Iterator[pa.RecordBatch]:
            """Complete groups."""
            nonlocal size
            h, c, key, at = (table.column(i).to_numpy() for i in range(4))
            new = np.concatenate(([True], h[1:] != h[:-1]))
            other = new | np.concatenate(([True], c[1:] != c[:-1]))
            first = np.flatnonzero(new)
            kinds = np.add.reduceat(other.astype(np.int64), first)
            sizes = np.diff(np.concatenate((first, [len(h)])))
            left, right = (pc.binary_length(table.column(i)).to_numpy() for i in (4, 5))
            one = np.repeat((kinds == 1) & (sizes > 1), sizes) & (left + right + k >= length)
            yield rows([key[one]], [(at - left)[one]], [(at + k + right)[one]])
            for g in np.flatnonzero(kinds > 1).tolist():
                lo, hi = first[g], first[g] + sizes[g]
                cuts = (lo + np.flatnonzero(other[lo:hi])).tolist()
                group = [(table.column(4)[i].as_py(), table.column(5)[i].as_py()) for i in cuts]
                held.append((group, [(key[i:j], at[i:j]) for i, j in zip(cuts, [*cuts[1:], hi], strict=True)]))
                size += len(group)
                if size >= COLLECTION or len(held) >= 60_000:
                    yield finish()

        carry: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            h = batch.column(0).to_numpy()
            edges = np.flatnonzero(h[1:] != h[:-1]) + 1
            if carry and h[0] != carry[-1].column(0)[-1].as_py():
                yield from whole(pa.Table.from_batches(carry).combine_chunks())
                carry = []
            if len(edges):
                yield from whole(pa.Table.from_batches([*carry, batch.slice(0, edges[-1])]).combine_chunks())
                carry = []
            carry.append(batch.slice(edges[-1] if len(edges) else 0))
        if carry:
            yield from whole(pa.Table.from_batches(carry).combine_chunks())
        if held:
            yield finish()

    marks = documents.select("key", "text").mapInArrow(mark, "h long, key long, at int, more array<int>")
    shared = scratch.save(marks.repartition("h").sortWithinPartitions("h").mapInArrow(again, "h long, key long, at int, more array<int>, hot boolean"), compression="zstd")
    scratch.release()
    by_text = shared.where("not hot").groupBy("key").agg(F.collect_list(F.struct("h", "at", "more")).alias("marks"))
    once = documents.select("key", "text").join(by_text, "key")
    around = once.mapInArrow(contexts, "h long, c long, key long, at int, a binary, b binary")
    found = scratch.save(around.repartition("h").sortWithinPartitions("h", "c").mapInArrow(search, "key long, start int, end int"), compression="zstd")
    scratch.release()
    found = found.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    hot = shared.where("hot").drop("hot")
    if not hot.isEmpty():
        both = found.union(hot_spans(hot, documents, scratch, length, k))
        found = both.groupBy("key").agg(F.flatten(F.collect_list("found")).alias("found"))
    scratch.drop(shared)
    return found


def suffix_dedup(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",), length: int = LENGTH, k: int = ANCHOR, as_text: bool = False) -> DataFrame:
    """``keep``, n_bytes, removed array<struct<start, end>> (maximal runs, in bytes), rest binary, for every document.
    With ``as_text`` rest is a string, without characters of which a part went.

    Texts are UTF-8 bytes; a null text is empty. A byte goes if any ``length`` bytes that cover it start anywhere else
    too, overlapping or in the same text included, judged on the input; so all copies go. Equal texts are copies of
    each other whatever their ids, null ids included: all of them goes, and one of them stands for all in the search.
    Empty or short texts keep everything; an empty table gives no rows.
    """
    scratch = Scratch(documents.sparkSession, "op10")
    keyed = documents.select(*keep, F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    keyed = keyed.withColumn("key2", F.xxhash64(F.lit(1), "text"))
    pair = ["key", "key2"]
    twice = scratch.save(keyed.select(pair).groupBy(pair).agg(F.count("*").alias("times")).where("times > 1").select(pair))
    single = by_keys(keyed, twice, pair, "left_anti")
    several = by_keys(keyed, twice, pair, "left_semi")
    one_each = scratch.save(several.select(*pair, "text").where(F.octet_length("text") >= length).dropDuplicates(pair).select("key", "text"), compression="zstd")
    by_text = spans(single.select("key", "text").union(one_each), scratch, length, k)
    everything = F.when(F.octet_length("text") >= length, F.array(F.struct(F.lit(0).alias("start"), F.octet_length("text").alias("end"))))
    n = len(keep)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sizes, removed, rests = [], [], []
                for text, marks in zip(part.column(n), part.column(n + 1).to_pylist(), strict=True):
                    raw, runs = text.as_py().encode(), []
                    for m in sorted(marks or (), key=lambda m: (m["start"], m["end"])):
                        if runs and m["start"] <= runs[-1]["end"]:
                            runs[-1]["end"] = max(runs[-1]["end"], m["end"])
                        else:
                            runs.append(dict(m))
                    edges = [0, *(x for r in runs for x in (r["start"], r["end"])), len(raw)]
                    sizes.append(len(raw))
                    removed.append(runs)
                    rests.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(n)), pa.array(sizes, pa.int64()), pa.array(removed, kind), pa.array([r.decode("utf-8", "ignore") for r in rests], pa.string()) if as_text else pa.array(rests, pa.binary())], [*keep, "n_bytes", "removed", "rest"])

    kept = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    columns = [F.col(f"`{c}`") for c in keep]
    whole = single.join(by_text, "key", "left").select(*columns, "text", "found").union(several.select(*columns, "text", everything.alias("found")))
    return whole.mapInArrow(cut, f"{kept}, n_bytes long, removed array<struct<start: long, end: long>>, rest {'string' if as_text else 'binary'}")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 from the result of ``suffix_dedup``."""
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("rest", 256).alias("kept_sha256"))


