import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termloom.llm import centroids, merkle, sentencepieces

from .conftest import frame, prose


def by_id(df):
    return sorted(map(tuple, df.collect()), key=repr)


# ---- 11: SentencePiece


def model():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


ODD = ["", " ", "   ", "a", " a", "a ", "  a  b   ", "▁", "a▁b ▁ c", "a　b\xa0c", "\n\n\t x\r\n", "<s> </s> <unk> <0x0A>", "é é ß", "﻿a￿", "😀 ‍ x", "\x00 a\x00b", "中文字 かな 한글", "0123 4567", "x" * 3000, "ab" * 5000 + " " + "▁" * 40, "  ", "a  ▁ b", " " * 300 + "z", "\U0010ffff퟿"]


def direct(texts):
    sp = sentencepieces.processor(model())
    ids = [sp.encode(t or "") for t in texts]
    return [(list(i), sp.decode(i)) for i in ids]


def test_pieces_equal_the_library(spark, edges, edge_rows, corpus, nothing):
    odd = [(n, t, "en", "s") for n, t in enumerate(ODD)]
    for df, rows in ((edges, edge_rows), (frame(spark, corpus), corpus), (frame(spark, odd), odd)):
        got = by_id(sentencepieces.sentencepieces(df, model()))
        assert got == sorted(((r[0], *x) for r, x in zip(rows, direct([r[1] for r in rows]), strict=True)), key=repr)
    assert sentencepieces.sentencepieces(nothing, model()).count() == 0


def test_many_buckets(spark, corpus, monkeypatch):
    monkeypatch.setattr(sentencepieces, "SHARE", 700)
    got = by_id(sentencepieces.sentencepieces(frame(spark, corpus), model()))
    assert got == sorted(((r[0], *x) for r, x in zip(corpus, direct([r[1] for r in corpus]), strict=True)), key=repr)


def test_small_blocks(spark, corpus, monkeypatch):
    """Blocks of a few texts, gathered a few ids at a time, in this process."""
    import pyarrow as pa

    monkeypatch.setattr(sentencepieces, "BLOCK", 640)
    monkeypatch.setattr(sentencepieces.TaskContext, "get", lambda: type("T", (), {"partitionId": lambda self: 3})())
    rows = [(r[0], r[1]) for r in corpus]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["doc_id", "text"])
    blocks = list(sentencepieces.numbered(iter([batch.slice(0, 70), batch.slice(70)]), 3))
    assert len(blocks) > 20 and len({b.column("block")[0].as_py() for b in blocks}) == len(blocks)
    seen = []
    for b in blocks:
        held, asks = b.column("held")[0].as_py(), b.column("asks")[0].as_py()
        words = [w for a in asks for w in sentencepieces.unpacked_strings(a).to_pylist()]
        places = sentencepieces.unpacked(b.column("places")[0].as_py(), sum(h["n"] for h in held))
        assert len(set(words)) == len(words) and [a["bucket"] for a in asks] == sorted({a["bucket"] for a in asks})
        for h in held:
            seen.append((h["doc_id"], " ".join(words[p] for p in places[: h["n"]])))
            places = places[h["n"] :]
    assert sorted(seen) == rows


@settings(max_examples=200, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" ▁ab\n"), st.characters(exclude_categories=("Cs",))), max_size=60))
def test_chunks_are_independent(text):
    sp = sentencepieces.processor(model())
    made = [sp.encode(c) if c else [sp.piece_to_id(sentencepieces.MARK)] for c in sentencepieces.chunks(text)]
    assert [i for ids in made for i in ids] == sp.encode(text)
    assert "".join(" " + sp.decode(i) for i in made)[1:] == sp.decode(sp.encode(text))


# ---- 12: centroids


def lloyd(rows, k=16, rounds=3, dims=64):
    """Whole numbers only, a loop over everything."""
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: ("~" if r[0] is None else hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    cs = [v for _, v in sorted(kept, key=key)[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((dist(v, c), n) for n, c in enumerate(cs))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for c in range(len(cs)):
            mine = [v for (_, v), o in zip(kept, of, strict=True) if o == c]
            if mine:
                cs[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out = [(i, *near(v)) for i, v in kept]
    total = sum(d for _, d, _ in out)
    return sorted(((i, c, d, sum(e for _, e, b in out if b == c), total, cs[c]) for i, d, c in out), key=repr)


def vector_rows(rng, n, spread=1.0):
    middles = [[rng.gauss(0, spread) for _ in range(64)] for _ in range(5)]
    return [(i, [m + rng.gauss(0, 0.2 * spread) for m in rng.choice(middles)]) for i in range(n)]


VECTOR = "vec_id long, embedding array<double>, centroid string, cluster string, n string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(*r, "z", "z", "z") for r in rows], VECTOR).repartition(3)


@pytest.mark.parametrize("spread", [1.0, 1e-3, 1e5, 0.0])
def test_centroids(spark, spread):
    rows = vector_rows(random.Random(7), 150, spread)
    rows += rows[:9] + [(900, None), (901, [1.0] * 63), (902, [None] + [1.0] * 63), (903, [math.nan] * 64), (904, [math.inf] * 64), (905, []), (None, [0.5] * 64), (None, [-0.5] * 64), (906, [0.0] * 64), (906, [0.25] * 64)]
    got = by_id(centroids.centroid_clusters(vectors_of(spark, rows)))
    assert got == [tuple(r) for r in lloyd(rows)] and len(got) == 150 + 9 + 4


def test_few_and_no_centroids(spark):
    rows = vector_rows(random.Random(8), 5)
    assert by_id(centroids.centroid_clusters(vectors_of(spark, rows))) == lloyd(rows)
    assert centroids.centroid_clusters(vectors_of(spark, [])).count() == 0
    assert centroids.centroid_clusters(vectors_of(spark, [(1, None), (2, [1.0])])).count() == 0


def test_huge_components(spark):
    rows = [(i, [x] * 64) for i, x in enumerate([1e8, -1e8, 1e300, -1e300, 1.0, 1.5])]
    got = {r["vec_id"]: r for r in centroids.centroid_clusters(vectors_of(spark, rows), k=3, rounds=1).collect()}
    assert len(got) == 6 and all(0 <= r["distance"] <= r["cluster_inertia"] <= r["inertia"] <= 2**63 - 1 for r in got.values())


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 7), st.integers(1, 9), st.sampled_from([3, 1000, 10**6, 2**27, 2**40, 2**44]), st.integers(0, 10**6))
def test_screening_keeps_the_nearest(n, k, most, seed):
    """With many near ties, at any size of the components, the assignment is that of whole numbers."""
    rng = random.Random(seed)
    base = [rng.randrange(-most, most + 1) for _ in range(64)]
    near = lambda: [max(-most, min(most, b + rng.choice([0, 0, 0, 1, -1]))) for b in base]
    x, c = [near() for _ in range(n)], [near() for _ in range(k)]
    dist = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    want = [min((dist(v, w), j) for j, w in enumerate(c)) for v in x]
    got = centroids.assign(np.array(x, np.int64), np.array(c, np.int64))
    assert [(int(d), int(j)) for j, d in zip(*got, strict=True)] == want
    may = centroids.screen(np.array(x, np.int64), np.array(c, np.int64))
    assert all(may[i, j] for i, v in enumerate(x) for j, w in enumerate(c) if dist(v, w) == want[i][0])


def test_screening_decides():
    """Where centroids are apart, one is left."""
    rng = np.random.default_rng(1)
    x, c = rng.integers(-50, 50, (500, 64)), rng.integers(-50, 50, (16, 64))
    assert (centroids.screen(x, c).sum(axis=1) == 1).mean() > 0.95


# ---- 13: Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    doc, text, lang, source, n = row
    n = None if n is None else n + more
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(*map(part, (doc, source, lang, n, text)))


def tree(leaves):
    """(root, for each leaf its siblings with their sides)"""
    level, paths, place = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for i, p in enumerate(place):
            paths[i].append(("L" if p % 2 else "R") + level[p ^ 1] if p ^ 1 < len(level) else "")
        level = [h(*level[i : i + 2]) for i in range(0, len(level), 2)]
        place = [p // 2 for p in place]
    return (level[0] if level else None), paths


def fold(x, path):
    for p in path:
        x = h(x) if not p else h(p[1:], x) if p[0] == "L" else h(x, p[1:])
    return x


def manifest(rows):
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    groups = {v: sorted((r for r in rows if r[2] == v), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for v in langs}
    low = {v: tree([leaf(r) for r in g]) for v, g in groups.items()}
    root, high = tree([low[v][0] for v in langs])
    out = []
    for v, upper in zip(langs, high, strict=True):
        for r, path in zip(groups[v], low[v][1], strict=True):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            whole = path + upper
            got = fold(leaf(r, int(hit)), whole)
            out.append((r[0], leaf(r), low[v][0], root, h(*[p[1:] for p in whole]), got, got == root))
    return sorted(out, key=repr)


def found(df, height):
    made = merkle.merkle_manifest(df, {"tampered": merkle.tampered()}, height)
    made = made.select("doc_id", "leaf", "subroot", "root", merkle.proof_hash(F.col("path")).alias("p"), merkle.folded(F.col("tampered"), F.col("path")).alias("f"))
    return by_id(made.withColumn("v", F.col("f") == F.col("root")))


def whole(rows):
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


@pytest.mark.parametrize("height", [1, 2, 10])
def test_manifest(spark, edges, edge_rows, nothing, height):
    rng = random.Random(4)
    rows = [(i, prose(rng, 3), rng.choice(["en"] * 5 + ["", None, "é", "zz", "Z"]), rng.choice(["s", None])) for i in range(90)] + [(7, "one id", "en", "s"), (7, "one id again", "en", "s")] + [(8, "copy", "en", "s")] * 5
    got = found(frame(spark, rows), height)
    assert got == manifest(whole(rows)) and not all(r[-1] for r in got) and any(r[-1] for r in got)
    assert found(edges, height) == manifest(whole(edge_rows))
    assert found(nothing, height) == []


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8])
def test_manifest_of_one_lang(spark, n):
    rows = [(i, "t", None, None) for i in range(n)]
    assert found(frame(spark, rows), 1) == manifest(whole(rows))


@pytest.mark.parametrize("n", [*range(1, 40), 64, 100])
def test_traversal(n):
    """Every path, the stacks' bound and the steps' bound, for whole and ragged blocks under higher trees too."""
    leaves = [h(str(i)).encode() for i in range(n)]
    root, paths = tree([x.decode() for x in leaves])
    low = (n - 1).bit_length()
    assert [[p.decode() for p in path] for path in merkle.traverse(leaves, low)] == paths
    assert merkle.node(leaves, 0, low).node().decode() == root
    up = merkle.node(leaves, 0, low + 2).node().decode()
    assert up == h(h(root))
    for i, path in enumerate(merkle.traverse(leaves, low + 2)):
        assert fold(leaves[i].decode(), [p.decode() for p in path]) == up
    hash_ = merkle.Treehash(leaves, 0, low)
    while not hash_.stack or hash_.stack[0][0] < low:
        hash_.advance(1)
        assert len(hash_.stack) <= low + 1
