"""Each stage of the pipeline against brute force, and all of them over odd tables."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from termloom.llm import language, mixing

from .conftest import frame, prose
from .test_operators import brute_join, split

corpus_pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = corpus_pipeline.COLUMNS


def rows_of(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=repr)


def full(rows):
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


def test_language_stage(spark, edges, edge_rows):
    """What stays is what the codewords decide with a majority; nothing else of a row changes but a missing lang."""
    rng = random.Random(2)
    kinds = {"aa": "bdgk", "bb": "lmnr", "cc": "pqst"}
    text = lambda k, n=20: " ".join("".join(rng.choice(kinds[k]) + rng.choice("aeiou") for _ in range(3)) for _ in range(n))
    rows = [(i, text(k := list(kinds)[i % 3]), k if i % 7 else None, "s") for i in range(90)] + [(100, "12 34 --", "aa", "s"), (101, None, "bb", "s"), (102, "", None, "s"), (None, text("aa"), "aa", None), (5, text("bb"), "bb", "t")]
    df = frame(spark, rows)
    model = language.learn(df.where("lang is not null and text is not null").select("doc_id", "text", "lang"))
    want = []
    for r in full(rows):
        share = language.profile(r[1] or "")
        if share is not None:
            k, _, doubt = model.decode(share)
            if not doubt:
                want.append((r[0], r[1], r[2] or model.names[k], r[3], r[4]))
    assert len(want) == 92
    assert rows_of(corpus_pipeline.language(spark, df, "")) == sorted(want, key=repr)
    assert {r[0] for r in rows_of(corpus_pipeline.language(spark, edges, ""))}.isdisjoint({1, 2, 3, 9})


def test_near_copies_stage(spark, corpus):
    rng = random.Random(21)
    odd = [(None, corpus[5][1], "en", "s"), (None, corpus[5][1], "en", "s"), (7, prose(rng, 50), "en", "s"), (900, "", "en", "s"), (901, None, "en", "s"), (901, None, "en", "s")]
    rows = [*corpus, *odd]
    keyed = sorted(set(full(rows)), key=repr)
    groups = collections.defaultdict(list)
    for (n, _, component) in brute_join([(n, r[1], "", "") for n, r in enumerate(keyed) if r[0] is not None]):
        groups[component].append(keyed[n])
    got = rows_of(corpus_pipeline.near_copies(spark, frame(spark, rows), ""))
    with_id = [r for r in got if r[0] is not None]
    assert len(with_id) == len(groups) and len(got) - len(with_id) == 2
    for members in groups.values():
        kept = [r for r in members if r in with_id]
        assert len(kept) == 1 and kept[0][0] == min(m[0] for m in members)


def test_repeats_stage(spark, corpus, edge_rows):
    for rows in (corpus, edge_rows):
        count = collections.Counter()
        raws = [(r[1] or "").encode() for r in rows]
        for raw in raws:
            count.update(raw[i : i + 200] for i in range(len(raw) - 199))
        want = []
        for r, raw in zip(rows, raws, strict=True):
            gone = bytearray(len(raw))
            for i in range(len(raw) - 199):
                if count[raw[i : i + 200]] > 1:
                    gone[i : i + 200] = b"\1" * 200
            rest = bytes(c for c, g in zip(raw, gone, strict=True) if not g).decode("utf-8", "ignore")
            if not any(gone):
                want.append((r[0], r[1] or "", *r[2:4], None if r[1] is None else len(r[1])))
            elif split(rest):
                want.append((r[0], rest, *r[2:4], len(rest)))
        assert rows_of(corpus_pipeline.repeats(spark, frame(spark, rows), "")) == sorted(want, key=repr)


def test_mixing_stage(spark, corpus):
    rows = [*corpus, *[(500, prose(random.Random(1), 30), "en", "s0")] * 40, (None, prose(random.Random(2), 30), "en", "s0")]
    got = collections.Counter(rows_of(corpus_pipeline.mixed(spark, frame(spark, rows), "")))
    times = collections.Counter(full(rows))
    assert set(got) <= set(times) and all(n <= 3 * times[r] for r, n in got.items())
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(split(r[1]))
    names = sorted(sizes)
    targets = dict(zip(names, mixing.share_out([sizes[n] for n in names], [k % 3 + 1 for k in range(len(names))], 3), strict=True))
    taken = collections.Counter()
    for r, n in got.items():
        taken[r[3]] += n * len(split(r[1]))
    assert all(abs(taken[n] - targets[n]) <= max(30, 0.02 * targets[n]) for n in names)


def test_run(spark, tmp_path, edges, corpus, nothing):
    pytest.importorskip("public_tokenizers")
    for name, df, least in (("odd", edges, 5), ("all", frame(spark, corpus), 100), ("none", nothing, 0)):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        pieces = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert len(pieces) >= least
        filled = collections.defaultdict(list)
        for p in pieces:
            filled[p["sequence_id"]].append((p["offset"], p["length"]))
        for parts in filled.values():
            end = 0
            for offset, length in sorted(parts):
                assert offset == end
                end += length
            assert end <= 1024
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "repeats", "mixing", "packing"]
