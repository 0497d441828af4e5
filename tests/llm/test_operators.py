import collections
import functools
import hashlib
import math
import pickle
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termloom.llm import embedding_dedup as caps
from termloom.llm import html_extraction as pages
from termloom.llm import jaccard_join as join
from termloom.llm import katz, language, mixing, packing, quality_classifier, quality_rules, stats, suffix_dedup, words

from .conftest import WORDS, frame, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def held(doc, modulus):
    return -1 if doc is None else zlib.crc32(str(doc).encode()) % modulus


def by_id(df):
    return sorted(map(tuple, df.collect()), key=repr)


# ---- 1: statistics and rules


def base(text):
    w, seen, again = split(text), set(), 0
    for line in (text or "").split("\n"):
        if split(line):
            again += line in seen
            seen.add(line)
    windows = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), again, len(covered)


def test_statistics(spark, edges, edge_rows, corpus):
    for df, rows in ((edges, edge_rows), (frame(spark, corpus), corpus)):
        got = by_id(stats.statistics(df).select("doc_id", *stats.BASE))
        assert got == sorted(((r[0], *base(r[1])) for r in rows), key=repr)


def test_quality_rules(spark, edges, nothing, labels):
    got = quality_rules.quality_rules(edges, labels).collect()
    assert len(got) == 15 and all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in got)
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert quality_rules.quality_rules(nothing, labels).count() == 0
    assert quality_rules.quality_rules(edges, labels.limit(0)).where("rule > 0").count() == 0


def test_rules_learn(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, 80) if i % 3 else " | ".join(prose(rng, 80).split()), "en", "s") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(frame(spark, rows), labels).collect()}
    assert all(got[i] == (i % 3 > 0) for i in range(300))


def test_tallies(spark):
    df = spark.createDataFrame([(float(i % 7), i % 2 == 0) for i in range(50)], "x double, bad boolean")
    full = df.select("bad", *[F.col("x").alias(f"f_{f}") for f in stats.FEATURES], *[F.ceil("x").cast("int").alias(f"b_{f}") for f in stats.FEATURES])
    got = quality_rules.tallies(full, F.lit(True), {f: [float(t) for t in range(6)] for f in stats.FEATURES})
    for f, op, t in got:
        hit = [i for i in range(50) if (i % 7 > t) == (op == ">")]
        assert got[f, op, t] == (sum(i % 2 == 0 for i in hit), sum(i % 2 for i in hit))


# ---- 2: languages


def test_language(spark, edges, nothing):
    rng = random.Random(2)
    kinds = {"aa": "bdgk", "bb": "lmnr", "cc": "pqst", "dd": "vwxz"}
    text = lambda k: " ".join("".join(rng.choice(kinds[k]) + rng.choice("aeiou") for _ in range(3)) for _ in range(20))
    rows = [(i, text(k := list(kinds)[i % 4]), k, "s") for i in range(200)]
    got = {r["doc_id"]: r for r in language.language_id(frame(spark, rows)).collect()}
    assert all(got[i]["lang_pred"] == r[2] and got[i]["held_out"] == (held(i, 4) == 2) and 0 <= got[i]["score"] <= 1 for i, r in enumerate(rows))
    out = {r["doc_id"]: r for r in language.language_id(edges).collect()}
    assert len(out) == 14 and all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (1, 2, 3, 9))
    assert out[8]["lang_pred"] in ("en", "xx")
    assert language.language_id(nothing).count() == 0
    assert {r["lang_pred"] for r in language.language_id(edges.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def brute_profile(text):
    """Shares of n-grams by bin, one at a time; None without a letter."""
    if not any(c.isalpha() for c in text):
        return None
    letters = language.letters()
    kept = [32]
    for c in map(ord, text.lower()):
        c = c if letters[c] else 32
        if c != 32 or kept[-1] != 32 or len(kept) == 1:
            kept.append(c)
    kept.append(32)
    out = collections.Counter()
    for n in range(1, language.ORDERS + 1):
        grams = []
        for i in range(len(kept) - n + 1):
            h = kept[i]
            for c in kept[i + 1 : i + n]:
                h = (h * 0x9E3779B97F4A7C15 + c) % 2**64
            grams.append(((h + n) * 0xBF58476D1CE4E5B9 % 2**64) >> 51)
        for g in grams:
            out[g] += 1 / len(grams) / language.ORDERS
    return out


def test_language_against_loops():
    """n-gram shares, bit weights and loss-weighted decoding, each as plain sums."""
    rng = random.Random(41)
    kinds = {"aa": "bdgk", "bb": "lmnr", "cc": "pqst"}
    made = [(k, " ".join("".join(rng.choice(kinds[k]) + rng.choice("aeiou") for _ in range(3)) for _ in range(12))) for k in kinds for _ in range(6)]
    names, matrix = sorted(kinds), language.code_matrix(3)
    sums = np.zeros((3, language.BINS))
    for k, text in made:
        got, want = language.profile(text), brute_profile(text)
        assert {i: x for i, x in enumerate(got.tolist()) if x} == pytest.approx(dict(want))
        sums[names.index(k)] += got
    weights = language.bit_weights(sums, matrix)
    for b in range(matrix.shape[1]):
        for g in rng.sample(range(language.BINS), 50):
            yes, no = ([sums[k, g] / sum(sums[k]) for k in range(3) if matrix[k, b] == side] for side in (1, -1))
            assert weights[g, b] == pytest.approx(math.log(sum(yes) / len(yes) + 1e-6) - math.log(sum(no) / len(no) + 1e-6))
    model = language.Codes(names, matrix, weights, np.array([0.5, 1.0, 2.0][: matrix.shape[1]]), np.array([1.0, 0.7, 0.4][: matrix.shape[1]]))
    for text in [*(t for _, t in made), "bala dama", "x", "lobo pato"]:
        share = language.profile(text)
        losses = []
        for k in range(3):
            loss = 0.0
            for b in range(matrix.shape[1]):
                margin = max(-6.0, min(6.0, sum(share[g] * weights[g, b] for g in np.flatnonzero(share)) / model.scale[b]))
                loss += model.trust[b] * math.log(1 + math.exp(-matrix[k, b] * margin))
            losses.append(loss)
        best = losses.index(min(losses))
        score = 1 / sum(math.exp(min(losses) - x) for x in losses)
        assert model.decode(share) == (best, pytest.approx(score), score < 0.5)


@pytest.mark.parametrize("k", [1, 2, 3, 4, 7, 8, 30])
def test_code_matrix(k):
    m = language.code_matrix(k)
    assert len({row.tobytes() for row in m}) == k


# ---- 3: Katz


def brute_katz(rows, order=2):
    """Plain loops: P of a word after a tuple of words, recursively over shorter tuples."""
    texts = [(d, [*split((t or "").translate(LOWER)), "</s>"], held(d, 5) == 1) for d, t, *_ in rows]
    grams = {k: collections.Counter() for k in range(1, order + 1)}
    padded = lambda w: ["<s>"] * (order - 1) + w
    for _, w, out in texts:
        if not out:
            for k, counts in grams.items():
                counts.update(tuple(padded(w)[i - k + 1 : i + 1]) for i in range(order - 1, len(w) + order - 1))
    uni = {g[0]: c for g, c in grams[1].items()}
    n, v = sum(uni.values()), len(uni)
    d = {k: katz.discounts(np.array([sum(c == r for c in grams[k].values()) for r in range(1, 7)])) for k in grams if k > 1}
    disc = lambda k, c: (d[k][c] if c <= katz.GT_MAX else 1.0) * c
    followers = collections.defaultdict(list)
    for k in d:
        for g, c in grams[k].items():
            followers[g[:-1]].append((g[-1], c))

    @functools.cache
    def room(h):
        k, whole = len(h) + 1, sum(c for _, c in followers[h])
        taken, seen = sum(disc(k, c) for _, c in followers[h]), sum(prob(h[1:], x) for x, _ in followers[h])
        den = whole + (taken >= whole * (1 - 1e-9))
        return den, (1 - taken / den) / (1 - seen)

    def prob(h, w):
        if not h:
            return (uni.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))
        if h not in followers:
            return prob(h[1:], w)
        den, backoff = room(h)
        c = grams[len(h) + 1][(*h, w)]
        return disc(len(h) + 1, c) / den if c else backoff * prob(h[1:], w)

    def whole(w):
        p = padded(w)
        return sum(math.log10(prob(tuple(p[i - order + 1 : i]), p[i])) for i in range(order - 1, len(p)))

    out = [(i, o, len(w), sum(x in uni for x in w), n, sum(math.log10(prob((), x)) for x in w), whole(w)) for i, w, o in texts]
    return out, prob, uni


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_katz(spark, corpus, edges, edge_rows, nothing, order):
    both = ((frame(spark, corpus), corpus), (edges, edge_rows))
    for df, rows in both if order in (2, 3) else both[:1]:
        want, prob, uni = brute_katz(rows, order)
        got = sorted(map(tuple, katz.katz_scores(df, order=order).collect()), key=lambda r: (repr(r[0]), r[2]))
        for g, w in zip(got, sorted(want, key=lambda r: (repr(r[0]), r[2])), strict=True):
            assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)
        seen = [*uni, WORDS[3]]
        for h in (("<s>",) * (order - 1), tuple(seen[: order - 1]), tuple(split(rows[5][1])[: order - 1])):
            assert sum(prob(h, w) for w in [*uni, "\0unknown"]) == pytest.approx(1)
    assert katz.katz_scores(nothing, order=order).count() == 0


def test_katz_in_many_chunks_and_buckets(spark, corpus, monkeypatch):
    """What chunks and buckets hold must not show: a chunk a text, more buckets than keys."""
    want = sorted(map(tuple, katz.katz_scores(frame(spark, corpus), order=3).collect()), key=repr)
    monkeypatch.setattr(katz, "CHUNK", 60)
    monkeypatch.setattr(katz, "BUCKET", 40)
    got = sorted(map(tuple, katz.katz_scores(frame(spark, corpus).repartition(2), order=3).collect()), key=repr)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)


# ---- 4: embeddings


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    rows, i = [], 0
    for c in range(30):
        centre = rng.standard_normal(32)
        for _ in range(rng.integers(1, 8)):
            rows.append((i, (centre + 0.22 * rng.standard_normal(32)).astype("f4").tolist(), c % 3))
            i += 1
    rows += [(1000 + k, rows[3][1], rows[3][2]) for k in range(5)] + [(2000, None, 1), (2001, [0.0] * 32, 1), (2002, [float("nan")] * 32, 1), (2003, [1.0, 2.0], 1), (2004, rows[0][1], None), (2005, [], 1), (None, rows[0][1], 0), (2006, [None] * 32, 1), (2007, [float("inf")] + [1.0] * 31, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit(1)).withColumn("weight", F.lit("x"))
    got = {r[0]: tuple(r)[1:] for r in caps.embedding_dedup(df).collect()}
    fine = [(i, np.array(v, float), label) for i, v, label in rows if i is not None and label is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links, parent = collections.Counter(), {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x, p) in enumerate(fine):
        for j, y, q in fine[a + 1 :]:
            if p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                links.update([i, j])
                s, t = sorted((find(i), find(j)))
                parent[t] = s
    assert len(links) > 20
    assert all(got[i][0] <= links[i] for i in parent) and sum(got[i][0] for i in parent) >= 0.95 * sum(links.values())
    right = sum(got[i][1:] == (find(i) if i is not None else None, i is not None and find(i) == i) for i in parent)
    assert right >= 0.95 * len(parent) and all(got[i][:2] == (0, i) for i in (2000, 2001, 2002, 2003, 2004, 2005, None, 2006, 2007))
    assert caps.embedding_dedup(df.limit(0)).count() == 0


def test_embeddings_in_double_precision(spark):
    """Components that squares of, or floats, cannot hold; and a cosine that only double precision tells from the threshold."""
    big, tiny = [1e300, 1e300, 0.0], [1e-300, 1e-300, 0.0]
    near = [1e300, 1e300, 1e298]
    one, angle = [1.0, *[0.0] * 63], math.acos(0.93)
    below, above = ([math.cos(a), math.sin(a), *[0.0] * 62] for a in (angle + 1e-12, angle - 1e-12))
    rows = [(1, big, 1), (2, big, 1), (3, near, 1), (4, tiny, 1), (5, one, 2), (6, below, 2), (7, one, 3), (8, above, 3), (9, [float("inf"), 1.0, 1.0], 1)]
    got = {r[0]: tuple(r)[1:3] for r in caps.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5), 6: (0, 6), 7: (1, 7), 8: (1, 7), 9: (0, 9)}


@pytest.mark.parametrize(("size", "codes"), [("sf0.01", None), ("sf0.1", None), ("sf0.1", 4096)])
def test_embedding_recall(spark, size, codes):
    """Links found of all links, on whole tables; codebooks of 4096 are those of two hundred million vectors a label."""
    df = spark.read.parquet(f"/root/testdata/{size}/embeddings.parquet")
    rows = [(r["vec_id"], np.array(r["embedding"], float), r["label"]) for r in df.collect() if r["embedding"] is not None and r["label"] is not None]
    links = collections.Counter()
    for label in {r[2] for r in rows}:
        ids = [r[0] for r in rows if r[2] == label]
        x = np.stack([r[1] for r in rows if r[2] == label])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        i, j = np.nonzero(np.triu(x @ x.T >= 0.93, 1))
        links.update(ids[k] for k in [*i, *j])
    got = {r["vec_id"]: r["n_links"] for r in caps.embedding_dedup(df, codes=codes).collect()}
    assert all(got[i] <= links[i] for i in got)
    assert sum(got.values()) >= 0.9 * sum(links.values())


def test_codes_grow():
    assert caps.codes_for(10_000, 12) == caps.codes_for(0, 12) == 256
    for n in (10**6, 10**8, 10**10):
        assert 8 <= n * 12 / caps.codes_for(n, 12) ** 2 <= caps.HELD


# ---- 5: packing


@pytest.fixture(scope="module")
def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    return P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def test_encoders_agree(tokenizer, edge_rows, corpus):
    fast, exact = packing.encoder(*tokenizer), packing.encoder(tokenizer[0], None, None)
    odd = ["a b  c d　e", "\x85\x1c x", "naïve Ünï 123,4 don't I'LL", " \n\n\t x\r\n", "日本語 текст ελ", "<|endoftext|>x"]
    for text in [*odd, *(r[1] or "" for r in [*edge_rows, *corpus[:20]])]:
        assert fast(text) == exact(text)


def test_packing(spark, tokenizer, edges, edge_rows, nothing):
    exact = packing.encoder(tokenizer[0], None, None)
    rows = packing.pack(edges, *tokenizer).collect()
    want = collections.Counter((r[0], (*exact(r[1] or ""), 0)) for r in edge_rows)
    docs = collections.defaultdict(list)
    for r in rows:
        docs[r["doc_id"], r["doc_tokens"]].append(r)
    for (doc, ids), times in want.items():
        mine = sorted(docs[doc, len(ids)], key=lambda r: r["start"])
        at = 0
        for r in mine[::times]:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    full = collections.defaultdict(list)
    for r in rows:
        full[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in full.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    assert packing.pack(nothing, *tokenizer).count() == 0


def test_encoders_agree_on_a_table(spark, tokenizer):
    """The ranks give the ids of the JSON tokenizer for every text of a whole table."""
    fast, exact = packing.encoder(*tokenizer), packing.encoder(tokenizer[0], None, None)
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").toLocalIterator():
        assert list(fast(r["text"] or "")) == list(exact(r["text"] or ""))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60))
def test_first_fit(sizes):
    bins, offsets = packing.first_fit_decreasing(np.array(sizes), 100)
    room, want = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        k = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
        if k == len(room):
            room.append(100)
        want[i] = (k, 100 - room[k])
        room[k] -= sizes[i]
    assert [(int(b), int(o)) for b, o in zip(bins, offsets, strict=True)] == [want[i] for i in range(len(sizes))]


# ---- 6: classifier


def test_classifier(spark, edges, nothing, labels):
    rng = random.Random(6)
    rows = [(i, prose(rng, 60) if i % 3 else " | ".join(prose(rng, 60).split()), "en", "s") for i in range(400)]
    known = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    got = quality_classifier.classify(frame(spark, rows), known).collect()
    assert all(r["held_out"] == (held(r["doc_id"], 5) == 0) and r["predicted"] == int(r["score"] >= 0.3) == int(r["doc_id"] % 3 > 0) for r in got)
    out = quality_classifier.classify(edges, labels).collect()
    assert len(out) == 15 and all(0 <= r["score"] <= 1 for r in out)
    assert {r["score"] for r in quality_classifier.classify(edges, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.classify(nothing, labels).count() == 0


def test_trees_fit():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = quality_classifier.fit(x[:1500], y[:1500])
    assert ((model.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95


def test_trees_against_loops():
    """The same trees grown by trying every cut of every feature at every node, row by row."""
    rng = np.random.default_rng(3)
    x = np.round(rng.random((60, 2)), 1)
    y = ((x[:, 0] > 0.4) & (x[:, 1] > 0.2)).astype(float)
    depth, rate, l2 = 2, 0.3, 1.0
    model = quality_classifier.fit(x, y, trees=3, depth=depth, rate=rate, bins=8, l2=l2, least=0.5)
    cuts = []
    for j in range(2):
        seen = np.unique(np.quantile(x[:, j], np.linspace(0, 1, 8), method="nearest"))
        cuts.append([(a + b) / 2 for a, b in zip(seen, seen[1:], strict=False)])
    share = (sum(y) + 1) / (len(y) + 2)
    margin = [math.log(share / (1 - share))] * 60
    for _ in range(3):
        p = [1 / (1 + math.exp(-m)) for m in margin]

        def grow(rows, level, p=p):
            sums = lambda ks: (sum(p[k] - y[k] for k in ks), sum(p[k] * (1 - p[k]) for k in ks))
            g, h = sums(rows)
            if level == depth:
                return {k: -rate * g / (h + l2) for k in rows}
            best, split = 1e-9, None
            for j in range(2):
                for t in cuts[j]:
                    left = [k for k in rows if x[k, j] <= t]
                    (a, b), (c, d) = sums(left), sums([k for k in rows if x[k, j] > t])
                    if b >= 0.5 and d >= 0.5 and a * a / (b + l2) + c * c / (d + l2) - g * g / (h + l2) > best + 1e-12:
                        best, split = a * a / (b + l2) + c * c / (d + l2) - g * g / (h + l2), (j, t)
            if split is None:
                return grow(rows, depth)
            j, t = split
            return grow([k for k in rows if x[k, j] <= t], level + 1) | grow([k for k in rows if x[k, j] > t], level + 1)

        leaf = grow(range(60), 0)
        margin = [m + leaf[k] for k, m in enumerate(margin)]
    assert model.margin(x).tolist() == pytest.approx(margin, abs=1e-6)


def test_labels_of_an_id(spark, edges):
    """Of several labels of an id the least counts, in both operators; repeated rows of an id are one row to fit on."""
    several = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    clash = several.withColumn("text", F.lit("clash")).withColumn("n_words", F.lit(1)).withColumn("bad", F.lit("x"))
    for f in (quality_rules.quality_rules, quality_classifier.classify):
        once = by_id(f(edges, spark.createDataFrame([(4, 0, 0)], "doc_id long, quality int, toxic int")))
        assert by_id(f(edges, several)) == once == by_id(f(edges, clash))


# ---- 7: pages


def page(title, body, comment="Nice one", extra=""):
    return f"<html><head><title>T</title><style>p{{}}</style></head><body><header>Site</header><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='ad'>Buy</div><main><article><h1>{title}</h1>{body}</article></main><div id='comments'><p>{comment}</p></div><aside>Side</aside><form><input value=x>Send</form>{extra}<footer>&copy; x</footer></body></html>"


def test_pages(spark):
    rows = [(1, "http://a.example/1", page("One", "<p>First &amp; best<p>Two\n  lines <b>bold</b><br>end")), (2, "http://a.example/2", page("Zwei", "<p>x</p><script>var p='</p><p>no';</script><!-- <p>no</p> -->")), (3, None, None), (4, "", ""), (5, "http://b.example/", "plain < text &#233;"), (6, "http://c.example/", "<p>open <div class='cookie-notice'>We use</div><p>rest"), (6, "http://c.example/", "<p>open"), (7, "http://a.example/3", page("Cut", "<p>tail &am").split("</article>")[0])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("_deal", F.lit(1))
    got = collections.defaultdict(list)
    for r in pages.extract_text(df).collect():
        got[r["page_id"]].append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert got[1] == ["One\nFirst & best\nTwo lines bold end"] and got[2] == ["Zwei\nx"] and got[3] == [""] and got[4] == [""]
    assert got[5] == ["plain < text é"] and sorted(got[6]) == ["open", "open\nrest"] and got[7] == ["Cut\ntail &am"]
    assert pages.extract_text(df.limit(0)).count() == 0


def test_wrapper_finds_template():
    made = [f"<body><div>Welcome to our site</div><div><p>{t} one</p><p>{t} two</p></div><div>All rights</div></body>" for t in "abcdefgh"]
    assert pages.extract(made) == [f"{t} one\n{t} two" for t in "abcdefgh"]


def test_wrapper_finds_template_in_repeats():
    def text(t, n, cut):
        body = [f"<p>{t} part {i} of the article, which is long enough</p>" for i in range(n)]
        return "".join(body[:cut]) + (f"<h2>{t} more</h2>" if cut else "") + "".join(body[cut:])

    pairs = [(t, n, cut) for t, (n, cut) in zip("abcdefgh", [(1, 0), (2, 0), (3, 1), (5, 0), (4, 2), (2, 1), (7, 3), (3, 0)], strict=True)]
    links = "".join(f"<li>Section {i}</li>" for i in range(6))
    cards = [f"<div><h3>{t}{i} card</h3><p>Read more</p></div>" for t in "abcdefgh" for i in range(1, 9)]
    made = [f"<body><ul>{links}</ul><p>Read our notice first</p>{text(*x)}<p>All rights reserved</p></body>" for x in pairs]
    want = [text(*x).replace("</p>", "\n").replace("<p>", "").replace("</h2>", "\n").replace("<h2>", "").strip() for x in pairs]
    assert pages.extract(made) == want
    made = [f"<body>{''.join(cards[8 * k : 8 * k + 1 + k])}<p>{t} end</p></body>" for k, t in enumerate("abcdefgh")]
    assert pages.extract(made) == ["\n".join([f"{t}{i} card" for i in range(1, 2 + k)] + [f"{t} end"]) for k, t in enumerate("abcdefgh")]


def test_versions_of_an_article_stay():
    body = "".join(f"<p>the same paragraph {i}</p>" for i in range(4))
    aside = "".join(f"<li>news {{0}}{i}</li>" for i in range(9))
    made = [f"<body><main>{body}<p>seen {t}</p></main><aside><ul>{aside.format(t)}</ul></aside></body>" for t in "abcdef"]
    assert pages.extract(made) == ["\n".join([f"the same paragraph {i}" for i in range(4)] + [f"seen {t}"]) for t in "abcdef"]


def test_wrapper_groups():
    """Equal numbers are elements, others repeated groups, aligned inside too; what some pages lack is optional."""
    items = [f"<li><h3>x{n}</h3></li>" + f"<li><h3>y</h3><p>z{n}</p></li>" * n for n in range(1, 4)]
    read = [pages.parse(f"<div><p>same</p><ul>{x}</ul>{'<h2>maybe</h2>' * (n % 2)}</div>") for n, x in enumerate(items, 1)]
    for _, texts in read:
        for t in texts:
            t.shared = t.text == "same"
    wrapper, _ = pages.infer([root for root, _ in read])
    assert "".join(k.expression() for k in wrapper.kids) == "<div><p>same</p><ul>(<li><h3>#</h3>(<p>#</p>)?</li>)*</ul>(<h2>maybe</h2>)?</div>"


def test_names_of_whole_pages_and_articles():
    """A class of the page, of what holds the article or of the article itself says nothing against its text."""
    body = "<h1>Title</h1><p>Body text.</p>"
    for page in (f'<body class="single has-sidebar"><article>{body}</article></body>', f'<div class="page no-comments"><main>{body}</main></div>', f'<article class="post category-advertising">{body}</article>', f'<body class="sidebar"><div class="widget"><article class="ad">{body}</article></div></body>'):
        assert pages.extract([page]) == ["Title\nBody text."]
    teaser = '<div class="related"><article>Other news</article></div><div class="site-footer">foot</div><div id="comment-list"><p>me too</p></div>'
    assert pages.extract([f"<article>{body}</article>{teaser}"]) == ["Title\nBody text."]


def test_wrapper_against_made_pages():
    """Pages made from layouts without any telling tag or class: the text is what the maker put there, page by page."""
    rng = random.Random(47)
    right = by_tags = n = 0
    for layout in range(12):
        fixed = [prose(rng, rng.randrange(2, 8)) for _ in range(4)]
        links = "".join(f"<li>{prose(rng, 2)} {i}</li>" for i in range(rng.randrange(2, 6)))
        depth = rng.randrange(1, 4)
        made, want = [], []
        for _ in range(rng.choice([2, 3, 6, 9])):
            parts = [prose(rng, rng.randrange(15, 40)) for _ in range(rng.randrange(2, 7))]
            text = "".join(f"<p>{x}</p>" if layout % 2 else f"<section><h2>{x[:20].strip()}</h2><p>{x}</p></section>" for x in parts)
            notice = f"<p>{fixed[3]}</p>" if layout % 3 else ""
            made.append(f"<body><div><div>{fixed[0]}</div><ul>{links}</ul></div>{'<div>' * depth}{notice}{text}{'</div>' * depth}<div><p>{fixed[1]}</p><p>{fixed[2]}</p></div></body>")
            want.append("\n".join(x if layout % 2 else f"{x[:20].strip()}\n{x}" for x in parts))
        right += sum(a == b for a, b in zip(pages.extract(made), want, strict=True))
        by_tags += sum(a == b for a, b in zip(pages.extract(made, wrapped=False), want, strict=True))
        n += len(made)
    assert right == n and by_tags == 0


def test_long_pages_in_seconds():
    import time

    made = ["<body><div>Our site</div>" + "".join(f"<h2>{k} {i}</h2><p>text {k} {i}</p>" if i % 3 else f"<ul><li>item {k} {i}</li></ul>" for i in range(6000)) + "</body>" for k in range(64)]
    start = time.time()
    found = pages.extract(made)
    assert time.time() - start < 60 and found[0].startswith("item 0 0\n0 1\ntext 0 1") and found[63].count("\n") == 9999


def test_many_copies_of_a_page(spark):
    rows = [(1, "http://a.example/1", page("One", "<p>x</p>"))] * 200 + [(2, "http://a.example/2", page("Two", "<p>y</p>"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert collections.Counter(r["text"] for r in pages.extract_text(df).collect()) == {"One\nx": 200, "Two\ny": 1}


def odd_host(rng, n):
    """Pages of one layout with repeated groups, optional parts, copies, equal texts in other markup and empty pages."""
    fixed = [prose(rng, rng.randrange(2, 6)) for _ in range(5)]
    tags = rng.sample(["div", "section", "ul", "td"], 2)
    article = rng.random() < 0.4
    made = []
    for k in range(n):
        if rng.random() < 0.08:
            made.append("<div></div>" * rng.randrange(6))
            continue
        if made and rng.random() < 0.15:
            other = rng.choice(made)
            made.append(other if rng.random() < 0.5 else other.replace("h3", "h4"))
            continue
        cards = "".join(f"<div><h3>{prose(rng, 4)}</h3><p>{fixed[0]}</p></div>" for _ in range(rng.randrange(1, 4 if rng.random() < 0.9 else 9)))
        body = "".join(f"<p>{prose(rng, rng.randrange(3, 15))}</p>" for _ in range(rng.randrange(1, 5)))
        once = f"<{tags[0]}><h2>{fixed[1]}</h2></{tags[0]}>" * (1 if rng.random() < 0.93 else 2)
        maybe = f"<p>{fixed[2]}</p>" if rng.random() < 0.97 else ""
        inner = f"<p>{fixed[3]}</p>{body}"
        made.append(f"<body><{tags[1]}>{fixed[4]}</{tags[1]}>{once}{maybe}{f'<article>{inner}</article>' if article else inner}{cards}<text>{fixed[1]}</text></body>")
    return made


def test_a_host_has_one_wrapper(spark, monkeypatch):
    """Pages of a host in many groups get the text that all pages of the host, read at once, give."""
    rng = random.Random(91)
    hosts = [odd_host(rng, n) for n in (3, 9, 15, 30, 40, 60, 60)]
    hosts += [[f"<body><p>{'same' if k else 'rare'} start</p><p>{prose(rng, 9)}</p></body>" for k in range(40)], ["<p>One</p>"] * 50 + ["<p>One</p><p>Two</p>"] * 30]
    body = "".join(f"<p>the same paragraph {i}</p>" for i in range(4))
    hosts.append([f"<body><main>{body}<p>seen {k}</p></main></body>" for k in range(25)])
    want = {(h, k): t for h, made in enumerate(hosts) for k, t in enumerate(pages.extract(made))}
    by_tags = {(h, k): t for h, made in enumerate(hosts) for k, t in enumerate(pages.extract(made, wrapped=False))}
    assert sum(want[x] != by_tags[x] for x in want) > 50
    rows = [(1000 * h + k, f"http://h{h}.example/{k}", x) for h, made in enumerate(hosts) for k, x in enumerate(made)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for group in (1, 8):
        monkeypatch.setattr(pages, "GROUP", group)
        got = pages.extract_text(df).collect()
        assert len(got) == len(rows)
        assert {(r["page_id"] // 1000, r["page_id"] % 1000): r["text"] for r in got} == want


def test_tasks_pass_on_what_they_hold(monkeypatch):
    """A task that holds one host or a few bytes at a time tells the same of its hosts in the end."""
    import pyarrow as pa

    rng = random.Random(92)
    made = [(f"h{k % 3}", x) for k, x in enumerate(odd_host(rng, 60))]
    batch = pa.RecordBatch.from_arrays([pa.array([h for h, _ in made]), pa.array([x for _, x in made])], ["_host", "html"])

    def told():
        out = {}
        for part in pages.joined(pages.Seen)(pages.see([batch])):
            for host, x in zip(*(c.to_pylist() for c in part.columns), strict=True):
                out.setdefault(host, pages.Seen()).join(pickle.loads(x))
        return {host: x.result() for host, x in out.items()}

    want = told()
    assert len(want) == 3 and all(want.values())
    for name in ("HELD", "HELD_BYTES"):
        with monkeypatch.context() as patch:
            patch.setattr(pages, name, 1)
            assert told() == want


def test_template_of_a_large_host(spark):
    """What 64 pages have in common is no template where another page of the host lacks it, and a page is never alone."""
    same = [(k, "http://a.example/", f"<body><div>Welcome</div><p>{k} is a text</p></body>") for k in range(150)]
    other = [(k, "http://b.example/", f"<body><div>{'Welcome' if k else 'Hello'}</div><p>{k} is a text</p></body>") for k in range(150)]
    got = {(r["url"], r["page_id"]): r["text"] for r in pages.extract_text(spark.createDataFrame(same + other, "page_id long, url string, html string")).collect()}
    assert got == {(u, k): f"{k} is a text" if "a." in u else f"{'Welcome' if k else 'Hello'}\n{k} is a text" for k, u, _ in same + other}


# ---- 8: Jaccard join


def brute_join(rows):
    sets = []
    for d, t, *_ in rows:
        w = split((t or "").translate(LOWER))
        sets.append((d, frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1 :]:
            if x and y and i is not None and j is not None and 100 * len(x & y) >= 75 * len(x | y):
                s, t = sorted((find(i), find(j)))
                parent[t] = s
    return sorted(((d, len(s), find(d)) for d, s in sets), key=repr)


def pairs_given(monkeypatch):
    """The number of pairs that each pass of the R-tree gives, before they are made distinct."""
    seen, whole = [], join.tree_pairs

    def counted(*args, **more):
        out = whole(*args, **more)
        seen.append(out.count())
        return out

    monkeypatch.setattr(join, "tree_pairs", counted)
    return seen


def test_join(spark, corpus, edges, edge_rows, nothing):
    want = brute_join(corpus)
    assert sum(c != d for d, _, c in want) > 20
    assert by_id(join.jaccard_join(frame(spark, corpus))) == want
    assert by_id(join.jaccard_join(edges)) == brute_join(edge_rows)
    assert join.jaccard_join(nothing).count() == 0


def test_join_repeated_ids(spark):
    rng = random.Random(31)
    a, b, c = (prose(rng, 40) for _ in range(3))
    rows = [(1, a, "en", "s"), (2, a, "en", "s"), (2, b, "en", "s"), (3, b, "en", "s"), (4, "", "en", "s"), (4, c, "en", "s"), (4, None, "en", "s"), (5, c, "en", "s"), (6, b + " x", "en", "s"), (6, c + " x", "en", "s")]
    want = brute_join(rows)
    assert [r[2] for r in want] == [1] * 10
    assert by_id(join.jaccard_join(frame(spark, rows))) == want
    assert by_id(join.jaccard_join(frame(spark, rows[:4]))) == brute_join(rows[:4])
    assert sql_rows("JACCARD", rows) == want


def sql_rows(name, rows):
    """What an oracle's SQL gives for these documents."""
    import duckdb

    from termloom.llm import oracles

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    return sorted(con.execute(getattr(oracles, name)).fetchall(), key=repr)


def test_join_oracle(edge_rows, corpus):
    for rows in (edge_rows, corpus[:60] + corpus[150:]):
        assert sql_rows("JACCARD", rows) == brute_join(rows)


def test_join_large_meeting_without_links(spark, monkeypatch):
    """Five thousand texts that share most of themselves, none linked: the bounds leave no more than a few pairs a text."""
    seen, rng = pairs_given(monkeypatch), random.Random(17)
    shared = prose(rng, 60)
    rows = [(i, f"{shared} {' '.join(f'{w}{i}' for w in prose(rng, 16).split())}", "en", "s") for i in range(5000)]
    assert all(c == d for d, _, c in by_id(join.jaccard_join(frame(spark, rows))))
    assert len(seen) == 2 and max(seen) <= 5000


def test_join_chain(spark, monkeypatch):
    """A chain of texts, each linked with its next ones only: the forest joins it, so few pairs are left for all bounds."""
    monkeypatch.setattr(join, "BLOCK", 40)
    seen, rng = pairs_given(monkeypatch), random.Random(19)
    words = [f"{w}{i}" for i, w in enumerate(prose(rng, 600).split())]
    shared = prose(rng, 60).split()
    rows = [(i, " ".join([*shared, *words[i : i + 60]]), "en", "s") for i in range(300)]
    assert by_id(join.jaccard_join(frame(spark, rows))) == brute_join(rows)
    assert max(seen) <= 3000


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10_000))
def test_fine_bound(seed):
    rng = np.random.default_rng(seed)
    pool = rng.integers(0, 1 << 62, 3000).astype(np.uint64)
    held = [np.unique(rng.choice(pool, rng.integers(1, 1500))) for _ in range(6)]
    fine = join.Fine([join.fine_vector(x) for x in held], np.array([len(x) for x in held]))
    i, j = np.triu_indices(6)
    both = np.array([len(np.intersect1d(held[a], held[b])) for a, b in zip(i, j, strict=True)])
    most = fine.most(i, j)
    assert (most >= both).all()
    like = np.minimum(fine.sizes[i], fine.sizes[j]) >= 0.75 * np.maximum(fine.sizes[i], fine.sizes[j])
    assert (most[like] <= both[like] + 0.25 * fine.sizes[i][like] + 3).all()


def test_join_links(spark, corpus, nothing, monkeypatch):
    """Every link between different sets, also where one star would join a whole group."""
    monkeypatch.setattr(join, "BLOCK", 7)
    rng = random.Random(13)
    words = prose(rng, 120).split()
    rows = [*corpus, *((1000 + i, " ".join([*words[:i], "odd", *words[i:]]), "en", "s") for i in range(12)), (2000, " ".join(words), "en", "s"), (2001, " ".join(words), "en", "s")]
    sets: dict[frozenset, int] = {}
    for d, text, *_ in rows:
        w = split(text.translate(LOWER))
        found = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])
        sets[found] = min(d, sets.get(found, d))
    names = sorted((d, x) for x, d in sets.items())
    want = [(a, b) for i, (a, x) in enumerate(names) for b, y in names[i + 1 :] if 100 * len(x & y) >= 75 * len(x | y)]
    assert sum(a >= 1000 for a, _ in want) == 13 * 12 // 2
    assert sorted(map(tuple, join.jaccard_join(frame(spark, rows), links=True).collect())) == want
    assert join.jaccard_join(nothing, links=True).count() == 0


def test_near_copies_of_a_repeated_id(spark):
    import corpus_pipeline

    rng = random.Random(21)
    old, one, two, three = (prose(rng, 60) for _ in range(4))
    rows = [(1, old, "en", "s"), (7, old + " more", "en", "s"), (7, one, "en", "s"), (7, two, "en", "s"), (7, two, "en", "s"), (8, one, "en", "s"), (9, three, "en", "s"), (9, three, "en", "t"), (None, old, "en", "s")]
    got = corpus_pipeline.near_copies(spark, frame(spark, rows), "").collect()
    assert sorted((repr(r["doc_id"]), r["text"]) for r in got) == sorted([("1", old), ("7", one), ("7", two), ("9", three), ("None", old)])
    assert [r["source"] for r in got if r["doc_id"] == 9] == [r["source"] for r in corpus_pipeline.near_copies(spark, frame(spark, rows[::-1]), "").collect() if r["doc_id"] == 9]


def test_join_apart(spark):
    """Texts that share most of themselves yet do not link: only the R-tree brings the linked ones among them together."""
    rng = random.Random(8)
    shared = prose(rng, 60)
    rows = []
    for i in range(40):
        tail = prose(rng, 16)
        rows += [(100 + 2 * i, f"{shared} {tail}", "en", "s"), (101 + 2 * i, f"{shared} {tail} end", "en", "s")]
    assert by_id(join.jaccard_join(frame(spark, rows))) == brute_join(rows)


@settings(max_examples=20, deadline=None)
@given(st.integers(2, 60), st.integers(0, 10_000))
def test_tree_loses_nothing(n, seed):
    rng = np.random.default_rng(seed)
    points = rng.integers(0, 6, (n, 8)).astype(np.int32)
    points[n // 2 :] = np.maximum(0, points[: n - n // 2] + rng.integers(-1, 2, (n - n // 2, 8)))
    sizes = np.maximum(1, points.sum(axis=1)).astype(np.int64)
    i, j = join.overlapping(points, sizes, 75)
    got = {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist(), strict=True)}
    want = {(a, b) for a in range(n) for b in range(a + 1, n) if np.minimum(points[a], points[b]).sum() >= join.needed(sizes[a], sizes[b])}
    assert got == want


# ---- 9: mixing


def test_share_out():
    assert mixing.share_out([100, 100, 100], [1, 2, 3], 3) == pytest.approx([50, 100, 150])
    assert mixing.share_out([1000, 10, 10], [1, 2, 3], 3) == pytest.approx([960, 30, 30])
    assert mixing.share_out([0, 0], [1, 2], 3) == [0, 0] and mixing.share_out([], [], 3) == []


def test_mixing(spark, corpus, edges, nothing):
    df = frame(spark, corpus)
    first, again = (by_id(mixing.mix(df)) for _ in range(2))
    assert first == again and len(first) == len(corpus)
    taken, target = collections.Counter(), {}
    source = {r[0]: r[3] for r in corpus}
    for r in mixing.mix(df).collect():
        assert r["size"] == len(split(corpus[r["doc_id"]][1])) and 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= max(10, 0.02 * target[s]) for s in target)
    assert mixing.mix(edges).count() == 15 and mixing.mix(nothing).count() == 0


def test_mixing_of_equal_rows(spark):
    """A hundred wholly equal rows: as many of them are taken as come nearest to the target, and reruns agree."""
    rows = [(5, prose(random.Random(1), 10), "en", "a")] * 100 + [(6, prose(random.Random(2), 15), "en", "b")] * 100
    first, again = (by_id(mixing.mix(frame(spark, rows))) for _ in range(2))
    assert first == again and len(first) == 200
    for r in mixing.mix(frame(spark, rows)).groupBy("doc_id", "size", "target").agg(F.sum("taken").alias("taken")).collect():
        assert abs(r["taken"] - r["target"]) <= r["size"] / 2 + 1e-6


def test_mixing_targets_in_sql(spark, corpus):
    """Sizes and targets as SQL has them: the excess above three times a source's size is shared again by weight."""
    import duckdb
    import pandas as pd

    documents = pd.DataFrame([(r[0], r[1], r[3]) for r in [*corpus, (900, prose(random.Random(4), 20_000), "en", "zz"), (901, None, "en", "zz"), (902, "a b", "en", None)]], columns=["doc_id", "text", "source"])  # noqa: F841
    sql = r"""WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
r(step, source, size, weight, target) AS (SELECT 0, source, size, weight, NULL::DOUBLE FROM s UNION ALL
  SELECT step + 1, source, size, weight, CASE WHEN target IS NOT NULL THEN target WHEN rest * weight / total > 3 * size THEN 3 * size END FROM
    (SELECT *, sum(size) OVER () - coalesce(sum(target) OVER (), 0) AS rest, sum(weight) FILTER (target IS NULL) OVER () AS total FROM r) WHERE step < 10),
z AS (SELECT *, sum(size) OVER () - coalesce(sum(target) OVER (), 0) AS rest, sum(weight) FILTER (target IS NULL) OVER () AS total FROM r WHERE step = 10)
SELECT d.doc_id, d.size, z.size::BIGINT AS source_size, coalesce(z.target, rest * weight / total) AS target FROM d JOIN z ON d.source IS NOT DISTINCT FROM z.source"""
    want = {r[0]: r[1:] for r in duckdb.sql(sql).fetchall()}
    rows = [(int(r.doc_id), None if r.text is None or r.text != r.text else r.text, "en", None if r.source is None or r.source != r.source else r.source) for r in documents.itertuples()]
    got = {r["doc_id"]: (r["size"], r["source_size"], r["target"]) for r in mixing.mix(frame(spark, rows)).collect()}
    assert set(got) == set(want) and all(got[i] == (want[i][0], want[i][1], pytest.approx(want[i][2])) for i in want)


def test_mixing_balances_covariates(spark, corpus):
    df = frame(spark, corpus)
    got = mixing.mix(df, covariates={"id": (F.col("doc_id") / 100, 0.9)})
    r = got.agg((F.sum(F.col("rate") * F.col("size") * F.col("doc_id") / 100) / F.sum(F.col("rate") * F.col("size"))).alias("m")).first()
    assert r["m"] == pytest.approx(0.9, abs=0.02)


# ---- 10: repeats


def brute_repeats(rows, length):
    raws = [(d, (t or "").encode()) for d, t, *_ in rows]
    count = collections.Counter(r[i : i + length] for _, r in raws for i in range(len(r) - length + 1))
    out = []
    for d, r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(bool(g) and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(r), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(r, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def test_repeats(spark, corpus, edges, edge_rows, nothing):
    assert by_id(suffix_dedup.digest(suffix_dedup.suffix_dedup(frame(spark, corpus)))) == brute_repeats(corpus, 200)
    assert by_id(suffix_dedup.digest(suffix_dedup.suffix_dedup(edges))) == brute_repeats(edge_rows, 200)
    assert suffix_dedup.suffix_dedup(nothing).count() == 0


@pytest.mark.parametrize("most", [1, 3, 20])
def test_repeats_of_hot_anchors(spark, edges, edge_rows, monkeypatch, most):
    """Anchors with more places than a task holds: periodic texts, and a passage in many surroundings, some of them alike."""
    monkeypatch.setattr(suffix_dedup, "COLLECTION", most)
    rng = random.Random(23)
    passage, wide = prose(rng, 34)[:185], prose(rng, 60)
    rows = [(i, f"{prose(rng, 12)[: rng.randrange(20, 60)]}{rng.choice('ab') * rng.randrange(20)}{passage}{rng.choice('cd') * rng.randrange(20)}{prose(rng, 12)}", "en", "s") for i in range(40)]
    rows += [(100 + i, f"{prose(rng, 20)} {wide} {prose(rng, 20)}", "en", "s") for i in range(25)]
    rows += [(200 + i, "ab " * (90 + 30 * i) + prose(rng, i), "en", "s") for i in range(5)] + [(300, rows[0][1], "en", "s"), (300, rows[0][1], "en", "s"), (None, rows[1][1], "en", "s")]
    assert by_id(suffix_dedup.digest(suffix_dedup.suffix_dedup(frame(spark, rows)))) == brute_repeats(rows, 200)
    assert by_id(suffix_dedup.digest(suffix_dedup.suffix_dedup(edges))) == brute_repeats(edge_rows, 200)


def test_many_copies_cost_no_more_than_one(spark, monkeypatch):
    """A thousand equal rows, with and without an id: one text is searched, and all of each row goes."""
    rng = random.Random(29)
    text, other = prose(rng, 600), prose(rng, 200)
    rows = [(7, text, "en", "s")] * 500 + [(None, text, "en", "s")] * 300 + [(i, text, "en", "s") for i in range(200)] + [(2000, other, "en", "s"), (2001, f"{other[:300]} {text[100:500]}", "en", "s")]
    seen, whole = [], suffix_dedup.spans

    def counted(documents, *args):
        seen.append(documents.count())
        return whole(documents, *args)

    monkeypatch.setattr(suffix_dedup, "spans", counted)
    assert by_id(suffix_dedup.digest(suffix_dedup.suffix_dedup(frame(spark, rows)))) == brute_repeats(rows, 200)
    assert seen == [3]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=12), min_size=1, max_size=12), st.integers(1, 5))
def test_column_wise(strings, width):
    got = suffix_dedup.repeated([np.frombuffer(s.encode(), np.uint8).astype(np.uint16) for s in strings], width)
    count = collections.Counter(s[i : i + width] for s in strings for i in range(len(s) - width + 1))
    assert [g.tolist() for g in got] == [[i for i in range(len(s) - width + 1) if count[s[i : i + width]] > 1] for s in strings]


# ---- words


def test_words(spark):
    import pyarrow as pa

    column = pa.array(["A b\tc", None, "", "  x ", "a B c", "long " * 1000, "é É"])
    out = {}
    for i, j, h, first in words.batches_of(column):
        for r in range(i, j):
            out[r] = h[first[r - i] : first[r - i + 1]].tolist()
    assert out[0] == out[4] and out[1] == out[2] == [] and len(out[3]) == 1 and len(set(out[5])) == 1 and len(out[5]) == 1000 and out[6][0] != out[6][1]


# ---- components


@pytest.mark.parametrize("most", [7, 500_000])
def test_connected(spark, most, monkeypatch):
    from termloom.llm import common

    monkeypatch.setattr(common, "EDGES", most)
    rng = random.Random(11)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(45)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in common.connected(spark.createDataFrame(edges, "a long, b long"), common.Scratch(spark, "t")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        s, t = sorted((find(a), find(b)))
        parent[t] = s
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
