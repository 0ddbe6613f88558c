"""Neighbours, ranked search and hard negatives against plain Python, with nulls, ties, repeated rows, long texts and clashing columns."""

import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docflow.llm import graphs, negatives, ranked

VECTORS = "vec_id long, embedding array<double>, label int"
CLASHING = ["query", "rank", "score", "shard", "block", "dims", "anchor_id", "number", "stage", "lane"]


def clashing(df):
    return df.select("*", *(F.lit("x").alias(c) for c in CLASHING))


def clouds(n, dims, seed):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((8, dims))
    return centre[np.arange(n) % 8] + 0.7 * rng.standard_normal((n, dims))


HARD = [(9001, None, 1), (9002, [0.0] * 16, 2), (9003, [math.nan] * 16, 3), (9004, [None] + [1.0] * 15, 4), (9005, [math.inf] + [0.0] * 15, 1), (9006, [1.0, 2.0], 1), (9007, [2.0, 1.0], 2), (None, [0.5] * 16, 1), (9008, [0.1] * 16, None), (9009, [], 1)]


@pytest.fixture(scope="module")
def points():
    x = clouds(2000, 16, 5)
    x[40] *= 3
    rows = [(i, v.tolist(), int(i % 8)) for i, v in enumerate(x)]
    rows += [(3000 + i, x[40].tolist(), 3) for i in range(60)]  # one hot vector, nearest to itself
    return rows + HARD + [rows[20], rows[20]]


def finite(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def brute_neighbours(rows, top):
    good = {(i, tuple(v)) for i, v, _ in rows if i is not None and finite(v) and any(v)}
    out = {}
    for i, v in good:
        if i % 20 == 0:
            near = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i and len(w) == len(v))
            out[i] = [(r + 1, j, -s) for r, (s, j) in enumerate(near[:top])]
    return out


def test_neighbours(spark, points):
    df = clashing(spark.createDataFrame(points, VECTORS).repartition(4))
    got = collections.defaultdict(list)
    for r in graphs.nearest(df, F.col("vec_id") % 20 == 0, top=20, shard=700).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    want = brute_neighbours(points, 20)
    assert set(got) == {i for i, near in want.items() if near}
    hits = total = 0
    for i, near in want.items():
        mine = sorted(got[i])
        assert [r for r, *_ in mine] == list(range(1, len(near) + 1))
        keys = [(-s, j) for _, j, s in mine]
        assert keys == sorted(keys) and i not in [j for _, j, _ in mine] and len({j for _, j, _ in mine}) == len(mine)
        exact = {j: s for _, j, s in near}
        assert all(abs(s - exact[j]) < 1e-12 for _, j, s in mine if j in exact)
        hits += len(exact.keys() & {j for _, j, _ in mine})
        total += len(near)
    assert hits / total >= 0.97
    copies = [j for _, j, _ in sorted(got[40])]
    assert copies[:20] == sorted(copies[:20]) == list(range(3000, 3020))


def test_neighbours_of_uneven_lengths(spark):
    """The longest vectors are nearest to most; every level holds something, and few rows or none work."""
    rng = np.random.default_rng(3)
    x = clouds(1500, 16, 9) * rng.lognormal(0, 0.5, 1500)[:, None]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    want = brute_neighbours(rows, 10)
    got = collections.defaultdict(set)
    for r in graphs.nearest(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0, top=10, shard=1500).collect():
        got[r.query_id].add(r.vec_id)
    assert sum(len(got[i] & {j for _, j, _ in near}) for i, near in want.items()) / (10 * len(want)) >= 0.9
    for few in ([], rows[:1], rows[:2]):
        told = graphs.nearest(spark.createDataFrame(few, VECTORS), F.col("vec_id") % 20 == 0).collect()
        assert [(r.query_id, r.vec_id) for r in told] == ([(0, 1)] if len(few) == 2 else [])


def brute_negatives(rows):
    good = [(i, str(lab), [math.floor(256 * c) for c in v]) for i, v, lab in rows if i is not None and lab is not None and finite(v)]
    anchors = {}
    for r in sorted(good, key=lambda r: (r[0], r[1], r[2])):
        if r[0] % 100 == 0:
            anchors.setdefault(r[0], r)
    out = []
    for a, lab, v in anchors.values():
        scored = sorted((-sum(p * q for p, q in zip(v, w)), j, other == lab) for j, other, w in good if j != a and len(w) == len(v))
        for p, j, _ in [s for s in scored if s[2]][:5]:
            hits = [(s, k) for s, k, same in scored if not same and 80 * -p <= 100 * -s <= 100 * -p]
            out += [(a, j, r + 1, k, -p, -s) for r, (s, k) in enumerate(hits[:5])]
    return sorted(out)


@pytest.mark.parametrize("block, tile", [(4096, 8192), (3, 97)])
def test_negatives(spark, points, block, tile):
    df = clashing(spark.createDataFrame(points, VECTORS).repartition(5))
    got = negatives.mine(df, F.col("vec_id") % 100 == 0, F.col("label"), block=block, tile=tile)
    assert sorted(map(tuple, got.collect())) == brute_negatives(points)


def test_negatives_of_large_and_no_components(spark):
    rows = [(0, [1e9, 1.0], 1), (1, [1e9, 2.0], 1), (2, [0.9e9, 3.0], 2), (3, [0.9e9, 3.0], 2), (4, [-1e9, 0.0], 1), (100, [-1.0, 0.0], 1), (101, [1.0, 0.0], 1), (102, [0.9, 0.0], 2), (200, [1e300, 1e300], 1)]
    got = negatives.mine(spark.createDataFrame(rows[:6], VECTORS), F.col("vec_id") % 100 == 0, F.col("label")).collect()
    assert {(r.anchor_id, r.positive_id, r["rank"], r.negative_id) for r in got if r.anchor_id == 0} == {(0, 1, 1, 2), (0, 1, 2, 3)}
    assert {r.positive_score for r in got if r.anchor_id == 0} == {negatives.MOST}
    assert negatives.mine(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 100 == 0, F.col("label")).count() >= 2
    assert negatives.mine(spark.createDataFrame([], VECTORS), F.col("vec_id") % 100 == 0, F.col("label")).count() == 0


def test_windows_close_without_the_anchor_in_memory():
    """A window opens at its positive and is gone once it has told all; equal scores count as inside."""
    pos = negatives.packed(np.array([7, 7]), np.array([100, 50]), 0, np.array([1, 2]))
    neg = negatives.packed(np.full(6, 7), np.array([120, 100, 90, 80, 79, 40]), 1, np.arange(10, 16))
    got = list(negatives.told(iter(sorted(pos + neg)), 2, 80, 100))
    assert got == [(7, 1, 1, 11, 100, 100), (7, 1, 2, 12, 100, 90), (7, 2, 1, 15, 50, 40)]


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_ranks(docs, items, top=10):
    own = [(i, collections.Counter(terms(t))) for i, t in docs]
    n, long = sum(1 for _, c in own if c), sum(sum(c.values()) for _, c in own)
    df = collections.Counter(t for _, c in own for t in c)
    asked = collections.defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for item, want in asked.items():
        scored = []
        for i, c in own:
            if c:
                m = 10 + 90 * sum(c.values()) * n // long
                s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in want if t in c)
                if s > 0:
                    scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(300)] + ["Ünicode", "naïve", "ABC", "x1"]
    docs = []
    for i in range(600):
        at = np.minimum(rng.zipf(1.3, rng.integers(1, 80)), len(words)) - 1
        docs.append((i, "the " + " ,".join(words[k] for k in at)))
    docs += [(700 + i, docs[3][1]) for i in range(40)]  # ties
    docs += [(900, None), (901, ""), (902, "... --- \n"), (None, docs[5][1]), (5, docs[5][1]), (903, "w1 rare " * 60_000), (904, "the")]
    items = [(k, " ".join(words[j] for j in rng.integers(0, len(words), 12)) + " the THE") for k in range(30)]
    return docs, items + [(50, None), (51, ""), (52, "nowhere"), (53, docs[3][1]), (None, "w1 w2"), (0, "w9 rare"), (0, "w9 rare")]


@pytest.mark.parametrize("shard, block, part_bytes", [(8192, 256, 1 << 26), (64, 7, 3000)])
def test_ranks(spark, corpus, shard, block, part_bytes):
    docs, items = corpus
    d = clashing(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).withColumn("item_id", F.lit(1))
    i = clashing(spark.createDataFrame(items, "item_id long, text string")).withColumn("doc_id", F.lit(1))
    got = ranked.rank(d, i, shard=shard, block=block, part_bytes=part_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_ranks(docs, items)


def test_ranks_of_empty_tables(spark, corpus):
    none_d, none_i = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    docs, items = spark.createDataFrame(corpus[0][:20], "doc_id long, text string"), spark.createDataFrame(corpus[1][:3], "item_id long, text string")
    assert ranked.rank(none_d, items).count() == ranked.rank(docs, none_i).count() == ranked.rank(none_d, none_i).count() == 0


def test_pieces_of_long_texts(monkeypatch):
    text = "Ab,cd É1 " * 500 + "x" * 3000 + " end"
    whole = [w for p in ranked.pieces(text) for w in p]
    monkeypatch.setattr(ranked, "PIECE", 64)
    assert [w for p in ranked.pieces(text) for w in p] == whole == [t.encode() for t in terms(text)]
