"""Nearest vectors, ranked search and whitening against brute force."""

import random
import re
from collections import Counter
from functools import reduce
from math import floor, inf, log, nan, sqrt

import numpy as np
import pytest

from newsloom.llm import maxscore, queries, vptree, whitening

VECTORS = "vec_id long, embedding array<float>"


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# Nearest vectors


def vectors(n, width, seed=1, clusters=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, width))
    x = (centres[rng.integers(0, clusters, n)] + 0.4 * rng.normal(size=(n, width))).astype(np.float32)
    x[n // 2 : n // 2 + n // 5] = x[0]  # a fifth are copies
    return x


def brute_nearest(items, queries_, k):
    """(query_id, rank, vec_id, score) by plain sums from left to right."""
    use = {(i, tuple(v)) for i, v in items if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    dot = lambda a, b: reduce(lambda s, xy: s + xy[0] * xy[1], zip(a, b, strict=True), 0.0)  # noqa: E731  sum() would compensate
    out = []
    for q, v in sorted({(i, tuple(v)) for i, v in queries_ if v} & use):
        scored = sorted((-dot(v, w) / (sqrt(dot(v, v)) * sqrt(dot(w, w))), i) for i, w in use if i != q and len(w) == len(v))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return out


@pytest.mark.parametrize("shard", [50, 8192])
def test_nearest_is_exact_with_factor_one(spark, shard):
    x = vectors(600, 12)
    items = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(items, VECTORS)
    got = rows_of(vptree.nearest(df, df.where("vec_id % 50 = 0"), shard=shard).orderBy("query_id", "rank"))
    assert got == brute_nearest(items, [r for r in items if r[0] % 50 == 0], 5)


def test_nearest_odd_rows(spark):
    good = [(i, [1.0, float(i), 2.0]) for i in range(1, 9)]
    odd = [(0, None), (100, [nan, 1.0, 1.0]), (101, [None, 1.0, 1.0]), (102, [0.0, 0.0, 0.0]), (103, [inf, 0.0, 0.0]), (None, [1.0, 1.0, 2.0]), (104, []), (50, [5.0, 1.0]), (51, [4.0, 1.0])]
    again = [good[0], good[0], (3, [9.0, 9.0, 9.0])]
    items = good + odd + again
    df = spark.createDataFrame([(*r, 1) for r in items], VECTORS + ", score int")
    got = rows_of(vptree.nearest(df, df, k=3).orderBy("query_id", "rank", "vec_id"))
    assert Counter(got) == Counter(brute_nearest(items, items, 3))
    assert {r[0] for r in got} == {*range(1, 9), 50, 51} and [r for r in got if r[0] == 50][0][2] == 51
    assert vptree.nearest(df.limit(0), df).count() == vptree.nearest(df, df.limit(0)).count() == vptree.nearest(df, df, k=0).count() == 0
    few = vptree.nearest(df.where("vec_id in (1, 2)"), df.where("vec_id = 1")).collect()
    assert [(r.rank, r.vec_id) for r in few] == [(1, 2)]
    with pytest.raises(ValueError):
        vptree.nearest(df, df, factor=0.5)


def test_nearest_far_numbers(spark):
    items = [(i, [1e200 * (i + 1), 1e200]) for i in range(3)] + [(i, [1e-200, 1e-200 * i]) for i in range(3, 6)]
    df = spark.createDataFrame(items, "vec_id long, embedding array<double>")
    got = vptree.nearest(df, df, k=1).orderBy("query_id").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, 1), (1, 2), (2, 1), (3, 4), (4, 5), (5, 4)] and all(0.9 < r.score <= 1 + 1e-12 for r in got)


def test_queries_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vptree, "QUERY_BLOCK", 7)
    x = vectors(200, 6)
    items = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(items, VECTORS)
    assert rows_of(vptree.nearest(df, df.where("vec_id < 40"), k=2).orderBy("query_id", "rank")) == brute_nearest(items, items[:40], 2)


def test_larger_factors_see_less_and_recall_stays():
    x = vectors(4000, 8, clusters=40).astype(np.float64)
    ids, own = np.arange(4000), np.arange(0, 4000, 50)
    s = vptree.unit(x)[own] @ vptree.unit(x).T
    s[np.arange(len(own)), own] = -9
    fifth = np.sort(s, axis=1)[:, -5]
    seen, recall = [], []
    for factor in (1, 1.5, 3):
        best = vptree.Best(own, x[own], 5)
        vptree.search(vptree.Tree(ids, x), best, factor)
        seen.append(best.seen / (len(own) * len(x)))
        recall.append((best.scores >= fifth[:, None] - 1e-12).mean())
    assert recall[0] == 1 and recall[1] >= 0.9
    assert seen[0] < 0.5 and seen[0] > seen[1] > seen[2]


def test_tree_bounds_hold():
    x = vectors(700, 5).astype(np.float64)
    tree = vptree.Tree(np.arange(700), x)
    q = vptree.unit(np.random.default_rng(3).normal(size=(20, 5)))
    low = tree.bounds(q)
    assert sorted(tree.ids) == list(range(700)) and len(tree.edges) == low.shape[1] + 1 and np.diff(tree.edges).max() <= vptree.LEAF
    for leaf in range(low.shape[1]):
        angle = np.arccos(np.clip(q @ tree.x[tree.edges[leaf] : tree.edges[leaf + 1]].T, -1, 1))
        assert (low[:, leaf, None] <= angle + 1e-7).all()


# Ranked search


def brute_ranked(docs, items, k=50):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    tf = [(i, Counter(split(t))) for i, t in docs]
    tf = [(i, c) for i, c in tf if c]
    total, long = len(tf), sum(sum(c.values()) for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in tf:
            m = 100 - 50 + 50 * sum(c.values()) * total // long
            s = sum(floor(1000 * log((2 * total + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(split(text)) if t in c)
            scored += [(-s, i is None, i)] if s > 0 else []
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


def corpus(n, seed=2):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Été", "中文", "x_y", "A1"]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [(i, " ".join(rng.choices(words, weights, k=rng.choice([0, 1, 5, 40, 400])))) for i in range(n)]


@pytest.mark.parametrize(("shard", "block"), [(1_500_000, 1024), (900, 4), (1, 1)])
def test_ranked_against_brute_force(spark, monkeypatch, shard, block):
    docs = corpus(150)
    items = [(i, t) for i, (_, t) in enumerate(corpus(40, seed=3))] + [(90, docs[7][1]), (91, "W1, w1;w1"), (92, "nowhere"), (93, None)]
    monkeypatch.setattr(maxscore, "SHARD_TERMS", shard)
    monkeypatch.setattr(maxscore, "BLOCK", block)
    shards = maxscore.index(spark.createDataFrame(docs, "doc_id long, text string"))
    got = rows_of(maxscore.search(shards, spark.createDataFrame(items, "item_id long, text string"), k=10).orderBy("item_id", "rank"))
    assert got == brute_ranked(docs, items, 10)
    monkeypatch.setattr(maxscore, "ITEM_TERMS", 60)
    assert rows_of(maxscore.search(shards, spark.createDataFrame(items, "item_id long, text string"), k=10).orderBy("item_id", "rank")) == got


def test_ranked_odd_rows(spark):
    docs = [(3, "a b"), (1, "a b"), (1, "a b"), (None, "a b"), (2, None), (4, ""), (5, " .,;\x00"), (6, "A\x00B é"), (7, "é" * 70_000 + " a")]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, score int, terms string")
    items = [(1, "b"), (1, "b"), (1, "é b"), (None, "a"), (2, ""), (3, "-")]
    shards = maxscore.index(df)
    got = rows_of(maxscore.search(shards, spark.createDataFrame(items, "item_id long, text string")))
    assert Counter(got) == Counter(brute_ranked(docs, [(1, "b"), (1, "é b"), (None, "a")]))
    assert [r[2] for r in sorted(got, key=lambda r: r[1]) if r[0] is None][:5] == [1, 1, 3, 7, None]
    none = maxscore.index(df.limit(0))
    assert maxscore.search(none, df.select(df.doc_id.alias("item_id"), "text")).count() == 0 == maxscore.search(shards, df.limit(0).select(df.doc_id.alias("item_id"), "text")).count()


def test_long_text_in_blocks_gives_the_same():
    from newsloom.llm import common

    text = " ".join(random.Random(1).choices(["Aa", "b", "c1", "é"], k=5000)).encode()
    whole, parts = maxscore._Shard(), maxscore._Shard()
    whole.add(1, text)
    old, maxscore.word_blocks = maxscore.word_blocks, lambda d: common.word_blocks(d, 100)
    try:
        parts.add(1, text)
    finally:
        maxscore.word_blocks = old
    assert whole.row().equals(parts.row()) and whole.size == 5000


def test_max_score_looks_at_fewer_postings():
    rng = np.random.default_rng(5)
    lists = []
    for df, high in ((20, 9000), (60, 5000), (9000, 30), (9500, 20)):
        docs = np.sort(rng.choice(10_000, df, replace=False))
        given = rng.integers(1, high, df)
        lists.append((docs, given, int(given.max())))
    full = np.zeros(10_000, np.int64)
    for docs, given, _ in lists:
        full[docs] += given
    top = maxscore.Top(10)
    maxscore.max_score(lists, 10_000, np.arange(10_000), np.zeros(10_000, bool), top)
    order = np.lexsort((np.arange(10_000), -full))[:10]
    assert top.ids.tolist() == order.tolist() and top.scores.tolist() == full[order].tolist()
    assert top.looked < sum(len(x[0]) for x in lists) / 3


# Whitening


def brute_whitening(vectors_, components=8):
    x = np.array([[floor(1024 * float(c)) + 100_000 for c in v] for v in vectors_], np.int64)
    n, s = len(x), x.sum(axis=0)
    a = (n * x - s).astype(np.float64) / n
    values, turns = np.linalg.eigh(a.T @ a / n)
    values, turns = values[::-1], turns[:, ::-1]
    deviation = [sum((n * int(c) - int(t)) ** 2 for c, t in zip(r, s, strict=True)) for r in x]
    return n, deviation, values, a @ turns[:, :components] / np.sqrt(values[:components])


def test_whitening_against_eigenvectors(spark):
    x = (np.random.default_rng(4).normal(size=(500, 12)) * np.linspace(0.05, 2, 12)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], VECTORS).repartition(40)
    n, deviation, values, white = brute_whitening(x)
    got = whitening.whiten(df).toPandas().sort_values(["vec_id", "component"])
    assert len(got) == 500 * 8 and set(got.n) == {n} and got.deviation.tolist() == np.repeat(deviation, 8).tolist()
    own = got.whitened.to_numpy().reshape(500, 8)
    signs = np.sign((own * white).sum(axis=0))
    assert np.allclose(own * signs, white, atol=1e-9)
    assert np.allclose(got.explained.to_numpy()[:8], values[:8] / values.sum(), rtol=1e-12)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-10
    assert np.abs(np.cov(own.T, bias=True) - np.eye(8)).max() == pytest.approx(got.identity_error.iloc[0], abs=1e-12)


def test_jacobi_keeps_small_singular_values():
    rng = np.random.default_rng(6)
    q, _ = np.linalg.qr(rng.normal(size=(9, 9)))
    sizes = 10.0 ** -np.arange(9)
    r = np.linalg.qr(rng.normal(size=(9, 9)))[0] * sizes @ q.T
    got, turns = whitening.jacobi(r)
    assert np.allclose(got, sizes, rtol=1e-6) and np.allclose(turns.T @ turns, np.eye(9), atol=1e-13)
    assert np.allclose(np.abs(turns.T @ q), np.eye(9), atol=1e-7)
    for n in (1, 2, 5, 6):
        pairs = {tuple(sorted(p)) for r in whitening._rounds(n) for p in r.tolist()}
        assert len(pairs) == n * (n - 1) // 2 == sum(len(r) for r in whitening._rounds(n))


def test_whitening_odd_rows(spark):
    good = [(i % 4, [float(i % 7), float(i * i % 5), 1.0]) for i in range(20)] + [(None, [9.0, 9.0, 1.0])]
    odd = [(5, None), (6, []), (7, [nan, 1.0, 1.0]), (8, [None, 1.0, 1.0]), (9, [-inf, 0.0, 0.0]), (10, [1.0, 2.0]), (11, [1e30, 1.0, 1.0])]
    df = spark.createDataFrame([(*r, 1) for r in good + odd], VECTORS + ", n int")
    got = whitening.whiten(df).toPandas()
    assert len(got) == 21 * 2 and set(got.component) == {1, 2} and set(got.n) == {21}  # the third dimension does not vary
    assert got.vec_id.isna().sum() == 2 and got.identity_error.iloc[0] < 1e-10
    assert sorted(got[got.component == 1].deviation) == sorted(brute_whitening([v for _, v in good], 1)[1])
    assert whitening.whiten(df.limit(0)).count() == 0 == whitening.whiten(df.where("vec_id = 5")).count()
    assert whitening.whiten(df.where("vec_id = 11")).count() == 0 == whitening.whiten(df.where("vec_id = 10")).count()


def test_deviation_beyond_64_bits():
    centre = whitening.Centre(3, [3 * 10**9, 0])
    x = np.array([[10**9 + 5, 0], [10**9 + 1_012_333_410, 0], [10**9 + 1_012_333_502, 0], [2 * 10**9 + 10**8, 10**9]])
    assert centre.deviations(x) == [225, (3 * 1_012_333_410) ** 2, (3 * 1_012_333_502) ** 2 if (3 * 1_012_333_502) ** 2 < 2**63 else None, None]


@pytest.mark.parametrize("name", ["op11_neighbours", "op13_whitening"])
def test_queries_cover_whole_tables(spark, name):
    sf = "/root/testdata/sf0.001"
    df = queries.QUERIES[name](spark, sf)
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert df.count() == (5 * -(-n // 50) if name == "op11_neighbours" else 8 * n)
