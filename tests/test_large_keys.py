"""Keys of more rows than one task takes: the split paths give what the loops give."""

import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.operators import cluster, decisions, graph, groups, scan
from test_operators import cosine, plain_complete, plain_leaders


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(scan, "PART", 40)
    monkeypatch.setattr(scan, "DRAWN", 40)


def events(spark, n=500, seed=1):
    rng = random.Random(seed)
    order = rng.sample(range(10 * n), n)
    data = [(rng.choice(["a", "a", "a", "b", None]), o, rng.choice([None, None, o * 2]), rng.random() < 0.2) for o in order]
    return data, spark.createDataFrame(data, "k string, o long, v long, h boolean").repartition(7)


def by_key(data):
    out = {}
    for r in sorted(data, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return out


def test_bounds_follow_the_rows(spark, small_parts):
    _, df = events(spark)
    cuts = scan.bounds(df, "o")
    sizes = [r["count"] for r in df.groupBy(scan.part("o", cuts).alias("p")).count().collect()]
    assert len(cuts) == 12 and len(sizes) == 13 and max(sizes) < 80
    assert scan.bounds(df.limit(40), "o") == [] == scan.bounds(df.limit(0), "o")
    text = df.select(F.lpad(F.col("o").cast("string"), 5, "0").alias("o"))
    assert len(scan.bounds(text, "o")) == 12


def test_scans_over_parts(spark, small_parts):
    data, df = events(spark)
    numbered, counted, carried, summed = {}, {}, {}, {}
    for own in by_key(data).values():
        last, count, total = None, 0, 0
        for i, (_, o, v, h) in enumerate(own):
            count, last = count + h, last if v is None else v
            numbered[o], counted[o], carried[o], summed[o] = i, count, last, total
            total += v or 0
    got = scan.number(df, ["k"], "o", "x")
    assert {r.o: r.x for r in got.collect()} == numbered and got.columns == ["k", "o", "v", "h", "x"]
    assert {r.o: r.x for r in scan.running_count(df, ["k"], "o", F.col("h"), "x").collect()} == counted
    assert {r.o: r.x for r in groups.carry_forward(df, ["k"], "o", "v", "x").collect()} == carried
    assert {r.o: r.x for r in scan.running_sum(df, ["k"], "o", "v", "x").collect()} == summed
    order = sorted(r[1] for r in data)
    assert {r.o: r.x for r in scan.number(df, [], "o", "x").collect()} == {o: i for i, o in enumerate(order)}
    assert {r.o: (r.batch_id, r.idx) for r in decisions.batches(df, [], "o", 25).collect()} == {o: (i // 25, i % 25) for i, o in enumerate(order)}


def test_no_window_takes_a_key_whole(spark, small_parts):
    _, df = events(spark)
    for made in (scan.number(df, [], "o", "x"), scan.last_so_far(df, ["k"], "o", "v", "x")):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "__at" in plan and "__carry" in plan


def test_blocks_over_parts(spark, small_parts):
    data, df = events(spark)
    want = set()
    for k, own in by_key(data).items():
        head, items = None, []
        for _, o, _, h in [*own, (k, None, None, True)]:
            if h:
                want |= {(k, head, tuple(items))} if head is not None and items else set()
                head, items = o, []
            else:
                items.append(o)
    got = groups.blocks(df, ["k"], "o", F.col("h"), F.col("o"), F.col("o"))
    assert {(r.k, r["head"], tuple(r["items"])) for r in got.collect()} == want


def plain_batches(sizes, most):
    out, batch, used = [], 0, 0
    for n in sizes:
        if used and used + n > most:
            batch, used = batch + 1, 0
        used += n
        out.append(batch)
    return out


@pytest.mark.parametrize(("most", "longest", "seed"), [(30, 12, 1), (200, 50, 2), (5, 9, 3), (1000, 3, 4), (1, 1, 5)])
def test_token_batches_across_tasks(spark, small_parts, most, longest, seed):
    """One key holds nearly all texts, many of them empty, and its batches reach over parts."""
    rng = random.Random(seed)
    data = [("one" if i % 11 else None, i, " ".join(["w"] * rng.choice([0, 0, 1, 3, 10, 60]))) for i in range(400)] + [("null", 9999, None)]
    data += [("blank", 1000 + i, "") for i in range(100)]
    got = decisions.token_batches(spark.createDataFrame(data, "k string, o long, t string").repartition(5), "k", "o", "t", str.split, " ".join, most, longest)
    assert got.columns == ["k", "o", "t", "n_tokens", "batch"]
    found = {r.o: (r.t, r.n_tokens, r.batch) for r in got.collect()}
    for own in by_key(data).values():
        cut = [(t or "").split()[:longest] for _, _, t in own]
        assert [found[r[1]] for r in own] == [(" ".join(c) if len((r[2] or "").split()) > longest else r[2], len(c), b) for r, c, b in zip(own, cut, plain_batches([len(c) for c in cut], most), strict=True)]


@pytest.mark.parametrize(("seed", "undated"), [(0, 0.0), (1, 0.05), (2, 0.5), (3, "late"), (4, "first")])
def test_leader_clusters_in_islands(spark, monkeypatch, seed, undated):
    monkeypatch.setattr(cluster, "TASK_ROWS", 30)
    rng = np.random.default_rng(seed)
    n = 160
    v, days = rng.normal(size=(n, 3)), rng.integers(0, 60, n).astype(float)
    v[7] = 0
    if undated == "late":
        days[120::3] = np.nan
    elif undated == "first":
        days[0] = np.nan
    else:
        days[rng.random(n) < undated] = np.nan
    start = date(2024, 1, 1)
    data = [("big", i * 3, [float(x) for x in v[i]] if i != 7 else None, None if np.isnan(days[i]) else start + timedelta(int(days[i]))) for i in range(n)]
    data += [("few", i, [1.0, 0.0, float(i % 2)], start) for i in range(10)] + [(None, i, [1.0, 0.0, 0.0], start + timedelta(9 * i)) for i in range(40)]
    got = cluster.leader_clusters(spark.createDataFrame(data, "s string, o long, v array<double>, d date").repartition(6), "s", "o", "v", "d")
    assert got.columns == ["s", "o", "cluster"]
    assert [r.cluster for r in got.where("s = 'big'").orderBy("o").collect()] == plain_leaders(v, days)
    assert [r.cluster for r in got.where("s = 'few'").orderBy("o").collect()] == [i % 2 for i in range(10)]
    assert [r.cluster for r in got.where("s is null").orderBy("o").collect()] == list(range(40))


@pytest.mark.parametrize("seed", range(3))
def test_complete_link_of_large_groups(spark, monkeypatch, seed):
    monkeypatch.setattr(cluster, "TASK_ROWS", 20)
    monkeypatch.setattr(cluster, "CHUNK", 16)
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(70, 4))
    v[10:14] = v[9]
    data = [("big", i, [float(x) for x in r]) for i, r in enumerate(v)] + [("few", i, [1.0, float(i), 0.0, 0.0]) for i in range(3)]
    got = cluster.coherent_groups(spark.createDataFrame(data, "g string, o long, v array<double>").repartition(5), "g", "o", "v", 0.8)
    parts = {}
    for r in got.where("g = 'big'").orderBy("o").collect():
        parts.setdefault(r.part, []).append(r.o)
    assert [parts[k] for k in sorted(parts)] == [sorted(g) for g in plain_complete(v, 0.8)]
    assert got.where("g = 'few'").count() == 3


def test_chains_of_nearest_neighbours_with_ties():
    v = np.array([[1.0, 0.0], [0.0, 1.0]] * 6 + [[1.0, 1.0]] * 3)
    assert cluster.complete_link(v, 0.9) == [[*range(0, 12, 2)], [*range(1, 12, 2)], [12, 13, 14]]
    assert cluster.complete_link(np.zeros((3, 2)), 0.5) == [[0], [1], [2]] and cluster.complete_link(np.zeros((0, 2)), 0.5) == []


def test_close_pairs_of_one_hot_key(spark, monkeypatch):
    monkeypatch.setattr(cluster, "CHUNK", 32)
    monkeypatch.setattr(cluster, "RUN", 8)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 6))
    v = centres[rng.integers(0, 12, 300)] + 0.15 * rng.normal(size=(300, 6))
    v[:5] = 0
    v[40:50] = v[39]
    start = date(2024, 1, 1)
    days = rng.integers(0, 9, 300)
    data = [(1, i, start + timedelta(int(days[i])) if i % 50 else None, [float(x) for x in v[i]] if i % 49 else None) for i in range(300)]
    df = spark.createDataFrame(data, "k int, o long, d date, v array<double>").repartition(4)
    got = cluster.close_pairs(df, ["k"], "o", "d", 2, "v", 0.9)
    use = [r for r in data if r[2] and r[3]]
    want = {(1, a[1], b[1]) for a in use for b in use if a[1] < b[1] and abs((a[2] - b[2]).days) <= 2 and cosine(np.array(a[3]), np.array(b[3])) >= 0.9}
    found = got.collect()
    assert len(found) == len(want) and {(r.k, r.first, r.second) for r in found} == want
    assert all(abs(r.similarity - cosine(v[r.first], v[r.second])) < 1e-12 for r in found)


def test_pivots_leave_products_out():
    """Vectors in tight bundles: most pairs are told apart by their angles to pivots."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 8))
    u = cluster._unit(list(centres[rng.integers(0, 40, 2000)] + 0.05 * rng.normal(size=(2000, 8))))
    n, zero = np.arange(2000), np.zeros(2000, np.int64)
    i, j, s, products = cluster.near_in_chunk(u, zero, n, np.ones(2000, bool), zero, 0, 0, 1, 0.95)
    want = np.argwhere(np.triu(u @ u.T >= 0.95, 1))
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [tuple(w) for w in want.tolist()] and (s >= 0.95).all()
    assert products < 0.5 * 2000 * 2000


def test_components_by_key(spark, monkeypatch):
    rng = random.Random(6)
    edges = [(k, 1000 * k + rng.randrange(60), 1000 * k + rng.randrange(60)) for k in range(8) for _ in range(30)] + [(9, 9000 + i, 9001 + i) for i in range(200)] + [(None, 1, 2), (3, None, 4)]
    df = spark.createDataFrame(edges, "k int, src long, dst long").repartition(3)
    want = rows(graph.connected_components(df), "node", "component")
    assert rows(graph.keyed_components(df, "k"), "node", "component") == want
    monkeypatch.setattr(graph, "LOCAL_EDGES", 25)
    assert rows(graph.connected_components(df), "node", "component") == want
    assert rows(graph.keyed_components(df, "k"), "node", "component") == want
    assert graph.keyed_components(df.limit(0), "k").count() == 0
    big = spark.createDataFrame([(1, i, i + 1) for i in range(500)], "k int, src long, dst long")
    assert rows(graph.keyed_components(big, "k").select("component").distinct(), "component") == [(0,)]


def test_latest_compares_numbers_as_numbers(spark):
    df = spark.createDataFrame([("a", 9, 1, "x"), ("a", 10, 2, "y"), ("a", 10, 3, "z"), ("b", None, 1, "n"), ("b", -5, 2, "m"), ("c", None, 2, "q"), ("c", None, 1, "p")], "k string, n int, o long, v string")
    assert rows(groups.latest(df, ["k"], "n", "o"), "k", "v") == [("a", "y"), ("b", "m"), ("c", "p")]
    text = spark.createDataFrame([("a", None, 1, "x"), ("a", "", 2, "y"), ("b", "2", 1, "u"), ("b", "10", 2, "w")], "k string, n string, o long, v string")
    assert rows(groups.latest(text, ["k"], "n", "o"), "k", "v") == [("a", "x"), ("b", "u")]


def test_last_wins_hashes_numbers(spark):
    df = spark.createDataFrame([("a", 1, 5, None), ("a", 2, None, 2.5), ("b", 1, 7, 1.0)], "k string, o long, n long, x double")
    got = groups.last_wins(df, ["k"], "o")
    assert rows(got, "k", "o", "n", "x") == [("a", 2, None, 2.5), ("b", 1, 7, 1.0)]
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
