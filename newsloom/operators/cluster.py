"""Clustering articles by embedding: leader clusters, complete-link groups, representatives, issue selection."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.storage import materialise
from newsloom.operators import scan
from newsloom.operators.graph import connected_components, local_components

#: Least similarity of near copies, and days between them; least similarity within an issue; articles of a moment and of an issue.
NEAR, NEAR_DAYS, COHERENT, PER_MOMENT, PER_ISSUE = 0.86, 1, 0.65, 2, 5
#: Queries that are sent to the items at once.
QUERY_BLOCK = 10_000
#: Rows of a subject or group that one task takes whole; of a chunk; of a run within it; pivots by whose angles runs are told apart.
TASK_ROWS, CHUNK, RUN, PIVOTS = 20_000, 2048, 64, 16


def _matrix(rows: list) -> np.ndarray:
    """The vectors as one matrix; a null is a vector of zeros, which is similar to nothing."""
    width = max((len(r) for r in rows if r is not None), default=1)
    return np.array([np.zeros(width) if r is None else list(r) for r in rows], np.float64).reshape(len(rows), width)


def _unit(rows: list) -> np.ndarray:
    x = _matrix(rows)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


@dataclass
class Clusters:
    """What lead() knows of clusters, in the order of their first members: the first member's day, the running mean, the size."""

    anchor: np.ndarray
    mean: np.ndarray
    size: np.ndarray


def leaders(vectors: np.ndarray, days: np.ndarray, near: float = NEAR, window: int = NEAR_DAYS) -> np.ndarray:
    """Each row's cluster, numbered by first member. A row joins the first cluster whose running mean is near enough.

    days: day numbers, NaN where unknown; a cluster whose first member is more than window days away is passed over, an unknown
    day is never too far.
    """
    return lead(vectors, days, near, window)[0]


def lead(vectors: np.ndarray, days: np.ndarray, near: float, window: int, known: Clusters | None = None) -> tuple[np.ndarray, Clusters]:
    """leaders(), and the clusters as they are at the end. known: clusters of earlier rows, which come first."""
    n, width = vectors.shape
    count = len(known.size) if known else 0
    out, anchor, mean, size = np.zeros(n, np.int64), np.empty(n + count), np.zeros((n + count, width)), np.zeros(n + count, np.int64)
    norms = np.zeros(n + count)
    if known:
        anchor[:count], mean[:count], size[:count] = known.anchor, known.mean, known.size
        norms[:count] = np.linalg.norm(known.mean, axis=1)
    for i in range(n):
        own = np.linalg.norm(vectors[i])
        dot = mean[:count] @ vectors[i]
        scale = norms[:count] * own
        similar = np.divide(dot, scale, out=np.zeros(count), where=scale > 0) >= near
        hit = np.flatnonzero(similar & ~(np.abs(anchor[:count] - days[i]) > window))
        c = int(hit[0]) if len(hit) else count
        if c == count:
            anchor[c], count = days[i], count + 1
        size[c] += 1
        mean[c] += (vectors[i] - mean[c]) / size[c]
        norms[c] = np.linalg.norm(mean[c])
        out[i] = c
    return out, Clusters(anchor[:count], mean[:count], size[:count])


def complete_link(vectors: np.ndarray, least: float = COHERENT) -> list[list[int]]:
    """Groups in which even the least similar two are similar enough; the most similar two clusters merge first.

    Similarities count to twelve digits. Of equally similar pairs the first merges; the earlier cluster takes in the later, which leaves the list. Found by
    chains of nearest neighbours: a merged cluster is no nearer to others than its parts were, so pairs that are each other's nearest
    can merge in any order, and a cluster without a near enough neighbour is done. Memory is the vectors and one row of similarities.
    """
    u = _unit(list(vectors))
    members, owner, left, chain, done = {i: [i] for i in range(len(u))}, np.arange(len(u)), list(range(len(u))), [], []
    while left:
        if not chain:
            chain = [left[0]]
        a = chain[-1]
        near = np.full(len(u), np.inf)
        for at in range(0, len(members[a]), 256):
            near = np.minimum(near, np.round(u @ u[members[a][at : at + 256]].T, 12).min(axis=1))
        own = np.full(len(u), np.inf)
        np.minimum.at(own, owner[owner >= 0], near[owner >= 0])
        own[np.isinf(own)], own[a] = -np.inf, -np.inf
        b = int(own.argmax())  # of equals the first
        if own[b] < least:
            done.append(a)
            owner[members[a]] = -1
            left.remove(a)
            chain.pop()
        elif len(chain) > 1 and chain[-2] == b:
            low, high = min(a, b), max(a, b)
            owner[members[high]] = low
            members[low] += members.pop(high)
            left.remove(high)
            del chain[-2:]
        else:
            chain.append(b)
    return [members[i] for i in sorted(done)]


def leader_clusters(df: DataFrame, subject: str, order: str, vector: str, day: str | None = None, near: float = NEAR, window: int = NEAR_DAYS) -> DataFrame:
    """df's subject and order columns with cluster (long), numbered within the subject by its first member. order is unique within a subject.

    A null vector is a cluster of its own. A subject of TASK_ROWS rows or fewer is one task's loop. A larger one is cut where no row can join a cluster
    across: up to the subject's first row without a day, days further apart than window split its rows into islands, which run side by side. From
    that row on any cluster may be joined, so the loop goes on in one task, with the islands' clusters in the order of their first members.
    """
    rows = df.select(F.col(subject).alias("s"), F.col(order).alias("o"), F.col(vector).cast("array<double>").alias("v"), (F.col(day).cast("date") if day else F.lit(None).cast("date")).alias("d"))
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    schema = T.StructType([T.StructField("s", kinds["s"]), T.StructField("o", kinds["o"]), T.StructField("cluster", T.LongType())])

    def days_of(part: pd.DataFrame) -> np.ndarray:
        days = pd.to_datetime(part["d"]).to_numpy("datetime64[D]").astype(np.float64)
        days[part["d"].isna().to_numpy()] = np.nan
        return days

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("o", kind="stable")
        return part[["s", "o"]].assign(cluster=leaders(_matrix(part["v"].tolist()), days_of(part), near, window))

    named = lambda out: out.select(F.col("s").alias(subject), F.col("o").alias(order), "cluster")
    large = rows.groupBy("s").agg(F.count("*").alias("n"), F.min(F.when(F.col("d").isNull(), F.col("o"))).alias("undated")).where(F.col("n") > TASK_ROWS)
    if large.isEmpty():
        return named(rows.groupBy("s").applyInPandas(run, schema))
    large = materialise(large)
    small = rows.join(large, rows.s.eqNullSafe(large.s), "left_anti").groupBy("s").applyInPandas(run, schema)

    whole = rows.join(large.select(F.col("s").alias("ls"), "undated"), rows.s.eqNullSafe(F.col("ls"))).drop("ls")
    early, late = whole.where(F.col("undated").isNull() | (F.col("o") < F.col("undated"))).drop("undated"), whole.where(F.col("o") >= F.col("undated")).drop("undated")
    # One row a subject and day is put in order: a calendar's days at most.
    by = W.partitionBy("s").orderBy("d")
    gaps = early.select("s", "d").distinct().withColumn("gap", F.coalesce(F.date_diff("d", F.lag("d").over(by)) > window, F.lit(False)))
    islands = gaps.select(F.col("s").alias("gs"), F.col("d").alias("gd"), F.count_if("gap").over(by.rowsBetween(W.unboundedPreceding, 0)).alias("island"))
    placed = early.join(islands, early.s.eqNullSafe(F.col("gs")) & (early.d == F.col("gd"))).drop("gs", "gd")
    state = T.StructType([T.StructField("s", kinds["s"]), T.StructField("o", kinds["o"]), T.StructField("first", kinds["o"]), T.StructField("day", T.DoubleType()), T.StructField("mean", T.ArrayType(T.DoubleType())), T.StructField("size", T.LongType())])

    def island(part: pd.DataFrame) -> pd.DataFrame:
        """Each row's cluster by its first member; that member's row has the cluster's state at the end too."""
        part = part.sort_values("o", kind="stable").reset_index(drop=True)
        out, made = lead(_matrix(part["v"].tolist()), days_of(part), near, window)
        heads = np.unique(out, return_index=True)[1]
        first = np.zeros(len(part), bool)
        first[heads] = True
        means = [None] * len(part)
        for c, i in enumerate(heads):
            means[i] = made.mean[c].tolist()
        return pd.DataFrame({"s": part["s"], "o": part["o"], "first": part["o"].to_numpy()[heads[out]], "day": np.where(first, made.anchor[out], np.nan), "mean": means, "size": np.where(first, made.size[out], 0)})

    early_done = materialise(placed.groupBy("s", "island").applyInPandas(island, state))

    def go_on(known: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        part, known = part.sort_values("o", kind="stable"), known.sort_values("first", kind="stable")
        # Where all vectors of an island, or of these rows, are null, their width is not known there; they are zeros of any width.
        width = max((len(x) for x in (*known["mean"], *part["v"]) if x is not None), default=1)
        wide = lambda rows: _matrix([None if x is None or len(x) < width else x for x in rows] + [np.zeros(width)])[:-1]
        start = Clusters(known["day"].to_numpy(np.float64), wide(known["mean"]), known["size"].to_numpy()) if len(known) else None
        out, _ = lead(wide(part["v"]), days_of(part), near, window, start)
        order_of = np.concatenate([known["first"].to_numpy(), part["o"].to_numpy()])
        heads = np.full(len(known) + len(part), -1)
        heads[: len(known)] = np.arange(len(known))
        for i, c in enumerate(out):
            heads[c] = heads[c] if heads[c] >= 0 else len(known) + i
        return part[["s", "o"]].assign(first=order_of[heads[out]])

    pairs = T.StructType([*schema.fields[:2], T.StructField("first", kinds["o"])])
    late_done = early_done.where("size > 0").groupBy("s").cogroup(late.groupBy("s")).applyInPandas(go_on, pairs)
    every = materialise(early_done.select("s", "o", "first").unionByName(late_done))
    numbers = scan.number(every.where("o = first").select(F.col("s").alias("ns"), F.col("o").alias("no")), ["ns"], "no", "cluster")
    return named(small.unionByName(every.join(numbers, every.s.eqNullSafe(F.col("ns")) & (every["first"] == F.col("no"))).select("s", "o", "cluster")))


def coherent_groups(df: DataFrame, group: str, order: str, vector: str, least: float = COHERENT) -> DataFrame:
    """df's group and order columns with part (long): the group split by complete link, parts numbered by first member. order is unique within a group.

    A group of TASK_ROWS rows or fewer is one task's work. Of a larger one the pairs that are similar enough are found in pairs of chunks; parts lie
    within what these pairs hold together, so that the components are split side by side.
    """
    rows = df.select(F.col(group).alias("s"), F.col(order).alias("o"), F.col(vector).cast("array<double>").alias("v"))
    fields = rows.select("s", "o").schema.fields
    schema = T.StructType([*fields, T.StructField("part", T.LongType())])

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("o", kind="stable")
        parts = np.zeros(len(own), np.int64)
        for k, members in enumerate(complete_link(_matrix(own["v"].tolist()), least)):
            parts[members] = k
        return own[["s", "o"]].assign(part=parts)

    named = lambda out: out.select(F.col("s").alias(group), F.col("o").alias(order), "part")
    large = rows.groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") > TASK_ROWS)
    if large.isEmpty():
        return named(rows.groupBy("s").applyInPandas(run, schema))
    large = materialise(large)
    small = rows.join(large, rows.s.eqNullSafe(large.s), "left_anti").groupBy("s").applyInPandas(run, schema)
    keyed = materialise(rows.join(large.select(F.col("s").alias("ls")), rows.s.eqNullSafe(F.col("ls"))).drop("ls").withColumn("id", F.xxhash64("s", "o")))

    def linked(part: pa.Table) -> pa.Table:
        u, ids, chunk = _unit(part.column("v").to_pylist()), part.column("id").to_numpy(), part.column("own").to_numpy()
        p, q = np.flatnonzero(chunk == part.column("p")[0].as_py()), np.flatnonzero(chunk == part.column("q")[0].as_py())
        a, b = np.nonzero(np.round(u[p] @ u[q].T, 12) >= least)
        node, low = local_components(ids[p][a], ids[q][b])
        return pa.table({"src": node, "dst": low})

    edges = _chunk_pairs(keyed.select("s", "id", "v"), ["s"], "id").groupBy("s", "p", "q").applyInArrow(linked, "src long, dst long")
    label = connected_components(edges).withColumnsRenamed({"node": "__node"})
    split = keyed.join(label, keyed.id == F.col("__node"), "left").withColumn("label", F.coalesce("component", "id")).select("s", "o", "v", "label")
    firsts = T.StructType([*fields, T.StructField("first", fields[1].dataType)])

    def within(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("o", kind="stable").reset_index(drop=True)
        first = np.zeros(len(own), np.int64)
        for members in complete_link(_matrix(own["v"].tolist()), least):
            first[members] = min(members)
        return own[["s", "o"]].assign(first=own["o"].to_numpy()[first])

    every = materialise(split.groupBy("s", "label").applyInPandas(within, firsts))
    numbers = scan.number(every.where("o = first").select(F.col("s").alias("ns"), F.col("o").alias("no")), ["ns"], "no", "part")
    return named(small.unionByName(every.join(numbers, every.s.eqNullSafe(F.col("ns")) & (every["first"] == F.col("no"))).select("s", "o", "part")))


def _chunk_pairs(df: DataFrame, keys: list[str], deal: str) -> DataFrame:
    """df's rows with own (a row's chunk of its key, about CHUNK rows dealt by a hash of deal), once for each pair p <= q of chunks of which it is in one."""
    plain = [f"__key{i}" for i in range(len(keys))]
    sizes = df.groupBy(*(F.col(k).alias(p) for k, p in zip(keys, plain, strict=True))).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("__parts"))
    sized = df.join(sizes, [F.col(k).eqNullSafe(F.col(p)) for k, p in zip(keys, plain, strict=True)]).drop(*plain)
    dealt = sized.withColumn("own", F.pmod(F.xxhash64(deal, F.lit(3)), F.col("__parts")).cast("int")).withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
    return dealt.withColumns({"p": F.least("own", "__other"), "q": F.greatest("own", "__other")}).drop("__parts", "__other")


def representatives(df: DataFrame, group: str, order: str, vector: str, press: str, most: int = PER_MOMENT) -> DataFrame:
    """df's rows that stand for their group, with pick: 1 the medoid, 2 the most similar of another press, or of any if there is none.

    The medoid has the largest mean similarity to the others (to nine digits), the first of equals; a group of one stands
    for itself. A null vector is similar to nothing. A unit vector's sum of similarities is its product with the sum of the
    group's unit vectors, so no pairs are made and a group of any size is summed before it is shuffled. A column pick of df's goes.
    """
    rows = df.drop("pick").withColumns({"__g": F.col(group), "__o": F.col(order), "__u": _normal(F.col(vector))})
    own = rows.select("__g", "__o", F.col(press).alias("__p"), "__u")
    parts = own.select("__g", F.posexplode("__u").alias("i", "x")).groupBy("__g", "i").agg(F.sum("x").alias("x"))
    whole = parts.groupBy("__g").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e.x).alias("__sum"))
    near = F.round(F.coalesce(_dot(F.col("__u"), F.col("__sum")) - _dot(F.col("__u"), F.col("__u")), F.lit(0.0)), 9)
    meant = own.join(whole, "__g", "left").withColumn("__m", near)
    first = meant.groupBy("__g").agg(F.max_by(F.struct("__o", "__p", "__u"), F.struct("__m", -F.col("__o"))).alias("__one"))
    other = own.join(first, "__g").where(F.col("__o") != F.col("__one.__o"))
    rank = F.struct(~F.col("__p").eqNullSafe(F.col("__one.__p")), F.coalesce(_dot(F.col("__u"), F.col("__one.__u")), F.lit(0.0)), -F.col("__o"))
    second = other.groupBy("__g").agg(F.max_by("__o", rank).alias("__o"))
    picks = first.select("__g", F.col("__one.__o").alias("__o"), F.lit(1).alias("pick")).union(second.select("__g", "__o", F.lit(2)))
    return rows.drop("__u").join(picks, ["__g", "__o"]).where(F.col("pick") <= most).drop("__g", "__o")


def _normal(vector: Column) -> Column:
    """The vector at length 1; one of no length stays as it is."""
    plain = vector.cast("array<double>")
    length = F.sqrt(_dot(plain, plain))
    return F.when(length > 0, F.transform(plain, lambda x: x / length)).otherwise(plain)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def close_pairs(df: DataFrame, keys: list[str], order: str, day: str, days: int = NEAR_DAYS, vector: str | None = None, near: float = NEAR) -> DataFrame:
    """(keys, first, second, similarity): pairs of rows of a key, first before second in order, at most so many days apart.

    With a vector, only pairs at least so similar, and their similarity; else it is null. Rows without a day or vector pair
    with none. An equi-join on the key and the day's block of days + 1, in which a row has its own and the next: no pair meets twice.
    With a vector, a block of any number of rows is dealt into chunks, and pairs of chunks are tasks' work (see near_in_chunk()).
    """
    rows = df.select(*keys, F.col(order).alias("o"), F.col(day).cast("date").alias("d"), (_normal(F.col(vector)) if vector else F.lit(None).cast("array<double>")).alias("u")).where("d is not null")
    at = F.floor(F.unix_date("d") / (days + 1))
    a = rows.select(*keys, F.col("o").alias("oa"), F.col("d").alias("da"), F.explode(F.array(at, at + 1)).alias("block"))
    b = rows.select(*keys, F.col("o").alias("ob"), F.col("d").alias("db"), at.alias("block"))
    if not vector:
        # The row of the earlier day asks; of one day, the one that is first in order.
        asks = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("oa") < F.col("ob")))
        met = a.join(b, [*keys, "block"]).where(asks & (F.date_diff("db", "da") <= days))
        return met.select(*keys, F.least("oa", "ob").alias("first"), F.greatest("oa", "ob").alias("second"), F.lit(None).cast("double").alias("similarity"))
    both = rows.where("u is not null").where(" and ".join(f"`{k}` is not null" for k in keys) or "true")
    both = both.select(*keys, "o", F.unix_date("d").cast("long").alias("n"), "u", at.alias("home"), F.explode(F.array(at, at + 1)).alias("block"))
    place = rows.select(*keys, "o").schema.fields
    schema = T.StructType([*place[:-1], T.StructField("first", place[-1].dataType), T.StructField("second", place[-1].dataType), T.StructField("similarity", T.DoubleType())])

    def pairs(part: pa.Table) -> pa.Table:
        o, home = part.column("o").combine_chunks(), part.column("home").to_numpy() == part.column("block").to_numpy()
        rank = pc.rank(o, tiebreaker="dense").to_numpy()
        i, j, s, _ = near_in_chunk(_matrix(part.column("u").to_pylist()), part.column("n").to_numpy(), rank, home, part.column("own").to_numpy(), part.column("p")[0].as_py(), part.column("q")[0].as_py(), days, near)
        i, j = np.where(rank[i] < rank[j], i, j), np.where(rank[i] < rank[j], j, i)
        key = {k: pa.array([part.column(k)[0].as_py()] * len(i), part.schema.field(k).type) for k in keys}
        return pa.table({**key, "first": o.take(pa.array(i)), "second": o.take(pa.array(j)), "similarity": s})

    return _chunk_pairs(both, [*keys, "block"], "o").groupBy(*keys, "block", "p", "q").applyInArrow(pairs, schema)


def near_in_chunk(u: np.ndarray, days: np.ndarray, rank: np.ndarray, home: np.ndarray, own: np.ndarray, p: int, q: int, window: int, near: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(i, j, similarity, products): the pairs of unit vectors at least so similar, of which i asks and j is at home in the block; products counts
    the pairs that were multiplied.

    Rows are put in order of their nearest pivot and their angle to it, and cut into runs. By the triangle inequality two runs hold no near pair if their ranges of
    angles to one of the pivots are further apart than the angle of near: such pairs of runs are left out before any product.
    """
    size = np.linalg.norm(u, axis=1) > 0
    keep = np.flatnonzero(size) if near > 0 else np.arange(len(u))
    pivots = u[keep[np.linspace(0, len(keep) - 1, min(PIVOTS, len(keep))).astype(int)]] if len(keep) else u[:0]
    angle = np.arccos(np.clip(u[keep] @ pivots.T, -1, 1))
    nearest = angle.argmin(axis=1) if len(keep) else keep
    by = np.lexsort((angle.min(axis=1), nearest)) if len(keep) else keep
    keep, angle = keep[by], angle[by]
    most = np.arccos(np.clip(near, -1, 1)) + 1e-6
    starts = np.arange(0, len(keep), RUN)
    low, high = (np.array([f(angle[s : s + RUN], axis=0) for s in starts]).reshape(len(starts), -1) for f in (np.min, np.max))
    out, products = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))], 0
    for x, s in enumerate(starts):
        open_ = np.flatnonzero((np.maximum(low[x] - high, low - high[x]) <= most).all(axis=1)) if near > 0 else np.arange(len(starts))
        for t in starts[open_]:
            a, b = keep[s : s + RUN], keep[t : t + RUN]
            b = b[home[b]]
            products += len(a) * len(b)
            i, j = np.nonzero(u[a] @ u[b].T >= near - 1e-9)
            i, j = a[i], b[j]
            asks = (days[i] < days[j]) | ((days[i] == days[j]) & (rank[i] < rank[j]))
            across = (own[i] == p) & (own[j] == q) | (own[i] == q) & (own[j] == p)
            ok = asks & across & (days[j] - days[i] <= window)
            i, j = i[ok], j[ok]
            s_ = np.cumsum(u[i] * u[j], axis=1)[:, -1] if len(i) else np.empty(0)
            ok = s_ >= near
            out.append((i[ok], j[ok], s_[ok]))
    return *(np.concatenate(c) for c in zip(*out, strict=True)), products


def select_issues(df: DataFrame, group: str, order: str, vector: str, day: str, press: str) -> DataFrame:
    """df's rows kept for issues, with issue (group:part), moment, pick and n, the issue's rows kept (5 at most).

    Each group is split by coherence, each part by moments (leader clusters within a day), and each moment gives its
    representatives. Issues rank by n, largest first.
    """
    parts = coherent_groups(df, group, order, vector)
    split = materialise(df.join(parts, [group, order]).withColumn("__part", F.concat_ws(":", F.col(group).cast("string"), F.col("part").cast("string"))))
    moments = leader_clusters(split, "__part", order, vector, day)
    placed = materialise(split.drop("part").join(moments, ["__part", order]).withColumn("__moment", F.concat_ws(":", "__part", F.col("cluster").cast("string"))))
    picked = representatives(placed, "__moment", order, vector, press)
    ranked = picked.withColumn("__r", F.row_number().over(W.partitionBy("__part").orderBy("cluster", "pick"))).where(F.col("__r") <= PER_ISSUE)
    sized = ranked.withColumn("n", F.count("*").over(W.partitionBy("__part")))
    return sized.withColumnsRenamed({"__part": "issue", "cluster": "moment"}).drop("__moment", "__r")


def top_similar(queries: DataFrame, items: DataFrame, query_id: str, item_id: str, vector: str, k: int = 5) -> DataFrame:
    """(query_id, item_id, similarity) of each query's k most similar items, ties to the smaller id; a query is not its own item. Null vectors ask and
    answer nothing.

    Queries are sent to every item block, in blocks of QUERY_BLOCK at most: with more queries than that, each block of them
    is a pass over the items whose result is written. Each item block keeps k a query before the shuffle.
    """
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(vector).cast("array<double>").alias("v"))
    rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    parts = max(1, -(-asked.count() // QUERY_BLOCK))
    found = None
    for part in range(parts):
        few = asked.where("v is not null").where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).collect()
        for at in range(0, max(1, len(few)), QUERY_BLOCK):
            own = _best(few[at : at + QUERY_BLOCK], rows, k)
            own = materialise(own) if parts > 1 else own
            found = own if found is None else found.union(own)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "item_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _best(few: list, rows: DataFrame, k: int) -> DataFrame:
    """(query_id, item_id, similarity) of the k items of each block of rows that are most similar to each of few queries."""
    ids, matrix = [r["query_id"] for r in few], _unit([r["v"] for r in few]) if few else np.zeros((0, 1))

    def score(batches):
        best: list = [[] for _ in ids]
        for part in batches:
            if not len(part) or not ids:
                continue
            s = matrix @ _unit(part["v"].tolist()).T
            own = part["item_id"].to_numpy()
            for q in range(len(ids)):
                others = np.flatnonzero(own != ids[q])
                top = others[np.lexsort((own[others], -s[q, others]))[:k]]
                best[q] = sorted([*best[q], *zip(-s[q, top], own[top], strict=True)])[:k]
        kept = [(ids[q], int(i), -float(s)) for q in range(len(ids)) for s, i in best[q]]
        yield pd.DataFrame(kept, columns=["query_id", "item_id", "similarity"]).astype({"query_id": "int64", "item_id": "int64", "similarity": "float64"})

    return rows.mapInPandas(score, "query_id long, item_id long, similarity double")
