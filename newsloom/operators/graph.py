"""Connected components by alternating large-star and small-star rounds, and in one pass where there are few edges, or a key holds few."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from newsloom.functions.storage import materialise

#: Edges of a written file, where that makes more files than there are cores.
FILE_EDGES = 100_000
#: Edges that one task joins at once.
LOCAL_EDGES = 1_000_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Edges with a null end are dropped and self-loops give single-node components. Every round is an aggregate and
    a join on the node, so that hubs are combined before the shuffle and split by adaptive joins after it;
    the rounds grow with the logarithm of a component's size. Nothing but two numbers a round reaches the driver. A round's
    edges are written in files in proportion to those of the round before, whatever the number of shuffle partitions. Once
    there are LOCAL_EDGES or fewer, of long nodes, one task joins them, as it could hold them at any size of the whole.
    """
    cores = edges.sparkSession.sparkContext.defaultParallelism
    pairs = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    given = materialise(pairs.distinct())  # read again for the loops at the end
    now = given.where("u != v")
    seen = _state(now)
    local = isinstance(now.schema["u"].dataType, LongType)
    while not (local and seen[0] <= LOCAL_EDGES):
        now = materialise(_small_star(_large_star(now)).coalesce(max(cores, seen[0] // FILE_EDGES)))
        state = _state(now)
        if state == seen:
            break
        seen = state
    else:
        now = now.coalesce(1).mapInPandas(_joined, "u long, v long")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    loops = given.where("u = v").select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(roots).union(loops).groupBy("node").agg(F.min("component").alias("component"))


def _joined(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = pd.concat([*parts, pd.DataFrame({"u": [], "v": []}, dtype=np.int64)])
    node, low = local_components(rows["u"].to_numpy(np.int64), rows["v"].to_numpy(np.int64))
    yield pd.DataFrame({"u": node, "v": low})[node != low]


def local_components(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, their smallest reachable node) of a few edges: smallest labels are passed on and pointers jumped until nothing moves."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, label = place[: len(u)], place[len(u) :], np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return nodes, nodes[label]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def keyed_components(edges: DataFrame, key: str, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) as connected_components() has them, of edges whose nodes (long) belong to one key each.

    A key's edges meet in one task, which joins about LOCAL_EDGES of them at once. Only keys of more edges go through rounds, with the
    stars that are left of their parts.
    """

    def joined(rows: np.ndarray, cut: int | None) -> Iterator[pd.DataFrame]:
        """Of rows k, u, v; cut: the key of which another part has edges too."""
        for some, done in ((rows[rows[:, 0] != cut], True), (rows[rows[:, 0] == cut], False)) if cut is not None else ((rows, True),):
            node, low = local_components(some[:, 1], some[:, 2])
            yield pd.DataFrame({"node": node, "component": low, "done": done})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, cut = np.empty((0, 3), np.int64), None
        for p in parts:
            rows = np.concatenate([rows, p.to_numpy(np.int64)])
            if len(rows) >= LOCAL_EDGES:
                at = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
                yield from joined(rows[:at], cut)
                rows = rows[at:]
                if len(rows) >= LOCAL_EDGES:
                    cut = int(rows[-1, 0])
                    yield from joined(rows, cut)
                    rows = rows[:0]
        yield from joined(rows, cut)

    own = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.xxhash64(key).alias("k"), F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v"))
    made = materialise(own.repartition("k").sortWithinPartitions("k").mapInPandas(run, "node long, component long, done boolean"))
    done, rest = made.where("done").select("node", "component"), made.where("not done")
    return done if rest.isEmpty() else done.unionByName(connected_components(rest, "node", "component"))
