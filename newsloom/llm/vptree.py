"""Nearest vectors by vantage-point trees, one a shard, with triangle-inequality pruning relaxed by a factor.

The distance is the angle between two vectors, which is a metric: by the triangle inequality a query at angle d from a vantage
point is at least max(low - d, d - high) from every vector whose angle to that point is between low and high. A tree halves a
shard by rank, level by level, so that its depth is the logarithm of the shard whatever copies it holds; a leaf's bound is the largest
on its path. A leaf is left out if factor times its bound is more than the angle of the k-th best found: with factor 1 nothing
near is lost, and a larger one prunes more than the inequality allows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions.storage import materialise
from newsloom.llm.common import release

#: Vectors of a shard and of a leaf; numbers of a shard at most, where vectors are wide; vantage points tried for a node.
SHARD, LEAF, SHARD_NUMBERS, TRIED = 8192, 32, 1 << 23, 4
#: Queries that go to all shards at once, and leaves that each of them visits before the others are pruned.
QUERY_BLOCK, FIRST = 4096, 2
FACTOR, NEAREST = 1.0, 5
#: What rounding may add to an angle, and to a cosine.
_ANGLE, _COSINE = 1e-6, 1e-9
_BEST = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def valid(vector: Column) -> Column:
    """Whether a vector has a direction: it is not null, holds no null, NaN or infinite number, and is not zero all over."""
    x = vector.cast("array<double>")
    finite = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & finite & F.exists(x, lambda v: v != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of one batch, which all have one width."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _lengths(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths, summed from left to right. Vectors that are too long or short for squares are scaled first by unit()."""
    return np.sqrt(np.cumsum(x * x, axis=1)[:, -1])


def unit(x: np.ndarray) -> np.ndarray:
    """The vectors at length 1; those whose squares leave the doubles' range are scaled by their largest number first."""
    top = np.abs(x).max(axis=1, keepdims=True)
    scaled = np.where((top > 1e100) | (top < 1e-100), x / top, x)
    return scaled / _lengths(scaled)[:, None]


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The cosines of pairs of rows, summed from left to right, so that equal vectors have equal cosines wherever they stand."""
    top = np.maximum(np.abs(x).max(axis=1, initial=0), np.abs(y).max(axis=1, initial=0))
    low = np.minimum(np.abs(x).max(axis=1, initial=0), np.abs(y).max(axis=1, initial=0))
    odd = (top > 1e100) | (low < 1e-100)
    if odd.any():
        x, y = x.copy(), y.copy()
        x[odd], y[odd] = unit(x[odd]), unit(y[odd])
    return np.cumsum(x * y, axis=1)[:, -1] / (_lengths(x) * _lengths(y))


def _angle(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


class Tree:
    """A vantage-point tree over rows (ids, vectors): vantage points by level, the range of angles of each child, and leaves as slices of rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF, tried: int = TRIED):
        x = unit(vectors)
        n, order, edges = len(ids), np.lexsort((ids,)), np.array([0, len(ids)])
        self.points, self.ranges = [], []
        while n > leaf * (len(edges) - 1):
            sizes = np.diff(edges)
            node = np.repeat(np.arange(len(sizes)), sizes)
            rows = x[order]
            best, spread = None, np.full(len(sizes), -1.0)
            for t in range(tried):
                at = edges[:-1] + sizes * t // tried
                angle = _angle(np.einsum("nd,nd->n", rows, rows[at][node]))
                mean = np.bincount(node, angle) / sizes
                own = np.bincount(node, (angle - mean[node]) ** 2)
                if best is None:
                    best, chosen = angle, at.copy()
                better = own > spread
                best, chosen, spread = np.where(better[node], angle, best), np.where(better, at, chosen), np.maximum(own, spread)
            place = np.lexsort((ids[order], best, node))
            half = edges[:-1] + (sizes + 1) // 2
            self.points.append(rows[chosen])
            order, best = order[place], best[place]
            edges = np.sort(np.concatenate([edges, half]))
            self.ranges.append(np.stack([best[edges[:-1]], best[edges[1:] - 1]], axis=1))
        self.edges, self.ids, self.vectors, self.x = edges, ids[order], vectors[order], x[order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The least angle that each unit query can have to each leaf's vectors."""
        low = np.zeros((len(queries), 1))
        for points, ranges in zip(self.points, self.ranges, strict=True):
            angle = np.repeat(_angle(queries @ points.T), 2, axis=1)
            low = np.maximum(np.repeat(low, 2, axis=1), np.maximum(ranges[:, 0] - angle, angle - ranges[:, 1]))
        return low


class Best:
    """The k best rows found for each query: larger cosines first, equal ones by id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.own, self.vectors, self.x, self.k = ids, vectors, unit(vectors), k
        self.scores, self.ids = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        self.seen = 0

    def angles(self, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The angle of each query's k-th best; without one, more than any."""
        worst = self.scores[rows, -1]
        return np.where(np.isinf(worst), 4.0, _angle(worst)) + _ANGLE

    def offer(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, x: np.ndarray) -> None:
        """Let these queries see these vectors. A product of matrices finds those that can be among the best; their cosines are then taken one by one."""
        self.seen += len(rows) * len(ids)
        near = (self.x[rows] @ x.T >= self.scores[rows, -1:] - _COSINE) & (ids != self.own[rows, None])
        q, i = np.nonzero(near)
        if not len(q):
            return
        scores = cosine(self.vectors[rows[q]], vectors[i])
        held = np.unique(q)
        kept = rows[held]
        every = np.concatenate([np.repeat(held, self.k), q])
        s = np.concatenate([self.scores[kept].ravel(), scores])
        v = np.concatenate([self.ids[kept].ravel(), ids[i]])
        order = np.lexsort((v, -s, every))
        first = np.searchsorted(every[order], held)
        take = order[first[:, None] + np.arange(self.k)]
        self.scores[kept], self.ids[kept] = s[take], v[take]


def search(tree: Tree, best: Best, factor: float = FACTOR, first: int = FIRST) -> None:
    """Show every query the leaves that can hold one of its k nearest, by bounds relaxed by factor. Each sees its first most
    promising leaves before the others are judged."""
    low = tree.bounds(best.x)
    leaves = low.shape[1]
    done = np.zeros(low.shape, bool)

    def visit(leaf: int, rows: np.ndarray) -> None:
        own = slice(tree.edges[leaf], tree.edges[leaf + 1])
        best.offer(rows, tree.ids[own], tree.vectors[own], tree.x[own])

    for turn in np.argsort(low, axis=1, kind="stable")[:, : min(first, leaves)].T:
        order = np.argsort(turn, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(turn[order])) + 1):
            if len(part):
                visit(int(turn[part[0]]), part)
        done[np.arange(len(turn)), turn] = True
    limit = best.angles()
    for leaf in np.argsort(low.mean(axis=0), kind="stable"):
        rows = np.flatnonzero((factor * low[:, leaf] <= limit) & ~done[:, leaf])
        if len(rows):
            visit(int(leaf), rows)
            limit[rows] = best.angles(rows)


def _plain(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part; rows alike in both count once."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where(F.col("vec_id").isNotNull() & valid(F.col("v")))
    return rows.select("vec_id", F.col("v").cast("array<double>").alias("v"))


def nearest(items: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEAREST, factor: float = FACTOR, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors of largest cosine to each query, equal ones by ascending vec_id.

    A vector that is null, zero or holds null or non-finite numbers takes no part, nor does a row without an id, nor a vector of another width than the query's. Rows alike in id
    and vector count once; a query's own id is never found for it, and of several queries of one id and unlike vectors each
    is answered (their ranks follow one another). Of an empty table, or where k is 0, nothing is found.

    With factor 1 the result is exact. Items are written once, in shards dealt by a hash of id and vector, the number of which
    follows their number; a shard's tree is built in the task that reads it. Queries go to the shards in blocks of QUERY_BLOCK, the
    only rows the driver sees; each block is a pass over the shards whose k rows a query and task are written.
    """
    if not k >= 1:
        return items.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not factor >= 1:
        raise ValueError("factor must be 1 or more")
    rows = _plain(items, id_col, vector_col).withColumn("width", F.size("v")).withColumn("h", F.xxhash64("vec_id", "v"))
    once = materialise(rows.groupBy("width", "vec_id", "h").agg(F.first("v").alias("v")))
    sizes = {r["width"]: r["n"] for r in once.groupBy("width").agg(F.count("*").alias("n")).collect()}
    asked = materialise(_plain(queries, id_col, vector_col).withColumn("h", F.xxhash64("vec_id", "v")).groupBy("vec_id", "h").agg(F.first("v").alias("v")))
    found = None
    for width, n in sorted(sizes.items()):
        shards = max(1, -(-n // max(1, min(shard, SHARD_NUMBERS // width))))
        dealt = once.where(F.col("width") == width).select(F.pmod("h", F.lit(shards)).cast("int").alias("shard"), "vec_id", "v")
        index = materialise(dealt.repartition(shards, "shard").sortWithinPartitions("shard", "vec_id"))
        own = asked.where(F.size("v") == width)
        blocks = max(1, -(-own.count() // QUERY_BLOCK))
        for block in range(blocks):
            few = own.where(F.pmod(F.xxhash64("h"), F.lit(blocks)) == block).orderBy("vec_id", "h").toArrow()
            for at in range(0, len(few), QUERY_BLOCK):
                part = materialise(_pass(index, few.slice(at, QUERY_BLOCK), k, factor))
                found = part if found is None else found.unionByName(part)
    if found is None:
        return nearest(items, queries, id_col, vector_col, 0)
    rank = F.row_number().over(W.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _pass(index: DataFrame, few: pa.Table, k: int, factor: float) -> DataFrame:
    """(query_id, query, vec_id, score) of the best that each task's shards hold for a block of queries."""
    ids, vectors, marks = few.column("vec_id").to_numpy(), _matrix(few.column("v").combine_chunks()), few.column("h").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held = Best(ids, vectors, k), []

        def close() -> None:
            if held:
                search(Tree(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])), best, factor)
                held.clear()

        now = None
        try:
            for b in batches:
                shards = b.column(0).to_numpy()
                cuts = np.r_[0, np.flatnonzero(np.diff(shards)) + 1, len(shards)]
                for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                    if z > a:
                        if now is not None and shards[a] != now:
                            close()
                        now = shards[a]
                        held.append((b.column(1).slice(a, z - a).to_numpy(), _matrix(b.column(2).slice(a, z - a))))
            close()
            q, i = np.nonzero(~np.isinf(best.scores))
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(marks[q]), pa.array(best.ids[q, i]), pa.array(best.scores[q, i])], names=["query_id", "query", "vec_id", "score"])
        finally:
            release()

    return index.mapInArrow(run, "query_id long, query long, vec_id long, score double")
