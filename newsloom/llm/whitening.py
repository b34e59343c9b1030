"""Embedding whitening: blockwise TSQR of the centred rows, then one-sided Jacobi rotations of R's columns.

The numbers become integers first, so that counts and sums are exact and a row is centred by one rounding. Each task folds its centred rows,
block by block, into one triangular R; R's meet in rounds of FAN until one is left, with the singular values of the whole
matrix. Plane rotations make R's columns orthogonal; their lengths are the singular values, accurate also where they are small as no
product R'R is made, and the accumulated rotations are the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.storage import materialise
from newsloom.llm.common import release

#: Numbers become floor(SCALE * c) + OFFSET. Rows of a block; triangles that meet in one; components returned.
SCALE, OFFSET, ROWS, FAN, COMPONENTS = 1024, 100_000, 2048, 16, 8
#: Rotations end after so many sweeps, or when no two columns have a cosine above this.
SWEEPS, ORTHOGONAL = 60, 1e-15
_MOST = float(1 << 62)


def valid(vector: Column) -> Column:
    """Whether a vector is not null or empty and holds finite numbers only, each of which has an integer of 64 bits."""
    numbers = ~F.exists(vector.cast("array<double>"), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) > _MOST / SCALE))
    return vector.isNotNull() & (F.size(vector) > 0) & numbers


def _integers(column: pa.Array) -> np.ndarray:
    """floor(SCALE * c) + OFFSET of the vectors of a batch, which all have one width."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (np.floor(SCALE * flat).astype(np.int64) + OFFSET).reshape(len(column), -1)


class Centre:
    """Rows minus their mean. The mean is n and the exact sums s, the numerator n * x - s an integer where 64 bits hold it."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums, self.mean = n, sums, np.array([s / n for s in sums])
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """x - s / n: the difference to the mean's whole part is exact, and its fraction is taken off in one rounding."""
        return (x - self.whole) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum over a row of (n * x - s)^2, exact; null where it is beyond 64 bits."""
        away = x - self.whole  # n * x - s = n * away - rest
        about = ((float(self.n) * away - self.rest) ** 2).sum(axis=1) / 2.0**63
        out = np.full(len(x), None)
        small, open_ = about < 1 - 1e-9, (about >= 1 - 1e-9) & (about < 1 + 1e-9)
        out[small] = ((self.n * away[small] - self.rest) ** 2).sum(axis=1)  # each square and their sum are within 64 bits
        for i in np.flatnonzero(open_):
            exact = sum((self.n * int(a) - int(r)) ** 2 for a, r in zip(away[i], self.rest, strict=True))
            out[i] = exact if exact < 1 << 63 else None
        return out.tolist()


def triangle(parts: Iterator[np.ndarray], width: int) -> np.ndarray:
    """R of the parts put on top of one another, folded in one after the other."""
    r = np.zeros((0, width))
    for p in parts:
        r = np.linalg.qr(np.vstack([r, p]), mode="r")
    return r


def _rounds(n: int) -> list[np.ndarray]:
    """Each pair of n columns once, as rounds of pairs that share no column (a round-robin tournament)."""
    seats, out = list(range(n + n % 2)), []
    for _ in range(len(seats) - 1):
        half = len(seats) // 2
        pairs = [(a, b) for a, b in zip(seats[:half], reversed(seats[half:]), strict=True) if max(a, b) < n]
        out.append(np.array(pairs, np.int64).reshape(-1, 2))
        seats = [seats[0], seats[-1], *seats[1:-1]]
    return out


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of r, falling, and its right singular vectors as columns, by one-sided rotations.

    A rotation makes two columns orthogonal; the pairs of a round share no column and turn together. Sweeps end when no pair was turned.
    """
    a, v = r.copy(), np.eye(r.shape[1])
    rounds = _rounds(r.shape[1])
    for _ in range(SWEEPS):
        turned = False
        for pairs in rounds:
            p, q = pairs[:, 0], pairs[:, 1]
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            go = np.abs(xy) > ORTHOGONAL * np.sqrt(xx * yy)
            if not go.any():
                continue
            turned = True
            p, q, x, y, xx, yy, xy = p[go], q[go], x[:, go], y[:, go], xx[go], yy[go], xy[go]
            zeta = (yy - xx) / (2 * xy)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            c = 1 / np.hypot(1, t)
            s = c * t
            a[:, p], a[:, q] = c * x - s * y, s * x + c * y
            left, right = v[:, p], v[:, q]
            v[:, p], v[:, q] = c * left - s * right, s * left + c * right
        if not turned:
            break
    sizes = np.linalg.norm(a, axis=0)
    order = np.argsort(-sizes, kind="stable")
    return sizes[order], v[:, order]


def _sums(rows: DataFrame) -> tuple[int, int, list[int]]:
    """(width, n, sums) of the width that most vectors have, the larger of equals. Sums meet by dimension; one row a dimension reaches the driver."""
    names = ["width", "dim", "n", "s"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[int, np.ndarray]] = {}
        for b in batches:
            sizes = b.column(0).value_lengths().to_numpy(zero_copy_only=False)
            for width in np.unique(sizes).tolist():
                x = _integers(b.column(0).filter(pa.array(sizes == width)))
                high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)  # halves, so that no sum leaves 64 bits
                n, old = total.get(width, (0, np.zeros((2, width), np.int64)))
                total[width] = n + len(x), old + np.stack([high, low])
        for width, (n, (high, low)) in total.items():
            sums = [str((int(h) << 32) + int(lo)) for h, lo in zip(high, low, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([width] * width), pa.array(range(width), pa.int64()), pa.array([n] * width, pa.int64()), pa.array(sums)], names=names)

    made = rows.select("v").mapInArrow(run, "width long, dim long, n long, s string")
    each = materialise(made.groupBy("width", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")))
    top = each.where("dim = 0").orderBy(F.desc("n"), F.desc("width")).first()
    if not top:
        return 0, 0, []
    own = each.where(F.col("width") == top["width"]).orderBy("dim").collect()
    return top["width"], top["n"], [int(r["s"]) for r in own]


def _triangle(rows: DataFrame, centre: Centre, width: int) -> np.ndarray:
    """R of all centred rows: one for each task, then of FAN at a time, until one is left."""
    schema = "part long, r binary"

    def out(part: int, r: np.ndarray) -> pa.RecordBatch:
        full = np.zeros((width, width))
        full[: len(r)] = r
        return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([full.tobytes()])], names=["part", "r"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (centre(_integers(b.column(0).slice(at, ROWS))) for b in batches for at in range(0, b.num_rows, ROWS))
        r = triangle(parts, width)
        if len(r):
            yield out(0, r)
        release()

    def meet(few: pa.Table) -> pa.Table:
        return pa.Table.from_batches([out(0, triangle((np.frombuffer(x.as_buffer()).reshape(width, width) for x in few.column("r")), width))])

    now = materialise(rows.select("v").mapInArrow(fold, schema))
    while (n := now.count()) > 1:
        groups = -(-n // FAN)
        # Hashes of what the triangles hold deal them out about evenly; any grouping gives the same R but for rounding and signs.
        dealt = now.withColumn("part", F.pmod(F.xxhash64("r"), F.lit(groups)))
        now = materialise(dealt.groupBy("part").applyInArrow(meet, schema))
    return np.frombuffer(bytes(now.first()["r"])).reshape(width, width)


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each valid vector and component.

    With x = floor(1024 c) + 100000 of each entry, n vectors and their sums S: the components are the unit eigenvectors of x's covariance
    (divisor n) by falling eigenvalue e, numbered from 1, components of them at most; whitened is x - S / n projected on one,
    over sqrt(e); explained is e over the covariance's trace; deviation is the sum of (n x - S)^2, exact, or null beyond 64 bits; identity_error
    is the largest absolute entry of whitened's covariance minus the identity, measured on the rows.

    Vectors that are null or empty, hold null or non-finite entries or such as leave 64 bits, and vectors of another width than most have (the
    larger of equally frequent widths stays) take no part. Rows that repeat count as often as they come, and null ids are kept.
    Components of no variance (beyond rounding) are left out: fewer rows than dimensions, or equal ones, give fewer
    components, and an empty table or one of equal vectors gives no row.

    The driver holds one number a dimension, R, and the components; rows are read in four passes, each a sum with one row (or
    R) a task before the shuffle.
    """
    empty = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(valid(F.col("v")))
    width, n, sums = _sums(rows)
    if not n:
        return df.sparkSession.createDataFrame([], empty)
    rows, centre = rows.where(F.size("v") == width), Centre(n, sums)
    sizes, turns = jacobi(_triangle(rows, centre, width))
    held = int((sizes[:components] > sizes[0] * width * np.finfo(float).eps).sum()) if sizes[0] > 0 else 0
    if not held:
        return df.sparkSession.createDataFrame([], empty)
    values = sizes**2 / n
    project, explained = turns[:, :held] / np.sqrt(values[:held]), values[:held] / values.sum()

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's rows, their mean, and their products about that mean, block by block."""
        for b in batches:
            w = centre(_integers(b.column(0))) @ project
            if len(w):
                mean = w.mean(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array([len(w)]), pa.array([mean.tolist()]), pa.array([((w - mean).T @ (w - mean)).ravel().tolist()])], names=["k", "mean", "products"])

    error = _identity_error(materialise(rows.select("v").mapInArrow(moments, "k long, mean array<double>, products array<double>")), held, n)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(at, ROWS) for at in range(0, whole.num_rows, ROWS)):
                x, k = _integers(b.column(1)), b.num_rows
                repeat = lambda values: pa.array(np.repeat(values, held))
                ids = b.column(0).take(repeat(np.arange(k)))
                away = pa.array(centre.deviations(x), pa.int64()).take(repeat(np.arange(k)))
                fixed = [pa.array(np.tile(np.arange(1, held + 1, dtype=np.int32), k)), pa.array(np.full(k * held, n))]
                made = [pa.array((centre(x) @ project).ravel()), pa.array(np.tile(explained, k)), pa.array(np.full(k * held, error))]
                yield pa.RecordBatch.from_arrays([ids, *fixed, away, *made], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
        release()

    return rows.select("vec_id", "v").mapInArrow(score, empty)


def _identity_error(parts: DataFrame, held: int, n: int) -> float:
    """The largest entry of the covariance minus the identity, from blocks' means and products about them. Sums by place reach the driver, held^2 numbers."""
    means = parts.select("k", F.posexplode("mean").alias("i", "m")).groupBy("i").agg((F.sum(F.col("k") * F.col("m")) / n).alias("m")).orderBy("i").collect()
    mean = F.array(*(F.lit(r["m"]) for r in means))
    apart = F.zip_with("mean", mean, lambda a, b: a - b)
    between = F.flatten(F.transform(apart, lambda a: F.transform(apart, lambda b: a * b * F.col("k"))))
    both = parts.select(F.posexplode(F.zip_with("products", between, lambda a, b: a + b)).alias("i", "x")).groupBy("i").agg((F.sum("x") / n).alias("x"))
    cov = np.array([r["x"] for r in both.orderBy("i").collect()]).reshape(held, held)
    return float(np.abs(cov - np.eye(held)).max())
