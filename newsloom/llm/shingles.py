"""Sets of word shingles: their hashes, prefix keys and sketches, and which sets are similar enough.

The distinct shingles of a text are put in one order for all texts, rare ones first. Two sets of similarity NUM / DEN or more share
one of the first n - ceil(NUM / DEN * n) + 1 shingles of either, so only sets that share such a key meet. Of those, sizes,
positions and the Hamming distance of parity sketches rule out most; the similarity of what is left is counted over the
whole sets. None of these bounds loses a pair. Any order finds every pair; which shingles are common is taken from a sample, for
speed alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from newsloom.functions.storage import materialise
from newsloom.llm.common import in_arrow, slices, word_blocks

#: The least similarity of a link, as a fraction.
NUM, DEN = 4, 5
#: Sets under one key that all meet at once; of more only the first CENTRES meet the others, those with the fewest rarer
#: shingles, which are the least changed of copies. Rows of a key that one task gets before it is dealt to several, by the
#: sample's estimate. Rows of a chunk of what is left at the end.
SMALL, CENTRES, HOT, CHUNK = 32, 2, 2000, 1024
#: Texts of which one is in the sample for the order, and common shingles known of it.
SAMPLED, COMMON = 64, 100_000
#: Bits by which wanted rows are told from others before their texts are read again.
WANTED = 1 << 24
_PAIR = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("place", pa.int64())])
_PLACE = np.int64(2**32)


def hashes(data: bytes, shingle: int, seed: int) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles, repeats included, block by block; a text of fewer words is one shingle, of none no."""
    carry, n = [], 0
    for block in word_blocks(data.lower()):
        words = carry + block
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
        yield (got := np.fromiter(map(xxh64_intdigest, grams, repeat(seed)), np.uint64))
        n += len(got)
        carry = words[max(0, len(words) - shingle + 1) :]
    if carry and not n:
        yield np.array([xxh64_intdigest(b" ".join(carry), seed)], np.uint64)


def distinct(parts: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def name(own: np.ndarray) -> int:
    """A set's name: equal sets have equal names."""
    return int(np.uint64(xxh64_intdigest(own.tobytes())).view(np.int64))


def sketch(own: np.ndarray) -> bytes:
    """Parity bits of a set, 2 to 4 for each element; 64 at least. Sketches differ in no more bits than sets differ in elements."""
    size = 64 << max(0, (len(own) - 1) // 32).bit_length()
    bits = np.bincount((own >> np.uint64(20)).astype(np.int64) % size, minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def sketches_differ(a: np.ndarray, b: np.ndarray) -> int:
    """In how many bits two sketches differ, the longer folded to the shorter's length: their bits are places modulo it."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    return int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)).sum())


def prefix(own: np.ndarray, common: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a set in order, rare shingles first and then by hash; and how many tasks each key's rows are dealt to."""
    if not len(own):
        return own, own.astype(np.int64)
    n = np.zeros(len(own), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        n = np.where(common[at] == own, counts[at], 0)
    by = np.lexsort((own, n))[: len(own) + 1 - -(-NUM * len(own) // DEN)]
    return own[by], np.maximum(1, -(-n[by] * SAMPLED // HOT))


def frequent(docs: DataFrame, row: str, shingle: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts (column text, as bytes) of a sample have, drawn by a hash of row, and in how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 500):
            for x in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(distinct([*hashes(x.as_py(), shingle, seed)]).view(np.int64))], names=["s"])

    sample = in_arrow(docs.where(F.pmod(F.xxhash64(row, F.lit(8)), F.lit(SAMPLED)) == 0).select("text"), run, "s long")
    top = sample.groupBy("s").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "s").limit(COMMON).toArrow()
    keys, n = top.column("s").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def may_link(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets that share their elements at these places (position and size), and none before, can be similar enough."""
    na, nb = a % _PLACE, b % _PLACE
    rest = np.minimum(na - a // _PLACE, nb - b // _PLACE)
    return (DEN * np.minimum(na, nb) >= NUM * np.maximum(na, nb)) & ((NUM + DEN) * rest >= NUM * (na + nb))


def groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    """Blocks of rows in order of their first columns; all rows that are equal in those are in one block."""
    held = None
    for b in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns], axis=1)
        rows = rows if held is None else np.concatenate([held, rows])
        turn = np.flatnonzero((rows[1:, :width] != rows[:-1, :width]).any(axis=1))
        cut = int(turn[-1]) + 1 if len(turn) else 0
        if cut:
            yield rows[:cut]
        held = rows[cut:]
    if held is not None and len(held):
        yield held


def _out(key: np.ndarray, a: np.ndarray, b: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(a), pa.array(b, mask=key != 0), pa.array(place)], schema=_PAIR)


def _pairs(rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """The pairs of rows (name in column 2, place in column 3) that may link."""
    ok = may_link(rows[i, 3], rows[j, 3])
    both = np.sort(rows[:, 2][np.stack([i[ok], j[ok]])], axis=0)
    both = np.unique(both, axis=1) if len(both[0]) > 1000 else both
    zero = np.zeros(len(both[0]), np.int64)
    return _out(zero, both[0], both[1], zero)


def _edges(rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the groups of equal first columns begin, and the last ends; of each row its group's size and start."""
    edges = np.flatnonzero(np.r_[True, (rows[1:, :width] != rows[:-1, :width]).any(axis=1), True])
    return edges, np.repeat(np.diff(edges), np.diff(edges)), np.repeat(edges[:-1], np.diff(edges))


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (key 0) of key, deal, name, place, parts in order of key and deal; of a crowded key also its rows (b null)."""
    for rows in groups(batches, 2):
        edges, size, start = _edges(rows, 2)
        few = np.flatnonzero((size <= SMALL) & (size > 1))
        for shift in range(1, SMALL):
            few = few[few + shift < start[few] + size[few]]
            if not len(few):
                break
            yield _pairs(rows, few, few + shift)
        for s in edges[:-1][np.diff(edges) > SMALL]:
            for centre in range(s, s + CENTRES):
                others = np.arange(centre + 1, s + size[s])
                yield _pairs(rows, np.full(len(others), centre), others)
        crowd = (size > SMALL) | (rows[:, 4] > 1)
        if crowd.any():
            own = rows[crowd]
            yield _out(own[:, 0] | (own[:, 0] == 0), own[:, 2], own[:, 2], own[:, 3])


def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of key, chunks (p, q), name, place, label in order of key and chunks, between unlike labels."""
    for rows in groups(batches, 3):
        _, size, start = _edges(rows, 3)
        rows = rows[:, [0, 1, 3, 4, 5]]
        left = np.arange(len(rows))
        for shift in range(1, int(size.max())):
            left = left[left + shift < start[left] + size[left]]
            own = left[rows[left, 4] != rows[left + shift, 4]]
            if len(own):
                yield _pairs(rows, own, own + shift)


def _near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches leave the similarity open."""
    side = lambda n: classes.select(F.col("name").alias(n), F.col("size").alias(f"size_{n}"), F.col("sketch").alias(f"sketch_{n}"))

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column(2).to_numpy() + b.column(3).to_numpy()
            sides = ([np.frombuffer(x.as_buffer(), np.uint64) for x in b.column(k)] for k in (4, 5))
            apart = np.fromiter(map(sketches_differ, *sides), np.int64, b.num_rows)
            yield b.select(["a", "b"]).filter(pa.array(apart * (NUM + DEN) <= sizes * (DEN - NUM)))

    both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("size_a", "size_b") * DEN >= F.greatest("size_a", "size_b") * NUM)
    return in_arrow(both.select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b"), open_, "a long, b long")


def _wanted(rows: DataFrame) -> np.ndarray:
    """WANTED bits, those of the hashes in the column row set: at most WANTED / 64 longs reach the driver, however many rows there are."""
    bit = F.pmod("row", F.lit(WANTED))
    words = rows.groupBy(F.floor(bit / 64).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(row, {WANTED}) % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros(WANTED // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


def alike(docs: DataFrame, classes: DataFrame, pairs: DataFrame, shingle: int, seed: int) -> DataFrame:
    """The (a, b) of distinct pairs of names whose sets are similar enough, counted over the whole sets.

    docs: row, text; classes: name, row (of one of its texts), size, sketch. Texts stay where they are: those that pairs want
    are told by their rows' bits, and their sets are sent to the pairs.
    """
    pairs = materialise(_near(pairs, classes))
    bits = _wanted(pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct().join(classes, "name"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(0).to_numpy() % WANTED
            for part in slices([b.filter(pa.array((bits[at // 64] >> (at % 64) & 1).astype(bool)))], 200):
                own = [distinct([*hashes(x.as_py(), shingle, seed)]) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([pa.array(map(name, own), pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], names=["name", "own"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(DEN * both >= NUM * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    read = in_arrow(docs.select("row", "text"), sets, "name long, own binary")
    found = materialise(read.groupBy("name").agg(F.first("own").alias("own")))
    side = lambda n, out: found.select(F.col("name").alias(n), F.col("own").alias(out))
    full = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    return materialise(in_arrow(full.select("a", "b", "x", "y"), check, "a long, b long"))
