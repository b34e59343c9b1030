"""SimHash near-duplicates: 64-bit fingerprints, linked at a Hamming budget through a pigeonring filter.

A fingerprint is cut into 8 segments of 8 bits on a ring. If two fingerprints differ in at most 3 bits, some chain of
consecutive segments starts at which the differences of its first l segments are at most l * 3 / 8, for every l.
So the first two segments agree and the next three hold one difference at most: two of those three agree as well.
Each start and each choice of those two gives an equality key of 32 bits; of the fingerprints that share a key, pairs
whose chain breaks its budgets are pruned before the full Hamming check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.storage import materialise
from newsloom.llm import shingles as sets
from newsloom.llm.common import batch, in_arrow, slices, utf8
from newsloom.operators.graph import connected_components

SEGMENTS, BITS, SEED = 8, 8, 42
#: A group of more fingerprints than this under one key is dealt out as pairs of chunks.
CHUNK = 1024
_FINGERPRINT = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
_LINK = pa.schema([("src", pa.int64()), ("dst", pa.int64())])


def _majority(parts: Iterator[np.ndarray]) -> int:
    """The bits that over half of the hashes have, as an unsigned number; 0 without a hash."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in parts:
        for at in range(0, len(hashes), 1 << 16):
            bits = np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def simhash(data: bytes, shingle: int = 3) -> int:
    """The fingerprint of UTF-8 text, lower-cased in A-Z, as an unsigned number; 0 if it has no word."""
    return _majority(sets.hashes(data, shingle, SEED))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long. Null text counts as empty."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 500):
            fps = np.array([simhash(x.as_py() or b"", shingle) for x in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], schema=_FINGERPRINT)

    return in_arrow(df.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text")), score, "doc_id long, fp long")


def budgets(distance: int) -> list[int]:
    """The most differences in the first 1, 2, ... segments of a chain."""
    return [(length * distance) // SEGMENTS for length in range(1, SEGMENTS + 1)]


def _shape(distance: int) -> tuple[int, int]:
    """Segments at a chain's start that agree; segments after them that hold one difference at most."""
    most = budgets(distance)
    return most.count(0), most.count(1)


def chain_keys(fp: Column, distance: int) -> list[Column]:
    """The equality keys of a fingerprint: the agreeing bits, with the start and the choice in the free low bits."""
    equal, loose = _shape(distance)
    whole = (1 << BITS) - 1
    keys = []
    for start in range(SEGMENTS):
        ring = fp if not start else F.shiftleft(fp, start * BITS).bitwiseOR(F.shiftrightunsigned(fp, 64 - start * BITS))
        for left_out in range(max(1, loose)):
            kept = [*range(equal), *(equal + i for i in range(loose) if i != left_out)]
            mask = sum(whole << (64 - (s + 1) * BITS) for s in kept)
            mask -= 1 << 64 if mask >> 63 else 0
            keys.append(ring.bitwiseAND(F.lit(mask)).bitwiseOR(F.lit(start * 8 + left_out)))
    return keys


def _linked(x: np.ndarray, y: np.ndarray, start: np.ndarray, distance: int) -> np.ndarray:
    """Which pairs pass the chain's budgets from their key's start, and then the full Hamming check."""
    differ = x ^ y
    parts = np.bitwise_count(differ.astype(">u8").view(np.uint8).reshape(-1, SEGMENTS))
    ring = (start[:, None] + np.arange(SEGMENTS)) % SEGMENTS
    chain = np.cumsum(np.take_along_axis(parts, ring, axis=1), axis=1) <= np.array(budgets(distance))
    return chain.all(axis=1) & (np.bitwise_count(differ) <= distance)


def _forest(fps: np.ndarray, start: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is linked within one group, one fewer than its members at most."""
    left, src, dst = np.ones(len(fps), bool), [], []
    for seed in range(len(fps)):
        stack = [seed] if left[seed] else []
        left[seed] = False
        while stack:
            i = stack.pop()
            open_ = np.flatnonzero(left)
            near = open_[_linked(fps[open_], np.full(len(open_), fps[i]), np.full(len(open_), start), distance)]
            left[near] = False
            stack.extend(near.tolist())
            src.append(np.full(len(near), fps[i]))
            dst.append(fps[near])
    return np.concatenate(src or [fps[:0]]), np.concatenate(dst or [fps[:0]])


def _runs(ids: np.ndarray, key: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """The links of whole groups; ids numbers the groups in ascending order."""
    edges = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1], True])
    sizes = np.diff(edges)
    src, dst = [fps[:0]], [fps[:0]]
    small = np.repeat(sizes <= 8, sizes)
    for shift in range(1, 8):
        i = np.flatnonzero(small[:-shift] & (ids[shift:] == ids[:-shift])) if len(ids) > shift else np.empty(0, int)
        ok = _linked(fps[i], fps[i + shift], (key[i] & 0xFF) >> 3, distance) if len(i) else np.empty(0, bool)
        src.append(fps[i[ok]])
        dst.append(fps[i[ok] + shift])
    for n in np.flatnonzero(sizes > 8):
        own = slice(edges[n], edges[n + 1])
        a, b = _forest(fps[own], int(key[edges[n]] & 0xFF) >> 3, distance)
        src.append(a)
        dst.append(b)
    return np.concatenate(src), np.concatenate(dst)


def links(distinct: DataFrame, distance: int = 3) -> DataFrame:
    """(src, dst) among distinct fingerprints fp: enough links at the distance to keep together all it joins.

    Groups under one key of over CHUNK fingerprints are dealt by hash into chunks, and each pair of chunks is a group
    of its own, so no task holds more than two chunks and no link is lost.
    """
    keyed = distinct.select(F.explode(F.array(*chain_keys(F.col("fp"), distance))).alias("key"), "fp")
    crowded = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = (
        keyed.join(crowded, "key").withColumn("parts", parts).withColumn("own", own)
        .select("key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        .select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp")
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                new = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
                a, b = _runs(np.r_[0, np.cumsum(new)], rows[:, 0], rows[:, 3].view(np.uint64), distance)
                yield batch({"src": a.view(np.int64), "dst": b.view(np.int64)}, _LINK)

        for b in batches:
            if not b.num_rows:
                continue
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns], axis=1)
            rows = np.concatenate([*held, rows])
            last = np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(axis=1))
            cut = last[-1] + 1 if len(last) else 0
            yield from flush(np.ascontiguousarray(rows[:cut]))
            held = [rows[cut:]]
        if held:
            yield from flush(np.ascontiguousarray(held[0]))

    return in_arrow(dealt.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b"), join, "src long, dst long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """(doc_id, fp, fingerprint, component_id) of every row of df.

    Fingerprints link at distance or fewer differing bits (1 to 7); component_id is the smallest doc_id reachable. Null and
    empty texts have fingerprint zero and link like any other; repeated rows are returned as often as they come; null
    ids are kept and never smallest (a component of null ids only has a null component_id). An empty table gives none.
    Exact copies meet in one aggregate with partial sums, so a group of any size costs one row in what follows.
    """
    if not 0 < distance < SEGMENTS:
        raise ValueError("distance must be from 1 to 7")
    marked = materialise(fingerprints(df, id_col, text_col, shingle))
    firsts = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    joined = connected_components(links(firsts.select("fp"), distance))
    named = firsts.join(joined, firsts.fp == joined.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("label"))
    lowest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    classes = named.join(lowest, "label").select("fp", "component_id")
    return marked.join(classes, "fp").select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, distance: int = 3) -> DataFrame:
    """df's rows without near-duplicates: of each group the row of the smallest id stays, of equal ids the first by a hash.

    Texts link at a Jaccard similarity of 0.8 or more of their sets of shingles. Fingerprints of those shingles that link at distance
    or fewer differing bits are candidates first; they hold most copies together, at one link a copy. As similar texts often
    differ in more bits than segments of 64 can find, sets that share a prefix key meet after that, unless they are joined
    already; every link is counted over the whole sets, and no pair is lost but to a collision of 64-bit hashes.
    Null texts count as empty; texts without words link to each other. Null ids come last, and rows alike in all columns count once.
    Of the sets under a crowded key all meet the least changed ones; after that only those meet that are not joined yet, in
    pairs of chunks, so that a large group of copies costs few pairs.
    """
    rows = df.withColumn("__row", F.xxhash64(*df.columns))
    docs = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col("__row").alias("row"), F.coalesce(utf8(text_col), F.lit(b"")).alias("text"))
    common, counts = sets.frequent(docs, "row", shingle, SEED)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = pa.list_(pa.int64())
        for b in slices(batches, 500):
            out = []
            for x in b.column(2):
                parts = list(sets.hashes(x.as_py(), shingle, SEED))
                own = sets.distinct(parts)
                keys, tasks = sets.prefix(own, common, counts)
                out.append((sets.name(own), len(own), np.uint64(_majority(iter(parts))).view(np.int64), sets.sketch(own), keys.view(np.int64), tasks))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), lists, lists)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))], names=["doc_id", "row", "name", "size", "fp", "sketch", "keys", "tasks"])

    marked = in_arrow(docs, mark, "doc_id long, row long, name long, size long, fp long, sketch binary, keys array<long>, tasks array<long>")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row")).alias("least")
    classes = materialise(marked.groupBy("name").agg(least, *(F.first(c).alias(c) for c in ("size", "fp", "sketch", "keys", "tasks"))).withColumn("row", F.col("least.row")))
    alike = lambda pairs: sets.alike(docs, classes, pairs, shingle, SEED)

    firsts = materialise(classes.groupBy("fp").agg(F.min("name").alias("head")))
    same = classes.select("fp", "name").join(firsts, "fp").where("name != head").select(F.least("name", "head").alias("a"), F.greatest("name", "head").alias("b"))
    ends = links(firsts.select("fp"), distance).distinct().join(firsts.select(F.col("fp").alias("src"), F.col("head").alias("x")), "src").join(firsts.select(F.col("fp").alias("dst"), F.col("head").alias("y")), "dst")
    linked = alike(same.union(ends.select(F.least("x", "y"), F.greatest("x", "y"))).distinct())
    joined = materialise(connected_components(linked, "a", "b"))
    # Later links meet the components found so far, each a star already, not their edges once more.
    join_more = lambda pairs: materialise(connected_components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(pairs), "a", "b"))

    both = F.arrays_zip("keys", "tasks")
    keyed = classes.select("name", "size", F.posexplode(both).alias("pos", "k")).select(
        F.col("k.keys").alias("key"), F.pmod("name", "k.tasks").alias("deal"), "name", (F.shiftleft(F.col("pos").cast("long"), 32) + F.col("size")).alias("place"), F.col("k.tasks").alias("parts")
    )
    schema = "key long, a long, b long, place long"
    met = materialise(in_arrow(keyed.repartition("key", "deal").sortWithinPartitions("key", "deal", "place", "name"), sets.meet, schema))
    joined = join_more(alike(_apart(met.where("key = 0").select("a", "b").distinct(), joined)))

    crowd = met.where("key != 0").select("key", F.col("a").alias("name"), "place")
    labelled = crowd.join(joined, crowd.name == joined.node, "left").select("key", "name", "place", F.coalesce("component", "name").alias("label"))
    split = labelled.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("low != high")
    left = materialise(labelled.join(split.select("key", "n"), "key").withColumn("parts", F.ceil(F.col("n") / sets.CHUNK).cast("int")))
    if not left.isEmpty():
        own = F.pmod(F.xxhash64("name"), F.col("parts")).cast("int")
        dealt = left.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        chunks = dealt.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "name", "place", "label")
        late = in_arrow(chunks.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "name"), sets.cross, schema)
        joined = join_more(alike(late.select("a", "b").distinct()))
    named = classes.join(joined, classes.name == joined.node, "left").select("least", F.coalesce("component", "name").alias("label"))
    kept = named.groupBy("label").agg(F.min("least").alias("least")).select(F.col("least.row").alias("__row"))
    return rows.dropDuplicates(["__row"]).join(kept, "__row", "left_semi").select(*df.columns)


def _apart(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """The pairs (a, b) that are not in one component yet."""
    side = lambda n: joined.select(F.col("node").alias(n), F.col("component").alias(f"in_{n}"))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return both.where(F.col("in_a").isNull() | F.col("in_b").isNull() | (F.col("in_a") != F.col("in_b"))).select("a", "b")
