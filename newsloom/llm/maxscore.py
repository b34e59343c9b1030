"""Ranked lexical search: an inverted index in shards, and MaxScore over each shard.

A shard's posting lists carry upper bounds, the largest score that a list gives a document of the shard. In ascending order of
bounds, the lists whose bounds together stay below the score of the k-th best document are non-essential: a document that only
they hold cannot qualify. Documents come from the essential lists; the others are probed, the largest bound first, for those
documents that can still qualify with what is left. Nothing that belongs to the result is lost.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions.storage import materialise
from newsloom.llm.common import in_arrow, slices, utf8, word_blocks

#: Terms (repeats counted) and documents after which a shard is closed; documents that are scored at once.
SHARD_TERMS, SHARD_DOCS, BLOCK = 1_500_000, 1 << 16, 1024
#: Distinct terms of the items that go to all shards at once, and results of an item.
ITEM_TERMS, MOST = 200_000, 50
#: Bytes of terms stay, A-Z as a-z, and all others are blanks.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_INDEX = {"docs": "long", "n_terms": "long", "ids": "binary", "without": "binary", "lengths": "binary", "terms": "binary", "starts": "binary", "posts": "binary", "tfs": "binary", "tf_bytes": "int"}
_KINDS = {"long": pa.int64(), "binary": pa.binary(), "int": pa.int32()}


def terms(data: bytes) -> Iterator[list[bytes]]:
    """The terms of UTF-8 text in order, in lists: runs of letters and digits of ASCII and of anything beyond, A-Z in lower case."""
    return word_blocks(data.translate(_FOLD))


class _Shard:
    """A shard under construction: each document's terms as codes, term * SHARD_DOCS + document, repeats included."""

    def __init__(self):
        self.vocabulary: defaultdict[bytes, int] = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__  # an unknown term gets the next number
        self.codes, self.counts, self.ids, self.lengths, self.size = [], [], [], [], 0

    def add(self, doc_id: int | None, data: bytes) -> None:
        numbers, own, n = self.vocabulary, len(self.ids), 0
        parts = []
        for block in terms(data):
            parts.append(np.unique(np.fromiter(map(numbers.__getitem__, block), np.int64, len(block)), return_counts=True))
            n += len(block)
        if not n:
            return
        found, counts = parts[0]
        if len(parts) > 1:
            found, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)
        self.codes.append(found * SHARD_DOCS + own)
        self.counts.append(counts)
        self.ids.append(doc_id)
        self.lengths.append(n)
        self.size += n

    def full(self) -> bool:
        return self.size >= SHARD_TERMS or len(self.ids) >= SHARD_DOCS

    def row(self) -> pa.RecordBatch:
        codes, tfs = np.concatenate(self.codes), np.concatenate(self.counts)
        order = np.argsort(codes, kind="stable")
        codes, tfs = codes[order], tfs[order]
        width = next(w for w in (1, 2, 4, 8) if int(tfs.max()) < 1 << (8 * w))
        starts = np.searchsorted(codes, np.arange(len(self.vocabulary) + 1) * SHARD_DOCS)
        without = np.array([i is None for i in self.ids])
        values = (
            len(self.ids), self.size, np.array([i or 0 for i in self.ids], np.int64).tobytes(), without.tobytes(), np.array(self.lengths, np.int64).tobytes(),
            b" ".join(self.vocabulary), starts.astype(np.int64).tobytes(), (codes % SHARD_DOCS).astype(np.uint16).tobytes(), tfs.astype(f"u{width}").tobytes(), width,
        )
        return pa.RecordBatch.from_arrays([pa.array([v], _KINDS[k]) for v, k in zip(values, _INDEX.values(), strict=True)], names=[*_INDEX])


def index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index of all texts, whole, written to the shared folder: a row a shard, its arrays as bytes.

    A shard is a run of rows of one task, closed after SHARD_TERMS terms or SHARD_DOCS documents, so no text is shuffled and a task holds one
    shard's numbers. Rows without a term (null and empty texts too) are in no shard; a row without an id is, and so is each
    row of an id that repeats.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for b in slices(batches, 500):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                shard.add(doc_id, text.as_py() or b"")
                if shard.full():
                    yield shard.row()
                    shard = _Shard()
        if shard.ids:
            yield shard.row()

    return materialise(in_arrow(df.select(F.col(id_col).cast("long"), utf8(text_col)), run, ", ".join(f"{c} {t}" for c, t in _INDEX.items())))


def _wanted(blob: bytes, wanted: dict[bytes, int]) -> list[tuple[int, int]]:
    """(place in the shard, number) of the wanted terms that a shard has."""
    return [(i, wanted[t]) for i, t in enumerate(blob.split(b" ")) if t in wanted]


def frequencies(shards: DataFrame, wanted: dict[bytes, int]) -> dict[int, int]:
    """In how many documents of all shards each of the wanted terms is, by its number. Sums of shards meet, no lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), np.int64)
        for b in batches:
            for blob, starts in zip(b.column(0), b.column(1), strict=True):
                sizes = np.diff(np.frombuffer(starts.as_buffer(), np.int64))
                for place, number in _wanted(blob.as_py(), wanted):
                    total[number] += sizes[place]
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["number", "df"])

    found = shards.select("terms", "starts").mapInArrow(run, "number long, df long")
    return {r["number"]: r["df"] for r in found.groupBy("number").agg(F.sum("df").alias("df")).collect()}


def weight(n_docs: int, df: int) -> int:
    return floor(1000 * log((2 * n_docs + 2) / (2 * df + 1)))


class Top:
    """The k best documents of one item so far, as rows of (score, without an id, id); and how many postings were looked at."""

    def __init__(self, k: int):
        self.k, self.scores, self.without, self.ids, self.looked = k, np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64), 0

    @property
    def least(self) -> int:
        """The score below which no document qualifies."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def offer(self, scores: np.ndarray, without: np.ndarray, ids: np.ndarray) -> None:
        s, w, i = np.concatenate([self.scores, scores]), np.concatenate([self.without, without]), np.concatenate([self.ids, ids])
        order = np.lexsort((i, w, -s))[: self.k]
        self.scores, self.without, self.ids = s[order], w[order], i[order]


def max_score(lists: list[tuple[np.ndarray, np.ndarray, int]], n_docs: int, ids: np.ndarray, without: np.ndarray, top: Top) -> None:
    """Give top a shard's documents that qualify. lists: of each of the item's terms its documents (ascending), their scores, and the largest of these."""
    lists = sorted((x for x in lists if x[2] > 0), key=lambda x: x[2])
    below = np.cumsum([0, *(x[2] for x in lists)])  # below[i]: the most that the first i lists give together
    if below[-1] < top.least:
        return
    edges = np.arange(0, n_docs + BLOCK, BLOCK)
    cuts = [np.searchsorted(x[0], edges) for x in lists]
    scores = np.zeros(BLOCK, np.int64)
    for b in range(len(edges) - 1):
        essential = int(np.searchsorted(below, top.least)) - 1  # the lists before it stay below the least score together
        if essential >= len(lists):
            return
        scores[:] = 0
        for (docs, given, _), cut in zip(lists[essential:], cuts[essential:], strict=True):
            own = slice(cut[b], cut[b + 1])
            scores[docs[own] - edges[b]] += given[own]
            top.looked += own.stop - own.start
        found = np.flatnonzero(scores)
        for i in range(essential - 1, -1, -1):
            found = found[scores[found] + below[i + 1] >= top.least]
            if not len(found):
                break
            docs, given = lists[i][0][cuts[i][b] : cuts[i][b + 1]], lists[i][1][cuts[i][b] : cuts[i][b + 1]]
            if len(docs):
                at = np.minimum(np.searchsorted(docs, found + edges[b]), len(docs) - 1)
                hit = docs[at] == found + edges[b]
                scores[found[hit]] += given[at[hit]]
                top.looked += len(found)
        found = found[scores[found] >= top.least]
        if len(found):
            top.offer(scores[found], without[found + edges[b]], ids[found + edges[b]])


def search(shards: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text", k: int = MOST) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for each item, equal scores by ascending doc_id, rows without an id last.

    shards: of index(). With N documents that have terms, L their terms with repeats, n a document's, df a term's documents and tf its
    occurrences in the document: a term's weight w is floor(1000 * ln((2N + 2) / (2df + 1))), a document's m is
    50 + 50nN div L, and its score the sum of w * (10^9 tf div (1000tf + 20m)) over the item's distinct terms, in 64-bit integers.

    Items go to the shards in blocks of about ITEM_TERMS distinct terms, the only ones the driver sees, with their frequencies; each block is a
    pass over the shards that writes k rows an item and task. Items without terms find nothing; rows alike in id and terms count once, and of one id's
    unlike rows each has its own ranks. Of an empty index nothing is found.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 200):
            own = [sorted({t for block in terms(x.as_py() or b"") for t in block}) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.list_(pa.binary()))], names=["item_id", "terms"])

    split = in_arrow(items.select(F.col(item_col).cast("long").alias("item_id"), utf8(text_col).alias("text")), read, "item_id long, terms array<binary>")
    asked = materialise(split.where(F.size("terms") > 0).distinct().withColumn("item", F.xxhash64("item_id", "terms")))
    total = shards.agg(F.sum("docs"), F.sum("n_terms")).first()
    blocks = max(1, -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // ITEM_TERMS))
    found = None
    for block in range(blocks if total[0] else 0):
        few = [(r["item"], r["item_id"], [bytes(t) for t in r["terms"]]) for r in asked.where(F.pmod("item", F.lit(blocks)) == block).orderBy("item").collect()]
        wanted = {t: i for i, t in enumerate(dict.fromkeys(t for _, _, own in few for t in own))}
        held = frequencies(shards, wanted)
        weights = [weight(total[0], held[i]) if i in held else 0 for i in range(len(wanted))]
        part = _pass(shards, [(item, item_id, [wanted[t] for t in own]) for item, item_id, own in few], wanted, weights, *total, k)
        part = materialise(part) if blocks > 1 else part
        found = part if found is None else found.unionByName(part)
    if found is None:
        return items.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    rank = F.row_number().over(W.partitionBy("item_id", "item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _pass(shards: DataFrame, few: list[tuple[int, int, list[int]]], wanted: dict[bytes, int], weights: list[int], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, item_id, doc_id, score) of the best that each task's shards hold for a block of items; a task's later shards start from the scores of its earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = [Top(k) for _ in few]
        for row in (b.slice(i, 1) for b in batches for i in range(b.num_rows)):
            col = {c: row.column(c)[0] for c in row.schema.names}
            array = lambda c, kind, col=col: np.frombuffer(col[c].as_buffer(), kind)
            ids, without, starts = array("ids", np.int64), array("without", bool), array("starts", np.int64)
            norm = 20 * (50 + 50 * array("lengths", np.int64) * n_docs // n_terms)
            posts, tfs, lists = array("posts", np.uint16), array("tfs", f"u{col['tf_bytes'].as_py()}"), {}
            for place, number in _wanted(col["terms"].as_py(), wanted):
                own = slice(starts[place], starts[place + 1])
                docs, tf = posts[own].astype(np.int64), tfs[own].astype(np.int64)
                given = weights[number] * (1_000_000_000 * tf // (1000 * tf + norm[docs]))
                lists[number] = (docs, given, int(given.max()))
            for top, (_, _, own) in zip(tops, few, strict=True):
                max_score([lists[t] for t in own if t in lists], len(ids), ids, without, top)
        for top, (item, item_id, _) in zip(tops, few, strict=True):
            if n := len(top.scores):
                columns = (pa.array([item] * n, pa.int64()), pa.array([item_id] * n, pa.int64()), pa.array(top.ids, mask=top.without), pa.array(top.scores))
                yield pa.RecordBatch.from_arrays([*columns], names=["item", "item_id", "doc_id", "score"])

    # A row is a whole shard, and a task's rows are those of one file split, whose size Spark bounds.
    return shards.mapInArrow(run, "item long, item_id long, doc_id long, score long")
