"""Removal of repeated passages through recompression.

A document's words are symbols. In each round runs of one symbol and then pairs of symbols become new symbols, named by
a hash of what they stand for, so that every executor gives equal substrings equal names. A pair is joined if its
first symbol is of the round's left half of the alphabet and its second of the right half, so a decision depends on two
neighbours alone; caps on a new symbol's width bound what a substring's surroundings can change at its ends. With
ROUNDS below, the symbols within the inner 38 words of equal 50-word windows are the same, wherever these windows stand.

Every window takes as its key the least name of a chain of symbols (12 words at least) in that inner part. A Spark
round gathers the keys and leaves those of two documents or more; only windows under such shared keys are then compared,
by a hash of their 50 words beside the key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from newsloom.functions.storage import materialise
from newsloom.llm.common import in_arrow, slices, utf8, word_blocks

WINDOW = 50
#: For each round the most words of a joined run and of a joined pair. A round loses a run and all but a word of a pair at either end.
ROUNDS = ((2, 2), (0, 4))
LOST = sum(run + pair - 1 for run, pair in ROUNDS)
#: Least words of a chain; chains of a window start at one of REACH places.
CHAIN = 12
REACH = WINDOW - 2 * LOST - (CHAIN + ROUNDS[-1][1] - 1) + 1
#: Keys of more occurrences than this are resolved window by window.
CROWD = 2000
#: Words handled at a time.
BLOCK = 1 << 18
_NONE = np.uint64(2**64 - 1)
_P = 6364136223846793005
_INVERSE = pow(_P, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_P, 2 * BLOCK), _powers(_INVERSE, 2 * BLOCK)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _spans(names: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of names[start:end] for each start and end, alike wherever the names stand."""
    total = np.r_[np.uint64(0), np.cumsum(names * _UP[: len(names)], dtype=np.uint64)]
    return _mix((total[end] - total[start]) * _DOWN[start])


def recompress(names: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The top symbols' names, places and widths."""
    place = np.arange(len(names))
    for level, (run, pair) in enumerate(ROUNDS):
        if run and len(names):
            new = np.r_[True, names[1:] != names[:-1]]
            first = np.flatnonzero(new)
            length = np.diff(np.r_[first, len(names)])
            joined = (length > 1) & (length * width[first] <= run)
            at = first[joined]
            names, width = names.copy(), width.copy()
            names[at] = _mix(names[at] * np.uint64(3) + length[joined].astype(np.uint64))
            width[at] *= length[joined]
            keep = new | ~np.repeat(joined, length)
            names, width, place = names[keep], width[keep], place[keep]
        right = (_mix(names + np.uint64(level + 1)) & np.uint64(1)).astype(bool)
        at = np.flatnonzero(~right[:-1] & right[1:] & (width[:-1] + width[1:] <= pair))
        keep = np.ones(len(names), bool)
        keep[at + 1] = False
        names, width = names.copy(), width.copy()
        names[at] = _mix(names[at] * np.uint64(_P) + (names[at + 1] ^ (names[at + 1] >> np.uint64(17))))
        width[at] += width[at + 1]
        names, width, place = names[keep], width[keep], place[keep]
    return names, place, width


def window_keys(words: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For hashed words, with gaps between documents (True), each place's window key and window hash.

    Only places from which 50 words follow without a gap mean anything. The key is the same for equal windows.
    """
    n = len(words)
    names, place, width = recompress(words, np.where(gap, 1000, 1))
    end = np.r_[place[1:], n]
    last = np.searchsorted(end, place + CHAIN)
    gaps = np.r_[0, np.cumsum(gap)]
    whole = last < len(end)
    last = np.minimum(last, len(end) - 1)
    whole &= gaps[end[last]] == gaps[place]
    least = np.full(n, _NONE)
    i = np.flatnonzero(whole)
    least[place[i]] = _spans(names, i, last[i] + 1)
    size, done = 1, least
    while size * 2 <= REACH:
        done = np.minimum(done[:-size], done[size:])
        size *= 2
    done = np.minimum(done[: n - REACH + 1], done[REACH - size :])
    starts = np.arange(n - WINDOW + 1)
    return done[LOST:][: len(starts)], _spans(words, starts, starts + WINDOW)


def hashed(data: bytes) -> np.ndarray:
    return np.concatenate([np.fromiter(map(xxh64_intdigest, block), np.uint64) for block in word_blocks(data)] or [np.empty(0, np.uint64)])


def _blocks(docs: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Windows of numbered documents, many documents at a time: the document's number, key and hash of each window.

    Longer documents come in slices that share 49 words, so that each window is in one slice.
    """
    held: list[np.ndarray] = []
    owner: list[int] = []
    size = 0

    def flush() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(x) for x in held])
        words = np.concatenate([x for w, i in zip(held, range(len(held)), strict=True) for x in (w, np.array([i], np.uint64))])
        ends = np.cumsum(lengths + 1) - 1
        gap = np.zeros(len(words), bool)
        gap[ends] = True
        words[ends] = _mix(np.arange(len(held), dtype=np.uint64) + np.uint64(0x5151))
        keys, whole = window_keys(words, gap)
        at = np.concatenate([np.arange(e - n, e - WINDOW + 1) for e, n in zip(ends, lengths, strict=True)])
        return np.repeat(np.array(owner), lengths - WINDOW + 1), keys[at], whole[at]

    for number, words in docs:
        for at in range(0, max(len(words) - WINDOW + 1, 0), BLOCK):
            piece = words[at : at + BLOCK + WINDOW - 1]
            if held and size + len(piece) > BLOCK:
                yield flush()
                held, owner, size = [], [], 0
            held.append(piece)
            owner.append(number)
            size += len(piece) + 1
    if held:
        yield flush()


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _lists(order: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The first place of each run of order, and the runs' values as lists."""
    first = np.flatnonzero(np.r_[True, order[1:] != order[:-1]]) if len(order) else np.empty(0, int)
    return first, pa.ListArray.from_arrays(pa.array(np.r_[first, len(order)], pa.int32()), _signed(values))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 2000):
        ids = b.column(0).to_numpy(zero_copy_only=False)
        for doc, key, _ in _blocks((i, hashed(x.as_py())) for i, x in enumerate(b.column(1))):
            new = np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]
            yield pa.RecordBatch.from_arrays([_signed(key[new]), pa.array(ids[doc[new]], pa.int64())], names=["key", "doc_id"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document, a row for each of its shared keys with the hashes of the windows under it."""
    for b in slices(batches, 2000):
        ids = b.column(0).to_numpy(zero_copy_only=False)
        known = b.column(2)
        for doc, key, whole in _blocks((i, hashed(x.as_py())) for i, x in enumerate(b.column(1))):
            edges = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1], True])
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                own = known[int(doc[s])].values
                shared, times = own.field(0).to_numpy(zero_copy_only=False).view(np.uint64), own.field(1).to_numpy(zero_copy_only=False)
                by = np.argsort(shared)
                shared, times = shared[by], times[by]
                at = np.minimum(np.searchsorted(shared, key[s:e]), len(shared) - 1)
                hit = np.flatnonzero(shared[at] == key[s:e])
                if not len(hit):
                    continue
                k, w = at[hit], whole[s:e][hit]
                by = np.lexsort((w, k))
                k, w = k[by], w[by]
                new = np.r_[True, (k[1:] != k[:-1]) | (w[1:] != w[:-1])]
                first, lists = _lists(k[new], w[new])
                k = k[new][first]
                yield pa.RecordBatch.from_arrays(
                    [_signed(shared[k]), pa.array(times[k], pa.int64()), pa.array(np.full(len(k), ids[int(doc[s])]), pa.int64()), lists],
                    names=["key", "times", "doc_id", "windows"],
                )


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of key, for each row the windows that an equal key's row of a smaller document has too."""
    held: pa.RecordBatch | None = None

    def flush(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not b.num_rows:
            return
        lists = b.column(2)
        sizes = np.diff(lists.offsets.to_numpy())
        key = np.repeat(b.column(0).to_numpy(), sizes)
        doc = np.repeat(b.column(1).to_numpy(), sizes)
        row = np.repeat(np.arange(b.num_rows), sizes)
        whole = lists.flatten().to_numpy()
        by = np.lexsort((doc, whole, key))
        k, w, d = key[by], whole[by], doc[by]
        new = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (w[1:] != w[:-1])])
        lowest = np.repeat(d[new], np.diff(np.r_[new, len(d)]))
        again = np.sort(by[d > lowest])
        first, out = _lists(row[again], whole[again])
        yield pa.RecordBatch.from_arrays([pa.array(doc[again][first], pa.int64()), out], names=["doc_id", "windows"])

    for b in batches:
        b = b if held is None else pa.concat_batches([held, b])
        keys = b.column(0).to_numpy()
        turn = np.flatnonzero(keys[1:] != keys[:-1])
        cut = int(turn[-1]) + 1 if len(turn) else 0
        yield from flush(b.slice(0, cut))
        held = b.slice(cut)
    if held is not None:
        yield from flush(held)


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, windows): for documents (doc_id, text as bytes, neither null), the hashes of their windows that a smaller doc_id has too.

    Documents with no such window have no row. Keys and windows meet through aggregates and joins; keys of over CROWD
    occurrences are resolved by an aggregate over single windows, combined before the shuffle, others in sorted runs.
    """
    keys = materialise(in_arrow(docs, _keys, "key long, doc_id long"))  # read twice
    ends = keys.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("times"))
    # Shared keys and windows are written, so that their joins shuffle both sides and a crowded key or window can be split.
    shared = materialise(ends.where("a < b").select("key", "times"))
    own = keys.join(shared, "key").groupBy("doc_id").agg(F.collect_set(F.struct("key", "times")).alias("known"))
    rows = materialise(in_arrow(docs.join(own, "doc_id").select("doc_id", "text", "known"), _windows, "key long, times long, doc_id long, windows array<long>"))
    few = rows.where(F.col("times") <= CROWD).select("key", "doc_id", "windows").repartition("key").sortWithinPartitions("key")
    few = in_arrow(few, _resolve, "doc_id long, windows array<long>")
    many = rows.where(F.col("times") > CROWD).select("key", "doc_id", F.explode("windows").alias("window"))
    lowest = materialise(many.groupBy("key", "window").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").drop("b"))
    crowded = many.join(lowest, ["key", "window"]).where("doc_id > a").groupBy("doc_id").agg(F.collect_set("window").alias("windows"))
    return few.union(crowded).groupBy("doc_id").agg(F.flatten(F.collect_list("windows")).alias("windows"))


def cut(data: bytes, windows: np.ndarray) -> tuple[int, list[bytes]]:
    """The number of words and those kept when windows with the given hashes are removed."""
    words = hashed(data)
    gone = np.zeros(len(words) + 1, np.int64)
    for at in range(0, len(words) - WINDOW + 1, BLOCK):
        own = words[at : at + BLOCK + WINDOW - 1]
        starts = np.arange(len(own) - WINDOW + 1)
        hit = at + starts[np.isin(_spans(own, starts, starts + WINDOW), windows)]
        gone[hit] += 1
        gone[hit + WINDOW] -= 1
    keep, kept, at = np.cumsum(gone)[:-1] == 0, [], 0
    for block in word_blocks(data):
        kept += [w for w, k in zip(block, keep[at : at + len(block)].tolist(), strict=True) if k]
        at += len(block)
    return len(words), kept


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, source_hash, n_words, kept_text) of documents that lose words, one row for each such id and text.

    A word goes if a window of 50 words that covers it, judged on the input, also starts in a document of a smaller id. kept_text
    has the other words joined by one space. source_hash is xxhash64 of the text, to tell rows of one id apart.
    Rows with null id or text lose nothing and take nothing from others; repeated rows count once; rows of one id with
    different texts take nothing from each other. Texts of under 50 words stay whole.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text")).where("doc_id is not null and text is not null")

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 200):
            out = [cut(t.as_py(), w.values.to_numpy(zero_copy_only=False).view(np.uint64)) for t, w in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([n for n, _ in out], pa.int64()), pa.array([b" ".join(k).decode() for _, k in out], pa.string())],
                names=["doc_id", "source_hash", "n_words", "kept_text"],
            )

    hit = docs.join(repeated_windows(docs), "doc_id").select("doc_id", F.xxhash64("text").alias("source_hash"), "text", "windows")
    return in_arrow(hit, shorten, "doc_id long, source_hash long, n_words long, kept_text string").dropDuplicates(["doc_id", "source_hash"])
