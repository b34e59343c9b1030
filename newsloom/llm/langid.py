"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import Kept, batch, in_arrow

#: n-grams in a profile; the longest n-gram; most labelled documents learned from for a language.
TOP, LONGEST, SAMPLE = 300, 3, 500
#: A profile is sent to every task, so languages are limited to what fits a task with ease.
MOST_LANGUAGES = 1000
_BLANK, _BLOCK = 1, 1 << 20


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the whole text's words, as numbers in ascending order, and their counts.

    Words are runs of letters, in lower case, with a blank on either side; n-grams of 1 to 3 stay within a word.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes = np.where(_letters()[codes], codes, _BLANK)
    codes = np.r_[_BLANK, codes, _BLANK]
    codes = codes[np.r_[True, (codes[1:] != _BLANK) | (codes[:-1] != _BLANK)]]
    keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for at in range(0, len(codes), _BLOCK):
        own, size = codes[at : at + _BLOCK + LONGEST - 1], min(_BLOCK, len(codes) - at)
        found = [own[:size][own[:size] != _BLANK]]
        for n in range(2, LONGEST + 1):
            m = min(size, len(own) - n + 1)
            if m <= 0:
                continue
            gram = own[:m].copy()
            for i in range(1, n):
                gram = gram << 21 | own[i : i + m]
            inner = np.ones(m, bool)
            for i in range(1, n - 1):
                inner &= own[i : i + m] != _BLANK
            found.append(gram[inner])
        k, c = np.unique(np.concatenate(found), return_counts=True)
        if len(keys):
            k, where = np.unique(np.r_[keys, k], return_inverse=True)
            c = np.bincount(where, np.r_[counts, c]).astype(np.int64)
        keys, counts = k, c
    return keys, counts


def profile(keys: np.ndarray, counts: np.ndarray, top: int = TOP) -> np.ndarray:
    """The most frequent n-grams, most frequent first; of equal counts the smaller number."""
    return keys[np.argsort(-counts, kind="stable")[:top]]


def out_of_place(doc: np.ndarray, known: np.ndarray, ranks: np.ndarray, top: int) -> int:
    """Sum over the document's n-grams of how far each is from its rank in the language; top for one not in it.

    known: the language's n-grams in ascending order, with their ranks.
    """
    at = np.minimum(np.searchsorted(known, doc), len(known) - 1)
    return int(np.where(known[at] == doc, np.abs(ranks[at] - np.arange(len(doc))), top).sum())


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE, top: int = TOP) -> dict[str, np.ndarray]:
    """A profile for each non-null value of lang_col, from about sample documents of each at most, drawn by a hash of the id.

    N-grams are counted on the executors; top rows a language reach the driver. Rows with null text or language teach nothing. Rows of one id, or
    without one, are drawn together or not at all, so that the number drawn is about sample where ids are unlike. Raises ValueError beyond
    MOST_LANGUAGES languages.
    """
    rows = df.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.lit(9)).alias("h"))
    sizes = rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return {}
    share = F.create_map(*(x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, sample / r["count"])))))
    drawn = rows.where(F.pmod("h", F.lit(1_000_000)) < F.element_at(share, F.col("lang")) * 1_000_000)
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                k, c = ngrams(text)
                yield batch({"lang": [lang] * len(k), "gram": k, "n": c}, schema)

    totals = in_arrow(drawn.select("lang", "text"), count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = totals.groupBy("lang").agg(F.expr(f"slice(array_sort(collect_list(struct(-n AS n, gram))), 1, {top})").alias("grams"))
    return {r["lang"]: np.array([g["gram"] for g in r["grams"]], np.int64) for r in ranked.collect()}


def identify(text: str | None, profiles: dict[str, tuple[np.ndarray, np.ndarray]], top: int = TOP) -> tuple[str, float]:
    """The nearest language (of equal distances the first in order of name) and a score: 1 at no distance, 0 at the largest."""
    if not text or not profiles or not has_letter(text):
        return "und", 0.0
    doc = profile(*ngrams(text), top)
    far = {lang: out_of_place(doc, *p, top) for lang, p in sorted(profiles.items())}
    best = min(far, key=far.get)
    return best, 1 - far[best] / (top * len(doc))


def predict(df: DataFrame, profiles: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", keep: tuple[Column, ...] = (), top: int = TOP, keep_text: bool = False) -> DataFrame:
    """df's id as doc_id, kept columns, text if asked for, lang_pred and score, a row for each row.

    Null, empty and letterless texts give und with score 0, as does everything if nothing was learned. Raises ValueError where a kept column is named like one of the result's.
    """
    kept = Kept(df, keep, ("doc_id", "lang_pred", "score", *["text"] * keep_text))
    ready = {lang: (np.sort(p), np.argsort(p)) for lang, p in profiles.items() if len(p)}
    rows = df.select(F.col(id_col).alias("doc_id"), *kept.columns, F.col(text_col).cast("string").alias("text"))
    left = [] if keep_text else ["text"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [identify(t.as_py(), ready, top) for t in b.column("text")]
            own = b.drop_columns(left)
            yield pa.RecordBatch.from_arrays(
                [*own.columns, pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())],
                names=[*own.schema.names, "lang_pred", "score"],
            )

    return kept.named(in_arrow(rows, score, rows.drop(*left).schema.add("lang_pred", "string").add("score", "double")))
