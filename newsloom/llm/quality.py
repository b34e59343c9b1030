"""Text quality by a byte-level convolutional network: filters over overlapping chunks, max-pooled, one probability.

A filter of WIDTH bytes is a table of one weight for each offset and byte value, so its response at a position is a sum of
WIDTH look-ups. Chunks of CHUNK positions overlap by WIDTH - 1 bytes: every window of the document is seen once.
While learning, a weight is the byte's own plus its class's (blank, digit, capital, ...), so that what holds for one letter
carries over to the others; the two are added into one table for scoring.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import Kept, in_arrow, utf8

FILTERS, WIDTH, CHUNK = 16, 6, 4096
#: Labelled documents of each label learned from at most (drawn by a hash of the id), bytes of their texts together at most, and passes over them.
SAMPLE, SAMPLE_BYTES, EPOCHS, RATE, DECAY = 1500, 64 << 20, 12, 0.02, 1e-4
#: Byte classes: the first byte of each range of values; a range lasts to the next.
_RANGES = (0, 1, 9, 14, 32, 33, 48, 58, 65, 91, 97, 123, 128, 160, 192)

Model = dict[str, np.ndarray]
_CLASS = np.searchsorted(_RANGES, np.arange(256), side="right") - 1


def _pad(data: bytes) -> np.ndarray:
    """The document's bytes after WIDTH - 1 zeros, so that each byte, of an empty text none, ends a window."""
    return np.frombuffer(bytes(WIDTH) + data, np.uint8)


def pooled(model: Model, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Each filter's largest response over the whole document, after the rectifier, and where it is."""
    codes, table = _pad(data), model["table"]
    best, where = np.full(table.shape[2], -np.inf, np.float32), np.zeros(table.shape[2], np.int64)
    positions = len(codes) - WIDTH + 1
    buffer = np.empty((min(CHUNK, positions), table.shape[2]), np.float32)
    for at in range(0, positions, CHUNK):
        n = min(CHUNK, positions - at)
        total = table[0].take(codes[at : at + n], axis=0)
        for w in range(1, WIDTH):
            total += table[w].take(codes[at + w : at + w + n], axis=0, out=buffer[:n], mode="clip")
        top = total.max(axis=0)
        if (better := top > best).any():
            where[better] = at + total[:, better].argmax(axis=0)
            best[better] = top[better]
    return np.maximum(best + model["shift"], 0), where


def probability(model: Model, data: bytes) -> float:
    z = float(np.clip(pooled(model, data)[0] @ model["weights"] + model["bias"][0], -30, 30))
    return 1 / (1 + np.exp(-z))


def train(texts: list[bytes], labels: list[int], prior: float | None = None, seed: int = 7, epochs: int = EPOCHS) -> Model:
    """Learn filters and head by Adam; only the windows that win the pooling carry gradient.

    prior: the share of label 1 that the probabilities are for, where the rows are drawn in another proportion.
    """
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    odds = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    model = {
        "filters": rng.normal(0, 0.2, (WIDTH, 256, FILTERS)).astype(np.float32), "classes": rng.normal(0, 0.2, (WIDTH, len(_RANGES), FILTERS)).astype(np.float32),
        "shift": np.zeros(FILTERS, np.float32), "weights": rng.normal(0, 0.3, FILTERS).astype(np.float32), "bias": np.full(1, odds, np.float32),
    }
    first, second, step = {k: np.zeros_like(v) for k, v in model.items()}, {k: np.zeros_like(v) for k, v in model.items()}, 0
    for epoch in range(epochs if texts else 0):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(texts))
        for at in range(0, len(order), 16):
            grad = {k: np.zeros_like(v) for k, v in model.items()}
            own, now = order[at : at + 16], model | {"table": model["filters"] + model["classes"][:, _CLASS]}
            for i in own:
                codes = _pad(texts[i])
                features, where = pooled(now, texts[i])
                z = float(np.clip(features @ model["weights"] + model["bias"][0], -30, 30))
                error = (1 / (1 + np.exp(-z)) - y[i]) / len(own)
                grad["weights"] += error * features
                grad["bias"] += error
                back = error * model["weights"] * (features > 0)
                grad["shift"] += back
                for w in range(WIDTH):
                    grad["filters"][w, codes[where + w], np.arange(FILTERS)] += back
                    np.add.at(grad["classes"][w], (_CLASS[codes[where + w]], np.arange(FILTERS)), back)
            step += 1
            for k, g in grad.items():
                g += DECAY * model[k] if k != "bias" else 0
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-6)
    if prior is not None:
        model["bias"] += np.float32(np.log(prior / (1 - prior)) - odds)
    return {"table": model["filters"] + model["classes"][:, _CLASS]} | {k: model[k] for k in ("shift", "weights", "bias")}


def learn(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from at most sample documents of each label (0 and others), the first by a hash of the id, at the labels' share.

    Of labels only ids and labels are read; the at most 2 * sample ids drawn are sent to the documents. Of rows of one id one text counts, the first
    by a hash. The driver gets the drawn documents' sizes, and then whole texts, label by label in the order of the draw, as long as they have sample_bytes / 2
    together; texts are never cut. Null ids and labels teach nothing, of one id's labels the largest counts, null texts are empty. Without labels every text scores alike.
    """
    own = labels.select(F.col(id_col).alias("id"), (F.col(label_col) != 0).cast("int").alias("y")).where("id is not null and y is not null")
    own = own.groupBy("id").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64(F.col("id").cast("string"), F.lit(4)))
    share = own.agg(F.avg("y")).first()[0]
    drawn = own.where("y = 0").orderBy("h", "id").limit(sample).union(own.where("y = 1").orderBy("h", "id").limit(sample))
    text = F.coalesce(utf8(text_col), F.lit(b""))
    found = docs.select(F.col(id_col).alias("id"), text.alias("text")).join(F.broadcast(drawn), "id")
    one = found.groupBy("id", "h", "y").agg(F.min(F.struct(F.xxhash64("text").alias("t"), F.octet_length("text").alias("n"))).alias("x")).select("id", "h", "y", "x.t", "x.n")
    left, wanted = [sample_bytes // 2] * 2, []
    for r in sorted(one.collect(), key=lambda r: (r["h"], r["y"])):
        left[r["y"]] -= r["n"]
        if left[r["y"]] >= 0:
            wanted.append((r["id"], r["t"]))
    few = docs.sparkSession.createDataFrame(wanted, T.StructType([T.StructField("w", docs.schema[id_col].dataType), T.StructField("t", T.LongType())]))
    met = found.join(F.broadcast(few), (F.col("id") == F.col("w")) & (F.xxhash64("text") == F.col("t")))
    got = sorted((r["h"], r["y"], bytes(r["text"])) for r in met.groupBy("id", "h", "y").agg(F.first("text").alias("text")).collect())
    prior = min(max(share, 0.01), 0.99) if got else None
    return train([t for _, _, t in got], [y for _, y, _ in got], prior)


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """df's id, kept columns and score, the probability of label 1, a row for each row; null text counts as empty.

    Raises ValueError where a kept column is named like one of the result's.
    """
    kept = Kept(df, keep, ("doc_id", "score"))
    rows = df.select(F.col(id_col).alias("doc_id"), *kept.columns, utf8(text_col).alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [probability(model, x.as_py() or b"") for x in b.column("text")]
            own = b.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(scores, pa.float64())], names=[*own.schema.names, "score"])

    return kept.named(in_arrow(rows, score, rows.drop("text").schema.add("score", "double")))
