"""Collection as a stream: new articles by key, snapshots before later stages, counts by time window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_by_key(stream: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """The first row of each key; a key is forgotten once the watermark is past it, which bounds the state."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def counts(stream: DataFrame, time: str, window: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """Rows per window and key; a window is final once the watermark is past it."""
    out = stream.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("window_start"), *keys, "n")


def run_available(stream: DataFrame, checkpoint: str, step: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Give what is there to step, batch by batch, and end. A batch that is repeated after a failure has its number again."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start()
    query.awaitTermination()


def snapshots(path: str, then: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A step that writes each batch under its number, so that a repeat replaces it, before anything that may fail reads it."""

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if then:
            then(batch.sparkSession.read.parquet(f"{path}/batch={number}"), number)

    return step
