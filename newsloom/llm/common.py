"""What the corpus operators share: words, folds, Arrow batches."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word, as a Java, RE2 and Python pattern.
WORD = r"[^\x20\x09-\x0D]+"
ROWS, _BATCH = 2000, "spark.sql.execution.arrow.maxRecordsPerBatch"
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(col: str) -> Column:
    """A text column's UTF-8 bytes; null stays null."""
    return F.col(col).cast("string").cast("binary")


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; ids that are null fall in fold -1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(-1)).cast("int")


class Kept:
    """Columns that an operator hands on: under inner names while it works, and under their own at the end.

    Raises ValueError where two of them, or one of them and a column that the operator makes, have one name.
    """

    def __init__(self, df: DataFrame, keep: tuple[Column, ...], made: tuple[str, ...]):
        self.names = df.select(*keep).columns if keep else []
        if twice := sorted({n for n in self.names if n in made or self.names.count(n) > 1}):
            raise ValueError(f"kept columns {twice} are named like others of the result")
        self.columns = [c.alias(f"__kept{i}") for i, c in enumerate(keep)]

    def named(self, out: DataFrame) -> DataFrame:
        return out.withColumnsRenamed({f"__kept{i}": n for i, n in enumerate(self.names)})


def word_blocks(data: bytes, block: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of data in order, as lists from slices of about block bytes, cut between words."""
    at = 0
    while at < len(data):
        cut = _SPACE.search(data, at + block) if at + block < len(data) else None
        end = cut.start() if cut else len(data)
        yield data[at:end].split()
        at = end


def batch(rows: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows at most."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def release() -> None:
    """Give memory that is free in this process back to the machine: a reused worker would hold its peak while other stages run."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """df.mapInArrow(), after which the worker's free memory is released.

    Rows are whole texts, so the session's batches get ROWS rows at most, also where they had no limit; a lower limit stays. The setting stays with the
    session, as plans read it when they run.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH)) <= ROWS:
        conf.set(_BATCH, str(ROWS))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(held, schema)
