"""Running values along an order, split so that no task takes a key whole: parts of the order, a carry a part, a second pass.

The order's range is cut into parts of about PART rows by bounds from a sample. Windows run within a key's part; what a key's
earlier parts leave behind (a count, a last value) is found from one aggregated row a key and part, and joined to the part's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a part on average, and rows from which a bound is drawn.
PART, DRAWN = 1_000_000, 64


def bounds(df: DataFrame, order: str) -> list:
    """The values of order at which parts begin, but for the first. They follow the rows' number; PART rows or fewer have none.

    The sample is drawn by a hash of the value, DRAWN a part on average, and is all that reaches the driver.
    """
    parts = -(-df.count() // PART)
    if parts < 2:
        return []
    every = max(1, PART // DRAWN)
    drawn = df.select(order).where(F.col(order).isNotNull() & (F.pmod(F.xxhash64(F.col(order), F.lit(1)), F.lit(every)) == 0)).orderBy(order)
    values = [r[0] for r in drawn.collect()]
    return sorted({values[k * len(values) // parts] for k in range(1, parts)}) if values else []


def part(order: str, cuts: list) -> Column:
    """The number of a row's part: how many of the bounds are not after it. Rows without an order come first, as windows have them."""
    if not cuts:
        return F.lit(0)
    return F.when(F.col(order).isNull(), 0).otherwise(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(order))))


def _carried(df: DataFrame, keys: list[str], order: str, left: Column, gathered: Column, names: tuple[str, str]) -> tuple[DataFrame, bool]:
    """(df with a row's part and what its key's earlier parts left, whether there are any).

    left: what one part leaves, an aggregate; gathered: of parts in order, what those before leave together, over the window earlier.
    """
    at, carry = names
    cuts = bounds(df, order)
    split = df.withColumn(at, part(order, cuts))
    if not cuts:
        return split, False
    sums = split.groupBy(*keys, at).agg(left.alias("__left"))
    plain = [f"__key{i}" for i in range(len(keys))]
    carries = sums.withColumn(carry, gathered).select(*(F.col(k).alias(p) for k, p in zip(keys, plain, strict=True)), F.col(at).alias("__part"), carry)
    on = [split[k].eqNullSafe(carries[p]) for k, p in zip(keys, plain, strict=True)] + [split[at] == carries["__part"]]
    return split.join(carries, on, "left").drop(*plain, "__part"), True


def _earlier(keys: list[str], at: str):
    return W.partitionBy(*keys).orderBy(at).rowsBetween(W.unboundedPreceding, -1)


def number(df: DataFrame, keys: list[str], order: str, out: str) -> DataFrame:
    """df with out, a row's place (long, from 0) by order within its key. Without keys all rows are one list."""
    names = ("__at", "__carry")
    split, more = _carried(df, keys, order, F.count("*"), F.coalesce(F.sum("__left").over(_earlier(keys, "__at")), F.lit(0)), names)
    place = F.row_number().over(W.partitionBy(*keys, "__at").orderBy(order)).cast("long") - 1
    return split.withColumn(out, place + F.col("__carry") if more else place).drop(*names)


def running_count(df: DataFrame, keys: list[str], order: str, counted: Column, out: str) -> DataFrame:
    """df with out, the number (long) of rows so far, the row itself included, for which counted holds."""
    names = ("__at", "__carry")
    marked = df.withColumn("__counted", counted)
    split, more = _carried(marked, keys, order, F.count_if("__counted"), F.coalesce(F.sum("__left").over(_earlier(keys, "__at")), F.lit(0)), names)
    own = F.count_if("__counted").over(W.partitionBy(*keys, "__at").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return split.withColumn(out, own + F.col("__carry") if more else own).drop(*names, "__counted")


def running_sum(df: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """df with out, the sum of value over the rows before, the row itself left out; nulls count as 0."""
    names = ("__at", "__carry")
    split, more = _carried(df, keys, order, F.coalesce(F.sum(value), F.lit(0)), F.coalesce(F.sum("__left").over(_earlier(keys, "__at")), F.lit(0)), names)
    own = F.coalesce(F.sum(value).over(W.partitionBy(*keys, "__at").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return split.withColumn(out, own + F.col("__carry") if more else own).drop(*names)


def last_so_far(df: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """df with out, the last value so far that is not null."""
    names = ("__at", "__carry")
    last = F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order)))
    split, more = _carried(df, keys, order, last, F.last("__left", ignorenulls=True).over(_earlier(keys, "__at")), names)
    own = F.last(value, ignorenulls=True).over(W.partitionBy(*keys, "__at").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return split.withColumn(out, F.coalesce(own, F.col("__carry")) if more else own).drop(*names)
