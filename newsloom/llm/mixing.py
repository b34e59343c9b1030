"""Mixing sources to target weights: capped water-filling, then whole and fractional repetitions in a seeded order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions.storage import materialise
from newsloom.llm.common import WORD

WEIGHTS, SHARE, EPOCHS, SEED = (5.0, 2.0, 1.0), 1.5, 2.0, "mix"
#: Documents of a source that one task puts in order.
STRATUM = 1000


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """source_size (source, source_size, ...) with target, one row a source.

    Sources by code point, null last, take the weights in turn. The total, share times all sizes, is divided by weight; a
    source stops at epochs times its size and its excess is shared again by weight. Sources in order of epochs * size / weight
    fill first to last: the level is the rest of the total over the rest
    of the weights at the first source that it does not fill; later sources would only lower it.
    If all stop, the total is out of reach and every source has its cap. A row a source is all that is put in one order.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    own = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(epochs))
    before = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    own = own.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    own = own.withColumn("total", F.sum("source_size").over(whole) * F.lit(share)).withColumn("all_weight", F.sum("weight").over(whole))
    own = own.withColumn("level", (F.col("total") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before")))
    last = F.max(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("level"))).over(whole)
    return own.withColumn("level", last).withColumn("target", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap"))).select(*sizes.columns, "target")


def words(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, seed: str = SEED) -> DataFrame:
    """(doc_id, source, text_hash, size, source_size, target, taken) of every row.

    Each document is taken as often as its source's target holds the source whole. Of the rest, documents in the order of a
    seeded hash are taken once more while they fit, and the one at the mark gives its first words: so a source's taken words
    are its target to a word, and no document is taken more than epochs times, rounded up to a whole number. Null and empty texts have size 0
    and null is a source of its own. Rows that repeat an id are told apart by their text; equal rows follow each other.
    The order within a source is found in strata of a hash, with their sums before them, so that no task orders a source whole.
    """
    sized = materialise(
        df.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), words(text_col).alias("size"), F.xxhash64(F.col(text_col)).alias("text_hash"))
        .withColumn("draw", F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    )
    totals = materialise(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))))
    strata = F.greatest(F.lit(1), F.ceil(F.col("rows") / STRATUM)).cast("long")
    number = F.conv(F.substring("draw", 1, 12), 16, 10).cast("long")
    known = sized.join(F.broadcast(totals) if totals.count() <= 10_000 else totals, sized.source.eqNullSafe(totals.source)).drop(totals.source)
    known = known.withColumn("stratum", F.floor(number / F.lit(2.0**48) * strata).cast("long"))
    sums = known.groupBy("source", "stratum").agg(F.sum("size").alias("stratum_size"))
    before = F.sum("stratum_size").over(W.partitionBy("source").orderBy("stratum").rowsBetween(W.unboundedPreceding, 0)) - F.col("stratum_size")
    sums = sums.select(F.col("source").alias("s"), F.col("stratum").alias("t"), before.alias("offset"))
    placed = known.join(sums, known.source.eqNullSafe(sums.s) & (known.stratum == sums.t)).drop("s", "t")
    within = W.partitionBy("source", "stratum").orderBy("draw", "doc_id", "text_hash").rowsBetween(W.unboundedPreceding, 0)
    end = F.col("offset") + F.sum("size").over(within)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    placed = placed.withColumn("end", end).withColumn("times", times)
    rest = F.floor(F.col("target") - F.col("times") * F.col("source_size") + F.lit(1e-6))
    more = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("end") - F.col("size"))))
    return placed.select("doc_id", "source", "text_hash", "size", "source_size", "target", (F.col("times") * F.col("size") + more).cast("long").alias("taken"))


def repeat(df: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """df's rows as the mix takes them, columns as in df: whole copies, and one of the first words where a part is taken.

    mixed: of mix() over df with the same columns. Documents that are not taken go; the words of a part are joined by one space. Rows that
    agree in id, source and text stand for one another, so what the mix takes of them is added up and their first row gives all of it.
    """
    same = lambda id_, source, text_hash: F.xxhash64(id_, id_.isNull(), source, source.isNull(), text_hash).alias("__key")
    takes = mixed.groupBy(same(F.col("doc_id"), F.col("source"), F.col("text_hash"))).agg(F.max("size").alias("__size"), F.sum("taken").alias("__taken"))
    keyed = df.select(same(F.col(id_col), F.col(source_col).cast("string"), F.xxhash64(F.col(text_col))), F.struct(*df.columns).alias("__r"))
    one = keyed.groupBy("__key").agg(F.min_by("__r", F.xxhash64("__r")).alias("__r"))  # of equal rows with other columns the least by a hash
    full = one.join(takes, "__key").where("__taken > 0")
    size, taken, whole = F.col("__size"), F.col("__taken"), F.col("__r")[text_col]
    full = full.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.ceil(taken / size).cast("int"))))
    part = F.least(size, taken - (F.col("__copy") - 1) * size)
    first = F.array_join(F.slice(F.split(F.regexp_replace(whole, r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+"), F.lit(1), part.cast("int")), " ")
    text = F.when(part == size, whole).otherwise(first).alias(text_col)
    return full.select(*(text if c == text_col else F.col("__r")[c].alias(c) for c in df.columns))
