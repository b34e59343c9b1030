"""Resolving company names against a registry: exact, normalised, then contained; verified where it is not certain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions.text import registry_key, verified

LEAST_KEY, MOST_CHECKED, GRAM = 4, 5, 4


def _named(registry: DataFrame) -> DataFrame:
    """Two rows a company: its own and its English name, with keys; empty names go."""
    both = F.explode(F.array(F.col("corp_name"), F.col("corp_eng_name")))
    return registry.select("corp_code", both.alias("spelled")).where("spelled != ''").withColumn("key", registry_key(F.col("spelled")))


def candidates(names: DataFrame, registry: DataFrame, subject: str = "subject") -> DataFrame:
    """(subject, corp_code, tier): the companies found by the first tier that finds any, and in it by the first name that does.

    names: subject, pos (order of trying) and name. Tiers: 1 the name is a company's own or English name; 2 their keys agree;
    3 the name's key, of 4 letters or more, is within a company's, and of those the shortest own names stay. Names with an
    empty key match nothing. Containment meets on pieces of 4 letters: of a key's pieces, each of which a company that contains it
    has, the one that the fewest companies have is looked up, so that common beginnings do not set all names against all.
    """
    tried = names.select(F.col(subject).alias("subject"), "pos", "name").withColumn("key", registry_key(F.col("name")))
    named = _named(registry)
    exact = tried.join(named, tried.name == named.spelled).select("subject", "pos", "corp_code", F.lit(1).alias("tier"))
    equal = tried.where("key != ''").join(named.select("corp_code", "key").where("key != ''").distinct(), "key").select("subject", "pos", "corp_code", F.lit(2).alias("tier"))
    grams = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("key") - (GRAM - 1)), lambda i: F.substring("key", i, F.lit(GRAM))))).alias("gram")
    pieces = named.where(F.char_length("key") >= GRAM).select("corp_code", F.col("key").alias("whole"), grams)
    known = tried.where(F.char_length("key") >= LEAST_KEY).select("key").distinct().select("key", grams).join(pieces.groupBy("gram").agg(F.count("*").alias("n")), "gram", "left")
    rarest = known.groupBy("key").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    asked = tried.join(rarest, "key")
    inside = asked.join(pieces, "gram").where(F.contains("whole", F.col("key"))).select("subject", "pos", "corp_code", F.lit(3).alias("tier")).distinct()
    size = registry.select("corp_code", F.char_length(registry_key(F.col("corp_name"))).alias("size"))
    found = exact.union(equal).union(inside).distinct().join(size, "corp_code")
    first = W.partitionBy("subject").orderBy("tier", "pos")
    best = found.withColumn("r", F.rank().over(first)).where("r = 1")
    short = best.withColumn("least", F.min("size").over(W.partitionBy("subject"))).where("tier < 3 or size = least")
    return short.select("subject", "corp_code", "tier")


def ranked(found: DataFrame, registry: DataFrame) -> DataFrame:
    """candidates() with rank within the subject: listed companies first, then the latest modified, then registry order (ord)."""
    rows = found.join(registry.select("corp_code", "stock_code", "modify_date", "ord"), "corp_code")
    listed = F.coalesce("stock_code", F.lit("")) != ""
    order = W.partitionBy("subject").orderBy(F.desc(listed), F.desc(F.coalesce("modify_date", F.lit(""))), "ord")
    return rows.withColumn("rank", F.row_number().over(order)).withColumn("n", F.count("*").over(W.partitionBy("subject")))


def resolve(names: DataFrame, registry: DataFrame, known: DataFrame, overview: DataFrame, subject: str = "subject") -> DataFrame:
    """(subject, corp_code) of the subjects resolved.

    known: subject, biz_no, ceo_name, either of them null; overview: corp_code, bizr_no, ceo_nm. A contained name, or more than one
    candidate, is checked where something is known: the first of the five best candidates that verifies is taken, or none. In
    all other cases the best candidate is.
    """
    rows = ranked(candidates(names, registry, subject), registry).join(known.select(F.col(subject).alias("subject"), "biz_no", "ceo_name"), "subject", "left")
    given = (F.coalesce("biz_no", F.lit("")) != "") | (F.coalesce("ceo_name", F.lit("")) != "")
    check = given & ((F.col("tier") == 3) | (F.col("n") > 1))
    seen = rows.join(overview, "corp_code", "left")
    right = F.coalesce(verified(F.col("bizr_no"), F.col("ceo_nm"), F.col("biz_no"), F.col("ceo_name")), F.lit(False))
    kept = seen.where(F.when(check, (F.col("rank") <= MOST_CHECKED) & right).otherwise(F.col("rank") == 1))
    return kept.groupBy("subject").agg(F.min_by("corp_code", "rank").alias("corp_code"))
