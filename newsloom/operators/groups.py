"""Latest rows, nested pivots, counts with ratios, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.text import division, sex, to_float, to_int
from newsloom.operators import scan

#: Types whose values an aggregate replaces in place, so that it hashes instead of sorting its input.
_FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def latest(df: DataFrame, keys: list[str], by: str, order: str) -> DataFrame:
    """Of each key the row with the largest by, compared as what it is, the first in order of equals; null counts as smallest, and so does an empty text.

    One aggregate, combined before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    text = isinstance(df.schema[by].dataType, T.StringType)
    value = F.coalesce(F.col(by), F.lit("")) if text else F.col(by)
    best = F.max_by(F.struct(*rest), F.struct(value.isNotNull(), value, -F.col(order)))
    return df.groupBy(*keys).agg(best.alias("__r")).select(*keys, "__r.*")


def earliest(df: DataFrame, keys: list[str], day: str, order: str) -> DataFrame:
    """Of each key the earliest dated row, the first in order of equals; the first row if none is dated."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(F.col(day).isNull(), F.col(day), F.col(order))).alias("__r")).select(*keys, "__r.*")


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the last in order. Columns of numbers and dates are each taken by order, which hashes; others ride in one struct."""
    rest = [c for c in df.columns if c not in keys]
    if all(isinstance(df.schema[c].dataType, _FIXED) for c in rest):
        return df.groupBy(*keys).agg(*(F.max_by(c, order).alias(c) for c in rest))
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__r")).select(*keys, "__r.*")


def periodic_reports(disclosures: DataFrame, corp: str = "corp_code", order: str = "ord") -> DataFrame:
    """The latest annual, half-year and quarterly report of each company, with label; the first of equal receipt dates."""
    name = F.col("report_nm")
    label = F.when(name.contains("사업보고서"), "사업보고서").when(name.contains("반기보고서"), "반기보고서").when(name.contains("분기보고서"), "분기보고서")
    return latest(disclosures.withColumn("label", label).where(F.col("label").isNotNull()), [corp, "label"], "rcept_dt", order)


def reporting_periods(periodic: DataFrame, corp: str = "corp_code") -> DataFrame:
    """Of periodic_reports(): the newer of annual and half-year report (annual if equal), and the quarterly one."""
    kind = F.when(F.col("label") == "분기보고서", "quarter").otherwise("annual_or_half")
    rest = [c for c in periodic.columns if c != corp]
    best = F.max_by(F.struct(*rest), F.struct("rcept_dt", F.col("label") == "사업보고서"))
    return periodic.withColumn("kind", kind).groupBy(corp, "kind").agg(best.alias("__r")).select(corp, "kind", "__r.*")


EMPLOYEE_METRICS = {"head_count": ("sm", to_int), "regular": ("rgllbr_co", to_int), "contract": ("cnttk_co", to_int), "avg_tenure": ("avrg_cnwk_sdytrn", to_float), "avg_salary": ("jan_salary_am", to_int), "total_salary": ("fyer_salary_totamt", to_int)}


def employees_long(rows: DataFrame, order: str = "ord") -> DataFrame:
    """(corp_code, bsns_year, division, sex, metrics...), the last row of equal labels."""
    named = rows.select("corp_code", "bsns_year", order, division(F.col("fo_bbm")).alias("division"), sex(F.col("sexdstn")).alias("sex"), *(f(F.col(c)).alias(k) for k, (c, f) in EMPLOYEE_METRICS.items()))
    return last_wins(named, ["corp_code", "bsns_year", "division", "sex"], order).drop(order)


def employees(rows: DataFrame, order: str = "ord") -> DataFrame:
    """One row a company and year: divisions, a map of division to a map of sex to a struct of metrics."""
    inner = employees_long(rows, order).groupBy("corp_code", "bsns_year", "division").agg(F.map_from_entries(F.collect_list(F.struct("sex", F.struct(*EMPLOYEE_METRICS)))).alias("by_sex"))
    return inner.groupBy("corp_code", "bsns_year").agg(F.map_from_entries(F.collect_list(F.struct("division", "by_sex"))).alias("divisions"))


def indicators_long(rows: DataFrame, order: str = "ord") -> DataFrame:
    """(corp_code, bsns_year, category, name, value), the last of equal names; no name, no row; no category, 기타."""
    category = F.coalesce(F.nullif(F.col("idx_cl_nm"), F.lit("")), F.lit("기타"))
    named = rows.where(F.coalesce("idx_nm", F.lit("")) != "").select("corp_code", "bsns_year", order, category.alias("category"), F.col("idx_nm").alias("name"), to_float(F.col("idx_val")).alias("value"))
    return last_wins(named, ["corp_code", "bsns_year", "category", "name"], order).drop(order)


def indicators(rows: DataFrame, order: str = "ord") -> DataFrame:
    """One row a company and year: indicators, a map of category to a map of name to value."""
    inner = indicators_long(rows, order).groupBy("corp_code", "bsns_year", "category").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("values"))
    return inner.groupBy("corp_code", "bsns_year").agg(F.map_from_entries(F.collect_list(F.struct("category", "values"))).alias("indicators"))


def statements(rows: DataFrame, keys: list[str], values: list[str], order: str = "ord") -> DataFrame:
    """One row a key: statements, fs_div to sj_div to (name, accounts); a section has its first row's name, an account its last row's values."""
    accounts = last_wins(rows.select(*keys, "fs_div", "sj_div", "account_nm", order, *values), [*keys, "fs_div", "sj_div", "account_nm"], order)
    names = rows.groupBy(*keys, "fs_div", "sj_div").agg(F.min_by("sj_nm", order).alias("name"))
    entry = F.struct("account_nm", F.struct(*values))
    sections = accounts.groupBy(*keys, "fs_div", "sj_div").agg(F.map_from_entries(F.collect_list(entry)).alias("accounts")).join(names, [*keys, "fs_div", "sj_div"])
    inner = sections.groupBy(*keys, "fs_div").agg(F.map_from_entries(F.collect_list(F.struct("sj_div", F.struct("name", "accounts")))).alias("sections"))
    return inner.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("fs_div", "sections"))).alias("statements"))


def match_counts(df: DataFrame, category: Column, matched: Column, ranks: dict[str, int]) -> DataFrame:
    """(category, total, matched) of the categories that occur, in the order of ranks; unknown categories are left out."""
    counted = df.select(category.alias("category"), matched.alias("m")).where(F.col("category").isin(*ranks)).groupBy("category").agg(F.count("*").alias("total"), F.count_if("m").alias("matched"))
    rank = F.create_map(*(F.lit(x) for p in ranks.items() for x in p))
    return counted.withColumn("ord", F.element_at(rank, F.col("category"))).orderBy("ord")


def noise(df: DataFrame, keys: list[str], relevant: Column, least: int = 10, share: float = 0.5) -> DataFrame:
    """Per key found, relevant and noisy: at least so many found and more than the share of them not relevant."""
    out = df.groupBy(*keys).agg(F.count("*").alias("found"), F.count_if(relevant).alias("relevant"))
    return out.withColumn("noisy", (F.col("found") >= least) & (1 - F.col("relevant") / F.col("found") > share))


def ordered_distinct(df: DataFrame, key: Column, name: str, order: str) -> DataFrame:
    """(key, name, ord): each key's first spelling, in order of first appearance. Empty keys go."""
    out = df.select(key.alias("key"), F.col(name).alias("name"), F.col(order).alias("ord")).where("key != ''")
    return out.groupBy("key").agg(F.min_by("name", "ord").alias("name"), F.min("ord").alias("ord")).orderBy("ord")


def unseen(new: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows of new whose key is not in seen; rows with a null key stay."""
    return new.join(seen.select(F.col(key).alias("__k")).distinct(), new[key] == F.col("__k"), "left_anti")


def without(df: DataFrame, key: Column, own: DataFrame, own_key: Column) -> DataFrame:
    """df without the rows whose key is among own's."""
    return df.withColumn("__key", key).join(own.select(own_key.alias("__key")).distinct(), "__key", "left_anti").drop("__key")


def carry_forward(df: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """df with the last value so far that is not null; a key's rows are dealt out by order, so that one key may hold any number."""
    return scan.last_so_far(df, keys, order, value, out)


def blocks(df: DataFrame, keys: list[str], order: str, header: Column, head: Column, item: Column) -> DataFrame:
    """One row a header row: its head and the items (array, in order) of the rows up to the next header; headers without items and items before any header go."""
    marked = scan.running_count(df.withColumn("__h", header), keys, order, F.col("__h"), "__b").where("__b > 0")
    got = marked.groupBy(*keys, "__b").agg(F.max(F.when(F.col("__h"), head)).alias("head"), F.array_sort(F.collect_list(F.when(~F.col("__h"), F.struct(F.col(order).alias("o"), item.alias("v"))))).alias("x"))
    return got.where(F.size("x") > 0).select(*keys, F.col("__b").alias("block"), "head", F.transform("x", lambda e: e.v).alias("items"))


def keyword_groups(df: DataFrame, group: str, keyword: Column, *texts: Column) -> DataFrame:
    """df's rows of groups in which some row's text holds the keyword."""
    hit = F.lit(False)
    for t in texts:
        hit = hit | F.coalesce(F.contains(t, keyword), F.lit(False))
    kept = df.groupBy(group).agg(F.bool_or(hit).alias("__ok")).where("__ok").select(group)
    return df.join(kept, group, "left_semi")
