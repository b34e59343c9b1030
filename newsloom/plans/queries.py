"""Queries of the engine over the driver's tables, each operator on whole tables, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

import io
import json
import re
import uuid
import zipfile
import zlib
from collections.abc import Callable
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions import taxonomy, text
from newsloom.functions.storage import materialise, shared_dir
from newsloom.operators import cluster, decisions, fit, graph, groups, incremental, registry
from newsloom.plans import company, matching, news, searches
from newsloom.plans import postings as structured_postings
from newsloom.sources import html, paged, pdf, stores
from newsloom.streaming import collect

AS_OF = date(1998, 7, 29)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "topics"
#: Files of a task that reads such as are made from short rows.
FILES = 1000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def choose(key: Column, *options: Column | str | None) -> Column:
    """One of the options by the key's remainder."""
    out = F.lit(None).cast("string")
    for i, o in enumerate(options):
        out = F.when(key % len(options) == i, o if isinstance(o, Column) else F.lit(o)).otherwise(out)
    return out


EVENTS_SQL = "(VALUES " + ", ".join(f"({o}, '{e}', '{c}', '{cl}', '{lk}', {b})" for o, e, c, cl, lk, b in taxonomy.rows()) + ") AS x(ord, event_id, category_id, category_label, label_ko, base_importance)"

# Latest rows, pivots, counts


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def latest_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return groups.latest(orders, ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def latest_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderkey", "o_orderdate")
    return groups.latest(orders, ["o_custkey", "o_orderstatus"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderstatus", "o_orderkey")


@query("""
WITH d AS (SELECT o_custkey AS corp_code, o_orderkey AS ord, strftime(o_orderdate, '%Y%m%d') AS rcept_dt, CASE o_orderkey % 4 WHEN 0 THEN '사업보고서' WHEN 1 THEN '반기보고서' WHEN 2 THEN '분기보고서' END AS label FROM orders),
l AS (SELECT *, row_number() OVER (PARTITION BY corp_code, label ORDER BY rcept_dt DESC, ord) AS r FROM d WHERE label IS NOT NULL),
k AS (SELECT *, CASE WHEN label = '분기보고서' THEN 'quarter' ELSE 'annual_or_half' END AS kind FROM l WHERE r = 1)
SELECT corp_code, kind, label, rcept_dt FROM (SELECT *, row_number() OVER (PARTITION BY corp_code, kind ORDER BY rcept_dt DESC, label = '사업보고서' DESC) AS q FROM k) WHERE q = 1""")
def reporting_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    name = choose(key, "사업보고서 (2024.12)", "반기보고서 (2025.06)", "분기보고서 (2025.03)", "감사보고서")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("corp_code"), key.alias("ord"), name.alias("report_nm"), F.date_format("o_orderdate", "yyyyMMdd").alias("rcept_dt"))
    return groups.reporting_periods(groups.periodic_reports(rows)).select("corp_code", "kind", "label", "rcept_dt")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 3 = 0, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END, o_orderkey) AS r FROM orders) WHERE r = 1")
def earliest_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")).alias("day"))
    return groups.earliest(orders, ["o_custkey"], "day", "o_orderkey").select("o_custkey", "o_orderkey")


EMPLOYEES = """
WITH e AS (SELECT l_suppkey AS corp_code, year(l_shipdate) AS bsns_year, CASE l_returnflag WHEN 'A' THEN 'total' ELSE l_returnflag END AS division, CASE l_linestatus WHEN 'O' THEN 'male' ELSE 'female' END AS sex,
  l_orderkey * 10 + l_linenumber AS ord, CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_orderkey END AS head_count, l_discount AS avg_tenure FROM lineitem)
"""


def _employee_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("l_orderkey")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("corp_code"), F.year("l_shipdate").alias("bsns_year"), F.when(F.col("l_returnflag") == "A", "성별합계").otherwise(F.col("l_returnflag")).alias("fo_bbm"),
        F.when(F.col("l_linestatus") == "O", "남").otherwise("여").alias("sexdstn"), (key * 10 + F.col("l_linenumber")).alias("ord"), F.when(key % 5 == 0, "-").otherwise(F.format_number(key, 0)).alias("sm"),
        F.lit("").alias("rgllbr_co"), F.lit("12.5").alias("cnttk_co"), F.col("l_discount").cast("string").alias("avrg_cnwk_sdytrn"), F.lit(None).cast("string").alias("jan_salary_am"), F.lit("1,000").alias("fyer_salary_totamt"),
    )


@query(EMPLOYEES + "SELECT corp_code, bsns_year, division, sex, head_count, CAST(NULL AS BIGINT) AS contract, avg_tenure, CAST(1000 AS BIGINT) AS total_salary FROM (SELECT *, row_number() OVER (PARTITION BY corp_code, bsns_year, division, sex ORDER BY ord DESC) AS r FROM e) WHERE r = 1")
def employees(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = groups.employees(_employee_rows(spark, sf_dir))
    flat = nested.select("corp_code", "bsns_year", F.explode("divisions").alias("division", "s")).select("corp_code", "bsns_year", "division", F.explode("s").alias("sex", "m"))
    return flat.select("corp_code", "bsns_year", "division", "sex", "m.head_count", "m.contract", "m.avg_tenure", "m.total_salary")


@query("""
WITH e AS (SELECT l_suppkey AS corp_code, year(l_shipdate) AS bsns_year, CASE WHEN l_linenumber = 1 THEN '기타' ELSE l_returnflag END AS category, l_linestatus AS name, l_orderkey * 10 + l_linenumber AS ord, l_quantity AS value FROM lineitem WHERE l_linenumber <> 2)
SELECT corp_code, bsns_year, category, name, value FROM (SELECT *, row_number() OVER (PARTITION BY corp_code, bsns_year, category, name ORDER BY ord DESC) AS r FROM e) WHERE r = 1""")
def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("corp_code"), F.year("l_shipdate").alias("bsns_year"), F.when(n == 1, None).otherwise(F.col("l_returnflag")).alias("idx_cl_nm"),
        F.when(n == 2, "").otherwise(F.col("l_linestatus")).alias("idx_nm"), (F.col("l_orderkey") * 10 + n).alias("ord"), F.col("l_quantity").cast("string").alias("idx_val"),
    )
    nested = groups.indicators(rows)
    return nested.select("corp_code", "bsns_year", F.explode("indicators").alias("category", "v")).select("corp_code", "bsns_year", "category", F.explode("v").alias("name", "value"))


@query("""
WITH e AS (SELECT l_suppkey, l_returnflag AS fs_div, l_linestatus AS sj_div, CAST(l_linenumber AS VARCHAR) AS account, l_orderkey * 10 + l_linenumber AS ord, l_partkey AS part, l_quantity AS amount FROM lineitem),
a AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, fs_div, sj_div, account ORDER BY ord DESC) AS r, first_value(part) OVER (PARTITION BY l_suppkey, fs_div, sj_div ORDER BY ord) AS name FROM e)
SELECT l_suppkey, fs_div, sj_div, CAST(name AS VARCHAR) AS name, account, amount FROM a WHERE r = 1""")
def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", F.col("l_returnflag").alias("fs_div"), F.col("l_linestatus").alias("sj_div"), F.col("l_partkey").cast("string").alias("sj_nm"), F.col("l_linenumber").cast("string").alias("account_nm"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.col("l_quantity").alias("amount"),
    )
    nested = groups.statements(rows, ["l_suppkey"], ["amount"]).select("l_suppkey", F.explode("statements").alias("fs_div", "s"))
    flat = nested.select("l_suppkey", "fs_div", F.explode("s").alias("sj_div", "x")).select("l_suppkey", "fs_div", "sj_div", "x.name", F.explode("x.accounts").alias("account", "v"))
    return flat.select("l_suppkey", "fs_div", "sj_div", "name", "account", "v.amount")


@query("""
SELECT category, count(*) AS total, count(*) FILTER (WHERE l_discount > 0.05) AS matched FROM
(SELECT l_discount, CASE l_linenumber WHEN 1 THEN '자격요건' WHEN 2 THEN '우대사항' WHEN 3 THEN '주요업무' WHEN 4 THEN '인재상 및 조직문화' WHEN 5 THEN '인재상 및 조직문화' END AS category FROM lineitem) WHERE category IS NOT NULL GROUP BY category""")
def category_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("required", "preferred", "responsibility", "culture", "talent_values", "other", "other"))), F.col("l_linenumber"))
    rows = table(spark, sf_dir, "lineitem").select(kind.alias("kind"), (F.col("l_discount") > 0.05).alias("matched"))
    return fit.category_summary(rows, "kind", "matched").select("category", "total", "matched")


@query("SELECT user_id, count(*) AS found, count(*) FILTER (WHERE value > 60) AS relevant, count(*) >= 10 AND 1 - count(*) FILTER (WHERE value > 60) / count(*) > 0.5 AS noisy FROM events GROUP BY user_id")
def noise_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.noise(table(spark, sf_dir, "events"), ["user_id"], F.col("value") > 60)


@query("SELECT lower(p_name) AS key, arg_min(p_name, p_partkey) AS name, min(p_partkey) AS ord FROM part GROUP BY 1")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.ordered_distinct(table(spark, sf_dir, "part"), F.lower("p_name"), "p_name", "p_partkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 20 = 1)")
def unseen_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderkey % 20 = 1").select(F.col("o_custkey").alias("c_custkey"))
    return groups.unseen(table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey")


@query("SELECT c_name FROM customer WHERE lower(replace(c_name, '#', '')) NOT IN (SELECT lower(replace(replace(s_name, 'Supplier', 'Customer'), '#', '')) FROM supplier)")
def without_own_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "supplier").select(F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("s"))
    plain = lambda c: F.lower(F.replace(c, F.lit("#"), F.lit("")))
    return groups.without(table(spark, sf_dir, "customer").select("c_name"), plain(F.col("c_name")), own, plain(F.col("s")))


@query("SELECT user_id, event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS carried FROM events")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("v"))
    return groups.carry_forward(events, ["user_id"], "event_id", "v", "carried").drop("v")


@query("""
WITH b AS (SELECT *, count(*) FILTER (WHERE event_id % 7 = 0) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS block FROM events)
SELECT user_id, block, CAST(max(CASE WHEN event_id % 7 = 0 THEN event_id END) AS VARCHAR) AS head, string_agg(event_type, ',' ORDER BY event_id) FILTER (WHERE event_id % 7 <> 0) AS items FROM b WHERE block > 0 GROUP BY user_id, block HAVING count(*) FILTER (WHERE event_id % 7 <> 0) > 0""")
def header_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups.blocks(table(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("event_id") % 7 == 0, F.col("event_id").cast("string"), F.col("event_type"))
    return found.select("user_id", "block", "head", F.array_join("items", ",").alias("items"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE contains(CAST(l_partkey AS VARCHAR), '77') OR contains(CAST(l_suppkey AS VARCHAR), '77'))")
def keyword_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return groups.keyword_groups(rows, "l_orderkey", F.lit("77"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).select("l_orderkey", "l_linenumber")


@query("""
SELECT a.o_orderkey AS first, b.o_orderkey AS second FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND abs(date_diff('day', a.o_orderdate, b.o_orderdate)) <= 1""")
def close_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.close_pairs(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", "o_orderdate").select("first", "second")


@query("""
SELECT a.label, a.vec_id AS first, b.vec_id AS second FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id AND abs(a.vec_id % 40 - b.vec_id % 40) <= 2
WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3""")
def near_dup_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("day", F.date_add(F.lit(AS_OF), (F.col("vec_id") % 40).cast("int")))
    return cluster.close_pairs(rows, ["label"], "vec_id", "day", 2, "embedding", 0.3).select("label", "first", "second")


@query("SELECT o_orderpriority, o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def latest_by_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest number wins, as a number: 10 before 9."""
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", "o_custkey", "o_orderkey")
    return groups.latest(orders, ["o_orderpriority"], "o_custkey", "o_orderkey")


@query("SELECT DISTINCT node, min(node) OVER (PARTITION BY c) AS component FROM (SELECT l_orderkey * 100 + l_linenumber AS node, l_orderkey AS c FROM lineitem)")
def line_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order, each linked to the next."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("src"))
    edges = lines.withColumn("dst", F.coalesce(F.lead("src").over(W.partitionBy("l_orderkey").orderBy("src")), "src"))
    return graph.keyed_components(edges, "l_orderkey")


# Scalar functions


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS collapsed FROM documents")
def collapse_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.collapse(F.col("text")).cast("binary")).alias("collapsed"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(DATE '1998-07-29' - CAST(o_orderkey % 9 AS INT), '%Y-%m-%d')
  WHEN 2 THEN strftime(DATE '1998-07-29' - 7 * CAST(o_orderkey % 9 AS INT), '%Y-%m-%d') WHEN 3 THEN '1998-07-29' END AS day FROM orders""")
def article_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    n = (key % 9).cast("string")
    said = choose(key, F.concat(F.lit("입력 "), F.date_format("o_orderdate", "yyyy.M.d"), F.lit(".")), F.concat(n, F.lit("일 전")), F.concat(n, F.lit(" 주 전")), F.concat(n, F.lit("시간 전")), F.when(key % 2 == 0, "2024.02.30").otherwise("1개월 전"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(text.article_date(said, AS_OF), "yyyy-MM-dd").alias("day"))


@query("SELECT c_custkey, c_name || ' A&B.' AS plain, lower(c_name) || 'a&b.' AS name_key, replace(c_name, ' ', '') || 'AB' AS registry_key FROM customer")
def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("㈜ "), F.col("c_name"), F.lit(" (주)  A&B. 유한회사"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.strip_entity(name).alias("plain"), text.name_key(name).alias("name_key"), text.registry_key(name).alias("registry_key"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey * 1000 END AS whole, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey * 1000 AS DOUBLE) WHEN 1 THEN 12.5::DOUBLE END AS real FROM orders""")
def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    said = choose(key, F.concat(F.lit(" "), F.format_number(key * 1000, 0)), "12.5", "-", "")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.to_int(said).alias("whole"), text.to_float(said).alias("real"))


@query("""
SELECT s_suppkey, lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS number, s_suppkey % 3 <> 2 AS same, s_suppkey % 2 = 0 AS verified FROM supplier""")
def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    number = F.lpad(key.cast("string"), 10, "0")
    dashed = F.concat_ws("-", F.substring(number, 1, 3), F.substring(number, 4, 2), F.substring(number, 6, 5))
    person = choose(key, "대표이사 김 철수", "김철수 CEO", "이영희")
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", text.business_number(F.concat(F.lit("주소 사업자 등록번호 : "), dashed, F.lit(" 끝"))).alias("number"), text.same_person(person, F.lit("김철수 대표")).alias("same"),
        text.verified(dashed, person, F.when(key % 2 == 0, number).otherwise("0"), F.lit("김철수")).alias("verified"),
    )


@query("""
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '11011' WHEN 1 THEN '11012' WHEN 2 THEN '11013' WHEN 3 THEN '11014' END AS code, CASE WHEN o_orderkey % 5 < 4 THEN strftime(o_orderdate, '%Y') END AS year FROM orders""")
def report_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, year = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy")
    at = lambda m: F.concat(F.lit("("), year, F.lit(f".{m})"))
    name = choose(key, F.concat(F.lit("사업보고서 "), at("12")), F.concat(F.lit("반기보고서 "), at("06")), F.concat(F.lit("[기재정정]분기보고서 "), at("03")), F.concat(F.lit("분기보고서 "), at("09")), "분기보고서")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.report_code(name).alias("code"), text.fiscal_year(name).alias("year"))


@query("""
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://www.jobkorea.co.kr/Recruit/GI_Read_Comt_Ifrm?Gno=' || page_id END AS detail, page_id % 3 = 0 AS blocked,
  '2025-0' || (page_id % 9 + 1) || '-05' AS deadline FROM pages""")
def posting_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("page_id")
    at = F.concat(F.when(key % 2 == 0, "https://www.jobkorea.co.kr").otherwise("https://evil-jobkorea.co.kr.example.com"), F.lit("/Recruit/GI_Read/"), key.cast("string"), F.lit("?Oem=1"))
    url = F.when(key % 3 == 0, "https://blog.naver.com/a").otherwise(F.col("url"))
    body = F.concat(F.lit("접수 2024-01-02 ~ 2025년 "), (key % 9 + 1).cast("string"), F.lit("월 5일"))
    return table(spark, sf_dir, "pages").select("page_id", text.detail_url(at).alias("detail"), text.blocked(url).alias("blocked"), text.deadline(F.lit(None).cast("string"), body).alias("deadline"))


@query("SELECT c_custkey, c_custkey % 3 <> 2 AS named FROM customer")
def names_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    said = choose(key, F.concat(F.lit("about ㈜"), F.upper("c_name"), F.lit("!")), "한빛 공장", "nobody")
    name = F.when(key % 3 == 1, "한빛테크").otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.name_appears(name, said).alias("named"))


@query("SELECT event_id, ['image/png', 'image/jpeg', 'image/webp', 'image/gif', 'image/png'][event_id % 5 + 1] AS mime FROM events")
def image_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = choose(F.col("event_id"), "89504E470D0A1A0A00", "FFD8FFE000", "524946460000000057454250", "47494638396100", "00")
    return table(spark, sf_dir, "events").select("event_id", text.mime(F.unhex(data)).alias("mime"))


@query("""
SELECT c_custkey, unnest(CASE WHEN c_custkey % 2 = 0 THEN ['"' || c_name || '"', '기업 "' || c_name || '"', '"' || c_name || '" "Kim"', '기업 "' || c_name || '" "Kim"'] ELSE ['"' || c_name || '"', '기업 "' || c_name || '"'] END) AS variant FROM customer""")
def query_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.query_variants(F.concat(F.lit("주식회사 "), F.col("c_name")), F.when(F.col("c_custkey") % 2 == 0, "Kim"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.explode(found).alias("variant"))


@query("""
SELECT l_orderkey, l_linenumber, '[' || CASE l_linenumber WHEN 1 THEN '자격요건' WHEN 2 THEN '우대사항' ELSE '기타' END || '] ' || CASE WHEN l_tax > 0.03 THEN '✓' ELSE '✗' END || ' need ' || l_partkey
  || CASE WHEN l_tax > 0.03 AND l_linenumber <> 3 THEN chr(10) || '  근거: ' || l_returnflag ELSE '' END || chr(10) || '  판단: ' || l_linestatus AS line FROM lineitem""")
def match_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    kind = F.when(n == 1, "required").when(n == 2, "preferred").otherwise("unknown")
    line = fit.match_text(kind, F.col("l_tax") > 0.03, F.concat(F.lit("need "), F.col("l_partkey").cast("string")), F.when(n == 3, "").otherwise(F.col("l_returnflag")), F.col("l_linestatus"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", line.alias("line"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <= 2 THEN 'skills[' || (l_linenumber - 1) || ']' END AS field, CASE WHEN l_linenumber <= 2 THEN 'ev' || (l_linenumber - 1) ELSE 'model' END AS excerpt FROM lineitem WHERE NOT (l_linenumber = 4)""")
def evidence_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    feature = lambda i: F.struct(F.lit(f"n{i}").alias("name"), F.lit(f"ev{i}").alias("evidence"), F.lit("cv").alias("source"))
    profile = F.struct(*(F.array(feature(0), feature(1)).alias(s) for s in fit.SECTIONS))
    path = F.when(n <= 5, F.concat(F.lit("skills["), (n - 1).cast("string"), F.lit("]"))).when(n == 6, "NONE")
    company = F.struct(F.array().cast("array<string>").alias("culture"), F.array(F.lit("x")).alias("industry_domain"), F.array(F.lit("x")).alias("talent_values"))
    items = table(spark, sf_dir, "lineitem").withColumn("dimension", F.when(n == 4, "culture").when(n == 5, "talent_values"))
    made = fit.with_dimension(items, company).withColumn("e", fit.evidence(path, F.lit("model"), profile, "candidate"))
    return made.select("l_orderkey", "l_linenumber", "e.field", "e.excerpt")


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector and the next."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return rows.join(other, "vec_id").select("vec_id", F.round(text.cosine(F.col("embedding"), F.col("next")), 9).alias("similarity"))


@query("SELECT o_orderkey, strftime(o_orderdate - INTERVAL 6 MONTH, '%Y-%m-%d') AS half_year_ago, abs(date_diff('day', o_orderdate, DATE '1998-07-29')) AS days FROM orders")
def month_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(text.months_ago(day, 6), "yyyy-MM-dd").alias("half_year_ago"), text.days_apart(day, F.lit(AS_OF)).cast("long").alias("days"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_name END AS cleaned, CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE '' END || ',' || p_partkey AS listed,
CASE WHEN p_partkey % 3 = 0 THEN '{"n":' || p_partkey || '}' ELSE '데이터 없음' END AS prompt, CASE WHEN p_partkey % 4 = 0 THEN p_name END IS NOT NULL AS any FROM part""")
def cleaned_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    said = choose(key, F.col("p_name"), "null", " None ", "")
    row = F.when(key % 3 == 0, F.struct(key.alias("n")))
    listed = text.clean_nulls(F.array(said, F.lit("NULL"), key.cast("string")))
    joined = F.when(F.size(listed) == 2, F.array_join(listed, ",")).otherwise(F.concat(F.lit(","), F.array_join(listed, ",")))
    return table(spark, sf_dir, "part").select("p_partkey", text.clean_null(said).alias("cleaned"), joined.alias("listed"), text.or_placeholder(row).alias("prompt"), text.has_value(text.clean_null(said), F.lit("")).alias("any"))


# Taxonomy, decisions, timelines, topics


@query(f"SELECT * FROM {EVENTS_SQL}")
def event_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.taxonomy(spark)


@query(f"""
WITH t AS (SELECT * FROM {EVENTS_SQL}), c AS (SELECT min(ord) AS ord, '[' || category_id || '] ' || category_label || chr(10) || string_agg('  ' || event_id || ': ' || label_ko || ' (중요도' || base_importance || ')', chr(10) ORDER BY ord) AS block FROM t GROUP BY category_id, category_label)
SELECT string_agg(block, chr(10) ORDER BY ord) AS prompt_text FROM c""")
def taxonomy_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.prompt_text(spark)


def _event(key: Column) -> Column:
    """An event of the taxonomy by the key, and an unknown one for some."""
    names = F.array(*(F.lit(r[1]) for r in taxonomy.rows()), F.lit("no.such_event"))
    return F.element_at(names, (key % 62 + 1).cast("int"))


ISSUES_SQL = f"""
WITH t AS (SELECT * FROM {EVENTS_SQL}),
i AS (SELECT o_orderkey AS ord, coalesce(t.event_id, 'general_other.general_pr') AS event_id, coalesce(t.category_id, 'general_other') AS category_id, CAST(o_orderkey * 7919 % 10 + 1 AS INT) AS importance, strftime(o_orderdate, '%Y-%m') AS occurred_month, o_orderpriority AS category
  FROM orders LEFT JOIN t ON t.ord = o_orderkey % 62)
"""


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(key.alias("ord"), _event(key).alias("event_id"), (key * 7919 % 10 + 1).cast("int").alias("importance"), F.date_format("o_orderdate", "yyyy-MM").alias("occurred_month"), F.col("o_orderpriority").alias("category"))


@query(ISSUES_SQL + "SELECT category_id, CAST(row_number() OVER (PARTITION BY category_id ORDER BY importance DESC, ord) - 1 AS INT) AS pos, ord, event_id, importance FROM i")
def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decisions.topics(_issues(spark, sf_dir))
    return found.select("category_id", F.posexplode("issues").alias("pos", "i")).select("category_id", "pos", "i.ord", "i.event_id", "i.importance")


@query(ISSUES_SQL + "SELECT y.year, CAST(row_number() OVER (PARTITION BY y.year ORDER BY importance DESC, ord) - 1 AS INT) AS pos, ord, category FROM i JOIN (VALUES ('1996'), ('1997'), ('1998')) AS y(year) ON y.year = occurred_month[1:4]")
def yearly_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decisions.yearly(_issues(spark, sf_dir), AS_OF)
    return found.select("year", F.posexplode("issues").alias("pos", "i")).select("year", "pos", "i.ord", "i.category")


@query("SELECT count(*) AS news_count FROM orders")
def issue_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.issue_count(decisions.lighten(decisions.topics(_issues(spark, sf_dir)), ("event_id", "importance")))


CHAIN_SQL = """
WITH o AS (SELECT *, row_number() OVER w - 1 AS idx, date_diff('day', lag(o_orderdate) OVER w, o_orderdate) AS gap FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
c AS (SELECT *, sum(CASE WHEN gap <= 90 THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY idx) AS chain FROM o),
m AS (SELECT *, strftime(o_orderdate, '%Y-%m') AS mon FROM c)
"""


@query(CHAIN_SQL + """
SELECT min(o_orderkey) AS ord, arg_max(mon, (mon, o_orderkey)) AS occurred_month, CASE WHEN count(*) > 1 THEN string_agg('[' || mon || '] ' || o_orderstatus, ' → ' ORDER BY mon, o_orderkey) ELSE min(o_orderstatus) END AS gist,
  CAST(max(o_orderkey % 10 + 1) AS INT) AS importance, CAST(count(*) AS INT) AS n FROM m GROUP BY o_custkey, chain""")
def timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    orders = table(spark, sf_dir, "orders").withColumn("idx", F.row_number().over(by) - 1).withColumn("gap", F.date_diff("o_orderdate", F.lag("o_orderdate").over(by)))
    links = F.when(F.col("gap") <= 90, F.array(F.col("idx") - 1)).otherwise(F.array().cast("array<int>"))
    issues = orders.select(
        F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("batch_id"), "idx", F.lit("t").alias("issue_title"), F.date_format("o_orderdate", "yyyy-MM").alias("occurred_month"), F.col("o_orderstatus").alias("gist"),
        F.lit("").alias("detail_summary"), F.lit(taxonomy.FALLBACK).alias("event_id"), F.array("o_orderkey").alias("articles"), (F.col("o_orderkey") % 10 + 1).cast("int").alias("company_importance"), links.alias("supersedes"),
    )
    return decisions.merge_timelines(issues).select("ord", "occurred_month", "gist", "importance", F.size("articles").alias("n"))


ITEMS_SQL = "WITH i AS (SELECT *, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) AS n FROM orders), b AS (SELECT o_custkey * 1000 + n // 6 AS batch_id, CAST(n % 6 AS INT) AS idx, o_orderkey FROM i)"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return decisions.batches(orders, ["o_custkey"], "o_orderkey", 6).select((F.col("o_custkey") * 1000 + F.col("batch_id")).alias("batch_id"), "idx", "o_orderkey")


@query("SELECT o_orderkey, CAST(n // 25 AS BIGINT) AS batch_id, CAST(n % 25 AS INT) AS idx FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS n FROM orders)")
def fixed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.batches(table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey"), ["o_orderpriority"], "o_orderkey").select("o_orderkey", "batch_id", "idx")


@query(ITEMS_SQL + "SELECT o_orderkey, CAST(CASE WHEN batch_id % 3 = 0 THEN idx ELSE 5 - idx END AS INT) AS pos FROM b WHERE batch_id % 3 = 0 OR idx <> 1")
def relevant_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    said = items.where("batch_id % 3 != 0").select("batch_id", (5 - F.col("idx")).alias("pos"), F.when(F.col("idx") == 1, 99).otherwise(F.col("idx")).alias("idx"))
    return decisions.keep_relevant(items, said).select("o_orderkey", "pos")


@query(ITEMS_SQL + ", s AS (SELECT batch_id, count(*) AS size FROM b GROUP BY batch_id) SELECT o_orderkey, CASE WHEN batch_id % 3 = 0 AND size > 1 OR batch_id % 3 = 1 AND size < 3 THEN CAST(idx // 2 AS INT) ELSE idx END AS group_no FROM b JOIN s USING (batch_id) WHERE NOT (batch_id % 3 = 0 AND size > 1 AND idx = 0)")
def grouped_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid answers without the first index, answers out of range from three rows on, and batches without an answer."""
    items = _items(spark, sf_dir)
    half = F.floor(F.col("idx") / 2).cast("int")
    valid = items.where("batch_id % 3 = 0 and idx > 0").select("batch_id", half.alias("group_no"), "idx")
    wrong = items.where("batch_id % 3 = 1").select("batch_id", half.alias("group_no"), F.when(F.col("idx") == 2, 50).otherwise(F.col("idx")).alias("idx"))
    return decisions.group_items(items, valid.union(wrong)).select("o_orderkey", "group_no")


@query(ITEMS_SQL + "SELECT o_orderkey, CASE WHEN idx = 3 THEN '' WHEN idx = 2 THEN 'second' ELSE 'first' END AS gist, CASE WHEN idx = 3 THEN 'general_other.general_pr' ELSE 'esg_csr.csr_activity' END AS event_id FROM b")
def summarised_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    answer = lambda df, pos, gist: df.select("batch_id", F.lit(pos).alias("pos"), "idx", F.lit(gist).alias("gist"), F.lit("").alias("detail_summary"), F.lit("esg_csr.csr_activity").alias("event_id"))
    said = answer(items.where("idx != 3"), 0, "first").union(answer(items.where("idx = 2"), 1, "second"))
    return decisions.summaries(items, said).select("o_orderkey", "gist", "event_id")


@query(ITEMS_SQL + f""", t AS (SELECT * FROM {EVENTS_SQL}), s AS (SELECT batch_id, count(*) AS size FROM b GROUP BY batch_id)
SELECT o_orderkey, CAST(CASE WHEN idx = 0 THEN coalesce(base_importance, 2) ELSE greatest(1, least(10, o_orderkey % 20 - 4)) END AS INT) AS company_importance, CASE WHEN idx = 0 THEN '' ELSE CAST(idx - 1 AS VARCHAR) END AS supersedes
FROM b JOIN s USING (batch_id) LEFT JOIN t ON t.ord = o_orderkey % 62""")
def ranked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir).withColumn("event_id", _event(F.col("o_orderkey")))
    links = F.array(F.col("idx") - 1, F.col("idx"), F.lit(77), F.lit(-1))
    said = items.where("idx > 0").select("batch_id", F.lit(0).alias("pos"), "idx", (F.col("o_orderkey") % 20 - 4).cast("int").alias("company_importance"), links.alias("supersedes"))
    return decisions.importance(items, said).select("o_orderkey", "company_importance", F.array_join("supersedes", ",").alias("supersedes"))


@query(r"""
WITH RECURSIVE d AS (SELECT source, doc_id, least(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f\v]+')), 8192)::BIGINT AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
r AS (SELECT source, doc_id, n, i, n AS used, 0::BIGINT AS batch FROM d WHERE i = 1
  UNION ALL SELECT d.source, d.doc_id, d.n, d.i, CASE WHEN r.used > 0 AND r.used + d.n > 250000 THEN d.n ELSE r.used + d.n END, r.batch + CASE WHEN r.used > 0 AND r.used + d.n > 250000 THEN 1 ELSE 0 END
  FROM r JOIN d ON d.source IS NOT DISTINCT FROM r.source AND d.i = r.i + 1)
SELECT source, doc_id, n AS n_tokens, batch FROM r""")
def token_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words stand for tokens; each source's documents in order of id."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    return decisions.token_batches(docs, "source", "doc_id", "text", re.compile(r"[^ \t\n\r\f\v]+").findall, " ".join).drop("text")


# Registry


REGISTRY_SQL = """
WITH r AS (SELECT c_custkey, c_name, CASE WHEN c_nationkey % 3 = 0 THEN 1 ELSE 0 END AS listed, CASE WHEN c_custkey % 5 = 0 THEN 'ENG ' || c_custkey ELSE '' END AS eng, c_custkey % 97 AS modified FROM customer),
n AS (SELECT s_suppkey, unnest([0, 1]) AS pos, unnest([CASE s_suppkey % 4 WHEN 0 THEN 'nobody' WHEN 1 THEN 'Customer#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') WHEN 2 THEN '㈜customer#' ELSE 'Customer#00000' || lpad(CAST(s_suppkey AS VARCHAR), 3, '0') END, CASE WHEN s_suppkey % 4 = 0 THEN 'ENG' || s_suppkey * 5 ELSE 'x' END]) AS name FROM supplier),
k AS (SELECT *, regexp_replace(replace(name, '㈜', ''), '[\\s().,&]', '', 'g') AS key FROM n),
m AS (SELECT s_suppkey, pos, c_custkey, listed, modified, length(c_name) AS size, CASE WHEN name = c_name OR name = eng THEN 1 WHEN key = c_name OR (eng <> '' AND key = replace(eng, ' ', '')) THEN 2 ELSE 3 END AS tier FROM k JOIN r
  ON name = c_name OR name = eng OR key = c_name OR (eng <> '' AND key = replace(eng, ' ', '')) OR (length(key) >= 4 AND (contains(c_name, key) OR contains(replace(eng, ' ', ''), key)))),
f AS (SELECT *, rank() OVER (PARTITION BY s_suppkey ORDER BY tier, pos) AS a, min(size) OVER (PARTITION BY s_suppkey, tier, pos) AS least FROM m),
g AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY listed DESC, lpad(CAST(modified AS VARCHAR), 3, '0') DESC, c_custkey) AS rank, count(*) OVER (PARTITION BY s_suppkey) AS n FROM f WHERE a = 1 AND (tier < 3 OR size = least))
"""


@query(REGISTRY_SQL + "SELECT s_suppkey AS subject, c_custkey AS corp_code, tier, CAST(rank AS INT) AS rank, n FROM g")
def registry_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, known = _names(spark, sf_dir), _registry(spark, sf_dir)
    return registry.ranked(registry.candidates(names, known), known).select("subject", "corp_code", "tier", "rank", "n")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    first = choose(key, "nobody", F.concat(F.lit("Customer#"), F.lpad(key.cast("string"), 9, "0")), "㈜customer#", F.concat(F.lit("Customer#00000"), F.lpad(key.cast("string"), 3, "0")))
    second = F.when(key % 4 == 0, F.concat(F.lit("ENG"), (key * 5).cast("string"))).otherwise("x")
    return table(spark, sf_dir, "supplier").select(key.alias("subject"), F.posexplode(F.array(first, second)).alias("pos", "name"))


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("corp_code"), F.col("c_name").alias("corp_name"), F.when(key % 5 == 0, F.concat(F.lit("ENG "), key.cast("string"))).otherwise("").alias("corp_eng_name"),
        F.when(F.col("c_nationkey") % 3 == 0, "S").otherwise("").alias("stock_code"), F.lpad((key % 97).cast("string"), 3, "0").alias("modify_date"), key.alias("ord"),
    )


@query(REGISTRY_SQL + """
SELECT s_suppkey AS subject, arg_min(c_custkey, rank) AS corp_code FROM g WHERE CASE WHEN s_suppkey % 2 = 0 AND (tier = 3 OR n > 1) THEN rank <= 5 AND c_custkey = s_suppkey ELSE rank = 1 END GROUP BY s_suppkey""")
def registry_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers looked up with what their profiles give: a business number where the profile was read, and nothing where it failed."""
    key = F.col("s_suppkey")
    name = F.concat(F.lit("firm "), key.cast("string"))
    pages = table(spark, sf_dir, "supplier").select(
        name.alias("company_name"), F.when(key % 2 == 0, "http://a").alias("url"), name.alias("text"), F.lit('{"business_description": "makes x"}').alias("answer"), F.lpad(key.cast("string"), 10, "0").alias("biz_reg_no"),
    )
    names = _names(spark, sf_dir).withColumn("company_name", F.concat(F.lit("firm "), F.col("subject").cast("string")))
    overview = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("corp_code"), F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("bizr_no"), F.lit("").alias("ceo_nm"))
    found = company.registry_of_profiles(company.profiles(pages), names, _registry(spark, sf_dir), overview)
    return found.select(F.regexp_extract("company_name", r"(\d+)$", 1).cast("long").alias("subject"), "corp_code")


# Vectors


@query("""
WITH e AS (SELECT vec_id, label, vec_id % 3 AS press, embedding FROM embeddings), p AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, a.press AS pa, b.press AS pb, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id),
m AS (SELECT label, a, row_number() OVER (PARTITION BY label ORDER BY round(avg(s), 9) DESC, a) AS r FROM p GROUP BY label, a), f AS (SELECT label, a FROM m WHERE r = 1),
s AS (SELECT label, b, row_number() OVER (PARTITION BY label ORDER BY (pa <> pb) DESC, s DESC, b) AS r FROM p JOIN f USING (label, a))
SELECT label, a AS vec_id, 1 AS pick FROM f UNION ALL SELECT label, b, 2 FROM s WHERE r = 1""")
def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("press", F.col("vec_id") % 3)
    return cluster.representatives(rows, "label", "vec_id", "embedding", "press").select("label", "vec_id", "pick")


@query("""
WITH p AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]) AS s FROM embeddings q JOIN embeddings i ON q.vec_id <> i.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, item_id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS INT) AS rank FROM p) WHERE rank <= 5""")
def top_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return cluster.top_similar(rows.where("vec_id % 100 = 0"), rows, "vec_id", "vec_id", "embedding").select("query_id", "item_id", "rank")


@query()
def leader_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("day", F.date_add(F.lit(AS_OF), (F.col("vec_id") % 3).cast("int")))
    return cluster.leader_clusters(rows, "label", "vec_id", "embedding", "day", near=0.35)


@query()
def coherent_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.coherent_groups(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", least=0.1)


# Collection


@query("SELECT o_orderkey, CASE WHEN o_orderdate >= '1998-01-29' THEN 0 WHEN o_orderdate >= '1998-01-01' THEN 1 WHEN o_orderdate >= '1997-01-01' THEN 2 ELSE 3 END AS round FROM orders WHERE o_orderdate >= '1996-01-01' AND o_orderdate < '1998-07-30'")
def search_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return incremental.rounds(orders, AS_OF, "day").select("o_orderkey", "round")


PAGES_SQL = """
WITH p AS (SELECT user_id, event_id, props AS url, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 10 + 1 AS page FROM events), r AS (SELECT * FROM p WHERE page <= 30),
f AS (SELECT *, min(page) OVER (PARTITION BY user_id, url) < page AS old FROM r), s AS (SELECT user_id, page, avg(old::INT) AS share FROM f GROUP BY user_id, page),
e AS (SELECT user_id, coalesce(min(page) FILTER (WHERE share >= 0.8), 31) AS last FROM s GROUP BY user_id)
SELECT user_id, event_id FROM f JOIN e USING (user_id) WHERE page < last AND NOT old"""


@query(PAGES_SQL)
def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.floor((F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1) / 10) + 1
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("props").alias("url"), page.cast("int").alias("page"))
    return incremental.read_pages(rows, ["user_id"], "page", "event_id", "url").select("user_id", "event_id")


@query(PAGES_SQL)
def paged_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_pages() through the data source: users as queries, their events as stored articles, read page by page."""
    path = f"{shared_dir(spark)}/articles-{uuid.uuid4().hex}"
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("query"), F.col("event_id").alias("ord"), F.col("event_id").cast("string").alias("title"), F.col("props").alias("url"), none.alias("mirror_url"), none.alias("press"),
        none.alias("snippet"), F.lit(None).cast("date").alias("date"),
    )
    paged.store_articles(rows, path)
    paged.register(spark)
    found = spark.read.format("paged_search").options(provider="newsloom.sources.paged:stored", lister="newsloom.sources.paged:stored_queries", path=path).load()
    return found.select(F.col("query").cast("long").alias("user_id"), F.col("title").cast("long").alias("event_id"))


@query("SELECT event_id, ts::VARCHAR AS ts FROM events WHERE ts >= '2024-01-05' AND ts < '2024-01-09'")
def day_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stores.day_window(table(spark, sf_dir, "events"), F.col("ts"), date(2024, 1, 5), date(2024, 1, 9))
    return rows.where(F.col("ts") < F.lit(date(2024, 1, 9))).select("event_id", F.col("ts").cast("string").alias("ts"))


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, counted by day; every batch's snapshot is written before the next."""
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    counted = collect.counts(stream, "ts", "1 day", ["event_type"])
    collect.run_available(counted, f"{at}/state", lambda batch, n: batch.write.mode("overwrite").parquet(f"{at}/out"), "complete")
    return spark.read.parquet(f"{at}/out").select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("SELECT DISTINCT user_id FROM events")
def stream_new_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    collect.run_available(collect.new_by_key(stream, "user_id", "ts", "60 days"), f"{at}/state", collect.snapshots(f"{at}/out"))
    return spark.read.parquet(f"{at}/out").select("user_id")


@query("SELECT 'order' AS kind, CAST(o_custkey AS VARCHAR) AS key, CAST(max(o_orderkey) AS VARCHAR) AS n FROM orders WHERE o_orderkey % 10 <> 0 GROUP BY o_custkey")
def stored_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports saved and listed again; some of them are no JSON."""
    path = f"{shared_dir(spark)}/reports-{uuid.uuid4().hex}"
    key = F.col("o_orderkey")
    payload = F.when(key % 10 == 0, "{broken").otherwise(F.concat(F.lit('{"n":'), key.cast("string"), F.lit("}")))
    saved = F.timestamp_seconds(key).cast("timestamp_ntz")
    stores.save_reports(table(spark, sf_dir, "orders").select(F.lit("order").alias("kind"), F.col("o_custkey").cast("string").alias("key"), saved.alias("saved_at"), payload.alias("payload")), path)
    found = stores.latest_reports(stores.list_reports(spark, path, "order"))
    return found.select("kind", "key", F.get_json_object("payload", "$.n").alias("n"))


@query("""
SELECT kind, key, filename, arg_max(content, l_orderkey * 10 + l_linenumber) AS content FROM (SELECT *, 'k' || l_linenumber % 2 AS kind, l_returnflag AS key, 'f' || l_partkey % 3 || '/a b' AS filename, l_orderkey || '-' || l_linenumber AS content FROM lineitem) GROUP BY ALL""")
def raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw files written in two goes: in the second those of odd orders' lines come anew, and other names stay."""
    path = f"{shared_dir(spark)}/raw-{uuid.uuid4().hex}"
    n = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("k"), (n % 2).cast("string")).alias("kind"), F.col("l_returnflag").alias("key"), F.lit("site").alias("source"), F.concat(F.lit("f"), (F.col("l_partkey") % 3).cast("string"), F.lit("/a b")).alias("filename"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), n.cast("string")).alias("content"), (F.col("l_orderkey") * 10 + n).alias("at"),
    )
    stores.save_raw(rows.where("filename != 'f1/a b'"), path, "at")
    stores.save_raw(rows.where("filename = 'f1/a b'"), path, "at")
    return stores.read_raw(spark, path).select("kind", "key", "filename", "content")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS cust FROM orders WHERE o_orderkey % 4 <> 0""")
def api_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    row = F.to_json(F.struct(F.when(key % 3 != 0, F.col("o_custkey")).alias("cust")))
    body = F.when(key % 4 == 0, '{"status":"013","message":"none"}').otherwise(F.concat(F.lit('{"status":"000","list":['), row, F.lit("]}")))
    return stores.api_rows(table(spark, sf_dir, "orders").withColumn("body", body), "body", "cust bigint", ("o_orderkey",))


@query("""
SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS corp_code, c_name AS corp_name, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS eng_csv, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS eng_xml FROM customer""")
def registry_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry written as CSV and as XML, and read from both."""
    path, key = f"{shared_dir(spark)}/registry-{uuid.uuid4().hex}", F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        F.lpad(key.cast("string"), 8, "0").alias("corp_code"), F.col("c_name").alias("corp_name"), F.when(key % 3 != 0, F.col("c_mktsegment")).alias("corp_eng_name"), F.lit(None).cast("string").alias("stock_code"), F.lit("20240101").alias("modify_date"),
    )
    rows.write.option("header", True).csv(f"{path}/csv")
    rows.write.format("xml").option("rowTag", "list").save(f"{path}/xml")
    a, b = stores.read_registry_csv(spark, f"{path}/csv"), stores.read_registry_xml(spark, f"{path}/xml").select("corp_code", F.col("corp_eng_name").alias("eng_xml"))
    return a.join(b, "corp_code").select("corp_code", "corp_name", F.col("corp_eng_name").alias("eng_csv"), "eng_xml")


@query("""
SELECT s_suppkey, '재무상태표' AS statement, unnest(['cash', 'debt']) AS account, unnest([CAST(s_suppkey AS VARCHAR), CAST(s_nationkey AS VARCHAR)]) AS now, unnest([NULL, '7']) AS before, CAST(s_suppkey * 2 AS VARCHAR) AS total FROM supplier WHERE s_suppkey % 5 <> 0""")
def audit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' zipped audit reports, some of which are no archives."""

    @F.pandas_udf("binary")
    def zipped(xml: pd.Series) -> pd.Series:
        def one(x: str) -> bytes:
            packed = io.BytesIO()
            with zipfile.ZipFile(packed, "w") as z:
                z.writestr("report.xml", x)
            return packed.getvalue()

        return xml.map(one)

    key = F.col("s_suppkey").cast("string")
    cell = lambda n, c: F.concat(F.lit(f'<TE ADELIM="{n}">'), c, F.lit("</TE>"))
    row = lambda *cells: F.concat(F.lit("<TR>"), *cells, F.lit("</TR>"))
    table_ = F.concat(F.lit('<TABLE-GROUP ACLASS="PBS_1">'), row(cell(1, key), cell(0, F.lit("cash"))), row(cell(0, F.lit("debt")), cell(2, F.col("s_nationkey").cast("string")), cell(3, F.lit("7"))), F.lit("</TABLE-GROUP>"))
    xml = F.concat(F.lit('<DOC><EXTRACTION ACODE="TOT">'), (F.col("s_suppkey") * 2).cast("string"), F.lit("</EXTRACTION>"), table_, F.lit("</DOC>"))
    files = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 5 == 0, F.lit("no zip").cast("binary")).otherwise(zipped(xml)).alias("content"))
    read = stores.audit_reports(files, keep=("s_suppkey",)).select("s_suppkey", "summary", F.explode("statements").alias("statement", "a")).select("s_suppkey", "summary", "statement", F.explode("a").alias("account", "v"))
    return read.select("s_suppkey", "statement", "account", F.col("v")["당기"].alias("now"), F.col("v")["전기"].alias("before"), F.col("summary")["TOT"].alias("total"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'b' ELSE 'c' END AS site, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_name END AS name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || ' | ' || c_nationkey ELSE NULL END AS industry,
CASE WHEN c_custkey % 2 = 0 THEN '[{"year":"20' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || '","events":["one","' || c_name || '"]}]' ELSE '[{"year":"1999","events":["e ' || c_custkey || '"]}]' END AS history FROM customer""")
def site_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' pages in the second and the third site's layout."""
    key, name = F.col("c_custkey"), F.col("c_name")
    year = F.concat(F.lit("20"), F.lpad((key % 100).cast("string"), 2, "0"))
    b = F.concat(
        F.lit('<div class="company-body-infomation"><table class="table-basic-infomation-primary"><tr class="field"><th>업종</th><td><div class="value">'), F.col("c_mktsegment"), F.lit('</div><div class="value">'), F.col("c_nationkey").cast("string"),
        F.lit('</div></td></tr></table><div id="devJKhistory">before<br>'), year, F.lit("년<br>- one<br>- "), name, F.lit("<br>1998년</div></div>"),
    )
    c = F.concat(F.lit('jobkorea.co.kr/super/ <div id="wrap"><h2 class="giHd">'), name, F.lit('</h2><ul class="history_cont"><li><p>1999</p><ul><li>e '), key.cast("string"), F.lit("</li></ul></li></ul></div>"))
    pages = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("http://www.jobkorea.co.kr/"), key.cast("string")).alias("url"), F.when(key % 2 == 0, b).otherwise(c).alias("html"))
    read = html.profiles(pages, keep=("c_custkey",))
    field = lambda path: F.get_json_object("profile", path)
    return read.select("c_custkey", "site", field("$.company_name").alias("name"), field("$.basic_info.업종").alias("industry"), field("$.history").alias("history"))


@query()
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html.parts(F.col("html"), F.lit(""), "lines", "flat").alias("p")).select("page_id", "p.lines", "p.flat")


@query()
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", html.parts(F.col("html"), F.col("url"), "links", "company_link").alias("p")).select("page_id", "url", "p.links", "p.company_link")
    return pages.select("page_id", F.size("links").alias("n"), html.link_by_words(F.col("links"), F.col("url"), ("the", "la")).alias("by_word"), F.col("company_link").alias("company"), html.official_url(F.col("links")).alias("official"))


@query("SELECT d.doc_id, coalesce(p.url, d.source) AS body FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id")
def mirror_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles, their mirrors pages with the URL for a body."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("mirror_url"), F.col("source").alias("snippet"))
    body = F.concat(F.lit('<article id="dic_area"><b>'), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</b></article>"))
    return html.with_body(docs, table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("url"), body.alias("html"))).select("doc_id", "body")


@query("""
SELECT c_custkey, unnest([0, 1, 2, 3]) AS pos, unnest([c_name || ' 소송', c_name || ' 판결', '기업 "' || c_name || '" 소송', '기업 "' || c_name || '" 판결']) AS query FROM customer""")
def litigation_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return company.litigation_queries(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name").select("c_custkey", "pos", "query")


@query(f"""
SELECT c_custkey, c_custkey % 7 = 0 AS crawl_success, [NULL, '{company.NO_URL}', '{company.EMPTY_PAGE}', '{company.NO_JSON}', '{company.WRONG_COMPANY}', '{company.NO_NAME}', '{company.NO_CONTENT}'][c_custkey % 7 + 1] AS error FROM customer""")
def profile_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as companies, each with one of the ways in which a profile fails, or none."""
    key, good = F.col("c_custkey") % 7, '{"business_description": "makes x"}'
    pages = table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat(F.col("c_name"), F.lit("|"), F.col("c_custkey").cast("string")).alias("company_name"), F.when(key != 1, "http://a").alias("url"), F.lit(None).cast("string").alias("biz_reg_no"),
        F.when(key == 2, "").when(key == 5, "another").otherwise(F.concat(F.col("c_name"), F.lit("|"), F.col("c_custkey").cast("string"))).alias("text"),
        F.when(key == 3, "{").when(key == 4, '{"is_company_match": false}').when(key == 6, "{}").otherwise(good).alias("answer"),
    )
    return company.profiles(pages).select(F.element_at(F.split("company_name", r"\|"), -1).cast("long").alias("c_custkey"), "crawl_success", "error")


@query("SELECT lower(regexp_replace(s_name, '[#]', '', 'g')) AS key, s_name AS name FROM supplier WHERE s_suppkey % 5 <> 0")
def rival_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers named twice as rivals, without those that are the company's own."""
    names = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.array(F.col("s_name"), F.concat(F.lit("㈜"), F.col("s_name")))).alias("name"))
    named = names.withColumn("ord", F.col("s_suppkey") * 2 + F.col("name").startswith("㈜").cast("int"))
    found = company.candidates(named, names.where("s_suppkey % 5 = 0").select("name"))
    return found.select(F.lower(F.replace("key", F.lit("#"), F.lit(""))).alias("key"), "name")


@query()
def news_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole news pipeline: embeddings as articles, labels as searches, answers made from positions."""
    vec = F.col("vec_id")
    articles = table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias("subject"), vec.alias("ord"), F.concat(F.lit("title "), vec.cast("string")).alias("title"), F.lit("snippet").alias("snippet"), F.lit("").alias("body"), F.lit("u").alias("url"),
        (vec % 4).cast("string").alias("press"), F.date_add(F.lit(AS_OF), -(vec % 400).cast("int")).alias("date"), "embedding",
    )
    none = spark.createDataFrame([], "batch_id long, group_no int, idx int")
    found = materialise(news.issues(news.issue_groups(articles, none, "title")))
    placed = lambda size: decisions.batches(found.withColumn("one", F.lit(0)), ["one"], "ord", size).select("batch_id", F.lit(0).alias("pos"), "idx")
    summary = placed(decisions.SUMMARY_BATCH).select("*", F.lit("gist").alias("gist"), F.lit("detail").alias("detail_summary"), F.lit("tech_rnd.patent_filing").alias("event_id"))
    ranks = placed(decisions.BATCH).select("*", (F.col("idx") + 5).alias("company_importance"), F.array().cast("array<int>").alias("supersedes"))
    made, _ = news.finalise(found, summary, ranks)
    return made.select("category_id", "category_label", "top", F.size("issues").alias("n"))


ROUNDS = [(n, a, b) for n, (a, b) in enumerate(incremental.search_rounds(AS_OF))]
#: Every 15th order as an article: the newest first, of which 30 pages of 2 are read a window and the days before once more; those of every 45th key are
#: not relevant. All are alike, so that those of a day and the day before are near copies; two neighbouring copies' firsts are one issue, if a mirror of
#: one of its articles names the company. Rounds end with 15 issues; the first two issues of each batch are one timeline.
SEARCH_SQL = f"""
WITH RECURSIVE o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, o_orderstatus AS press FROM orders WHERE o_orderkey % 15 = 0),
w AS (SELECT * FROM (VALUES {", ".join(f"({n}, DATE '{a}', DATE '{b}')" for n, a, b in ROUNDS)}) AS x(n, a, b)),
f AS (SELECT n, k, d, press, row_number() OVER (PARTITION BY n ORDER BY d DESC, k) AS r FROM o JOIN w ON d BETWEEN a AND b),
g AS (SELECT n, min(d) AS oldest FROM f WHERE r <= 60 GROUP BY n),
l AS (SELECT f.n, k, d, press, row_number() OVER (PARTITION BY f.n ORDER BY d DESC, k) AS r FROM f JOIN g ON g.n = f.n AND d < oldest),
z AS (SELECT n, k, d, press FROM f WHERE r <= 60 UNION ALL SELECT n, k, d, press FROM l WHERE r <= 60),
p AS (SELECT k, d, press, n, row_number() OVER (ORDER BY n, d DESC, k) AS ord FROM z WHERE k % 45 <> 0),
c(a) AS (SELECT max(d) FROM p UNION ALL SELECT (SELECT max(d) FROM p WHERE d < c.a - 1) FROM c WHERE c.a IS NOT NULL),
q AS (SELECT p.*, (SELECT min(a) FROM c WHERE a >= p.d) AS anchor FROM p),
s AS (SELECT *, min(ord) OVER (PARTITION BY anchor) AS head, min(n) OVER (PARTITION BY anchor) AS since FROM q),
u AS (SELECT *, dense_rank() OVER (ORDER BY head) - 1 AS cluster FROM s),
v AS (SELECT *, (cluster // 25) * 25 + cluster % 25 // 2 AS issue FROM u),
m AS (SELECT v.n AS upto, x.* FROM (SELECT DISTINCT n FROM p) AS v JOIN v AS x ON x.n <= v.n),
h AS (SELECT upto, issue FROM m GROUP BY upto, issue HAVING bool_or(k % 60 = 0)),
e AS (SELECT coalesce(min(upto) FILTER (WHERE issues >= {incremental.ENOUGH}), max(upto)) AS upto FROM (SELECT upto, count(*) AS issues FROM h GROUP BY upto)),
t AS (SELECT m.* FROM m JOIN e USING (upto) JOIN h USING (upto, issue)),
first AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY ord) AS pick FROM t),
second AS (SELECT x.*, row_number() OVER (PARTITION BY x.cluster ORDER BY x.press <> y.press DESC, x.ord) AS place FROM first AS x JOIN first AS y ON x.cluster = y.cluster AND y.pick = 1 AND x.pick > 1),
picked AS (SELECT issue, ord, k, d FROM first WHERE pick = 1 UNION ALL SELECT issue, ord, k, d FROM second WHERE place = 1),
issues AS (SELECT issue, min(ord) AS ord, arg_min(k, (d, ord)) AS title, strftime(min(d), '%Y-%m') AS month, count(*) AS n FROM picked GROUP BY issue),
numbered AS (SELECT *, row_number() OVER (ORDER BY ord) - 1 AS i FROM issues),
chained AS (SELECT *, CASE WHEN i % 25 < 2 THEN i // 25 * 25 ELSE i END AS chain FROM numbered)
SELECT 'order ' || arg_max(title, (month, ord)) AS issue_title, max(month) AS occurred_month, CAST(sum(n) AS INT) AS n, CAST(count(*) AS INT) AS members,
  CAST(max(i % 25 % 10 + 1) AS INT) AS importance, (SELECT category_id FROM {EVENTS_SQL} WHERE event_id = 'tech_rnd.patent_filing') AS category_id FROM chained GROUP BY chain"""


@query(SEARCH_SQL)
def company_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A company's search from end to end, through the paged source: see SEARCH_SQL for what decides its rows."""
    path, none = f"{shared_dir(spark)}/articles-{uuid.uuid4().hex}", F.lit(None).cast("string")
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").where(key % 15 == 0).withColumn("day", F.col("o_orderdate").cast("date")).withColumn("ord", -F.unix_date("day") * 10_000_000_000 + key)
    text = key.cast("string")
    paged.store_articles(orders.select(
        F.lit('"Acme"').alias("query"), "ord", F.concat(F.lit("order "), text).alias("title"), F.concat(F.lit("http://articles/"), text).alias("url"), F.concat(F.lit("http://mirrors/"), text).alias("mirror_url"),
        F.col("o_orderstatus").alias("press"), F.lit("an order").alias("snippet"), F.col("day").alias("date"),
    ), path)
    name = F.when(key % 60 == 0, "Acme").otherwise("a company")
    mirrors = orders.select(F.concat(F.lit("http://mirrors/"), text).alias("url"), F.concat(F.lit('<article id="dic_area">Order of '), name, F.lit("</article>")).alias("html"))
    placed = lambda found, size: decisions.batches(found, [], "ord", size).select("batch_id", F.lit(0).alias("pos"), "idx")

    def relevant(items: DataFrame) -> DataFrame:
        good = items.where(F.regexp_extract("title", r"order (\d+)", 1).cast("long") % 45 != 0).select("batch_id", F.col("idx").alias("pos"), "idx")
        return good.unionByName(items.select("batch_id", F.lit(-1).alias("pos"), F.lit(None).cast("int").alias("idx")).distinct())

    p = searches.Providers(
        search=lambda q, a, b: paged.search(spark, "newsloom.sources.paged:stored", q, a, b, AS_OF, path=path, page_size=2), relevant=relevant, mirrors=mirrors, vectors=lambda texts: [[1.0, 0.0] for _ in texts],
        grouping=lambda items: items.select("batch_id", F.floor(F.col("idx") / 2).cast("int").alias("group_no"), "idx"),
        summaries=lambda found: placed(found, decisions.SUMMARY_BATCH).select("*", F.lit("gist").alias("gist"), F.lit("detail").alias("detail_summary"), F.lit("tech_rnd.patent_filing").alias("event_id")),
        importance=lambda found: placed(found, decisions.BATCH).select("*", (F.col("idx") % 10 + 1).alias("company_importance"), F.when(F.col("idx") == 1, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")).alias("supersedes")),
        snapshot=lambda articles, number: None,
    )
    topics, _ = searches.recent_issues(spark, "㈜Acme", None, AS_OF, p)
    flat = topics.select("category_id", F.explode("issues").alias("i"))
    return flat.select("i.issue_title", "i.occurred_month", F.size("i.articles").alias("n"), F.size("i.members").alias("members"), "i.importance", "category_id")


def _posting(prompt: str) -> str:
    """An answer by the order's number: fine, with one track twice, without a name at first, and never without fault."""
    key = int(re.search(r"order (\d+)", prompt)[1])
    track = {"requirements": [f"r{key}"], "preferred": None, "responsibilities": []}
    jobs = [{"job_name": f"job {key}", "locations": ["here", "there"]}, {"job_name": "two", "tracks": {"newcomer": track, "experienced": track if key % 4 == 1 else None}}]
    if key % 4 == 2 and "missing" not in prompt or key % 4 == 3:
        del jobs[0]["job_name"]
    if key % 4 == 3:
        jobs[1]["locations"] = "nowhere"
    said = json.dumps({"common": {}, "jobs": jobs, "work_conditions": {"deadline": "2001-02-03" if key % 8 == 0 else None}, "raw_meta": {"vision_used": True}, "preprocess_log": {}})
    return f"```json\n{said}\n```" if key % 3 == 0 else said


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 >= 2 THEN 2 ELSE 1 END AS tries, CASE WHEN o_orderkey % 4 = 3 THEN '$.jobs[0].job_name: missing; $.jobs[1].locations: not a list' ELSE '' END AS violations,
CASE WHEN o_orderkey % 4 = 3 THEN NULL WHEN o_orderkey % 8 = 0 THEN '2001-02-03' WHEN year(o_orderdate) >= 2000 THEN strftime(o_orderdate, '%Y-%m-%d') END AS deadline, CASE WHEN o_orderkey % 4 = 3 THEN NULL WHEN o_orderkey % 4 = 1 THEN 'two' ELSE '' END AS warned,
CASE WHEN o_orderkey % 4 <> 3 THEN 'job ' || o_orderkey || ',two' END AS jobs, CASE WHEN o_orderkey % 4 <> 3 THEN 'http://orders/' || o_orderkey END AS source_url FROM orders""")
def posting_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as postings whose text a page holds, structured by answers that hold to the schema, do so when asked again, or never do."""
    key = F.col("o_orderkey").cast("string")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("http://orders/"), key).alias("url"), F.date_format("o_orderdate", "yyyy.M.d").alias("day"))
    body = F.concat(F.lit("<p>order "), F.col("o_orderkey").cast("string"), F.lit("</p><p>"), F.repeat(F.lit("text "), F.lit(50)), F.lit("1999-1-1 ~ "), F.col("day"), F.lit("</p>"))
    pages = orders.select("url", F.lit(None).cast("string").alias("final_url"), body.alias("html"))
    found = structured_postings.posting_texts(orders.select("o_orderkey", "url", F.lit(None).cast("string").alias("job_title"), F.lit(None).cast("string").alias("screenshot_text")), pages)
    path = f"{shared_dir(spark)}/raw-{uuid.uuid4().hex}"
    keep = lambda raw: stores.save_raw(raw.select(F.lit("job_posting").alias("kind"), F.col("url").alias("key"), F.lit("site").alias("source"), F.lit("raw_text.txt").alias("filename"), F.col("posting_text").alias("content"), F.lit(0).alias("at")), path, "at")
    made = structured_postings.postings(found, lambda texts: [_posting(t) for t in texts], keep)
    value = F.col("value")
    return made.select(
        "o_orderkey", "tries", F.array_join("violations", "; ").alias("violations"), value["work_conditions"]["deadline"].alias("deadline"), F.array_join("warnings", ",").alias("warned"),
        F.array_join(F.transform(value["jobs"], lambda j: j["job_name"]), ",").alias("jobs"), value["raw_meta"]["source_url"].alias("source_url"),
    )


def _resume(prompt: str) -> str:
    key = int(prompt.split()[1])
    if key % 5 == 1:
        return json.dumps({"response_type": "fail", "reason": f"no resume {key}", "suggestion": "send one"})
    entry = {"name": f"school {key}", "graduate": None} | ({"rank": 1} if key % 5 == 2 else {})
    return json.dumps({"response_type": "success" if key % 5 != 3 else "perhaps", "resume": {"school": [entry], "tools_skills": [{"name": t} for t in ("a", "b", "c")[: key % 3]]}})


@query("""
SELECT c_custkey, ['success', 'fail', 'invalid', 'invalid', 'no_text'][c_custkey % 5 + 1] AS outcome,
CASE c_custkey % 5 WHEN 1 THEN '이력서로 인식할 수 없는 문서입니다: no resume ' || c_custkey WHEN 2 THEN '$.resume.school[0].rank: not known' WHEN 3 THEN '$.response_type: none of success, fail' WHEN 4 THEN '텍스트를 추출하지 못했습니다. 스캔 이미지형 PDF는 지원하지 않습니다.' END AS reason,
CASE WHEN c_custkey % 5 = 0 THEN 'school ' || c_custkey END AS school, CASE WHEN c_custkey % 5 = 0 THEN CAST(c_custkey % 3 AS INT) END AS skills, CASE WHEN c_custkey % 5 = 0 THEN '1998-07-29 00:00:00' END AS created FROM customer""")
def resume_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as resume texts: structured, said to be none, answered wrongly, or without text."""
    key = F.col("c_custkey")
    files = table(spark, sf_dir, "customer").select("c_custkey", F.when(key % 5 == 4, " \n").otherwise(F.concat(F.lit("resume "), key.cast("string"), F.lit(" of "), F.col("c_name"))).alias("text"))
    made = structured_postings.resumes(files, lambda texts: [_resume(t) for t in texts], F.lit(AS_OF).cast("timestamp"))
    resume = F.col("resume")
    return made.select("c_custkey", "outcome", "reason", F.get(resume["school"], F.lit(0))["name"].alias("school"), F.size(resume["tools_skills"]).alias("skills"), resume["created_datetime"].alias("created"))


def _pdf(text: str) -> bytes:
    """A file of two pages, the first packed and shown through a map to Unicode, the second plain."""
    shown = b"".join(b"<%04X> Tj " % (ord(c) + 1) for c in text)
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0001> <FFFF> <0000> endbfrange"
    packed = zlib.compress(b"BT /K 9 Tf 50 700 Td " + shown + b"ET")
    bodies = (
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 /Resources << /Font << /K 7 0 R >> >> >>", b"<< /Type /Page /Contents 5 0 R >>", b"<< /Type /Page /Contents 6 0 R >>",
        b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(packed), packed), b"<< /Length 38 >>\nstream\nBT (page) Tj 0 -9 Td [(t) (wo)] TJ ET   \nendstream",
        b"<< /Subtype /Type0 /ToUnicode 8 0 R >>", b"<< /Length %d >>\nstream\n%s\nendstream" % (len(cmap), cmap),
    )
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, b) for i, b in enumerate(bodies, 1)) + b"trailer << /Root 1 0 R >>"


@query("""
SELECT s_suppkey, CASE WHEN s_suppkey % 7 <> 0 THEN '이력서 ' || s_name || chr(10) || 'page' || chr(10) || 'two' ELSE '' END AS text, CASE WHEN s_suppkey % 7 <> 0 THEN 2 ELSE 0 END AS pages, CASE WHEN s_suppkey % 7 = 0 THEN 'not a PDF file' END AS error FROM supplier""")
def pdf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as resumes in files, some of which are none."""

    @F.pandas_udf("binary")
    def made(names: pd.Series) -> pd.Series:
        return names.map(lambda n: b"nothing" if n is None else _pdf(n))

    name = F.when(F.col("s_suppkey") % 7 != 0, F.concat(F.lit("이력서 "), F.col("s_name")))
    suppliers = table(spark, sf_dir, "supplier")
    dealt = suppliers.repartition(max(1, -(-suppliers.count() // FILES)), "s_suppkey")  # a row is short, its file takes a millisecond
    files = dealt.select("s_suppkey", made(name).alias("content"))
    return pdf.pdf_texts(files, F.col("content"), ("s_suppkey",)).select("s_suppkey", "text", F.size("pages").alias("pages"), "error")


KINDS = tuple(fit.CATEGORIES)


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as analyses and their lines as a model's items: the first four of a job, the others of a company without culture."""
    n = F.col("l_linenumber")
    feature = lambda i: F.struct(F.lit(f"n{i}").alias("name"), F.lit(f"ev{i}").alias("evidence"), F.lit("cv").alias("source"))
    kind = F.get(F.array(*map(F.lit, KINDS)), (F.col("l_partkey") % 7).cast("int") + F.when(n > 4, 2).otherwise(0))
    own = [(F.col("l_quantity") > 25).alias("matched"), F.concat(F.lit("skills["), (n % 3).cast("string"), F.lit("]")).alias("candidate_feature_path"), F.lit("model").alias("candidate_evidence_excerpt"), F.lit("").alias("reasoning")]
    text, proof = F.col("l_partkey").cast("string"), F.lit("p")
    job = F.struct(n.alias("n"), kind.alias("match_target_type"), text.alias("match_target_text"), proof.alias("match_target_evidence"), *own)
    firm = F.struct(n.alias("n"), kind.alias("dimension"), text.alias("criterion_text"), proof.alias("criterion_evidence"), *own)
    lists = lambda item, cond: F.array_sort(F.collect_list(F.when(cond, item)))
    grouped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(lists(job, n <= 4).alias("job_items"), lists(firm, n > 4).alias("company_items"))
    some, nothing = F.array(F.lit("x")), F.array().cast("array<string>")
    return matching.analyse(grouped.select(
        "*", F.struct(*(F.array(feature(0), feature(1)).alias(s) for s in fit.SECTIONS)).alias("candidate_profile"), F.lit("Dev").alias("job_title"), F.lit("").alias("company_name"),
        F.struct(F.lit("Acme").alias("company_name"), some.alias("industry_domain"), nothing.alias("culture"), some.alias("talent_values")).alias("company_profile"),
    ), "l_orderkey")


ITEMS_SQL = f"""items AS (SELECT *, (l_partkey % 7 + CASE WHEN l_linenumber > 4 THEN 2 ELSE 0 END) AS k, [{", ".join(f"'{k}'" for k in KINDS)}][k + 1] AS kind, l_quantity > 25 AS matched FROM lineitem),
kept AS (SELECT *, [{", ".join(f"'{c}'" for c in fit.CATEGORIES.values())}][k + 1] AS category FROM items WHERE NOT (l_linenumber > 4 AND kind = 'culture'))"""


@query(f"WITH {ITEMS_SQL} SELECT l_orderkey, category, count(*) AS total, count(*) FILTER (matched) AS matched FROM kept GROUP BY ALL")
def fit_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analyses(spark, sf_dir).select("l_orderkey", F.explode("category_summary").alias("c"))
    return found.select("l_orderkey", "c.category", F.col("c.total").cast("long").alias("total"), F.col("c.matched").cast("long").alias("matched"))


@query(f"""
WITH {ITEMS_SQL}, lines AS (SELECT *, '[' || category || '] ' || CASE WHEN matched THEN '✓' ELSE '✗' END || ' ' || l_partkey || CASE WHEN matched THEN chr(10) || '  근거: ' || CASE WHEN l_linenumber % 3 < 2 THEN 'ev' || l_linenumber % 3 ELSE 'model' END ELSE '' END AS line FROM kept)
SELECT l_orderkey, 'Acme' AS company_name, coalesce(string_agg(line, chr(10) ORDER BY l_linenumber, kind, CAST(l_partkey AS VARCHAR), matched) FILTER (l_linenumber <= 4), '') AS job_text, coalesce(string_agg(line, chr(10) ORDER BY l_linenumber, kind, CAST(l_partkey AS VARCHAR), matched) FILTER (l_linenumber > 4), '') AS company_text
FROM (SELECT DISTINCT l_orderkey FROM lineitem) LEFT JOIN lines USING (l_orderkey) GROUP BY l_orderkey""")
def fit_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses(spark, sf_dir).select("l_orderkey", "company_name", "job_text", "company_text")


@query("""
SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 ELSE 0 END AS step,
CASE c_custkey % 6 WHEN 0 THEN c_name WHEN 1 THEN 'said ' || c_name WHEN 2 THEN c_name WHEN 3 THEN 'said post ' || c_name WHEN 4 THEN 'shot' END AS name FROM customer""")
def site_profile_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as postings whose profile is found by the named page (of a known layout or not), a linked page, the posting, screenshots, or not at all."""
    key, text = F.col("c_custkey") % 6, F.col("c_custkey").cast("string")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", key.alias("k"), text.alias("t"))
    post, info = F.concat(F.lit("http://post/"), F.col("t")), F.concat(F.when(F.col("k") == 1, "http://other/").otherwise("http://gamejob/"), F.col("t"))
    card = F.concat(F.lit('<h1 class="corpName">'), F.col("c_name"), F.lit("</h1>"))
    link = F.when(F.col("k") == 2, F.concat(F.lit('<a href="http://gamejob/'), F.col("t"), F.lit('">기업정보</a>')))
    note = F.when(F.col("k") == 3, F.concat(F.lit("<p>post "), F.col("c_name"), F.lit("</p>")))
    pages = customers.where("k <= 2").select(info.alias("url"), F.when(F.col("k") == 1, F.concat(F.lit("<p>"), F.col("c_name"), F.lit("</p>"))).otherwise(card).alias("html"))
    pages = pages.unionByName(customers.select(post.alias("url"), F.coalesce(link, note, F.lit("<p>empty</p>")).alias("html")))
    postings = customers.select("c_custkey", post.alias("posting_url"), F.when(F.col("k") <= 1, info).alias("info_url"), F.when(F.col("k") == 4, '```json\n{"name": "shot", "benefits": []}\n```').when(F.col("k") == 5, '{"name": null}').alias("screenshot_answer"))
    told = lambda texts: ["{" if t == "empty" else f'{{"name": "said {t}"}}' for t in texts]
    found = company.site_profiles(postings, pages, told)
    return found.select("c_custkey", F.coalesce("step", F.lit(0)).alias("step"), F.coalesce(F.get_json_object("profile", "$.기업정보.회사명"), F.get_json_object("profile", "$.name")).alias("name"))
