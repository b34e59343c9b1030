"""Company profiles, filings and reports put together, and the shells around searches and models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import clean_null, clean_nulls, name_appears, registry_key, strip_entity, unfence
from newsloom.operators import registry
from newsloom.operators.groups import ordered_distinct, unseen, without
from newsloom.sources import html

# Reasons of failure, query templates and discovery phrases.
NO_URL = "URL 탐색 실패: 검색 결과에서 공식 사이트를 찾지 못함"
EMPTY_PAGE = "빈 페이지(본문 텍스트 없음, JS 렌더링 가능성)"
NO_JSON = "JSON 파싱 실패"
WRONG_COMPANY = "이름 매칭 실패: 페이지가 요청 회사가 아닌 포털/타사 내용"
NO_NAME = "이름 미확인: 본문에 회사명이 없어 동일 회사인지 확인 불가"
NO_CONTENT = "내용 없음: 사이트는 맞으나 사업 정보를 추출하지 못함(빈/JS 페이지 가능성)"
LITIGATION = ('{name} 소송', '{name} 판결', '기업 "{name}" 소송', '기업 "{name}" 판결')
TREND_PHRASES = ("최신 트렌드", "최신 이슈", "트렌드 모음", "이슈 모음")
PROFILE = "website_url string, business_description string, main_products_services array<string>, talent_values string, ceo_message string, ceo_name string, is_company_match boolean"


def profiles(pages: DataFrame) -> DataFrame:
    """One profile row a company. pages: company_name, url, text, answer (a model's JSON, fenced or not), biz_reg_no.

    The first reason that holds fails the company: no URL, no text, no JSON, another company's page, a text without the
    name, neither description nor products. A failed company keeps its name, URL and error; all else is null or empty.
    """
    told = pages.withColumn("__json", unfence(F.col("answer"))).withColumn("__a", F.from_json("__json", PROFILE))
    description, products = clean_null(F.col("__a.business_description")), F.coalesce(clean_nulls(F.col("__a.main_products_services")), F.array().cast("array<string>"))
    text = F.coalesce("text", F.lit(""))
    error = (
        F.when(F.coalesce("url", F.lit("")) == "", NO_URL).when(text == "", EMPTY_PAGE).when(F.try_parse_json("__json").isNull(), NO_JSON)
        .when(F.coalesce(F.col("__a.is_company_match"), F.lit(True)) == F.lit(False), WRONG_COMPANY).when(~name_appears(F.col("company_name"), text), NO_NAME)
        .when((F.coalesce(F.trim(description), F.lit("")) == "") & (F.size(products) == 0), NO_CONTENT)
    )
    judged = told.withColumn("error", error)
    good = F.col("error").isNull()
    keep = lambda c: F.when(good, c)
    return judged.select(
        "company_name", F.when(good, F.coalesce(clean_null(F.col("__a.website_url")), F.col("url"))).otherwise(F.col("url")).alias("website_url"), keep(description).alias("business_description"),
        F.when(good, products).otherwise(F.array().cast("array<string>")).alias("main_products_services"), *(keep(clean_null(F.col(f"__a.{c}"))).alias(c) for c in ("talent_values", "ceo_message", "ceo_name")),
        keep(F.col("biz_reg_no")).alias("biz_reg_no"), good.alias("crawl_success"), "error",
    )


def registry_of_profiles(found: DataFrame, names: DataFrame, registry_rows: DataFrame, overview: DataFrame, name: str = "company_name") -> DataFrame:
    """(name, corp_code) of the companies that the registry has, told apart by what their profiles say.

    found: profiles()' rows; names: company_name, pos and name, as registry.candidates() tries them. The business number and the head's name count
    only where the profile was read; a company without a profile is looked up by its name alone.
    """
    good = F.col("crawl_success")
    known = found.select(name, F.when(good, F.col("biz_reg_no")).alias("biz_no"), F.when(good, F.col("ceo_name")).alias("ceo_name"))
    return registry.resolve(names, registry_rows, known, overview, name).withColumnRenamed("subject", name)


def filings(companies: DataFrame, audits: DataFrame, periodic: DataFrame, employees: DataFrame, indicators: DataFrame) -> DataFrame:
    """One row a company (corp_code): its audit reports where there are any, else its periodic statements, employees and indicators.

    audits: corp_code, label, report (a struct); periodic: corp_code, label, report; employees: corp_code, divisions; indicators:
    corp_code, indicators. The two branches do not mix: a company with an audit report has no employees or indicators.
    """
    entry = lambda df: df.groupBy("corp_code").agg(F.map_from_entries(F.collect_list(F.struct("label", "report"))).alias("m"))
    a, p = entry(audits).withColumnRenamed("m", "__a"), entry(periodic).withColumnRenamed("m", "__p")
    out = companies.join(a, "corp_code", "left").join(p, "corp_code", "left").join(employees, "corp_code", "left").join(indicators, "corp_code", "left")
    audited = F.col("__a").isNotNull()
    return out.select(*companies.columns, F.col("__a").alias("audit_statements"), *(F.when(~audited, F.col(c)).alias(n) for c, n in (("__p", "periodic_statements"), ("divisions", "employees"), ("indicators", "indicators"))))


def assemble(companies: DataFrame, key: str, **sections: DataFrame) -> DataFrame:
    """companies with each section's rows as a struct named like it (null where there is none), and flags has_<section>.

    A section has one row a key; its key column is key.
    """
    out = companies
    for name, rows in sections.items():
        own = rows.select(F.col(key).alias("__k"), F.struct(*(c for c in rows.columns if c != key)).alias(name))
        out = out.join(own, out[key].eqNullSafe(F.col("__k")), "left").drop("__k").withColumn(f"has_{name}", F.col(name).isNotNull())
    return out


def litigation_queries(names: DataFrame, name: str) -> DataFrame:
    """names with pos and query, a row for each template."""
    made = F.array(*(F.replace(F.lit(t), F.lit("{name}"), strip_entity(F.col(name))) for t in LITIGATION))
    return names.select("*", F.posexplode(made).alias("pos", "query"))


def new_articles(found: DataFrame, seen: DataFrame, url: str = "url", order: str = "ord") -> DataFrame:
    """Articles of URLs not seen before, the first of each URL in order."""
    rest = [c for c in found.columns if c != url]
    first = unseen(found, seen, url).groupBy(url).agg(F.min_by(F.struct(*rest), order).alias("__r"))
    return first.select(url, "__r.*").select(*found.columns)


def candidates(found: DataFrame, own: DataFrame, name: str = "name", order: str = "ord") -> DataFrame:
    """(key, name, ord): distinct names found, in their first spelling, without the company's own."""
    key = registry_key(F.col(name))
    return ordered_distinct(without(found, key, own, registry_key(F.col(name))), key, name, order)


def trend_queries(titles: DataFrame, title: str) -> DataFrame:
    made = F.array(*(F.concat(F.lit("한국 "), F.col(title), F.lit(f" {p}")) for p in TREND_PHRASES))
    return titles.select("*", F.posexplode(made).alias("pos", "query"))


def ask(df: DataFrame, prompt: Column, out: str, provider: Callable[[list[str]], list[str]], when: Column | None = None) -> DataFrame:
    """df with the provider's answer to each prompt in out, asked in Arrow batches on the executors.

    Rows for which when is not true, and null prompts, are not asked and have null: where there is no evidence no call is made.
    """

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            answers = pd.Series([None] * len(s), dtype=object)
            rows = s.notna().to_numpy().nonzero()[0]
            if len(rows):
                answers.iloc[rows] = provider(s.iloc[rows].tolist())
            yield answers

    return df.withColumn(out, run(prompt if when is None else F.when(when, prompt)))


def keywords(answers: Column, most: int = 5) -> Column:
    """At most five keywords of an answer in JSON ({"keywords": [...]}); what is no JSON has none."""
    found = F.from_json(unfence(answers), "keywords array<string>")["keywords"]
    return F.slice(F.coalesce(clean_nulls(found), F.array().cast("array<string>")), 1, most)


def any_value(answer: Column) -> Column:
    """Whether an answer, fence or not, is a JSON object with a value that is neither null, empty, false nor zero."""
    values = F.map_values(F.from_json(unfence(answer), "map<string,string>"))
    return F.coalesce(F.exists(values, lambda v: v.isNotNull() & ~v.isin("", "[]", "{}", "false", "0")), F.lit(False))


def site_profiles(postings: DataFrame, pages: DataFrame, provider: Callable[[list[str]], list[str]], prompt: Callable[[Column], Column] = lambda text: text) -> DataFrame:
    """postings with profile (JSON) and step (1 to 4, null: none): the first that gives one of the company page named, the company page that
    the posting links to, the posting's own text, and the answer to its screenshots.

    postings: posting_url, info_url, screenshot_answer and others; pages: url, html, a row a URL. Pages of a known layout are
    read; the text of others is asked about, as is a posting's own, only where the steps before gave nothing.
    """
    read = html.profiles(pages, keep=("url",)).select(F.col("url").alias("__url"), F.struct("profile", "fallback_text").alias("__read"))
    raw = pages.select(F.col("url").alias("__url"), F.col("html").alias("__html"))

    def step(df: DataFrame, told: Column, text: Column, out: str) -> DataFrame:
        asked = ask(df, prompt(text), "__said", provider, F.col("profile").isNull() & told.isNull() & (F.coalesce(text, F.lit("")) != ""))
        found = F.coalesce(told, F.when(any_value(F.col("__said")), unfence(F.col("__said"))))
        return asked.withColumn("__found", found).withColumns({"step": F.coalesce("step", F.when(F.col("__found").isNotNull(), int(out))), "profile": F.coalesce("profile", "__found")}).drop("__said", "__found")

    none = F.lit(None).cast("string")
    out = postings.withColumns({"profile": none, "step": F.lit(None).cast("int")})
    out = out.join(read, out.info_url == read["__url"], "left")
    out = step(out, F.col("__read.profile"), F.col("__read.fallback_text"), "1").drop("__url", "__read")
    out = out.join(raw, out.posting_url == raw["__url"], "left").drop("__url")
    out = out.withColumn("__link", html.company_link(F.col("__html"), F.col("posting_url"))).withColumn("__own", html.html_lines(F.col("__html"))).drop("__html")
    out = out.join(read, out["__link"] == read["__url"], "left")
    out = step(out, F.when(F.col("profile").isNull(), F.col("__read.profile")), F.col("__read.fallback_text"), "2").drop("__url", "__read", "__link")
    out = step(out, none, F.col("__own"), "3").drop("__own")
    shot = F.when(F.col("profile").isNull() & any_value(F.col("screenshot_answer")), unfence(F.col("screenshot_answer")))
    return out.withColumn("__shot", shot).withColumns({"step": F.coalesce("step", F.when(F.col("__shot").isNotNull(), 4)), "profile": F.coalesce("profile", "__shot")}).drop("__shot")
