"""Profiles, filings, assembly and the shells around searches and models."""

from pyspark.sql import functions as F

from newsloom.plans import company


def test_profiles_fail_by_the_first_reason(spark):
    good = '```json\n{"business_description": "makes x", "main_products_services": ["a", "null"], "ceo_name": "none", "is_company_match": true}\n```'
    rows = [
        ("윕스", "http://w", "윕스 소개", good), ("윕스", None, "윕스", good), ("윕스", "http://w", "", good), ("윕스", "http://w", "윕스", "{bad"),
        ("윕스", "http://w", "윕스", '{"is_company_match": false, "business_description": "x"}'), ("윕스", "http://w", "other", good), ("윕스", "http://w", "윕스", '{"business_description": "null"}'),
    ]
    df = spark.createDataFrame([(*r, "1234567890") for r in rows], "company_name string, url string, text string, answer string, biz_reg_no string")
    got = company.profiles(df).collect()
    assert [r.error for r in got] == [None, company.NO_URL, company.EMPTY_PAGE, company.NO_JSON, company.WRONG_COMPANY, company.NO_NAME, company.NO_CONTENT]
    assert tuple(got[0]) == ("윕스", "http://w", "makes x", ["a"], None, None, None, "1234567890", True, None)
    assert all(r.biz_reg_no is None and r.main_products_services == [] and not r.crawl_success for r in got[1:])


def test_filings_branch(spark):
    companies = spark.createDataFrame([("1",), ("2",), ("3",)], "corp_code string")
    report = "corp_code string, label string, report struct<name:string>"
    got = {r.corp_code: r for r in company.filings(
        companies, spark.createDataFrame([("1", "감사보고서", ("x",))], report), spark.createDataFrame([("1", "사업보고서", ("y",)), ("2", "사업보고서", ("y",)), ("2", "분기보고서", ("z",))], report),
        spark.createDataFrame([("1", "e"), ("2", "e")], "corp_code string, divisions string"), spark.createDataFrame([("2", "i")], "corp_code string, indicators string"),
    ).collect()}
    assert list(got["1"].audit_statements) == ["감사보고서"] and got["1"].periodic_statements is None and got["1"].employees is None
    assert set(got["2"].periodic_statements) == {"사업보고서", "분기보고서"} and (got["2"].employees, got["2"].indicators) == ("e", "i")
    assert got["3"].audit_statements is None and got["3"].periodic_statements is None


def test_assembly(spark):
    base = spark.createDataFrame([("a",), ("b",)], "k string")
    got = {r.k: r for r in company.assemble(base, "k", profile=spark.createDataFrame([("a", 1)], "k string, v int"), site=spark.createDataFrame([("b", 2)], "k string, w int")).collect()}
    assert (got["a"].profile.v, got["a"].has_profile, got["a"].site, got["a"].has_site) == (1, True, None, False) and got["b"].site.w == 2


def test_searches(spark):
    names = spark.createDataFrame([("㈜윕스",)], "name string")
    assert [r.query for r in company.litigation_queries(names, "name").orderBy("pos").collect()] == ["윕스 소송", "윕스 판결", '기업 "윕스" 소송', '기업 "윕스" 판결']
    assert company.trend_queries(names, "name").where("pos = 0").first().query == "한국 ㈜윕스 최신 트렌드"
    found = spark.createDataFrame([("u", 1), ("u", 0), ("v", 2), ("s", 3)], "url string, ord long")
    assert sorted(map(tuple, company.new_articles(found, found.where("url = 's'")).collect())) == [("u", 0), ("v", 2)]
    rivals = spark.createDataFrame([("A사", 1), ("㈜A사", 0), ("윕스", 2), ("B", 3)], "name string, ord long")
    assert [r.name for r in company.candidates(rivals, names).collect()] == ["㈜A사", "B"]


def test_models(spark):
    df = spark.createDataFrame([("a", True), ("b", False), (None, True)], "p string, ok boolean")
    got = company.ask(df, F.col("p"), "x", lambda prompts: [p * 2 for p in prompts], F.col("ok"))
    assert [r.x for r in got.collect()] == ["aa", None, None]
    said = spark.createDataFrame([('{"keywords":["a","b","null","c","d","e","f"]}',), ("no",), (None,)], "x string")
    assert [r.k for r in said.select(company.keywords(F.col("x")).alias("k")).collect()] == [["a", "b", "c", "d", "e"], [], []]
