"""Scalar functions on small rows."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from newsloom.functions import taxonomy, text


def apply(spark, function, *rows, schema="a string, b string, c string, d string"):
    n = len(schema.split(","))
    df = spark.createDataFrame([(*(r if isinstance(r, tuple) else (r,)), *[None] * n)[:n] for r in rows], schema)
    return [r.x for r in df.select(function.alias("x")).collect()]


def test_dates(spark):
    got = apply(spark, text.article_date(F.col("a"), date(2026, 7, 29)), "2026.7.3.", "3시간 전", "2일 전", "1주 전", "1개월 전", "2024.02.30", "", None, "입력 2025.12.31 · 5분 전", "10분전")
    assert got == [date(2026, 7, 3), date(2026, 7, 29), date(2026, 7, 27), date(2026, 7, 22), None, None, None, None, date(2025, 12, 31), date(2026, 7, 29)]


def test_names(spark):
    names = ["㈜ 윕스", "주식회사 Wips (주)", "(유)A.B & C, D", None]
    assert apply(spark, text.strip_entity(F.col("a")), *names) == ["윕스", "Wips", "A.B & C, D", ""]
    assert apply(spark, text.name_key(F.col("a")), *names) == ["윕스", "wips", "a.b&c,d", ""]
    assert apply(spark, text.registry_key(F.col("a")), *names, "(사)모임") == ["윕스", "Wips", "ABCD", "", "사모임"]
    assert apply(spark, text.name_appears(F.col("a"), F.col("b")), ("㈜윕스", "about 윕스"), ("삼성전자", "삼성물산 소식"), ("Acme", "none"), (None, "x")) == [True, True, False, False]


def test_identities(spark):
    assert apply(spark, text.business_number(F.col("a")), "사업자등록번호: 123-45-67890", "사업자 등록 번호 1234567890", "none", None) == ["1234567890", "1234567890", None, None]
    assert apply(spark, text.same_number(F.col("a"), F.col("b")), ("123-45", "12345"), ("", ""), (None, "1")) == [True, False, False]
    assert apply(spark, text.same_person(F.col("a"), F.col("b")), ("김 철수 대표이사", "ceo 김철수"), ("회장", "대표")) == [True, False]
    v = text.verified(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    assert apply(spark, v, ("1-2", "x", "12", "y"), ("1", "x", "2", "x"), ("1", "김", None, "김 대표"), ("1", "x", None, None)) == [True, False, True, False]


def test_reports_and_numbers(spark):
    names = ["사업보고서 (2024.12)", "반기보고서 (2025.06)", "분기보고서 (2025.03)", "분기보고서 (2025.09)", "분기보고서 (2025.06)", "감사보고서", "분기보고서"]
    assert apply(spark, text.report_code(F.col("a")), *names) == ["11011", "11012", "11013", "11014", None, None, None]
    assert apply(spark, text.fiscal_year(F.col("a")), *names)[:6] == ["2024", "2025", "2025", "2025", "2025", None]
    said = ["1,234", " 7 ", "-", "", "12.5", "x", None]
    assert apply(spark, text.to_int(F.col("a")), *said) == [1234, 7, None, None, None, None, None]
    assert apply(spark, text.to_float(F.col("a")), *said) == [1234.0, 7.0, None, None, 12.5, None, None]
    assert apply(spark, text.division(F.col("a")), "전사", " 합계 ", "-", None, "반도체") == ["total", "total", "total", "total", "반도체"]
    assert apply(spark, text.sex(F.col("a")), "남", " 여", None, "기타") == ["male", "female", "전체", "기타"]


def test_nulls_and_fences(spark):
    assert apply(spark, text.clean_null(F.col("a")), "Null", " none ", "", "x", None) == [None, None, None, "x", None]
    assert apply(spark, text.clean_nulls(F.array("a", "b", "c")), ("x", "NULL", None)) == [["x"]]
    assert apply(spark, text.has_value(F.col("a"), F.col("b")), ("", None), ("", "x")) == [False, True]
    assert apply(spark, text.unfence(F.col("a")), '```json\n{"a":1}\n```', '```{"a":1}```', "{}") == ['{"a":1}', '{"a":1}', "{}"]
    assert apply(spark, text.or_placeholder(F.when(F.col("a") == "x", F.struct("a"))), "x", "y") == ['{"a":"x"}', text.PLACEHOLDER]


def test_postings(spark):
    deadline = text.deadline(F.col("a"), F.col("b"))
    assert apply(spark, deadline, (None, "2024-01-02 ~ 2024.3.4"), ("2020-01-01", "2024-01-02"), (None, "2025년 7월 1일"), (None, "none"), ("", None)) == ["2024-03-04", "2020-01-01", "2025-07-01", None, None]
    urls = ["https://www.jobkorea.co.kr/Recruit/GI_Read/12?Oem=1", "https://evil-jobkorea.co.kr.a.com/Recruit/GI_Read/12", "https://m.jobkorea.co.kr/Recruit/GI_Read/12/x", "not a url", None]
    assert apply(spark, text.detail_url(F.col("a")), *urls) == ["https://www.jobkorea.co.kr/Recruit/GI_Read_Comt_Ifrm?Gno=12", None, None, None, None]
    assert apply(spark, text.blocked(F.col("a")), "https://blog.naver.com/x", "https://a.namu.wiki", "https://example.org/x.com", None) == [True, True, False, False]
    track = "a struct<requirements:array<string>,preferred:array<string>,responsibilities:array<string>>"
    rows = [((["x"], None, []), (["x"], None, [])), ((["x"], None, []), (["x"], [], [])), (([], [], []), ([], [], [])), ((["x"], None, None), None)]
    df = spark.createDataFrame(rows, f"{track}, {track.replace('a ', 'b ', 1)}")
    assert [r.x for r in df.select(text.identical_tracks(F.col("a"), F.col("b")).alias("x")).collect()] == [True, False, False, False]


def test_cosine_and_images(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [r.x for r in df.select(text.cosine(F.col("a"), F.col("b")).alias("x")).collect()] == pytest.approx([0.0, 1.0, 0.0])
    heads = ["89504E470D0A1A0A", "FFD8FF", "524946460000000057454250", "474946383961", "", "52494646"]
    assert apply(spark, text.mime(F.unhex("a")), *heads) == ["image/png", "image/jpeg", "image/webp", "image/gif", "image/png", "image/png"]
    assert apply(spark, text.query_variants(F.col("a"), F.col("b")), ("㈜윕스", None), ("윕스", "김")) == [['"윕스"', '기업 "윕스"'], ['"윕스"', '기업 "윕스"', '"윕스" "김"', '기업 "윕스" "김"']]


def test_taxonomy(spark):
    rows = taxonomy.rows()
    assert len(rows) == 61 and len({r[2] for r in rows}) == 12 and min(r[5] for r in rows) == 2 and max(r[5] for r in rows) == 10
    got = taxonomy.with_event(spark.createDataFrame([(1, "x.y"), (2, None), (3, rows[0][1])], "n int, event_id string")).collect()
    assert {r.n: r.event_id for r in got} == {1: taxonomy.FALLBACK, 2: taxonomy.FALLBACK, 3: rows[0][1]}
    lines = taxonomy.prompt_text(spark).first().prompt_text.split("\n")
    assert len(lines) == 73 and lines[0].startswith("[hiring_workforce]") and lines[1].startswith("  hiring_workforce.mass_hiring: ")
