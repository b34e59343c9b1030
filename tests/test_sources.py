"""Pages, stores, streams and the news pipeline."""

import io
import json
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from newsloom.plans import news
from newsloom.sources import dom, html, stores
from newsloom.streaming import collect

SEARCH = """<div class="fds-news-item-list-tab">
<div><a data-heatmap-target=".tit" href="http://n/1"><span class="x sds-comps-text-type-headline1">First</span><span>hidden</span></a>
<span class="sds-comps-profile-info-title-text"><span class="sds-comps-text-type-body2">Press A</span></span>
<span class="sds-comps-profile-info-subtext">2면 TOP</span><span class="sds-comps-profile-info-subtext">2일 전</span>
<a href="https://n.news.naver.com/m/1">mirror</a><p class="sds-comps-text-type-body1">Snippet one</p></div>
<div><a data-heatmap-target=".tit">no address</a></div>
<div><a data-heatmap-target=".tit" href="http://n/2">Second</a></div></div>"""
B = """<div class="company-body-infomation"><table class="table-basic-infomation-primary"><tr class="field"><th>업종</th><td><div class="value">게임</div><div class="value">SW</div></td><th>설립</th><td>2001</td></tr></table>
<div class="financial-analysis-card"><div class="headers"><b class="header">매출</b></div><div class="revenue"><i class="value">10억</i></div><div class="chart"><div class="bar"><i class="label">2023</i><i class="value">9억</i></div></div></div>
<div class="corporate-history-list-item"><i class="year">2022</i><i class="month">01</i><p class="month-description">a</p></div><div class="corporate-history-list-item"><i class="month">05</i><p class="month-description">b</p></div>
<div id="devJKhistory">before<br>2021년<br>- one<br>- two<br><br>2020년<br>2019년<br>three</div>
<table class="table-in-progress-announcement"><tbody><tr><td>now</td><td><b class="title">Dev</b></td><td><i>x</i><i>y</i></td></tr></tbody></table>
<div class="benefit-item-group"><div class="item"><b class="benefit-header">식대</b><div class="benefit-body"><p>p1</p><p>p2</p></div></div></div></div>"""
C = """jobkorea.co.kr/super/ <div id="wrap"><h2 class="giHd">Acme</h2><div class="corpInfo"><dl><strong>2001</strong></dl><dl><strong>10</strong></dl><dl><strong>중견</strong></dl><dl><dd>none</dd></dl></div>
<div class="history_cont"><p>x</p></div><ul class="history_cont"><li><p>2020</p><ul><li>e1</li><li>e2</li></ul></li></ul><div class="talent"><ul><li><strong>t</strong><p>d <b>e</b></p></li></ul></div></div>"""


def test_selectors():
    page = dom.parse('<div id="a" class="x y"><p>one<br>two<p class="y">three</p></div><a href="http://q/z.html">l</a>')
    assert [n.tag for n in page.select("div.x.y, a[href$='html']")] == ["div", "a"] and len(page.select("div p")) == 2
    assert page.first("#a > p").text(" ", strip=True).startswith("one two") and page.first("p.z") is None
    assert page.first('[class*="x"]').attrs["id"] == "a" and page.select("> div")[0].attrs["id"] == "a"


def test_page_texts():
    page = "<head><style>s</style></head><nav>n</nav><p> a <b>b</b></p><noscript>no</noscript>\n<script>x</script><footer>f</footer><p>c&amp;d</p>"
    assert html.lines_text(page) == "a\nb\nno\nc&d" and html.flat_text(page) == "a b c&d" and html.lines_text(None) == ""


def test_articles(spark):
    pages = spark.createDataFrame([(1, SEARCH), (2, '<p id="notfound" class="api_noresult_wrap">'), (3, None), (4, "")], "n int, html string")
    got = html.articles(pages, ("n",), "html", date(2026, 7, 29)).collect()
    assert [tuple(r) for r in got] == [(1, 0, "First", "http://n/1", "https://n.news.naver.com/m/1", "Press A", date(2026, 7, 27), "Snippet one"), (1, 1, "Second", "http://n/2", None, "", None, "")]
    assert [r.x for r in pages.select(html.no_results(F.col("html")).alias("x")).collect()] == [False, True, None, False]
    mirrors = spark.createDataFrame([("https://n.news.naver.com/m/1", '<div id="articleBodyContents">Body <b>text</b></div>')], "url string, html string")
    bodies = html.with_body(html.articles(pages, ("n",), "html", date(2026, 7, 29)), mirrors)
    assert {r.title: r.body for r in bodies.collect()} == {"First": "Body text", "Second": ""}


def test_links(spark):
    page = '<a href="mailto:x">회사소개</a><a href="/About">us</a><a href="https://blog.naver.com/a">b</a><a href="http://ok.kr/ceo">c</a><div class="view__header-title"><div class="corp-name"><a href="../co?1">n</a></div></div>'
    df = spark.createDataFrame([(page, "http://h.kr/d/e")], "html string, url string").withColumn("links", html.links(F.col("html")))
    got = df.select(
        html.link_by_words(F.col("links"), F.col("url"), html.ABOUT_WORDS).alias("about"), html.link_by_words(F.col("links"), F.col("url"), html.CEO_WORDS).alias("ceo"),
        html.official_url(F.col("links")).alias("site"), html.company_link(F.col("html"), F.col("url")).alias("co"), html.crawl_text(F.col("html"), F.lit(None).cast("string")).alias("t"),
    ).first()
    assert tuple(got) == ("http://h.kr/About", "http://ok.kr/ceo", "http://ok.kr/ceo", "http://h.kr/co?1", "회사소개 us b c n")


def test_one_parse_gives_all_parts(spark):
    page = '<p> a <b>b</b></p><a href="/About">company</a><article id="dic_area">body</article><p id="notfound" class="api_noresult_wrap">'
    df = spark.createDataFrame([(1, page, "http://h.kr/d"), (2, None, None), (3, SEARCH, None), (4, "", "u")], "n int, html string, url string")
    got = {r.n: r.p for r in df.select("n", html.parts(F.col("html"), F.col("url"), *html.PARTS).alias("p")).collect()}
    assert tuple(got[1]) == ("a\nb\ncompany\nbody", "a b company body", [("/About", "company")], "http://h.kr/About", "body", [], True)
    assert set(got[2]) == {None} and [a.title for a in got[3].articles] == ["First", "Second"] and got[3].no_results is False
    assert tuple(got[4]) == ("", "", [], None, "", [], False)
    spark.udtf.register("page_links", html.PageLinks)
    df.createOrReplaceTempView("some_pages")
    rows = spark.sql("select n, l.pos, l.href, l.text from some_pages, lateral page_links(html) l order by n, l.pos").collect()
    assert [tuple(r) for r in rows] == [(1, 0, "/About", "company"), (3, 0, "http://n/1", "Firsthidden"), (3, 1, "https://n.news.naver.com/m/1", "mirror"), (3, 2, "http://n/2", "Second")]


def test_profiles(spark):
    a = '<h1 class="corpName"> Acme  Inc </h1><div class="corpInfo"><dl><dt>대표</dt><dd>Kim</dd><dt>빈</dt></dl></div><div id="infoTab"><article class="corpDesc"><h4 class="corpTit">•소개</h4><div class="contArea">x<br>y</div></article></div><div id="newsTab"><ul class="newslist"><li><b class="tit">t</b></li></ul></div>'
    rows = [("http://gamejob.co.kr/1", a), ("http://www.jobkorea.co.kr/2", B), ("http://www.jobkorea.co.kr/3", C), ("http://www.jobkorea.co.kr/4", "<p>no container</p>"), ("http://other", "<p>x</p>"), ("http://gamejob", None)]
    got = html.profiles(spark.createDataFrame(rows, "url string, html string"), keep=("url",)).collect()
    assert [r.site for r in got] == ["a", "b", "c", "b", None, "a"]
    pa, pb, pc = (json.loads(r.profile) for r in got[:3])
    assert pa == {"기업정보": {"회사명": "Acme Inc"}, "기업상세정보": {"대표": "Kim"}, "소개": {"소개": "x y"}, "기업뉴스": [{"제목": "t", "내용": None, "날짜": None}]}
    assert pb["basic_info"] == {"업종": "게임 | SW", "설립": "2001"} and pb["financial"] == {"매출": {"current_value": "10억", "history": {"2023": "9억"}}}
    assert pb["history"] == [{"year": "2022", "month": "01", "events": ["a"]}, {"year": "2022", "month": "05", "events": ["b"]}, {"year": "2021", "events": ["one", "two"]}, {"year": "2019", "events": ["three"]}]
    assert pb["employment"]["recruitments"] == [{"period": "now", "title": "Dev", "details": "x | y"}] and pb["benefits"] == {"식대": ["p1", "p2"]}
    assert pc["company_name"] == "Acme" and (pc["founded"], "revenue" in pc) == ("2001", False) and pc["history"] == [{"year": "2020", "events": ["e1", "e2"]}] and pc["talents"] == [{"type": "t", "description": "d e"}]
    assert [(r.profile, r.fallback_text) for r in got[3:]] == [(None, "no container"), (None, "x"), (None, None)]


def test_reports(spark, tmp_path):
    rows = [("r", "A", "2024-01-01 00:00:00", '{"v":1}'), ("r", "A", "2024-01-02 00:00:00", '{"v":2}'), ("r", "A", "2024-01-03 00:00:00", "{bad"), ("r", "A_B", "2024-02-01 00:00:00", '{"v":9}'), ("s", "A", "2024-03-01 00:00:00", "{}")]
    df = spark.createDataFrame(rows, "kind string, key string, saved_at string, payload string").withColumn("saved_at", F.col("saved_at").cast("timestamp_ntz"))
    stores.save_reports(df.limit(3), f"{tmp_path}/r")
    stores.save_reports(df.offset(3), f"{tmp_path}/r")
    assert [r.payload for r in stores.list_reports(spark, f"{tmp_path}/r", "r", "A").collect()] == ['{"v":2}', '{"v":1}']
    assert {(r.kind, r.key): r.payload for r in stores.latest_reports(stores.list_reports(spark, f"{tmp_path}/r")).collect()} == {("r", "A"): '{"v":2}', ("r", "A_B"): '{"v":9}', ("s", "A"): "{}"}
    raw = lambda *rows: spark.createDataFrame([("k", "007", *r) for r in rows], "kind string, key string, source string, filename string, content binary, at int")
    for own in ([("one", "f/1", b"1", 0)], [("two", "f/1", b"2", 0)], [("one", "f/1", b"longer", 1), ("one", "f/1", b"3", 2)], [("one", "g", b"4", 0), ("one", None, b"5", 0)]):
        stores.save_raw(raw(*own), f"{tmp_path}/raw", "at")
    got = {(r.key, r.source, r.filename): bytes(r.content) for r in stores.read_raw(spark, f"{tmp_path}/raw", "binary").collect()}
    assert got == {("007", "one", "f/1"): b"3", ("007", "two", "f/1"): b"2", ("007", "one", "g"): b"4", ("007", "one", None): b"5"}
    many = spark.range(500).select(F.lit("").alias("kind"), F.lit(None).cast("string").alias("key"), F.lit("").alias("source"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("filename"), F.col("id").cast("string").cast("binary").alias("content"), F.lit(0).alias("at"))
    stores.save_raw(many.unionByName(many.limit(1).withColumn("filename", F.lit(""))), f"{tmp_path}/many", "at", buckets=4)
    stores.save_raw(many.where("filename = 'f7'").withColumn("content", F.lit("new").cast("binary")), f"{tmp_path}/many", "at", buckets=4)
    back = {(r.kind, r.key, r.filename): bytes(r.content) for r in stores.read_raw(spark, f"{tmp_path}/many", "binary").collect()}
    assert len(back) == 501 and back["", None, "f7"] == b"new" and back["", None, "f8"] == b"8" and ("", None, "") in back
    assert len([p for p in (tmp_path / "many").iterdir() if p.name.startswith("bucket=")]) == 4


def test_registry_files(spark, tmp_path):
    (tmp_path / "c.csv").write_text("corp_code,corp_name,corp_eng_name,stock_code,modify_date\n001,가,A,,20240101\n", encoding="utf-8")
    (tmp_path / "c.xml").write_text("<result><list><corp_code> 001 </corp_code><corp_name>가</corp_name><stock_code/></list></result>", encoding="utf-8")
    assert stores.read_registry_csv(spark, f"{tmp_path}/c.csv").first()[:4] == ("001", "가", "A", None)
    assert stores.read_registry_xml(spark, f"{tmp_path}/c.xml").first()[:5] == ("001", "가", "", "", "")


def test_api_answers(spark):
    df = spark.createDataFrame([('{"status":"000","list":[{"a":"1"},{"a":"2"}]}',), ('{"status":"013"}',)], "b string")
    assert [r.a for r in stores.api_rows(df, "b", "a string").collect()] == ["1", "2"]
    for bad in ('{"status":"010"}', '{"status":"800","message":"closed"}', "nonsense"):
        with pytest.raises(Exception, match="API"):
            stores.api_rows(spark.createDataFrame([(bad,)], "b string"), "b", "a string").collect()


def test_audit_reports(spark):
    xml = '<DOC><EXTRACTION ACODE="TOT">100</EXTRACTION><TABLE-GROUP ACLASS="PBS_1"><TR><TE ADELIM="1">5</TE><TE ADELIM="0">현금</TE><TE ADELIM="2"></TE><TE ADELIM="3">4</TE></TR><TR><TH>x</TH></TR></TABLE-GROUP><TABLE-GROUP ACLASS="ZZ"><TR><TE ADELIM="0">a</TE><TE ADELIM="1">1</TE></TR></TABLE-GROUP></DOC>'
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("a.xml", xml)
    df = spark.createDataFrame([(1, bytearray(packed.getvalue())), (2, bytearray(b"no zip")), (3, None)], "n int, content binary")
    got = stores.audit_reports(df, keep=("n",)).collect()
    assert [(r.n, r.summary, r.statements) for r in got] == [(1, {"TOT": "100"}, {"재무상태표": {"현금": {"당기": "5", "전기": "4"}}})]


def test_streams(spark, tmp_path):
    rows = [(i % 3, f"2024-01-0{1 + i % 4} 00:00:00") for i in range(12)]
    df = spark.createDataFrame(rows, "u int, t string").withColumn("t", F.col("t").cast("timestamp"))
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    seen = []
    collect.run_available(collect.new_by_key(stream(), "u", "t", "30 days"), f"{tmp_path}/s1", collect.snapshots(f"{tmp_path}/out", lambda b, n: seen.append(b.count())))
    assert sorted(r.u for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0, 1, 2] and sum(seen) == 3
    collect.run_available(collect.counts(stream(), "t", "1 day", []), f"{tmp_path}/s2", lambda b, n: b.write.mode("overwrite").parquet(f"{tmp_path}/n"), "complete")
    assert [r.n for r in spark.read.parquet(f"{tmp_path}/n").collect()] == [3, 3, 3, 3]


def test_news_pipeline(spark):
    schema = "subject string, ord long, title string, snippet string, body string, url string, press string, date date, embedding array<double>"
    rows = [
        ("s", 0, "Acme sues", "sn", "", "u0", "P1", date(2024, 1, 5), [1.0, 0.0, 0.0]), ("s", 1, "Acme sues too", "sn", "b", "u1", "P2", date(2024, 1, 5), [0.99, 0.05, 0.0]),
        ("s", 2, "Ruling for Acme", "sn", "b", "u2", "P1", date(2024, 6, 1), [0.9, 0.4, 0.0]), ("s", 3, "Weather", "sn", "b", "u3", "P1", None, [0.0, 0.0, 1.0]),
    ]
    articles = spark.createDataFrame(rows, schema)
    grouping = spark.createDataFrame([(0, 0, 0), (0, 0, 1), (0, 1, 2)], "batch_id long, group_no int, idx int")
    found = news.issues(news.issue_groups(articles, grouping, "㈜Acme"))
    got = found.collect()
    assert [(r.issue_title, r.occurred_month, r["size"], [a.ord for a in r.articles]) for r in got] == [("Acme sues", "2024-01", 3, [0, 1, 2])]
    summary = spark.createDataFrame([(0, 0, 0, "gist", "more", "reputation_risk.major_lawsuit")], "batch_id long, pos int, idx int, gist string, detail_summary string, event_id string")
    none = spark.createDataFrame([], "batch_id long, pos int, idx int, company_importance int, supersedes array<int>")
    topics, raw = news.finalise(found, summary, none)
    row = topics.first()
    assert (row.category_id, row.issues[0].importance, row.issues[0].gist) == ("reputation_risk", 6, "gist") and "body" not in row.issues[0].articles[0].asDict()
    assert raw.first().articles[1].body == "b"
    report = news.report("Acme", {"company": topics}, {"profile": True}, date(2025, 5, 1)).first()
    years = {y["year"]: y["issues"] for y in json.loads(report.yearly_issues)}
    assert set(years) == {"2023", "2024", "2025"} and years["2024"][0]["category"] == "company" and json.loads(report.source_snapshot) == {"news_count": 1, "profile": True}


def test_candidates(spark):
    articles = spark.createDataFrame([("x", 0, "t", "u", "p", date(2024, 2, 1), "b")], "candidate string, ord long, title string, url string, press string, date date, body string")
    web = spark.createDataFrame([("x", "w"), ("y", "only web"), ("z", "")], "candidate string, body string")
    got = {r.issue_title: (r.occurred_month, [a.body for a in r.articles]) for r in news.candidate_issues(articles, web).collect()}
    assert got == {"x": ("2024-02", ["b", "w"]), "y": ("", ["only web"])}
    said = spark.createDataFrame([("x", "competitor")], "candidate string, class string")
    assert [r.candidate for r in news.keep_class(web.select("candidate"), said, ("competitor",)).collect()] == ["x"]
