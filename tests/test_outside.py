"""What is read from outside: paged searches as a data source, paced calls, answers checked against a schema."""

import json
import threading
import time
from collections import Counter
from datetime import date
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.structured import decode, optional, required, structured
from newsloom.operators import paced
from newsloom.plans import postings
from newsloom.sources import paged

A, B = date(2024, 1, 1), date(2024, 1, 31)


def read(spark, tmp_path, *queries, start=A, end=B, **options):
    log = tmp_path / "calls"
    log.touch()
    paged.register(spark)
    reader = spark.read.format("paged_search").options(provider="tests.stub_pages:scripted", log=str(log), wait="0", **{k: str(v) for k, v in options.items()}).load()
    found = reader.where(F.col("query").isin(*queries) & (F.col("searched_from") == F.lit(start)) & (F.col("searched_to") == F.lit(end)))
    return found, log


def test_pages_end_by_the_stopping_rule(spark, tmp_path):
    found, log = read(spark, tmp_path, "two", "part", "endless", "none")
    by = Counter((r.query, r.page) for r in found.collect())
    assert {k: n for k, n in by.items() if k[0] != "endless"} == {("two", 1): 5, ("two", 2): 5, ("part", 1): 5}
    assert {k for k in by if k[0] == "endless"} == {("endless", i) for i in range(1, 31)}
    asked = Counter(x.split()[0] for x in log.read_text().splitlines())
    assert asked == {"two": 3, "part": 2, "endless": 30, "none": 1}
    assert {x.split()[1:3] == [str(A), str(B)] for x in log.read_text().splitlines()} == {True}


def test_one_page_and_pushed_filters(spark, tmp_path):
    found, log = read(spark, tmp_path, "endless", pages=1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 2 and len(log.read_text().splitlines()) == 1
    assert "Filter (" not in plan and "paged_search" in plan  # the window and the query are the source's
    more = found.where("press = 'p' and page > 5")
    assert more.count() == 0 and "Filter (" in more._jdf.queryExecution().executedPlan().toString()


def test_throttled_pages_are_asked_again_and_failures_are_rows(spark, tmp_path):
    found, log = read(spark, tmp_path, "throttled", "broken", tries=4)
    rows = {r.query: (r.page, r.url, r.error) for r in found.where("error is null").collect()}
    assert rows == {"throttled": (1, "late", None), "broken": (1, "kept", None)}
    assert [(r.query, r.page, r.error) for r in found.where("error is not null").collect()] == [("broken", 2, "OSError: no route")]
    assert Counter(log.read_text().splitlines())[f"broken {A} {B} 2"] >= 4


def test_html_pages_give_articles(spark, tmp_path):
    log = tmp_path / "calls"
    log.touch()
    got = paged.search(spark, "tests.stub_pages:scripted", "html", A, B, date(2024, 1, 31), log=log).collect()
    assert [tuple(r) for r in got] == [(1000, "Title", "Snip", "http://n/1", "Press", date(2024, 1, 28), None, None)]


def test_stored_articles_answer_windows(spark, tmp_path):
    rows = [("q", i, f"t{i}", f"u{i % 40}", None, "p", "s", date(2024, 1, 1 + i % 28) if i % 9 else None) for i in range(60)] + [("other", 1, "x", "y", None, "p", "s", A)]
    paged.store_articles(spark.createDataFrame(rows, "query string, ord long, title string, url string, mirror_url string, press string, snippet string, date date"), str(tmp_path / "store"))
    ask = lambda q, a, b, **o: paged.search(spark, "newsloom.sources.paged:stored", q, a, b, B, path=str(tmp_path / "store"), **o).orderBy("ord").collect()
    inside = [r for r in rows[:60] if r[7] is None or date(2024, 1, 5) <= r[7] <= date(2024, 1, 20)]
    want, seen = [], set()
    for at in range(0, len(inside), 10):
        page = inside[at : at + 10]
        new = [r for r in page if r[3] not in seen]
        if 1 - len(new) / len(page) >= 0.8:
            break
        seen |= {r[3] for r in page}
        want += new
    assert [(r.title, r.url, r.date) for r in ask("q", date(2024, 1, 5), date(2024, 1, 20))] == [(r[2], r[3], r[7]) for r in want]
    assert [r.title for r in ask("other", A, A)] == ["x"] and ask("missing", A, B) == []
    assert len(ask("q", A, B, pages=1, page_size=4)) == 4


# Paced calls


class Clock:
    def __init__(self):
        self.now, self.slept = 0.0, []

    def __call__(self):
        return self.now

    def sleep(self, s):
        self.slept.append(s)
        self.now += s


def test_bucket_keeps_the_pace():
    clock = Clock()
    bucket = paced.Bucket(2.0, 3, clock, clock.sleep)
    went = []
    for _ in range(7):
        bucket.take()
        went.append(clock.now)
    assert went == [0, 0, 0, 0.5, 1.0, 1.5, 2.0]
    clock.now += 10
    for _ in range(4):
        bucket.take()
    assert clock.slept[-1] == 0.5 and clock.now == 12.5


def test_back_off_between_tries():
    clock, calls = Clock(), []

    def call(request):
        calls.append(clock.now)
        raise TimeoutError(request)

    assert paced.attempt(call, "x", paced.Bucket(1000, 1000, clock, clock.sleep), 4, 0.5) == (None, "TimeoutError: x", 4)
    assert calls == [0, 0.5, 1.5, 3.5]
    assert paced.attempt(lambda r: None, "x", paced.Bucket(1, 1, clock, clock.sleep), 3, 1) == (None, None, 1)


def test_failing_and_slow_hosts(spark, tmp_path):
    """A host that fails loses no row of another, no host has two requests in flight, and hosts of a task do not wait for each other."""
    path = str(tmp_path)

    def call(request):
        host = request.split("/")[0]
        flag = f"{path}/{host}"
        open(flag, "x").close()  # noqa: SIM115  fails if another request of the host is in flight
        try:
            if host == "bad":
                raise ConnectionError("refused")
            time.sleep(0.3 if host == "slow" else 0.01)
            return None if request.endswith("/0") else request.upper()
        finally:
            import os

            os.unlink(flag)

    rows = [(h, i) for h in ("bad", "slow", "fast") for i in range(6)] + [(None, 1)]
    df = spark.createDataFrame(rows, "host string, n int").repartition(5)
    began = time.time()
    got = paced.paced(df, F.concat("host", F.lit("/"), F.col("n").cast("string")), F.col("host"), call, rate=200, burst=5, tries=2, wait=0.01).collect()
    assert time.time() - began < 20 and len(got) == len(rows)
    by = {(r.host, r.n): (r.answer, r.error, r.tries) for r in got}
    assert all(by["bad", i] == (None, "ConnectionError: refused", 2) for i in range(6))
    assert all(by[h, i] == (f"{h}/{i}".upper(), None, 1) for h in ("slow", "fast") for i in range(1, 6))
    assert by["fast", 0] == (None, None, 1) and by[None, 1] == (None, None, 0)
    with pytest.raises(ValueError, match="taken"):
        paced.paced(df.withColumn("error", F.lit(1)), F.col("host"), F.col("host"), call)
    assert paced.paced(df.limit(0), F.col("host"), F.col("host"), call).count() == 0


def test_pages_by_http(spark):
    class Site(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            if self.path == "/old":
                self.send_response(302)
                self.send_header("Location", "/new")
                self.end_headers()
            elif self.path == "/new":
                self.send_response(200)
                self.send_header("Content-Type", "text/html; charset=euc-kr")
                self.end_headers()
                self.wfile.write("<p>한글\n둘</p>".encode("euc-kr"))
            else:
                self.send_response(404 if self.path == "/none" else 500)
                self.end_headers()

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    root = f"http://127.0.0.1:{server.server_port}"
    df = spark.createDataFrame([(f"{root}{p}",) for p in ("/old", "/none", "/broken")] + [(None,)], "url string")
    got = {r.url and r.url.removeprefix(root): (r.html, r.final_url, r.error, r.tries) for r in paced.pages(df, "url", rate=100, burst=10, tries=2, wait=0.01).collect()}
    server.shutdown()
    assert got["/old"] == ("<p>한글\n둘</p>", f"{root}/new", None, 1) and got["/none"] == (None, None, None, 1) and got[None] == (None, None, None, 0)
    assert got["/broken"][:2] == (None, None) and "500" in got["/broken"][2] and got["/broken"][3] == 2


# Structured answers

SCHEMA = T.StructType([
    required("kind", "string", one_of=["a", "b"]), optional("n", "bigint"), optional("share", "double"), optional("ok", "boolean"),
    required("items", T.ArrayType(T.StructType([required("name", "string"), optional("tags", "array<string>")])), closed=True),
])


def violations(spark, answer, closed=False):
    return spark.createDataFrame([(answer,)], "a string").select(decode(F.col("a"), SCHEMA, closed).alias("d")).first().d


@pytest.mark.parametrize(("answer", "want"), [
    ('{"kind": "a", "items": []}', []),
    ('```json\n{"kind": "b", "n": 3, "share": 2, "ok": false, "items": [{"name": "x", "tags": ["t"]}], "more": 1}\n```', []),
    ('{"kind": "a", "n": null, "items": [{"name": "x", "tags": null}]}', []),
    ("no json", ["$: not JSON"]), (None, ["$: not JSON"]), ("[1]", ["$: not an object"]), ("{}", ["$.kind: missing", "$.items: missing"]),
    ('{"kind": "c", "n": 1.5, "share": "x", "ok": "true", "items": {}}', ["$.kind: none of a, b", "$.n: not a whole number", "$.share: not a number", "$.ok: not true or false", "$.items: not a list"]),
    ('{"kind": 1, "items": [{"name": "x"}, {"tags": ["a", 2, null]}, 7, {"name": "y", "z": 1}]}', ["$.kind: not a text", "$.items[1].name: missing", "$.items[1].tags[1]: not a text", "$.items[1].tags[2]: missing", "$.items[2]: not an object", "$.items[3].z: not known"]),
])
def test_decode(spark, answer, want):
    got = violations(spark, answer)
    assert got.violations == want and (got.value is None) == bool(want)


def test_closed_objects(spark):
    assert violations(spark, '{"kind": "a", "items": [], "z": 1, "b": 2}', True).violations == ["$.b: not known", "$.z: not known"]
    full = violations(spark, '{"kind": "b", "n": 3, "share": 2, "items": [{"name": "x", "tags": ["t"]}]}').value
    assert (full.kind, full.n, full.share, full.ok, full["items"][0].name, full["items"][0].tags) == ("b", 3, 2.0, None, "x", ["t"])


def test_violators_are_asked_once_more(spark):
    def provider(texts):
        out = []
        for t in texts:
            fixed = "missing" in t or t.startswith("good")
            out.append('{"kind": "a", "items": []}' if fixed and not t.startswith("never") else '{"kind": "a"}')
        return out

    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "never"), (4, None)], "n int, p string")
    got = {r.n: (r.value and r.value.kind, r.violations, r.tries) for r in structured(df, F.col("p"), SCHEMA, postings._asker(provider)).collect()}
    assert got == {1: ("a", [], 1), 2: ("a", [], 2), 3: (None, ["$.items: missing"], 2), 4: (None, None, 0)}
    with pytest.raises(ValueError, match="taken"):
        structured(df.withColumn("tries", F.lit(1)), F.col("p"), SCHEMA, postings._asker(provider))


def test_postings(spark):
    long = "업무 내용 " * 60
    pages = spark.createDataFrame([("http://short/1", "https://www.jobkorea.co.kr/Recruit/GI_Read/77?x=1", f"<p>{long}</p>"), ("https://www.jobkorea.co.kr/Recruit/GI_Read_Comt_Ifrm?Gno=77", None, "<b>마감 2024.1.2 ~ 2024-03-04</b>"), ("http://x/2", None, "<p>little</p>")], "url string, final_url string, html string")
    rows = [(1, "http://short/1", "Dev", None), (2, "http://x/2", None, "shot text"), (3, None, "", None), (4, "http://gone", "QA", None)]
    found = postings.posting_texts(spark.createDataFrame(rows, "id int, url string, job_title string, screenshot_text string"), pages)
    texts = {r.id: (r.key, r.posting_text, r.vision_used) for r in found.collect()}
    assert texts[1] == ("Dev", f"[공고 원문 (URL: http://short/1)]\n{long.strip()}\n\n[공고 상세 본문 (URL: https://www.jobkorea.co.kr/Recruit/GI_Read_Comt_Ifrm?Gno=77)]\n마감 2024.1.2 ~ 2024-03-04", False)
    assert texts[2] == (postings.NO_TITLE, "[스크린샷에서 추출한 공고 내용]\nshot text", True) and texts[3] == (postings.NO_TITLE, "", False) and texts[4] == ("QA", "", False)
    track = {"requirements": ["r"], "preferred": None, "responsibilities": None}
    good = {"company_name": "C", "common": {}, "jobs": [{"job_name": "j", "tracks": {"newcomer": track, "experienced": track}}, {"job_name": "k", "locations": ["Seoul"]}], "work_conditions": {}, "raw_meta": {"source_url": "made up", "vision_used": True}, "preprocess_log": {}}
    bad = {**good, "jobs": [{"locations": "Seoul"}]}
    kept = []
    made = postings.postings(found, lambda ts: [json.dumps(bad if t.startswith("QA") else good) for t in ts], lambda df: kept.append(df.count()))
    got = {r.id: r for r in made.collect()}
    assert kept == [4]
    one = got[1].value
    assert (one.raw_meta.source_url, one.raw_meta.vision_used, one.work_conditions.deadline, one.raw_text) == ("http://short/1", False, "2024-03-04", texts[1][1])
    assert got[1].warnings == ["j"] and one.jobs[1].locations == ["Seoul"] and got[2].value.raw_meta.vision_used and got[2].value.work_conditions.deadline is None
    assert got[4].value is None and got[4].tries == 2 and got[4].violations == ["$.jobs[0].job_name: missing", "$.jobs[0].locations: not a list"]


def test_resumes(spark):
    answers = {
        "cv": '{"response_type": "success", "resume": {"school": [{"name": "U"}], "tools_skills": [{"name": "Spark", "proficiency": null}]}}',
        "news": '{"response_type": "fail", "reason": "a news text", "suggestion": "send a resume"}', "odd": '{"response_type": "fail"}',
        "wrong": '{"response_type": "success", "resume": {"school": [{"name": "U", "rank": 1}]}}', "bare": '{"response_type": "success"}',
    }
    df = spark.createDataFrame([(k, k) for k in answers] + [("blank", " \n "), ("null", None)], "id string, text string")
    now = F.lit("2024-05-06 07:08:09").cast("timestamp")
    got = {r.id: r for r in postings.resumes(df, lambda ts: [answers[t.split("\n")[0]] for t in ts], now).collect()}
    assert got["cv"].outcome == "success" and got["cv"].resume.school[0].name == "U" and got["cv"].resume.created_datetime == "2024-05-06 07:08:09"
    assert (got["news"].outcome, got["news"].reason, got["news"].suggestion, got["news"].resume) == ("fail", "이력서로 인식할 수 없는 문서입니다: a news text", "send a resume", None)
    assert got["odd"].reason.endswith("알 수 없는 사유") and got["odd"].suggestion is None
    assert (got["wrong"].outcome, got["wrong"].reason) == ("invalid", "$.resume.school[0].rank: not known")
    assert got["bare"].outcome == "success" and got["bare"].resume.school is None
    assert {got[k].outcome for k in ("blank", "null")} == {"no_text"} and got["null"].reason == postings.NO_RESUME_TEXT
