"""The plans put together: searches by rounds and variants, site profiles step by step, fit analyses."""

import json
from datetime import date, timedelta

from pyspark.sql import functions as F

from newsloom.operators import incremental
from newsloom.plans import company, matching, searches

AS_OF = date(2026, 7, 29)


def providers(spark, search, snapshots):
    """Titles that end in x are irrelevant; no two articles are alike; every issue gets the same event."""

    def relevant(items):
        good = items.where("title not like '%x'").select("batch_id", F.col("idx").alias("pos"), "idx")
        return good.unionByName(items.select("batch_id", F.lit(-1).alias("pos"), F.lit(None).cast("int").alias("idx")).distinct())

    none = spark.createDataFrame([], "batch_id long, pos int, idx int, gist string, detail_summary string, event_id string")
    ranks = spark.createDataFrame([], "batch_id long, pos int, idx int, company_importance int, supersedes array<int>")
    return searches.Providers(
        search=search, relevant=relevant, mirrors=spark.createDataFrame([("m0", '<article id="dic_area">whole</article>')], "url string, html string"),
        vectors=lambda texts: [[0.0, 0.0] for _ in texts], grouping=lambda items: spark.createDataFrame([], "batch_id long, group_no int, idx int"),
        summaries=lambda found: none, importance=lambda found: ranks, snapshot=lambda articles, number: snapshots.append((number, articles.count())),
    )


def articles(spark, rows):
    """rows: (title, url, day, mirror)."""
    schema = "ord long, title string, snippet string, url string, press string, date date, mirror_url string"
    return spark.createDataFrame([(i, t, f"snippet {t}", u, "P", d, m) for i, (t, u, d, m) in enumerate(rows)], schema)


def test_rounds_refill_and_bodies(spark):
    """A search that stops after four articles is asked once more for the days before; rounds end when there are enough issues."""
    days = [AS_OF - timedelta(20 * i) for i in range(40)]
    whole = articles(spark, [(f"Acme {i}{'x' if i % 3 == 1 else ''}", f"u{i}", d, "m0" if i == 0 else None) for i, d in enumerate(days)])
    asked, snapshots = [], []

    def search(query, start, end):
        asked.append((query, start, end))
        return whole.where(F.col("date").between(F.lit(start), F.lit(end))).orderBy(F.desc("date")).limit(4)

    found, noisy = searches.collect_issues("q", AS_OF, providers(spark, search, snapshots), "Acme", enough=6)
    want, seen, calls = [], set(), []
    for start, end in incremental.search_rounds(AS_OF):
        take = lambda a, b: [i for i, d in enumerate(days) if a <= d <= b and i not in seen][:4]
        new = take(start, end)
        seen |= set(new)
        calls.append((start, end))
        if new and days[new[-1]] > start:
            calls.append((start, days[new[-1]] - timedelta(1)))
            again = take(*calls[-1])
            seen |= set(again)
            new += again
        want += [i for i in new if i % 3 != 1]
        if len(want) >= 6:
            break
    assert [(a, b) for _, a, b in asked] == calls and not noisy
    got = {r.issue_title: r for r in found.collect()}
    assert set(got) == {f"Acme {i}" for i in want} and [n for n, _ in snapshots] == list(range(1, len(snapshots) + 1)) and snapshots[-1][1] == len(want)
    assert got["Acme 0"].articles[0].body == "whole" and got["Acme 2"].articles[0].body == "snippet Acme 2" and got["Acme 0"].occurred_month == "2026-07"


def test_noisy_variant_is_refined(spark):
    rows = lambda n, good: articles(spark, [(f"Acme {i}{'' if i < good else 'x'}", f"u{i}", AS_OF, None) for i in range(n)])
    by_query, asked, snapshots = {'"Acme"': rows(40, 16), '기업 "Acme"': rows(18, 17)}, [], []

    def search(query, start, end):
        asked.append(query)
        return by_query[query].where(F.col("date").between(F.lit(start), F.lit(end)))

    topics, raw = searches.recent_issues(spark, "㈜Acme", None, AS_OF, providers(spark, search, snapshots), articles(spark, [("Acme sued", "law", AS_OF, None), ("other x", "no", AS_OF, None)]))
    assert list(dict.fromkeys(asked)) == ['"Acme"', '기업 "Acme"'] and raw.count() == 18 and topics.count() == 1 and len(topics.first().issues) == 18
    assert snapshots[0] == (0, 1)


def test_nothing_relevant_is_not_noisy(spark):
    """Articles of which none is relevant, or of which the net of names leaves no issue, ask no stricter query."""
    for titles, keyword in ((["other x"] * 12, "㈜Acme"), (["other"] * 12, "㈜Acme")):
        asked, snapshots = [], []
        rows = articles(spark, [(t, f"u{i}", AS_OF, None) for i, t in enumerate(titles)])

        def search(query, start, end, asked=asked, rows=rows):
            asked.append(query)
            return rows.where(F.col("date").between(F.lit(start), F.lit(end)))

        assert searches.recent_issues(spark, keyword, "Kim", AS_OF, providers(spark, search, snapshots)) is None
        # The days before the oldest article of the first round are asked for once more.
        assert set(asked) == {'"Acme"'} and len(asked) == len(incremental.search_rounds(AS_OF)) + 1


def test_nothing_found_ends_the_search(spark):
    asked, snapshots = [], []
    empty = articles(spark, [("t", "u", AS_OF, None)]).limit(0)
    p = providers(spark, lambda *a: asked.append(a) or empty, snapshots)
    assert searches.industry_trend(spark, "games", AS_OF, p) is None and len(asked) == 1
    words = spark.createDataFrame([(3, "RAG"), (1, "agents"), (2, "RAG")], "ord long, name string")
    web = spark.createDataFrame([("RAG", "about it"), ("agents", ""), ("other", "x")], "candidate string, body string")
    none = spark.createDataFrame([], "candidate string, ord long, title string, url string, press string, date date, body string")
    topics, raw = searches.job_trend(spark, "dev", AS_OF, p, words, none, web)
    assert [(r.issue_title, r.articles[0].body) for r in raw.collect()] == [("RAG", "about it")] and topics.count() == 1


def test_site_profile_steps(spark):
    card, page = '<h1 class="corpName">A</h1>', '<a href="/corp/1">기업정보</a><p>jobs</p>'
    pages = spark.createDataFrame([("http://gamejob/1", card), ("http://x/post", page), ("http://x/corp/1", "<p>linked</p>"), ("http://x/plain", "<p>plain</p>")], "url string, html string")
    rows = [(1, "http://x/post", "http://gamejob/1", None), (2, "http://x/post", None, None), (3, "http://x/plain", "http://gone", None), (4, None, None, '```json\n{"a": "b"}\n```'), (5, None, None, '{"a": null, "b": []}'), (6, "http://x/plain", "http://gamejob/1", "{")]
    postings = spark.createDataFrame(rows, "n int, posting_url string, info_url string, screenshot_answer string")
    told = lambda texts: [json.dumps({"said": t}) for t in texts]
    got = {r.n: (r.step, r.profile and json.loads(r.profile)) for r in company.site_profiles(postings, pages, told).collect()}
    assert got[1][0] == 1 and got[1][1]["기업정보"] == {"회사명": "A"} and got[6][0] == 1
    assert got[2] == (2, {"said": "linked"}) and got[3] == (3, {"said": "plain"}) and got[4] == (4, {"a": "b"}) and got[5] == (None, None)


def test_fit_analysis(spark):
    feature = "array<struct<name:string,evidence:string,source:string>>"
    item = "matched:boolean,candidate_feature_path:string,candidate_evidence_excerpt:string,reasoning:string"
    schema = f"""n int, candidate_profile struct<skills:{feature},experiences:{feature},education:{feature},certifications:{feature},awards:{feature}>, job_title string, company_name string,
        company_profile struct<company_name:string,industry_domain:array<string>,culture:array<string>,talent_values:array<string>>,
        job_items array<struct<match_target_type:string,match_target_text:string,match_target_evidence:string,{item}>>, company_items array<struct<dimension:string,criterion_text:string,criterion_evidence:string,{item}>>"""
    profile = ([("Spark", "built it", "cv")], None, [], [], [])
    job = [("required", "Spark", "e", True, "skills[0]", "guess", "good"), ("required", "Go", "e", False, "skills[7]", "guess", ""), ("odd", "z", None, True, None, "said", None)]
    firm = [("culture", "c", "e", True, None, None, None), ("talent_values", "t", "e", None, "experiences[0]", "x", None), (None, "n", "e", False, None, None, None)]
    rows = [(1, profile, "Dev", "", ("Acme", [], [], ["v"]), job, firm), (2, profile, "Dev", "Report", ("Acme", None, None, None), None, firm[:1]), (3, None, None, None, None, job[:1], None)]
    got = {r.n: r for r in matching.analyse(spark.createDataFrame(rows, schema), "n").collect()}
    a = got[1]
    assert (a.job_title, a.company_name) == ("Dev", "Acme") and [(c.category, c.total, c.matched) for c in a.category_summary] == [("자격요건", 2, 1), ("인재상 및 조직문화", 1, 0)]
    assert [(m.candidate_evidence.field, m.candidate_evidence.excerpt) for m in a.job_matches] == [("skills[0]", "built it"), (None, "guess"), (None, "said")] and len(a.company_matches) == 2
    assert a.job_text.split("\n") == ["[자격요건] ✓ Spark", "  근거: built it", "  판단: good", "[자격요건] ✗ Go", "[기타] ✓ z", "  근거: said"]
    assert (got[2].company_name, got[2].job_matches, got[2].company_matches, got[2].category_summary, got[2].job_text) == ("Report", [], [], [], "")
    assert got[3].job_matches[0].candidate_evidence.excerpt == "guess" and got[3].company_matches == []
