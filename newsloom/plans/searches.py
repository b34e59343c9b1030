"""News searches put together: rounds of days until there are issues enough, query variants until one is not noisy."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.storage import materialise
from newsloom.functions.text import query_variants
from newsloom.operators import decisions, incremental
from newsloom.operators.groups import ordered_distinct, unseen
from newsloom.plans import news
from newsloom.sources.html import with_body

#: Articles from which noise is judged, and the share of others than relevant ones above which a search is noisy.
LEAST_FOUND, NOISE_SHARE = 10, 0.5
ARTICLE = ("title", "snippet", "url", "press", "date", "mirror_url")
#: Ranks of a search's rounds, batches and places in one number that keeps the order of reading.
ROUND, BATCH = 1 << 40, 1 << 20


@dataclass(frozen=True)
class Providers:
    """What a search takes from outside, as frames or functions between frames: stored pages and decision tables serve as well as live ones.

    search(query, first day, last day) gives ord and the columns of ARTICLE; relevant(items) and grouping(items), of items with batch_id
    and idx, the answers of keep_relevant and group_items; mirrors has url and html; vectors embeds texts, on the executors;
    summaries(issues) and importance(issues) give the answers of finalise; snapshot(articles, round) stores what is
    collected before any later step.
    """

    search: Callable[[str, date, date], DataFrame]
    relevant: Callable[[DataFrame], DataFrame]
    mirrors: DataFrame
    vectors: Callable[[list[str]], list[list[float]]]
    grouping: Callable[[DataFrame], DataFrame]
    summaries: Callable[[DataFrame], DataFrame]
    importance: Callable[[DataFrame], DataFrame]
    snapshot: Callable[[DataFrame, int], None]


def _relevant(new: DataFrame, p: Providers, number: int) -> DataFrame:
    """The relevant articles with their bodies, in the order the model gave."""
    items = materialise(decisions.batches(new.withColumn("subject", F.lit("")), [], "ord"))
    kept = decisions.keep_relevant(items, p.relevant(items))
    place = F.lit(number * ROUND) + F.col("batch_id") * BATCH + F.col("pos")
    return with_body(kept.select("subject", place.alias("ord"), *ARTICLE), p.mirrors)


def collect_issues(query: str, as_of: date, p: Providers, keyword: str | None = None, first: DataFrame | None = None, enough: int = incremental.ENOUGH) -> tuple[DataFrame | None, bool]:
    """(issues, noisy) of one query; issues is None, and the search not noisy, where no issue was found, by whatever step.

    Rounds go back in time until there are enough issues, or none found at all. Each takes articles of new URLs, searches the days
    before its oldest once more, keeps the relevant, fetches their bodies and stores all collected so far before
    they are grouped. first: articles found beforehand (of litigation), which count only where they are relevant. With a keyword,
    issues that do not name it go. The loop runs over at most five rounds, and only counts reach the driver.
    """
    pool = seen = issues = None
    found = relevant = selected = 0

    def add(new: DataFrame, number: int) -> int:
        nonlocal pool
        kept = _relevant(new, p, number)
        pool = materialise(kept if pool is None else pool.unionByName(kept))
        p.snapshot(pool, number)
        return pool.count()

    if first is not None:
        seen = first.select("url")
        found = relevant = add(first, 0)
    for number, (start, end) in enumerate(incremental.search_rounds(as_of), 1):
        fetch = lambda a, b, old: (lambda got: got if old is None else unseen(got, old, "url"))(p.search(query, a, b).select("ord", *ARTICLE))
        new = materialise(fetch(start, end, seen))
        gap_end = incremental.refill(new, "date", start)
        if gap_end:
            known = new.select("url") if seen is None else seen.unionByName(new.select("url"))
            new = materialise(new.unionByName(fetch(start, gap_end, known).withColumn("ord", F.col("ord") + BATCH)))
        found += new.count()
        relevant = add(new, number)
        if not found:
            break
        seen = new.select("url") if seen is None else seen.unionByName(new.select("url"))
        if relevant:
            embedded = decisions.embed(pool.withColumn("__text", news.article_text()), "__text", "embedding", p.vectors).drop("__text")
            issues = materialise(news.issues(news.issue_groups(materialise(embedded), p.grouping, keyword)))
            selected = issues.count()
            if selected >= enough:
                break
    if not selected:
        return None, False
    return issues, found >= LEAST_FOUND and 1 - relevant / found > NOISE_SHARE


def _finished(spark: SparkSession, issues: DataFrame | None, p: Providers) -> tuple[DataFrame, DataFrame] | None:
    return None if issues is None else news.finalise(issues, p.summaries(issues), p.importance(issues))


def recent_issues(spark: SparkSession, name: str, person: str | None, as_of: date, p: Providers, litigation: DataFrame | None = None) -> tuple[DataFrame, DataFrame] | None:
    """(topics, raw) of a company: its query variants from loose to strict until one is not noisy; None where nothing was found."""
    said = spark.range(1).select(query_variants(F.lit(name), F.lit(person).cast("string")).alias("v")).first()["v"]
    issues = incremental.refine(said, lambda q: collect_issues(q, as_of, p, name, litigation))
    return _finished(spark, issues, p)


def industry_trend(spark: SparkSession, keyword: str, as_of: date, p: Providers) -> tuple[DataFrame, DataFrame] | None:
    """(topics, raw) of an industry: one query, noisy or not, and no net of names."""
    return _finished(spark, collect_issues(keyword, as_of, p)[0], p)


def job_trend(spark: SparkSession, title: str, as_of: date, p: Providers, keywords: DataFrame, articles: DataFrame, web: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """(topics, raw) of a job: the issues of its own search, then one issue for each distinct keyword of the trend searches.

    keywords: ord, name (as the trend searches gave them, in their order); articles and web: as news.candidate_issues takes them.
    """
    issues, _ = collect_issues(title, as_of, p)
    order = ordered_distinct(keywords, F.col("name"), "name", "ord").select(F.col("name").alias("issue_title"), (F.lit(1 << 60) + F.col("ord")).alias("ord"))
    more = news.candidate_issues(articles, web).join(order, "issue_title").withColumn("size", F.size("articles").cast("long"))
    more = materialise(more.select("ord", "issue_title", "occurred_month", "articles", "size"))
    p.snapshot(more.select(F.explode("articles").alias("a")).select("a.*"), 0)
    return _finished(spark, more if issues is None else issues.unionByName(more), p)
