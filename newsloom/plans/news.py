"""The news pipelines: articles to issues, issues to topics, topics to a report."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.storage import materialise
from newsloom.functions.text import strip_entity
from newsloom.operators import cluster, decisions, groups


def article_text() -> F.Column:
    """What is embedded of an article: its title, and its body or snippet."""
    return F.trim(F.concat_ws(" ", "title", F.coalesce(F.nullif(F.col("body"), F.lit("")), F.col("snippet"))))


def issue_groups(articles: DataFrame, grouping: DataFrame | Callable[[DataFrame], DataFrame], keyword: str | None = None) -> DataFrame:
    """articles (subject, ord, title, body, snippet, press, date, embedding) with group_id.

    Near copies cluster first; the first article of each cluster is grouped by the model's answers (batch_id, group_no, idx over
    the representatives in order, or a function of the batched representatives that gives them); clusters follow their representative. With a keyword, groups of which no article names it go.
    """
    clustered = materialise(articles.join(cluster.leader_clusters(articles, "subject", "ord", "embedding", "date"), ["subject", "ord"]))
    firsts = clustered.groupBy("subject", "cluster").agg(F.min("ord").alias("ord"))
    batched = decisions.batches(firsts, ["subject"], "ord")
    if callable(grouping):
        batched = materialise(batched.join(clustered.select("subject", "ord", "title", "body", "snippet"), ["subject", "ord"]))
        grouping = grouping(batched)
    grouped = decisions.group_items(batched, grouping)
    named = grouped.select("subject", "cluster", F.concat_ws("/", "subject", F.col("batch_id").cast("string"), F.col("group_no").cast("string")).alias("group_id"))
    out = clustered.join(named, ["subject", "cluster"]).drop("cluster")
    if keyword is None:
        return out
    plain = strip_entity(F.lit(keyword))
    return groups.keyword_groups(out, "group_id", plain, F.col("title"), F.coalesce(F.nullif(F.col("body"), F.lit("")), F.col("snippet")))


def issues(grouped: DataFrame) -> DataFrame:
    """(ord, issue_title, occurred_month, articles, size) of issue_groups()' rows: each issue's title and month are its earliest article's."""
    picked = materialise(cluster.select_issues(materialise(grouped), "group_id", "ord", "embedding", "date", "press"))
    head = groups.earliest(picked.select("issue", "title", "date", "ord"), ["issue"], "date", "ord")
    article = F.struct("ord", "title", "url", "press", F.col("date").cast("string").alias("date"), "body")
    kept = picked.groupBy("issue").agg(F.array_sort(F.collect_list(article)).alias("articles"), F.max("n").alias("size"), F.min("ord").alias("first"))
    out = kept.join(head.select("issue", F.col("title").alias("issue_title"), F.coalesce(F.date_format("date", "yyyy-MM"), F.lit("")).alias("occurred_month")), "issue")
    return out.select(F.col("first").alias("ord"), "issue_title", "occurred_month", "articles", "size")


def finalise(found: DataFrame, summary_answers: DataFrame, importance_answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(topics, raw): summaries, importance and links from the answers, timelines merged, and issues put under their topics.

    raw has the issues with their articles' bodies, for another run over them; topics' articles have none.
    """
    found = materialise(found)
    raw = found.select("ord", "issue_title", "occurred_month", "articles")
    light = found.withColumn("articles", F.transform("articles", lambda a: a.dropFields("body")))
    summed = decisions.summaries(decisions.batches(light, [], "ord", decisions.SUMMARY_BATCH), summary_answers)
    ranked = decisions.importance(decisions.batches(summed.drop("batch_id", "idx"), [], "ord"), importance_answers)
    return decisions.topics(decisions.merge_timelines(materialise(ranked))), raw


def report(company: str, topics: dict[str, DataFrame], sources: dict[str, bool], as_of: date) -> DataFrame:
    """One row: company, yearly issues of all kinds of topics, their number, and which sources gave something, as JSON text."""
    flat = None
    for kind, t in topics.items():
        own = t.select(F.explode("issues").alias("i")).select("i.*").withColumn("category", F.lit(kind))
        flat = own if flat is None else flat.unionByName(own, allowMissingColumns=True)
    years = decisions.yearly(flat, as_of).agg(F.array_sort(F.collect_list(F.struct("year", "issues"))).alias("y"))
    count = flat.agg(F.count("*").alias("news_count"))  # a row on either side
    flags = F.struct("news_count", *(F.lit(v).alias(k) for k, v in sources.items()))
    return years.join(F.broadcast(count)).select(F.lit(company).alias("company"), F.to_json("y").alias("yearly_issues"), F.to_json(flags).alias("source_snapshot"))


def candidate_issues(articles: DataFrame, web: DataFrame) -> DataFrame:
    """One issue a candidate: its first-page articles and, last, its web summary as one more; candidates with neither have none.

    articles: candidate, ord, title, url, press, date, body; web: candidate, body.
    """
    extra = web.where(F.coalesce("body", F.lit("")) != "").select("candidate", F.lit(2**31).cast("long").alias("ord"), F.lit("").alias("title"), F.lit("").alias("url"), F.lit("").alias("press"), F.lit(None).cast("date").alias("date"), "body")
    rows = articles.select("candidate", F.col("ord").cast("long").alias("ord"), "title", "url", "press", "date", "body").unionByName(extra)
    got = rows.groupBy("candidate").agg(F.array_sort(F.collect_list(F.struct("ord", "title", "url", "press", F.col("date").cast("string").alias("date"), "body"))).alias("articles"), F.min("date").alias("d"))
    return got.select(F.col("candidate").alias("issue_title"), F.coalesce(F.date_format("d", "yyyy-MM"), F.lit("")).alias("occurred_month"), "articles")


def keep_class(candidates: DataFrame, answers: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """candidates (candidate, ...) whose class among answers (candidate, class) is wanted; unanswered ones are unrelated."""
    said = answers.groupBy("candidate").agg(F.first("class", ignorenulls=True).alias("class"))
    return candidates.join(said, "candidate", "left").withColumn("class", F.coalesce("class", F.lit("unrelated"))).where(F.col("class").isin(*wanted))
