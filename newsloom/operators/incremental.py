"""Search rounds, page loops and the round loop that stops early."""

from __future__ import annotations

from calendar import monthrange
from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions.storage import materialise

#: Overlap at which a page ends its window; pages of a window; issues at which rounds stop.
OVERLAP, PAGES, ENOUGH = 0.8, 30, 15


def months_before(day: date, months: int) -> date:
    n = day.year * 12 + day.month - 1 - months
    return date(n // 12, n % 12 + 1, min(day.day, monthrange(n // 12, n % 12 + 1)[1]))


def search_rounds(as_of: date) -> list[tuple[date, date]]:
    """Ranges of days that do not overlap: the last six months, the rest of this year, last year, the year before, and
    before April one more."""
    cursor = months_before(as_of, 6)
    out = [(cursor, as_of)]
    for year in range(as_of.year, as_of.year - (4 if as_of.month < 4 else 3), -1):
        start, end = date(year, 1, 1), min(date(year, 12, 31), cursor - timedelta(days=1))
        if start <= end:
            out.append((start, end))
            cursor = start
    return out


def rounds(df: DataFrame, as_of: date, day: str) -> DataFrame:
    """df's rows that a round covers, with round (0 the newest). The ranges become one CASE on the day: no join, and pushed down as bounds."""
    spans = search_rounds(as_of)
    number = F.lit(None).cast("int")
    for k, (start, end) in reversed(list(enumerate(spans))):
        number = F.when(F.col(day).between(F.lit(start), F.lit(end)), k).otherwise(number)
    inside = F.col(day).between(F.lit(min(s for s, _ in spans)), F.lit(as_of))
    return df.where(inside).withColumn("round", number).where("round is not null")


def read_pages(articles: DataFrame, keys: list[str], page: str, order: str, url: str, seen: DataFrame | None = None) -> DataFrame:
    """The articles that reading pages in turn collects: those of new URLs on each page before the one that ends the window.

    A page ends its window if at least 80 % of its rows have a URL from an earlier page, or of seen (same keys, url), and
    its own new rows go with it; 30 pages at most are read, and none after a page number without rows. A URL
    twice on one page stays twice. A row is old if its URL's first page is earlier: pages before the end are all read, so that
    first page is one of them, and a window needs no loop.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    same = lambda other: [F.col(k).eqNullSafe(other[n]) for k, n in zip(keys, names, strict=True)]
    named = lambda df: df.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), *(c for c in df.columns if c not in keys))
    rows = articles.where(F.col(page).between(1, PAGES)).withColumn("__old", F.min(page).over(W.partitionBy(*keys, url)) < F.col(page))
    if seen is not None:
        old = named(seen.select(*keys, F.col(url).alias("__u")).distinct())
        rows = rows.join(old, [*same(old), F.col(url) == old["__u"]], "left").withColumn("__old", F.col("__old") | F.col("__u").isNotNull()).drop("__u", *names)
    stats = rows.groupBy(*keys, page).agg(F.avg(F.col("__old").cast("int")).alias("__share"))
    place = stats.withColumn("__gap", F.row_number().over(W.partitionBy(*keys).orderBy(page)) != F.col(page))
    last = F.coalesce(F.min(F.when((F.col("__share") >= OVERLAP - 1e-12) | F.col("__gap"), F.col(page))), F.lit(PAGES + 1))
    ends = named(place.groupBy(*keys).agg(last.alias("__end")))
    kept = rows.join(ends, same(ends)).where((F.col(page) < F.col("__end")) & ~F.col("__old"))
    return kept.select(*articles.columns)


def refill(collected: DataFrame, day: str, start: date) -> date | None:
    """The last day of a window that is to be searched once more: the day before the oldest found, where that is in the window."""
    oldest = collected.agg(F.min(day)).first()[0]
    return oldest - timedelta(days=1) if oldest and oldest > start else None


def collect_rounds(as_of: date, fetch: Callable[[date, date], DataFrame], issues: Callable[[DataFrame], DataFrame], day: str, key: str, snapshot: Callable[[DataFrame, int], None] | None = None, enough: int = ENOUGH) -> DataFrame:
    """The issues of the rounds read until there are enough, or of all rounds.

    Each round adds its articles of new keys to those before; where its oldest day is after its start, the days before are fetched once
    more. snapshot gets what is collected, before the issues are found. Rounds are a handful, so the loop runs on the driver
    and only counts reach it.
    """
    whole = None
    for number, (start, end) in enumerate(search_rounds(as_of)):
        new = fetch(start, end)
        again = refill(new, day, start)
        if again:
            new = new.unionByName(fetch(start, again).join(new.select(F.col(key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left_anti"))
        whole = materialise(new if whole is None else whole.unionByName(new.join(whole.select(F.col(key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left_anti")))
        if snapshot:
            snapshot(whole, number)
        found = materialise(issues(whole))
        if found.count() >= enough:
            break
    return found


def refine(variants: list[str], collect: Callable[[str], tuple[DataFrame, bool]]) -> DataFrame:
    """The result of the first query variant that is not noisy, or of the last."""
    for v in variants:
        found, noisy = collect(v)
        if not noisy:
            break
    return found
