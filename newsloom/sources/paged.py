"""Paged searches as a Spark data source: queries are read page by page, a day window is taken over as a pushed filter.

    register(spark)
    spark.read.format("paged_search").option("provider", "module:function").load().where("query = 'x' and searched_from = ... and searched_to = ...")

A partition is one query in one window. Its pages are asked for in turn until a page brings hardly anything new, so that a window's stopping
rule needs no other task. What answers is named by provider, a function (query, first day, last day, page from 1, options) that the
executors import; it gives a page as HTML, or its articles as dicts.
"""

from __future__ import annotations

import importlib
import json
import time
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull
from pyspark.sql.types import StructType

from newsloom.functions.text import article_date
from newsloom.operators.incremental import OVERLAP, PAGES
from newsloom.sources.dom import parse
from newsloom.sources.html import NO_RESULTS, page_articles

#: Times that an empty page is asked for before its window ends with an error, and seconds before the second; doubled each time.
TRIES, WAIT = 5, 0.5
#: Articles of a stored page, files of stored articles.
PAGE_SIZE, BUCKETS = 10, 16
FIELDS = ("title", "url", "mirror_url", "press", "snippet")
SCHEMA = "query string, searched_from date, searched_to date, page int, pos int, title string, url string, mirror_url string, press string, snippet string, dates array<string>, error string"
Provider = Callable[[str, date | None, date | None, int, dict], str | list[dict] | None]


def _provider(name: str) -> Provider:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def _articles(page: str | list[dict] | None) -> tuple[list[dict], bool]:
    """(articles, whether an empty page is final): a list is, a page of HTML if it says that nothing was found."""
    if isinstance(page, list):
        return page, True
    return (page_articles(page), parse(page).first(NO_RESULTS) is not None) if page else ([], False)


def read_window(ask: Provider, query: str, start: date | None, end: date | None, options: dict) -> Iterator[tuple]:
    """(page, pos, article or None, error) of one window: articles of URLs that no earlier page had, until a page of which 80 % are old ends it.

    A page that is empty without saying so was throttled, and a call that fails is one that a later try may answer: both are asked
    for again. What stays so after TRIES ends the window with one row of its error; what was read before it is kept.
    """
    seen: set[str] = set()
    for page in range(1, int(options.get("pages", PAGES)) + 1):
        error, found, wait = "", [], float(options.get("wait", WAIT))
        for attempt in range(int(options.get("tries", TRIES))):
            time.sleep(wait * 2 ** (attempt - 1) if attempt else 0)
            try:
                found, final = _articles(ask(query, start, end, page, options))
                error = "" if found or final else "empty page"
            except Exception as e:  # whatever a provider raises is this window's error
                error = f"{type(e).__name__}: {e}"
            if not error:
                break
        if error:
            yield page, 0, None, error
        if not found:
            return
        new = [a for a in found if a["url"] not in seen]
        if 1 - len(new) / len(found) >= OVERLAP - 1e-12:
            return
        seen.update(a["url"] for a in found)
        yield from ((page, pos, a, None) for pos, a in enumerate(found) if a in new)


@dataclass
class Window(InputPartition):
    """One query, or the queries that lister names for a part."""

    query: str | None
    part: int
    start: date | None
    end: date | None


class SearchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)
        self.queries = json.loads(options["queries"]) if "queries" in options else None
        self.start, self.end = (date.fromisoformat(options[k]) if options.get(k) else None for k in ("from", "to"))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """A query or several, and the window's first and last day; all other filters stay Spark's."""
        for f in sorted(filters, key=lambda f: isinstance(f, IsNotNull)):
            match f:
                case EqualTo(("query",), value) | EqualNullSafe(("query",), value):
                    self.queries = [value]
                case In(("query",), values):
                    self.queries = list(values)
                case EqualTo(("searched_from",), value) | EqualNullSafe(("searched_from",), value):
                    self.start = value
                case EqualTo(("searched_to",), value) | EqualNullSafe(("searched_to",), value):
                    self.end = value
                case IsNotNull(("query",)):
                    pass
                case IsNotNull(("searched_from",)) if self.start:
                    pass
                case IsNotNull(("searched_to",)) if self.end:
                    pass
                case _:
                    yield f

    def partitions(self) -> list[Window]:
        if self.queries is None and "lister" in self.options:
            return [Window(None, i, self.start, self.end) for i in range(int(self.options.get("parts", BUCKETS)))]
        return [Window(q, 0, self.start, self.end) for q in dict.fromkeys(self.queries or []) if q is not None] or [Window("", 0, None, None)]

    def read(self, partition: Window) -> Iterator[tuple]:
        ask = _provider(self.options["provider"])
        listed = _provider(self.options["lister"])(partition.part, self.options) if partition.query is None else [partition.query]
        for query in filter(None, listed):
            for page, pos, a, error in read_window(ask, query, partition.start, partition.end, self.options):
                a = a or {}
                yield (query, partition.start, partition.end, page, pos, *(a.get(f) for f in FIELDS), a.get("dates"), error)


class PagedSearch(DataSource):
    """Options: provider (needed), queries (a JSON list) and from, to (ISO days) where no filter gives them, pages, tries, wait; all go to the provider too.

    Where neither a filter nor queries says what to ask, lister does, a function (part, options) that names the queries of each of so many parts.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_search"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> SearchReader:
        return SearchReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let it take over filters (a switch that only Python sources look at)."""
    spark.dataSource.register(PagedSearch)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def search(spark: SparkSession, provider: str, query: str, start: date, end: date, as_of: date, **options: object) -> DataFrame:
    """(ord, title, snippet, url, press, date, mirror_url, error) of a query's window, in the order of its pages: what collect_issues() takes as a search.

    A row with an error stands for the pages that could not be read. Relative dates count from as_of. One page of a search is pages=1.
    """
    register(spark)
    pages = spark.read.format("paged_search").options(provider=provider, **{k: str(v) for k, v in options.items()}).load()
    found = pages.where((F.col("query") == query) & (F.col("searched_from") == F.lit(start)) & (F.col("searched_to") == F.lit(end)))
    day = F.get(F.filter(F.transform("dates", lambda x: article_date(x, as_of)), lambda d: d.isNotNull()), F.lit(0))
    return found.select((F.col("page") * 1000 + F.col("pos")).cast("long").alias("ord"), "title", "snippet", "url", "press", day.alias("date"), "mirror_url", "error")


def store_articles(df: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write articles (query, ord, title, url, mirror_url, press, snippet, date) for stored(), dealt into files by their query."""
    own = df.select("query", F.col("ord").cast("long").alias("ord"), *FIELDS, F.col("date").cast("date").alias("date"))
    own.withColumn("bucket", F.pmod(F.crc32(F.col("query").cast("binary")), F.lit(buckets)).cast("int")).repartition(buckets, "bucket").write.partitionBy("bucket").parquet(path)


@lru_cache(maxsize=2)
def _bucket(path: str, bucket: int) -> dict[str, pa.Table]:
    """The articles of a bucket by their query, in order."""
    files, at = pyarrow.fs.FileSystem.from_uri(path) if urlsplit(path).scheme else (pyarrow.fs.LocalFileSystem(), path)
    folder = f"{at}/bucket={bucket}"
    if files.get_file_info(folder).type == pyarrow.fs.FileType.NotFound:
        return {}
    rows = ds.dataset(folder, filesystem=files, format="parquet").to_table().sort_by([("query", "ascending"), ("ord", "ascending")])
    names = rows.column("query").combine_chunks()
    ends = pc.run_end_encode(names)
    starts = [0, *ends.run_ends.to_pylist()]
    return {q: rows.slice(a, z - a) for q, a, z in zip(ends.values.to_pylist(), starts[:-1], starts[1:], strict=True)}


def stored_queries(part: int, options: dict) -> list[str]:
    """A lister over store_articles()' files: a part is a bucket."""
    return list(_bucket(options["path"], part))


def stored(query: str, start: date | None, end: date | None, page: int, options: dict) -> list[dict]:
    """A provider over store_articles()' files: option path, and page_size articles a page. Articles without a day are in every window."""
    own = _bucket(options["path"], zlib.crc32(query.encode()) % int(options.get("parts", BUCKETS))).get(query)
    if own is None:
        return []
    if start or end:
        day = own.column("date")
        inside = pc.and_kleene(pc.greater_equal(day, start or date.min), pc.less_equal(day, end or date.max))
        own = own.filter(pc.fill_null(inside, True))
    size = int(options.get("page_size", PAGE_SIZE))
    rows = own.slice((page - 1) * size, size).to_pylist()
    return [{f: r[f] for f in FIELDS} | {"dates": [r["date"].strftime("%Y.%m.%d.")] if r["date"] else []} for r in rows]
