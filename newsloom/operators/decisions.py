"""Model answers as decision tables: batches, index match-back, validity and fallbacks, timelines, topics, years."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.storage import materialise
from newsloom.functions.taxonomy import FALLBACK, FALLBACK_IMPORTANCE, taxonomy, with_event
from newsloom.operators import scan
from newsloom.operators.graph import keyed_components
from newsloom.operators.groups import last_wins

#: Rows of a batch for grouping and importance, and for summaries; tokens of a request and of one text.
BATCH, SUMMARY_BATCH, REQUEST_TOKENS, TEXT_TOKENS = 25, 6, 250_000, 8192


def batches(df: DataFrame, keys: list[str], order: str, size: int = BATCH) -> DataFrame:
    """df with batch_id and idx (0-based within it), by order within keys; without keys all rows are one list."""
    placed = scan.number(df, keys, order, "__n")
    return placed.withColumn("batch_id", F.floor(F.col("__n") / size).cast("long")).withColumn("idx", (F.col("__n") % size).cast("int")).drop("__n")


def token_batches(df: DataFrame, key: str, order: str, text: str, count: Callable[[str], list], cut: Callable[[list], str], most: int = REQUEST_TOKENS, longest: int = TEXT_TOKENS) -> DataFrame:
    """(key, order, text, n_tokens, batch): a batch is closed when the next text would take it over most tokens, unless it holds no token yet.

    A text of more than longest tokens is cut to its first longest; null counts as empty. A key's texts are taken one after the other, in order, but no task
    takes a key whole: texts are counted where they are, the order is cut into parts, and of each part is found where it leaves the open batch
    for every place at which its first batch can start. Those tables are followed from part to part, and a second pass numbers the batches.
    """
    rows = df.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(text).alias("t"))
    schema = T.StructType([*rows.schema.fields, T.StructField("n_tokens", T.LongType())])

    def counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            tokens = [count(t or "") for t in p["t"]]
            yield p.assign(t=[cut(x[:longest]) if len(x) > longest else t for x, t in zip(tokens, p["t"], strict=True)], n_tokens=[min(len(x), longest) for x in tokens])

    whole = materialise(rows.mapInPandas(counted, schema))
    cuts = scan.bounds(whole, "o")
    placed = whole.withColumn("at", scan.part("o", cuts))
    dealt = lambda frame: frame.repartition("k", "at").sortWithinPartitions("k", "at", "o")
    if cuts:
        kind = rows.schema["k"].dataType
        table = T.StructType([T.StructField("k", kind), T.StructField("at", T.IntegerType()), T.StructField("total", T.LongType()), *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("low", "high", "after", "closed"))])
        tables = dealt(placed.select("k", "at", "o", "n_tokens")).select("k", "at", "n_tokens").mapInPandas(lambda parts: _ends(parts, most), table)
        carry = T.StructType([T.StructField("ck", kind), T.StructField("cat", T.IntegerType()), T.StructField("used", T.LongType()), T.StructField("first", T.LongType())])
        carries = tables.repartition("k").sortWithinPartitions("k", "at").mapInPandas(lambda parts: _follow(parts, most), carry)
        placed = placed.join(carries, placed.k.eqNullSafe(carries.ck) & (placed["at"] == carries.cat), "left").drop("ck", "cat")
    else:
        placed = placed.withColumns({"used": F.lit(0).cast("long"), "first": F.lit(0).cast("long")})

    def numbered(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, used, batch = None, 0, 0
        for p in parts:
            out = []
            for k, at, n, before, first in zip(p["k"], p["at"], p["n_tokens"], p["used"], p["first"], strict=True):
                if (k if k == k else None, at) != now:
                    now, used, batch = (k if k == k else None, at), int(before), int(first)
                if used and used + n > most:
                    batch, used = batch + 1, 0
                used += n
                out.append(batch)
            yield p[["k", "o", "t", "n_tokens"]].assign(batch=out)

    made = dealt(placed).mapInPandas(numbered, T.StructType([*schema.fields, T.StructField("batch", T.LongType())]))
    return made.select(F.col("k").alias(key), F.col("o").alias(order), F.col("t").alias(text), "n_tokens", "batch")


def _ends(parts: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """Of each key and part (rows k, at, n_tokens in order): for every row at which a first batch can start, the tokens before it (low) and
    with it (high), the tokens of the batch that is open at the part's end (after), and how many batches began (closed).

    A row's batch ends at a next start, found in the sums of tokens; pointers to next starts are doubled until all stand on a last one.
    """

    def table(key: tuple, sizes: list) -> pd.DataFrame:
        n = np.concatenate(sizes)
        sums = np.concatenate([[0], np.cumsum(n)])
        starts = np.arange(len(n))
        ahead = np.minimum(np.maximum(np.searchsorted(sums, sums[:-1] + most, "right") - 1, np.searchsorted(sums, sums[:-1], "right")), len(n))
        last, hops = np.where(ahead < len(n), ahead, starts), (ahead < len(n)).astype(np.int64)
        while (last[last] != last).any():
            hops, last = hops + hops[last], last[last]
        low = min(int(np.searchsorted(sums, 0, "right")) - 1, len(n))
        high = max(int(np.searchsorted(sums, most, "right")) - 1, int(np.searchsorted(sums, 0, "right")))
        own = slice(low, high + 1)
        return pd.DataFrame([(*key, int(sums[-1]), sums[:-1][own], sums[1:][own], sums[-1] - sums[last[own]], hops[own] + 1)], columns=["k", "at", "total", "low", "high", "after", "closed"])

    now, sizes = None, []
    for p in parts:
        for key, rows in p.groupby(["k", "at"], sort=False, dropna=False):
            key = (key[0] if key[0] == key[0] else None, key[1])
            if key != now and sizes:
                yield table(now, sizes)
                sizes = []
            now = key
            sizes.append(rows["n_tokens"].to_numpy())
    if sizes:
        yield table(now, sizes)


def _follow(parts: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """The tokens of the open batch (used) and its number (first) before each part of a key, from _ends()' tables in order."""
    now, used, batch = None, 0, 0
    for p in parts:
        out = []
        for r in p.itertuples(index=False):
            key = (r.k if r.k == r.k else None,)
            if key != now:
                now, used, batch = key, 0, 0
            out.append((key[0], r.at, used, batch))
            low, high = np.asarray(r.low), np.asarray(r.high)
            start = max(int(np.searchsorted(high, most - used, "right")), 0 if used else int(np.searchsorted(low, 0, "right")))
            if start < len(high):
                used, batch = int(r.after[start]), batch + int(r.closed[start])
            else:
                used += int(r.total)
        yield pd.DataFrame(out, columns=["ck", "cat", "used", "first"])


def embed(df: DataFrame, text: str, out: str, provider: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """df with the provider's vector of each text, in Arrow batches; null text counts as empty. The provider is called on the executors."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series(provider(s.fillna("").tolist()))

    return df.withColumn(out, run(F.col(text)))


def keep_relevant(items: DataFrame, answers: DataFrame) -> DataFrame:
    """items (batch_id, idx, ...) in the order the model gave (pos), where it answered; batches without an answer pass whole.

    answers: batch_id, pos, idx; an answered batch with nothing relevant has one row of null idx. Indices out of range go;
    an index given twice keeps its row twice.
    """
    said = answers.select("batch_id", "pos", "idx")
    named = items.join(said, ["batch_id", "idx"])
    silent = items.join(said.select("batch_id").distinct(), "batch_id", "left_anti").withColumn("pos", F.col("idx").cast(answers.schema["pos"].dataType))
    return named.unionByName(silent)


def group_items(items: DataFrame, answers: DataFrame) -> DataFrame:
    """items with group_no, from answers (batch_id, group_no, idx).

    A batch with an index given twice or out of range, or without any answer, falls apart into groups of one; in a valid one,
    indices left out go.
    """
    size = items.groupBy("batch_id").agg(F.count("*").alias("size"))
    check = answers.groupBy("batch_id").agg(F.count("*").alias("n"), F.countDistinct("idx").alias("d"), F.min("idx").alias("low"), F.max("idx").alias("high"))
    valid = size.join(check, "batch_id").where("n = d and low >= 0 and high < size").select("batch_id")
    good = items.join(valid, "batch_id", "left_semi").join(answers.select("batch_id", "group_no", "idx"), ["batch_id", "idx"])
    single = items.join(valid, "batch_id", "left_anti").withColumn("group_no", F.col("idx").cast(answers.schema["group_no"].dataType))
    return good.unionByName(single)


def summaries(issues: DataFrame, answers: DataFrame) -> DataFrame:
    """issues (batch_id, idx, ...) with gist, detail_summary, event_id from answers (batch_id, pos, idx, ...): the last of an index
    wins, and an issue without an answer has empty texts and the fallback event."""
    last = last_wins(answers.select("batch_id", "idx", "pos", "gist", "detail_summary", "event_id"), ["batch_id", "idx"], "pos").drop("pos")
    out = issues.join(last, ["batch_id", "idx"], "left")
    empty = F.col("event_id").isNull() & F.col("gist").isNull()
    return out.withColumns({"event_id": F.when(empty, FALLBACK).otherwise(F.col("event_id")), "gist": F.coalesce("gist", F.lit("")), "detail_summary": F.coalesce("detail_summary", F.lit(""))})


def importance(issues: DataFrame, answers: DataFrame) -> DataFrame:
    """issues (batch_id, idx, event_id, ...) with company_importance (1 to 10) and supersedes from answers (batch_id, pos, idx, ...).

    The last of an index wins; without an answer the event's base importance and no links. Links out of the batch's range, and
    to the issue itself, go.
    """
    size = issues.groupBy("batch_id").agg(F.count("*").alias("__size"))
    last = last_wins(answers.select("batch_id", "idx", "pos", "company_importance", "supersedes"), ["batch_id", "idx"], "pos").drop("pos")
    base = taxonomy(issues.sparkSession).select(F.col("event_id").alias("__event"), F.col("base_importance").alias("__base"))
    out = issues.join(last, ["batch_id", "idx"], "left").join(F.broadcast(base), F.col("event_id") == F.col("__event"), "left").join(size, "batch_id")
    given = F.col("company_importance")  # null stays null: greatest() and least() would pass it over
    clamped = F.when(given.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(10), given)))
    links = F.filter(F.coalesce("supersedes", F.array().cast("array<int>")), lambda s: (s >= 0) & (s < F.col("__size")) & (s != F.col("idx")))
    return out.withColumn("company_importance", F.coalesce(clamped, F.col("__base"), F.lit(FALLBACK_IMPORTANCE))).withColumn("supersedes", links).drop("__event", "__base", "__size")


def merge_timelines(issues: DataFrame) -> DataFrame:
    """Chains of issues as one issue each. issues: ord, batch_id, idx, issue_title, occurred_month, gist, detail_summary, event_id,
    articles, company_importance, supersedes (indices of the same batch).

    Returns ord (the chain's smallest), the last member's title, month and event, the texts joined by arrows with their months
    where there are two or more, all articles, the largest importance (1 if none), and members. Members go by month, empty
    first, then by ord. Links are read within their batch, so that a later batch's never point at the first.
    """
    place = issues.select("batch_id", F.col("idx").alias("__to"), F.col("ord").alias("dst"))
    edges = issues.select("batch_id", F.col("ord").alias("src"), F.explode("supersedes").alias("__to")).join(place, ["batch_id", "__to"]).select("batch_id", "src", "dst")
    chain = keyed_components(edges, "batch_id")
    placed = issues.join(chain, issues.ord == chain.node, "left").withColumn("chain", F.coalesce("component", "ord"))
    row = F.struct(F.coalesce("occurred_month", F.lit("")).alias("m"), "ord", "issue_title", "occurred_month", "gist", "detail_summary", "event_id", "articles")
    got = placed.groupBy("chain").agg(F.array_sort(F.collect_list(row)).alias("r"), F.coalesce(F.max("company_importance"), F.lit(1)).alias("importance"))
    end = F.element_at("r", -1)
    text = lambda c: F.when(F.size("r") > 1, F.array_join(F.transform("r", lambda x: F.concat(F.lit("["), x.m, F.lit("] "), F.coalesce(x[c], F.lit("")))), " → ")).otherwise(end[c])
    return got.select(
        F.col("chain").alias("ord"), end["issue_title"].alias("issue_title"), end["occurred_month"].alias("occurred_month"), text("gist").alias("gist"), text("detail_summary").alias("detail_summary"),
        end["event_id"].alias("event_id"), F.flatten(F.transform("r", lambda x: x.articles)).alias("articles"), "importance", F.transform("r", lambda x: x.ord).alias("members"),
    )


def topics(issues: DataFrame) -> DataFrame:
    """(category_id, category_label, top, first, issues): issues by category, most important first, equals by ord; in topics likewise.

    issues: ord, event_id, importance and others. An unknown event becomes the fallback.
    """
    named = with_event(issues)
    inner = F.struct((-F.col("importance")).alias("__down"), *[c for c in ("ord", *(c for c in issues.columns if c != "ord"))])
    got = named.groupBy("category_id", "category_label").agg(F.array_sort(F.collect_list(inner)).alias("issues"), F.max("importance").alias("top"), F.min("ord").alias("first"))
    return got.withColumn("issues", F.transform("issues", lambda x: x.dropFields("__down"))).orderBy(F.desc("top"), "first")


def target_years(as_of: date) -> list[int]:
    """Three years, this and the last two; before April one year earlier."""
    start = as_of.year - 2 - (as_of.month < 4)
    return [start, start + 1, start + 2]


def yearly(issues: DataFrame, as_of: date) -> DataFrame:
    """(year, issues) for each of target_years(as_of), empty ones too. issues: ord, category, occurred_month, importance and others."""
    years = issues.sparkSession.createDataFrame([(str(y),) for y in target_years(as_of)], "year string")
    own = issues.withColumn("year", F.substring("occurred_month", 1, 4))
    rest = [c for c in issues.columns if c != "ord"]
    got = own.join(F.broadcast(years), "year").groupBy("year").agg(F.array_sort(F.collect_list(F.struct((-F.col("importance")).alias("__down"), "ord", *rest))).alias("issues"))
    full = years.join(got, "year", "left").withColumn("issues", F.coalesce("issues", F.array().cast(got.schema["issues"].dataType)))
    return full.withColumn("issues", F.transform("issues", lambda x: x.dropFields("__down")))


def lighten(topics_df: DataFrame, keep: tuple[str, ...] = ("issue_title", "occurred_month", "gist", "event_id", "importance", "category")) -> DataFrame:
    """Topics whose issues have only the fields that a prompt needs."""
    fields = [f.name for f in topics_df.schema["issues"].dataType.elementType.fields]
    return topics_df.withColumn("issues", F.transform("issues", lambda x: F.struct(*(x[f].alias(f) for f in fields if f in keep))))


def issue_count(topics_df: DataFrame) -> DataFrame:
    return topics_df.agg(F.coalesce(F.sum(F.size("issues")), F.lit(0)).alias("news_count"))
