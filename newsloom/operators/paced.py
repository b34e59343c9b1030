"""Calls to outside services, dealt by host: one request in flight and a steady pace a host, tries with back-off, failures as rows."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Requests a second and host on average, and at once after a pause; times a call is tried; seconds before the second try, doubled each time; hosts a task serves at once.
RATE, BURST, TRIES, WAIT, AT_ONCE = 1.0, 1, 3, 0.5, 16
USER_AGENT, SECONDS = "Mozilla/5.0", 10


class Bucket:
    """A token bucket: take() waits until a request may go out."""

    def __init__(self, rate: float, burst: int, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.tokens, self.at = float(burst), clock()

    def take(self) -> None:
        now = self.clock()
        self.tokens, self.at = min(self.burst, self.tokens + (now - self.at) * self.rate), now
        if self.tokens < 1:
            self.sleep((1 - self.tokens) / self.rate)
            self.tokens, self.at = 1.0, self.clock()
        self.tokens -= 1


def attempt(call: Callable[[str], str | None], request: str, bucket: Bucket, tries: int, wait: float) -> tuple[str | None, str | None, int]:
    """(answer, error, tries taken). An answer of None is not tried again: the service said that there is none."""
    error = None
    for n in range(1, tries + 1):
        bucket.take()
        try:
            return call(request), None, n
        except Exception as e:  # whatever a service raises is this row's error, not the job's
            error = f"{type(e).__name__}: {e}"
            if n < tries:
                bucket.sleep(wait * 2 ** (n - 1))
    return None, error, tries


def paced(df: DataFrame, request: Column, host: Column, call: Callable[[str], str | None], rate: float = RATE, burst: int = BURST, tries: int = TRIES, wait: float = WAIT, answer: str = "answer") -> DataFrame:
    """df with the answer to each row's request (text), error and tries; a row for each row, whether the call succeeded or not.

    Rows of a host are one task's, which asks one after the other at the host's pace; up to AT_ONCE hosts of a task are asked at the same
    time. That a host of many rows takes long is its pace, which more tasks must not raise. A null request is not asked and has
    neither answer nor error; a null host is one host. Raises ValueError where df has a column of one of the new names.
    """
    made = {answer: "string", "error": "string", "tries": "int"}
    if taken := made.keys() & set(df.columns):
        raise ValueError(f"columns {sorted(taken)} are taken")
    rows = df.select(F.struct(*df.columns).alias("row"), request.cast("string").alias("request"), host.cast("string").alias("host"))
    schema = T.StructType([rows.schema["row"], *(T.StructField(k, T._parse_datatype_string(v)) for k, v in made.items())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buckets: dict[str | None, Bucket] = {}
        with ThreadPoolExecutor(AT_ONCE) as pool:
            for p in parts:
                hosts = p["host"].where(p["host"].notna(), None)
                by_host: dict[str | None, list[int]] = {}
                for i, h in enumerate(hosts):
                    by_host.setdefault(h, []).append(i)
                requests, out = p["request"].tolist(), [(None, None, 0)] * len(p)

                def serve(h: str | None, own: list[int], requests: list = requests, out: list = out) -> None:
                    for i in own:
                        if isinstance(requests[i], str):
                            out[i] = attempt(call, requests[i], buckets[h], tries, wait)

                for h in by_host:
                    buckets.setdefault(h, Bucket(rate, burst))
                list(pool.map(lambda item: serve(*item), by_host.items()))
                yield pd.concat([p[["row"]].reset_index(drop=True), pd.DataFrame(out, columns=[*made])], axis=1)

    return rows.repartition("host").mapInPandas(run, schema).select("row.*", *made)


def http_get(url: str) -> str | None:
    """A page's text, with its address after redirects on a first line of its own; None where the server has no such page. Other failures raise."""
    request = urllib.request.Request(url, headers={"User-Agent": USER_AGENT})  # noqa: S310
    try:
        with urllib.request.urlopen(request, timeout=SECONDS) as r:  # noqa: S310
            body = r.read()
            return r.geturl() + "\n" + body.decode(r.headers.get_content_charset() or "utf-8", "replace")
    except urllib.error.HTTPError as e:
        if e.code in (404, 410):
            return None
        raise


def pages(df: DataFrame, url_col: str, get: Callable[[str], str | None] = http_get, **pace: float) -> DataFrame:
    """df with html, final_url, error and tries of each row's URL, at a host's pace."""
    got = paced(df, F.col(url_col), F.try_parse_url(F.col(url_col), F.lit("HOST")), get, answer="__page", **pace)
    return got.withColumns({"html": F.expr("substring(__page, locate('\\n', __page) + 1)"), "final_url": F.expr("substring(__page, 1, locate('\\n', __page) - 1)")}).drop("__page")
