"""Stored reports and raw snapshots, the company registry, API answers, audit reports."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.storage import materialise
from newsloom.sources.dom import Node, parse

REGISTRY_SCHEMA = "corp_code string, corp_name string, corp_eng_name string, stock_code string, modify_date string"
REPORT_SCHEMA = "kind string, key string, saved_at timestamp_ntz, payload string"
# Statement classes by prefix, and periods by position.
STATEMENTS = {"PBS": "재무상태표", "PIS": "손익계산서", "PEF": "자본변동표", "PCF": "현금흐름표"}
PERIODS = ("당기", "전기", "전전기")


def save_reports(df: DataFrame, path: str) -> None:
    """Append reports (kind, key, saved_at, payload as JSON text), partitioned by kind. A key that begins like another is another key."""
    df.select("kind", "key", "saved_at", "payload").write.mode("append").partitionBy("kind").parquet(path)


def list_reports(spark: SparkSession, path: str, kind: str | None = None, key: str | None = None) -> DataFrame:
    """Reports, newest first; those whose payload is no JSON are left out. The kind prunes partitions and the key is pushed down."""
    out = spark.read.schema(REPORT_SCHEMA).parquet(path)
    out = out.where(F.col("kind") == kind) if kind is not None else out
    out = out.where(F.col("key") == key) if key is not None else out
    return out.where(F.try_parse_json("payload").isNotNull()).orderBy(F.desc("saved_at"))


def latest_reports(reports: DataFrame) -> DataFrame:
    """The newest report of each kind and key."""
    return reports.groupBy("kind", "key").agg(F.max_by("payload", "saved_at").alias("payload"), F.max("saved_at").alias("saved_at"))


RAW = ["kind", "key", "source", "filename"]
#: Folders that raw content is dealt into, whatever the number of names.
RAW_BUCKETS = 64


def save_raw(df: DataFrame, path: str, order: str, buckets: int = RAW_BUCKETS) -> None:
    """Raw content (kind, key, source, filename, content), one of a name for each kind, key and source: written again, it replaces
    that name's alone. Of rows of one name the last in order stays, of equals the largest content. Empty and null parts of a name are unlike.

    Names are dealt by a hash into so many folders (the same number each time). The folders that new names fall in are
    written anew with what else they hold, and no others; one writer at a time.
    """
    last = df.groupBy(*RAW).agg(F.max_by("content", F.struct(order, "content")).alias("content"))
    last = materialise(last.withColumn("bucket", F.pmod(F.xxhash64(*(F.struct(c) for c in RAW)), F.lit(buckets)).cast("int")))
    touched = [r["bucket"] for r in last.select("bucket").distinct().collect()]
    if not touched:
        return
    try:
        old = df.sparkSession.read.schema(last.schema).parquet(path).where(F.col("bucket").isin(touched))
    except AnalysisException:
        old = last.limit(0)
    new = last.select(*(F.col(c).alias(f"new_{c}") for c in RAW))
    kept = old.join(new, [old[c].eqNullSafe(new[f"new_{c}"]) for c in RAW], "left_anti")
    # The folders are read before they are replaced.
    materialise(last.unionByName(kept)).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read_raw(spark: SparkSession, path: str, content: str = "string") -> DataFrame:
    """What save_raw() has written; content: its type."""
    return spark.read.schema(", ".join(f"{c} string" for c in RAW) + f", content {content}, bucket int").parquet(path).select(*RAW, "content")


def read_registry_csv(spark: SparkSession, path: str) -> DataFrame:
    """The cached registry: five text columns; empty cells are null. ord numbers the rows in file order, with gaps."""
    return spark.read.option("header", True).schema(REGISTRY_SCHEMA).csv(path).withColumn("ord", F.monotonically_increasing_id())


def read_registry_xml(spark: SparkSession, path: str) -> DataFrame:
    """The registry as published, a <list> element a company."""
    fields = [F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ("corp_code", "corp_name", "corp_eng_name", "stock_code", "modify_date")]
    return spark.read.format("xml").option("rowTag", "list").schema(REGISTRY_SCHEMA).load(path).select(*fields).withColumn("ord", F.monotonically_increasing_id())


def api_rows(answers: DataFrame, body: str, row_schema: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The rows of JSON answers. Status 000 has them in list, 013 has none; 010 is a bad key and any other an error: both end the query with their message."""
    got = answers.select(*keep, F.from_json(F.col(body), f"status string, message string, list array<struct<{row_schema}>>").alias("a"))
    status = F.coalesce(F.col("a.status"), F.lit(""))
    failed = F.when(status == "010", F.raise_error(F.lit("the API key is not valid"))).otherwise(F.raise_error(F.concat(F.lit("API error, status="), status, F.lit(": "), F.coalesce(F.col("a.message"), F.lit("")))))
    rows = F.when(status == "000", F.col("a.list")).when(status == "013", F.array().cast(f"array<struct<{row_schema}>>")).otherwise(failed)
    return got.select(*keep, F.inline(rows))


def _audit(xml: str) -> tuple[dict, dict]:
    page = parse(xml)
    summary = {n.attrs["acode"]: n.text(strip=True) for n in page.find_all("extraction") if n.attrs.get("acode")}
    statements: dict = {}
    for group in page.find_all("table-group"):
        label = next((v for k, v in STATEMENTS.items() if group.attrs.get("aclass", "").startswith(k)), None)
        rows = dict(filter(None, map(_account, group.find_all("tr")))) if label else {}
        if rows:
            statements[label] = rows
    return summary, statements


def _account(tr: Node) -> tuple[str, dict] | None:
    """An account and its values by period: the cells with text in order of their number, of which 0 is the name."""
    cells = sorted(tr.find_all("te"), key=lambda c: int(c.attrs.get("adelim") or 0))
    named = [(c.attrs.get("adelim") == "0", c.text(strip=True)) for c in cells]
    name = next((t for zero, t in reversed(named) if zero), None)
    values = [t for zero, t in named if not zero and t]
    return (name, dict(zip(PERIODS, values, strict=False))) if name and values else None


def audit_reports(files: DataFrame, content: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """Kept columns with summary (map) and statements (map of statement to map of account to map of period) of zipped audit reports.

    Files that are no archives, and reports with neither, are left out.
    """

    @F.pandas_udf("struct<summary:map<string,string>,statements:map<string,map<string,map<string,string>>>>")
    def run(data: pd.Series) -> pd.DataFrame:
        rows = []
        for x in data:
            try:
                with zipfile.ZipFile(io.BytesIO(x or b"")) as z:
                    rows.append(_audit(z.read(z.namelist()[0]).decode("utf-8", "replace")))
            except (zipfile.BadZipFile, IndexError):
                rows.append(({}, {}))
        return pd.DataFrame(rows, columns=["summary", "statements"])

    out = files.select(*keep, run(F.col(content)).alias("r")).select(*keep, "r.summary", "r.statements")
    return out.where((F.size("summary") > 0) | (F.size("statements") > 0))


def day_window(df: DataFrame, day: Column, start, end) -> DataFrame:
    """Rows of a range of days, both ends included: bounds that Parquet scans take over."""
    return df.where((day >= F.lit(start)) & (day <= F.lit(end)))
