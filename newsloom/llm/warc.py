"""WARC archives: records, revisit resolution by payload digest, deduplicated writing, and reading back."""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.storage import materialise

LEAST_BYTES = 1000
#: Records a file: bounds what a reading task holds.
RECORDS = 2000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = "record_key long, record_type string, target_uri string, record_id string, refers_to_id string, digest string, length long, payload binary, headers map<string,string>"


def decide(df: DataFrame, key_col: str, payload_col: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """df with payload_bytes, payload_digest (hex SHA-1), record_type and refers_to.

    Of rows with equal payloads of at least least_bytes the one with the largest key is the response and the others revisit it;
    smaller payloads are all responses. Null payloads are empty. Rows that repeat the largest key are responses all; rows
    with a null key revisit a keyed row, and without one are responses. Columns of df's that have one of the four new names are replaced.
    Digests are counted with partial sums, and those that
    repeat are written with their winners: payloads are shuffled by digest once, or not at all where these are few, and a
    crowded digest is split.
    """
    own = df.drop("payload_bytes", "payload_digest", "record_type", "refers_to").withColumn("payload_bytes", F.coalesce(F.octet_length(payload_col), F.lit(0)).cast("long")).withColumn("payload_digest", F.sha1(F.coalesce(F.col(payload_col), F.lit("")).cast("binary")))
    heads = own.where(F.col("payload_bytes") >= least_bytes).groupBy(F.col("payload_digest").alias("digest")).agg(F.max(key_col).alias("winner"), F.count("*").alias("n"))
    heads = materialise(heads.where("n > 1 and winner is not null").drop("n"))
    found = own.join(heads, (own.payload_digest == heads.digest) & (own.payload_bytes >= least_bytes), "left")
    revisit = heads.winner.isNotNull() & ~own[key_col].eqNullSafe(heads.winner)
    return found.select(*(own[c] for c in own.columns), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, heads.winner).alias("refers_to"))


def _urn(col: Column) -> Column:
    """A record's id: of a key always the same, without one unlike any other."""
    h = F.md5(F.concat(F.lit("newsloom:"), F.coalesce(col.cast("string"), F.concat(F.lit("without a key "), F.uuid()))))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def escaped(uri: Column) -> Column:
    """A URI whose blanks, line breaks and control characters are percent-encoded, as none may stand in a header."""
    out = uri
    for code in (*range(33), 127):
        out = F.replace(out, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(uri.rlike("[\\x00-\\x20\\x7F]"), out).otherwise(uri)


def write(decided: DataFrame, path: str, key_col: str, uri_col: str, payload_col: str, date: Column | None = None) -> None:
    """Write decide()'s rows as gzip-compressed WARC/1.1 files under path, with fresh headers; revisits carry no payload.

    date: when a row was captured (a timestamp); without one, or where it is null, the time of writing.

    A record ends in CR LF CR LF, which is the line separator of Spark's text writer: it commits files task by task on any
    file system, so a lost executor leaves no half file. Blanks, line breaks and control characters in a URI are percent-encoded.
    """
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    revisit = F.col("record_type") == "revisit"
    uri = F.coalesce(escaped(F.col(uri_col).cast("string")), F.lit(""))
    at = F.coalesce(date, F.current_timestamp()) if date is not None else F.current_timestamp()
    stamp = F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    body = F.when(revisit, "").otherwise(F.coalesce(F.col(payload_col), F.lit("")))
    record = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", _urn(F.col(key_col))), line("WARC-Date", stamp),
        line("WARC-Target-URI", uri), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", _urn(F.col("refers_to"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        F.coalesce(line("X-Record-Key", F.col(key_col).cast("string")), F.lit("")), line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.octet_length(body).cast("string")), F.lit("\r\n"), body,
    )
    decided.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", RECORDS).option("compression", "gzip").text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and payload of each record, by its length; ValueError at what is no record."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no record at byte {at}")
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(headers["content-length"])
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the archives under path, one row each; without payloads their bytes stay behind.

    digest is computed from a response's payload, and must be the header's; a revisit has its header's. length is the payload's
    as stored. An empty folder gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_key", "record_type", "target_uri", "record_id", "refers_to_id", "digest", "length", "payload", "headers"]
        kinds = [pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary(), pa.map_(pa.string(), pa.string())]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        for b in batches:
            for content in b.column(0):
                rows = []
                data = content.as_py()
                for h, payload in parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    said, key = h.get("warc-payload-digest", "").removeprefix("sha1:"), h.get("x-record-key")
                    if h["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != said:
                        raise ValueError(f"digest of {h['warc-record-id']} is not its payload's")
                    rows.append((int(key) if key else None, h["warc-type"], h.get("warc-target-uri"), h["warc-record-id"], h.get("warc-refers-to"), said, len(payload), payload if payloads else None, list(h.items())))
                    if len(rows) == 500:
                        yield batch(rows)
                        rows = []
                yield batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, RECORD_SCHEMA)


def resolve(records: DataFrame) -> DataFrame:
    """records with payload_bytes and refers_to of each revisit's original, found by record id and digest; those of responses are their own.

    Only headers meet: the payload column is not joined. A revisit whose original is missing has null in both.
    """
    originals = records.where("record_type = 'response'").groupBy(F.col("record_id").alias("__id"), F.col("digest").alias("__digest")).agg(F.max("record_key").alias("__key"), F.max("length").alias("__length"))
    heads = records.drop("payload", "headers")
    found = heads.join(originals, (F.col("refers_to_id") == F.col("__id")) & (F.col("digest") == F.col("__digest")), "left")
    revisit = F.col("record_type") == "revisit"
    return found.withColumn("payload_bytes", F.when(revisit, F.col("__length")).otherwise(F.col("length"))).withColumn("refers_to", F.when(revisit, F.col("__key"))).drop("__id", "__digest", "__key", "__length")
