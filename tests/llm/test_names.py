"""Kept columns of any name, nulls where they do harm, and what a model's score is, through the queries."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import common, langid, licences, matroska, pieces, quality, queries, spotsigs, warc


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "the cat", 5), (None, None, 6), (2, "", None)], "doc_id long, text string, score int")


def test_kept_columns_keep_their_names(spark, docs):
    model = quality.train([b"a b", b"!!!"], [1, 0], epochs=1)
    odd = (F.col("text"), F.col("score").alias("__kept0"), F.col("score").alias("__text"), F.col("score").alias("__found"))
    got = quality.predict(docs, model, keep=odd)
    assert got.columns == ["doc_id", "text", "__kept0", "__text", "__found", "score"] and {r.doc_id: (r.text, r["__kept0"]) for r in got.collect()} == {1: ("the cat", 5), None: (None, 6), 2: ("", None)}
    profiles = {"en": np.sort(langid.ngrams("the cat")[0])}
    got = langid.predict(docs, profiles, keep=(F.col("score").alias("ids"), F.col("text")))
    assert got.columns == ["doc_id", "ids", "text", "lang_pred", "score"] and {r.ids for r in got.collect()} == {5, 6, None}
    got = pieces.encode(docs, keep=(F.col("text"), F.col("score").alias("__text")), decoded=True)
    assert got.columns == ["text", "__text", "ids", "decoded"] and {r.text: r.decoded for r in got.collect()} == {"the cat": "the cat", None: "", "": ""}
    got = licences.scan(docs, keep=(F.col("score").alias("__found"), F.col("text")))
    assert got.columns == ["__found", "text", "identifiers", "licences"] and {r["__found"] for r in got.collect()} == {5, 6, None}
    stored = matroska.store(docs, keep=(F.col("score").alias("__data"), F.col("text")))
    assert stored.columns == ["__data", "text", "n_bytes", "media"]
    assert matroska.packets(stored, "media", keep=(F.col("media"), F.col("text").alias("__media"))).columns == ["media", "__media", "packets", "cues", "duration_ms", "error"]
    assert matroska.describe(stored, "media", keep=(F.col("text"),)).count() == 3


def test_names_of_results_cannot_be_kept(spark, docs):
    model = quality.train([b"a b", b"!!!"], [1, 0], epochs=1)
    score = F.col("score")
    calls = [
        lambda: quality.predict(docs, model, keep=(score,)), lambda: langid.predict(docs, {}, keep=(score.alias("lang_pred"),)), lambda: langid.predict(docs, {}, keep=(F.col("text"),), keep_text=True),
        lambda: pieces.encode(docs, keep=(score.alias("ids"),)), lambda: pieces.decode(docs.withColumn("ids", F.array(F.lit(1))), keep=(F.col("text"),)), lambda: licences.scan(docs, keep=(score.alias("licences"),)),
        lambda: matroska.store(docs, keep=(score.alias("media"),)), lambda: quality.predict(docs, model, keep=(score.alias("a"), score.alias("a"))),
        lambda: spotsigs.with_signatures(docs.withColumn("__marked", score), F.col("text"), "s"), lambda: spotsigs.with_next(docs.withColumn("__b", score), "doc_id", "text", "after"),
        lambda: spotsigs.with_next(docs.withColumn("after", score), "doc_id", "text", "after"),
    ]
    for call in calls:
        with pytest.raises(ValueError, match="named like|taken"):
            call()


def test_ids_beyond_the_vocabulary(spark):
    n = len(pieces.load(pieces.default_model()).texts)
    df = spark.createDataFrame([(1, [n, -1, None, 2**31 - 1]), (2, []), (3, None)], "k int, ids array<int>")
    got = {r.k: r.text for r in pieces.decode(df, keep=(F.col("k"),)).collect()}
    assert got[2] == "" and got[3] is None and got[1].count("⁇") == 4


def test_records_without_a_key_and_odd_addresses(spark, tmp_path):
    pages = spark.createDataFrame([(None, "http://a/\t\x00b\x1f\r\nc d\x7f", "one"), (None, "http://a/é%20", "one"), (7, None, "x" * 2000), (8, "u", "x" * 2000)], "page_id long, url string, html string")
    decided = warc.decide(pages.withColumn("__winner", F.lit(1)).withColumn("payload_bytes", F.lit("old")), "page_id", "html")
    assert "__winner" in decided.columns and {r.payload_bytes for r in decided.collect()} == {3, 2000}
    warc.write(decided, f"{tmp_path}/w", "page_id", "url", "html", F.when(F.col("page_id") == 7, F.lit("2020-05-06 07:08:09").cast("timestamp")))
    got = warc.resolve(warc.read(spark, f"{tmp_path}/w", payloads=False)).collect()
    assert len({r.record_id for r in got}) == 4
    assert {r.target_uri for r in got} == {"http://a/%09%00b%1F%0D%0Ac%20d%7F", "http://a/é%20", "", "u"}
    assert {r.record_key: (r.record_type, r.refers_to) for r in got if r.record_key} == {7: ("revisit", 8), 8: ("response", None)}
    stamps = {r.record_key: dict(r.headers)["warc-date"] for r in warc.read(spark, f"{tmp_path}/w").collect()}
    assert stamps[7] == "2020-05-06T07:08:09Z" and stamps[8] > "2024" and len(stamps[8]) == 20


def test_batches_have_a_limit(spark, docs):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    try:
        for given, want in (("0", "2000"), ("-1", "2000"), ("5000", "2000"), ("100", "100")):
            spark.conf.set(key, given)
            langid.predict(docs, {})
            assert spark.conf.get(key) == want
    finally:
        spark.conf.set(key, old)
    assert common.ROWS == 2000


def test_learning_takes_one_text_an_id_and_bounded_bytes(spark):
    rows = [(i, ("good words here " if i % 2 else "!!! ??? ") * (i + 1)) for i in range(20)]
    again = [(3, "other text")] * 50
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    seen = []
    old, quality.train = quality.train, lambda texts, y, prior: seen.append((texts, y)) or {}
    try:
        quality.learn(spark.createDataFrame(rows + again, "doc_id long, text string"), labels, "quality")
        quality.learn(spark.createDataFrame(rows, "doc_id long, text string"), labels, "quality", sample_bytes=1000)
    finally:
        quality.train = old
    (texts, y), (few, z) = seen
    assert len(texts) == 20 and sum(y) == 10
    assert 0 < len(few) < 20 and set(few) <= {t.encode() for _, t in rows}
    assert all(sum(len(t) for t, own in zip(few, z, strict=True) if own == k) <= 500 for k in (0, 1))


def plain_score(model, data):
    """The network as loops: the best window of each filter, then one logistic unit."""
    codes = bytes(quality.WIDTH) + data
    best = [-math.inf] * quality.FILTERS
    for at in range(len(codes) - quality.WIDTH + 1):
        for f in range(quality.FILTERS):
            best[f] = max(best[f], sum(float(model["table"][w, codes[at + w], f]) for w in range(quality.WIDTH)))
    z = sum(max(b + float(model["shift"][f]), 0) * float(model["weights"][f]) for f, b in enumerate(best)) + float(model["bias"][0])
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_op4_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in queries.op4_quality(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert got.keys() == texts.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for i, r in got.items())
    taught = sorted((r.doc_id, r.quality) for r in labels.collect() if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 5)
    order = {r.d: r.h for r in spark.createDataFrame([(str(i), i) for i, _ in taught], "s string, d long").select("d", F.xxhash64("s", F.lit(4)).alias("h")).collect()}
    drawn = sorted((order[i], int(q != 0), (texts[i] or "").encode()) for i, q in taught if i in texts)
    share = np.mean([int(q != 0) for _, q in taught])
    model = quality.train([t for _, _, t in drawn], [y for _, y, _ in drawn], min(max(share, 0.01), 0.99))
    short = [i for i, t in texts.items() if len((t or "").encode()) < 300][:25]
    for i in short:
        assert got[i].score == pytest.approx(plain_score(model, (texts[i] or "").encode()), abs=1e-4)


def test_op9_against_brute_force(spark):
    """Profiles, ranks and distances by plain counting of all taught texts, which are fewer than a sample."""
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op9_language(spark, sf).collect()}

    def grams(text):
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        out = {}
        for w in words:
            for n in (1, 2, 3):
                padded = w if n == 1 else f" {w} "
                for i in range(len(padded) - n + 1):
                    out[padded[i : i + n]] = out.get(padded[i : i + n], 0) + 1
        return out

    def number(gram):
        value = 0
        for c in gram:
            value = value << 21 | (1 if c == " " else ord(c))
        return value

    def ranked(counts):
        return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], number(x[0])))][: langid.TOP]

    taught = {}
    for r in rows:
        if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            own = taught.setdefault(r.lang, {})
            for g, n in grams(r.text).items():
                own[g] = own.get(g, 0) + n
    profiles = {lang: {g: i for i, g in enumerate(ranked(c))} for lang, c in taught.items()}
    for r in rows:
        if not r.text or not any(map(str.isalpha, r.text)):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        own = ranked(grams(r.text))
        far = {lang: sum(abs(p[g] - i) if g in p else langid.TOP for i, g in enumerate(own)) for lang, p in sorted(profiles.items())}
        best = min(far, key=far.get)
        assert got[r.doc_id].lang_pred == best and got[r.doc_id].score == pytest.approx(1 - far[best] / (langid.TOP * len(own)))
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
