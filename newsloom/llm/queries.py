"""The operators' queries over the whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.storage import shared_dir
from newsloom.llm import langid, licences, matroska, maxscore, mixing, pieces, quality, simhash, spotsigs, substring, vptree, warc, whitening
from newsloom.llm.common import WORD, fold, table


def op1_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = matroska.store(table(spark, sf_dir, "documents"), keep=(F.col("doc_id"),))
    return matroska.describe(stored, "media", (F.col("doc_id"), F.col("n_bytes")))


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents"), keep=(F.col("doc_id"),))
    return found.select("doc_id", F.array_join("identifiers", " ").alias("identifiers"), F.array_join("licences", ", ").alias("licences"))


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    words = F.split(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")), " ")
    plain = docs.select("doc_id", F.xxhash64(F.col("text").cast("binary")).alias("source_hash"), F.filter(words, lambda w: w != "").alias("words"))
    whole = plain.select("doc_id", "source_hash", F.size("words").cast("long").alias("n_words"), F.sha2(F.array_join("words", " "), 256).alias("whole_sha256"))
    cut = substring.remove_repeats(docs).select(F.col("doc_id").alias("cut_id"), F.col("source_hash").alias("cut_hash"), mixing.words("kept_text").alias("kept"), F.sha2("kept_text", 256).alias("cut_sha256"))
    both = whole.join(cut, (whole.doc_id == cut.cut_id) & (whole.source_hash == cut.cut_hash), "left")
    return both.select("doc_id", "n_words", F.coalesce(F.col("n_words") - F.col("kept"), F.lit(0)).alias("n_removed"), F.coalesce("cut_sha256", "whole_sha256").alias("kept_sha256"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = quality.learn(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0), "quality")
    scored = quality.predict(docs, learned)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    coded = pieces.encode(docs, keep=(F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("source_hash")), decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), (F.xxhash64("decoded") == F.col("source_hash")).alias("round_trip"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(warc.decide(pages, "page_id", "html"), path, "page_id", "url", "html")
    back = warc.resolve(warc.read(spark, path, payloads=False))
    return back.select(F.col("record_key").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = langid.learn(docs.where(fold("doc_id", 4) != 2))
    return langid.predict(docs, profiles).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = spotsigs.with_next(docs, "doc_id", "text", "next_text", sigs="sigs").withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substring("next_text", F.lit(1), cut))
    made = spotsigs.with_signatures(both.withColumn("edited", edited), F.col("edited"), "edited_sigs")
    return made.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), spotsigs.fingerprint(F.col("sigs")).alias("fingerprint"), spotsigs.fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        spotsigs.likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), spotsigs.likeness(F.col("sigs"), F.col("next_text_sigs")).alias("near_next"),
    )


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return vptree.nearest(rows, rows.where("vec_id % 50 = 0"))


def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.search(maxscore.index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_matroska, op2_licences, op3_substring, op4_quality, op5_pieces, op6_mixing, op7_warc, op8_simhash, op9_language, op10_spotsigs,
        op11_neighbours, op12_ranked, op13_whitening,
    )
}

ORACLE = {
    "op3_substring": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
g AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS h FROM p),
f AS (SELECT h, min(doc_id) AS first FROM g GROUP BY h),
c AS (SELECT DISTINCT g.doc_id, unnest(range(g.i, g.i + 50)) AS k FROM g JOIN f USING (h) WHERE f.first < g.doc_id),
r AS (SELECT doc_id, list(k) AS gone FROM c GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w) AS n, coalesce(len(gone), 0) AS r,
  CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END AS kept FROM d LEFT JOIN r USING (doc_id))
SELECT doc_id, n AS n_words, r AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k""",
    "op6_mixing": f"""
WITH d AS (SELECT doc_id, source, text, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size, md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS draw FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
o AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
b AS (SELECT *, coalesce(sum(cap) OVER u, 0) AS cap_before, coalesce(sum(weight) OVER u, 0) AS weight_before, sum(source_size) OVER () * 1.5::DOUBLE AS total, sum(weight) OVER () AS all_weight
  FROM o WINDOW u AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - cap_before) / (all_weight - weight_before) AS level FROM b),
t AS (SELECT source, source_size, coalesce(least(cap, weight * (SELECT max(level) FROM l WHERE cap >= level * weight)), cap) AS target FROM l),
p AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS times,
  sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id ROWS UNBOUNDED PRECEDING) AS ends FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(times * size + greatest(0, least(size, floor(target - times * source_size + 1e-6) - (ends - size))) AS BIGINT) AS taken FROM p""",
    "op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
w AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM w""",
    "op11_neighbours": """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_reduce(list_transform(embedding::DOUBLE[], lambda x: x * x), lambda a, b: a + b) AS square FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, i.vec_id, list_reduce(list_transform(range(1, len(q.v) + 1), lambda k: q.v[k] * i.v[k]), lambda a, b: a + b) / (sqrt(q.square) * sqrt(i.square)) AS score
  FROM e AS q JOIN e AS i ON q.vec_id <> i.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5""",
    "op12_ranked": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT doc_id, w, len(w)::BIGINT AS n FROM d WHERE len(w) > 0), g AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS all_terms FROM s),
t AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM s) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM t, g GROUP BY term, docs),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
r AS (SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // all_terms))))::BIGINT AS score FROM b JOIN f USING (term) JOIN t USING (term), g GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 50""",
}
