"""A corpus pipeline of five stages, each over what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.storage import materialise
from newsloom.llm import langid, mixing, pieces, simhash, substring
from newsloom.llm.common import fold, table

#: A text further from its language's profile than this is in none of the languages learned.
LEAST_SCORE = 0.3
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents in a learned language; those without letters or far from every profile go."""
    profiles = langid.learn(docs.where(fold("doc_id", 4) != 2))
    scored = langid.predict(docs, profiles, keep=tuple(F.col(c) for c in ("lang", "source", "n_chars")), keep_text=True)
    return scored.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group, that of the smallest id; documents link at a Jaccard similarity of 0.8 or more of their
    5-word shingles, found through their fingerprints and prefix keys."""
    return simhash.keep_one(docs.select(*COLUMNS))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove the words of passages that a document of a smaller id has; documents that lose all words go."""
    cut = substring.remove_repeats(docs).select(F.col("doc_id").alias("cut_id"), F.col("source_hash").alias("cut_hash"), "kept_text")
    both = docs.select(*COLUMNS).join(cut, (F.col("doc_id") == F.col("cut_id")) & (F.xxhash64(F.col("text").cast("binary")) == F.col("cut_hash")), "left")
    text = F.coalesce("kept_text", "text")
    kept = both.where("kept_text is null or kept_text != ''").withColumn("text", text)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat, cut or drop documents so that the sources come near their targets."""
    mixed = mixing.repeat(docs.select(*COLUMNS), mixing.mix(docs))
    return mixed.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode the whole texts."""
    coded = pieces.encode(docs, keep=(F.col("doc_id"), F.col("source")))
    return coded.select("doc_id", "source", F.size("ids").alias("n_tokens"), "ids")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("substrings", substrings), ("mix", mix), ("tokens", tokens)]
#: The shingles, profiles and pieces have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each result written to the shared folder and read again; the last is returned."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
