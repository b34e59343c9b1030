"""Postings and resumes: raw text put together from pages, screenshots and files, kept, and structured by a model under a schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.storage import materialise
from newsloom.functions.structured import optional, required, structured
from newsloom.functions.text import deadline, detail_url, identical_tracks
from newsloom.plans.company import ask
from newsloom.sources.html import html_lines

#: Characters below which a page's text counts as not read.
USEFUL_CHARS = 200
# Headings of a posting's parts, keys, and reasons of failure.
POSTING_PART, DETAIL_PART, SCREENSHOT_PART = "[공고 원문 (URL: {url})]\n", "[공고 상세 본문 (URL: {url})]\n", "[스크린샷에서 추출한 공고 내용]\n"
NO_TITLE, NO_TITLE_HINT = "직무명_미지정", "(미지정 — 공고에 있는 모든 모집분야를 jobs[]에 각각 빠짐없이 추출하세요)"
NO_RESUME_TEXT, NOT_A_RESUME, UNKNOWN_REASON = "텍스트를 추출하지 못했습니다. 스캔 이미지형 PDF는 지원하지 않습니다.", "이력서로 인식할 수 없는 문서입니다", "알 수 없는 사유"

_TEXTS = "array<string>"


def _texts(*names: str) -> list[T.StructField]:
    return [optional(n, "string") for n in names]


# The fields of a posting and of a resume.
_DOCUMENTS = [optional(n, _TEXTS) for n in ("documents_required", "documents_optional")]
TRACK = T.StructType([*(optional(n, _TEXTS) for n in ("requirements", "preferred", "responsibilities")), *_DOCUMENTS])
JOB = T.StructType([
    required("job_name", "string"), *_texts("department", "career", "headcount", "education", "major"),
    *(optional(n, _TEXTS) for n in ("locations", "responsibilities", "preferred_common", "skills", "core_competencies")),
    optional("tracks", T.StructType([optional("newcomer", TRACK), optional("experienced", TRACK)])),
])
CONDITIONS = T.StructType([*_texts("employment_type", "work_type", "salary"), optional("benefits", _TEXTS), *_texts("deadline", "recruit_url")])
LOG = T.StructType([
    optional("dropped_fields", T.ArrayType(T.StructType([required(n, "string") for n in ("field", "original_value", "reason")]))),
    optional("low_confidence", T.ArrayType(T.StructType([*(required(n, "string") for n in ("field", "original_text", "issue")), required("confidence", "double")]))),
    optional("parse_warnings", _TEXTS),
])
POSTING = T.StructType([
    *_texts("company_name", "posting_title", "source_site", "source_url"),
    required("common", T.StructType([*_texts("education", "major"), optional("preferred", _TEXTS), *_DOCUMENTS])),
    required("jobs", T.ArrayType(JOB)), optional("process", _TEXTS), required("work_conditions", CONDITIONS),
    required("raw_meta", T.StructType([optional("source_url", "string"), optional("vision_used", "boolean"), optional("llm_error", "string")])),
    required("preprocess_log", LOG), optional("raw_text", "string"),
])


def _entries(*names: str) -> T.ArrayType:
    return T.ArrayType(T.StructType(_texts(*names)))


RESUME = T.StructType([
    optional("school", _entries("name", "score", "start_date", "end_date", "location", "major", "graduate"), closed=True),
    optional("career", _entries("name", "department", "position", "responsibilities", "leaving_reason", "start_date", "end_date"), closed=True),
    optional("certifications", _entries("name", "organization", "date"), closed=True),
    optional("awards", _entries("date", "name", "organization", "description"), closed=True),
    optional("education", _entries("name", "organization", "start_date", "end_date", "description"), closed=True),
    optional("tools_skills", _entries("name", "proficiency"), closed=True),
    optional("created_datetime", "string"),
])
ROUTE = T.StructType([required("response_type", "string", one_of=["success", "fail"]), optional("resume", RESUME, closed=True), *_texts("reason", "suggestion")])


def _asker(provider: Callable[[list[str]], list[str]]) -> Callable[[DataFrame, Column, str, Column], DataFrame]:
    return lambda df, prompt, out, when: ask(df, prompt, out, provider, when)


def posting_texts(postings: DataFrame, pages: DataFrame) -> DataFrame:
    """postings with key, posting_text and vision_used: the page's text where it is long enough, the text of its detail page, and what
    screenshots said, each under its heading.

    postings: url, job_title, screenshot_text (each may be null); pages: url, final_url, html, a row a URL. Whether a page has a detail page is told
    by its final address.
    """
    read = pages.select(F.col("url").alias("__url"), F.coalesce("final_url", "url").alias("__final"), html_lines(F.col("html")).alias("__text"))
    first = postings.join(read, postings.url == read["__url"], "left").drop("__url")
    first = first.withColumnsRenamed({"__text": "__own", "__final": "__at"}).withColumn("__detail", detail_url(F.coalesce("__at", "url")))
    both = first.join(read.select(F.col("__url"), F.col("__text").alias("__more")), F.col("__detail") == F.col("__url"), "left").drop("__url")
    part = lambda heading, url, text: F.concat(F.replace(F.lit(heading), F.lit("{url}"), url), text)
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    parts = F.array(
        F.when(F.char_length("__own") >= USEFUL_CHARS, part(POSTING_PART, F.col("url"), F.col("__own"))), F.when(given("__more").isNotNull(), part(DETAIL_PART, F.col("__detail"), F.col("__more"))),
        F.when(F.col("screenshot_text").isNotNull(), F.concat(F.lit(SCREENSHOT_PART), "screenshot_text")),
    )
    text = F.array_join(F.filter(parts, lambda x: x.isNotNull()), "\n\n")
    made = both.withColumns({"key": F.coalesce(given("job_title"), F.lit(NO_TITLE)), "posting_text": text, "vision_used": F.col("screenshot_text").isNotNull()})
    return made.drop("__own", "__at", "__detail", "__more")


def postings(found: DataFrame, provider: Callable[[list[str]], list[str]], keep: Callable[[DataFrame], None], prompt: Callable[[Column, Column], Column] = lambda title, text: F.concat_ws("\n\n", title, text)) -> DataFrame:
    """posting_texts()' rows with value (a POSTING), violations, tries and warnings (job names whose two tracks are the same).

    keep gets the raw texts before the model is asked. The model's source address, vision flag and raw text are replaced by the known ones, and a
    missing deadline by the last date in the text. An answer that violates the schema twice has no value.
    """
    found = materialise(found)
    keep(found)
    made = structured(found, prompt(F.coalesce(F.nullif(F.col("job_title"), F.lit("")), F.lit(NO_TITLE_HINT)), F.col("posting_text")), POSTING, _asker(provider))
    value = F.col("value")
    known = F.struct(F.col("url").alias("source_url"), F.col("vision_used"), value["raw_meta"]["llm_error"].alias("llm_error"))
    terms = value["work_conditions"].withField("deadline", deadline(value["work_conditions"]["deadline"], F.col("posting_text")))
    full = value.withField("raw_meta", known).withField("work_conditions", terms).withField("raw_text", F.col("posting_text"))
    same = F.transform(F.filter(value["jobs"], lambda j: identical_tracks(j["tracks"]["newcomer"], j["tracks"]["experienced"])), lambda j: j["job_name"])
    return made.withColumns({"value": F.when(value.isNotNull(), full), "warnings": same})


def resumes(files: DataFrame, provider: Callable[[list[str]], list[str]], now: Column, prompt: Callable[[Column], Column] = lambda text: text) -> DataFrame:
    """files (text and others) with resume (a RESUME, created now), outcome, reason and suggestion.

    outcome: success; no_text, which is not asked about; fail, with the model's reason and advice; invalid, where the answer violates the schema twice, with what is wrong
    as reason. So a file that is no resume is a row, not an error.
    """
    blank = F.coalesce(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")), F.lit("")) == ""
    made = structured(files, F.when(~blank, prompt(F.col("text"))), ROUTE, _asker(provider), closed=False)
    value = F.col("value")
    outcome = F.when(blank, "no_text").when(F.size("violations") > 0, "invalid").otherwise(value["response_type"])
    stamp = F.date_format(now, "yyyy-MM-dd HH:mm:ss")
    empty = F.from_json(F.lit("{}"), RESUME.simpleString())
    resume = F.when(F.col("outcome") == "success", F.coalesce(value["resume"], empty).withField("created_datetime", stamp))
    reason = F.when(blank, NO_RESUME_TEXT).when(F.col("outcome") == "invalid", F.array_join("violations", "; ")).when(F.col("outcome") == "fail", F.concat(F.lit(f"{NOT_A_RESUME}: "), F.coalesce(value["reason"], F.lit(UNKNOWN_REASON))))
    judged = made.withColumn("outcome", outcome)
    return judged.withColumns({"resume": resume, "reason": reason, "suggestion": F.when(F.col("outcome") == "fail", value["suggestion"])}).drop("value", "violations", "tries")
