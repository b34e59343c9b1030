"""Matches of requirements and candidate profiles: evidence look-up, dimension filter, category counts, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators.groups import match_counts

# The report's category of each kind of match; two kinds share the last.
CATEGORIES = {
    "required": "자격요건", "preferred": "우대사항", "responsibility": "주요업무", "tech_tool": "기술·도구", "career": "경력사항",
    "education": "학력사항", "industry_domain": "산업 및 사업 분야", "culture": "인재상 및 조직문화", "talent_values": "인재상 및 조직문화",
}
SECTIONS = ("skills", "experiences", "education", "certifications", "awards")
DIMENSIONS = ("industry_domain", "culture", "talent_values")


def category(kind: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for p in CATEGORIES.items() for x in p)), kind)


def evidence(path: Column, excerpt: Column, profile: Column, doc_id: str) -> Column:
    """struct<doc_id, field, feature_name, excerpt, source>: of the feature that a path such as skills[0] names in the profile.

    profile: a struct of the sections, arrays of (name, evidence, source). A path that names none leaves the model's excerpt.
    """
    parts = rf"^({'|'.join(SECTIONS)})\[(\d+)\]$"
    section, index = F.regexp_extract(path, parts, 1), F.regexp_extract(path, parts, 2).try_cast("int")
    found = F.lit(None)
    for s in SECTIONS:
        found = F.when(section == s, F.get(profile[s], index)).otherwise(found)
    return F.struct(
        F.lit(doc_id).alias("doc_id"), F.when(found.isNotNull(), path).alias("field"), found["name"].alias("feature_name"),
        F.when(found.isNotNull(), found["evidence"]).otherwise(excerpt).alias("excerpt"), found["source"].alias("source"),
    )


def with_dimension(items: DataFrame, profile: Column, dimension: str = "dimension") -> DataFrame:
    """items of dimensions for which the company profile (a struct of arrays) has something; other kinds all stay."""
    empty = F.lit(False)
    for d in DIMENSIONS:
        empty = empty | (F.col(dimension).eqNullSafe(F.lit(d)) & (F.coalesce(F.size(profile[d]), F.lit(0)) <= 0))
    return items.where(~empty)


def category_summary(matches: DataFrame, kind: str, matched: str) -> DataFrame:
    """(category, total, matched, ord) in the order of the categories, those that occur."""
    ranks = {c: i for i, c in enumerate(dict.fromkeys(CATEGORIES.values()))}
    return match_counts(matches, category(F.col(kind)), F.coalesce(F.col(matched), F.lit(False)), ranks)


def match_text(kind: Column, matched: Column, text: Column, excerpt: Column, reasoning: Column) -> Column:
    """A match as lines: its category, a mark and its text, then evidence of a hit and the reasoning, where given."""
    given = lambda c: F.nullif(c, F.lit(""))
    head = F.concat(F.lit("["), F.coalesce(category(kind), F.lit("기타")), F.lit("] "), F.when(matched, "✓").otherwise("✗"), F.lit(" "), F.coalesce(text, F.lit("")))
    return F.concat_ws("\n", head, F.when(matched, F.concat(F.lit("  근거: "), given(excerpt))), F.concat(F.lit("  판단: "), given(reasoning)))


def resolve_title(names: Column) -> Column:
    """struct<status, title, names>: no name is an error, one is the title, more are a choice."""
    n = F.coalesce(F.size(names), F.lit(0))
    status = F.when(n <= 0, "error").when(n == 1, "title").otherwise("choice")
    return F.struct(status.alias("status"), F.when(n == 1, F.get(names, F.lit(0))).alias("title"), F.when(n > 1, names).alias("names"))


def company_data(report: Column) -> Column:
    """What of a stored report goes into the company profile's prompt, as JSON without empty fields.

    report: a struct with summaries as structs of summary, and lists of (text).
    """
    texts = lambda c: F.filter(F.transform(report[c], lambda x: x["text"]), lambda t: F.coalesce(t, F.lit("")) != "")
    some = lambda c: F.when(F.size(c) > 0, c)
    plain = [F.nullif(report[c], F.lit("")).alias(c) for c in ("company_name", "industry_status")]
    summaries = [F.nullif(report[c]["summary"], F.lit("")).alias(c) for c in ("financial_analysis", "growth_potential", "jobplanet_review_summary")]
    lists = [some(texts(c)).alias(c) for c in ("swot_strengths", "swot_weaknesses", "swot_opportunities", "swot_threats", "key_points")]
    return F.to_json(F.struct(*plain, *summaries, *lists))
