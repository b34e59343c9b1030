"""A candidate's fit: match rows, category counts and report texts of any number of analyses, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators import fit

CANDIDATE, COMPANY = "candidate", "company"
JOB_FIELDS = ("match_target_type", "match_target_text", "match_target_evidence")
COMPANY_FIELDS = ("dimension", "criterion_text", "criterion_evidence")


def _matches(items: Column, fields: tuple[str, ...], profile: Column, owner: tuple[str, str]) -> Column:
    """Match rows of a model's items, in their order, with the evidence that each one's path names."""

    def row(x: Column) -> Column:
        proof = fit.evidence(x["candidate_feature_path"], x["candidate_evidence_excerpt"], profile, CANDIDATE)
        head = [F.lit(owner[1]).alias(owner[0]), *(x[f].alias(f) for f in fields)]
        return F.struct(*head, x["matched"].alias("matched"), F.lit(CANDIDATE).alias("candidate_profile_id"), proof.alias("candidate_evidence"), x["reasoning"].alias("reasoning"))

    return F.coalesce(F.transform(items, row), F.array())


def _summary(job: Column, company: Column) -> Column:
    """array<struct<category, total, matched>> in the order of the categories, those that occur."""
    one = lambda kind: lambda m: F.struct(fit.category(m[kind]).alias("category"), F.coalesce(m["matched"], F.lit(False)).alias("matched"))
    marks = F.concat(F.transform(job, one(JOB_FIELDS[0])), F.transform(company, one(COMPANY_FIELDS[0])))

    def count(name: str) -> Column:
        own = F.filter(marks, lambda m: m["category"] == name)
        return F.struct(F.lit(name).alias("category"), F.size(own).alias("total"), F.size(F.filter(own, lambda m: m["matched"])).alias("matched"))

    return F.filter(F.array(*(count(name) for name in dict.fromkeys(fit.CATEGORIES.values()))), lambda c: c["total"] > 0)


def _text(matches: Column, fields: tuple[str, ...]) -> Column:
    kind, said = fields[:2]
    return F.array_join(F.transform(matches, lambda m: fit.match_text(m[kind], m["matched"], m[said], m["candidate_evidence"]["excerpt"], m["reasoning"])), "\n")


def analyse(df: DataFrame, *keep: str) -> DataFrame:
    """Kept columns and job_title, company_name, job_matches, company_matches, category_summary, job_text, company_text of each analysis.

    df: candidate_profile (a struct of fit.SECTIONS), job_title, company_profile (a struct of company_name and fit.DIMENSIONS),
    company_name (the stored report's, which goes first), job_items and company_items (arrays of a model's items; null: none). Items of
    dimensions for which the company profile has nothing go. The two texts are what a model writes the summary from.
    """
    company = F.col("company_profile")
    known = lambda d: ~F.array_contains(F.array(*(F.when(F.coalesce(F.size(company[x]), F.lit(0)) <= 0, x).otherwise("") for x in fit.DIMENSIONS)), F.coalesce(F.nullif(d, F.lit("")), F.lit("-")))
    left = F.filter("company_items", lambda x: known(x["dimension"]))
    made = df.select(
        *keep, "job_title", F.coalesce(F.nullif(F.col("company_name"), F.lit("")), company["company_name"]).alias("company_name"),
        _matches(F.col("job_items"), JOB_FIELDS, F.col("candidate_profile"), ("job_posting_id", "job")).alias("job_matches"),
        _matches(left, COMPANY_FIELDS, F.col("candidate_profile"), ("company_profile_id", COMPANY)).alias("company_matches"),
    )
    return made.select("*", _summary(F.col("job_matches"), F.col("company_matches")).alias("category_summary"), _text(F.col("job_matches"), JOB_FIELDS).alias("job_text"), _text(F.col("company_matches"), COMPANY_FIELDS).alias("company_text"))
