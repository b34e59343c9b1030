"""Scalar text, number and date functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

# Corporate forms, titles, domains, hosts, labels and patterns of the data.
REGISTRY_FORMS = "주식회사|㈜|\\(주\\)|\\(유\\)|유한회사"
ENTITY_FORMS = "\\(주\\)|㈜|주식회사|\\(유\\)|유한회사|\\(사\\)|사단법인|\\(재\\)|재단법인"
PERSON_TITLES = "대표이사|대표|회장|사장|CEO"
TOTAL_LABELS = ("전사", "성별합계", "합계", "", "-")
SEXES = {"남": "male", "여": "female"}
NULL_WORDS = ("null", "none", "")
POSTING_HOSTS = ("jobkorea.co.kr", "www.jobkorea.co.kr", "m.jobkorea.co.kr")
BLOCKED_DOMAINS = (
    "google.com", "search.naver.com", "blog.naver.com", "cafe.naver.com", "post.naver.com", "in.naver.com", "linkedin.com", "facebook.com",
    "instagram.com", "youtube.com", "twitter.com", "x.com", "tistory.com", "namu.wiki", "wikipedia.org", "jobkorea.co.kr", "saramin.co.kr",
    "wanted.co.kr", "rocketpunch.com", "jobplanet.co.kr", "incruit.com", "gamejob.co.kr", "albamon.com", "catch.co.kr", "linkareer.com",
    "worknet.go.kr", "jasoseol.com", "nicebizinfo.com", "nicednb.com", "creditbank.co.kr", "nts.go.kr", "alio.go.kr", "data.go.kr",
    "ftc.go.kr", "kotra.or.kr", "innobiz.or.kr", "kssn.net", "bizno.net", "kepco.co.kr",
)
DATE, AGO = r"(\d{4})\.(\d{1,2})\.(\d{1,2})", r"(\d+)\s*(분|시간|일|주)\s*전"
DEADLINE = r"(20\d{2})[-./년]\s*(\d{1,2})[-./월]\s*(\d{1,2})"
BUSINESS_NUMBER = r"사업자\s*등록\s*번호\s*[:：]?\s*(\d{3}[-\s]?\d{2}[-\s]?\d{5})"
QUARTER, FISCAL_YEAR = r"\.(\d{2})\)", r"\((\d{4})\.\d{2}\)"
DETAIL_PATH, DETAIL_URL = r"^/Recruit/GI_Read/(\d+)$", "https://www.jobkorea.co.kr/Recruit/GI_Read_Comt_Ifrm?Gno="
FENCE_START, FENCE_END = r"^```(?:json)?\s*", r"\s*```$"
UNIT_DAYS = {"분": 0, "시간": 0, "일": 1, "주": 7}
REPORT_CODES = {"사업보고서": "11011", "반기보고서": "11012"}
QUARTER_CODES = {"03": "11013", "09": "11014"}
PLACEHOLDER = "데이터 없음"


def _map(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for p in pairs.items() for x in p))


def collapse(text: Column) -> Column:
    """Runs of any Unicode white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def article_date(text: Column, as_of: Column | date) -> Column:
    """The first Y.M.D in the text, else the first '3 days ago' in Korean before as_of; impossible dates and no match give null."""
    part = lambda i: F.regexp_extract(text, DATE, i)
    spelled = F.try_to_date(F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")), "yyyy-MM-dd")
    days = F.regexp_extract(text, AGO, 1).try_cast("int") * F.element_at(_map(UNIT_DAYS), F.regexp_extract(text, AGO, 2))
    today = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return F.when(text.rlike(DATE), spelled).when(text.rlike(AGO), F.date_sub(today, days))


def strip_entity(name: Column) -> Column:
    """A name without corporate forms, for use in search queries; case and single blanks stay."""
    return collapse(F.regexp_replace(F.coalesce(name, F.lit("")), ENTITY_FORMS, ""))


def name_key(name: Column) -> Column:
    """Without corporate forms and white space, in lower case: to tell whether text names a company."""
    return F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), rf"(?U){ENTITY_FORMS}|\s+", ""))


def registry_key(name: Column) -> Column:
    """Without fewer corporate forms, white space and . , & ( ), in its own case: to look up a registry."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), REGISTRY_FORMS, ""), r"(?U)[\s().,&]", "")


def digits(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9]", "")


def same_number(a: Column, b: Column) -> Column:
    return (digits(a) != "") & (digits(a) == digits(b))


def person_key(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), rf"(?i){PERSON_TITLES}", ""), r"(?U)\s+", "")


def same_person(a: Column, b: Column) -> Column:
    return (person_key(a) != "") & (person_key(a) == person_key(b))


def verified(number: Column, person: Column, known_number: Column, known_person: Column) -> Column:
    """A known business number decides alone; without one a known person does; without either nothing is verified."""
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(given(known_number), same_number(number, known_number)).when(given(known_person), same_person(person, known_person)).otherwise(False)


def business_number(text: Column) -> Column:
    """The ten digits after the label of a business registration number, or null."""
    found = F.regexp_extract(text, f"(?U){BUSINESS_NUMBER}", 1)
    return F.nullif(digits(found), F.lit(""))


def report_code(name: Column) -> Column:
    """The code of a periodic report from its name; quarterly reports go by their month, others have none."""
    quarter = F.try_element_at(_map(QUARTER_CODES), F.regexp_extract(name, QUARTER, 1))
    out = F.when(name.contains("사업보고서"), REPORT_CODES["사업보고서"]).when(name.contains("반기보고서"), REPORT_CODES["반기보고서"])
    return out.when(name.contains("분기보고서"), quarter)


def fiscal_year(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, FISCAL_YEAR, 1), F.lit(""))


def to_int(text: Column) -> Column:
    """A whole number with thousands separators; blank, - and anything else, 12.5 among it, is null."""
    return F.regexp_replace(F.trim(text), ",", "").try_cast("bigint")


def to_float(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), ",", "").try_cast("double")


def division(label: Column) -> Column:
    plain = F.trim(F.coalesce(label, F.lit("")))
    return F.when(plain.isin(*TOTAL_LABELS), "total").otherwise(plain)


def sex(label: Column) -> Column:
    plain = F.trim(F.coalesce(label, F.lit("전체")))
    return F.coalesce(F.try_element_at(_map(SEXES), plain), plain)


def clean_null(text: Column) -> Column:
    """null for texts that spell it."""
    return F.when(~F.lower(F.trim(text)).isin(*NULL_WORDS), text)


def clean_nulls(items: Column) -> Column:
    """A list without the entries that spell null."""
    return F.filter(items, lambda x: x.isNotNull() & ~F.lower(F.trim(x)).isin(*NULL_WORDS))


def has_value(*texts: Column) -> Column:
    """Whether any text is neither null nor empty."""
    return F.coalesce(*(F.nullif(t, F.lit("")) for t in texts)).isNotNull()


def deadline(known: Column, text: Column) -> Column:
    """The known deadline, else the last date in the text as yyyy-mm-dd, else null."""
    last = F.get(F.reverse(F.regexp_extract_all(text, F.lit(DEADLINE), F.lit(0))), F.lit(0))
    part = lambda i: F.regexp_extract(last, DEADLINE, i)
    found = F.when(last.isNotNull(), F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")))
    return F.coalesce(F.nullif(known, F.lit("")), found)


def url_host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def detail_url(url: Column) -> Column:
    """The page that holds a posting's body, for URLs of exactly the known hosts and path; else null."""
    number = F.regexp_extract(F.try_parse_url(url, F.lit("PATH")), DETAIL_PATH, 1)
    ok = url_host(url).isin(*POSTING_HOSTS) & (number != "")
    return F.when(ok, F.concat(F.lit(DETAIL_URL), number))


def blocked(url: Column, domains: tuple[str, ...] = BLOCKED_DOMAINS) -> Column:
    """Whether the host holds a blocked domain anywhere; no host, not blocked."""
    host = F.coalesce(url_host(url), F.lit(""))
    return F.exists(F.array(*map(F.lit, domains)), lambda d: F.contains(host, d))


def name_appears(name: Column, text: Column) -> Column:
    """Whether a text names a company: its key, or, lenient on purpose, the name's first two Hangul letters."""
    key, where, prefix = name_key(name), name_key(text), F.regexp_extract(F.coalesce(name, F.lit("")), "^([가-힣]{2})", 1)
    return ((key != "") & F.contains(where, key)) | ((prefix != "") & F.contains(where, prefix))


def unfence(text: Column) -> Column:
    """A model's answer without its code fence."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), FENCE_START, ""), FENCE_END, "")


def months_ago(day: Column, months: int) -> Column:
    return F.add_months(day, -months)


def days_apart(a: Column, b: Column) -> Column:
    return F.abs(F.date_diff(a, b))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays of numbers; 0 where a norm is 0."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.sqrt(total(F.transform(x, lambda v: v.cast("double") * v.cast("double"))))
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    return F.when((norm(a) == 0) | (norm(b) == 0), 0.0).otherwise(dot / (norm(a) * norm(b)))


def query_variants(name: Column, person: Column) -> Column:
    """Search phrases from loose to strict: two, and two more where a person is known."""
    plain = strip_entity(name)
    quoted, who = F.concat(F.lit('"'), plain, F.lit('"')), F.concat(F.lit(' "'), person, F.lit('"'))
    firm = F.lit("기업 ")
    known = F.coalesce(person, F.lit("")) != ""
    return F.filter(F.array(quoted, F.concat(firm, quoted), F.when(known, F.concat(quoted, who)), F.when(known, F.concat(firm, quoted, who))), lambda x: x.isNotNull())


def or_placeholder(value: Column) -> Column:
    """A structure as JSON, or the words for no data."""
    return F.coalesce(F.to_json(value), F.lit(PLACEHOLDER))


def mime(data: Column) -> Column:
    """An image's type by its first bytes; PNG where none fits."""
    head = F.hex(F.substring(data, 1, 12))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "image/png").when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
        .when(head.startswith("474946383761") | head.startswith("474946383961"), "image/gif").otherwise("image/png")
    )


def identical_tracks(a: Column, b: Column, fields: tuple[str, ...] = ("requirements", "preferred", "responsibilities")) -> Column:
    """Whether two tracks (structs of lists) agree in all fields and are not all empty; a missing track agrees with none."""
    same, some = F.lit(True), F.lit(False)
    for f in fields:
        same = same & a[f].eqNullSafe(b[f])
        some = some | F.coalesce(F.size(a[f]) > 0, F.lit(False))
    return a.isNotNull() & b.isNotNull() & same & some
