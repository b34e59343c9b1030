"""Layouts of company profile pages as tables of field and rule, and the reader that applies one to a page.

A layout names its container and its fields. A rule takes an element and gives a value, or OMIT where the page has none; a dict of
rules gives a dict of the values that are there.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from newsloom.sources.dom import Node

OMIT = object()
Rule = Callable[[Node], Any] | dict[str, Any]


def value_of(node: Node, rule: Rule) -> Any:
    if not isinstance(rule, dict):
        return rule(node)
    got = {name: value_of(node, r) for name, r in rule.items()}
    return {name: v for name, v in got.items() if v is not OMIT}


def tidy(s: str) -> str:
    return " ".join(s.split())


def text(css: str = "", sep: str = "", missing: Any = OMIT) -> Rule:
    """The stripped texts of the first element found, or of the element itself, joined by sep."""

    def rule(node: Node) -> Any:
        hit = node.first(css) if css else node
        return missing if hit is None else hit.text(sep, strip=True)

    return rule


def line(css: str = "", sep: str = "", missing: Any = OMIT, drop: str = "") -> Rule:
    """The text of the first element found on one line, without the characters to drop."""

    def rule(node: Node) -> Any:
        hit = node.first(css) if css else node
        return missing if hit is None else tidy(hit.text(sep)).translate(dict.fromkeys(map(ord, drop)))

    return rule


def attribute(css: str, name: str) -> Rule:
    return lambda node: OMIT if (hit := node.first(css)) is None else hit.attrs.get(name)


def cell(n: int, sep: str = "") -> Rule:
    return lambda node: tds[n].text(sep, strip=True) if len(tds := node.find_all("td")) > n else OMIT


def fact(css: str, n: int, least: int, rule: Rule) -> Rule:
    """The rule on the n-th element found, where there are at least so many."""
    return lambda node: value_of(found[n], rule) if len(found := node.select(css)) >= least else OMIT


def every(css: str, sep: str = "") -> Rule:
    return lambda node: [x.text(sep, strip=True) for x in node.select(css)]


def joined(css: str, sep: str) -> Rule:
    """The texts of all elements found, joined by sep; the element's own text where there are none."""
    return lambda node: sep.join(x.text(" ", strip=True) for x in found) if (found := node.select(css)) else node.text(" ", strip=True)


def records(css: str, fields: dict[str, Rule], need: str | None = None, carry: str | None = None) -> Rule:
    """A dict for each element found that has the field needed; an empty field to carry keeps the last value that was given."""

    def rule(node: Node) -> list[dict]:
        out, last = [], None
        for x in node.select(css):
            row = value_of(x, fields)
            if carry:
                last = row[carry] = row.get(carry) or last
            if need is None or need in row:
                out.append(row)
        return out

    return rule


def table(css: str, key: Rule, value: Rule) -> Rule:
    """{key: value} of the elements found that have both; the last of a key stays."""

    def rule(node: Node) -> dict:
        got = ((value_of(x, key), value_of(x, value)) for x in node.select(css))
        return {k: v for k, v in got if k is not OMIT and v is not OMIT}

    return rule


def terms(css: str, key: Rule, value: Rule) -> Rule:
    """{key: value} of definition lists: the n-th term with the n-th definition of each."""

    def rule(node: Node) -> dict:
        lists = ((x.find_all("dt"), x.find_all("dd")) for x in node.select(css))
        return {value_of(t, key): value_of(d, value) for dt, dd in lists for t, d in zip(dt, dd, strict=False)}

    return rule


def headed(css: str, key: Rule, value: Rule) -> Rule:
    """{key: value} of table rows: each header cell takes the cell after it."""

    def rule(node: Node) -> dict:
        out = {}
        for row in node.select(css):
            cells = iter(row.find_all("th", "td"))
            for c in cells:
                if c.tag == "th" and (v := next(cells, None)) is not None:
                    out[value_of(c, key)] = value_of(v, value)
        return out

    return rule


def filled(rule: Rule) -> Rule:
    return lambda node: value_of(node, rule) or OMIT


def chain(*rules: Rule) -> Rule:
    return lambda node: [x for r in rules for x in value_of(node, r)]


def lines(sep: str = "\n") -> Rule:
    return lambda node: sep.join(s for s in map(str.strip, node.text("\n").splitlines()) if s)


def broken_lines(node: Node) -> list[str]:
    """The non-blank lines of an element whose lines end at <br>."""
    out, stack = [""], list(reversed(node.children))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            first, *rest = x.split("\n")
            out[-1] += first
            out += rest
        elif x.tag == "br":
            out.append("")
        else:
            stack += reversed(x.children)
    return [s for s in map(str.strip, out) if s]


def years(css: str, heading: str, bullet: str) -> Rule:
    """[{year, events}] of a block of lines: a heading opens a year, the lines below are its events; years without any go."""

    def rule(node: Node) -> list[dict]:
        out: list[dict] = []
        for s in broken_lines(node.first(css) or Node("", {}, None)):
            if found := re.match(heading, s):
                out.append({"year": found[1], "events": []})
            elif out:
                out[-1]["events"].append(s.lstrip(bullet).strip())
        return [x for x in out if x["events"]]

    return rule


# Containers, fields and selectors of the three sites' pages.
LAYOUTS: dict[str, tuple[str, Rule]] = {
    "a": ("", {
        "기업정보": {"회사명": line(".corpName"), "채용상태": line(".corpHeader .now")},
        "기업상세정보": terms(".corpInfo dl", line(), lambda dd: tidy(dd.text(" ", strip=True))),
        "소개": table("#infoTab article.corpDesc", line("h4.corpTit", drop="•ㆍ"), line(".contArea", "\n")),
        "기업뉴스": records("#newsTab .newslist li", {"제목": line(".tit", missing=None), "내용": line(".desc", missing=None), "날짜": line(".date", missing=None)}),
    }),
    "b": ("div.company-body-infomation", {
        "basic_info": headed("table.table-basic-infomation-primary tr.field", text(sep=" "), joined(".value, .salary-average-item, .reference", " | ")),
        "financial": table(".financial-analysis-card", text(".headers .header"), {
            "current_value": text(".revenue .value", missing=None),
            "history": filled(table(".chart .bar", text(".label"), text(".value"))),
        }),
        "history": chain(
            records(".corporate-history-list-item", {"year": text(".year"), "month": text(".month"), "events": every(".month-description")}, need="month", carry="year"),
            years("#devJKhistory", r"^(\d{4})년$", "- "),
        ),
        "employment": {
            "recruitments": records(".table-in-progress-announcement tbody tr", {"period": cell(0), "title": text(".title", missing=""), "details": cell(2, " | ")}, need="details"),
        },
        "benefits": table(".benefit-item-group .item", text(".benefit-header"), every(".benefit-body p")),
        "location": {"address": text(".working-environment-map .address"), "map_url": attribute(".btnMapApiL", "href")},
        "raw_text": lines(),
    }),
    "c": ("#wrap", {
        "company_name": text("h2.giHd"),
        "founded": fact(".corpInfo dl", 0, 4, text("strong")),
        "employee_count": fact(".corpInfo dl", 1, 4, text("strong")),
        "company_type": fact(".corpInfo dl", 2, 4, text("strong")),
        "revenue": fact(".corpInfo dl", 3, 4, text("strong")),
        "reasons_to_join": every(".corpInfo2 ul li"),
        "history": records(".history_cont > li", {"year": text("p", missing=""), "events": every("ul li", " ")}),
        "benefits": records(".culture_area > div", {"title": text(".culture_txt p", missing=""), "description": text(".culture_txt span", " ", "")}),
        "talents": records(".talent li", {"type": text("strong", missing=""), "description": text("p", " ", "")}),
        "address": text(".corMap_info dl dd", " "),
        "website": text(".corp_tel a"),
    }),
}


def read(page: Node, layout: str) -> dict:
    """The fields of a page of a layout; {} where its container is missing."""
    container, fields = LAYOUTS[layout]
    at = page.first(container) if container else page
    return {} if at is None else value_of(at, fields)
