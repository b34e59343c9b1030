"""Providers of pages that the executors of tests import."""

from pathlib import Path


def scripted(query, start, end, page, options):
    """Pages by query; calls are noted in a file."""
    with open(options["log"], "a") as f:
        f.write(f"{query} {start} {end} {page}\n")
    item = lambda u: {"title": f"t {u}", "url": u, "mirror_url": None, "press": "p", "snippet": "s", "dates": ["입력", "2024.01.02."]}
    if query == "two":  # the third page is the second once more
        return [item(f"u{min(page, 2)}-{i}") for i in range(5)]
    if query == "part":  # the last page but one has one new article of five
        return [item(f"u{page}-{i}" if page == 1 or i == 0 else f"u1-{i}") for i in range(5)]
    if query == "endless":
        return [item(f"u{page}-{i}") for i in range(2)]
    if query == "html":
        return PAGE if page == 1 else '<div id="notfound" class="api_noresult_wrap"></div>'
    calls = Path(options["log"]).read_text().count(f"{query} {start} {end} {page}\n")
    if query == "throttled":
        return [] if page > 1 else ("" if calls < 3 else [item("late")])
    if query == "broken":
        if page == 2:
            raise OSError("no route")
        return [item("kept")]
    return []


PAGE = """<div class="fds-news-item-list-tab"><div><a data-heatmap-target=".tit" href="http://n/1"><span class="sds-comps-text-type-headline1">Title</span></a>
<span class="sds-comps-profile-info-title-text">Press</span><span class="sds-comps-profile-info-subtext">3일 전</span><span class="sds-comps-text-type-body1">Snip</span></div></div>"""
