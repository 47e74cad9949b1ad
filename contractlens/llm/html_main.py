"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block of text. Elements that never hold an article (scripts, styles, forms,
navigation, page footers, asides, adverts, notices, reader comments) are markup too. Where the page marks its article,
the lines are those of the article and no others. The running text of each line (outside links) is summed over a
sliding window; text starts where the sum surges and ends where it dives, at the line that carries the surge or the
dive itself: neighbours that only share a window with it are cut. Runs of text with other words between them belong
together, however short those are; only a window without any running text (a menu, a list of links) parts them.
"""

from __future__ import annotations

import html as htmllib
import re
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_text, table

WINDOW = 3  # lines summed
SURGE = 80  # characters in a window that mark running text
CARRIES = 40  # characters outside links that a line without a full stop needs to begin or end the text

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|</?([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>", re.S)
# Elements by their role.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object"}
DROP = RAW | {"head", "nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "audio", "video", "canvas"}
BLOCK = set("address article aside blockquote body br button center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adbox|banner|promo\w*|sponsor\w*|sidebar|side|menu|nav\w*|breadcrumbs?|cookies?|consent|notices?|alert|popup|modal|newsletter|subscribe|comments?|disqus|replies|reply|share|sharing|social|related|recommend\w*|footer|header|masthead|toolbar|widget|login|signup|search|pagination|pager|tags)(?:[\s_-]|$)",
    re.I,
)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
ATTR = re.compile(r"([A-Za-z_:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(raw)}


def _unwanted(name: str, raw: str, inside: bool) -> bool:
    if name in DROP or name == "header" and not inside:
        return True
    if name in ("article", "main") and not inside or name in ("body", "html", "b", "i", "em", "strong", *HEADINGS) or not raw.strip():
        return False
    a = _attributes(raw)
    return a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden") == "true" or bool(HINT.search(f"{a.get('class', '')} {a.get('id', '')}"))


class Line(NamedTuple):
    text: str
    size: int  # characters outside links
    place: int  # 2 inside an article, 1 inside the main element, else 0
    heading: bool = False


def lines_of(page: str) -> list[Line]:
    """The blocks of the page, in order."""
    tokens = list(TOKEN.finditer(page))
    closers: dict[int, int] = {}
    open_at: dict[str, list[int]] = {}
    for i, m in enumerate(tokens):
        name = (m[1] or "").lower()
        if not name or name in VOID:
            continue
        if m[0][1] != "/":
            open_at.setdefault(name, []).append(i)
        elif open_at.get(name):
            closers[open_at[name].pop()] = i
    out: list[Line] = []
    text, link, in_link, depth, heading = [], 0, 0, {"article": 0, "main": 0}, False

    def flush() -> None:
        nonlocal link
        s = " ".join(htmllib.unescape("".join(text)).split())
        if s:
            out.append(Line(s, max(0, len(s) - link), 2 if depth["article"] else int(depth["main"] > 0), heading))
        text.clear()
        link = 0

    at, i = 0, 0
    while i < len(tokens):
        m = tokens[i]
        if m.start() > at:
            piece = page[at : m.start()]
            text.append(piece)
            link += len(piece) * bool(in_link)
        at = max(at, m.end())
        name = (m[1] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                text.append(htmllib.escape(m[0][9:-3]))
            i += 1
            continue
        closing = m[0][1] == "/"
        if name in BLOCK:
            flush()
        if not closing and name not in VOID and _unwanted(name, m[2] or "", any(depth.values())):
            end = closers.get(i)
            if end is None and name in RAW:  # unclosed raw text runs to the end
                flush()
                return out
            if end is not None:
                i, at = end + 1, tokens[end].end()
                continue
        if name in depth:
            depth[name] = max(0, depth[name] + (-1 if closing else 1))
        elif name in HEADINGS:
            heading = not closing
        elif name == "a":
            in_link = 0 if closing else 1
        i += 1
    if at < len(page):
        text.append(page[at:])
    flush()
    return out


def runs_of(size: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """(first line, end line) between each surge, where the sum of a window comes to `surge`, and its dive, where it falls
    below. Runs that only windows with some text lie between are one."""
    sums = [sum(size[i : i + window]) for i in range(len(size))]
    out, at, dive = [], 0, 0
    while at < len(sums):
        if sums[at] < surge:
            at += 1
            continue
        start = at
        while at < len(sums) and sums[at] >= surge:
            at += 1
        end = min(len(size), at + window - 1)
        if out and all(sums[dive:start]):
            start = out.pop()[0]
        dive = at  # the first window after the run
        out.append((start, end))
    return out


#: How lines begin or end that follow an article and are no part of it.
CLOSING = re.compile(r"^\s*(?:©|\(c\)|copyright\b)|\ball rights reserved\b|^\s*(?:contact us|privacy policy|terms of (?:use|service))\b", re.I)
STOP = re.compile(r"[.!?…。！？:;][\"'”’»)\]]*$")


def carries(line: Line, surge: int = SURGE) -> bool:
    """Whether a line is running text itself: most of it outside links, a sentence or of some length, no closing notice."""
    if 2 * line.size < len(line.text) or CLOSING.search(line.text) and len(line.text) < 2 * surge:
        return False
    return line.size >= CARRIES or bool(STOP.search(line.text))


def _further(lines: list[Line], at: int, step: int, last: int) -> int:
    """The furthest line that carries text (or heads it) before a line without any: short first and last paragraphs whose
    windows come to no surge."""
    while 0 <= at < len(lines) and lines[at].size:
        if carries(lines[at]) or step < 0 and lines[at].heading:
            last = at
        at += step
    return last


def main_lines(lines: list[Line], window: int = WINDOW, surge: int = SURGE) -> list[str]:
    """The lines of the article. Marked lines are all of it. Else each run is cut to the lines that carry text, with
    headings before them and paragraphs too short for a surge beside them; the largest run stays, and others that hold two paragraphs. A page with too little text
    for any surge is taken whole."""
    place = max((x.place for x in lines), default=0)
    if place:
        return [x.text for x in lines if x.place == place]
    found = []
    for start, end in runs_of([x.size for x in lines], window, surge):
        while start < end and not carries(lines[start], surge):
            start += 1
        while start < end and not carries(lines[end - 1], surge):
            end -= 1
        if start < end:
            found.append((_further(lines, start - 1, -1, start), _further(lines, end, 1, end - 1) + 1))
    most = max((sum(x.size for x in lines[a:z]) for a, z in found), default=0)
    good = lambda part: sum(x.size for x in part) == most or sum(x.size >= surge and bool(STOP.search(x.text)) for x in part) > 1
    kept = [x.text for a, z in found if good(lines[a:z]) for x in lines[a:z]]
    return kept or [x.text for x in lines]


def extract(page: str | None) -> str:
    return " ".join(main_lines(lines_of(page))) if page else ""


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page. Null and empty pages have an empty text, pages with little text all
    of it; rows map one to one and repeated rows stay; null ids and urls pass; other columns are left aside."""

    def run(htmls: list[str | None]) -> list[tuple]:
        return [(t, len(t)) for t in map(extract, htmls)]

    return per_text(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), "html", run, "text string, n_chars long")


def op7_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
