"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped to lines: a line is the text of a block (paragraph, heading, list
item, cell, or what stands between breaks), and where a container begins or ends a
blank line stands. What is no running text is stripped with its markup: scripts,
styles, heads, menus, page headers and footers, asides, forms, hidden parts, parts
whose class, id or role names a menu, notice, advert or reader comments, what follows
a heading of reader comments in its container, and runs of list items that are links
only. A line weighs as many characters as it has outside links.

Weights are summed over windows of `window` lines. Text runs between the points where
the sums surge from zero and where they dive to zero again; a run is kept whole if its
highest sum reaches `surge` characters or, on a page of little text, `share` of the
page's highest sum. Where a page has article or main elements with text, the lines
outside them weigh nothing, and an article is one run. Sections that stand directly in
the body are runs of their own.

Pages are independent: no shuffle, and a page is read once from its start to its end.

Defined results: one row for each row of the table, so repeated rows and null ids stay;
null or empty html, or html without text, gives an empty text; an unclosed comment,
script or tag goes on to the end of the page; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kinmap.llm.text import bounded, tidy

WINDOW, SURGE, SHARE = 3, 80, 0.2

TAG = re.compile(r"""<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)((?>=\s*(?:"[^"]*"|'[^']*')|[^>])*+)>|[!?/][^>]*>)""")
ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"']+))?""")
CUT_TAG = re.compile(r"<[a-zA-Z/!?]")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Their content is text of no page, whatever it looks like.
RAW = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes", "noscript", "template", "svg", "math", "object", "canvas"}
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
CONTAINERS = {"html", "body", "div", "section", "article", "main", "header", "footer", "nav", "aside", "form", "table", "ul", "ol", "dl", "center", "fieldset", "details", "dialog", "menu", "search", "head"}
BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "tr", "thead", "tbody", "tfoot", "caption", "pre", "blockquote", "figure", "figcaption", "address", "summary", "hgroup", "legend", "option", "br", "hr"}
#: Inline elements that may be adverts or hidden, or are links; others are not followed.
INLINE = {"a", "span", "button", "select", "label", "ins"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: An element of the key ends an open one of the value when it begins.
ENDS = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"}, "option": {"option"}}
NO_TEXT = {"head", "nav", "footer", "aside", "form", "dialog", "menu", "button", "select", "fieldset", "search", "option"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu", "menubar", "toolbar", "status"}
#: Words of class and id that name something else than the text.
ASIDE = set(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs masthead topbar sidebar sidenav rail widget widgets toolbar "
    "footer footnav copyright colophon cookie cookies consent gdpr privacy notice notices banner popup modal overlay lightbox "
    "ad ads advert adverts advertisement advertising adsense adslot adbox adsbygoogle sponsor sponsored sponsors promo promos promotion promoted "
    "newsletter subscribe subscription signup signin login register search share sharing social follow related recommended recommendations teaser "
    "teasers comment comments commentlist respond response responses reply replies disqus discussion guestbook pagination pager paging skip hidden taboola outbrain".split()
)
#: An article or main element is something else only if a name of it begins with one of these.
ASIDE_ARTICLE = {"comment", "comments", "reply", "ad", "ads", "advert", "advertisement", "sponsored", "promo", "teaser", "related", "widget"}
#: Names that begin so tell of what an element has beside it.
TELLS_OF = {"has", "no", "with", "without"}
OF_ARTICLE = {"article", "post", "entry", "story"}
TALK = re.compile(
    r"(?:\d+\s+)?(?:(?:reader|readers|user|visitor|leave|post|write|add|your|a|all|latest|recent)(?:['’]s?|s['’])?\s+)*(?:comments?|replies|reply|responses)(?:\s*[:(]?\s*\d*\)?)?"
    r"|(?:\d+\s+)?(?:leser|nutzer)?kommentare?(?:\s*\(?\d*\)?):?|(?:\d+\s+)?commentaires?(?:\s+des\s+lecteurs)?(?:\s*\(?\d*\)?)\s?:?|(?:\d+\s+)?comentarios?(?:\s+de\s+(?:los\s+)?lectores)?(?:\s*\(?\d*\)?):?",
    re.I,
)


def attributes(text: str) -> dict[str, str]:
    """The first value of each attribute, names lowered."""
    out: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), references.unescape(value.strip("\"'")))
    return out


def is_aside(name: str, text: str, in_article: bool) -> bool:
    """Whether an element holds something else than running text."""
    if name in NO_TEXT or (name == "header" and not in_article):
        return True
    if not text or text.isspace() or name in ("html", "body"):
        return False
    found = attributes(text)
    style = found.get("style", "").replace(" ", "").lower()
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style:
        return True
    if found.get("role", "").lower() in ROLES:
        return True
    names = [[w.lower() for w in WORD.findall(n)] for key in ("class", "id") for n in found.get(key, "").split()]
    names = [n for n in names if n and n[0] not in TELLS_OF]
    if name in ("article", "main"):
        return any(n[0] in ASIDE_ARTICLE for n in names)
    words = {w for n in names for w in n}
    if "header" in words and name not in HEADINGS and not words & OF_ARTICLE and not in_article:
        return True
    return bool(words & ASIDE)


class Line(NamedTuple):
    text: str  # empty for a blank line
    weight: int
    inside: bool  # in an article or main element
    item: bool  # a list item that is a link and no more


BLANK = Line("", 0, False, False)


class Lines:
    """The lines of a page, in page order."""

    def __init__(self) -> None:
        self.rows: list[Line] = []
        self.pieces: list[str] = []
        self.linked = 0

    def add(self, piece: str, in_link: bool) -> None:
        piece = references.unescape(piece) if "&" in piece else piece
        self.pieces.append(piece)
        if in_link:
            self.linked += len(piece.strip())

    def end(self, inside: bool, item: bool) -> str:
        """The line so far ends; its text."""
        line = " ".join("".join(self.pieces).split())
        if line:
            weight = max(0, len(line) - self.linked)
            self.rows.append(Line(line, weight, inside, item and weight * 10 <= len(line)))
        self.pieces, self.linked = [], 0
        return line

    def blank(self, times: int) -> None:
        self.rows += [BLANK] * times


def stripped(page: str, window: int = WINDOW) -> Lines:
    """The page without markup and asides."""
    lines = Lines()
    stack: list[tuple[str, bool]] = []  # open elements that are followed, and whether each is an aside
    open_now: Counter[str] = Counter()
    asides = links = articles = items = 0
    at, stop = 0, page.rfind(">") + 1
    silenced = -1  # reader comments go on while the stack is so deep

    def close(depth: int) -> None:
        nonlocal asides, links, articles, items, silenced
        while len(stack) > depth:
            name, aside = stack.pop()
            open_now[name] -= 1
            asides -= aside
            links -= name == "a"
            articles -= name in ("article", "main")
            items -= name == "li"
        if len(stack) < silenced:
            silenced = -1

    while at < stop:
        found = TAG.search(page, at, stop)
        if found is None:
            break
        quiet = asides or silenced >= 0
        if found.start() > at and not quiet:
            lines.add(page[at : found.start()], links > 0)
        at = found.end()
        if found.group(1):  # a comment
            ends = page.find("-->", found.end() - 2)
            at = len(page) if ends < 0 else ends + 3
            continue
        name = (found.group(3) or "").lower()
        if not name:
            continue
        opens = not found.group(2)
        if name in RAW:
            if opens:
                ends = RAW_END[name].search(page, at)
                at = len(page) if ends is None else ends.end()
            continue
        breaks = name in CONTAINERS or name in BLOCKS
        if not breaks and name not in INLINE:
            continue
        if breaks:
            line = lines.end(articles > 0, items > 0)
            if line and not opens and name in HEADINGS and TALK.fullmatch(line) and silenced < 0:
                lines.rows.pop()
                names = [x for x, _ in stack]
                silenced = len(names) - names[::-1].index(name) - 1 if name in names else len(names)
        if opens:
            if breaks and stack and stack[-1][0] in ("p", *HEADINGS) and name not in ("br",):
                close(len(stack) - 1)
            ended = ENDS.get(name)
            while ended and stack and stack[-1][0] in ended:
                close(len(stack) - 1)
            if name in VOID:
                continue
            aside = is_aside(name, found.group(4), articles > 0)
            if name in CONTAINERS and not quiet and not articles:
                lines.blank(window if name in ("article", "main") or not stack or stack[-1][0] in ("body", "html") else 1)
            stack.append((name, aside))
            open_now[name] += 1
            asides += aside
            links += name == "a"
            articles += name in ("article", "main")
            items += name == "li"
        else:
            if not open_now[name]:
                continue
            depth = len(stack) - 1
            while stack[depth][0] != name and (name in CONTAINERS or stack[depth][0] not in CONTAINERS):
                depth -= 1
            if stack[depth][0] != name:  # an inline or block element does not end beyond its container
                continue
            close(depth)
            if name in CONTAINERS and not articles and not asides and silenced < 0:
                lines.blank(window if name in ("article", "main") or not stack or stack[-1][0] in ("body", "html") else 1)
    if at < len(page) and not (asides or silenced >= 0):
        tail = page[at:]
        cut = CUT_TAG.search(tail)
        lines.add(tail[: cut.start()] if cut else tail, links > 0)
    lines.end(articles > 0, items > 0)
    return lines


def without_menus(rows: list[Line]) -> list[Line]:
    """The lines but for runs of three and more list items that are links."""
    out: list[Line] = []
    for item, run in groupby(rows, key=lambda row: row.item or row == BLANK):
        run = list(run)
        out += run if not item or sum(row.item for row in run) < 3 else [row for row in run if not row.item]
    return out


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE, share: float = SHARE) -> str:
    """The text between the surge and dive points of the page's lines."""
    rows = without_menus(stripped(page or "", window).rows)
    if any(row.weight for row in rows if row.inside):
        rows = [row if row.inside else BLANK for row in rows]
    text, weight, n = [row.text for row in rows], [row.weight for row in rows], len(rows)
    # A page may be of links alone: then its lines count as they stand.
    if not any(weight):
        weight = [len(t) for t in text]
    sums, total = [0] * n, 0
    for k in range(n - 1, -1, -1):
        total += weight[k] - (weight[k + window] if k + window < n else 0)
        sums[k] = total
    least = min(surge, share * max(sums, default=0))
    kept: list[str] = []
    k = 0
    while k < n:
        if not sums[k]:
            k += 1
            continue
        first = k  # the surge
        while k < n and sums[k]:
            k += 1
        if max(sums[first:k]) >= least:  # the dive: k
            kept += [t for t in text[first:k] if t]
    return " ".join(kept)


def main_texts(pages: DataFrame, window: int = WINDOW, surge: int = SURGE, share: float = SHARE) -> DataFrame:
    """page_id, url, text and n_chars of every row of `pages`."""
    schema = pages.select("page_id", "url").schema

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py(), window, surge, share) for p in batch.column("html")]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    return bounded(pages).select("page_id", "url", "html").mapInArrow(tidy(extract), f"{fields}, text string, n_chars long")


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
