"""Main text of web pages by line-block distribution.

Markup is stripped so that every block element becomes one line.  Parts that
their element or class names as no article text (menus, adverts, forms ...)
leave blank lines unless the lines around them have one parent, as do the edges
of containers.  The text lengths of the
lines are summed over a sliding window: where a sum surges above a threshold
the text begins, where the sum dives to zero it ends, and every line between
is kept, however short.  Where the page marks its article, the mark bounds the
text: all lines in it are kept and no others, unless the distribution has a
span outside that holds much more text; then the mark is taken for no mark.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritext.llm.shared import text_or_empty

#: Lines of a window, and the sum at which it surges.
WINDOW, SURGE = 3, 80
#: Without a marked article, spans shorter than this share of the longest are sidebars and the like.
SPAN_SHARE = 0.2
#: A marked article is believed if its text, so many times, is not shorter than the longest span outside.
MARK_WEIGHT = 2

#: Element kinds of HTML, as words (fixed values of the standard).
#: Content of these is no text of the page, or what a browser shows in their place is none; a line runs on past them.
RAW = set("script style textarea title xmp iframe noembed noframes noscript template svg canvas audio video select annotation annotation-xml".split())
BOILERPLATE = set("nav footer aside form button dialog menu fieldset".split())
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
             "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td "
             "tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Words of a class, id or role that name a part which is no article text.
NAMES = set("ad ads adbox adslot adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs captcha comment comments "
            "complementary consent contentinfo cookie cookies copyright dialog discussion disqus footer gdpr login masthead menu menubar modal "
            "nav navbar navigation newsletter notice notices notification pager pagination popup promo promotion recommended related replies "
            "respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar widget widgets".split())
#: Blocks that hold one line as a rule, and those that are the page.
LEAVES = set("address caption dd dt figcaption h1 h2 h3 h4 h5 h6 legend li option p pre summary td th body html".split())
HEADER_NAMES = {"header", "topbar"}
#: Of these, the ones that name ordinary sections too: they need links or form fields in the part.
TOPICS = set("consent dialog discussion login masthead menu navigation notice notices notification promotion recommended related replies respond "
             "search share sharing skip social sponsor subscription teaser advertising copyright banner".split())
#: The ones that an id alone says inside the article, where ids are mostly slugs of headings.
IDS = set("ad ads adbox adslot adsense comment comments disqus sidebar breadcrumb breadcrumbs pagination newsletter".split())
#: Words that make compounds with those names.
FILLERS = set("area bar block body box button buttons container form group holder inner item items link links list row slot space unit wrap wrapper".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
FIELDS = {"form", "input", "button", "textarea", "select"}
CONTAINERS = {"article", "main"}
#: Class, id or role of an article element that is a reader's comment or the like, as a whole or as the first word of a compound.
NO_ARTICLES = set("comment comments reply replies respond disqus discussion sidebar advert advertisement ad ads sponsored promo complementary "
                  "related recommended newsletter".split())
NO_ARTICLE = re.compile(rf"(?:{'|'.join(sorted(NO_ARTICLES))})(?:[-_]+(?:\d+|area|block|body|box|card|content|entry|item|list|post|thread|wrapper))*")

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"      # a tag with whole quotes
    r"|<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)(?:>|(?=<)|\Z)"                         # a tag whose quote or end is missing
    r"|<[!?/][^>]*+(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
WORDS = re.compile(r"[a-z0-9]+")


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(source)}


def _names(tokens: str, in_article: bool) -> set[str]:
    """The listed words that tokens are made of: any word of them, inside the
    article only whole tokens and compounds of names, fillers and numbers."""
    found = set()
    for token in tokens.lower().split():
        words = set(WORDS.findall(token))
        if not in_article or all(w in NAMES or w in FILLERS or w[0].isdigit() for w in words):
            found |= words & NAMES
    return found


def _is_boilerplate(name: str, source: str, in_article: bool, supported: Callable[[], bool]) -> bool:
    if name in BOILERPLATE or name == "header" and not in_article:
        return True
    if name in ("html", "body") or not source.strip(" /\n"):
        return False
    a = _attributes(source)
    if name in CONTAINERS:
        named, ids = f"{a.get('class', '')} {a.get('role', '')}".lower().split(), a.get("id", "").lower().split()
        return any(NO_ARTICLE.fullmatch(t) for t in named + [t for t in ids if t.startswith(("comment", "reply", "disqus"))])
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", "")):
        return True
    classes = f"{a.get('class', '')} {a.get('role', '')}".lower()
    named = _names(classes, in_article)
    ids = set() if name in HEADINGS else _names(a.get("id", ""), in_article)
    if not in_article and HEADER_NAMES & set(WORDS.findall(classes if name in HEADINGS else f"{classes} {a.get('id', '').lower()}")):
        return True
    sure = named - TOPICS or (ids & IDS if in_article else ids - TOPICS or NAMES & set(classes.split()))
    return bool(sure) or bool(named | ids) and supported()


class _Lines:
    """The page as lines: text, length for the distribution, whether in the marked article."""

    def __init__(self) -> None:
        self.texts: list[str] = []
        self.lengths: list[int] = []
        self.inside: list[bool] = []
        self.parents: list[tuple[int, int, bool]] = []     # the line's parent and its parent (see Parents)
        self.parent = (0, 0, True)
        self.skipped = False                               # whether a part was left out since the last line
        self.parts: list[str] = []
        self.linked = 0

    def add(self, text: str, link: bool) -> None:
        if text:
            text = html_lib.unescape(text) if "&" in text else text
            self.parts.append(text)
            if link:
                self.linked += len(text.strip())

    def end(self, inside: bool, gap: bool = False) -> None:
        """End of a line; with ``gap`` a window of blank lines follows."""
        text = " ".join("".join(self.parts).split())
        if text:
            if self.skipped and self.parents and not together(self.parents[-1], self.parent):
                self.gap(inside)
            self.skipped = False
            self.texts.append(text)
            self.parents.append(self.parent)
            self.lengths.append(max(1, len(text) - 2 * self.linked) if 2 * self.linked <= len(text) else 0)
            self.inside.append(inside)
        if gap:
            self.gap(inside)
        self.parts, self.linked = [], 0

    def gap(self, inside: bool) -> None:
        if self.lengths and self.lengths[-WINDOW:] != [0] * WINDOW:
            self.texts += [""] * WINDOW
            self.lengths += [0] * WINDOW
            self.inside += [inside] * WINDOW
            self.parents += self.parents[-1:] * WINDOW


def together(a: tuple[int, int, bool], b: tuple[int, int, bool]) -> bool:
    """Whether two lines have one parent, or the one's parent lies right in the other's, the body aside."""
    return a[0] == b[0] or not b[2] and a[1] == b[0] or not a[2] and b[1] == a[0]


class Parents:
    """The open elements that can hold several lines; ``of`` is (number of the
    innermost, of the one around it, whether the innermost is the page's body)."""

    def __init__(self) -> None:
        self.open: list[tuple[str, int]] = []
        self.count, self.names = 0, Counter()
        self.of = (0, 0, True)

    def tag(self, name: str, closing: str) -> None:
        if not closing:
            self.count += 1
            self.names[name] += 1
            self.open.append((name, self.count))
        elif self.names[name]:
            last = ""
            while last != name:
                last, _ = self.open.pop()
                self.names[last] -= 1
        inner, outer = ([("", 0)] * 2 + self.open[-2:])[:-3:-1]
        self.of = (inner[1], outer[1], not inner[0])


class _Tags(list):
    """The page's tags: (start, end, closing, name, source); a raw element is one tag up to its end."""

    def __init__(self, page: str) -> None:
        pos, size = 0, len(page)
        self.page, self.sums = page, None
        self.unclosed: dict[str, list[int]] = {}           # by name, places of start tags without an end tag
        while pos < size:
            m = TOKEN.search(page, pos)
            if not m:
                break
            pos = m.end()
            closing, name, source = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            name = (name or "").lower()
            if not closing and name in RAW and not source.endswith("/"):
                close = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.I).search(page, pos)
                pos = close.end() if close else size
            elif closing and self.unclosed.get(name):
                self.unclosed[name].pop()
            elif not closing and name and name not in VOID and not source.endswith("/"):
                self.unclosed.setdefault(name, []).append(len(self))
            self.append((m.start(), pos, closing, name, source))

    def supported(self, i: int) -> bool:
        """Whether the part of tag i has form fields, or half of its text in links."""
        if self.sums is None:
            self.sums, links, row, at = [], False, [0, 0, 0], 0          # text, linked text and fields before each tag
            opened: dict[str, list[int]] = {}
            self.ends: dict[int, int] = {}
            for k, (start, end, closing, name, _) in enumerate(self):
                text = len("".join(self.page[at:start].split()))
                row = [row[0] + text, row[1] + text * links, row[2]]
                self.sums.append(tuple(row))
                at = end
                if name == "a":
                    links = not closing
                if closing and opened.get(name):
                    self.ends[opened[name].pop()] = k
                elif not closing and name and name not in VOID:
                    opened.setdefault(name, []).append(k)
                row[2] += name in FIELDS and not closing
        if i not in self.ends:
            return False
        text, linked, fields = (b - a for a, b in zip(self.sums[i], self.sums[self.ends[i]], strict=True))
        return fields > (self[i][3] in FIELDS) or 2 * linked > text

    def lacks_end(self, i: int) -> bool:
        """Whether the end tag of tag i is missing, or may be as an element of its name around it has none."""
        left = self.unclosed.get(self[i][3])
        return bool(left) and left[0] <= i


def lines_of(page: str) -> _Lines:
    """Strip the markup of a page."""
    out, at, links = _Lines(), 0, 0
    skipped, depth, cut = "", 0, False      # the boilerplate element we are in, how many of its name are open, if its end is missing
    containers: list[str] = []              # open article and main elements
    tags, parents = _Tags(page), Parents()
    for i, (start, end, closing, name, source) in enumerate(tags):
        if not skipped:
            out.add(page[at:start], links > 0)
        at = end
        if not name:                        # comment, doctype
            continue
        if not closing and name in RAW and not source.endswith("/"):
            continue
        if name == "head":
            skipped, depth, cut = ("", 0, False) if closing else ("head", 1, True)
            continue
        if skipped and not closing and (name == "body" and skipped == "head" or name in CONTAINERS and not containers and cut):
            skipped = ""
        if skipped:
            if name == skipped and not source.endswith("/"):
                depth += -1 if closing else 1
                if not depth:
                    skipped = ""
                    out.skipped = not containers
            continue
        if name == "a":
            links = 0 if closing else 1
        elif name == "br":
            out.parts.append(" ")
        elif not closing and name not in VOID and _is_boilerplate(name, source, bool(containers), lambda: tags.supported(i)):  # noqa: B023
            out.end(bool(containers))
            out.skipped = out.skipped or not containers
            skipped, depth, cut = name, 1, tags.lacks_end(i)
        elif name in CONTAINERS:
            out.end(bool(containers), gap=True)
            if not closing:
                containers.append(name)
            elif name in containers:
                while containers.pop() != name:
                    pass
        elif name in BLOCKS:
            links = 0
            out.end(bool(containers), gap=False)
        if not skipped and name in BLOCKS and name not in LEAVES:
            parents.tag(name, closing)
            out.parent = parents.of
    if not skipped:
        out.add(page[at:], links > 0)
    out.end(bool(containers))
    return out


def spans(lengths: list[int], surge: int = SURGE, window: int = WINDOW) -> list[tuple[int, int]]:
    """Spans of lines from a surge of the window sums to the dive after it."""
    n, found, i = len(lengths), [], 0
    sums = [sum(lengths[k:k + window]) for k in range(n)]
    while i < n:
        if sums[i] >= surge:
            start = i
            while i < n and sums[i]:
                i += 1
            while start < i and not lengths[start]:
                start += 1
            found.append((start, i))
        i += 1
    return found


def with_lead(lines: _Lines, lengths: list[int], start: int) -> int:
    """The start of a span moved up over short lines of the same parent, past
    linked lines right below it (a list of contents, say) of a window at most."""
    parent, first, i, between = lines.parents[start][0], start, start - 1, 0
    while i >= 0 and lines.texts[i] and between <= WINDOW:
        if lines.parents[i][0] == parent and lengths[i]:
            first, between = i, 0
        elif parent in lines.parents[i][:2]:
            between += 1
        else:
            break
        i -= 1
    return first


def main_text(page: str) -> str:
    """The article's blocks, one a line."""
    lines = lines_of(page)
    lengths = lines.lengths
    marked = any(x and t for x, t in zip(lines.inside, lines.texts, strict=True))
    if marked:
        outside = [0 if x else n for n, x in zip(lengths, lines.inside, strict=True)]
        rival = max((sum(outside[a:b]) for a, b in spans(outside)), default=0)
        marked = MARK_WEIGHT * (sum(lengths) - sum(outside)) >= rival
    if marked:                              # within the marked article a linked line is text as well
        lengths = [max(n, len(t)) if x else 0 for n, t, x in zip(lengths, lines.texts, lines.inside, strict=True)]
    found = spans(lengths) if not marked else spans(lengths, surge=1)
    if not found:                           # nothing surges: the run of lines with the most text
        found = spans(lengths, surge=1)
        found = [max(found, key=lambda s: sum(lengths[s[0]:s[1]]))] if found else []
    kept = found
    if not marked:                          # spans of one container count as one
        groups: list[list[tuple[int, int]]] = []
        for span in found:
            if groups and together(lines.parents[groups[-1][-1][1] - 1], lines.parents[span[0]]):
                groups[-1].append(span)
            else:
                groups.append([span])
        sums = [sum(sum(lengths[a:b]) for a, b in g) for g in groups]
        kept = [s for g, n in zip(groups, sums, strict=True) if n >= SPAN_SHARE * max(sums) for s in g]
        ends = [0] + [b for _, b in kept]
        kept = [(max(end, with_lead(lines, lengths, a)), b) for end, (a, b) in zip(ends, kept)]
    return "\n".join(t for a, b in kept for t in lines.texts[a:b] if t)


def with_main_text(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` with ``out_col``: the main text of the whole page.

    White space inside a block is one space, blocks are joined by a newline in
    page order, character references are decoded.  Null or empty html, and a
    page without article text, give "".  Broken markup never fails: a cut tag,
    an unclosed quote or element ends where the next tag or the page does.
    Repeated rows are extracted each on its own; other columns pass through,
    and a column already called ``out_col`` is replaced.
    """
    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages_ in batches:
            yield pd.Series([main_text(p) for p in pages_], dtype=object)

    return pages.withColumn(out_col, extract(text_or_empty(html_col)))
