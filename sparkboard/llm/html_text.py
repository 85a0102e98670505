"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block of text. A line's length is what it
has outside links, white space not counted; lines inside elements that certainly hold
no article (menus, forms, adverts and so on) have length 0. Where a page marks its
articles, the lines are those of the article elements, else those of the main
element, else those of the containers whose text is dense (below). Lengths are summed
over sliding windows of ``WINDOW`` lines. Text surges where the sum rises from 0 and dives where it is back at 0; from each surge to
its dive, the lines from the first to the last with a length are kept. So one or two
lines of links between others stay, and a list of links goes. No stretch is too short:
a short section after such a list is article too.

On a page that marks no article, the distribution of the sums decides which containers
(``CONTAINERS``) hold it: each one's windows over its own lines, those of containers
inside it left out, have a largest sum. It is article if that is at least ``SHARE`` of the
largest on the page; so is everything inside it. Footers, notices and adverts that say
so nowhere are containers of little text and go by this. A page whose text lies in its
body itself, or in one container, keeps all of it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

WINDOW = 3
SHARE = 0.25

_MARKUP = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z]|/)")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_END = re.compile(r">|=\s*+([\"'])")
_NAMES = re.compile(r"""(?<![^\s"'/])(class|id|role|aria-hidden|hidden|style)(?=[\s=/]|$)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Fixed values of the HTML standard and of common practice.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math select".split())
CLOSED_BY = {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option", "p")}
CONTAINERS = frozenset("article aside center details div footer header main section".split())
JUNK_ELEMENTS = frozenset("nav footer aside form button label fieldset legend dialog menu head object canvas audio video".split())
JUNK_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus reply replies respond discussion share sharing social related recommended recommendations pagination pager search searchbox form widget skip complementary contentinfo masthead topbar toolbar".split()
)
#: Words that say nothing beside a name of junk: "post-comments" and "sidebar-left" are junk, "social-policy" is not.
NEUTRAL_NAMES = frozenset("article articles post posts entry story stories content main page site blog global area bar block body box button buttons col column container group inner item items left link links list outer panel right row section text title top bottom wrap wrapper".split())
HEADER_NAMES = frozenset("header masthead page site global top main wrap wrapper container inner bar".split())

_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


def _tag_end(page: str, at: int, missing: set[str]) -> int:
    """Where the tag that is open at ``at`` ends, after its bracket; -1 if it does not end.

    Brackets inside quoted values do not end it. A quote that is never closed counts as
    none; ``missing`` holds the quotes that do not come up again, so each is missed once.
    """
    while m := _END.search(page, at):
        if not m[1]:
            return m.end()
        close = -1 if m[1] in missing else page.find(m[1], m.end())
        if close < 0:
            missing.add(m[1])
            return page.find(">", m.end()) + 1 or -1
        at = close + 1
    return -1


def _events(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", name, attributes) and ("close", name, "") in one forward pass."""
    at, missing = 0, set()
    while m := _MARKUP.search(page, at):
        if m.start() > at:
            yield "text", page[at : m.start()], ""
        if m[0] == "<!--":
            end = page.find("-->", m.start() + 2)
            at = end + 3 if end >= 0 else len(page)
        elif m[0][-1] in "!?/":
            at = page.find(">", m.end()) + 1 or len(page)
        else:
            name = _NAME.match(page, m.end() - 1)
            end = _tag_end(page, name.end(), missing)
            if end < 0:
                return
            at, tag, attributes = end, name[0].lower(), page[name.end() : end - 1]
            if m[0][1] == "/":
                yield "close", tag, ""
            elif tag in RAW:
                if not (tag in ("svg", "math") and attributes.endswith("/")):
                    close = _RAW_END[tag].search(page, at)
                    at = close.start() if close else len(page)
            else:
                yield "open", tag, attributes
    if at < len(page):
        yield "text", page[at:], ""


def _named(attributes: str) -> tuple[list[frozenset[str]], bool]:
    """The words of each class, id and role, and whether the element is hidden."""
    names: list[frozenset[str]] = []
    hidden = False
    for name, a, b, c in _NAMES.findall(attributes):
        value, name = a or b or c, name.lower()
        if name in ("class", "id", "role"):
            names += [frozenset(w.lower() for w in _PARTS.findall(x)) for x in value.split()]
        else:
            hidden = hidden or name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and bool(_INVISIBLE.search(value))
    return names, hidden


def _is_junk(words: frozenset[str]) -> bool:
    """A name is junk if all its words are, or say nothing, and one is."""
    return bool(words & JUNK_NAMES) and all(w in JUNK_NAMES or w in NEUTRAL_NAMES or w.isdigit() for w in words)


def lines(page: str) -> list[tuple[str, int, int]]:
    """(text, length outside links, article) of each block; one of junk has no text and length 0.

    article is 1 in an article element, 0 in one with a name of junk, -1 in a main element, -2 for none.
    """
    return [x[:3] for x in _placed_lines(page)[0]]


def _placed_lines(page: str) -> tuple[list[tuple[str, int, int, int]], list[int]]:
    """``lines`` with the number of the container around each, and the container around each container (0: the page, in itself)."""
    out: list[tuple[str, int, int, int]] = []
    around = [0]
    stack: list[tuple[str, bool, int, bool, int]] = [("", False, -2, False, 0)]  # element, junk, article, link, container
    place = 0
    opened: Counter[str] = Counter()
    text: list[str] = []
    free = 0
    some = False  # text, junk too, since the last line

    def flush(article: int) -> None:
        nonlocal free, some
        if some:
            out.append((" ".join("".join(text).split()), free, article, place))
        text.clear()
        free, some = 0, False

    def close(k: int) -> None:
        while len(stack) > k:
            name, junk, article, _, _ = stack.pop()
            opened[name] -= 1
            if name in BLOCK or junk != stack[-1][1] or article != stack[-1][2]:
                flush(article)

    def innermost(names: tuple[str, ...], border: bool) -> int:
        """The place of the innermost open element of ``names``, with ``border`` inside no other block; 0 if there is none."""
        if any(opened[n] for n in names):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in names:
                    return k
                if border and stack[k][0] in BLOCK:
                    break
        return 0

    for kind, name, attributes in _events(page):
        _, junk, article, link, inner = stack[-1]
        if kind == "text":
            if not name.isspace():
                some, place = True, inner
            if not junk:
                piece = html.unescape(name) if "&" in name else name
                text.append(piece)
                if not link:
                    free += sum(map(len, piece.split()))
            continue
        if kind == "close":
            if k := innermost((name,), False):
                close(k)
            elif name in BLOCK:
                flush(article)
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in BLOCK:
            flush(article)
            while k := innermost(CLOSED_BY.get(name, ("p",)), True):  # elements that this one ends without a tag
                close(k)
            _, junk, article, link, inner = stack[-1]
        if name in VOID:
            continue
        if not junk:
            names, junk = _named(attributes) if attributes else ([], False)
            named = any(map(_is_junk, names))
            inside = article >= 0
            is_article = name == "article" or any(w == {"article"} or w == {"article", "body"} for w in names)
            if name in JUNK_ELEMENTS or named and (inside or not is_article) and name not in ("html", "body", "main"):
                junk = True
            elif not inside and (name == "header" or any("header" in w and w <= HEADER_NAMES for w in names)) and name not in ("html", "body", "main"):
                junk = True
            if not junk and is_article and not inside:
                article = 0 if named else 1
            elif not junk and article == -2 and (name == "main" or name != "body" and any(w == {"main"} or w == {"main", "content"} for w in names)):
                article = -1
        if junk != stack[-1][1] or article != stack[-1][2]:
            flush(stack[-1][2])
        if name in CONTAINERS:
            around.append(inner)
            inner = len(around) - 1
        stack.append((name, junk, article, link or name == "a", inner))
        opened[name] += 1
    close(1)
    flush(-2)
    return out, around


def _dense(found: list[tuple[str, int, int, int]], around: list[int]) -> list[tuple[str, int, int, int]]:
    """The lines of containers with a window of at least ``SHARE`` of the page's largest, and of those inside them."""
    lengths: dict[int, list[int]] = {}
    for _, n, _, place in found:
        lengths.setdefault(place, []).append(n)
    peaks = {place: max(_sums(own)) for place, own in lengths.items()}
    least = max(peaks.values(), default=0) * SHARE
    dense: list[bool] = []
    for place, outer in enumerate(around):  # a container comes after the one around it
        dense.append(peaks.get(place, -1) >= least or place > 0 and dense[outer])
    return [x for x in found if dense[x[3]]]


def _sums(lengths: list[int]) -> list[int]:
    return [sum(lengths[i : i + WINDOW]) for i in range(len(lengths))]


def stretches(lengths: list[int]) -> list[tuple[int, int]]:
    """(from, to) of the lines to keep, for each surge and its dive: from the first line
    with a length to the last one."""
    n = len(lengths)
    sums = _sums(lengths)
    found, i = [], 0
    while i < n:
        if not sums[i]:
            i += 1
            continue
        surge = i
        while i < n and sums[i]:
            i += 1
        own = [k for k in range(surge, i) if lengths[k]]
        found.append((own[0], own[-1] + 1))
    return found


def main_text(page: str | None) -> str:
    """The article's text, its blocks joined by spaces; empty if there is none."""
    found, around = _placed_lines(page or "")
    inside = max((x[2] for x in found if x[0]), default=-2)
    own = [x for x in found if x[2] == inside]
    if inside == -2:
        own = _dense(own, around)
    return " ".join(x[0] for a, b in stretches([x[1] for x in own]) for x in own[a:b] if x[0])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``, from its whole html.

    A null or empty page, and one without text, has an empty text. A page of any length
    is read in one forward pass; markup that does not end is left out to the page's end.
    Repeated rows come out as often; other columns play no part; an empty table gives an
    empty table.
    """
    small_batches(pages.sparkSession)
    kind = dict(pages.dtypes)
    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(_extracted, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")
