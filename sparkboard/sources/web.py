"""Web pages: main content, links, tables, feeds, Markdown; format by content type and head."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..batches import released, small_batches

_SKIP = {"script", "style", "noscript", "template", "svg", "iframe", "nav", "footer", "aside", "form", "button", "header"}
_JUNK = re.compile(r"(^|[\s_-])(menu|nav|sidebar|cookie|banner|ads?|advert|share|social|comments?|breadcrumb|newsletter|popup|modal)([\s_-]|$)", re.I)
_TEXT = {"p", "h1", "h2", "h3", "h4", "li", "blockquote", "pre", "td", "th", "figcaption"}
_HOLDERS = {"article", "main", "section", "div", "body"}
_VOID = set("area base br col embed hr img input link meta source track wbr".split())


class _Page(HTMLParser):
    """Collects headings, paragraphs with their holders, links and tables of one page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int]] = []
        self.skip = 0
        self.title, self.description = "", ""
        self.headings: list[tuple[int, str]] = []
        self.blocks: list[tuple[str, str, tuple[int, ...], int]] = []  # tag, text, holders, characters in links
        self.links: list[tuple[str, str]] = []
        self.tables: list[dict] = []
        self.open_tables: list[dict] = []
        self.holders: list[tuple[int, str]] = []
        self.kinds: dict[int, str] = {}
        self.held: list[str] | None = None
        self.tag, self.linked, self.link, self.link_text = "", 0, "", []
        self.n = 0

    def flush(self) -> None:
        if self.held is not None:
            text = " ".join("".join(self.held).split())
            if text:
                self.blocks.append((self.tag, text, tuple(k for k, _ in self.holders), self.linked))
                if re.fullmatch("h[1-6]", self.tag):
                    self.headings.append((int(self.tag[1]), text))
        self.held, self.linked = None, 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = {k: v or "" for k, v in attrs}
        if tag == "meta" and given.get("name", "").lower() == "description":
            self.description = given.get("content", "")
        if tag in _VOID:
            if tag == "br" and self.held is not None:
                self.held.append(" ")
            return
        junk = tag in _SKIP or bool(_JUNK.search(f"{given.get('class', '')} {given.get('id', '')}"))
        self.stack.append((tag, int(junk)))
        self.skip += junk
        if tag == "title":
            self.held, self.tag = [], "title"
        if tag == "a" and given.get("href"):
            self.link, self.link_text = given["href"], []
        if self.skip:
            return
        if tag in _HOLDERS:
            self.flush()
            self.n += 1
            self.holders.append((self.n, tag))
            self.kinds[self.n] = tag
        if tag == "table":
            self.open_tables.append({"rows": [], "caption": "", "heading": self.headings[-1][1] if self.headings else ""})
        elif tag == "tr" and self.open_tables:
            self.open_tables[-1]["rows"].append([])
        elif tag in ("td", "th") and self.open_tables and self.open_tables[-1]["rows"]:
            self.open_tables[-1]["cell"] = []
            self.open_tables[-1]["span"] = max(1, min(12, int(given["colspan"]) if given.get("colspan", "").isdigit() else 1))
        if tag in _TEXT or tag == "caption":
            self.flush()
            self.held, self.tag = [], tag

    def handle_endtag(self, tag: str) -> None:
        if tag == "title" and self.tag == "title" and self.held is not None:
            self.title, self.held = " ".join("".join(self.held).split()), None
        if tag == "a" and self.link:
            self.links.append((self.link, " ".join("".join(self.link_text).split())))
            self.link = ""
        if tag in ("td", "th") and self.open_tables and "cell" in self.open_tables[-1]:
            t = self.open_tables[-1]
            t["rows"][-1] += [" ".join("".join(t.pop("cell")).split())] * t["span"]
        if tag == "caption" and self.open_tables and self.held is not None:
            self.open_tables[-1]["caption"] = " ".join("".join(self.held).split())
        if tag == "table" and self.open_tables:
            self.tables.append(self.open_tables.pop())
        if tag in _TEXT or tag == "caption":
            self.flush()
        if tag in _HOLDERS and self.holders and not self.skip:
            self.flush()
            self.holders.pop()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self.skip -= sum(j for _, j in self.stack[k:])
                del self.stack[k:]
                break

    def handle_data(self, data: str) -> None:
        if self.link:
            self.link_text.append(data)
        if self.tag == "title" and self.held is not None:
            self.held.append(data)
        elif not self.skip:
            if self.held is not None:
                self.held.append(data)
                self.linked += len(data) if self.link else 0
            if self.open_tables and "cell" in self.open_tables[-1]:
                self.open_tables[-1]["cell"].append(data)


def _read(page: str | None) -> _Page:
    parser = _Page()
    parser.feed(page or "")
    parser.close()
    parser.flush()
    return parser


def _main(page: _Page) -> list[str]:
    """Paragraphs of article or main if these hold 400 characters, else of the holder that
    maximises paragraph length times (1 - link density), if it has 200; else all."""
    weight: dict[int, tuple[int, int]] = {}
    for tag, text, holders, linked in page.blocks:
        if tag in ("p", "li", "blockquote", "pre"):
            for h in holders:
                a, b = weight.get(h, (0, 0))
                weight[h] = a + len(text), b + linked
    named = [h for h in weight if page.kinds[h] in ("article", "main") and weight[h][0] >= 400]
    score = lambda h: weight[h][0] * (1 - min(0.9, weight[h][1] / max(1, weight[h][0])))
    best = named[0] if named else max((h for h in weight if page.kinds[h] in ("div", "section") and weight[h][0] >= 200), key=score, default=None)
    return [text for tag, text, holders, _ in page.blocks if (best is None or best in holders) and not re.fullmatch("h[1-6]|t[dh]|caption", tag) and len(text) > 40]


def _rows(df: DataFrame, key: str, page: str, f, schema: str, names: list[str]) -> DataFrame:
    kind = dict(df.dtypes)[key]
    small_batches(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *x) for k, text in zip(batch["k"], batch["x"], strict=True) for x in f(text)]
            yield pd.DataFrame(rows, columns=[key, *names])

    return df.select(F.col(key).alias("k"), F.col(page).alias("x")).mapInPandas(released(run), f"{key} {kind}, {schema}")


def main_content(pages: DataFrame, key: str, page: str) -> DataFrame:
    """key, title, description, headings, paragraphs, text of every page."""
    def one(text: str | None) -> list[tuple]:
        p = _read(text)
        paragraphs = _main(p)
        return [(p.title, p.description, [t for _, t in p.headings], paragraphs, "\n".join(paragraphs))]

    return _rows(pages, key, page, one, "title string, description string, headings array<string>, paragraphs array<string>, text string", ["title", "description", "headings", "paragraphs", "text"])


def links(pages: DataFrame, key: str, page: str) -> DataFrame:
    """key, position, href, label of every link."""
    return _rows(pages, key, page, lambda t: [(k, h, x) for k, (h, x) in enumerate(_read(t).links)], "position int, href string, label string", ["position", "href", "label"])


def page_tables(text: str | None) -> list[tuple[str, list[list[str]]]]:
    """(name, rows) of each table with two rows and two columns or more; blank rows go."""
    found = []
    for t in _read(text).tables:
        rows = [r for r in t["rows"] if any(r)]
        if len(rows) >= 2 and max(map(len, rows)) >= 2:
            width = max(map(len, rows))
            found.append((t["caption"] or t["heading"], [r + [""] * (width - len(r)) for r in rows]))
    return found


def tables(pages: DataFrame, key: str, page: str) -> DataFrame:
    """key, table, name, row, cells of every table row."""
    return _rows(pages, key, page, lambda t: [(k, name, r, cells) for k, (name, rows) in enumerate(page_tables(t)) for r, cells in enumerate(rows)], "tbl int, name string, row int, cells array<string>", ["tbl", "name", "row", "cells"])


def refreshed_rows(datasets: DataFrame, source_rows: DataFrame) -> DataFrame:
    """(dataset, row, cells): the rows that datasets take from the tables of freshly read sources.

    ``datasets`` has dataset, source, tbl and width, the number of its columns; ``source_rows``
    has source, tbl, row and cells, row 0 being the head. Cells go by position: what a row
    lacks is empty, what it has beyond the width is left out.
    """
    cells = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.coalesce(F.get("cells", i), F.lit("")))
    found = datasets.where("width > 0").select("dataset", "source", "tbl", "width").join(source_rows.where("row > 0"), ["source", "tbl"])
    return found.select("dataset", "row", cells.alias("cells"))


def content_kind(content_type: Column, head: Column) -> Column:
    """json, feed, csv, markdown or html of a fetched text."""
    t, h = F.lower(F.coalesce(content_type, F.lit(""))), F.ltrim(F.coalesce(head, F.lit("")))
    return (
        F.when(t.contains("json") | h.rlike(r"^[\[{]"), "json")
        .when(t.rlike("rss|atom|xml") & ~t.contains("html") | h.rlike(r"(?i)^(<\?xml[^>]*>\s*)?<(rss|feed)\b"), "feed")
        .when(t.contains("csv"), "csv")
        .when(t.contains("markdown") | h.rlike(r"^#{1,3} "), "markdown")
        .otherwise("html")
    )


def feed_items(text: str | None) -> list[tuple[str, str, str, str]]:
    """(title, url, date, text) of RSS and Atom items; none if the text is no XML."""
    try:
        root = ElementTree.fromstring(text or "")
    except ElementTree.ParseError:
        return []
    name = lambda e: e.tag.rsplit("}", 1)[-1]
    items = []
    for e in root.iter():
        if name(e) in ("item", "entry"):
            own = {name(c): c for c in e}
            get = lambda *keys, own=own: next((("".join(own[k].itertext()) or own[k].get("href") or "").strip() for k in keys if k in own), "")
            plain = re.sub(r"<[^>]+>", " ", html.unescape(get("description", "summary", "content", "encoded")))
            items.append((get("title"), get("link", "id"), get("pubDate", "updated", "published"), " ".join(plain.split())))
    return items


def feeds(df: DataFrame, key: str, text: str) -> DataFrame:
    return _rows(df, key, text, lambda t: [(k, *x) for k, x in enumerate(feed_items(t))], "position int, title string, url string, date string, text string", ["position", "title", "url", "date", "text"])


def markdown_tables(text: str | None) -> list[list[list[str]]]:
    """Pipe tables of a Markdown text, without their rule lines."""
    found: list[list[list[str]]] = []
    run: list[list[str]] = []
    for line in [*(text or "").splitlines(), ""]:
        if line.strip().startswith("|"):
            cells = [c.strip() for c in line.strip().strip("|").split("|")]
            if not all(re.fullmatch(r":?-{2,}:?", c) for c in cells):
                run.append(cells)
        else:
            if len(run) >= 2:
                found.append(run)
            run = []
    return found
