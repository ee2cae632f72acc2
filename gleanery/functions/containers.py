"""The part of a page that holds the article: the first element that one of a host's ordered selectors matches."""

from __future__ import annotations

from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.sources.tables import small_batches

#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Finder(HTMLParser):
    """Where the first element of each selector (``tag`` or ``tag.class``) begins and ends; elements of its tag may nest."""

    def __init__(self, selectors: list[str]):
        super().__init__(convert_charrefs=False)
        self.wanted = [tuple(s.lower().split(".", 1)) if "." in s else (s.lower(), None) for s in selectors]
        self.spans: list[tuple[int, int] | None] = [None] * len(selectors)
        self.open: dict[int, list[int]] = {}  # by selector: start of the inside, elements of the tag that are open
        self.headings: list[list[str] | None] = [None] * len(selectors)  # by selector: texts of the first h1 inside
        self.reading: set[int] = set()  # selectors whose h1 is open

    def find(self, html: str) -> tuple[str | None, str | None]:
        """The inside of the first match, and the text of its first h1."""
        self.html, self.lines = html, [0]
        for k, c in enumerate(html):
            if c == "\n":
                self.lines.append(k + 1)
        self.feed(html)
        self.close()
        for span, heading in zip(self.spans, self.headings, strict=True):
            if span:
                return html[span[0] : span[1]], None if heading is None else "".join(heading)
        return None, None

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            return
        if tag == "h1":
            for k in self.open:
                if self.headings[k] is None:
                    self.headings[k] = []
                    self.reading.add(k)
        classes = (dict(attrs).get("class") or "").lower().split()
        for k, (name, cls) in enumerate(self.wanted):
            if name != tag or self.spans[k]:
                continue
            if k in self.open:
                self.open[k][1] += 1
            elif cls is None or cls in classes:
                self.open[k] = [self._at() + len(self.get_starttag_text() or ""), 1]

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        pass

    def _read(self, text: str) -> None:
        for k in self.reading:
            self.headings[k].append(text)

    def handle_data(self, data: str) -> None:
        self._read(data)

    def _refer(self, reference: str) -> None:
        """A reference as it stands there: one without its semicolon may be none."""
        if self.reading:
            self._read(unescape(reference + ";" if self.html.startswith(";", self._at() + len(reference)) else reference))

    def handle_entityref(self, name: str) -> None:
        self._refer(f"&{name}")

    def handle_charref(self, name: str) -> None:
        self._refer(f"&#{name}")

    def handle_endtag(self, tag: str) -> None:
        if tag == "h1":
            self.reading.clear()
        for k in [k for k in self.open if self.wanted[k][0] == tag]:
            self.open[k][1] -= 1
            if not self.open[k][1]:
                self.spans[k] = (self.open.pop(k)[0], self._at())
                self.reading.discard(k)


def article(html: str | None, selectors: list[str] | None) -> tuple[str | None, str | None]:
    """Inner HTML of the first match of the first selector that matches, and the text of its first h1; None without any, never the whole page. Empty counts as none."""
    inner, heading = _Finder(selectors).find(html) if html and selectors else (None, None)
    return (inner, heading) if inner else (None, None)


def container(html: str | None, selectors: list[str] | None) -> str | None:
    return article(html, selectors)[0]


def article_containers(rows: DataFrame, html: str, selectors: str) -> DataFrame:
    """``rows`` without the page and its selectors (an array, in their order), and with ``inner_html`` and ``heading``, the text of the first h1 in it.

    Elements nest, so this is a parser in Arrow batches and no pattern; pages are handled one by one. Null pages
    and null or empty selectors give NULL; elements that never end match nothing.
    """
    small_batches(rows.sparkSession)
    keep = [c for c in rows.columns if c not in (html, selectors, "inner_html", "heading")]
    rows = rows.select(*keep, html, selectors)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema), "inner_html string", "heading string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages, lists = (batch.column(len(keep) + k).to_pylist() for k in (0, 1))
            found = [article(x, s) for x, s in zip(pages, lists, strict=True)]
            inner, headings = (pa.array([f[k] for f in found], pa.string()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], inner, headings], names=[*keep, "inner_html", "heading"])

    return rows.mapInArrow(run, schema)


def selectors_by_host(pages: DataFrame, selectors: DataFrame) -> DataFrame:
    """``pages`` with the array ``selectors`` of their host; ``selectors`` has host, place and selector. Hosts without any get NULL."""
    lists = selectors.groupBy("host").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "selector"))), lambda x: x["selector"]).alias("selectors"))
    return pages.join(lists, "host", "left")
