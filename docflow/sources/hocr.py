"""hOCR pages by a scanner that reads markup as a stream of tags and texts and keeps no tree.

Classes are sets, attributes come in any order and either quote, character references are undone in texts and attributes, and
elements may lie in one another. What is open is all that is held of a page, besides the lines that have ended.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

PAR, LINE, WORD = "ocr_par", "ocr_line", "ocrx_word"
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Open:
    """An element that has begun: its tag, and what it is."""

    __slots__ = ("at", "kinds", "name", "tag", "texts", "title", "words")

    def __init__(self, tag: str, kinds: set[str], name: str, title: str) -> None:
        self.tag, self.kinds, self.name, self.title = tag, kinds, name, title
        self.at = 0  # number of the next line of a paragraph
        self.words: list[list[str]] = []
        self.texts: list[str] = []


class Scanner(HTMLParser):
    """Collects (par_id, line_ord, text, title): the lines of every paragraph, a line in two paragraphs once for each.

    A paragraph tag ends an open one, as in HTML; an end tag ends all that has begun within its element, and one without a
    beginning is passed over.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[_Open] = []
        self.lines: list[tuple[str, int, str, str]] = []
        self._places: dict[int, list[tuple[str, int]]] = {}

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        found = dict(reversed(attrs))  # of an attribute that is there twice the first counts
        if tag == "p":
            self._ended("p")
        kinds = set((found.get("class") or "").split()) & {PAR, LINE, WORD}
        now = _Open(tag, kinds, found.get("id") or "", found.get("title") or "")
        if WORD in kinds:
            for line in self.stack:
                if LINE in line.kinds:
                    line.words.append(now.texts)  # what is said follows
        if LINE in kinds:
            # lines are numbered as they begin, in each paragraph that they begin in
            pars = [o for o in self.stack if PAR in o.kinds]
            self._places[id(now)] = [(o.name, o.at) for o in pars]
            for o in pars:
                o.at += 1
        if tag not in _VOID:
            self.stack.append(now)
        elif LINE in kinds:
            self._closed(now)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self._ended(tag)

    def handle_data(self, data: str) -> None:
        for o in self.stack:
            if WORD in o.kinds:
                o.texts.append(data)

    def _ended(self, tag: str) -> None:
        at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i].tag == tag), None)
        while at is not None and len(self.stack) > at:
            self._closed(self.stack.pop())

    def _closed(self, o: _Open) -> None:
        if LINE in o.kinds:
            words = " ".join("".join(w).strip(" \t\r\n\f\v") for w in o.words)
            self.lines += [(name, at, words, o.title) for name, at in self._places.pop(id(o), ())]

    def close(self) -> None:
        super().close()
        while self.stack:
            self._closed(self.stack.pop())


def box(title: Column) -> Column:
    """The four numbers behind ``bbox`` in an hOCR title; nulls where there are none."""
    parts = [F.regexp_extract(title, r"\bbbox\s+(-?\d+)\s+(-?\d+)\s+(-?\d+)\s+(-?\d+)", i).try_cast("int").alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"), 1)]
    return F.struct(*parts)


def size(title: Column) -> Column:
    """The number behind ``x_size`` in an hOCR title, if there is one."""
    return F.nullif(F.regexp_extract(title, r"\bx_size\s+([\d.]+)", 1), F.lit("")).try_cast("double")


def lines(pages: DataFrame, doc: str = "doc_id", hocr: str = "hocr") -> DataFrame:
    """Rows (doc, par_id, line_ord, text, bbox, size): the lines of each page's paragraphs, words joined by blanks.

    Line numbers start at 0 in each paragraph. A word within a word counts as both. Null and empty pages have no lines, nor has
    markup outside of paragraphs; a paragraph without an id has an empty one.
    """
    shape = T.StructType([T.StructField(doc, pages.schema[doc].dataType), T.StructField("par_id", T.StringType()), T.StructField("line_ord", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("title", T.StringType())])
    arrow = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                markup = b.column(1)[i].as_py()
                if not markup:
                    continue
                scan = Scanner()
                scan.feed(markup)
                scan.close()
                for lo in range(0, len(scan.lines), 10_000):
                    part = scan.lines[lo : lo + 10_000]
                    key = b.column(0).take(pa.array([i] * len(part), pa.int64()))
                    yield pa.RecordBatch.from_arrays([key, *(pa.array(c, t) for c, t in zip(zip(*part, strict=True), arrow.types[1:], strict=True))], names=arrow.names)

    found = pages.select(doc, F.col(hocr).cast("string").alias("hocr")).mapInArrow(run, shape)
    return found.select(doc, "par_id", "line_ord", "text", box(F.col("title")).alias("bbox"), size(F.col("title")).alias("size"))
