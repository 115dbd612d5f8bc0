"""Adapters for what needs an external program: they take a function and give rows of a fixed schema.

A function gets the bytes of one file and options, and yields tuples. It is loaded once in each worker; a file that fails
is one row with ``error`` and never fails the others. None of the programs is part of this package.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from html import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..schema import LAYOUT_ITEM

Extractor = Callable[..., Iterable[tuple]]

#: What a batch of results takes at most before it is passed on, in characters; one row may be larger.
_BATCH = 1 << 22

#: What each kind of extractor yields for a file.
KINDS = {
    "layout": T.StructType(LAYOUT_ITEM.fields[1:]),
    "tables": T.StructType([T.StructField("page", T.IntegerType()), T.StructField("table_no", T.IntegerType()), T.StructField("cells", T.ArrayType(T.ArrayType(T.StringType())))]),
    "text": T.StructType([T.StructField("page", T.IntegerType()), T.StructField("ord", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("fonts", T.ArrayType(T.StringType())), T.StructField("sizes", T.ArrayType(T.DoubleType()))]),
    "hocr": T.StructType([T.StructField("page", T.IntegerType()), T.StructField("hocr", T.StringType())]),
    "html": T.StructType([T.StructField("html", T.StringType())]),
    "edges": T.StructType([T.StructField("answer", T.StringType())]),
    "assets": T.StructType([T.StructField("path", T.StringType()), T.StructField("content", T.BinaryType())]),
}


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Rows (path, content) of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


def _length(x: object) -> int:
    return len(x) if isinstance(x, (str, bytes)) else sum(16 + _length(y) for y in x) if isinstance(x, (list, tuple)) else 0


def extracted(found: DataFrame, kind: str, extractor: Extractor, **options: object) -> DataFrame:
    """Rows (path, the kind's columns, error): what the extractor yields for each file.

    Results are passed on as they come, so a task holds one file and a few megabytes of its results, however many files it
    reads. Of a file that fails only the error is kept, so one file's results wait for its end.
    """
    shape = KINDS[kind]
    schema = T.StructType([T.StructField("path", T.StringType()), *shape.fields, T.StructField("error", T.StringType())])
    arrow = to_arrow_schema(schema)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for b in batches:
            for i in range(b.num_rows):
                p, c = b.column("path")[i].as_py(), b.column("content")[i].as_py()
                try:
                    got = [(p, *r, None) for r in extractor(c, **options)]
                except Exception as e:  # a bad file is a row of its own
                    got = [(p, *[None] * len(shape.fields), f"{type(e).__name__}: {e}")]
                for row in got:
                    rows.append(row)
                    size += 200 + sum([_length(x) for x in row if x is not None])
                    if size > _BATCH:
                        yield made(rows)
                        rows, size = [], 0
        if rows:
            yield made(rows)

    return found.select("path", "content").mapInArrow(run, schema)


def extracted_whole(found: DataFrame, kind: str, extractor: Extractor, **options: object) -> DataFrame:
    """Rows (path, items, error): one a file, with what the extractor yields for it as an array in that order.

    For steps that need a file's items together: nothing has to be shuffled to bring them there again. A file that fails has no
    items. As with ``extracted`` a task holds one file and a few megabytes of results.
    """
    shape = KINDS[kind]
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("items", T.ArrayType(shape)), T.StructField("error", T.StringType())])
    item, arrow = to_arrow_schema(shape), to_arrow_schema(schema)

    def listed(got: list[tuple]) -> pa.ListArray:
        columns = zip(*got, strict=True) if got else [()] * len(item)
        values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, item, strict=True)], fields=list(item))
        return pa.ListArray.from_arrays(pa.array([0, len(got)], pa.int32()), values).cast(arrow.field("items").type)

    def made(paths: list[str], items: list[pa.ListArray], errors: list[str | None]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.concat_arrays(items), pa.array(errors, pa.string())], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, items, errors, size = [], [], [], 0
        for b in batches:
            for i in range(b.num_rows):
                error = None
                try:
                    got = listed(list(extractor(b.column("content")[i].as_py(), **options)))
                except Exception as e:  # a bad file is a row without items
                    got, error = listed([]), f"{type(e).__name__}: {e}"
                paths.append(b.column("path")[i].as_py())
                items.append(got)
                errors.append(error)
                size += 200 + got.nbytes
                if size > _BATCH:
                    yield made(paths, items, errors)
                    paths, items, errors, size = [], [], [], 0
        if paths:
            yield made(paths, items, errors)

    return found.select("path", "content").mapInArrow(run, schema)


#: Namespaces of word-processor, drawing and spreadsheet markup.
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_DRAWING = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_SLIDE = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def office_text(content: bytes) -> Iterator[tuple]:
    """Word-processor, slide and spreadsheet files (zipped XML), with the standard library: layout items without geometry.

    Paragraphs in order, headings and list items by style; slides as pages, their titles as headings; sheets as pages, each
    one table. Tables have their cells as plain markup. Of a part one paragraph, shape or row is held as a tree at a time.
    """
    import io
    import zipfile

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        if "word/document.xml" in names:
            found = _word_items(z)
        elif any(n.startswith("ppt/slides/slide") for n in names):
            found = _slide_items(z, names)
        elif any(n.startswith("xl/worksheets/sheet") for n in names):
            found = _sheet_items(z, names)
        else:
            raise ValueError("no office file")
        for i, (page, label, text, html) in enumerate(found):
            yield i, page, label, None, None, None, None, text, html, None, None


def _said(node: object, space: str) -> str:
    return "".join([t.text or "" for t in node.iter(f"{space}t")])


def _first(node: object, *tags: str) -> object | None:
    """The first element below by the tags on the way to it."""
    for x in node.findall(tags[0]):
        if (found := _first(x, *tags[1:]) if tags[1:] else x) is not None:
            return found
    return None


def _numbered(names: set[str], start: str) -> list[tuple[int, str]]:
    """Parts of a package by the number in their names."""
    return sorted((int(n[len(start) : -4]), n) for n in names if n.startswith(start) and n.endswith(".xml") and n[len(start) : -4].isdigit())


def _markup(rows: Iterable[Iterable[str]]) -> str:
    return "<table>" + "".join(map(_row_markup, rows)) + "</table>"


def _row_markup(cells: Iterable[str]) -> str:
    return "<tr>" + "".join([f"<td>{escape(c, quote=False)}</td>" for c in cells]) + "</tr>"


def _outermost(z: object, part: str, wanted: Callable[[list], bool]) -> Iterator:
    """Elements of a part whose path from the root is wanted, outermost ones, each when it is whole; what was read is let go."""
    from xml.etree import ElementTree

    path, within = [], 0
    with z.open(part) as raw:
        for event, node in ElementTree.iterparse(raw, ("start", "end")):
            if event == "start":
                if within:
                    within += 1
                else:
                    path.append(node)
                    within = 1 if wanted(path) else 0
            elif within > 1:
                within -= 1
            else:
                path.pop()
                if within:
                    yield node
                within = 0
                if path:
                    path[-1].remove(node)


def _tagged(*tags: str) -> Callable[[list], bool]:
    return lambda path: path[-1].tag in tags


def _in_body() -> Callable[[list], bool]:
    """Children of the first body below the root."""
    bodies: list = []

    def wanted(path: list) -> bool:
        if len(path) == 2 and path[1].tag == f"{_WORD}body":
            bodies.append(path[1])
        return len(path) == 3 and bool(bodies) and path[1] is bodies[0]

    return wanted


def _word_items(z: object) -> Iterator[tuple]:
    for p in _outermost(z, "word/document.xml", _in_body()):
        if p.tag == f"{_WORD}tbl":
            yield 1, "table", None, _markup([[_said(c, _WORD) for c in r.iter(f"{_WORD}tc")] for r in p.iter(f"{_WORD}tr")])
        elif p.tag == f"{_WORD}p":
            style = _first(p, f"{_WORD}pPr", f"{_WORD}pStyle")
            name = (style.get(f"{_WORD}val", "") if style is not None else "").lower()
            listed = name.startswith("list") or _first(p, f"{_WORD}pPr", f"{_WORD}numPr") is not None
            yield 1, "section_header" if name.startswith(("heading", "title")) else "list_item" if listed else "text", _said(p, _WORD), None


def _slide_items(z: object, names: set[str]) -> Iterator[tuple]:
    said, table = f"{_SLIDE}sp", f"{_DRAWING}tbl"
    for n, part in _numbered(names, "ppt/slides/slide"):
        for shape in _outermost(z, part, _tagged(said, table)):
            for node in shape.iter():
                if node.tag == said:
                    kind = _first(node, f"{_SLIDE}nvSpPr", f"{_SLIDE}nvPr", f"{_SLIDE}ph")
                    title = kind is not None and kind.get("type") in ("title", "ctrTitle")
                    for p in node.iter(f"{_DRAWING}p"):
                        if text := _said(p, _DRAWING):
                            yield n, "title" if title else "text", text, None
                elif node.tag == table:
                    yield n, "table", None, _markup([[_said(c, _DRAWING) for c in r.iter(f"{_DRAWING}tc")] for r in node.iter(f"{_DRAWING}tr")])


def _sheet_items(z: object, names: set[str]) -> Iterator[tuple]:
    shared = [_said(s, _SHEET) for top in _outermost(z, "xl/sharedStrings.xml", _tagged(f"{_SHEET}si")) for s in top.iter(f"{_SHEET}si")] if "xl/sharedStrings.xml" in names else []

    def value(cell: object) -> str:
        if cell.get("t") == "inlineStr":
            return _said(cell, _SHEET)
        v = cell.find(f"{_SHEET}v")
        text = (v.text or "") if v is not None else ""
        return shared[int(text)] if cell.get("t") == "s" and text else text

    for n, part in _numbered(names, "xl/worksheets/sheet"):
        rows = [_row_markup([value(c) for c in r.iter(f"{_SHEET}c")]) for top in _outermost(z, part, _tagged(f"{_SHEET}row")) for r in top.iter(f"{_SHEET}row")]
        if rows:
            yield n, "table", None, f"<table>{''.join(rows)}</table>"


def kth_table(tables: DataFrame, page: int, number: int) -> DataFrame:
    """Of extracted tables (path, page, table_no, cells) the ``number``-th of a page, both from 0; files without it have no row."""
    return tables.where((F.col("page") == page) & (F.col("table_no") == number))


def first_match(rows: DataFrame, doc: str, order: tuple[str, ...], value: str) -> DataFrame:
    """Rows (doc, value): of each document the first value in order that is not blank."""
    kept = rows.where(F.trim(F.coalesce(F.col(value).cast("string"), F.lit(""))) != "")
    return kept.groupBy(doc).agg(F.min_by(value, F.struct(*order)).alias(value))
