"""Markdown, HTML, hOCR, text functions, pixels and adapters on golden values."""

import io
import math
import random
import re
import struct
import time
import tracemalloc
import zipfile
import zlib
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
import pytest

from docflow.catalog import documents, web
from docflow.functions import pixels
from docflow.functions import text as X
from docflow.plans import markdown
from docflow.schema import ELEMENT
from docflow.sources import adapters, annotations, hocr, html
from pyspark.sql import functions as F


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_markdown_document(spark):
    rows = [("d", 1, "h", "A", None), ("d", 2, "p", "b", None), ("d", 3, "li", "c", None), ("d", 4, "img", None, "images/picture-1.png"), ("e", 1, "odd", "x", None), ("e", 2, "p", "y", None)]
    df = spark.createDataFrame(rows, "doc_id string, id int, type string, text string, src string").withColumn("html", F.lit("t")).withColumn("level", F.when(F.col("type") == "h", 1))
    got = dict(markdown.assembled(df.withColumn("content", markdown.line()), "doc_id", "id", "content").collect())
    assert got == {"d": "# A\n\nb\n\n- c\n\n![Image](images/picture-1.png)\n", "e": "\ny\n"}


def test_render_without_headings_and_strict(spark):
    rows = [("d", 1, 1, None, "p", "only", None, None, None, None), ("e", 1, 1, None, "h", "T", 20.0, 4.0, None, None), ("e", 2, 1, None, "h", "U", 20.0, 4.0, None, None)]
    df = spark.createDataFrame(rows, ELEMENT)
    assert dict(markdown.render(df).collect()) == {"d": "only\n", "e": "# T\n\n# U\n"}
    assert [r["doc_id"] for r in markdown.strict_failures(df).collect()] == ["d"]


def test_text_functions(spark):
    assert _one(spark, X.pipe_table(F.lit([["a\nb", ""]]))) == "|a b||"
    assert _one(spark, X.pipe_table(F.array(F.array(F.lit("a\nb"), F.lit(None)), F.array(F.lit("c"), F.lit(""))))) == "|a b|None|\n|c||"
    assert _one(spark, X.preview(F.lit("\t" + "x" * 40))) == "x" * 35 + "..."
    assert _one(spark, X.selector(F.lit("div"), F.lit(" a  b "))) == "div.a.b"
    assert _one(spark, X.accepted(F.lit(["pdf", "docx"]))) == ".pdf,.docx"
    assert _one(spark, X.upload_path(F.lit("id"), F.lit("x.tar.PDF"))) == "id.PDF"
    assert _one(spark, X.element_type(F.lit("list_item"))) == "li"
    assert _one(spark, X.element_type(F.lit("list_item"), compat=True)) == "p"
    assert _one(spark, X.label_colour(F.lit("caption"))) == "orange"
    assert _one(spark, X.heading_level(F.lit("h3"))) == 3
    assert [tuple(e) for e in _one(spark, X.edge_lines(F.lit("#1->#2\nno\n#2->#30\n")))] == [(1, 2), (2, 30)]


def test_cut_references_are_text_when_asked(spark):
    page = "<article><h1>A &amp; b&amp</h1><p>&lt;&notit; &#233;&#233 &amp;amp<a href='?a&copy=1&lt;'>&</a></article>"
    df = spark.createDataFrame([(1, page)], "page_id long, html string")
    got = [r["text"] for r in html.elements(df, closed=True).orderBy("id").collect()]
    assert got == ["A & b&amp", "<&notit; é&#233 &amp&"]
    assert [r["text"] for r in html.elements(df).orderBy("id").collect()][0] == "A & b&"
    assert next(n for n in html.Tree(page, closed=True).nodes if n.tag == "a").attrs == {"href": "?a&copy=1<"}


def _cut_pages(spark, path):
    """A folder with pages whose headings end within a character reference."""
    rows = [(k, f"<html><body><article><h1>T{k} &amp; u&amp</h1><p>v &lt; w</p></article></body></html>") for k in range(4)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{path}/pages.parquet")
    return str(path)


def test_html_elements_with_cut_references(spark, tmp_path):
    got = web.html_elements(spark, _cut_pages(spark, tmp_path)).orderBy("page_id", "ord").collect()
    assert [(r["label"], r["text"]) for r in got[:2]] == [("h1", "T0 & u&amp"), ("p", "v < w")]


def test_page_markdown_with_cut_references(spark, tmp_path):
    assert dict(web.page_markdown(spark, _cut_pages(spark, tmp_path)).collect())[1] == "# T1 & u&amp\n\nv < w\n"


def test_varied_elements_with_cut_references(spark, tmp_path):
    rows = web.varied_elements(spark, _cut_pages(spark, tmp_path)).where("label = 'h1'").orderBy("page_id").collect()
    assert [r["text"] for r in rows] == [f"T{k} & u&amp" for k in range(4)]


def test_varied_markdown_with_cut_references(spark, tmp_path):
    got = dict(web.varied_markdown(spark, _cut_pages(spark, tmp_path)).collect())
    assert (got[0], got[2]) == ("# T0 & u&amp\n\nv < w\n", "# T2 & u&amp\n\n### v < w\n")


def test_tolerant_html(spark):
    page = "<main class='a b'><h1>T<!-- x --></h1><p>one<p>two<br>2 &amp; 3<ul><li>i<li>j</ul><script>'</p>'</script><table><tr><td>c<th>h<td>d<tr><td><table><td>e</table></table></main><h2>out"
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")
    got = [(r["label"], r["text"], r["in_content"]) for r in html.elements(df).orderBy("id").collect()]
    assert got == [("h1", "T", True), ("h2", "out", False), ("table", "chde", True), ("table", "e", True), ("li", "i", True), ("li", "j", True), ("p", "one", True), ("p", "two 2 & 3", True)]
    cells = [(r["table_id"], r["id"], r["text"]) for r in html.cells(df).orderBy("table_id", "id").collect()]
    assert cells == [(1, 1, "c"), (1, 2, "d"), (1, 3, "e"), (1, 4, "e"), (2, 1, "e")]
    assert [r["selector"] for r in html.selectors(df).collect()] == ["main.a.b"]


def test_unclosed_tags_take_linear_time():
    for tag in ("b", "h1", "p", "div"):
        begun = time.perf_counter()
        page = html.Tree("".join(f"<{tag}>x </i>" for _ in range(8_000)))
        assert len(page.nodes) == 8_000 and len(page.words) == 8_000
        assert time.perf_counter() - begun < 3
    # a heading ends an open heading, so texts don't pile up
    tree = html.Tree("<h1>a<h2>b")
    assert [tree.text(n) for n in tree.nodes] == ["a", "b"]


def test_blocks_of_general_pages(spark, tmp_path):
    page = "<main><h1>T</h1><p>one</p><ul><li>a<ul><li>b<p>c</p></ul><li>d</ul><img src='i.png'><h2>U</h2><table><tr><th>x<td><p>y &lt;</p></table><h3></h3><p> </p></main><p>out</p>"
    df = spark.createDataFrame([(1, page), (2, "<body><p>only</p>"), (3, None), (4, "no tags")], "page_id long, html string")
    got = [(r["page_id"], r["tag"], r["text"], r["left"], r["src"], r["html"]) for r in html.blocks(df).orderBy("page_id", "ord").collect()]
    table = "<table><tr><th>x</th><td>y &lt;</td></tr></table>"
    assert got == [
        (1, "h1", "T", 0.0, None, None), (1, "p", "one", 0.0, None, None), (1, "li", "a", 40.0, None, None), (1, "li", "b", 80.0, None, None), (1, "p", "c", 80.0, None, None), (1, "li", "d", 40.0, None, None),
        (1, "img", "", 0.0, "i.png", None), (1, "h2", "U", 0.0, None, None), (1, "table", "x", 0.0, None, table), (1, "h3", "", 0.0, None, None), (2, "p", "only", 0.0, None, None),
    ]
    df.write.parquet(f"{tmp_path}/pages.parquet")
    text = {r["page_id"]: r["markdown"] for r in web.page_markdown(spark, str(tmp_path)).collect()}
    assert text == {1: f"# T\n\none\n\n- a\n\n- b\n\nc\n\n- d\n\n![Image](i.png)\n\n## U\n\n{table}\n\n### \n", 2: "only\n"}
    found = {r["page_id"]: r["edges"] for r in web.page_edges(spark, str(tmp_path)).collect()}
    assert found == {1: "#1->#2\n#2->#3\n#3->#4\n#1->#5\n#5->#6\n#5->#7\n#1->#8\n#8->#9\n#8->#10\n"}


def test_article_fallback_is_the_element_with_most_text(spark):
    df = spark.createDataFrame([(1, "<div><p>x</p></div><section class=s><p>long text</p></section>")], "page_id long, html string")
    assert html.selectors(df).first()["selector"] == "section.s"


def test_hocr(spark):
    page = """<p class='ocr_par' id='par_1'><span class='ocr_line' id='l1' title="bbox 1 2 3 4; x_size 22.5"><span class='ocrx_word'>Hi</span> <span class='ocrx_word'><em>you</em></span></span>
    <span title='bbox 5 6 7 8' class="ocr_line" id="l2"><span class='ocrx_word'>a&amp;b</span></span></p>"""
    got = hocr.lines(spark.createDataFrame([("d", page), ("e", None)], "doc_id string, hocr string")).orderBy("line_ord").collect()
    assert [(r["par_id"], r["text"], tuple(r["bbox"]), r["size"]) for r in got] == [("par_1", "Hi you", (1, 2, 3, 4), 22.5), ("par_1", "a&b", (5, 6, 7, 8), None)]


def test_hocr_query_reads_every_conversation(spark, tmp_path):
    rows = [(conv, turn, "user", f"Turn {turn}, of <{conv}>\tno-{chr(97 + conv)}") for conv in range(12) for turn in range(2)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {tuple(r) for r in documents.hocr_lines(spark, str(tmp_path)).collect()}
    assert got == {(str(c), f"par_{t}", 0, " ".join(re.sub("[^A-Za-z]", " ", text).split()), t, t + 1, t + 20, t + 30, t + 0.5) for c, t, _, text in rows}


def test_files_of_annotations_and_edges(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"doc_id": "d", "id": 1, "bbox": {"xc": 1.0, "yc": 2.0, "w": 3.0, "h": 4.0}, "type": "p", "text": "x"}]')
    row = annotations.read_elements(spark, str(tmp_path / "a.json")).first()
    assert (row["id"], row["bbox"]["w"], row["fontsize"]) == (1, 3.0, None)
    (tmp_path / "e.txt").write_text("#1->#2\n\n#2->#3\n")
    assert [(r["parent_id"], r["child_id"]) for r in annotations.read_edges(spark, str(tmp_path / "e.txt")).orderBy("ord").collect()] == [(1, 2), (2, 3)]


def test_pixels():
    assert pixels.run_thickness(np.array([[0, 0, 1, 1, 0, 1]], dtype=bool)) == 1.5
    assert math.isnan(pixels.run_thickness(np.array([[1, 1, 0, 0, 0, 0]], dtype=bool)))
    ring = np.zeros((9, 9), dtype=bool)
    ring[1:8, 1:8] = True
    ring[3:6, 3:6] = False
    ring[4, 4] = True
    assert pixels.glyph_boxes(ring) == [(1, 1, 7, 7)]
    two = np.zeros((8, 20), dtype=bool)
    two[0:2, 0:5] = True  # ten pixels: not above the area
    two[0:6, 8:10] = True
    two[0:4, 14:18] = True
    assert pixels.font_style(two) == (5.0, pixels.run_thickness(two))
    assert pixels.erosions(np.ones((4, 6), dtype=bool)) == 4
    assert pixels.erosions(np.pad(np.ones((3, 3), dtype=bool), 1)) == 2


def test_pixels_on_rows(spark):
    image = np.full((8, 20, 3), 255, np.uint8)
    image[0:6, 8:10] = 0
    image[0:4, 14:18] = 0
    df = spark.createDataFrame([("a", 20, 8, 3, bytearray(image.tobytes())), ("b", 0, 0, 3, None)], "id string, width int, height int, channels int, data binary")
    got = {r["id"]: (r["fontsize"], r["thickness"]) for r in pixels.styled(df, "id").collect()}
    assert got == {"a": (5.0, 3.0), "b": (None, None)}


def test_run_lengths_without_python(spark):
    df = spark.createDataFrame([("a", [0, 0, 255, 255, 0, 255]), ("b", [255, 255, 0, 0, 0, 0]), ("c", [])], "id string, pixels array<int>")
    got = dict(pixels.run_lengths(df, "id").collect())
    assert got["a"] == 1.5
    assert math.isnan(got["b"])
    assert math.isnan(got["c"])


def test_adapters_isolate_bad_files(spark, tmp_path):
    out = io.BytesIO()
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>T</w:t></w:r></w:p><w:p><w:r><w:t>a</w:t></w:r><w:r><w:t>b</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "good.docx").write_bytes(out.getvalue())
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    rows = adapters.extracted(adapters.files(spark, str(tmp_path), "*.docx"), "layout", adapters.office_text).collect()
    assert sorted((r["label"], r["text"]) for r in rows if r["error"] is None) == [("section_header", "T"), ("text", "ab")]
    assert len([r for r in rows if r["error"] and r["error"].startswith("BadZipFile")]) == 1


@pytest.mark.parametrize("compat", [False, True])
def test_layout_elements(spark, compat):
    from docflow.schema import LAYOUT_ITEM

    rows = [("d", i, 1, label, 0.0, 90.0, w, 80.0, "x", None, 5.0, 1.0) for i, (label, w) in enumerate([("page_header", 9.0), ("title", 9.0), ("picture", 0.2), ("list_item", 9.0), ("picture", 9.0), ("form", 9.0)])]
    got = annotations.layout_elements(spark.createDataFrame(rows, LAYOUT_ITEM), spark.createDataFrame([("d", 1, 100.0)], "doc_id string, page int, height double"), compat).orderBy("id").collect()
    assert [(r["id"], r["type"], r["src"]) for r in got] == [(1, "h", None), (2, "p" if compat else "li", None), (3, "img", "images/picture-1.png")]
    assert tuple(got[0]["bbox"]) == (4.5, 15.0, 9.0, 10.0)


class _Captured:
    """Stands for a table: gives back the function that its batches would go through."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def test_extracted_rows_are_passed_on_as_they_come():
    read = []

    def extractor(content):
        read.append(content)
        if content == b"7":
            raise ValueError("bad")
        for i in range(100):
            yield 1, i, "x" * 1000, ["f" * 500], [1.0]

    run = adapters.extracted(_Captured(), "text", extractor)
    files = pa.RecordBatch.from_pydict({"path": [f"p{i}" for i in range(200)], "content": [str(i).encode() for i in range(200)]})
    out, seen = [], []
    for b in run(iter([files])):
        out.append(b)
        seen.append(len(read))
    assert max(b.nbytes for b in out) < 10 << 20 and seen[0] < 50
    rows = [r for b in out for r in b.to_pylist()]
    assert len(rows) == 199 * 100 + 1
    assert [(r["path"], r["error"]) for r in rows if r["error"]] == [("p7", "ValueError: bad")]


def test_office_items_are_passed_on_as_they_come():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document xmlns:w='{w}'><w:body>{'<w:p><w:r><w:t>x</w:t></w:r></w:p>' * 2000}</w:body></w:document>")
    run = adapters.extracted(_Captured(), "layout", adapters.office_text)
    sizes = [b.num_rows for b in run(iter([pa.RecordBatch.from_pydict({"path": [f"{i}.docx" for i in range(40)], "content": [out.getvalue()] * 40})]))]
    assert sum(sizes) == 80_000 and max(sizes) < 30_000


def _office_file(part, head, piece, tail, times):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(part, head + piece * times + tail)
    return out.getvalue()


@pytest.mark.parametrize("kind", ["docx", "pptx", "xlsx"])
def test_office_parts_are_read_without_their_tree(kind):
    from docflow.catalog.files import _KINDS

    piece = {
        "docx": "<w:p><w:pPr><w:pStyle w:val='Heading1'/></w:pPr><w:r><w:t>x</w:t></w:r></w:p>",
        "pptx": "<p:sp><p:txBody><a:p><a:r><a:t>x</a:t></a:r></a:p></p:txBody></p:sp>",
        "xlsx": "<row><c><v>1</v></c><c><v>2</v></c></row>",
    }[kind]
    part, head, tail = _KINDS[kind]
    content = _office_file(part, head, piece, tail, 20_000)
    tracemalloc.start()
    n = sum(1 if r[7] else len(r[8].split("<tr>")) - 1 for r in adapters.office_text(content))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 20_000 and peak < 8 << 20


def test_office_nesting(spark):
    w, a, p = (f"http://schemas.openxmlformats.org/{n}/2006/main" for n in ("wordprocessingml", "drawingml", "presentationml"))
    para = "<w:p><w:r><w:t>%s</w:t></w:r></w:p>"
    word = _office_file("word/document.xml", f"<w:document xmlns:w='{w}'>{para % 'before'}<w:body>", f"{para % 'in'}<w:sdt>{para % 'control'}</w:sdt><w:tbl><w:tr><w:tc>{para % 'cell'}</w:tc></w:tr></w:tbl>", f"</w:body><w:body>{para % 'second'}</w:body></w:document>", 1)
    shape = "<p:sp><p:txBody><a:p><a:r><a:t>%s</a:t></a:r></a:p></p:txBody></p:sp>"
    table = "<p:graphicFrame><a:tbl><a:tr><a:tc><a:txBody><a:p><a:r><a:t>t</a:t></a:r></a:p></a:txBody></a:tc></a:tr></a:tbl></p:graphicFrame>"
    slide = _office_file("ppt/slides/slide1.xml", f"<p:sld xmlns:p='{p}' xmlns:a='{a}'>", f"<p:grpSp>{shape % 'in a group'}<p:grpSp>{table}</p:grpSp></p:grpSp>{shape % 'last'}", "</p:sld>", 1)
    cut = _office_file("word/document.xml", f"<w:document xmlns:w='{w}'><w:body>", para % "x", "</w:body>", 1000)
    rows = spark.createDataFrame([("a", bytearray(word)), ("b", bytearray(slide)), ("c", bytearray(cut)), ("d", None)], "path string, content binary")
    got = {r["path"]: ([(i["label"], i["text"] or i["html"]) for i in r["items"]], r["error"]) for r in adapters.extracted_whole(rows, "layout", adapters.office_text).collect()}
    assert got["a"] == ([("text", "in"), ("table", "<table><tr><td>cell</td></tr></table>")], None)
    assert got["b"] == ([("text", "in a group"), ("table", "<table><tr><td>t</td></tr></table>"), ("text", "last")], None)
    assert got["c"][0] == [] and got["c"][1].startswith("ParseError") and got["d"][0] == [] and got["d"][1]
    flat = adapters.extracted(rows, "layout", adapters.office_text).orderBy("path", "raw_ord").collect()
    assert [(r["path"], r["text"] or r["html"]) for r in flat if not r["error"]] == [(k, x) for k in "ab" for _, x in got[k][0]]
    assert {r["path"]: r["error"] for r in flat if r["error"]} == {k: got[k][1] for k in "cd"}


def test_files_that_are_passed_on_whole_fill_small_batches():
    def extractor(content):
        if content == b"7":
            raise ValueError("bad")
        for i in range(100):
            yield 1, i, "x" * 1000, ["f" * 500], [1.0]

    run = adapters.extracted_whole(_Captured(), "text", extractor)
    files = pa.RecordBatch.from_pydict({"path": [f"p{i}" for i in range(200)], "content": [str(i).encode() for i in range(200)]})
    out = list(run(iter([files])))
    assert max(b.nbytes for b in out) < 10 << 20
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["path"] for r in rows] == [f"p{i}" for i in range(200)]
    assert [(len(r["items"]), r["error"]) for r in rows] == [(0, "ValueError: bad") if i == 7 else (100, None) for i in range(200)]


def test_office_markdown_groups_no_items(spark):
    from docflow import pipelines
    from docflow.catalog.files import _KINDS

    pipelines.REGISTRY.discover("docflow.pipelines")
    part, head, tail = _KINDS["docx"]
    word = _office_file(part, head, "<w:p><w:r><w:t>x</w:t></w:r></w:p>", tail, 2)
    empty = _office_file(part, head, "", tail, 1)
    rows = spark.createDataFrame([("a", bytearray(word)), ("b", bytearray(empty)), ("c", bytearray(b"no zip"))], "task_id string, content binary")
    out = pipelines.REGISTRY.pipelines["office"].run(rows)
    assert "Aggregate" not in out._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in out.collect()] == [("a", "x\n\nx\n")]


def test_office_files_are_made_in_passing(spark, tmp_path):
    from docflow.catalog import files

    spark.range(5000).selectExpr("id AS o_orderkey", "id % 2 * 20 AS o_custkey", "'3-MEDIUM' AS o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    made = files._office(spark, str(tmp_path))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan
    found = {r["task_id"]: bytes(r["content"]) for r in made.collect()}
    assert sorted(found) == [f"{i}.{k}" for i in range(2) for k in ("docx", "pptx", "xlsx")]
    for name, raw in found.items():
        part, head, tail = files._KINDS[name[2:]]
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            body = z.read(part).decode()
            assert z.namelist() == [part] and body.startswith(head) and body.endswith(tail)
            assert body.count("3-MEDIUM") == 2500 and len(raw) < len(body) / 5


def test_office_files(spark):
    w, a, p, x = (f"http://schemas.openxmlformats.org/{n}/2006/main" for n in ("wordprocessingml", "drawingml", "presentationml", "spreadsheetml"))

    def packed(**files):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n, body in files.items():
                z.writestr(n.replace("__", "/") + ".xml", body)
        return bytearray(out.getvalue())

    cell = "<w:tc><w:p><w:r><w:t>%s</w:t></w:r></w:p></w:tc>"
    word = f"<w:document xmlns:w='{w}'><w:body><w:p><w:pPr><w:pStyle w:val='Title'/></w:pPr><w:r><w:t>T</w:t></w:r></w:p><w:tbl><w:tr>{cell % 'a'}{cell % 'b &lt;'}</w:tr></w:tbl><w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>i</w:t></w:r></w:p><w:p/></w:body></w:document>"
    slide = f"<p:sld xmlns:p='{p}' xmlns:a='{a}'><p:sp><p:nvSpPr><p:nvPr><p:ph type='title'/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>%s</a:t></a:r></a:p></p:txBody></p:sp></p:sld>"
    sheet = f"<worksheet xmlns='{x}'><sheetData><row><c t='s'><v>1</v></c><c><v>2.5</v></c></row></sheetData></worksheet>"
    strings = f"<sst xmlns='{x}'><si><t>zero</t></si><si><t>o</t><t>ne</t></si></sst>"
    files = {"a.docx": packed(word__document=word), "b.pptx": packed(ppt__slides__slide10=slide % "ten", ppt__slides__slide2=slide % "two"), "c.xlsx": packed(xl__worksheets__sheet1=sheet, xl__sharedStrings=strings), "d.zip": packed(x="x"), "e.docx": bytearray(b"no zip")}
    rows = spark.createDataFrame(list(files.items()), "path string, content binary")
    got = {}
    for r in adapters.extracted(rows, "layout", adapters.office_text).orderBy("path", "raw_ord").collect():
        got.setdefault(r["path"], []).append(r["error"] or (r["page"], r["label"], r["text"], r["html"]))
    assert got["a.docx"] == [(1, "section_header", "T", None), (1, "table", None, "<table><tr><td>a</td><td>b &lt;</td></tr></table>"), (1, "list_item", "i", None), (1, "text", "", None)]
    assert got["b.pptx"] == [(2, "title", "two", None), (10, "title", "ten", None)]
    assert got["c.xlsx"] == [(1, "table", None, "<table><tr><td>one</td><td>2.5</td></tr></table>")]
    assert got["d.zip"] == ["ValueError: no office file"] and got["e.docx"][0].startswith("BadZipFile")


def test_links_beyond_the_assets_stay(spark):
    texts = spark.createDataFrame([("a", "x ![p](u.png) y\n![](v w.png)![q](z)"), ("b", "![p](u.png)"), ("c", None)], "doc_id string, markdown string")
    assets = spark.createDataFrame([("a", f"images/picture-{i}.png") for i in (2, 1)], "doc_id string, path string")
    got = dict(markdown.relinked(texts, assets).collect())
    assert got["a"] == "x ![p](images/picture-1.png) y\n![](images/picture-2.png)![q](z)" and got["b"] == "![p](u.png)" and not got["c"]


def test_relinking_thousands_of_pictures(spark):
    n = 10_000
    text = "start " + "\n".join(f"a ![p{i}](old/{i}.png) b" for i in range(n)) + " end"
    texts = spark.createDataFrame([("many", text), ("none", None), ("plain", "no picture ![x] (y)")], "doc_id string, markdown string")
    assets = spark.range(n - 5).select(F.lit("many").alias("doc_id"), F.concat(F.lit("images/picture-"), F.col("id") + 1, F.lit(".png")).alias("path"))
    markdown.relinked(texts.limit(1), assets.limit(10)).collect()  # starts the engine
    began = time.perf_counter()
    got = dict(markdown.relinked(texts, assets).collect())
    assert time.perf_counter() - began < 5
    want = "start " + "\n".join(f"a ![p{i}]({f'images/picture-{i + 1}.png' if i < n - 5 else f'old/{i}.png'}) b" for i in range(n)) + " end"
    assert got == {"many": want, "none": None, "plain": "no picture ![x] (y)"}


def test_png_holds_the_pixels(spark):
    x = np.arange(2 * 3 * 3, dtype=np.uint8)
    raw = pixels.png(x.tobytes(), 3, 2, 3)
    size = struct.unpack(">II", raw[16:24])
    body = zlib.decompress(raw[raw.index(b"IDAT") + 4 : raw.index(b"IEND") - 8])
    lines = np.frombuffer(body, np.uint8).reshape(2, 10)
    assert size == (3, 2) and not lines[:, 0].any()
    # the file has red first, the engine's rows blue
    assert (lines[:, 1:].reshape(2, 3, 3)[:, :, ::-1] == x.reshape(2, 3, 3)).all()


def test_crops_round_half_to_even_and_are_black_outside():
    x = np.full((4, 4, 1), 9, np.uint8)
    assert pixels.crop(x, 0.5, 1.5, 2.5, 2.5).shape == (0, 2, 1)
    out = pixels.crop(x, -1, -1, 2, 2)
    assert out.shape == (3, 3, 1) and out.sum() == 4 * 9


_XML = "{http://www.w3.org/1999/xhtml}"


def _classed(node, name):
    return name in (node.get("class") or "").split()


def _by_tree(page):
    """Lines of a page by an XML parser: (par id, line number, text, bbox or None)."""
    out = []
    for par in (n for n in ElementTree.fromstring(page).iter() if _classed(n, "ocr_par")):
        for k, line in enumerate(n for n in par.iter() if n is not par and _classed(n, "ocr_line")):
            words = [("".join(w.itertext())).strip(" \t\r\n\f\v") for w in line.iter() if w is not line and _classed(w, "ocrx_word")]
            numbers = re.search(r"\bbbox (-?\d+) (-?\d+) (-?\d+) (-?\d+)", line.get("title") or "")
            out.append((par.get("id") or "", k, " ".join(words), tuple(map(int, numbers.groups())) if numbers else (None,) * 4))
    return out


def test_hocr_scanner_equals_an_xml_parser(spark):
    rng = random.Random(19)

    def attribute(name, value):
        q = rng.choice("'\"")
        value = value.replace("&", "&amp;").replace("<", "&lt;").replace(q, "&#39;" if q == "'" else "&quot;")
        return f" {name}={q}{value}{q}"

    def text():
        return "".join(rng.choice(["wörd", " ", "&amp;", "&lt;", "&#233;", "&#x6F22;", "a'b", '"', "\n", "]"]) for _ in range(rng.randint(0, 5)))

    def tag(kind, inner, depth):
        classes = {"par": "ocr_par", "line": "ocr_line", "word": "ocrx_word"}.get(kind)
        found = [attribute("class", rng.choice(["", "x ", "ocr_lines "]) + classes + rng.choice(["", " y", "\tz"]))] if classes else [attribute("class", "ocr_carea")] * rng.randint(0, 1)
        found.append(attribute("id", rng.choice(["p & q", "<i>", f"{kind}_{depth}"])))
        if rng.random() < 0.8:
            found.append(attribute("title", rng.choice(["", "image \"x; y\"; "]) + f"bbox {rng.randint(-9, 99)} {rng.randint(0, 99)} 3 4" + rng.choice(["", "; x_size 20.5", "; baseline 0 -5"])))
        rng.shuffle(found)
        # a p may not lie in a p, so paragraphs within others are div
        name = "div" if kind in ("par", "area") else "span"
        return f"<{name}{''.join(found)}>{inner}</{name}>" if inner or rng.random() < 0.5 else f"<{name}{''.join(found)}/>"

    def made(depth):
        parts = []
        for _ in range(rng.randint(0, 3)):
            kind = rng.choice(["par", "line", "line", "word", "word", "area", "em"])
            inner = made(depth + 1) if depth < 5 else text()
            parts.append(text() + (f"<em>{inner}</em><br/>" if kind == "em" else tag(kind, inner, depth)) + rng.choice(["", "<!-- <span class='ocr_line'> -->"]))
        return "".join(parts) + text()

    pages = [f'<html xmlns="http://www.w3.org/1999/xhtml"><body>{made(0)}{tag("par", made(1), 0)}</body></html>' for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(pages)), "doc_id int, hocr string").repartition(3)
    got = [(r["doc_id"], r["par_id"], r["line_ord"], r["text"], tuple(r["bbox"])) for r in hocr.lines(df).collect()]
    want = [(i, *line) for i, page in enumerate(pages) for line in _by_tree(page)]
    assert len(want) > 150
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_hocr_that_is_not_well_formed(spark):
    pages = [
        (1, "<p class=ocr_par id=a><span class=ocr_line title='bbox 1 2 3 4'><span class=ocrx_word>x</b><p class=ocr_par id=b><span class=ocr_line><span class=ocrx_word>y &amp"),
        (2, "</span></p>text<span class='ocr_line'>no paragraph</span>"),
        (3, ""),
        (4, None),
        (5, "<div class=ocr_par><span class='ocr_line' class='x' title><span class=ocrx_word><span class=ocrx_word>in</span>out</span></span></div>"),
    ]
    got = [tuple(r) for r in hocr.lines(spark.createDataFrame(pages, "doc_id int, hocr string")).select("doc_id", "par_id", "line_ord", "text", "bbox.x1", "size").orderBy("doc_id", "par_id").collect()]
    assert got == [(1, "a", 0, "x", 1, None), (1, "b", 0, "y &", None, None), (5, "", 0, "inout in", None, None)]


def test_content_scores():
    long = "some words, and more of them, to fill a paragraph that counts "
    link = f"<a href=x>{long * 9}</a>"
    pages = {
        f"<body><div class=nav><p>{link}</p><p>{link}</p></div><section><p>{long}</p><p>{long}</p></section></body>": "section",
        f"<div class='sidebar'><p>{long * 3}</p></div><div id=story><p>{long}</p></div>": "div",
        f"<div class=a><p>{long}</p><p>{long}</p></div><div class=b><p>{long}</p></div>": "div.a",
        f"<div class='outer article'><div class=one><p>{long}</p></div><div class=two><p>{long}</p></div></div>": "div.outer.article",
        f"<table><tr class=r><td>{long}</td><td>{long}</td></tr></table>": "tr.r",
        f"<ul class=u><li class=l><p>{long}</p></li><li><p>short</p></li></ul><blockquote><p>{long}</p></blockquote>": "blockquote",
        "<div class=x><p>ab</p></div><div class=y><p>abc</p></div>": "div.y",
        "<b>nothing</b>": None,
    }
    for page, want in pages.items():
        node = html.content(html.Tree(page))
        assert (node and ".".join([node.tag, *(node.attrs.get("class") or "").split()])) == want, page
    tree = html.Tree(f"<div class=story id=main><p>{long}</p>{'x' * len(long)}<a>{'y' * len(long)}</a></div>")
    n = len(long)
    worth = 1 + 2 + 0
    assert html.scores(tree) == {0: (5 + 25 + 25 + worth) * (1 - n / (3 * n))}


def test_interpolation():
    rng = np.random.default_rng(3)
    for h, w, to_h, to_w in ((5, 7, 11, 13), (12, 9, 5, 4), (1, 1, 3, 2), (2, 3, 2, 3), (30, 1, 7, 1)):
        x = rng.integers(0, 256, (h, w, 3), dtype=np.uint8)
        got = pixels.interpolated(x, to_h, to_w).astype(float)
        assert got.shape == (to_h, to_w, 3)
        ys, xs = (np.clip((np.arange(to) + 0.5) * n / to - 0.5, 0, n - 1) for n, to in ((h, to_h), (w, to_w)))
        y, x0 = np.floor(ys).astype(int), np.floor(xs).astype(int)
        fy, fx = (ys - y)[:, None, None], (xs - x0)[None, :, None]
        y1, x1 = np.minimum(y + 1, h - 1), np.minimum(x0 + 1, w - 1)
        want = (x[y][:, x0] * (1 - fx) + x[y][:, x1] * fx) * (1 - fy) + (x[y1][:, x0] * (1 - fx) + x[y1][:, x1] * fx) * fy
        assert np.abs(got - want).max() < 0.75
    same = rng.integers(0, 256, (4, 6, 1), dtype=np.uint8)
    assert (pixels.interpolated(same, 4, 6) == same).all()


def test_previews_of_empty_texts(spark, tmp_path):
    rows = [(1, "", "en", "web", 0), (2, None, "en", "web", None), (3, " x ", "de", "a b", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, documents.text_previews(spark, str(tmp_path)).collect()))
    assert got == [(1, "...", "en.web", 0, 640), (2, None, "en.web", None, 640), (3, "x...", "de.a.b", 1, 640)]
