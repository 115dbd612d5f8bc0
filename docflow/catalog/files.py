"""Files: annotations, edges, Markdown, archives, office files, extractors, uploads and tasks as streams."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import pipelines
from ..functions import text as X
from ..operators import hierarchy
from ..plans import markdown, registry
from ..sources import adapters, annotations, hocr, html
from ..sources import archives as packages
from ..storage import fresh_dir, spread, stored
from ..streaming import tasks
from .base import Catalog, table

_C = Catalog()

#: Office files in one batch of rows, in bytes (one may be larger).
_BATCH = 1 << 22


def _listed(order: str, value: Column) -> Column:
    """Values of a group as one array in order."""
    return F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda x: x["v"])


_ITEMS = """
WITH items AS (
  SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag, l_linestatus)::INTEGER AS id, l_quantity, l_returnflag || l_linestatus AS said, l_linenumber, l_partkey FROM lineitem)
"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a supplier has delivered, numbered; stands for the elements of a document."""
    nth = F.row_number().over(hierarchy.Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus"))
    return table(spark, sf_dir, "lineitem").select("l_suppkey", nth.alias("id"), "l_quantity", F.concat("l_returnflag", "l_linestatus").alias("said"), "l_linenumber", "l_partkey")


@_C.add(_ITEMS + "SELECT l_suppkey::VARCHAR AS doc_id, id, 'p' AS type, said AS text, (l_quantity / 2)::DOUBLE AS w FROM items")
def annotation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements written as one JSON array a document, and read again under the element schema."""
    n = F.col("l_quantity")
    box = F.struct(*[c.cast("double").alias(k) for k, c in (("xc", n), ("yc", n), ("w", n / 2), ("h", n))])
    rows = _items(spark, sf_dir).select(F.col("l_suppkey").cast("string").alias("doc_id"), "id", box.alias("bbox"), F.lit("p").alias("type"), F.col("said").alias("text"))
    out = fresh_dir(spark, "annotations")
    annotations.to_json_text(rows, "doc_id", "id", "doc_id", "id", "bbox", "type", "text").select(F.col("doc_id").alias("file"), F.col("annotations").alias("value")).repartition("file").write.partitionBy("file").text(out)
    return annotations.read_elements(spark, out).select("doc_id", "id", "type", "text", "bbox.w")


@_C.add(_ITEMS + "SELECT l_suppkey::INTEGER AS page, id AS ord, l_linenumber::INTEGER AS parent_id, (l_partkey + 100)::INTEGER AS child_id FROM items")
def edge_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges written as one text a page, and read again line by line."""
    found = _items(spark, sf_dir).select(F.col("l_suppkey").alias("page"), F.col("id").alias("ord"), F.col("l_linenumber").alias("parent_id"), (F.col("l_partkey") + 100).alias("child_id"))
    out = fresh_dir(spark, "edges")
    hierarchy.edge_text(found, "page").select("page", F.col("edges").alias("value")).repartition("page").write.partitionBy("page").text(out)
    read = annotations.read_edges(spark, out)
    return read.select(F.regexp_extract("path", r"page=(\d+)", 1).cast("int").alias("page"), (F.col("ord") + 1).alias("ord"), "parent_id", "child_id")


@_C.add("SELECT (o_custkey // 20)::VARCHAR AS task_id, string_agg(o_orderpriority || chr(10), chr(10) ORDER BY o_orderkey) AS markdown FROM orders GROUP BY o_custkey // 20")
def markdown_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written as one text file a task, and read again."""
    rows = table(spark, sf_dir, "orders").select(F.expr("CAST(o_custkey DIV 20 AS STRING)").alias("task_id"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("content"))
    out = fresh_dir(spark, "markdown")
    tasks.write_markdown(markdown.assembled(rows, "task_id", "id", "content"), out)
    return tasks.read_markdown(spark, out)


@_C.add("SELECT c_nationkey::VARCHAR AS task_id, 'images/picture-' || c_custkey || '.png' AS path, c_name AS content FROM customer")
def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of each task in one archive, and out of it again; tasks are few and grow with the table."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("task_id"), F.concat(F.lit("images/picture-"), "c_custkey", F.lit(".png")).alias("path"), F.encode("c_name", "UTF-8").alias("content"))
    out = fresh_dir(spark, "archives")
    packages.write_archives(rows, out)
    found = packages.contents(spread(packages.archive_members(spark, out)))
    return found.select("task_id", "path", F.decode("content", "UTF-8").alias("content"))


@_C.add(
    """WITH files AS (SELECT o_custkey // 50 AS task, o_orderpriority AS said, 'images/' || o_custkey || '.png' AS path FROM orders),
once AS (SELECT task, path, said, row_number() OVER (PARTITION BY task, path ORDER BY sha256(said)) AS nth FROM (SELECT DISTINCT * FROM files))
SELECT task::VARCHAR AS task_id, CASE nth WHEN 1 THEN path ELSE replace(path, '.png', '-' || nth || '.png') END AS path, said AS content, '' AS error FROM once"""
)
def archive_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives as files, of which members are read again by their places; files of one name and other content are numbered."""
    path = F.concat(F.lit("images/"), "o_custkey", F.lit(".png"))
    rows = table(spark, sf_dir, "orders").select(F.expr("CAST(o_custkey DIV 50 AS STRING)").alias("task_id"), path.alias("path"), F.encode("o_orderpriority", "UTF-8").alias("content"))
    out = fresh_dir(spark, "archive-files")
    packages.write_archives(rows, out)
    found = packages.contents(packages.archive_members(spark, out))
    return found.select("task_id", "path", F.decode("content", "UTF-8").alias("content"), F.coalesce("error", F.lit("")).alias("error"))


_PARTS = """
WITH parts AS (
  SELECT (p_partkey // 40)::VARCHAR AS doc_id, p_partkey::INTEGER AS id, (p_size % 3 + 1)::INTEGER AS page, CASE p_partkey % 3 WHEN 0 THEN 'p' WHEN 1 THEN 'li' ELSE 'img' END AS type,
         CASE WHEN p_partkey % 3 < 2 THEN p_name END AS text, CASE WHEN p_partkey % 3 = 2 THEN 'images/' || p_partkey || '.png' END AS src
  FROM part)
"""


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    none = F.lit(None)
    box = F.struct(*[(k % m).cast("double").alias(n) for n, m in (("xc", 7), ("yc", 11), ("w", 13), ("h", 17))])
    return table(spark, sf_dir, "part").select(
        F.expr("CAST(p_partkey DIV 40 AS STRING)").alias("doc_id"), k.cast("int").alias("id"), (F.col("p_size") % 3 + 1).cast("int").alias("page"), box.alias("bbox"), F.when(k % 3 == 0, "p").when(k % 3 == 1, "li").otherwise("img").alias("type"), F.when(k % 3 < 2, F.col("p_name")).alias("text"),
        none.cast("double").alias("fontsize"), none.cast("double").alias("thickness"), none.cast("string").alias("html"), F.when(k % 3 == 2, F.concat(F.lit("images/"), k, F.lit(".png"))).alias("src"),
    )


@_C.add(
    _PARTS
    + """SELECT doc_id, 'content_list.json' AS path, row_number() OVER (PARTITION BY doc_id ORDER BY id)::INTEGER AS nth, type, coalesce(text, src) AS said, page - 1 AS page_idx FROM parts
UNION ALL SELECT doc_id, 'model.json', row_number() OVER (PARTITION BY doc_id ORDER BY id)::INTEGER, type, id::VARCHAR, -1 FROM parts
UNION ALL SELECT doc_id, 'middle.json', row_number() OVER (PARTITION BY doc_id ORDER BY id)::INTEGER, 'box', (id % 13)::VARCHAR || 'x' || (id % 17)::VARCHAR, page - 1 FROM parts
UNION ALL SELECT doc_id, 'text.md', 1, 'md', string_agg(CASE type WHEN 'p' THEN text WHEN 'li' THEN '- ' || text ELSE '![Image](' || src || ')' END || chr(10), chr(10) ORDER BY id), -1 FROM parts GROUP BY doc_id"""
)
def bundle_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text and the three JSON files of each document's bundle, read again."""
    files = markdown.bundle(_parts(spark, sf_dir))
    shape = "array<struct<type:string,text:string,page_idx:int,img_path:string,table_body:string,id:int,bbox:struct<xc:double,yc:double,w:double,h:double>>>"
    rows = files.where("path <> 'text.md'").select("doc_id", "path", F.posexplode(F.from_json("content", shape)).alias("i", "e"))
    box = F.concat(F.col("e.bbox.w").cast("int").cast("string"), F.lit("x"), F.col("e.bbox.h").cast("int").cast("string"))
    said = F.when(F.col("path") == "middle.json", box).when(F.col("path") == "model.json", F.col("e.id").cast("string")).otherwise(F.coalesce("e.text", "e.img_path"))
    rows = rows.select("doc_id", "path", (F.col("i") + 1).alias("nth"), F.coalesce("e.type", F.lit("box")).alias("type"), said.alias("said"), F.coalesce("e.page_idx", F.lit(-1)).alias("page_idx"))
    return rows.unionByName(files.where("path = 'text.md'").select("doc_id", "path", F.lit(1).alias("nth"), F.lit("md").alias("type"), F.col("content").alias("said"), F.lit(-1).alias("page_idx")))


@_C.add(
    """WITH said AS (
  SELECT *, (o_custkey // 20)::VARCHAR AS doc_id, row_number() OVER (PARTITION BY o_custkey // 20 ORDER BY o_orderkey) AS nth, count(*) FILTER (WHERE o_orderstatus <> 'P') OVER (PARTITION BY o_custkey // 20) AS n_assets FROM orders)
SELECT doc_id, string_agg('See ![' || o_orderpriority || '](' || CASE WHEN nth <= n_assets THEN 'images/picture-' || nth ELSE 'x_artifacts/image_' || o_orderkey END || '.png).', chr(10) ORDER BY o_orderkey) AS markdown
FROM said GROUP BY doc_id"""
)
def relinked_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exporter's Markdown whose pictures point to the files of the bundle, hundreds in a document; some files are missing."""
    rows = table(spark, sf_dir, "orders").select(F.expr("CAST(o_custkey DIV 20 AS STRING)").alias("doc_id"), "o_orderkey", "o_orderpriority", "o_orderstatus")
    line = F.concat(F.lit("See !["), "o_orderpriority", F.lit("](x_artifacts/image_"), "o_orderkey", F.lit(".png)."))
    texts = rows.groupBy("doc_id").agg(F.array_join(_listed("o_orderkey", line), "\n").alias("markdown"))
    there = rows.where("o_orderstatus <> 'P'").select("doc_id", F.col("o_orderkey").alias("id"), F.lit("img").alias("type"))
    return markdown.relinked(texts, annotations.asset_paths(there, "doc_id"), "doc_id")


_NS = {"w": "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "a": "http://schemas.openxmlformats.org/drawingml/2006/main", "p": "http://schemas.openxmlformats.org/presentationml/2006/main", "s": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


#: Of each kind of office file the part with its body, and what stands before and after that.
_KINDS = {
    "docx": ("word/document.xml", f'<w:document xmlns:w="{_NS["w"]}"><w:body>', "</w:body></w:document>"),
    "pptx": ("ppt/slides/slide1.xml", f'<p:sld xmlns:p="{_NS["p"]}" xmlns:a="{_NS["a"]}"><p:cSld><p:spTree>', "</p:spTree></p:cSld></p:sld>"),
    "xlsx": ("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{_NS["s"]}"><sheetData>', "</sheetData></worksheet>"),
}


def _office(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (task_id, content): one word-processor, slide and spreadsheet file for the orders of each twenty customers.

    Orders meet as rows, sorted by file, and become markup as they pass into it; a task holds one file, deflated.
    """
    n, k, kind = F.col("o_orderpriority"), F.col("o_orderkey"), F.col("kind")
    word = F.concat(F.lit('<w:p><w:pPr><w:pStyle w:val="'), F.when(k % 2 == 0, "Heading1").otherwise("ListBullet"), F.lit('"/></w:pPr><w:r><w:t>'), n, F.lit("</w:t></w:r></w:p>"))
    slide = F.concat(F.lit("<p:sp><p:nvSpPr><p:nvPr/></p:nvSpPr><p:txBody><a:p><a:r><a:t>"), n, F.lit("</a:t></a:r></a:p></p:txBody></p:sp>"))
    sheet = F.concat(F.lit("<row><c><v>"), k, F.lit('</v></c><c t="inlineStr"><is><t>'), n, F.lit("</t></is></c></row>"))
    rows = table(spark, sf_dir, "orders").select(F.expr("o_custkey DIV 20").alias("file"), k, n, F.explode(F.array(*map(F.lit, _KINDS))).alias("kind"))
    rows = rows.repartition("file", "kind").sortWithinPartitions("file", "kind", "o_orderkey", "o_orderpriority")
    return rows.select(F.concat(F.col("file").cast("string"), F.lit("."), "kind").alias("task_id"), "kind", F.when(kind == "docx", word).when(kind == "pptx", slide).otherwise(sheet).alias("piece")).mapInArrow(_zipped, "task_id string, content binary")


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Office files, each of rows (task_id, kind, piece) that follow one another."""
    done, size, now = [], 0, None

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.string(), pa.binary()), strict=True)], names=["task_id", "content"])

    def ended() -> int:
        key, out, z, body = now
        body.write(_KINDS[key[1]][2].encode())
        body.close()
        z.close()
        done.append((key[0], out.getvalue()))
        return 200 + len(done[-1][1])

    for b in batches:
        rows = zip(*[c.to_pylist() for c in b.columns], strict=True)
        for key, found in groupby(rows, key=lambda r: r[:2]):
            if now is None or now[0] != key:
                size += ended() if now is not None else 0
                if size > _BATCH:
                    yield made()
                    done, size = [], 0
                part = zipfile.ZipInfo(_KINDS[key[1]][0])
                part.compress_type = zipfile.ZIP_DEFLATED
                z = zipfile.ZipFile(out := io.BytesIO(), "w")
                now = key, out, z, z.open(part, "w")
                now[3].write(_KINDS[key[1]][1].encode())
            now[3].write("".join(r[2] or "" for r in found).encode())
    if now is not None:
        ended()
        yield made()


_TWENTIES = "WITH said AS (SELECT o_custkey // 20 AS file, o_orderkey AS k, o_orderpriority AS n FROM orders)\n"


@_C.add(
    _TWENTIES
    + """SELECT file || '.docx' AS path, (row_number() OVER w - 1)::BIGINT AS raw_ord, CASE k % 2 WHEN 0 THEN 'section_header' ELSE 'list_item' END AS label, n AS said FROM said WINDOW w AS (PARTITION BY file ORDER BY k)
UNION ALL SELECT file || '.pptx', (row_number() OVER w - 1)::BIGINT, 'text', n FROM said WINDOW w AS (PARTITION BY file ORDER BY k)
UNION ALL SELECT file || '.xlsx', 0, 'table', '<table>' || string_agg('<tr><td>' || k || '</td><td>' || n || '</td></tr>', '' ORDER BY k) || '</table>' FROM said GROUP BY file"""
)
def office_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of word-processor, slide and spreadsheet files."""
    found = adapters.extracted(_office(spark, sf_dir).select(F.col("task_id").alias("path"), "content"), "layout", adapters.office_text)
    return found.select("path", "raw_ord", "label", F.coalesce("text", "html").alias("said"))


_LINES = """
WITH lines AS (
  SELECT o_custkey AS file, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INTEGER AS n, o_orderstatus AS flag, left(o_orderpriority, 1) AS status FROM orders)
"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (path, content): one text for each customer, a line for each order; stands for a folder of files."""
    nth = F.row_number().over(hierarchy.Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = table(spark, sf_dir, "orders").select("o_custkey", nth.alias("n"), "o_orderstatus", F.left("o_orderpriority", F.lit(1)).alias("status"))
    text = F.array_join(_listed("n", F.concat_ws("|", "n", "o_orderstatus", "status")), "\n")
    return rows.groupBy(F.col("o_custkey").cast("string").alias("path")).agg(F.encode(text, "UTF-8").alias("content"))


def _lines(content: bytes) -> list[list[str]]:
    return [line.split("|") for line in content.decode().split("\n")]


def _tables_of(content: bytes) -> Iterator[tuple]:
    # each line is a table of one row with one empty cell
    for n, flag, status in _lines(content):
        yield 1, int(n) - 1, [[flag, None, status]]


def _layout_of(content: bytes, scale: float = 1.0) -> Iterator[tuple]:
    for n, flag, status in _lines(content):
        yield int(n), 1, "text" if flag == "O" else "list_item", 0.0, 10.0 * scale, 5.0 * scale, 0.0, flag + status, None, None, None


def _text_of(content: bytes) -> Iterator[tuple]:
    for n, flag, status in _lines(content):
        yield 1, int(n), flag, sorted({flag, status}), [float(n)]


def _hocr_of(content: bytes) -> Iterator[tuple]:
    words = " ".join(f"<span class='ocrx_word'>{flag}{status}</span>" for _, flag, status in _lines(content))
    yield 1, f"<p class='ocr_par' id='p1'><span class='ocr_line' title='bbox 1 2 3 4; x_size 9.5'>{words}</span></p>"


def _edges_of(content: bytes, mode: str = "auto") -> Iterator[tuple]:
    lines = _lines(content)
    if mode == "strict" and len(lines) > 5:
        raise ValueError("too long")
    yield ("Edges:\n" + "\n".join(f"#0->#{n}" for n, _, _ in lines),)


def _html_of(content: bytes) -> Iterator[tuple]:
    yield ("<main>" + "".join(f"<p>{flag}{status}" for _, flag, status in _lines(content)) + "</main>",)


@_C.add(_LINES + "SELECT file::VARCHAR AS path, '|' || flag || '|None|' || status || '|' AS pipes FROM lines WHERE n = 3")
def extracted_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third table of each file's first page, as a pipe table; files with fewer have none."""
    found = adapters.kth_table(adapters.extracted(_texts(spark, sf_dir), "tables", _tables_of), 1, 2)
    return found.select("path", X.pipe_table(F.col("cells")).alias("pipes"))


@_C.add(
    _LINES + "SELECT file::VARCHAR AS doc_id, n AS id, CASE flag WHEN 'O' THEN 'p' ELSE 'li' END AS type, flag || status AS text, 5.0::DOUBLE AS xc, 90.0::DOUBLE AS yc FROM lines"
)
def extracted_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout items of each file by an extractor at a page scale of two, made elements."""
    items = adapters.extracted(_texts(spark, sf_dir), "layout", _layout_of, scale=2.0).withColumnRenamed("path", "doc_id")
    sizes = items.select("doc_id", "page").distinct().withColumn("height", F.lit(100.0))
    return annotations.layout_elements(items, sizes).select("doc_id", "id", "type", "text", "bbox.xc", "bbox.yc")


@_C.add(_LINES + "SELECT file::VARCHAR AS path, n AS ord, flag AS text, status || ',' || flag AS fonts, n::DOUBLE AS size FROM lines")
def extracted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text layer of each file: blocks in order with their fonts and sizes."""
    found = adapters.extracted(_texts(spark, sf_dir), "text", _text_of)
    return found.select("path", "ord", "text", F.array_join("fonts", ",").alias("fonts"), F.get("sizes", F.lit(0)).alias("size"))


@_C.add(_LINES + "SELECT file::VARCHAR AS doc_id, string_agg(flag || status, ' ' ORDER BY n) AS text, 9.5::DOUBLE AS size FROM lines GROUP BY file")
def extracted_hocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the hOCR that an extractor gives for each image."""
    found = adapters.extracted(_texts(spark, sf_dir), "hocr", _hocr_of).withColumnRenamed("path", "doc_id")
    return hocr.lines(found).select("doc_id", "text", "size")


@_C.add(
    _LINES
    + """, sizes AS (SELECT file, count(*) AS all_ FROM lines GROUP BY file)
SELECT file::VARCHAR AS path, CASE WHEN all_ > 5 THEN -1 ELSE n END::INTEGER AS child_id, CASE WHEN all_ > 5 THEN 'ValueError: too long' ELSE '' END AS error
FROM lines JOIN sizes USING (file) WHERE all_ <= 5 OR n = 1"""
)
def extracted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges in a model's answer for each file; in its strict mode it refuses some, which are rows with an error."""
    found = adapters.extracted(_texts(spark, sf_dir), "edges", _edges_of, mode="strict")
    rows = found.select("path", F.coalesce("error", F.lit("")).alias("error"), F.explode_outer(X.edge_lines(F.col("answer"))).alias("e"))
    return rows.select("path", F.coalesce("e.child_id", F.lit(-1)).alias("child_id"), "error")


@_C.add(_LINES + "SELECT file AS page_id, n AS ord, flag || status AS text FROM lines")
def extracted_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the HTML that a converter gives for each file."""
    pages = adapters.extracted(_texts(spark, sf_dir), "html", _html_of).select(F.col("path").cast("long").alias("page_id"), "html")
    return html.blocks(pages).select("page_id", "ord", "text")


@_C.add(
    """SELECT s_name || '.' || CASE s_suppkey % 2 WHEN 0 THEN 'PDF' ELSE 'docx' END AS filename, CASE s_suppkey % 5 WHEN 4 THEN 'none' ELSE 'layout' END AS model,
  CASE WHEN s_suppkey % 5 = 4 THEN 'unknown model' WHEN s_suppkey % 2 = 0 THEN 'accepted' ELSE 'wrong extension' END AS verdict, '.' || CASE s_suppkey % 2 WHEN 0 THEN 'PDF' ELSE 'docx' END AS extension FROM supplier"""
)
def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that arrive in a landing zone, as a stream against the registry."""
    base = fresh_dir(spark, "uploads")
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier")
    name = F.concat("s_name", F.lit("."), F.when(k % 2 == 0, "PDF").otherwise("docx"))
    tasks.land(rows.select(F.when(k % 5 == 4, "none").otherwise("layout").alias("model"), name.alias("filename"), F.encode("s_name", "UTF-8").alias("content")), f"{base}/zone")
    models = spark.createDataFrame([("layout", ["pdf"])], "model string, extensions array<string>")

    def batch(df: DataFrame, number: int) -> None:
        tasks.uploaded(df, models).write.mode("overwrite").parquet(f"{base}/tasks/batch={number}")

    tasks.drained(tasks.upload_stream(spark, f"{base}/zone", rows.count() // 3 + 1, by_time=True).writeStream.foreachBatch(batch).option("checkpointLocation", f"{base}/checkpoint").start())
    found = spark.read.parquet(f"{base}/tasks")
    return found.select("filename", "model", "verdict", F.expr("substring(pdf_path, length(task_id) + 1)").alias("extension"))


@_C.add("SELECT s_name AS model, string_agg('.' || lower(kind), ',' ORDER BY kind) AS accept FROM (SELECT DISTINCT s_name, l_returnflag || l_linestatus AS kind FROM supplier JOIN lineitem ON l_suppkey = s_suppkey) GROUP BY s_name")
def models_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry written as a JSON map, and read again as the accept lists of forms; suppliers stand for models."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    models = rows.groupBy(F.col("s_name").alias("model")).agg(F.sort_array(F.collect_set(F.lower(F.concat("l_returnflag", "l_linestatus")))).alias("extensions"))
    out = fresh_dir(spark, "models")
    registry.stored(models).select(F.col("models").alias("value")).write.text(out)
    return registry.parsed(spark.read.text(out, wholetext=True), "value").select("model", X.accepted(F.col("extensions")).alias("accept"))


@_C.add("SELECT conv_id, turn, '> ' || text || '!' AS text FROM conversations WHERE role = 'assistant'")
def chained_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps one after another as one step."""
    steps = [lambda d: d.where("role = 'assistant'"), lambda d: d.withColumn("text", F.concat(F.lit("> "), "text")), lambda d: d.withColumn("text", F.concat("text", F.lit("!"))), lambda d: d.select("conv_id", "turn", "text")]
    return registry.chain(steps)(table(spark, sf_dir, "conversations"))


@_C.add(
    """SELECT doc_id::VARCHAR AS task_id, CASE WHEN doc_id % 3 < 2 AND text <> '' THEN text || chr(10) END AS markdown, CASE WHEN doc_id % 3 = 2 THEN 'unknown model' WHEN coalesce(text, '') = '' THEN 'no result' END AS error FROM documents"""
)
def discovered_pipelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks through pipelines that are found in a package; tasks without a model go to its default."""
    pipelines.REGISTRY.discover(pipelines.__name__)
    k = F.col("doc_id") % 3
    asked = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("task_id"), "text", F.lit(None).cast("binary").alias("content"), F.when(k == 0, "plain").when(k == 2, "none").alias("model"))
    return pipelines.REGISTRY.convert(asked)


@_C.add(
    _TWENTIES
    + """SELECT file || '.docx' AS task_id, string_agg(CASE k % 2 WHEN 0 THEN '# ' ELSE '- ' END || n || chr(10), chr(10) ORDER BY k) AS markdown FROM said GROUP BY file
UNION ALL SELECT file || '.pptx', string_agg(n || chr(10), chr(10) ORDER BY k) FROM said GROUP BY file
UNION ALL SELECT file || '.xlsx', '<table>' || string_agg('<tr><td>' || k || '</td><td>' || n || '</td></tr>', '' ORDER BY k) || '</table>' || chr(10) FROM said GROUP BY file"""
)
def office_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Office files to Markdown by the package's own pipeline."""
    pipelines.REGISTRY.discover(pipelines.__name__)
    # every model's pipeline reads the tasks; their files are made once
    asked = stored(_office(spark, sf_dir), "office-files").select("task_id", "content", F.lit(None).cast("string").alias("text"), F.lit("office").alias("model"))
    return pipelines.REGISTRY.convert(asked).select("task_id", "markdown")


QUERIES, SQL = _C.queries, _C.sql
