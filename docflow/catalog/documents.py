"""Documents: heading levels, Markdown, tables, hOCR, annotations, formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.geometry import fitted
from ..operators import headers
from ..plans import markdown
from ..schema import LABELS
from ..sources import adapters, annotations, hocr
from .base import Catalog, table

_C = Catalog()

# headings of a document are the parts of a brand and size; sizes and strokes fall into a few groups
_HEADERS = """
WITH headers AS (
  SELECT p_brand || '/' || p_size AS doc_id, p_partkey::INTEGER AS id, (10 + p_partkey * 7 % 5 * 4 + p_partkey % 3 * 0.25)::DOUBLE AS fontsize, (2 + p_partkey * 7 % 5 % 3)::DOUBLE AS thickness FROM part),
z AS (
  SELECT *, (fontsize - avg(fontsize) OVER d) / CASE WHEN stddev_pop(fontsize) OVER d = 0 THEN 1 ELSE stddev_pop(fontsize) OVER d END AS zf,
         (thickness - avg(thickness) OVER d) / CASE WHEN stddev_pop(thickness) OVER d = 0 THEN 1 ELSE stddev_pop(thickness) OVER d END AS zt
  FROM headers WINDOW d AS (PARTITION BY doc_id))
"""
_CLUSTERS = (
    _HEADERS.replace("WITH", "WITH RECURSIVE", 1)
    + """, near AS (SELECT a.doc_id, a.id AS a, b.id AS b FROM z a JOIN z b ON a.doc_id = b.doc_id AND (a.zf - b.zf) ** 2 + (a.zt - b.zt) ** 2 <= 0.25),
reach(doc_id, a, b) AS (SELECT doc_id, a, b FROM near UNION SELECT r.doc_id, r.a, n.b FROM reach r JOIN near n ON n.doc_id = r.doc_id AND n.a = r.b),
part_of AS (SELECT doc_id, a AS id, min(b) AS root, count(DISTINCT b) AS n FROM reach GROUP BY doc_id, a),
clustered AS (
  SELECT h.*, CASE WHEN p.n = 1 THEN -1 ELSE (SELECT count(DISTINCT q.root) FROM part_of q WHERE q.doc_id = p.doc_id AND q.n > 1 AND q.root < p.root) END::INTEGER AS cluster
  FROM headers h JOIN part_of p ON p.doc_id = h.doc_id AND p.id = h.id),
means AS (SELECT doc_id, cluster, avg(fontsize) AS mean_fontsize, avg(thickness) AS mean_thickness, count(*) AS n, min(id) AS first_id FROM clustered WHERE cluster <> -1 GROUP BY doc_id, cluster)
"""
)


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    size = 10 + k * 7 % 5 * 4 + k % 3 * 0.25
    return table(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", "p_size").alias("doc_id"), k.cast("int").alias("id"), size.cast("double").alias("fontsize"), (2 + k * 7 % 5 % 3).cast("double").alias("thickness"))


@_C.add(_HEADERS + "SELECT doc_id, id, round(zf, 6) AS z_fontsize, round(zt, 6) AS z_thickness FROM z")
def standardised_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and strokes in population standard deviations from their document's mean."""
    return headers.standardised(_headers(spark, sf_dir), "doc_id").select("doc_id", "id", *[F.round(c, 6).alias(c) for c in ("z_fontsize", "z_thickness")])


@_C.add(_CLUSTERS + "SELECT doc_id, cluster, round(mean_fontsize, 6) AS mean_fontsize, round(mean_thickness, 6) AS mean_thickness, n, first_id FROM means")
def header_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of each document's clusters of headings."""
    found = headers.cluster_means(headers.clustered(_headers(spark, sf_dir), "doc_id"), "doc_id")
    return found.select("doc_id", "cluster", F.round("mean_fontsize", 6).alias("mean_fontsize"), F.round("mean_thickness", 6).alias("mean_thickness"), "n", "first_id")


_LEVEL = """, ranked AS (SELECT doc_id, cluster, row_number() OVER (PARTITION BY doc_id ORDER BY mean_fontsize DESC, mean_thickness DESC, first_id)::INTEGER AS rank FROM means),
firsts AS (SELECT doc_id, arg_min(fontsize, id) AS first_size FROM headers GROUP BY doc_id),
levels AS (
  SELECT c.doc_id, c.id, c.cluster, CASE WHEN c.cluster = -1 THEN CASE WHEN c.fontsize > f.first_size THEN 1 END ELSE r.rank END AS level
  FROM clustered c JOIN firsts f USING (doc_id) LEFT JOIN ranked r ON r.doc_id = c.doc_id AND r.cluster = c.cluster)
"""


@_C.add(_CLUSTERS + _LEVEL + "SELECT doc_id, id, cluster, coalesce(level, 0) AS level FROM levels")
def header_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading levels by rank of cluster; lone headings against the first one."""
    return headers.levels(_headers(spark, sf_dir)).fillna(0, ["level"])


@_C.add(
    _CLUSTERS
    + _LEVEL
    + """, elements AS (
  SELECT doc_id, id, 0 AS k, CASE WHEN level IS NULL THEN 'Part ' || id ELSE repeat('#', level) || ' Part ' || id END AS line FROM levels
  UNION ALL
  SELECT p_brand || '/' || p_size, p_partkey::INTEGER, 1, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN '- ' || p_name WHEN 2 THEN '![Image](images/' || p_partkey || '.png)' ELSE '<table><tr><td>' || p_type || '</td></tr></table>' END FROM part)
SELECT doc_id, string_agg(line || chr(10), chr(10) ORDER BY id, k) AS markdown FROM elements GROUP BY doc_id"""
)
def document_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents: headings by cluster, then paragraphs, list items, pictures and tables, as Markdown."""
    heads = _headers(spark, sf_dir).select("doc_id", (F.col("id") * 2).alias("id"), F.lit("h").alias("type"), F.concat(F.lit("Part "), "id").alias("text"), "fontsize", "thickness", F.lit(None).cast("string").alias("html"), F.lit(None).cast("string").alias("src"))
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, ("p", "li", "img", "table"))), (k % 4).cast("int") + 1)
    none = F.lit(None).cast("double")
    body = table(spark, sf_dir, "part").select(
        F.concat_ws("/", "p_brand", "p_size").alias("doc_id"), (k * 2 + 1).cast("int").alias("id"), kind.alias("type"), F.col("p_name").alias("text"), none.alias("fontsize"), none.alias("thickness"), F.concat(F.lit("<table><tr><td>"), "p_type", F.lit("</td></tr></table>")).alias("html"), F.concat(F.lit("images/"), k, F.lit(".png")).alias("src")
    )
    return markdown.render(heads.unionByName(body))


@_C.add(
    """SELECT o_custkey AS doc_id, array_to_string(list(line ORDER BY o_orderkey), '') AS markdown FROM (
  SELECT *, CASE o_orderkey % 3 WHEN 0 THEN chr(10) WHEN 1 THEN o_orderpriority || chr(10) || chr(10) ELSE '- ' || o_orderpriority || chr(10) || chr(10) END AS line FROM orders) GROUP BY o_custkey"""
)
def odd_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of unknown kinds say nothing, but their empty line stays."""
    k = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), k.alias("id"), F.when(k % 3 == 0, "odd").when(k % 3 == 1, "p").otherwise("li").alias("type"), F.col("o_orderpriority").alias("text"), none.alias("src"), none.alias("html"))
    found = markdown.assembled(rows.withColumn("content", markdown.line(False)), "doc_id", "id", "content")
    return found.select("doc_id", F.concat("markdown", F.lit("\n")).alias("markdown"))


@_C.add("SELECT o_custkey AS doc_id, string_agg('|' || replace(o_orderpriority, '-', ' ') || '|' || CASE WHEN o_orderkey % 3 = 0 THEN 'None' ELSE o_orderkey::VARCHAR END || '|', chr(10) ORDER BY o_orderkey) AS pipes FROM orders GROUP BY o_custkey")
def pipe_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of cells as pipe tables; line breaks in cells become blanks, missing cells are spelled out."""
    k = F.col("o_orderkey")
    cells = F.array(F.regexp_replace("o_orderpriority", "-", "\n"), F.when(k % 3 != 0, k.cast("string")))
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", cells.alias("cells")))).alias("rows"))
    return rows.select("doc_id", X.pipe_table(F.transform("rows", lambda r: r["cells"])).alias("pipes"))


_WORDS = "list_filter(regexp_split_to_array(regexp_replace(text, '[^A-Za-z ]', ' ', 'g'), ' +'), lambda w: w <> '')"


@_C.add(
    f"""SELECT conv_id::VARCHAR AS doc_id, 'par_' || turn AS par_id, 0 AS line_ord, array_to_string({_WORDS}, ' ') AS text,
  turn::INTEGER AS x1, (turn + 1)::INTEGER AS y1, (turn + 20)::INTEGER AS x2, (turn + 30)::INTEGER AS y2, (turn + 0.5)::DOUBLE AS size FROM conversations"""
)
def hocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of OCR pages: words, box and size of each line; turns of conversations stand for paragraphs."""
    rows = table(spark, sf_dir, "conversations")
    words = F.array_remove(F.split(F.regexp_replace("text", "[^A-Za-z ]", " "), " +"), "")
    spans = F.array_join(F.transform(words, lambda w: F.concat(F.lit('<span class="ocrx_word">'), w, F.lit("</span>"))), " ")
    head = F.format_string('<p class="ocr_par" id="par_%d"><span class="ocr_line" id="line_%d" title="bbox %d %d %d %d; x_size %d.5">', "turn", "turn", "turn", F.col("turn") + 1, F.col("turn") + 20, F.col("turn") + 30, "turn")
    pars = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.concat(head, spans, F.lit("</span></p>")).alias("p")))).alias("ps"))
    page = pars.select(F.col("conv_id").cast("string").alias("doc_id"), F.concat(F.lit("<html><body>"), F.array_join(F.transform("ps", lambda p: p["p"]), ""), F.lit("</body></html>")).alias("hocr"))
    return hocr.lines(page).select("doc_id", "par_id", "line_ord", "text", "bbox.*", "size")


_ODD = "list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


@_C.add(
    f"""SELECT conv_id::VARCHAR AS doc_id, 'par & ' || turn AS par_id, k::INTEGER AS line_ord, CASE k WHEN 0 THEN array_to_string({_ODD}, ' ') ELSE role || ' <é>' END AS text,
  CASE k WHEN 0 THEN turn ELSE -turn END::INTEGER AS x1, CASE k WHEN 0 THEN turn + 0.5 END::DOUBLE AS size
FROM conversations, range(2) lines(k)"""
)
def varied_hocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of OCR pages as other tools write them: several classes, either quote, references, nested and closed tags."""

    def written(c: Column) -> Column:
        for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&#62;"), ('"', "&quot;"), ("e", "&#101;"), ("o", "&#x6F;")):
            c = F.replace(c, F.lit(old), F.lit(new))
        return c

    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    spans = F.array_join(F.transform(words, lambda w: F.concat(F.lit("<span id='w' class='x ocrx_word'> <strong>"), written(w), F.lit("</strong><br/></span>"))), "\n")
    turn = F.col("turn").cast("string")
    par = F.concat(
        F.lit("<!-- <p class='ocr_par'> --><p lang=en class='ocr_par  left' id='par &amp; "), turn, F.lit("'><span title='bbox "), turn, F.lit(" 2 3 4; x_size "), turn, F.lit(".5; image &quot;a; b&quot;' class=\"ocr_textfloat ocr_line\">"), spans,
        F.lit("</span><span class=\"ocr_line\" title='x_wconf 9; bbox -"), turn, F.lit(" 2 3 4'><em><span class=ocrx_word>"), F.col("role"), F.lit("</span></em><span class=ocrx_word>&lt;&eacute;&gt;</span></span><span class='ocr_lines'><span class=ocrx_word>no</span></span></p>"),
    )
    pages = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("doc_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", par.alias("p")))), lambda p: p["p"]), "").alias("hocr"))
    return hocr.lines(pages).select("doc_id", "par_id", "line_ord", "text", "bbox.x1", "size")


@_C.add("SELECT conv_id, turn, role AS type, text FROM conversations")
def annotation_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements to one JSON array a document and back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("id"), F.col("role").alias("type"), "text")
    back = annotations.from_json_text(annotations.to_json_text(rows, "conv_id", "id", "id", "type", "text"), "conv_id", "annotations")
    return back.select("conv_id", F.col("id").cast("long").alias("turn"), "type", "text")


_LABEL_LIST = ", ".join(f"'{x}'" for x in LABELS)


@_C.add(
    f"""WITH raw AS (
  SELECT o_custkey::VARCHAR AS doc_id, o_orderkey AS raw_ord, list_extract([{_LABEL_LIST}], (o_orderkey % 17)::INTEGER + 1) AS label, o_orderkey % 5 AS l, o_orderkey % 5 + o_orderkey % 4 AS r, 90 - o_orderkey % 7 AS t, 80 - o_orderkey % 7 AS b FROM orders),
kept AS (SELECT * FROM raw WHERE label NOT IN ('page_footer', 'page_header', 'form', 'key_value_region') AND r > l)
SELECT doc_id, row_number() OVER w::INTEGER AS id, (l + r) / 2.0 AS xc, (100 - t + 100 - b) / 2.0 AS yc, (r - l)::DOUBLE AS w, (t - b)::DOUBLE AS h,
  CASE WHEN label IN ('section_header', 'title') THEN 'h' WHEN label IN ('table', 'document_index') THEN 'table' WHEN label = 'picture' THEN 'img' WHEN label = 'list_item' THEN 'li' ELSE 'p' END AS type,
  CASE WHEN label = 'picture' THEN 'images/picture-' || count(*) FILTER (WHERE label = 'picture') OVER w || '.png' END AS src
FROM kept WINDOW w AS (PARTITION BY doc_id ORDER BY raw_ord)"""
)
def layout_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout items to elements: dropped labels and empty crops, dense ids, kinds, boxes, picture names."""
    k = F.col("o_orderkey")
    label = F.element_at(F.array(*map(F.lit, LABELS)), (k % 17).cast("int") + 1)
    none = F.lit(None)
    items = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("doc_id"), k.alias("raw_ord"), F.lit(1).alias("page"), label.alias("label"), *[c.cast("double").alias(n) for c, n in ((k % 5, "l"), (90 - k % 7, "t"), (k % 5 + k % 4, "r"), (80 - k % 7, "b"))],
        F.col("o_orderpriority").alias("text"), none.cast("string").alias("html"), none.cast("double").alias("fontsize"), none.cast("double").alias("thickness"),
    )
    sizes = items.select("doc_id", "page").distinct().withColumn("height", F.lit(100.0))
    return annotations.layout_elements(items, sizes).select("doc_id", "id", "bbox.*", "type", "src")


@_C.add(
    """SELECT doc_id, left(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 35) || '...' AS preview, lang || '.' || source AS selector,
  trunc(n_chars * least(640 / n_chars::DOUBLE, 640 / 1000.0::DOUBLE))::INTEGER AS width, trunc(1000 * least(640 / n_chars::DOUBLE, 640 / 1000.0::DOUBLE))::INTEGER AS height FROM documents"""
)
def text_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Previews of texts, selectors from a tag and classes, sizes fitted to a longest side."""
    rows = table(spark, sf_dir, "documents").withColumn("fit", fitted(F.col("n_chars"), F.lit(1000)))
    return rows.select("doc_id", X.preview(F.col("text")).alias("preview"), X.selector(F.col("lang"), F.col("source")).alias("selector"), "fit.width", "fit.height")


@_C.add("SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS fonts, array_to_string(list_sort(list(DISTINCT l_linenumber)), ',') AS sizes FROM lineitem GROUP BY l_orderkey")
def text_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Font names and sizes of each text block, each once; lines of an order stand for characters."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(X.distinct_formats(F.collect_list(F.struct(F.col("l_returnflag").alias("font"), F.col("l_linenumber").alias("size")))).alias("f"))
    return rows.select("l_orderkey", F.array_join("f.fonts", ",").alias("fonts"), F.array_join(F.col("f.sizes").cast("array<string>"), ",").alias("sizes"))


@_C.add("SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'assistant' AND trim(text) <> '' GROUP BY conv_id")
def first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First container with text of each document: the first answer of a conversation."""
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return adapters.first_match(rows, "conv_id", ("turn",), "text")


@_C.add("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A look at the first rows of a table, of which a few are asked for."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", (-F.col("o_totalprice")).alias("least"))
    return annotations.preview(rows, 5, "least", "o_orderkey").drop("least")


QUERIES, SQL = _C.queries, _C.sql
