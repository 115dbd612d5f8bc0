"""Images: grey values, ink, glyphs, crops, overlays, PNG files; pixels are arithmetic on page ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pixels
from ..functions import text as X
from ..schema import LABELS
from ..sources import annotations
from .base import Catalog, table

_C = Catalog()
_W, _H = 16, 12

_COLOUR = f"""
WITH px AS (SELECT page_id, y, x, c, (page_id * 31 + y * 17 + x * 7 + c * 50) % 256 AS v FROM pages, range({_H}) ys(y), range({_W}) xs(x), range(3) cs(c)),
grey AS (SELECT page_id, y, x, (299 * max(v) FILTER (WHERE c = 0) + 587 * max(v) FILTER (WHERE c = 1) + 114 * max(v) FILTER (WHERE c = 2) + 500) // 1000 AS g FROM px GROUP BY ALL)
"""


def _bytes(values: Column) -> Column:
    """An array of small numbers as bytes."""
    return F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), ""))


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.sequence(F.lit(0), F.lit(_W * _H * 3 - 1))
    value = F.transform(i, lambda k: (F.col("page_id") * 31 + F.floor(k / (3 * _W)) * 17 + F.floor(k / 3) % _W * 7 + k % 3 * 50) % 256)
    return table(spark, sf_dir, "pages").select("page_id", F.lit(_W).alias("width"), F.lit(_H).alias("height"), F.lit(3).alias("channels"), _bytes(value).alias("data"))


@_C.add(_COLOUR + "SELECT page_id, string_agg(printf('%02X', g::INTEGER), '' ORDER BY y, x) AS grey FROM grey GROUP BY page_id")
def grey_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grey values of colour images, with the weights as they fall on blue, green and red."""
    return pixels.greyed(_images(spark, sf_dir), "page_id").select("page_id", F.hex("data").alias("grey"))


@_C.add(_COLOUR + "SELECT page_id, string_agg(CASE WHEN g <= 128 THEN 'FF' ELSE '00' END, '' ORDER BY y, x) AS mask FROM grey GROUP BY page_id")
def ink_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ink of images: the dark pixels, inverted."""
    return pixels.inked(_images(spark, sf_dir), "page_id").select("page_id", F.hex("data").alias("mask"))


# two black rectangles on white
_RECTANGLES = """
WITH glyphs AS (
  SELECT page_id, 2 AS x, 2 AS y, (1 + page_id % 6)::INTEGER AS w, (2 + page_id % 9)::INTEGER AS h FROM pages
  UNION ALL SELECT page_id, 20, 3, (2 + page_id % 5)::INTEGER, (1 + page_id % 13)::INTEGER FROM pages)
"""


def _rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    at = F.sequence(F.lit(0), F.lit(40 * 20 - 1))

    def within(i: Column, x: int, y: int, w: Column, h: Column) -> Column:
        col, row = i % 40, F.floor(i / 40)
        return (col >= x) & (col < w + x) & (row >= y) & (row < h + y)

    value = F.transform(at, lambda i: F.when(within(i, 2, 2, 1 + k % 6, 2 + k % 9) | within(i, 20, 3, 2 + k % 5, 1 + k % 13), 0).otherwise(255))
    return table(spark, sf_dir, "pages").select("page_id", F.lit(40).alias("width"), F.lit(20).alias("height"), F.lit(1).alias("channels"), _bytes(value).alias("data"))


@_C.add(_RECTANGLES + "SELECT page_id, x, y, w, h FROM glyphs")
def glyph_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of the outer connected parts of ink."""
    return pixels.glyphs(_rectangles(spark, sf_dir), "page_id")


@_C.add(
    _RECTANGLES
    + """, large AS (SELECT page_id, count(*) AS n, avg(h) AS fontsize FROM glyphs WHERE w * h > 10 GROUP BY page_id),
lines AS (SELECT page_id, sum(w) / count(*) AS ratio FROM glyphs, range(20) r(i) WHERE i >= y AND i < y + h GROUP BY page_id, i),
strokes AS (SELECT page_id, quantile_cont(ratio, 0.5) AS thickness FROM lines GROUP BY page_id),
steps AS (SELECT page_id, max((least(w, h) + 1) // 2) AS erosions FROM glyphs GROUP BY page_id)
SELECT steps.page_id::VARCHAR AS page_id, coalesce(CASE WHEN n >= 2 THEN fontsize END, -1) AS fontsize, coalesce(CASE WHEN n >= 2 THEN thickness END, -1) AS thickness, erosions::INTEGER AS erosions
FROM steps LEFT JOIN large USING (page_id) LEFT JOIN strokes USING (page_id)"""
)
def font_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glyph height, stroke by runs and stroke by erosion, from pixels."""
    return pixels.styled(_rectangles(spark, sf_dir), "page_id").fillna(-1.0, ["fontsize", "thickness"])


_CORNERS = """
, boxes AS (
  SELECT page_id, k AS id, (page_id * k % 14 - 2 + k % 2 * 0.5)::DOUBLE AS x1, (page_id * k % 9 - 1)::DOUBLE AS y1, (page_id * k % 14 + k * 3 - 1.5)::DOUBLE AS x2, (page_id * k % 9 + k * 2.5)::DOUBLE AS y2, k
  FROM pages, range(4) t(k))
"""


def _corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("id"))
    k, p = F.col("id"), F.col("page_id")
    return rows.select("page_id", F.col("id").cast("long").alias("id"), *[c.cast("double").alias(n) for c, n in ((p * k % 14 - 2 + k % 2 * 0.5, "x1"), (p * k % 9 - 1, "y1"), (p * k % 14 + k * 3 - 1.5, "x2"), (p * k % 9 + k * 2.5, "y2"))])


@_C.add(
    _COLOUR
    + _CORNERS
    + f""", cut AS (SELECT page_id, id, round_even(x1, 0)::INTEGER AS a, round_even(y1, 0)::INTEGER AS b, round_even(x2, 0)::INTEGER AS c, round_even(y2, 0)::INTEGER AS d FROM boxes),
dots AS (SELECT page_id, id, c - a AS width, d - b AS height, px, py, ch FROM cut, range(-3, {_W + 20}) xs(px), range(-3, {_H + 20}) ys(py), range(3) cs(ch) WHERE px >= a AND px < c AND py >= b AND py < d)
SELECT dots.page_id, id, width, height, string_agg(printf('%02X', coalesce(v, 0)::INTEGER), '' ORDER BY py, px, ch) AS data
FROM dots LEFT JOIN px ON px.page_id = dots.page_id AND px.x = dots.px AND px.y = dots.py AND px.c = dots.ch GROUP BY ALL"""
)
def element_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements cut out of their page: corners rounded half to even, black beyond the page, no crop without a pixel."""
    return pixels.cropped(_images(spark, sf_dir), _corners(spark, sf_dir), "page_id", "id").select("page_id", "id", "width", "height", F.hex("data").alias("data"))


@_C.add(
    _COLOUR
    + f"""SELECT page_id, 20 AS width, {20 * _H // _W} AS height, string_agg(printf('%02X', v::INTEGER), '' ORDER BY r, q, c) AS data
FROM range({20 * _H // _W}) rs(r), range(20) qs(q), px WHERE px.y = (2 * r + 1) * {_H} // {2 * (20 * _H // _W)} AND px.x = (2 * q + 1) * {_W} // 40 GROUP BY page_id"""
)
def resized_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images brought to a longest side by their nearest pixels."""
    return pixels.resized(_images(spark, sf_dir), "page_id", longest=20, nearest=True).select("page_id", "width", "height", F.hex("data").alias("data"))


def _axis(name: str, n: int, to: int) -> str:
    """SQL of rows (spot, pixel, weight) along one side: the two pixels that each place lies between, weights in 1 / 2048."""
    return f"""{name}_places AS (SELECT k AS spot, floor(((2 * k + 1) * {n} - {to}) / {2 * to}.0)::BIGINT AS f, ((2 * k + 1) * {n} - {to}) AS over FROM range({to}) ks(k)),
{name}_first AS (SELECT spot, greatest(least(f, {n - 1}), 0) AS p, CASE WHEN f < 0 OR f >= {n - 1} THEN 0 ELSE (4096 * (over - f * {2 * to}) + {2 * to}) // {4 * to} END AS w FROM {name}_places),
{name} AS (SELECT spot, p AS pixel, 2048 - w AS weight FROM {name}_first UNION ALL SELECT spot, p + 1, w FROM {name}_first WHERE w > 0)"""


def _interpolated_sql(longest: int) -> str:
    to_w, to_h = longest, longest * _H // _W
    return (
        _COLOUR
        + f""", {_axis("across", _W, to_w)}, {_axis("down", _H, to_h)},
dots AS (SELECT page_id, d.spot AS r, a.spot AS q, c, (sum(v * d.weight * a.weight)::BIGINT + 2097152) >> 22 AS v FROM down d, across a, px WHERE px.y = d.pixel AND px.x = a.pixel GROUP BY page_id, d.spot, a.spot, c)
SELECT page_id, {to_w} AS width, {to_h} AS height, string_agg(printf('%02X', v::INTEGER), '' ORDER BY r, q, c) AS data FROM dots GROUP BY page_id"""
    )


@_C.add(_interpolated_sql(25))
def enlarged_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images brought to a longer side, interpolated."""
    return pixels.resized(_images(spark, sf_dir), "page_id", longest=25).select("page_id", "width", "height", F.hex("data").alias("data"))


@_C.add(_interpolated_sql(11))
def reduced_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images brought to a shorter side, interpolated."""
    return pixels.resized(_images(spark, sf_dir), "page_id", longest=11).select("page_id", "width", "height", F.hex("data").alias("data"))


_KINDS = ("title", "picture", "caption", "text")


@_C.add(
    _COLOUR
    + _CORNERS
    + """, sides AS (SELECT *, round_even(x1, 0) AS a, round_even(y1, 0) AS b, round_even(x2, 0) AS c1, round_even(y2, 0) AS d FROM boxes),
over AS (
  SELECT px.page_id, px.y, px.x, px.c, v, max(id) AS top FROM px LEFT JOIN sides s ON s.page_id = px.page_id AND px.x BETWEEN a AND c1 AND px.y BETWEEN b AND d AND (px.x = a OR px.x = c1 OR px.y = b OR px.y = d) GROUP BY ALL)
SELECT page_id, string_agg(printf('%02X', CASE WHEN top IS NULL THEN v ELSE list_extract(CASE top WHEN 0 THEN [0, 128, 0] WHEN 1 THEN [0, 0, 255] WHEN 2 THEN [0, 165, 255] ELSE [255, 0, 0] END, c + 1) END::INTEGER), '' ORDER BY y, x, c) AS data
FROM over GROUP BY page_id"""
)
def overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines of elements on their page, in the colours of their labels."""
    label = F.element_at(F.array(*map(F.lit, _KINDS)), F.col("id").cast("int") + 1)
    boxes = _corners(spark, sf_dir).withColumn("colour", X.label_colour(label))
    return pixels.drawn(_images(spark, sf_dir), boxes, "page_id").select("page_id", F.hex("data").alias("data"))


@_C.add(
    """SELECT page_id::VARCHAR AS task_id, 'pages/page-' || (page_id % 7 + 1) || '.png' AS path, (1 + page_id % 5)::INTEGER AS width, (1 + page_id % 3)::INTEGER AS height, '89504E470D0A1A0A' AS magic FROM pages"""
)
def page_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of pages as PNG files of their bundle."""
    k = F.col("page_id")
    w, h = (1 + k % 5).cast("int"), (1 + k % 3).cast("int")
    rows = table(spark, sf_dir, "pages").select("page_id", (k % 7 + 1).alias("page"), w.alias("width"), h.alias("height"), F.lit(3).alias("channels"), _bytes(F.transform(F.sequence(F.lit(1), w * h * 3), lambda i: i * k % 256)).alias("data"))
    files = annotations.png_assets(annotations.page_paths(rows), "page_id")
    size = pixels.png_size(F.col("content"))
    return files.select("task_id", "path", size["width"].alias("width"), size["height"].alias("height"), F.hex(F.substring("content", 1, 8)).alias("magic"))


@_C.add(
    """WITH kinds AS (SELECT o_custkey::VARCHAR AS doc_id, o_orderkey AS id, list_extract(['img', 'table', 'p'], (o_orderkey % 3)::INTEGER + 1) AS type FROM orders)
SELECT doc_id, id, CASE type WHEN 'img' THEN 'images/picture-' ELSE 'images/table-' END || row_number() OVER (PARTITION BY doc_id, type ORDER BY id) || '.png' AS path FROM kinds WHERE type <> 'p'"""
)
def asset_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of picture and table images, counted by kind."""
    kind = F.element_at(F.array(F.lit("img"), F.lit("table"), F.lit("p")), (F.col("o_orderkey") % 3).cast("int") + 1)
    return annotations.asset_paths(table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("doc_id"), F.col("o_orderkey").alias("id"), kind.alias("type")))


_LABEL_LIST = ", ".join(f"'{x}'" for x in LABELS)


@_C.add(
    f"""WITH labels AS (SELECT l_orderkey, l_linenumber, upper(list_extract([{_LABEL_LIST}], ((l_orderkey + l_linenumber) % 17)::INTEGER + 1)) AS label FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN lower(label) IN ('section_header', 'title') THEN 'green' WHEN lower(label) IN ('table', 'picture') THEN 'red' WHEN lower(label) = 'caption' THEN 'orange' ELSE 'blue' END AS colour FROM labels"""
)
def label_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours of layout labels, in any case."""
    label = F.upper(F.element_at(F.array(*map(F.lit, LABELS)), ((F.col("l_orderkey") + F.col("l_linenumber")) % 17).cast("int") + 1))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.label_colour(label).alias("colour"))


QUERIES, SQL = _C.queries, _C.sql
