"""Boxes and trees: geometry, overlap, suppression, parents, list levels, preorder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions import pixels
from ..functions import text as X
from ..operators import hierarchy, overlap
from ..sources.html import TAGS
from .base import Catalog, table

_C = Catalog()
_AT = 0.5  # overlap threshold at which the arithmetic boxes below do meet

_BOXES = f"""
WITH boxes AS (
  SELECT user_id AS page, event_id AS id, event_id * 7 % 40 AS x1, event_id * 13 % 60 AS y1, event_id * 7 % 40 + 30 + event_id % 11 AS x2, event_id * 13 % 60 + 20 + event_id % 7 AS y2,
         list_extract({list(TAGS)}, (event_id * 5 % 7)::INTEGER + 1) AS label
  FROM events)
"""
_IOU = "greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    x, y = F.col("event_id") * 7 % 40, F.col("event_id") * 13 % 60
    rows = e.select(F.col("user_id").alias("page"), F.col("event_id").alias("id"), *[c.cast("double").alias(n) for c, n in ((x, "x1"), (y, "y1"), (x + 30 + F.col("event_id") % 11, "x2"), (y + 20 + F.col("event_id") % 7, "y2"))], F.element_at(F.array(*map(F.lit, TAGS)), (F.col("event_id") * 5 % 7).cast("int") + 1).alias("label"))
    return rows.withColumn("bbox", G.centred(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))


@_C.add(_BOXES + "SELECT page, id, (x1 + x2) / 2.0 AS xc, (y1 + y2) / 2.0 AS yc, (x2 - x1)::DOUBLE AS w, (y2 - y1)::DOUBLE AS h, x1::DOUBLE AS left_, (100 - y1)::DOUBLE AS flipped FROM boxes")
def box_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners to centre boxes and back to the left edge; depths from heights."""
    rows = _boxes(spark, sf_dir)
    return rows.select("page", "id", "bbox.xc", "bbox.yc", "bbox.w", "bbox.h", G.left(F.col("bbox")).alias("left_"), G.flipped(F.col("y1"), F.lit(100.0)).alias("flipped"))


@_C.add(
    _BOXES
    + """, content AS (SELECT page, min(x1) + 10 AS cx, min(y1) + 10 AS cy, least(1000, min(x1) + 30) + 35 AS cx2, least(3000, min(y1) + 40) + 35 AS cy2 FROM boxes GROUP BY page)
SELECT page, id, (x1 - cx)::DOUBLE AS x, (y1 - cy)::DOUBLE AS y FROM boxes JOIN content USING (page) WHERE x1 >= cx AND x2 <= cx2 AND y1 >= cy AND y2 <= cy2"""
)
def content_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements wholly within their page's padded content rectangle, rebased to it."""
    rows = _boxes(spark, sf_dir)
    top = rows.groupBy("page").agg((F.min("x1") + 10).alias("cx"), (F.min("y1") + 10).alias("cy"))
    box = top.select("page", G.content_rectangle(F.col("cx"), F.col("cy"), F.lit(20.0), F.lit(30.0)).alias("c"))
    kept = rows.join(box, "page").where(G.inside(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.col("c")))
    return kept.select("page", "id", (F.col("x1") - F.col("c.x1")).alias("x"), (F.col("y1") - F.col("c.y1")).alias("y"))


@_C.add(
    _BOXES
    + f""", pairs AS (
  SELECT a.page, a.id AS a, b.id AS b, {_IOU} AS i, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s FROM boxes a JOIN boxes b ON a.page = b.page AND a.id < b.id)
SELECT page, a, b, round(i / (s - i)::DOUBLE, 6) AS iou FROM pairs WHERE i >= {_AT} * (s - i)"""
)
def overlapping_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one page's boxes with enough intersection over union."""
    return overlap.overlapping_pairs(_boxes(spark, sf_dir), "page", _AT).withColumn("iou", F.round("iou", 6))


@_C.add(
    _BOXES
    + """, next AS (SELECT *, lead(x1) OVER w AS u1, lead(y1) OVER w AS v1, lead(x2) OVER w AS u2, lead(y2) OVER w AS v2 FROM boxes WINDOW w AS (PARTITION BY page ORDER BY id)),
met AS (SELECT page, id, greatest(least(x2, u2) - greatest(x1, u1), 0) * greatest(least(y2, v2) - greatest(y1, v1), 0) AS i, (x2 - x1) * (y2 - y1) + (u2 - u1) * (v2 - v1) AS s FROM next WHERE u1 IS NOT NULL)
SELECT page, id, round(i / (s - i)::DOUBLE, 6) AS iou, i >= 0.5 * (s - i) AS near FROM met"""
)
def box_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection over union of each box and the next one on its page."""
    other = F.lead("bbox").over(Window.partitionBy("page").orderBy("id"))
    rows = _boxes(spark, sf_dir).withColumn("other", other).where("other is not null")
    return rows.select("page", "id", F.round(G.iou(F.col("bbox"), F.col("other")), 6).alias("iou"), G.overlaps(F.col("bbox"), F.col("other"), _AT).alias("near"))


_LITERAL = "greatest(least(a.xc + a.w, b.xc + b.w) - greatest(a.xc, b.xc), 0) * greatest(least(a.yc + a.h, b.yc + b.h) - greatest(a.yc, b.yc), 0)"


@_C.add(
    _BOXES
    + f""", centred AS (SELECT page, id, (x1 + x2) / 2.0 AS xc, (y1 + y2) / 2.0 AS yc, x2 - x1 AS w, y2 - y1 AS h FROM boxes),
pairs AS (SELECT a.page, a.id AS a, b.id AS b, {_LITERAL} AS i, a.w * a.h + b.w * b.h AS s FROM centred a JOIN centred b ON a.page = b.page AND a.id < b.id)
SELECT page, a, b, round(i / (s - i)::DOUBLE, 6) AS iou FROM pairs WHERE i >= 0.75 * (s - i)"""
)
def literal_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by the literal reading, which takes centres for top left corners."""
    return overlap.overlapping_pairs(_boxes(spark, sf_dir), "page", 0.75, compat=True).withColumn("iou", F.round("iou", 6))


@_C.add(_BOXES + """SELECT page, id, x1::DOUBLE AS "left", y1::DOUBLE AS top, row_number() OVER (PARTITION BY page ORDER BY y1, id * 3 % 7, id)::INTEGER AS ord FROM boxes""")
def ordered_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements from the top of their page, ties by the rank of an earlier step, then id."""
    rows = _boxes(spark, sf_dir).withColumn("rank", F.col("id") * 3 % 7)
    return hierarchy.ordered(rows, "page").select("page", "id", "left", "top", "ord")


@_C.add(_BOXES + "SELECT page, id, label, substr(label, 2, 1)::INTEGER AS level FROM boxes WHERE label IN ('h1', 'h2', 'h3')")
def heading_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of headings by the digit of their tags."""
    rows = _boxes(spark, sf_dir).where(F.col("label").isin(*hierarchy.HEADINGS))
    return rows.select("page", "id", "label", X.heading_level(F.col("label")).alias("level"))


@_C.add(
    _BOXES.replace("WITH", "WITH RECURSIVE", 1)
    + f""", ranked AS (
  SELECT *, row_number() OVER (PARTITION BY page ORDER BY list_position({list(TAGS)}, label), -((x2 - x1) * (y2 - y1)), id) AS r FROM boxes),
hits AS (
  SELECT a.page, a.r AS r, list(b.r) AS before
  FROM (SELECT a.page, a.r AS ra, b.r AS rb, {_IOU} AS i, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s FROM ranked a JOIN ranked b ON a.page = b.page AND b.r < a.r) p
  JOIN ranked a ON a.page = p.page AND a.r = p.ra JOIN ranked b ON b.page = p.page AND b.r = p.rb WHERE i >= {_AT} * (s - i) GROUP BY ALL),
walk(page, r, kept) AS (
  SELECT DISTINCT page, 0::BIGINT, []::BIGINT[] FROM boxes
  UNION ALL
  SELECT w.page, w.r + 1, CASE WHEN list_has_any(coalesce(h.before, []), w.kept) THEN w.kept ELSE list_append(w.kept, w.r + 1) END
  FROM walk w JOIN ranked n ON n.page = w.page AND n.r = w.r + 1 LEFT JOIN hits h ON h.page = w.page AND h.r = w.r + 1),
last AS (SELECT page, arg_max(kept, r) AS kept FROM walk GROUP BY page)
SELECT page, id, list_position(kept, r)::INTEGER AS rank FROM ranked JOIN last USING (page) WHERE list_contains(kept, r)"""
)
def suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy suppression: the boxes of each page that no better kept box overlaps."""
    return overlap.suppress(_boxes(spark, sf_dir), "page", _AT)


_TAGS = f"""
WITH tagged AS (
  SELECT user_id AS page, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS ord,
         list_extract({list(TAGS)}, (event_id * 5 % 7)::INTEGER + 1) AS tag, (event_id * 11 % 90)::DOUBLE AS "left"
  FROM events)
"""


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    tag = F.element_at(F.array(*map(F.lit, TAGS)), (F.col("event_id") * 5 % 7).cast("int") + 1)
    return e.select(F.col("user_id").alias("page"), F.col("event_id").alias("id"), F.row_number().over(order).alias("ord"), tag.alias("tag"), (F.col("event_id") * 11 % 90).cast("double").alias("left"))


_PARENT = """
  (SELECT max(b.ord) FROM tagged b WHERE b.page = a.page AND b.ord < a.ord AND CASE a.tag
     WHEN 'h1' THEN false WHEN 'h2' THEN b.tag = 'h1' WHEN 'h3' THEN b.tag IN ('h1', 'h2') WHEN 'p' THEN b.tag IN ('h1', 'h2', 'h3')
     WHEN 'li' THEN false ELSE b.tag IN ('h1', 'h2', 'h3', 'p') END)"""


@_C.add(_TAGS + f"SELECT page, id, ord, tag, coalesce({_PARENT}, 0) AS parent_ord FROM tagged a")
def element_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest earlier heading of a smaller level, heading, or paragraph, by kind of element."""
    return hierarchy.parents(_tagged(spark, sf_dir), "page").drop("left").fillna(0, ["parent_ord"])


_LEVELS = (
    _TAGS.replace("WITH", "WITH RECURSIVE", 1)
    + """, items AS (SELECT page, ord, "left", row_number() OVER (PARTITION BY page ORDER BY ord) AS n FROM tagged WHERE tag = 'li'),
fold(page, n, ord, seen, level) AS (
  SELECT DISTINCT page, 0::BIGINT, 0, []::DOUBLE[], 0 FROM items
  UNION ALL
  SELECT f.page, i.n, i.ord,
         CASE WHEN list_position(list_transform(f.seen, lambda v: abs(i."left" - v) <= 8), true) > 0 THEN f.seen ELSE list_sort(list_append(f.seen, i."left")) END,
         CASE WHEN list_position(list_transform(f.seen, lambda v: abs(i."left" - v) <= 8), true) > 0 THEN list_position(list_transform(f.seen, lambda v: abs(i."left" - v) <= 8), true)
              ELSE list_position(list_sort(list_append(f.seen, i."left")), i."left") END::INTEGER
  FROM fold f JOIN items i ON i.page = f.page AND i.n = f.n + 1),
levels AS (SELECT page, ord, level FROM fold WHERE n > 0)
"""
)
_HUNG = """, named AS (SELECT t.*, l.level FROM tagged t LEFT JOIN levels l USING (page, ord)),
hung AS (
  SELECT a.page, a.id, a.ord, a.tag, a.level, CASE WHEN a.tag = 'li' THEN
    (SELECT max(b.ord) FROM named b WHERE b.page = a.page AND b.ord < a.ord AND (b.tag IN ('h1', 'h2', 'h3', 'p') OR (b.tag = 'li' AND b.level < a.level)))
    ELSE """ + _PARENT.replace("tagged b", "named b") + """ END AS parent_ord FROM named a)
"""  # fmt: skip


@_C.add(_LEVELS + "SELECT page, ord, level FROM levels")
def list_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of list items by the indents seen so far on the page."""
    return hierarchy.list_levels(_tagged(spark, sf_dir), "page")


@_C.add(_LEVELS + _HUNG + "SELECT page, id, ord, tag, coalesce(level, 0) AS level, coalesce(parent_ord, 0) AS parent_ord FROM hung")
def element_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents of all elements, list items included."""
    return hierarchy.tree(_tagged(spark, sf_dir), "page").drop("left").fillna(0, ["level", "parent_ord"])


@_C.add(
    _LEVELS
    + _HUNG
    + """, walk AS (
  SELECT page, ord, id, NULL::BIGINT AS parent_id, lpad(ord::VARCHAR, 8, '0') AS path FROM hung WHERE parent_ord IS NULL
  UNION ALL
  SELECT h.page, h.ord, h.id, w.id, w.path || '/' || lpad(h.ord::VARCHAR, 8, '0') FROM walk w JOIN hung h ON h.page = w.page AND h.parent_ord = w.ord)
SELECT page, string_agg('#' || parent_id || '->#' || id || chr(10), '' ORDER BY path) AS edges FROM walk WHERE parent_id IS NOT NULL GROUP BY page"""
)
def preorder_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge lines of each page's tree in preorder."""
    walked = hierarchy.preorder(hierarchy.tree(_tagged(spark, sf_dir), "page"), "page")
    return hierarchy.edge_text(hierarchy.edges(walked, "page"), "page")


@_C.add(_LEVELS + _HUNG + "SELECT page, parent_ord, string_agg(id::VARCHAR, ',' ORDER BY ord) AS children FROM hung WHERE parent_ord IS NOT NULL GROUP BY ALL")
def parent_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of each element, in order."""
    return hierarchy.children(hierarchy.tree(_tagged(spark, sf_dir), "page"), "page").withColumn("children", F.array_join(F.col("children").cast("array<string>"), ","))


@_C.add(
    """SELECT l_orderkey AS crop, count(*) FILTER (WHERE l_linenumber * l_quantity > 10) AS n_glyphs,
  CASE WHEN count(*) FILTER (WHERE l_linenumber * l_quantity > 10) >= 2 THEN quantile_cont(l_quantity, 0.5) FILTER (WHERE l_linenumber * l_quantity > 10) END AS fontsize
FROM lineitem GROUP BY l_orderkey"""
)
def glyph_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact median height of glyph boxes above the area, per crop; lines of an order stand for glyphs."""
    return pixels.glyph_size(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("crop"), F.col("l_linenumber").alias("w"), F.col("l_quantity").alias("h")), "crop")


@_C.add(
    """WITH px AS (SELECT event_id % 500 AS crop, event_id, unnest(range(16)) AS i, CASE WHEN (event_id * 31 + unnest(range(16)) * unnest(range(16)) * 7) % 5 < 3 THEN 1 ELSE 0 END AS p FROM events),
steps AS (SELECT *, p = 1 AND lag(p) OVER (PARTITION BY event_id ORDER BY i) = 0 AS up FROM px),
lines AS (SELECT crop, event_id, sum(p) AS n, count(*) FILTER (WHERE up) AS runs FROM steps GROUP BY ALL)
SELECT crop, coalesce(round(quantile_cont(n / runs, 0.5) FILTER (WHERE runs > 0), 6), 'NaN'::DOUBLE) AS thickness FROM lines GROUP BY crop"""
)
def stroke_thickness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median ink per run over the pixel rows of a crop, in generated code; pixels are arithmetic on event ids."""
    e = table(spark, sf_dir, "events")
    row = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.when((F.col("event_id") * 31 + i * i * 7) % 5 < 3, 255).otherwise(0))
    return pixels.run_lengths(e.select((F.col("event_id") % 500).alias("crop"), row.alias("pixels")), "crop").withColumn("thickness", F.round("thickness", 6))


QUERIES, SQL = _C.queries, _C.sql
