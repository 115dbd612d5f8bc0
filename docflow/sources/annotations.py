"""Stored annotations, edge lists, and layout items that external extractors have written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.geometry import centred, crop_size, flipped
from ..functions.pixels import png
from ..functions.text import element_type
from ..schema import ELEMENT, RUNNING_LABELS


def read_elements(spark: SparkSession, path: str, schema: T.StructType = ELEMENT) -> DataFrame:
    """Elements from JSON arrays or objects, under a fixed schema; a file's elements are one array or one a line."""
    return spark.read.schema(schema).json(path, multiLine=True)


def from_json_text(rows: DataFrame, key: str, column: str, schema: T.StructType = ELEMENT) -> DataFrame:
    """Elements of a JSON array in a column, one row each, next to the key."""
    return rows.select(key, F.posexplode(F.from_json(column, T.ArrayType(schema))).alias("pos", "e")).select(key, "pos", "e.*")


def to_json_text(rows: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """Rows (key, annotations): the elements of each key as one JSON array in order."""
    listed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*columns).alias("e"))))
    return rows.groupBy(key).agg(F.to_json(F.transform(listed, lambda x: x["e"])).alias("annotations"))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, ord, parent_id, child_id) of edge files; lines that are no edge are passed over."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", "\n")).alias("ord", "line"))
    pattern = r"^\s*#(\d+)->#(\d+)\s*$"
    return lines.where(F.col("line").rlike(pattern)).select("path", "ord", *[F.regexp_extract("line", pattern, i).cast("int").alias(n) for i, n in ((1, "parent_id"), (2, "child_id"))])


def preview(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows in an order that leaves no ties, for a look at a table."""
    return rows.orderBy(*order).limit(n)


def layout_elements(items: DataFrame, sizes: DataFrame, compat: bool = False) -> DataFrame:
    """Elements from layout items and page sizes (doc_id, page, height), in reading order with dense ids.

    Running heads and feet go first, then items whose crop has no pixel and labels that make no element; only then ids
    and picture numbers are counted. Page sizes join by page; pixels never travel.
    """
    rows = items.where(~F.lower("label").isin(*RUNNING_LABELS)).join(sizes.select("doc_id", "page", "height"), ["doc_id", "page"])
    x1, x2 = F.col("l"), F.col("r")
    y1, y2 = flipped(F.col("t"), F.col("height")), flipped(F.col("b"), F.col("height"))
    width, height = crop_size(x1, y1, x2, y2)
    rows = rows.where((width > 0) & (height > 0)).withColumn("type", element_type(F.col("label"), compat)).where("type is not null")
    order = Window.partitionBy("doc_id").orderBy("raw_ord")
    rows = rows.withColumn("id", F.row_number().over(order)).withColumn("nth", F.count(F.when(F.col("type") == "img", 1)).over(order))
    spoken = F.col("type").isin("h", "p", "li")
    return rows.select(
        "doc_id",
        "id",
        "page",
        centred(x1, y1, x2, y2).alias("bbox"),
        "type",
        F.when(spoken, F.col("text")).alias("text"),
        F.when(spoken, F.col("fontsize")).alias("fontsize"),
        F.when(spoken, F.col("thickness")).alias("thickness"),
        F.when(F.col("type") == "table", F.col("html")).alias("html"),
        F.when(F.col("type") == "img", F.concat(F.lit("images/picture-"), F.col("nth"), F.lit(".png"))).alias("src"),
    )


def asset_paths(elements: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Rows (doc, id, path): names of the picture and table images of each document, each kind counted by itself in order."""
    nth = F.row_number().over(Window.partitionBy(doc, "type").orderBy("id"))
    rows = elements.where(F.col("type").isin("img", "table"))
    return rows.select(doc, "id", F.concat(F.when(F.col("type") == "img", "images/picture-").otherwise("images/table-"), nth, F.lit(".png")).alias("path"))


def page_paths(pages: DataFrame, page: str = "page") -> DataFrame:
    """Adds ``path``: the name of each page's image."""
    return pages.withColumn("path", F.concat(F.lit("pages/page-"), F.col(page), F.lit(".png")))


def png_assets(images: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Rows (task_id, path, content) from images (doc, path, width, height, channels, data): PNG files of a bundle."""
    made = F.udf(lambda d, w, h, c: None if d is None else png(bytes(d), w, h, c), "binary", useArrow=True)
    return images.select(F.col(doc).cast("string").alias("task_id"), "path", made("data", "width", "height", "channels").alias("content"))
