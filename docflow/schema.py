"""Schemas of the records that flow through the package."""

from __future__ import annotations

from pyspark.sql import types as T

BOX = T.StructType([T.StructField(n, T.DoubleType()) for n in ("xc", "yc", "w", "h")])

#: An element of a page layout: geometry, kind, and what its kind has.
ELEMENT = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("id", T.IntegerType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("bbox", BOX),
        T.StructField("type", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("fontsize", T.DoubleType()),
        T.StructField("thickness", T.DoubleType()),
        T.StructField("html", T.StringType()),
        T.StructField("src", T.StringType()),
    ]
)
#: A layout item as an extractor gives it, before it becomes an element. Corners have their origin at the bottom left.
LAYOUT_ITEM = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("raw_ord", T.LongType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("label", T.StringType()),
        T.StructField("l", T.DoubleType()),
        T.StructField("t", T.DoubleType()),
        T.StructField("r", T.DoubleType()),
        T.StructField("b", T.DoubleType()),
        T.StructField("text", T.StringType()),
        T.StructField("html", T.StringType()),
        T.StructField("fontsize", T.DoubleType()),
        T.StructField("thickness", T.DoubleType()),
    ]
)
HTML_ELEMENT = "page_id long, id int, label string, bbox struct<xc:double,yc:double,w:double,h:double>, text string"
TABLE_CELL = "page_id long, table_id int, id int, label string, bbox struct<xc:double,yc:double,w:double,h:double>, text string"
EDGE = "page_id long, ord int, parent_id int, child_id int"
PDF_TABLE = "doc_id string, page int, table_no int, cells array<array<string>>"
TASK = "task_id string, pdf_path string, model string"
STATUS = "task_id string, status string, seq long"
ASSET = "task_id string, path string, content binary"
REGISTRY = "map<string,array<string>>"
CHAT = "array<struct<role:string,content:array<struct<type:string,text:string,image:string>>>>"

#: The layout labels an extractor may give.
LABELS = (
    "caption", "footnote", "formula", "list_item", "page_footer", "page_header", "picture", "section_header", "table", "text",
    "title", "document_index", "code", "checkbox_selected", "checkbox_unselected", "form", "key_value_region",
)
#: Labels by what becomes of them; forms and key-value regions make no element.
HEADING_LABELS = ("section_header", "title")
TABLE_LABELS = ("table", "document_index")
TEXT_LABELS = ("caption", "footnote", "formula", "text", "code", "checkbox_selected", "checkbox_unselected")
RUNNING_LABELS = ("page_footer", "page_header")
STATUSES = ("pending", "processing", "completed", "failed")
