"""Text functions of the rendering and labelling steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import HEADING_LABELS, TABLE_LABELS, TEXT_LABELS

_BLANKS = r"^[\s\x1c-\x1f\x85\xa0]+|[\s\x1c-\x1f\x85\xa0]+$"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, _BLANKS, "")


def preview(text: Column, size: int = 35) -> Column:
    return F.concat(F.substring(stripped(text), 1, size), F.lit("..."))


def element_type(label: Column, compat: bool = False) -> Column:
    """Kind of a layout label: heading, paragraph, table, picture or list item; null for labels that make no element.

    ``compat``: list items are paragraphs.
    """
    low = F.lower(label)
    return (
        F.when(low.isin(*HEADING_LABELS), "h")
        .when(low.isin(*TABLE_LABELS), "table")
        .when(low == "picture", "img")
        .when(low == "list_item", "p" if compat else "li")
        .when(low.isin(*TEXT_LABELS), "p")
    )


def label_colour(label: Column) -> Column:
    low = F.lower(label)
    return F.when(low.isin(*HEADING_LABELS), "green").when(low.isin("table", "picture"), "red").when(low == "caption", "orange").otherwise("blue")


def heading_level(tag: Column) -> Column:
    """The digit behind the h of a heading tag."""
    return F.substring(tag, 2, 1).cast("int")


def selector(tag: Column, classes: Column) -> Column:
    """CSS selector of a tag with all its classes."""
    names = F.filter(F.split(F.trim(F.coalesce(classes, F.lit(""))), r"\s+"), lambda c: c != "")
    return F.array_join(F.concat(F.array(tag), names), ".")


def accepted(extensions: Column) -> Column:
    """Extensions as a form's accept list."""
    return F.array_join(F.transform(extensions, lambda e: F.concat(F.lit("."), e)), ",")


def clean_cell(cell: Column) -> Column:
    """A table cell on one line; a missing one is spelled out."""
    return F.coalesce(F.regexp_replace(cell, "\n", " "), F.lit("None"))


def pipe_table(cells: Column) -> Column:
    """Rows of cells as lines of a pipe table, without a rule under the first."""
    return F.array_join(F.transform(cells, lambda row: F.concat(F.lit("|"), F.array_join(F.transform(row, clean_cell), "|"), F.lit("|"))), "\n")


def edge_lines(text: Column) -> Column:
    """Edges (parent_id, child_id) in the lines ``#parent->#child`` of a text; other lines are passed over."""
    pairs = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"^\s*#\d+->#\d+\s*$"))

    def edge(line: Column) -> Column:
        return F.struct(F.regexp_extract(line, r"#(\d+)->#(\d+)", 1).cast("int").alias("parent_id"), F.regexp_extract(line, r"#(\d+)->#(\d+)", 2).cast("int").alias("child_id"))

    return F.transform(pairs, edge)


def upload_path(task_id: Column, filename: Column) -> Column:
    """Task id and the extension of the uploaded file, one dot between them."""
    return F.concat(task_id, F.regexp_extract(filename, r"(\.[^.]*)$", 1))


def distinct_formats(characters: Column) -> Column:
    """Font names and sizes of the characters (font, size) of a text, each once and in order."""
    return F.struct(
        F.array_sort(F.array_distinct(F.transform(characters, lambda c: c["font"]))).alias("fonts"),
        F.array_sort(F.array_distinct(F.transform(characters, lambda c: c["size"]))).alias("sizes"),
    )
