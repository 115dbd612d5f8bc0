"""Elements to Markdown."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.headers import levels


def line(rows_have_level: bool = True) -> Column:
    """Markdown of one element by its ``type``; null for kinds that have none."""
    return line_of(F.col("type"), F.col("text"), F.col("level") if rows_have_level else F.lit(None).cast("int"), F.col("src"), F.col("html"))


def line_of(kind: Column, text: Column, level: Column, src: Column, html: Column) -> Column:
    """Markdown of one element by its values."""
    text = F.coalesce(text, F.lit(""))
    return (
        F.when((kind == "h") & level.isNotNull(), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text))
        .when(kind.isin("h", "p"), text)
        .when(kind == "li", F.concat(F.lit("- "), text))
        .when(kind == "img", F.concat(F.lit("![Image]("), F.coalesce(src, F.lit("")), F.lit(")")))
        .when(kind == "table", F.coalesce(html, F.lit("")))
    )


def assembled(rows: DataFrame, doc: str, order: str, content: str) -> DataFrame:
    """Rows (doc, markdown): each element's content and an empty line, in order; an element without content is the line alone."""
    listed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(content).alias("c"))))
    return rows.groupBy(doc).agg(joined(listed, lambda e: e["c"]).alias("markdown"))


def joined(elements: Column, content: Callable[[Column], Column]) -> Column:
    """One text of a document's elements in an array: each one's content and an empty line, or the line alone."""
    lines = F.flatten(F.transform(elements, lambda e: F.when(content(e).isNull(), F.array(F.lit(""))).otherwise(F.array(content(e), F.lit("")))))
    return F.array_join(lines, "\n")


def render(elements: DataFrame, doc: str = "doc_id", noise_level: str = "larger") -> DataFrame:
    """Rows (doc, markdown): heading levels from clusters of size and thickness, then one text a document.

    Only the headings' numbers travel to the clustering; texts are shuffled once, for the assembly. A document without
    headings has paragraphs only.
    """
    found = levels(elements.where("type = 'h'"), doc, noise_level=noise_level).select(doc, "id", "level")
    rows = elements.join(found, [doc, "id"], "left").withColumn("content", line())
    return assembled(rows, doc, "id", "content")


def strict_failures(elements: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Documents that strict rendering refuses: no headings, or headings without size or thickness."""
    bad = F.col("fontsize").isNull() | F.col("thickness").isNull() | F.isnan("fontsize") | F.isnan("thickness")
    head = F.col("type") == "h"
    counts = elements.groupBy(doc).agg(F.count(F.when(head, 1)).alias("n"), F.count(F.when(head & bad, 1)).alias("n_bad"))
    return counts.where("n = 0 or n_bad > 0").select(doc)


#: An image of a Markdown text: its description and its address.
_LINK = r"!\[([^\]]*)\]\([^)]*\)"


def relinked(texts: DataFrame, assets: DataFrame, doc: str = "doc_id", text: str = "markdown") -> DataFrame:
    """Rows (doc, markdown) whose n-th image points to the n-th of the document's ``assets(doc, path)``, by path order.

    What an exporter has named in a folder of its own so finds the files of the bundle. Images beyond the assets stay as they
    are. Paths are ordered by their length, then by themselves, so that 10 comes after 9.
    """
    named = assets.groupBy(doc).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.length("path").alias("n"), "path"))), lambda a: a["path"]).alias("paths"))
    rows = texts.select(doc, F.col(text).alias("markdown")).join(named, doc, "left")
    # each text is matched three times, however many images it has; what stands before an image, its description, the image
    # and its path then lie side by side, and one pass puts them together
    rows = rows.withColumns({"between": F.split("markdown", _LINK, -1), "said": F.regexp_extract_all("markdown", F.lit(_LINK), F.lit(1)), "link": F.regexp_extract_all("markdown", F.lit(_LINK), F.lit(0)), "path": F.coalesce("paths", F.array().cast("array<string>"))})

    def piece(x: Column) -> Column:
        new = F.concat(F.lit("!["), x["said"], F.lit("]("), x["path"], F.lit(")"))
        return F.concat(F.coalesce(x["between"], F.lit("")), F.when(x["link"].isNull(), "").when(x["path"].isNull(), x["link"]).otherwise(new))

    return rows.select(doc, F.array_join(F.transform(F.arrays_zip("between", "said", "link", "path"), piece), "").alias("markdown"))


def bundle(elements: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Rows (doc, path, content) of an element table: ``text.md`` and three JSON files, as text.

    ``content_list.json`` has what each element says in order, ``middle.json`` the boxes of each page, ``model.json`` the kinds.
    """
    said = F.struct("type", "text", (F.col("page") - 1).alias("page_idx"), F.col("src").alias("img_path"), F.col("html").alias("table_body"))
    parts = {
        "content_list.json": said,
        "middle.json": F.struct((F.col("page") - 1).alias("page_idx"), "id", "bbox"),
        "model.json": F.struct("id", "type"),
    }
    listed = [F.to_json(F.transform(F.sort_array(F.collect_list(F.struct(F.col("id").alias("_id"), e.alias("e")))), lambda x: x["e"])).alias(n) for n, e in parts.items()]
    rows = elements.groupBy(doc).agg(*listed).join(render(elements, doc), doc)
    files = F.array(*[F.struct(F.lit(n).alias("path"), F.col(f"`{n}`").alias("content")) for n in parts], F.struct(F.lit("text.md").alias("path"), F.col("markdown").alias("content")))
    return rows.select(doc, F.explode(files).alias("f")).select(doc, "f.path", "f.content")
