"""Word-processor, slide and spreadsheet files."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import markdown
from ..sources import adapters
from . import REGISTRY


@REGISTRY.register("office", ["docx", "pptx", "xlsx"])
def office(rows: DataFrame) -> DataFrame:
    """Rows (task_id, markdown) of tasks with their file as ``content``; headings by style, tables as markup.

    A file that can't be read has no result. A file's items stay together, so its text is made where the file lies. Reading
    takes long for the few bytes of a packed file, so files are dealt to all cores by their number.
    """
    rows = rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)
    found = adapters.extracted_whole(rows.select(F.col("task_id").alias("path"), "content"), "layout", adapters.office_text).where("error is null and size(items) > 0")

    def content(item: Column) -> Column:
        label = item["label"]
        head = label.isin("section_header", "title")
        kind = F.when(head, "h").when(label == "table", "table").when(label == "list_item", "li").otherwise("p")
        return markdown.line_of(kind, item["text"], F.when(head, 1), F.lit(None).cast("string"), item["html"])

    return found.select(F.col("path").alias("task_id"), markdown.joined(F.col("items"), content).alias("markdown"))
