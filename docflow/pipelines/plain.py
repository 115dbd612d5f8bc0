"""Texts as they are."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import REGISTRY


@REGISTRY.register("plain", ["txt", "md"], default=True)
def plain(rows: DataFrame) -> DataFrame:
    """Rows (task_id, markdown) of tasks with their ``text``, which ends in one line break; empty texts have no result."""
    return rows.where("text <> ''").select("task_id", F.concat("text", F.lit("\n")).alias("markdown"))
