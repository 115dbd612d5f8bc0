"""Folders that driver and executors share."""

from __future__ import annotations

import re
import uuid
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` where it is set; otherwise a folder in the warehouse. On a cluster that folder must not be on a
    local disk, where executors would each write their own; that is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        if base.startswith(("file:", "/")) and not re.fullmatch(r"local(\[[^,\]]*(,\d+)?\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return base.rstrip("/")


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """What reads and writes a path in Python, and the path there; for files that are no tables.

    Paths are as the engine spells them: a scheme or none, and no escapes. On a cluster the folder must be one that driver and
    executors share.
    """
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if re.match(r"[a-z0-9]+:/", path):
        return fs.FileSystem.from_uri(quote(path, safe=":/@?=&"))
    return fs.LocalFileSystem(), path


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def spread(rows: DataFrame) -> DataFrame:
    """A table as scanned, dealt to all cores if its files come in fewer pieces; for steps that work hard on each row.

    A small file is often one row group, which one task reads. Where there are pieces enough nothing is shuffled.
    """
    n = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(n) if rows.rdd.getNumPartitions() < n else rows


def stored(rows: DataFrame, what: str) -> DataFrame:
    """``rows`` written to the shared folder and read back: lineage is cut, and a lost executor loses nothing.

    A lazy result may read the table, so it stays until the session's engine ends.
    """
    spark = rows.sparkSession
    path = fresh_dir(spark, what)
    rows.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(rows.schema).parquet(path)


def gone(table: DataFrame) -> None:
    """Delete a stored table that no later plan reads."""
    context = table.sparkSession.sparkContext
    for root in {f.rsplit("/", 1)[0] for f in table.inputFiles()[:1]}:
        where = context._jvm.org.apache.hadoop.fs.Path(root)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
