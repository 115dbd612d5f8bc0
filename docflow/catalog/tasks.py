"""Conversion tasks: registry, gates, status, results, streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans import registry
from ..storage import fresh_dir
from ..streaming import tasks
from .base import Catalog, table

_C = Catalog()

_MODELS = (("layout", ["pdf"]), ("plain", ["pdf"]), ("office", ["docx", "pptx", "xlsx"]))
_EVENTS = {"signup": "pending", "click": "processing", "view": "processing", "purchase": "completed", "error": "failed"}
_STATUS = "CASE event_type " + " ".join(f"WHEN '{e}' THEN '{s}'" for e, s in _EVENTS.items()) + " END"
_LOG = f"""
WITH log AS (SELECT user_id::VARCHAR AS task_id, {_STATUS} AS status, event_id AS seq FROM events),
latest AS (SELECT task_id, arg_max(status, seq) AS status, max(seq) AS seq FROM log GROUP BY task_id)
"""


def _log(events: DataFrame) -> DataFrame:
    status: Column = F.lit(None)
    for e, s in _EVENTS.items():
        status = F.when(F.col("event_type") == e, s).otherwise(status)
    return events.select(F.col("user_id").cast("string").alias("task_id"), status.alias("status"), F.col("event_id").alias("seq"))


def _models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_MODELS, "model string, extensions array<string>")


@_C.add(_LOG + "SELECT * FROM latest")
def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last status of each task; events stand for status messages."""
    return tasks.latest_status(_log(table(spark, sf_dir, "events")))


@_C.add(_LOG + "SELECT * FROM latest")
def status_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream: all events are read once, and the last complete result is the answer."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet")
    out = fresh_dir(spark, "status")

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/result")

    query = tasks.latest_status(_log(stream)).writeStream.outputMode("complete").foreachBatch(batch).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("task_id string, status string, seq long").parquet(f"{out}/result")


@_C.add(_LOG + "SELECT c_custkey::VARCHAR AS task_id, CASE WHEN status IS NULL THEN 404 ELSE 200 END AS code, status FROM customer LEFT JOIN latest ON task_id = c_custkey::VARCHAR")
def status_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to status requests: unknown tasks are not found."""
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("task_id"))
    return tasks.status_answer(asked, tasks.latest_status(_log(table(spark, sf_dir, "events"))))


@_C.add(
    _LOG
    + """, results AS (SELECT o_custkey::VARCHAR AS task_id, string_agg(o_orderkey::VARCHAR, chr(10) ORDER BY o_orderkey) AS markdown FROM orders GROUP BY o_custkey)
SELECT c_custkey::VARCHAR AS task_id, CASE WHEN status IS NULL THEN 404 WHEN status <> 'completed' THEN 400 WHEN markdown IS NULL THEN 500 ELSE 200 END AS code,
  CASE WHEN status = 'completed' THEN markdown END AS markdown
FROM customer LEFT JOIN latest ON latest.task_id = c_custkey::VARCHAR LEFT JOIN results ON results.task_id = c_custkey::VARCHAR"""
)
def result_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to result requests: unknown, not completed, lost, or the Markdown."""
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("task_id"))
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("task_id"))
    results = orders.agg(F.array_join(F.sort_array(F.collect_list("o_orderkey")).cast("array<string>"), "\n").alias("markdown"))
    return tasks.result_answer(asked, tasks.latest_status(_log(table(spark, sf_dir, "events"))), results)


@_C.add(
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'layout' WHEN 1 THEN 'office' WHEN 2 THEN 'plain' ELSE 'none' END AS model,
  CASE event_id % 4 WHEN 3 THEN 'unknown model' ELSE CASE WHEN (event_id % 4 = 1 AND event_id % 3 = 1) OR (event_id % 4 <> 1 AND event_id % 3 <> 1) THEN 'accepted' ELSE 'wrong extension' END END AS verdict FROM events"""
)
def extension_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests against the registry: extensions in any case, with or without a dot."""
    e = F.col("event_id")
    name = F.element_at(F.array(F.lit("Report.PDF"), F.lit("a.docx"), F.lit("xpdf")), (e % 3).cast("int") + 1)
    model = F.element_at(F.array(F.lit("layout"), F.lit("office"), F.lit("plain"), F.lit("none")), (e % 4).cast("int") + 1)
    asked = table(spark, sf_dir, "events").select(e, name.alias("filename"), model.alias("model"))
    return registry.gated(asked, _models(spark)).select("event_id", "model", "verdict")


@_C.add(
    """SELECT doc_id::VARCHAR AS task_id, CASE WHEN doc_id % 5 < 4 AND length(text) > 0 THEN CASE doc_id % 5 WHEN 0 THEN '# ' || text ELSE text END || chr(10) END AS markdown,
  CASE WHEN doc_id % 5 = 4 THEN 'unknown model' WHEN length(text) = 0 THEN 'no result' END AS error FROM documents"""
)
def converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks through the pipelines of a registry; unknown models are errors of their own rows."""
    known = registry.Registry()
    docs = table(spark, sf_dir, "documents").where("length(text) > 0").select(F.col("doc_id").cast("string").alias("task_id"), "text")

    @known.register("plain", ["txt"])
    def plain(rows: DataFrame) -> DataFrame:
        return rows.join(docs, "task_id").select("task_id", F.concat("text", F.lit("\n")).alias("markdown"))

    @known.register("titled", ["txt"])
    def titled(rows: DataFrame) -> DataFrame:
        return rows.join(docs, "task_id").select("task_id", F.concat(F.lit("# "), "text", F.lit("\n")).alias("markdown"))

    k = F.col("doc_id") % 5
    asked = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("task_id"), F.when(k == 0, "titled").when(k == 4, "none").when(k == 1, "plain").alias("model"))
    return known.convert(asked)


QUERIES, SQL = _C.queries, _C.sql
