"""Streams: the queue, tasks that are delivered again, status that arrives in any order."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..plans import registry
from ..sources import queue
from ..storage import fresh_dir
from ..streaming import tasks
from .base import Catalog, table

_C = Catalog()

_ORDERS = """SELECT (row_number() OVER (ORDER BY o_orderkey) - 1)::BIGINT AS "offset", o_orderkey::VARCHAR AS task_id, 'in/' || o_custkey || '.pdf' AS pdf_path,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS model, o_orderdate AS sent FROM orders"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tasks in the order of their keys; some have no model."""
    path = F.concat(F.lit("in/"), F.col("o_custkey"), F.lit(".pdf"))
    model = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").orderBy("o_orderkey").select(F.col("o_orderkey").cast("string").alias("task_id"), path.alias("pdf_path"), model.alias("model"), F.col("o_orderdate").cast("timestamp").alias("sent"))


@_C.add(_ORDERS)
def queue_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages published by a job and read back as a table, each at its offset."""
    path = fresh_dir(spark, "queue")
    queue.publish(_asked(spark, sf_dir), path)
    return queue.messages(spark, path).select("offset", "task_id", "pdf_path", "model", F.col("sent").cast("timestamp_ntz").alias("sent"))


@_C.add(_ORDERS)
def queue_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream, some messages at a time: it is stopped on the way and goes on from its checkpoint, by offset."""
    base = fresh_dir(spark, "queue-stream")
    rows = _asked(spark, sf_dir)
    n = rows.count()
    queue.publish(rows, f"{base}/queue")

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/read/batch={number}")

    def reader(per_batch: int) -> DataStreamWriter:
        return queue.message_stream(spark, f"{base}/queue", per_batch).writeStream.foreachBatch(batch).option("checkpointLocation", f"{base}/checkpoint")

    reader(n // 3).trigger(availableNow=True).start().awaitTermination()  # a third, and the end of this worker
    tasks.drained(reader(n // 3 + 1).start())
    return spark.read.schema(queue.MESSAGE).parquet(f"{base}/read").select("offset", "task_id", "pdf_path", "model", F.col("sent").cast("timestamp_ntz").alias("sent"))


@_C.add(
    """SELECT c_custkey::VARCHAR AS task_id, CASE WHEN c_custkey % 4 = 3 THEN 'failed' WHEN c_custkey % 5 = 0 THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN c_custkey % 4 <> 3 AND c_custkey % 5 <> 0 THEN CASE c_custkey % 4 WHEN 0 THEN '# ' ELSE '' END || c_name || chr(10) END AS markdown,
  CASE WHEN c_custkey % 4 = 3 THEN 'unknown model' WHEN c_custkey % 5 = 0 THEN 'no result' END AS error FROM customer"""
)
def conversion_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks from the queue through the conversion loop, each delivered one to three times, in one batch or in several.

    A row for each result that was written, with the last status of its task: there is one for every task.
    """
    base = fresh_dir(spark, "conversion")
    k = F.col("c_custkey")
    asked = table(spark, sf_dir, "customer").select(k, k.cast("string").alias("task_id"), F.col("c_name").alias("pdf_path"), F.when(k % 4 == 0, "titled").when(k % 4 == 1, "plain").when(k % 4 == 3, "none").alias("model"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("sent"))
    # the second delivery of some tasks is next to the first; what is delivered a third time is, after all first ones
    queue.publish(asked.unionByName(asked.where(k % 3 > 0)).orderBy("c_custkey").drop("c_custkey"), f"{base}/queue")
    queue.publish(asked.where(k % 3 == 2).drop("c_custkey"), f"{base}/queue")
    known = registry.Registry()
    name = F.when(F.col("task_id").cast("long") % 5 != 0, F.col("pdf_path"))
    known.register("plain", ["txt"])(lambda df: df.select("task_id", F.concat(name, F.lit("\n")).alias("markdown")))
    known.register("titled", ["txt"])(lambda df: df.select("task_id", F.concat(F.lit("# "), name, F.lit("\n")).alias("markdown")))
    messages = queue.message_stream(spark, f"{base}/queue", asked.count())
    tasks.drained(tasks.conversion(messages, known.convert, f"{base}/results", f"{base}/status", f"{base}/checkpoint", sent="sent", available=False))
    status = tasks.latest_status(spark.read.parquet(f"{base}/status"))
    return spark.read.parquet(f"{base}/results").select("task_id", "markdown", "error").join(status.select("task_id", "status"), "task_id")


_STATUS = "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'processing' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'completed' ELSE 'failed' END"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB, as the state processors need it, until the block ends."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@_C.add(
    f"""WITH RECURSIVE log AS (SELECT user_id::VARCHAR AS task_id, {_STATUS} AS status, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
walk(task_id, n, status, seq) AS (
  SELECT DISTINCT task_id, 0::BIGINT, NULL::VARCHAR, NULL::BIGINT FROM log
  UNION ALL
  SELECT w.task_id, l.n, CASE WHEN ok THEN l.status ELSE w.status END, CASE WHEN ok THEN l.seq ELSE w.seq END
  FROM (SELECT w.*, l.n AS m, l.status AS s, l.seq AS q, (w.status IS NULL AND l.status = 'pending') OR (w.status = 'pending' AND l.status IN ('processing', 'failed')) OR (w.status = 'processing' AND l.status IN ('completed', 'failed')) AS ok
        FROM walk w JOIN log l ON l.task_id = w.task_id AND l.n = w.n + 1) w, LATERAL (SELECT m AS n, s AS status, q AS seq) l)
SELECT task_id, arg_max(status, n) AS status, arg_max(seq, n) AS seq FROM walk WHERE status IS NOT NULL GROUP BY task_id"""
)
def guarded_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status messages as a stream in which no task skips a step or leaves a final status, by the order of their numbers.

    They arrive shuffled, in six batches, some of them twice; after the third the stream is stopped and started again.
    """
    base = fresh_dir(spark, "guarded")
    status = F.lit("failed")
    for event, name in (("signup", "pending"), ("click", "processing"), ("view", "processing"), ("purchase", "completed")):
        status = F.when(F.col("event_type") == event, name).otherwise(status)
    e = F.col("event_id")
    part = F.pmod(F.xxhash64(e), F.lit(6))
    dealt = F.explode(F.when(e % 5 == 0, F.array(part, (part + e % 3) % 6)).otherwise(F.array(part))).alias("part")
    log = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("task_id"), status.alias("status"), e.alias("seq"), dealt)
    log.repartition(6, "part").write.parquet(f"{base}/dealt")

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/status/batch={number}")

    schema = "task_id string, status string, seq long"
    found = spark.read.schema(f"{schema}, part long").parquet(f"{base}/dealt")
    with rocksdb(spark):
        for parts in ((0, 1, 2), (3, 4, 5)):
            for p in parts:
                found.where(F.col("part") == p).drop("part").coalesce(1).write.mode("append").parquet(f"{base}/log")
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/log")
            tasks.guarded_status(stream).writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    seen = spark.read.schema(f"{schema}, batch int").parquet(f"{base}/status")
    return seen.groupBy("task_id").agg(F.max_by(F.struct("status", "seq"), "batch").alias("s")).select("task_id", "s.status", "s.seq")


QUERIES, SQL = _C.queries, _C.sql
