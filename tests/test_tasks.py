"""Registry, gates, status and the conversion loop."""

import io
import json
import time
import zipfile

from docflow import pipelines
from docflow.catalog import tasks as catalog
from docflow.plans import registry
from docflow.streaming import tasks
from docflow.streaming.progress import ProgressLog
from pyspark.sql import functions as F


def test_extension_gate(spark):
    rows = spark.createDataFrame([("m", "Report.PDF"), ("m", "xpdf"), ("m", "a.docx"), ("other", "a.pdf")], "model string, filename string")
    models = spark.createDataFrame([("m", ["pdf"])], "model string, extensions array<string>")
    got = {r["model"] + r["filename"]: r["verdict"] for r in registry.gated(rows, models).collect()}
    assert got == {"mReport.PDF": "accepted", "mxpdf": "accepted", "ma.docx": "wrong extension", "othera.pdf": "unknown model"}


def test_chain_and_default(spark):
    steps = [lambda d: d.withColumn("x", F.col("id") + 1), lambda d: d.withColumn("y", F.col("x") * 10)]
    assert [tuple(r) for r in registry.chain(steps)(spark.range(2)).orderBy("id").collect()] == [(0, 1, 10), (1, 2, 20)]
    assert registry.chain([])(spark.range(2)).count() == 2
    known = registry.Registry()
    known.register("a", ["pdf"])(lambda df: df)
    known.register("b", ["pdf"], default=True)(lambda df: df)
    assert known.default == "b"


def test_result_answer(spark):
    asked = spark.createDataFrame([(t,) for t in "abcd"], "task_id string")
    status = spark.createDataFrame([("b", "processing"), ("c", "completed"), ("d", "completed")], "task_id string, status string")
    results = spark.createDataFrame([("d", "# x")], "task_id string, markdown string")
    assert {r["task_id"]: (r["code"], r["markdown"]) for r in tasks.result_answer(asked, status, results).collect()} == {"a": (404, None), "b": (400, None), "c": (500, None), "d": (200, "# x")}


def test_result_query_reads_the_orders_of_every_customer(spark, tmp_path):
    spark.createDataFrame([(c,) for c in range(1, 7)], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(12, 1), (11, 1), (30, 3), (40, 4)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    events = [(1, 1, "purchase"), (2, 2, "purchase"), (3, 3, "purchase"), (4, 4, "purchase"), (5, 4, "error"), (6, 6, "purchase")]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    got = {r["task_id"]: (r["code"], r["markdown"]) for r in catalog.result_answer(spark, str(tmp_path)).collect()}
    # customers 2 and 6 have no orders: their results are lost
    assert got == {"1": (200, "11\n12"), "2": (500, None), "3": (200, "30"), "4": (400, None), "5": (404, None), "6": (500, None)}


def test_conversion_loop(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for t, m in (("1", "good"), ("2", None), ("3", "unknown")):
        (tmp_path / "in" / f"{t}.json").write_text(json.dumps({"task_id": t, "pdf_path": "x", "model": m}))
    known = registry.Registry()
    known.register("good", ["txt"])(lambda df: df.select("task_id", F.lit("done\n").alias("markdown")))
    where = [str(tmp_path / n) for n in ("results", "status", "checkpoint")]
    for _ in range(2):  # the second run finds nothing new
        tasks.conversion(tasks.task_stream(spark, str(tmp_path / "in"), 2), known.convert, *where).awaitTermination()
    log = spark.read.parquet(where[1])
    assert log.count() == 6
    assert {r["task_id"]: r["status"] for r in tasks.latest_status(log).collect()} == {"1": "completed", "2": "completed", "3": "failed"}


def test_discovered_pipelines():
    assert pipelines.REGISTRY.discover("docflow.pipelines") == ["office", "plain"]
    assert pipelines.REGISTRY.default == "plain"
    assert {n: p.formats for n, p in pipelines.REGISTRY.pipelines.items()} == {"office": ("docx", "pptx", "xlsx"), "plain": ("txt", "md")}


def test_registry_as_json(spark):
    models = spark.createDataFrame([("b", ["x", "y"]), ("a", [])], "model string, extensions array<string>")
    row = registry.stored(models).first()["models"]
    assert json.loads(row) == {"a": [], "b": ["x", "y"]}


def test_progress_is_logged(spark, tmp_path, caplog):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(json.dumps({"task_id": "1", "pdf_path": "x", "model": "m"}))
    listener = ProgressLog()
    spark.streams.addListener(listener)
    try:
        with caplog.at_level("INFO", "docflow.streaming"):
            tasks.task_stream(spark, str(tmp_path / "in")).writeStream.foreachBatch(lambda df, n: None).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
            for _ in range(100):
                if "ended" in caplog.text:
                    break
                time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert "started" in caplog.text and "ended" in caplog.text and "batch 0: " in caplog.text


def test_markdown_files(spark, tmp_path):
    rows = spark.createDataFrame([("1", "# a\n\nb\n"), ("2", "x\n"), ("3", None)], "task_id string, markdown string")
    tasks.write_markdown(rows, str(tmp_path / "m"))
    assert sorted(map(tuple, tasks.read_markdown(spark, str(tmp_path / "m")).collect())) == [("1", "# a\n\nb\n"), ("2", "x\n")]


def test_landed_files_are_what_the_stream_reads(spark, tmp_path):
    names = ["a.pdf", "50%#'*:=?\\{[]^.pdf", 'q"/ü 漢.PDF', "a.pdf"]
    rows = [("m/1", n, f"{i}".encode()) for i, n in enumerate(names)] + [(None, "x", b"n"), ("m", "gone", None)]
    zone = str(tmp_path / "zone")
    for _ in range(2):  # a run that comes again replaces its own files
        tasks.land(spark.createDataFrame(rows, "model string, filename string, content binary"), zone)
    tasks.upload_stream(spark, zone, 100).writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/got/batch={n}")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "got")).collect()
    assert sorted(((r["model"], r["filename"], bytes(r["content"])) for r in got), key=repr) == sorted((r for r in rows if r[2] is not None), key=repr)


def test_upload_stream_goes_on_from_its_log(spark, tmp_path):
    zone = str(tmp_path / "zone")

    def land(*names):
        tasks.land(spark.createDataFrame([("m", n, n.encode()) for n in names], "model string, filename string, content binary"), zone)

    def read(per_batch, checkpoint, now):
        sizes = []

        def batch(df, number):
            # no batch names its files in the plan, however many there are
            assert "filename=" not in df._jdf.queryExecution().toString()
            sizes.append(sorted(r["filename"] for r in df.select("filename").collect()))

        stream = tasks.upload_stream(spark, zone, per_batch, by_time=not now).writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / checkpoint))
        if now:
            stream.trigger(availableNow=True).start().awaitTermination()
        else:
            tasks.drained(stream.start())
        return [s for s in sizes if s]

    land("a", "b", "b", "c")  # rows that are the same are files of their own
    assert read(3, "one", False) == [["a", "b", "b"], ["c"]]
    land("c", "d", "e")
    assert sorted(n for s in read(1, "one", True) for n in s) == ["d", "e"]
    assert read(1, "one", False) == []
    # another checkpoint sees all
    assert sorted(n for s in read(1, "two", True) for n in s) == ["a", "b", "b", "c", "d", "e"]
    (tmp_path / "zone/model=m/filename=f").mkdir()
    (tmp_path / "zone/model=m/filename=f/x").write_bytes(b"put by another program")
    assert read(1, "two", False) == [["f"]]


def test_bundles(spark):
    rows = spark.createDataFrame([("t", "text.md", bytearray(b"x")), ("t", "images/1.png", bytearray(b"y")), ("t", "text.md", bytearray(b"x"))], "task_id string, path string, content binary")
    with zipfile.ZipFile(io.BytesIO(bytes(tasks.bundles(rows).first()["zip"]))) as z:
        assert sorted(z.namelist()) == ["images/1.png", "text.md"]
        assert z.read("text.md") == b"x"
    back = {r["path"]: bytes(r["content"]) for r in tasks.unbundled(tasks.bundles(rows)).collect()}
    assert back == {"text.md": b"x", "images/1.png": b"y"}
