"""The queue as a source, redelivered tasks, status that arrives late."""

import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from docflow.plans import registry
from docflow.sources import queue
from docflow.streaming import tasks

DAY = datetime(2024, 5, 1)


def _asked(spark, ids, sent=DAY):
    return spark.createDataFrame([(f"t{i}", f"in/{i}.pdf", None if i % 3 else "good", sent + timedelta(minutes=i)) for i in ids], "task_id string, pdf_path string, model string, sent timestamp")


def _files(path, kind):
    return sorted(p.name for p in (path / kind).glob("*")) if (path / kind).is_dir() else []


def test_messages_have_offsets_in_the_order_of_publishing(spark, tmp_path):
    path = str(tmp_path / "q")
    assert queue.messages(spark, path).count() == 0
    queue.publish(_asked(spark, range(7)).coalesce(1), path)
    queue.publish(_asked(spark, []), path)
    queue.publish(_asked(spark, range(7, 10)).coalesce(1), path)
    got = queue.messages(spark, path).orderBy("offset").collect()
    assert [(r["offset"], r["task_id"], r["model"], r["sent"]) for r in got] == [(i, f"t{i}", None if i % 3 else "good", DAY + timedelta(minutes=i)) for i in range(10)]
    assert _files(tmp_path / "q", "log") == [f"{0:020d}-{7:010d}.jsonl", f"{7:020d}-{3:010d}.jsonl"]
    assert _files(tmp_path / "q", "staged") == []


def test_large_publications_are_cut_into_segments(tmp_path):
    log = queue.Log(str(tmp_path / "q"))
    log.publish([log.staged(iter(f'{{"task_id": "{i}"}}' for i in range(25)), 10), None, log.staged(iter(()))])
    assert [(a, z) for a, z, _ in log.segments()] == [(0, 10), (10, 20), (20, 25)]
    assert [(s.first, s.start, s.end) for s in log.spans(5, 21)] == [(0, 5, 10), (10, 10, 20), (20, 20, 21)]
    log.drop([log.staged(iter(["{}"]))])
    assert _files(tmp_path / "q", "staged") == []


def test_odd_messages(spark, tmp_path):
    log = queue.Log(str(tmp_path / "q"))
    lines = ['{"task_id": 5, "seq": "7", "sent": "2024-05-01T10:00:00+02:00", "more": 1}', "broken", "[1]", "", '{"seq": "x", "sent": 3, "task_id": {"a": "\\u00e9"}}']
    log.publish([log.staged(iter(lines))])
    got = queue.messages(spark, str(tmp_path / "q"), "seq long, task_id string, offset long, sent timestamp").orderBy("offset").collect()
    assert [tuple(r) for r in got] == [(7, "5", 0, datetime(2024, 5, 1, 8)), (None, None, 1, None), (None, None, 2, None), (None, None, 3, None), (None, '{"a": "\\u00e9"}', 4, None)]


def test_offsets_are_filtered_at_the_source(spark, tmp_path):
    path = str(tmp_path / "q")
    for i in range(0, 50, 10):
        queue.publish(_asked(spark, range(i, i + 10)).coalesce(1), path)
    # a segment that must not be opened is broken on purpose
    first = sorted((tmp_path / "q" / "log").iterdir())[0]
    first.unlink()
    first.mkdir()
    key = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        for condition, want in (("offset >= 12 and offset < 31", range(12, 31)), ("offset > 47", range(48, 50)), ("offset = 20 and model is null", [20]), ("offset <= 11 and offset > 9 and task_id like 't1%'", [10, 11]), ("offset in (20, 33) and offset > 9", [20, 33])):
            assert sorted(r["offset"] for r in queue.messages(spark, path).where(condition).collect()) == [i for i in want if condition[-4:] != "null" or i % 3]
    finally:
        spark.conf.set(key, before)


def _reading(spark, path, out, checkpoint, per_batch=0, group="workers"):
    def batch(df, number):
        df.select("offset").write.mode("overwrite").parquet(f"{out}/batch={number}")

    tasks.drained(queue.message_stream(spark, path, per_batch, group).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start())
    return sorted((r["batch"], r["offset"]) for r in spark.read.parquet(out).collect())


def test_a_stream_goes_on_by_offset(spark, tmp_path):
    path, out, check = (str(tmp_path / n) for n in ("q", "out", "check"))
    queue.publish(_asked(spark, range(10)).coalesce(1), path)
    assert _reading(spark, path, out, check, 4) == [(i // 4, i) for i in range(10)]
    queue.publish(_asked(spark, range(10, 15)).coalesce(1), path)
    got = _reading(spark, path, out, check, 4)
    assert [o for _, o in got] == list(range(15)) and max(b for b, _ in got) == 4
    assert queue.Log(path).place("workers")["given"] == 15
    # another group reads for itself; a new stream of the first one starts after what that has finished
    assert [o for _, o in _reading(spark, path, str(tmp_path / "o2"), str(tmp_path / "c2"), group="others")] == list(range(15))
    done = queue.Log(path).place("workers")["done"]
    assert 8 <= done <= 15
    queue.publish(_asked(spark, [15]), path)
    assert [o for _, o in _reading(spark, path, str(tmp_path / "o3"), str(tmp_path / "c3"))] == list(range(done, 16))


def test_a_stream_publishes(spark, tmp_path):
    path = str(tmp_path / "q")
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"task_id": str(i), "pdf_path": "x", "model": "m"}))
    spark.dataSource.register(queue.QueueSource)
    tasks.task_stream(spark, str(tmp_path / "in")).writeStream.format(queue.NAME).option("path", path).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = queue.messages(spark, path).collect()
    assert sorted((r["offset"], r["task_id"]) for r in got) == sorted(zip(range(3), (r["task_id"] for r in sorted(got)), strict=True))
    assert {r["task_id"] for r in got} == {"0", "1", "2"}


def _known():
    known = registry.Registry()
    known.register("good", ["pdf"])(lambda df: df.select("task_id", F.concat("pdf_path", F.lit("!")).alias("markdown")))
    known.register("double", ["pdf"])(lambda df: df.crossJoin(df.sparkSession.range(2)).select("task_id", F.concat("pdf_path", "id").alias("markdown")))
    return known


def test_a_repeated_message_is_one_task(spark):
    rows = [("1", "a", "good"), ("1", "a", "good"), ("2", "b", None), ("3", "c", "none"), ("3", "c", "none"), (None, "d", "good"), (None, "d", "good"), ("4", "e", "double"), ("5", "f", "good"), ("5", "g", "good")]
    asked = spark.createDataFrame(rows, "task_id string, pdf_path string, model string").withColumns({"extra": F.create_map(F.lit(1), F.lit(2)), "files": F.array(F.lit("x"))})
    runs = [sorted((tuple(r) for r in _known().convert(asked.repartition(n)).collect()), key=repr) for n in (1, 3)]
    assert runs[0] == runs[1]
    got = {t: (m, e) for t, m, e in runs[0]}
    assert len(runs[0]) == len(got) == 6
    assert got["5"][0] in ("f!", "g!")
    assert {t: got[t] for t in ("1", "2", "3", "4")} == {"1": ("a!", None), "2": ("b!", None), "3": (None, "unknown model"), "4": ("e0", None)}
    assert tasks.one_a_task(asked.select("task_id")).count() == 6
    assert tasks.one_a_task(asked).columns == asked.columns


def test_redelivery_over_batches(spark, tmp_path):
    path, *where = (str(tmp_path / n) for n in ("q", "results", "status", "checkpoint"))
    rng = random.Random(4)
    sent = [i for i in range(30) for _ in range(rng.randint(1, 3))]
    rng.shuffle(sent)
    for k in range(0, len(sent), 10):
        queue.publish(_asked(spark, sent[k : k + 10]).coalesce(1), path)
    for _ in range(2):  # the second run starts from the checkpoint and finds nothing new
        tasks.drained(tasks.conversion(queue.message_stream(spark, path, 7), _known().convert, *where, sent="sent", available=False))
    results = spark.read.parquet(where[0])
    assert sorted(r["task_id"] for r in results.collect()) == sorted(f"t{i}" for i in range(30))
    assert results.select("batch").distinct().count() > 3
    log = spark.read.parquet(where[1])
    assert log.count() == 60 and {r["status"] for r in tasks.latest_status(log).collect()} == {"completed"}
    # weeks later the ids are forgotten: the task is done again, and its last result is the one that counts
    for i, day in ((30, 20), (31, 21), (3, 30)):
        queue.publish(_asked(spark, [i], DAY + timedelta(days=day)), path)
    tasks.drained(tasks.conversion(queue.message_stream(spark, path, 1), _known().convert, *where, sent="sent", available=False))
    again = spark.read.parquet(where[0])
    assert again.where("task_id = 't3'").count() == 2
    assert tasks.latest_results(again).count() == 32


def _guarded(spark, path, out, check, sent=None, gap=None):
    def batch(df, number):
        df.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema("task_id string, status string, seq long, sent timestamp").option("maxFilesPerTrigger", 1).json(path)
    tasks.guarded_status(stream, sent, gap).writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    seen = spark.read.parquet(out).groupBy("task_id").agg(F.max_by(F.struct("status", "seq"), "batch").alias("s"))
    return {r["task_id"]: tuple(r["s"]) for r in seen.collect()}


def _walked(steps):
    """The status of each task after its steps in order."""
    out = {}
    for t, s, n in sorted(set(steps), key=lambda x: (x[2], x[1])):
        now = out.get(t, (None, 0))[0]
        if (now is None and s == "pending") or (now is not None and s in tasks.NEXT[now]):
            out[t] = (s, n)
    return out


def _written(folder, k, steps, minute=None):
    folder.mkdir(exist_ok=True)
    when = DAY + timedelta(minutes=minute or 0)
    (folder / f"{k:03d}.json").write_text("\n".join(json.dumps({"task_id": t, "status": s, "seq": n, "sent": (when.isoformat() if minute is not None else None)}) for t, s, n in steps))


def test_status_in_any_order_equals_status_in_order(spark, tmp_path):
    rng = random.Random(12)
    steps = [(f"t{rng.randrange(6)}", rng.choice(list(tasks.NEXT)), n) for n in range(120)]
    steps += [("late", "processing", 1002), ("late", "completed", 1003), ("late", "pending", 1001)]
    mixed = [*steps, *rng.sample(steps, 20)]
    rng.shuffle(mixed)
    place = [str(tmp_path / n) for n in ("in", "out", "check")]
    for k in range(3):
        _written(tmp_path / "in", k, mixed[k::6])
    _guarded(spark, *place)
    for k in range(3, 6):  # a new worker finds the waiting steps in the state of the old one
        _written(tmp_path / "in", k, mixed[k::6])
    got = _guarded(spark, *place)
    assert got == _walked(steps) and got["late"] == ("completed", 1003)


def test_a_gap_closes(spark, tmp_path):
    place = [str(tmp_path / n) for n in ("in", "out", "check")]
    # the first step of "a" comes within the gap, that of "b" after it: by then the step without it has settled
    batches = [(0, [("a", "processing", 2), ("b", "processing", 2), ("c", "pending", 1)]), (5, [("a", "pending", 1), ("c", "processing", 2)]), (30, [("x", "pending", 1)]), (60, [("x", "processing", 2)]), (61, [("b", "pending", 1), ("c", "completed", 3), ("x", "failed", 3)])]
    for k, (minute, steps) in enumerate(batches):
        _written(tmp_path / "in", k, steps, minute)
        got = _guarded(spark, *place, "sent", "10 minutes")
    assert got["a"] == ("processing", 2) and got["c"] == ("completed", 3) and got["x"] == ("failed", 3)
    assert "b" not in got
