"""A message queue as a data source: published by a job, read by offset as a table or as a stream.

A queue is a folder that driver and executors share. It holds segments of JSON lines that never change, named by the offset
of their first message and their number of messages; so the names are the index. A publisher's tasks write segments aside,
and its commit gives them their places. What a group of readers has been given and has finished is kept beside them: a new
stream of the group starts after what was finished, so messages in between are delivered again, as by a broker.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, date, datetime
from itertools import chain, islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    DataSourceStreamWriter,
    DataSourceWriter,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema

from ..storage import filesystem

NAME = "docflow_queue"
#: A message: where it stands, when it was sent, and the task.
MESSAGE = "offset long, sent timestamp, task_id string, pdf_path string, model string"
#: Messages of a segment at most.
SPAN = 100_000


class Log:
    """The folder of a queue."""

    def __init__(self, path: str) -> None:
        self.fs, self.root = filesystem(path)

    def _names(self, folder: str) -> list[str]:
        found = self.fs.get_file_info(fs.FileSelector(f"{self.root}/{folder}", allow_not_found=True))
        return [f.base_name for f in found if f.type == fs.FileType.File and not f.base_name.startswith(".")]

    def segments(self) -> list[tuple[int, int, str]]:
        """(first offset, offset after the last, name), in order."""
        names = (n for n in self._names("log") if n.endswith(".jsonl"))
        return sorted((int(n[:20]), int(n[:20]) + int(n[21:31]), n) for n in names)

    def end(self) -> int:
        return max((z for _, z, _ in self.segments()), default=0)

    def staged(self, lines: Iterator[str], most: int = SPAN) -> Staged:
        """Write messages aside, as segments of at most ``most`` without a place; none for no messages."""
        parts = []
        self.fs.create_dir(f"{self.root}/staged")
        for first in lines:
            name, n = f"{uuid.uuid4().hex}.jsonl", 0
            with self.fs.open_output_stream(f"{self.root}/staged/{name}") as out:
                for line in chain([first], islice(lines, most - 1)):
                    out.write(line.encode() + b"\n")
                    n += 1
            parts.append((name, n))
        return Staged(parts)

    def publish(self, found: Iterable[Staged | None]) -> None:
        """Give segments their places at the end, in the order given. There is one publisher at a time."""
        self.fs.create_dir(f"{self.root}/log")
        at = self.end()
        for name, n in (x for s in found if s is not None for x in s.parts):
            self.fs.move(f"{self.root}/staged/{name}", f"{self.root}/log/{at:020d}-{n:010d}.jsonl")
            at += n

    def drop(self, found: Iterable[Staged | None]) -> None:
        for name, _ in (x for s in found if s is not None for x in s.parts):
            self.fs.delete_file(f"{self.root}/staged/{name}")

    def place(self, group: str) -> dict[str, int]:
        """``given`` and ``done``: the offsets before which a group has been given messages, and has finished them."""
        where = f"{self.root}/groups/{group}.json"
        if self.fs.get_file_info(where).type != fs.FileType.File:
            return {"given": 0, "done": 0}
        with self.fs.open_input_stream(where) as f:
            return json.loads(f.read())

    def keep_place(self, group: str, place: dict[str, int]) -> None:
        self.fs.create_dir(f"{self.root}/groups")
        aside = f"{self.root}/groups/.{group}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(aside) as f:
            f.write(json.dumps(place).encode())
        self.fs.move(aside, f"{self.root}/groups/{group}.json")

    def spans(self, start: int, end: int) -> list[Span]:
        """The segments that hold the offsets from ``start`` to before ``end``, each with its share of them."""
        return [Span(name, a, max(a, start), min(z, end)) for a, z, name in self.segments() if max(a, start) < min(z, end)]


@dataclass
class Staged(WriterCommitMessage):
    parts: list[tuple[str, int]]


@dataclass
class Span(InputPartition):
    """Offsets ``start`` to before ``end`` of a segment whose first offset is ``first``."""

    name: str
    first: int
    start: int
    end: int


def _rows(path: str, span: Span | None, schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """A span's messages under the schema: ``offset`` is the place, other fields are the message's; broken lines have none."""
    if span is None:  # the engine's own piece where there are none
        return
    log, arrow = Log(path), to_arrow_schema(schema)
    kinds = {f.name: f.dataType for f in schema.fields}
    held: list[dict] = []
    with log.fs.open_input_file(f"{log.root}/log/{span.name}") as raw:
        for i, line in enumerate(io.BufferedReader(raw, 1 << 20), span.first):
            if i >= span.end:
                break
            if i < span.start:
                continue
            try:
                found = json.loads(line)
            except ValueError:
                found = {}
            found = found if isinstance(found, dict) else {}
            held.append({n: i if n == "offset" else _value(found.get(n), k) for n, k in kinds.items()})
            if len(held) == 10_000:
                yield pa.RecordBatch.from_pylist(held, schema=arrow)
                held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=arrow)


def _value(x: object, kind: T.DataType) -> object:
    if x is None:
        return None
    if isinstance(kind, T.StringType):
        return x if isinstance(x, str) else json.dumps(x)
    try:
        if isinstance(kind, T.TimestampType):
            return datetime.fromisoformat(x)
        return int(x) if isinstance(kind, T.IntegralType) else float(x) if isinstance(kind, T.FractionalType) else x
    except (TypeError, ValueError):
        return None


class Table(DataSourceReader):
    """All messages, or those between the offsets that a filter asks for."""

    def __init__(self, path: str, schema: T.StructType) -> None:
        self.path, self.schema, self.start, self.end = path, schema, 0, 1 << 62

    def partitions(self) -> list[Span]:
        return Log(self.path).spans(self.start, self.end)

    def read(self, partition: Span | None) -> Iterator[pa.RecordBatch]:
        return _rows(self.path, partition, self.schema)


class FilteredTable(Table):
    """A table that takes comparisons of ``offset`` itself: segments outside of them are not opened."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if getattr(f, "attribute", None) != ("offset",):
                yield f
            elif isinstance(f, EqualTo):
                self.start, self.end = max(self.start, f.value), min(self.end, f.value + 1)
            elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.start = max(self.start, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, LessThan | LessThanOrEqual):
                self.end = min(self.end, f.value + isinstance(f, LessThanOrEqual))
            else:
                yield f


class Stream(DataSourceStreamReader):
    """Messages by offset, ``per_batch`` at most at a time (0: all there are)."""

    def __init__(self, path: str, schema: T.StructType, group: str, per_batch: int) -> None:
        self.path, self.schema, self.group, self.per_batch = path, schema, group, per_batch
        # a stream that goes on goes on after what its checkpoint has planned
        self.at = Log(path).place(group)["given"]

    def initialOffset(self) -> dict:  # noqa: N802
        self.at = Log(self.path).place(self.group)["done"]
        return {"offset": self.at}

    def latestOffset(self) -> dict:  # noqa: N802
        end = Log(self.path).end()
        self.at = max(self.at, min(end, self.at + self.per_batch) if self.per_batch else end)
        return {"offset": self.at}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        log = Log(self.path)
        self.at = max(self.at, end["offset"])
        log.keep_place(self.group, log.place(self.group) | {"given": end["offset"]})
        return log.spans(start["offset"], end["offset"])

    def read(self, partition: Span | None) -> Iterator[pa.RecordBatch]:
        return _rows(self.path, partition, self.schema)

    def commit(self, end: dict) -> None:
        log = Log(self.path)
        place = log.place(self.group)
        log.keep_place(self.group, {"given": max(place["given"], end["offset"]), "done": max(place["done"], end["offset"])})


class _Publishing:
    """What publishers of tables and of streams share: rows become messages."""

    def __init__(self, path: str, schema: T.StructType) -> None:
        self.path, self.names = path, [n for n in schema.names if n != "offset"]

    def write(self, iterator: Iterator[Row]) -> Staged:
        return Log(self.path).staged(json.dumps({n: _plain(r[n]) for n in self.names if r[n] is not None}, ensure_ascii=False) for r in iterator)


class TablePublisher(_Publishing, DataSourceWriter):
    def commit(self, messages: list[Staged | None]) -> None:
        Log(self.path).publish(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        Log(self.path).drop(messages)


class StreamPublisher(_Publishing, DataSourceStreamWriter):
    """A batch that is committed again after a crash is published again: messages come at least once."""

    def commit(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        Log(self.path).publish(messages)

    def abort(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        Log(self.path).drop(messages)


def _plain(x: object) -> object:
    if isinstance(x, datetime):
        return x.astimezone(UTC).isoformat()
    return x.isoformat() if isinstance(x, date) else x


class QueueSource(DataSource):
    """``spark.read.format(NAME)`` and ``readStream``, with options path, group, perBatch and filters."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return MESSAGE

    def reader(self, schema: T.StructType) -> Table:
        return (FilteredTable if self.options.get("filters") == "true" else Table)(self.options["path"], schema)

    def streamReader(self, schema: T.StructType) -> Stream:  # noqa: N802
        return Stream(self.options["path"], schema, self.options.get("group", "workers"), int(self.options.get("perbatch", 0)))

    def writer(self, schema: T.StructType, overwrite: bool) -> TablePublisher:
        return TablePublisher(self.options["path"], schema)

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> StreamPublisher:  # noqa: N802
        return StreamPublisher(self.options["path"], schema)


def publish(rows: DataFrame, path: str) -> None:
    """Add rows (task_id, pdf_path, model, sent, or any other fields) as messages at the end of a queue."""
    rows.sparkSession.dataSource.register(QueueSource)
    rows.write.format(NAME).mode("append").option("path", path).save()


def messages(spark: SparkSession, path: str, schema: str | T.StructType = MESSAGE) -> DataFrame:
    """A queue's messages as a table; comparisons of ``offset`` reach the source where the session lets filters do so."""
    spark.dataSource.register(QueueSource)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false").lower()
    return spark.read.format(NAME).schema(schema).option("path", path).option("filters", pushed).load()


def message_stream(spark: SparkSession, path: str, per_batch: int = 0, group: str = "workers", schema: str | T.StructType = MESSAGE) -> DataFrame:
    """A queue's messages as a stream for a group of readers.

    With a bound on a batch, use a trigger by time and ``processAllAvailable``: a trigger for what is there now takes one batch.
    """
    spark.dataSource.register(QueueSource)
    return spark.readStream.format(NAME).schema(schema).option("path", path).option("perBatch", per_batch).option("group", group).load()
