"""A landing zone as a data source: files that arrive in folders are a stream, and the driver holds no list of them.

A zone is laid out as ``model=.../filename=.../file``. Each group of readers has a log of arrivals in it, kept as a queue: what a
listing finds anew is added at its end, and the stream goes through the log by offset. Tasks are given places in the log, and open the files
themselves. A listing is made when all that was found has been read; it holds a hash of each file that was seen before.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader

from ..storage import filesystem
from .queue import Log, Span, Table

NAME = "docflow_landing"
FILE = "path string, content binary, model string, filename string"
#: An arrival: its offset, where the file lies in the zone, and its bytes.
ARRIVAL = T.StructType([T.StructField("offset", T.LongType()), T.StructField("file", T.StringType()), T.StructField("size", T.LongType())])
#: Arrivals of a segment of the log at most; bytes of files that one task reads, and what each file counts for at least.
SEGMENT, SHARE, LEAST = 10_000, 16 << 20, 16 << 10
#: Bytes of files in one batch of rows (one file may be larger).
BATCH = 4 << 20
_NULL = "__HIVE_DEFAULT_PARTITION__"


def level(value: str | None) -> str:
    """A value as a folder's name holds it, by the engine's rules for partitions."""
    return re.sub(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""", lambda m: f"%{ord(m[0]):02X}", value) if value else _NULL


def value(level: str) -> str | None:
    """The value that a folder's name holds."""
    return None if level == _NULL else re.sub(r"%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), level)


def _key(file: str) -> bytes:
    return blake2b(file.encode("utf-8", "surrogateescape"), digest_size=16).digest()


class Arrivals(DataSourceStreamReader):
    """Files by their place in the log, ``per_batch`` at most at a time (0: all there are); unless ``by_time`` the first time all there are.

    A trigger for what is there now asks for an end once, and cannot be told from one by time. What a group has been given is kept,
    as a stream that goes on from a checkpoint isn't told where that ends.
    """

    def __init__(self, path: str, group: str, per_batch: int, by_time: bool) -> None:
        self.zone, self.log, self.group, self.per_batch, self.all = path, f"{path}/_arrivals/{group}", group, per_batch, not by_time
        self.at = Log(self.log).place(group)["given"]
        self.seen: set[bytes] | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        # a new checkpoint sees all files
        return {"offset": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        log = Log(self.log)
        if self.all or self.at >= log.end():
            log.publish([log.staged(self._new(), SEGMENT)])
        end = log.end()
        self.at = end if self.all or not self.per_batch else max(self.at, min(end, self.at + self.per_batch))
        self.all = False
        return {"offset": self.at}

    def _arrivals(self, span: Span | None) -> Iterator[pa.RecordBatch]:
        return Table(self.log, ARRIVAL).read(span)

    def _new(self) -> Iterator[str]:
        """What lies in the zone and is not in the log, as lines of it."""
        if self.seen is None:
            log = Log(self.log)
            self.seen = {_key(f) for s in log.spans(0, log.end()) for b in self._arrivals(s) for f in b.column("file").to_pylist()}
        where, root = filesystem(self.zone)

        def under(folder: str, kind: fs.FileType, start: str = "") -> list[fs.FileInfo]:
            found = where.get_file_info(fs.FileSelector(f"{root}/{folder}", allow_not_found=True))
            return [f for f in found if f.type == kind and f.base_name.startswith(start) and not f.base_name.startswith((".", "_"))]

        for model in sorted(f.base_name for f in under("", fs.FileType.Directory, "model=")):
            for name in sorted(f.base_name for f in under(model, fs.FileType.Directory, "filename=")):
                for f in sorted(under(f"{model}/{name}", fs.FileType.File), key=lambda f: f.base_name):
                    file = f"{model}/{name}/{f.base_name}"
                    if (key := _key(file)) not in self.seen:
                        self.seen.add(key)
                        yield json.dumps({"file": file, "size": f.size})

    def partitions(self, start: dict, end: dict) -> list[Span]:
        """Pieces of segments, dealt by the bytes of their files."""
        log = Log(self.log)
        self.at = max(self.at, end["offset"])
        log.keep_place(self.group, {"given": max(log.place(self.group)["given"], end["offset"])})
        out = []
        for span in log.spans(start["offset"], end["offset"]):
            size = SHARE
            for b in self._arrivals(span):
                for at, n in zip(*[b.column(c).to_pylist() for c in ("offset", "size")], strict=True):
                    if size >= SHARE:
                        out.append(Span(span.name, span.first, at, at))
                        size = 0
                    out[-1].end = at + 1
                    size += max(n, LEAST)
        return out

    def read(self, partition: Span | None) -> Iterator[pa.RecordBatch]:
        where, root = filesystem(self.zone)
        rows: list[tuple] = []
        size = 0

        def made() -> pa.RecordBatch:
            kinds = (pa.string(), pa.binary(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "content", "model", "filename"])

        for b in self._arrivals(partition):
            for file in b.column("file").to_pylist():
                with where.open_input_file(f"{root}/{file}") as f:
                    content = f.readall()
                model, name, _ = file.split("/")
                rows.append((f"{self.zone}/{file}", content, value(model.partition("=")[2]), value(name.partition("=")[2])))
                size += len(content) + 500
                if size >= BATCH:
                    yield made()
                    rows, size = [], 0
        if rows:
            yield made()


class LandingSource(DataSource):
    """``spark.readStream.format(NAME)`` with options path, group, perBatch and byTime."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return FILE

    def streamReader(self, schema: T.StructType) -> Arrivals:  # noqa: N802
        o = self.options
        return Arrivals(o["path"].rstrip("/"), o.get("group", "workers"), int(o.get("perbatch", 0)), o.get("bytime", "false").lower() == "true")


def file_stream(spark: SparkSession, path: str, per_batch: int = 0, group: str = "workers", by_time: bool = False) -> DataFrame:
    """Rows (path, content, model, filename) of the files in a zone as they arrive, each once; streams that run at one time are groups of their own.

    A trigger for what is there now takes all of it in one batch. ``by_time`` says that the trigger is another one: then ``per_batch``
    bounds the first batch too.
    """
    spark.dataSource.register(LandingSource)
    return spark.readStream.format(NAME).option("path", path).option("perBatch", per_batch).option("group", group).option("byTime", by_time).load()
