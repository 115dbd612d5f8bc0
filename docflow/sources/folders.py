"""Folders of small files, one a page, as a data source: a filter on the page decides which files are opened.

An annotation tool leaves thousands of files ``<page>.json`` (an array of elements) or ``<page>.txt`` (an edge a line). A job that
asks for some pages opens theirs; one that asks for all deals the files to tasks by their sizes.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith
from pyspark.sql.pandas.types import to_arrow_schema

from ..schema import BOX, ELEMENT
from ..storage import filesystem

NAME = "docflow_folder"
#: Bytes of files that one task reads, and what each file counts for at least.
SHARE, LEAST = 16 << 20, 64 << 10
EDGES = T.StructType([T.StructField("page", T.StringType()), *[T.StructField(n, T.IntegerType()) for n in ("ord", "parent_id", "child_id")]])
ELEMENTS = T.StructType([T.StructField("page", T.StringType()), T.StructField("ord", T.IntegerType()), *[f for f in ELEMENT if f.name != "page"], T.StructField("error", T.StringType())])
_EDGE = re.compile(r"\s*#(\d+)->#(\d+)\s*")


@dataclass
class Files(InputPartition):
    names: list[str]


class Folder(DataSourceReader):
    """The pages of a folder; those that a filter leaves, if it can take one."""

    def __init__(self, path: str, kind: str) -> None:
        self.path, self.kind = path, kind
        self.pages: set[str] | None = None
        self.starts: list[str] = []

    def wanted(self, page: str) -> bool:
        return (self.pages is None or page in self.pages) and all(page.startswith(s) for s in self.starts)

    def partitions(self) -> list[Files]:
        where, root = filesystem(self.path)
        ending = f".{self.kind}"
        if self.pages is not None:  # as many as are asked for, whatever else lies there
            found = where.get_file_info([f"{root}/{quote(p, safe='')}{ending}" for p in sorted(self.pages) if self.wanted(p)])
        else:
            found = where.get_file_info(fs.FileSelector(root, allow_not_found=True))
        files = sorted((f.base_name, f.size) for f in found if f.type == fs.FileType.File and f.base_name.endswith(ending) and self.wanted(unquote(f.base_name[: -len(ending)])))
        out, size = [], SHARE
        for name, n in files:
            if size >= SHARE:
                out.append(Files([]))
                size = 0
            out[-1].names.append(name)
            size += max(n, LEAST)
        return out

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        where, root = filesystem(self.path)
        schema, rows_of = (EDGES, _edges) if self.kind == "txt" else (ELEMENTS, _elements)
        arrow = to_arrow_schema(schema)
        for name in partition.names if partition is not None else ():
            with where.open_input_file(f"{root}/{name}") as f:
                text = f.readall().decode("utf-8", "replace")
            page = unquote(name.rpartition(".")[0])
            rows = list(rows_of(text))
            for lo in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_pylist([{"page": page, **r} for r in rows[lo : lo + 10_000]], schema=arrow)


class FilteredFolder(Folder):
    """Takes equality, membership and beginnings of ``page`` itself."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            own = getattr(f, "attribute", None) == ("page",)
            if own and isinstance(f, EqualTo | In):
                these = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.pages = these if self.pages is None else self.pages & these
            elif own and isinstance(f, StringStartsWith):
                self.starts.append(f.value)
            else:
                yield f


def _edges(text: str) -> Iterator[dict]:
    """Edges line by line; lines that are no edge are passed over, and counted."""
    for i, line in enumerate(text.split("\n")):
        if found := _EDGE.fullmatch(line):
            yield {"ord": i, "parent_id": int(found[1]), "child_id": int(found[2])}


def _elements(text: str) -> Iterator[dict]:
    """Elements of a JSON array, or of one object; fields of another kind are null, and a file that is no JSON is one row with an error."""
    try:
        found = json.loads(text)
    except ValueError as e:
        yield {"error": f"{type(e).__name__}: {e}"}
        return
    for i, e in enumerate(found if isinstance(found, list) else [found]):
        if isinstance(e, dict):
            yield {"ord": i, **{f.name: _cast(e.get(f.name), f.dataType) for f in ELEMENT if f.name != "page"}}


def _cast(x: object, kind: T.DataType) -> object:
    number = isinstance(x, int | float) and not isinstance(x, bool)
    if kind == BOX:
        return {n: _cast(x.get(n), T.DoubleType()) for n in BOX.names} if isinstance(x, dict) else None
    if isinstance(kind, T.StringType):
        return x if isinstance(x, str) or x is None else json.dumps(x)
    if isinstance(kind, T.IntegerType):
        return int(x) if number and x == int(x) and abs(x) < 1 << 31 else None
    return float(x) if number else None


class FolderSource(DataSource):
    """``spark.read.format(NAME)`` with options path, kind (json or txt) and filters."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        return EDGES if self.options.get("kind") == "txt" else ELEMENTS

    def reader(self, schema: T.StructType) -> Folder:
        return (FilteredFolder if self.options.get("filters") == "true" else Folder)(self.options["path"], self.options.get("kind", "json"))


def _read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    spark.dataSource.register(FolderSource)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false").lower()
    return spark.read.format(NAME).option("path", path).option("kind", kind).option("filters", pushed).load()


def edge_folder(spark: SparkSession, path: str) -> DataFrame:
    """Rows (page, ord, parent_id, child_id) of the files ``<page>.txt``; filters on ``page`` open only what they ask for, where the session lets them."""
    return _read(spark, path, "txt")


def element_folder(spark: SparkSession, path: str) -> DataFrame:
    """Rows (page, ord, element, error) of the files ``<page>.json``, likewise."""
    return _read(spark, path, "json")
