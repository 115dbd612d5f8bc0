"""Archives of any size: members are deflated where their rows lie, and an archive is a file, never a value.

What a member takes in its archive is known once it is deflated, so its offset is a running sum over small rows. Members then
meet in the order of their offsets in one task an archive, which writes each as it comes and holds none; their directory
follows as rows of its own. Reading goes the other way: directories become rows, and members are read from their offsets by
whichever task gets them.
"""

from __future__ import annotations

import struct
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import filesystem, stored

#: Fixed values of the archive format: marks of records, version, flags (names in UTF-8), deflate, the first day there is.
_LOCAL, _ENTRY, _END, _END64, _AT64 = b"PK\3\4", b"PK\1\2", b"PK\5\6", b"PK\6\6", b"PK\6\7"
_VERSION, _FLAGS, _DEFLATE, _DAY = 45, 0x800, 8, 0x21
_MAX16, _MAX32 = 0xFFFF, 0xFFFFFFFF
_HEAD = 30
#: Contents in one batch of rows, in bytes (one may be larger), and archives that a task has open at once.
_BATCH, _OPEN = 1 << 22, 32


def write_archives(assets: DataFrame, path: str) -> DataFrame:
    """Write one archive a task, ``<task>.zip`` in a folder that driver and executors share; rows (task_id, file, members, bytes).

    Files of one path and content are one member; of one path and other contents, the second and later ones are named
    ``name-2.ext`` and so on, in order of digest. Null contents are no files. Members lie in order of their names, and a
    run gives the same bytes as the one before. A task's archive appears when it is whole. Offsets, sizes and numbers
    of members beyond 32 and 16 bits are written as the format has them.
    """
    rows = assets.where("content is not null").select(F.coalesce(F.col("task_id").cast("string"), F.lit("null")).alias("task_id"), F.col("path").cast("string").alias("path"), F.sha2("content", 256).alias("digest"), "content")
    packed = stored(rows.mapInArrow(_deflated, "task_id string, path string, digest string, crc long, size long, packed binary"), "deflated")
    small = packed.select("task_id", "path", "digest", "crc", "size", F.octet_length("packed").cast("long").alias("length")).distinct()
    nth = F.row_number().over(Window.partitionBy("task_id", "path").orderBy("digest"))
    name = F.when(F.col("nth") == 1, F.col("path")).otherwise(F.concat(F.regexp_extract("path", r"(?s)^(.*?)(\.[^./]*)?$", 1), F.lit("-"), "nth", F.regexp_extract("path", r"(?s)^(.*?)(\.[^./]*)?$", 2)))
    small = small.withColumn("nth", nth).withColumn("name", name)
    before = Window.partitionBy("task_id").orderBy("name", "digest").rowsBetween(Window.unboundedPreceding, -1)
    placed = stored(small.withColumn("at", F.coalesce(F.sum(F.col("length") + _HEAD + F.octet_length("name")).over(before), F.lit(0))), "placed-members")
    members = placed.join(packed.select("task_id", "path", "digest", "packed"), ["task_id", "path", "digest"]).select("task_id", F.lit(0).alias("kind"), "at", "name", "crc", "size", "length", "packed")
    directory = placed.select("task_id", F.lit(1).alias("kind"), "at", "name", "crc", "size", "length", F.lit(None).cast("binary").alias("packed"))
    dealt = members.unionByName(directory).repartition("task_id").sortWithinPartitions("task_id", "kind", "at", "name")
    return stored(dealt.mapInArrow(_writer(path), "task_id string, file string, members long, bytes long"), "archives")


def _deflated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["task_id", "path", "digest", "crc", "size", "packed"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    rows, held = [], 0
    for b in batches:
        for i in range(b.num_rows):
            content = b.column("content")[i].as_py()
            squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
            body = squeeze.compress(content) + squeeze.flush()
            rows.append((*[b.column(c)[i].as_py() for c in names[:3]], zlib.crc32(content), len(content), body))
            held += 200 + len(body)
            if held > _BATCH:
                yield made(rows)
                rows, held = [], 0
    if rows:
        yield made(rows)


class _Archive:
    """A file that grows by members, then by their directory."""

    def __init__(self, folder: str, task: str) -> None:
        self.task, self.at, self.begun, self.count = task, 0, None, 0
        self.fs, root = filesystem(folder)
        self.fs.create_dir(root)
        self.file, self.aside = f"{root}/{quote(task, safe='')}.zip", f"{root}/.{uuid4().hex}"
        self.out = self.fs.open_output_stream(self.aside)

    def write(self, raw: bytes) -> None:
        self.out.write(raw)
        self.at += len(raw)

    def member(self, name: bytes, crc: int, size: int, packed: bytes, at: int) -> None:
        if at == self.at:  # else it is the copy of a file that is there already
            self.write(struct.pack("<4s5H3L2H", _LOCAL, _VERSION, _FLAGS, _DEFLATE, 0, _DAY, crc, len(packed), size, len(name), 0) + name + packed)

    def entry(self, name: bytes, crc: int, size: int, length: int, at: int) -> None:
        if self.begun is None:
            self.begun = self.at
        more = struct.pack("<2HQ", 1, 8, at) if at >= _MAX32 else b""
        self.write(struct.pack("<4s6H3L5H2L", _ENTRY, _VERSION, _VERSION, _FLAGS, _DEFLATE, 0, _DAY, crc, length, size, len(name), len(more), 0, 0, 0, 0, min(at, _MAX32)) + name + more)
        self.count += 1

    def close(self) -> tuple[str, str, int, int]:
        begun, size = self.at if self.begun is None else self.begun, 0 if self.begun is None else self.at - self.begun
        if self.count >= _MAX16 or begun >= _MAX32 or size >= _MAX32:
            where = self.at
            self.write(struct.pack("<4sQ2H2L4Q", _END64, 44, _VERSION, _VERSION, 0, 0, self.count, self.count, size, begun))
            self.write(struct.pack("<4sLQL", _AT64, 0, where, 1))
        self.write(struct.pack("<4s4H2LH", _END, 0, 0, min(self.count, _MAX16), min(self.count, _MAX16), min(size, _MAX32), min(begun, _MAX32), 0))
        self.out.close()
        self.fs.move(self.aside, self.file)
        return self.task, self.file, self.count, self.at


def _writer(folder: str):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Archive | None = None

        def ended(a: _Archive) -> pa.RecordBatch:
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(a.close(), kinds, strict=True)], names=["task_id", "file", "members", "bytes"])

        for b in batches:
            for i in range(b.num_rows):
                task, kind, at, name, crc, size, length = (b.column(c)[i].as_py() for c in ("task_id", "kind", "at", "name", "crc", "size", "length"))
                if now is None or now.task != task:
                    if now is not None:
                        yield ended(now)
                    now = _Archive(folder, task)
                if kind:
                    now.entry(name.encode(), crc, size, length, at)
                else:
                    now.member(name.encode(), crc, size, b.column("packed")[i].as_py(), at)
        if now is not None:
            yield ended(now)

    return run


_MEMBER = "task_id string, file string, path string, at long, length long, size long, crc long, method int, error string"


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """Rows (task_id, file, path, at, length, size, crc, method, error): the members of the archives in a folder.

    Only their directories are read. A file that is no archive is one row with ``error``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _MEMBER.split(", ")]
        kinds = [pa.string(), pa.string(), pa.string(), *[pa.int64()] * 4, pa.int32(), pa.string()]
        for b in batches:
            for file in b.column("path").to_pylist():
                task = unquote(file.rsplit("/", 1)[-1].removesuffix(".zip"))
                where, root = filesystem(file)
                rows = []
                try:
                    with where.open_input_file(root) as raw, zipfile.ZipFile(raw) as z:
                        rows = [(task, file, m.filename, m.header_offset, m.compress_size, m.file_size, m.CRC, m.compress_type, None) for m in z.infolist()]
                except (zipfile.BadZipFile, OSError, ValueError) as e:  # also a seek before the start of a short file
                    rows = [(task, file, *[None] * 6, f"{type(e).__name__}: {e}")]
                for lo in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[lo : lo + 10_000], strict=True), kinds, strict=True)], names=names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path").mapInArrow(run, _MEMBER)


def contents(members: DataFrame) -> DataFrame:
    """Rows (task_id, path, content, error) of such members, each read from its place; what does not check is an error.

    A task holds a few open files and the contents of a few megabytes of members.
    """
    names = ["task_id", "path", "content", "error"]
    kinds = [pa.string(), pa.string(), pa.binary(), pa.string()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        with _Opened() as files:
            for b in batches:
                for r in b.to_pylist():
                    content, error = None, r["error"]
                    if error is None:
                        try:
                            content = _content(files[r["file"]], r)
                        except (ValueError, OSError, zlib.error, struct.error) as e:
                            error = f"{type(e).__name__}: {e}"
                    rows.append((r["task_id"], r["path"], content, error))
                    size += 200 + len(content or b"")
                    if size > _BATCH:
                        yield made(rows)
                        rows, size = [], 0
        if rows:
            yield made(rows)

    return members.mapInArrow(run, "task_id string, path string, content binary, error string")


class _Opened(dict):
    """Files by path, of which so many stay open at once."""

    def __missing__(self, path: str) -> pa.NativeFile:
        if len(self) >= _OPEN:
            self.pop(next(iter(self))).close()
        where, root = filesystem(path)
        return self.setdefault(path, where.open_input_file(root))

    def __enter__(self) -> _Opened:
        return self

    def __exit__(self, *error: object) -> None:
        for f in self.values():
            f.close()


def _content(raw: pa.NativeFile, r: dict) -> bytes:
    raw.seek(r["at"])
    head = struct.unpack("<4s5H3L2H", raw.read(_HEAD))
    raw.seek(r["at"] + _HEAD + head[-2] + head[-1])
    body = raw.read(r["length"])
    if r["method"] not in (0, _DEFLATE):
        raise ValueError(f"method {r['method']}")
    content = zlib.decompress(body, -15) if r["method"] == _DEFLATE else body
    if zlib.crc32(content) != r["crc"]:
        raise ValueError("checksum")
    return content
