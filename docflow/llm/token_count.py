"""Token counts of documents in flat token files without an index.

A flat file is the token ids of its documents one after another, each document closed by a separator id. It is read in
blocks of fixed size; every block is searched for the separator with one vector comparison. As blocks have a fixed size,
positions are absolute, and a document that spans blocks needs only the last separator and the number of separators before
its block: a prefix scan over one small row a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import filesystem, fresh_dir
from .common import leaving, trimmed, written

#: Tokens in a block, and blocks in a group of the two-level prefix scan.
BLOCK, GROUP = 1 << 19, 1024
END = 50256
_KINDS = {2: "<u2", 4: "<u4", 8: "<u8"}


def ranks(path: str) -> dict[bytes, int]:
    """Byte sequences and their ranks from a vocabulary file of base64 lines."""
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}


_ENCODERS: dict[str, object] = {}


def _encoder(path: str, pattern: str) -> object:
    if path not in _ENCODERS:
        import tiktoken

        _ENCODERS[path] = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})
    return _ENCODERS[path]


def width_of(vocabulary: str, end: int = END) -> int:
    """Bytes that each id of a vocabulary and its separator need in a token file."""
    return 2 if max(end, *ranks(vocabulary).values()) < 1 << 16 else 4


def write_files(docs: DataFrame, vocabulary: str, pattern: str, path: str, key: str = "doc_id", text: str = "text", end: int = END, width: int | None = None) -> DataFrame:
    """Encode documents into flat files of ids of ``width`` bytes (as many as the vocabulary needs), one file a task.

    The files lie in the folder ``path``, which driver and executors share, and hold nothing but ids. Given are rows (file,
    first, keys) that say which documents a file holds from document ``first`` on; they are written before they are used. A
    task that runs again writes a file of its own, so what an attempt that failed has left is named by no row. Null texts are
    documents without tokens. The vocabulary must not have the separator.
    """
    if end in ranks(vocabulary).values():
        raise ValueError(f"id {end} separates documents, but the vocabulary has it")
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    kind = _KINDS[width or width_of(vocabulary, end)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary, pattern).encode_ordinary
        store, root = filesystem(path)
        store.create_dir(root)
        name, first, out = f"{uuid4().hex}.bin", 0, None
        for b in batches:
            keys = b.column("key").to_pylist()
            out = out or store.open_output_stream(f"{root}/{name}")
            for t in b.column("text").to_pylist():
                out.write(np.array([*(encode(t) if t else ()), end], dtype=kind).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first], pa.int64()), pa.array([keys], pa.list_(pa.int64()))], names=["file", "first", "keys"])
            first += len(keys)
        if out is not None:
            out.close()

    return written(rows.mapInArrow(trimmed(run), "file string, first long, keys array<long>"), "token-files")


def read_files(spark: SparkSession, path: str, width: int = 2, block: int = BLOCK) -> DataFrame:
    """Blocks (file, block, tokens) of flat binary token files of any size.

    Spark lists the files; each block is a range of one file that a task reads by seeking, so the blocks of a large file
    are spread over all tasks. The files lie where pyarrow's file systems reach them (local, HDFS, object stores). Files of
    no bytes have no blocks; bytes behind the last whole id are left out.
    """
    step = block * width
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.floor(F.col("length") / width).alias("n")).where("n > 0")
    at = files.select("file", (F.col("n") * width).alias("stop"), F.explode(F.expr(f"sequence(0L, (n - 1) div {block})")).alias("block"))

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, stop, n in zip(*(b.column(c).to_pylist() for c in ("file", "stop", "block")), strict=True):
                store, inner = filesystem(name)
                with store.open_input_file(inner) as f:
                    f.seek(n * step)
                    raw = f.read(min(step, stop - n * step))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([raw], pa.binary())], names=["file", "block", "tokens"])

    return at.repartition("file", "block").mapInArrow(ranges, "file string, block long, tokens binary")


def count(blocks: DataFrame, end: int = END, block: int = BLOCK, width: int = 2, repeated: bool = True) -> DataFrame:
    """Rows (file, nth, n_tokens): the tokens before each separator, without it, for all documents of all files.

    ``blocks`` has rows (file, block, tokens); all blocks of a file but the last hold ``block`` little-endian ids of
    ``width`` bytes. Empty documents count 0; tokens behind the last separator of a file are a last document of their own;
    null and empty blocks hold nothing; a block that is given twice counts once (``repeated``: there may be such; where there
    are none, separators need no shuffle for it). An empty table gives no rows.
    """
    kind = _KINDS[width]
    name = blocks.schema["file"].dataType
    arrow = pa.string() if name.simpleString() == "string" else pa.int64()
    blocks = blocks.select(F.col("file").cast("string" if arrow == pa.string() else "long").alias("file"), F.col("block").cast("long").alias("block"), "tokens")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, sizes = [], []
            for n, raw in zip(b.column("block").to_pylist(), b.column("tokens").to_pylist(), strict=True):
                ids = np.frombuffer(raw or b"", dtype=kind)
                ends.append(np.flatnonzero(ids == end) + n * block)
                sizes.append(len(ids) + n * block)
            values = pa.ListArray.from_arrays(np.cumsum([0, *map(len, ends)]), np.concatenate(ends) if ends else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("block"), values.cast(pa.list_(pa.int64())), pa.array(sizes, pa.int64())], names=["file", "block", "ends", "stop"])

    found = written(blocks.mapInArrow(search, f"file {'string' if arrow == pa.string() else 'long'}, block long, ends array<long>, stop long"), "separators")
    small = found.groupBy("file", "block").agg(F.max(F.size("ends")).cast("long").alias("n"), F.max(F.element_at(F.when(F.size("ends") > 0, F.col("ends")), -1)).alias("last"), F.max("stop").alias("stop"))
    # two-level prefix scan: within groups of blocks, then over the groups of a file
    small = small.withColumn("group", F.floor(F.col("block") / GROUP))
    before = Window.partitionBy("file", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    groups = small.groupBy("file", "group").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    earlier = Window.partitionBy("file").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("file", "group", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_group"), F.max("last").over(earlier).alias("last_group"))
    scanned = small.select("file", "block", "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_in"), F.max("last").over(before).alias("last_in"))
    scanned = scanned.join(groups, ["file", "group"]).select("file", "block", (F.col("n_in") + F.col("n_group")).alias("n0"), F.coalesce("last_in", "last_group", F.lit(-1)).alias("last0"))
    rows = (found.dropDuplicates(["file", "block"]) if repeated else found).join(scanned, ["file", "block"]).select("file", "n0", F.concat(F.array("last0"), "ends").alias("ends"))
    whole = rows.select("file", "n0", F.posexplode(F.zip_with(F.slice("ends", 1, F.size("ends") - 1), F.expr("slice(ends, 2, size(ends) - 1)"), lambda a, b: b - a - 1)).alias("i", "n_tokens")).select("file", (F.col("n0") + F.col("i")).alias("nth"), "n_tokens")
    rest = small.groupBy("file").agg(F.sum("n").alias("nth"), F.max("last").alias("last"), F.max("stop").alias("stop")).where("stop > coalesce(last, -1) + 1")
    return whole.unionByName(rest.select("file", "nth", (F.col("stop") - F.coalesce("last", F.lit(-1)) - 1).alias("n_tokens")))


def document_counts(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_tokens): documents written as flat token files, read back by ranges and counted from the files alone.

    Null and empty texts count 0. Repeated rows each keep a row; a null key stays null; other columns are left out,
    whatever their names; an empty table gives no rows.
    """
    spark, width = docs.sparkSession, width_of(vocabulary)
    path = fresh_dir(spark, "tokens")
    held = write_files(docs, vocabulary, pattern, path, key, text, width=width)
    if held.isEmpty():
        return spark.createDataFrame([], f"`{key}` long, n_tokens long")
    leaving(spark, path)
    counts = count(read_files(spark, path, width), width=width, repeated=False).withColumn("file", F.substring_index("file", "/", -1))
    named = held.select("file", "first", F.posexplode("keys").alias("i", key)).select("file", (F.col("first") + F.col("i")).alias("nth"), key)
    return named.join(counts, ["file", "nth"]).select(key, "n_tokens")
