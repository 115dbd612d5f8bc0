"""Shared pieces: table reading, byte-level word scanning in numpy, connected components, written intermediates."""

from __future__ import annotations

import contextlib
import ctypes
import inspect
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import fresh_dir

#: The word separators of every word-based operator, and the word pattern they leave.
SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"

_IS_SEP = np.zeros(256, dtype=bool)
_IS_SEP[list(SEPARATORS)] = True


def trimmed(run: Callable) -> Callable:
    """A batch or group function that gives freed memory back: workers live on, and the next stage may need it."""

    def done(out: object) -> object:
        if isinstance(out, Iterator):
            return _drained(out)
        _trim()
        return out

    # the engine counts a group function's arguments
    if len([x for x in inspect.signature(run).parameters.values() if x.default is x.empty]) == 2:
        return lambda left, right: done(run(left, right))
    return lambda rows: done(run(rows))


def _drained(out: Iterator) -> Iterator:
    try:
        yield from out
    finally:
        _trim()


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of tables that ``scratch`` blocks, from the outermost in, will delete.
_SCRATCH: list[list[str]] = []


def written(df: DataFrame, what: str, kept: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage is cut and a lost executor loses nothing.

    Within a ``scratch`` block the table goes when the block ends, unless it is ``kept``. Outside of one it stays as long as the
    session's engine, as a lazy result may read it, and goes when that ends.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, what)
    if _SCRATCH and not kept:
        _SCRATCH[-1].append(path)
    df.write.parquet(path)
    leaving(spark, path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written in this block are deleted when it ends, but for those written as ``kept``."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            _delete(spark, path)


def removed(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` that no later plan reads."""
    for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
        _delete(spark, root)


def leaving(spark: SparkSession, path: str) -> None:
    """Have a folder that exists deleted when the driver's engine ends, if it is still there then."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def buckets(spark: SparkSession, per_partition: int = 2) -> int:
    """Number of hash buckets: follows the session's shuffle partitions, which follow the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))) * per_partition


def text_slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold at most ``most`` bytes together (one longer text stands alone)."""
    sizes = np.diff(string_buffers(texts)[1])
    first, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and total + n > most:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


def string_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and the offsets of its rows; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def separators(raw: np.ndarray) -> np.ndarray:
    """Which bytes are word separators."""
    return _IS_SEP[raw]


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words of all rows, and the first word of each row (length rows + 1)."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~_IS_SEP[raw]
    begins = np.empty(n, dtype=bool)
    begins[0] = True
    np.logical_not(word[:-1], out=begins[1:])
    edge = offsets[:-1]
    begins[edge[edge < n]] = True
    begins &= word
    stops = np.empty(n, dtype=bool)
    stops[-1] = True
    np.logical_not(word[1:], out=stops[:-1])
    edge = offsets[1:]
    stops[edge[edge > 0] - 1] = True
    stops &= word
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def local_forest(edges: Iterable[tuple[np.ndarray, np.ndarray]]) -> dict[int, int]:
    """Union-find over a stream of edge arrays: node to the smallest node of its part."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for us, vs in edges:
        for u, v in zip(us.tolist(), vs.tolist(), strict=True):
            a, b = top(u), top(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return {x: top(x) for x in parent}


#: Links that one task joins by union-find at a time.
BLOCK = 200_000


def components(edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """Connected components of ``edges(u, v)``: rows (node, component), the component being its smallest node.

    Alternates two star steps until nothing changes: every node hands its smallest neighbour to its larger
    neighbours, then to all its smaller ones. The links live in written tables, never on the driver; each step is a
    partial-aggregated minimum, written, and one join of two plain tables, which Spark can split at a hub. Before each round every task joins what
    it holds by union-find, which is why few rounds are needed, and none once all links that are left fit into one block.
    Null ends are dropped; an empty input gives no rows.
    """
    spark = edges.sparkSession
    now = written(_contracted(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v")), "links")
    seen = None
    while True:
        if now.count() <= block:
            whole = written(_contracted(now.coalesce(1)), "links")
            removed(spark, now)
            now = whole
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m")), "low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = written(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v"), "down")
        least = written(down.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = down.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v")
        after = written(_contracted(small).distinct(), "links")
        mark = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for old in (now, low, down, least):
            removed(spark, old)
        now = after
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def _contracted(edges: DataFrame) -> DataFrame:
    """Within blocks of links of one task, each part becomes a star around its smallest node."""

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush() -> Iterator[pa.RecordBatch]:
            part = local_forest((np.asarray(b.column(0)), np.asarray(b.column(1))) for b in held)
            pairs = [(x, r) for x, r in part.items() if x != r]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["u", "v"])

        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= BLOCK:
                yield from flush()
                held, rows = [], 0
        yield from flush()

    return edges.dropna().mapInArrow(stars, "u long, v long")
