"""Hard-negative mining by blocked dense products.

Vectors are quantised to whole numbers and packed into blocks, as matrices. A block of anchors is broadcast and multiplied
with every candidate block, in float64, which is exact below 2^53. The first pass keeps each anchor's best rows of its own
label, the second the best rows of other labels in a window of scores below each of those. What tasks keep is merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import fresh_dir, spread
from .common import leaving, trimmed, written

#: Components become floor(SCALE * x).
SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: Scores of negatives lie between these percentages of the positive's score.
LEAST, MOST = 50, 95
#: Vectors of a candidate block, and anchors that are broadcast at a time.
BLOCK, ANCHORS = 4096, 8192
#: Anchors and candidates of which scores are held at a time.
_TILE = (1024, 2048)
_NONE = -(1 << 62)
_PACKED = "base long, width int, label binary, id binary, anchor binary, data binary"


def quantised(vectors: pa.Array, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Matrix of floor(scale * x) as float64, and which rows take part: no null, no null or non-finite component.

    Shorter vectors are filled with zeros, which changes no product. So that every inner product fits into a long, rows with a
    component of 2^k or more after scaling take no part either, k being 28 for 64 components.
    """
    flat = vectors.flatten()
    sizes = np.asarray(vectors.value_lengths().fill_null(0)).astype(np.int64)
    width = int(sizes.max(initial=0))
    row, bound = np.repeat(np.arange(len(vectors)), sizes), np.cumsum(sizes) - sizes
    out = np.zeros((len(vectors), width))
    out[row, np.arange(len(row)) - bound[row]] = np.asarray(flat.cast(pa.float64()).fill_null(np.nan))
    with np.errstate(invalid="ignore", over="ignore"):
        out = np.floor(out * scale)
        fits = (np.abs(out) < 2.0 ** ((62 - max(width - 1, 0).bit_length()) // 2)).all(axis=1)  # false for NaN too
    return out, fits & ~np.asarray(vectors.is_null())


def _even(vectors: pa.Array, block: int) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``block`` rows whose matrix has 2 million components at most, or of one row."""
    lo, width = 0, 0
    for i, n in enumerate(vectors.value_lengths().fill_null(0).to_pylist()):
        if i - lo == block or i > lo and max(width, n) * (i - lo + 1) > 1 << 21:
            yield lo, i
            lo, width = i, 0
        width = max(width, n)
    if lo < len(vectors):
        yield lo, len(vectors)


def packed(rows: DataFrame, block: int = BLOCK, scale: int = SCALE) -> DataFrame:
    """Blocks of vectors (base, width, label, id, anchor, data) from rows (id, label, vector, anchor); ``base`` numbers their rows.

    Within a block, rows are in order of label and id. A row without id or label takes no part. Number a block's rows only
    from a written table, as a place in the input is no more than that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for b in batches:
            for lo, hi in _even(b.column("vector"), block):
                part = b.slice(lo, hi - lo)
                data, fits = quantised(part.column("vector"), scale)
                fits &= ~np.asarray(part.column("id").is_null()) & ~np.asarray(part.column("label").is_null())
                ids, labels = (np.asarray(part.column(c).fill_null(0)) for c in ("id", "label"))
                order = np.lexsort((ids, labels))
                order = order[fits[order]]
                if len(order):
                    chosen = np.asarray(part.column("anchor").fill_null(False)).astype(np.uint8)[order]
                    yield _block(at, labels[order], ids[order], chosen, data[order].astype(np.int64))
                    at += len(order)

    wide = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<double>").alias("vector"), F.col("anchor").cast("boolean").alias("anchor"))
    return wide.mapInArrow(trimmed(run), _PACKED)


def _block(base: int, labels: np.ndarray, ids: np.ndarray, chosen: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
    # four bytes a component, and half that where it is enough
    small = np.int16 if np.abs(data).max(initial=0) < 1 << 15 else np.int32
    values = [labels.astype("<i8"), ids.astype("<i8"), chosen, np.r_[np.array([np.dtype(small).itemsize], np.uint8), np.ascontiguousarray(data.astype(small)).view(np.uint8).ravel()]]
    return pa.RecordBatch.from_arrays([pa.array([base], pa.int64()), pa.array([data.shape[1]], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in values]], names=["base", "width", "label", "id", "anchor", "data"])


def _unpacked(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each block: numbers, labels, ids, whether anchors, and the matrix as long."""
    for base, width, label, i, chosen, data in zip(*(b.column(c).to_pylist() for c in ("base", "width", "label", "id", "anchor", "data")), strict=True):
        labels = np.frombuffer(label, "<i8")
        matrix = np.frombuffer(data, f"<i{data[0]}", offset=1).reshape(len(labels), width)
        yield base + np.arange(len(labels)), labels, np.frombuffer(i, "<i8"), np.frombuffer(chosen, np.uint8) > 0, matrix


class Best:
    """The best ``k`` of each row of questions: scores downwards, then ids upwards. Two may be merged, in any order."""

    def __init__(self, rows: int, k: int) -> None:
        self.k = k
        self.score = np.full((rows, k), _NONE, dtype=np.int64)
        self.id = np.full((rows, k), np.iinfo(np.int64).max, dtype=np.int64)

    def add(self, row: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        last_score, last_id = self.score[row, -1], self.id[row, -1]
        better = (score > last_score) | ((score == last_score) & (ident < last_id))
        row, score, ident = row[better], score[better], ident[better]
        if not len(row):
            return
        touched = np.unique(row)
        rows = np.r_[row, np.repeat(touched, self.k)]
        scores, ids = np.r_[score, self.score[touched].ravel()], np.r_[ident, self.id[touched].ravel()]
        order = np.lexsort((ids, -scores, rows))
        rows, scores, ids = rows[order], scores[order], ids[order]
        nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
        kept = nth < self.k
        self.score[rows[kept], nth[kept]], self.id[rows[kept], nth[kept]] = scores[kept], ids[kept]


def _tiles(anchors: np.ndarray, matrix: np.ndarray, new: bool) -> Iterator[tuple[int, int, np.ndarray]]:
    """Scores tile by tile (first row, first column, scores); the first tiles of a new search are narrow, as all of them is kept."""
    width = max(anchors.shape[1], matrix.shape[1], 1)
    bound = int(np.abs(anchors).max(initial=0)) * int(np.abs(matrix).max(initial=0)) * width
    kind = np.float64 if bound < 1 << 53 else np.int64
    both = min(anchors.shape[1], matrix.shape[1])
    left, right = anchors[:, :both].astype(kind), np.ascontiguousarray(matrix[:, :both].astype(kind).T)
    at, step = 0, 64 if new else _TILE[1]
    while at < right.shape[1]:
        for top in range(0, len(left), _TILE[0]):
            yield top, at, left[top : top + _TILE[0]] @ right[:, at : at + step]
        at, step = at + step, min(2 * step, _TILE[1])


def best_of_own(anchors: tuple[np.ndarray, ...], blocks: Iterator[tuple[np.ndarray, ...]], k: int) -> Best:
    """For each anchor (number, label, id, matrix; in order of label) the best rows of its label, itself left out."""
    numbers, labels, _, matrix = anchors
    best = Best(len(labels), k)
    for rows, others, ids, _, data in blocks:
        for label in np.unique(others):
            lo, hi = np.searchsorted(labels, label), np.searchsorted(labels, label, "right")
            a, z = np.searchsorted(others, label), np.searchsorted(others, label, "right")
            if lo == hi:
                continue
            for top, left, scores in _tiles(matrix[lo:hi], data[a:z], (best.score[lo:hi] == _NONE).any()):
                row, col = np.nonzero(scores >= best.score[lo + top : lo + top + len(scores), -1:])
                own = numbers[lo + top + row] == rows[a + left + col]
                best.add((lo + top + row)[~own], scores[row, col].astype(np.int64)[~own], ids[a + left + col][~own])
    return best


def windows(positive: np.ndarray, least: int = LEAST, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score s with least * p <= 100 * s <= most * p, in whole numbers; empty where p is none."""
    low = positive // 100 * least - (-(positive % 100) * least) // 100
    high = positive // 100 * most + positive % 100 * most // 100
    none = positive == _NONE
    return np.where(none, 1, low), np.where(none, 0, high)


def best_of_others(anchors: tuple[np.ndarray, ...], positive: np.ndarray, blocks: Iterator[tuple[np.ndarray, ...]], k: int, least: int, most: int) -> Best:
    """For each anchor and positive (row anchor * positives + place) the best rows of other labels within the window."""
    _, labels, _, matrix = anchors
    n = positive.shape[1]
    low, high = windows(positive, least, most)
    best = Best(positive.size, k)
    for seen, (_, others, ids, _, data) in enumerate(blocks):
        for top, left, scores in _tiles(matrix, data, not seen):
            part = slice(top, top + len(scores))
            floor = np.maximum(low[part], np.where(low[part] <= high[part], best.score[top * n : (top + len(scores)) * n, -1].reshape(-1, n), np.iinfo(np.int64).max >> 1))
            # one look at the tile for all windows of an anchor; what it finds is few and is judged for each
            row, col = np.nonzero((scores >= floor.min(axis=1, keepdims=True)) & (scores <= high[part].max(axis=1, keepdims=True)))
            other = labels[top + row] != others[left + col]
            row, col = row[other], col[other]
            score, ident = scores[row, col].astype(np.int64), ids[left + col]
            for p in range(n):
                fits = (score >= low[top + row, p]) & (score <= high[top + row, p])
                best.add((top + row[fits]) * n + p, score[fits], ident[fits])
    return best


def _anchor_blocks(blocks: DataFrame, size: int) -> DataFrame:
    """Blocks of about ``size`` anchors, in the form of ``packed`` but with a number for each row in place of ``base``."""
    one = "number long, label long, id long, width int, data binary"

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, labels, ids, chosen, matrix in _unpacked(b):
                at = np.flatnonzero(chosen)
                data = [matrix[i].astype("<i4").tobytes() for i in at.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(rows[at]), pa.array(labels[at]), pa.array(ids[at]), pa.array([matrix.shape[1]] * len(at), pa.int32()), pa.array(data, pa.binary())], names=["number", "label", "id", "width", "data"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, size):
                part = b.slice(lo, size)
                numbers, labels, ids = (np.asarray(part.column(c)) for c in ("number", "label", "id"))
                matrix = np.zeros((part.num_rows, max(part.column("width").to_pylist(), default=0)), "<i4")
                for i, (w, raw) in enumerate(zip(part.column("width").to_pylist(), part.column("data").to_pylist(), strict=True)):
                    matrix[i, :w] = np.frombuffer(raw, "<i4")
                order = np.lexsort((ids, labels))
                yield pa.RecordBatch.from_arrays([pa.array([matrix.shape[1]], pa.int32()), *[pa.array([v[order].tobytes()], pa.binary()) for v in (numbers, labels, ids, matrix)]], names=["width", "number", "label", "id", "data"])

    found = written(blocks.mapInArrow(trimmed(apart), one), "anchors")
    dealt = found.repartition(max(1, -(-found.count() // size)))
    return written(dealt.mapInArrow(trimmed(together), "width int, number binary, label binary, id binary, data binary"), "anchor-blocks")


def mine(rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, scale: int = SCALE, anchors: int = ANCHORS) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from rows (id, label, vector, anchor).

    An anchor's positives are its best rows of equal label but itself; for each, the best rows of other labels whose score s
    fits ``least`` * p <= 100 * s <= ``most`` * p. Equal scores go by smaller id. Every row is a candidate, but for those without
    id, label or a finite vector. Repeated rows are candidates and anchors of their own. Without anchors there are no rows.

    Anchor blocks go one after another: each is two jobs over all candidates, and its broadcasts are let go before the next.
    """
    spark = rows.sparkSession
    blocks = written(packed(spread(rows), scale=scale), "vector-blocks")
    out = fresh_dir(spark, "hard-negatives")
    shape = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], shape).write.parquet(f"{out}/block=-1")
    leaving(spark, out)
    for i, b in enumerate(_anchor_blocks(blocks, anchors).toLocalIterator()):
        numbers, labels, ids = (np.frombuffer(b[c], "<i8") for c in ("number", "label", "id"))
        block = (numbers, labels, ids, np.frombuffer(b["data"], "<i4").reshape(len(labels), b["width"]))
        _mined(spark, blocks, block, positives, negatives, least, most).write.parquet(f"{out}/block={i}")
    return spark.read.schema(shape).parquet(out).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _mined(spark: SparkSession, blocks: DataFrame, block: tuple[np.ndarray, ...], positives: int, negatives: int, least: int, most: int) -> DataFrame:
    sent = spark.sparkContext.broadcast(block)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for b in batches:
            yield from _unpacked(b)

    def given(best: Best, *names: str) -> Iterator[pa.RecordBatch]:
        row, place = np.nonzero(best.score != _NONE)
        yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int64)), pa.array(best.id[row, place]), pa.array(best.score[row, place])], names=list(names))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from given(best_of_own(sent.value, rows_of(batches), positives), "a", "id", "score")

    def ranked(found: DataFrame, k: int) -> DataFrame:
        # the engine cuts each task's rows to the best k of a group before they travel
        place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "id"))
        return found.withColumn("rank", place).where(F.col("rank") <= k)

    first = np.full((len(block[1]), positives), _NONE, dtype=np.int64)
    names = np.zeros_like(first)
    # a block's positives are a few numbers for each of its anchors
    for r in ranked(blocks.mapInArrow(trimmed(own), "a long, id long, score long"), positives).collect():
        first[r["a"], r["rank"] - 1], names[r["a"], r["rank"] - 1] = r["score"], r["id"]
    marks = spark.sparkContext.broadcast(first)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from given(best_of_others(sent.value, marks.value, rows_of(batches), negatives, least, most), "a", "id", "score")

    found = written(ranked(blocks.mapInArrow(trimmed(others), "a long, id long, score long"), negatives), "negatives")
    sent.destroy()
    marks.destroy()
    of = [(int(i), int(block[2][i // positives]), int(names.flat[i]), int(first.flat[i])) for i in np.flatnonzero(first.ravel() != _NONE)]
    known = spark.createDataFrame(of, "a long, anchor_id long, positive_id long, positive_score long")
    return known.join(found, "a").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
