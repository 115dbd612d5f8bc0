"""Overlap of boxes within a page: pairs, and greedy suppression."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..storage import stored

THRESHOLD = 0.95
#: Tags in the order in which they win.
PRIORITY = ("h1", "h2", "h3", "table", "li", "img", "p")


def overlapping_pairs(boxes: DataFrame, page: str, threshold: float = THRESHOLD, compat: bool = False) -> DataFrame:
    """Rows (page, a, b, iou), a < b: pairs of one page's boxes ``bbox`` with ids ``id`` that overlap enough.

    Corners and areas are worked out before the join, and its residue is one product against another. Two boxes of an IoU
    t have heights within a factor of t, and their tops are apart by no more than (1 - t) / t of the lesser height. So the
    equality key is the page, a class of height and a cell of tops of that class's size; one side is dealt to its own cell and
    the next, and to three cells of the next class, so each two boxes meet once. A crowded page is many small groups, not one,
    and pairs that can't overlap enough are not compared. With a threshold of 0 or less all pairs of a page are pairs, and the page alone is the key. Boxes with nulls
    or without an area pair with none above that.
    """
    box = F.col("bbox")
    half = 0 if compat else 0.5
    rows = boxes.select(F.col(page), F.col("id"), *[(box[at] - half * box[size]).alias(low) for low, at, size in (("left", "xc", "w"), ("top", "yc", "h"))], box["w"].alias("w"), box["h"].alias("h"))
    rows = rows.dropna().withColumns({"right": F.col("left") + F.col("w"), "bottom": F.col("top") + F.col("h"), "area": F.col("w") * F.col("h")}).drop("w")
    if threshold > 0:
        t = min(threshold, 0.999)
        step = abs(math.log(t)) * (1 + 1e-9)  # a hair more than the threshold allows, so rounding loses no pair

        def cell(kind: Column) -> Column:
            return F.floor(F.col("top") / (F.exp((kind + 1) * step) * ((1 - t) / t * (1 + 1e-9))))

        rows = rows.where("area > 0 and h > 0").withColumn("class", F.floor(F.log("h") / step))
        around = F.array(*[F.struct((F.col("class") + d).alias("class"), (cell(F.col("class") + d) + e).alias("cell"), F.lit(d == e == 0).alias("own")) for d, e in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
        own = cell(F.col("class"))
    else:
        rows = rows.withColumn("class", F.lit(0).cast("long"))
        own = F.lit(0).cast("long")
        around = F.array(F.struct("class", own.alias("cell"), F.lit(True).alias("own")))
    names = ("id", "left", "top", "right", "bottom", "area")
    a = rows.select(page, *[F.col(c).alias(f"a_{c}") for c in names], F.explode(around).alias("key")).select("*", "key.class", "key.cell", "key.own").drop("key")
    b = rows.select(page, *[F.col(c).alias(f"b_{c}") for c in names], "class", own.alias("cell"))

    def side(low: str, high: str) -> Column:
        return F.least(f"a_{high}", f"b_{high}") - F.greatest(f"a_{low}", f"b_{low}")

    across, down = side("left", "right"), side("top", "bottom")
    both = F.greatest(across, F.lit(0.0)) * F.greatest(down, F.lit(0.0))
    once = F.when(F.col("own"), F.col("a_id") < F.col("b_id")).otherwise(F.col("a_id") != F.col("b_id"))
    pairs = a.join(b, [page, "class", "cell"]).where(once).withColumn("both", both).withColumn("union", F.col("a_area") + F.col("b_area") - F.col("both"))
    found = F.when(F.col("union") > 0, F.col("both") / F.col("union")).otherwise(F.lit(0.0))
    return pairs.where(F.col("both") >= F.lit(threshold) * F.col("union")).select(page, F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"), found.alias("iou")).where(F.col("iou") >= threshold)


def _priority(tag: Column, tags: Sequence[str]) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, tags)), tag), F.lit(0).cast("long")), F.lit(len(tags) + 1).cast("long"))


#: Links of a page that one task settles at a time.
CROWDED = 500_000


def suppress(boxes: DataFrame, page: str, threshold: float = THRESHOLD, tags: Sequence[str] = PRIORITY, compat: bool = False, crowded: int = CROWDED) -> DataFrame:
    """Rows (page, id, rank) of the boxes that survive greedy suppression, in the order in which they were taken.

    Order: tag priority, then larger area, then id. A box goes if one that was taken before it overlaps it enough. Boxes are
    numbered in that order and ``overlapping_pairs`` links them; who goes is settled on the links alone, in one pass over
    those of many pages at a time. A page with over ``crowded`` links is settled in rounds: boxes that no live better one
    overlaps are taken, what they overlap goes, and the links of both; each round is a few joins dealt by box, so a page
    has no task to itself. Rounds are as many as the longest chain of boxes that each overlap a worse one, at most, and
    end when few links are left. Boxes without a place overlap none and stay.
    """
    order = Window.partitionBy(page).orderBy("priority", "area", "id")
    rows = boxes.select(page, "id", "bbox", _priority(F.col("label"), tags).alias("priority"), (-F.col("bbox.w") * F.col("bbox.h")).alias("area"))
    placed = stored(rows.select(page, "id", "bbox", F.row_number().over(order).alias("place")), "placed-boxes")
    links = stored(overlapping_pairs(placed.select(page, F.col("place").alias("id"), "bbox"), page, threshold, compat).select(page, "a", "b"), "box-links")
    lost = _settled(links, page, crowded)
    left = placed.select(page, "id", "place").join(lost, [page, "place"], "left_anti")
    return left.select(page, "id", F.row_number().over(Window.partitionBy(page).orderBy("place")).alias("rank"))


def _settled(links: DataFrame, page: str, crowded: int) -> DataFrame:
    """Rows (page, place) of the boxes that go, from links (page, a, b) of which a is the better box."""
    gone: list[DataFrame] = []
    few = [links]
    while True:
        full = few.pop()
        sizes = stored(full.groupBy(page).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowded).select(page), "crowded-pages")
        if sizes.isEmpty():
            few.append(full)
            break
        # all that a round leaves is written, so no round is worked out again
        few.append(full.join(sizes, page, "left_anti"))
        live = full.join(sizes, page, "left_semi")
        ends = live.select(page, F.explode(F.array(F.struct(F.col("a").alias("place"), F.lit(0).alias("below")), F.struct(F.col("b").alias("place"), F.lit(1).alias("below")))).alias("e"))
        taken = ends.groupBy(page, "e.place").agg(F.max("e.below").alias("below")).where("below = 0").select(page, F.col("place").alias("a"))
        out = stored(live.join(taken, [page, "a"], "left_semi").select(page, F.col("b").alias("place")).distinct(), "suppressed")
        gone.append(out)
        for end in ("b", "a"):
            live = live.join(out.withColumnRenamed("place", end), [page, end], "left_anti")
        few.append(stored(live.select(page, "a", "b"), "box-links"))
    for part in few:
        gone.append(_settled_at_once(part, page))
    return reduce(DataFrame.unionByName, gone)


def _settled_at_once(links: DataFrame, page: str) -> DataFrame:
    """The same for pages with few links, whose links meet in one task."""

    def judged(rows: pa.Table) -> pa.RecordBatch:
        pages = rows.column(page).combine_chunks()
        number = np.asarray(pages.dictionary_encode().indices).astype(np.int64)
        a, b = (np.asarray(rows.column(c)).astype(np.int64) for c in ("a", "b"))
        # a page's boxes come in order, so a box is settled when its turn comes
        nodes, where = np.unique(np.r_[number << 32 | a, number << 32 | b], return_inverse=True)
        better, worse = where[: len(a)], where[len(a) :]
        dead = np.zeros(len(nodes), dtype=bool)
        firsts = np.flatnonzero(np.r_[True, better[1:] != better[:-1]])
        for i, lo, hi in zip(better[firsts].tolist(), firsts.tolist(), np.r_[firsts[1:], len(better)].tolist(), strict=True):
            if not dead[i]:
                dead[worse[lo:hi]] = True
        at = np.flatnonzero(dead)
        _, sample = np.unique(number, return_index=True)
        return pa.RecordBatch.from_arrays([pages.take(pa.array(sample[nodes[at] >> 32])), pa.array((nodes[at] & 0xFFFFFFFF).astype(np.int32))], names=[page, "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            # the last page of a batch may go on in the next
            same = pc.equal(b.column(page), b.column(page)[-1]) if b.num_rows else None
            if same is None:
                continue
            cut = b.num_rows - pc.sum(same).as_py()
            if cut or (held and not held[0].column(page)[-1].equals(b.column(page)[-1])):
                yield judged(pa.Table.from_batches([*held, b.slice(0, cut)], schema=b.schema))
                held = []
            held.append(b.slice(cut))
        if held:
            yield judged(pa.Table.from_batches(held))

    shape = T.StructType([links.schema[page], T.StructField("place", T.IntegerType())])
    return links.repartition(page).sortWithinPartitions(page, "a", "b").mapInArrow(run, shape)
