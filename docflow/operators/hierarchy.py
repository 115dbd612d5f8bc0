"""Trees over the elements of a page: parents, list levels, preorder."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

HEADINGS = ("h1", "h2", "h3")
#: Lefts of list items within so many pixels are one indent.
TOLERANCE = 8.0


def ordered(boxes: DataFrame, page: str) -> DataFrame:
    """Adds ``left``, ``top`` and ``ord``, the place on the page from the top (ties: ``rank`` of the suppression, id)."""
    from ..functions.geometry import left, top

    rows = boxes.withColumn("left", left(F.col("bbox"))).withColumn("top", top(F.col("bbox")))
    ties = ["rank"] if "rank" in boxes.columns else []
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy(page).orderBy("top", *ties, "id")))


def parents(rows: DataFrame, page: str) -> DataFrame:
    """Adds ``parent_ord``: the nearest earlier element that an element belongs to, by ``ord`` and ``tag``.

    A heading belongs to the nearest heading of a smaller level, a paragraph to the nearest heading, a picture or table
    to the nearest paragraph or heading; list items are left to ``list_parents``. One window sort per page serves all.
    """
    before = Window.partitionBy(page).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)

    def last(*tags: str) -> Column:
        return F.last(F.when(F.col("tag").isin(*tags), F.col("ord")), ignorenulls=True).over(before)

    parent = F.when(F.col("tag") == "h2", last("h1")).when(F.col("tag") == "h3", last("h1", "h2")).when(F.col("tag") == "p", last(*HEADINGS)).when(F.col("tag").isin("img", "table"), last("p", *HEADINGS))
    return rows.withColumn("parent_ord", parent)


def list_levels(rows: DataFrame, page: str, tolerance: float = TOLERANCE) -> DataFrame:
    """Rows (page, ord, level) of the list items: the place of their left among the indents seen so far.

    An indent that was seen within ``tolerance`` is used again, the leftmost first; others are inserted in order. Earlier
    items keep the level they had. Items without a left have no level.
    """
    return _scanned(rows.where("tag = 'li'"), page, "left", tolerance).select(page, "ord", "level")


def list_parents(rows: DataFrame, page: str) -> DataFrame:
    """Rows (page, ord, parent_ord) of the list items, from ``tag`` and ``level``.

    The parent is the nearest earlier element that is a heading or paragraph, or a list item of a smaller level; headings and
    paragraphs count as level 0. An item without a level hangs on nothing, and nothing on it.
    """
    return _scanned(rows, page, "level", 0).select(page, "ord", "parent_ord")


def _scanned(rows: DataFrame, page: str, column: str, tolerance: float) -> DataFrame:
    """Rows (page, ord, level, parent_ord) of the list items, from ``tag`` and their ``left`` or ``level``.

    Pages are read from top to bottom where their rows lie, and what is found goes on at once. Held are a page's indents, which
    are no more than it is wide in tolerances, and a stack of rising levels, on which a later item may hang; an element
    costs a search among the one and is once on the other, so a page costs as much as it has elements.
    """
    kept = rows.where(F.col("tag").isin("li", "p", *HEADINGS)).select(page, F.col("ord").cast("int").alias("ord"), F.when(F.col("tag") == "li", F.col(column).cast("double")).alias("place"), (F.col("tag") == "li").alias("item"))
    shape = T.StructType([kept.schema[page], *[T.StructField(n, T.IntegerType()) for n in ("ord", "level", "parent_ord")]])

    def level_of(left: float, seen: list[float]) -> int:
        i = max(bisect_left(seen, left - tolerance) - 1, 0)
        while i < len(seen) and seen[i] < left and abs(left - seen[i]) > tolerance:
            i += 1
        if i == len(seen) or abs(left - seen[i]) > tolerance:
            i = bisect_left(seen, left)
            seen.insert(i, left)
        return i + 1

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[int, int]] = []
        seen: list[float] = []
        last = None
        for b in batches:
            keys = b.column(page)
            numbers = keys.dictionary_encode(null_encoding="encode").indices.to_pylist()
            at, out, before = [], [], None
            for i, (k, o, place, item) in enumerate(zip(numbers, *(b.column(c).to_pylist() for c in ("ord", "place", "item")), strict=True)):
                if k != before:  # another page, unless the batch before ended in it
                    if before is not None or last is None or not last.equals(keys[i]):
                        stack, seen = [], []
                    before, last = k, keys[i]
                level = 0
                if item:
                    level = None if place is None else level_of(place, seen) if column == "left" else int(place)
                    at.append(i)
                if level is None:
                    out.append((o, None, None))
                    continue
                while stack and stack[-1][0] >= level:
                    stack.pop()
                if item:
                    out.append((o, level, stack[-1][1] if stack else None))
                stack.append((level, o))
            if out:
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), *(pa.array(c, pa.int32()) for c in zip(*out, strict=True))], names=shape.names)

    return kept.repartition(page).sortWithinPartitions(page, "ord").mapInArrow(scanned, shape)


def tree(rows: DataFrame, page: str) -> DataFrame:
    """All rows with ``level`` (list items) and ``parent_ord``, from page, ord, id, tag and left."""
    hung = _scanned(rows, page, "left", TOLERANCE).withColumnRenamed("parent_ord", "list_parent")
    return parents(rows, page).join(hung, [page, "ord"], "left").withColumn("parent_ord", F.coalesce("list_parent", "parent_ord")).drop("list_parent")


def children(rows: DataFrame, page: str) -> DataFrame:
    """Rows (page, parent_ord, children): the ids of each parent's children in order."""
    kids = F.sort_array(F.collect_list(F.struct("ord", "id")))
    return rows.where("parent_ord is not null").groupBy(page, "parent_ord").agg(F.transform(kids, lambda k: k["id"]).alias("children"))


#: Rows of a page that one task walks.
CROWDED = 500_000


def preorder(rows: DataFrame, page: str, crowded: int = CROWDED) -> DataFrame:
    """Adds ``nth`` (place in the preorder walk of the page's tree, from 1), ``depth`` and ``parent_id``, from ``ord``, ``parent_ord`` and ``id``.

    ``ord`` numbers a page's rows. A parent that is not among them or does not come before its child makes the child a root, so
    there are no cycles. Pages are walked one after another where their rows lie, in time that grows with their number alone,
    however deep the tree; the walk of a page of over ``crowded`` rows is ranked by ``_toured`` instead, over all tasks.
    """
    from ..storage import stored

    rows = stored(rows, "tree")
    large = stored(rows.groupBy(page).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowded).select(F.col(page).alias("large")), "large-pages")
    if large.isEmpty():
        return _walked(rows, page)
    same = F.col(page).eqNullSafe(F.col("large"))
    return _walked(rows.join(large, same, "left_anti"), page).unionByName(_toured(rows.join(large, same, "left_semi"), page))


def _walked(rows: DataFrame, page: str) -> DataFrame:
    """The walk of pages that each fit into a task."""
    added = [T.StructField("nth", T.IntegerType()), T.StructField("depth", T.IntegerType()), T.StructField("parent_id", rows.schema["id"].dataType)]

    def walked(table: pa.Table) -> Iterator[pa.RecordBatch]:
        at, up = table.column("ord").to_pylist(), table.column("parent_ord").to_pylist()
        pages = np.asarray(table.column(page).combine_chunks().dictionary_encode(null_encoding="encode").indices)
        above, nth, depth = np.full(len(at), -1), [0] * len(at), [0] * len(at)
        row_of: dict[int, int] = {}
        firsts = np.flatnonzero(np.r_[True, pages[1:] != pages[:-1]]).tolist()
        for lo, hi in zip(firsts, [*firsts[1:], len(at)], strict=True):
            row_of.clear()
            for i in range(lo, hi):
                above[i] = row_of.get(up[i], -1)
                row_of.setdefault(at[i], i)
            size = [1] * (hi - lo)
            for i in range(hi - 1, lo - 1, -1):
                if above[i] >= 0:
                    size[above[i] - lo] += size[i - lo]
            # parents come before their children, which take the places after them one by one
            free, root = [0] * (hi - lo), 1
            for i in range(lo, hi):
                if above[i] < 0:
                    nth[i], root = root, root + size[i - lo]
                else:
                    nth[i], depth[i] = free[above[i] - lo], depth[above[i]] + 1
                    free[above[i] - lo] += size[i - lo]
                free[i - lo] = nth[i] + 1
        parent = table.column("id").combine_chunks().take(pa.array(above, mask=above < 0))
        for name, values in (("nth", pa.array(nth, pa.int32())), ("depth", pa.array(depth, pa.int32())), ("parent_id", parent)):
            table = table.append_column(name, values)
        yield from table.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            pages = b.column(page).dictionary_encode(null_encoding="encode").indices
            cut = b.num_rows - pc.sum(pc.equal(pages, pages[-1])).as_py()
            if cut or (held and not held[0].column(page)[-1].equals(b.column(page)[-1])):
                yield from walked(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held = []
            held.append(b.slice(cut))
        if held:
            yield from walked(pa.Table.from_batches(held))

    return rows.repartition(page).sortWithinPartitions(page, "ord").mapInArrow(run, T.StructType([*rows.schema, *added]))


def _toured(rows: DataFrame, page: str) -> DataFrame:
    """The walk of large pages, by list ranking of their Euler tours.

    The tour enters and leaves each element once; what follows each step is known from its first child, next sibling and parent.
    Every step knows the entries and the rise from itself to before the one it points to, and each round it takes over those
    of that one and points where it points, so the tour is ranked in as many joins as its length has bits. Steps are dealt
    by themselves, not by page.
    """
    from ..storage import gone, stored

    above = rows.select(F.col(page).alias("_page"), F.col("ord").alias("_ord"), F.col("id").alias("parent_id"))
    hung = rows.join(above, F.col(page).eqNullSafe(F.col("_page")) & (F.col("parent_ord") == F.col("_ord")) & (F.col("_ord") < F.col("ord")), "left").drop("_page")
    hung = stored(hung.withColumn("after", F.lead("ord").over(Window.partitionBy(page, "_ord").orderBy("ord"))), "hung")
    ord_, up = F.col("ord").cast("long"), F.col("_ord").cast("long")
    first = hung.where("_ord is not null").groupBy(F.col(page).alias("_page"), F.col("_ord").alias("_parent")).agg(F.min("ord").alias("first"))
    steps = hung.join(first, F.col(page).eqNullSafe(F.col("_page")) & (F.col("ord") == F.col("_parent")), "left")
    enter = F.struct((2 * ord_).alias("step"), F.coalesce(2 * F.col("first").cast("long"), 2 * ord_ + 1).alias("to"), F.lit(1).alias("entries"), F.lit(1).alias("rise"))
    leave = F.struct((2 * ord_ + 1).alias("step"), F.coalesce(2 * F.col("after").cast("long"), 2 * up + 1).alias("to"), F.lit(0).alias("entries"), F.lit(-1).alias("rise"))
    tour = stored(steps.select(F.col(page).alias("p"), F.explode(F.array(enter, leave)).alias("s")).select("p", "s.*"), "tour")
    while not tour.where("to is not null").isEmpty():
        ahead = tour.select(F.col("p").alias("q"), F.col("step").alias("at"), F.col("to").alias("next"), F.col("entries").alias("e"), F.col("rise").alias("r"))
        joined = tour.join(ahead, F.col("p").eqNullSafe(F.col("q")) & (F.col("to") == F.col("at")), "left")
        further = stored(joined.select("p", "step", F.col("next").alias("to"), (F.col("entries") + F.coalesce("e", F.lit(0))).alias("entries"), (F.col("rise") + F.coalesce("r", F.lit(0))).alias("rise")), "tour")
        gone(tour)
        tour = further
    # what is known now is the rest of the tour from each step on
    sizes = hung.groupBy(F.col(page).alias("_page")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    ranked = tour.where("step % 2 = 0").select("p", (F.col("step") / 2).cast("long").alias("at"), "entries", "rise")
    found = hung.join(ranked, F.col(page).eqNullSafe(F.col("p")) & (ord_ == F.col("at"))).join(F.broadcast(sizes), F.col(page).eqNullSafe(F.col("_page")))
    return found.select(*rows.columns, (F.col("n") - F.col("entries") + 1).alias("nth"), (-F.col("rise")).alias("depth"), "parent_id")


def edges(rows: DataFrame, page: str) -> DataFrame:
    """Rows (page, ord, parent_id, child_id): the tree's edges in preorder, numbered from 1; from ``nth`` and ``parent_id``."""
    found = rows.where("parent_id is not null")
    return found.select(page, F.row_number().over(Window.partitionBy(page).orderBy("nth")).alias("ord"), "parent_id", F.col("id").alias("child_id"))


def edge_text(found: DataFrame, page: str) -> DataFrame:
    """Rows (page, edges): one line ``#parent->#child`` for each edge."""
    line = F.concat(F.lit("#"), F.col("parent_id"), F.lit("->#"), F.col("child_id"), F.lit("\n"))
    return found.withColumn("line", line).groupBy(page).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "line"))), lambda e: e["line"]), "").alias("edges"))
