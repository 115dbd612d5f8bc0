"""Boxes as Column arithmetic: everything stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The viewport of page captures, of table captures, and the padding of a content box.
VIEWPORT, TABLE_VIEWPORT, PADDING = (1000, 3000), (1000, 7500), 35


def centred(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Corners to centre and size."""
    return F.struct(((x1 + x2) / 2).alias("xc"), ((y1 + y2) / 2).alias("yc"), (x2 - x1).alias("w"), (y2 - y1).alias("h"))


def left(box: Column) -> Column:
    return box["xc"] - box["w"] / 2


def top(box: Column) -> Column:
    return box["yc"] - box["h"] / 2


def flipped(y: Column, page_height: Column) -> Column:
    """A height above the bottom of the page, as a depth below its top."""
    return page_height - y


def content_rectangle(x: Column, y: Column, w: Column, h: Column, viewport: tuple[int, int] = VIEWPORT) -> Column:
    """Corners of a content box: cut at the viewport, then padded to the right and below."""
    right, bottom = F.least(F.lit(viewport[0]), x + w) + PADDING, F.least(F.lit(viewport[1]), y + h) + PADDING
    return F.struct(x.alias("x1"), y.alias("y1"), right.alias("x2"), bottom.alias("y2"))


def inside(x1: Column, y1: Column, x2: Column, y2: Column, rectangle: Column) -> Column:
    """All four edges lie within the rectangle, touching allowed."""
    return (x1 >= rectangle["x1"]) & (x2 <= rectangle["x2"]) & (y1 >= rectangle["y1"]) & (y2 <= rectangle["y2"])


def crop_size(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """Pixels of a crop: its corners rounded half to even."""
    return F.bround(x2) - F.bround(x1), F.bround(y2) - F.bround(y1)


def overlap(a: Column, b: Column, compat: bool = False) -> tuple[Column, Column]:
    """Intersection and union areas of two centre boxes.

    ``compat`` reads xc and yc as a top left corner, which is wrong for boxes of unequal sizes.
    """

    def span(box: Column, at: str, size: str) -> tuple[Column, Column]:
        low = box[at] if compat else box[at] - box[size] / 2
        return low, low + box[size]

    sides = []
    for at, size in (("xc", "w"), ("yc", "h")):
        (a0, a1), (b0, b1) = span(a, at, size), span(b, at, size)
        sides.append(F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0.0)))
    both = sides[0] * sides[1]
    return both, a["w"] * a["h"] + b["w"] * b["h"] - both


def iou(a: Column, b: Column, compat: bool = False) -> Column:
    """Intersection over union, 0 where the union is empty."""
    both, union = overlap(a, b, compat)
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def overlaps(a: Column, b: Column, threshold: float, compat: bool = False) -> Column:
    """IoU of at least ``threshold``, without a division."""
    both, union = overlap(a, b, compat)
    return F.when(union > 0, both >= threshold * union).otherwise(F.lit(threshold <= 0))


def fitted(width: Column, height: Column, longest: int = 640) -> Column:
    """Size with the longest side brought to ``longest``, the ratio kept, fractions cut off; a side of 0 stays 0."""
    # a side of 0 bounds nothing: the other one alone counts, as an infinite quotient would have it
    factor = F.coalesce(F.least(F.try_divide(F.lit(longest), width), F.try_divide(F.lit(longest), height)), F.lit(0.0))
    return F.struct((width * factor).cast("int").alias("width"), (height * factor).cast("int").alias("height"))
