"""Heading levels from font size and stroke thickness."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EPS = 0.5


def standardised(rows: DataFrame, doc: str, columns: tuple[str, ...] = ("fontsize", "thickness")) -> DataFrame:
    """Adds z_<column>: distance from the document's mean in population standard deviations (1 where those are 0)."""
    over = Window.partitionBy(doc)
    for c in columns:
        spread = F.stddev_pop(c).over(over)
        rows = rows.withColumn(f"z_{c}", (F.col(c) - F.avg(c).over(over)) / F.when(spread == 0, 1.0).otherwise(spread))
    return rows


#: Styles of a document up to which its clusters are grown by a fold in generated code.
FEW = 64


def clustered(headers: DataFrame, doc: str, eps: float = EPS, few: int = FEW) -> DataFrame:
    """Adds ``cluster``: density clusters of a document's headers in scaled size and thickness, -1 for lone ones.

    A point with one neighbour within ``eps`` belongs to a cluster, so clusters are the connected components of the
    neighbour graph over each document's distinct pairs of size and thickness. Where those are ``few`` they are grown by a
    fold: a new pair joins all groups it is near. Where measurements are continuous and pairs many, ``_by_cells`` links cells
    of a grid instead, so no two pairs are compared that lie far apart. A group of one header is none. Clusters are numbered
    from 0 by their first header. Headers without size or thickness (null or NaN) are lone.
    """
    usable = F.col("fontsize").isNotNull() & F.col("thickness").isNotNull() & ~F.isnan("fontsize") & ~F.isnan("thickness")
    style = ("fontsize", "thickness")
    styles = standardised(headers.where(usable), doc).groupBy(doc, *style).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("z_fontsize").alias("x"), F.first("z_thickness").alias("y"))
    points = styles.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("id", "x", "y", "n", *style))).alias("points"))
    none = F.array(F.slice("points", 1, 0))

    def near(group: Column, p: Column) -> Column:
        return F.exists(group, lambda q: F.pow(q["x"] - p["x"], 2) + F.pow(q["y"] - p["y"], 2) <= eps * eps)

    def grow(groups: Column, p: Column) -> Column:
        return F.concat(F.filter(groups, lambda g: ~near(g, p)), F.array(F.array_append(F.flatten(F.filter(groups, lambda g: near(g, p))), p)))

    groups = F.filter(F.aggregate("points", F.slice(none, 1, 0), grow), lambda g: (F.size(g) > 1) | (F.get(g, F.lit(0))["n"] > 1))
    ordered = F.array_sort(F.transform(groups, lambda g: F.array_sort(g)))
    grown = points.where(F.size("points") <= few).select(doc, F.posexplode(ordered).alias("cluster", "members")).select(doc, F.col("cluster").cast("int").alias("cluster"), F.explode("members").alias("m"))
    linked = points.where(F.size("points") > few).select(doc, "points", _by_cells(eps)("points.x", "points.y", "points.n").alias("cluster"))
    linked = linked.select(doc, F.explode(F.arrays_zip("cluster", "points")).alias("e")).select(doc, "e.cluster", F.col("e.points").alias("m")).where("cluster >= 0")
    named = grown.unionByName(linked).select(doc, "cluster", *[F.col(f"m.{c}").alias(c) for c in style])
    return headers.join(named, [doc, *style], "left").select(*headers.columns, F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def _by_cells(eps: float) -> Callable[..., Column]:
    """A function of columns x, y, n: the cluster of each point of a document, in order of its first point; -1 for lone ones."""

    @F.udf("array<int>", useArrow=True)
    def found(xs: Sequence[float], ys: Sequence[float], ns: Sequence[int]) -> list[int]:
        return linked_cells(np.asarray(xs, dtype=float), np.asarray(ys, dtype=float), np.asarray(ns), eps).tolist()

    return found


def linked_cells(x: np.ndarray, y: np.ndarray, n: np.ndarray, eps: float) -> np.ndarray:
    """Clusters of points by cells so small that all points of one are near each other.

    Cells become one cluster where a point of one is near a point of another, at most two cells away; only such pairs of
    cells that do not belong together yet are looked into.
    """
    side = eps / math.sqrt(2) * (1 - 1e-9)
    cells, of = np.unique(np.c_[np.floor(x / side), np.floor(y / side)], axis=0, return_inverse=True)
    of = of.reshape(-1)
    order = np.argsort(of, kind="stable")
    bound = np.searchsorted(of[order], np.arange(len(cells) + 1))
    top = list(range(len(cells)))

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    number = {(a, b): i for i, (a, b) in enumerate(cells.tolist())}
    for dx, dy in [(a, b) for a in range(3) for b in range(-2, 3) if (a, b) > (0, 0)]:
        for (a, b), i in number.items():
            j = number.get((a + dx, b + dy))
            if j is None or root(i) == root(j):
                continue
            one, other = order[bound[i] : bound[i + 1]], order[bound[j] : bound[j + 1]]
            step = max(1, (1 << 20) // len(other))
            if any(((x[p, None] - x[other]) ** 2 + (y[p, None] - y[other]) ** 2 <= eps * eps).any() for p in (one[k : k + step] for k in range(0, len(one), step))):
                top[max(root(i), root(j))] = min(root(i), root(j))
    part = np.array([root(i) for i in range(len(cells))], dtype=np.int64)[of]
    whole = np.bincount(part, weights=n, minlength=len(cells))
    out, names = np.full(len(x), -1, dtype=np.int32), {}
    for i in np.flatnonzero(whole[part] > 1).tolist():
        out[i] = names.setdefault(int(part[i]), len(names))
    return out


def cluster_means(rows: DataFrame, doc: str) -> DataFrame:
    """Rows (doc, cluster, mean_fontsize, mean_thickness, n, first_id) of the clusters proper."""
    return rows.where("cluster <> -1").groupBy(doc, "cluster").agg(F.avg("fontsize").alias("mean_fontsize"), F.avg("thickness").alias("mean_thickness"), F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


def levels(headers: DataFrame, doc: str = "doc_id", eps: float = EPS, noise_level: str = "larger") -> DataFrame:
    """Rows (doc, id, cluster, level): clusters ranked by mean size, then mean thickness, largest first.

    A lone header is level 1 if larger than the document's first header, else it has no level; ``noise_level='one'``
    makes all of them level 1. Ranks are not capped. A document without headers has no rows.
    """
    rows = clustered(headers.select(doc, "id", "fontsize", "thickness"), doc, eps)
    order = Window.partitionBy(doc).orderBy(F.desc("mean_fontsize"), F.desc("mean_thickness"), "first_id")
    ranked = cluster_means(rows, doc).select(doc, "cluster", F.row_number().over(order).alias("rank"))
    first = F.first("fontsize").over(Window.partitionBy(doc).orderBy("id"))
    lone = F.lit(1) if noise_level == "one" else F.when(F.col("fontsize") > F.col("first_size"), 1)
    rows = rows.withColumn("first_size", first).join(ranked, [doc, "cluster"], "left")
    return rows.select(doc, "id", "cluster", F.when(F.col("cluster") == -1, lone).otherwise(F.col("rank")).alias("level"))
