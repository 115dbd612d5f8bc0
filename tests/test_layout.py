"""Boxes, trees and heading levels against golden values and plain models."""

import random
import time

import numpy as np
import pytest

from docflow.functions import geometry as G
from docflow.operators import headers, hierarchy, overlap
from docflow.sources.html import TAGS
from pyspark.sql import functions as F


def test_corners_to_centre(spark):
    row = spark.range(1).select(G.centred(*map(F.lit, (10.0, 20.0, 30.0, 60.0))).alias("b")).first()["b"]
    assert tuple(row) == (20.0, 40.0, 20.0, 40.0)


def test_fitted_cuts_fractions(spark):
    assert tuple(spark.range(1).select(G.fitted(F.lit(1000), F.lit(333), 800).alias("s")).first()["s"]) == (800, 266)


def test_fitted_takes_sides_of_nothing(spark):
    sizes = spark.createDataFrame([(0, 1000), (1000, 0), (0, 0), (None, 1000), (500, 250)], "w long, h long")
    assert [tuple(r["s"]) for r in sizes.select(G.fitted(F.col("w"), F.col("h")).alias("s")).collect()] == [(0, 640), (640, 0), (0, 0), (None, 640), (640, 320)]


@pytest.mark.parametrize(
    ("sizes", "expected"),
    [
        ([(20, 4)], [None]),
        ([(20, 4), (20, 4)], [1, 1]),
        ([(20, 4), (14, 2)], [None, None]),
        ([(14, 2), (20, 4)], [None, 1]),
        ([(20, 4), (20, 4), (14, 2), (14, 2), (30, 5), (10, 1)], [1, 1, 2, 2, 1, None]),
        ([(12, 2), (12, 2), (12, 3), (12, 3)], [2, 2, 1, 1]),
        ([(None, 4), (20, float("nan")), (20, 4), (20, 4)], [None, None, 1, 1]),
    ],
)
def test_heading_levels(spark, sizes, expected):
    rows = spark.createDataFrame([("d", i, None if f is None else float(f), float(t)) for i, (f, t) in enumerate(sizes)], "doc_id string, id int, fontsize double, thickness double")
    assert [r["level"] for r in headers.levels(rows).orderBy("id").collect()] == expected


def test_lone_headings_may_all_be_first_level(spark):
    rows = spark.createDataFrame([("d", 1, 20.0, 4.0), ("d", 2, 14.0, 2.0)], "doc_id string, id int, fontsize double, thickness double")
    assert [r["level"] for r in headers.levels(rows, noise_level="one").orderBy("id").collect()] == [1, 1]


def _iou(a, b):
    x = max(0, min(a[0] + a[2] / 2, b[0] + b[2] / 2) - max(a[0] - a[2] / 2, b[0] - b[2] / 2))
    y = max(0, min(a[1] + a[3] / 2, b[1] + b[3] / 2) - max(a[1] - a[3] / 2, b[1] - b[3] / 2))
    union = a[2] * a[3] + b[2] * b[3] - x * y
    return x * y / union if union > 0 else 0


@pytest.mark.parametrize("threshold", [0.0, 0.05, 0.3, 0.5, 0.95, 1.0])
@pytest.mark.parametrize("compat", [False, True])
def test_overlapping_pairs_equal_brute_force(spark, threshold, compat):
    rng = random.Random(8)
    rows = [(p, i, tuple(rng.choice([rng.randint(0, 12), rng.uniform(0, 12)]) for _ in range(4))) for p in range(5) for i in range(40)]
    rows += [(9, i, (5.0, 5.0, 4.0, 4.0)) for i in range(3)] + [(9, 7, None), (None, 8, (5.0, 5.0, 4.0, 4.0)), (9, 8, (5.0, 5.0, 0.0, 4.0))]
    boxes = spark.createDataFrame([(p, i, None if b is None else tuple(map(float, b))) for p, i, b in rows], "page int, id int, bbox struct<xc:double,yc:double,w:double,h:double>")
    moved = (lambda b: (b[0] + b[2] / 2, b[1] + b[3] / 2, b[2], b[3])) if compat else lambda b: b
    want = {(p, i, j): _iou(moved(a), moved(b)) for p, i, a in rows for q, j, b in rows if p == q and p is not None and a and b and i < j}
    got = {(r["page"], r["a"], r["b"]): r["iou"] for r in overlap.overlapping_pairs(boxes, "page", threshold, compat).collect()}
    assert got.keys() == {k for k, v in want.items() if v >= threshold} or all(abs(want[k] - threshold) < 1e-9 for k in got.keys() ^ {k for k, v in want.items() if v >= threshold})
    assert all(abs(want[k] - v) < 1e-9 for k, v in got.items())
    assert overlap.overlapping_pairs(boxes.limit(0), "page", threshold, compat).count() == 0


def test_suppression_equals_a_pop_loop(spark):
    rng = random.Random(5)
    rows = [(p, i, rng.choice(TAGS), (float(rng.randint(0, 9)), float(rng.randint(0, 9)), float(rng.randint(0, 12)), float(rng.randint(1, 12)))) for p in range(12) for i in range(20)]
    boxes = spark.createDataFrame(rows, "page int, id int, label string, bbox struct<xc:double,yc:double,w:double,h:double>")
    # by pages at once, by rounds to the end, and by rounds until few links of a page are left
    gots = [{(r["page"], r["id"]): r["rank"] for r in overlap.suppress(boxes, "page", 0.4, crowded=n).collect()} for n in (overlap.CROWDED, 0, 15)]
    want = {}
    for p in range(12):
        left = sorted((r for r in rows if r[0] == p), key=lambda r: (TAGS.index(r[2]), -r[3][2] * r[3][3], r[1]))
        n = 0
        while left:
            best, *left = left
            n += 1
            want[p, best[1]] = n
            left = [r for r in left if _iou(best[3], r[3]) < 0.4]
    assert gots == [want] * 3


def test_tree_equals_a_walk(spark):
    rng = random.Random(9)
    rows = [(p, i, 100 + i, rng.choice(TAGS), float(rng.randint(0, 60))) for p in range(8) for i in range(1, 31)]
    tree = hierarchy.tree(spark.createDataFrame(rows, "page int, ord int, id int, tag string, left double"), "page").cache()
    want = {}
    for p in range(8):
        seen, done, stack, last = [], [], [], None
        for _, o, _, tag, left in (r for r in rows if r[0] == p):
            level = parent = None
            if tag[0] == "h":
                while stack and stack[-1][1] >= int(tag[1]):
                    stack.pop()
                parent = stack[-1][0] if stack else None
                stack.append((o, int(tag[1])))
                last = o
            elif tag == "p":
                parent = stack[-1][0] if stack else None
                last = o
            elif tag in ("img", "table"):
                parent = last
            else:
                close = [i for i, v in enumerate(seen) if abs(v - left) <= 8]
                if not close:
                    seen = sorted([*seen, left])
                level = (close[0] if close else seen.index(left)) + 1
                parent = next((q for q, t, lv in reversed(done) if t in ("h1", "h2", "h3", "p") or (t == "li" and lv < level)), None)
            done.append((o, tag, level))
            want[p, o] = (level, parent)
    assert {(r["page"], r["ord"]): (r["level"], r["parent_ord"]) for r in tree.collect()} == want

    def walk(p, o):
        out = []
        for k in sorted(q for (page, q), (_, par) in want.items() if page == p and par == o):
            out += ([f"#{100 + o}->#{100 + k}"] if o else []) + walk(p, k)
        return out

    roots = {p: [o for (page, o), (_, par) in sorted(want.items()) if page == p and par is None] for p in range(8)}
    text = {r["page"]: r["edges"] for r in hierarchy.edge_text(hierarchy.edges(hierarchy.preorder(tree, "page"), "page"), "page").collect()}
    for p in range(8):
        assert text[p].splitlines() == [line for o in roots[p] for line in walk(p, o)]


def test_list_levels_golden(spark):
    rows = spark.createDataFrame([(1, i, "li", float(x)) for i, x in enumerate((10, 18, 30, 19, 2), 1)], "page int, ord int, tag string, left double")
    assert [r["level"] for r in hierarchy.list_levels(rows, "page").orderBy("ord").collect()] == [1, 1, 2, 2, 1]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page int, id int, label string, bbox struct<xc:double,yc:double,w:double,h:double>")
    assert overlap.suppress(none, "page").count() == 0
    assert headers.levels(spark.createDataFrame([], "doc_id string, id int, fontsize double, thickness double")).count() == 0


def test_suppression_of_a_crowded_page(spark):
    rng = random.Random(6)
    rows = []
    for i in range(0, 12_000, 3):
        x, y = rng.uniform(0, 1000), rng.uniform(0, 60_000)
        # a box, its copy under another tag, and one that is moved too far
        rows += [(1, i, "p", (x, y, 40.0, 20.0)), (1, i + 1, "h1", (x, y, 40.0, 20.0)), (1, i + 2, "li", (x + 5, y, 40.0, 20.0))]
    boxes = spark.createDataFrame(rows, "page int, id int, label string, bbox struct<xc:double,yc:double,w:double,h:double>")
    begun = time.perf_counter()
    got = {r["id"] for r in overlap.suppress(boxes, "page").collect()}
    assert time.perf_counter() - begun < 30
    assert not any(i % 3 == 0 for i in got) and sum(i % 3 == 1 for i in got) == 4_000
    assert overlap.suppress(boxes.limit(0), "page").count() == 0


def test_preorder_of_deep_and_wide_pages(spark):
    # a chain, a fan, and parents that come later or are missing
    n = 8_000
    rows = [("chain", i, i - 1 if i > 1 else None) for i in range(1, n + 1)] + [("fan", i, 1 if i > 1 else None) for i in range(1, n + 1)] + [("odd", 1, 2), ("odd", 2, 9), ("odd", 3, 1), ("odd", 4, None), ("odd", 5, 2)]
    tree = spark.createDataFrame([(p, o, up, 10 * o) for p, o, up in rows], "page string, ord int, parent_ord int, id int")
    begun = time.perf_counter()
    got = {(r["page"], r["ord"]): (r["nth"], r["depth"]) for r in hierarchy.preorder(tree, "page").collect()}
    assert time.perf_counter() - begun < 20
    assert all(got["chain", i] == (i, i - 1) and got["fan", i] == (i, int(i > 1)) for i in range(1, n + 1))
    assert {k[1]: v for k, v in got.items() if k[0] == "odd"} == {1: (1, 0), 3: (2, 1), 2: (3, 0), 5: (4, 1), 4: (5, 0)}
    assert hierarchy.preorder(tree.limit(0), "page").count() == 0


def test_ranked_tours_equal_walks(spark):
    rng = random.Random(14)
    rows = [(p, o, rng.choice([None, rng.randint(1, o), max(1, o - 1), 1, o + 2]), f"x{o}") for p in ("a", "b", None) for o in range(1, 60)]
    rows += [("chain", o, o - 1, f"x{o}") for o in range(1, 200)] + [("one", 7, None, "x")]
    tree = spark.createDataFrame([(*r, rng.random()) for r in rows], "page string, ord int, parent_ord int, id string, more double")
    columns = [*tree.columns, "nth", "depth", "parent_id"]
    gots = []
    for crowded in (hierarchy.CROWDED, 0, 59):  # all walked, all ranked, the chain ranked
        found = hierarchy.preorder(tree, "page", crowded)
        assert found.columns == columns
        gots.append(sorted(map(tuple, found.collect()), key=repr))
    assert gots[0] == gots[1] == gots[2] and len(gots[0]) == len(rows)
    at = {(r[0], r[1]): r for r in gots[0]}
    for page, o, up, *_, nth, depth, parent in gots[0]:
        above = at.get((page, up)) if up is not None and up < o else None
        assert parent == (above[3] if above else None) and depth == (above[6] + 1 if above else 0) and (not above or above[5] < nth)
    for page in ("a", "b", None, "chain"):
        assert sorted(r[5] for r in gots[0] if r[0] == page) == list(range(1, 1 + sum(r[0] == page for r in rows)))


def test_lists_over_many_pieces_equal_a_walk(spark):
    rng = random.Random(21)
    rows = [(p, o, o, rng.choice(["li"] * 12 + ["p", "h2", "img"] * (p != 3)), rng.choice([None] + [float(x) for x in range(0, 70, 3)])) for p in (1, 2, 3, None) for o in range(1, 400)]
    df = spark.createDataFrame(rows, "page int, ord int, id int, tag string, left double")
    want, hung = {}, {}
    for p in (1, 2, 3, None):
        seen, done = [], []
        for _, o, _, tag, left in (r for r in rows if r[0] == p):
            level = None
            if tag == "li" and left is not None:
                close = [i for i, v in enumerate(seen) if abs(v - left) <= 8]
                if not close:
                    seen = sorted([*seen, left])
                level = (close[0] if close else seen.index(left)) + 1
            if tag == "li":
                want[p, o] = level
                hung[p, o] = next((q for q, t, lv in reversed(done) if level is not None and (t in ("p", "h2") or (t == "li" and lv is not None and lv < level))), None)
            done.append((o, tag, level))
    levels = hierarchy.list_levels(df, "page")
    assert {(r["page"], r["ord"]): r["level"] for r in levels.collect()} == want
    named = df.join(levels.withColumnRenamed("page", "q").withColumnRenamed("ord", "o"), F.col("page").eqNullSafe(F.col("q")) & (F.col("ord") == F.col("o")), "left").drop("q", "o")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for size in ("7", "10000"):  # pages over many batches, and many pages in one
        spark.conf.set(key, size)
        try:
            found = hierarchy.list_parents(named, "page").collect()
            both = hierarchy.tree(df, "page").where("tag = 'li'").collect()
        finally:
            spark.conf.unset(key)
        assert {(r["page"], r["ord"]): r["parent_ord"] for r in found} == hung and len(found) == len(hung)
        assert {(r["page"], r["ord"]): (r["level"], r["parent_ord"]) for r in both if r["page"] is not None} == {k: (want[k], hung[k]) for k in want if k[0] is not None}


def test_clusters_by_cells_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    for size, spread in ((1, 1), (2, 0.1), (60, 6.0), (300, 9.0), (300, 30.0)):
        x, y, n = rng.random(size) * spread, rng.random(size) * spread, rng.integers(1, 3, size)
        part = list(range(size))
        for i in range(size):
            for j in range(i):
                if (x[i] - x[j]) ** 2 + (y[i] - y[j]) ** 2 <= 0.25 and part[i] != part[j]:
                    old, new = max(part[i], part[j]), min(part[i], part[j])
                    part = [new if p == old else p for p in part]
        names, want = {}, []
        for i in range(size):
            big = sum(int(n[j]) for j in range(size) if part[j] == part[i]) > 1
            want.append(names.setdefault(part[i], len(names)) if big else -1)
        assert headers.linked_cells(x, y, n, 0.5).tolist() == want
    rows = [("a" if i % 3 else "b", i, float(rng.integers(8, 30)) + float(rng.random() > 0.7) * 0.25, float(rng.integers(1, 9))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id string, id int, fontsize double, thickness double")
    assert sorted(map(tuple, headers.clustered(df, "doc_id", 0.2, few=0).collect())) == sorted(map(tuple, headers.clustered(df, "doc_id", 0.2, few=1000).collect()))


def test_many_styles_of_one_document():
    rng = np.random.default_rng(5)
    begun = time.perf_counter()
    x = np.r_[rng.normal(size=50_000), rng.normal(size=50_000) * 200]
    got = headers.linked_cells(x, rng.permutation(x), np.ones(len(x), dtype=int), 0.5)
    assert time.perf_counter() - begun < 30 and got.max() > 100 and (got == -1).any()
