"""Hard negatives against plain Python over whole numbers."""

import math
import random

import numpy as np
import pyarrow as pa

from docflow.llm import hard_negatives, queries

RNG = random.Random(31)


def _fits(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def _wanted(rows, positives=5, negatives=3, least=50, most=95):
    """rows: (id, label, vector, anchor)."""
    good = [(i, lab, [math.floor(256 * x) for x in v], a, n) for n, (i, lab, v, a) in enumerate(rows) if i is not None and lab is not None and _fits(v)]
    out = []
    for i, lab, v, anchor, n in good:
        if not anchor:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, other) for j, other, w, _, m in good if m != n)  # noqa: B905 - shorter ones end in zeros
        for s, p, _ in [x for x in scored if x[2] == lab][:positives]:
            fits = [(j, -t) for t, j, other in scored if other != lab and least * -s <= 100 * -t <= most * -s]
            out += [(i, p, k + 1, j, -s, t) for k, (j, t) in enumerate(fits[:negatives])]
    return sorted(out)


def _frame(spark, rows):
    return spark.createDataFrame(rows, "id long, label long, vector array<double>, anchor boolean")


def _vector(d=8, spread=1.0):
    return [RNG.uniform(-spread, spread) for _ in range(d)]


def test_mine_equals_brute_force(spark):
    centres = [_vector() for _ in range(4)]
    rows = [(k, RNG.choice([0, 0, 0, 1, 2, 9]), [c + RNG.uniform(-0.7, 0.7) for c in RNG.choice(centres)], k % 10 == 0) for k in range(-20, 400)]
    same = _vector()
    rows += [(1000 + k, k % 3, same, k % 40 == 0) for k in range(90)]  # one vector of many rows: all scores are ties
    rows += [(2000, 1, None, True), (2001, None, _vector(), True), (2002, 1, [1.0, None, 0.5], True), (2003, 1, [math.nan, *_vector(7)], True), (2004, 1, [math.inf, *_vector(7)], True)]
    rows += [(None, 1, _vector(), True), (2005, 77, _vector(), True), (2006, 1, [], True), (2007, 1, _vector(3), True), (2008, 0, _vector(11), True), (2009, 2, _vector(), None)]
    rows += [(5, 0, _vector(), False), (10, 0, rows[30][2], True), rows[30]]  # an id on several rows, and a repeated row
    want = _wanted(rows)
    assert len(want) > 200
    for parts, anchors in ((1, 8192), (5, 16)):
        got = hard_negatives.mine(_frame(spark, rows).repartition(parts), anchors=anchors)
        assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        assert sorted(tuple(r) for r in got.collect()) == want
    other = {"positives": 2, "negatives": 4, "least": 33, "most": 71}
    assert sorted(tuple(r) for r in hard_negatives.mine(_frame(spark, rows), **other).collect()) == _wanted(rows, **other)
    assert hard_negatives.mine(_frame(spark, rows).limit(0)).count() == 0
    assert hard_negatives.mine(_frame(spark, [r[:3] + (False,) for r in rows])).count() == 0


def test_large_components_stay_exact(spark):
    """Products beyond 2^53 are taken in whole numbers; what could leave a long takes no part."""
    rows = [(k, k % 2, [float(RNG.randrange(500_000, 1_000_000)) + RNG.random() for _ in range(8)], k < 6) for k in range(60)]
    assert max(r[4] for r in _wanted(rows)) > 1 << 53
    assert sorted(tuple(r) for r in hard_negatives.mine(_frame(spark, rows)).collect()) == _wanted(rows)
    huge = [*rows, (100, 0, [1e30] * 8, True), (101, 1, [-1e300] * 8, False)]
    assert sorted(tuple(r) for r in hard_negatives.mine(_frame(spark, huge)).collect()) == _wanted(rows)


def test_op12(spark, tmp_path):
    rows = [(k, [RNG.choice([None] if RNG.random() < 0.002 else [RNG.gauss(0, 0.3)]) for _ in range(16)], RNG.choice([None, *range(10), *[3] * 10])) for k in range(700)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = [(k, (lab + 1) % 10 if lab is not None and k % 7 == 0 else lab, None if v is None else [None if x is None else float(np.float32(x)) for x in v], k % 50 == 0) for k, v, lab in rows]
    assert sorted(tuple(r) for r in queries.op12_hard_negatives(spark, str(tmp_path)).collect()) == _wanted(want)


def test_windows_are_whole_numbers():
    for p in [*range(-250, 250), 10**15 + 7]:
        low, high = (int(x) for x in hard_negatives.windows(np.array(p)))
        inside = [s for s in range(p // 2 - 3, p // 2 + 4) if 50 * p <= 100 * s] if p >= 0 else []
        assert not inside or low == min(inside)
        assert high == 95 * p // 100


def test_best_is_mergeable():
    score, ids = np.array([RNG.randrange(6) for _ in range(400)]), np.array([RNG.randrange(50) for _ in range(400)])
    row = np.array([RNG.randrange(3) for _ in range(400)])
    for cuts in ([0, 400], [0, 1, 7, 200, 400]):
        best = hard_negatives.Best(3, 5)
        for a, z in zip(cuts, cuts[1:], strict=False):
            best.add(row[a:z], score[a:z], ids[a:z])
        for r in range(3):
            assert list(zip((-best.score[r]).tolist(), best.id[r].tolist(), strict=True)) == sorted(zip((-score[row == r]).tolist(), ids[row == r].tolist(), strict=True))[:5]


def test_quantised_blocks():
    data, fits = hard_negatives.quantised(pa.array([[0.5, -0.001], None, [], [math.nan], [1.0, 2.0, 3.0], [None, 1.0], [2.0**60]], pa.list_(pa.float64())))
    assert fits.tolist() == [True, False, True, False, True, False, False]
    assert data[0].tolist() == [128, -1, 0] and data[4].tolist() == [256, 512, 768]
