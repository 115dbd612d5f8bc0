"""Decontamination, substring dedup, near-duplicates, components."""

import os
import random

import numpy as np
import xxhash

from docflow.llm import decontamination, simhash, substring_dedup
from docflow.llm.common import components, removed, scratch, written
from tests.llm.helpers import TEXTS, documents, words


def _least(p, t):
    row = [0] * (len(t) + 1)
    for i, x in enumerate(p):
        row, old = [i + 1], row
        for j, y in enumerate(t):
            row.append(min(old[j + 1] + 1, row[j] + 1, old[j] + (x != y)))
    return min(row)


def test_myers_equals_dynamic_programming():
    rng = random.Random(3)
    for _ in range(300):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(lo, hi))) for lo, hi in ((1, 90), (0, 120)))
        assert decontamination.distance(p, t, 1000)[0] == _least(p, t)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(6)
    vocabulary = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(25))) for i in range(8)] + [(90, None), (91, "too short"), (0, "again " * 20)]
    rows = [*TEXTS]
    for k in range(40):
        noise = " ".join(rng.choice(vocabulary) for _ in range(60))
        item = list(rng.choice(items[:8])[1])
        for _ in range(rng.randint(0, 20)):
            item[rng.randrange(len(item))] = rng.choice("abz ")
        rows.append((100 + k, noise + "!\n" + "".join(item).upper() + " " + noise))
    docs, bench = documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"], r["distance"]) for r in decontamination.matches(docs, bench).collect()), key=repr)
    want = []
    for i, t in rows:
        for j, x in items:
            p = decontamination.normalised(x or "")
            if len(p.split()) >= decontamination.MIN_WORDS and t and len(t) < 10_000:
                d = _least(p, decontamination.normalised(t))
                if d <= int(decontamination.ERROR_RATE * len(p)):
                    want.append((i, j, d))
    assert len(want) > 10
    assert got == sorted(want, key=repr)
    clean = decontamination.clean(docs, bench)
    assert clean.columns == docs.columns
    assert sorted((r["doc_id"] for r in clean.collect()), key=repr) == sorted((i for i, _ in rows if i not in {w[0] for w in want}), key=repr)
    small = decontamination.matches(docs, bench, block=300)
    assert sorted(((r["doc_id"], r["item_id"], r["distance"]) for r in small.collect()), key=repr) == got
    assert decontamination.matches(docs.limit(0), bench).count() == decontamination.matches(docs, bench.limit(0)).count() == 0


def test_decontamination_finds_short_items(spark):
    items = [(1, "Who wrote Faust?"), (2, "art"), (3, "東京の人口は何人ですか"), (4, "?!"), (5, ""), (6, "_ , _")]
    rows = [(1, "He asked: who wrote  FAUST, then left"), (2, "a party of parts"), (3, "the Art."), (4, "問題は東京の人口は何人ですかと聞いた"), (5, "who wrote Fausta"), (6, "?!"), (7, ""), (8, "who wrote a fist"), (9, None), (10, "who wrfte Faust")]
    docs, bench = documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in decontamination.matches(docs, bench).collect())
    # 15 letters allow one edit, the other items none: they stand as whole words
    assert got == [(1, 1, 0), (3, 2, 0), (4, 3, 0), (5, 1, 0), (10, 1, 1)]
    assert {r["doc_id"] for r in decontamination.clean(docs, bench).collect()} == {2, 6, 7, 8, 9}


def _deduplicated(rows, size=20):
    seen = {}
    key = lambda i: -(2**63) if i is None else i
    for i, t in rows:
        w = words(t)
        for s in range(len(w) - size + 1):
            g = tuple(w[s : s + size])
            seen[g] = min(seen.get(g, (2**63, 0)), (key(i), s))
    out = []
    for i, t in rows:
        w = words(t)
        gone = {k for s in range(len(w) - size + 1) if seen[tuple(w[s : s + size])] != (key(i), s) for k in range(s, s + size)}
        out.append((i, len(w), len(gone), [x for k, x in enumerate(w) if k not in gone]))
    return out


def test_substring_dedup_equals_brute_force(spark):
    rng = random.Random(8)
    shared = [" ".join(f"s{k}w{i}" for i in range(rng.randint(18, 45))) for k in range(6)]
    rows = [*TEXTS]
    for k in range(60):
        parts = [" ".join(f"d{k}x{rng.randrange(5000)}" for _ in range(rng.randint(0, 30))) + "\n" + rng.choice(shared) + "\t" for _ in range(rng.randint(1, 4))]
        rows.append((100 + k, "".join(parts)))
    rows += [(200 + k, rng.choice(shared)) for k in range(20)] + [(300, "z " * 70), (301, " ".join("ab"[i % 3 > 0] for i in range(90)))]
    for chunks in (1, 7):
        got = substring_dedup.deduplicate(documents(spark, rows), keep=("rest", "lang"), chunks=chunks).collect()
        assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], words(r["kept"])) for r in got), key=repr) == sorted(_deduplicated(rows), key=repr)
        assert all(tuple(r["rest"]) == (-1, "en") for r in got)
        texts = dict(rows)
        assert all(r["kept"] == texts[r["doc_id"]] for r in got if not r["n_removed"])
    assert substring_dedup.deduplicate(documents(spark, rows).limit(0)).count() == 0


def test_substring_dedup_tells_words_of_one_polynomial_hash_apart(spark):
    # complementary Thue-Morse words have equal polynomial hashes modulo 2^64 for any odd base
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    one, other = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    head = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{head} {one}"), (2, f"{head} {other}"), (3, f"{head} {one}")]
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.deduplicate(documents(spark, rows)).collect()}
    assert got == {1: 0, 2: 0, 3: 20}


def test_substring_dedup_of_rows_that_repeat_a_key(spark):
    shared, own = " ".join(f"s{i}" for i in range(25)), " ".join(f"t{i}" for i in range(30))
    # one key on many rows: places start at zero in each, so equal places lead together and later ones go
    rows = [(5, shared), (5, f"x {shared}"), (5, shared), (None, own), (None, own), (9, f"{own} {shared}")] * 2 + [(5, f"u{k} v{k}") for k in range(30)]
    for chunks in (1, 4):
        got = substring_dedup.deduplicate(documents(spark, rows), chunks=chunks).collect()
        assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], words(r["kept"])) for r in got), key=repr) == sorted(_deduplicated(rows), key=repr)


def _fingerprint(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles], dtype=np.uint64)
    return sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))


def test_fingerprints_and_components(spark):
    rng = random.Random(5)
    rows = [*TEXTS]
    for k in range(12):
        base = [f"n{rng.randrange(400)}" for _ in range(160)]
        for j in range(8):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "edit"
            rows.append((1000 + 10 * k + j, " ".join(w)))
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    fps = {i: _fingerprint(t) for i, t in rows}
    assert all(r["fp"] == simhash.signed(fps[r["doc_id"]]) for r in got)
    keys = sorted(i for i in fps if i is not None)
    top = {i: i for i in fps}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in fps:
        for b in fps:
            if (fps[a] ^ fps[b]).bit_count() <= 4 and find(a) != find(b):
                x, y = sorted((find(a), find(b)), key=lambda i: (i is None, i))
                top[y] = x
    assert {r["doc_id"]: r["component"] for r in got} == {i: find(i) for i in fps}
    assert keys
    assert simhash.near_duplicates(documents(spark, []).limit(0)).count() == 0


def test_masks_cover_all_pairs_within_the_radius():
    rng = random.Random(1)
    masks = simhash.covering_masks()
    assert len(masks) == 31
    for _ in range(3000):
        differ = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not differ & m for m in masks)


def test_split_groups_lose_no_link(spark):
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    fps = sorted({centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 7))) for _ in range(300)})
    df = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long")
    for group in (4096, 30):
        links = simhash.links(df, group=group)
        got = {r["node"]: r["component"] for r in components(links).collect()}
        top = {x: x for x in fps}

        def find(x, top=top):
            while top[x] != x:
                x = top[x]
            return x

        for i, a in enumerate(fps):
            for b in fps[i + 1 :]:
                if (a ^ b).bit_count() <= 4:
                    top[find(a)] = find(b)
        mine = {}
        for x in fps:
            mine.setdefault(find(x), set()).add(simhash.signed(x))
        want = {x: min(s) for s in mine.values() if len(s) > 1 for x in s}
        assert got == want


def test_scratch_tables_go(spark):
    with scratch(spark):
        inner, kept = written(spark.range(3), "inner"), written(spark.range(4), "kept", kept=True)
        paths = [x.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("//", "/") for x in (inner, kept)]
        assert all(map(os.path.isdir, paths))
    assert [os.path.isdir(p) for p in paths] == [False, True]
    assert kept.count() == 4
    removed(spark, kept)
    assert not os.path.isdir(paths[1])


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, k) for k in range(101, 180)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    want = {**dict.fromkeys(range(1, 61), 1), **dict.fromkeys(range(100, 180), 100), 200: 200, 201: 200}
    for block in (0, 200_000):  # by rounds of stars, and in one block
        assert dict(components(spark.createDataFrame(edges, "u long, v long"), block).collect()) == want
        assert components(spark.createDataFrame([], "u long, v long"), block).count() == 0
    # links of one task must not be enough: a path dealt to many partitions
    path = spark.range(300).selectExpr("id AS u", "id + 1 AS v").repartition(16)
    got = components(path, 20)
    assert got.count() == 301 and {r["component"] for r in got.collect()} == {0}
