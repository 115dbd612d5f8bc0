"""URL filters, quality rules, toxicity, languages."""

import math
import random
import re
from collections import Counter
from fnmatch import translate

import numpy as np
import pyarrow as pa
import pytest

from docflow.llm import langid, quality, toxicity
from docflow.llm.common import string_buffers
from docflow.llm.url_filter import Automaton, filter_urls
from pyspark.sql import functions as F
from tests.llm.helpers import TEXTS, documents, words


def test_automaton_equals_globs():
    rng = random.Random(2)
    globs = ["".join(rng.choice("ab*?") for _ in range(rng.randint(0, 25))) for _ in range(40)]
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 30))) for _ in range(300)] + [""]
    got = Automaton.of([g.encode() for g in globs]).scan(*string_buffers(pa.array(texts)))
    want = [[re.match(translate(g), t) is not None for g in globs] for t in texts]
    assert got.tolist() == want


def test_a_question_mark_is_one_character():
    globs = ["?", "a?b", "??", "*é?", "?*?x"]
    texts = ["é", "aéb", "a漢b", "ab", "漢🙂", "🙂", "xé🙂", "é🙂🙂", "漢x", "a🙂x", "🙂ééx"]
    got = Automaton.of([g.encode() for g in globs]).scan(*string_buffers(pa.array(texts)))
    assert got.tolist() == [[re.fullmatch(translate(g), t) is not None for g in globs] for t in texts]


def test_globs_see_the_canonical_address(spark):
    urls = [("http://a.org/%6Cogin", "block"), ("http://a.org/%6cogin?x", "block"), ("http://a.org/%2Flogin", "allow"), ("http://user@cheap-pills.org:80/", "block"), ("http://x.org/%%341", "allow"), ("http://x.org./a.exe", "block"), ("http://x.org:8080", "allow"), ("http://é.org/%C3%A9%", "allow")]
    got = filter_urls(spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)], "page_id long, url string")).orderBy("page_id").collect()
    assert [r["verdict"] for r in got] == [v for _, v in urls]
    # the columns and the host rules keep to the address as it is
    assert (got[0]["path"], got[3]["host"]) == ("/%6Cogin", "user@cheap-pills.org:80")


def test_url_rules(spark):
    urls = [
        (1, "https://a.com/x?y#z", "a.com", "/x", "com/", "allow"),
        (2, "http://EXAMPLE.com/en/1", "example.com", "/en/1", "example.com/en/", "block"),
        (3, "http://www.example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        (4, "http://notexample.net/es/", "notexample.net", "/es/", "net/es/", "block"),
        (5, "http://a.org/x.com/", "a.org", "/x.com/", None, "allow"),
        (6, "http://cheap-pills.org/", "cheap-pills.org", "/", None, "block"),
        (7, None, "", "", None, "allow"),
        (8, "no scheme", "", "", None, "allow"),
        (9, "x://", "", "", None, "allow"),
        (10, "http://a.com", "a.com", "", None, "allow"),
        (11, "u://a.com/r?u=http://b.net/es/", "a.com", "/r", "com/", "allow"),
        (12, "http://a.org/" + "p" * 50_000 + "/login", "a.org", "/" + "p" * 50_000 + "/login", None, "block"),
        (None, "http://x.net/fr/", "x.net", "/fr/", "net/fr/", "block"),
    ]
    df = spark.createDataFrame([(*u[:2], 5, "h") for u in [*urls, urls[0]]], "page_id long, url string, key int, host string")
    got = [tuple(r)[:5] for r in filter_urls(df).collect()]
    assert sorted(got, key=repr) == sorted(((u[0], *u[2:]) for u in [*urls, urls[0]]), key=repr)
    assert filter_urls(df.limit(0)).count() == 0


def _base(text):
    w = words(text)
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def fitted(scores):
    """The threshold that follows from the scores of trusted documents."""
    low, half = np.percentile(sorted(scores), [1, 50])
    return low - 2.5 * (half - low)


def test_quality_rules(spark):
    rows = [*TEXTS, (20, "one two three four five six seven eight # " * 3 + "nine $$"), (21, " ".join("ab" for _ in range(25))), (22, " ".join(f"u{i}" for i in range(19)))]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(1, 1), (8, 1), (10, 0), (None, 1), (1, 1)], "doc_id long, quality int")
    ratios = quality.log_ratios(docs, labels)
    least = quality.threshold(docs, labels, ratios)
    got = quality.judge(docs, ratios, threshold=least, keep=tuple(docs.columns)).collect()
    assert abs(least - fitted(r["score"] for r in got if r["doc_id"] in (1, 8) and not r["base_failed"])) < 1e-12
    assert sorted(tuple(r)[:7] for r in got if r["doc_id"]) == sorted((i, *_base(t)) for i, t in rows if i)
    assert all(r["rest"]["text"] == dict(rows)[r["doc_id"]] and r["rest"]["score"] == -1 for r in got)
    # the score is the mean log ratio of the hashed words and pairs, under counts over all documents
    hashed = spark.createDataFrame([(i, words(t)) for i, t in enumerate(t for _, t in rows)], "n int, w array<string>")
    grams = {r["n"]: [h & (quality.BUCKETS - 1) for h in r["h"]] for r in quality._grams(hashed.withColumnRenamed("w", "words")).selectExpr("n", "concat(h1, slice(h2, 1, greatest(size(h2) - 1, 0))) AS h").collect()}
    good, whole = Counter(), Counter()
    for n, (i, _) in enumerate(rows):
        whole.update(grams[n])
        if i in (1, 8):
            good.update(grams[n])
    a, b = quality.BUCKETS + sum(good.values()), quality.BUCKETS + sum(whole.values())
    for r in got:
        n = next(k for k, (i, _) in enumerate(rows) if i == r["doc_id"])
        want = sum(math.log((good[g] + 1) / a) - math.log((whole[g] + 1) / b) for g in grams[n]) / max(len(grams[n]), 1)
        assert abs(r["score"] - want) < 1e-5
        assert r["kept"] == (not r["base_failed"] and r["score"] >= least)
    # without a trusted document that passes the base rules every score will do
    assert quality.threshold(docs, labels.where("quality = 0"), ratios) == quality.threshold(docs.limit(0), labels, ratios) == -math.inf
    assert all(r["kept"] != r["base_failed"] for r in quality.judge(docs, ratios).collect())
    assert quality.judge(docs.limit(0), quality.log_ratios(docs.limit(0), labels.limit(0))).count() == 0


def test_quality_trusts_all_that_are_labelled_good(spark, monkeypatch):
    n = 20_800
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.concat(F.lit("w"), F.xxhash64("id", i) % 300)), " ").alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(None, "x " * 25), (7, None)], "doc_id long, text string"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 200 == 1, 0).otherwise(1).alias("quality"))
    # the trusted multinomial has every word and pair of the good documents, so it can be told from its sums
    ratios = quality.log_ratios(docs, labels)
    good, whole = (n - n // 200) * 41 + quality.BUCKETS, n * 41 + 49 + quality.BUCKETS
    h = spark.range(1).select(F.xxhash64(F.lit("x")).alias("h")).first()["h"] & (quality.BUCKETS - 1)
    counts = Counter(quality._grams(docs.select("doc_id", quality._words("text").alias("words"))).selectExpr("doc_id", f"size(filter(concat(h1, slice(h2, 1, greatest(size(h2) - 1, 0))), h -> h & {quality.BUCKETS - 1} = {h})) AS c").rdd.flatMap(lambda r: [bool(r["doc_id"] is not None and r["doc_id"] % 200 != 1)] * r["c"]).collect())
    assert abs(ratios[h] / 1e6 - math.log((counts[True] + 1) / good) + math.log((counts[True] + counts[False] + 1) / whole)) < 1e-5
    judged = quality.judge(docs, ratios)
    want = fitted(r["score"] for r in judged.where("not base_failed and doc_id % 200 <> 1").collect())
    assert abs(quality.fitted(judged, labels) - want) < 1e-12 and abs(quality.threshold(docs, labels, ratios) - want) < 1e-12
    # ranks are exact through any number of bins, with equal scores too
    monkeypatch.setattr(quality, "_BINS", 3)
    monkeypatch.setattr(quality, "_HELD", 2)
    few = spark.createDataFrame([(x,) for x in [0.1, 0.1, 0.1, 0.2, 0.25, 0.25, 3.0, -7.5, 0.2500001]], "score double")
    assert quality._quantiles(few, (0.0, 0.3, 0.5, 0.99)) == pytest.approx(np.percentile([r["score"] for r in few.collect()], [0, 30, 50, 99]), abs=1e-12)


def _edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, old = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(old[j + 1] + 1, row[j] + 1, old[j] + (x != y)))
    return row[-1]


def test_lexicon_equals_edit_distance():
    rng = random.Random(4)
    terms = {"".join(rng.choice("abcd") for _ in range(rng.randint(3, 11))): (1.0, 1.0) for _ in range(30)}
    lexicon = toxicity.Lexicon(terms)
    for _ in range(800):
        word = list(rng.choice(sorted(terms)))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(word) + 1)
            word[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b"])
        word = "".join(word)
        want = min((d for t in terms if (d := _edit(word, t)) <= toxicity.edits(t)), default=None)
        found = lexicon.nearest(word)
        assert (None if found is None else found[1]) == want
        if want is not None:
            assert lexicon.possible([word])[0]


def test_every_term_of_a_large_lexicon_is_found_misspelled():
    rng = random.Random(9)
    terms = {"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)): (1.0, 1.0) for _ in range(300)}
    lexicon = toxicity.Lexicon(terms)
    assert lexicon.look_up({t[:4] + t[5:] for t in terms}) == {t[:4] + t[5:]: (t, 1) for t in terms}
    # the candidates leave out no term: short, long and very long ones against the walk of the whole trie
    mixed = toxicity.Lexicon({"".join(rng.choice("abcde") for _ in range(n)): (1.0, 1.0) for n in [*range(3, 15), 39, 40, 41, 90] * 20})
    for t in mixed.terms:
        word = list(t)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(word) + 1)
            word[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b"])
        word = "".join(word)
        want = (word, 0) if word in mixed.terms else mixed.nearest(word)
        assert mixed.look_up({word}) == ({word: want} if want else {})


def test_toxicity(spark):
    rng = random.Random(1)
    plain = ["river", "stone", "walks", "green", "under", "house", "seven", "light"]

    def text(bad):
        w = [rng.choice(plain) for _ in range(40)]
        for _ in range(3 * bad):
            w[rng.randrange(40)] = rng.choice(["blockhead", "nincompoop"])
        if rng.random() < (0.9 if bad else 0.06):
            w[30:34] = ["tu", "es", "blockhead", "imbécile"] if bad else ["quoth", "he", '"blockhead"', "dryly"]
        return " ".join(w)

    rows = [(i, text(i % 4 == 0)) for i in range(400)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert {"blockhead", "nincompoop"} <= set(model.lexicon.terms) and not {"quoth", "river"} & set(model.lexicon.terms)
    # what tells quotation from abuse was in no list: it stood around hits
    assert model.context["quoth"] < -1 and model.context["dryly"] < -1
    tests = [(1, "tu es a blockhead"), (2, "es nincompop bl0ckhed !"), (3, 'river stone quoth he "blockhead" dryly'), (4, "green river under stone"), (5, None), (6, ""), (None, "x")]
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in toxicity.score(documents(spark, tests), model).collect()}
    assert got[1][1] == got[2][1] == 1
    assert got[4][1] == got[5][1] == got[6][1] == got[None][1] == 0
    assert got[3][0] < got[1][0]
    assert toxicity.score(docs.limit(0), model).count() == 0
    silent = toxicity.fit(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score(docs, silent).collect()} == {0.5}


def test_toxicity_equals_plain_python(spark):
    """Lexicon, features and score of a fitted model worked out again word by word, with edit distances to all terms."""
    rng = random.Random(12)
    plain = ["river", "stone", "said", "you", "green", "under", "house", "seven", "light", '"quiet', 'word"', "your!"]
    bad = ["".join(rng.choice("abcdefghij") for _ in range(rng.choice([4, 6, 9, 12]))) for _ in range(120)]

    def text(toxic):
        w = [rng.choice(plain) for _ in range(rng.randint(60, 120))]
        for _ in range(rng.randint(20, 34) * toxic):
            x = list(rng.choice(bad))
            if rng.random() < 0.2:
                x[rng.randrange(len(x))] = rng.choice("zyx0")
            w[rng.randrange(len(w))] = "".join(x) + rng.choice(["", "!", ",", '"'])
        if not toxic and rng.random() < 0.6:
            at = rng.randrange(len(w))
            w[at : at + 3] = ["quoth", rng.choice(bad), rng.choice(["Raven,", "raven"])]
        return " ".join(w)

    rows = [(i, text(i % 3 == 0)) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(500)], "doc_id long, toxic int")
    model = toxicity.fit(documents(spark, rows), labels)
    terms = model.lexicon.terms
    assert len(terms) > 80
    n1 = sum(i % 3 == 0 for i in range(500))
    n0, base = 500 - n1, (n1 + 0.5) / 501
    seen = {w: [0, 0] for i, t in rows[:500] for w in map(toxicity.folded, words(t))}
    for i, t in rows[:500]:
        for w in {toxicity.folded(x) for x in words(t)}:
            seen[w][i % 3 == 0] += 1
    want = {}
    for w, (c, x) in seen.items():
        if len(w) > 2 and x:
            odds = math.log((x + 0.25) / (n1 + 0.5)) - math.log((c + 0.25) / (n0 + 0.5))
            if odds >= toxicity.LOG_ODDS and x * math.log(x / ((x + c) * base)) + c * math.log(max(c, 1) / ((x + c) * (1 - base))) >= toxicity.EVIDENCE:
                want[w] = odds
    assert set(terms) == set(want) and all(abs(terms[w][0] - want[w]) < 1e-9 for w in want)

    def hit(word):
        w = toxicity.folded(word)
        if w in terms:
            return terms[w][0], 0
        near = []
        for t in terms:
            if abs(len(t) - len(w)) <= toxicity.edits(t) and (k := _edit(w, t)) <= toxicity.edits(t):
                near.append((k, -terms[t][1] * (0.8 if k == 2 else 1.0), t))
        return (-min(near)[1], min(near)[0]) if near and w else None

    known = {w: hit(w) for w in {w for _, t in rows for w in words(t)}}

    def near_of(ws, i):
        return [w for w in [*ws[max(0, i - 8) : i], *ws[i + 1 : i + 9]] if known[w] is None]

    met = Counter(), Counter()
    for i, t in rows[:500]:
        ws = words(t)
        at = [k for k, w in enumerate(ws) if known[w]]
        if at:
            met[i % 3 == 0].update({toxicity.folded(w) for k in at for w in near_of(ws, k)} - {""} | {None})
    h0, h1 = met[0][None], met[1][None]
    share, context = (h1 + 0.5) / (h1 + h0 + 1), {}
    for w in (met[0].keys() | met[1].keys()) - {None}:
        c, x = met[0][w], met[1][w]
        if x * math.log(max(x, 1) / ((x + c) * share)) + c * math.log(max(c, 1) / ((x + c) * (1 - share))) >= toxicity.EVIDENCE:
            context[w] = math.log((x + 0.5) / (h1 + 1)) - math.log((c + 0.5) / (h0 + 1))
    assert set(model.context) == set(context) and all(abs(model.context[w] - v) < 1e-9 for w, v in context.items())
    assert context["quoth"] < 0 and context["raven"] < 0

    def score(t):
        ws = words(t)
        hits = [(i, *known[w]) for i, w in enumerate(ws) if known[w]]
        x = [0.0] * 8
        if hits:
            mark = lambda part: any(c in w for w in part for c in toxicity.QUOTES)
            quoted = [mark(ws[max(0, i - 8) : i + 1]) and mark(ws[i : i + 9]) for i, *_ in hits]
            says = [max(-6, min(6, sum(context.get(toxicity.folded(w), 0) for w in set(near_of(ws, i))))) for i, *_ in hits]
            total, n = sum(w for _, w, _ in hits), len(hits)
            x = [1.0, math.log1p(total), max(w for _, w, _ in hits), math.log1p(100 * total / len(ws)), sum(says) / n, max(says), sum(quoted) / n, sum(k > 0 for *_, k in hits) / n]
        z = sum(float(w) * v for w, v in zip(model.weights, [*x, 1.0], strict=True))
        return 1 / (1 + math.exp(-z))

    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in toxicity.score(documents(spark, rows), model).collect()}
    for i, t in rows:
        s = score(t)
        assert abs(got[i][0] - s) < 1e-9 and got[i][1] == int(s >= toxicity.THRESHOLD)
    # long texts, repeated rows, rows without a key
    odd = [(1, " ".join([rows[0][1]] * 400)), (1, " ".join([rows[0][1]] * 400)), (None, rows[0][1]), (2, None)]
    assert sorted(round(r["score"], 9) for r in toxicity.score(documents(spark, odd), model).collect()) == sorted(round(score(t or ""), 9) for _, t in odd)


def test_one_text_of_each_key_teaches(spark):
    rows = [(i, f"plain words {i}") for i in range(50)] + [(7, "plain again")] * 200
    labels = spark.createDataFrame([(i, int(i == 7)) for i in range(50)], "doc_id long, toxic int")
    once = toxicity.fit(documents(spark, rows), labels)
    assert once.weights.tolist() == toxicity.fit(documents(spark, rows[:51]), labels).weights.tolist()


def test_languages_equal_plain_python(spark):
    """Counts, prior and posterior of every n-gram of letters, by dictionary."""
    rng = random.Random(21)
    kinds = {"aa": ["talo", "Järvi", "metsä", "kuu"], "bb": ["house", "lake", "wood", "moon"], "cc": ["漢字", "かな", "語"]}
    rows = [(i, " ".join(rng.choice(kinds[k] + ["12", "-"]) for _ in range(rng.randint(1, 12))), k) for i in range(90) for k in [rng.choice("aaabbc") * 2]]
    docs = spark.createDataFrame([*rows, *rows[:3], (200, "kuu", None), (201, None, "aa")], "doc_id long, text string, lang string")
    model = langid.fit(docs)

    def hashed(points, n):
        h = n * 0x9E3779B1 & 0xFFFFFFFF
        for p in points:
            h = (h ^ p) * 0x85EBCA6B & 0xFFFFFFFF
            h ^= h >> 15
        return (h >> 1) & (langid.HASHES - 1)

    def grams(text):
        s = re.sub(" +", " ", "".join(c.lower() if c.isalpha() else " " for c in text))
        return [hashed([ord(c) for c in s[i : i + n]], n) for n in (1, 2, 3) for i in range(len(s) - n + 1)]

    counts, n_docs = {}, Counter()
    for _, t, k in [*rows, *rows[:3]]:
        counts.setdefault(k, Counter()).update(grams(t))
        n_docs[k] += 1
    tests = [(i, t) for i, t, _ in rows] + [(300, "Talo moon"), (301, "!"), (302, None), (303, "metsä " * 2_000), (303, "metsä " * 2_000)]
    names = sorted(counts)
    for r in langid.identify(documents(spark, tests), model).collect():
        t = dict(tests)[r["doc_id"]]
        if not any(map(str.isalpha, t or "")):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        logs = []
        for k in names:
            whole = sum(counts[k].values()) + 0.5 * langid.HASHES
            logs.append(math.log((n_docs[k] + 0.5) / (sum(n_docs.values()) + 0.5 * len(names))) + sum(math.log((counts[k][g] + 0.5) / whole) for g in grams(t)))
        best = max(range(len(names)), key=lambda i: logs[i])
        assert r["lang_pred"] == names[best]
        assert abs(r["score"] - 1 / sum(math.exp(x - logs[best]) for x in logs)) < 1e-3
    # equal languages tie: the first in order
    even = langid.fit(spark.createDataFrame([(1, "abc", "y"), (2, "abc", "x")], "doc_id long, text string, lang string"))
    got = langid.identify(documents(spark, [(1, "abc")]), even).first()
    assert (got["lang_pred"], round(got["score"], 6)) == ("x", 0.5)


def test_languages(spark):
    rng = random.Random(7)
    kinds = {"aa": ["talo", "järvi", "metsä", "kuu"], "bb": ["house", "lake", "wood", "moon"]}
    rows = [(i, " ".join(rng.choice(kinds[lang]) for _ in range(30)), lang) for i in range(60) for lang in [rng.choice(sorted(kinds))]]
    docs = spark.createDataFrame([*rows, (100, "no label", None), (101, None, "aa")], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.languages == ("aa", "bb")
    tests = documents(spark, [(1, "Metsä JÄRVI talo"), (2, "the Wood house"), (3, None), (4, ""), (5, "123 !? 🙂"), (6, "moon " * 50_000), (None, "kuu")])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(tests, model).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "aa", 2: "bb", 3: "und", 4: "und", 5: "und", 6: "bb", None: "aa"}
    assert all(0 <= v[1] <= 1 for v in got.values())
    nothing = langid.fit(docs.limit(0))
    assert {r["lang_pred"] for r in langid.identify(tests, nothing).collect()} == {"und"}


def test_language_grams_do_not_cross_rows():
    points, at = langid._letters(pa.array(["ab", "", "c d", None]))
    grams, starts, full = langid._slices(points, at, 2)
    assert (full.tolist(), np.diff(np.append(starts, len(grams))).tolist()) == ([0, 2], [1, 2])
