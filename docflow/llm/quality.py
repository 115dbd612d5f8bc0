"""Quality rules in DataFrame functions only.

Base rules count words, symbols, repeated lines and repeated 8-word windows of each text. The method scores a text by
the log-likelihood ratio of its hashed words and word pairs under two multinomials, one of trusted documents and one of
the whole corpus, divided by their number; every document is compared with one threshold, fixed by the trusted ones. All
documents that are labelled good are trusted, and all of them count for both.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Hash buckets of the two multinomials: the size of the model, whatever the size of the corpus.
BUCKETS = 1 << 14
#: Where the threshold lies, from the scores of trusted documents: this low quantile, less so many times its distance to the median.
QUANTILE, MARGIN = 0.01, 2.5
_SCALE = 1_000_000
_SPLIT = r"[\x20\x09-\x0D]+"
_SYMBOLS = "#*$%&|<>"
_SPAN = 8
#: Ranks are found in so many bins of scores at once, down to a bin of at most so many rows.
_BINS, _HELD = 1 << 12, 1 << 12


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), _SPLIT), "")


def _pairs(a: str, gap: int) -> Column:
    """Hash of the elements i and i + gap of an array; the last ``gap`` results are meaningless."""
    return F.zip_with(F.col(a), F.slice(F.col(a), gap + 1, F.greatest(F.size(a), F.lit(1))), lambda x, y: F.xxhash64(x, y))


def _grams(rows: DataFrame) -> DataFrame:
    """Adds h1 and h2 (hashes of words and of word pairs) to rows with ``words``; h2 has a last meaningless element."""
    return rows.withColumn("h1", F.transform("words", lambda w: F.xxhash64(w))).withColumn("h2", _pairs("h1", 1))


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(BUCKETS - 1).cast("long")).cast("int")


def _trusted(labels: DataFrame) -> DataFrame:
    """The ids of all documents that are labelled good, each once."""
    return labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("good_id")).distinct()


def log_ratios(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> list[int]:
    """Log ratio of each bucket (trusted over corpus, in millionths), from every n-gram of every document.

    The driver gets one row per bucket, a number fixed by ``BUCKETS``. Labels may be as many as documents, so the join is one
    of two large tables at any size; documents without id take no part in it.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    known = rows.where("key is not null").join(_trusted(labels).hint("merge"), F.col("key") == F.col("good_id"), "left").select(F.col("good_id").alias("good"), "text")
    rows = known.unionByName(rows.where("key is null").select(F.col("key").alias("good"), "text")).select("good", _words("text").alias("words"))
    rows = _grams(rows).select("good", F.explode(F.concat("h1", F.slice("h2", 1, F.greatest(F.size("h2") - 1, F.lit(0))))).alias("h"))
    counts = rows.groupBy(_bucket(F.col("h")).alias("bucket")).agg(F.count("good").alias("good"), F.count(F.lit(1)).alias("whole")).collect()
    good_of, whole_of = [1] * BUCKETS, [1] * BUCKETS
    for r in counts:
        good_of[r["bucket"]] += r["good"]
        whole_of[r["bucket"]] += r["whole"]
    shift = math.log(sum(whole_of)) - math.log(sum(good_of))
    return [round(_SCALE * (math.log(g) - math.log(w) + shift)) for g, w in zip(good_of, whole_of, strict=True)]


def threshold(docs: DataFrame, labels: DataFrame, ratios: list[int], key: str = "doc_id", text: str = "text") -> float:
    """The least score that a document may have, from those of all trusted ones that pass the base rules (see ``fitted``)."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return fitted(judge(rows.join(_trusted(labels), F.col("key") == F.col("good_id"), "left_semi"), ratios, "key"), labels, "key")


def fitted(judged: DataFrame, labels: DataFrame, key: str = "doc_id") -> float:
    """The threshold from the rows of ``judge``: a low quantile of the trusted scores, less a margin as wide as they differ.

    Both quantiles are exact and over all trusted documents that pass the base rules, so it is one number that is the same in
    every run. Where there are none, every score will do. Only ids and scores travel.
    """
    passed = judged.where("not base_failed").select(F.col(key).alias("key"), "score")
    scores = written(passed.join(_trusted(labels), F.col("key") == F.col("good_id"), "left_semi").select("score"), "trusted-scores")
    found = _quantiles(scores, (QUANTILE, 0.5))
    return found[0] - MARGIN * (found[1] - found[0]) if found else -math.inf


def _quantiles(scores: DataFrame, at: tuple[float, ...]) -> list[float]:
    """Exact quantiles of a table of scores, between neighbours in proportion; none of an empty one."""
    n, lo, hi = scores.agg(F.count("score"), F.min("score"), F.max("score")).first()
    places = [q * (n - 1) for q in at]
    of = _ranked(scores, n, lo, hi, sorted({r for p in places for r in (math.floor(p), math.ceil(p))})) if n else {}
    return [of[math.floor(p)] + (p - math.floor(p)) * (of[math.ceil(p)] - of[math.floor(p)]) for p in places] if n else []


def _ranked(scores: DataFrame, n: int, lo: float, hi: float, ranks: list[int]) -> dict[int, float]:
    """The scores at some ranks (from 0) of the ``n`` that lie from ``lo`` to ``hi``.

    Few rows are sorted as they are. Of more, the bins that hold the ranks are looked into one by one: counts of bins are all
    that the driver gets, and as ``lo`` and ``hi`` never share a bin, every step narrows.
    """
    within = scores.where(F.col("score").between(lo, hi))
    if lo == hi:
        return dict.fromkeys(ranks, lo)
    if n <= _HELD:
        held = sorted(r["score"] for r in within.collect())
        return {r: held[r] for r in ranks}
    nth = F.least(F.floor((F.col("score") - lo) / (hi - lo) * _BINS), F.lit(_BINS - 1))
    bins = within.groupBy(nth.alias("bin")).agg(F.count("score").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi")).collect()
    found, before = {}, 0
    for b in sorted(bins, key=lambda b: b["bin"]):
        inside = [r - before for r in ranks if before <= r < before + b["n"]]
        if inside:
            found |= {r + before: x for r, x in _ranked(within, b["n"], b["lo"], b["hi"], inside).items()}
        before += b["n"]
    return found


def verdicts(judged: DataFrame, least: float) -> DataFrame:
    """Rows of ``judge`` with ``kept`` by another threshold."""
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(least)))


def judge(docs: DataFrame, ratios: list[int], key: str = "doc_id", text: str = "text", threshold: float = -math.inf, keep: tuple[str, ...] = (), nested: str = "rest") -> DataFrame:
    """Rows (key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept, rest).

    One pass without a shuffle. Null and empty texts have no words, score 0 and fail the base rules, as every text of
    under 20 words does. Windows are told apart by 64 bits of hash. Repeated rows each keep a row; a null key stays null. ``rest`` (named by ``nested``) is a struct of the columns in
    ``keep``, absent without any; other columns are left out; an empty table gives no rows.
    """
    t = F.col("_t")
    rows = docs.select(F.col(key).cast("long").alias("_k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"), (F.struct(*[F.col(c) for c in keep]) if keep else F.lit(None)).alias("_keep"))
    rows = rows.withColumn("words", _words("_t"))
    bare = t
    for c in _SYMBOLS:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    rows = rows.withColumn("lines", F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    rows = rows.select(
        "_k",
        "_keep",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.octet_length(t) - F.octet_length(bare)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    rows = _grams(rows).drop("words")
    # one literal, which the optimizer turns into an array; thousands of them take the driver seconds to hand over
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<bigint>") if ratios else F.array().cast("array<bigint>")
    grams = F.concat("h1", F.slice("h2", 1, F.greatest(F.size("h2") - 1, F.lit(0))))
    rows = rows.withColumn("sum", F.aggregate(grams, F.lit(0).cast("long"), lambda a, h: a + F.get(table, _bucket(h))))
    rows = rows.withColumn("h4", _pairs("h2", 2)).drop("h1", "h2").withColumn("h8", _pairs("h4", 4)).drop("h4")
    rows = rows.withColumn("h8", F.slice("h8", 1, F.greatest(F.col("n_words").cast("int") - (_SPAN - 1), F.lit(0))))
    return _counted(rows, key, threshold, nested if keep else None)


def _counted(rows: DataFrame, key: str, threshold: float, nested: str | None) -> DataFrame:
    """From the hashes of the 8-word windows to the words that repeated windows cover, and the verdict."""
    rows = rows.withColumn("twice", F.size(F.array_distinct("h8")) < F.size("h8"))
    # windows in order of hash, then place: those next to an equal hash are repeated
    placed = F.sort_array(F.arrays_zip("h8", F.sequence(F.lit(1), F.size("h8"))))
    rows = rows.withColumn("placed", F.when(F.col("twice"), placed.cast("array<struct<h:bigint,p:int>>")))
    n = F.size("placed")
    alike = F.zip_with(F.slice("placed", 1, F.greatest(n - 1, F.lit(0))), F.slice("placed", 2, F.greatest(n, F.lit(1))), lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"])))
    rows = rows.withColumn("at", F.when(F.col("twice"), F.sort_array(F.array_distinct(F.flatten(F.filter(alike, lambda x: x.isNotNull()))))))
    # a repeated window covers its words up to the next repeated window
    gaps = F.zip_with(F.slice("at", 1, F.greatest(F.size("at") - 1, F.lit(0))), F.slice("at", 2, F.greatest(F.size("at"), F.lit(1))), lambda a, b: F.least(b - a, F.lit(_SPAN)))
    covered = F.aggregate(gaps, F.lit(_SPAN).cast("long"), lambda a, g: a + g)
    grams = F.greatest(2 * F.col("n_words") - 1, F.lit(1))
    rows = rows.select("*", F.when(F.col("twice"), covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"))
    rows = rows.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    rows = rows.withColumn("score", F.col("sum") / grams / F.lit(float(_SCALE)))
    # always true, but not for the optimizer: a filter on a verdict must not be taken apart into the steps below, each of
    # which would then be worked out again and again
    whole = F.monotonically_increasing_id() >= 0
    return rows.select(
        F.col("_k").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (F.col("base_failed") & whole).alias("base_failed"), "score", (~F.col("base_failed") & (F.col("score") >= F.lit(threshold)) & whole).alias("kept"), *([F.col("_keep").alias(nested)] if nested else [])
    )
