"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are read as arrays of code points; every n-gram is hashed to a row of one log-probability matrix (hash by
language), and a batch is scored by gathering those rows and adding them up per document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import string_buffers, text_slices

ORDERS = (1, 2, 3)
HASHES = 1 << 15
#: At most about so many labelled documents (those of least hash) fit the model; whole texts of them are counted.
SAMPLE = 20_000
UNKNOWN = "und"


def _letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows, small letters; everything that is no letter is one blank, one between words and rows.

    The second array has the first code point of each row.
    """
    raw, offsets = string_buffers(texts)
    is_first = (raw & 0xC0) != 0x80
    at = np.concatenate(([0], np.cumsum(is_first)))[offsets]
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    table = _folded()
    points = table[points]
    blank = points == 32
    keep = np.ones(len(points), dtype=bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    heads = at[:-1]
    keep[heads[heads < len(points)]] = True
    return points[keep], np.concatenate(([0], np.cumsum(keep)))[at]


_FOLDED: list[np.ndarray] = []


def _folded() -> np.ndarray:
    if not _FOLDED:
        to = np.full(0x110000, 32, dtype=np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                to[c] = ord(low) if len(low) == 1 else c
        _FOLDED.append(to)
    return _FOLDED[0]


def _grams(points: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n-gram that starts at each place (n - 1 fewer than places)."""
    h = np.full(len(points) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
    for k in range(n):
        h = (h ^ points[k : len(points) - n + 1 + k]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
    return (h >> np.uint32(1)) & np.uint32(HASHES - 1)


def _slices(points: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-grams of all rows in a row, their starts by row, and the rows that have any; none crosses from row to row."""
    size = np.maximum(np.diff(at) - (n - 1), 0)
    inside = np.zeros(max(len(points) - n + 1, 0) + 1, dtype=np.int32)
    full = np.flatnonzero(size)
    np.add.at(inside, at[:-1][full], 1)
    np.add.at(inside, at[:-1][full] + size[full], -1)
    grams = _grams(points, n)[np.cumsum(inside[:-1]) > 0] if len(points) >= n else np.zeros(0, np.uint32)
    return grams, (np.cumsum(size) - size)[full], full


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    log_probability: np.ndarray  # hash x language, float32; the last row is the log prior

    def score(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and its posterior, from all n-grams of each text; the unknown language with 0 where there are no letters."""
        points, at = _letters(texts)
        logit = np.tile(self.log_probability[-1].astype(np.float64), (len(texts), 1))
        for n in ORDERS:
            grams, starts, full = _slices(points, at, n)
            if len(full):
                for k in range(len(self.languages)):
                    logit[full, k] += np.add.reduceat(self.log_probability[:, k][grams], starts, dtype=np.float64)
        lettered = np.concatenate(([0], np.cumsum(points != 32)))[at]
        letters = np.diff(lettered) > 0
        best = logit.argmax(1)
        p = np.exp(logit - logit.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
        return names, np.where(letters, p[np.arange(len(best)), best], 0.0)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE, smoothing: float = 0.5) -> Model:
    """Learn from the rows of ``docs`` whose language is not null.

    At most about ``sample`` of them are read, those of least hash of key and text; the counts, a matrix of fixed size for
    each language, are added up on the driver. The prior of a language is its share of them (half a document more for
    each language). Without any labelled row the model has no language. Rows that repeat a key count each.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    n = rows.count()
    if n > sample:
        share = int(sample / n * (1 << 32))
        rows = rows.where(F.pmod(F.xxhash64(F.col(key).cast("long"), F.col(text)), F.lit(1 << 32)) < share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}  # counts of the hashes, then of documents
        for b in batches:
            langs = np.array(b.column("lang").to_pylist(), dtype=object)
            for lo, hi in text_slices(b.column("text"), 1 << 21):
                own = langs[lo:hi]
                for name in sorted(set(own)):
                    picked = b.column("text")[lo:hi].filter(pa.array(own == name))
                    points, at = _letters(picked)
                    here = found.setdefault(name, np.zeros(HASHES + 1, dtype=np.int64))
                    here[-1] += len(picked)
                    for n in ORDERS:
                        here[:-1] += np.bincount(_slices(points, at, n)[0], minlength=HASHES)
        for name, counts in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([counts.tobytes()], pa.binary())], names=["lang", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for b in batches:
            for name, raw in zip(b.column("lang").to_pylist(), b.column("counts").to_pylist(), strict=True):
                found[name] = found.get(name, 0) + np.frombuffer(raw, dtype=np.int64)
        for name, counts in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([counts.tobytes()], pa.binary())], names=["lang", "counts"])

    part = rows.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).mapInArrow(count, "lang string, counts binary")
    counts: dict[str, np.ndarray] = {}
    for r in part.repartition("lang").mapInArrow(total, "lang string, counts binary").collect():
        counts[r["lang"]] = np.frombuffer(bytes(r["counts"]), dtype=np.int64)
    names = tuple(sorted(counts))
    matrix = np.zeros((HASHES + 1, len(names)), dtype=np.float32)
    n_docs = sum(int(c[-1]) for c in counts.values())
    for k, name in enumerate(names):
        c = counts[name][:-1].astype(np.float64) + smoothing
        matrix[:-1, k] = np.log(c) - np.log(c.sum())
        matrix[-1, k] = np.log(counts[name][-1] + 0.5) - np.log(n_docs + 0.5 * len(names))
    return Model(names, matrix)


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, lang_pred, score): the likeliest language of each whole text, and how likely it is (0 to 1).

    ``und`` and 0 for null texts, texts without letters, and a model without languages. Ties go to the first language in
    order. Repeated rows each keep a row; other columns are left out; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = sent.value
        for b in batches:
            texts = b.column("text").fill_null("")
            for lo, hi in text_slices(texts, 1 << 21):
                names, scores = m.score(texts[lo:hi]) if m.languages else ([UNKNOWN] * (hi - lo), np.zeros(hi - lo))
                yield pa.RecordBatch.from_arrays([b.column("key")[lo:hi], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[key, "lang_pred", "score"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{key}` long, lang_pred string, score double")

