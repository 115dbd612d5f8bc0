"""Fill-in-middle by succinct rank and select.

Where tokens start is a bit for each byte of a batch of texts, packed into words with a directory of popcounts a block. The
popcount between a text's ends is its number of tokens; select on two ranks gives the bytes at which it is cut. A second
bitvector, of the bytes that start a code point, turns cuts into characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import separators, string_buffers, text_slices, trimmed

#: The marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Of 100 texts so many are cut; of 100 that are, so many begin with the suffix.
RATE, SPM = 50, 80
#: Bytes of text of which the bitvectors are made at a time.
SLICE = 4 << 20
_WORDS = 8  # 64-bit words of a block


class Bits:
    """A bitvector with rank and select, for arrays of questions."""

    def __init__(self, flags: np.ndarray) -> None:
        packed = np.packbits(flags, bitorder="little")
        span = 8 * _WORDS
        whole = np.zeros((len(packed) // span + 1) * span, dtype=np.uint8)  # a block of zeros at the end, so every place has one
        whole[: len(packed)] = packed
        self.words = whole.view("<u8").reshape(-1, _WORDS)
        self.counts = np.bitwise_count(self.words)
        self.before = np.r_[0, np.cumsum(self.counts.sum(axis=1, dtype=np.int64))]

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Number of ones before each place."""
        block, word, bit = at >> 9, (at >> 6) & (_WORDS - 1), at & 63
        earlier = (self.counts[block] * (np.arange(_WORDS) < word[:, None])).sum(axis=1, dtype=np.int64)
        low = self.words[block, word] & ((np.uint64(1) << bit.astype(np.uint64)) - np.uint64(1))
        return self.before[block] + earlier + np.bitwise_count(low)

    def select(self, nth: np.ndarray) -> np.ndarray:
        """Place of each nth one, from 0; there must be as many."""
        block = np.searchsorted(self.before, nth, "right") - 1
        left = nth - self.before[block]
        word, left = _within(self.counts[block], left)
        octets = np.ascontiguousarray(self.words[block, word]).view(np.uint8).reshape(-1, 8)
        byte, left = _within(np.bitwise_count(octets), left)
        bits = np.unpackbits(octets[np.arange(len(byte)), byte][:, None], axis=1, bitorder="little")
        return (block << 9) + (word << 6) + (byte << 3) + _within(bits, left)[0]


def _within(counts: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The column in which the running sum of each row first exceeds ``left``, and what is left of that in it."""
    sums = np.cumsum(counts, axis=1, dtype=np.int64)
    column = (sums <= left[:, None]).sum(axis=1)
    return column, left - np.where(column > 0, sums[np.arange(len(column)), column - 1], 0)


def _drawn(key: int | None, seed: int) -> bytes:
    return hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()[:16]


def transformed(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """Rows (key, n, form, output, prefix_chars, middle_chars): each whole text in its form, by what its key draws.

    A token is a word with the blanks before it, or the blanks at the end. Form ``psm`` is prefix, suffix, middle, ``spm``
    suffix, prefix, middle, each after its mark; ``plain`` is the text itself, as for empty texts and those that have a mark.
    Null texts are empty; a null key draws as an empty one; equal keys draw alike. Every row keeps a row; other columns are left
    out; an empty table gives no rows.
    """
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in text_slices(b.column("text"), SLICE):
                yield slice_(b.column("key")[lo:hi], b.column("text")[lo:hi])

    def slice_(keys: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        raw, offsets = string_buffers(texts)
        blank = separators(raw)
        starts = blank.copy()
        starts[1:] &= ~blank[:-1]
        begin, end = offsets[:-1], offsets[1:]
        starts[begin[begin < end]] = True  # the first token of a text starts with it, whatever ends the one before
        tokens, points = Bits(starts), Bits((raw & 0xC0) != 0x80)
        ids = keys.to_pylist()
        drawn = np.frombuffer(b"".join(_drawn(k, seed) for k in ids), dtype=">u4").reshape(-1, 4).astype(np.int64)
        first = tokens.rank(begin)
        n = tokens.rank(end) - first
        at = np.sort(drawn[:, :2] % (n + 1)[:, None], axis=1)
        cuts = np.repeat(end[:, None], 2, axis=1)
        for k in (0, 1):
            inner = np.flatnonzero(at[:, k] < n)
            cuts[inner, k] = tokens.select((first + at[:, k])[inner])
        chars = [points.rank(x) for x in (begin, cuts[:, 0], cuts[:, 1])]
        whole, form, output = raw.tobytes(), [], []
        for i, (a, c, d, z) in enumerate(zip(begin.tolist(), cuts[:, 0].tolist(), cuts[:, 1].tolist(), end.tolist(), strict=True)):
            said = whole[a:z]
            if not said or drawn[i, 2] % 100 >= rate or any(m in said for m in marks):
                form.append("plain")
                output.append(said)
                continue
            p, m, s = marks[0] + whole[a:c], marks[2] + whole[c:d], marks[1] + whole[d:z]
            form.append("spm" if drawn[i, 3] % 100 < spm else "psm")
            output.append((s + p if form[-1] == "spm" else p + s) + m)
        plain = np.array([f == "plain" for f in form])
        sizes = [pa.array(chars[k + 1] - chars[k], pa.int64(), mask=plain) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(output, pa.binary()).cast(pa.string()), *sizes], names=[key, "n", "form", "output", "prefix_chars", "middle_chars"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    kinds = (("n", T.LongType()), ("form", T.StringType()), ("output", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()))
    return rows.mapInArrow(trimmed(run), T.StructType([T.StructField(key, T.LongType()), *[T.StructField(c, k) for c, k in kinds]]))


def restored(output: Column, form: Column) -> Column:
    """The text again, from an output and its form. No mark is in a text that was cut, so they part it."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    first, second, last = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, last, second)).when(form == "spm", F.concat(second, last, first)).otherwise(output)
