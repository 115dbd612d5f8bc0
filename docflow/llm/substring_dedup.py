"""Removal of repeated word windows by difference-cover anchors.

Anchors are short windows that start only at cover positions modulo a period: for any two places there is a shift below
the period that brings both onto cover positions, so two equal long windows share an aligned anchor. Anchors that occur
once (most of them) end the work for the text around them; around repeated ones the windows are extended to full length
and compared. Documents are dealt into chunks of bounded size, as many as the text fills; each chunk sends every distinct
hash once, packed by hash bucket, so a passage that a third of all documents share costs its bucket one entry a chunk, and
gets back one bit for each. A packed row holds at least one hash, so there are never more of them than hashes.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import buckets, string_buffers, text_slices, trimmed, word_spans

WINDOW = 20
#: A difference cover; every residue modulo the period is a difference of two of its members.
PERIOD, COVER = 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1

#: Bytes of text that a chunk holds on average (one longer text, or the rows that repeat one, are in one chunk).
CHUNK = 1 << 21

_BITS = "chunk int, part int, bucket int, bits binary"
_SENT = "bucket int, chunk int, blob binary"
#: Order of a chunk's rows, the same each time it is read.
_ORDER = [("key", "ascending"), ("text", "ascending")]

#: Odd multipliers of the hashes of anchors and of the two halves of a window's identity.
_ANCHOR, _LEFT, _RIGHT = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F))


def word_hashes(texts: pa.Array) -> np.ndarray:
    """128 bits (XXH3) of each word of all rows in order, as two columns; not a polynomial, so no text is built to collide."""
    out = [np.zeros((0, 2), dtype=np.uint64)]
    for lo, hi in text_slices(texts, 1 << 20):
        # bytes.split knows the ASCII blanks only, as asked for
        words = b" ".join(texts[lo:hi].cast(pa.binary()).to_pylist()).split()
        out.append(np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), dtype=np.uint64).reshape(-1, 2))
    return np.concatenate(out)


def sequence_hashes(words: np.ndarray, starts: np.ndarray, width: int, by: np.uint64) -> np.ndarray:
    """64 bits of the ``width`` hashes from each start on: mixed in one after another, so their order counts."""
    out = np.full(len(starts), width, dtype=np.uint64)
    for k in range(width):
        out ^= words[starts + k]
        out *= by
        out ^= out >> np.uint64(29)
    return out


@dataclass
class Chunk:
    """Words of a chunk's documents, sorted by key, and what is known of their windows."""

    keys: np.ndarray  # of the rows
    texts: pa.Array
    starts: np.ndarray  # of the words, bytes
    ends: np.ndarray
    first: np.ndarray  # first word of each row, and the end
    words: np.ndarray  # two hashes each
    place: np.ndarray  # of each word in its row
    room: np.ndarray  # words from each to the end of its row

    @staticmethod
    def of(table: pa.Table) -> Chunk:
        keys = np.asarray(table.column("key").combine_chunks())
        texts = table.column("text").combine_chunks().fill_null("")
        raw, offsets = string_buffers(texts)
        starts, ends, first = word_spans(raw, offsets)
        sizes = np.diff(first)
        place = np.arange(len(starts)) - np.repeat(first[:-1], sizes)
        return Chunk(keys, texts, starts, ends, first, word_hashes(texts), place, np.repeat(sizes, sizes) - place)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Words at which anchors start, and their hashes."""
        size = self.place + self.room
        at = np.flatnonzero(_COVERED[self.place % PERIOD] & (self.room >= ANCHOR) & (size >= WINDOW))
        return at, sequence_hashes(self.words[:, 0], at, ANCHOR, _ANCHOR)

    def windows(self, n: int, bits: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and two hashes of the full windows that hold a repeated anchor."""
        at, hashes = self.anchors()
        kinds, back, times = np.unique(hashes, return_inverse=True, return_counts=True)
        repeated = times > 1
        for bucket, own in _dealt(kinds, n):
            if bucket in bits:
                repeated[own] |= np.unpackbits(bits[bucket], count=len(own)).view(bool)
        hit = np.zeros(len(self.words) + 1, dtype=np.int32)
        hit[at[repeated[back]] + 1] = 1
        np.cumsum(hit, out=hit)
        start = np.flatnonzero(self.room >= WINDOW)
        start = start[hit[start + PERIOD] > hit[start]]
        return start, sequence_hashes(self.words[:, 0], start, WINDOW, _LEFT), sequence_hashes(self.words[:, 1], start, WINDOW, _RIGHT)

    def leaders(self, start: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each window its group of equal windows, and for each group the window at the smallest key and place."""
        row = np.searchsorted(self.first, start, side="right") - 1
        rank = np.unique(self.keys, return_inverse=True)[1][row] if len(row) else row
        where = rank << 32 | self.place[start]
        order = np.lexsort((where, b, a))
        new = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])] if len(order) else np.zeros(0, bool)
        group = np.empty(len(order), dtype=np.int64)
        group[order] = np.cumsum(new) - 1
        lead = order[new]
        # rows that repeat a key also repeat its places: neither comes before the other
        self.first_here = where == where[lead][group] if len(order) else np.zeros(0, bool)
        return group, lead


_COVERED = np.zeros(PERIOD, dtype=bool)
_COVERED[list(COVER)] = True


def _dealt(hashes: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Buckets of hashes, and the places of their members in order."""
    bucket = (hashes % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    kinds, first = np.unique(bucket[order], return_index=True)
    for k, own in zip(kinds.tolist(), np.split(order, first[1:]) if len(kinds) else [], strict=True):
        yield k, own


def _sent(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    b, c, x = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"bucket": pa.array(b, pa.int32()), "chunk": pa.array(c, pa.int32()), "blob": pa.array(x, pa.binary())})


def _answers(part: int, table: pa.Table, flags: np.ndarray, sizes: list[int]) -> pa.Table:
    chunks = table.column("chunk").to_pylist()
    packed = [np.packbits(f).tobytes() for f in np.split(flags, np.cumsum(sizes)[:-1])]
    n = len(chunks)
    return pa.table({"chunk": pa.array(chunks, pa.int32()), "part": pa.array([part] * n, pa.int32()), "bucket": table.column("bucket").combine_chunks(), "bits": pa.array(packed, pa.binary())})


def _bits_of(table: pa.Table, part: int) -> dict[int, np.ndarray]:
    return {b: np.frombuffer(x, dtype=np.uint8) for p, b, x in zip(table.column("part").to_pylist(), table.column("bucket").to_pylist(), table.column("bits").to_pylist(), strict=True) if p == part}


def _shared_anchors(table: pa.Table) -> pa.Table:
    """Of one bucket's hashes, those that more than one chunk sent."""
    parts = [np.frombuffer(x, dtype=np.uint64) for x in table.column("blob").to_pylist()]
    _, back, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    return _answers(1, table, times[back] > 1, [len(p) for p in parts])


def _later_windows(table: pa.Table) -> pa.Table:
    """Of one bucket's windows, those that another chunk has at a smaller key or place."""
    parts = [np.frombuffer(x, dtype=np.int64).reshape(4, -1) for x in table.column("blob").to_pylist()]
    a, b, key, place = np.concatenate([np.vstack((p[:2], np.cumsum(p[2:], axis=1))) for p in parts], axis=1)
    order = np.lexsort((place, key, b, a))
    a, b, key, place = (x[order] for x in (a, b, key, place))
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = np.empty(len(order), dtype=bool)
    # rows that repeat a key also repeat its places: neither comes before the other
    later[order] = (key != key[lead]) | (place != place[lead])
    return _answers(2, table, later, [p.shape[1] for p in parts])


def _cut(keys: np.ndarray, n_words: np.ndarray, removed: np.ndarray, kept: list, rest: pa.Array) -> pa.Table:
    return pa.table({"key": pa.array(keys, pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.string()), "rest": rest})


def _nullable(kind: T.StructType) -> T.StructType:
    """The type with nulls allowed everywhere."""
    return T.StructType.fromJson(json.loads(re.sub(r'("(?:nullable|containsNull|valueContainsNull)":)false', r"\1true", kind.json())))


def _chunks(docs: DataFrame, text: str) -> int:
    """As many chunks as the text fills, ``CHUNK`` bytes each."""
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")).cast("long"))).first()[0] or 0
    return size // CHUNK + 1


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: Sequence[str] = (), chunks: int | None = None) -> DataFrame:
    """Rows (key, n_words, n_removed, kept, rest): every whole text without the words of repeated windows.

    A window is ``WINDOW`` consecutive words of one document; it is removed if its word sequence also starts at a smaller
    key, or earlier under the same key. Windows are judged on the input. ``kept`` is the text with the removed words and
    the separators behind them cut out. Null texts have no words and stay null. A null key sorts first and stays null.
    Rows that repeat a key count as one document in which each row's places start at zero. ``rest`` is a struct of the
    columns named in ``keep``; other columns are left out, whatever their names; an empty table gives no rows.

    Windows are told apart by 128 bits, made of two 64-bit hashes over the two halves of each word's XXH3. Chunks are dealt
    by key and text, so many rows of one key don't meet in a task unless their texts are equal too.
    """
    n, m = buckets(docs.sparkSession), chunks or _chunks(docs, text)
    lowest = F.lit(-(2**63))
    rows = docs.select(F.coalesce(F.col(key).cast("long"), lowest).alias("key"), F.col(text).cast("string").alias("text"), (F.struct(*keep) if keep else F.struct(F.lit(None).cast("int").alias("none"))).alias("rest"))
    rows = rows.select(F.pmod(F.xxhash64("key", "text"), F.lit(m)).cast("int").alias("chunk"), "key", "text", "rest")

    schema = T.StructType([*(T.StructField(c, T.LongType()) for c in ("key", "n_words", "n_removed")), T.StructField("kept", T.StringType()), T.StructField("rest", _nullable(rows.schema["rest"].dataType))])
    kind = to_arrow_schema(schema).field("rest").type

    def send_anchors(table: pa.Table) -> pa.Table:
        kinds = np.unique(Chunk.of(table.sort_by(_ORDER)).anchors()[1])
        chunk = table.column("chunk")[0].as_py()
        return _sent([(b, chunk, kinds[own].tobytes()) for b, own in _dealt(kinds, n)])

    def send_windows(table: pa.Table, known: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _sent([])
        c = Chunk.of(table.sort_by(_ORDER))
        start, a, b = c.windows(n, _bits_of(known, 1))
        _, lead = c.leaders(start, a, b)
        lead = np.sort(lead)
        a, b, start = a[lead], b[lead], start[lead]
        keys = c.keys[np.searchsorted(c.first, start, side="right") - 1]
        out = []
        for bucket, own in _dealt(a, n):
            # keys and places as steps: in this order they are small
            steps = (np.diff(x[own], prepend=np.int64(0)) for x in (keys, c.place[start]))
            out.append((bucket, table.column("chunk")[0].as_py(), np.vstack((a[own].view(np.int64), b[own].view(np.int64), *steps)).tobytes()))
        return _sent(out)

    def cut(table: pa.Table, known: pa.Table) -> pa.Table:
        table = table.sort_by(_ORDER)
        rest, null = table.column("rest").combine_chunks().cast(kind), table.column("text").is_null().to_pylist()
        if not table.num_rows:
            return _cut(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), [], rest)
        c = Chunk.of(table)
        start, a, b = c.windows(n, _bits_of(known, 1))
        group, lead = c.leaders(start, a, b)
        order = np.argsort(lead)
        later = np.zeros(len(lead), dtype=bool)
        second = _bits_of(known, 2)
        for bucket, own in _dealt(a[lead[order]], n):
            if bucket in second:
                later[order[own]] = np.unpackbits(second[bucket], count=len(own)).view(bool)
        gone = start[later[group] | ~c.first_here]
        edge = np.zeros(len(c.words) + 1, dtype=np.int32)
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + WINDOW, -1)
        lost = np.cumsum(edge[:-1]) > 0
        removed = np.diff(np.concatenate(([0], np.cumsum(lost)))[c.first])
        kept = c.texts.to_pylist()
        _, offsets = string_buffers(c.texts)
        for r in np.flatnonzero(removed).tolist():
            lo, hi = c.first[r], c.first[r + 1]
            mark = np.diff(np.concatenate(([0], lost[lo:hi].astype(np.int8), [0])))
            begin, stop = np.flatnonzero(mark > 0), np.flatnonzero(mark < 0)
            whole = kept[r].encode()
            cuts = c.starts[lo + begin] - offsets[r]
            goes = np.where(lo + stop < hi, c.starts[np.minimum(lo + stop, len(c.starts) - 1)] - offsets[r], len(whole))
            pieces = zip(np.concatenate(([0], goes)).tolist(), np.concatenate((cuts, [len(whole)])).tolist(), strict=True)
            kept[r] = b"".join([whole[i:j] for i, j in pieces]).decode()
        kept = [None if x else k for x, k in zip(null, kept, strict=True)]
        return _cut(c.keys, np.diff(c.first), removed, kept, rest)

    first = rows.groupBy("chunk").applyInArrow(trimmed(send_anchors), _SENT).groupBy("bucket").applyInArrow(trimmed(_shared_anchors), _BITS)
    second = rows.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(trimmed(send_windows), _SENT).groupBy("bucket").applyInArrow(trimmed(_later_windows), _BITS)
    known = first.unionByName(second)
    out = rows.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(trimmed(cut), schema)
    return out.select(F.when(F.col("key") != lowest, F.col("key")).alias(key), "n_words", "n_removed", "kept", "rest")
