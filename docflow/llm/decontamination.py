"""Benchmark decontamination by pigeonhole edit matching.

An item within k edits of a passage, cut into k + 1 pieces, has at least one piece in it unchanged. One Aho-Corasick scan
of a text finds all piece hits; each hit says where its item would start, and Myers' bit-parallel distance verifies it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, trimmed, written

#: Edits allowed for each character of an item; items without a word are nothing to search for. Items too short for an
#: edit are found where they stand as whole words.
ERROR_RATE, MIN_WORDS = 0.08, 1
#: Characters of items in one block; a larger benchmark is searched block by block, so what is sent has this bound.
BLOCK = 4_000_000

_NO_WORD = re.compile(r"[\W_]+")
#: Letters of scripts that put no blanks between words.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u312f\u31a0-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def normalised(text: str) -> str:
    """Small letters; everything between words is one blank."""
    return _NO_WORD.sub(" ", text.lower()).strip()


def whole(text: str, lo: int, hi: int) -> bool:
    """Whether no word of a normalised text goes on beyond either end of a passage."""

    def parted(i: int) -> bool:
        return not 0 < i < len(text) or " " in text[i - 1 : i + 1] or bool(_UNSPACED.search(text[i - 1 : i + 1]))

    return parted(lo) and parted(hi)


def distance(pattern: str, text: str, most: int) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to a part of ``text`` and where that part ends; ``most + 1`` if above ``most``.

    Myers' algorithm: the differences down a column of the table are two bit vectors as long as the pattern.
    """
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, where = min(m, most + 1), 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | ~(diagonal | plus) & full
        down = plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = up << 1 & full
        plus = (down << 1 | ~(diagonal | up)) & full
        minus = up & diagonal
        if score < best:
            best, where = score, j + 1
    return best, where


@dataclass
class Items:
    """A block of benchmark items; the automaton over their pieces is made once in each worker."""

    ids: list[int]
    texts: list[str]
    rate: float
    _automaton: object = field(default=None, repr=False, compare=False)

    def budget(self, i: int) -> int:
        return int(self.rate * len(self.texts[i]))

    def automaton(self) -> object:
        if self._automaton is None:
            import ahocorasick

            pieces: dict[str, list[tuple[int, int]]] = {}
            for i, t in enumerate(self.texts):
                parts = self.budget(i) + 1
                cuts = [len(t) * p // parts for p in range(parts + 1)]
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    pieces.setdefault(t[lo:hi], []).append((i, hi))
            machine = ahocorasick.Automaton()
            for piece, owners in pieces.items():
                machine.add_word(piece, owners)
            machine.make_automaton()
            self._automaton = machine
        return self._automaton

    def __getstate__(self) -> dict:
        return {"ids": self.ids, "texts": self.texts, "rate": self.rate, "_automaton": None}

    def found(self, text: str) -> list[tuple[int, int]]:
        """(item, distance) of each item that some passage of a text is within its budget of."""
        text = normalised(text)
        places: dict[int, set[int]] = {}
        for end, owners in self.automaton().iter(text):
            for i, hi in owners:
                places.setdefault(i, set()).add(end + 1 - hi)
        out = []
        for i, starts in places.items():
            k, m = self.budget(i), len(self.texts[i])
            if not k:
                if any(whole(text, s, s + m) for s in starts):
                    out.append((self.ids[i], 0))
                continue
            best, reach = k + 1, -1
            for s in sorted(starts):
                # starts within k of each other are one passage; each window is read once
                if s <= reach:
                    continue
                reach = s + k
                best = min(best, distance(self.texts[i], text[max(0, s - k) : s + m + 2 * k], k)[0])
                if not best:
                    break
            if best <= k:
                out.append((self.ids[i], best))
        return out


def blocks(benchmark: DataFrame, key: str = "item_id", text: str = "text", rate: float = ERROR_RATE, min_words: int = MIN_WORDS, block: int = BLOCK) -> Iterator[Items]:
    """The benchmark, a query set that is read once, in blocks of bounded size. Null items and those without a word are left out."""
    now, size = Items([], [], rate), 0
    for r in benchmark.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where("text is not null").toLocalIterator():
        t = normalised(r["text"])
        if len(t.split()) < min_words:
            continue
        if size + len(t) > block and now.ids:
            yield now
            now, size = Items([], [], rate), 0
        now.ids.append(r["key"])
        now.texts.append(t)
        size += len(t)
    if now.ids:
        yield now


def _in_turn(found: Iterator[Items]) -> Iterator[tuple[Items, bool]]:
    """Each block, and whether it is the only one: others are sent, searched for and let go before the next is read."""
    first = next(found, None)
    for second in found:
        yield first, False
        first = second
        break
    else:
        if first is not None:
            yield first, True
        return
    yield first, False
    for items in found:
        yield items, False


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **how: float) -> DataFrame:
    """Rows (key, item_id, distance): each document's passages within the edit budget of an item, the least distance of each.

    Whole normalised texts are searched, without a shuffle. Null and empty texts match nothing; repeated documents and
    items each give their own rows; other columns are left out; an empty side gives no rows. A benchmark of one block is
    searched for when the rows are asked for; of several each one's rows are written, so no more than one is ever sent out.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    out = rows.sparkSession.createDataFrame([], f"`{key}` long, item_id long, distance int")
    for items, alone in _in_turn(blocks(benchmark, **how)):
        sent = rows.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent: object = sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = [(k, i, d) for k, t in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True) if t for i, d in sent.value.found(t)]
                if got:
                    ks, ids, ds = zip(*got, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(ids, pa.int64()), pa.array(ds, pa.int32())], names=[key, "item_id", "distance"])

        found = rows.mapInArrow(trimmed(run), f"`{key}` long, item_id long, distance int")
        if not alone:
            found = written(found, "matches")
            sent.destroy()
        out = out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how: float) -> DataFrame:
    """The rows of ``docs``, all their columns, whose text matches no item. Null texts stay; nothing is shuffled.

    Of a benchmark of several blocks, what each leaves is written and read for the next.
    """
    last = None
    for items, alone in _in_turn(blocks(benchmark, **how)):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent: object = sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = pa.array([not t or not sent.value.found(t) for t in b.column(text).to_pylist()], pa.bool_())
                yield b.filter(keep) if not pc.all(keep).as_py() else b

        docs = docs.mapInArrow(trimmed(run), docs.schema)
        if not alone:
            docs = written(docs, "clean")
            sent.destroy()
            if last is not None:
                removed(docs.sparkSession, last)
            last = docs
    return docs
