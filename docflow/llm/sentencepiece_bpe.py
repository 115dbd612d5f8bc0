"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The distinct words of a batch lie in one flat numpy array of symbols. Every round takes the best-ranked adjacent pair of
each word and merges its occurrences from the left at once; words without a mergeable pair leave the array. No piece of
the vocabulary crosses from a letter to a word-start mark (checked on loading), so words can be merged apart. Very long
words (scripts and data without blanks) are merged at many places a round: wherever a pair is the best far enough around it.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices, trimmed

MARK = "▁"
_SPACE = ord(MARK)
_NONE = np.int32(2**31 - 1)
#: Longer words (characters) are merged by themselves and not kept; words kept by a worker while a task lasts.
LONG, KEPT = 128, 100_000


class Model:
    """Vocabulary tables of a BPE model with byte fallback, identity normalisation and a dummy prefix."""

    _loaded: dict[str, Model] = {}

    @classmethod
    def load(cls, path: str) -> Model:
        """One per worker process."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        n, t = model.normalizer_spec, model.trainer_spec
        if t.model_type != 2 or not t.byte_fallback or n.precompiled_charsmap or n.remove_extra_whitespaces or not n.add_dummy_prefix or not n.escape_whitespaces or t.treat_whitespace_as_suffix:
            raise ValueError("the model is not a plain BPE model with byte fallback")
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        if any(p.type not in (1, 2, 3, 6) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        if any(b == MARK and a != MARK for p in normal for a, b in zip(p, p[1:], strict=False)):
            raise ValueError("a piece crosses a word start")
        scores = [p.score for p in model.pieces]
        # byte tokens
        self.byte_id = np.zeros(256, dtype=np.int64)
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                self.byte_id[int(p.piece[1:-1], 16)] = i
        # characters are their own symbols until the end: piece ids, or beyond them the code points outside the vocabulary
        self.size = len(model.pieces)
        self.char_id = {c: i for c, i in normal.items() if len(c) == 1}
        # every split of a piece into two pieces or characters is a merge
        sides: dict[tuple[int, int], int] = {}
        unsafe: set[int] = set()
        by_score: dict[float, int] = {}
        for p, i in normal.items():
            if len(p) > 1:
                by_score[scores[i]] = by_score.get(scores[i], 0) + 1
        for p, i in normal.items():
            for k in range(1, len(p)):
                a, b = normal.get(p[:k]), normal.get(p[k:])
                # a character outside the vocabulary can be a side too, but never after its own merge
                a = self._outside(p[:k]) if a is None and k == 1 else a
                b = self._outside(p[k:]) if b is None and len(p) - k == 1 else b
                if a is None or b is None:
                    continue
                sides[a, b] = i
                for part in (a, b):
                    if part < self.size and len(model.pieces[part].piece) > 1 and scores[i] >= scores[part]:
                        unsafe.add(part)
        unsafe.update(i for p, i in normal.items() if len(p) > 1 and by_score[scores[i]] > 1)
        self._hash(np.fromiter((a << 32 | b for a, b in sides), np.int64, len(sides)), np.fromiter(sides.values(), np.int32, len(sides)))
        ranks = {s: r for r, s in enumerate(sorted(set(scores), reverse=True))}
        #: by piece id; the last entry, which -1 reads, says that a pair makes nothing
        self.rank = np.array([*(ranks[s] for s in scores), _NONE], dtype=np.int32)
        self.symbol = np.arange(self.size, self.size + 0x110000, dtype=np.int32)
        self.symbol[[ord(c) for c in self.char_id]] = list(self.char_id.values())
        self.safe = np.ones(self.size, dtype=bool)
        self.safe[list(unsafe)] = False
        self.text = [bytes([int(p.piece[1:-1], 16)]) if p.type == 6 else p.piece.replace(MARK, " ").encode() if p.type == 1 else " ⁇ ".encode() if p.type == 2 else b"" for p in model.pieces]
        self.shown = [b"%d%s" % (i, end) for end in (b",", b"\n") for i in range(self.size)]
        self.spelled = [t + end for end in (b"", b"\xff") for t in self.text]
        #: symbols on each side in which a pair must be the best one to be merged: twice the characters of the longest piece
        self.reach = 2 * max(map(len, normal))
        self.forget()

    def forget(self) -> None:
        """Let go of the words met so far."""
        self.young: dict[str, tuple[bytes, bytes]] = {}
        self.old: dict[str, tuple[bytes, bytes]] = {}
        self.once: list[str] = []
        self.sides: dict[int, int] = {}

    def _outside(self, c: str) -> int:
        return self.size + ord(c)

    def _hash(self, pairs: np.ndarray, made: np.ndarray) -> None:
        """An open-addressed table of the mergeable pairs, at most an eighth full."""
        self.bits = max(4, int(len(pairs) * 8).bit_length())
        size = 1 << self.bits
        self.keys, self.made = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        at, todo, self.probes = self._slot(pairs), np.arange(len(pairs)), 0
        while len(todo):
            self.probes += 1
            free = self.keys[at[todo]] < 0
            put = todo[free]
            self.keys[at[put]] = pairs[put]
            todo = todo[self.keys[at[todo]] != pairs[todo]]
            at[todo] = (at[todo] + 1) & (size - 1)
        self.made[self._find(pairs)] = made

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def _find(self, pairs: np.ndarray) -> np.ndarray:
        """Slot of each pair, or a free slot."""
        at = self._slot(pairs)
        for _ in range(self.probes):
            there = self.keys[at]
            wrong = np.flatnonzero((there != pairs) & (there >= 0))
            if not len(wrong):
                break
            at[wrong] = (at[wrong] + 1) & (len(self.keys) - 1)
        return at

    def merges(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Piece that each adjacent pair makes, -1 for none."""
        pair = left.astype(np.int64) << 32 | right
        at = self._find(pair)
        return np.where(self.keys[at] == pair, self.made[at], np.int32(-1))

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of words in which spaces are already marks, and the end of each word in them."""
        sym = self.symbol[np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)]
        word = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) for w in words])
        made = np.full(len(sym), -1, dtype=np.int32)
        if len(sym) > 1:
            made[:-1] = np.where(word[:-1] == word[1:], self.merges(sym[:-1], sym[1:]), np.int32(-1))
        rank = self.rank[made]
        done_word: list[np.ndarray] = []
        done_sym: list[np.ndarray] = []
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.r_[first, len(sym)])
            live = best < _NONE
            if not live.all():
                keep = np.repeat(live, sizes)
                done_word.append(word[~keep])
                done_sym.append(sym[~keep])
                sym, word, made, rank = sym[keep], word[keep], made[keep], rank[keep]
                if not len(sym):
                    break
                best, sizes = best[live], sizes[live]
            hit = np.flatnonzero(rank == np.repeat(best, sizes))
            # of the best pairs of a word: all, if merging one can't bring forward another merge; else the leftmost
            own = word[hit]
            lead = np.r_[True, own[1:] != own[:-1]]
            hit = hit[lead | self.safe[made[hit]]]
            # overlapping occurrences (runs of one symbol): every second one, from the left
            near = np.diff(hit) == 1
            if near.any():
                begin = np.maximum.accumulate(np.where(np.r_[True, ~near], np.arange(len(hit)), 0))
                hit = hit[(np.arange(len(hit)) - begin) % 2 == 0]
            sym[hit] = made[hit]
            keep = np.ones(len(sym), dtype=bool)
            keep[hit + 1] = False
            sym, word, made, rank = sym[keep], word[keep], made[keep], rank[keep]
            # only the pairs on both sides of a merge are new
            at = hit - np.arange(len(hit))
            at = np.concatenate((at, at[at > 0] - 1))
            last = at == len(sym) - 1
            after = np.where(last, at, at + 1)
            made[at] = np.where(last | (word[at] != word[after]), np.int32(-1), self.merges(sym[at], sym[after]))
            rank[at] = self.rank[made[at]]
        word = np.concatenate(done_word) if done_word else np.zeros(0, np.int32)
        sym = np.concatenate(done_sym) if done_sym else np.zeros(0, np.int32)
        order = np.argsort(word, kind="stable")
        sym, word = self._with_bytes(sym[order], word[order])
        return sym, np.cumsum(np.bincount(word, minlength=len(words)))

    def encode_long(self, word: str) -> np.ndarray:
        """Piece ids of one word, merging in each round all pairs that are the first best one within ``reach`` symbols.

        A merge changes only the symbol it makes, and none outgrows the longest piece. So whatever merges come before that
        of such a pair stay beyond half the reach, and what it leads to stays within the other half: merging it at once
        changes nothing. Where the word repeats itself few pairs are the first best ones; what is then left is merged one
        by one from a heap, so the time stays near to linear.
        """
        sym = self.symbol[np.frombuffer(word.encode("utf-32-le"), dtype=np.uint32)]
        made = np.append(self.merges(sym[:-1], sym[1:]), np.int32(-1))
        k = self.reach
        while True:
            rank = self.rank[made]
            # least rank of the k symbols from each on; k places of padding stand before the first
            low = np.concatenate((np.full(k, _NONE), rank, np.full(k, _NONE)))
            wide = 1
            while wide < k:
                step = min(wide, k - wide)
                low[:-step] = np.minimum(low[:-step], low[step:])
                wide += step
            hit = np.flatnonzero((rank < _NONE) & (rank == low[k : k + len(rank)]) & (rank < low[: len(rank)]))
            if len(hit) * 256 < len(sym):
                break
            sym[hit] = made[hit]
            keep = np.ones(len(sym), dtype=bool)
            keep[hit + 1] = False
            sym, made = sym[keep], made[keep]
            at = hit - np.arange(len(hit))
            at = np.unique(np.concatenate((at, at[at > 0] - 1)))
            last = at == len(sym) - 1
            made[at] = np.where(last, np.int32(-1), self.merges(sym[at], sym[np.where(last, at, at + 1)]))
        if len(hit):
            sym = self._one_by_one(sym, made)
        return self._with_bytes(sym, np.zeros(len(sym), dtype=np.int32))[0]

    def _one_by_one(self, symbols: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """The symbols that are left when the best pair, of equal ones the leftmost, has been merged again and again."""
        if not self.sides:
            used = np.flatnonzero(self.keys >= 0)
            self.sides = dict(zip(self.keys[used].tolist(), self.made[used].tolist(), strict=True))
        sym, made, n = symbols.tolist(), pairs.tolist(), len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, find = self.rank.tolist(), self.sides.get
        heap = [(rank[p], i) for i, p in enumerate(made) if p >= 0]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            p = made[i]
            if p < 0 or rank[p] != r:
                continue
            j = after[i]
            end = after[j]
            sym[i], sym[j], made[j], after[i] = p, -1, -1, end
            if end < n:
                before[end] = i
            for x, y in ((before[i], i), (i, end)):
                if x >= 0:
                    made[x] = new = find(sym[x] << 32 | sym[y], -1) if y < n else -1
                    if new >= 0:
                        heapq.heappush(heap, (rank[new], x))
        return np.array([x for x in sym if x >= 0], dtype=np.int32)

    def _with_bytes(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters outside the vocabulary become byte tokens."""
        out = np.flatnonzero(sym >= self.size)
        if not len(out):
            return sym, word
        spelled = [self.byte_id[list(chr(c).encode())] for c in (sym[out] - self.size).tolist()]
        times = np.ones(len(sym), dtype=np.int64)
        times[out] = [len(s) for s in spelled]
        at = np.cumsum(times) - times
        ids = np.repeat(sym, times)
        for i, s in zip(at[out].tolist(), spelled, strict=True):
            ids[i : i + len(s)] = s
        return ids, np.repeat(word, times)

    def words_of(self, text: str) -> list[str]:
        """A text's words, each with the marks that precede it."""
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        if MARK * 2 not in marked and marked[-1] != MARK:
            return [MARK + w for w in marked[1:].split(MARK)]
        words, run = [], ""
        for w in marked.split(MARK)[1:]:
            run += MARK
            if w:
                words.append(run + w)
                run = ""
        return words + [run] * bool(run)

    def look_up(self, words: set[str], most: int = KEPT) -> dict[str, tuple[bytes, bytes]]:
        """Per word: ids joined by commas, decoded bytes.

        What was asked for since the last ``most`` words, or before that, is kept for later batches; long words are not.
        """
        for w in self.once:
            del self.young[w]
        self.once = []
        new = words.difference(self.young)
        if len(self.young) + len(new) > most:
            self.old, self.young = self.young, {}
            new = words
        kept = self.old.keys() & new
        if kept:
            self.young.update(zip(kept, map(self.old.__getitem__, kept), strict=True))
            new = new.difference(kept)
        if new:
            words_in = [w for w in new if len(w) <= LONG]
            self.once = [w for w in new if len(w) > LONG]
            flat, ends = self.encode_words(words_in)
            long = [self.encode_long(w) for w in self.once]
            flat = np.concatenate((flat, *long))
            ends = np.concatenate((ends, (ends[-1] if len(ends) else 0) + np.cumsum([len(x) for x in long], dtype=np.int64)))
            flat[ends - 1] += self.size  # the last piece of a word carries the end mark of what is split below
            shown = b"".join(map(self.shown.__getitem__, flat.tolist())).split(b"\n")
            spelled = b"".join(map(self.spelled.__getitem__, flat.tolist())).split(b"\xff")
            self.young.update(zip([*words_in, *self.once], zip(shown, spelled, strict=False), strict=False))
        return self.young

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the pieces in a row; the caller takes off the dummy prefix and mends invalid UTF-8."""
        return b"".join([self.text[i] for i in ids])

    def encode(self, text: str) -> list[int]:
        words = self.words_of(text)
        known = self.look_up(set(words))
        joined = b",".join([known[w][0] for w in words])
        return [int(x) for x in joined.split(b",")] if joined else []

    def decode_text(self, ids: list[int]) -> str:
        raw = self.decode(ids)
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """Encode every whole text and decode it again: rows (key, n_tokens, ids_sha256, decoded_sha256[, ids][, decoded]).

    No begin or end ids. Null and empty texts have no ids and decode to the empty text. Repeated rows each keep a row; a
    null key stays null; other columns are left out, whatever their names; an empty table gives no rows. ``model`` is the
    path of the vocabulary file, the same on all executors. A worker lets go of its words when a task ends.
    """
    extra = [("ids", pa.list_(pa.int32()), "array<int>")] * with_ids + [("decoded", pa.string(), "string")] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.load(model)
        gc.disable()  # the word tables hold no cycles, and walking them again and again costs more than the merges
        try:
            for b in batches:
                texts = b.column("text").fill_null("")
                for lo, hi in text_slices(texts, 1 << 20):
                    words = [m.words_of(t) for t in texts[lo:hi].to_pylist()]
                    known = m.look_up(set().union(*words))
                    rows: list[list] = [[] for _ in range(3 + len(extra))]
                    for ws in words:
                        shown, spelled = zip(*map(known.__getitem__, ws), strict=True) if ws else ((), ())
                        ids = b",".join(shown)
                        raw = b"".join(spelled)[1:]
                        rows[0].append(ids.count(b",") + 1 if ids else 0)
                        rows[1].append(hashlib.sha256(ids).hexdigest())
                        rows[2].append(hashlib.sha256(raw).hexdigest())
                        if with_ids:
                            rows[3].append([int(x) for x in ids.split(b",")] if ids else [])
                        if with_text:
                            rows[-1].append(raw.decode())
                    kinds = [pa.int64(), pa.string(), pa.string(), *(e[1] for e in extra)]
                    names = [key, "n_tokens", "ids_sha256", "decoded_sha256", *(e[0] for e in extra)]
                    yield pa.RecordBatch.from_arrays([b.column("key")[lo:hi], *(pa.array(r, k) for r, k in zip(rows, kinds, strict=True))], names=names)
        finally:
            m.forget()
            gc.enable()

    schema = f"`{key}` long, n_tokens long, ids_sha256 string, decoded_sha256 string" + "".join(f", {n} {s}" for n, _, s in extra)
    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(trimmed(run), schema)
