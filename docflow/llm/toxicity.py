"""Toxicity by a lexicon that forgives misspelling, and what stands around its hits.

The lexicon is learned from labelled documents and kept as a trie. A word is turned into a bit-parallel Levenshtein automaton
that walks the trie and drops a branch as soon as no state is left; so all terms within one or two edits are found together.
Only words that share a rest with a term, what is left without one or two letters, are turned into automata, and they walk
the trie of those terms: a walk of the whole trie for each gives the same and takes about ten times as long.

What tells abuse from quotation is learned as well: the words that stand around hits in toxic documents and in others, by
their log odds; and the marks of quotation, which need no language. A logistic score over the hits and what is around them
gives the probability.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, text_slices, written

#: At most so many labelled documents (those of least hash) teach lexicon and weights; their whole texts are read.
SAMPLE = 20_000
#: A term needs this log odds, and this log-likelihood ratio against the base rate of toxic documents (about one chance
#: in a million). All such terms are kept; the sample bounds their number.
LOG_ODDS, EVIDENCE = 2.5, 12.0
#: Words on each side of a hit that make its context.
CONTEXT = 8
THRESHOLD = 0.3

#: Characters that stand for letters in disguised words.
DISGUISE = str.maketrans("013457@$", "oieastas")
#: Marks of quotation.
QUOTES = '"“”„«»‹›'
FEATURES = ("any", "weight", "best", "density", "context", "harshest", "quoted", "fuzzy")
#: What the words around one hit may say together, at most, in log odds.
SAYS = 6.0

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_WORD = re.compile(WORD)


def folded(word: str) -> str:
    """A word without marks at its ends, in small letters, disguised letters undone."""
    w = _EDGE.sub("", word.lower())
    return w if w.isalpha() else "".join(c for c in w.translate(DISGUISE) if c.isalpha()) if any(map(str.isalpha, w)) else ""


def edits(term: str) -> int:
    """Edits a word may be away from a term; short terms must be exact, for their neighbours are other words."""
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


#: Terms of more letters have too many rests: all words of about their length are candidates, which are few.
LONG = 40
#: Multipliers of the hashes of words and of their slots.
_BASE, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _deletions(letters: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Hashes of words of one length (letter by word) without each choice of at most ``k`` (two at most) of their letters."""
    n = len(letters)
    powers = np.array([pow(_BASE, e, 1 << 64) for e in range(n + 1)], dtype=np.uint64)

    def before(shift: int) -> np.ndarray:
        # sums of the letters before each place, where ``shift`` letters after them go
        out = np.zeros((n + 1, letters.shape[1]), dtype=np.uint64)
        np.cumsum(letters * powers[np.maximum(n - 1 - shift - np.arange(n), 0)][:, None], axis=0, out=out[1:])
        return out

    none = before(0)
    yield none[n]
    if k:
        one, rest = before(1), none[n] - none
        for i in range(n):
            yield one[i] + rest[i + 1]
    if k > 1:
        two = before(2)
        for i in range(n - 1):
            start = two[i] - one[i + 1]
            for j in range(i + 1, n):
                yield start + one[j] + rest[j + 1]


def _letters(words: list[str]) -> np.ndarray:
    """Code points of words of one length, letter by word."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    return np.ascontiguousarray(points.reshape(len(words), -1).T, dtype=np.uint64)


class _Neighbourhood:
    """The terms that allow ``k`` edits by the hashes of what is left of them without at most ``k`` letters.

    A word within ``k`` edits of a term has such a rest in common with it; so no near term is ever missed.
    """

    def __init__(self, terms: list[str], numbers: list[int], k: int) -> None:
        self.k, self.lengths = k, {len(t) + d for t in terms for d in range(-k, k + 1)}
        keys, owners = [], []
        for n in sorted({len(t) for t in terms}):
            own = [(t, i) for t, i in zip(terms, numbers, strict=True) if len(t) == n]
            for h in _deletions(_letters([t for t, _ in own]), k):
                keys.append(h)
                owners.append(np.array([i for _, i in own], dtype=np.int64))
        key, owner = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(key, kind="stable")
        self.keys, self.owners = key[order], owner[order]
        self.shift = np.uint64(64 - min(24, max(12, int(len(key) * 32).bit_length())))
        self.taken = np.zeros(1 << (64 - int(self.shift)), dtype=bool)
        self.taken[self._slots(key)] = True

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return (h * np.uint64(_MIX)) >> self.shift

    def near(self, letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of words and numbers of the terms they share a rest with."""
        for h in _deletions(letters, self.k):
            at = np.flatnonzero(self.taken[self._slots(h)])
            if len(at):
                lo, hi = (np.searchsorted(self.keys, h[at], side) for side in ("left", "right"))
                size = hi - lo
                if size.any():
                    place = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
                    yield np.repeat(at, size), self.owners[place]


@dataclass
class Lexicon:
    """Terms as a trie, searched with a Levenshtein automaton of each word; their weights, exact and misspelled."""

    terms: dict[str, tuple[float, float]]
    _trie: dict = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        self._names = list(self.terms)
        self._trie = self._spelled(self._names)
        self._near: list[_Neighbourhood] = []
        for k in range(3):
            own = [(t, i) for i, t in enumerate(self._names) if edits(t) == k and len(t) <= LONG]
            if own:
                self._near.append(_Neighbourhood(*map(list, zip(*own, strict=True)), k))
        self._long = [(len(t), i) for i, t in enumerate(self._names) if len(t) > LONG]
        self._known: dict[str, tuple[str, int] | None] = {}

    @staticmethod
    def _spelled(terms: list[str]) -> dict:
        trie: dict = {}
        for t in terms:
            node = trie
            for c in t:
                node = node.setdefault(c, {})
            node[""] = t
        return trie

    def candidates(self, words: list[str], block: int = 8192) -> dict[int, list[str]]:
        """By the place of a word: all terms that may be within their edits of it, few that are not."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        pairs = [np.zeros(0, dtype=np.int64)]
        for n in np.unique(sizes[sizes > 0]).tolist():
            near = [x for x in self._near if n in x.lengths]
            long = [i for m, i in self._long if abs(m - n) <= edits(self._names[i])]
            own = np.flatnonzero(sizes == n) if near or long else ()
            pairs += [own * len(self._names) + i for i in long]
            for lo in range(0, len(own) if near else 0, block):
                part = own[lo : lo + block]
                letters = _letters([words[i] for i in part.tolist()])
                pairs += [np.unique(part[at] * len(self._names) + term) for x in near for at, term in x.near(letters)]
        out: dict[int, list[str]] = {}
        for pair in np.unique(np.concatenate(pairs)).tolist():
            i, term = divmod(pair, len(self._names))
            out.setdefault(i, []).append(self._names[term])
        return out

    def possible(self, words: list[str]) -> np.ndarray:
        """Words that may be within the edits of a term."""
        out = np.zeros(len(words), dtype=bool)
        out[list(self.candidates(words))] = True
        return out

    def weight(self, hit: tuple[str, int]) -> float:
        term, k = hit
        return self.terms[term][0] if not k else self.terms[term][1] * (0.8 if k == 2 else 1.0)

    def nearest(self, word: str, among: list[str] | None = None) -> tuple[str, int] | None:
        """The term (of all, or of some) within its edits of a word, and how many: fewest edits, then greatest weight, then first in order."""
        n = len(word)
        where: dict[str, int] = {}
        for i, c in enumerate(word):
            where[c] = where.get(c, 0) | 1 << i
        end = 1 << n
        full = (end << 1) - 1
        best: tuple[int, float, str] | None = None
        # state: for each number of edits, the bits of the word's prefixes that the path may spell
        stack = [(self._trie if among is None else self._spelled(among), (1, 3 & full, 7 & full))]
        while stack:
            node, rows = stack.pop()
            for c, child in node.items():
                if c == "":
                    for k in range(edits(child) + 1):
                        if rows[k] & end:
                            found = (k, -self.weight((child, k)), child)
                            best = found if best is None else min(best, found)
                            break
                    continue
                m = where.get(c, 0)
                a = (rows[0] & m) << 1
                b = ((rows[1] & m) << 1 | rows[0] | rows[0] << 1 | a << 1) & full
                d = ((rows[2] & m) << 1 | rows[1] | rows[1] << 1 | b << 1) & full
                if a | b | d:
                    stack.append((child, (a, b, d)))
        return None if best is None else (best[2], best[0])

    def look_up(self, words: set[str], most: int = 200_000) -> dict[str, tuple[str, int]]:
        """Hits among raw words: term and number of edits."""
        if len(self._known) > most:
            self._known = {w: x for w, x in self._known.items() if x}
        new = [w for w in words if w not in self._known]
        if new:
            plain = [folded(w) for w in new]
            near = self.candidates(plain)
            for i, (w, p) in enumerate(zip(new, plain, strict=True)):
                self._known[w] = (p, 0) if p in self.terms else self.nearest(p, near[i]) if i in near else None
        return {w: x for w in words if (x := self._known[w])}


_QUOTE = re.compile(f"[{QUOTES}]")


class Context(dict):
    """By raw word: its log odds of standing around a hit in a toxic document, 0 if it tells nothing; a bounded memory of words."""

    def __init__(self, odds: dict[str, float]) -> None:
        super().__init__()
        self.odds = odds

    def __missing__(self, word: str) -> float:
        if len(self) > 100_000:
            self.clear()
        self[word] = says = self.odds.get(folded(word), 0.0)
        return says


def around(words: list[str], i: int) -> list[str]:
    """The words on both sides of a place."""
    return words[max(0, i - CONTEXT) : i] + words[i + 1 : i + CONTEXT + 1]


def features(words: list[str], hits: dict[str, tuple[float, int]], context: Context) -> list[float]:
    """Sums over the hits of one text, and what the words and marks around them say."""
    found = [(i, *hits[w]) for i, w in enumerate(words) if w in hits] if hits else []
    if not found:
        return [0.0] * len(FEATURES)
    total = best = said = quoted = fuzzy = 0.0
    harshest = -SAYS
    for i, weight, k in found:
        says = max(-SAYS, min(SAYS, sum(context[w] for w in set(around(words, i)) if w not in hits))) if context.odds else 0.0
        total += weight
        best = max(best, weight)
        said += says
        harshest = max(harshest, says)
        quoted += bool(_QUOTE.search(" ".join(words[max(0, i - CONTEXT) : i + 1])) and _QUOTE.search(" ".join(words[i : i + CONTEXT + 1])))
        fuzzy += k > 0
    n = len(found)
    return [1.0, math.log1p(total), best, math.log1p(100 * total / len(words)), said / n, harshest, quoted / n, fuzzy / n]


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray  # of the features, then the bias
    context: dict[str, float] = field(default_factory=dict)  # log odds of the words around hits

    def __post_init__(self) -> None:
        self._context = Context(self.context)

    def rows(self, texts: list[str]) -> np.ndarray:
        words = [_WORD.findall(t) for t in texts]
        hits = {w: (self.lexicon.weight(x), x[1]) for w, x in self.lexicon.look_up(set().union(*words)).items()}
        return np.array([features(ws, hits, self._context) for ws in words], dtype=np.float64).reshape(-1, len(FEATURES))

    def score(self, texts: list[str]) -> np.ndarray:
        z = self.rows(texts) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights and bias by Newton steps with a ridge on the weights."""
    x = np.hstack((x, np.ones((len(x), 1))))
    w, pull = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, x.T @ (p - y) + pull @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learn lexicon and weights from ``labels(key, label)``, of which at most ``sample`` keys are used.

    The driver gets the terms, the words that tell around hits and one row of features for each sampled key. Conflicting labels of a document count as
    toxic; of several texts of a key the first in order is read. Null keys and labels teach nothing. Without toxic
    documents the lexicon is empty and every score is the same.
    """
    spark = docs.sparkSession
    taught = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).cast("long").alias("_k")).agg(F.max(F.col(label).cast("int")).alias("y"))
    taught = taught.orderBy(F.xxhash64("_k"), "_k").limit(sample)
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(taught), F.col("k") == F.col("_k")).groupBy("k").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    rows = written(rows.select("text", "y"), "labelled")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: list[Counter] = [Counter(), Counter()]
            for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                seen[int(y > 0)].update({folded(w) for w in set(_WORD.findall(t))})
            both = [w for w in seen[0].keys() | seen[1].keys() if w]
            yield pa.RecordBatch.from_arrays([pa.array(both, pa.string()), *(pa.array([s[w] for w in both], pa.int64()) for s in seen)], names=["term", "clean", "toxic"])

    n = {r["y"]: r["n"] for r in rows.groupBy(F.expr("int(y > 0)").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    a, b = F.col("toxic"), F.col("clean")
    odds = F.log((a + 0.25) / (n1 + 0.5)) - F.log((b + 0.25) / (n0 + 0.5))
    base = (n1 + 0.5) / (n1 + n0 + 1)
    evidence = a * F.log(a / ((a + b) * base)) + b * F.log(F.greatest(b, F.lit(1)) / ((a + b) * (1 - base)))
    counts = rows.mapInArrow(words, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    best = counts.where("toxic > 0 and length(term) > 2").select("term", odds.alias("odds"), evidence.alias("evidence")).where((F.col("odds") >= LOG_ODDS) & (F.col("evidence") >= EVIDENCE))
    terms = {r["term"]: (r["odds"], 1.0) for r in best.orderBy(F.desc("evidence"), "term").collect()}

    sent = _sent(spark, terms, np.zeros(len(FEATURES) + 1), {})

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In how many documents a term is misspelled (kind 0), a word stands around a hit (1), there is a hit at all (2)."""
        m = _model(sent)
        for b in batches:
            seen: list[Counter] = [Counter(), Counter()]
            words_of = [_WORD.findall(t) for t in b.column("text").to_pylist()]
            hits = m.lexicon.look_up(set().union(*words_of))
            for ws, y in zip(words_of, b.column("y").to_pylist(), strict=True):
                own = hits.keys() & set(ws)
                if not own:
                    continue
                near = {folded(w) for i, w in enumerate(ws) if w in own for w in around(ws, i) if w not in hits}
                seen[int(y > 0)].update({(0, hits[w][0]) for w in own if hits[w][1]} | {(1, w) for w in near if w} | {(2, "")})
            both = sorted(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in both], pa.int32()), pa.array([t for _, t in both], pa.string()), *(pa.array([s[x] for x in both], pa.int64()) for s in seen)], names=["kind", "term", "clean", "toxic"])

    counts = written(rows.mapInArrow(met, "kind int, term string, clean long, toxic long").groupBy("kind", "term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "around")
    # a misspelling weighs what documents with one tell; unseen ones are thought to be mostly meant
    lift = math.log((n0 + 0.5) / (n1 + 0.5))
    found = {r["term"]: (r["toxic"], r["clean"]) for r in counts.where("kind = 0").collect()}
    for t, (w, _) in terms.items():
        toxic, clean = found.get(t, (0, 0))
        terms[t] = w, max(0.0, min(w, math.log((toxic + 1) / (clean + 0.15)) + lift))
    # what stands around a hit tells by how much oftener it does so in toxic documents than in others, if by more than chance
    n_hit = counts.where("kind = 2").first()
    h1, h0 = (n_hit["toxic"], n_hit["clean"]) if n_hit else (0, 0)
    share = (h1 + 0.5) / (h1 + h0 + 1)
    tells = a * F.log(F.greatest(a, F.lit(1)) / ((a + b) * share)) + b * F.log(F.greatest(b, F.lit(1)) / ((a + b) * (1 - share)))
    says = F.log((a + 0.5) / (h1 + 1.0)) - F.log((b + 0.5) / (h0 + 1.0))
    context = {r["term"]: r["says"] for r in counts.where("kind = 1").where(tells >= EVIDENCE).select("term", says.alias("says")).orderBy("term").collect()}
    model = Model(Lexicon(terms), np.zeros(len(FEATURES) + 1), context)
    weighed = _sent(spark, terms, model.weights, context)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(weighed)
        for b in batches:
            x = m.rows(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["y", "x"])

    got = rows.mapInArrow(measured, "y int, x array<double>").collect()
    if n.get(1) and n.get(0):
        model.weights = _logistic(np.array([r["x"] for r in got]), np.array([float(r["y"] > 0) for r in got]))
    return model


_MODELS: dict[str, Model] = {}


def _sent(spark: SparkSession, terms: dict[str, tuple[float, float]], weights: np.ndarray, context: dict[str, float]) -> object:
    return spark.sparkContext.broadcast((uuid.uuid4().hex, dict(terms), weights, context))


def _model(sent: object) -> Model:
    """The broadcast model, built once in each worker."""
    name, terms, weights, context = sent.value
    if name not in _MODELS:
        _MODELS.clear()
        _MODELS[name] = Model(Lexicon(terms), weights, context)
    return _MODELS[name]


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows (key, score, predicted) for every whole text: the probability of toxicity, and 1 from ``threshold`` on.

    Null and empty texts score as texts without hits. Repeated rows each keep a row; a null key stays null; other columns
    are left out, whatever their names; an empty table gives no rows. Of terms equally near, the one of greatest weight is
    taken, then the first in order.
    """
    sent = _sent(docs.sparkSession, model.lexicon.terms, model.weights, model.context)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(sent)
        for b in batches:
            texts = b.column("text").fill_null("")
            for lo, hi in text_slices(texts, 1 << 22):  # words are looked up together: smaller slices cost more
                p = m.score(texts[lo:hi].to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("key")[lo:hi], pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], names=[key, "score", "predicted"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{key}` long, score double, predicted int")
