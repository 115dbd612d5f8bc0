"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position gets a vector of r + 1 bits; the masks are, for each nonzero vector v, the positions whose vector has
an odd inner product with v. The at most r positions in which two fingerprints differ span less than the whole space, so
some v is orthogonal to all of them: the two agree on that mask. With 2^(r+1) - 1 tables no pair within the radius is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, string_buffers, text_slices, trimmed, word_spans, written

BITS, RADIUS, SHINGLE, SEED = 64, 4, 4, 42
#: Larger groups of fingerprints that agree on a mask are split by what they differ in, without losing a pair.
GROUP = 4096


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (key, fp), and ``rest`` with the columns in ``keep`` if any: the 64-bit SimHash of the word shingles of every whole text, as a signed long.

    A-Z lower-cased; shingles count as often as they occur; a text of fewer words is one shingle; without words (null and
    empty texts too) the fingerprint is zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for b in batches:
            texts = (b.column("rest").field(inner) if inner is not None else b.column("text")).fill_null("")
            for lo, hi in text_slices(texts, 1 << 20):
                raw, offsets = string_buffers(texts[lo:hi])
                starts, ends, first = word_spans(raw, offsets)
                # words of all rows, one space between them; bytes.lower and bytes.split know ASCII only, as asked for
                whole = b" ".join(b" ".join(texts[lo:hi].cast(pa.binary()).to_pylist()).lower().split())
                sizes = ends - starts
                at = np.cumsum(sizes + 1) - (sizes + 1)
                n_words = np.diff(first)
                n_sh = np.where(n_words >= shingle, n_words - shingle + 1, np.minimum(n_words, 1))
                bound = np.r_[0, np.cumsum(n_sh)]
                row = np.repeat(np.arange(hi - lo), n_sh)
                begin = first[:-1][row] + np.arange(len(row)) - bound[:-1][row]
                last = np.minimum(begin + shingle, first[1:][row]) - 1
                a, z = at[begin], at[last] + sizes[last]
                hashes = np.array([digest(whole[i:j], seed) for i, j in zip(a.tolist(), z.tolist(), strict=True)], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([b.column("key")[lo:hi], pa.array(_majority(hashes, bound).view(np.int64)), *([b.column("rest")[lo:hi]] if keep else [])], names=[key, "fp", *(["rest"] if keep else [])])

    # a text that is kept is not sent to the workers twice
    inner = keep.index(text) if text in keep and isinstance(docs.schema[text].dataType, T.StringType) else None
    sent = [] if inner is not None else [F.col(text).cast("string").alias("text")]
    rest = [F.struct(*[F.col(c) for c in keep]).alias("rest")] if keep else []
    rows = docs.select(F.col(key).cast("long").alias("key"), *sent, *rest)
    out = T.StructType([T.StructField(key, T.LongType()), T.StructField("fp", T.LongType()), *[f for f in rows.schema if f.name == "rest"]])
    return rows.mapInArrow(trimmed(run), out)


def _majority(hashes: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """For each slice of hashes, the bits set in over half of them."""
    out = np.zeros(len(bound) - 1, dtype=np.uint64)
    full = np.flatnonzero(np.diff(bound) > 0)
    if not len(full):
        return out
    starts, n = bound[:-1][full], np.diff(bound)[full]
    planes = hashes.view(np.uint8).reshape(-1, 8)
    for byte in range(8):
        bits = np.unpackbits(planes[:, byte : byte + 1], axis=1, bitorder="little")
        counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        set_ = np.packbits(2 * counts > n[:, None], axis=1, bitorder="little")[:, 0]
        out[full] |= set_.astype(np.uint64) << np.uint64(8 * byte)
    return out


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """2^(radius+1) - 1 masks; each pair of bit patterns within the radius agrees on all bits of at least one.

    Position i has the vector i modulo the nonzero vectors, plus one, so each mask has about half of the positions.
    """
    vectors = [i % (2 ** (radius + 1) - 1) + 1 for i in range(bits)]
    return [sum(1 << i for i, a in enumerate(vectors) if (a & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``fp`` that keep together all that chains of near pairs connect.

    Within each group of equal masked bits only a spanning forest is given out, not all pairs. Groups above ``group`` are
    dealt again by one of radius + 1 parts of the other bits (a pair within the radius agrees on one of them), and again
    by the next split, until they are small or no bit is left; so no task holds an unbounded group and no pair is lost.
    """
    spark = fps.sparkSession
    masks = covering_masks(radius)
    keys = F.array(*[F.struct(F.lit(len(masks) + t).cast("long").alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("k"), F.lit(signed(m)).alias("fixed")) for t, m in enumerate(masks)])
    rows = fps.select("fp", F.explode(keys).alias("e")).select("fp", "e.t", "e.k", "e.fixed")
    found = []
    while True:
        sizes = rows.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        large = written(sizes.where(F.col("n") > group).select("t", "k", F.lit(1).alias("large")), "large")
        some = large.limit(1).count() > 0
        marked = rows.join(large, ["t", "k"], "left") if some else rows.withColumn("large", F.lit(None).cast("int"))
        found.append(_near(marked.where("large is null").select("t", "k", "fp"), radius))
        if not some:
            break
        rows = _split(written(marked.where("large = 1"), "split"), radius)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _split(rows: DataFrame, radius: int) -> DataFrame:
    """Each row once for each part of its free bits: (t, k, fixed) narrowed by the bits of that part.

    The numbers t of the tables stay apart: a deeper table's is the upper table's times radius + 2, plus the part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ts, ks, fs, fp = (b.column(n).to_pylist() for n in ("t", "k", "fixed", "fp"))
            out: list[list] = [[], [], [], []]
            for t, _, f, x in zip(ts, ks, fs, fp, strict=True):
                fixed, bits = f & (2**64 - 1), x & (2**64 - 1)
                free = [i for i in range(64) if not fixed >> i & 1]
                parts = [sum(1 << i for i in free[p :: radius + 1]) for p in range(radius + 1)] if len(free) > radius else [sum(1 << i for i in free)]
                for p, part in enumerate(parts):
                    for column, value in zip(out, (x, t * (radius + 2) + p + 1, signed(bits & (fixed | part)), signed(fixed | part)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())], names=["fp", "t", "k", "fixed"])

    return rows.select("fp", "t", "k", "fixed").mapInArrow(run, "fp long, t long, k long, fixed long")


def _near(rows: DataFrame, radius: int) -> DataFrame:
    """Spanning links of each (t, k) group, from partitions sorted by group; groups are of bounded size here."""

    def forest(x: np.ndarray) -> list[tuple[int, int]]:
        got, left = [], x.copy()
        while len(left) > 1:
            todo, left = [left[0]], left[1:]
            while todo and len(left):
                u = todo.pop()
                near = np.bitwise_count(left ^ u) <= radius
                if near.any():
                    new = left[near]
                    got.extend((int(u), int(v)) for v in new)
                    todo.extend(new)
                    left = left[~near]
        return got

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(g: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
            same = g[1:] == g[:-1]
            first = np.flatnonzero(np.r_[True, ~same])
            size = np.diff(np.r_[first, len(g)])
            two = first[size == 2]
            close = two[np.bitwise_count(x[two] ^ x[two + 1]) <= radius]
            us, vs = x[close].view(np.int64).tolist(), x[close + 1].view(np.int64).tolist()
            for i, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                for u, v in forest(x[i : i + n]):
                    us.append(signed(u))
                    vs.append(signed(v))
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

        pending = (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        for b in batches:
            g = np.r_[pending[0], np.asarray(b.column("g"))]
            x = np.r_[pending[1], np.asarray(b.column("fp")).view(np.uint64)]
            whole = np.searchsorted(g, g[-1]) if len(g) else 0
            yield from flush(g[:whole], x[:whole])
            pending = (g[whole:], x[whole:])
        yield from flush(*pending)

    # groups may share a hash; what does is compared by all 64 bits all the same
    grouped = rows.select(F.xxhash64("t", "k").alias("g"), "fp").repartition("g").sortWithinPartitions("g", "fp")
    return grouped.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """Rows (key, fp, component): ``component`` is the smallest key reachable by links of ``radius`` bits at most.

    Copies are joined through their common fingerprint, so they are never expanded into pairs. A null key keeps its row
    and takes no part in the choice of the smallest. Repeated rows each keep a row; other columns are left out; an empty
    table gives no rows.
    """
    return groups(docs, key, text, radius).select(key, "fp", "component")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of ``near_duplicates`` and ``part``, which tells groups of the same smallest key apart."""
    return grouped(written(fingerprints(docs, key, text), "fingerprints"), key, radius)


def grouped(fps: DataFrame, key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """The rows of ``groups`` from a table (key, fp); it is read more than once, so it should be a written one."""
    reps = written(fps.groupBy("fp").agg(F.min(key).alias("rep")), "reps")
    near = links(reps.select("fp"), radius).distinct()
    ends = components(near)
    part = reps.join(ends, reps["fp"] == ends["node"], "left").select("fp", "rep", F.coalesce("component", "fp").alias("part"))
    low = written(part.groupBy("part").agg(F.min("rep").alias("component")), "names")
    named = part.join(low, "part").select("fp", "component", "part")
    return fps.select(key, "fp").join(named, "fp").select(key, "fp", "component", "part")
