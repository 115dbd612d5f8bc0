"""Fill-in-middle against plain Python, and back; rank and select against counting."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from docflow.llm import fim, queries
from tests.llm.helpers import TEXTS, documents

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
RNG = random.Random(23)
PIECES = ["wörd", "a", "漢字", "🙂", " ", "\n", "\t ", "<", "P>", "<S", "b́", " ", "\x00", "x<y"]
ROWS = [
    *TEXTS,
    *((k, "".join(RNG.choice(PIECES) for _ in range(RNG.randint(0, 40)))) for k in range(1000, 1300)),
    *((k, f"words and <{m}> more words") for k, m in zip(range(1300, 1330), "PSM" * 10, strict=True)),
    *((k, "one") for k in range(1330, 1350)),
    *((k, " ") for k in range(1350, 1370)),
    (-5, "negative keys draw as well"),
]


def _plain(i, text, rate=50, spm=80, seed=42):
    t = TOKEN.findall(text or "")
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    text = text or ""
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return i, len(t), "plain", text, None, None
    p, m, s = ("".join(x) for x in (t[:a], t[a:b], t[b:]))
    if h[3] % 100 < spm:
        return i, len(t), "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return i, len(t), "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def test_transformed_and_back(spark):
    docs = documents(spark, ROWS).withColumns({"n": F.lit("x"), "form": F.lit(1), "output": F.lit(None).cast("string"), "text2": F.col("text")})
    for rate, spm, seed in ((50, 80, 42), (100, 30, 7)):
        found = fim.transformed(docs, seed=seed, rate=rate, spm=spm)
        got = sorted((tuple(r) for r in found.collect()), key=repr)
        assert got == sorted((_plain(i, t, rate, spm, seed) for i, t in ROWS), key=repr)
        assert {r[2] for r in got} == {"plain", "psm", "spm"}
        back = found.select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("text")).collect()
        assert sorted((tuple(r) for r in back), key=repr) == sorted(((i, t or "") for i, t in ROWS), key=repr)
    assert fim.transformed(docs.limit(0)).count() == 0


def test_op13(spark, tmp_path):
    documents(spark, ROWS).write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(i, n, form, p, m, sha(out), sha(t or "")) for i, t in ROWS for _, n, form, out, p, m in [_plain(i, t)]]
    found = queries.op13_fim(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted(want, key=repr)


def test_rank_and_select():
    rng = np.random.default_rng(4)
    for n, share in ((1, 1.0), (63, 0.5), (64, 0.5), (512, 0.3), (513, 0.9), (5000, 0.01), (20_000, 0.5), (1024, 1.0)):
        flags = rng.random(n) < share
        bits = fim.Bits(flags)
        at = np.arange(n + 1)
        assert (bits.rank(at) == np.r_[0, np.cumsum(flags)]).all()
        ones = np.flatnonzero(flags)
        assert (bits.select(np.arange(len(ones))) == ones).all()
    assert fim.Bits(np.zeros(0, bool)).rank(np.zeros(3, np.int64)).tolist() == [0, 0, 0]


def test_texts_of_a_slice_do_not_meet(spark, monkeypatch):
    """A text that ends in blanks before one that begins with them: each has its own first token."""
    rows = [(1, "a "), (2, " b"), (3, ""), (4, " "), (5, None), (6, "\n"), (7, "c")] * 3
    for size in (1, 5, 1 << 20):
        monkeypatch.setattr(fim, "SLICE", size)
        got = sorted(tuple(r) for r in fim.transformed(documents(spark, rows)).select("doc_id", "n").collect())
        assert got == sorted((i, len(TOKEN.findall(t or ""))) for i, t in rows)
