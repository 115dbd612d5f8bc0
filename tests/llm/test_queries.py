"""The registered queries on small tables against plain Python: wiring, held-out rows, digests."""

import hashlib
import random
import zlib

import public_tokenizers
import pytest
import sentencepiece

from docflow.llm import decontamination, queries, token_count
from tests.llm.helpers import TEXTS, documents
from tests.llm.test_duplicates import _fingerprint, _least
from tests.llm.test_filters import _base, fitted

RNG = random.Random(17)
PLAIN = ["river", "stone", "walks", "green", "under", "house", "seven", "light", "metsä", "kuu"]
ITEM = " ".join(RNG.choice(PLAIN) for _ in range(25))


def _text(i):
    w = [RNG.choice(PLAIN) for _ in range(RNG.randint(15, 50))]
    if i % 4 == 0:
        for _ in range(3):
            w[RNG.randrange(len(w))] = RNG.choice(["blockhead", "nincompoop"])
    return " ".join(w)


ROWS = [*TEXTS, *((i, _text(i)) for i in range(100, 400)), (500, f"x {ITEM} y"), (501, ITEM.upper())]
LANGS = {i: "aa" if (i or 0) % 2 else "bb" for i, _ in ROWS}


def _tables(spark, path, rows=ROWS, labels=None, langs=LANGS):
    docs = documents(spark, rows).drop("lang")
    named = spark.createDataFrame(list(langs.items()), "id long, lang string")
    docs.join(named, docs["doc_id"].eqNullSafe(named["id"]), "left").drop("id").write.parquet(f"{path}/documents.parquet")
    labels = labels if labels is not None else [(i, 1, int(i % 4 == 0)) for i in range(100, 400)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "?")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    return _tables(spark, tmp_path_factory.mktemp("tables"))


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_op2(spark, tables):
    p = decontamination.normalised(ITEM)
    want = []
    for i, t in ROWS:
        if t and len(t) < 10_000:
            d = _least(p, decontamination.normalised(t))
            if d <= int(decontamination.ERROR_RATE * len(p)):
                want.append((i, 1, d))
    assert {(500, 1, 0), (501, 1, 0)} <= set(want)
    assert _sorted(queries.op2_decontamination(spark, tables).collect()) == _sorted(want)


def _held_out(i, modulus, remainder):
    return i is not None and zlib.crc32(str(i).encode()) % modulus == remainder


def test_op4(spark, tables, tmp_path):
    got = queries.op4_toxicity(spark, tables).collect()
    assert got[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"}
    assert sorted(((r["doc_id"], r["held_out"]) for r in got), key=repr) == sorted(((i, _held_out(i, 4, 2)) for i, _ in ROWS), key=repr)
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got)
    found = {r["doc_id"]: r["predicted"] for r in got}
    held = [i for i in range(100, 400) if _held_out(i, 4, 2)]
    assert held and all(found[i] == int(i % 4 == 0) for i in held)
    # labels of held-out rows teach nothing: the opposite ones change no score
    flipped = [(i, 1, int((i % 4 == 0) != _held_out(i, 4, 2))) for i in range(100, 400)]
    assert _sorted(queries.op4_toxicity(spark, _tables(spark, tmp_path, labels=flipped)).collect()) == _sorted(got)


def test_op5(spark, tables):
    got = queries.op5_quality_rules(spark, tables).collect()
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert _sorted([r[n] for n in names] for r in got) == _sorted([i, *_base(t)] for i, t in ROWS)
    least = fitted(r["score"] for r in got if 100 <= (r["doc_id"] or 0) < 400 and not r["base_failed"])
    assert all(r["kept"] == (not r["base_failed"] and r["score"] >= least - 1e-12) for r in got)
    assert any(r["kept"] for r in got)


def test_op6(spark, tables):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=token_count.ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert _sorted(queries.op6_token_counts(spark, tables).collect()) == _sorted((i, len(own.encode_ordinary(t or ""))) for i, t in ROWS)


def test_op7(spark, tables):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))) for i, t in ROWS for ids in [library.encode(t or "")]]
    assert _sorted(queries.op7_sentencepiece(spark, tables).collect()) == _sorted(want)


def test_op9(spark, tables):
    fps = {i: _fingerprint(t) for i, t in ROWS}
    part = {i: i for i in fps}
    for _ in fps:  # smallest ids travel along links until none moves
        moved = False
        for i in fps:
            low = min((part[j] for j in fps if (fps[i] ^ fps[j]).bit_count() <= 4), key=lambda k: (k is None, k))
            moved |= low != part[i]
            part[i] = low
        if not moved:
            break
    want = [(i, f"{fps[i]:016x}", part[i]) for i, _ in ROWS]
    assert _sorted(queries.op9_simhash(spark, tables).collect()) == _sorted(want)


def test_op10(spark, tables, tmp_path):
    got = queries.op10_language_id(spark, tables).collect()
    assert sorted(((r["doc_id"], r["held_out"]) for r in got), key=repr) == sorted(((i, _held_out(i, 3, 1)) for i, _ in ROWS), key=repr)
    assert {r["lang_pred"] for r in got} == {"aa", "bb", "und"}
    assert all((r["lang_pred"] == "und") == (not any(map(str.isalpha, dict(ROWS)[r["doc_id"]] or ""))) and 0 <= r["score"] <= 1 for r in got)
    # languages and texts of held-out rows teach nothing
    other = {i: "cc" if _held_out(i, 3, 1) else k for i, k in LANGS.items()}
    assert _sorted(queries.op10_language_id(spark, _tables(spark, tmp_path, langs=other)).collect()) == _sorted(got)
