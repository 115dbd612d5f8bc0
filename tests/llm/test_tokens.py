"""Token files, SentencePiece, chat formatting, the pipeline."""

import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from pyspark.sql import functions as F
from docflow.llm import chat, decontamination, quality, sentencepiece_bpe, token_count
from docflow.llm.common import written
from tests.llm.helpers import TEXTS, documents, words
from tests.llm.test_duplicates import _deduplicated, _fingerprint, _least
from tests.llm.test_filters import _base, fitted

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_encoding_equals_the_library(library):
    rng = random.Random(1)
    model = sentencepiece_bpe.Model.load(MODEL)
    letters = "abtheinor     ▁▁\n\t.,ÿ漢é🙂\x00aaabbb0123\u0301"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += [" " * n for n in range(40)] + ["a" * n for n in range(60)] + ["the" * 300, "aab" * 40, "<s> </s> <0x41> <unk>"]
    for t in texts:
        ids = library.encode(t)
        assert model.encode(t) == ids
        assert model.decode_text(ids) == library.decode(ids)


def test_long_unspaced_words_equal_the_library(library):
    rng = random.Random(2)
    model = sentencepiece_bpe.Model.load(MODEL)
    kinds = ["abtheinor", "ACGT", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "的一是不了人我在有他这漢é", "a", "ab", "aab", "esthrintion", "01", "\u0301e🙂\x00"]
    for letters in kinds:
        for n in (127, 128, 129, 160, 700, 5_000):
            for t in ("".join(rng.choice(letters) for _ in range(n)), (letters * n)[:n]):
                assert model.encode(t) == library.encode(t)
    syllables = ["the", "ing", "tion", "er", "in", "an", "re", "ed", "est", "ment", "ly", "un", "con"]
    t = "".join(rng.choice(syllables) for _ in range(60_000))
    begun = time.perf_counter()
    assert model.encode(t) == library.encode(t)
    t = "".join(rng.choice(kinds[2]) for _ in range(200_000))
    assert model.encode(f"{t} and {t[:300]}") == library.encode(f"{t} and {t[:300]}")
    assert model.encode(" " * 50_000) == library.encode(" " * 50_000)
    assert time.perf_counter() - begun < 60  # seconds; a merge a round would take many minutes


def test_encoding_of_tables(spark, library):
    got = sentencepiece_bpe.encode(documents(spark), MODEL, with_ids=True, with_text=True).collect()
    want = []
    for i, t in TEXTS:
        ids = library.encode(t or "")
        text = library.decode(ids)
        want.append((i, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), text)), ids, text))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert sentencepiece_bpe.encode(documents(spark).limit(0), MODEL).count() == 0


def test_separator_scan_over_blocks(spark):
    rng = random.Random(4)
    for name, n in (("a", 50), ("b", 3), ("c", 0)):
        lengths = [rng.choice([0, 1, 2, 7, 40]) for _ in range(n)]
        flat = np.array([x for k in lengths for x in [*([5] * k), 9]] + [5] * (3 if name == "b" else 0), dtype="<u2")
        rows = [(name, k, bytearray(flat[k * 8 : k * 8 + 8].tobytes())) for k in range(-(-len(flat) // 8))]
        df = spark.createDataFrame([*rows, *rows[:1]], "file string, block long, tokens binary")
        got = [(r["nth"], r["n_tokens"]) for r in token_count.count(df, end=9, block=8).orderBy("nth").collect()]
        assert got == list(enumerate(lengths + [3] * (name == "b")))


def test_token_files_on_disk(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(np.array([1, 2, 9, 9, 3, 9], dtype="<u2").tobytes() + b"\x09")
    (tmp_path / "none.bin").write_bytes(b"")
    blocks = token_count.read_files(spark, str(tmp_path), block=4)
    assert [r["n_tokens"] for r in token_count.count(blocks, end=9, block=4).orderBy("nth").collect()] == [2, 0, 1]


def test_token_files_beyond_two_gigabytes(spark, tmp_path):
    # sparse on disk; ids of four bytes, separators at a few far places
    places, n = [5, 1_000_000, 400_000_000, 599_999_999], 600_000_000
    with open(tmp_path / "large.bin", "wb") as f:
        f.truncate(4 * n)
        for p in places:
            f.seek(4 * p)
            f.write(np.uint32(70_000).tobytes())
    block = 1 << 22
    blocks = token_count.read_files(spark, str(tmp_path), width=4, block=block)
    assert blocks.select("file", "block").distinct().count() == -(-n // block)
    got = [r["n_tokens"] for r in token_count.count(blocks, end=70_000, block=block, width=4).orderBy("nth").collect()]
    assert got == [5, 999_994, 398_999_999, 199_999_998]


def test_wide_ids(spark, tmp_path):
    import base64

    # a vocabulary whose ids don't fit into 16 bits
    path = tmp_path / "wide.tiktoken"
    path.write_text("".join(f"{base64.b64encode(bytes([b])).decode()} {b + 70_000}\n" for b in range(256)))
    assert token_count.width_of(str(path)) == 4
    got = token_count.document_counts(documents(spark), str(path), public_tokenizers.PATTERN).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((i, len((t or "").encode())) for i, t in TEXTS), key=repr)
    assert token_count.document_counts(documents(spark).limit(0), str(path), public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError, match="70001"):
        token_count.write_files(documents(spark), str(path), public_tokenizers.PATTERN, str(tmp_path / "no"), end=70_001)


def test_written_files_are_flat(spark, tmp_path):
    """What the query reads is nothing but ids: the files are those of plain Python, in the order of their keys."""
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=token_count.ranks(path), special_tokens={})
    texts = [(i, t) for i, t in TEXTS if i not in (None, 1)]
    held = token_count.write_files(documents(spark, texts).repartition(3), path, public_tokenizers.PATTERN, f"{tmp_path}/a b%20/f").collect()
    for file in {r["file"] for r in held}:
        keys = [k for r in sorted((r for r in held if r["file"] == file), key=lambda r: r["first"]) for k in r["keys"]]
        want = [x for k in keys for x in [*own.encode_ordinary(dict(texts)[k] or ""), token_count.END]]
        assert np.fromfile(f"{tmp_path}/a b%20/f/{file}", "<u2").tolist() == want
    (tmp_path / "a b%20" / "f" / "lost.bin").write_bytes(b"\1\0")
    counts = token_count.count(token_count.read_files(spark, f"{tmp_path}/a b%20/f", block=64), block=64, repeated=False)
    assert counts.where("file not like '%lost.bin'").agg(F.sum("n_tokens")).first()[0] == sum(len(own.encode_ordinary(t or "")) for _, t in texts)


def test_document_counts(spark):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=token_count.ranks(path), special_tokens={})
    got = [tuple(r) for r in token_count.document_counts(documents(spark), path, public_tokenizers.PATTERN).collect()]
    assert sorted(got, key=repr) == sorted(((i, len(own.encode_ordinary(t or ""))) for i, t in TEXTS), key=repr)


def test_preferences(spark):
    turn = "array<struct<role:string,text:string>>"
    a, b, c = ("user", "q"), ("assistant", "yes"), ("assistant", "no!")
    rows = [(1, [a, b], [a, c]), (2, [a, b], [a, b]), (3, None, [a]), (4, [], []), (5, [a, b, a, c], [a, b]), (6, [("user", None)], [("user", None)])]
    got = {r["conv_id"]: r for r in chat.preferences(spark.createDataFrame(rows, f"conv_id long, chosen {turn}, rejected {turn}")).collect()}
    q, yes, no = "<|user|>\nq<|end|>\n", "<|assistant|>\nyes<|end|>\n", "<|assistant|>\nno!<|end|>\n"
    assert {k: (r["n_prompt_turns"], r["prompt"], r["chosen"], r["rejected"]) for k, r in got.items() if k < 6} == {1: (1, q, yes, no), 2: (2, q + yes, "", ""), 3: (0, "", "", q), 4: (0, "", "", ""), 5: (2, q + yes, q + no, "")}
    spans = [tuple(s) for s in got[5]["chosen_scored"]]
    assert [got[5]["chosen"][s : s + n] for s, n in spans] == ["no!<|end|>\n"]
    assert got[6]["n_prompt_turns"] == 1


def _sides(key, turns):
    """The turns of the rejected side, from those (role, text) of a conversation."""
    k = key or 0
    at = [i for i, (r, _) in enumerate(turns) if r == "assistant"]
    if not at:
        return turns
    nth = (0, len(at) // 2, len(at) - 1)[k % 3]
    said, other = turns[at[nth]][1], turns[at[(nth + 1) % len(at)]][1]
    rest = [] if k % 4 == 2 else turns[at[nth] + 1 :] + [("user", "Try again.")] * (k % 4 == 3)
    return [*turns[: at[nth]], ("assistant", "" if said == other else other), *rest]


def test_stale_pairs(spark):
    rng = random.Random(8)
    rows = [(k, i, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["a", "b", "", "c"])) for k in range(60) for i in range(rng.randint(1, 9))]
    rows += [(200, 0, "user", "only"), (201, 0, "assistant", "x"), (201, 0, "assistant", "x"), (None, 0, "user", None), (None, 1, "assistant", "n")]
    convs = chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    plain = lambda ts: [tuple(t) for t in ts]
    got = [(r["conv_id"], plain(r["chosen"]), plain(r["rejected"])) for r in chat.stale_pairs(convs).collect()]
    whole = [(r["conv_id"], plain(r["turns"])) for r in convs.collect()]
    assert sorted(got, key=repr) == sorted(((k, ts, _sides(k, ts)) for k, ts in whole), key=repr)
    # the common prefix ends in many places, not only before the last answer
    common = [next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) for _, a, b in got]
    last = [max((i for i, (r, _) in enumerate(a) if r == "assistant"), default=len(a)) for _, a, _ in got]
    assert sum(c < z for c, z in zip(common, last, strict=True)) > 15


def test_preferences_equal_plain_python(spark):
    rng = random.Random(3)
    turn = "array<struct<role:string,text:string>>"
    one = lambda: (rng.choice(["user", "assistant", "system"]), rng.choice(["", "a", "b", "漢🙂", "x" * 5_000]))
    rows = []
    for k in range(400):
        head = [one() for _ in range(rng.randint(0, 6))]
        rows.append((k, *(head + [one() for _ in range(rng.randint(0, 4))] for _ in range(2))))
    rows += rows[:5] + [(None, [one()], [])]
    pairs = spark.createDataFrame([(*r, 0, "") for r in rows], f"conv_id long, chosen {turn}, rejected {turn}, n_prompt_turns int, prompt string")
    shown = lambda ts: "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in ts)

    def scored(ts):
        at, spans = 0, []
        for r, t in ts:
            if r == "assistant":
                spans.append((at + len(r) + 5, len(t) + 8))
            at += len(r) + len(t) + 13
        return spans

    want = []
    for k, a, b in rows:
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        want.append((k, n, shown(a[:n]), shown(a[n:]), shown(b[n:]), scored(a[n:]), scored(b[n:])))
        assert all(shown(a[n:])[s : s + z].endswith("<|end|>\n") for s, z in scored(a[n:]))
    got = [(*tuple(r)[:5], [tuple(s) for s in r["chosen_scored"]], [tuple(s) for s in r["rejected_scored"]]) for r in chat.preferences(pairs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert chat.preferences(pairs.limit(0)).count() == 0
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string, chosen int, n int")
    assert chat.preferences(chat.stale_pairs(chat.conversations(empty))).count() == 0


def test_pipeline_equals_plain_python(spark, tmp_path, library):
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(300)]
    item = " ".join(rng.choice(vocabulary) for _ in range(30))
    passage = " ".join(rng.choice(vocabulary) for _ in range(40))
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(15, 120)))) for i in range(40)]
    rows += [(50, rows[3][1]), (51, rows[4][1] + " tail"), (52, rows[5][1] + " " + item), (53, "junk " * 40), (54, None), (55, "")]
    rows += [(60 + k, rows[k][1][::-1] + " " + passage) for k in range(6, 12)]
    docs = documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    scored = quality.judge(docs, quality.log_ratios(docs, labels)).collect()
    least = fitted(r["score"] for r in scored if r["doc_id"] is not None and r["doc_id"] < 40 and not r["base_failed"])
    passed = {r["doc_id"] for r in scored if r["score"] >= least - 1e-12}
    now = [(i, t) for i, t in rows if not _base(t)[-1] and i in passed]
    fps, heads = {i: _fingerprint(t) for i, t in now}, {}
    for i in sorted(fps):
        heads[i] = min((heads[j] for j in heads if (fps[i] ^ fps[j]).bit_count() <= 4), default=i)
    now = [(i, t) for i, t in now if heads[i] == i]
    texts = dict(now)
    now = [(i, texts[i] if not gone else " ".join(kept)) for i, n, gone, kept in _deduplicated(now) if not gone or gone < n]
    p = decontamination.normalised(item)
    now = [(i, t) for i, t in now if _least(p, decontamination.normalised(t)) > int(decontamination.ERROR_RATE * len(p))]
    assert [r[0] for r in got] == sorted(i for i, _ in now)
    # cuts keep the separators in front of them, so texts are compared by their words
    again = {r["doc_id"]: r["text"] for r in _before_last(spark, tmp_path).collect()}
    assert {i: words(t) for i, t in again.items()} == {i: words(t) for i, t in now}
    assert got == sorted((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()) for i, t in again.items() for ids in [library.encode(t)])


def test_near_duplicates_of_an_id_with_two_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    # 7 has a copy of 5's text and one of its own; 8 has two texts and a repeated row
    rows = [(5, a), (7, a), (7, b), (8, c), (8, c[::-1]), (8, c), (9, c), (None, a)]
    got = corpus_pipeline.one_of_each(spark, documents(spark, rows), "").select("doc_id", "text").collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted([(5, a), (7, b), (8, c), (8, c[::-1]), (None, a)], key=repr)


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, repeats, long texts, empty tables and columns with the stages' own names."""
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [*TEXTS, (20, f"{passage} one"), (21, f"{passage} two"), (20, f"{passage}  one"), (None, None), (22, passage)]
    docs = documents(spark, rows).withColumns({c: F.lit(7) for c in ("_n", "_", "kept", "n_removed", "row", "component")})
    docs = docs.withColumns({"of": F.create_map(F.lit("a"), F.lit(1)), "some": F.array(F.lit(1), F.lit(None)), "raw": F.lit(b"x"), "in": F.struct(F.create_map(F.lit(1), F.lit("b")).alias("m"))})
    spark.createDataFrame([(8, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, f"{passage} one"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, str(tmp_path))
        assert made.columns == docs.columns
        got = made.collect()
        assert got and all(r["_n"] == 7 and r["key"] == -1 and (r["of"], r["some"], r["raw"], r["in"]["m"]) == ({"a": 1}, [1, None], b"x", {1: "b"}) for r in got)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        ids = [r["doc_id"] for r in got]
        if name == names[1]:
            # 20 has a row whose text differs in blanks only: the first in order stays
            assert sorted((r["doc_id"], r["text"]) for r in got if r["doc_id"] == 20) == [(20, f"{passage}  one")]
            assert ids.count(None) == 2 and ids.count(1) == 1
        if name == names[2]:
            assert ids.count(3) == 1 and 22 not in ids and ids.count(None) == 2
        if name == names[3]:
            assert not {20, 21, 22} & set(ids) and ids.count(3) == 1


def _before_last(spark, path):
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, docs, str(path)), name)
        assert after.columns == docs.columns
        docs = after
    return docs


def test_quality_stage_trusts_all_that_are_labelled_good(spark, tmp_path, monkeypatch):
    n = 20_400
    word = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.concat(F.lit("w"), F.xxhash64("id", i) % 300))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.array_join(word, " ").alias("text"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 200 == 1, 0).otherwise(1).alias("quality"))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(quality, "MARGIN", 0)
    monkeypatch.setattr(quality, "QUANTILE", 0.5)
    got = {r["doc_id"] for r in corpus_pipeline.good_quality(spark, docs, str(tmp_path)).collect()}
    judged = quality.judge(docs, quality.log_ratios(docs, labels)).collect()
    least = np.median([r["score"] for r in judged if r["doc_id"] % 200 != 1])
    assert got == {r["doc_id"] for r in judged if r["score"] >= least}
