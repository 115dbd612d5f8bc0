"""Documents that hold every odd case: nulls, empty and long texts, repeats, ties, columns with the operators' own names."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}x{i // 977}" for i in range(30_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from all of the other animals in the wood today"),
    (2, "the quick brown fox jumps over the lazy dog and runs away from all of the other animals in the wood today"),
    (3, None),
    (4, ""),
    (5, " \t\n\x0b\x0c\r "),
    (6, "a"),
    (7, "One line here.\nOne line here.\n\n \nOne line here.\n漢字 é\u00a0b ▁mark 🙂 \x00 end"),
    (8, LONG),
    (9, LONG + " tail"),
    (10, "x " * 60),
    (None, "a text without a key that has some twenty words or more so that a window of it may be found in it and counted"),
    (1, "The quick brown fox jumps over the lazy dog and runs away from all of the other animals in the wood today"),
]
#: Names that operators use inside or give out.
CLASHES = ["key", "words", "chunk", "rest", "fp", "score", "_k", "n_words", "part", "host"]


def documents(spark, rows=TEXTS):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(-1) for c in CLASHES})


def words(text):
    return WORD.findall(text or "")
