"""Corpus cleaning in five stages, each written as Parquet and read again.

Stage functions take (spark, docs, sf_dir). All but the last return the columns of ``documents``; what a stage rejects is
gone for the stages after it. The near-duplicate stage works on 4-word shingles and fingerprints of 64 bits, as its operator does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.llm import decontamination, quality, sentencepiece_bpe, simhash, substring_dedup
from docflow.llm.common import removed, scratch, table, written
from docflow.llm.queries import tokenizer
from docflow.storage import spread

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the log-likelihood threshold, judged on the corpus this stage gets.

    Null and empty texts go, as all of under 20 words do. Rows without id and repeated rows are judged as any other. Each row is
    judged once; the threshold is that of all documents of this corpus that are labelled good.
    """
    labels = table(spark, sf_dir, "labels")
    judged = written(quality.judge(docs, quality.log_ratios(docs, labels), keep=tuple(docs.columns), nested="row"), "judged")
    return quality.verdicts(judged, quality.fitted(judged, labels)).where("kept").select("row.*").select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of smallest id, once. Rows without id stay.

    Where an id has several texts, each is judged by its own fingerprint; of those in one group that of least fingerprint
    stays, and of rows that share id and fingerprint that of least text. Null and empty texts are one group. Columns may be
    of any kind.
    """
    rows = simhash.fingerprints(docs, keep=tuple(docs.columns)).withColumn("row", F.struct(F.xxhash64("rest.text").alias("hash"), F.monotonically_increasing_id().alias("nth")))
    rows = written(rows, "fingerprinted")
    found = simhash.grouped(rows).where("doc_id = component")
    heads = found.groupBy("part").agg(F.min("doc_id").alias("doc_id"), F.min("fp").alias("fp")).select("doc_id", "fp")
    # chosen by numbers alone, so that the texts travel once
    kept = rows.select("doc_id", "fp", "row").join(heads, ["doc_id", "fp"], "left_semi").groupBy("doc_id", "fp").agg(F.min("row").alias("row"))
    named = rows.join(kept.select("row.nth"), F.col("row.nth") == F.col("nth"), "left_semi")
    return named.select("rest.*").unionByName(rows.where("doc_id is null").select("rest.*")).select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows that occur earlier; documents of which nothing is left go. ``n_chars`` follows.

    Null texts and those of under 20 words stay as they are. A missing id counts as the smallest.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = substring_dedup.deduplicate(docs, keep=others).where("n_removed = 0 or n_removed < n_words")
    made = {c: F.col("rest")[c] for c in others} | {"doc_id": F.col("doc_id"), "text": F.col("kept")}
    if "n_chars" in others:
        made["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(made["n_chars"]).cast("long")
    return cut.select(*[made[c].alias(c) for c in docs.columns])


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null and empty texts stay, and all documents if there is no benchmark."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digests of the token ids of each text, and of the text they decode to; null texts are empty."""
    return sentencepiece_bpe.encode(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", good_quality),
    ("simhash_near_dedup", one_of_each),
    ("substring_dedup", without_repeats),
    ("benchmark_decontamination", uncontaminated),
    ("sentencepiece", tokens),
]
#: The shingle hash of the near-duplicate stage and the tokenizer are not SQL; a test compares with plain Python.
ORACLE_SQL = None


def stage_written(spark: SparkSession, docs: DataFrame, sf_dir: str, name: str, stage: Stage) -> DataFrame:
    """A stage's result as a table of the shared folder; tables of its own that it has read are gone."""
    with scratch(spark):
        return written(stage(spark, docs, sf_dir), name, kept=True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; the first four are written to the shared folder and read again.

    What they have written on the way is deleted, but for the table that the last stage reads.
    """
    docs = None
    for name, stage in STAGES[:-1]:
        before, docs = docs, stage_written(spark, spread(table(spark, sf_dir, "documents")) if docs is None else docs, sf_dir, name, stage)
        if before is not None:
            removed(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
