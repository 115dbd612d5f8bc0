"""Exact dedup against a persistent index of digests, in DataFrame functions only.

The index is a table on disk, bucketed and sorted by the SHA-256 of the normalised text. New data are reduced to one row a
digest, joined to the index bucket by bucket by a sort-merge anti-join, and what the index does not have is appended. The
index is never shuffled, and of the texts only their digests are.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import fresh_dir
from .common import buckets, leaving, table, written

_BLANKS = r"[\x20\x09-\x0D]+"
#: A digest is common if it has more than this share of an even partition's rows; so there are few common ones.
_SHARE = 4


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", batch: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (key, digest, row, batch), and ``rest`` with the columns in ``keep`` if any: one for each document.

    A text is compared after each run of blanks has become one blank; null counts as empty, and a text of blanks alone is one
    blank, which is not empty. ``row`` tells repeated rows apart; it holds for this table only once that is written. Batches
    came in the order of their names. Columns of other names are left out, whatever they are called.
    """
    plain = F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), _BLANKS, " ")
    rest = [F.struct(*[F.col(c) for c in keep]).alias("rest")] if keep else []
    return docs.select(F.col(key).cast("long").alias(key), F.unhex(F.sha2(plain, 256)).alias("digest"), F.monotonically_increasing_id().alias("row"), (F.lit("0") if batch is None else batch).alias("batch"), *rest)


class Index:
    """Digests that have been seen: (digest, keep_id, batch), in as many buckets as the index was made with.

    ``path`` lies in a folder that driver and executors share. It is opened again by its path, in this or a later session; the
    number of buckets is read from there. Batches are added one at a time.
    """

    def __init__(self, spark: SparkSession, path: str, n: int | None = None) -> None:
        self.spark = spark
        meta = f"{path}/_buckets"
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(meta)
        if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            n = spark.read.schema("n int").json(meta).first()["n"]
        else:
            n = n or buckets(spark, 1)
            spark.range(1).select(F.lit(n).alias("n")).coalesce(1).write.json(meta)
        self.n = n
        self.name = "digests_" + hashlib.md5(path.encode()).hexdigest()
        where = f"{path}/rows".replace("'", r"\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {n} BUCKETS LOCATION '{where}'")

    def rows(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def _dealt(self, found: DataFrame) -> DataFrame:
        """One row a digest, dealt as the index is; a grouping into as many partitions is so already."""
        return found if buckets(self.spark, 1) == self.n else found.repartition(self.n, "digest")

    def add(self, rows: DataFrame, key: str = "doc_id") -> None:
        """Append the digests of a batch that the index has not; of equal ones the row of smallest key stands for all.

        A batch that is added again adds nothing, so a job that was lost is simply run again. Null keys come after all others.
        """
        new = self._dealt(rows.groupBy("digest").agg(F.min(_place(key)).alias("first")))
        # an anti-join in the form of an outer join without a match: the optimizer would move the other form below the grouping,
        # and then all copies of a text would travel to the index instead of one row
        known = self.rows().select(F.col("digest").alias("known")).hint("merge")
        new = new.join(known, F.col("digest") == F.col("known"), "left").where("known is null")
        new.select("digest", F.col("first.key").alias("keep_id"), F.col("first.batch").alias("batch")).write.insertInto(self.name)

    def resolve(self, rows: DataFrame, key: str = "doc_id") -> DataFrame:
        """Rows (key, keep_id, group_size, kept, text_sha256, rest) of batches that have been added; every row has one.

        ``keep_id`` is the key that the index has for the text, ``group_size`` the number of equal rows in ``rows``. One row of
        them is kept, if the text was new with its batch. ``rows`` is read more than once, so it is to be a written table.
        """
        found = self._dealt(rows.groupBy("digest").agg(F.min(_place(key)).alias("first"), F.count(F.lit(1)).alias("group_size")))
        known = self.rows().withColumnRenamed("batch", "since").hint("merge")
        found = found.join(known, "digest").select("digest", "keep_id", "group_size", F.when(F.col("since") == F.col("first.batch"), F.col("first.row")).alias("stays"))
        found = written(found, "resolved")
        # fewer digests than that many partitions' shares can be common, so these are few enough to send; no other key is skewed
        most = rows.count() / (_SHARE * buckets(self.spark, 1))
        common = found.where(F.col("group_size") > most)
        named = rows.join(F.broadcast(common), "digest").unionByName(rows.join(F.broadcast(common.select("digest")), "digest", "left_anti").join(found.where(F.col("group_size") <= most).hint("merge"), "digest"))
        kept = F.coalesce(F.col("row") == F.col("stays"), F.lit(False))
        rest = ["rest"] if "rest" in rows.columns else []
        return named.select(key, "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), *rest)


def _place(key: str) -> Column:
    """What orders equal texts: the batch, the key (null last), the row."""
    return F.struct("batch", F.col(key).isNull().alias("none"), F.col(key).alias("key"), "row")


def deduplicate(docs: DataFrame, index: Index, batch: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents of a batch whose text neither the index nor an earlier row of the batch has; the index then has them.

    All columns are kept as they are. Null, empty and repeated rows are as in ``digests``; an empty batch gives no rows.
    """
    rows = written(digests(docs, key, text, F.lit(batch), tuple(docs.columns)), "batch")
    index.add(rows, key)
    return index.resolve(rows, key).where("kept").select("rest.*").select(*docs.columns)


def equal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (doc_id, keep_id, group_size, kept, text_sha256) of all ``documents``, by an index that takes them in two batches.

    The batches meet at a middle id, so a row of the second finds the equal texts of smaller ids in the index. Rows without
    an id come last. An empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    rows = written(digests(docs), "digests")
    middle = rows.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    rows = rows.withColumn("batch", F.when(F.col("doc_id") <= F.lit(middle).cast("long"), "1").otherwise("2"))
    path = fresh_dir(spark, "digest-index")
    index = Index(spark, path)
    leaving(spark, path)  # the query's index is its own; one that is to persist has a path of its user's
    for batch in ("1", "2"):
        index.add(rows.where(F.col("batch") == batch))
    return index.resolve(rows)
