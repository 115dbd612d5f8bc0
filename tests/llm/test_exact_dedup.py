"""Exact dedup by a persistent index, against plain Python."""

import hashlib
import re

from pyspark.sql import functions as F

from docflow.llm import exact_dedup, queries
from docflow.llm.common import written
from tests.llm.helpers import CLASHES, TEXTS, documents

ROWS = [
    *TEXTS,
    (20, "same  words\there"),
    (21, "same words here"),
    (22, "same words here "),
    (19, "same\nwords \x0b here"),
    (None, "same words here"),
    (None, None),
    (40, " \n"),
    (41, "Same words here"),
    (42, "same words here"),
    *((100 + k, "a common line") for k in range(60)),
]


def _digest(t):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()


def _want(rows):
    """The multiset of (id, keep_id, size, digest), and how many rows of each digest stay: one."""
    groups = {}
    for i, t in rows:
        groups.setdefault(_digest(t), []).append(i)
    low = {d: min((i for i in ids if i is not None), default=None) for d, ids in groups.items()}
    return sorted(((i, low[_digest(t)], len(groups[_digest(t)]), _digest(t)) for i, t in rows), key=repr)


def _checked(got, rows):
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == _want(rows)
    stay = [r for r in got if r["kept"]]
    assert sorted(r["text_sha256"] for r in stay) == sorted({_digest(t) for _, t in rows})
    assert all(r["doc_id"] == r["keep_id"] for r in stay)


def test_op11(spark, tmp_path):
    documents(spark, ROWS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op11_exact_dedup(spark, str(tmp_path))
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    _checked(found.collect(), ROWS)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_op11_of_an_empty_table_and_of_rows_without_ids(spark, tmp_path):
    for name, rows in (("none", []), ("lone", [(None, "a"), (None, "a"), (None, None)])):
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        _checked(queries.op11_exact_dedup(spark, f"{tmp_path}/{name}").collect(), rows)


def test_batches_of_an_index_that_is_opened_again(spark, tmp_path):
    path = f"{tmp_path}/index's"
    first, second = documents(spark, ROWS[:14]), documents(spark, ROWS[10:])
    one = exact_dedup.deduplicate(first, exact_dedup.Index(spark, path, 3), "b1")
    assert one.columns == first.columns
    texts = [_digest(r["text"]) for r in one.collect()]
    assert sorted(texts) == sorted({_digest(t) for _, t in ROWS[:14]})
    # a later session knows the folder only, and has another number of shuffle partitions
    spark.sql(f"DROP TABLE {exact_dedup.Index(spark, path).name}")
    again = exact_dedup.Index(spark, path)
    assert again.n == 3
    two = [_digest(r["text"]) for r in exact_dedup.deduplicate(second, again, "b2").collect()]
    assert sorted(two) == sorted({_digest(t) for _, t in ROWS} - set(texts))
    before = again.rows().count()
    # a batch that is run again gives the same rows and adds nothing
    assert sorted(_digest(r["text"]) for r in exact_dedup.deduplicate(second, again, "b2").collect()) == sorted(two)
    assert again.rows().count() == before == len({_digest(t) for _, t in ROWS})
    assert exact_dedup.deduplicate(second.limit(0), again, "b3").count() == 0


def test_columns_of_any_kind_and_name_are_kept(spark, tmp_path):
    docs = documents(spark, ROWS).withColumns({"digest": F.lit("mine"), "row": F.create_map(F.lit("a"), F.lit(1)), "batch": F.array(F.lit(2)), "keep_id": F.lit(7), "group_size": F.lit(None).cast("binary")})
    got = exact_dedup.deduplicate(docs, exact_dedup.Index(spark, f"{tmp_path}/index"), "x")
    assert got.columns == docs.columns and set(CLASHES) < set(got.columns)
    assert all((r["digest"], r["row"], r["batch"], r["keep_id"]) == ("mine", {"a": 1}, [2], 7) for r in got.collect())


def test_the_index_is_joined_as_it_lies(spark, tmp_path):
    """The stored side has no exchange and no copies travel: what is joined to the index is one row a digest."""
    index = exact_dedup.Index(spark, f"{tmp_path}/index")
    rows = written(exact_dedup.digests(documents(spark, ROWS)), "rows")
    index.add(rows)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        new = index._dealt(rows.groupBy("digest").agg(F.min("row").alias("first"))).join(index.rows().select(F.col("digest").alias("known")).hint("merge"), F.col("digest") == F.col("known"), "left")
        plan = new._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
