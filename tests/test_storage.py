"""The shared folder, and small scans on all cores."""

from types import SimpleNamespace

import pytest

from docflow.storage import fresh_dir, shared_dir, spread


def _session(master, **conf):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, default=None: conf.get(k.replace(".", "_"), default)), sparkContext=SimpleNamespace(master=master))


def test_shared_folder():
    assert shared_dir(_session("yarn", spark_checkpoint_dir="hdfs://x/y/")) == "hdfs://x/y"
    assert shared_dir(_session("local[*]", spark_sql_warehouse_dir="file:/w/")) == "file:/w/_shared"
    assert shared_dir(_session("yarn", spark_sql_warehouse_dir="hdfs://x/w")) == "hdfs://x/w/_shared"
    for master in ("yarn", "spark://a:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_dir(_session(master, spark_sql_warehouse_dir="file:/w"))
    here = _session("local", spark_checkpoint_dir="c")
    assert fresh_dir(here, "a") != fresh_dir(here, "a") and fresh_dir(here, "a").startswith("c/a-")


def test_small_scans_are_dealt_to_all_cores(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.range(1000).repartition(8).write.parquet(str(tmp_path / "many"))
    n = spark.sparkContext.defaultParallelism
    small = spread(spark.read.parquet(str(tmp_path / "one")))
    assert small.rdd.getNumPartitions() == n and small.distinct().count() == 1000
    whole = spark.read.parquet(str(tmp_path / "many"))
    if whole.rdd.getNumPartitions() >= n:
        assert spread(whole) is whole
