from types import SimpleNamespace

import pytest

from pyspark.sql import functions as F

from reqsift.workspace import folder, spread


def session(master, named=None):
    conf = SimpleNamespace(get=lambda key, default: named or default)
    return SimpleNamespace(
        conf=conf, sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}")
    )


def test_the_named_folder_is_used():
    assert folder(session("yarn", "hdfs://shared/")) == "hdfs://shared/reqsift-app-yarn"


def test_only_a_local_session_may_fall_back():
    assert folder(session("local[2]")) == folder(session("local[2]"))
    with pytest.raises(RuntimeError):
        folder(session("yarn"))


def test_a_file_of_one_row_group_is_dealt_to_all_cores(spark, tmp_path):
    spark.range(200_000).withColumn("x", F.sha2(F.col("id").cast("string"), 256)).coalesce(1).write.parquet(f"{tmp_path}/t")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500k")
    try:
        table = spark.read.parquet(f"{tmp_path}/t")
        assert table.rdd.getNumPartitions() > 8
        held = [r["count"] for r in spread(table).groupBy(F.spark_partition_id()).count().collect()]
        assert sum(held) == 200_000 and max(held) < 50_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
