"""Cutting lineage: intermediate tables that survive the loss of an executor.

Iterative operators write each round to the shared checkpoint folder and read
it back.  The folder is the one the cluster names in ``spark.checkpoint.dir``;
only a local session (tests) may fall back to a temporary folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

_local_folders: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """This application's own folder below the checkpoint folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = _local_folders.setdefault(
            spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-reqsift-")
        )
    return f"{named.rstrip('/')}/reqsift-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, **options) -> DataFrame:
    """Write ``df`` as parquet under the checkpoint folder and return the table read back.

    Unlike a cached plan the result has no lineage to recompute, and its file
    sizes give the optimizer true statistics for its join choices.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Use every core when a source has fewer splits than the cluster has cores, or uneven ones.

    A small table in one file would be worked on by one task, and a file of few row groups
    by as many, however many splits it has: all but those with a group's middle are empty.
    A source whose splits hold a like number of rows stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    # Counted from the footers, as no column is read.
    held = df.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
    if not held[1] or held[0] * cores <= 2 * held[1]:
        return df
    return df.repartition(max(cores, df.rdd.getNumPartitions()))
