"""Sequential numbers over a global order, without one task per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from reqsift.workspace import materialize


def number_rows(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Add ``name``: 1, 2, 3, … within ``group`` in the order of ``order``.

    A plain ``row_number`` over the group would sort a large group in one task.
    Here rows are range-partitioned by group and order, so a large group spans
    many partitions; each partition numbers its own part and adds the number of
    rows that earlier partitions hold.  The partitioned table is written out
    first, because range bounds are sampled and must not change between uses.
    ``order`` has to be unique within the group.
    """
    keys = [*group, *order]
    placed = materialize(
        df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id())
    )
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = (
        placed.groupBy(*group, "_part")
        .agg(F.count("*").alias("_rows"))
        .withColumn("_start", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .drop("_rows")
    )
    within = Window.partitionBy(*group, "_part").orderBy(*order)
    return (
        placed.withColumn("_local", F.row_number().over(within))
        .join(starts, [*group, "_part"])
        .withColumn(name, F.col("_start") + F.col("_local"))
        .drop("_part", "_local", "_start")
    )


def running_max(
    df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, name: str
) -> DataFrame:
    """Add ``name``: the largest ``value`` up to a row within ``group`` in the order of ``order``.

    Range-partitioned as in ``number_rows``: each partition takes its own largest so far
    and the largest of the partitions before it.
    """
    placed = materialize(
        df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id())
    )
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    before = (
        placed.groupBy(*group, "_part")
        .agg(F.max(value).alias("_most"))
        .withColumn("_before", F.max("_most").over(earlier))
        .drop("_most")
    )
    within = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        placed.withColumn("_own", F.max(value).over(within))
        .join(before, [*group, "_part"])
        .withColumn(name, F.greatest("_own", "_before"))
        .drop("_part", "_own", "_before")
    )


def running_sum(
    df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, name: str
) -> DataFrame:
    """Add ``name``: the sum of ``value`` up to and with a row within ``group`` in the order of ``order``.

    Range-partitioned as in ``number_rows``: each partition adds its own rows to the sum of
    the partitions before it.
    """
    placed = materialize(
        df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id())
    )
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    before = (
        placed.groupBy(*group, "_part")
        .agg(F.sum(value).alias("_sum"))
        .withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
        .drop("_sum")
    )
    within = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        placed.withColumn("_own", F.sum(value).over(within))
        .join(before, [*group, "_part"])
        .withColumn(name, F.col("_own") + F.col("_before"))
        .drop("_part", "_own", "_before")
    )


def record_id(project: Column, number: Column) -> Column:
    """``PROJECT-001``; wider than three digits from 1000 on."""
    return F.format_string("%s-%03d", F.upper(project), number)


def assign_ids(
    df: DataFrame, order: Sequence[str] = ("cand_order",), name: str = "requirement_id"
) -> DataFrame:
    """Number the records of each project in order and derive their IDs."""
    numbered = number_rows(df, ["project"], order, "_number")
    return numbered.withColumn(name, record_id(F.col("project"), F.col("_number"))).drop("_number")


def first_rows(
    df: DataFrame, count: int, order: Sequence[Column], group: Sequence[str] = ()
) -> DataFrame:
    """The first ``count`` rows, per group if one is given.

    Spark limits each partition to ``count`` rows before it brings a group together.
    """
    if not group:
        return df.orderBy(*order).limit(count)
    nth = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_nth", nth).filter(F.col("_nth") <= count).drop("_nth")
