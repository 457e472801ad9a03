"""Ranks within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mneme.storage import materialize


def group_rank(df: DataFrame, group: list[str], value: str, rank: str = "rank") -> DataFrame:
    """Rank of each distinct ``value`` in its group: the number of rows with at least this value.

    Gives one row per group and distinct value: ``group..., value, rank``; rows with a null group or
    value take no part. Ties share the greatest rank. No task gets a whole group: equal values are
    counted first, the counts are range-partitioned by group and value, ranks run within the blocks
    of a group, and the block totals before each block (at most one row per group and partition) are
    added. The range partitioning is written once, so a lost executor can't move a block's borders.
    """
    clean = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    counts = clean.groupBy(*group, value).agg(F.count(F.lit(1)).alias("__n"))
    ranged = counts.repartitionByRange(*[F.col(g) for g in group], F.col(value).desc())
    blocks = materialize(ranged.withColumn("__block", F.spark_partition_id()), "ranks")
    before = (
        blocks.groupBy(*group, "__block")
        .agg(F.sum("__n").alias("__total"))
        .withColumn(
            "__before",
            F.coalesce(
                F.sum("__total").over(Window.partitionBy(*group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
        .drop("__total")
    )
    running = F.sum("__n").over(
        Window.partitionBy(*group, "__block").orderBy(F.col(value).desc()).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        blocks.withColumn("__running", running)
        .join(before, [*group, "__block"])
        .select(*group, value, (F.col("__before") + F.col("__running")).alias(rank))
    )


def running_sum(df: DataFrame, group: str, order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with the sum ``out`` of ``value`` over its group's rows up to and with each row, in ``order``.

    No task gets a whole group: rows are range-partitioned by group and order, sums run within the
    blocks of a group, and the totals of the blocks before (one row per group and partition) are added.
    """
    ranged = df.repartitionByRange(F.col(group), *[F.col(c) for c in order])
    blocks = materialize(ranged.withColumn("__block", F.spark_partition_id()), "blocks")
    earlier = Window.partitionBy(group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.groupBy(group, "__block").agg(F.sum(value).alias("__total")).withColumn("__before", F.coalesce(F.sum("__total").over(earlier), F.lit(0)))
    within = F.sum(value).over(Window.partitionBy(group, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return blocks.withColumn(out, within).join(before.drop("__total"), [group, "__block"]).withColumn(out, F.col(out) + F.col("__before")).drop("__before", "__block")


def row_numbers(df: DataFrame, order: list, out: str) -> DataFrame:
    """``df`` numbered from 1 in ``order`` (columns or expressions), without bringing all rows into one task.

    Rows are range-partitioned and numbered within their partition; the sizes of the partitions before
    (one row per partition) are added.
    """
    blocks = materialize(df.repartitionByRange(*order).withColumn("__block", F.spark_partition_id()), "numbered")
    sizes = blocks.groupBy("__block").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("__block").orderBy(*order))
    offsets = F.broadcast(sizes.select("__block", before.alias("__before")))  # one row per partition
    return blocks.withColumn(out, within).join(offsets, "__block").withColumn(out, (F.col(out) + F.col("__before")).cast("int")).drop("__block", "__before")
