"""Keeping total orders from landing in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkwarden.session import cut_lineage

def number_rows(df: DataFrame, group: list[str], order: list[str], number: str, total: str) -> DataFrame:
    """``row_number`` and group size in a total order, without a whole group in one window task.

    Rows are range-partitioned on (group, order) so that a large group spans many slices; each slice
    numbers its own rows and the small per-slice counts give the offsets. Finding the range bounds
    reads ``df`` one time more, so store a costly one before (``cut_lineage``).
    """
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # stored, so that counts and numbers see the same slices
    sliced = cut_lineage(
        df.repartitionByRange(slices, *group, *order).withColumn("_slice", F.spark_partition_id())
    )
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*group)
    offsets = (
        sliced.groupBy(*group, "_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            *[F.col(g).alias(f"_{g}") for g in group],
            F.col("_slice").alias("_from"),
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
            F.sum("_n").over(everything).alias(total),
        )
    )
    local = Window.partitionBy(*group, "_slice").orderBy(*order)
    # a group without a key is a group too
    same = reduce(
        lambda a, b: a & b,
        [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group],
        F.col("_slice") == F.col("_from"),
    )
    return (
        sliced.withColumn("_at", F.row_number().over(local))
        .join(offsets, same)
        .select(*df.columns, (F.col("_before") + F.col("_at")).alias(number), total)
    )
