"""Exact ranks of whole tables without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotweave.session import Scratch


def global_rank(df: DataFrame, order: list[Column], scratch: Scratch, out: str = "rank", parts: int | None = None) -> DataFrame:
    """df with its row's number, from 0, in an order that must be total.

    Rows are partitioned by range and sorted within partitions; the partitions' sizes, a row each, give the offsets.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id())
    placed = scratch.cut(placed)
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    local = placed.withColumn("_local", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return local.join(F.broadcast(before), "_part").withColumn(out, F.col("_before") + F.col("_local") - 1).drop("_part", "_before", "_local")  # a row for each partition
