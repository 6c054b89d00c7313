"""Places of rows in a total order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywork.sources.io import shared_path


def numbered(df: DataFrame, *order: Column | str, name: str = "place", first: int = 1) -> DataFrame:
    """``df`` with the place of each row in ``order``, counted from ``first``.

    Rows are dealt by ranges of the order and written; the sizes of the ranges (as many numbers as partitions) give where
    each begins, and rows are counted on from there within their range. Rows that are equal in ``order`` are counted in
    any order.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, "order")
    df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    held = spark.read.parquet(path)
    starts, at = [], first
    for r in sorted(held.groupBy("_range").agg(F.count("*").alias("n")).collect()):
        starts.append((r["_range"], at))
        at += r["n"]
    begins = spark.createDataFrame(starts, "_range int, _start long")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return held.join(F.broadcast(begins), "_range").withColumn(name, (F.col("_start") + inside - 1).cast("long")).drop("_range", "_start")
