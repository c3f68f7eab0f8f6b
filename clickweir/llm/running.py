"""Running totals and ranks over a global order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from clickweir.session import scratch


def running_total(spark: SparkSession, rows: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """`rows` with column `name`: the sum of `value` over all rows up to and including this one in `order`.

    Rows are range-sorted and stored once (a second evaluation could draw other range bounds); each range then adds the
    total of the ranges before it. Only one total per range goes to one task. `order` must tell rows apart as far as
    results may depend on it. Null values count as zero.
    """
    path = scratch(spark, "ranges")
    (rows.withColumn("_value", F.coalesce(value, F.lit(0))).repartitionByRange(*order)
     .withColumn("_range", F.spark_partition_id()).write.parquet(path))
    ranged = spark.read.parquet(path)
    totals = ranged.groupBy("_range").agg(F.sum("_value").alias("_sum"))
    before = totals.select("_range", (F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum")).alias("_before"))
    within = F.sum("_value").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return (ranged.withColumn("_within", within).join(before, "_range")
            .withColumn(name, F.col("_within") + F.col("_before")).drop("_value", "_range", "_within", "_before"))
