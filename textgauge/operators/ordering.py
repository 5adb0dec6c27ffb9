"""Running totals and ranks over rows in order, without gathering the rows, or those of one value, in a task."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def kept(df: DataFrame) -> DataFrame:
    """``df`` evaluated once. A checkpoint in the shared folder that the session names, which a lost executor doesn't
    take along; without such a folder (on one machine) a copy on disk."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if folder and not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    if context._jsc.sc().getCheckpointDir().isDefined():
        return df.checkpoint()
    return df.persist(StorageLevel.DISK_ONLY)


def running(rows: DataFrame, order: list[Column], amount: Column, name: str) -> DataFrame:
    """Adds the sum of ``amount`` over all rows before a row in the order, which must tell all rows apart.

    Rows are dealt out by ranges of the order, so rows that agree in its first column needn't share a task. Each
    range adds up its own; what stands before a range comes from the ranges' sums, one number a partition."""
    placed = kept(rows.withColumn("_amount", amount).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sums = placed.groupBy("_part").agg(F.sum("_amount").alias("n")).orderBy("_part").collect()
    before, total = [], 0
    for r in sums:
        before.append((r["_part"], total))
        total += r["n"]
    offsets = rows.sparkSession.createDataFrame(before, "_part int, _before double" if isinstance(total, float) else "_part int, _before long")
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.withColumn("_inside", F.coalesce(F.sum("_amount").over(own), F.lit(0)))
    joined = inside.join(F.broadcast(offsets), "_part")  # a row for each partition
    return joined.withColumn(name, F.col("_before") + F.col("_inside")).drop("_part", "_before", "_inside", "_amount")
