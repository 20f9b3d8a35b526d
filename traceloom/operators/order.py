"""Positions in a total order without a single task (WR-8, WIN-5, SUP-19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from traceloom.store import written


def positions(rows: DataFrame, order: list[str], name: str = "position", start: int = 0) -> DataFrame:
    """Column `name`: start + 1, start + 2, ... in the order of the columns, which should be unique. Rows are cut into
    ranges; only one count per range comes to the driver."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = written(rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = {r["_range"]: r["count"] for r in cut.groupBy("_range").count().collect()}
    before, total = [], start
    for k in sorted(counts):
        before += [F.lit(k), F.lit(total)]
        total += counts[k]
    offset: Column = F.create_map(*before)[F.col("_range")] if before else F.lit(start)
    own = Window.partitionBy("_range").orderBy(*order)
    return cut.withColumn(name, F.row_number().over(own) + offset).drop("_range")


def prefix_sum(rows: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Column `name`: sum of `value` over all rows up to this one in the order, by ranges like `positions`."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = written(rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = {r["_range"]: r["s"] or 0 for r in cut.groupBy("_range").agg(F.sum(value).alias("s")).collect()}
    before, total = [], 0
    for k in sorted(sums):
        before += [F.lit(k), F.lit(total).cast("long")]
        total += sums[k]
    offset: Column = F.create_map(*before)[F.col("_range")] if before else F.lit(0)
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return cut.withColumn(name, F.sum(value).over(own) + offset).drop("_range")
