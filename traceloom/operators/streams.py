"""Window functions over long streams, without one task per stream.

A stream (a device's display, say) is cut into blocks of time. A window function runs within the blocks; what it needs
from before or behind its block comes from a table with one row per stream and block, whose own window is bounded by
the number of blocks of the time line. Rows are ordered by (ts, id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from traceloom.store import block

AT = ("ts", "id")


def blocked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("block", F.coalesce(block(), F.lit(0)))  # not null, so that plain joins on it are right


def _inner(keys: list[str]):
    return Window.partitionBy(*keys, "block").orderBy(*AT)


def _outer(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("block")


def _meet(rows: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    on = [*keys, "block"]
    edges = edges.select(*(F.col(k).alias(f"_{k}") for k in on), *(c for c in edges.columns if c not in on))
    match = None
    for k in on:
        # equality where no null can be: then the join uses the partitioning of the windows
        one = F.col(k).eqNullSafe(F.col(f"_{k}")) if rows.schema[k].nullable else F.col(k) == F.col(f"_{k}")
        match = one if match is None else match & one
    return rows.join(edges, match, "left").drop(*(f"_{k}" for k in on))


def lag(rows: DataFrame, keys: list[str], columns: list[str], name: str) -> DataFrame:
    """Column `name`: struct of `columns` of the row before in the stream; null for its first row."""
    value, at = F.struct(*columns), F.struct(*AT)
    edges = rows.groupBy(*keys, "block").agg(F.max_by(value, at).alias("_tail"))
    edges = edges.withColumn("_tail", F.lag("_tail").over(_outer(keys)))
    out = _meet(rows, edges, keys).withColumn(name, F.lag(value).over(_inner(keys)))
    return out.withColumn(name, F.coalesce(name, "_tail")).drop("_tail")


def lead(rows: DataFrame, keys: list[str], columns: list[str], name: str) -> DataFrame:
    """Column `name`: struct of `columns` of the row behind in the stream; null for its last row."""
    value, at = F.struct(*columns), F.struct(*AT)
    edges = rows.groupBy(*keys, "block").agg(F.min_by(value, at).alias("_head"))
    edges = edges.withColumn("_head", F.lead("_head").over(_outer(keys)))
    out = _meet(rows, edges, keys).withColumn(name, F.lead(value).over(_inner(keys)))
    return out.withColumn(name, F.coalesce(name, "_head")).drop("_head")


def running_sum(rows: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """Column `name`: sum of a number over the stream up to the row."""
    rows = rows.withColumn("_v", value)
    edges = rows.groupBy(*keys, "block").agg(F.sum("_v").alias("_before"))
    before = _outer(keys).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.withColumn("_before", F.coalesce(F.sum("_before").over(before), F.lit(0)))
    out = _meet(rows, edges, keys)
    local = F.sum("_v").over(_inner(keys).rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn(name, local + F.col("_before")).drop("_v", "_before")


def position(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Column `name`: number of the row in its stream, from 1."""
    return running_sum(rows, keys, F.lit(1), name)
