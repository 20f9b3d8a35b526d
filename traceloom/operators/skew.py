"""Per-key results where a few keys hold most rows (problem 5).

Fragment-replicate by estimated load: the rows of each key are counted first (a map-side combined count), keys are
packed into tasks by their load, a key larger than its share is split into as many shards as its load asks for, and
the rows of the matching side travel only to the tasks that hold a shard of their key.

What comes to the driver is bounded by the number of tasks: the keys that exceed half of a task's share (at most twice
as many as tasks) and the loads of the buckets into which all other keys are hashed.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from traceloom.store import table, written

BUCKETS_PER_TASK = 8


def packing(loads: list[tuple[object, int]], tasks: int) -> list[tuple[object, int]]:
    """Task of each (item, load): the largest item first, each to the task with the least load so far."""
    heap = [(0, t) for t in range(tasks)]
    out = []
    for item, load in sorted(loads, key=lambda x: (-x[1], str(x[0]))):
        least, t = heapq.heappop(heap)
        out.append((item, t))
        heapq.heappush(heap, (least + load, t))
    return out


class Plan:
    """Which task holds which shard: `heavy` rows (key, shard, shards, task), `light` rows (bucket, task)."""

    def __init__(self, heavy: list[tuple[object, int, int, int]], light: list[tuple[int, int]], tasks: int, buckets: int):
        self.heavy, self.light, self.tasks, self.buckets = heavy, light, tasks, buckets


def plan(rows: DataFrame, key: str, tasks: int) -> Plan:
    buckets = BUCKETS_PER_TASK * tasks
    loads = rows.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n"))
    loads = loads.withColumn("bucket", F.pmod(F.xxhash64("k"), F.lit(buckets)).cast("int")).persist()
    try:
        whole = loads.agg(F.sum("n")).first()[0] or 0
        share = max(1, math.ceil(whole / tasks))
        large = loads.where(F.col("n") * 2 > share).select("k", "n").collect()
        small = loads.where(F.col("n") * 2 <= share).groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    finally:
        loads.unpersist()
    items: list[tuple[object, int]] = [(("light", r["bucket"]), r["n"]) for r in small]
    shards = {}
    for r in large:
        shards[r["k"]] = m = math.ceil(2 * r["n"] / share)  # shards of half a share pack better than whole ones
        items += [(("heavy", r["k"], s), math.ceil(r["n"] / m)) for s in range(m)]
    heavy, light = [], []
    for item, t in packing(items, tasks):
        if item[0] == "heavy":
            heavy.append((item[1], item[2], shards[item[1]], t))
        else:
            light.append((item[1], t))
    return Plan(heavy, light, tasks, buckets)


def placed(rows: DataFrame, key: str, spread: Column, plan: Plan, replicate: bool = False) -> DataFrame:
    """rows with column `task`, each in the task's own partition. `spread` tells the shard of a row of a large key;
    with `replicate` a row goes to every task that holds a shard of its key instead."""
    spark = rows.sparkSession
    kind = rows.schema[key].dataType.simpleString()
    # both tables have at most a fixed multiple of `tasks` rows, so broadcasting them is bounded
    heavy = spark.createDataFrame(plan.heavy, f"hk {kind}, shard int, shards int, heavy_task int")
    light = spark.createDataFrame(plan.light, "lb int, light_task int")
    count = heavy.groupBy(F.col("hk").alias("ck")).agg(F.first("shards").alias("m"))
    out = rows
    if replicate:
        to = heavy.select("hk", "heavy_task").distinct()
        out = out.join(F.broadcast(to), F.col(key).eqNullSafe(F.col("hk")), "left").drop("hk")
    else:
        out = out.join(F.broadcast(count), F.col(key).eqNullSafe(F.col("ck")), "left")
        out = out.withColumn("at", F.when(F.col("m").isNotNull(), F.pmod(spread, F.col("m")).cast("int"))).drop("ck", "m")
        match = F.col(key).eqNullSafe(F.col("hk")) & (F.col("at") == F.col("shard"))
        out = out.join(F.broadcast(heavy.drop("shards")), match, "left").drop("hk", "shard", "at")
    out = out.withColumn("lb2", F.pmod(F.xxhash64(key), F.lit(plan.buckets)).cast("int"))
    out = out.join(F.broadcast(light), F.col("lb2") == F.col("lb"), "left")
    task = F.coalesce("heavy_task", "light_task", F.pmod("lb2", F.lit(plan.tasks))).cast("int")
    return out.withColumn("task", task).drop("heavy_task", "light_task", "lb", "lb2").repartitionById(plan.tasks, F.col("task"))


def per_key(
    rows: DataFrame, key: str, spread: Column, partial: list[Column], final: list[Column], side: DataFrame | None = None,
    side_key: str | None = None, tasks: int | None = None, each: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Result per key without a task that is much longer than the rest.

    Every task aggregates its shards (`partial`, after the join with `side` and the optional step `each`), then the few
    rows per key and task are merged (`final`). A null key is a key of its own. An empty table gives no rows; columns
    beyond those that the aggregates name are ignored; `task` is the only name taken.
    """
    tasks = tasks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    how = plan(rows, key, tasks)
    out = placed(rows, key, spread, how)
    group = ["task", key]
    if side is not None:
        copies = placed(side.withColumnRenamed(side_key, "side_key"), "side_key", F.lit(0), how, replicate=True)
        on = (out["task"] == copies["task"]) & out[key].eqNullSafe(copies["side_key"])
        out = out.join(copies.hint("shuffle_hash"), on, "left").drop(copies["task"])
        group += [c for c in copies.columns if c not in ("task", "side_key")]
    if each is not None:
        out = each(out)
    return out.groupBy(*group).agg(*partial).groupBy(*group[1:]).agg(*final)


def app_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations as delivered, first and last ts, and name of each app; rows without an app are a key of their own
    and rows without ts count, but give no time."""
    rows = table(spark, sf_dir, "observations").select("app_id", "device_id", "id", "ts")
    apps = table(spark, sf_dir, "apps").select(F.col("id").alias("app"), F.lower("bundle_id").alias("bundle_id"))
    apps = apps.dropDuplicates(["app"])
    partial = [F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi")]
    final = [F.sum("n").alias("observations"), F.min("lo").alias("first_ts"), F.max("hi").alias("last_ts")]
    return per_key(rows, "app_id", F.xxhash64("device_id", "id"), partial, final, apps, "app")


def heavy_apps(spark: SparkSession, sf_dir: str, share: int = 20) -> DataFrame:
    """Apps that hold at least one row of `share` of all rows as delivered; rows without an app count in the whole."""
    each = written(app_activity(spark, sf_dir).groupBy("app_id").agg(F.sum("observations").alias("n")), "counts")  # used twice
    whole = each.agg(F.sum("n").alias("whole"))  # one row
    return each.join(F.broadcast(whole)).where(f"app_id is not null and n * {share} >= whole").select("app_id")
