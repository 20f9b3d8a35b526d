"""Time slices and sessions of live observations (SES-1 to SES-11).

A slice lasts until the next observation of the same device and display, 90 s at most; the last one of a display has
length 0. A session is a run of slices of one app: it goes on if the row before on the display has the same app and is
less than 300 s old, or, after other apps, if the app's own last row is at most 20 s old, which counts as an
interruption. Null displays and apps are the key -1, a null device is the device with the empty name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from traceloom.operators import streams
from traceloom.store import BLOCK_MS, live

DWELL_MS, SESSION_MS, RETURN_MS = 90_000, 300_000, 20_000  # fixed values
UNKNOWN = ("permission_lost", "timeout", "locked")  # fixed values
DISPLAY = ["device_id", "display"]


def time_class(state: Column) -> Column:
    """SES-11: unknown, idle (dwell only) or active (dwell and active)."""
    return F.when(state.isin(*UNKNOWN), "unknown").when(state == "user_idle", "idle").otherwise("active")


def clipped(lo: Column, hi: Column) -> Column:
    """SES-9: part of the slice that lies in lo .. hi."""
    return F.greatest(F.lit(0), F.least("end", hi) - F.greatest("ts", lo))


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SES-1: (device_id, display, id, ts, end, app, kind, window_id, url_id, file_id, block), and for sessions papp and
    pts: the app of the row before and the last time of the row's own app, if they may matter.

    Rows within 90 s behind a block's end and within 300 s before its begin are in the block too, as ghosts; no rule
    looks further, but for whether a row is the last of its display. Where a later block has rows, a ghost behind the
    block's reach stands for them. So one shuffle by block serves all windows."""
    rows = live(spark, sf_dir, "ts", "display_id", "app_id", "window_id", "url_id", "file_id", "source_state").where("ts is not null")
    rows = rows.withColumn("display", F.coalesce("display_id", F.lit(-1))).withColumn("app", F.coalesce("app_id", F.lit(-1)))
    rows = streams.blocked(rows.withColumn("device_id", F.coalesce("device_id", F.lit("")))).withColumnRenamed("block", "home").drop("display_id", "app_id")
    later = F.lead("home").over(Window.partitionBy(*DISPLAY).orderBy("home")).isNotNull()
    ghosts = rows.groupBy(*DISPLAY, "home").agg(F.lit(True).alias("x")).withColumn("later", later).where("later")
    ghosts = ghosts.select(*DISPLAY, ((F.col("home") + 1) * BLOCK_MS + DWELL_MS).alias("ts"), F.col("home").alias("block"), F.lit(False).alias("own"))
    into = F.col("ts") - F.col("home") * BLOCK_MS
    also = F.array(F.col("home"), F.when(into < DWELL_MS, F.col("home") - 1), F.when(into >= BLOCK_MS - SESSION_MS, F.col("home") + 1))
    rows = rows.withColumn("block", F.explode(F.filter(also, lambda b: b.isNotNull()))).withColumn("own", F.col("block") == F.col("home")).drop("home")
    rows = rows.unionByName(ghosts, allowMissingColumns=True).repartition(*DISPLAY, "block")
    order = Window.partitionBy(*DISPLAY, "block").orderBy("ts", "id")
    twin = (F.col("ts") == F.lag("ts").over(order)) & F.col("id").eqNullSafe(F.lag("id").over(order))
    rows = rows.where("id is not null or not own").withColumn("twin", F.coalesce(twin, F.lit(False))).where("not twin").drop("twin")
    rows = rows.withColumn("next", F.lead("ts").over(order)).withColumn("papp", F.lag("app").over(order))
    rows = rows.withColumn("pts", F.lag("ts").over(Window.partitionBy(*DISPLAY, "block", "app").orderBy("ts", "id")))
    rows = rows.where("own").withColumn("end", F.least(F.coalesce("next", "ts"), F.col("ts") + DWELL_MS))
    return rows.withColumn("kind", time_class(F.col("source_state"))).withColumn("block", F.coalesce("block", F.lit(0))).drop("next", "source_state", "own")


def with_begins(rows: DataFrame) -> DataFrame:
    """SES-2: whether a slice begins a session, and whether it comes back to one after other apps."""
    age = F.col("ts") - F.col("pts")
    begins = F.when(F.col("pts").isNull(), 1).when(F.col("papp") == F.col("app"), (age >= SESSION_MS).cast("int")).otherwise((age > RETURN_MS).cast("int"))
    rows = rows.withColumn("begins", begins)
    return rows.withColumn("returns", ((F.col("begins") == 0) & (F.col("papp") != F.col("app"))).cast("int")).drop("papp", "pts")


def with_sessions(rows: DataFrame) -> DataFrame:
    """SES-2: slices with `session`, its number for the display and app."""
    return streams.running_sum(with_begins(rows), [*DISPLAY, "app"], F.col("begins"), "session")


def totals(*extra: Column) -> list[Column]:
    ms = F.col("end") - F.col("ts")
    part = lambda *kinds: F.sum(F.when(F.col("kind").isin(*kinds), ms).otherwise(0))
    return [part("active", "idle").alias("dwell_ms"), part("active").alias("active_ms"), part("unknown").alias("unknown_ms"), *extra]


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SES-2, SES-5: sessions are made within the blocks; only a block's first and last one of an app can be parts of a
    longer one and meet in a second window."""
    key = [*DISPLAY, "app"]
    rows = with_begins(slices(spark, sf_dir))
    own = Window.partitionBy(*key, "block").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("part", F.sum("begins").over(own))  # 0: goes on from the block before
    names = ("dwell_ms", "active_ms", "unknown_ms", "interruptions", "observations")
    parts = rows.groupBy(*key, "block", "part").agg(F.min("ts").alias("start_ts"), F.max("end").alias("end_ts"), *totals(F.sum("returns").alias("interruptions"), F.count("*").alias("observations")))
    last = F.col("part") == F.max("part").over(Window.partitionBy(*key, "block"))
    parts = parts.withColumn("edge", (F.col("part") == 0) | last).withColumn("slot", F.when(~F.col("edge"), F.col("block")))
    chain = Window.partitionBy(*key, "edge", "slot").orderBy("block", "part")
    parts = parts.withColumn("whole", F.sum(F.when(F.col("part") > 0, 1).otherwise(0)).over(chain.rowsBetween(Window.unboundedPreceding, 0)))
    out = parts.groupBy(*key, "edge", "slot", "whole").agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), *(F.sum(c).alias(c) for c in names))
    return out.drop("edge", "slot", "whole")


def overlapping_sessions(spark: SparkSession, sf_dir: str, lo: int, hi: int) -> DataFrame:
    """SES-4, JN-8: sessions that share time with lo .. hi."""
    return sessions(spark, sf_dir).where((F.col("start_ts") < hi) & (F.col("end_ts") > lo))


def id_intervals(rows: DataFrame, keys: list[str], id_: str = "id", width: int = 1 << 20) -> DataFrame:
    """SES-6, DEL-11: (keys, lo, hi) of runs of consecutive ids. Ids are cut into blocks of a fixed width; runs that
    touch across blocks are joined by the blocks' edges."""
    rows = rows.select(*keys, F.col(id_).alias("id")).where("id is not null").distinct().withColumn("part", F.floor(F.col("id") / width))
    own = Window.partitionBy(*keys, "part").orderBy("id")
    runs = rows.withColumn("run", F.col("id") - F.row_number().over(own)).groupBy(*keys, "part", "run").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    edge = (F.col("lo") == F.col("part") * width) | (F.col("hi") == (F.col("part") + 1) * width - 1)
    runs = runs.withColumn("edge", edge).withColumn("slot", F.when(~edge, F.col("part")))
    order = Window.partitionBy(*keys, "edge", "slot").orderBy("lo")
    runs = runs.withColumn("new", F.when(F.col("lo") - F.lag("hi").over(order) == 1, 0).otherwise(1))
    runs = runs.withColumn("chain", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "edge", "slot", "chain").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("edge", "slot", "chain")


def merged_intervals(rows: DataFrame, keys: list[str], lo: str = "lo", hi: str = "hi", touch: int = 1) -> DataFrame:
    """SES-7: intervals merged where one begins at most `touch` behind the furthest end so far; malformed ones are
    dropped. The keys should bound the rows, as a day does."""
    rows = rows.where(F.col(lo) <= F.col(hi)).select(*keys, F.col(lo).alias("lo"), F.col(hi).alias("hi"))
    order = Window.partitionBy(*keys).orderBy("lo", "hi")
    far = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.when(F.col("lo") <= far + touch, 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("run")


def union_ms(rows: DataFrame, keys: list[str]) -> DataFrame:
    """SES-8: time covered by at least one slice, per key and hour; hours bound what one task sees."""
    hour = 3_600_000
    cut = rows.where("end > ts").withColumn("hour", F.explode(F.sequence(F.floor(F.col("ts") / hour), F.floor((F.col("end") - 1) / hour))))
    cut = cut.select(*keys, "hour", F.greatest("ts", F.col("hour") * hour).alias("lo"), F.least("end", (F.col("hour") + 1) * hour).alias("hi"))
    return merged_intervals(cut, [*keys, "hour"], touch=0).groupBy(*keys, "hour").agg(F.sum(F.col("hi") - F.col("lo")).alias("online_ms"))


def session_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SES-6: ids of the observations of each session, as intervals."""
    return id_intervals(with_sessions(slices(spark, sf_dir)), [*DISPLAY, "app", "session"])
