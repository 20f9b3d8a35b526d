"""Activity patterns of slices and sessions (PAT-1 to PAT-14)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from traceloom.operators import streams
from traceloom.operators.ledger import DAY, HOUR, day_of, per_bucket, sums
from traceloom.operators.slices import DISPLAY, DWELL_MS, RETURN_MS, sessions, slices

FOCUS_MS = 1_500_000  # fixed value: 25 minutes


def heat_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAT-2: per weekday (1 is Monday) and hour the times and the mean dwell over the hours of that cell in the span."""
    rows = per_bucket(slices(spark, sf_dir), HOUR).where("ms > 0 or inside = 1")
    each = rows.groupBy("bucket").agg(*sums())
    span = each.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi")).where("lo is not null")
    spine = span.select(F.explode(F.sequence("lo", "hi")).alias("bucket"))
    weekday = (F.pmod(F.floor(F.col("bucket") / 24) + 3, F.lit(7)) + 1).cast("int")
    hour = F.pmod("bucket", F.lit(24)).cast("int")
    cells = spine.join(each, "bucket", "left").groupBy(weekday.alias("weekday"), hour.alias("hour"))
    names = ("dwell_ms", "active_ms", "unknown_ms", "observations")
    out = cells.agg(F.count("*").alias("slots"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names))
    return out.where("dwell_ms + unknown_ms + observations > 0").withColumn("mean_dwell_ms", F.col("dwell_ms") / F.col("slots"))


def marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAT-3: dense sums by hour (24 rows) and by weekday (7 rows)."""
    cells = heat_map(spark, sf_dir).groupingSets([("hour",), ("weekday",)], "hour", "weekday").agg(F.sum("dwell_ms").alias("dwell_ms"), F.sum("observations").alias("observations"))
    kinds = spark.range(24).select(F.lit("hour").alias("axis"), F.col("id").cast("int").alias("value")).union(spark.range(1, 8).select(F.lit("weekday"), F.col("id").cast("int")))
    cells = cells.select(F.when(F.col("hour").isNotNull(), "hour").otherwise("weekday").alias("axis"), F.coalesce("hour", "weekday").alias("value"), "dwell_ms", "observations")
    return kinds.join(cells, ["axis", "value"], "left").fillna(0, ["dwell_ms", "observations"])


def peak_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAT-4: the cell of most dwell; of equal ones the earliest in the week."""
    return heat_map(spark, sf_dir).orderBy(F.desc("dwell_ms"), F.col("weekday") * 100 + F.col("hour")).limit(1).select("weekday", "hour", "dwell_ms")


def app_patterns(spark: SparkSession, sf_dir: str, hours: int = 3) -> DataFrame:
    """PAT-5: dwell of each app, its share, first and last time and its hours of most dwell."""
    rows = per_bucket(slices(spark, sf_dir).where("app <> -1"), HOUR).where("kind <> 'unknown'")
    each = rows.groupBy("app", F.pmod("bucket", F.lit(24)).alias("hour")).agg(F.sum("ms").alias("ms"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    order = Window.partitionBy("app").orderBy(F.desc("ms"), "hour")  # 24 rows at most
    each = each.withColumn("k", F.row_number().over(order))
    top = F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("k") <= hours) & (F.col("ms") > 0), F.struct("k", "hour")))), lambda x: x["hour"].cast("string")), ",")
    apps = each.groupBy("app").agg(F.sum("ms").alias("dwell_ms"), F.min("lo").alias("first_ts"), F.max("hi").alias("last_ts"), top.alias("top_hours"))
    whole = apps.agg(F.sum("dwell_ms").alias("whole"))
    return apps.join(F.broadcast(whole)).withColumn("share", F.col("dwell_ms") / F.nullif("whole", F.lit(0))).drop("whole")


def transitions(spark: SparkSession, sf_dir: str, top: int = 20) -> DataFrame:
    """PAT-6, JN-13: changes from one app to another on a display within 90 s."""
    rows = streams.lag(slices(spark, sf_dir).where("app <> -1"), DISPLAY, ["app", "ts"], "before")
    gap = F.col("ts") - F.col("before.ts")
    rows = rows.where((F.col("before.app") != F.col("app")) & (gap <= DWELL_MS))
    rows = rows.groupBy(F.col("before.app").alias("from_app"), F.col("app").alias("to_app")).agg(F.count("*").alias("changes"), F.avg(gap).alias("mean_gap_ms"))
    return rows.orderBy(F.desc("changes"), "from_app", "to_app").limit(top)


def focus_blocks(spark: SparkSession, sf_dir: str, least: int = FOCUS_MS) -> DataFrame:
    """PAT-7: runs on a display without a gap of 20 s or more and without unknown time, of 25 minutes or more."""
    rows = streams.lag(slices(spark, sf_dir), DISPLAY, ["ts", "kind"], "before")
    gap = F.col("ts") - F.col("before.ts")
    breaks = F.coalesce((gap >= RETURN_MS) | (F.col("kind") == "unknown") | (F.col("before.kind") == "unknown"), F.lit(True))
    rows = streams.running_sum(rows, DISPLAY, breaks.cast("int"), "run").where("kind <> 'unknown'")
    ms = F.col("end") - F.col("ts")
    apps = rows.groupBy(*DISPLAY, "run", "app").agg(
        F.min("ts").alias("lo"), F.max(F.greatest("end", "ts")).alias("hi"), F.sum(ms).alias("ms"), F.sum(F.when(F.col("kind") == "active", ms).otherwise(0)).alias("active")
    )
    runs = apps.groupBy(*DISPLAY, "run").agg(
        F.min("lo").alias("start_ts"), F.max("hi").alias("end_ts"), F.sum("ms").alias("ms"), F.sum("active").alias("active"), F.count("*").alias("apps"),
        F.min_by("app", F.struct(-F.col("ms"), F.col("app"))).alias("top_app"),
    )
    runs = runs.withColumn("duration_ms", F.col("end_ts") - F.col("start_ts")).where(F.col("duration_ms") >= least)
    return runs.select(*DISPLAY, "start_ts", "duration_ms", "apps", "top_app", (F.col("active") / F.nullif("ms", F.lit(0))).alias("active_ratio"))


def focus_stats(spark: SparkSession, sf_dir: str, least: int = FOCUS_MS) -> DataFrame:
    """PAT-8."""
    d = F.col("duration_ms")
    return focus_blocks(spark, sf_dir, least).agg(
        F.count("*").alias("blocks"), F.sum(d).alias("total_ms"), F.avg(d).alias("mean_ms"), F.expr("percentile(duration_ms, 0.5)").alias("median_ms"), F.max(d).alias("longest_ms"),
        F.count_if(F.col("apps") == 1).alias("single_app"), F.count_if(F.col("active_ratio") >= 0.5).alias("active_half"),
    )


def session_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAT-9, PAT-10: nearest-rank percentiles of the sessions' lengths."""
    rows = sessions(spark, sf_dir).withColumn("ms", F.col("end_ts") - F.col("start_ts"))
    return rows.agg(
        F.count("*").alias("sessions"), F.avg("ms").alias("mean_ms"), F.expr("percentile_disc(0.5) within group (order by ms)").alias("median_ms"),
        F.expr("percentile_disc(0.9) within group (order by ms)").alias("p90_ms"), F.max("ms").alias("longest_ms"), F.sum("dwell_ms").alias("dwell_ms"), F.sum("interruptions").alias("interruptions"),
    )


def active_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAT-12."""
    return slices(spark, sf_dir).select(day_of(F.col("ts")).alias("day")).agg(F.count_distinct("day").alias("days"))


def activity_page(spark: SparkSession, sf_dir: str, before: tuple[int, str, int] | None = None, size: int = 50) -> DataFrame:
    """PAT-13: the newest observations, or those behind a (ts, device, id) cursor."""
    rows = slices(spark, sf_dir).select("ts", "device_id", "id", "app", "display")
    if before is not None:
        ts, device, i = before
        rows = rows.where((F.col("ts") < ts) | ((F.col("ts") == ts) & ((F.col("device_id") < device) | ((F.col("device_id") == device) & (F.col("id") < i)))))
    return rows.orderBy(F.desc("ts"), F.desc("device_id"), F.desc("id")).limit(size)


def recent_activity(spark: SparkSession, sf_dir: str, minutes: int = 30) -> DataFrame:
    """PAT-14: per app what happened in the last minutes before the newest observation."""
    rows = slices(spark, sf_dir)
    newest = rows.agg(F.max("ts").alias("now"))
    return rows.join(F.broadcast(newest)).where(F.col("ts") > F.col("now") - minutes * 60_000).groupBy("app").agg(F.count("*").alias("observations"), F.max("ts").alias("last_ts"))


def daily_gpu_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-22: running dwell of each device within its day."""
    rows = slices(spark, sf_dir).withColumn("day", F.floor(F.col("ts") / DAY)).groupBy("device_id", "day", F.floor(F.col("ts") / HOUR).alias("hour")).agg(F.sum(F.col("end") - F.col("ts")).alias("ms"))
    order = Window.partitionBy("device_id", "day").orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("device_id", "hour", F.sum("ms").over(order).alias("used_ms"))
