"""Day and week ledgers, timelines and rollups of slices (AGG-1 to AGG-23). Days are UTC days, numbered from 1970."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from traceloom.operators import streams
from traceloom.operators.slices import DISPLAY, sessions, slices, union_ms

HOUR, DAY = 3_600_000, 86_400_000
MARGIN = 91_000  # slices are cut on the whole stream, so a range needs no margin of its own


def day_of(ms: Column) -> Column:
    return F.floor(ms / DAY).cast("long")


def iso_week(day: Column) -> Column:
    """Number of the Monday-first week of a day, from the week of 1970-01-01."""
    return F.floor((day + 3) / 7).cast("long")


def per_bucket(rows: DataFrame, size: int) -> DataFrame:
    """JN-9: slices cut at the borders of buckets of `size` ms: column `bucket`, `ms` and `inside` (1 if the row's own
    time lies in the bucket). A slice lasts 90 s at most, so it meets two buckets."""
    last = F.greatest(F.floor((F.col("end") - 1) / size), F.floor(F.col("ts") / size))
    rows = rows.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("ts") / size), last)))
    lo, hi = F.col("bucket") * size, (F.col("bucket") + 1) * size
    rows = rows.withColumn("ms", F.greatest(F.lit(0), F.least("end", hi) - F.greatest("ts", lo)))
    return rows.withColumn("inside", (F.floor(F.col("ts") / size) == F.col("bucket")).cast("int"))


def sums() -> list[Column]:
    part = lambda *kinds: F.sum(F.when(F.col("kind").isin(*kinds), F.col("ms")).otherwise(0))
    return [part("active", "idle").alias("dwell_ms"), part("active").alias("active_ms"), part("unknown").alias("unknown_ms"), F.sum("inside").alias("observations")]


def switches(rows: DataFrame, key: str) -> DataFrame:
    """AGG-2: column `switch`: 1 where a row with a key follows one with another key on its display, in the same day;
    rows without a key don't count and don't break."""
    rows = rows.where(F.col(key).isNotNull() & (F.col(key) != -1)).withColumn("day", day_of(F.col("ts")))
    rows = streams.lag(rows, [*DISPLAY, "day"], [key], "before")
    return rows.withColumn("switch", F.when(F.col(f"before.{key}") == F.col(key), 0).otherwise(1))


def day_ledger(spark: SparkSession, sf_dir: str, key: str = "app") -> DataFrame:
    """AGG-1, AGG-4: per day and key (app, url_id or file_id) the times, observations and switches."""
    rows = slices(spark, sf_dir)
    own = per_bucket(rows.where(F.col(key).isNotNull() & (F.col(key) != -1)), DAY).where("ms > 0 or inside = 1")
    each = own.groupBy(F.col("bucket").alias("day"), key).agg(*sums())
    sw = switches(rows, key).groupBy("day", key).agg(F.sum("switch").alias("switches"))
    return each.join(sw, ["day", key], "left").withColumn("switches", F.coalesce("switches", F.lit(0)))


def day_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-4: per day the totals of all slices and the time online on any display."""
    rows = slices(spark, sf_dir)
    each = per_bucket(rows, DAY).where("ms > 0 or inside = 1").groupBy(F.col("bucket").alias("day")).agg(*sums())
    online = union_ms(rows.where("kind <> 'unknown'").withColumn("all", F.lit(1)), ["all"])
    online = online.groupBy(F.floor(F.col("hour") / 24).alias("day")).agg(F.sum("online_ms").alias("online_ms"))
    return each.join(online, "day", "left").withColumn("online_ms", F.coalesce("online_ms", F.lit(0)))


def display_dwell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-4: dwell per day and display; unknown time is left out."""
    rows = per_bucket(slices(spark, sf_dir).where("kind <> 'unknown'"), DAY)
    return rows.groupBy(F.col("bucket").alias("day"), *DISPLAY).agg(F.sum("ms").alias("dwell_ms")).where("dwell_ms > 0")


def timeline(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """AGG-8: dense buckets from the first to the last observation, empty ones included, with the app of most dwell."""
    rows = per_bucket(slices(spark, sf_dir), size).where("ms > 0 or inside = 1")
    each = rows.groupBy("bucket").agg(*sums())
    apps = rows.where("app <> -1 and kind <> 'unknown'").groupBy("bucket", "app").agg(F.sum("ms").alias("ms"))
    top = apps.groupBy("bucket").agg(F.min_by("app", F.struct(-F.col("ms"), F.col("app"))).alias("top_app"))
    span = each.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi")).where("lo is not null")
    spine = span.select(F.explode(F.sequence("lo", "hi")).alias("bucket"))
    out = spine.join(each, "bucket", "left").join(top, "bucket", "left").select((F.col("bucket") * size).alias("start_ts"), "dwell_ms", "active_ms", "unknown_ms", "observations", "top_app")
    return out.fillna(0, ["dwell_ms", "active_ms", "unknown_ms", "observations"])


def week_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-9: sums of the day ledgers of each week."""
    rows = day_ledger(spark, sf_dir).withColumn("week", iso_week(F.col("day")))
    names = ("dwell_ms", "active_ms", "unknown_ms", "observations", "switches")
    return rows.groupBy("week", "app").agg(*(F.sum(c).alias(c) for c in names), F.count_distinct("day").alias("active_days"))


def week_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-9: seven rows for each week with any observation, with whether the day has data."""
    days = day_totals(spark, sf_dir)
    weeks = days.select(iso_week(F.col("day")).alias("week")).distinct()
    spine = weeks.withColumn("day", F.explode(F.sequence(F.col("week") * 7 - 3, F.col("week") * 7 + 3)))
    out = spine.join(days, "day", "left").select("week", "day", F.col("dwell_ms").isNotNull().alias("has_data"), "dwell_ms", "observations")
    return out.fillna(0, ["dwell_ms", "observations"])


def observation_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-7: every day from the first to the last live observation."""
    from traceloom.store import table

    span = table(spark, sf_dir, "observations").where("deleted_at is null").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).where("lo is not null")
    return span.select(F.explode(F.sequence(day_of(F.col("lo")), day_of(F.col("hi")))).alias("day"))


def session_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-19: sessions per app."""
    names = ("dwell_ms", "active_ms", "unknown_ms")
    return sessions(spark, sf_dir).groupBy("app").agg(F.count("*").alias("sessions"), *(F.sum(c).alias(c) for c in names))
