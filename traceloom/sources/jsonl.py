"""Feeds of observations and of app switches in JSON lines (SRC-1, SRC-2, SRC-7, SRC-8, SUP-54)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: One object per line. Fields that are absent get the defaults of `observations`.
SCHEMA = (
    "ts long, display_id long, app struct<bundle_id:string,name:string>, window string, url struct<raw:string,canonical:string,host:string,kind:string>, file string, "
    "`trigger` string, capture_method string, completeness string, source_state string, texts array<struct<text:string,region:string>>, _corrupt_record string"
)
SWITCHES = "start double, end double, bundle_id string, name string, dwell_s double, active_s double, end_reason string, _corrupt_record string"


def observations(spark: SparkSession, path: str) -> DataFrame:
    """SRC-1: observations of a feed; lines that can't be read keep only `_corrupt_record`. An empty host is null."""
    rows = spark.read.schema(SCHEMA).option("mode", "PERMISSIVE").json(path)
    default = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    url = F.when(F.col("url").isNotNull(), F.struct("url.raw", "url.canonical", F.nullif("url.host", F.lit("")).alias("host"), F.coalesce("url.kind", F.lit("web")).alias("kind")))
    return rows.select(
        "ts", "display_id", "app", "window", url.alias("url"), "file", default("trigger", "timer"), default("capture_method", "ax"), default("completeness", "complete"),
        default("source_state", "ok"), F.coalesce("texts", F.array()).alias("texts"), "_corrupt_record",
    )


def stream(spark: SparkSession, path: str) -> DataFrame:
    """SRC-7: the same feed as a stream of files."""
    return spark.readStream.schema(SCHEMA).json(path)


def readable(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that could be read, and the others; a row without a time can't be placed and is one of the others."""
    good = F.col("ts").isNotNull() & F.col("_corrupt_record").isNull()
    return rows.where(good).drop("_corrupt_record"), rows.where(~good)


def switches(spark: SparkSession, path: str) -> DataFrame:
    """SRC-8: app switches; unreadable lines are left out and can be counted by `_corrupt_record`."""
    return spark.read.schema(SWITCHES).option("mode", "PERMISSIVE").json(path)


def generated(spark: SparkSession, count: int, seed: int = 1, start_ts: int = 1_600_000_000_000, step_ms: int = 10_000, reuse_every: int = 3) -> DataFrame:
    """SRC-2: a feed made by a rule: the same arguments give the same rows, in any number of partitions. Every
    `reuse_every`-th row repeats an earlier text."""
    rows = spark.range(count)
    h = lambda name, n: F.pmod(F.xxhash64("id", F.lit(name), F.lit(seed)), F.lit(n))
    app = h("app", 12)
    text = F.when(F.col("id") % reuse_every == 0, F.floor(F.col("id") / (reuse_every * 4))).otherwise(F.col("id"))
    return rows.select(
        (F.lit(start_ts) + F.col("id") * step_ms).alias("ts"), h("display", 2).alias("display_id"), F.struct(F.concat(F.lit("com.app"), app).alias("bundle_id"), F.concat(F.lit("App "), app).alias("name")).alias("app"),
        F.concat(F.lit("Window "), h("window", 40)).alias("window"), F.array(F.struct(F.concat(F.lit("Text number "), text).alias("text"), F.lit("body").alias("region"))).alias("texts"),
    )


def written(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def switch_report(rows: DataFrame, system: tuple[str, ...] = ("loginwindow",)) -> DataFrame:
    """AGG-20: per app the dwell, active time, switches and days; its name is the one of most dwell."""
    rows = rows.where(F.col("bundle_id").isNotNull() & ~F.col("bundle_id").isin(*system))
    names = rows.groupBy("bundle_id", "name").agg(F.sum("dwell_s").alias("d")).groupBy("bundle_id").agg(F.max_by("name", F.struct("d", "name")).alias("name"))
    day = F.floor(F.col("start") / 86_400)
    each = rows.groupBy("bundle_id").agg(F.sum("dwell_s").alias("dwell_s"), F.sum("active_s").alias("active_s"), F.count("*").alias("switches"), F.count_distinct(day).alias("days"))
    return each.join(names, "bundle_id")
