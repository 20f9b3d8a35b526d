"""Evidence, items and contexts (EVD-1 to EVD-6, AGG-11 to AGG-18, JN-10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from traceloom.functions import text as T
from traceloom.operators.search import live_rows
from traceloom.operators.slices import DWELL_MS
from traceloom.store import once, table


def texts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVD-2, EVD-4: (device_id, id, text): the texts of each observation by ord, one below the other. A list holds
    the texts of one observation."""
    shown = table(spark, sf_dir, "occurrences").dropDuplicates(["device_id", "id"]).select("device_id", F.col("observation_id").alias("obs"), "ord", F.col("id").alias("occ"), "text_version_id")
    texts = table(spark, sf_dir, "text_versions").select("device_id", F.col("id").alias("text_version_id"), "text")
    rows = shown.join(texts, ["device_id", "text_version_id"]).groupBy("device_id", "obs").agg(F.array_sort(F.collect_list(F.struct("ord", "occ", "text"))).alias("t"))
    return rows.select("device_id", F.col("obs").alias("id"), F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text"))


def evidence(spark: SparkSession, sf_dir: str, ids: DataFrame, apps: list[str] | None = None, level: str = "evidence") -> DataFrame:
    """EVD-1, SEC-3: each asked (device_id, id) with its status (ok, missing, denied) and text; a grant of level summary
    masks the text."""
    rows = ids.join(live_rows(spark, sf_dir).select("device_id", "id", "ts", "app_id"), ["device_id", "id"], "left")
    rows = rows.join(table(spark, sf_dir, "apps").select(F.col("id").alias("app_id"), F.lower("bundle_id").alias("bundle_id")), "app_id", "left")
    rows = rows.join(texts_of(spark, sf_dir), ["device_id", "id"], "left")
    allowed = F.lit(True) if apps is None or "*" in apps else F.coalesce(F.col("bundle_id").isin([a.lower() for a in apps]), F.lit(False))
    status = F.when(F.col("ts").isNull(), "missing").when(~allowed, "denied").otherwise("ok")
    text = F.when((status == "ok") & F.lit(level == "evidence"), F.col("text"))
    return rows.select("device_id", "id", status.alias("status"), text.alias("text"), ((status == "ok") & F.lit(level != "evidence")).alias("redacted"))


def neighbours(spark: SparkSession, sf_dir: str, ids: DataFrame, n: int = 2) -> DataFrame:
    """JN-10, EVD-3: the n rows before and behind each asked row on its display, by strictly smaller or larger ts. The
    asked rows are few (50 at most by the caps of the tools), so they are what is replicated."""
    rows = live_rows(spark, sf_dir).select("device_id", F.coalesce("display_id", F.lit(-1)).alias("display"), "id", "ts")
    asked = rows.join(ids, ["device_id", "id"], "left_semi").select("device_id", "display", F.col("id").alias("of"), F.col("ts").alias("at"))
    near = rows.join(F.broadcast(asked), ["device_id", "display"]).where("ts <> at")
    side = F.when(F.col("ts") < F.col("at"), "before").otherwise("after")
    near = near.withColumn("side", side)
    order = Window.partitionBy("device_id", "of", "side").orderBy(F.abs(F.col("ts") - F.col("at")), F.when(F.col("side") == "before", -F.col("id")).otherwise(F.col("id")))
    return near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= n).select("device_id", "of", "side", "k", "id")


def item(spark: SparkSession, sf_dir: str, key: str, value: int) -> DataFrame:
    """AGG-11: one object: how often, when and on how many days it was seen."""
    rows = live_rows(spark, sf_dir).where(F.col(key) == value)
    return rows.agg(F.count("*").alias("observations"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_distinct(F.floor(F.col("ts") / 86_400_000)).alias("days"), F.count_distinct("app_id").alias("apps"))


def item_days(spark: SparkSession, sf_dir: str, key: str, value: int) -> DataFrame:
    return live_rows(spark, sf_dir).where((F.col(key) == value) & F.col("ts").isNotNull()).groupBy(F.floor(F.col("ts") / 86_400_000).alias("day")).agg(F.count("*").alias("observations"))


def item_titles(spark: SparkSession, sf_dir: str, key: str, value: int, most: int = 10) -> DataFrame:
    """AGG-11: the most frequent titles of an object."""
    rows = live_rows(spark, sf_dir).where(F.col(key) == value).join(table(spark, sf_dir, "windows").select(F.col("id").alias("window_id"), "title"), "window_id")
    return rows.groupBy("title").agg(F.count("*").alias("observations")).orderBy(F.desc("observations"), "title").limit(most)


def object_dwell(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """AGG-12: dwell of each object over its own stream on each display: gaps count 90 s at most."""
    rows = live_rows(spark, sf_dir).where(F.col(key).isNotNull() & F.col("ts").isNotNull())
    order = Window.partitionBy(key, "device_id", F.coalesce("display_id", F.lit(-1)), F.floor(F.col("ts") / 86_400_000)).orderBy("ts", "id")
    rows = rows.withColumn("gap", F.least(F.col("ts") - F.lag("ts").over(order), F.lit(DWELL_MS)))
    return rows.groupBy(key).agg(F.coalesce(F.sum("gap"), F.lit(0)).alias("dwell_ms"), F.count("*").alias("observations"))


def app_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-13, AGG-14, AGG-18: rows per app by completeness, first and last time."""
    rows = live_rows(spark, sf_dir).groupBy("app_id").agg(
        F.count("*").alias("observations"), F.count_if(F.col("completeness") == "complete").alias("complete"), F.count_if(F.col("completeness") == "partial").alias("partial"),
        F.count_if(F.col("completeness") == "unavailable").alias("unavailable"), F.count_if(F.col("source_state") != "ok").alias("not_ok"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )
    return rows.join(table(spark, sf_dir, "apps").select(F.col("id").alias("app_id"), "bundle_id", "name"), "app_id", "left")


def capture_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-15: rows and mean confidence of recognised texts per app and method."""
    rows = live_rows(spark, sf_dir).select("device_id", F.col("id").alias("observation_id"), "app_id", "capture_method")
    shown = table(spark, sf_dir, "occurrences").dropDuplicates(["device_id", "id"])
    return rows.join(shown, ["device_id", "observation_id"]).groupBy("app_id", "capture_method").agg(F.count("*").alias("texts"), F.round(F.avg("confidence"), 6).alias("confidence"))


def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-16, AGG-17, AGG-21: sizes of the store, rows of its own and imported ones, and how often texts repeat."""
    obs = once(table(spark, sf_dir, "observations")).agg(F.count("*").alias("observations"), F.count("origin_device").alias("imported"), F.count("deleted_at").alias("deleted"))
    texts = table(spark, sf_dir, "text_versions").agg(F.count("*").alias("texts"), F.sum(F.octet_length("text")).alias("bytes"))
    shown = table(spark, sf_dir, "occurrences").dropDuplicates(["device_id", "id"]).agg(F.count("*").alias("shown"))
    out = obs.join(texts).join(shown)  # one row each
    return out.withColumn("repeat_rate", F.round(1 - F.col("texts") / F.nullif("shown", F.lit(0)), 6))


def context(spark: SparkSession, sf_dir: str, start: int, end: int, tokens: int = 2000) -> list[str]:
    """EVD-5: header lines and the newest snippets of a range within a budget of tokens."""
    rows = live_rows(spark, sf_dir, start, end)
    names = table(spark, sf_dir, "apps").select(F.col("id").alias("app_id"), "name")
    apps = rows.join(names, "app_id").groupBy("name").count().orderBy(F.desc("count"), "name").limit(8).collect()
    lines = [f"{r['name']}: {r['count']}" for r in apps]
    left = tokens - sum(-(-len(x) // 2) for x in lines)
    wanted = max(8, tokens // 16)
    newest = rows.orderBy(F.desc("ts"), F.desc("device_id"), F.desc("id")).limit(wanted).select("device_id", "id", "ts")
    texts = texts_of(spark, sf_dir).join(newest, ["device_id", "id"]).orderBy(F.desc("ts"), F.desc("device_id"), F.desc("id")).select("text").collect()
    for r in texts:
        if left <= 8:
            break
        most = 2 * min(left - 8, 200)
        body = (r["text"] or "").replace("\n", " ")
        body = body if len(body) <= most else body[: most - 1] + "…"
        cost = -(-len(body) // 2)
        if cost > left:
            break
        lines.append(body)
        left -= cost
    return lines


def context_lines(spark: SparkSession, sf_dir: str, start: int, end: int) -> DataFrame:
    rows = [(i, x) for i, x in enumerate(context(spark, sf_dir, start, end))]
    return spark.createDataFrame(rows, "k int, line string")


def opaque_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "text_versions").where("text is not null")
    return rows.select("vrow", F.size(T.opaque_tokens(F.col("text"))).alias("opaque"))
