"""Deletion with its cascade, expiry by quota, upkeep and integrity (DEL-1 to DEL-11, MNT-1 to MNT-3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from traceloom.operators.order import prefix_sum
from traceloom.operators.slices import id_intervals, session_intervals
from traceloom.store import once, table

ID_BLOCK = 4096
BATCH = 200  # fixed value: observations are expired in batches


def escaped(text: str) -> str:
    """FLT-3: text for LIKE, without wildcards of its own."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(table(spark, sf_dir, "observations"))


def chosen(spark: SparkSession, sf_dir: str, app: str | None = None, start: int | None = None, end: int | None = None, host: str | None = None, url_prefix: str | None = None, path_prefix: str | None = None, title: str | None = None) -> DataFrame:
    """DEL-1 to DEL-4: (device_id, id) of live observations of an app, time range (half-open) or object."""
    if start is not None and end is not None and start >= end:
        raise ValueError("start must be before end")
    rows = observations(spark, sf_dir).where("deleted_at is null")
    if start is not None:
        rows = rows.where(F.col("ts") >= start)
    if end is not None:
        rows = rows.where(F.col("ts") < end)

    def keep(name: str, key: str, test: Column) -> None:
        nonlocal rows
        rows = rows.join(table(spark, sf_dir, name).where(test).select(F.col("id").alias(key)), key, "left_semi")

    if app is not None:
        keep("apps", "app_id", F.lower("bundle_id") == app.lower())
    if host is not None:
        keep("urls", "url_id", F.lower("host") == host.lower())
    if url_prefix is not None:
        keep("urls", "url_id", F.startswith(F.lower("canonical_url"), F.lit(url_prefix.lower())))
    if path_prefix is not None:
        keep("files", "file_id", F.startswith(F.lower("path"), F.lit(path_prefix.lower())))
    if title is not None:
        keep("windows", "window_id", F.lower("title") == title.lower())
    return rows.select("device_id", "id")


def left_occurrences(spark: SparkSession, sf_dir: str, gone: DataFrame) -> DataFrame:
    shown = table(spark, sf_dir, "occurrences").dropDuplicates(["device_id", "id"])
    return shown.join(gone.select("device_id", F.col("id").alias("observation_id")), ["device_id", "observation_id"], "left_anti")


def orphans(spark: SparkSession, sf_dir: str, left: DataFrame) -> DataFrame:
    """DEL-6: (device_id, id) of text versions that no occurrence shows any more."""
    used = left.select("device_id", F.col("text_version_id").alias("id"))
    return table(spark, sf_dir, "text_versions").select("device_id", "id").join(used, ["device_id", "id"], "left_anti")


def touched(intervals: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """DEL-7, JN-6: keys of the intervals (device_id, lo, hi) that hold a deleted id. Both sides meet in blocks of ids,
    so no interval is spelt out."""
    blocks = F.explode(F.sequence(F.floor(F.col("lo") / ID_BLOCK), F.floor(F.col("hi") / ID_BLOCK)))
    ids = gone.select("device_id", F.col("id").alias("_id"), F.floor(F.col("id") / ID_BLOCK).alias("b"))
    both = intervals.withColumn("b", blocks).join(ids, ["device_id", "b"]).where("_id between lo and hi")
    return both.select(*keys).distinct()


def cascade(spark: SparkSession, sf_dir: str, gone: DataFrame) -> DataFrame:
    """DEL-5: what a deletion takes with it, as one row of counters."""
    shown = table(spark, sf_dir, "occurrences").dropDuplicates(["device_id", "id"])
    left = left_occurrences(spark, sf_dir, gone)
    before, after = orphans(spark, sf_dir, shown), orphans(spark, sf_dir, left)
    freed = after.join(before, ["device_id", "id"], "left_anti")
    pieces = table(spark, sf_dir, "chunks").join(freed.withColumnRenamed("id", "text_version_id"), ["device_id", "text_version_id"], "left_semi")
    stale = touched(session_intervals(spark, sf_dir), gone, ["device_id", "display", "app", "session"])
    texts = table(spark, sf_dir, "text_versions").join(freed, ["device_id", "id"], "left_semi")
    parts = {
        "observations": gone.agg(F.count("*")), "occurrences": shown.join(gone.select("device_id", F.col("id").alias("observation_id")), ["device_id", "observation_id"], "left_semi").agg(F.count("*")),
        "versions": freed.agg(F.count("*")), "chunks": pieces.agg(F.count("*")), "sessions": stale.agg(F.count("*")), "bytes": texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))),
    }
    out = None
    for name, df in parts.items():
        one = df.toDF("value").select(F.lit(name).alias("what"), F.col("value").cast("long").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def expiry(spark: SparkSession, sf_dir: str, quota: int) -> DataFrame:
    """DEL-8, DEL-9: how many of the oldest observations must go, in batches, until the texts fit into the quota. A
    text is freed with the last observation that shows it; texts that none shows stay."""
    rows = observations(spark, sf_dir).where("ts is not null").select("device_id", "id", "ts")
    shown = table(spark, sf_dir, "occurrences").select("device_id", F.col("observation_id").alias("id"), "text_version_id").distinct()
    last = shown.join(rows, ["device_id", "id"]).groupBy("device_id", "text_version_id").agg(F.max(F.struct("ts", "device_id", "id")).alias("at"))
    sizes = table(spark, sf_dir, "text_versions").select("device_id", F.col("id").alias("text_version_id"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"))
    freed = last.join(sizes, ["device_id", "text_version_id"]).groupBy(F.col("at.device_id").alias("device_id"), F.col("at.id").alias("id")).agg(F.sum("n").alias("n"))
    order = rows.join(freed, ["device_id", "id"], "left").select("ts", "device_id", "id", F.coalesce("n", F.lit(0)).alias("n"), F.lit(1).alias("one"))
    order = prefix_sum(prefix_sum(order, ["ts", "device_id", "id"], "n", "freed"), ["ts", "device_id", "id"], "one", "k")
    used = sizes.agg(F.sum("n").alias("used"))
    enough = order.join(F.broadcast(used)).where(F.col("used") - F.col("freed") <= quota)
    need = enough.agg(F.min("k").alias("need"))
    return used.join(need).select("used", F.when(F.col("used") <= quota, 0).otherwise(F.ceil(F.col("need") / BATCH) * BATCH).alias("expired"), F.when(F.col("used") * 10 >= F.lit(8 * quota), "warn").otherwise("ok").alias("level"))


def deleted_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DEL-11: deleted ids of each source device as intervals."""
    rows = observations(spark, sf_dir).where("deleted_at is not null")
    rows = rows.select(F.coalesce("origin_device", "device_id").alias("device"), F.coalesce("origin_id", "id").alias("id"))
    return id_intervals(rows, ["device"])


def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MNT-1: what the derived tables lack or have too much: four anti joins."""
    texts, pieces = table(spark, sf_dir, "text_versions"), table(spark, sf_dir, "chunks")
    key = ["device_id", "text_version_id"]
    own = texts.select("device_id", F.col("id").alias("text_version_id"), "text")
    parts = {
        "chunks_without_text": pieces.join(own, key, "left_anti"),
        "texts_without_chunks": own.join(pieces, key, "left_anti"),
        "embedded_without_model": pieces.where("embedded_at is not null and model is null"),
        "pending": pieces.where("embedded_at is null"),
    }
    return _counts(parts)


def _counts(parts: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("value")).select(F.lit(name).alias("what"), "value")
        out = one if out is None else out.unionByName(one)
    return out


def retained(spark: SparkSession, sf_dir: str, now: int, days: int = 30) -> DataFrame:
    """MNT-2: tombstones older than the retention, per device."""
    return observations(spark, sf_dir).where(F.col("deleted_at") < now - days * 86_400_000).groupBy("device_id").agg(F.count("*").alias("expired"))


def integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MNT-3, JN-4, JN-5: counts of what should not be there."""
    raw, obs = table(spark, sf_dir, "observations"), observations(spark, sf_dir)
    shown, texts = table(spark, sf_dir, "occurrences"), table(spark, sf_dir, "text_versions")

    def dangling(key: str, name: str) -> DataFrame:
        return obs.where(F.col(key).isNotNull()).join(table(spark, sf_dir, name).select(F.col("id").alias(key)), key, "left_anti")

    def repeated(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")

    here = obs.select("device_id", F.col("id").alias("observation_id"), "deleted_at")
    return _counts({
        "app_missing": dangling("app_id", "apps"), "window_missing": dangling("window_id", "windows"), "url_missing": dangling("url_id", "urls"), "file_missing": dangling("file_id", "files"),
        "occurrence_without_observation": shown.join(here, ["device_id", "observation_id"], "left_anti"),
        "occurrence_without_text": shown.join(texts.select("device_id", F.col("id").alias("text_version_id")), ["device_id", "text_version_id"], "left_anti"),
        "occurrence_of_deleted": shown.join(here.where("deleted_at is not null"), ["device_id", "observation_id"], "left_semi"),
        "text_never_shown": orphans(spark, sf_dir, shown), "observation_twice": repeated(raw, "device_id", "id"), "occurrence_twice": repeated(shown, "device_id", "id"),
        "text_twice": repeated(texts, "device_id", "sha256"), "byte_len_wrong": texts.where(F.col("byte_len") != F.octet_length("text")),
        "hash_wrong": texts.where(F.lower(F.hex("sha256")) != F.sha2(F.encode("text", "UTF-8"), 256)), "window_without_app": table(spark, sf_dir, "windows").join(table(spark, sf_dir, "apps").select(F.col("id").alias("app_id")), "app_id", "left_anti"),
        "thumb_of_deleted": obs.where("deleted_at is not null and thumb_ref is not null"), "ts_missing": obs.where("ts is null"),
    })
