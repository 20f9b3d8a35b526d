"""Building the store: dimensions, content-addressed texts, late attachments, last write wins (WR-1 to WR-8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from traceloom.operators.order import positions
from traceloom.store import once, table


def upserted(known: DataFrame, incoming: DataFrame, key: str, order: str, columns: list[str], id_: str = "id") -> DataFrame:
    """WR-2: rows of `incoming` whose natural key isn't known yet, one per key (the first by `order` wins), with new
    ids behind the largest known one. Keys are compared without case; null keys are no rows."""
    fresh = incoming.where(F.col(key).isNotNull()).withColumn("_k", F.lower(key)).join(known.select(F.lower(key).alias("_k")).distinct(), "_k", "left_anti")
    first = fresh.groupBy("_k").agg(F.min_by(F.struct(key, *columns), F.struct(order, key)).alias("r")).select("_k", "r.*")
    top = known.agg(F.max(id_)).first()[0] or 0
    return positions(first, ["_k"], id_, top).select(id_, key, *columns)


def content_addressed(rows: DataFrame, device: str, text: str, order: list[str]) -> DataFrame:
    """WR-3, WR-5: one version per device and SHA-256 of the raw text (no folding before): when it was first seen, and
    how many rows used it again. Null text has no version."""
    digest = F.sha2(F.encode(text, "UTF-8"), 256)
    rows = rows.where(F.col(text).isNotNull()).select(F.col(device).alias("device"), digest.alias("sha256"), F.octet_length(text).alias("byte_len"), F.struct(*order).alias("o"))
    return rows.groupBy("device", "sha256").agg(F.max("byte_len").alias("byte_len"), F.min("o").alias("first_seen"), (F.count("*") - 1).alias("reused"))


def attached(occurrences: DataFrame, late: DataFrame) -> DataFrame:
    """WR-4: (device_id, observation_id, text_version_id, ord) of texts that come late: ord goes on behind the last."""
    last = occurrences.groupBy("device_id", "observation_id").agg(F.max("ord").alias("last"))
    from pyspark.sql import Window

    order = Window.partitionBy("device_id", "observation_id").orderBy("text_version_id")  # texts of one observation
    rows = late.withColumn("k", F.row_number().over(order)).join(last, ["device_id", "observation_id"], "left")
    return rows.select("device_id", "observation_id", "text_version_id", (F.coalesce("last", F.lit(-1)) + F.col("k")).cast("int").alias("ord"))


def latest(rows: DataFrame, key: str, order: list[Column | str], columns: list[str]) -> DataFrame:
    """WR-7: last write wins."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("r")).select(key, "r.*")


def apps_from_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apps that a feed adds to a store that knows those of the first half of the alphabet."""
    apps = table(spark, sf_dir, "apps").select("id", "bundle_id", "name")
    return upserted(apps.where("lower(name) < 'n'"), apps.where("lower(name) >= 'l'"), "bundle_id", "name", ["name"])


def versions_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions that the occurrences of each device build, in order of the occurrences' ids."""
    shown = table(spark, sf_dir, "occurrences").dropDuplicates(["device_id", "id"])
    texts = table(spark, sf_dir, "text_versions").select("device_id", F.col("id").alias("text_version_id"), "text")
    rows = content_addressed(shown.join(texts, ["device_id", "text_version_id"]), "device_id", "text", ["id"])
    return rows.select("device", "sha256", "byte_len", F.col("first_seen.id").alias("first_id"), "reused")


def late_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each device's first text attached late to all observations that show its second."""
    shown = table(spark, sf_dir, "occurrences").dropDuplicates(["device_id", "id"])
    late = shown.where("text_version_id = 2").select("device_id", "observation_id", F.lit(1).cast("long").alias("text_version_id")).distinct()
    return attached(shown, late)


def window_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window that each app of a device showed last."""
    rows = once(table(spark, sf_dir, "observations").where("deleted_at is null and app_id is not null and ts is not null"))
    return rows.groupBy("device_id", "app_id").agg(F.max_by("window_id", F.struct("ts", "id")).alias("window_id"), F.max("ts").alias("ts"))


def dense_url_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(table(spark, sf_dir, "urls").select("raw_locator"), ["raw_locator"], "id", 1000)
