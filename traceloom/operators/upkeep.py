"""Validity of cached ledgers, digests, sizes and gates (AGG-5, AGG-10, AGG-23, SUP-6, SUP-8, SUP-40, STR-3, STR-5, SEA-17, EVA-9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from traceloom.operators import deletion, evaluation
from traceloom.operators.ledger import day_of, iso_week
from traceloom.operators.search import live_rows
from traceloom.operators.slices import sessions
from traceloom.store import table


def fingerprints(rows: DataFrame) -> DataFrame:
    """AGG-5: (day, n, top): what a cached day ledger was built from; it is valid as long as both are the same."""
    return rows.where("ts is not null").groupBy(day_of(F.col("ts")).alias("day")).agg(F.count("*").alias("n"), F.max(F.struct("id", "device_id")).alias("top")).select("day", "n", F.concat_ws(":", F.col("top.id").cast("string"), "top.device_id").alias("top"))


def day_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(live_rows(spark, sf_dir).where("origin_device is null"))


def changed_days(spark: SparkSession, sf_dir: str, gone: DataFrame) -> DataFrame:
    """AGG-5, AGG-10: days whose ledger a deletion makes invalid, and their weeks: only these are worked out again."""
    rows = live_rows(spark, sf_dir).where("origin_device is null")
    now = fingerprints(rows.join(gone, ["device_id", "id"], "left_anti")).withColumnsRenamed({"n": "n2", "top": "top2"})
    out = fingerprints(rows).join(now, "day", "left").where("not (n <=> n2 and top <=> top2)")
    return out.select("day", iso_week(F.col("day")).alias("week"))


def days_to_recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changed_days(spark, sf_dir, deletion.chosen(spark, sf_dir, host="wiki.lumen.test"))


def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-23."""
    rows = live_rows(spark, sf_dir)
    return rows.agg(*(F.count_distinct(c).alias(c) for c in ("device_id", "app_id", "window_id", "url_id", "file_id")))


def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SUP-40: one number for all live rows, whatever their order or files."""
    rows = live_rows(spark, sf_dir).select(F.crc32(F.concat_ws("|", "device_id", F.col("id").cast("string"), F.col("ts").cast("string"))).alias("h"))
    return rows.agg(F.count("*").alias("rows"), F.sum("h").alias("digest"))


def column_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SUP-6: bytes of each text column of the store."""
    parts = (("text_versions", "text"), ("windows", "title"), ("urls", "raw_locator"), ("files", "path"), ("apps", "name"))
    out = None
    for name, c in parts:
        one = table(spark, sf_dir, name).agg(F.coalesce(F.sum(F.octet_length(c)), F.lit(0)).alias("bytes")).select(F.lit(f"{name}.{c}").alias("what"), "bytes")
        out = one if out is None else out.unionByName(one)
    return out


def session_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SUP-8: what a restored store remembers of its sessions."""
    return sessions(spark, sf_dir).agg(F.max(F.col("end_ts") - F.col("start_ts")).alias("longest_ms"), F.max("start_ts").alias("last_start"))


def trigrams(text: Column) -> Column:
    """SEA-17: distinct runs of three signs."""
    t = F.lower(text)
    n = F.length(t)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(t, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def title_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "windows").where("title is not null")
    return rows.select(F.explode(trigrams(F.col("title"))).alias("token")).groupBy("token").agg(F.count("*").alias("titles"))


def recognition_due(changed: Column, empty: Column, since_ms: Column, least_ms: int = 5000) -> Column:
    """STR-3: whether a region is to be read: it changed or gave no text, and the last reading is old enough."""
    return (changed | empty) & F.coalesce(since_ms >= least_ms, F.lit(True))


def gate(checks: list[tuple[str, bool]]) -> str | None:
    """STR-5: the first reason against a job, in the order of the checks."""
    return next((reason for reason, holds in checks if holds), None)


def relevant_after_deletion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVA-9: how many relevant texts of each query are left when the rows of a host are deleted."""
    left = deletion.left_occurrences(spark, sf_dir, deletion.chosen(spark, sf_dir, host="wiki.lumen.test"))
    gone = deletion.orphans(spark, sf_dir, left).join(table(spark, sf_dir, "text_versions").select("device_id", "id", "vrow"), ["device_id", "id"])
    rows = evaluation.relevant(spark, sf_dir).join(gone.select("vrow", F.lit(1).alias("gone")), "vrow", "left")
    return rows.groupBy("query").agg(F.count("*").alias("before"), (F.count("*") - F.count("gone")).alias("after"))
