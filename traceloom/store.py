"""The store's tables and the helpers that every operator shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

GAP_MS = 300_000  # fixed value: an inactivity of this length ends a period or a run
BLOCK_MS = 21_600_000  # streams are cut into blocks of six hours, so that no device is one task


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where none is set (tests in local mode)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if given is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="traceloom-"))
    return sc.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once to the shared folder and read back: later uses neither recompute them nor depend
    on an executor that may be lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def live(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Observations neither deleted nor imported; copies delivered twice are still there (see `once`)."""
    rows = table(spark, sf_dir, "observations").where("deleted_at is null and origin_device is null")
    return rows.select("device_id", "id", *(c for c in columns if c not in ("device_id", "id")))


def once(rows: DataFrame) -> DataFrame:
    """One row for each (device_id, id)."""
    return rows.dropDuplicates(["device_id", "id"])


def block(ts: str = "ts") -> Column:
    """Number of the block of the time line that a time lies in."""
    return F.floor(F.col(ts) / F.lit(BLOCK_MS)).cast("long")
