"""Repeated consecutive events (problem 2): each run of one screen becomes one row with its count and duration.

The stream of a device and display is cut into blocks of time, so that no device is one task. Within a block an event's
value is its app and the canonical form of its window's title; a gap of GAP_MS begins a new segment. The row number
within the block less the row number within the block and value is constant along a run and identifies it. Only the
first and the last run of a block can go on in the next block; these are joined in a second step, whose rows per
display are bounded by the number of blocks.

Null equals null: a null display is a display of its own, rows without app or window form runs with each other. Rows
without ts have no place in the order and are left out. A row delivered twice counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from traceloom.store import GAP_MS, block, live, table

SALTS = 8

#: Passing state of a window before and behind what its title names: activity marks, counts of unread items, positions
#: in a list, percentages, clock times, and words such as saving or not responding.
MARK = r"(?:[\x{25CF}\x{2022}\x{25CB}\x{25E6}\x{25C9}*\x{27F3}\x{27F2}\x{21BB}\x{2731}\x{2733}\x{23F8}\x{25B6}\x{23F5}\x{2800}-\x{28FF}\x{1F507}-\x{1F50A}\x{1F514}\x{1F515}\x{1F534}]\x{FE0F}?)"
UNREAD = r"\(\d+\+?(?: ?(?:条未读|unread|new|neue|ungelesen|non lus?|sin leer|não lidas?|непрочитанн\p{L}*))?\)"
BEFORE = rf"(?:{MARK}|{UNREAD}|\[\d+/\d+\]|\d+ ?%)"
STATE = r"(?:saving|saved|not responding|loading|edited|modified|paused|muted|read[- ]only|offline|syncing)"
BEHIND = (
    rf"(?:…|\.\.\.|{MARK}|{UNREAD}|\[\d+/\d+\]|\[\d{{1,2}}:\d{{2}}(?::\d{{2}})?\]|\({STATE}[.…]*\)"
    rf"|[-–—] (?:{STATE}|\d+\+? unread|\d+ ?%))"
)


def screen(title: Column) -> Column:
    """What a title names: without passing state, case and runs of spaces. A title of nothing else stays as it is;
    numbers of items, days, versions and parts stay."""
    t = F.lower(F.trim(F.regexp_replace(title, r"[\s\x{A0}]+", " ")))
    t = F.regexp_replace(t, rf"^(?:{BEFORE} ?)+(?=.)", "")
    return F.trim(F.regexp_replace(t, rf"(?<=.)(?: ?{BEHIND})+$", ""))


def with_screens(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """rows with column `screen`. A window that many rows share, and the rows without one, are spread by a salt."""
    salt = F.pmod(F.xxhash64("device_id", "id"), F.lit(SALTS)).cast("int")
    names = windows.select(F.col("id").alias("window_id"), screen(F.col("title")).alias("screen")).where("window_id is not null")
    names = names.dropDuplicates(["window_id"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", salt).join(names, ["window_id", "salt"], "left").drop("salt")


def runs(rows: DataFrame, gap: int = GAP_MS) -> DataFrame:
    """(device_id, display_id, app_id, screen, first_id, last_id, n, start_ts, end_ts) of every run, single rows
    included, of rows (device_id, display_id, id, ts, app_id, screen)."""
    rows = rows.where("ts is not null").select("device_id", "display_id", block().alias("block"), "ts", "id", "app_id", "screen")
    stream = ["device_id", "display_id", "block"]
    order = Window.partitionBy(*stream).orderBy("ts", "id")
    twin = F.col("ts").eqNullSafe(F.lag("ts").over(order)) & F.col("id").eqNullSafe(F.lag("id").over(order))
    rows = rows.withColumn("twin", F.coalesce(twin & (F.row_number().over(order) > 1), F.lit(False))).where("not twin").drop("twin")
    rows = rows.withColumn("k", F.row_number().over(order)).withColumn("is_last", F.lead(F.lit(1)).over(order).isNull())
    gaps = F.coalesce(F.col("ts") - F.lag("ts").over(order) >= gap, F.lit(False)).cast("int")
    rows = rows.withColumn("gap", gaps).withColumn("segment", F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    value = [*stream, "segment", "app_id", "screen"]
    same = Window.partitionBy(*value).orderBy("ts", "id")
    rows = rows.withColumn("run", F.col("k") - F.row_number().over(same))
    at = F.struct("ts", "id")
    found = rows.groupBy(*value, "run").agg(
        F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"), F.min("k").alias("k"), F.max("is_last").alias("is_last")
    )
    # an edge run is the first or the last of its block; the others stay alone in their slot
    found = found.withColumn("edge", (F.col("k") == 1) | F.col("is_last"))
    found = found.withColumn("slot", F.when(~F.col("edge"), F.col("block")))
    chain = Window.partitionBy("device_id", "display_id", "edge", "slot").orderBy("first")
    lag = lambda c: F.lag(c).over(chain)
    goes_on = (
        F.col("edge") & (F.col("block") != lag("block")) & F.col("app_id").eqNullSafe(lag("app_id"))
        & F.col("screen").eqNullSafe(lag("screen")) & (F.col("first.ts") - lag("last.ts") < gap)
    )
    found = found.withColumn("begins", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    found = found.withColumn("whole", F.sum("begins").over(chain.rowsBetween(Window.unboundedPreceding, 0)))
    out = found.groupBy("device_id", "display_id", "edge", "slot", "whole", "app_id", "screen").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")
    )
    return out.select(
        "device_id", "display_id", "app_id", "screen", F.col("first.id").alias("first_id"), F.col("last.id").alias("last_id"),
        "n", F.col("first.ts").alias("start_ts"), F.col("last.ts").alias("end_ts"),
    )


def screen_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = live(spark, sf_dir, "ts", "display_id", "app_id", "window_id")
    return runs(with_screens(rows, table(spark, sf_dir, "windows")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two or more rows."""
    return screen_runs(spark, sf_dir).where("n >= 2").select("device_id", "first_id", "last_id")


def p2_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run, single rows included, with count and duration: the stream without its repetitions."""
    return screen_runs(spark, sf_dir).withColumn("duration_ms", F.col("end_ts") - F.col("start_ts")).drop("end_ts")
