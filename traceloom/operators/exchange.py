"""Exchange between devices and archives (SYN-1 to SYN-9, SUP-10 to SUP-17)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from traceloom.operators.deletion import ID_BLOCK, deleted_intervals, observations
from traceloom.operators.order import positions
from traceloom.store import table

SEGMENT = 2000  # fixed value: observations of a segment


def segments(spark: SparkSession, sf_dir: str, after: int = 0) -> DataFrame:
    """SYN-1: a device's own rows behind a watermark, cut into numbered segments: what each holds."""
    rows = observations(spark, sf_dir).where(F.col("origin_device").isNull() & (F.col("id") > after)).select("device_id", "id", "deleted_at")
    rows = positions(rows, ["device_id", "id"])
    first = rows.groupBy("device_id").agg(F.min("position").alias("first"))
    rows = rows.join(first, "device_id").withColumn("seq", F.floor((F.col("position") - F.col("first")) / SEGMENT) + 1)
    return rows.groupBy("device_id", "seq").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("observations"), F.count("deleted_at").alias("deleted"))


def segment_gaps(have: DataFrame) -> DataFrame:
    """SYN-5, SUP-17: (device_id, upto, missing) of received (device_id, seq): import stops before the first gap."""
    have = have.select("device_id", "seq").distinct()
    follow = have.select("device_id", (F.col("seq") - 1).alias("seq"), F.lit(True).alias("goes_on"))
    ends = have.join(follow, ["device_id", "seq"], "left").where("goes_on is null").groupBy("device_id").agg(F.min("seq").alias("run"), F.max("seq").alias("last"), F.lit(None).cast("long").alias("x"))
    begin = have.groupBy("device_id").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    upto = F.when(F.col("first") == 1, F.col("run")).otherwise(0)
    return ends.join(begin, "device_id").select("device_id", upto.alias("upto"), (F.col("last") - F.col("n")).alias("missing"))


def gaps_of_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of which every third was lost."""
    return segment_gaps(segments(spark, sf_dir).where("seq % 3 <> 0"))


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SUP-10: device and id that a row has everywhere."""
    rows = observations(spark, sf_dir)
    return rows.select(F.coalesce("origin_device", "device_id").alias("device"), F.coalesce("origin_id", "id").alias("id"), "device_id", F.col("id").alias("local_id"), "deleted_at")


def imported(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """SYN-3, SYN-7: incoming (device, id, ...) rows that aren't there yet, each once; tombstones count as there."""
    return incoming.dropDuplicates(["device", "id"]).join(known.select("device", "id"), ["device", "id"], "left_anti")


def import_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each device lacks of the rows that others have of theirs: counts before and after an import."""
    rows = identities(spark, sf_dir)
    here = rows.where("device <> device_id")
    own = rows.where("device = device_id").select("device", "id")
    new = imported(here, own)
    again = imported(here.select("device", "id").unionByName(new), own)
    return new.agg(F.count("*").alias("new")).join(again.agg(F.count("*").alias("again")))


def covered(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """JN-7, SYN-4: rows (device, id) that lie in a range (device, lo, hi), met in blocks of ids."""
    b = F.explode(F.sequence(F.floor(F.col("lo") / ID_BLOCK), F.floor(F.col("hi") / ID_BLOCK)))
    cut = ranges.select(F.col("device").alias("d"), "lo", "hi", b.alias("b"))
    on = (F.col("device") == F.col("d")) & (F.floor(F.col("id") / ID_BLOCK) == F.col("b")) & F.col("id").between(F.col("lo"), F.col("hi"))
    return rows.join(cut, on, "left_semi")


def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SYN-4: copies on other devices that the sources have deleted."""
    copies = identities(spark, sf_dir).where("device <> device_id and deleted_at is null")
    return covered(copies, deleted_intervals(spark, sf_dir)).select("device", "id", "device_id", "local_id")


def archive(spark: SparkSession, sf_dir: str, path: str, start: int, end: int) -> None:
    """SYN-6, SNK-1: live rows of a range with their texts, in JSON lines by day."""
    rows = observations(spark, sf_dir).where((F.col("ts") >= start) & (F.col("ts") < end) & F.col("deleted_at").isNull())
    rows.withColumn("day", F.floor(F.col("ts") / 86_400_000)).write.partitionBy("day").mode("overwrite").option("compression", "gzip").json(f"{path}/observations")
    shown = table(spark, sf_dir, "occurrences").dropDuplicates(["device_id", "id"]).join(rows.select("device_id", F.col("id").alias("observation_id")), ["device_id", "observation_id"], "left_semi")
    shown.write.mode("overwrite").json(f"{path}/occurrences")
    used = shown.select("device_id", F.col("text_version_id").alias("id")).distinct()
    table(spark, sf_dir, "text_versions").join(used, ["device_id", "id"]).select("device_id", "id", "vrow", "text", F.hex("sha256").alias("sha256")).write.mode("overwrite").json(f"{path}/texts")
    manifest(spark, path).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows and checksum of each table of an archive; the checksum doesn't depend on order or files."""
    out = None
    for name in ("observations", "occurrences", "texts"):
        try:
            rows = spark.read.json(f"{path}/{name}")
        except Exception:  # a table without rows leaves no schema
            continue
        if not rows.columns:
            continue
        one = rows.select(F.xxhash64(*(F.col(f"`{c}`").cast("string") for c in sorted(rows.columns))).alias("h")).agg(F.count("*").alias("rows"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("checksum"))
        one = one.select(F.lit(name).alias("name"), "rows", "checksum")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "name string, rows long, checksum string")


def verified(spark: SparkSession, path: str) -> bool:
    """SYN-8."""
    kept = {(r["name"], r["rows"], r["checksum"]) for r in spark.read.schema("name string, rows long, checksum string").json(f"{path}/manifest").collect()}
    return kept == {(r["name"], r["rows"], r["checksum"]) for r in manifest(spark, path).collect()}


def exported_rows(spark: SparkSession, sf_dir: str, start: int, end: int) -> DataFrame:
    """What an archive of a range would hold, per day."""
    rows = observations(spark, sf_dir).where((F.col("ts") >= start) & (F.col("ts") < end) & F.col("deleted_at").isNull())
    return rows.groupBy(F.floor(F.col("ts") / 86_400_000).alias("day")).agg(F.count("*").alias("rows"))
