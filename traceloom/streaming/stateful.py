"""Stateful operators on streams (STR-1, STR-2, STR-10, STR-11) and streams into the store (WR-1, SYN-3)."""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from traceloom.store import shared_dir

QUIET_MS, HOLD_MS = 3_000, 60_000  # fixed values
CALLS, SPAN_MS, CLIENTS = 60, 60_000, 256  # fixed values


@dataclass
class Coalescer:
    """STR-1: the last of the texts that one app and title show in quick succession. It is given out when the key
    changes, after `HOLD_MS` of holding, or when nothing came for `QUIET_MS`."""

    key: str | None = None
    first: int = 0
    last: int = 0
    text: str | None = None
    held: int = 0

    def put(self, ts: int, key: str, text: str | None) -> tuple | None:
        out = None
        if self.held and (key != self.key or ts - self.first > HOLD_MS or ts - self.last > QUIET_MS):
            out = self.flush()
        if not self.held:
            self.key, self.first = key, ts
        self.last, self.text, self.held = ts, text, self.held + 1
        return out

    def flush(self) -> tuple:
        out = (self.key, self.first, self.last, self.text, self.held)
        self.key, self.text, self.held = None, None, 0
        return out


COALESCED = "device_id string, key string, first_ts long, last_ts long, text string, held int"
STATE = "key string, first long, last long, text string, held int"


def coalesce_rows(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    c = Coalescer(*state.get) if state.exists else Coalescer()
    out = []
    if state.hasTimedOut:
        out.append(c.flush())
        state.remove()
    else:
        rows = pd.concat(list(frames)).sort_values(["ts", "key"], kind="stable")
        for ts, k, text in zip(rows["ts"], rows["key"], rows["text"]):
            if (done := c.put(int(ts), k, text)) is not None:
                out.append(done)
        state.update((c.key, c.first, c.last, c.text, c.held))
        state.setTimeoutDuration(QUIET_MS)
    yield pd.DataFrame([(key[0], *r) for r in out], columns=["device_id", "key", "first_ts", "last_ts", "text", "held"])


def coalesced(stream: DataFrame) -> DataFrame:
    """Stream (device_id, ts, key, text) to the texts that are kept; state per device is one text."""
    return stream.groupBy("device_id").applyInPandasWithState(coalesce_rows, COALESCED, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


@dataclass
class RateLimiter:
    """STR-2: at most `CALLS` allowed calls of a client in any `SPAN_MS`; denied ones don't count. Of more than
    `CLIENTS` clients the one unused for longest is forgotten."""

    calls: int = CALLS
    span: int = SPAN_MS
    clients: int = CLIENTS
    seen: OrderedDict = field(default_factory=OrderedDict)

    def allow(self, client: str, now: int) -> bool:
        times = self.seen.setdefault(client, deque())
        self.seen.move_to_end(client)
        if len(self.seen) > self.clients:
            self.seen.popitem(last=False)
        while times and now - times[0] >= self.span:
            times.popleft()
        if len(times) >= self.calls:
            return False
        times.append(now)
        return True


@dataclass
class AuditBuffer:
    """STR-11: the last `most` notes that wait; older ones are dropped and counted."""

    most: int = 200
    waiting: deque = field(default_factory=deque)
    dropped: int = 0

    def put(self, note: object) -> None:
        self.waiting.append(note)
        if len(self.waiting) > self.most:
            self.waiting.popleft()
            self.dropped += 1


@dataclass
class Dwell:
    """SES-12, STR-10: time of an app from ticks: a tick counts the time since the last one, `most` at most; a longer
    gap ends the interval; time counts as active while the device is idle for less than `idle`."""

    most: int = 5_000
    idle: int = 60_000
    least: int = 1_000
    app: str | None = None
    start: int = 0
    last: int = 0
    dwell: int = 0
    active: int = 0

    def tick(self, now: int, app: str, idle_ms: int) -> tuple | None:
        out, delta = None, now - self.last
        if self.app is not None and delta <= self.most:
            self.dwell += max(0, delta)
            self.active += max(0, delta) if idle_ms < self.idle else 0
        if self.app is not None and (app != self.app or delta > self.most):
            out = (self.app, self.start, self.last if delta > self.most else now, self.dwell, self.active) if self.dwell >= self.least else None
            self.app = None
        if self.app is None:
            self.app, self.start, self.dwell, self.active = app, now, 0, 0
        self.last = now
        return out


def observation_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/observations.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/observations.parque[t]")  # a pattern may name a file or a folder


def finished(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there and gives its last result as a table in the shared folder."""
    import uuid

    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = stream.schema

    def write(df: DataFrame, _: int) -> None:
        df.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/out")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/out")


def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per hour and app as a stream; copies are dropped within the watermark."""
    rows = observation_stream(spark, sf_dir).where("ts is not null and deleted_at is null").withColumn("at", F.timestamp_millis("ts"))
    rows = rows.dropDuplicates(["device_id", "id"])
    counts = rows.groupBy(F.window("at", "1 hour").alias("w"), "app_id").agg(F.count("*").alias("observations"))
    out = counts.select(F.unix_millis("w.start").alias("start_ts"), "app_id", "observations")
    return finished(out)


def recorded(stream: DataFrame, path: str, key: list[str]):
    """WR-1, SYN-3: a stream written to a table, each key once, also if batches are delivered again."""

    def write(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        rows = df.dropDuplicates(key)
        try:
            known = spark.read.parquet(path)
            rows = rows.join(known.where(F.col("_batch") != batch).select(*key), key, "left_anti")
        except Exception:  # the first batch finds no table
            pass
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        rows.withColumn("_batch", F.lit(batch)).write.mode("overwrite").partitionBy("_batch").parquet(path)

    return stream.writeStream.foreachBatch(write)
