"""Periods of use of a device (problem 6), by occupancy bitmaps.

Each device has a bitmap of the time line at the resolution of its times (1 ms), in blocks of fixed length. A bitmap of
this resolution is sparse, so it is held in run containers: sorted pairs of the first and the last set bit. Closing it
with an element as long as the gap is a dilation by doubling shifts (B |= B << 1, << 2, << 4, ...; on run containers a
shift-or lengthens every run and fuses those that meet, exact because a run is never shorter than the next shift)
followed by one erosion, which trims the ends. What is left are the periods within a block; counts are joined by
searching each event's run. Only the first and the last run of a block can go on in a neighbouring block, so only these
meet in a second step, whose rows per device are bounded by the length of the time line, not by the number of events.

Rows without ts have no place on the time line and are left out; a null device is a device of its own; a row delivered
twice counts once; equal times are one bit but count as often as there are rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from traceloom.store import BLOCK_MS, GAP_MS, block, live

RUNS = "device_id string, block long, start long, end long, n long, apps array<struct<app_id:bigint,n:bigint>>, edge boolean"


def fuse(group: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs that overlap or touch become one."""
    first = np.ones(len(lo), bool)
    first[1:] = (group[1:] != group[:-1]) | (lo[1:] > hi[:-1] + 1)
    last = np.append(first[1:], True)
    return group[first], lo[first], hi[last]


def closed(group: np.ndarray, ts: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Closing of the bitmaps of sorted (group, ts) so that bits less than `gap` apart become one run."""
    lo = hi = ts
    if gap < 2:
        first = np.ones(len(ts), bool)
        first[1:] = (group[1:] != group[:-1]) | (ts[1:] != ts[:-1])
        return group[first], ts[first], ts[first]
    group, lo, hi = fuse(group, lo, hi)
    left, shift = gap - 2, 1  # runs that touch are one, so a dilation by gap - 2 joins distances up to gap - 1
    while left > 0:
        k = min(shift, left)
        group, lo, hi = fuse(group, lo, hi + k)
        left, shift = left - k, shift * 2
    return group, lo, hi - (gap - 2)


def merged(a: dict, b: dict) -> dict:
    for k, n in b.items():
        a[k] = a.get(k, 0) + n
    return a


def block_runs(gap: int):
    """Streams rows sorted by device, block, ts, id; emits the runs of each block. Holds one open run at a time."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict | None = None  # the last run seen, not yet emitted
        last_key = last_row = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.table(b)
            dev = t.column("device_id").combine_chunks().dictionary_encode()
            dev = dev.combine_chunks() if isinstance(dev, pa.ChunkedArray) else dev
            names = dev.dictionary.to_pylist()
            d = np.asarray(dev.indices.fill_null(-1))
            blk, ts = np.asarray(t.column("block")), np.asarray(t.column("ts"))
            ids = np.asarray(t.column("id").fill_null(-(2**63)))
            app = np.asarray(t.column("app_id").fill_null(-(2**63)))
            name = lambda i: names[i] if i >= 0 else None  # noqa: B023, E731
            # a row delivered twice follows its twin
            keep = np.ones(len(ts), bool)
            keep[1:] = (d[1:] != d[:-1]) | (ts[1:] != ts[:-1]) | (ids[1:] != ids[:-1])
            keep[0] = last_row != (name(d[0]), ts[0], ids[0])
            last_row = (name(d[-1]), ts[-1], ids[-1])
            d, blk, ts, app = d[keep], blk[keep], ts[keep], app[keep]
            if not len(ts):
                continue
            change = np.ones(len(ts), bool)
            change[1:] = (d[1:] != d[:-1]) | (blk[1:] != blk[:-1])
            group = np.cumsum(change) - 1
            at = np.flatnonzero(change)
            g, lo, hi = closed(group, ts, gap)
            # the run of each event: runs are sorted by (group, lo), and so are events
            run = np.cumsum(np.isin(np.arange(len(ts)), _starts(group, ts, g, lo, at))) - 1
            n = np.bincount(run, minlength=len(lo))
            pair = np.lexsort((app, run))
            pr, pp = run[pair], app[pair]
            new = np.ones(len(pr), bool)
            new[1:] = (pr[1:] != pr[:-1]) | (pp[1:] != pp[:-1])
            where = np.flatnonzero(new)
            counts = np.diff(np.append(where, len(pr)))
            bounds = np.searchsorted(pr[where], np.arange(len(lo) + 1))
            apps_v, rows = pp[where], []
            for i in range(len(lo)):
                key = (name(d[at[g[i]]]), int(blk[at[g[i]]]))
                one = {"key": key, "start": int(lo[i]), "end": int(hi[i]), "n": int(n[i]), "apps": dict(zip(apps_v[bounds[i] : bounds[i + 1]].tolist(), counts[bounds[i] : bounds[i + 1]].tolist()))}
                if open_ is not None and open_["key"] == key and one["start"] - open_["end"] < gap:
                    open_ |= {"end": one["end"], "n": open_["n"] + one["n"], "apps": merged(open_["apps"], one["apps"])}
                    continue
                if open_ is not None:
                    open_["edge"] = open_["first"] or open_["key"] != key
                    rows.append(open_)
                one["first"] = key != last_key
                last_key, open_ = key, one
            if rows:
                yield _batch(rows)
        if open_ is not None:
            yield _batch([open_ | {"edge": True}])

    return of


def _starts(group: np.ndarray, ts: np.ndarray, g: np.ndarray, lo: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Index of the first event of each run; `at` has the first event of each group, less than a block before the last."""
    span = np.int64(BLOCK_MS)
    return np.searchsorted(group * span + (ts - ts[at][group]), g * span + (lo - ts[at][g]))


def _batch(rows: list[dict]) -> pa.RecordBatch:
    none = -(2**63)
    apps = [[{"app_id": None if k == none else k, "n": v} for k, v in r["apps"].items()] for r in rows]
    kind = pa.list_(pa.struct([("app_id", pa.int64()), ("n", pa.int64())]))
    cols = [pa.array([r["key"][0] for r in rows], pa.string()), pa.array([r["key"][1] for r in rows], pa.int64())]
    cols += [pa.array([r[c] for r in rows], pa.int64()) for c in ("start", "end", "n")]
    cols += [pa.array(apps, kind), pa.array([bool(r["edge"]) for r in rows], pa.bool_())]
    return pa.RecordBatch.from_arrays(cols, ["device_id", "block", "start", "end", "n", "apps", "edge"])


def periods(rows: DataFrame, gap: int = GAP_MS) -> DataFrame:
    """(device_id, start_ts, end_ts, n, apps) of each period of rows (device_id, id, ts, app_id)."""
    rows = rows.where("ts is not null").select("device_id", "id", "ts", "app_id", block().alias("block"))
    rows = rows.repartition("device_id", "block").sortWithinPartitions("device_id", "block", "ts", "id")
    runs = rows.mapInArrow(block_runs(gap), RUNS)
    # edge runs of a device meet in one window, inner runs stay with their block (where each begins a period)
    slot = F.when(~F.col("edge"), F.col("block"))
    order = Window.partitionBy("device_id", "edge", "slot").orderBy("start")
    begins = F.coalesce(F.col("start") - F.lag("end").over(order) >= gap, F.lit(True)).cast("int")
    out = runs.withColumn("slot", slot).withColumn("begins", begins)
    out = out.withColumn("period", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # the lists that are collected here are as many as a period has blocks
    apps = F.flatten(F.collect_list("apps")).alias("apps")
    out = out.groupBy("device_id", "edge", "slot", "period").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"), apps)
    return out.select("device_id", F.col("start").alias("start_ts"), F.col("end").alias("end_ts"), "n", "apps")


def device_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, end, duration and number of live observations of each period."""
    return periods(live(spark, sf_dir, "ts", "app_id")).select("device_id", "start_ts", "end_ts", (F.col("end_ts") - F.col("start_ts")).alias("duration_ms"), F.col("n").alias("observations"))


def period_apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live observations per app of each period; rows without an app count under null."""
    each = periods(live(spark, sf_dir, "ts", "app_id")).select("device_id", "start_ts", F.explode("apps").alias("a"))
    return each.groupBy("device_id", "start_ts", F.col("a.app_id").alias("app_id")).agg(F.sum("a.n").alias("observations"))


def period_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods(live(spark, sf_dir, "ts", "app_id")).select("device_id", "start_ts", "end_ts")
