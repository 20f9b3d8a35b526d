"""Filling containers of fixed capacity (problem 8), by bounded-space online packing.

Each partition keeps a fixed number of open containers. An item goes to the open container that it fills best; if it
fits none, the fullest one is emitted and a new one opened. What is open at the end of a partition are leftovers; these
are merged as items of their own, FAN_IN partitions at a time, until one partition is left, so that no step sees more
than FAN_IN times the number of open containers in a task.

Only an item over the capacity is divided: full containers are cut from its front, the rest is an item like others.
Items of size 0 take no space and go to any container; null size counts as 0. Equal items and repeated keys are items
each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from traceloom.llm.tokens import documents, token_counts
from traceloom.store import table, written

OPEN = 256
FAN_IN = 16


class Packer:
    """Open containers by room left; `sizes` has a bit for each room that some container has."""

    def __init__(self, capacity: int, base: int):
        self.capacity, self.next = capacity, base
        self.rooms: dict[int, list[int]] = {}
        self.mask, self.count = 0, 0
        self.closed: list[int] = []

    def _leave(self, room: int, bin_: int) -> None:
        self.rooms.setdefault(room, []).append(bin_)
        self.mask |= 1 << room
        self.count += 1

    def _take(self, room: int) -> int:
        left = self.rooms[room]
        bin_ = left.pop()
        if not left:
            del self.rooms[room]
            self.mask &= ~(1 << room)
        self.count -= 1
        return bin_

    def put(self, size: int) -> int:
        """Container for an item of at most the capacity."""
        fits = self.mask >> size
        if fits:
            room = size + ((fits & -fits).bit_length() - 1)
            bin_ = self._take(room)
        else:
            if self.count >= OPEN:
                self._take((self.mask & -self.mask).bit_length() - 1)  # the fullest is emitted
            bin_, room = self.next, self.capacity
            self.next += 1
        if room > size:
            self._leave(room - size, bin_)
        return bin_

    def open(self) -> list[tuple[int, int]]:
        return [(b, self.capacity - room) for room, bins in self.rooms.items() for b in bins]


PLACED = "bin long, key long, part int, from_token int, n_tokens int, fill int"


def pack_of(capacity: int):
    """Rows (key, tokens) to rows of items with their container; then rows (null key) for the containers left open."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Packer(capacity, TaskContext.get().partitionId() << 36)

        def rows_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["bin", "key", "part", "from_token", "n_tokens", "fill"])

        for b in batches:
            rows = []
            for key, size in zip(b.column("key").to_pylist(), b.column("tokens").to_pylist()):
                size, at, part = size or 0, 0, 0
                while size - at > capacity:
                    rows.append((p.next, key, part, at, capacity, None))
                    p.next, at, part = p.next + 1, at + capacity, part + 1
                rows.append((p.put(size - at), key, part, at, size - at, None))
            if rows:
                yield rows_of(rows)
        if left := p.open():
            yield rows_of([(bin_, None, -1, 0, 0, fill) for bin_, fill in left])

    return of


def merge_of(capacity: int, level: int):
    """Containers left open (bin, fill, ...) to (bin, to, fill): the container that each goes to."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(((f, b) for x in batches for b, f in zip(x.column("bin").to_pylist(), x.column("fill").to_pylist())), reverse=True)
        p = Packer(capacity, (level << 58) | (TaskContext.get().partitionId() << 36))
        to = [(b, p.put(f)) for f, b in rows]
        fill: dict[int, int] = {}
        for (f, _), (_, t) in zip(rows, to):
            fill[t] = fill.get(t, 0) + f
        if to:
            cols = [pa.array([b for b, _ in to], pa.int64()), pa.array([t for _, t in to], pa.int64()), pa.array([fill[t] for _, t in to], pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, ["bin", "to", "fill"])

    return of


def packed(sizes: DataFrame, capacity: int) -> DataFrame:
    """(bin, key, part, from_token, n_tokens) of rows (key, tokens): tokens from_token .. from_token + n_tokens - 1 of
    the item lie in container bin."""
    rows = written(sizes.mapInArrow(pack_of(capacity), PLACED), "packed")
    left = rows.where("key is null and part = -1").select("bin", "fill")
    partitions, level = max(1, rows.rdd.getNumPartitions()), 1
    maps = None  # original container -> container so far
    while True:
        partitions = math.ceil(partitions / FAN_IN)
        step = left.repartition(partitions).mapInArrow(merge_of(capacity, level), "bin long, to long, fill int")
        step = written(step, "merged")
        links = step.select("bin", F.col("to").alias("new"))
        maps = links.withColumnRenamed("new", "to") if maps is None else maps.join(links.withColumnRenamed("bin", "to"), "to", "left").select("bin", F.coalesce("new", "to").alias("to"))
        if partitions == 1:
            break
        # full enough containers stay; the rest is merged again
        left = step.where(F.col("fill") < capacity).select(F.col("to").alias("bin"), "fill").distinct()
        level += 1
    items = rows.where("part >= 0").drop("fill")
    return items.join(maps, "bin", "left").select(F.coalesce("to", "bin").alias("bin"), "key", "part", "from_token", "n_tokens")


def document_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(token_counts(documents(spark, sf_dir)), "sizes")


def limits(spark: SparkSession, sf_dir: str) -> list[tuple[str, int]]:
    rows = table(spark, sf_dir, "size_limits").where("unit = 'tokens' and capacity > 0").select("name", "capacity").distinct().collect()
    return sorted((r["name"], r["capacity"]) for r in rows)


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in containers of each limit in tokens; no rows if there is none."""
    sizes = document_sizes(spark, sf_dir)
    out = None
    for name, capacity in limits(spark, sf_dir):
        part = packed(sizes, capacity).select(F.lit(name).alias("container"), "bin", F.col("key").alias("doc_id"), "part", "from_token", "n_tokens")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "container string, bin long, doc_id long, part int, from_token int, n_tokens int")


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used per limit, and the fewest that the total could need."""
    each = p8_containers(spark, sf_dir).groupBy("container", "bin").agg(F.sum("n_tokens").alias("n"))
    caps = table(spark, sf_dir, "size_limits").select(F.col("name").alias("container"), "capacity")
    out = each.groupBy("container").agg(F.count("*").alias("bins"), F.sum("n").alias("tokens"), F.max("n").alias("fullest")).join(caps, "container")
    return out.select("container", "bins", F.ceil(F.col("tokens") / F.col("capacity")).alias("fewest"), "fullest", "tokens")
