"""Distinct-word shuffle: texts become lists of positions in the dictionary of their batch, so that what is worked out
for a word is worked out once for all texts.

Texts are split into words, batch by batch; each batch keeps a dictionary of its distinct words. Only the dictionaries
are shuffled by word (a word comes once per batch, however often it is written, so frequent words make no hot key);
whatever is derived for a distinct word is joined back to the dictionaries, and each batch is put together again from
its dictionary and its lists of positions. A batch ends at `BATCH_CHARS` characters or earlier; a text is never cut.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from traceloom.store import written

BATCH_CHARS = 4_000_000
ENCODED = "batch long, key long, places array<int>, words array<string>"


def encode_of(split: Callable[[str], list[str]], notes: bool = False):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            n = len(keys)
            flat = pa.array(np.concatenate(places) if places else np.zeros(0, np.int32), pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in places])), pa.int32()), flat)
            words = pa.array([None] * n + [list(known)], pa.list_(pa.string()))
            lists = pa.concat_arrays([lists, pa.array([None], pa.list_(pa.int32()))])
            keys_ = [*keys, None]
            if noted:
                words = pa.concat_arrays([words, pa.array([list(noted)], pa.list_(pa.string()))])
                lists = pa.concat_arrays([lists, pa.array([list(noted.values())], pa.list_(pa.int32()))])
                keys_.append(None)
            cols = [pa.array([number] * len(keys_), pa.int64()), pa.array(keys_, pa.int64()), lists, words]
            return pa.RecordBatch.from_arrays(cols, ["batch", "key", "places", "words"])

        keys, places, known, chars, noted = [], [], {}, 0, Counter()
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = split(text) if text else ([], ()) if notes else []
                if notes:
                    found, also = found
                    noted.update(also)
                keys.append(key)
                places.append(np.fromiter((known.setdefault(w, len(known)) for w in found), np.int32, len(found)))
                chars += len(text or "")
                if chars >= BATCH_CHARS or len(keys) >= 20_000:
                    yield flush()
                    number, keys, places, known, chars, noted = number + 1, [], [], {}, 0, Counter()
        if keys:
            yield flush()

    return of


def encoded(texts: DataFrame, split: Callable[[str], list[str]], notes: bool = False) -> DataFrame:
    """(key, text) rows as written batches: a row per text with its places, and a row per batch (null places) with its
    words. Null and empty texts have no words. A key may come more than once; each row stays a row. With `notes`, split
    gives a second list, whose strings are counted per batch in a row of their own (see `noted`)."""
    return written(texts.mapInArrow(encode_of(split, notes), ENCODED), "words")


def noted(batches: DataFrame) -> DataFrame:
    """(word, n) of the notes over all batches."""
    rows = batches.where("words is not null and places is not null").select(F.explode(F.arrays_zip("words", "places")).alias("w"))
    return rows.groupBy(F.col("w.words").alias("word")).agg(F.sum("w.places").alias("n"))


def dictionary(batches: DataFrame) -> DataFrame:
    """(batch, place, word)."""
    return batches.where("words is not null and places is null").select("batch", F.posexplode("words").alias("place", "word"))


def resolved(batches: DataFrame, values: DataFrame, kind: str, out: str, of: Callable) -> DataFrame:
    """Joins `values` (word, value) back. `of` streams each batch: called with (its values in order of place, null
    where a word has none; keys; places) it gives record batches of schema `out`."""
    found = dictionary(batches).join(values, "word", "left").select("batch", F.lit(0).alias("part"), "place", "value", F.lit(None).cast("long").alias("key"), F.lit(None).cast("array<int>").alias("places"))
    texts = batches.where("words is null").select("batch", F.lit(1).alias("part"), F.lit(0).alias("place"), F.lit(None).cast(kind).alias("value"), "key", "places")
    rows = found.unionByName(texts).repartition("batch").sortWithinPartitions("batch", "part", "place")

    def stream(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values: list[pa.Array] = []
        now = table = None
        for b in rows:
            ids, part = np.asarray(b.column("batch")), np.asarray(b.column("part"))
            cuts = np.append(np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (part[1:] != part[:-1]))), len(ids))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if ids[lo] != now:
                    now, values, table = ids[lo], [], None
                if part[lo] == 0:
                    values.append(b.column("value").slice(lo, hi - lo))
                    continue
                if table is None:
                    table = pa.concat_arrays(values) if values else b.column("value").slice(0, 0)
                yield of(table, b.column("key").slice(lo, hi - lo), b.column("places").slice(lo, hi - lo))

    return rows.mapInArrow(stream, out)
