"""Splitting texts at natural boundaries (problem 4), by pointer doubling.

Every character boundary of a text is joined to its farthest legal successor: the piece that begins there ends at the
last paragraph end in the second half of what the capacity allows, else sentence or line end there, else the last word
end, else the last character boundary; the next piece begins at the last word begin (else character boundary) that
still shares the overlap. The successor table is then squared until the set of cuts reachable from 0 no longer grows:
log2(pieces) rounds give all greedy cuts at once, for all texts of a batch together.

The validity of recorded pieces is decided by the same tables: the successor of a recorded piece is the next one by
`ord`, if the pair is legal; a text's pieces are usable if doubling leads from the first piece to the end of the text.

All positions are UTF-8 bytes of the text itself; byte_len is not read. Null text has size 0. A piece with null
position, or an overlap that leaves no progress, is not usable.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from traceloom.store import table

CHAR, WORD, SENTENCE, PARAGRAPH = 1, 2, 3, 4


def doubled(succ: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """All nodes that are reached from the roots along succ, by squaring it. A node that is its own successor ends."""
    reached, jump = np.unique(roots), succ
    while True:
        more = np.union1d(reached, jump[reached])
        if len(more) == len(reached):
            return reached
        reached, jump = more, jump[jump]


def classes(b: np.ndarray) -> np.ndarray:
    """Class of each byte position 0 .. n as the end of a piece; 0 inside a character."""
    n = len(b)
    out = np.zeros(n + 1, np.int8)
    out[:n][(b & 0xC0) != 0x80] = CHAR
    out[n] = PARAGRAPH
    if not n:
        return out
    space = (b == 32) | (b == 10) | (b == 13) | (b == 9)
    ends = np.flatnonzero(space[:-1] & ~space[1:]) + 1  # a run of white space ends: a word begins
    if len(ends):
        begins = np.flatnonzero(space & ~np.append(False, space[:-1]))  # first byte of each run of white space
        first = begins[np.searchsorted(begins, ends - 1, "right") - 1]
        lines = np.append(0, np.cumsum(b == 10))
        breaks = lines[ends] - lines[first]
        stop = np.isin(b[np.maximum(first - 1, 0)], np.frombuffer(b".!?;:", np.uint8)) & (first > 0)
        out[ends] = np.where(breaks >= 2, PARAGRAPH, np.where((breaks == 1) | stop, SENTENCE, WORD))
    for mark, kind in (("。", SENTENCE), ("！", SENTENCE), ("？", SENTENCE), ("；", SENTENCE), ("，", WORD), ("、", WORD)):
        x, y, z = mark.encode()
        if n >= 3:
            at = np.flatnonzero((b[:-2] == x) & (b[1:-1] == y) & (b[2:] == z)) + 3
            out[at] = np.maximum(out[at], kind)
    return out


def successors(b: np.ndarray, capacity: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes (byte positions where pieces may begin), the end of the piece that begins at each, and the index of the
    node where the next piece begins (its own index where the text ends)."""
    n, kind = len(b), classes(b)
    nodes = np.flatnonzero(kind >= CHAR)
    far = nodes + capacity
    pick = lambda ends, to: np.where((k := np.searchsorted(ends, to, "right")) > 0, ends[np.maximum(k - 1, 0)], -1) if len(ends) else np.full(len(to), -1)
    end = pick(nodes, far)
    for least, low in ((WORD, overlap), (SENTENCE, capacity // 2), (PARAGRAPH, capacity // 2)):
        e = pick(np.flatnonzero(kind >= least), far)
        end = np.where(e > nodes + low, e, end)
    end = np.where(far >= n, n, end)
    begin = pick(nodes, end - overlap)
    w = pick(np.flatnonzero(kind >= WORD), end - overlap)
    begin = np.where((w > nodes) & (w >= begin - overlap), w, begin)
    begin = np.where(begin > nodes, begin, end)  # no room for both overlap and progress: the next begins where this ends
    succ = np.where(end >= n, np.arange(len(nodes)), np.searchsorted(nodes, begin))
    return nodes, end, succ


def pieces_of(capacity: int, overlap: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column("vrow"), batch.column("bytes")
            tables, base = [], 0
            for i, text in enumerate(texts):
                b = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid else np.zeros(0, np.uint8)
                nodes, end, succ = successors(b, capacity, overlap)
                tables.append((np.full(len(nodes), i), nodes, end, succ + base))
                base += len(nodes)
            if not base:
                continue
            text_of, nodes, end, succ = map(np.concatenate, zip(*tables))
            cuts = doubled(succ, np.flatnonzero(np.append(True, text_of[1:] != text_of[:-1])))
            of_text, begin, stop = text_of[cuts], nodes[cuts], end[cuts]
            first = np.flatnonzero(np.append(True, of_text[1:] != of_text[:-1]))
            ord_ = np.arange(len(cuts)) - np.repeat(first, np.diff(np.append(first, len(cuts))))
            cols = [keys.take(pa.array(of_text)), pa.array(ord_, pa.int32()), pa.array(begin, pa.int64()), pa.array(stop - begin, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["vrow", "ord", "offset", "len"])

    return of


def usable(sizes: np.ndarray, inside: list[np.ndarray], lists: list[list], capacity: int, overlap: int) -> np.ndarray:
    """Whether each text's recorded pieces are usable: doubling leads from its first piece to the end of the text."""
    done = []
    text, at, end = [], [], []
    for i, pieces in enumerate(lists):
        text += [i] * len(pieces)
        at += [p["at"] if p["at"] is not None else -1 for p in pieces]
        end += [p["end"] if p["end"] is not None else -2 for p in pieces]
    text, at, end = np.array(text, np.int64), np.array(at, np.int64), np.array(end, np.int64)
    n = len(text)
    out = sizes <= capacity  # without pieces
    if not n:
        return out
    ok = (at >= 0) & (end >= at) & (end - at <= capacity) & (end <= sizes[text])
    for i in np.unique(text):
        own = text == i if len(lists) == 1 else slice(*np.searchsorted(text, [i, i + 1]))
        if len(inside[i]):
            ok[own] &= ~np.isin(at[own], inside[i]) & ~np.isin(end[own], inside[i])
    END, LOST = n, n + 1
    last = np.append(text[1:] != text[:-1], True)
    shared = np.append(np.minimum(end[1:], end[:-1]) - np.maximum(at[1:], at[:-1]), 0)
    succ = np.where(last, np.where(end == sizes[text], END, LOST), np.where(shared >= overlap, np.arange(1, n + 1), LOST))
    succ = np.append(np.where(ok, succ, LOST), [END, LOST])
    roots = np.flatnonzero(np.append(True, last[:-1]))
    jump = succ
    while (jump[roots] < n).any():
        jump = jump[jump]
    done = jump[roots] == END
    out[text[roots]] = done & (at[roots] == 0)
    return out


def unusable_of(capacity: int, overlap: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, inside = [], []
            for text in batch.column("bytes"):
                b = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid else np.zeros(0, np.uint8)
                sizes.append(len(b))
                inside.append(np.flatnonzero((b & 0xC0) == 0x80))
            lists = [p or [] for p in batch.column("pieces").to_pylist()]
            bad = ~usable(np.array(sizes), inside, lists, capacity, overlap)
            yield pa.RecordBatch.from_arrays([batch.column("vrow").filter(pa.array(bad))], ["vrow"])

    return of


def limit(spark: SparkSession, sf_dir: str) -> tuple[int, int] | None:
    row = table(spark, sf_dir, "size_limits").where("name = 'piece'").select("capacity", "overlap").first()
    return (row["capacity"], row["overlap"] or 0) if row else None


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose recorded pieces can't be used; none if there is no limit `piece`."""
    capacity, overlap = limit(spark, sf_dir) or (2**62, 0)
    texts = table(spark, sf_dir, "text_versions").select("vrow", "device_id", F.col("id").alias("text_version_id"), F.encode("text", "UTF-8").alias("bytes"))
    each = F.struct("ord", F.col("offset").alias("at"), (F.col("offset") + F.col("len")).alias("end"))
    # a list holds the pieces of one text
    pieces = table(spark, sf_dir, "chunks").groupBy("device_id", "text_version_id").agg(F.sort_array(F.collect_list(each)).alias("pieces"))
    rows = texts.join(pieces, ["device_id", "text_version_id"], "left").where(F.col("pieces").isNotNull() | (F.length("bytes") > capacity))
    return rows.select("vrow", "bytes", "pieces").mapInArrow(unusable_of(capacity, overlap), "vrow long")


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New pieces of all texts longer than the limit."""
    capacity, overlap = limit(spark, sf_dir) or (2**62, 0)
    texts = table(spark, sf_dir, "text_versions").select("vrow", F.encode("text", "UTF-8").alias("bytes")).where(F.length("bytes") > capacity)
    return texts.mapInArrow(pieces_of(capacity, overlap), "vrow long, ord int, offset long, len long")
