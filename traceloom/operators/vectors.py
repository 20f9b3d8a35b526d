"""Chunks, vectors and exact nearest neighbours (VEC-1 to VEC-13, SEA-8, JN-12, JN-15)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from traceloom.store import table, written

TARGET, MOST, OVERLAP, LEAST, CHUNKS = 500, 700, 80, 8, 64  # fixed values of the chunker; CHUNKS=None cuts a text whole
DIM = 64
BLOCK, QUERIES = 4096, 256


def truncated(v: Column, dim: int) -> Column:
    """VEC-1: the first dimensions, of length 1 again; a zero vector stays."""
    head = F.transform(F.slice(v, 1, dim), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(head, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(head, lambda x: x / norm)).otherwise(head)


def quantised(v: Column) -> Column:
    """VEC-2: 8-bit numbers, scaled so that the largest is 127."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    return F.transform(v, lambda x: F.when(top > 0, F.round(x.cast("double") * (127 / top))).otherwise(0.0).cast("int"))


def dequantised(v: Column, scale: Column) -> Column:
    """VEC-3."""
    return F.transform(v, lambda x: x.cast("double") * scale / 127)


def cosine(a: Column, b: Column) -> Column:
    """VEC-4: 0 for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def blocks_of(size: int):
    """Rows (id, v) to blocks (ids, matrix as bytes of unit vectors)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = [], []

        def flush() -> pa.RecordBatch:
            m = np.array(rows, np.float64)
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([m.tobytes()], pa.binary())], ["ids", "m"])

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if i is None or not v:
                    continue
                ids.append(i)
                rows.append(v)
                if len(ids) >= size:
                    yield flush()
                    ids, rows = [], []
        if ids:
            yield flush()

    return of


def nearest_of(k: int, dim: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q_ids, qm, ids, m in zip(*(b.column(c).to_pylist() for c in ("q_ids", "qm", "ids", "m"))):
                s = np.frombuffer(qm).reshape(len(q_ids), dim) @ np.frombuffer(m).reshape(len(ids), dim).T
                n = min(k, s.shape[1])
                kth = -np.partition(-s, n - 1, axis=1)[:, n - 1 : n]
                qi, ci = np.nonzero(s >= kth)  # ties of the last place stay until the merge
                yield pa.RecordBatch.from_arrays([pa.array(np.array(q_ids)[qi]), pa.array(np.array(ids)[ci]), pa.array(np.round(1 - s[qi, ci], 9))], ["q", "id", "distance"])

    return of


def nearest(rows: DataFrame, queries: DataFrame, k: int, dim: int) -> DataFrame:
    """VEC-5: exact k nearest rows (id, v) of each query row (id, v) by cosine distance; ties by id. A stated set of
    queries goes against all rows, block by block: each pair of blocks gives its own best, merged per query."""
    own = written(rows.select("id", "v").mapInArrow(blocks_of(BLOCK), "ids array<long>, m binary"), "blocks")
    asked = written(queries.select("id", "v").mapInArrow(blocks_of(QUERIES), "ids array<long>, m binary"), "queries").toDF("q_ids", "qm")
    best = own.crossJoin(asked).mapInArrow(nearest_of(k, dim), "q long, id long, distance double")
    order = Window.partitionBy("q").orderBy("distance", "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def dimension(rows: DataFrame) -> int:
    row = rows.select(F.size("v").alias("n")).first()
    return row["n"] if row else 1


def neighbours(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """Queries are all rows whose id is divisible by 100."""
    rows = embeddings(spark, sf_dir)
    return nearest(rows, rows.where("id % 100 = 0"), k, dimension(rows))


def neighbours_within(spark: SparkSession, sf_dir: str, distance: float, k: int = 200) -> DataFrame:
    """SEA-8: of the k nearest those within a distance."""
    return neighbours(spark, sf_dir, k).where(F.col("distance") <= distance)


def label_precision(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """VEC-13: share of the k nearest that have the query's label."""
    rows = embeddings(spark, sf_dir)
    hits = neighbours(spark, sf_dir, k).where("q <> id")
    hits = hits.join(rows.select(F.col("id").alias("q"), F.col("label").alias("own")), "q").join(rows.select("id", "label"), "id")
    return hits.groupBy("own").agg(F.round(F.avg((F.col("own") == F.col("label")).cast("double")), 6).alias("precision"), F.count("*").alias("pairs"))


def short_recall(spark: SparkSession, sf_dir: str, dim: int = 16, k: int = 10) -> DataFrame:
    """VEC-13: recall of the k nearest in the first dimensions against all dimensions."""
    rows = embeddings(spark, sf_dir)
    cut = rows.select("id", truncated(F.col("v"), dim).alias("v"))
    full = neighbours(spark, sf_dir, k).select("q", "id")
    part = nearest(cut, cut.where("id % 100 = 0"), k, min(dim, dimension(rows))).select("q", "id")
    return full.join(part.withColumn("hit", F.lit(1)), ["q", "id"], "left").agg(F.round(F.count("hit") / F.count("*"), 6).alias("recall"))


def rotation(spark: SparkSession, sf_dir: str, k: int = 50) -> DataFrame:
    """WIN-6: hits of each query in rounds, one of every label per round."""
    hits = neighbours(spark, sf_dir, k).join(embeddings(spark, sf_dir).select("id", "label"), "id")
    rounds = F.row_number().over(Window.partitionBy("q", "label").orderBy("rank"))
    return hits.select("q", "id", "label", "rank", rounds.alias("round"))


def pieces_of(text: str, most: int | None = CHUNKS) -> list[tuple[int, int]]:
    """VEC-7: (begin, end) in characters: lines are gathered up to TARGET characters; a longer stretch than MOST is cut
    into windows that overlap; what is blank or short is dropped."""
    spans, begin, end = [], None, 0
    for m in re.finditer(r"[^\n]*(?:\n|$)", text):
        if not m[0]:
            continue
        a, b = m.start(), m.end() - m[0].endswith("\n")
        if begin is not None and b - begin > TARGET:
            spans.append((begin, end))
            begin = None
        if begin is None:
            begin = a
        end = b
    if begin is not None:
        spans.append((begin, end))
    out = []
    for a, b in spans:
        while b - a > MOST:
            out.append((a, a + MOST))
            a += MOST - OVERLAP
        out.append((a, b))
    out = [(a, b) for a, b in out if len(text[a:b].strip()) >= LEAST]
    return out if most is None else out[:most]


def chunks_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        rows = []
        for key, text in zip(df["key"], df["text"]):
            if text:
                before, at = 0, 0
                for o, (a, b) in enumerate(pieces_of(text)):
                    if a < at:
                        before, at = 0, 0
                    before += len(text[at:a].encode())
                    at = a
                    rows.append((key, o, before, len(text[a:b].encode())))
        yield pd.DataFrame(rows, columns=["key", "ord", "offset", "len"])


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "text_versions").select(F.col("vrow").alias("key"), "text")
    return texts.mapInPandas(chunks_of, "key long, ord int, offset long, len long")


def sliced(text: Column, offset: Column, length: Column) -> Column:
    """VEC-8: the text of a piece given in bytes. A character that its edges cut becomes U+FFFD; a piece that isn't within
    the text is null."""
    data = F.encode(text, "UTF-8")
    size = F.octet_length(data)
    inside = length.between(0, size) & offset.between(0, size - length)
    return F.when(inside, F.make_valid_utf8(F.substring(data, offset.cast("int") + 1, length.cast("int")).cast("string")))


def piece_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New chunks with their length in characters, as cut out of the text again."""
    own = chunks(spark, sf_dir).join(table(spark, sf_dir, "text_versions").select(F.col("vrow").alias("key"), "text"), "key")
    return own.select("key", "ord", F.length(sliced(F.col("text"), F.col("offset"), F.col("len"))).alias("chars"))


def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC-6, VEC-10: chunks by model: embedded and waiting."""
    return table(spark, sf_dir, "chunks").groupBy("model").agg(F.count("*").alias("chunks"), F.count_if(F.col("embedded_at").isNull()).alias("pending"))


FNV, PRIME, MASK = 0xCBF29CE484222325, 0x100000001B3, (1 << 64) - 1  # the published constants


def fnv1a(data: bytes) -> int:
    h = FNV
    for b in data:
        h = ((h ^ b) * PRIME) & MASK
    return h


def hashed(text: str, dim: int = DIM) -> list[float]:
    """VEC-11: signed counts of hashed words and word pairs, of length 1."""
    words = re.findall(r"[^\W_]+", text.lower())
    v = np.zeros(dim)
    for w in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]:
        h = fnv1a(w.encode())
        v[h % dim] += -1.0 if h & 0x10000000 else 1.0
    n = np.linalg.norm(v)
    return (v / n if n else v).tolist()


def embedded_of(dim: int):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            yield pd.DataFrame({"vrow": df["vrow"], "v": [hashed(t or "", dim) for t in df["text"]]})

    return of


def embedded(spark: SparkSession, sf_dir: str, dim: int = DIM) -> DataFrame:
    """VEC-9: the job over waiting chunks: each with the vector of its text."""
    wait = table(spark, sf_dir, "chunks").where("embedded_at is null and offset is not null and len is not null")
    texts = table(spark, sf_dir, "text_versions").select("device_id", F.col("id").alias("text_version_id"), "text")
    rows = wait.join(texts, ["device_id", "text_version_id"]).select("vrow", sliced(F.col("text"), F.col("offset"), F.col("len")).alias("text"))
    return rows.mapInPandas(embedded_of(dim), "vrow long, v array<double>")
