"""Hybrid retrieval over the store (SEA-1 to SEA-18, WIN-3, WIN-4, WIN-6, JN-1 to JN-3).

Channels give observations: exact (URL, path, title, app), index (a phrase of the token index, checked against the
text), scan (queries of one or two signs), vector. Results are merged by the first channel that has them, or by
weighted reciprocal ranks. Limits are parameters; None means all.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from traceloom.functions import text as T
from traceloom.store import once, table

INDEX_LIMIT, FILTERED_LIMIT, SCAN_DAYS, K = 200, 2000, 7, 60  # fixed values
WEIGHTS = {"vector": 0.5}  # fixed value; the other channels weigh 1


def live_rows(spark: SparkSession, sf_dir: str, start: int | None = None, end: int | None = None, app: str | None = None) -> DataFrame:
    """FLT-1, FLT-2: live observations in a half-open range of time, of an app."""
    rows = once(table(spark, sf_dir, "observations").where("deleted_at is null"))
    if start is not None:
        rows = rows.where(F.col("ts") >= start)
    if end is not None:
        rows = rows.where(F.col("ts") < end)
    if app is not None:
        rows = rows.join(table(spark, sf_dir, "apps").where(F.lower("bundle_id") == app.lower()).select(F.col("id").alias("app_id")), "app_id", "left_semi")
    return rows


def newest(rows: DataFrame, limit: int | None) -> DataFrame:
    """WIN-3."""
    return rows if limit is None else rows.orderBy(F.desc("ts"), F.desc("device_id"), F.desc("id")).limit(limit)


def by_object(spark: SparkSession, sf_dir: str, field: str, value: str, limit: int | None = 50, **scope) -> DataFrame:
    """SEA-2, SEA-3, JN-3: observations of the objects that match: URLs without a path by host, else by substring."""
    v = unicodedata.normalize("NFKC", value).lower()
    has = lambda c: F.contains(F.lower(c), F.lit(v))
    if field in ("url", "host"):
        name, key = "urls", "url_id"
        bare = v.split("://")[-1]
        if "/" in bare.rstrip("/"):
            test: Column = has("canonical_url") | has("raw_locator")
        else:
            bare = bare.rstrip("/")
            test = (F.lower("host") == bare) | F.endswith(F.lower("host"), F.lit("." + bare)) | has("canonical_url") | has("raw_locator")
    elif field == "path":
        name, key, test = "files", "file_id", has("path")
    elif field == "title":
        name, key, test = "windows", "window_id", has("title")
    else:
        name, key, test = "apps", "app_id", has("bundle_id") | has("name")
    ids = table(spark, sf_dir, name).where(test).select(F.col("id").alias(key))
    return newest(live_rows(spark, sf_dir, **scope).join(ids, key, "left_semi").select("device_id", "id", "ts"), limit)


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted index: (token, vrow) of every text, whole."""
    rows = table(spark, sf_dir, "text_versions").where("text is not null")
    return rows.select("vrow", F.explode(F.array_distinct(T.index_tokens("text"))).alias("token"))


def index_hits(spark: SparkSession, sf_dir: str, query: str, limit: int | None = INDEX_LIMIT) -> DataFrame:
    """SEA-4, SEA-5: (vrow, device_id, id) of texts that hold the phrase: all its tokens, then the folded words
    themselves; the newest rows first."""
    q = unicodedata.normalize("NFKC", query).lower()
    tokens = T.bigrams_of("".join(c for c in unicodedata.normalize("NFD", q) if not unicodedata.combining(c)))
    import re

    tokens = sorted(set(re.findall(r"[^\W_]+", tokens)))
    rows = table(spark, sf_dir, "text_versions").where("text is not null")
    if tokens:
        with_all = index(spark, sf_dir).where(F.col("token").isin(tokens)).groupBy("vrow").agg(F.count("*").alias("n")).where(F.col("n") == len(tokens))
        rows = rows.join(with_all.select("vrow"), "vrow", "left_semi")
    rows = rows.where(F.contains(F.lower("text"), F.lit(q)) | F.contains(F.lower(T.fold("text")), F.lit(q))).select("vrow", "device_id", "id")
    return rows if limit is None else rows.orderBy(F.desc("vrow")).limit(limit)


def expanded(spark: SparkSession, sf_dir: str, texts: DataFrame, limit: int | None, **scope) -> DataFrame:
    """JN-2: the live observations that show the texts, each once, newest first."""
    shown = table(spark, sf_dir, "occurrences").select("device_id", F.col("observation_id").alias("id"), "text_version_id")
    ids = shown.join(texts.select("device_id", F.col("id").alias("text_version_id")), ["device_id", "text_version_id"], "left_semi").select("device_id", "id")
    return newest(live_rows(spark, sf_dir, **scope).join(ids, ["device_id", "id"], "left_semi").select("device_id", "id", "ts"), limit)


def by_index(spark: SparkSession, sf_dir: str, query: str, limit: int | None = 50, texts: int | None = INDEX_LIMIT, **scope) -> DataFrame:
    return expanded(spark, sf_dir, index_hits(spark, sf_dir, query, FILTERED_LIMIT if scope and texts == INDEX_LIMIT else texts), limit, **scope)


def by_scan(spark: SparkSession, sf_dir: str, query: str, limit: int | None = 50, days: int | None = SCAN_DAYS, **scope) -> DataFrame:
    """SEA-6: short queries: texts shown in the last days before the newest observation (or the end of the range)."""
    q = unicodedata.normalize("NFKC", query).lower()
    texts = table(spark, sf_dir, "text_versions").where(F.contains(F.lower(T.fold("text")), F.lit(q)))
    rows = expanded(spark, sf_dir, texts, None, **scope)
    if days is not None:
        if scope.get("end") is not None:
            rows = rows.where(F.col("ts") >= scope["end"] - days * 86_400_000)
        else:
            top = live_rows(spark, sf_dir).agg(F.max("ts").alias("top"))
            rows = rows.join(F.broadcast(top)).where(F.col("ts") >= F.col("top") - days * 86_400_000).drop("top")
    return newest(rows, limit)


def ranked(channels: dict[str, DataFrame]) -> DataFrame:
    """(channel, device_id, id, ts, rank) of channels whose size is bounded by their limit."""
    out = None
    for i, (name, df) in enumerate(channels.items()):
        order = Window.orderBy(F.desc("ts"), F.desc("device_id"), F.desc("id"))
        part = df.select(F.lit(i).alias("turn"), F.lit(name).alias("channel"), "device_id", "id", "ts", F.row_number().over(order).alias("rank"))
        out = part if out is None else out.unionByName(part)
    return out


def union(channels: dict[str, DataFrame], limit: int = 50) -> DataFrame:
    """SEA-10: each observation once, by the first channel that has it."""
    rows = ranked(channels).groupBy("device_id", "id").agg(F.min(F.struct("turn", "rank", "channel", "ts")).alias("r"))
    return rows.orderBy("r.turn", "r.rank").limit(limit).select("device_id", "id", F.col("r.channel").alias("channel"), F.col("r.ts").alias("ts"))


def fused(channels: dict[str, DataFrame], limit: int = 50) -> DataFrame:
    """SEA-11: sum of weight / (60 + rank) over the channels; ties in order of the union."""
    weight = F.lit(1.0)
    for name, w in WEIGHTS.items():
        weight = F.when(F.col("channel") == name, w).otherwise(weight)
    rows = ranked(channels).withColumn("part", weight / (K + F.col("rank")))
    rows = rows.groupBy("device_id", "id").agg(F.sum("part").alias("score"), F.min(F.struct("turn", "rank", "channel")).alias("r"))
    return rows.orderBy(F.desc(F.round("score", 12)), "r.turn", "r.rank").limit(limit).select("device_id", "id", F.col("r.channel").alias("channel"), F.round("score", 9).alias("score"))


def channels_of(spark: SparkSession, sf_dir: str, query: str, limit: int = 50, **scope) -> dict[str, DataFrame]:
    """SEA-1: the channels that a query asks for."""
    field, rest = T.field_query(query)
    if not rest.strip():
        return {}
    if field:
        return {"exact": by_object(spark, sf_dir, field, rest, limit, **scope)}
    out = {"exact": by_object(spark, sf_dir, "title", rest, limit, **scope)}
    if T.short_scan(rest):
        out["scan"] = by_scan(spark, sf_dir, rest, limit, **scope)
    else:
        out["index"] = by_index(spark, sf_dir, rest, limit, **scope)
    return out


def summaries(spark: SparkSession, sf_dir: str, hits: DataFrame, query: str) -> DataFrame:
    """SEA-12 to SEA-14, JN-1: what a hit shows: app, title, host or path, and the snippet of its first text."""
    rows = hits.join(live_rows(spark, sf_dir).select("device_id", "id", "app_id", "window_id", "url_id", "file_id"), ["device_id", "id"])
    for name, key, cols in (("apps", "app_id", ["name"]), ("windows", "window_id", ["title"]), ("urls", "url_id", ["host"]), ("files", "file_id", ["path"])):
        rows = rows.join(table(spark, sf_dir, name).select(F.col("id").alias(key), *cols), key, "left")
    shown = table(spark, sf_dir, "occurrences").select("device_id", F.col("observation_id").alias("id"), "ord", "text_version_id")
    first = shown.join(hits.select("device_id", "id"), ["device_id", "id"], "left_semi").groupBy("device_id", "id").agg(F.min_by("text_version_id", F.struct("ord", "text_version_id")).alias("text_version_id"))
    texts = table(spark, sf_dir, "text_versions").select("device_id", F.col("id").alias("text_version_id"), "text")
    rows = rows.join(first.join(texts, ["device_id", "text_version_id"]), ["device_id", "id"], "left")
    line = F.concat_ws(" · ", "name", F.coalesce("title", "host", "path"), T.snippet(F.col("text"), query))
    return rows.select("device_id", "id", "channel", T.truncated(line, 100).alias("summary"))


def rotated(hits: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """WIN-6: one of each group per round."""
    rounds = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return hits.withColumn("round", rounds)


def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEA-16: in how many texts each token stands."""
    return index(spark, sf_dir).groupBy("token").agg(F.count("*").alias("texts"))


def bm25(spark: SparkSession, sf_dir: str, terms: list[str], limit: int = 20, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """SEA-16: texts ordered by BM25 of the terms."""
    rows = table(spark, sf_dir, "text_versions").where("text is not null").select("vrow", T.index_tokens("text").alias("tokens")).withColumn("n", F.size("tokens"))
    stats = rows.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"))
    hits = rows.select("vrow", "n", F.explode("tokens").alias("token")).where(F.col("token").isin(terms)).groupBy("vrow", "n", "token").agg(F.count("*").alias("tf"))
    df = hits.groupBy("token").agg(F.count("*").alias("df"))
    rows = hits.join(F.broadcast(df), "token").join(F.broadcast(stats))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    return rows.groupBy("vrow").agg(F.round(F.sum(score), 6).alias("score")).orderBy(F.desc("score"), "vrow").limit(limit)
