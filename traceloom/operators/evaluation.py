"""Evaluation of retrieval (EVA-1 to EVA-13). Relevant texts are those that hold the query's words: a rule, not labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from traceloom.operators import vectors
from traceloom.operators.search import index
from traceloom.store import table

QUERIES = ("query planner", "memory budget", "search index", "sync segment", "hiring plan", "cost estimate", "no such words here")


def relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEA-18, EVA-8: (query, vrow) by a full scan; queries are few and fixed, so they are what is replicated."""
    asked = spark.createDataFrame([(q,) for q in QUERIES], "query string")
    texts = table(spark, sf_dir, "text_versions").where("text is not null").select("vrow", F.lower("text").alias("t"))
    return texts.join(F.broadcast(asked)).where(F.contains("t", F.col("query"))).select("query", "vrow")


def returned(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """SEA-15: the newest k texts that hold all words of each query, in any order: a looser engine than the truth."""
    asked = spark.createDataFrame([(q, w, len(set(q.split()))) for q in QUERIES for w in set(q.split())], "query string, token string, n int")
    hits = index(spark, sf_dir).join(F.broadcast(asked), "token").groupBy("query", "n", "vrow").agg(F.count("*").alias("m")).where("m = n")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("vrow")))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "vrow", "rank")


def scores(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """EVA-1, EVA-3: recall, precision and reciprocal rank of each query, and how it failed. Recall is by the most that
    k places can hold; precision is null where nothing came; a query without relevant texts fails if anything comes."""
    asked = spark.createDataFrame([(q,) for q in QUERIES], "query string")
    truth = relevant(spark, sf_dir)
    hits = returned(spark, sf_dir, k).join(truth.withColumn("ok", F.lit(1)), ["query", "vrow"], "left")
    each = hits.groupBy("query").agg(F.count("*").alias("came"), F.count("ok").alias("hits"), F.min(F.when(F.col("ok") == 1, F.col("rank"))).alias("first"))
    rows = asked.join(truth.groupBy("query").agg(F.count("*").alias("relevant")), "query", "left").join(each, "query", "left").fillna(0, ["relevant", "came", "hits"])
    most = F.least("relevant", F.lit(k))
    return rows.select(
        "query", "relevant", "came", "hits", F.round(F.col("hits") / F.nullif(most, F.lit(0)), 6).alias("recall"), F.round(F.col("hits") / F.nullif("came", F.lit(0)), 6).alias("precision"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal"), bucket(F.col("relevant"), F.col("came"), F.col("hits"), most).alias("bucket"),
    )


def bucket(relevant: Column, came: Column, hits: Column, most: Column) -> Column:
    return (
        F.when((relevant == 0) & (came > 0), "false positive").when(relevant == 0, "pass").when(came == 0, "index miss").when(hits < most, "trimmed").otherwise("pass")
    )


def summary(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """EVA-4: means over the queries, by bucket and in all."""
    rows = scores(spark, sf_dir, k)
    return rows.rollup("bucket").agg(F.count("*").alias("queries"), F.round(F.avg("recall"), 5).alias("recall"), F.round(F.avg("reciprocal"), 5).alias("mrr")).withColumn("bucket", F.coalesce("bucket", F.lit("all")))


def threshold_sweep(spark: SparkSession, sf_dir: str, steps: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8, 1.0), k: int = 50) -> DataFrame:
    """EVA-7: neighbours and their precision by label under each threshold of distance."""
    rows = vectors.embeddings(spark, sf_dir)
    hits = vectors.neighbours(spark, sf_dir, k).where("q <> id")
    hits = hits.join(rows.select(F.col("id").alias("q"), F.col("label").alias("own")), "q").join(rows.select("id", "label"), "id")
    limits = spark.createDataFrame([(s,) for s in steps], "threshold double")
    pairs = hits.join(F.broadcast(limits)).where(F.col("distance") <= F.col("threshold"))
    return limits.join(pairs.groupBy("threshold").agg(F.count("*").alias("pairs"), F.round(F.avg((F.col("own") == F.col("label")).cast("double")), 6).alias("precision")), "threshold", "left").fillna(0, ["pairs"])


def character_errors(truth: Column, read: Column) -> Column:
    """EVA-13: edit distance per character of the truth."""
    return F.levenshtein(truth, read) / F.nullif(F.length(truth), F.lit(0))


def title_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVA-13 on titles, read with their zeros taken for the letter."""
    rows = table(spark, sf_dir, "windows").where("title is not null")
    return rows.select("id", F.round(character_errors(F.col("title"), F.replace("title", F.lit("0"), F.lit("O"))), 6).alias("cer"))
