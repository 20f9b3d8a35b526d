"""Token ids of whole texts by a public byte-level BPE vocabulary (problem 7).

Texts are split into pre-tokens by the published pattern and go through the distinct-word shuffle of `words`: each
distinct pre-token is encoded once, its ids are joined back and the texts are put together by position. A byte-level
BPE never merges across pre-tokens, so the result equals encoding each text as a whole. Decoding joins the ids with the
table of token bytes.

Null and empty texts have the empty list. Strings of special tokens are ordinary text. Every row of the input gives a
row, also if its id comes twice. Columns other than the two named are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from traceloom.llm.words import dictionary, encoded, resolved
from traceloom.store import table

VOCABULARY = "byte_bpe_50k"


def place(name: str) -> str:
    """Path of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken")


@cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def encoder(path: str):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})


def pre_tokens(text: str) -> list[str]:
    return _pattern().findall(text)


@cache
def _pattern():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


def ids_of_words(path: str):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single = encoder(path)._core_bpe.encode_single_piece
        for b in batches:
            ids = [single(w.encode()) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["word", "value"])

    return of


def joined_ids(table: pa.Array, keys: pa.Array, places: pa.Array) -> pa.RecordBatch:
    """Ids of each text from the ids of its pre-tokens."""
    n = np.asarray(pc.list_value_length(places).fill_null(0))
    flat = table.take(places.flatten())
    sizes = np.append(0, np.cumsum(np.asarray(pc.list_value_length(flat).fill_null(0), dtype=np.int64)))
    bounds = sizes[np.append(0, np.cumsum(n))]
    ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat.flatten())
    return pa.RecordBatch.from_arrays([keys, ids], ["key", "ids"])


def token_ids(texts: DataFrame, path: str | None = None) -> DataFrame:
    """(key, ids) of rows (key, text)."""
    path = path or place(VOCABULARY)
    batches = encoded(texts, pre_tokens)
    words = dictionary(batches).select("word").distinct().mapInArrow(ids_of_words(path), "word string, value array<int>")
    return resolved(batches, words, "array<int>", "key long, ids array<int>", joined_ids)


def joined_counts(table: pa.Array, keys: pa.Array, places: pa.Array) -> pa.RecordBatch:
    n = np.asarray(pc.list_value_length(places).fill_null(0))
    sizes = np.append(0, np.cumsum(np.asarray(table)[np.asarray(places.flatten())].astype(np.int64) if len(table) else np.zeros(0, np.int64)))
    bounds = np.append(0, np.cumsum(n))
    return pa.RecordBatch.from_arrays([keys, pa.array(sizes[bounds[1:]] - sizes[bounds[:-1]], pa.int32())], ["key", "tokens"])


def token_counts(texts: DataFrame, path: str | None = None) -> DataFrame:
    """(key, tokens) of rows (key, text): the numbers of ids, without the ids."""
    path = path or place(VOCABULARY)
    batches = encoded(texts, pre_tokens)
    words = dictionary(batches).select("word").distinct().mapInArrow(ids_of_words(path), "word string, value array<int>")
    words = words.select("word", F.size("value").alias("value"))
    return resolved(batches, words, "int", "key long, tokens int", joined_counts)


def token_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(id, bytes) of a vocabulary; its size is fixed by the vocabulary."""
    rows = [(i, bytearray(b)) for b, i in ranks(path or place(VOCABULARY)).items()]
    return spark.createDataFrame(rows, "id int, bytes binary")


def decoded(ids: DataFrame, path: str | None = None) -> DataFrame:
    """(key, text) of rows (key, ids) with unique keys, by a join with the token-byte table."""
    parts = ids.select("key", F.posexplode_outer("ids").alias("pos", "id"))
    parts = parts.join(F.broadcast(token_table(ids.sparkSession, path)), "id", "left")
    # the list that is collected is one text's
    whole = parts.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("pos", "bytes"))).alias("parts"))
    hexes = F.array_join(F.transform("parts", lambda p: F.hex(p["bytes"])), "", "")
    return whole.select("key", F.decode(F.unhex(hexes), "UTF-8").alias("text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(documents(spark, sf_dir)).select(F.col("key").alias("doc_id"), "ids")


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as decoded from their ids; a null text comes back as an empty one."""
    return decoded(token_ids(documents(spark, sf_dir))).select(F.col("key").alias("doc_id"), "text")
