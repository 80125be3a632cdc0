"""Search sources. A source answers a table of queries with (query_id, score, content, source, src_ord, pos).

Registered by name; ``retrieve`` runs those that it has a table for. Adding a source is adding a function.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import topk

#: Order in which sources are merged.
ORDER = {"cache": 0, "memory": 1, "web": 2}
WEB_SCORE = 0.5
TOPICS = "RelatedTopics array<struct<Text:string>>"


def _answer(ranked: DataFrame, name: str) -> DataFrame:
    return ranked.select("query_id", "score", "content", F.lit(name).alias("source"), F.lit(ORDER[name]).alias("src_ord"), F.col("rank").alias("pos"))


def cache_source(queries: DataFrame, entries: DataFrame, top_k: int) -> DataFrame:
    """entries: pos, input, output, input_vec, output_vec. Both texts of an entry are candidates; only positive scores stay."""
    sides = F.array(
        F.struct((F.col("pos") * 2).alias("at"), F.col("input").alias("content"), F.col("input_vec").alias("embedding")),
        F.struct((F.col("pos") * 2 + 1).alias("at"), F.col("output").alias("content"), F.col("output_vec").alias("embedding")),
    )
    candidates = entries.select(F.explode(sides).alias("c")).select("c.*")
    scored = topk.cosine_pairs(queries, candidates, "embedding").where("score > 0")
    return _answer(topk.best(scored, top_k, [F.desc("score"), F.asc("at")]), "cache")


def memory_source(queries: DataFrame, records: DataFrame, top_k: int) -> DataFrame:
    """records: rec_id, vector, payload (bytes)."""
    scored = topk.cosine_pairs(queries, records, "vector").withColumn("content", T.lossy_text(F.col("payload")))
    return _answer(topk.best(scored, top_k, [F.desc("score"), F.asc("rec_id")]), "memory")


def web_source(replies: DataFrame, top_k: int) -> DataFrame:
    """replies: query_id, json. The first k topics, then those of them without a text are dropped."""
    topics = F.slice(F.from_json("json", TOPICS)["RelatedTopics"], 1, top_k)
    ranked = replies.select("query_id", F.posexplode(topics).alias("at", "topic")).select(
        "query_id", F.col("topic.Text").alias("content"), F.lit(WEB_SCORE).cast("double").alias("score"), (F.col("at") + 1).alias("rank")
    )
    return _answer(ranked.where(F.col("content").isNotNull()), "web")


def web_request(text: Column, endpoint: str) -> Column:
    return F.concat(F.lit(f"{endpoint}?q="), T.url_encoded(text))


SOURCES: dict[str, Callable[[DataFrame, DataFrame, int], DataFrame]] = {"cache": cache_source, "memory": memory_source, "web": lambda queries, replies, top_k: web_source(replies, top_k)}


def retrieve(queries: DataFrame, tables: dict[str, DataFrame], top_k: int) -> DataFrame:
    """The answers of every source that ``tables`` has a table for, in the sources' order; an unknown name is an error."""
    if unknown := set(tables) - set(SOURCES):
        raise ValueError(f"unknown sources: {sorted(unknown)}")
    return functools.reduce(DataFrame.unionByName, [SOURCES[n](queries, tables[n], top_k) for n in sorted(tables, key=ORDER.get)])
