"""Union of sources, first-occurrence dedup, re-ranking, prompt blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

# Prompt texts and block titles, in order.
BASE_SYSTEM = "You are a helpful assistant. Use the following context to answer the user."
BLOCKS = [("memory", "Memory"), ("cache", "Cache"), ("web", "Web")]
TOP_K = 5


def merged(answers: list[DataFrame]) -> DataFrame:
    """All sources' rows; of equal contents per query the first in source order stays, whatever its score."""
    rows = reduce(DataFrame.unionByName, answers)
    first = F.min_by(F.struct("score", "source", "src_ord", "pos"), F.struct("src_ord", "pos")).alias("r")
    return rows.groupBy("query_id", "content").agg(first).select("query_id", "content", "r.*")


def reranked(rows: DataFrame) -> DataFrame:
    """Adds rank: by falling score, source order and place on ties. Not cut again."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "src_ord", "pos")))


def persona_system(persona: Column, base: str = BASE_SYSTEM) -> Column:
    return F.concat(F.lit(base + "\n\nPersona: "), persona)


def blocks(ranked: DataFrame) -> DataFrame:
    """query_id, blocks: ARRAY<STRUCT<title, lines>> in fixed order, empty ones left out."""
    held = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "source", "content"))).alias("all"))

    def block(source: str, title: str) -> Column:
        own = F.filter("all", lambda r: r["source"] == source)
        return F.struct(F.lit(title).alias("title"), F.transform(own, lambda r: r["content"]).alias("lines"))

    made = [block(source, title) for source, title in BLOCKS]
    return held.select("query_id", F.filter(F.array(*made), lambda b: F.size(b["lines"]) > 0).alias("blocks"))


def prompt(system: Column, found: Column) -> Column:
    """System text, then a section per block with a dash line per content."""
    part = lambda b: F.concat(F.lit("## "), b["title"], F.lit("\n"), F.array_join(F.transform(b["lines"], lambda x: F.concat(F.lit("- "), x, F.lit("\n"))), ""), F.lit("\n"))
    return F.concat(system, F.lit("\n\n"), F.array_join(F.transform(found, part), ""))


def prompts(answers: list[DataFrame], system: Column) -> DataFrame:
    """query_id, prompt of every query that some source answered."""
    return blocks(reranked(merged(answers))).select("query_id", prompt(system, F.col("blocks")).alias("prompt"))
