"""From cleaned text to the flat feature record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.sources import dims


def cleaned(rows: DataFrame, column: str = "text") -> DataFrame:
    """Adds cleaned and status."""
    out = rows.withColumn("cleaned", T.clean(F.col(column)))
    return out.withColumn("status", T.clean_status(F.col(column), F.col("cleaned")))


def tokenized(rows: DataFrame, column: str = "cleaned") -> DataFrame:
    """Adds tokens, word_count, sentence_count and token_status."""
    out = rows.withColumn("tokens", T.tokens(F.col(column))).withColumn("word_count", F.size("tokens"))
    return out.withColumn("sentence_count", T.sentence_count(F.col(column))).withColumn("token_status", T.token_status(F.col("word_count")))


def complexity(word_count: Column, multiplier: Column) -> Column:
    """min(5, words / 100 x multiplier) in single precision."""
    part = (word_count.cast("float") / F.lit(100.0).cast("float")).cast("float")
    return F.least((part * multiplier).cast("float"), F.lit(5.0).cast("float"))


def processing_time(word_count: Column, score: Column) -> Column:
    """Truncated parts in single precision, within 5 and 300."""
    base = (word_count.cast("float") * F.lit(0.1).cast("float")).cast("float").cast("int")
    return F.least(F.greatest(base + (score * F.lit(10.0).cast("float")).cast("float").cast("int"), F.lit(5)), F.lit(300))


def response_length(proficiency: Column, score: Column) -> Column:
    return (
        F.when(proficiency == "Beginner", "Detailed")
        .when(proficiency == "Intermediate", F.when(score > 3.0, "Comprehensive").otherwise("Standard"))
        .when(proficiency == "Advanced", F.when(score > 4.0, "Comprehensive").otherwise("Standard"))
        .when(proficiency == "Expert", "Brief")
    )


def complexity_tier(score: Column) -> Column:
    return F.when(score < 1.0, "simple").when(score < 2.5, "moderate").when(score < 4.0, "complex").otherwise("advanced")


def proficiency_level(proficiency: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in dims.LEVELS.items() for x in kv]), proficiency)


def featured(rows: DataFrame) -> DataFrame:
    """Adds complexity_score, domain_category, tier, time, length and level to rows with domain, word_count and proficiency."""
    dim = dims.domain_dim(rows.sparkSession).withColumnRenamed("domain", "__domain")
    out = rows.join(F.broadcast(dim), F.lower("domain") == F.col("__domain"), "left")
    out = out.withColumn("complexity_score", complexity(F.col("word_count"), F.coalesce("multiplier", F.lit(1.0).cast("float"))))
    out = out.withColumn("domain_category", F.coalesce("category", F.lit("general"))).drop("__domain", "multiplier", "category")
    return out.withColumns({
        "estimated_processing_time": processing_time(F.col("word_count"), F.col("complexity_score")),
        "suggested_response_length": response_length(F.col("proficiency"), F.col("complexity_score")),
        "complexity_tier": complexity_tier(F.col("complexity_score")),
        "proficiency_level": proficiency_level(F.col("proficiency")),
    })


def search_filters() -> Column:
    """MAP of the fields that narrow a search."""
    names = ("domain", "domain_category", "complexity_tier", "proficiency_level")
    return F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])


def filtered(rows: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Conjunction of equalities, pushed down to the scan."""
    for name, value in filters.items():
        rows = rows.where(F.col(name) == value)
    return rows


def record(rows: DataFrame, now: Column | None = None, ident: Column | None = None) -> DataFrame:
    """The 21-column flat record; ``now`` (epoch seconds) and ``ident`` make it reproducible."""
    at = F.unix_timestamp() if now is None else now
    return rows.select(
        (F.uuid() if ident is None else ident).alias("id"), "vector", F.col("text").alias("raw_input"), F.col("text").alias("cleaned_input"), "action", "domain", "topic", "mode", "proficiency", "personality",
        F.col("word_count").cast("long"), F.col("sentence_count").cast("long"), T.token_preview(F.col("tokens")).alias("token_preview"), "complexity_score",
        F.col("estimated_processing_time").cast("long"), "suggested_response_length", "domain_category", "complexity_tier", "proficiency_level", at.cast("long").alias("created_at"), at.cast("long").alias("updated_at"),
    )


def engine_json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns), {"pretty": "true"})
