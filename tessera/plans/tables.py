"""Readers of the input tables and small derivations that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import dims

DOMAIN_NAMES = [name for held in dims.DOMAINS.values() for name in held]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a domain and a proficiency by doc_id; one in 65 has a domain that the dimension doesn't know."""
    docs = table(spark, sf_dir, "documents")
    names = F.array(*[F.lit(n) for n in [*DOMAIN_NAMES, "gardening"]])
    levels = F.array(*[F.lit(n) for n in dims.PROFICIENCIES.values()])
    return docs.withColumn("domain", F.get(names, F.pmod("doc_id", F.lit(65)).cast("int"))).withColumn("proficiency", F.get(levels, F.pmod("doc_id", F.lit(4)).cast("int")))


def vector_queries(rows: DataFrame) -> DataFrame:
    """query_id, query, label: the vectors whose id is divisible by 100."""
    return rows.where(F.pmod("vec_id", F.lit(100)) == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.col("label").alias("query_label"))


def first_parts(rows: DataFrame, count: int, size: int) -> list[list[float]]:
    """The first ``size`` components of vectors 0 to count - 1: a fixed, reproducible codebook."""
    got = rows.where(F.col("vec_id") < count).orderBy("vec_id").select(F.slice("embedding", 1, size)).collect()
    return [[float(x) for x in r[0]] for r in got]
