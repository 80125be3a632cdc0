"""Vector store as a Parquet table: append and open."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "vector array<float>, timestamp bigint, payload binary"


def open_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD).parquet(path)


def append(records: DataFrame, path: str) -> None:
    records.select("vector", "timestamp", "payload").write.mode("append").parquet(path)


def dimension(store: DataFrame) -> int | None:
    """The vectors' number of components; it comes from the data."""
    row = store.select(F.size("vector").alias("n")).where("n > 0").first()
    return row.n if row else None


def index_entries(placed: DataFrame) -> DataFrame:
    """id, centroid, offset: postings in list order. placed: vec_id, centroid."""
    from pyspark.sql import Window as W

    at = F.row_number().over(W.partitionBy("centroid").orderBy("vec_id")) - 1
    return placed.select(F.col("vec_id").alias("id"), F.col("centroid").cast("int").alias("centroid"), at.cast("long").alias("offset"))
