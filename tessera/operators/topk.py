"""Nearest rows per query.

The queries are broadcast only if there are at most ``BROADCAST_QUERIES``; beyond that they are dealt by hash to blocks of about
half as many, and each block is broadcast in turn (a query set against all rows). Each block keeps its k best per query before the one shuffle on the
query id.

``nearest_texts`` embeds texts and searches them in the same Arrow batches: a text is embedded once, vectors never leave the worker and a batch is
one matrix product with the queries. By default it ranks every text for every query: pairs are dealt by query and band of score, and each task also
tells each band how many of its pairs lie in better bands, so that a band knows its first rank without waiting for the others. Given a number k, each
task hands on its k best per query alone.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tessera.functions import models
from tessera.functions import vectors as V

BROADCAST_QUERIES = 10_000
#: Texts that are embedded and compared at once.
TEXTS = 256
#: At most so many pairs are handed on at once.
PAIRS = 1 << 18
#: Bands of equal width that scores from 1 to -1 are dealt to.
BANDS = 256


def pairs(queries: DataFrame, rows: DataFrame, same: Column | None = None) -> DataFrame:
    """Every query with every row, in blocks of queries. queries: query_id and more."""
    on = same if same is not None else F.lit(True)
    if queries.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES:
        return rows.join(F.broadcast(queries), on, "inner")
    return functools.reduce(DataFrame.unionByName, [rows.join(F.broadcast(p), on, "inner") for p in query_blocks(queries)])


def query_blocks(queries: DataFrame) -> list[DataFrame]:
    blocks = -(-2 * queries.count() // BROADCAST_QUERIES)
    return [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) for b in range(blocks)]


def cosine_pairs(queries: DataFrame, rows: DataFrame, column: str, same: Column | None = None) -> DataFrame:
    """``pairs`` with score, the retrieval cosine of ``query`` and ``column`` rounded to six places. Each vector's norm is computed once."""
    asked, held = queries.withColumn("__asked", V.norm(F.col("query"))), rows.withColumn("__held", V.norm(F.col(column)))
    cosine = V.dot(F.col("query"), F.col(column)) / F.greatest(F.col("__asked") * F.col("__held"), F.lit(V.F32_EPSILON))
    return pairs(asked, held, same).withColumn("score", F.round(cosine, 6)).drop("__asked", "__held")


def best(scored: DataFrame, top_k: int, order: list[Column], by: str = "query_id") -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("rank") <= top_k)


def nearest(queries: DataFrame, rows: DataFrame, top_k: int, metric: str = "cosine", same: Column | None = None) -> DataFrame:
    """query_id, rank, vec_id, score. queries: query_id, query; rows: vec_id, embedding. Score rounded to six places, ties to the smaller id."""
    V.check_search(top_k, metric)
    if metric == "cosine":
        scored = cosine_pairs(queries, rows, "embedding", same).select("query_id", "vec_id", "score")
    else:
        scored = pairs(queries, rows, same).select("query_id", "vec_id", F.round(V.similarity(F.col("query"), F.col("embedding"), metric), 6).alias("score"))
    return best(scored, top_k, [F.desc("score"), F.asc("vec_id")]).select("query_id", "rank", "vec_id", "score")


def within(queries: DataFrame, rows: DataFrame, radius: float) -> DataFrame:
    """query_id, vec_id, distance: rows at most ``radius`` away (l2)."""
    distance = F.round(F.sqrt(V.l2_squared(F.col("query"), F.col("embedding"))), 6)
    return pairs(queries, rows).select("query_id", "vec_id", distance.alias("distance")).where(F.col("distance") <= radius)


def rounded(x: np.ndarray) -> np.ndarray:
    """To six places, halves away from zero, as SQL does it."""
    return np.copysign(np.floor(np.abs(x) * 1e6 + 0.5) / 1e6, x) + 0.0


def as_matrix(vectors: list) -> np.ndarray:
    return np.array(vectors, np.float64) if vectors else np.empty((0, 0))


def embedded(column: pa.Array, factory: Callable[[], object]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows with a vector, their vectors, the vectors' norms)."""
    got = models.provider(factory).embed([t or "" for t in column.to_pylist()])
    at = np.array([i for i, v in enumerate(got) if v is not None], np.int64)
    vectors = as_matrix([got[i] for i in at])
    return at, vectors, np.sqrt((vectors * vectors).sum(axis=1))


class Best:
    """The k best of each query so far: more score first (not a number counts as most), then null ids, then smaller ones."""

    def __init__(self, queries: int, top_k: int):
        self.top_k, self.least = top_k, np.full(queries, -np.inf)
        self.place, self.score, self.valid, self.ident = np.empty(0, np.int64), np.empty(0), np.empty(0, bool), np.empty(0, np.int64)

    def add(self, score: np.ndarray, valid: np.ndarray, ident: np.ndarray) -> None:
        """score: a row for each candidate, a column for each query."""
        row, place = np.nonzero(~(score < self.least))
        place, score = np.concatenate([self.place, place]), np.concatenate([self.score, score[row, place]])
        valid, ident = np.concatenate([self.valid, valid[row]]), np.concatenate([self.ident, ident[row]])
        key = np.where(np.isnan(score), np.inf, score)
        order = np.lexsort((ident, valid, -key, place))
        first = np.searchsorted(place[order], place[order])
        rank = np.arange(len(order)) - first
        order = order[rank < self.top_k]
        self.place, self.score, self.valid, self.ident = place[order], score[order], valid[order], ident[order]
        last = rank[rank < self.top_k] == self.top_k - 1
        self.least[self.place[last]] = key[order][last]


def bands(score: np.ndarray) -> np.ndarray:
    """0 to BANDS - 1 by falling score; not a number lies in the first."""
    found = np.clip(np.floor((1 - score) * (BANDS / 2)), 0, BANDS - 1)
    return np.where(np.isnan(found), 0, found).astype(np.int64)


def nearest_texts(queries: DataFrame, texts: DataFrame, top_k: int | None = None, factory: Callable[[], object] = models.HashedEmbedder) -> DataFrame:
    """query_id, rank, vec_id, score: the texts by falling cosine of their embedding with the query's, rounded to six places, ties to the
    smaller id; all of them, or the ``top_k`` best. queries: query_id, text; texts: vec_id (long), text. Blank texts have no vector and take no
    part; a norm of zero scores 0."""
    if top_k is not None:
        V.check_search(top_k, "cosine")
    schema = StructType([queries.schema["query_id"], *texts.limit(0).selectExpr("CAST(vec_id AS long) AS vec_id", "CAST(0 AS double) AS score").schema])
    everything = StructType([queries.schema["query_id"], StructField("vec_id", LongType()), StructField("score", DoubleType()), StructField("band", LongType())])
    vectors = StructType([queries.schema["query_id"], *queries.limit(0).selectExpr("CAST(null AS array<double>) AS vector").schema])

    def embed(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, TEXTS):
                part = batch.slice(a, TEXTS)
                at, found, _ = embedded(part.column(1), factory)
                yield pa.record_batch([part.column(0).take(pa.array(at)), pa.array(list(found), pa.list_(pa.float64()))], ["query_id", "vector"])

    def compared(batches, matrix, norms, texts_at_once):
        """(scores, a row for each text and a column for each query; which ids are valid; ids)."""
        for batch in batches if len(matrix) else ():
            for a in range(0, batch.num_rows, texts_at_once):
                part = batch.slice(a, texts_at_once)
                at, found, lengths = embedded(part.column(1), factory)
                if len(at):
                    both, ident = lengths[:, None] * norms, part.column(0)
                    score = rounded(np.divide(found @ matrix.T, both, out=np.zeros_like(both), where=both != 0))
                    yield score, ident.is_valid().to_numpy(zero_copy_only=False)[at], ident.fill_null(0).to_numpy()[at]

    def search(part: DataFrame, block: int) -> DataFrame:
        asked = part.select("query_id", "text").mapInArrow(embed, vectors).toArrow().combine_chunks()
        matrix = as_matrix(asked["vector"].to_pylist())
        shared = texts.sparkSession.sparkContext.broadcast((asked["query_id"].combine_chunks(), matrix, np.sqrt((matrix * matrix).sum(axis=1))))

        def scan(batches):
            names, matrix, norms = shared.value
            best = Best(len(matrix), top_k)
            for score, valid, ident in compared(batches, matrix, norms, TEXTS):
                best.add(score, valid, ident)
            yield pa.record_batch([names.take(pa.array(best.place)), pa.array(best.ident, mask=~best.valid), pa.array(best.score)], ["query_id", "vec_id", "score"])

        def scan_all(batches):
            """Every pair; then for each band, without a score, the number of this task's pairs in better bands in place of an id."""
            names, matrix, norms = shared.value
            each, first = len(matrix), (block << 32) * BANDS
            seen = np.zeros(each * BANDS, np.int64)
            for score, valid, ident in compared(batches, matrix, norms, min(TEXTS, max(1, PAIRS // max(each, 1)))):
                score, place = score.T.ravel(), np.repeat(np.arange(each), len(ident))
                band = place * BANDS + bands(score)
                np.add.at(seen, band, 1)
                ids = pa.array(np.tile(ident, each), mask=np.tile(~valid, each))
                yield pa.record_batch([names.take(pa.array(place)), ids, pa.array(score), pa.array(first + band)], everything.names)
            better = (np.cumsum(seen.reshape(-1, BANDS), axis=1) - seen.reshape(-1, BANDS)).ravel()
            told = np.flatnonzero(better)
            for a in range(0, len(told), PAIRS):
                band = told[a : a + PAIRS]
                yield pa.record_batch([names.take(pa.array(band // BANDS)), pa.array(better[band]), pa.nulls(len(band), pa.float64()), pa.array(first + band)], everything.names)

        given = texts.select(F.col("vec_id").cast("long").alias("vec_id"), "text")
        return given.mapInArrow(scan_all, everything) if top_k is None else given.mapInArrow(scan, schema)

    few = queries.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES
    found = functools.reduce(DataFrame.unionByName, [search(p, i) for i, p in enumerate([queries] if few else query_blocks(queries))])
    if top_k is None:
        inside = W.partitionBy("band").orderBy(F.desc_nulls_first("score"), F.asc("vec_id")).rowsBetween(W.unboundedPreceding, W.currentRow)
        rank = F.sum(F.when(F.col("score").isNull(), F.col("vec_id")).otherwise(1)).over(inside).cast("int")
        return found.withColumn("rank", rank).where(F.col("score").isNotNull()).select("query_id", "rank", "vec_id", "score")
    return best(found, top_k, [F.desc("score"), F.asc("vec_id")]).select("query_id", "rank", "vec_id", "score")
