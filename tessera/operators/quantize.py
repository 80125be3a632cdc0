"""k-means, PCA, product quantization, inverted lists.

Codebooks are bounded by their parameters (m x k centroids), so they go into expressions as literals and
nothing is shuffled to encode; only training aggregates.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tessera.functions import vectors as V

MAX_ITERS, TOLERANCE, SPLIT = 25, 1e-4, 5e-5
#: A column of doubles gets at most so many literals; larger codebooks go through a numpy UDF.
LITERALS = 20_000


def literal_vectors(vectors: list[list[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(x)) for x in v]) for v in vectors])


def nearest_centroid(vector: Column, centroids: list[list[float]]) -> Column:
    """Index of the nearest (squared l2); the lowest on ties."""
    marked = F.transform(literal_vectors(centroids), lambda c, i: F.struct(V.l2_squared(vector, c).alias("d"), i.alias("k")))
    return F.array_min(marked)["k"]


def kmeans_step(rows: DataFrame, centroids: list[list[float]], column: str = "embedding") -> DataFrame:
    """k, n, centroid: one Lloyd step. Means are partial sums per component; no vectors are shuffled.

    The centroids come as a one-row table, bounded by k, so that all steps share one compiled plan.
    """
    dims = len(centroids[0])
    table = rows.sparkSession.createDataFrame([(centroids,)], "__c array<array<double>>")
    marked = F.transform("__c", lambda c, i: F.struct(V.l2_squared(F.col(column), c).alias("d"), i.alias("k")))
    placed = rows.crossJoin(F.broadcast(table)).select(F.array_min(marked)["k"].alias("k"), F.col(column).alias("v"))
    means = placed.groupBy("k").agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col("v")[i].cast("double")).alias(f"c{i}") for i in range(dims)])
    return means.select("k", "n", F.array(*[F.col(f"c{i}") for i in range(dims)]).alias("centroid"))


@dataclass
class KMeansModel:
    centroids: list[list[float]]
    iterations: int = 0
    counts: list[int] = field(default_factory=list)


def kmeans(rows: DataFrame, k: int, column: str = "embedding", start: list[list[float]] | None = None, max_iters: int = MAX_ITERS, tolerance: float = TOLERANCE, empty: str = "split", seed: int = 42) -> KMeansModel:
    """Lloyd's algorithm until no centroid moves by more than ``tolerance``. empty: split the largest cluster, or drop (keep the old centroid)."""
    if start is None:
        start = plus_plus(rows, k, column, seed)
    held = rows.select(column).persist()
    try:
        if held.limit(k).count() < k:
            raise ValueError("insufficient samples")
        centroids, counts, step = [list(map(float, c)) for c in start], [0] * k, 0
        for step in range(1, max_iters + 1):
            found = {r.k: r for r in kmeans_step(held, centroids, column).collect()}
            fresh = [list(found[i].centroid) if i in found else list(centroids[i]) for i in range(k)]
            counts = [found[i].n if i in found else 0 for i in range(k)]
            if empty == "split":
                for i in (i for i in range(k) if not counts[i]):
                    big = max(range(k), key=lambda j: counts[j])
                    fresh[i], fresh[big] = [x + SPLIT for x in fresh[big]], [x - SPLIT for x in fresh[big]]
                    counts[i], counts[big] = counts[big] // 2, counts[big] - counts[big] // 2
            moved = max(float(np.linalg.norm(np.subtract(a, b))) for a, b in zip(centroids, fresh))
            centroids = fresh
            if moved <= tolerance:
                break
        return KMeansModel(centroids, step, counts)
    finally:
        held.unpersist()


def plus_plus(rows: DataFrame, k: int, column: str, seed: int, sample: int = 4096) -> list[list[float]]:
    """k-means++ on a bounded sample, taken in hash order."""
    got = rows.select(column).orderBy(F.xxhash64(column, F.lit(seed))).limit(max(sample, k)).collect()
    points, rng = np.array([r[0] for r in got], float), np.random.default_rng(seed)
    if len(points) < k:
        raise ValueError("insufficient samples")
    chosen = [points[rng.integers(len(points))]]
    near = ((points - chosen[0]) ** 2).sum(axis=1)
    for _ in range(1, k):
        weight = near / near.sum() if near.sum() > 0 else np.full(len(points), 1 / len(points))
        chosen.append(points[rng.choice(len(points), p=weight)])
        near = np.minimum(near, ((points - chosen[-1]) ** 2).sum(axis=1))
    return [c.tolist() for c in chosen]


def ml_kmeans(rows: DataFrame, k: int, column: str = "embedding", seed: int = 42):
    """MLlib's estimator (k-means||) on the same column, for large k."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    vectors = rows.select(array_to_vector(F.col(column).cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed, maxIter=MAX_ITERS, tol=TOLERANCE).fit(vectors)


# --- PCA ------------------------------------------------------------------------------------------


def covariance(rows: DataFrame, dims: int, column: str = "embedding") -> DataFrame:
    """i, j, cov for i <= j: population covariance. Tasks add up their vectors' products in numpy; only dims x dims sums are shuffled.

    Vectors that are null or have another dimension take no part.
    """

    def sums(batches):
        total, square, n = np.zeros(dims), np.zeros((dims, dims)), 0
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)
                total, square, n = total + x.sum(axis=0), square + x.T @ x, n + len(x)
        if n:
            i, j = np.triu_indices(dims)
            yield pa.record_batch([pa.array(c) for c in (i.astype(np.int32), j.astype(np.int32), np.full(len(i), n), total[i], total[j], square[i, j])], ["i", "j", "n", "x", "y", "xy"])

    usable = rows.select(F.col(column).alias("v")).where((F.size("v") == dims) & ~F.exists("v", lambda x: x.isNull()))
    parts = usable.mapInArrow(sums, "i int, j int, n long, x double, y double, xy double").groupBy("i", "j")
    whole = parts.agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in ("x", "y", "xy")])
    return whole.select("i", "j", (F.col("xy") / F.col("n") - F.col("x") / F.col("n") * F.col("y") / F.col("n")).alias("cov"))


@dataclass
class PcaModel:
    mean: list[float]
    components: list[list[float]]


def pca(rows: DataFrame, out: int, column: str = "embedding") -> PcaModel:
    """Mean and top principal directions."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    vectors = rows.select(array_to_vector(F.col(column).cast("array<double>")).alias("x"))
    mean = vectors.select(Summarizer.mean(F.col("x"))).first()[0].toArray().tolist()
    return PcaModel(mean, PCA(k=out, inputCol="x", outputCol="y").fit(vectors).pc.toArray().T.tolist())


def project(vector: Column, model: PcaModel) -> Column:
    mean = F.array(*[F.lit(x) for x in model.mean])
    centred = F.zip_with(vector, mean, lambda a, b: a.cast("double") - b)
    return F.transform(literal_vectors(model.components), lambda c: V.dot(centred, c))


# --- product quantization ---------------------------------------------------------------------------


@dataclass
class Codebook:
    """centroids[m][k]: per sub-space; one entry serves all sub-spaces (shared)."""

    centroids: list[list[list[float]]]
    m: int

    def of(self, m: int) -> list[list[float]]:
        return self.centroids[m if len(self.centroids) > 1 else 0]

    @property
    def sub_dims(self) -> int:
        return len(self.centroids[0][0])

    @property
    def k(self) -> int:
        return len(self.centroids[0])


def check_dims(dims: int, m: int) -> int:
    if dims > V.MAX_DIM or dims % m:
        raise ValueError("dims must be a multiple of m, 1024 at most")
    return dims // m


def train_codebook(rows: DataFrame, dims: int, m: int, bits: int = 8, column: str = "embedding", seed: int = 42, max_iters: int = MAX_ITERS, tolerance: float = TOLERANCE, sample: int = 16_384) -> Codebook:
    """Standard product quantization: k-means in every sub-space, 2^bits centroids each; all sub-spaces share a job per step.

    Starts are random vectors of a bounded sample in hash order; a centroid without vectors keeps its place. Every vector takes part in
    every step; tasks return sums and counts per centroid.
    """
    sub, k = check_dims(dims, m), 1 << bits
    usable = rows.select(F.col(column).cast("array<double>").alias("v")).where((F.size("v") == dims) & ~F.exists("v", lambda x: x.isNull()))
    got = usable.orderBy(F.xxhash64("v", F.lit(seed)), "v").limit(max(sample, k)).toArrow()["v"].combine_chunks()
    points = got.flatten().to_numpy(zero_copy_only=False).reshape(-1, m, sub)
    if len(points) < k:
        raise ValueError("insufficient samples")
    centroids = points[np.random.default_rng(seed).choice(len(points), k, replace=False)].transpose(1, 0, 2).copy()
    held = usable.persist()
    try:
        for _ in range(max_iters):

            def sums(batches, centroids=centroids):
                total, n = np.zeros((m, k, sub)), np.zeros((m, k), np.int64)
                for batch in batches:
                    x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, m, sub)
                    near = nearest_codes(x, centroids)
                    for i in range(m):
                        np.add.at(total[i], near[:, i], x[:, i])
                        n[i] += np.bincount(near[:, i], minlength=k)
                at, code = np.nonzero(n)
                if len(at):
                    yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(code.astype(np.int32)), pa.array(n[at, code]), pa.array(total[at, code].tolist(), pa.list_(pa.float64()))], ["m", "k", "n", "total"])

            parts = held.mapInArrow(sums, "m int, k int, n long, total array<double>").groupBy("m", "k")
            fresh = centroids.copy()
            for r in parts.agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(sub)]).alias("total")).collect():
                fresh[r.m, r.k] = np.array(r.total) / r.n
            moved, centroids = np.sqrt(((fresh - centroids) ** 2).sum(axis=2)).max(), fresh
            if moved <= tolerance:
                break
    finally:
        held.unpersist()
    return Codebook(centroids.tolist(), m)


def nearest_codes(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """vectors x m codes. x: vectors x m x sub, centroids: m x k x sub."""
    out = np.empty(x.shape[:2], np.int16)
    for a in range(0, len(x), 2048):
        for i in range(x.shape[1]):
            out[a : a + 2048, i] = ((x[a : a + 2048, i, None, :] - centroids[i][None]) ** 2).sum(axis=2).argmin(axis=1)
    return out


def encode(vector: Column, book: Codebook) -> Column:
    """ARRAY<SMALLINT> of m codes; null for a vector of other dimension. A codebook of over ``LITERALS`` numbers goes through numpy batches."""
    if book.m * book.k * book.sub_dims > LITERALS:
        return encode_udf(book)(vector)
    codes = [nearest_centroid(F.slice(vector, m * book.sub_dims + 1, book.sub_dims), book.of(m)).cast("smallint") for m in range(book.m)]
    return F.when(F.size(vector) == book.m * book.sub_dims, F.array(*codes))


def encode_udf(book: Codebook, preprocess: bool = False):
    """The same in numpy batches, for codebooks beyond ``LITERALS`` numbers. preprocess: as ``vectors.preprocess`` first."""
    centroids = np.array([book.of(m) for m in range(book.m)])

    @F.pandas_udf("array<smallint>")
    def run(vectors: pd.Series) -> pd.Series:
        fits = [i for i, v in enumerate(vectors) if v is not None and len(v) == book.m * book.sub_dims]
        out: list[np.ndarray | None] = [None] * len(vectors)
        if fits:
            x = np.stack([np.asarray(vectors.iloc[i], float) for i in fits])
            if preprocess:
                x = x - x.mean(axis=1, keepdims=True)
                x = x / np.sqrt((x * x).sum(axis=1, keepdims=True) + 1e-12)
                x = x / (np.sqrt((x * x).sum(axis=1, keepdims=True)) + 1e-12)
            for i, codes in zip(fits, nearest_codes(x.reshape(len(fits), book.m, -1), centroids)):
                out[i] = codes
        return pd.Series(out)

    return run


def decode(codes: Column, book: Codebook) -> Column:
    """Concatenated centroids; null where a code or the number of codes is off. A large codebook goes through numpy batches."""
    if book.m * book.k * book.sub_dims > LITERALS:
        return decode_udf(book)(codes)
    parts = [F.get(literal_vectors(book.of(m)), F.get(codes, m).cast("int")) for m in range(book.m)]
    return F.when(F.size(codes) == book.m, F.flatten(F.array(*parts)))


def decode_udf(book: Codebook):
    centroids = np.array([book.of(m) for m in range(book.m)])

    @F.pandas_udf("array<double>")
    def run(codes: pd.Series) -> pd.Series:
        def one(c):
            if c is None or len(c) != book.m or not all(0 <= x < book.k for x in c):
                return None
            return centroids[np.arange(book.m), np.asarray(c, int)].ravel()

        return pd.Series([one(c) for c in codes])

    return run


def lookup_table(query: Column, book: Codebook) -> Column:
    """ARRAY<ARRAY<DOUBLE>>: squared distances of each query part and centroid."""

    def row(m: int) -> Column:
        part = F.slice(query, m * book.sub_dims + 1, book.sub_dims)
        return F.transform(literal_vectors(book.of(m)), lambda c: V.l2_squared(part, c))

    return F.array(*[row(m) for m in range(book.m)])


def table_distance(table: Column, codes: Column, m: int) -> Column:
    """Asymmetric distance: the table's entries at the codes, added up."""
    total = F.get(F.get(table, 0), F.get(codes, 0).cast("int"))
    for i in range(1, m):
        total = total + F.get(F.get(table, i), F.get(codes, i).cast("int"))
    return total


def quantize(vector: Column, book: Codebook) -> Column:
    """Codes of the preprocessed vector; decoding gives the preprocessed space back."""
    if book.m * book.k * book.sub_dims > LITERALS:
        return encode_udf(book, preprocess=True)(vector)
    return encode(V.preprocess(vector), book)


# --- inverted lists ---------------------------------------------------------------------------------


def placed(rows: DataFrame, coarse: list[list[float]], column: str = "embedding") -> DataFrame:
    """Adds centroid."""
    return rows.withColumn("centroid", nearest_centroid(F.col(column), coarse))


def write_lists(rows: DataFrame, coarse: list[list[float]], path: str, column: str = "embedding") -> None:
    """A Parquet table partitioned by centroid: a list is a pruned scan."""
    placed(rows, coarse, column).write.mode("overwrite").partitionBy("centroid").parquet(path)


def search_lists(lists: DataFrame, queries: DataFrame, coarse: list[list[float]], nprobe: int, top_k: int, column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, distance (squared l2): nearest rows in each query's ``nprobe`` nearest lists. lists: as ``placed`` gives them.

    A query meets only the lists that it asks for, by an equi-join on the list.
    """
    marked = F.transform(literal_vectors(coarse), lambda c, i: F.struct(V.l2_squared(F.col("query"), c).alias("d"), i.alias("k")))
    asked = queries.withColumn("centroid", F.explode(F.transform(F.slice(F.array_sort(marked), 1, nprobe), lambda x: x["k"])))
    scored = lists.join(asked, "centroid").select("query_id", "vec_id", F.round(V.l2_squared(F.col("query"), F.col(column)), 6).alias("distance"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top_k).select("query_id", "rank", "vec_id", "distance")


def probe(lists: DataFrame, query: list[float], coarse: list[list[float]], nprobe: int) -> DataFrame:
    """The rows of the query's nearest lists."""
    near = np.argsort(((np.array(coarse) - np.array(query)) ** 2).sum(axis=1), kind="stable")[:nprobe]
    return lists.where(F.col("centroid").isin([int(n) for n in near]))
