"""Approximate nearest neighbours: inverted lists scanned by adaptive dimension blocks.

Largest inner product becomes least distance: a vector gets one more dimension that lifts it to the common
norm, a query a zero there. All are rotated by one random orthogonal matrix, so that the first dimensions are
a random sample of all, and each list is kept as column blocks (``BLOCK_DIMS`` x vectors). A scan adds up
squared differences block by block; after each, the hypothesis that a candidate still beats the
current k-th distance is tested from the partial distance, ``partial * dims / seen > (1 + epsilon / sqrt(seen))^2 * kth``,
and those that fail are abandoned. The survivors' inner products are computed exactly, in double
precision, on the original vectors.

Centroids are fitted on at most ``FIT_ROWS`` vectors in hash order of their id; every vector is indexed. How many
of its nearest lists a query probes is measured on the table itself: ``MEASURED`` queries are compared with all
vectors, and the least number of lists is taken that holds ``FOUND`` of their true neighbours (vectors without
clusters need over half of all lists, whatever the size). Where these hold too few candidates, a query
probes more. The nearest list is scanned first; the k-th inner product found there goes with the query to all further
lists, as the distance to beat. Equal vectors
are one class: only the rows of its k + 1 smallest ids can be among anyone's k nearest, so the others
leave before the index (an exact reduction). Lists are cut into units of ``UNIT_ROWS`` vectors and ``UNIT_QUERIES``
queries, so no task holds a list, however large.

Defined results: vectors that are null, empty, zero, of another dimension than most or hold null or
non-finite components take no part; ties go to the smaller vec_id; a query id that repeats is asked once, with the
smallest of its vectors, and repeated ids are candidates of their own but never their own query's; an empty table gives an
empty result; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from tessera.llm.common import materialize

TOP, QUERY_EVERY = 20, 20
FIT_ROWS, FIT_STEPS, MAX_LISTS = 20_000, 8, 4096
BLOCK_DIMS, EPSILON, UNIT_ROWS, UNIT_QUERIES, SEED = 16, 2.1, 8192, 2048, 42
#: Share of the true neighbours that must lie in the probed lists, and the queries that it is measured on.
FOUND, MEASURED = 0.97, 256


def clean_vectors(table: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, vector: rows with an id and a usable vector."""
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0)).where(~bad & F.exists("vector", lambda x: x != 0))
    return rows


def first_copies(rows: DataFrame, top: int) -> DataFrame:
    """Of equal vectors the rows of the ``top`` + 1 smallest ids, of equal rows ``top``."""
    once = F.row_number().over(W.partitionBy("vector", "vec_id").orderBy("vec_id"))
    place = F.dense_rank().over(W.partitionBy("vector").orderBy("vec_id"))
    return rows.withColumn("copy", once).where(F.col("copy") <= top).withColumn("place", place).where(F.col("place") <= top + 1).select("vec_id", "vector")


def kmeans(x: np.ndarray, k: int, steps: int, rng) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(steps):
        near = nearest(x, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        count = np.bincount(near, minlength=k)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, count: int) -> np.ndarray:
    """Indices of the ``count`` nearest centres of each row, nearest first."""
    out = []
    for a in range(0, len(x), 4096):
        d = (centres**2).sum(axis=1) - 2 * x[a : a + 4096] @ centres.T
        part = np.argpartition(d, count - 1, axis=1)[:, :count] if count < d.shape[1] else np.broadcast_to(np.arange(d.shape[1]), d.shape)
        out.append(np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out) if out else np.empty((0, count), np.int64)


def lift(x: np.ndarray, norm: float) -> np.ndarray:
    """Appends the component that gives every row the common norm."""
    return np.concatenate([x, np.sqrt(np.maximum(norm * norm - (x * x).sum(axis=1), 0))[:, None]], axis=1)


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def scan(queries: np.ndarray, owners: np.ndarray, beaten: np.ndarray, vectors: np.ndarray, ids: np.ndarray, rotation: np.ndarray, norm: float, top: int) -> list[tuple[int, int, float]]:
    """(row of queries, vec_id, inner product) of each query's best in one unit. beaten: inner products that each query has ``top`` of already."""
    blocks = (lift(vectors, norm) @ rotation).T.astype(np.float32)
    turned = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1) @ rotation
    dims, out = len(blocks), []
    edges = [*range(0, dims, BLOCK_DIMS), dims]
    seeds = min(len(ids), 4 * top)
    known = norm * norm + (queries * queries).sum(axis=1) - 2 * beaten
    for q in range(len(queries)):
        # A first set of candidates, in full, gives the distance to beat.
        full = ((blocks[:, :seeds] - turned[q][:, None].astype(np.float32)) ** 2).sum(axis=0)
        kth = min(np.partition(full, top)[top] if seeds > top else np.inf, known[q])
        alive, partial = np.arange(len(ids)), np.zeros(len(ids), np.float32)
        for a, b in zip(edges, edges[1:]):
            rows = blocks[a:b] if len(alive) == len(ids) else blocks[a:b, alive]
            partial = partial + ((rows - turned[q, a:b, None].astype(np.float32)) ** 2).sum(axis=0)
            seen = b
            bound = kth * (1.0001 if seen == dims else (1 + EPSILON / np.sqrt(seen)) ** 2 * seen / dims) + 1e-6
            stay = partial <= bound
            if not stay.all():
                alive, partial = alive[stay], partial[stay]
        exact = vectors[alive] @ queries[q]
        keep = ids[alive] != owners[q]
        alive, exact = alive[keep], exact[keep]
        best = np.lexsort((ids[alive], -exact))[:top]
        out += [(q, int(ids[alive[i]]), float(exact[i])) for i in best]
    return out


def probes_needed(placed: DataFrame, asked: DataFrame, centres: np.ndarray, top: int) -> int:
    """Least number of nearest lists that holds ``FOUND`` of the true neighbours of a sample of the queries."""
    sample = asked.orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id").limit(MEASURED).select("vec_id", "vector").toArrow()
    if not sample.num_rows:
        return 1
    owners, queries = sample["vec_id"].to_numpy(), matrix(sample["vector"].combine_chunks())

    def best(batches):
        scores, lists = np.empty((len(owners), 0)), np.empty((len(owners), 0), np.int32)
        for batch in batches:
            s = queries @ matrix(batch.column(2)).T
            s[owners[:, None] == batch.column(1).to_numpy()[None, :]] = -np.inf
            scores = np.concatenate([scores, s], axis=1)
            lists = np.concatenate([lists, np.broadcast_to(batch.column(0).to_numpy(), s.shape)], axis=1)
            if scores.shape[1] > top:
                at = np.argpartition(-scores, top - 1, axis=1)[:, :top]
                scores, lists = np.take_along_axis(scores, at, 1), np.take_along_axis(lists, at, 1)
        row, at = np.nonzero(scores > -np.inf)
        yield pa.record_batch([pa.array(row.astype(np.int32)), pa.array(lists[row, at], pa.int32()), pa.array(scores[row, at])], ["row", "list", "score"])

    rank = F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"), "list"))
    true = placed.select("list", "vec_id", "vector").mapInArrow(best, "row int, list int, score double").withColumn("rank", rank).where(F.col("rank") <= top).select("row", "list").toArrow()
    if not true.num_rows:
        return 1
    order = nearest(np.concatenate([queries, np.zeros((len(queries), 1))], axis=1), centres, len(centres))
    place = np.argsort(order, axis=1)[true["row"].to_numpy(), true["list"].to_numpy()]
    return int(np.sort(place)[int(np.ceil(FOUND * len(place))) - 1]) + 1


def search(table: DataFrame, top: int = TOP, query_every: int = QUERY_EVERY, probes: int | None = None, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``top`` nearest found. Queries: ids divisible by ``query_every``. probes: measured where None."""
    spark = table.sparkSession
    usable = clean_vectors(table, key, column)
    sizes = usable.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    result = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], result)
    dims = sizes.dims
    usable = usable.where(F.size("vector") == dims)
    kept = materialize(first_copies(usable, top), "ann-vectors")
    count, largest = kept.agg(F.count(F.lit(1)), F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))).first()
    norm = float(np.sqrt(largest)) * (1 + 1e-9)
    rng = np.random.default_rng(SEED)
    rotation = np.linalg.qr(rng.standard_normal((dims + 1, dims + 1)))[0]
    sample = kept.orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id").limit(FIT_ROWS).select("vector").toArrow()["vector"].combine_chunks()
    sample = lift(matrix(sample), norm)
    lists = int(min(MAX_LISTS, max(1, round(np.sqrt(count) / 4)), len(sample)))
    centres = kmeans(sample, lists, FIT_STEPS, rng) if lists > 1 else sample.mean(axis=0, keepdims=True)

    def assign(batches):
        for batch in batches:
            x = matrix(batch.column(1))
            near = nearest(lift(x, norm), centres, 1)[:, 0] if len(x) else np.empty(0, np.int64)
            yield pa.record_batch([pa.array(near, pa.int32()), batch.column(0), batch.column(1)], ["list", "vec_id", "vector"])

    placed = materialize(kept.mapInArrow(assign, "list int, vec_id long, vector array<double>"), "ann-lists")
    # Every copy of a vector is asked for on its own id, every id once.
    queries = usable.where(F.pmod("vec_id", F.lit(query_every)) == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    if probes is None:
        probes = probes_needed(placed, queries, centres, top) if lists > 1 else 1
    held = np.zeros(lists, np.int64)
    for r in placed.groupBy("list").count().collect():
        held[r.list] = r["count"]
    units = np.maximum(1, -(-held // UNIT_ROWS))

    def probe(batches):
        for batch in batches:
            x = matrix(batch.column(1))
            order = nearest(np.concatenate([x, np.zeros((len(x), 1))], axis=1), centres, lists) if len(x) else np.empty((0, lists), np.int64)
            rows, to, place = [], [], []
            for i, near in enumerate(order):
                near = near[held[near] > 0]
                enough = int(np.searchsorted(np.cumsum(held[near]), top + 1)) + 1
                near = near[: max(probes, enough)]
                rows += [i] * len(near)
                to += near.tolist()
                place += range(len(near))
            at = pa.array(rows, pa.int64())
            yield pa.record_batch([pa.array(to, pa.int32()), pa.array(place, pa.int32()), batch.column(0).take(at), batch.column(1).take(at)], ["list", "place", "vec_id", "vector"])

    asked = materialize(queries.mapInArrow(probe, "list int, place int, vec_id long, vector array<double>"), "ann-probes")

    def unit(key, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not vectors.num_rows or not queries.num_rows:
            return schema.empty_table()
        owners, beaten = queries["vec_id"].to_numpy(), queries["beaten"].to_numpy()
        got = scan(matrix(queries["vector"].combine_chunks()), owners, beaten, matrix(vectors["vector"].combine_chunks()), vectors["vec_id"].to_numpy(), rotation, norm, top)
        return pa.table([pa.array(owners[[g[0] for g in got]], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.float64())], schema=schema)

    def scanned(asked: DataFrame) -> DataFrame:
        """query_id, vec_id, score: each query's best of every unit. asked: list, vec_id, vector, beaten."""
        wanted = np.zeros(lists, np.int64)
        for r in asked.groupBy("list").count().collect():
            wanted[r.list] = r["count"]
        parts = np.maximum(1, -(-wanted // UNIT_QUERIES))
        # The vectors of a list go to each of its query parts, the queries to each of its vector units.
        table_of = spark.createDataFrame([(i, int(units[i]), int(parts[i])) for i in range(lists) if wanted[i]], "list int, units int, parts int")
        left = placed.join(F.broadcast(table_of), "list").select("list", F.pmod(F.xxhash64("vec_id"), F.col("units")).cast("int").alias("unit"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "vec_id", "vector")
        right = asked.join(F.broadcast(table_of), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("units") - 1)).alias("unit"), F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), "vec_id", "vector", "beaten")
        names = ["list", "unit", "part"]
        return left.groupBy(*names).cogroup(right.groupBy(*names)).applyInArrow(unit, "query_id long, vec_id long, score double")

    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    nothing = F.lit(float("-inf"))
    if not asked.take(1):
        return spark.createDataFrame([], result)
    first = scanned(asked.where("place = 0").withColumn("beaten", nothing)).withColumn("rank", rank).where(F.col("rank") <= top)
    first = materialize(first, "ann-first")
    beaten = first.where(F.col("rank") == top).select(F.col("query_id").alias("vec_id"), F.col("score").alias("beaten"))
    rest = asked.where("place > 0").join(beaten, "vec_id", "left").withColumn("beaten", F.coalesce("beaten", nothing))
    names = ["query_id", "vec_id", "score"]
    found = first.select(*names)
    if lists > 1 and rest.take(1):
        found = found.unionByName(scanned(rest))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
