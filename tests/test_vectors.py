import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import quantize, topk


def one(spark, expr, **vectors):
    rows = spark.createDataFrame([tuple(vectors.values())], ", ".join(f"{k} array<float>" for k in vectors))
    return rows.select(expr).first()[0]


def test_cosine_variants(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, V.cosine(a, b), a=[0.0, 0.0], b=[1.0, 0.0]) == 0
    assert one(spark, V.cosine(a, b, "embedding"), a=[1.0], b=[1.0, 0.0]) == 0
    assert abs(one(spark, V.cosine(a, b, "distance"), a=[1.0, 0.0], b=[0.0, 1.0]) - 1) < 1e-9


def test_preprocess(spark):
    assert abs(one(spark, V.l2_normalize(F.col("a")), a=[1.0, 0.0, 0.0, 0.0])[0] - 1) < 1e-9
    assert abs(sum(one(spark, V.mean_center(F.col("a")), a=[1.0, 2.0, 3.0, 4.0]))) < 1e-6
    assert one(spark, V.vector_status(F.col("a")), a=[0.0] * 1025) == "too_many_dims"


def test_topk_checks(spark):
    with pytest.raises(ValueError):
        V.check_search(0, "cosine")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, query array<float>")
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.rank, r.vec_id) for r in topk.nearest(q, e, 2).orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_pq(spark):
    ones = quantize.Codebook([[[1.0] * 8] * 256], 48)
    assert one(spark, quantize.decode(F.array(*[F.lit(0).cast("smallint")] * 48), ones), a=[0.0]) == [1.0] * 384
    halves = spark.createDataFrame([([0.5] * 384,)], "v array<float>")
    assert halves.select(quantize.encode_udf(ones)("v")).first()[0] == [0] * 48
    small = quantize.Codebook([[[0.0, 0.0], [1.0, 1.0]]], 2)
    v = spark.createDataFrame([([0.9, 0.9, 0.1, 0.0],)], "v array<float>")
    assert v.select(quantize.encode(F.col("v"), small)).first()[0] == [1, 0]
    assert abs(v.select(quantize.table_distance(quantize.lookup_table(F.col("v"), small), quantize.encode(F.col("v"), small), 2)).first()[0] - 0.03) < 1e-6
    with pytest.raises(ValueError):
        quantize.check_dims(10, 3)


def test_kmeans(spark):
    same = spark.createDataFrame([([0.0] * 4,)] * 100, "embedding array<float>")
    assert len(quantize.kmeans(same, 2, max_iters=2).centroids) == 2
    with pytest.raises(ValueError):
        quantize.kmeans(same.limit(3), 5)
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.normal(0, 0.1, (40, 2)), rng.normal(5, 0.1, (40, 2))])
    model = quantize.kmeans(spark.createDataFrame([(p.tolist(),) for p in points], "embedding array<float>"), 2, max_iters=5)
    assert sorted(round(c[0]) for c in model.centroids) == [0, 5] and sorted(model.counts) == [40, 40]
