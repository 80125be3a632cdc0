"""Functions that no query runs: stores, providers, personas, training, keys, small helpers."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import codecs, crypto, models
from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import conversation, features, quantize, topk
from tessera.sources import dims, search, store
from tessera.streaming import flush


def one(spark, column, **values):
    rows = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return rows.select(column).first()[0]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.2, (80, 8)) for c in (-3, 0, 3)])
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


def test_covariance_and_pca(spark, vectors):
    x, rows = vectors
    odd = rows.unionByName(spark.createDataFrame([(900, None), (901, [1.0]), (902, [None] * 8)], rows.schema))
    got = {(r.i, r.j): r["cov"] for r in quantize.covariance(odd, 8).collect()}
    want = np.cov(x.T, bias=True)
    assert len(got) == 36 and all(got[i, j] == pytest.approx(want[i, j]) for i, j in got)
    model = quantize.pca(rows, 2)
    values, axes = np.linalg.eigh(want)
    assert abs(np.dot(model.components[0], axes[:, -1])) == pytest.approx(1, abs=1e-6)
    shown = np.array([r[0] for r in rows.orderBy("vec_id").select(quantize.project(F.col("embedding"), model)).collect()])
    assert np.allclose(shown, (x - x.mean(axis=0)) @ np.array(model.components).T) and shown[:, 0].var() == pytest.approx(values[-1])
    assert quantize.covariance(rows.limit(0), 8).count() == 0


def test_trained_codebook(spark, vectors, monkeypatch):
    x, rows = vectors
    book = quantize.train_codebook(rows, 8, 2, bits=2, max_iters=20)
    assert book.k == 4 and book.sub_dims == 4
    coded = rows.select("vec_id", quantize.encode(F.col("embedding"), book).alias("c"), "embedding")
    error = coded.select(F.avg(V.l2_squared(F.col("embedding"), quantize.decode(F.col("c"), book)))).first()[0]
    assert error < 0.1 * x.var(axis=0).sum()
    parts = x.reshape(len(x), 2, 4)
    near = ((parts[:, :, None, :] - np.array(book.centroids)[None]) ** 2).sum(axis=3).argmin(axis=2)
    want = {i: c.tolist() for i, c in enumerate(near)}
    assert {r.vec_id: list(r.c) for r in coded.collect()} == want
    small = [list(r.c) for r in rows.orderBy("vec_id").select(quantize.quantize(F.col("embedding"), book).alias("c")).collect()]
    monkeypatch.setattr(quantize, "LITERALS", 1)
    odd = rows.unionByName(spark.createDataFrame([(900, None), (901, [1.0])], rows.schema))
    large = odd.select("vec_id", quantize.encode(F.col("embedding"), book).alias("c"))
    large = large.withColumn("v", quantize.decode(F.col("c"), book)).collect()
    assert {r.vec_id: r.c and list(r.c) for r in large} == want | {900: None, 901: None}
    assert all(np.allclose(r.v, np.concatenate([book.of(m)[c] for m, c in enumerate(r.c)])) for r in large if r.c)
    shared = quantize.quantize(F.col("embedding"), book)
    assert [list(r.c) for r in rows.orderBy("vec_id").select(shared.alias("c")).collect()] == small
    with pytest.raises(ValueError):
        quantize.train_codebook(rows.limit(3), 8, 2, bits=2)


def test_lists(spark, vectors, tmp_path):
    x, rows = vectors
    coarse = [[-3.0] * 8, [0.0] * 8, [3.0] * 8]
    quantize.write_lists(rows, coarse, f"{tmp_path}/lists")
    lists = spark.read.parquet(f"{tmp_path}/lists")
    assert {r.vec_id for r in quantize.probe(lists, [0.1] * 8, coarse, 1).collect()} == set(range(80, 160))
    queries = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    got = quantize.search_lists(quantize.placed(rows, coarse), queries, coarse, 3, 4).collect()
    for q in range(0, 240, 50):
        d = ((x - x[q]) ** 2).sum(axis=1)
        assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == np.argsort(d, kind="stable")[:4].tolist()
    centres = [c.tolist() for c in quantize.ml_kmeans(rows, 3).clusterCenters()]
    assert sorted(round(c[0]) for c in centres) == [-3, 0, 3]


def test_query_blocks(spark, vectors, monkeypatch):
    x, rows = vectors
    queries = rows.where("vec_id < 40").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    for metric in ("cosine", "dot"):
        whole = sorted(map(tuple, topk.nearest(queries, rows, 3, metric).collect()))
        monkeypatch.setattr(topk, "BROADCAST_QUERIES", 10)
        assert sorted(map(tuple, topk.nearest(queries, rows, 3, metric).collect())) == whole and len(whole) == 120
        monkeypatch.undo()


def test_store(spark, tmp_path):
    records = spark.createDataFrame([([1.0, 2.0], 7, bytearray(b"a"), "more")], "vector array<float>, timestamp bigint, payload binary, extra string")
    for _ in range(2):
        store.append(records, f"{tmp_path}/store")
    held = store.open_store(spark, f"{tmp_path}/store")
    assert held.count() == 2 and held.columns == ["vector", "timestamp", "payload"] and store.dimension(held) == 2
    assert store.dimension(held.limit(0)) is None


def test_personas(spark, tmp_path):
    (tmp_path / "p.toml").write_text(
        '[personality]\nname = "Nadia"\n[personality.core_traits]\nhumor_deployment = "dry"\n[personality.interaction_style]\nformality_level = 7\n'
        '[personality.expertise_domains]\nprimary_focus = ["a", "b"]\nsecondary_areas = ["c"]\n[personality.model]\ntemperature = 1\n'
    )
    held = dims.load_personas(spark, [f"{tmp_path}/p.toml"])
    assert held.schema == dims.persona_dim(spark).schema
    r = held.first()
    assert (r.name, r.formality_level, r.humor_deployment, list(r.primary_focus), r.temperature, r.top_p) == ("Nadia", 7, "dry", ["a", "b"], 1.0, None)
    flags = dims.persona_flags(held).first()
    assert flags.is_formal and flags.supports_humor and dims.expertise(held).first().areas == ["a", "b", "c"]
    assert ("interaction_style", "formality_level", "7") in {(s.section, s.key, s.value) for s in dims.persona_settings(spark, [f"{tmp_path}/p.toml"]).collect()}
    assert one(spark, dims.with_name(F.lit("Hello {{name}}!"), F.lit("Ann"))) == "Hello Ann!"


def test_sources(spark):
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, query array<double>")
    memory = spark.createDataFrame([(1, [1.0, 0.0], bytearray(b"m")), (2, [0.0, 1.0], bytearray(b"n"))], "rec_id long, vector array<double>, payload binary")
    replies = spark.createDataFrame([(1, json.dumps({"RelatedTopics": [{"Text": "w"}]}))], "query_id long, json string")
    got = search.retrieve(queries, {"web": replies, "memory": memory}, 1).collect()
    assert [(r.source, r.content) for r in sorted(got, key=lambda r: r.src_ord)] == [("memory", "m"), ("web", "w")]
    with pytest.raises(ValueError):
        search.retrieve(queries, {"disk": memory}, 1)
    assert one(spark, search.web_request(F.lit("a b"), "http://x")) == "http://x?q=a%20b"


def test_records_and_prompts(spark):
    rows = spark.createDataFrame([("rust", 1), ("go", 2)], "domain string, n int")
    assert [r.n for r in features.filtered(rows, {"domain": "go"}).collect()] == [2]
    assert json.loads(rows.where("n = 1").select(features.engine_json("domain", "n")).first()[0]) == {"domain": "rust", "n": 1}
    shown = one(spark, conversation.analysis_prompt(F.lit("text")))
    assert shown.endswith("<|im_start|>user\ntext\n<|im_end|>\n<|im_start|>assistant\n") and shown.startswith("<|im_start|>system")
    assert flush.priority(rows).where("priority = 1").count() == 2


def test_small_text_functions(spark):
    assert one(spark, T.command_reply(F.lit("go"))) == "[command: go]"
    assert one(spark, T.message_time(F.lit(61_000 * 60).cast("long"))) == "01:01"
    assert one(spark, T.sendable(F.lit(" \n　"))) is None and one(spark, T.sendable(F.lit(" a "))) == "a"
    assert abs(one(spark, T.now_ms()) / 1000 - __import__("time").time()) < 100
    blanks = " \t " * 20_000
    assert one(spark, T.clean(F.lit(f"{blanks}a{blanks}b \n\n \r\n c é{blanks}"))) == f"a{blanks}b c "
    assert one(spark, T.clean(F.lit("a\rb\n \n"))) == "a\rb"


def test_models(spark):
    got = one(spark, models.hashed_embedding(F.lit("One two TWO")))
    assert np.allclose(got, models.HashedEmbedder().embed(["One two TWO"])[0]) and one(spark, models.hashed_embedding(F.lit(" "))) is None
    texts = spark.createDataFrame([("a\nb c d",), (" ",), (None,)], "t string")
    assert [r[0] for r in texts.select(models.generation_udf(max_tokens=2)("t")).collect()] == ["b c", None, None]
    found = one(spark, models.keyword_analysis(F.array(*[F.lit(w) for w in ("please", "debug", "my", "rust", "lifetimes")]), F.lit(""), ["rust", "go"]))
    assert tuple(found) == ("debug", "rust", "lifetimes")


def test_keys(spark):
    key = crypto.random_bytes()
    rows = spark.range(50).select("id", F.encode(F.col("id").cast("string"), "UTF-8").alias("plain"), crypto.counter_nonce(F.col("id")).alias("nonce"))
    for algorithm in ("chacha20poly1305", "aes256gcm"):
        back = rows.withColumn("s", crypto.seal(F.col("plain"), key, F.col("nonce"), algorithm)).withColumn("p", crypto.unseal(F.col("s"), key, F.col("nonce"), algorithm))
        assert back.where("p = plain and s <> plain").count() == 50
    drawn = [bytes(r[0]) for r in spark.range(200).select(crypto.random_nonce()).collect()]
    assert all(len(n) == 12 for n in drawn) and len(set(drawn)) == 200
    assert len({n[i] for n in drawn for i in range(12)}) > 200  # no byte is fixed by the UUID's format
    assert crypto.derive("hkdf", key, b"x") == crypto.hkdf(key, b"x") and len(crypto.fingerprint(key)) == 8 and crypto.same(key, bytes(key))
    assert crypto.nonce_from(bytes(12)) == bytes(12)
    for bad in (lambda: crypto.nonce_from(b"1"), lambda: crypto.derive("md5", key, b"")):
        with pytest.raises(ValueError):
            bad()
    try:
        import argon2  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError):
            crypto.verify_password(b"p", bytes(16), key)
    else:
        assert crypto.verify_password(b"p", bytes(16), crypto.password_key(b"p", bytes(16)))


def test_bits_and_chunks(spark):
    data = bytes(range(256)) * 50
    assert codecs.zstd_unchunk(codecs.zstd_chunks(data, 1000)) == data and len(codecs.zstd_chunks(data, 1000)) == 13
    assert codecs.read_bits_msb(struct.pack(">IH", 0xDEADBEEF, 0x8001), [4, 12, 16, 1, 15]) == [0xD, 0xEAD, 0xBEEF, 1, 1]
    with pytest.raises(ValueError):
        codecs.read_bits_msb(b"\x00", [9])
    assert one(spark, V.set_bits(F.lit(0b1011))) == 3
    flat = F.array(*[F.lit(1.0)] * 6)
    assert one(spark, V.vector_count(flat, 3)) == 2 and one(spark, V.vector_count(flat, 4)) is None


def test_nearest_texts(spark, monkeypatch):
    """Against every pair by SQL functions: ties, blank and null texts, null ids, two query blocks; no vector leaves the scan."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"W{x}" for x in rng.integers(0, 30, rng.integers(1, 12))) for _ in range(700)]
    texts[5:9] = [" ", None, "", texts[0]]
    rows = spark.createDataFrame([(None if i == 40 else 3 * i, t) for i, t in enumerate([*texts, *texts[100:200]])], "vec_id long, text string").repartition(3)
    queries = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate([*texts[:30], "nothing alike"])], "query_id string, text string")
    embed = models.embedding_udf()
    asked = queries.select("query_id", embed("text").alias("query")).where("query IS NOT NULL")
    scored = topk.pairs(asked, rows.select("vec_id", embed("text").alias("embedding")).where("embedding IS NOT NULL"))
    scored = scored.select("query_id", "vec_id", F.round(V.cosine(F.col("query"), F.col("embedding"), "embedding"), 6).alias("score"))
    want = topk.best(scored, 7, [F.desc("score"), F.asc("vec_id")]).select("query_id", "rank", "vec_id", "score").collect()
    found = topk.nearest_texts(queries, rows, 7)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert set(found.collect()) == set(want) and len(want) == 7 * 28 and "NestedLoop" not in plan and "ArrowEvalPython" not in plan
    monkeypatch.setattr(topk, "BROADCAST_QUERIES", 20)
    assert set(topk.nearest_texts(queries, rows, 7).collect()) == set(want)
    assert topk.nearest_texts(queries, rows.limit(0), 7).count() == 0 and topk.nearest_texts(queries.limit(0), rows, 7).count() == 0


def test_semantic_search_embeds_in_the_scan(spark):
    from tessera.plans import queries

    plan = queries.semantic_search(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "NestedLoop" not in plan


def test_nearest_texts_ranks_every_text(spark, monkeypatch):
    """Against every pair by SQL functions, without a k: ties over tasks and inside bands, blank and null texts, null ids, a query id twice, two query blocks."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 30, rng.integers(1, 12))) for _ in range(300)]
    texts[5:9] = [" ", None, "", texts[0]]
    rows = spark.createDataFrame([(None if i == 40 else 3 * i, t) for i, t in enumerate([*texts, *texts[100:200]])], "vec_id long, text string").repartition(3)
    queries = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate([*texts[:20], "nothing alike"])], "query_id string, text string")
    embed = models.embedding_udf()
    asked = queries.select("query_id", embed("text").alias("query")).where("query IS NOT NULL")
    scored = topk.pairs(asked, rows.select("vec_id", embed("text").alias("embedding")).where("embedding IS NOT NULL"))
    scored = scored.select("query_id", "vec_id", F.round(V.cosine(F.col("query"), F.col("embedding"), "embedding"), 6).alias("score"))
    want = topk.best(scored, 1000, [F.desc("score"), F.asc("vec_id")]).select("query_id", "rank", "vec_id", "score").collect()
    found = topk.nearest_texts(queries, rows)
    assert set(found.collect()) == set(want) and found.count() == len(want) == 18 * 397 and found.schema["rank"].dataType.simpleString() == "int"
    monkeypatch.setattr(topk, "PAIRS", 50)
    monkeypatch.setattr(topk, "BROADCAST_QUERIES", 12)
    assert set(topk.nearest_texts(queries, rows).collect()) == set(want)
    assert topk.nearest_texts(queries, rows.limit(0)).count() == 0 and topk.nearest_texts(queries.limit(0), rows).count() == 0
    twice = topk.nearest_texts(queries.limit(1).union(queries.limit(1)), rows)
    assert twice.count() == 2 * 397 and {r["count"] for r in twice.groupBy("rank").count().collect()} == {2}


def test_bands_follow_falling_scores():
    score = np.array([np.nan, np.inf, 1, 0.995, 0.5, 0, -0.0, -0.5, -1, -np.inf])
    band = topk.bands(score)
    assert (np.diff(band) >= 0).all() and band[0] == 0 and band[-1] == topk.BANDS - 1


def test_semantic_search_ranks_every_document(spark):
    from tessera.plans import queries

    got = queries.semantic_search(spark, "/root/testdata/sf0.001").groupBy("query_id").agg(F.count("*").alias("n"), F.max("rank").alias("last"), F.countDistinct("rank").alias("ranks")).collect()
    held = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.col("text").rlike(r"\S")).count()
    assert len(got) == 40 and {(r["n"], r["last"], r["ranks"]) for r in got} == {(held, held, held)}
