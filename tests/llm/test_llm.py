"""Operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import pickle
import zlib
from collections import Counter
from itertools import cycle
from math import log10

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import ann, bpe, matroska, maxent_lm, mixing, quality, sharding, simhash, token_files, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "one two three four five six seven eight nine ten alpha beta gamma delta".split()


def texts() -> list[str | None]:
    rng = np.random.default_rng(0)
    made = [" ".join(rng.choice(WORDS, rng.integers(5, 60))) for _ in range(40)]
    return [*made, made[0], made[0], None, "", " \n\t ", "x" * 40_000, "long " * 8_000, "a<|endoftext|>b  \n c", "ÀÉ ß İ Σας 中文 😀 \u3000 x"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 7 == 0 else "en", None if i % 11 == 0 else f"s{i % 3}", 0) for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[3]], SCHEMA).withColumns({n: F.lit("clash") for n in ("size", "shard", "host", "fp", "node", "score", "bucket", "target")}).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def raw(docs):
    return [(r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect()]


def test_ann(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((2500, 16)).astype(np.float32)
    x[100:140] = x[0]
    rows = [(i, [float(v) for v in x[i]], "c") for i in range(2500)]
    bad = [(3000, None, "c"), (3020, [0.0] * 16, "c"), (3040, [float("nan")] * 16, "c"), (3060, [1.0], "c"), (3080, [], "c")]
    got = ann.search(spark.createDataFrame([*rows, *bad], "vec_id long, embedding array<float>, rank string")).toPandas()
    assert set(got.query_id) == set(range(0, 2500, 20))
    hit, y = 0, x.astype(float)
    for q in range(0, 2500, 20):
        s = y @ y[q]
        best = [i for i in np.lexsort((np.arange(2500), -s)) if i != q][:20]
        mine = got[got.query_id == q].sort_values("rank")
        assert len(mine) == 20 and np.allclose(mine.score, s[mine.vec_id]) and list(mine["rank"]) == list(range(1, 21))
        hit += len(set(best) & set(mine.vec_id))
    assert hit / (20 * 125) >= 0.9
    assert ann.search(spark.createDataFrame([(0, [1.0, 0.0])], "vec_id long, embedding array<float>")).count() == 0
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_ann_repeated_ids(spark):
    """A repeated id is asked once, with its smallest vector; its rows are candidates of their own."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 16))
    ids = np.arange(900)
    ids[:3], ids[7:9] = 0, 7
    x[100:160] = x[200]
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x)]
    got = ann.search(spark.createDataFrame([*rows, *rows[100:140]], "vec_id long, embedding array<double>"), probes=999).toPandas()
    ids, x = np.concatenate([ids, ids[100:140]]), np.concatenate([x, x[100:140]])
    assert sorted(set(got.query_id)) == list(range(0, 900, 20)) and (got.groupby("query_id").size() == 20).all()
    hit = 0
    for q in range(0, 900, 20):
        y = min(x[ids == q].tolist())
        s = np.array([np.dot(v, y) for v in x])
        best = sorted((-round(float(a), 9), int(i)) for a, i in zip(s, ids) if i != q)[:20]
        mine = got[got.query_id == q].sort_values("rank")
        hit += (Counter((-round(a, 9), i) for a, i in zip(mine.score, mine.vec_id)) & Counter(best)).total()
    assert hit >= 0.98 * len(got)


def test_ann_recall_without_clusters(spark):
    x = np.random.default_rng(2).standard_normal((6000, 64)).astype(np.float32)
    got = ann.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).toPandas()
    s = x[::20].astype(float) @ x.T.astype(float)
    s[np.arange(300), np.arange(0, 6000, 20)] = -np.inf
    best = np.argsort(-s, axis=1)[:, :20]
    found = got.groupby("query_id").vec_id.agg(set)
    assert sum(len(found[20 * i] & set(b)) for i, b in enumerate(best.tolist())) / (20 * 300) >= 0.9


def test_token_files(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(token_files.default_path())
    docs = docs.unionByName(docs.where("doc_id < 4").withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.where("doc_id < 9").withColumn("doc_id", F.lit(5)))
    files = token_files.write_token_files(docs, f"file://{tmp_path}/t", shards=3)
    got = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(spark, files).collect()}
    start = 0
    for doc, text in sorted(raw(docs), key=lambda x: (x[0] is not None, x[0], zlib.crc32(x[1]))):
        ids = np.array([*whole.encode(text.decode(), add_special_tokens=False).ids, 0], "<u4")
        assert got.pop((doc, start)) == (len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert not got
    assert token_files.read_token_files(spark, token_files.write_token_files(empty, f"file://{tmp_path}/e", shards=3)).count() == 0


@pytest.mark.parametrize("bits", [1, 5, 13, 16, 17, 32])
def test_packing(bits, tmp_path):
    import pyarrow as pa

    ids = np.random.default_rng(bits).integers(0, 2**bits, 150_000, dtype=np.uint64).astype(np.uint32)
    with pa.OSFile(str(tmp_path / "f"), "wb") as f:
        writer = token_files.Writer(f, bits)
        writer.add(None, ids[:0])
        for a in range(0, len(ids), 70_001):
            writer.add(a, ids[a : a + 70_001])
        writer.add(-1, ids[:0])
        with pytest.raises(ValueError):
            writer.add(None, ids[:1])
        assert writer.close() == len(ids)
    with pa.OSFile(str(tmp_path / "f")) as f:
        reader = token_files.Reader(f)
        assert [d for d, _, _ in reader.documents()] == [None, 0, 70_001, 140_002, -1]
        assert (np.concatenate([x for _, _, x in reader.documents()]) == ids).all()
        assert (reader.ids(65_530, 20) == ids[65_530:65_550]).all() and len(reader.ids(5, 0)) == 0


def test_sharding(docs, empty):
    got = sharding.with_slots(sharding.kd_shards(docs, 5)).toPandas()
    want = sorted((d, len(t) + 8, zlib.crc32(t)) for d, t in raw(docs))
    assert sorted(map(tuple, got[["doc_id", "size", "text_crc32"]].values.tolist())) == [tuple(w) for w in want]
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert got.shard.between(0, 4).all()
    assert sharding.with_slots(sharding.kd_shards(empty, 5)).count() == 0


def test_sharding_is_even(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "w" * int(rng.integers(1, 200)) if i % 3 else "same text", "en", "hot" if i % 3 == 0 else f"s{i % 5}", 0) for i in range(3000)]
    size = sharding.kd_shards(spark.createDataFrame(rows, SCHEMA), 24).groupBy("shard").agg(F.sum("size").alias("n")).toPandas().n
    assert len(size) == 24 and size.max() / size.min() < 1.1


def brute_tree(rows, shards, first=0, heavy=None):
    """row -> shard by recursion over sorted lists. rows: (row, size, keys)."""
    if shards == 1 or not rows:
        return {r: first for r, _, _ in rows}
    spread = [(max(k[d] for _, _, k in rows) >> 32) - (min(k[d] for _, _, k in rows) >> 32) for d in range(4)]
    dim, half = max(range(4), key=lambda d: (spread[d], -d)), shards // 2

    def cut(part, goal):
        at, point = 0, -(2**62)
        for _, size, k in sorted(part, key=lambda r: r[2][dim]):
            if at + size - goal > goal - at:
                return point
            at, point = at + size, k[dim]
        return point

    goal = sum(s for _, s, _ in rows) * half / shards
    over = cut(rows, goal)
    light = cut([r for r in rows if r[1] <= heavy], goal - sum(s for _, s, k in rows if s > heavy and k[dim] <= over))
    left = [r for r in rows if r[2][dim] <= (over if r[1] > heavy else light)]
    right = [r for r in rows if r not in left]
    return brute_tree(left, half, first, heavy) | brute_tree(right, shards - half, first + half, heavy)


@pytest.mark.parametrize("shards", [6, 8])
def test_sharding_tree(spark, shards):
    """Shards against recursion over sorted lists: widest dimension, weighted medians, heavy documents beside light ones."""
    rng = np.random.default_rng(shards)
    rows = [(i, "w" * int(n), f"l{i % 3}", f"s{i * 7 % 5}", 0) for i, n in enumerate(rng.integers(40, 400, 300))]
    rows += [(1000 + i, "h" * int(n), "l1", "s1", 0) for i, n in enumerate(rng.integers(1500, 3500, 12))]
    docs = spark.createDataFrame(rows, SCHEMA)
    meta = sharding.document_meta(docs).collect()
    want = brute_tree([(r.doc_id, r["size"], tuple(r["keys"])) for r in meta], shards, heavy=sum(r["size"] for r in meta) / shards / sharding.HEAVY)
    got = sharding.kd_shards(docs, shards).toPandas()
    assert dict(zip(got.doc_id, got.shard)) == want
    size = got.groupby("shard")["size"].sum()
    assert size.max() / size.min() < 1.1


def test_sharding_by_target_bytes(spark):
    docs = spark.createDataFrame([(i, "w" * (50 + i % 90), "en", f"s{i % 4}", 0) for i in range(2000)], SCHEMA)
    size = sharding.kd_shards(docs, target_bytes=10_000).groupBy("shard").agg(F.sum("size").alias("n")).toPandas().n
    assert len(size) == -(-int(size.sum()) // 10_000) and size.max() < 10_400 and size.min() > 9_000


def brute_components(prints, radius=3):
    label = list(range(len(prints)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= radius:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_simhash(docs, empty):
    prints = []
    for doc, text in sorted(raw(docs)):
        w = text.lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        prints.append((doc, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    root = brute_components(prints)
    want = sorted((d, f, prints[r][0]) for (d, f), r in zip(prints, root))
    got = sorted((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.simhash_components(docs).collect())
    assert got == want
    assert simhash.simhash_components(empty).count() == 0


@pytest.mark.parametrize("radius", [3, 10])
def test_vantage_points(radius, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 16)
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = base[:100] ^ (np.uint64(1) << rng.integers(0, 64, 100, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 100, dtype=np.uint64))
    points = np.unique(np.concatenate([base, near]))
    want = brute_components([(i, int(p)) for i, p in enumerate(points)], radius)
    assert simhash.components(points, radius).tolist() == want


def test_shards_stay_small(spark):
    """Ten times the points, no larger shard, and no link lost; a set that no split helps is compared in blocks."""
    rng = np.random.default_rng(11)

    def points(n):
        base = rng.integers(-(2**63), 2**63, n)
        return np.unique(np.concatenate([base, base[: n // 5] ^ (1 << rng.integers(0, 60, n // 5)) ^ (1 << rng.integers(0, 60, n // 5))]))

    def largest(fps, most):
        table = spark.createDataFrame([(int(x),) for x in fps], "fp long")
        rows = simhash.shards_of(table, 3, most).toPandas()
        held = {}
        for (shard, a, b), part in rows.groupby(["shard", "a", "b"]):
            held[shard, a, b] = set(part.fp)
        return max(map(len, held.values())), list(held.values())

    for n in (2000, 20_000):
        fps = points(n)
        most, shards = largest(fps, 1000)
        assert most <= 1000
        pairs = [p for i, j in simhash.pair_blocks(fps.view(np.uint64), 3) for p in zip(fps[i].tolist(), fps[j].tolist())]
        assert len(pairs) >= n // 5
        where = {}
        for k, s in enumerate(shards):
            for x in s:
                where.setdefault(x, set()).add(k)
        assert all(where[a] & where[b] for a, b in pairs)
    ball = np.unique([sum(1 << int(b) for b in rng.choice(14, rng.integers(0, 8), replace=False)) for _ in range(6000)])
    most, shards = largest(ball, 500)
    assert most <= 1000 and len(shards) > 1
    assert all(any(a in s and b in s for s in shards) for a, b in rng.choice(ball, (200, 2)).tolist() if (a ^ b).bit_count() <= 3)


def test_components(spark):
    chain = [(i + 1, i) for i in range(30)] + [(100, 101), (101, 102), (5, 5)]
    got = {r.u: r.v for r in simhash.connected(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, 101: 100, 102: 100}


def test_near_duplicates(spark):
    rng = np.random.default_rng(5)
    base = [[f"w{x}" for x in rng.integers(0, 5000, 300)] for _ in range(12)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i in range(6):
        w = list(base[i])
        w[100 + i] = "changed"
        rows.append((100 + i, " ".join(w)))
    rows += [(200, " ".join(base[0])), (300, ""), (301, None), (302, "one two")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert kept == {*range(12), 300, 302}


def test_near_duplicates_of_long_texts(spark):
    base = [f"w{i}" for i in range(2000)]
    cut = lambda n: " ".join([*base[:n], *[f"v{n}.{i}" for i in range(2000 - n)]])
    # n - 4 of 3,996 - n shingles are shared: 0.78 to 0.82.
    for n in range(1750, 1806, 5):
        true = (n - 4) / (2 * 1996 - (n - 4)) >= 0.8
        a, b = (np.unique(simhash.shingle_hashes(x.encode(), 5)) for x in (cut(2000), cut(n)))
        links = simhash.group_links(np.array([1, 2]), np.zeros(2, np.uint64), np.array([len(a), len(b)]), [simhash.signature(cut(x).encode(), 5)[3] for x in (2000, n)], 0.8)
        assert bool(links) == true


def test_near_duplicates_with_repeated_lines(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(30):
        body, line = (" ".join(f"w{x}" for x in rng.integers(0, 50_000, n)) for n in (300, 12))
        rows += [(i, f"{body} {line}"), (100 + i, " ".join([body, *[line] * 40]))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == set(range(30))


def test_group_links():
    rng = np.random.default_rng(7)
    sets = []
    for _ in range(40):
        base = rng.choice(400, 60, replace=False)
        sets += [np.unique(np.concatenate([base[rng.random(60) < 0.9], rng.integers(400, 460, rng.integers(1, 8))])).astype(np.uint64) for _ in range(6)]
    sets += [sets[0], sets[0]]
    n = len(sets)
    share = lambda x, y: len(np.intersect1d(sets[x], sets[y])) / len(np.union1d(sets[x], sets[y]))
    pairs = np.array([(x, y) for x in range(n) for y in range(x) if share(x, y) >= 0.8])
    want = simhash.merge_labels(np.arange(n), pairs[:, 0], pairs[:, 1])
    links = simhash.group_links(np.arange(n), rng.integers(0, 2**63, n).astype(np.uint64), np.array([len(s) for s in sets]), [s.astype("<u8").tobytes() for s in sets], 0.8)
    got = simhash.merge_labels(np.arange(n), *np.array(links).T)
    assert got.tolist() == want.tolist() and 1 < len(set(want.tolist())) < n


def test_keep_one_goes_by_text(spark):
    rng = np.random.default_rng(8)
    a, b, c, d = (" ".join(f"w{x}" for x in rng.integers(0, 50_000, 60)) for _ in range(4))
    rows = [(1, a), (1, b), (2, b + " more"), (None, c), (None, d), (None, d), (3, d + " more"), (4, " "), (5, "\t \n"), (6, a), (7, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_one(docs).collect()), key=str)
    assert kept == sorted([(1, a), (1, b), (None, c), (3, d + " more"), (4, " ")], key=str)


def test_urls(spark):
    urls = ["http://A.Example.ORG/es/1", "https://example.org/en/12?x#y", "https://example.org", None, "no scheme", "http://badexample.org/es/", "x://com/de/", "http://m.a.com/fr/?q", "http://[::1]/", "a://b://c/d", "https://EXAMPLE.org/es/"]
    rows = [(i, u, "clash") for i, u in enumerate([*urls, urls[0]])]
    got = {r.page_id: tuple(r)[1:] for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, rule string")).collect()}
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/", "block") and got[11] == got[0]
    assert got[1] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[2] == ("example.org", "", None, "allow") and got[3] == ("", "", None, "allow") == got[4]
    assert got[5] == ("badexample.org", "/es/", "org/", "allow") and got[6] == ("com", "/de/", "com/de/", "block") and got[7][2:] == ("com/fr/", "allow")
    assert got[9][:2] == ("b:", "//c/d")
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


@pytest.mark.parametrize("lacing", [0, matroska.XIPH, matroska.FIXED, matroska.EBML_LACE])
def test_matroska(lacing, monkeypatch):
    if not lacing:
        monkeypatch.setattr(matroska, "BLOCK_FRAMES", 1)
    for size in (1, 192, 1000, 192 * 3000 + 5):
        data = np.random.default_rng(size).integers(0, 256, size, dtype=np.uint8).tobytes()
        payload = data if lacing != matroska.FIXED else data + bytes(-size % 192)
        file = matroska.mux(payload, lacing=lacing)
        out = matroska.demux(file)
        assert out["error"] is None and b"".join(file[p[2] : p[2] + p[3]] for p in out["packets"]) == payload
        assert len(out["cues"]) == out["clusters"] and [p[1] for p in out["packets"]] == [4_000_000 * i for i in range(len(out["packets"]))]
        for _, _, at in out["cues"]:
            assert file[at : at + 4] == matroska.CLUSTER.to_bytes(4, "big")
        assert matroska.demux(file[: len(file) // 2])["error"]


def test_matroska_unknown_sizes():
    cluster = lambda t, data: matroska.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + matroska.uint(matroska.TIMESTAMP, t) + matroska.element(matroska.SIMPLE_BLOCK, matroska.block(1, 0, [data], 0))
    file = matroska.element(matroska.EBML, b"") + matroska.SEGMENT.to_bytes(4, "big") + b"\xff" + cluster(0, b"ab") + cluster(7, b"cd")
    out = matroska.demux(file)
    assert [file[p[2] : p[2] + p[3]] for p in out["packets"]] == [b"ab", b"cd"] and out["packets"][1][1] == 7_000_000 and out["clusters"] == 2


def test_media_columns(docs, empty):
    media = matroska.media_table(docs).cache()
    assert matroska.packet_table(media).groupBy("doc_id").count().count() == len({d for d, _ in raw(docs)})
    got = sorted(map(tuple, media.mapInArrow(matroska._digest_rows, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").select("doc_id", "n_bytes", "payload_sha256").collect()))
    assert got == sorted((d, len(t), hashlib.sha256(t + b" " * (-len(t) % 192 if t else 192)).hexdigest()) for d, t in raw(docs))
    assert matroska.media_table(empty).count() == 0


def test_quality(spark, empty):
    rng = np.random.default_rng(7)
    good = [" ".join(rng.choice(WORDS, 60)) for _ in range(120)]
    bad = [" ".join(f"{w.upper()}$$$%%" for w in rng.choice(WORDS, 60)) for _ in range(120)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate([*good, *bad, "", None])], SCHEMA)
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(240)] + [(0, 0, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.score_documents(docs, model).collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id < 240]
    assert held and np.mean([(r.doc_id < 120) == (r.predicted == 1) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values()) and all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    odd = docs.withColumns({"a b": F.array(F.struct(F.lit(1).alias("x y"))), "score": F.lit("clash")})
    kept = quality.keep_good(odd, model)
    assert kept.schema == odd.schema
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got.values() if r.score >= quality.THRESHOLD)
    again = quality.score_documents(odd.unionByName(odd), model).collect()
    assert len(again) == 2 * len(got) and all(r.score == got[r.doc_id].score for r in again)
    unnamed = quality.score_documents(docs.withColumn("doc_id", F.lit(None).cast("long")), model)
    assert unnamed.where("held_out is null or doc_id is not null").count() == 0
    none = quality.fit(docs, labels.limit(0))
    assert all(r.score == 1.0 for r in quality.score_documents(docs, none).collect())
    assert quality.score_documents(empty, none).count() == 0 and none.prior == 1.0


def test_language_model(docs, empty):
    rows = raw(docs)
    cut = [(d, t.lower().split() + [b""]) for d, t in rows]
    out = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    counts = Counter(w for d, words in cut if not out(d) for w in words)
    total, kinds = sum(counts.values()), len(counts)
    want = sorted((d, out(d), len(w), sum(counts[x] > 0 for x in w), total, round(sum(log10((counts[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in w), 6)) for d, w in cut)
    got = maxent_lm.score_documents(docs).collect()
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert sum(r.score for r in got if not r.held_out) > sum(r.base_score for r in got if not r.held_out)
    assert maxent_lm.score_documents(empty).count() == 0


def test_quality_of_long_texts():
    """A text of many blocks has the sum of its blocks' sizes, and a score is the calibration of the difference alone."""
    rng = np.random.default_rng(9)
    make = lambda f: [" ".join(f(w) for w in rng.choice(WORDS, 200)).encode() for _ in range(60)]
    good, bad = (quality.Sizer(quality.dictionary(make(f))) for f in (str, str.upper))
    text = b"".join(make(str))
    assert good.size(text) == sum(good.size(text[a : a + quality.BLOCK]) for a in range(0, len(text), quality.BLOCK))
    (one, d), (_, none) = quality.differences([text, b""], good, bad)
    assert one == 1 and none == 0 and d == pytest.approx(10 * (bad.size(text) - good.size(text)) / len(text)) and d > 0


def slow_log(model, one: int, two: int, slot: int) -> float:
    """Natural log of p(slot | two, one), a number at a time. one, two: codes of the words before."""
    priors, out, mask = maxent_lm.log_priors(model.mass).astype(float), 0.0, 2**64 - 1
    odd = [int(x) for x in maxent_lm.ODD]
    feature = [one >> 32, two >> 32, (one * odd[0] & mask) ^ (two * odd[1] & mask)]
    first = 0
    for level in range(maxent_lm.LEVELS):
        node = first + slot // 16 ** (3 - level)
        logits = priors[node].copy()
        for kind in maxent_lm.USED[level]:
            mixed = (feature[kind] * odd[0] + node * odd[1] + kind) * odd[2] & mask
            mixed = (mixed ^ mixed >> 29) * odd[0] & mask
            half, base = ((model.bits - 1, 0), (model.bits - 2, 2), (model.bits - 2, 3))[kind]
            logits += model.weights[(mixed >> 64 - half) + (base << model.bits - 2)]
        out += logits[slot // 16 ** (2 - level) % 16] - np.log(np.exp(logits).sum())
        first += 16**level
    return out


def test_language_model_scores(docs):
    """Every score against a loop over tokens; p sums to one over all words and the unseen one."""
    keyed, size = maxent_lm.dealt_texts(docs, "doc_id", "text")
    _, counts = maxent_lm.count_words(keyed)
    model = maxent_lm.fit(keyed, counts, size)
    assert np.abs(model.weights).max() > 0.1
    count = {bytes(r.word): r.c for r in counts.collect() if r.c}
    code, start = maxent_lm.Vocabulary(model.top), maxent_lm.START << 32
    part = lambda w, slot: np.log((count.get(w, 0) + 0.5) / model.mass[slot])
    slot_of = lambda w: code[w] >> 32 if w in count else maxent_lm.UNSEEN
    got = {(r.doc_id, r.n_tokens): r.score for r in maxent_lm.score_documents(docs).collect()}
    for d, text in raw(docs):
        if len(text) < 5000:
            words, one, two, want = text.lower().split() + [b""], start, start, 0.0
            for w in words:
                want += slow_log(model, one, two, slot_of(w)) + part(w, slot_of(w))
                one, two = code[w], one
            assert got[d, len(words)] == pytest.approx(want / np.log(10), abs=1e-3)
    for one, two in ((start, start), (code[b"two"], start), (code[b"unheard"], code[b"one"])):
        total = np.exp(slow_log(model, one, two, maxent_lm.UNSEEN))
        for w in count:
            total += np.exp(slow_log(model, one, two, slot_of(w)) + part(w, slot_of(w)))
        assert total == pytest.approx(1, abs=1e-4)


def test_language_model_learns(spark):
    """What follows depends on the words before: held-out texts are likelier than under the base model."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{x}" for x in rng.integers(0, 20, 120)), "en", "s", 0) for i in range(300)]
    got = [r for r in maxent_lm.score_documents(spark.createDataFrame(rows, SCHEMA)).collect() if r.held_out]
    assert sum(r.score - r.base_score for r in got) / sum(r.n_tokens for r in got) > 0.15


def test_counts_of_weights_that_came_by_pickle(monkeypatch):
    """A broadcast's arrays have a dtype object of their own, with which ``add.at`` casts each number: counts are added to numpy's own."""
    met = []

    class Add:
        @staticmethod
        def at(to, places, numbers):
            met.append(to.dtype is np.dtype(to.dtype.type))
            np.add.at(to, places, numbers)

    class Numpy:
        add = Add

        def __getattr__(self, name):
            return getattr(np, name)

    rng = np.random.default_rng(6)
    weights = rng.normal(0, 0.3, (1 << 16, maxent_lm.FAN)).astype(np.float32)
    priors = maxent_lm.log_priors(rng.random(maxent_lm.SLOTS) + 0.1)
    codes, ends = maxent_lm.coded([b"a b  A c", b"", b"b a"], maxent_lm.Vocabulary([b"", b"a"]))
    monkeypatch.setattr(maxent_lm, "np", Numpy())
    sums = []
    for now in (weights, pickle.loads(pickle.dumps(weights))):
        sums.append((np.zeros_like(now), np.zeros_like(now)))
        maxent_lm.add_counts(maxent_lm.histories(codes, ends), codes >> 32, now, priors, *sums[-1])
    assert met and all(met)
    assert all((a == b).all() for a, b in zip(*sums)) and sums[0][0].sum() == 8 * len(codes) and sums[0][1].sum() == pytest.approx(8 * len(codes))


def test_codes_of_many_words():
    """Slots and codes made together are those made one by one."""
    rng = np.random.default_rng(7)
    words = [b"", b"a", b"\xff", *(bytes(rng.integers(0, 256, n).tolist()) for n in rng.integers(0, 40, 500)), *(bytes([a, b]) for a in range(0, 256, 5) for b in range(256))]
    vocabulary = maxent_lm.Vocabulary(words[3:50])
    assert maxent_lm.spelt_slots(words).tolist() == [maxent_lm.spelt_slot(w) for w in words]
    assert vocabulary.codes(words).tolist() == [vocabulary[w] for w in words] and vocabulary.codes([]).tolist() == []


def test_bpe(docs, empty):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(bpe.default_path())
    got = sorted(map(tuple, bpe.bpe_digests(docs).collect()))
    want = []
    for d, t in raw(docs):
        ids = whole.encode(t.decode(), add_special_tokens=False).ids
        back = whole.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.bpe_digests(empty).count() == 0


def test_bpe_of_every_code_point():
    """As the library, whatever Unicode version Python's tables have."""
    from tokenizers import Tokenizer

    whole, mine = Tokenizer.from_file(bpe.default_path()), bpe.load(bpe.default_path())
    points = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x323B0), *range(0xE0000, 0xE01F0))]
    for a in range(0, len(points), 5000):
        pieces = [f"c{x}cy{y}c{x}" for x, y in zip(points[a : a + 5000], cycle("z.é1"))] + [f"ab{x}cy" for x in points[a : a + 5000]] + points[a : a + 5000]
        want = [w.ids for w in whole.encode_batch(pieces, add_special_tokens=False)]
        cut = [p.encode().split() for p in pieces]
        got = mine.encode_pieces([p for parts in cut for p in parts] or [b"x"])
        at = 0
        for p, parts, ids in zip(pieces, cut, want):
            assert np.frombuffer(b"".join(g[0] for g in got[at : at + len(parts)]), "<u4").tolist() == ids, repr(p)
            at += len(parts)


def test_bpe_of_random_texts():
    from hypothesis import given, settings, strategies as st
    from tokenizers import Tokenizer

    whole, mine = Tokenizer.from_file(bpe.default_path()), bpe.load(bpe.default_path())

    @settings(max_examples=400, deadline=None)
    @given(st.text(max_size=60) | st.text(alphabet="aA'sté \n1.,<|endoftext>ΣἈ\u0301\u0345\u0301", max_size=60))
    def check(text):
        import pyarrow as pa

        batch = pa.record_batch([pa.array([0]), pa.array([text.encode()])], ["k", "t"])
        ((_, ids, out),) = bpe.coded([batch], bpe.default_path())
        want = whole.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want and out.decode() == whole.decode(want, skip_special_tokens=False) == mine.decode(want)

    check()


def test_mixing(docs, empty):
    got = mixing.mix_report(docs).toPandas()
    assert len(got) == len(raw(docs)) and (got.taken <= 2 * got["size"]).all()
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    size: dict = {}
    for d, t in raw(docs):
        size[source[d]] = size.get(source[d], 0) + len(t.split())
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(size.values()), set(size)
    while True:
        per = left / sum(weight[s] for s in free)
        over = [s for s in free if per * weight[s] > 2 * size[s]]
        if not over:
            target |= {s: per * weight[s] for s in free}
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
            free.discard(s)
    for s in size:
        part = got[[source[d] == s for d in got.doc_id]]
        assert np.allclose(part.target, target[s]) and abs(part.taken.sum() - target[s]) <= 1 and (part.source_size == size[s]).all()
    again = mixing.mix_report(docs).toPandas()
    assert sorted(zip(again.doc_id, again.taken)) == sorted(zip(got.doc_id, got.taken))
    assert mixing.mix_report(empty).count() == 0
    assert mixing.mix_documents(docs).schema == docs.schema and mixing.mix_documents(empty).count() == 0


def test_mixing_cuts_the_sorted_sequence(docs):
    """Every document's words against a loop over the sorted sequence."""
    keyed = docs.select("doc_id", "text", "source").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("order", F.xxhash64("doc_id", F.crc32(F.col("text").cast("binary")), F.lit(mixing.SEED)))
    target = {(r.doc_id): (r.target, r.source_size) for r in mixing.mix_report(docs).collect()}
    queues: dict = {}
    for r in sorted(keyed.collect(), key=lambda r: (r.order, r.doc_id, len(r.text.encode().split()))):
        queues.setdefault(r.source, []).append((r.doc_id, len(r.text.encode().split())))
    sequence, border, full = [], {}, {}
    for source, held in queues.items():
        goal, every = target[held[0][0]]
        assert every == sum(n for _, n in held)
        at = 0
        for turn in range(2):
            for doc, n in held:
                if goal > 0:
                    sequence.append(((at + n) / goal, "n" if source is None else f"s{source}", turn, at - every * turn, doc, n, source))
                border[doc] = border.get(doc, 0) + max(0, min(n, round(goal) - at))
                at += n
    total = 0
    for _, _, _, _, doc, n, _ in sorted(sequence):
        total += n
        if total > round(sum({s: target[q[0][0]][0] for s, q in queues.items()}.values())):
            break
        full[doc] = full.get(doc, 0) + n
    got = mixing.mix_report(docs).toPandas().groupby("doc_id")[["taken", "whole"]].sum()
    copies = Counter(r.doc_id for r in keyed.collect())
    for doc in got.index:
        assert got.taken[doc] == border[doc] and got.whole[doc] == full.get(doc, 0), (doc, copies[doc])
    mixed = Counter((r.doc_id, r.text) for r in mixing.mix_documents(docs).collect())
    text = {r.doc_id: r.text for r in docs.collect()}
    for doc, n in got.whole.items():
        if words := len((text[doc] or "").encode().split()):
            assert mixed[doc, text[doc]] * words == n


def test_near_duplicates_go_by_fingerprints(spark, monkeypatch):
    """Without min-wise partitions, similar texts within the radius are found by the fingerprints' components; unlike texts of one component stay apart."""
    rng = np.random.default_rng(15)
    base = [[f"w{x}" for x in rng.integers(0, 50_000, 3000)] for _ in range(20)]
    texts = [" ".join(w) for w in base] + [" ".join(w[:-1] + ["changed"]) for w in base]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    prints = [simhash.signature(t.encode(), 5)[1] for t in texts]
    assert all((prints[i] ^ prints[20 + i]).bit_count() <= simhash.RADIUS for i in range(20))
    whole = simhash.signature
    monkeypatch.setattr(simhash, "signature", lambda text, width: (*whole(text, width)[:4], []))
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == set(range(20))
    # One fingerprint for all: a single component, in which the shingle sets decide.
    monkeypatch.setattr(simhash, "signature", lambda text, width: (whole(text, width)[0], 0, *whole(text, width)[2:4], []))
    monkeypatch.setattr(simhash, "GROUP_BLOCK", 16)
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == set(range(20))


def test_partitions_of_one_component_are_left_out(spark):
    nodes = spark.createDataFrame([(1, 5, 70, [1, 2]), (2, 5, 70, [1, 3]), (3, 5, 80, [2, 4]), (4, 5, 90, [4, 3])], "node long, n long, cluster long, bands array<long>")
    got = {(r.way, r.key, r.node) for r in simhash.partitions(nodes).collect()}
    assert got == {(0, 70, 1), (0, 70, 2), (1, 2, 1), (1, 2, 3), (1, 3, 2), (1, 3, 4), (1, 4, 3), (1, 4, 4)}


def test_links_in_few_files(spark, monkeypatch):
    """A table of links is a file for each core at most, however many shuffle partitions there are."""
    written, whole = [], simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df, name: written.append((name, len((out := whole(df, name)).inputFiles()))) or out)
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 40)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        chain = spark.createDataFrame([(i + 1, i) for i in range(300)], "u long, v long")
        assert {(r.u, r.v) for r in simhash.connected(chain).collect()} == {(i, 0) for i in range(1, 301)}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert written and max(n for _, n in written) <= spark.sparkContext.defaultParallelism


def test_words_are_counted_in_one_shuffle(spark, monkeypatch):
    """Counts of all training texts beside each block's words, by a window and without a join; a repeated flush changes nothing."""
    monkeypatch.setattr(maxent_lm, "WORDS_HELD", 3)
    rows = [(i % 3, i % 4 == 1, f"a b{i % 5} A c{i} b{i % 2}".encode()) for i in range(40)]
    keyed = spark.createDataFrame(rows, "block int, held_out boolean, text binary")
    plans, whole = [], maxent_lm.materialize
    monkeypatch.setattr(maxent_lm, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or whole(df, name))
    words, counts = (x.collect() for x in maxent_lm.count_words(keyed))
    want = Counter(w for _, held, t in rows if not held for w in [*t.lower().split(), b""])
    asked = {(b, w) for b, _, t in rows for w in [*t.lower().split(), b""]}
    assert {(r.block, bytes(r.word), r.c) for r in words} == {(b, w, want[w]) for b, w in asked}
    assert sorted((bytes(r.word), r.c) for r in counts) == sorted({(w, want[w]) for _, w in asked})
    assert len(plans) == 1 and "Join" not in plans[0] and plans[0].count("Exchange hashpartitioning(word") == 1 and plans[0].count("Sort [word") == 1
