"""The corpus pipeline from end to end, each stage against brute force on what the one before kept."""

import hashlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import bpe, mixing, quality, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "one two three four five six seven eight nine ten alpha beta gamma delta".split()


def shingles(text: str) -> set:
    w = [x.decode() for x in text.encode().lower().split()]
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def tables(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).withColumns({"a b": F.lit("x"), "size": F.lit(1), "node": F.lit("clash")}).write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], 0 if "$$" in (r[1] or "") else 1, 0) for r in rows if r[0] is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(12)
    good = [" ".join(rng.choice(WORDS, rng.integers(30, 90))) for _ in range(150)]
    bad = [" ".join(f"{w.upper()}$$$%%" for w in rng.choice(WORDS, 50)) for _ in range(100)]
    near = [t + " changed" for t in good[:10]]
    rows = [(i, t, "en", None if i % 9 == 0 else f"s{i % 4}", 0) for i, t in enumerate([*good, *bad, *near, good[20], good[20], "", None, " \n", "Ünïcode Σας 中文 " * 3, "long text of words " * 2000])]
    rows += [(None, good[30] + " without an id", "en", "s1", 0), (3, "another text under a used id " * 3, "en", "s2", 0)]
    tables(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    model = quality.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    held = [r for r in docs.collect() if quality.scores([(r.text or "").encode()], model)[0] >= quality.THRESHOLD]
    first = corpus_pipeline.good_documents(spark, docs, str(tmp_path))
    key = lambda r: (r.doc_id, r.text, r.source)
    assert first.schema == docs.schema and Counter(map(key, first.collect())) == Counter(map(key, held))
    assert 0 < len(held) < len(rows) and sum("$$" in (r.text or "") for r in held) <= 5

    sets = [shingles(r.text or "") for r in held]
    label = list(range(len(held)))
    for i in range(len(held)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if label[i] != label[j] and (not a and not b or a and b and len(a & b) >= 0.8 * len(a | b)):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    groups = {}
    for r, x in zip(held, label):
        groups.setdefault(x, []).append(r)
    firsts = Counter(key(min(g, key=lambda r: (r.doc_id is None, r.doc_id, hashlib.md5((r.text or "").encode()).digest()))) for g in groups.values())
    second = corpus_pipeline.one_of_each(spark, first, str(tmp_path)).cache()
    assert second.schema == docs.schema and Counter(map(key, second.collect())) == firsts and len(groups) < len(held)

    third = corpus_pipeline.mixed(spark, second, str(tmp_path)).cache()
    whole = Counter()
    for r in mixing.mix_report(second).collect():
        whole[r.doc_id] += r.whole
    words = Counter()
    for r in third.collect():
        words[r.doc_id] += len((r.text or "").encode().split())
    assert third.schema == docs.schema and +words == +whole

    library = Tokenizer.from_file(bpe.default_path())
    want = Counter()
    for r in third.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want[r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    assert Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == want


def test_pipeline_of_empty_tables(spark, tmp_path):
    tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicates_of_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0
