"""Compression classifier of text quality.

Two zstandard dictionaries are built, one from good and one from bad labelled texts. A text is compressed with both, block
by block (``BLOCK`` bytes, so a dictionary counts the same at any place of a long text). The one signal is the normalised
difference of the sizes, (bad - good) / bytes; a logistic calibration, fitted on labelled texts that neither dictionary has seen,
turns it into the score.

Fitting uses a bounded sample: at most ``SAMPLE_ROWS`` rows and ``SAMPLE_BYTES`` bytes per class, in hash order
of doc_id; class weights restore the labels' own proportions. Only doc_ids whose crc32 (as text) is
not 2 modulo 4 are learnt from. Scoring covers every byte of every text.

Defined results: a null text is an empty one, and empty texts get a score like any other; a null doc_id is not held out;
contradicting labels of one document are left out; without labels of both classes every score is the share of good ones (1 without
any label); an empty table gives an empty table; rows may repeat; further columns are not read. ``keep_good`` returns the
columns of its input, whatever their names and types.
"""

from __future__ import annotations

import hashlib
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import text_or_empty

LEVEL, DICT_BYTES, BLOCK = 3, 112_640, 1024
SAMPLE_ROWS, SAMPLE_BYTES, DICT_SHARE = 4000, 24 << 20, 0.5
THRESHOLD = 0.7


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    #: Intercept and slope over the normalised difference; none without labels of both classes.
    weights: list[float]
    prior: float


class Sizer:
    """Compressed sizes with one dictionary."""

    def __init__(self, dictionary: bytes, level: int = LEVEL):
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)
        self.frame = len(self.compressor.compress(b""))

    def size(self, text: bytes) -> int:
        compress, frame = self.compressor.compress, self.frame
        return sum([len(compress(text[a : a + BLOCK])) - frame for a in range(0, len(text), BLOCK)])


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary of an eighth of the samples' bytes, ``DICT_BYTES`` at most; their own bytes where they are too few to train on."""
    try:
        size = min(DICT_BYTES, max(256, sum(map(len, samples)) // 8))
        return zstandard.train_dictionary(size, [s[a : a + BLOCK] for s in samples for a in range(0, len(s), BLOCK)]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICT_BYTES:] or b" " * 8


def differences(texts: list[bytes], good: Sizer, bad: Sizer) -> np.ndarray:
    """Rows of 1 and the normalised compressed-size difference."""
    d = np.array([(bad.size(t) - good.size(t)) / max(1, len(t)) for t in texts], float)
    return np.stack([np.ones_like(d), 10 * d], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-4, steps: int = 60) -> np.ndarray:
    """Weighted logistic regression by damped Newton steps."""
    theta = np.zeros(x.shape[1])
    loss = lambda t: float((w * np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ t))).sum() / w.sum() + ridge / 2 * t @ t)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        slope = x.T @ (w * (p - y)) / w.sum() + ridge * theta
        bend = (x * (w * p * (1 - p))[:, None]).T @ x / w.sum() + ridge * np.eye(len(theta))
        step, scale = np.linalg.solve(bend, slope), 1.0
        while scale > 1e-4 and loss(theta - scale * step) > loss(theta):
            scale /= 2
        theta = theta - scale * step
        if np.abs(scale * step).max() < 1e-8:
            break
    return theta


def remainder(key: str, modulus: int):
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(modulus))


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> tuple[dict[int, list[bytes]], dict[int, int]]:
    """Texts and number of labelled documents per class, from those that may be learnt from."""
    agreed = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("z")).where("y = z")
    agreed = agreed.where(F.col("doc_id").isNotNull() & (remainder("doc_id", 4) != 2)).select("doc_id", "y")
    counts = {r.y: r["count"] for r in agreed.groupBy("y").count().collect()}
    order = F.xxhash64("doc_id", F.lit(7))
    parts = [agreed.where(F.col("y") == y).orderBy(order, "doc_id").limit(SAMPLE_ROWS) for y in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"))
    sized = texts.select("doc_id", F.octet_length("text").alias("n")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.max("n").alias("n")).orderBy(order, "doc_id").collect()
    room, kept = {0: SAMPLE_BYTES, 1: SAMPLE_BYTES}, []
    for r in sized:
        if r.n <= room[r.y]:
            room[r.y] -= r.n
            kept.append((r.doc_id, r.y))
    out: dict[int, list[bytes]] = {0: [], 1: []}
    if kept:
        wanted = docs.sparkSession.createDataFrame(kept, "doc_id long, y int")
        once = texts.join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
        for r in once.orderBy(order, "doc_id").collect():
            out[r.y].append(bytes(r.text))
    return out, counts


def fit(docs: DataFrame, labels: DataFrame) -> QualityModel:
    texts, counts = labelled_sample(docs, labels)
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 1.0
    if min(len(texts[0]), len(texts[1])) < 4:
        return QualityModel(b"", b"", [], prior)
    cut = {y: max(2, int(len(t) * DICT_SHARE)) for y, t in texts.items()}
    good, bad = (dictionary(texts[y][: cut[y]]) for y in (1, 0))
    rest = {y: texts[y][cut[y] :] for y in (0, 1)}
    x = differences(rest[1] + rest[0], Sizer(good), Sizer(bad))
    y = np.array([1.0] * len(rest[1]) + [0.0] * len(rest[0]))
    w = np.array([counts[1] / len(rest[1])] * len(rest[1]) + [counts[0] / len(rest[0])] * len(rest[0]))
    return QualityModel(good, bad, logistic(x, y, w).tolist(), prior)


_sizers: dict[str, tuple[Sizer, Sizer]] = {}


def scores(texts: list[bytes], model: QualityModel) -> np.ndarray:
    if not model.weights:
        return np.full(len(texts), model.prior)
    name = hashlib.sha256(pickle.dumps((model.good, model.bad))).hexdigest()
    if name not in _sizers:
        _sizers.clear()
        _sizers[name] = Sizer(model.good), Sizer(model.bad)
    return 1 / (1 + np.exp(-np.clip(differences(texts, *_sizers[name]) @ np.array(model.weights), -40, 40)))


def score_documents(docs: DataFrame, model: QualityModel, key: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                got = scores([t.as_py() for t in part.column(2)], model)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(got, pa.float64())], ["doc_id", "held_out", "score"])

    out = F.coalesce(remainder(key, 4) == 2, F.lit(False))
    keyed = docs.select(F.col(key).cast("long").alias("doc_id"), out.alias("held_out"), text_or_empty().cast("binary").alias("text"))
    scored = keyed.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that reach the threshold, with their own columns; a text crosses to Python once."""
    names = docs.columns
    plain = docs.withColumn("text", F.col("text").cast("string")).toDF(*[f"c{i}" for i in range(len(names))])
    at = names.index("text")

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                got = scores([(t.as_py() or "").encode("utf-8") for t in part.column(at)], model)
                yield part.filter(pa.array(got >= threshold))

    return plain.mapInArrow(run, plain.schema).toDF(*names)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_documents(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
