"""Hashed maximum-entropy language model with a class-factored softmax.

Tokens: words (A-Z lower-cased, maximal runs without space and the code points 9 to 13), then one end per text.
Every word has one of ``SLOTS`` member slots: the ``TOP`` most frequent words one of their own, all others one that their
spelling names, unseen words the last. Slots lie in nested classes of ``FAN``: p(word | h) is the product of a softmax over
``FAN`` classes, one over the ``FAN`` classes inside, one over the ``FAN`` slots in that, and the word's part of its slot under
the corpus counts. Without weights that product is the base model, so the model is a distribution over all words and
the unseen one.

Features of a history are hashed together with the class they speak about into weight rows of ``FAN`` numbers: the word
before (n-gram), the word before that (skip), both as they are spelt (n-gram). There is a row for every ``TOKENS_PER_ROW``
training tokens, between ``LEAST_BITS`` and ``MOST_BITS`` bits of them: a worker holds all weights (16 MB at most).

Training takes every training text (crc32 of doc_id as text is not 1 modulo 5) once, in ``ROUNDS`` distributed gradient updates.
All tasks add up observed and expected counts per row over their texts of the round; the sums meet by ranges of
rows, and a weight moves by ``RATE`` times the logarithm of observed over expected counts (the gradient, scaled by its curvature),
both eased by ``RIDGE``. Scoring gathers the few rows of each token in numpy batches.

Base score: counts of all words over all training texts. The vocabulary grows with the corpus, so it is never broadcast or
collected: texts are dealt to blocks of about ``BLOCK_BYTES``, each block names its distinct words, a window over each word adds up its counts and
the answers meet the block's texts again. A block's size does not depend on the table's or the cluster's.

Defined results: a null text is an empty one (one end token); a null doc_id is not held out; without training texts all tokens
are unseen; an empty table gives an empty table; rows may repeat; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from tessera.llm.common import materialize, text_or_empty

FAN, LEVELS = 16, 3
SLOTS = FAN**LEVELS
TOP, UNSEEN, START = 3072, SLOTS - 1, SLOTS
NODES = [0, 1, 1 + FAN]
#: Features of each level: 0 the word before, 1 the word before that, 2 both.
USED = [(0, 1, 2), (0, 1, 2), (0, 2)]
ROUNDS, RATE, RIDGE, STEEPEST = 4, 0.6, 4.0, 20.0
TOKENS_PER_ROW, LEAST_BITS, MOST_BITS = 256, 16, 18
BLOCK_BYTES, TASK_BYTES, PARTS = 8 << 20, 512 << 20, 16
END = b""
CHUNK = 1 << 13
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def spelt_slot(word: bytes) -> int:
    """Slot of a word that has none of its own: by its ending, then by its first byte and length."""
    slot = TOP + zlib.crc32(word[-2:]) % 32 * 32 + zlib.crc32(word[:1] + bytes([min(len(word) // 3, 7)])) % 32
    return min(slot, UNSEEN - 1)


def _crcs(make) -> np.ndarray:
    return np.array([zlib.crc32(make(i)) for i in range(256)], np.int64)


#: ``spelt_slot`` in parts: the last two bytes (a CRC is affine in each of them), a word's only byte, the length's class and the first byte.
TWO_LAST = (_crcs(lambda i: bytes([i, 0]))[:, None] ^ _crcs(lambda i: bytes([0, i])) ^ zlib.crc32(bytes(2))) % 32 * 32
ONE_LAST = _crcs(lambda i: bytes([i])) % 32 * 32
FIRST = np.array([_crcs(lambda i, k=k: bytes([i, k])) % 32 for k in range(8)])
NONE = zlib.crc32(b"") % 32 * 32 + zlib.crc32(bytes(1)) % 32


def spelt_slots(words: list[bytes]) -> np.ndarray:
    """``spelt_slot`` of many words."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat, ends = np.frombuffer(b"".join((bytes(2), *words, bytes(1))), np.uint8), np.cumsum(sizes) + 2
    last = np.where(sizes > 1, TWO_LAST[flat[ends - 2], flat[ends - 1]], ONE_LAST[flat[ends - 1]])
    named = last + FIRST[np.minimum(sizes // 3, 7), flat[ends - sizes]]
    return np.minimum(TOP + np.where(sizes > 0, named, NONE), UNSEEN - 1)


def slots_of(words: list[bytes], rank: dict[bytes, int]) -> np.ndarray:
    """Slots of many words. rank: the words with one of their own."""
    own = np.fromiter(map(rank.get, words, repeat(-1)), np.int64, len(words))
    shared = np.flatnonzero(own < 0)
    own[shared] = spelt_slots([words[i] for i in shared.tolist()])
    return own


class Vocabulary:
    """Codes of words: slot << 32 | hash."""

    def __init__(self, top: list[bytes]):
        self.rank = {w: i for i, w in enumerate(top)}

    def __getitem__(self, word: bytes) -> int:
        slot = self.rank.get(word)
        return (spelt_slot(word) if slot is None else slot) << 32 | zlib.crc32(word)

    def codes(self, words: list[bytes]) -> np.ndarray:
        return slots_of(words, self.rank) << 32 | np.fromiter(map(zlib.crc32, words), np.int64, len(words))


def histories(codes: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """The three features of every token. codes: all texts' tokens, the last of each text at ``ends``."""
    first = np.zeros(len(codes), bool)
    first[0] = True
    first[ends[:-1] + 1] = True
    second = np.roll(first, 1)
    second[0] = False
    one = np.where(first, START << 32, np.roll(codes, 1)).astype(np.uint64)
    two = np.where(first | second, START << 32, np.roll(codes, 2)).astype(np.uint64)
    half = np.uint64(32)
    return [one >> half, two >> half, (one * ODD[0]) ^ (two * ODD[1])]


def rows_of(feature: np.ndarray, kind: int, node: np.ndarray, bits: int) -> np.ndarray:
    """Weight rows of a feature at class ``node``: the first half for the word before, a quarter for each of the others."""
    mixed = (feature * ODD[0] + node.astype(np.uint64) * ODD[1] + np.uint64(kind)) * ODD[2]
    mixed ^= mixed >> np.uint64(29)
    mixed *= ODD[0]
    low = bits - 1 if kind == 0 else bits - 2
    base = (0, 2, 3)[kind] << (bits - 2)
    return (mixed >> np.uint64(64 - low)).astype(np.int64) + base


def log_priors(mass: np.ndarray) -> np.ndarray:
    """Natural log of each class's part of the one around it: a row for each node."""
    out = []
    for level in range(LEVELS):
        held = mass.reshape(FAN**level, FAN, -1).sum(axis=2)
        with np.errstate(divide="ignore", invalid="ignore"):
            out.append(np.where(held > 0, np.log(held / held.sum(axis=1, keepdims=True)), -np.inf))
    return np.concatenate(out).astype(np.float32)


def path(slot: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(node, digit) of a slot at each level."""
    return [(NODES[level] + slot // FAN ** (LEVELS - level), slot // FAN ** (LEVELS - 1 - level) % FAN) for level in range(LEVELS)]


@dataclass
class Model:
    top: list[bytes]
    #: Eased corpus counts of each slot.
    mass: np.ndarray
    weights: np.ndarray
    total: int
    kinds: int

    @property
    def bits(self) -> int:
        return len(self.weights).bit_length() - 1

    @property
    def whole(self) -> float:
        return self.total + 0.5 * (self.kinds + 1)


def logits_of(rows: dict[int, np.ndarray], node: np.ndarray, weights: np.ndarray, priors: np.ndarray) -> np.ndarray:
    logits = priors.take(node, axis=0)
    for r in rows.values():
        logits += weights.take(r, axis=0)
    return logits


def slot_logs(features: list[np.ndarray], slot: np.ndarray, weights: np.ndarray, priors: np.ndarray) -> np.ndarray:
    """Natural log of p(slot | history) of every token."""
    bits, out, ones = len(weights).bit_length() - 1, np.zeros(len(slot)), np.ones(FAN, np.float32)
    for a in range(0, len(slot), CHUNK):
        part, to = slice(a, a + CHUNK), slot[a : a + CHUNK]
        for level, (node, digit) in enumerate(path(to)):
            logits = logits_of({k: rows_of(features[k][part], k, node, bits) for k in USED[level]}, node, weights, priors)
            chosen = logits[np.arange(len(to)), digit]
            np.exp(logits, out=logits)
            out[part] += chosen - np.log(logits @ ones)
    return out


def add_counts(features: list[np.ndarray], slot: np.ndarray, weights: np.ndarray, priors: np.ndarray, observed: np.ndarray, expected: np.ndarray) -> None:
    """Adds the tokens' observed and expected counts per weight; expected ones two at a time, as the parts of complex numbers.

    The view as float32 matters: a dtype that came by pickle is equal to numpy's own but another object, with which ``add.at`` takes some 15 times as long."""
    bits, ones, outputs = len(weights).bit_length() - 1, np.ones(FAN, np.float32), np.arange(FAN // 2)
    observed, expected = observed.reshape(-1).view(np.float32), expected.reshape(-1).view(np.complex64)
    for a in range(0, len(slot), CHUNK):
        part, to = slice(a, a + CHUNK), slot[a : a + CHUNK]
        for level, (node, digit) in enumerate(path(to)):
            rows = {k: rows_of(features[k][part], k, node, bits) for k in USED[level]}
            p = logits_of(rows, node, weights, priors)
            np.exp(p, out=p)
            p /= (p @ ones)[:, None]
            flat = p.reshape(-1).view(np.complex64)
            for r in rows.values():
                np.add.at(observed, r * FAN + digit, np.float32(1))
                np.add.at(expected, ((r * (FAN // 2))[:, None] + outputs).reshape(-1), flat)


def cut_texts(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """All texts' tokens, and the places of the texts' ends."""
    flat, ends = [], []
    for t in texts:
        flat += words_of(t)
        ends.append(len(flat))
        flat.append(END)
    return flat, np.array(ends, np.int64)


def coded(texts: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts' tokens, and the places of the texts' ends."""
    words, ends = cut_texts(texts)
    return vocabulary.codes(words), ends


def shortened(x: np.ndarray) -> bytes:
    """The upper halves of 32-bit floats: eight bits of precision do for a sum of counts on its way."""
    return ((x.reshape(-1).view(np.uint32) + np.uint32(1 << 15)) >> np.uint32(16)).astype(np.uint16).tobytes()


def widened(x: bytes) -> np.ndarray:
    return (np.frombuffer(x, np.uint16).astype(np.uint32) << np.uint32(16)).view(np.float32)


def grouped(column, most: int = 2 << 20):
    """Lists of about ``most`` bytes of texts."""
    held, size = [], 0
    for t in column:
        held.append(t.as_py())
        size += len(held[-1])
        if size > most:
            yield held
            held, size = [], 0
    if held:
        yield held


def train(texts: DataFrame, model: Model, size: int) -> np.ndarray:
    """Weights after ``ROUNDS`` updates, each over its own part of ``texts`` (round, text). size: bytes of all texts."""
    spark = texts.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    weights, priors, top = model.weights, log_priors(model.mass), model.top
    # A table of few splits is dealt out; one of many is read where it lies.
    deal = DataFrame.repartition if texts.rdd.getNumPartitions() < tasks else DataFrame.coalesce
    span = len(weights) // PARTS
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast((weights, priors, top))

        def count(batches, shared=shared):
            now, priors, top = shared.value
            observed, expected, vocabulary, any_ = np.zeros_like(now), np.zeros_like(now), Vocabulary(top), False
            for batch in batches:
                for part in grouped(batch.column(0)):
                    codes, ends = coded(part, vocabulary)
                    add_counts(histories(codes, ends), codes >> 32, now, priors, observed, expected)
                    any_ = True
            if any_:
                cut = [(i, shortened(observed[a : a + span]), shortened(expected[a : a + span])) for i, a in enumerate(range(0, len(now), span))]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*cut), (pa.int32(), pa.binary(), pa.binary()))], ["part", "observed", "expected"])

        def add(table: pa.Table) -> pa.Table:
            sums = [np.zeros(span * FAN, np.float32), np.zeros(span * FAN, np.float32)]
            for name, total in zip(("observed", "expected"), sums):
                for x in table[name]:
                    total += widened(x.as_py())
            return pa.table([table["part"][:1], pa.array([sums[0].tobytes()], pa.binary()), pa.array([sums[1].tobytes()], pa.binary())], ["part", "observed", "expected"])

        schema = "part int, observed binary, expected binary"
        got = texts.where(F.col("round") == turn).select("text").transform(deal, tasks).mapInArrow(count, schema).groupBy("part").applyInArrow(add, schema).toArrow()
        shared.destroy()
        weights = weights.copy()
        for part, seen, meant in zip(got["part"].to_pylist(), got["observed"].to_pylist(), got["expected"].to_pylist()):
            seen, meant = (np.frombuffer(x, np.float32).reshape(span, FAN) for x in (seen, meant))
            weights[part * span : (part + 1) * span] += RATE * np.log((seen + RIDGE) / (meant + RIDGE))
        np.clip(weights, -STEEPEST, STEEPEST, out=weights)
    return weights


def held_out(key: str):
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))


WORDS_HELD = 2_000_000


def _block_words(batches):
    """(piece, word, n): the distinct words of each block with their number in training texts, in bounded memory.

    piece: the block << 32 | the number of the flush, so a word has one row of each piece."""
    seen: dict[int, Counter] = {}
    size = flushes = 0

    def out():
        for block in list(seen):
            counts = seen.pop(block)
            words, numbers = list(counts), list(counts.values())
            for a in range(0, len(words), 100_000):
                part = words[a : a + 100_000]
                yield pa.record_batch([pa.array(np.full(len(part), block << 32 | flushes, np.int64)), pa.array(part, pa.binary()), pa.array(numbers[a : a + 100_000], pa.int64())], ["piece", "word", "n"])

    for batch in batches:
        for block, held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            counts = seen.setdefault(block, Counter())
            before = len(counts)
            words = words_of(text.as_py())
            words.append(END)
            if held:
                for w in words:
                    counts.setdefault(w, 0)
            else:
                counts.update(words)
            size += len(counts) - before
            if size > WORDS_HELD:
                yield from out()
                size, flushes = 0, flushes + 1
    yield from out()


def slot_sums(known: DataFrame, top: list[bytes]) -> np.ndarray:
    """Eased counts of each slot over the (word, c) table of known words."""

    def run(batches):
        rank = {w: i for i, w in enumerate(top)}
        mass = np.zeros(SLOTS)
        for batch in batches:
            slots = slots_of(batch.column(0).to_numpy(zero_copy_only=False).tolist(), rank)
            mass += np.bincount(slots, batch.column(1).to_numpy() + 0.5, SLOTS)
        at = np.flatnonzero(mass)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(mass[at])], ["slot", "mass"])

    mass = np.zeros(SLOTS)
    for r in known.select("word", "c").mapInArrow(run, "slot int, mass double").groupBy("slot").agg(F.sum("mass").alias("mass")).collect():
        mass[r.slot] = r.mass
    mass[UNSEEN] = 0.5
    return mass


def dealt_texts(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """(doc_id, held_out, text, block, round of every document; bytes of all texts)."""
    keyed = docs.select(F.col(key).cast("long").alias("doc_id"), held_out(key).alias("held_out"), text_or_empty(text).cast("binary").alias("text"))
    size = keyed.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    dealt = F.xxhash64("doc_id", F.crc32("text"))
    return keyed.withColumns({"block": F.pmod(dealt, F.lit(blocks)).cast("int"), "round": F.pmod(F.shiftright(dealt, 40), F.lit(ROUNDS)).cast("int")}), size


def count_words(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(block, word, c; word, c): each block's distinct words with all training texts' counts, and those counts once for each word.

    The counts meet the blocks' words in one shuffle and one sort: a word has no more rows than there are blocks."""
    words = keyed.repartition("block").select("block", "held_out", "text").mapInArrow(_block_words, "piece long, word binary, n long")
    same = W.partitionBy("word")
    first, block = F.col("piece") == F.min("piece").over(same), F.shiftright("piece", 32).cast("int")
    words = materialize(words.select(block.alias("block"), "word", F.sum("n").over(same).alias("c"), first.alias("first")), "lm-words")
    return words.select("block", "word", "c"), words.where("first").select("word", "c")


def fit(keyed: DataFrame, counts: DataFrame, size: int) -> Model:
    known = counts.where("c > 0")
    total, kinds = known.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = [bytes(r.word) for r in known.orderBy(F.desc("c"), "word").limit(TOP).collect()]
    if total and END not in top:
        top[-1] = END
    bits = int(np.clip(round(np.log2(max(1, total / TOKENS_PER_ROW))), LEAST_BITS, MOST_BITS))
    model = Model(top, slot_sums(known, top), np.zeros((1 << bits, FAN), np.float32), total, kinds)
    model.weights = train(keyed.where(~F.col("held_out")).select("round", "text"), model, size) if total else model.weights
    return model


SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score_texts(texts: list[bytes], number: dict[bytes, int], counts: np.ndarray, codes: np.ndarray, model: Model, priors: np.ndarray) -> tuple[np.ndarray, ...]:
    """(tokens, known tokens, base score, score) of each text. number: place of a word in ``counts`` and ``codes``."""
    words, ends = cut_texts(texts)
    at = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    c, code = counts[at], codes[at]
    slot = np.where(c > 0, code >> 32, UNSEEN)
    base = np.log10((c + 0.5) / model.whole)
    score = (slot_logs(histories(code, ends), slot, model.weights, priors) + np.log((c + 0.5) / model.mass[slot])) / np.log(10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    return ends - starts + 1, np.add.reduceat((c > 0).astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(score, starts)


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    keyed, size = dealt_texts(docs, key, text)
    # A word that a flush of ``_block_words`` gave twice is told the same count both times.
    answers, counts = count_words(keyed)
    model = fit(keyed, counts, size)
    priors = log_priors(model.mass)
    shared = docs.sparkSession.sparkContext.broadcast((model, priors))

    def score(key, texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return SCORES.empty_table()
        model, priors = shared.value
        asked = answers["word"].to_numpy().tolist()
        number = dict(zip(asked, range(len(asked))))
        codes = Vocabulary(model.top).codes(asked)
        c = answers["c"].to_numpy()
        out = [score_texts(part, number, c, codes, model, priors) for part in grouped(texts["text"].combine_chunks())]
        return pa.table([texts["doc_id"], texts["held_out"], *[pa.array(np.concatenate([o[i] for o in out])) for i in range(4)]], schema=SCORES)

    scored = keyed.select("doc_id", "held_out", "text", "block").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def op8_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
