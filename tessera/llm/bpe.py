"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

A word's symbols are the leaves of a segment tree; leaf i holds ``rank * width + i`` of the pair that
starts at symbol i. The root is the leftmost pair of the lowest rank. A merge rewrites three leaves and
their paths to the root, so a word of n symbols costs O(n log n), however long it is. Trees of many words
are one numpy array, and every step does the next merge of all words that still have one.

Texts are cut at spaces and the code points 9 to 13, which no pre-token of this vocabulary crosses; the
pieces' results are kept per Python worker (``CACHE_PIECES`` of ``CACHE_BYTES`` at most), so each distinct piece is
normalised, split and merged about once. Normalisation is NFC, then per-character lower case; the classes of characters
and their lower case depend on the Unicode version, so pieces with a code point from U+0530 on are normalised and split
by the tokenizers library itself (below it all code points agree, as a test shows).

Defined results: a null text is an empty one (no ids, an empty decoded text); an empty table gives an
empty table; rows may repeat; further columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import text_or_empty

CACHE_PIECES, CACHE_BYTES = 400_000, 16 << 20
#: Cells of one array of trees.
TREE_CELLS = 1 << 21
NONE = np.iinfo(np.int64).max


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class PairMerger:
    """Merges symbol sequences by pair rank, many at once."""

    def __init__(self, left: np.ndarray, right: np.ndarray, made: np.ndarray, symbols: int):
        """Merge r joins ``left[r]`` and ``right[r]`` into ``made[r]``."""
        self.base = np.int64(symbols + 1)
        keys = left.astype(np.int64) * self.base + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made.astype(np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where no merge joins it; symbols below 0 join nothing."""
        key = left.astype(np.int64) * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(known, self.ranks[at], NONE)

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """symbols: all words' one after the other. The same after all merges."""
        starts = np.cumsum(lengths) - lengths
        widths = 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64)
        left = lengths.astype(np.int64).copy()
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for width in np.unique(widths).tolist():
            members = np.flatnonzero(widths == width)
            step = max(1, TREE_CELLS // width)
            for a in range(0, len(members), step):
                part = members[a : a + step]
                filled = np.arange(width) < lengths[part, None]
                grid = np.full((len(part), width + 1), -1, np.int32)
                grid[:, :width][filled] = symbols[(starts[part, None] + np.arange(width))[filled]]
                if width > 1:
                    self._merge_equal(grid, width)
                held = grid >= 0
                left[part] = held.sum(axis=1)
                parts.append((part, grid[held]))
        ends = np.cumsum(left)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        for part, merged in parts:
            count = left[part]
            inside = np.arange(len(merged)) - np.repeat(np.cumsum(count) - count, count)
            out[np.repeat(ends[part] - count, count) + inside] = merged
        return out, left

    def _merge_equal(self, symbol: np.ndarray, width: int) -> None:
        """Merges the rows of ``symbol`` (width + 1 columns, -1 behind a word's end) in place."""
        n = len(symbol)
        after = np.broadcast_to(np.arange(1, width + 2, dtype=np.int32), (n, width + 1)).copy()
        before = np.broadcast_to(np.arange(-1, width, dtype=np.int32), (n, width + 1)).copy()
        place = np.arange(width, dtype=np.int64)
        tree = np.full((n, 2 * width), NONE, np.int64)
        ranks = self.rank(symbol[:, :width], symbol[:, 1:])
        tree[:, width:] = np.where(ranks == NONE, NONE, ranks * width + place)
        for low in (1 << k for k in range(width.bit_length() - 2, -1, -1)):
            tree[:, low : 2 * low] = np.minimum(tree[:, 2 * low : 4 * low : 2], tree[:, 2 * low + 1 : 4 * low : 2])
        live = np.flatnonzero(tree[:, 1] != NONE)
        while len(live):
            rank, at = np.divmod(tree[live, 1], width)
            gone = after[live, at]
            beyond = after[live, gone]
            symbol[live, at] = self.made[rank]
            symbol[live, gone] = -1
            after[live, at] = beyond
            before[live, np.minimum(beyond, width)] = at
            prior = before[live, at]
            right = np.where(beyond < width, symbol[live, np.minimum(beyond, width)], -1)
            left = np.where(prior >= 0, symbol[live, np.maximum(prior, 0)], -1)
            mid = symbol[live, at]
            self._put(tree, live, gone, np.full(len(live), NONE), width)
            forward = self.rank(mid, right)
            self._put(tree, live, at, np.where(forward == NONE, NONE, forward * width + at), width)
            has = prior >= 0
            if has.any():
                rows, prior = live[has], prior[has]
                backward = self.rank(left[has], mid[has])
                self._put(tree, rows, prior, np.where(backward == NONE, NONE, backward * width + prior), width)
            live = live[tree[live, 1] != NONE]

    @staticmethod
    def _put(tree: np.ndarray, rows: np.ndarray, leaf: np.ndarray, value: np.ndarray, width: int) -> None:
        node = leaf.astype(np.int64) + width
        tree[rows, node] = value
        while width > 1:
            node >>= 1
            width >>= 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])


class WordBpe:
    """Encoder and decoder of a word-end BPE vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # The library's normaliser and pre-tokenizer, without a second copy of the vocabulary.
        library = Tokenizer.from_str(json.dumps(spec | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": []}))
        self.normalize, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in chain(vocab.items(), self.special.items())}
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        ids = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.merger = PairMerger(ids[:, 0], ids[:, 1], ids[:, 2], max(self.tokens) + 1)
        alphabet = byte_alphabet()
        self.inner = np.array([vocab[c] for c in alphabet], np.int32)
        self.final = np.array([vocab[c + suffix] for c in alphabet], np.int32)
        self.words_of = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        special = regex.compile("(" + ("|".join(map(regex.escape, self.special)) or r"(?!)") + ")")
        self.split_special, self.has_special = special.split, special.search
        self.byte_of = {c: b for b, c in enumerate(alphabet)}
        self.rare = regex.compile("[\u0530-\U0010ffff]").search
        self.pieces: dict[bytes, tuple[bytes, bytes]] = {}
        self.held = 0

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text without special tokens."""
        if self.rare(text):
            shown = [token for token, _ in self.split(self.normalize(text))]
            return [bytes([self.byte_of[c] for c in token]).decode("utf-8") for token in shown]
        text = unicodedata.normalize("NFC", text)
        # Lower case goes character by character: no word-final sigma.
        text = text.replace("Σ", "σ").lower() if "Σ" in text else text.lower()
        return self.words_of(text)

    def encode_words(self, words: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian 32-bit integers, decoded text) of each word."""
        raw = [w.encode("utf-8") for w in words]
        lengths = np.array([len(r) for r in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[flat]
        last = np.cumsum(lengths) - 1
        symbols[last] = self.final[flat[last]]
        ids, counts = self.merger.merge(symbols, lengths)
        packed, names = ids.astype("<u4").tobytes(), [self.tokens[i] for i in ids.tolist()]
        out, at = [], 0
        for n in counts.tolist():
            out.append((packed[4 * at : 4 * (at + n)], " ".join(names[at : at + n]).encode("utf-8")))
            at += n
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian 32-bit integers, decoded text) of texts, whole words each."""
        plan: list[list[str]] = []
        words: dict[str, int] = {}
        for piece in pieces:
            text = piece.decode("utf-8", "replace")
            if not self.has_special(text):
                items = self.words(text)
            else:
                items = []
                for k, part in enumerate(self.split_special(text)):
                    items += [part] if k % 2 else self.words(part)
            for w in items:
                words.setdefault(w, len(words))
            plan.append(items)
        plain = [w for w in words if w not in self.special]
        known = dict(zip(plain, self.encode_words(plain)))
        known |= {w: (i.to_bytes(4, "little"), w.encode("utf-8")) for w, i in self.special.items()}
        out = []
        for items in plan:
            if len(items) == 1:
                out.append(known[items[0]])
            else:
                got = [known[w] for w in items]
                out.append((b"".join([g[0] for g in got]), b" ".join([g[1] for g in got])))
        return out

    def decode(self, ids) -> str:
        """Tokens joined by a space, as a vocabulary without a decoder does it."""
        return " ".join([self.tokens[int(i)] for i in ids if int(i) in self.tokens])

    def learn(self, pieces: set[bytes]) -> None:
        """Puts the ids and the decoded text of all pieces into the cache."""
        fresh = [p for p in pieces if p not in self.pieces]
        size = sum(map(len, fresh))
        if len(self.pieces) + len(fresh) > CACHE_PIECES or self.held + size > CACHE_BYTES:
            self.pieces.clear()
            fresh = list(pieces)
            self.held, size = 0, sum(map(len, fresh))
        self.held += size
        self.pieces.update(zip(fresh, self.encode_pieces(fresh)))


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """One encoder per worker and file."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


#: Texts are taken up in groups of about this many bytes.
GROUP_BYTES = 2 << 20


def coded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[object, bytes, bytes]]:
    """(key, ids as little-endian 32-bit integers, decoded text) of each (key, text) row."""
    bpe = load(path)

    def flush(held):
        cut = [text.split() for _, text in held]
        bpe.learn(set(chain.from_iterable(cut)))
        known = bpe.pieces
        for (key, _), pieces in zip(held, cut):
            found = [known[p] for p in pieces]
            yield key, b"".join([f[0] for f in found]), b" ".join([f[1] for f in found if f[0]])

    held, size = [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py()
            held.append((key, text))
            size += len(text)
            if size >= GROUP_BYTES:
                yield from flush(held)
                held, size = [], 0
    yield from flush(held)


def _records(rows, names: list[str], types: list[pa.DataType], bytes_most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(x) if isinstance(x, (bytes, str)) else 8 for x in r)
        if size >= bytes_most:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array of int), decoded."""
    path = path or default_path()

    def run(batches):
        rows = ((k, np.frombuffer(ids, "<u4").astype(np.int32).tolist(), out.decode("utf-8")) for k, ids, out in coded(batches, path))
        return _records(rows, ["doc_id", "ids", "decoded"], [pa.int64(), pa.list_(pa.int32()), pa.string()])

    return _keyed(docs, key, text).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).cast("binary").alias("text"))


def bpe_digests(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path = path or default_path()

    def run(batches):
        rows = ((k, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(out).hexdigest()) for k, ids, out in coded(batches, path))
        return _records(rows, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.int64(), pa.string(), pa.string()])

    return _keyed(docs, key, text).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
