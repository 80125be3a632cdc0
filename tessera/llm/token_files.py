"""Token-id files: fixed-width bit packing with block offsets.

File layout (little-endian): magic, blocks of packed ids, document ids and token counts, byte offsets of
the blocks, a footer (bits, counts, block size, positions of the tables) and its length. Every id takes the
minimum bits for the vocabulary, least significant bit first; every block but the last holds ``BLOCK`` ids and
starts at a byte, so a range of ids is read by unpacking the blocks that hold it, and nothing else. Documents
with a null id come first; the footer counts them.

Documents are range-partitioned and sorted by doc_id, then by the text's hashes (so a doc_id that repeats is no single
task), encoded and written by the executors into the cluster's shared folder, one file per shard. A repeated task attempt writes a file of its own name and only the
files that the finished job reports are read. The driver keeps the list of files, nothing per document.

Encoding uses the tokenizers library's model. Texts are cut at each space that a non-space follows, where the
byte-level pre-tokenizer always cuts too; a Python worker keeps the ids of up to ``CACHE_PIECES``
pieces. A text that holds a special token's string goes through the library as it is.

Defined results: a null text is an empty one (the end id alone); rows with a null doc_id are written before all others and
read back with a null doc_id; rows of one doc_id go by crc32 of the text; an empty table gives no files and an empty result; rows
may repeat; further columns of the input are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from tessera.llm.common import new_path, text_or_empty

MAGIC, BLOCK, END_ID = b"TSBP0001", 1 << 16, 0
CACHE_PIECES, CACHE_TOKENS = 1_200_000, 100_000
FOOTER = struct.Struct("<IIQQQQQQ")
#: Pieces over so many bytes are not kept.
LONG_PIECE = 256


# --- bit packing --------------------------------------------------------------------------------


def bits_for(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(spread, bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=bits * count, bitorder="little").reshape(count, bits)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :bits] = flat
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


class Writer:
    """Streams documents' ids into one file."""

    def __init__(self, stream, bits: int):
        self.stream, self.bits = stream, bits
        self.docs, self.counts, self.offsets, self.held, self.size, self.at, self.nulls = [], [], [], [], 0, len(MAGIC), 0
        stream.write(MAGIC)

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        """Documents without an id come before all others."""
        if doc is None and len(self.docs) > self.nulls:
            raise ValueError("a null id after others")
        self.nulls += doc is None
        self.docs.append(doc or 0)
        self.counts.append(len(ids))
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= BLOCK:
            flat = np.concatenate(self.held)
            whole = len(flat) // BLOCK * BLOCK
            for a in range(0, whole, BLOCK):
                self._block(flat[a : a + BLOCK])
            self.held, self.size = [flat[whole:]], len(flat) - whole

    def _block(self, ids: np.ndarray) -> None:
        self.offsets.append(self.at)
        self.at += self.stream.write(pack(ids, self.bits))

    def close(self) -> int:
        """Number of ids in the file."""
        if self.size:
            self._block(np.concatenate(self.held))
        tables = np.array(self.docs, "<i8").tobytes() + np.array(self.counts, "<i8").tobytes() + np.array(self.offsets, "<u8").tobytes()
        total = sum(self.counts)
        self.stream.write(tables + FOOTER.pack(self.bits, BLOCK, len(self.docs), total, len(self.offsets), self.at, len(tables), self.nulls) + MAGIC)
        return total


class Reader:
    """Documents in order, or any range of ids, of a file opened for random access."""

    def __init__(self, stream):
        self.stream = stream
        end = stream.size() - FOOTER.size - len(MAGIC)
        stream.seek(end)
        self.bits, self.block, docs, self.total, blocks, at, size, self.nulls = FOOTER.unpack(stream.read(FOOTER.size))
        if stream.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a token-id file")
        stream.seek(at)
        tables = stream.read(size)
        self.docs, self.counts = np.frombuffer(tables, "<i8", docs), np.frombuffer(tables, "<i8", docs, 8 * docs)
        self.offsets = np.frombuffer(tables, "<u8", blocks, 16 * docs)

    def ids(self, start: int, count: int) -> np.ndarray:
        """Any range of the file's ids."""
        parts, end = [], min(start + count, self.total)
        for b in range(start // self.block, -(-end // self.block) if count else 0):
            parts.append(self._read(b)[max(0, start - b * self.block) : end - b * self.block])
        return np.concatenate(parts) if parts else np.empty(0, np.uint32)

    def _read(self, b: int) -> np.ndarray:
        held = min(self.block, self.total - b * self.block)
        self.stream.seek(int(self.offsets[b]))
        return unpack(self.stream.read(-(-held * self.bits // 8)), self.bits, held)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, place of its first id in the file, ids); each block is read once."""
        at, b, held, left = 0, 0, [], 0
        for n, (doc, count) in enumerate(zip(self.docs.tolist(), self.counts.tolist())):
            while left < count:
                held.append(self._read(b))
                left += len(held[-1])
                b += 1
            flat = held[0] if len(held) == 1 else np.concatenate(held) if held else np.empty(0, np.uint32)
            yield doc if n >= self.nulls else None, at, flat[:count]
            held, left, at = [flat[count:]], left - count, at + count


# --- encoding -----------------------------------------------------------------------------------


class Pieces(dict):
    """Ids of pieces that follow a space, as little-endian 32-bit integers, made when asked for.

    Empty for a piece that goes with what is before: an empty one, or one that starts with white space.
    """

    def __init__(self, bpe: ByteBpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: bytes) -> bytes:
        if len(self) >= CACHE_PIECES:
            self.clear()
        follows = not piece or piece[:1].isspace() or piece[0] > 127 and piece.decode("utf-8", "replace")[0].isspace()
        ids = b"" if follows else self.bpe.fresh(b" " + piece)
        if len(piece) <= LONG_PIECE:
            self[piece] = ids
        return ids


class Tokens(dict):
    """Ids of pre-tokens, made when asked for."""

    def __init__(self, bpe: ByteBpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, token: str) -> bytes:
        if len(self) >= CACHE_TOKENS:
            self.clear()
        ids = self.bpe.token_ids(token)
        if len(token) <= LONG_PIECE:
            self[token] = ids
        return ids


class ByteBpe:
    """The tokenizers library's byte-level BPE, with pieces' ids kept."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        from tessera.llm.bpe import byte_alphabet

        self.whole = Tokenizer.from_file(path)
        self.tokenize = self.whole.model.tokenize
        self.special = [t.content.encode("utf-8") for t in self.whole.get_added_tokens_decoder().values()]
        self.vocabulary = self.whole.get_vocab_size()
        self.letters = str.maketrans({i: c for i, c in enumerate(byte_alphabet())})
        self.pretokens = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        self.pieces, self.inner = Pieces(self), Tokens(self)

    def token_ids(self, token: str) -> bytes:
        if token.isascii() and token.isprintable():
            shown = token.replace(" ", self.letters[32])
        else:
            shown = token.encode("utf-8").decode("latin-1").translate(self.letters)
        return struct.pack(f"<{len(found)}I", *[t.id for t in found]) if (found := self.tokenize(shown)) else b""

    def fresh(self, piece: bytes) -> bytes:
        """Ids of a piece, as little-endian 32-bit integers."""
        if piece[:1] == b" " and piece[1:].isalpha():
            return self.token_ids(piece.decode("ascii"))
        tokens = self.pretokens(piece.decode("utf-8", "replace"))
        if len(tokens) == 1:
            return self.token_ids(tokens[0])
        # The word of "word," is looked up as the piece "word".
        return b"".join([self.pieces[t[1:].encode("utf-8")] if t[0] == " " and t[1:].isalpha() else self.inner[t] for t in tokens])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of whole texts, as little-endian 32-bit integers."""
        look, out = self.pieces.__getitem__, []
        for text in texts:
            if any(s in text for s in self.special):
                out.append(np.array(self.whole.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes())
                continue
            parts = text.split(b" ")
            got = list(map(look, parts[1:]))
            if all(got):
                out.append(self.fresh(parts[0]) + b"".join(got))
                continue
            joined: list[list[bytes]] = [[parts[0], b""]]
            for p, ids in zip(parts[1:], got):
                if not ids:
                    joined[-1] = [joined[-1][0] + b" " + p, b""]
                else:
                    joined.append([b" " + p, ids])
            out.append(b"".join([ids or self.fresh(p) for p, ids in joined]))
        return out


_loaded: dict[str, ByteBpe] = {}


def load(path: str) -> ByteBpe:
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# --- DataFrames ---------------------------------------------------------------------------------

GROUP_BYTES = 2 << 20


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder that Spark names: object stores go by pyarrow's scheme for them."""
    scheme, sep, rest = uri.partition("://")
    return pafs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + sep + rest)


def _grouped(batches, most: int = GROUP_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    keys, texts, size = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py()
            if size >= most:
                yield keys, texts
                keys, texts, size = [], [], 0
            keys.append(key)
            texts.append(text)
            size += len(text)
    if keys:
        yield keys, texts


def _write_shards(tokenizer: str, folder: str):
    def run(batches):
        import uuid

        from pyspark import TaskContext

        shard, writer, stream, name = TaskContext.get().partitionId(), None, None, None
        bpe, end = load(tokenizer), np.array([END_ID], "<u4")
        for keys, texts in _grouped(batches):
            if writer is None:
                fs, root = _filesystem(folder)
                fs.create_dir(root, recursive=True)
                name = f"shard-{shard:06d}-{uuid.uuid4().hex}.tsbp"
                stream = fs.open_output_stream(f"{root}/{name}")
                writer = Writer(stream, bits_for(bpe.vocabulary))
            for key, ids in zip(keys, bpe.encode(texts)):
                writer.add(key, np.concatenate([np.frombuffer(ids, "<u4"), end]))
        if writer is not None:
            total = writer.close()
            stream.close()
            yield pa.record_batch([pa.array([x], t) for x, t in zip((shard, f"{folder}/{name}", len(writer.docs), total), (pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["shard", "path", "docs", "tokens"])

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, shards: int | None = None, key: str = "doc_id", text: str = "text") -> list[tuple[int, str, int, int, int]]:
    """Encodes and writes all texts in ascending key order. Returns (shard, path, docs, tokens, ids before it) per file."""
    shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).cast("binary").alias("text"))
    keyed = keyed.withColumns({"crc": F.crc32("text"), "hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = [F.asc_nulls_first("doc_id"), "crc", "hash", "row"]
    ordered = keyed.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text")
    rows = sorted(tuple(r) for r in ordered.mapInArrow(_write_shards(tokenizer or default_path(), folder), "shard int, path string, docs long, tokens long").collect())
    out, before = [], 0
    for r in rows:
        out.append((*r, before))
        before += r[3]
    return out


def _read_files(batches):
    for batch in batches:
        for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            fs, place = _filesystem(path)
            with fs.open_input_file(place) as stream:
                held = []
                for doc, at, ids in Reader(stream).documents():
                    held.append((doc, before + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(held) == 10_000:
                        yield _digests(held)
                        held = []
                if held:
                    yield _digests(held)


def _digests(rows) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(spark: SparkSession, files: list[tuple]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files, a task for each file."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame([(f[0], f[1], f[4]) for f in files], "id int, path string, before long")
    dense = F.row_number().over(W.partitionBy(F.lit(0)).orderBy("id")) - 1
    return listed.withColumn("id", dense.cast("int")).repartitionById(len(files), F.col("id")).select("path", "before").mapInArrow(_read_files, schema)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_token_files(spark, write_token_files(docs, new_path(spark, "token-files")))
