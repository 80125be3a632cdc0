"""Lossless byte codecs: bit packing, run lengths, canonical Huffman, range ANS, zstandard, and the smallest of them.

Each codec is a pair of functions bytes -> bytes; ``codec_udf`` lifts one to a vectorised column function that gives null
for a row it can't code. ``runs`` and ``pack_bits_sql`` are the forms that need no Python.
"""

from __future__ import annotations

import heapq
import os
import struct
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

RLE_MAX, ZSTD_LEVEL, RANS_LOW = 255, 3, 1 << 23


# --- bit packing --------------------------------------------------------------------------------


def check_bits(bits: int) -> None:
    if not 1 <= bits <= 8:
        raise ValueError("bits must be 1 to 8")


def pack_bits(values: np.ndarray, bits: int, mask: bool = False) -> bytes:
    """Least significant bit first, zero padded. A value over the width is an error, or masked."""
    check_bits(bits)
    v = np.asarray(values, np.int64)
    if mask:
        v = v & ((1 << bits) - 1)
    elif len(v) and (v.max() >> bits or v.min() < 0):
        raise ValueError("overflow")
    spread = np.unpackbits(v.astype(np.uint8)[:, None], axis=1, bitorder="little")[:, :bits]
    return np.packbits(spread, bitorder="little").tobytes()


def unpack_bits(data: bytes, bits: int, count: int) -> np.ndarray:
    check_bits(bits)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=bits * count, bitorder="little").reshape(count, bits)
    return np.packbits(flat, axis=1, bitorder="little").ravel()


def pack_bits_sql(values: Column, bits: int) -> Column:
    """BINARY of an array of numbers, for widths that divide a byte; null where a value is over the width."""
    if bits not in (1, 2, 4, 8):
        raise ValueError("widths of 1, 2, 4 and 8 only")
    per = 8 // bits
    count = F.ceil(F.size(values) / F.lit(per)).cast("int")
    place = lambda i, k: F.shiftleft(F.coalesce(F.get(values, i * per + k), F.lit(0)).cast("int"), bits * k)
    byte = lambda i: sum((place(i, k) for k in range(1, per)), place(i, 0))
    packed = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.lpad(F.hex(byte(i).cast("long")), 2, "0"))
    fits = ~F.exists(values, lambda v: (v < 0) | (v > (1 << bits) - 1))
    return F.when(F.size(values) == 0, F.unhex(F.lit(""))).when(fits, F.unhex(F.array_join(packed, "")))


# --- run lengths --------------------------------------------------------------------------------


def rle_encode(data: bytes) -> bytes:
    """Pairs of count and value, runs of at most 255."""
    v = np.frombuffer(data, np.uint8)
    if not len(v):
        return b""
    starts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    lengths = np.diff(np.append(starts, len(v)))
    pieces = -(-lengths // RLE_MAX)
    counts = np.full(pieces.sum(), RLE_MAX)
    counts[np.cumsum(pieces) - 1] = lengths - (pieces - 1) * RLE_MAX
    return np.stack([counts, np.repeat(v[starts], pieces)], axis=1).astype(np.uint8).tobytes()


def rle_decode(data: bytes) -> bytes:
    if len(data) % 2:
        raise ValueError("odd length")
    pairs = np.frombuffer(data, np.uint8).reshape(-1, 2)
    return np.repeat(pairs[:, 1], pairs[:, 0]).tobytes()


def runs(rows: DataFrame, order: str, value: str, by: list[str] | None = None, most: int = RLE_MAX) -> DataFrame:
    """Run-length table (by..., run_start, value, length) of a column in order; runs of at most ``most``."""
    by = by or []
    inside = W.partitionBy(*by, value).orderBy(order)
    island = F.row_number().over(W.partitionBy(*by).orderBy(order)) - F.row_number().over(inside)
    marked = rows.select(*by, F.col(order).alias("__at"), F.col(value).alias("value"), island.alias("__island"))
    place = F.row_number().over(W.partitionBy(*by, "value", "__island").orderBy("__at")) - 1
    cut = marked.withColumn("__cut", F.floor(place / most))
    return cut.groupBy(*by, "value", "__island", "__cut").agg(F.min("__at").alias("run_start"), F.count(F.lit(1)).alias("length")).drop("__island", "__cut")


# --- Huffman ------------------------------------------------------------------------------------


def huffman_lengths(counts: np.ndarray) -> np.ndarray:
    """Code length of each byte; one symbol alone gets one bit."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(256, np.uint8)
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    heap = [(int(counts[s]), int(s), (int(s),)) for s in used]
    heapq.heapify(heap)
    while len(heap) > 1:
        (a, s, left), (b, t, right) = heapq.heappop(heap), heapq.heappop(heap)
        for x in left + right:
            lengths[x] += 1
        heapq.heappush(heap, (a + b, min(s, t), left + right))
    return lengths


def canonical(lengths: np.ndarray) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length), by length then symbol."""
    code, last, out = 0, 0, {}
    for n, s in sorted((int(n), s) for s, n in enumerate(lengths.tolist()) if n):
        code <<= n - last
        out[s], code, last = (code, n), code + 1, n
    return out


def huffman_encode(data: bytes) -> bytes:
    """Length of the data, 256 code lengths, then the codes, most significant bit first."""
    v = np.frombuffer(data, np.uint8)
    lengths = huffman_lengths(np.bincount(v, minlength=256)) if len(v) else np.zeros(256, np.uint8)
    codes = canonical(lengths)
    wide = int(lengths.max()) if len(v) else 0
    table = np.zeros((256, max(1, wide)), np.uint8)
    for s, (code, n) in codes.items():
        table[s, :n] = [code >> (n - 1 - k) & 1 for k in range(n)]
    held = np.arange(max(1, wide)) < lengths[:, None]
    bits = table[v][held[v]] if len(v) else np.empty(0, np.uint8)
    return struct.pack("<Q", len(v)) + lengths.tobytes() + np.packbits(bits).tobytes()


def huffman_decode(data: bytes) -> bytes:
    (count,) = struct.unpack_from("<Q", data)
    symbols = {(n, code): s for s, (code, n) in canonical(np.frombuffer(data, np.uint8, 256, 8)).items()}
    out, code, n = bytearray(), 0, 0
    for bit in np.unpackbits(np.frombuffer(data, np.uint8, offset=264)).tolist():
        if len(out) == count:
            break
        code, n = code << 1 | bit, n + 1
        if (n, code) in symbols:
            out.append(symbols[n, code])
            code = n = 0
    if len(out) != count:
        raise ValueError("cut off")
    return bytes(out)


# --- range ANS ----------------------------------------------------------------------------------


def rans_frequencies(data: bytes, precision: int) -> np.ndarray:
    """Byte frequencies that sum to 2^precision, none of a used byte 0."""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(np.int64)
    total, whole = counts.sum(), 1 << precision
    if not total:
        return np.full(256, whole // 256)
    scaled = np.where(counts > 0, np.maximum(1, counts * whole // total), 0)
    while (off := whole - scaled.sum()) != 0:
        at = int(np.argmax(scaled))
        scaled[at] += off if off > 0 else max(off, 1 - scaled[at])
    return scaled


def check_precision(precision: int) -> None:
    if precision not in (12, 14):
        raise ValueError("precision must be 12 or 14")


def rans_encode(data: bytes, precision: int = 12) -> bytes:
    """Length, frequencies, final state, then the bytes that the state gave up, last one first."""
    check_precision(precision)
    freq = rans_frequencies(data, precision)
    start = np.cumsum(freq) - freq
    f, c, out, state = freq.tolist(), start.tolist(), bytearray(), RANS_LOW
    for s in reversed(data):
        most = (RANS_LOW >> precision << 8) * f[s]
        while state >= most:
            out.append(state & 255)
            state >>= 8
        state = (state // f[s] << precision) + state % f[s] + c[s]
    return struct.pack("<Q", len(data)) + freq.astype("<u2").tobytes() + struct.pack("<I", state) + bytes(reversed(out))


def rans_decode(data: bytes, precision: int = 12) -> bytes:
    check_precision(precision)
    (count,) = struct.unpack_from("<Q", data)
    freq = np.frombuffer(data, "<u2", 256, 8).astype(np.int64)
    if freq.sum() != 1 << precision:
        raise ValueError("frequencies don't sum to the precision")
    start = np.cumsum(freq) - freq
    symbol = np.repeat(np.arange(256), freq).tolist()
    f, c, mask = freq.tolist(), start.tolist(), (1 << precision) - 1
    (state,) = struct.unpack_from("<I", data, 520)
    at, out = 524, bytearray()
    for _ in range(count):
        low = state & mask
        s = symbol[low]
        out.append(s)
        state = f[s] * (state >> precision) + low - c[s]
        while state < RANS_LOW:
            state, at = state << 8 | data[at], at + 1
    return bytes(out)


# --- zstandard and the choice ---------------------------------------------------------------------


def zstd_encode(data: bytes, level: int = ZSTD_LEVEL) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(data)


def zstd_decode(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def zstd_chunks(data: bytes, chunk: int, level: int = ZSTD_LEVEL) -> list[bytes]:
    """Independent frames."""
    return [zstd_encode(data[a : a + chunk], level) for a in range(0, len(data), chunk)]


def zstd_unchunk(chunks: list[bytes]) -> bytes:
    return b"".join(map(zstd_decode, chunks))


def read_bits_msb(data: bytes, widths: list[int]) -> list[int]:
    """Numbers of up to 32 bits, most significant bit first."""
    whole, left = int.from_bytes(data, "big"), 8 * len(data)
    out = []
    for n in widths:
        left -= n
        if left < 0 or n > 32:
            raise ValueError("not enough bits, or more than 32 at once")
        out.append(whole >> left & (1 << n) - 1)
    return out


#: In order of preference on ties.
CODECS: dict[str, tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]] = {
    "ans12": (lambda d: rans_encode(d, 12), lambda d: rans_decode(d, 12)),
    "ans14": (lambda d: rans_encode(d, 14), lambda d: rans_decode(d, 14)),
    "huffman": (huffman_encode, huffman_decode),
    "rle": (rle_encode, rle_decode),
    "zstd": (zstd_encode, zstd_decode),
    "bits4": (lambda d: struct.pack("<Q", len(d)) + pack_bits(np.frombuffer(d, np.uint8), 4), lambda d: unpack_bits(d[8:], 4, struct.unpack_from("<Q", d)[0]).tobytes()),
    "bits5": (lambda d: struct.pack("<Q", len(d)) + pack_bits(np.frombuffer(d, np.uint8), 5), lambda d: unpack_bits(d[8:], 5, struct.unpack_from("<Q", d)[0]).tobytes()),
    "bits6": (lambda d: struct.pack("<Q", len(d)) + pack_bits(np.frombuffer(d, np.uint8), 6), lambda d: unpack_bits(d[8:], 6, struct.unpack_from("<Q", d)[0]).tobytes()),
}


def smallest(data: bytes, codecs: tuple[str, ...] = tuple(CODECS)) -> tuple[str, bytes]:
    """The codec with the smallest output; one that can't code the data is left out, ties go to the earlier."""
    best: tuple[str, bytes] | None = None
    for name in codecs:
        try:
            out = CODECS[name][0](data)
        except ValueError:
            continue
        if best is None or len(out) < len(best[1]):
            best = name, out
    if best is None:
        raise ValueError("no codec")
    return best


def _tried(f: Callable[[bytes], object]):
    def one(x):
        try:
            return None if x is None else f(bytes(x))
        except Exception:  # noqa: BLE001  whatever a codec or library raises, the row's result is null
            return None

    return one


def codec_udf(name: str, decode: bool = False):
    """BINARY -> BINARY; null for null and for rows that can't be coded."""

    @F.pandas_udf("binary")
    def run(data: pd.Series) -> pd.Series:
        return data.map(_tried(CODECS[name][decode]))

    return run


def smallest_udf(codecs: tuple[str, ...] = tuple(CODECS)):
    """BINARY -> STRUCT<codec, bytes>."""

    @F.pandas_udf("codec string, bytes binary")
    def run(data: pd.Series) -> pd.DataFrame:
        got = [_tried(lambda d: smallest(d, codecs))(d) or (None, None) for d in data]
        return pd.DataFrame(got, columns=["codec", "bytes"])

    return run


def expand_udf():
    """(STRING codec, BINARY) -> BINARY: inverse of ``smallest_udf``."""

    @F.pandas_udf("binary")
    def run(codec: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([_tried(CODECS[c][1])(d) if c else None for c, d in zip(codec, data)], dtype=object)

    return run


def byte_histogram(rows: DataFrame, column: str) -> DataFrame:
    """byte, freq, cum (sum of the frequencies below) over all rows of a string column."""
    hexed = F.hex(F.col(column).cast("binary"))
    bytes_ = rows.select(F.explode(F.regexp_extract_all(hexed, F.lit("(..)"), F.lit(1))).alias("h"))
    freq = bytes_.groupBy("h").agg(F.count(F.lit(1)).alias("freq")).select(F.conv("h", 16, 10).cast("int").alias("byte"), "freq")
    return freq.withColumn("cum", F.coalesce(F.sum("freq").over(W.orderBy("byte").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))


@dataclass
class CodecConfig:
    """Codec choice; ``from_env`` reads COMP_CODEC, COMP_BITS and COMP_LEVEL, bad numbers fall back, a bad codec is an error."""

    codec: str = "zstd"
    bits: int = 8
    level: int = ZSTD_LEVEL

    def validate(self) -> CodecConfig:
        check_bits(self.bits)
        if not 1 <= self.level <= 22:
            raise ValueError("level must be 1 to 22")
        if self.codec not in CODECS:
            raise ValueError(f"unknown codec {self.codec}")
        return self

    @classmethod
    def from_env(cls, env=os.environ) -> CodecConfig:
        def number(name: str, default: int) -> int:
            try:
                return int(env.get(name, default))
            except ValueError:
                return default

        return cls(env.get("COMP_CODEC", "zstd"), number("COMP_BITS", 8), number("COMP_LEVEL", ZSTD_LEVEL)).validate()
