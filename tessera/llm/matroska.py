"""Media columns: write and parse Matroska files as packet tables.

``mux`` stores 8-bit samples losslessly as one A_PCM/INT/LIT track: clusters of SimpleBlocks, several
frames to a block by one of the container's lacings, and cues that point to the clusters. ``packets``
parses any EBML stream by its element ids: variable-length ids and sizes, unknown sizes of segments and
clusters, SimpleBlocks and BlockGroups, the lacings none, Xiph, fixed and EBML, cues. A packet has its
track, timestamp in nanoseconds, byte range in the file, cluster, block and lace position.

Defined results: a null text is an empty one; an empty text is stored as one frame of blanks; damaged
files give the packets before the damage and an error text; an empty table gives an empty table; rows
may repeat; further columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import text_or_empty

FRAME, BLOCK_FRAMES, CLUSTER_FRAMES, RATE = 192, 8, 1024, 48_000
#: Fixed values of the Matroska and EBML specifications (RFC 9559, RFC 8794).
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, FRAME_DURATION, FLAG_LACING = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383, 0x9C
AUDIO, SAMPLE_RATE, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements at these levels end a cluster or segment of unknown size.
TOP_LEVEL = {0x114D9B74, INFO, TRACKS, CLUSTER, CUES, 0x1941A469, 0x1043A770, 0x1254C367}
XIPH, FIXED, EBML_LACE = 1, 2, 3


# --- writing ------------------------------------------------------------------------------------


def vint(value: int, width: int = 0) -> bytes:
    """EBML size: the shortest form, or of the given width; all ones stay free for 'unknown'."""
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def signed_vint(value: int) -> bytes:
    width = next(w for w in range(1, 9) if abs(value) < (1 << 7 * w - 1) - 1)
    return vint(value + (1 << 7 * width - 1) - 1, width)


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes(-(-ident.bit_length() // 8), "big") + vint(len(body)) + body


def uint(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, -(-value.bit_length() // 8)), "big"))


def lace_sizes(sizes: list[int], lacing: int) -> bytes:
    """The sizes of all frames but the last."""
    if lacing == XIPH:
        return b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    if lacing == EBML_LACE:
        return vint(sizes[0]) + b"".join(signed_vint(b - a) for a, b in zip(sizes, sizes[1:-1]))
    return b""


def block(track: int, at: int, frames: list[bytes], lacing: int) -> bytes:
    if len(frames) == 1:
        lacing = 0
    head = vint(track) + struct.pack(">hB", at, 0x80 | lacing << 1)
    sizes = [len(f) for f in frames]
    return head + (bytes([len(frames) - 1]) + lace_sizes(sizes, lacing) if lacing else b"") + b"".join(frames)


def mux(payload: bytes, frame: int = FRAME, lacing: int = FIXED) -> bytes:
    """A complete Matroska file of the payload's bytes as unsigned 8-bit mono samples."""
    step = frame * 1_000_000_000 // RATE
    head = element(EBML, uint(EBML_VERSION, 1) + uint(EBML_READ_VERSION, 1) + uint(EBML_MAX_ID, 4) + uint(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + uint(DOC_VERSION, 4) + uint(DOC_READ_VERSION, 2))
    frames = -(-len(payload) // frame)
    info = element(INFO, uint(TIMESTAMP_SCALE, step) + element(DURATION, struct.pack(">d", frames)) + element(MUXING_APP, b"tessera") + element(WRITING_APP, b"tessera"))
    audio = element(AUDIO, element(SAMPLE_RATE, struct.pack(">d", RATE)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + uint(FRAME_DURATION, step) + audio))
    parts, at, cues = [info, tracks], len(info) + len(tracks), []
    for first in range(0, frames, CLUSTER_FRAMES):
        body = [uint(TIMESTAMP, first)]
        for i in range(first, min(frames, first + CLUSTER_FRAMES), BLOCK_FRAMES):
            held = payload[i * frame : min(i + BLOCK_FRAMES, first + CLUSTER_FRAMES) * frame]
            cut = [held[k : k + frame] for k in range(0, len(held), frame)]
            body.append(element(SIMPLE_BLOCK, block(1, i - first, cut, lacing)))
        parts.append(element(CLUSTER, b"".join(body)))
        cues.append(element(CUE_POINT, uint(CUE_TIME, first) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        at += len(parts[-1])
    return head + element(SEGMENT, b"".join(parts) + element(CUES, b"".join(cues)))


# --- reading ------------------------------------------------------------------------------------


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int | None, int]:
    """(value, position behind it); None for a size of all ones."""
    lead = data[at]
    if not lead:
        raise ValueError(f"no EBML length at byte {at}")
    width = 9 - lead.bit_length()
    if at + width > len(data):
        raise ValueError(f"cut off at byte {at}")
    value = int.from_bytes(data[at : at + width], "big")
    if keep_marker:
        return value, at + width
    value &= (1 << 7 * width) - 1
    return (None if value == (1 << 7 * width) - 1 else value), at + width


def children(data: bytes, at: int, end: int, level_end: set[int] = frozenset()) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of the elements in a range; an unknown size runs to the end or to an id of ``level_end``."""
    while at < end:
        ident, body = read_vint(data, at, keep_marker=True)
        if ident in level_end:
            return
        size, body = read_vint(data, body)
        stop = end if size is None else body + size
        if size is None and ident == CLUSTER:
            stop = body
            for _, _, stop in children(data, body, end, TOP_LEVEL):
                pass
        if stop > end:
            raise ValueError(f"element {ident:x} at byte {at} ends outside its parent")
        yield ident, body, stop
        at = stop


def laces(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """(start, size) of the frames of a block whose header ends at ``at``."""
    if not lacing:
        return [(at, end - at)]
    count, at = data[at] + 1, at + 1
    if lacing == FIXED:
        size, rest = divmod(end - at, count)
        if rest:
            raise ValueError("frames of a fixed lacing differ in size")
        return [(at + i * size, size) for i in range(count)]
    sizes: list[int] = []
    for i in range(count - 1):
        if lacing == XIPH:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:
            start = at
            value, at = read_vint(data, at)
            value = (1 << 7 * (at - start)) - 1 if value is None else value
            size = value if not i else sizes[-1] + value - ((1 << 7 * (at - start) - 1) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced frames end outside their block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def demux(data: bytes) -> dict:
    """packets: (track, time_ns, start, size, keyframe, cluster, block, lace); tracks, cues, scale, error."""
    out = {"packets": [], "tracks": {}, "cues": [], "scale": 1_000_000, "clusters": 0, "blocks": 0, "error": None}
    num = lambda a, b: int.from_bytes(data[a:b], "big")
    try:
        for ident, a, b in children(data, 0, len(data)):
            if ident == SEGMENT:
                _segment(data, a, b, out, num)
    except (ValueError, IndexError, struct.error) as e:
        out["error"] = str(e)
    return out


def _segment(data: bytes, a: int, b: int, out: dict, num) -> None:
    for ident, c, d in children(data, a, b):
        if ident == INFO:
            out["scale"] = next((num(x, y) for i, x, y in children(data, c, d) if i == TIMESTAMP_SCALE), out["scale"])
        elif ident == TRACKS:
            for i, x, y in children(data, c, d):
                if i == TRACK_ENTRY:
                    entry = {j: (p, q) for j, p, q in children(data, x, y)}
                    number = num(*entry[TRACK_NUMBER])
                    codec = entry.get(CODEC_ID)
                    out["tracks"][number] = {"type": num(*entry[TRACK_TYPE]) if TRACK_TYPE in entry else None, "codec": data[slice(*codec)].decode("ascii", "replace") if codec else None, "step": num(*entry[FRAME_DURATION]) if FRAME_DURATION in entry else 0}
        elif ident == CUES:
            for i, x, y in children(data, c, d):
                if i == CUE_POINT:
                    point = {j: (p, q) for j, p, q in children(data, x, y)}
                    where = {j: num(p, q) for j, p, q in children(data, *point[CUE_POSITIONS])}
                    out["cues"].append((num(*point[CUE_TIME]), where.get(CUE_TRACK), a + where[CUE_CLUSTER]))
        elif ident == CLUSTER:
            base = 0
            for i, x, y in children(data, c, d):
                if i == TIMESTAMP:
                    base = num(x, y)
                elif i == SIMPLE_BLOCK:
                    _block(data, x, y, base, out, True)
                elif i == BLOCK_GROUP:
                    for j, p, q in children(data, x, y):
                        if j == BLOCK:
                            _block(data, p, q, base, out, False)
            out["clusters"] += 1


def _block(data: bytes, a: int, b: int, base: int, out: dict, simple: bool) -> None:
    track, at = read_vint(data, a)
    relative, flags = struct.unpack_from(">hB", data, at)
    step = out["tracks"].get(track, {}).get("step", 0)
    time = (base + relative) * out["scale"]
    key = bool(flags & 0x80) if simple else None
    for lace, (start, size) in enumerate(laces(data, at + 3, b, flags >> 1 & 3)):
        out["packets"].append((track, time + lace * step, start, size, key, out["clusters"], out["blocks"], lace))
    out["blocks"] += 1


def features(file: dict, payload: bytes) -> str:
    """Counts of the container and statistics of the samples, as one line."""
    samples = np.frombuffer(payload, np.uint8)
    sums = int(samples.sum(dtype=np.int64)), int((samples.astype(np.int64) ** 2).sum())
    n = max(1, len(samples))
    last = max((p[1] for p in file["packets"]), default=0)
    crossings = int(np.count_nonzero(np.diff((samples >= 128).view(np.int8)))) if len(samples) else 0
    return (
        f"tracks={len(file['tracks'])};clusters={file['clusters']};blocks={file['blocks']};packets={len(file['packets'])};cues={len(file['cues'])};"
        f"last_ns={last};mean={sums[0] / n:.6f};rms={(sums[1] / n) ** 0.5:.6f};crossings={crossings}"
    )


# --- DataFrames ---------------------------------------------------------------------------------

#: Output batches hold about this many bytes.
BATCH_BYTES = 8 << 20


def _batches(rows: Iterator[tuple], schema: pa.Schema, weight: int) -> Iterator[pa.RecordBatch]:
    """rows as record batches of bounded bytes; weight: the column whose bytes count."""
    held: list[tuple] = []
    size = 0
    for r in rows:
        held.append(r)
        size += 64 + len(r[weight] or b"")
        if size >= BATCH_BYTES:
            yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)


MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def _mux_rows(batches):
    def rows():
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                raw = text.as_py()
                padded = raw + b" " * ((-len(raw)) % FRAME or (0 if raw else FRAME))
                yield doc, len(raw), mux(padded)

    return _batches(rows(), MEDIA, 2)


def media_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes (without padding), media: every text as a Matroska file."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).cast("binary").alias("text")).mapInArrow(_mux_rows, "doc_id long, n_bytes long, media binary")


PACKETS = pa.schema([("doc_id", pa.int64()), ("track", pa.int64()), ("time_ns", pa.int64()), ("start", pa.int64()), ("size", pa.int64()), ("keyframe", pa.bool_()), ("cluster", pa.int32()), ("block", pa.int32()), ("lace", pa.int32()), ("error", pa.string())])


def _packet_rows(batches):
    def rows():
        for b in batches:
            for doc, media in zip(b.column(0).to_pylist(), b.column(1)):
                file = demux(media.as_py() or b"")
                for p in file["packets"]:
                    yield doc, *p, None
                if file["error"]:
                    yield doc, *[None] * 8, file["error"]

    return _batches(rows(), PACKETS, 9)


def packet_table(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """One row per packet of every file; a damaged file has one more row with the error."""
    return media.select(F.col(key).cast("long").alias("doc_id"), F.col(column).alias("media")).mapInArrow(
        _packet_rows, "doc_id long, track long, time_ns long, start long, size long, keyframe boolean, cluster int, block int, lace int, error string"
    )


DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def _digest_rows(batches):
    def rows():
        for b in batches:
            for doc, n, media in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                data = media.as_py()
                file = demux(data)
                if file["error"]:
                    raise ValueError(f"doc {doc}: {file['error']}")
                payload = b"".join([data[p[2] : p[2] + p[3]] for p in file["packets"]])
                yield doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), features(file, payload)

    return _batches(rows(), DIGESTS, 7)


def op6_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = media_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return media.mapInArrow(_digest_rows, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
