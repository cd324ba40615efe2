"""Operator 10: media columns in the Matroska container.

write_media() stores bytes losslessly as 8-bit mono PCM in a Matroska stream: an EBML header and one segment with info, tracks, clusters
of laced simple blocks, and cues. read_packets() parses any such stream (variable-length ids and sizes, known and unknown sizes, clusters,
simple blocks and block groups, the four lacings, cues) into a packet table: track, time stamp, byte offset and size, key-frame flag.

Null texts are stored as empty ones (64 zero bytes). Equal bytes give equal streams; repeated rows are stored each; an empty table gives
an empty result; other columns are kept, and columns named as output columns are replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, table, texts_of

#: Element ids of the container format (fixed values).
EBML, SEGMENT, INFO, TRACKS, TRACK, CLUSTER, CUES, CUE = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0x1F43B675, 0x1C53BB6B, 0xBB
TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xE7, 0xA3, 0xA0, 0xA1, 0xB3, 0xB7, 0xF7, 0xF1
SCALE, DURATION, NUMBER, UID, TYPE, CODEC, AUDIO, RATE, CHANNELS, BITS = 0x2AD7B1, 0x4489, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3
#: Payloads are padded to a multiple of PAD bytes; a frame, a block and a cluster hold so many samples, frames and blocks.
PAD, FRAME, LACED, BLOCKS, SAMPLES_PER_SECOND = 64, 1024, 8, 16, 8000


def vint(n: int) -> bytes:
    """A size as an EBML variable-length integer."""
    width = 1
    while n >= (1 << (7 * width)) - 1:
        width += 1
    return ((1 << (7 * width)) | n).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


_HEAD = element(EBML, number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(0x4282, b"matroska") + number(0x4287, 4) + number(0x4285, 2))
_TRACKS = element(TRACKS, element(TRACK, number(NUMBER, 1) + number(UID, 1) + number(TYPE, 2) + element(CODEC, b"A_PCM/INT/LIT") + element(AUDIO, element(RATE, struct.pack(">d", SAMPLES_PER_SECOND)) + number(CHANNELS, 1) + number(BITS, 8))))


def _laced(frames: list[bytes]) -> tuple[int, bytes]:
    """The lacing kind and head of a block's frames: fixed for equal sizes, else EBML lacing."""
    if len(frames) == 1:
        return NO_LACING, b""
    sizes = [len(f) for f in frames]
    if len(set(sizes)) == 1:
        return FIXED, bytes([len(frames) - 1])
    head = bytes([len(frames) - 1]) + vint(sizes[0])
    for a, b in zip(sizes[:-2], sizes[1:-1], strict=True):
        d, width = b - a, 1
        while not -(1 << (7 * width - 1)) < d < (1 << (7 * width - 1)):
            width += 1
        head += ((1 << (7 * width)) | (d + (1 << (7 * width - 1)) - 1)).to_bytes(width, "big")
    return EBML_LACING, head


def write_media(payload: bytes) -> bytes:
    """A Matroska stream that holds payload as 8-bit samples."""
    ms = lambda at: at * 1000 // SAMPLES_PER_SECOND
    info = element(INFO, number(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / SAMPLES_PER_SECOND)))
    body, cues, position = [info, _TRACKS], [], len(info) + len(_TRACKS)
    for start in range(0, len(payload), span := FRAME * LACED * BLOCKS):
        parts = [number(TIME, ms(start))]
        for at in range(start, min(start + span, len(payload)), FRAME * LACED):
            frames = [payload[k : min(k + FRAME, len(payload))] for k in range(at, min(at + FRAME * LACED, len(payload)), FRAME)]
            lacing, head = _laced(frames)
            parts.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", ms(at) - ms(start), 0x80 | lacing << 1) + head + b"".join(frames)))
        cluster = element(CLUSTER, b"".join(parts))
        cues.append(element(CUE, number(CUE_TIME, ms(start)) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, position))))
        body.append(cluster)
        position += len(cluster)
    return _HEAD + element(SEGMENT, b"".join([*body, element(CUES, b"".join(cues))]))


@dataclass(frozen=True)
class Packet:
    """One frame; cluster is its cluster's offset, or that of a cue's."""

    track: int
    ms: int
    offset: int
    size: int
    key: bool
    cluster: int


@dataclass(frozen=True)
class Cue:
    ms: int
    track: int
    offset: int


def _vint(data: bytes, at: int, keep_marker: bool) -> tuple[int, int]:
    """An EBML integer and the offset behind it; -1 is the unknown size."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"bad EBML integer at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"EBML integer cut off at byte {at}")
    n = int.from_bytes(data[at : at + width], "big")
    if not keep_marker:
        n &= (1 << 7 * width) - 1
        if n == (1 << 7 * width) - 1:
            n = -1
    return n, at + width


def _elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """Id, offset, and range of the body of each element in a range."""
    while at < end:
        ident, body = _vint(data, at, True)
        size, body = _vint(data, body, False)
        stop = end if size < 0 else body + size
        if stop > end:
            raise ValueError(f"element at byte {at} is cut off")
        if size < 0 and ident == CLUSTER:  # an unknown size ends at the next element of the upper level
            stop = body
            while stop < end and int.from_bytes(data[stop : stop + 4], "big") not in (CLUSTER, CUES, INFO, TRACKS):
                _, inner = _vint(data, stop, True)
                n, inner = _vint(data, inner, False)
                stop = inner + n
        yield ident, at, body, stop
        at = stop


def _frames(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """Offset and size of the frames behind a block's head."""
    if lacing == NO_LACING:
        return [(at, end - at)]
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == XIPH:
        for _ in range(count - 1):
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            sizes.append(n + data[at])
            at += 1
    elif lacing == EBML_LACING and count > 1:
        n, at = _vint(data, at, False)
        sizes.append(n)
        for _ in range(count - 2):
            width = 9 - data[at].bit_length()
            d, at = _vint(data, at, False)
            d = (1 << 7 * width) - 1 if d < 0 else d
            sizes.append(sizes[-1] + d - ((1 << (7 * width - 1)) - 1))
    elif lacing == FIXED:
        if (end - at) % count:
            raise ValueError("fixed lacing of unequal frames")
        sizes = [(end - at) // count] * (count - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced sizes exceed their block")
    out = []
    for n in sizes:
        out.append((at, n))
        at += n
    return out


def read_packets(data: bytes) -> tuple[list[Packet], list[Cue]]:
    """The packet table and cues of a Matroska stream; ValueError if it's broken. Cue offsets are from the stream's start."""
    packets: list[Packet] = []
    cues: list[Cue] = []
    uint = lambda a, b: int.from_bytes(data[a:b], "big")
    scale = 1_000_000
    for top, _, a, b in _elements(data, 0, len(data)):
        if top != SEGMENT:
            continue
        for ident, at, c, d in _elements(data, a, b):
            if ident == INFO:
                scale = next((uint(x, y) for i, _, x, y in _elements(data, c, d) if i == SCALE), scale)
            elif ident == CLUSTER:
                base = 0
                for i, _, x, y in _elements(data, c, d):
                    blocks = [(x, y)] if i == SIMPLE_BLOCK else [(p, q) for k, _, p, q in _elements(data, x, y) if k == BLOCK] if i == BLOCK_GROUP else []
                    if i == TIME:
                        base = uint(x, y)
                    for p, q in blocks:
                        track, p = _vint(data, p, False)
                        relative, flags = struct.unpack_from(">hB", data, p)
                        time = (base + relative) * scale // 1_000_000
                        key = bool(flags & 0x80) or i == BLOCK_GROUP
                        packets += [Packet(track, time, o, n, key, at) for o, n in _frames(data, p + 3, q, flags >> 1 & 3)]
            elif ident == CUES:
                for i, _, x, y in _elements(data, c, d):
                    if i == CUE:
                        time, where = 0, []
                        for k, _, p, q in _elements(data, x, y):
                            if k == CUE_TIME:
                                time = uint(p, q) * scale // 1_000_000
                            elif k == CUE_POSITIONS:
                                where.append({m: uint(r, s) for m, _, r, s in _elements(data, p, q)})
                        cues += [Cue(time, w.get(CUE_TRACK, 0), a + w.get(CUE_CLUSTER, 0)) for w in where]
    return packets, cues


def features(data: bytes) -> tuple[bytes, str]:
    """The bytes that a stream's packets hold, and features of packets and samples in words."""
    packets, cues = read_packets(data)
    payload = b"".join([data[p.offset : p.offset + p.size] for p in packets])
    x = np.frombuffer(payload, dtype=np.uint8)
    clusters = {p.cluster for p in packets}
    total = int(x.sum(dtype=np.int64))
    turns = int(np.count_nonzero(np.diff((x >= 128).astype(np.int8))))
    cued = sum(c.offset in clusters for c in cues)
    return payload, f"packets={len(packets)};clusters={len(clusters)};cues={cued};last_ms={packets[-1].ms if packets else 0};sum={total};peak={int(x.max(initial=0))};crossings={turns}"


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % PAD or (0 if raw else PAD))


def media_column(docs: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """docs with a binary column that holds each text's bytes, padded, as a Matroska stream."""
    bounded_batches(docs.sparkSession)
    kept = docs.drop(out)
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([write_media(padded(t.encode())) for t in texts_of(batch, text)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, out])

    return kept.mapInArrow(run, schema)


_FEATURES = T.StructType([T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType())])


def media_features(media: DataFrame, column: str = "media") -> DataFrame:
    """media without its binary column, with what the stored bytes hold when read back; a null stream gives nulls."""
    bounded_batches(media.sparkSession)
    kept = [c for c in media.columns if c != column and c not in _FEATURES.fieldNames()]
    schema = T.StructType([*media.select(*kept).schema.fields, *_FEATURES.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for stored in batch.column(column):
                if (data := stored.as_py()) is None:
                    rows.append((None,) * 6)
                    continue
                payload, said = features(data)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(data), hashlib.sha256(data).hexdigest(), said))
            made = [pa.array([r[k] for r in rows], pa.int64() if k in (0, 2, 3) else pa.string()) for k in range(6)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], names=[*kept, *_FEATURES.fieldNames()])

    return media.mapInArrow(run, schema)


def packet_table(media: DataFrame, key: str, column: str = "media") -> DataFrame:
    """One row per packet of each stream: key, packet number, track, ms, byte range, key frame."""
    bounded_batches(media.sparkSession)
    slim = media.select(key, column)
    schema = T.StructType([slim.schema[key], *(T.StructField(n, T.LongType()) for n in ("packet", "track", "ms", "offset", "size")), T.StructField("key_frame", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, stored in zip(batch.column(0), batch.column(1), strict=True):
                found = read_packets(stored.as_py())[0] if stored.is_valid else []
                columns = [[k.as_py()] * len(found), range(len(found)), *([getattr(p, n) for p in found] for n in ("track", "ms", "offset", "size", "key"))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, pa.schema([("k", batch.schema.types[0]), *((n, pa.int64()) for n in "abcde"), ("f", pa.bool_())]), strict=True)], names=schema.fieldNames())

    return slim.mapInArrow(run, schema)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: what its text's bytes hold after a way through the stored stream."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text")
    return media_features(media_column(docs).drop("text")).select("doc_id", "n_bytes", *_FEATURES.fieldNames())
