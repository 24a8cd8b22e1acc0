"""Media columns: Matroska files written and parsed in memory, as packet tables.

The parser reads variable-length EBML elements (also of unknown size), tracks, clusters,
simple blocks and block groups with no, Xiph, fixed-size or EBML lacing, and cues.  Every
frame becomes a packet with its track, timestamp, and byte range in the file.

A text is stored as 8-bit PCM frames of 576 samples: its UTF-8 bytes, padded with 255 up
to a positive multiple of 576.  The file holds nothing but the payload and constants, so
equal texts give equal files.

Defined cases: null text counts as empty (one frame of padding); null media gives no
packets; damaged media gives the packets before the damage and an error text, and so do
numbers beyond the columns that hold them; equal rows
give equal results; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME, RATE = 576, 8000
FRAME_NS = FRAME * 1_000_000_000 // RATE
FRAMES_A_BLOCK, BLOCKS_A_CLUSTER = 8, 32
# Element ids of the container format.
EBML, SEGMENT, INFO, TRACKS, TRACK, CLUSTER, CUES, CUE = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0x1F43B675, 0x1C53BB6B, 0xBB
SCALE, NUMBER, UID, KIND, CODEC, AUDIO, HERTZ, CHANNELS, DEPTH, DURATION = 0x2AD7B1, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
TIME, SIMPLE, GROUP, BLOCK, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUE_TIME, CUE_AT, CUE_TRACK, CUE_CLUSTER, CUE_RELATIVE = 0xB3, 0xB7, 0xF7, 0xF1, 0xF0
TOP = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469}
LACING = {"none": 0, "xiph": 1, "fixed": 2, "ebml": 3}


def vint(value: int, width: int = 0) -> bytes:
    """A size: the position of the first set bit says how many bytes follow."""
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: str) -> bytes:
    """Frame sizes in front of the frames, as the lacing kind writes them."""
    if kind == "none":
        return frames[0]
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if kind == "xiph":
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == "ebml":
        head += vint(sizes[0])
        for before, n in zip(sizes, sizes[1:-1]):
            step = n - before
            width = next(w for w in range(1, 9) if abs(step) < (1 << 7 * w - 1) - 1)
            head += vint(step + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


_HEAD = element(EBML, uint(0x4286, 1) + uint(0x42F7, 1) + uint(0x42F2, 4) + uint(0x42F3, 8) + element(0x4282, b"matroska") + uint(0x4287, 4) + uint(0x4285, 2))
_INFO = element(INFO, uint(SCALE, 1_000_000) + element(0x4D80, b"pagewright") + element(0x5741, b"pagewright"))
_TRACKS = element(TRACKS, element(TRACK, b"".join([
    uint(NUMBER, 1), uint(UID, 1), uint(KIND, 2), uint(0x9C, 1), uint(DURATION, FRAME_NS), element(CODEC, b"A_PCM/INT/LIT"),
    element(AUDIO, element(HERTZ, struct.pack(">d", RATE)) + uint(CHANNELS, 1) + uint(DEPTH, 8)),
])))


def mux(payload: bytes, lacing: str = "fixed") -> bytes:
    """A whole file around the payload; its length must be a positive multiple of FRAME."""
    per_block = 1 if lacing == "none" else FRAMES_A_BLOCK
    frames = [payload[k : k + FRAME] for k in range(0, len(payload), FRAME)]
    head = _INFO + _TRACKS
    parts, at, cues = [head], len(head), []
    for first in range(0, len(frames), per_block * BLOCKS_A_CLUSTER):
        began = first * FRAME_NS // 1_000_000
        body = [uint(TIME, began)]
        for k in range(first, min(len(frames), first + per_block * BLOCKS_A_CLUSTER), per_block):
            group = frames[k : k + per_block]
            kind = lacing if len(group) > 1 else "none"
            body.append(element(SIMPLE, b"\x81" + struct.pack(">hB", k * FRAME_NS // 1_000_000 - began, 0x80 | LACING[kind] << 1) + lace(group, kind)))
        parts.append(cluster := element(CLUSTER, b"".join(body)))
        cues.append(element(CUE, uint(CUE_TIME, began) + element(CUE_AT, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at) + uint(CUE_RELATIVE, len(body[0])))))
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return _HEAD + element(SEGMENT, b"".join(parts))


@dataclass
class Media:
    doc_type: str = ""
    scale: int = 1_000_000
    tracks: dict[int, dict] = field(default_factory=dict)
    #: track, timestamp in ns, offset, size, keyframe, place in its lace
    packets: list[tuple[int, int, int, int, bool, int]] = field(default_factory=list)
    #: time in ns, track, absolute offset of the cluster, relative position or None
    cues: list[tuple[int, int, int, int | None]] = field(default_factory=list)
    error: str | None = None


class Damaged(ValueError):
    pass


def _vint(data: bytes, at: int, end: int, keep: bool = False) -> tuple[int, int, bool]:
    """Value, place after it, and whether all its bits are set (an unknown size)."""
    if at >= end or not data[at]:
        raise Damaged(f"no variable-length number at {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise Damaged(f"cut off at {at}")
    raw = int.from_bytes(data[at : at + width], "big")
    value = raw & (1 << 7 * width) - 1
    return (raw if keep else value), at + width, value == (1 << 7 * width) - 1


def _elements(data: bytes, at: int, end: int, inside: int = 0) -> Iterator[tuple[int, int, int]]:
    """Id, start and end of each body.  A body of unknown size reaches up to the next element that cannot be inside."""
    while at < end:
        ident, body, _ = _vint(data, at, end, keep=True)
        size, body, unknown = _vint(data, body, end)
        stop = body + size
        if unknown:
            stop = end
            if ident == CLUSTER:
                here = body
                while here < end:
                    child, after, _ = _vint(data, here, end, keep=True)
                    if child in TOP:
                        break
                    n, after, _ = _vint(data, after, end)
                    here = after + n
                stop = min(here, end)
        if stop > end:
            yield ident, body, end
            raise Damaged(f"element {ident:X} at {at} ends beyond its parent")
        yield ident, body, stop
        at = stop


def _block(data: bytes, at: int, end: int, cluster_time: int, media: Media, simple: bool, key: bool) -> None:
    track, at, _ = _vint(data, at, end)
    if at + 3 > end:
        raise Damaged(f"block cut off at {at}")
    relative, flags = struct.unpack_from(">hB", data, at)
    at += 3
    kind, sizes = flags >> 1 & 3, []
    if kind:
        if at >= end:
            raise Damaged(f"lace cut off at {at}")
        n = data[at] + 1
        at += 1
        if kind == 1:
            for _ in range(n - 1):
                size = 0
                while at < end and data[at] == 255:
                    size, at = size + 255, at + 1
                if at >= end:
                    raise Damaged(f"lace cut off at {at}")
                sizes.append(size + data[at])
                at += 1
        elif kind == 3 and n > 1:
            size, at, _ = _vint(data, at, end)
            sizes.append(size)
            for _ in range(n - 2):
                before = at
                step, at, _ = _vint(data, at, end)
                size += step - ((1 << 7 * (at - before) - 1) - 1)
                sizes.append(size)
        elif kind == 2:
            if (end - at) % n:
                raise Damaged(f"fixed lace of uneven size at {at}")
            sizes = [(end - at) // n] * (n - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Damaged(f"lace sizes beyond the block at {at}")
    step = media.tracks.get(track, {}).get("frame_ns", 0)
    began = (cluster_time + relative) * media.scale
    _fits(track, 32, "track number")
    _fits(began, 64, "time")
    _fits(began + step * len(sizes), 64, "time")
    for k, size in enumerate(sizes):
        media.packets.append((track, began + k * step, at, size, bool(flags & 0x80) if simple else key, k))
        at += size


def _fits(value: int, bits: int, what: str) -> int:
    if not -(1 << bits - 1) <= value < 1 << bits - 1:
        raise Damaged(f"{what} {value} beyond {bits} bits")
    return value


def _real(data: bytes, a: int, b: int) -> float:
    """A float of 4 or 8 bytes; one of none is 0."""
    if b - a not in (0, 4, 8):
        raise Damaged(f"float of {b - a} bytes at {a}")
    return struct.unpack({0: ">0s", 4: ">f", 8: ">d"}[b - a], data[a:b])[0] or 0.0


def demux(data: bytes) -> Media:
    """Everything that can be read, and the error that ended the reading."""
    media = Media()

    def number(a: int, b: int) -> int:
        if b - a > 8:
            raise Damaged(f"number of {b - a} bytes at {a}")
        return int.from_bytes(data[a:b], "big")

    try:
        seen = False
        for ident, a, b in _elements(data, 0, len(data)):
            if ident == EBML:
                seen = True
                for x, c, d in _elements(data, a, b):
                    if x == 0x4282:
                        media.doc_type = data[c:d].decode("ascii", "replace")
            elif ident == SEGMENT:
                _segment(data, a, b, media, number)
        if not seen:
            raise Damaged("no header")
    except Damaged as e:
        media.error = str(e)
    return media


def _segment(data: bytes, a: int, b: int, media: Media, number) -> None:
    for ident, c, d in _elements(data, a, b):
        if ident == INFO:
            for x, p, q in _elements(data, c, d):
                if x == SCALE:
                    media.scale = number(p, q)
        elif ident == TRACKS:
            for x, p, q in _elements(data, c, d):
                if x == TRACK:
                    _track(data, p, q, media, number)
        elif ident == CLUSTER:
            time = 0
            for x, p, q in _elements(data, c, d):
                if x == TIME:
                    time = number(p, q)
                elif x == SIMPLE:
                    _block(data, p, q, time, media, True, True)
                elif x == GROUP:
                    inner = list(_elements(data, p, q))
                    key = all(y != REFERENCE for y, _, _ in inner)
                    for y, r, s in inner:
                        if y == BLOCK:
                            _block(data, r, s, time, media, False, key)
        elif ident == CUES:
            for x, p, q in _elements(data, c, d):
                if x == CUE:
                    when, places = 0, []
                    for y, r, s in _elements(data, p, q):
                        if y == CUE_TIME:
                            when = number(r, s) * media.scale
                        elif y == CUE_AT:
                            got = {z: number(t, u) for z, t, u in _elements(data, r, s)}
                            places.append((got.get(CUE_TRACK, 0), a + got.get(CUE_CLUSTER, 0), got.get(CUE_RELATIVE)))
                    for track, cluster, relative in places:
                        media.cues.append((_fits(when, 64, "cue time"), _fits(track, 32, "track number"), _fits(cluster, 64, "cue place"), relative))


def _track(data: bytes, p: int, q: int, media: Media, number) -> None:
    entry = {"codec": "", "kind": 0, "frame_ns": 0, "rate": 0.0, "channels": 0, "depth": 0}
    ident = 0
    for x, r, s in _elements(data, p, q):
        if x == NUMBER:
            ident = number(r, s)
        elif x == CODEC:
            entry["codec"] = data[r:s].decode("ascii", "replace")
        elif x == KIND:
            entry["kind"] = number(r, s)
        elif x == DURATION:
            entry["frame_ns"] = number(r, s)
        elif x == AUDIO:
            for y, t, u in _elements(data, r, s):
                if y == HERTZ:
                    entry["rate"] = _real(data, t, u)
                elif y == CHANNELS:
                    entry["channels"] = number(t, u)
                elif y == DEPTH:
                    entry["depth"] = number(t, u)
    media.tracks[ident] = entry


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (-len(raw) % FRAME or (FRAME if not raw else 0)), len(raw)


def payload_of(data: bytes, media: Media, track: int = 1) -> bytes:
    return b"".join(data[o : o + n] for t, _, o, n, _, _ in media.packets if t == track)


PACKETS = "track int, timestamp_ns long, offset long, size int, keyframe boolean, lace int, error string"


def packet_table(df: DataFrame, key: str, media: str) -> DataFrame:
    """(key, packet columns): one row a packet; damaged media add a row with the error alone."""
    kind = dict(df.dtypes)[key]
    names = ["key", *[c.split()[0] for c in PACKETS.split(", ")]]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for k, data in enumerate(batch.column(1).to_pylist()):
                if data is None:
                    continue
                got = demux(data)
                found = [(*p, None) for p in got.packets] + ([(*[None] * 6, got.error)] if got.error else [])
                at += [k] * len(found)
                rows += found
            columns = list(zip(*rows)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, types)]], names)

    return df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{media}`").alias("m")).mapInArrow(run, f"key {kind}, {PACKETS}").withColumnRenamed("key", key)


def store_texts(df: DataFrame, key: str = "doc_id", text: str = "text", lacing: str = "fixed") -> DataFrame:
    """(key, media binary, n_bytes): each text as a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [padded(t) for t in batch.column(1).to_pylist()]
            media = pa.array([mux(p, lacing) for p, _ in made], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), media, pa.array([n for _, n in made], pa.int64())], ["k", "media", "n_bytes"])

    kind = dict(df.dtypes)[key]
    return df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).mapInArrow(run, f"k {kind}, media binary, n_bytes long").withColumnRenamed("k", key)


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_packets long"


def read_features(df: DataFrame, key: str = "doc_id", media: str = "media", n_bytes: str = "n_bytes") -> DataFrame:
    """Digests and sample statistics of the bytes read back out of each file."""
    kind = dict(df.dtypes)[key]

    names = ["key", "n_bytes", *[c.split()[0] for c in FEATURES.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_features(data) for data in batch.column(1).to_pylist()]
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *[pa.array(c, t) for c, t in zip(columns, kinds)]], names)

    picked = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{media}`").alias("m"), F.col(f"`{n_bytes}`").alias("n"))
    return picked.mapInArrow(run, f"key {kind}, n_bytes long, {FEATURES}").withColumnRenamed("key", key)


def _features(data: bytes | None) -> tuple:
    if data is None:
        return (None,) * 7
    got = demux(data)
    if got.error:
        raise ValueError(f"stored media can't be read: {got.error}")
    back = payload_of(data, got)
    x = np.frombuffer(back, np.uint8)
    level = np.bincount(x, minlength=256)
    v = np.arange(256)
    crossings = int(np.count_nonzero((x[1:] > 127) != (x[:-1] > 127)))
    feature = f"frames={len(x) // FRAME};sum={int(level @ v)};energy={int(level @ (v - 128) ** 2)};peak={int(x.max(initial=0))};crossings={crossings}"
    return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature, len(got.packets)


def _digest(spark, sf_dir):
    return read_features(store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
