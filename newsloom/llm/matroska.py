"""Matroska in a binary column: write 8-bit PCM, and parse any file's elements into a packet table.

Element ids, lacing modes and flags are those of the public Matroska and EBML specifications (RFC 8794, RFC 9559).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import Kept, in_arrow, utf8

# Fixed values of the format.
EBML, SEGMENT, INFO, SCALE, DURATION = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, TRACK, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, RATE, CHANNELS, DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIME, SIMPLE, GROUP, BLOCK, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4282, 0x4287, 0x4285
DEFAULT_DURATION, BLOCK_DURATION = 0x23E383, 0x9B
SEEK_HEAD, CHAPTERS, ATTACHMENTS, TAGS = 0x114D9B74, 0x1043A770, 0x1941A469, 0x1254C367
#: What ends an element of unknown size.
ENDS = {SEGMENT: frozenset({EBML}), CLUSTER: frozenset({EBML, SEGMENT, SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, CHAPTERS, ATTACHMENTS, TAGS})}
NO_LACE, XIPH_LACE, FIXED_LACE, EBML_LACE = 0, 1, 2, 3

#: Samples a second; samples a frame; frames a block; blocks a cluster.
HERTZ, FRAME, LACE, BLOCKS = 8000, 512, 8, 16
UNIT = 64


def size_bytes(n: int, width: int = 0) -> bytes:
    """n as a variable-length size; all ones are left for the unknown size."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(kind: int, data: bytes, width: int = 0) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + size_bytes(len(data), width) + data


def number(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def real(kind: int, x: float) -> bytes:
    return element(kind, np.array(x, ">f8").tobytes())


def _laced(frames: list[bytes], mode: int) -> bytes:
    """The frame sizes and frames of a block after its flags."""
    if mode == NO_LACE:
        return frames[0]
    head, sizes = bytes([len(frames) - 1]), [len(x) for x in frames]
    if mode == XIPH_LACE:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif mode == EBML_LACE:
        head += size_bytes(sizes[0])
        for a, b in zip(sizes[:-2], sizes[1:-1], strict=True):
            width = next(w for w in range(1, 9) if abs(b - a) < 1 << 7 * w - 1)
            head += size_bytes(b - a + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def block(track: int, ticks: int, frames: list[bytes], mode: int | None = None) -> bytes:
    """A SimpleBlock of key frames; without a mode: none for one frame, fixed for equal sizes, else EBML lacing."""
    if mode is None:
        mode = NO_LACE if len(frames) == 1 else FIXED_LACE if len({len(x) for x in frames}) == 1 else EBML_LACE
    return element(SIMPLE, size_bytes(track) + ticks.to_bytes(2, "big", signed=True) + bytes([0x80 | mode << 1]) + _laced(frames, mode))


def write_pcm(payload: bytes) -> bytes:
    """A file with one track of unsigned 8-bit mono samples, clusters of laced blocks, and cues to every cluster."""
    head = element(EBML, element(DOC_TYPE, b"matroska") + number(DOC_VERSION, 4) + number(DOC_READ_VERSION, 2))
    info = element(INFO, number(SCALE, 1_000_000) + real(DURATION, len(payload) * 1000 / HERTZ))
    audio = element(AUDIO, real(RATE, HERTZ) + number(CHANNELS, 1) + number(DEPTH, 8))
    tracks = element(TRACKS, element(TRACK, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + element(CODEC, b"A_PCM/INT/LIT") + number(DEFAULT_DURATION, FRAME * 10**9 // HERTZ) + audio))
    parts, at, cues = [info, tracks], len(info) + len(tracks), []
    step = FRAME * LACE * BLOCKS
    for start in range(0, len(payload), step):
        ticks = start * 1000 // HERTZ
        blocks = []
        for b in range(start, min(start + step, len(payload)), FRAME * LACE):
            frames = [payload[i : min(i + FRAME, len(payload))] for i in range(b, min(b + FRAME * LACE, len(payload)), FRAME)]
            blocks.append(block(1, b * 1000 // HERTZ - ticks, frames))
        cluster = element(CLUSTER, number(TIME, ticks) + b"".join(blocks))
        cues.append(element(CUE, number(CUE_TIME, ticks) + element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    return head + element(SEGMENT, b"".join([*parts, element(CUES, b"".join(cues))]), 8)


@dataclass
class Media:
    """What a file holds. packets: track, timestamp in ns, byte offset, size, key frame, lacing, cluster's number."""

    scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, str] = field(default_factory=dict)
    frame_ns: dict[int, int] = field(default_factory=dict)
    packets: list[tuple[int, int, int, int, bool, int, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    error: str | None = None


def read_size(data: bytes, at: int, end: int) -> tuple[int, int]:
    """A variable-length size and where it ends; -1 for the unknown size."""
    if at >= end or not data[at]:
        raise ValueError("no size here")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise ValueError("a size is cut short")
    n = int.from_bytes(data[at : at + width], "big") & (1 << 7 * width) - 1
    return (-1 if n == (1 << 7 * width) - 1 else n), at + width


def elements(data: bytes, at: int, end: int, until: frozenset[int] = frozenset()) -> Iterator[tuple[int, int, int]]:
    """Kind, start and end of each element's data; a cluster or segment of unknown size reaches
    to the first element that cannot be inside it, any other to the end; one of until ends the list."""
    while at < end:
        width = 9 - data[at].bit_length()
        if not 1 <= width <= 4 or at + width > end:
            raise ValueError("no element here")
        kind = int.from_bytes(data[at : at + width], "big")
        if kind in until:
            return
        n, body = read_size(data, at + width, end)
        if n < 0:
            last = max((e for _, _, e in elements(data, body, end, ENDS[kind])), default=body) if kind in ENDS else end
        else:
            last = body + n
        if last > end:
            raise ValueError("an element is cut short")
        yield kind, body, last
        at = last


def lace_sizes(data: bytes, at: int, end: int, mode: int) -> tuple[list[int], int]:
    """The sizes of a block's frames and where the first begins."""
    if mode == NO_LACE:
        return [end - at], at
    count, at, sizes = data[at] + 1, at + 1, []
    if mode == FIXED_LACE:
        if (end - at) % count:
            raise ValueError("a fixed lace does not divide")
        return [(end - at) // count] * count, at
    while len(sizes) < count - 1:
        if mode == XIPH_LACE:
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            n, at = n + data[at], at + 1
        else:
            n, stop = read_size(data, at, end)
            n = n if not sizes else sizes[-1] + n - ((1 << 7 * (stop - at) - 1) - 1)
            at = stop
        sizes.append(n)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("a lace is longer than its block")
    return sizes, at


def _block(media: Media, data: bytes, at: int, end: int, time: int, key: bool | None, lasts: int = 0) -> None:
    """The frames of a block. Those of a lace follow each other by the track's frame duration, else by their share of the block's."""
    track, at = read_size(data, at, end)
    ticks, flags = int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2]
    mode = flags >> 1 & 3
    sizes, at = lace_sizes(data, at + 3, end, mode)
    step = media.frame_ns.get(track) or lasts * media.scale // len(sizes)
    for i, n in enumerate(sizes):
        media.packets.append((track, (time + ticks) * media.scale + i * step, at, n, bool(flags & 0x80) if key is None else key, mode, len(media.clusters) - 1))
        at += n


def parse(data: bytes) -> Media:
    """Everything up to the first fault, which error names. Frames of a lace share its timestamp where no duration is known."""
    media = Media()
    uint = lambda s, e: int.from_bytes(data[s:e], "big")
    try:
        for top, s, e in elements(data, 0, len(data)):
            if top != SEGMENT:
                continue
            base = s
            for kind, s1, e1 in elements(data, s, e):
                if kind == CLUSTER:
                    media.clusters.append(s1)
                    time = 0
                    for k, s2, e2 in elements(data, s1, e1):
                        if k == TIME:
                            time = uint(s2, e2)
                        elif k == SIMPLE:
                            _block(media, data, s2, e2, time, None)
                        elif k == GROUP:
                            inner = list(elements(data, s2, e2))
                            lasts = next((uint(s3, e3) for j, s3, e3 in inner if j == BLOCK_DURATION), 0)
                            for j, s3, e3 in inner:
                                if j == BLOCK:
                                    _block(media, data, s3, e3, time, all(x[0] != REFERENCE for x in inner), lasts)
                elif kind == INFO:
                    for k, s2, e2 in elements(data, s1, e1):
                        if k == SCALE:
                            media.scale = uint(s2, e2)
                        elif k == DURATION:
                            media.duration = float(np.frombuffer(data[s2:e2], ">f8" if e2 - s2 == 8 else ">f4")[0])
                elif kind == TRACKS:
                    for k, s2, e2 in elements(data, s1, e1):
                        if k == TRACK:
                            own = {j: (s3, e3) for j, s3, e3 in elements(data, s2, e2)}
                            media.tracks[uint(*own[TRACK_NUMBER])] = data[slice(*own[CODEC])].decode() if CODEC in own else ""
                            if DEFAULT_DURATION in own:
                                media.frame_ns[uint(*own[TRACK_NUMBER])] = uint(*own[DEFAULT_DURATION])
                elif kind == CUES:
                    for k, s2, e2 in elements(data, s1, e1):
                        inner = list(elements(data, s2, e2)) if k == CUE else []
                        cue = {j: (s3, e3) for j, s3, e3 in inner}
                        for j, s3, e3 in inner:
                            if j == CUE_TRACK_POSITIONS:
                                place = {i: (s4, e4) for i, s4, e4 in elements(data, s3, e3)}
                                media.cues.append((uint(*cue[CUE_TIME]) * media.scale, uint(*place[CUE_TRACK]), base + uint(*place[CUE_CLUSTER])))
    except (ValueError, IndexError, KeyError) as x:
        media.error = str(x) or type(x).__name__
    return media


def samples(data: bytes, media: Media, track: int = 1) -> bytes:
    """A track's frames joined in order."""
    return b"".join([data[at : at + n] for t, _, at, n, _, _, _ in media.packets if t == track])


def feature(media: Media, payload: bytes) -> str:
    """Counts of packets, clusters and cues, the duration, a CRC of the packet table, and the samples' mean and deviation."""
    x = np.frombuffer(payload, np.uint8)
    table = zlib.crc32(np.array([p[:4] for p in media.packets], np.int64).tobytes())
    return f"p{len(media.packets)} c{len(media.clusters)} q{len(media.cues)} {media.duration:.3f}ms {table:08x} {x.mean() if len(x) else 0:.4f} {x.std() if len(x) else 0:.4f}"


PACKETS = "array<struct<track:bigint,timestamp_ns:bigint,offset:bigint,size:bigint,keyframe:boolean,lacing:int,cluster:int>>"


CUE_LIST = "array<struct<timestamp_ns:bigint,track:bigint,offset:bigint>>"


def _type(ddl: str) -> T.DataType:
    return T.StructType.fromDDL(f"x {ddl}")["x"].dataType


def packets(df: DataFrame, media_col: str, keep: tuple[Column, ...] = ()) -> DataFrame:
    """Kept columns and, of each file, packets (an array; explode it for a table), cues, duration_ms and error.

    Null and empty files have no packets; a file that breaks off has those before the fault, and error says why. Raises ValueError where a
    kept column is named like one of the result's.
    """
    kept = Kept(df, keep, ("packets", "cues", "duration_ms", "error"))
    rows = df.select(*kept.columns, F.col(media_col).cast("binary").alias("__media"))
    kind = pa.list_(pa.struct([("track", pa.int64()), ("timestamp_ns", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("keyframe", pa.bool_()), ("lacing", pa.int32()), ("cluster", pa.int32())]))
    cue_kind = pa.list_(pa.struct([("timestamp_ns", pa.int64()), ("track", pa.int64()), ("offset", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [parse(x.as_py() or b"") for x in b.column("__media")]
            named = lambda names, rows: [dict(zip(names, r, strict=True)) for r in rows]
            tables = [
                pa.array([named([f.name for f in kind.value_type], m.packets) for m in got], kind),
                pa.array([named([f.name for f in cue_kind.value_type], m.cues) for m in got], cue_kind),
                pa.array([m.duration for m in got], pa.float64()), pa.array([m.error for m in got], pa.string()),
            ]
            own = b.drop_columns(["__media"])
            yield pa.RecordBatch.from_arrays([*own.columns, *tables], names=[*own.schema.names, "packets", "cues", "duration_ms", "error"])

    schema = rows.drop("__media").schema.add("packets", _type(PACKETS)).add("cues", _type(CUE_LIST))
    return kept.named(in_arrow(rows, run, schema.add("duration_ms", "double").add("error", "string")))


def store(df: DataFrame, text_col: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """Kept columns, n_bytes and media: the text's UTF-8 bytes, filled with zeros to a positive multiple of 64, as a file.

    Raises ValueError where a kept column is named like one of the result's.
    """
    kept = Kept(df, keep, ("n_bytes", "media"))
    rows = df.select(*kept.columns, F.coalesce(utf8(text_col), F.lit(b"")).alias("__data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                data = [x.as_py() for x in b.column("__data")]
                files = [write_pcm(x + bytes(max(UNIT, -(-len(x) // UNIT) * UNIT) - len(x))) for x in data]
                own = b.drop_columns(["__data"])
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(map(len, data), pa.int64()), pa.array(files, pa.binary())], names=[*own.schema.names, "n_bytes", "media"])

    return kept.named(in_arrow(rows, run, rows.drop("__data").schema.add("n_bytes", "long").add("media", "binary")))


def describe(df: DataFrame, media_col: str, keep: tuple[Column, ...] = ()) -> DataFrame:
    """Kept columns and payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_packets of what the files of track 1 hold.

    Raises ValueError where a kept column is named like one of the result's.
    """
    made = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string", "n_packets": "long"}
    kept = Kept(df, keep, (*made,))
    rows = df.select(*kept.columns, F.col(media_col).cast("binary").alias("__media"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column("__media"):
                data = x.as_py() or b""
                media = parse(data)
                back = samples(data, media)
                out.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature(media, back), len(media.packets)))
            own = b.drop_columns(["__media"])
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            columns = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*own.columns, *columns], names=[*own.schema.names, *made])

    schema = rows.drop("__media").schema
    for name, kind in made.items():
        schema = schema.add(name, kind)
    return kept.named(in_arrow(rows, run, schema))
