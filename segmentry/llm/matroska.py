"""Matroska media columns: EBML elements, clusters, lacing and cues as packet tables.

A media column holds whole Matroska files. They are parsed element by element: ids
and sizes of variable length, master elements of known or unknown size, clusters,
simple blocks and block groups, the three kinds of lacing, and cues. Each frame gives
a packet row with its track, timestamp and byte range in the file; each cue gives a
cue row. A writer stores bytes losslessly as 8-bit PCM samples in such a file.

Defined cases: null media has no packets and no cues; a file that breaks off or is no
EBML gives the packets before the fault and then one row with the fault's ``error``;
empty bytes are such a file; equal payloads give equal files; rows that repeat give
their rows each time. Frames of a lace follow one another by the duration that the block
group or the track gives; without one they share the time of their block. An element
beyond its parent, and content encodings, are faults. For the text store, null text is empty text, and text is padded
with zero bytes to a positive multiple of 64.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType

from .common import quoted
from .tokens import output

# Element ids of the Matroska specification (RFC 9559).
EBML, EBML_DOC_TYPE, SEGMENT, INFO, TIMESTAMP_SCALE = 0x1A45DFA3, 0x4282, 0x18538067, 0x1549A966, 0x2AD7B1
MUXING_APP, WRITING_APP, TRACKS, TRACK_ENTRY, TRACK_NUMBER = 0x4D80, 0x5741, 0x1654AE6B, 0xAE, 0xD7
TRACK_UID, TRACK_TYPE, CODEC_ID, AUDIO, SAMPLING_FREQUENCY = 0x73C5, 0x83, 0x86, 0xE1, 0xB5
CHANNELS, BIT_DEPTH, CLUSTER, TIMESTAMP, SIMPLE_BLOCK = 0x9F, 0x6264, 0x1F43B675, 0xE7, 0xA3
DEFAULT_DURATION, BLOCK_DURATION, CONTENT_ENCODINGS = 0x23E383, 0x9B, 0x6D80
BLOCK_GROUP, BLOCK, REFERENCE_BLOCK, CUES, CUE_POINT = 0xA0, 0xA1, 0xFB, 0x1C53BB6B, 0xBB
CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xB3, 0xB7, 0xF7, 0xF1
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

MASTERS = {SEGMENT, CLUSTER, BLOCK_GROUP, INFO, TRACKS, TRACK_ENTRY, CUES, CUE_POINT, CUE_TRACK_POSITIONS}
#: Elements that end a cluster or segment of unknown size.
TOP = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, EBML}

RATE, FRAME, FRAMES_A_BLOCK, BLOCKS_A_CLUSTER = 8000, 512, 8, 63
SCALE = 1_000_000  # nanoseconds a tick


class Malformed(ValueError):
    """The bytes are not what the format allows; the message says where."""


@dataclass(frozen=True)
class Packet:
    track: int
    timestamp: int  # nanoseconds
    cluster: int
    start: int
    length: int
    lacing: int
    keyframe: bool


@dataclass(frozen=True)
class Cue:
    time: int  # nanoseconds
    track: int
    cluster_start: int


def read_number(data: bytes, at: int, keep_marker: bool = False) -> tuple[int | None, int]:
    """A number of variable length and the place after it; None for unknown size."""
    if at >= len(data) or not data[at]:
        raise Malformed(f"no number at {at}")
    size = 9 - data[at].bit_length()
    if at + size > len(data):
        raise Malformed(f"number cut off at {at}")
    raw = int.from_bytes(data[at : at + size], "big")
    if keep_marker:
        return raw, at + size
    value = raw & ((1 << (7 * size)) - 1)
    return (None if value == (1 << (7 * size)) - 1 else value), at + size


def write_number(value: int) -> bytes:
    size = 1
    while value >= (1 << (7 * size)) - 1:
        size += 1
    return ((1 << (7 * size)) | value).to_bytes(size, "big")


def _lace_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Sizes of a block's frames, and where the first of them starts."""
    if lacing == NO_LACING:
        return [end - at], at
    if at >= end:
        raise Malformed(f"no lace count at {at}")
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == FIXED:
        if (end - at) % n:
            raise Malformed(f"unequal fixed lace at {at}")
        return [(end - at) // n] * n, at
    for k in range(n - 1):
        if lacing == XIPH:
            size = 0
            while True:
                if at >= end:
                    raise Malformed(f"lace cut off at {at}")
                size, at = size + data[at], at + 1
                if data[at - 1] != 255:
                    break
        else:
            begin = at
            raw, at = read_number(data, at)
            bits = 7 * (at - begin)
            raw = (1 << bits) - 1 if raw is None else raw
            size = raw if not k else sizes[-1] + raw - ((1 << (bits - 1)) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Malformed(f"lace beyond its block at {at}")
    return sizes, at


def parse(data: bytes) -> Iterator[Packet | Cue]:
    """Packets and cues in file order; raises :class:`Malformed` at the first fault."""
    at, total = 0, len(data)
    scale, base, cluster, segment, track = SCALE, 0, -1, 0, 0
    cue: dict[int, int] = {}
    seen_header = False
    group_end, reference, held, lasts = -1, False, [], 0
    entry: dict[int, int] = {}
    steps: dict[int, int] = {}  # nanoseconds a frame, by track
    parents: list[int] = []  # where the elements around this place end
    if not total:
        raise Malformed("no bytes")

    def block(begin: int, end: int, simple: bool) -> list[Packet]:
        number, p = read_number(data, begin)
        if p + 3 > end:
            raise Malformed(f"block cut off at {begin}")
        (relative,), flags = struct.unpack_from(">h", data, p), data[p + 2]
        lacing = flags >> 1 & 3
        sizes, p = _lace_sizes(data, p + 3, end, lacing)
        found, time, step = [], (base + relative) * scale, steps.get(number or 0, 0)
        for k, size in enumerate(sizes):
            found.append(
                Packet(number or 0, time + k * step, cluster, p, size, lacing, bool(flags & 0x80) and simple)
            )
            p += size
        return found

    def group() -> Iterator[Packet]:
        """The frames of a block group; its duration goes before the track's."""
        for k, p in enumerate(held):
            time = held[0].timestamp + k * lasts // len(held) if lasts else p.timestamp
            yield replace(p, timestamp=time, keyframe=not reference)

    while at < total:
        if group_end >= 0 and at >= group_end:
            yield from group()
            group_end, reference, held, lasts = -1, False, [], 0
        while parents and at >= parents[-1]:
            parents.pop()
        limit = parents[-1] if parents else total
        start = at
        ident, at = read_number(data, at, keep_marker=True)
        size, at = read_number(data, at)
        end = limit if size is None else at + size
        if size is None and ident not in TOP:
            raise Malformed(f"unknown size at {start}")
        if end > limit:
            raise Malformed(f"element beyond {'its parent' if parents else 'the file'} at {start}")
        if not seen_header:
            if ident != EBML:
                raise Malformed("no EBML header")
            seen_header = True
        if ident in MASTERS:
            parents.append(end)
        if ident == SEGMENT:
            segment = at
        elif ident == CLUSTER:
            cluster, base = cluster + 1, 0
        elif ident == BLOCK_GROUP:
            group_end, reference, held, lasts = end, False, [], 0
        elif ident in MASTERS:
            if ident == CUE_POINT:
                cue = {}
            elif ident == TRACK_ENTRY:
                entry = {}
        else:
            if ident == TIMESTAMP_SCALE:
                scale = int.from_bytes(data[at:end], "big")
            elif ident == TIMESTAMP:
                base = int.from_bytes(data[at:end], "big")
            elif ident == SIMPLE_BLOCK:
                yield from block(at, end, True)
            elif ident == BLOCK:
                held = block(at, end, False)
            elif ident == BLOCK_DURATION:
                lasts = int.from_bytes(data[at:end], "big") * scale
            elif ident in (TRACK_NUMBER, DEFAULT_DURATION):
                entry[ident] = int.from_bytes(data[at:end], "big")
                if len(entry) == 2:
                    steps[entry[TRACK_NUMBER]] = entry[DEFAULT_DURATION]
            elif ident == CONTENT_ENCODINGS:
                raise Malformed(f"content encodings at {start}")
            elif ident == REFERENCE_BLOCK:
                reference = True
            elif ident in (CUE_TIME, CUE_TRACK, CUE_CLUSTER_POSITION):
                cue[ident] = int.from_bytes(data[at:end], "big")
                if ident == CUE_CLUSTER_POSITION:
                    track = cue.get(CUE_TRACK, 0)
                    yield Cue(cue.get(CUE_TIME, 0) * scale, track, segment + cue[ident])
            at = end
    yield from group()


def _element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + write_number(len(body)) + body


def _uint(ident: int, value: int) -> bytes:
    return _element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


_HEADER = _element(EBML, _element(EBML_DOC_TYPE, b"matroska"))
_FRONT = _element(
    INFO,
    _uint(TIMESTAMP_SCALE, SCALE)
    + _element(MUXING_APP, b"segmentry")
    + _element(WRITING_APP, b"segmentry"),
) + _element(
    TRACKS,
    _element(
        TRACK_ENTRY,
        _uint(TRACK_NUMBER, 1)
        + _uint(TRACK_UID, 1)
        + _uint(TRACK_TYPE, 2)
        + _uint(DEFAULT_DURATION, FRAME * 1_000_000_000 // RATE)
        + _element(CODEC_ID, b"A_PCM/INT/LIT")
        + _element(
            AUDIO,
            _element(SAMPLING_FREQUENCY, struct.pack(">d", RATE))
            + _uint(CHANNELS, 1)
            + _uint(BIT_DEPTH, 8),
        ),
    ),
)


def lace(frames: list[bytes], lacing: int) -> bytes:
    """Lace header and frames; fixed lacing needs frames of one length."""
    if lacing == NO_LACING:
        return frames[0]
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if lacing == XIPH:
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif lacing == EBML_LACING:
        head += write_number(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            size = 1
            while not -(1 << (7 * size - 1)) < b - a < (1 << (7 * size - 1)) - 1:
                size += 1
            raw = b - a + (1 << (7 * size - 1)) - 1
            head += ((1 << (7 * size)) | raw).to_bytes(size, "big")
    return head + b"".join(frames)


def mux(payload: bytes) -> bytes:
    """``payload`` as 8-bit samples, one track, laced blocks, a cue for each cluster."""
    body, cues = [_FRONT], []
    place = len(_FRONT)
    span = FRAME * FRAMES_A_BLOCK
    for base in range(0, len(payload), span * BLOCKS_A_CLUSTER):
        begin = base * 1000 // RATE
        parts = [_uint(TIMESTAMP, begin)]
        for at in range(base, min(len(payload), base + span * BLOCKS_A_CLUSTER), span):
            part = payload[at : at + span]
            frames = [part[i : i + FRAME] for i in range(0, len(part), FRAME)]
            if len(frames) == 1:
                kind = NO_LACING
            else:
                kind = FIXED if len(frames[-1]) == FRAME else EBML_LACING
            ticks = at * 1000 // RATE - begin
            head = b"\x81" + struct.pack(">hB", ticks, 0x80 | kind << 1)
            parts.append(_element(SIMPLE_BLOCK, head + lace(frames, kind)))
        where = _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER_POSITION, place)
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, begin) + _element(CUE_TRACK_POSITIONS, where)))
        body.append(_element(CLUSTER, b"".join(parts)))
        place += len(body[-1])
    body.append(_element(CUES, b"".join(cues)))
    return _HEADER + _element(SEGMENT, b"".join(body))


def demux(media: bytes) -> bytes:
    """The bytes of all packets, in file order."""
    found = (x for x in parse(media) if isinstance(x, Packet))
    return b"".join(media[p.start : p.start + p.length] for p in found)


def _packet_rows(batches: Iterator[pa.RecordBatch], cues: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        take, rows = [], []
        for i, media in enumerate(batch.column(1)):
            if not media.is_valid:
                continue
            k, fault = 0, None
            try:
                for x in parse(media.as_py()):
                    if isinstance(x, Cue) == cues:
                        take.append(i)
                        rows.append((k, *vars(x).values(), None))
                        k += 1
            except Malformed as e:
                fault = str(e)
            if fault is not None:
                take.append(i)
                rows.append((k, *[None] * (3 if cues else 7), fault))
        kinds = [pa.int64()] * 4 if cues else [*[pa.int64()] * 6, pa.int32(), pa.bool_()]
        names = CUE_NAMES if cues else PACKET_NAMES
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(take, pa.int64())),
                *(pa.array(c, t) for c, t in zip(columns, [*kinds, pa.string()], strict=True)),
            ],
            ["id", *names],
        )


PACKET_NAMES = ("packet", "track", "timestamp", "cluster", "start", "length", "lacing", "keyframe", "error")
CUE_NAMES = ("cue", "time", "track", "cluster_start", "error")


def packet_table(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """``id`` and a row for each frame: timestamps in nanoseconds, byte ranges in the file."""
    kinds = [*[LongType()] * 6, IntegerType(), BooleanType(), StringType()]
    schema = output(df, id_col, "id", *zip(PACKET_NAMES, kinds, strict=True))
    return df.select(quoted(id_col), quoted(media_col)).mapInArrow(
        lambda b: _packet_rows(b, False), schema
    )


def cue_table(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """``id`` and a row for each cue: its time, track, and where its cluster starts."""
    schema = output(df, id_col, "id", *zip(CUE_NAMES, [*[LongType()] * 4, StringType()], strict=True))
    return df.select(quoted(id_col), quoted(media_col)).mapInArrow(
        lambda b: _packet_rows(b, True), schema
    )


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes padded to a positive multiple of 64, and their unpadded number."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 if raw else 64), len(raw)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        media, sizes = [], []
        for text in batch.column(1):
            payload, n = payload_of(text.as_py())
            media.append(mux(payload))
            sizes.append(n)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())],
            ["id", "n_bytes", "media"],
        )


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, media``: each text stored as a Matroska file."""
    from pyspark.sql.types import BinaryType

    schema = output(docs, id_col, "id", ("n_bytes", LongType()), ("media", BinaryType()))
    return docs.select(quoted(id_col), quoted(text_col)).mapInArrow(_store, schema)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for cell in batch.column(2):
            media = cell.as_py()
            packets, n_cues = [], 0
            for x in parse(media):
                if isinstance(x, Packet):
                    packets.append(x)
                else:
                    n_cues += 1
            payload = b"".join(media[p.start : p.start + p.length] for p in packets)
            samples = np.frombuffer(payload, np.uint8)
            feature = (
                f"packets={len(packets)};clusters={packets[-1].cluster + 1};cues={n_cues};"
                f"last_ms={packets[-1].timestamp // 1_000_000};"
                f"mean={samples.mean():.4f};peak={samples.max()}"
            )
            rows.append(
                (
                    len(payload),
                    hashlib.sha256(payload).hexdigest(),
                    zlib.crc32(payload[-64:]),
                    len(media),
                    hashlib.sha256(media).hexdigest(),
                    feature,
                )
            )
        columns = list(zip(*rows, strict=True)) or [[] for _ in range(6)]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)),
            ],
            ["id", "n_bytes", *(n for n, _ in FEATURES)],
        )


FEATURES = (
    ("payload_bytes", LongType()),
    ("payload_sha256", StringType()),
    ("tail_crc32", LongType()),
    ("media_bytes", LongType()),
    ("media_sha256", StringType()),
    ("feature", StringType()),
)


def media_features(stored: DataFrame) -> DataFrame:
    """Digests and features of the payload that is read back from ``store_texts`` rows."""
    schema = output(stored, "id", "id", ("n_bytes", LongType()), *FEATURES)
    return stored.select("id", "n_bytes", "media").mapInArrow(_features, schema)
