"""Matroska media columns: writing 8-bit PCM files, and parsing EBML into packet tables.

The parser walks variable-length EBML elements (ids and sizes, unknown sizes included),
collects tracks, cues and clusters, and undoes all four kinds of lacing, giving each
frame's track, timestamp and byte range. It never copies frames: samples are read by
the byte ranges of the packet table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, pick

# Fixed values of the Matroska and EBML specifications.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
FLAG_LACING, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0x9C, 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
ENCODINGS, ENCODING, SCOPE, ENCODING_TYPE, COMPRESSION, ALGORITHM, SETTINGS = 0x6D80, 0x6240, 0x5032, 0x5033, 0x5034, 0x4254, 0x4255
ZLIB, STRIPPED = 0, 3
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, EBML_VERSION, READ_VERSION, MAX_ID, MAX_SIZE, TYPE_VERSION, TYPE_READ = 0x4282, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4287, 0x4285
#: Elements whose children are walked.
MASTERS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, ENCODINGS, ENCODING, COMPRESSION, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS}
#: Elements that can only follow a cluster of unknown size, not lie in it.
TOP = {CLUSTER, CUES, INFO, TRACKS, SEGMENT, EBML}

#: Samples of a frame, frames of a block, frames of a cluster, samples a second.
FRAME, LACED, IN_CLUSTER, RATE = 192, 8, 64, 8000
FRAME_NS = 1_000_000_000 * FRAME // RATE


def _size(n: int) -> bytes:
    width = 1
    while n >= (1 << 7 * width) - 1:  # all ones are the unknown size
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(id: int, body: bytes) -> bytes:
    return id.to_bytes((id.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def number(id: int, n: int) -> bytes:
    return element(id, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


_HEAD = element(
    EBML,
    number(EBML_VERSION, 1) + number(READ_VERSION, 1) + number(MAX_ID, 4) + number(MAX_SIZE, 8)
    + element(DOC_TYPE, b"matroska") + number(TYPE_VERSION, 4) + number(TYPE_READ, 2),
)
_TRACKS = element(
    TRACKS,
    element(
        TRACK_ENTRY,
        number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(FLAG_LACING, 1)
        + number(DEFAULT_DURATION, FRAME_NS) + element(CODEC_ID, b"A_PCM/INT/LIT")
        + element(AUDIO, element(SAMPLING, struct.pack(">d", RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8)),
    ),
)


def padded(text: bytes) -> bytes:
    """The bytes and blanks up to a positive multiple of a frame."""
    return text + b" " * (-len(text) % FRAME if text else FRAME)


def mux(payload: bytes) -> bytes:
    """A Matroska file of one 8-bit PCM track, a function of the payload alone.
    The payload's length is a multiple of FRAME."""
    frames = len(payload) // FRAME
    info = element(
        INFO,
        number(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", frames * FRAME_NS / 1e6))
        + element(MUXING_APP, b"xsdframe") + element(WRITING_APP, b"xsdframe"),
    )
    body, cues, at = [info, _TRACKS], [], len(info) + len(_TRACKS)
    for first in range(0, frames, IN_CLUSTER):
        time = first * FRAME_NS // 1_000_000
        parts = [number(TIMESTAMP, time)]
        for k in range(first, min(first + IN_CLUSTER, frames), LACED):
            n = min(LACED, min(first + IN_CLUSTER, frames) - k)
            moved = struct.pack(">h", k * FRAME_NS // 1_000_000 - time)
            lace = b"\x84" + bytes([n - 1]) if n > 1 else b"\x80"  # key frames; fixed-size lacing
            parts.append(element(SIMPLE_BLOCK, b"\x81" + moved + lace + payload[k * FRAME : (k + n) * FRAME]))
        cluster = element(CLUSTER, b"".join(parts))
        cues.append(element(CUE_POINT, number(CUE_TIME, time) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    return _HEAD + element(SEGMENT, b"".join(body))


@dataclass
class Encoding:
    """How stored frames came from the track's own. scope: bit 1, all frames."""

    scope: int = 1
    type: int = 0
    algorithm: int = ZLIB
    settings: bytes = b""

    def undo(self, frame: bytes) -> bytes:
        if not self.scope & 1:
            return frame
        if self.type == 0 and self.algorithm == STRIPPED:
            return self.settings + frame
        if self.type == 0 and self.algorithm == ZLIB:
            return zlib.decompress(frame)
        raise ValueError("frames are encrypted" if self.type else f"frames are compressed by algorithm {self.algorithm}")


@dataclass
class Track:
    number: int = 0
    kind: int = 0
    codec: str = ""
    duration_ns: int = 0
    rate: float = 8000.0
    channels: int = 1
    depth: int = 0
    encodings: list[Encoding] = field(default_factory=list)


@dataclass
class Media:
    """What a file holds. packets: track, timestamp_ns, begin, end (byte range), cluster
    (byte place), keyframe. cues: time_ns, track, cluster. error: why parsing stopped, or empty."""

    tracks: dict[int, Track] = field(default_factory=dict)
    packets: list[tuple[int, int, int, int, int, bool]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    error: str = ""


def _vint(data: bytes, at: int, keep: bool) -> tuple[int, int]:
    """A variable-length integer and the place after it; -1 for an unknown size.
    keep: the length marker belongs to the value, as in ids."""
    if at >= len(data):
        raise ValueError(f"ends at {at}")
    first = data[at]
    if not first:
        raise ValueError(f"bad length at {at}")
    width = 9 - first.bit_length()
    if at + width > len(data):
        raise ValueError(f"ends at {at}")
    value = int.from_bytes(data[at : at + width], "big")
    if not keep:
        value ^= 1 << 7 * width
        if value == (1 << 7 * width) - 1:
            value = -1
    return value, at + width


def laced(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Byte ranges of the frames in a block's body. kind: 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    if not kind:
        return [(at, end)]
    count, at = data[at] + 1, at + 1
    if kind == 2:
        size, rest = divmod(end - at, count)
        if rest:
            raise ValueError(f"uneven lacing at {at}")
        return [(at + k * size, at + (k + 1) * size) for k in range(count)]
    sizes: list[int] = []
    for k in range(count - 1):
        if kind == 1:
            n = 0
            while True:
                n += (b := data[at])
                at += 1
                if b < 255:
                    break
            sizes.append(n)
        elif not k:
            n, at = _vint(data, at, False)
            sizes.append(n)
        else:
            begin = at
            n, at = _vint(data, at, True)
            width = at - begin
            n = (n ^ 1 << 7 * width) - ((1 << 7 * width - 1) - 1)  # signed difference
            sizes.append(sizes[-1] + n)
    out = []
    for n in sizes:
        out.append((at, at + n))
        at += n
    out.append((at, end))
    if at > end or any(b < a for a, b in out):
        raise ValueError(f"lacing passes the block at {at}")
    return out


def parse(data: bytes) -> Media:
    """Walk a file. A damaged or cut file gives what came before the damage, and the error."""
    media = Media()
    scale, segment, cluster, cluster_time, group = 1_000_000, 0, 0, 0, 0
    track = cue = None
    stack: list[tuple[int, int]] = []  # masters being walked: id, end
    at = 0
    try:
        while at < len(data):
            while stack and at >= stack[-1][1]:
                stack.pop()
            begin = at
            id, at = _vint(data, at, True)
            size, at = _vint(data, at, False)
            while stack and id in TOP and stack[-1][0] in (CLUSTER, CUES) and stack[-1][1] == len(data):
                stack.pop()  # a master of unknown size ends where its sibling begins
            end = len(data) if size < 0 else at + size
            if end > len(data):
                raise ValueError(f"element {id:x} at {begin} passes the end")
            if id in MASTERS:
                stack.append((id, end))
                if id == SEGMENT:
                    segment = at
                elif id == CLUSTER:
                    cluster, cluster_time = begin, 0
                elif id == TRACK_ENTRY:
                    track = Track()
                elif id == CUE_POINT:
                    cue = [0, 0, 0]
                elif id == BLOCK_GROUP:
                    group = len(media.packets)
                elif id == ENCODING and track is not None:
                    track.encodings.append(Encoding())
                continue
            if id in (SIMPLE_BLOCK, BLOCK):
                owner, p = _vint(data, at, False)
                moved, flags = struct.unpack_from(">hB", data, p)
                step = media.tracks[owner].duration_ns if owner in media.tracks else 0
                time = (cluster_time + moved) * scale
                for a, b in laced(data, p + 3, end, flags >> 1 & 3):
                    media.packets.append((owner, time, a, b, cluster, id == BLOCK or flags >= 0x80))
                    time += step
            elif id == REFERENCE_BLOCK:  # its group's frames need another frame
                media.packets[group:] = [(*p[:5], False) for p in media.packets[group:]]
            elif track is not None and track.encodings and id in (SCOPE, ENCODING_TYPE, ALGORITHM):
                name = {SCOPE: "scope", ENCODING_TYPE: "type", ALGORITHM: "algorithm"}[id]
                setattr(track.encodings[-1], name, int.from_bytes(data[at:end], "big"))
            elif track is not None and track.encodings and id == SETTINGS:
                track.encodings[-1].settings = data[at:end]
            elif id == TIMESTAMP:
                cluster_time = int.from_bytes(data[at:end], "big")
            elif id == TIMESTAMP_SCALE:
                scale = int.from_bytes(data[at:end], "big")
            elif track is not None and id == TRACK_NUMBER:
                track.number = int.from_bytes(data[at:end], "big")
                media.tracks[track.number] = track
            elif track is not None and id == TRACK_TYPE:
                track.kind = int.from_bytes(data[at:end], "big")
            elif track is not None and id == CODEC_ID:
                track.codec = data[at:end].decode("ascii", "replace")
            elif track is not None and id == DEFAULT_DURATION:
                track.duration_ns = int.from_bytes(data[at:end], "big")
            elif track is not None and id == SAMPLING:
                track.rate = struct.unpack(">d" if size == 8 else ">f", data[at:end])[0]
            elif track is not None and id == CHANNELS:
                track.channels = int.from_bytes(data[at:end], "big")
            elif track is not None and id == BIT_DEPTH:
                track.depth = int.from_bytes(data[at:end], "big")
            elif cue is not None and id == CUE_TIME:
                cue[0] = int.from_bytes(data[at:end], "big") * scale
            elif cue is not None and id == CUE_TRACK:
                cue[1] = int.from_bytes(data[at:end], "big")
            elif cue is not None and id == CUE_CLUSTER:
                cue[2] = segment + int.from_bytes(data[at:end], "big")
                media.cues.append(tuple(cue))
            at = end
    except (ValueError, IndexError, struct.error) as e:
        media.error = str(e) or type(e).__name__
    return media


def store(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, media binary): each whole text as a Matroska file. Null texts are empty;
    repeated rows are stored as often as they occur; an empty table gives an empty one."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or b"" for t in part.column(1).to_pylist()]
        return pa.record_batch(
            [part.column(0).cast(pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([mux(padded(t)) for t in texts], pa.binary())],
            ["doc_id", "n_bytes", "media"],
        )

    rows = pick(docs, id, text).toDF("doc_id", "text").select("doc_id", F.col("text").cast("binary").alias("text"))
    return map_slices(rows, "text", work, "doc_id long, n_bytes long, media binary")


PACKET = "track int, timestamp_ns long, begin long, end long, cluster long, keyframe boolean"
CUE = "time_ns long, track int, cluster long"
TRACK = "track int, kind int, codec string, duration_ns long, rate double, channels int, depth int, stripped binary, compressed boolean, error string"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def _table(stored: DataFrame, media: str, id: str, schema: str, rows_of: Callable[[Media], list[tuple]]) -> DataFrame:
    fields = [c.split() for c in schema.split(", ")]

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        rows, docs = [], []
        for doc, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            found = rows_of(parse(data or b""))
            rows += found
            docs += [doc] * len(found)
        cols = list(zip(*rows)) or [[]] * len(fields)
        return pa.record_batch([pa.array(docs, pa.int64()), *(pa.array(c, _KINDS[k]) for c, (_, k) in zip(cols, fields))], ["doc_id", *(n for n, _ in fields)])

    plain = pick(stored, id, media).toDF("doc_id", "media").select(F.col("doc_id").cast("long").alias("doc_id"), "media")
    return map_slices(plain, "media", work, f"doc_id long, {schema}")


def packets(stored: DataFrame, media: str = "media", id: str = "doc_id") -> DataFrame:
    """A row for each frame: doc_id and PACKET. The byte range is of what is stored; TRACK says
    how it was encoded. Null media and files without frames have none; repeated rows have
    theirs each; an empty table gives an empty one."""
    return _table(stored, media, id, PACKET, lambda m: m.packets)


def cues(stored: DataFrame, media: str = "media", id: str = "doc_id") -> DataFrame:
    """A row for each cue: doc_id and CUE, the cluster as in packets(), so the index leads to
    packets without a walk. Null media, repeated rows and empty tables as there."""
    return _table(stored, media, id, CUE, lambda m: m.cues)


def tracks(stored: DataFrame, media: str = "media", id: str = "doc_id") -> DataFrame:
    """A row for each track: doc_id and TRACK. stripped: bytes that stand before each stored
    frame; error: the file's, as far as it could be read. Null media and the like as above."""

    def rows(m: Media) -> list[tuple]:
        def stripped(t: Track) -> bytes:
            return b"".join(e.settings for e in reversed(t.encodings) if e.scope & 1 and not e.type and e.algorithm == STRIPPED)

        return [
            (t.number, t.kind, t.codec, t.duration_ns, t.rate, t.channels, t.depth, stripped(t), any(e.algorithm != STRIPPED for e in t.encodings), m.error or None)
            for t in m.tracks.values()
        ]

    return _table(stored, media, id, TRACK, rows)


def samples(data: bytes, media: Media, track: int = 1) -> bytes:
    """A track's frames in a row, by the packet table, encodings undone from the last to the first."""
    how = media.tracks[track].encodings if track in media.tracks else []
    frames = [data[a:b] for t, _, a, b, _, _ in media.packets if t == track]
    for encoding in reversed(how):
        frames = [encoding.undo(f) for f in frames]
    return b"".join(frames)


def features(wave: bytes, media: Media) -> str:
    """Packets, duration, mean, deviation, range and sign changes of 8-bit samples around 128."""
    x = np.frombuffer(wave, np.uint8).astype(np.int64) - 128
    n, total, squares = len(x), int(x.sum()), int((x * x).sum())
    if not n:
        return "0"
    turns = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    last = media.packets[-1][1] + FRAME_NS
    spread = (squares * n - total * total) / (n * n)
    return f"packets={len(media.packets)};ns={last};mean={total / n:.6f};var={spread:.6f};min={int(x.min())};max={int(x.max())};turns={turns};cues={len(media.cues)}"


DIGEST = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long,"
    " media_sha256 string, feature string, error string"
)


def digest(stored: DataFrame) -> DataFrame:
    """DIGEST of each stored file, from its bytes: parsed, its frames joined by the packet
    table. error is null for a sound file whose cues all point at clusters. Repeated rows come
    out as often as they came in; an empty table gives an empty result."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc, n, data in zip(*(c.to_pylist() for c in part.columns)):
            media = parse(data)
            try:
                wave = samples(data, media)
            except (ValueError, zlib.error) as e:
                wave, media.error = b"", media.error or str(e)
            places = {p[4] for p in media.packets}
            error = media.error or ("" if {c[2] for c in media.cues} == places else "cues miss clusters")
            out.append((
                doc, n, len(wave), hashlib.sha256(wave).hexdigest(), zlib.crc32(wave[-16:]), len(data),
                hashlib.sha256(data).hexdigest(), features(wave, media), error or None,
            ))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        names = [c.split()[0] for c in DIGEST.split(",")]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return map_slices(stored.select("doc_id", "n_bytes", "media"), "media", work, DIGEST)
