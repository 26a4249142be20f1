"""Matroska files in binary columns: write PCM tracks, and parse files into packet tables.

The parser walks EBML elements of variable length (unknown sizes included), and lists one packet
per frame: track, timestamp, byte range, cluster, lacing. It reads headers only; payload bytes are
sliced when asked for. It stops at the first byte that is no valid element, keeping what came
before, so truncated files give their whole packets; null or foreign bytes give none.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the Matroska specification: element ids.
EBML, DOC_TYPE, SEGMENT, INFO, TIMESTAMP_SCALE, DURATION = 0x1A45DFA3, 0x4282, 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, DISCARD_PADDING = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x75A2
MASTERS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CUES, CUE_POINT, CUE_TRACK_POSITIONS, CLUSTER, BLOCK_GROUP}
TOP_LEVEL = {INFO, TRACKS, CUES, CLUSTER, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}
NONE, XIPH, FIXED, EBML_LACE = 0, 1, 2, 3

RATE = 8000  #: samples a second; 64 samples are 8 ms, so every frame starts at a whole millisecond
FRAME = 1024  #: samples in a frame
LACED = 8  #: frames in a block
BLOCKS = 8  #: blocks in a cluster; block times are 16-bit offsets to the cluster's


def vint(value: int, width: int = 0) -> bytes:
    """A size or track number, as short as it goes; all ones is kept for 'unknown'."""
    n = max(width, 1)
    while value >= (1 << 7 * n) - 1:
        n += 1
    return (value | 1 << 7 * n).to_bytes(n, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], how: int) -> bytes:
    """Frame count and sizes (the last one follows from the block's), then the frames."""
    if how == NONE:
        return frames[0]
    sizes = [len(f) for f in frames]
    head = bytes([len(frames) - 1])
    if how == XIPH:
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif how == EBML_LACE:
        head += vint(sizes[0])
        for was, s in zip(sizes, sizes[1:-1], strict=False):
            n, d = 1, s - was
            while not -(1 << 7 * n - 1) < d < 1 << 7 * n - 1:
                n += 1
            head += (d + (1 << 7 * n - 1) - 1 | 1 << 7 * n).to_bytes(n, "big")
    elif len(set(sizes)) > 1:
        raise ValueError("fixed lacing needs equal sizes")
    return head + b"".join(frames)


def block(track: int, offset_ms: int, frames: list[bytes], how: int, key: bool = True) -> bytes:
    return vint(track) + struct.pack(">hB", offset_ms, (0x80 if key else 0) | how << 1) + lace(frames, how)


def mux_pcm(payload: bytes, discard: int = 0) -> bytes:
    """A file with one track of 8-bit samples; ``discard``: samples at the end that are padding.

    Equal frames use fixed lacing, a shorter last frame EBML lacing, single frames none. The last
    block is a BlockGroup that carries the padding. Cues point to every cluster.
    """
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    clusters, cues, at = [], [], 0
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">f", RATE)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    at = len(info) + len(tracks)
    step = LACED * BLOCKS
    for first in range(0, len(frames), step):
        start = first * FRAME * 1000 // RATE
        body = [uint(TIMESTAMP, start)]
        for b in range(first, min(first + step, len(frames)), LACED):
            own = frames[b : b + LACED]
            how = NONE if len(own) == 1 else FIXED if len(own[-1]) == FRAME else EBML_LACE
            raw = block(1, b * FRAME * 1000 // RATE - start, own, how)
            last = b + LACED >= len(frames)
            body.append(element(BLOCK_GROUP, element(BLOCK, raw) + element(DISCARD_PADDING, (discard * 1_000_000_000 // RATE).to_bytes(8, "big", signed=True))) if last and discard else element(SIMPLE_BLOCK, raw))
        clusters.append(element(CLUSTER, b"".join(body)))
        cues.append((start, at))
        at += len(clusters[-1])
    index = element(CUES, b"".join(element(CUE_POINT, uint(CUE_TIME, t) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, p))) for t, p in cues))
    return element(EBML, element(DOC_TYPE, b"matroska")) + element(SEGMENT, info + tracks + b"".join(clusters) + index)


@dataclass
class Parsed:
    """What a file holds. packets: (track, timestamp ns, offset, size, cluster, lacing, keyframe)."""

    doc_type: str = ""
    scale: int = 1_000_000
    tracks: list[dict] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  #: (time ns, track, byte offset of the cluster)
    clusters: list[int] = field(default_factory=list)
    packets: list[tuple[int, int, int, int, int, int, bool]] = field(default_factory=list)
    discard_ns: int = 0


class _Bad(ValueError):
    pass


def read_vint(data: bytes, at: int, end: int, keep_marker: bool = False) -> tuple[int | None, int]:
    """Value and next place; None: unknown (all ones)."""
    if at >= end or not data[at]:
        raise _Bad("no vint")
    n = 9 - data[at].bit_length()
    if at + n > end:
        raise _Bad("cut off")
    raw = int.from_bytes(data[at : at + n], "big")
    if keep_marker:
        return raw, at + n
    value = raw ^ 1 << 7 * n
    return (None if value == (1 << 7 * n) - 1 else value), at + n


def _frames(data: bytes, at: int, end: int, how: int) -> list[tuple[int, int]]:
    """(offset, size) of each frame in a block's body."""
    if how == NONE:
        return [(at, end - at)]
    if at >= end:
        raise _Bad("no lace")
    n, sizes = data[at] + 1, []
    at += 1
    if how == FIXED:
        if (end - at) % n:
            raise _Bad("uneven")
        return [(at + i * ((end - at) // n), (end - at) // n) for i in range(n)]
    for i in range(n - 1):
        if how == XIPH:
            size = 0
            while at < end and data[at] == 255:
                size, at = size + 255, at + 1
            if at >= end:
                raise _Bad("cut off")
            size, at = size + data[at], at + 1
        else:
            value, after = read_vint(data, at, end)
            if value is None:
                value = (1 << 7 * (after - at)) - 1
            size = value if i == 0 else sizes[-1] + value - ((1 << 7 * (after - at) - 1) - 1)
            at = after
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise _Bad("sizes")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def parse(data: bytes | None) -> Parsed:
    out = Parsed()
    if not data:
        return out
    own = {"track": {}, "cue": [0, 0, None], "time": 0, "segment": 0}
    marks: list[tuple[int, int, int]] = []  # per packet so far in ticks; scaled at the end

    def number(at: int, end: int) -> int:
        return int.from_bytes(data[at:end], "big")

    def blocks(at: int, end: int, simple: bool) -> None:
        track, at = read_vint(data, at, end)
        if at + 3 > end:
            raise _Bad("cut off")
        offset, flags = struct.unpack_from(">hB", data, at)
        how = flags >> 1 & 3
        for i, (start, size) in enumerate(_frames(data, at + 3, end, how)):
            marks.append((own["time"] + offset, i, 0))
            out.packets.append((track or 0, 0, start, size, len(out.clusters) - 1, how, bool(flags & 0x80) or not simple))

    def walk(at: int, end: int, inside: int) -> int:
        while at < end:
            ident, body = read_vint(data, at, end, True)
            if inside == CLUSTER and ident in TOP_LEVEL:
                return at  # the end of a cluster of unknown size
            size, body = read_vint(data, body, end)
            stop = end if size is None else body + size
            if stop > end:
                if ident not in MASTERS:
                    raise _Bad("cut off")
                stop = end
            if ident == SEGMENT:
                own["segment"] = body
            elif ident == CLUSTER:
                out.clusters.append(at)
            elif ident == TRACK_ENTRY:
                own["track"] = {}
                out.tracks.append(own["track"])
            elif ident == CUE_POINT:
                own["cue"] = [0, 0, None]
            if ident in MASTERS or ident == EBML:
                at = walk(body, stop, ident)
                if ident == CUE_TRACK_POSITIONS and own["cue"][2] is not None:
                    out.cues.append((own["cue"][0], own["cue"][1], own["segment"] + own["cue"][2]))
                at = at if size is None else stop
                continue
            if ident == SIMPLE_BLOCK or ident == BLOCK:
                blocks(body, stop, ident == SIMPLE_BLOCK)
            elif ident == TIMESTAMP:
                own["time"] = number(body, stop)
            elif ident == TIMESTAMP_SCALE:
                out.scale = number(body, stop)
            elif ident == DISCARD_PADDING:
                out.discard_ns = int.from_bytes(data[body:stop], "big", signed=True)
            elif ident == DOC_TYPE:
                out.doc_type = data[body:stop].rstrip(b"\0").decode("ascii", "replace")
            elif ident in (TRACK_NUMBER, TRACK_TYPE, CHANNELS, BIT_DEPTH):
                own["track"][{TRACK_NUMBER: "number", TRACK_TYPE: "type", CHANNELS: "channels", BIT_DEPTH: "bits"}[ident]] = number(body, stop)
            elif ident == CODEC_ID:
                own["track"]["codec"] = data[body:stop].decode("ascii", "replace")
            elif ident == SAMPLING_FREQUENCY and stop - body in (4, 8):
                own["track"]["rate"] = struct.unpack(">f" if stop - body == 4 else ">d", data[body:stop])[0]
            elif ident == CUE_TIME:
                own["cue"][0] = number(body, stop)
            elif ident == CUE_TRACK:
                own["cue"][1] = number(body, stop)
            elif ident == CUE_CLUSTER_POSITION:
                own["cue"][2] = number(body, stop)
            at = stop
        return at

    try:
        walk(0, len(data), 0)
    except (_Bad, RecursionError):
        pass
    rates = {t.get("number"): t.get("rate", 0) * t.get("channels", 1) * t.get("bits", 0) / 8 for t in out.tracks}
    done, at_block = [], None
    for (ticks, i, _), p in zip(marks, out.packets, strict=True):
        at_block = ticks * out.scale if i == 0 else at_block
        done.append((p[0], round(at_block), *p[2:]))
        per_s = rates.get(p[0]) or 0
        at_block += p[3] * 1_000_000_000 / per_s if per_s else 0  # laced frames follow each other
    out.packets = done
    out.cues = [(t * out.scale, track, place) for t, track, place in out.cues]
    return out


def padded(text: str | None, unit: int = 64) -> tuple[bytes, int]:
    """UTF-8 bytes with zeros up to a positive multiple of ``unit``, and their number without."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(unit, -(-len(raw) // unit) * unit), b"\0"), len(raw)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, media binary)``: every whole text as 8-bit samples of a Matroska file. Null: empty."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                files = []
                for text in part.column(1).to_pylist():
                    payload, n = padded(text)
                    files.append(mux_pcm(payload, len(payload) - n))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(files, pa.binary())], ["doc_id", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, media binary")


PACKETS = "doc_id long, packet int, track int, timestamp_ns long, offset long, size long, cluster int, lacing int, keyframe boolean"


def packets(files: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """The packet table of a column of files: one row per frame."""

    def run(batches):
        for batch in batches:
            for ident, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(ident, i, *p) for i, p in enumerate(parse(data.as_py()).packets)]
                if rows:
                    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in PACKETS.split(", ")])

    return files.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(run, PACKETS)


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_packets int, n_clusters int, n_cues int"


def read_back(data: bytes | None) -> tuple:
    """Features of a stored file, all from its bytes: sizes, digests, packets and the signal's shape.

    ``feature``: duration in ms, mean and root mean square of the samples around 128 (in
    thousandths), and how often neighbours lie on different sides of 128.
    """
    found = parse(data)
    payload = b"".join(data[p[2] : p[2] + p[3]] for p in found.packets)
    samples = np.frombuffer(payload, dtype=np.uint8)
    total = int(samples.sum(dtype=np.int64)) - 128 * len(samples)
    square = int(np.square(samples.astype(np.int16) - 128, dtype=np.int32).sum(dtype=np.int64))
    crossings = int(np.count_nonzero((samples[1:] ^ samples[:-1]) & 128))
    n = max(1, len(samples))
    feature = f"{len(samples) * 1000 // RATE}ms mean={total * 1000 // n} rms={int((square * 1_000_000 // n) ** 0.5)} crossings={crossings}"
    return (len(payload) - found.discard_ns * RATE // 1_000_000_000, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data or b""), hashlib.sha256(data or b"").hexdigest(), feature, len(found.packets), len(found.clusters), len(found.cues))


def digests(files: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = [(i, *read_back(m.as_py())) for i, m in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
            fields = [f.split() for f in DIGESTS.split(", ")]
            kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}
            cols = list(zip(*rows, strict=True)) or [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], [n for n, _ in fields])

    return files.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(run, DIGESTS)
