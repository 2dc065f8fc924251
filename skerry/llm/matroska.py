"""Media columns: Matroska files to packet tables.

:func:`packets` parses the variable-length EBML elements of a file (unknown sizes, nested masters,
both kinds of blocks, and the Xiph, EBML and fixed lacings) to one record per frame: track,
timestamp, key frame, and the byte range of the frame in the file.  :func:`cues` gives the index.
:func:`mux` writes one track of 8-bit samples as a file, losslessly.

A block's timestamp is that of its first frame.  The others follow at the block's duration divided by
its frames, else at the track's default duration; without either they share the block's timestamp.
``timestamp`` counts ticks of the file's timestamp scale, ``time_ns`` nanoseconds.

Defined results: a null text counts as empty; the payload of an empty text is 192 spaces; repeated
rows give equal values; an empty table gives an empty result; a damaged file raises ``ValueError``
in :func:`packets` and :func:`cues` (rows of :func:`packet_table` then carry it in ``error``); a file
without frames, or without bytes, has no rows in :func:`packet_table`; further columns are ignored; a text
or file of any length is worked on as a whole, within a task's memory.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm import _arrow

# Element identifiers of the format, with their length markers.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0x23E383
AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER, CUE_RELATIVE = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1, 0xF0
MASTERS = frozenset((EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS))
#: Elements that end a cluster or segment of unknown size.
TOP = frozenset((CLUSTER, CUES, TRACKS, INFO, SEGMENT, EBML))

FRAME = 192
RATE = 48_000
FRAMES_PER_BLOCK = 8
BLOCKS_PER_CLUSTER = 32


def _id(number: int) -> bytes:
    return number.to_bytes((number.bit_length() + 7) // 8, "big")


def _size(number: int, width: int = 0) -> bytes:
    """A size as a variable-length number; all ones are kept for sizes that aren't known."""
    width = width or next(w for w in range(1, 9) if number < (1 << 7 * w) - 1)
    return (number | 1 << 7 * width).to_bytes(width, "big")


def _element(number: int, body: bytes) -> bytes:
    return _id(number) + _size(len(body)) + body


def _uint(number: int, value: int) -> bytes:
    return _element(number, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _lace_sizes(sizes: list[int], lacing: int) -> bytes:
    if lacing == 1:  # Xiph
        return b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    if lacing == 3:  # EBML: the first size, then signed differences
        out = _size(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
            out += _size(b - a + (1 << 7 * width - 1) - 1, width)
        return out
    return b""


def block_body(track: int, relative: int, frames: list[bytes], lacing: int, key: bool = True) -> bytes:
    flags = (0x80 if key else 0) | lacing << 1
    head = _size(track) + relative.to_bytes(2, "big", signed=True) + bytes([flags])
    if not lacing:
        return head + frames[0]
    return head + bytes([len(frames) - 1]) + _lace_sizes([len(f) for f in frames], lacing) + b"".join(frames)


def mux(payload: bytes, frame: int = FRAME) -> bytes:
    """One audio track of 8-bit samples; ``payload`` is a positive multiple of ``frame``."""
    header = _element(EBML, b"".join((
        _uint(EBML_VERSION, 1), _uint(EBML_READ_VERSION, 1), _uint(EBML_MAX_ID, 4), _uint(EBML_MAX_SIZE, 8),
        _element(DOC_TYPE, b"matroska"), _uint(DOC_TYPE_VERSION, 4), _uint(DOC_TYPE_READ_VERSION, 2),
    )))
    ticks = 1000 * frame // RATE  # milliseconds of a frame
    frames = [payload[k : k + frame] for k in range(0, len(payload), frame)]
    info = _element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + _element(MUXING_APP, b"skerry") + _element(WRITING_APP, b"skerry"))
    audio = _element(AUDIO, _element(SAMPLING, np.array(RATE, dtype=">f8").tobytes()) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))
    tracks = _element(TRACKS, _element(TRACK_ENTRY, b"".join((
        _uint(TRACK_NUMBER, 1), _uint(TRACK_UID, 1), _uint(TRACK_TYPE, 2), _uint(FLAG_LACING, 1), _uint(DEFAULT_DURATION, 1_000_000_000 * frame // RATE),
        _element(CODEC_ID, b"A_PCM/INT/LIT"), audio,
    ))))
    at, clusters, points = len(info) + len(tracks), [], []
    for c in range(0, len(frames), FRAMES_PER_BLOCK * BLOCKS_PER_CLUSTER):
        start = c * ticks
        stamp = _uint(TIMESTAMP, start)
        blocks = []
        for k, b in enumerate(range(c, min(len(frames), c + FRAMES_PER_BLOCK * BLOCKS_PER_CLUSTER), FRAMES_PER_BLOCK)):
            group = frames[b : b + FRAMES_PER_BLOCK]
            lacing = 0 if len(group) == 1 else (2, 1, 3)[k % 3]
            blocks.append(_element(SIMPLE_BLOCK, block_body(1, b * ticks - start, group, lacing)))
        body = _element(CLUSTER, stamp + b"".join(blocks))
        positions = _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at) + _uint(CUE_RELATIVE, len(stamp))
        points.append(_element(CUE_POINT, _uint(CUE_TIME, start) + _element(CUE_POSITIONS, positions)))
        clusters.append(body)
        at += len(body)
    return header + _element(SEGMENT, info + tracks + b"".join(clusters) + _element(CUES, b"".join(points)))


def vint(data: bytes, at: int, keep_marker: bool) -> tuple[int, int]:
    """(number, position after it) of the variable-length number at ``at``; -1 for an unknown size."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length number at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"the number at byte {at} is cut off")
    number = int.from_bytes(data[at : at + width], "big")
    if keep_marker:
        return number, at + width
    number &= (1 << 7 * width) - 1
    return (-1 if number == (1 << 7 * width) - 1 else number), at + width


def elements(data: bytes, start: int, stop: int) -> Iterator[tuple[int, int, int, int]]:
    """(identifier, first byte, first body byte, end) of the elements between two positions."""
    at = start
    while at < stop:
        number, body = vint(data, at, True)
        size, body = vint(data, body, False)
        if size < 0:
            end = _open_end(data, number, body, stop)
        else:
            end = body + size
        if end > stop:
            raise ValueError(f"the element at byte {at} ends after its parent")
        yield number, at, body, end
        at = end


def _open_end(data: bytes, number: int, body: int, stop: int) -> int:
    """Where an element of unknown size ends: before the next one that can't be its child."""
    ends = TOP if number == CLUSTER else frozenset((SEGMENT, EBML))
    at = body
    while at < stop:
        child, inner = vint(data, at, True)
        if child in ends:
            return at
        size, inner = vint(data, inner, False)
        at = inner + size if size >= 0 else _open_end(data, child, inner, stop)
    return stop


@dataclass(frozen=True)
class Packet:
    track: int
    timestamp: int
    key: bool
    lacing: int
    start: int
    size: int
    time_ns: int = 0


def _frames(data: bytes, body: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """(track, relative time, flags, frame ranges) of a block."""
    track, at = vint(data, body, False)
    if at + 3 > end:
        raise ValueError(f"the block at byte {body} is cut off")
    relative = int.from_bytes(data[at : at + 2], "big", signed=True)
    flags = data[at + 2]
    lacing, at = flags >> 1 & 3, at + 3
    if not lacing:
        return track, relative, flags, [(at, end - at)]
    if at >= end:
        raise ValueError(f"the block at byte {body} is cut off")
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == 2:
        if (end - at) % count:
            raise ValueError(f"fixed lacing doesn't divide the block at byte {body}")
        sizes = [(end - at) // count] * (count - 1)
    elif lacing == 1:
        for _ in range(count - 1):
            size = 0
            while at < end and data[at] == 255:
                size, at = size + 255, at + 1
            if at >= end:
                raise ValueError(f"the lace sizes at byte {body} are cut off")
            sizes.append(size + data[at])
            at += 1
    elif count > 1:
        size, at = vint(data, at, False)
        sizes.append(size)
        for _ in range(count - 2):
            before = at
            number, at = vint(data, at, False)
            width = at - before
            if number < 0:
                number = (1 << 7 * width) - 1
            sizes.append(sizes[-1] + number - ((1 << 7 * width - 1) - 1))
    left = end - at - sum(sizes)
    if left < 0 or min(sizes, default=0) < 0:
        raise ValueError(f"the laces of the block at byte {body} are larger than it")
    ranges = []
    for size in [*sizes, left]:
        ranges.append((at, size))
        at += size
    return track, relative, flags, ranges


SCALE = 1_000_000  # nanoseconds of a tick where the file doesn't say


def _number(data: bytes, start: int, stop: int) -> int:
    return int.from_bytes(data[start:stop], "big")


def _timing(data: bytes, body: int, end: int) -> tuple[int, dict[int, int]]:
    """(nanoseconds of a tick, default duration of each track in nanoseconds) of a segment."""
    scale, durations = SCALE, {}
    for number, _, first, last in elements(data, body, end):
        if number == INFO:
            for child, _, a, b in elements(data, first, last):
                scale = (_number(data, a, b) or SCALE) if child == TIMESTAMP_SCALE else scale
        elif number == TRACKS:
            for child, _, a, b in elements(data, first, last):
                if child == TRACK_ENTRY:
                    entry = {k: _number(data, x, y) for k, _, x, y in elements(data, a, b) if k in (TRACK_NUMBER, DEFAULT_DURATION)}
                    if TRACK_NUMBER not in entry:
                        raise ValueError(f"the track at byte {a} has no number")
                    durations[entry[TRACK_NUMBER]] = entry.get(DEFAULT_DURATION, 0)
    return scale, durations


def packets(data: bytes) -> list[Packet]:
    """The frames of all tracks in file order."""
    out: list[Packet] = []

    def block(body: int, end: int, cluster: int, key: bool | None, total: int | None) -> None:
        track, relative, flags, ranges = _frames(data, body, end)
        key_frame = bool(flags & 0x80) if key is None else key
        each, parts = (total * scale, len(ranges)) if total is not None else (durations.get(track, 0), 1)  # nanoseconds of so many frames
        start = (cluster + relative) * scale
        for k, (a, n) in enumerate(ranges):
            later = k * each // parts
            out.append(Packet(track, cluster + relative + later // scale, key_frame, flags >> 1 & 3, a, n, start + later))

    for top, _, body, end in elements(data, 0, len(data)):
        if top != SEGMENT:
            continue
        scale, durations = _timing(data, body, end)
        for number, _, first, last in elements(data, body, end):
            if number != CLUSTER:
                continue
            stamp = 0
            for child, _, a, b in elements(data, first, last):
                if child == TIMESTAMP:
                    stamp = _number(data, a, b)
                elif child == SIMPLE_BLOCK:
                    block(a, b, stamp, None, None)
                elif child == BLOCK_GROUP:
                    inner = {k: (x, y) for k, _, x, y in elements(data, a, b)}
                    if BLOCK in inner:
                        total = _number(data, *inner[BLOCK_DURATION]) if BLOCK_DURATION in inner else None
                        block(*inner[BLOCK], stamp, REFERENCE not in inner, total)
    return out


def cues(data: bytes) -> list[tuple[int, int, int]]:
    """(time, track, cluster's first byte in the file) of the index: one for each position of each point."""
    out = []
    for top, _, body, end in elements(data, 0, len(data)):
        if top != SEGMENT:
            continue
        for number, _, first, last in elements(data, body, end):
            if number != CUES:
                continue
            for child, at, a, b in elements(data, first, last):
                if child != CUE_POINT:
                    continue
                parts = [(k, x, y) for k, _, x, y in elements(data, a, b)]
                times = [_number(data, x, y) for k, x, y in parts if k == CUE_TIME]
                positions = [{k: _number(data, x, y) for k, _, x, y in elements(data, *p[1:])} for p in parts if p[0] == CUE_POSITIONS]
                if not times or not positions or any(CUE_TRACK not in p or CUE_CLUSTER not in p for p in positions):
                    raise ValueError(f"the cue point at byte {at} lacks its time, track or cluster")
                out += [(times[0], p[CUE_TRACK], body + p[CUE_CLUSTER]) for p in positions]
    return out


PACKET_SCHEMA = "file_id long, packet int, track int, timestamp long, key boolean, lacing int, start long, size long, time_ns long, error string"


def packet_table(files: DataFrame, *, id_col: str = "file_id", data_col: str = "data") -> DataFrame:
    """One row per frame of each file (a binary column); a damaged file gives one row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        names = [c.split()[0] for c in PACKET_SCHEMA.split(", ")]
        for part, texts in _arrow.text_slices(batches, "data"):
            for file_id, data in zip(part.column("file_id").to_pylist(), texts):
                try:
                    rows = [(file_id, k, p.track, p.timestamp, p.key, p.lacing, p.start, p.size, p.time_ns, None) for k, p in enumerate(packets(data))]
                except ValueError as error:
                    rows = [(file_id, *[None] * 8, str(error))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return files.select(F.col(id_col).cast("long").alias("file_id"), F.col(data_col).alias("data")).mapInArrow(run, PACKET_SCHEMA)


def padded(text: bytes, unit: int = FRAME) -> bytes:
    """The text with spaces up to a positive multiple of ``unit`` bytes."""
    return text + b" " * (-len(text) % unit if text else unit)


def features(data: bytes, found: list[Packet]) -> tuple[bytes, str]:
    """(payload read back through the packets, its features)."""
    payload = b"".join([data[p.start : p.start + p.size] for p in found])
    samples = np.frombuffer(payload, dtype=np.uint8).astype(np.int64)
    middle = samples - 128
    crossings = int(np.count_nonzero((middle[1:] >= 0) != (middle[:-1] >= 0)))
    loud = [int((middle[k : k + FRAME] ** 2).sum()) for k in (0, max(0, len(middle) - FRAME))]
    seen = {
        "packets": len(found), "tracks": len({p.track for p in found}), "ms": found[-1].timestamp if found else 0, "cues": len(cues(data)),
        "sum": int(samples.sum()), "energy": int((middle**2).sum()), "crossings": crossings, "first": loud[0], "last": loud[1],
        "spread": int(np.count_nonzero(np.bincount(samples, minlength=256))),
    }
    return payload, json.dumps(seen, separators=(",", ":"))


MEDIA_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary"


def media_columns(docs: DataFrame, *, id_col="doc_id", text_col="text", with_media: bool = True) -> DataFrame:
    """Store each text as a Matroska file, read it back, and describe what was read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _arrow.text_slices(batches):
            rows = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), texts):
                media = mux(padded(text))
                payload, feature = features(media, packets(media))
                rows.append((
                    doc_id, len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media),
                    hashlib.sha256(media).hexdigest(), feature, media if with_media else None,
                ))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[c.split()[0] for c in MEDIA_SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, MEDIA_SCHEMA)
