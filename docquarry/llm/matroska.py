"""Matroska media columns: EBML elements, clusters, lacing and cues as tables of packets.

packets() turns a binary column of files into a row per frame with track, timestamp and byte range;
cues() into a row per cue. store() writes texts as files of 8-bit mono samples, and payloads() reads
the samples of any file's track back through its packets. A file is one row, so work is per row and
needs no shuffle; packets leave in batches of bounded size.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

NAME = "op6_matroska"
SQL = None  # SQL can't parse files: exact round trips are tested

# Element ids of the format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION = 0x2AD7B1, 0x4489, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements that end a cluster or segment of unknown size.
TOP = {EBML, SEGMENT}
LEVEL_1 = TOP | {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}
CONTENT_ENCODINGS, ENCRYPTED_BLOCK = 0x6D80, 0xAF
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

#: What store() writes: samples a second, samples of a frame, frames of a block, blocks of a cluster, unit of padding.
RATE, FRAME, BLOCK_FRAMES, CLUSTER_BLOCKS, UNIT = 8000, 1024, 4, 8, 64
PACKET_BATCH = 20_000


class Malformed(ValueError):
    pass


@dataclass
class Packet:
    track: int
    timestamp_ns: int
    keyframe: bool
    lacing: int
    cluster: int  # byte position of its cluster
    start: int
    size: int


@dataclass
class File:
    scale: int = 1_000_000
    tracks: dict[int, dict] = field(default_factory=dict)
    clusters: list[int] = field(default_factory=list)
    packets: list[Packet] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time in ns, track, byte position of the cluster


def read_vint(data: bytes, at: int, end: int, marker: bool = False) -> tuple[int | None, int]:
    """A variable-length integer and the position after it; None if all value bits are set (unknown)."""
    if at >= end or not data[at]:
        raise Malformed(f"no variable-length integer at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise Malformed(f"cut off at byte {at}")
    value = int.from_bytes(data[at : at + width], "big")
    if marker:
        return value, at + width
    value &= (1 << 7 * width) - 1
    return (None if value == (1 << 7 * width) - 1 else value), at + width


def elements(data: bytes, at: int, end: int, stop: set[int] = frozenset()) -> Iterator[tuple[int, int, int, int]]:
    """(id, start of the element, start of its data, end) of a master's children; unknown sizes end before an id of stop."""
    while at < end:
        first = at
        name, at = read_vint(data, at, end, marker=True)
        if name in stop:
            return
        size, at = read_vint(data, at, end)
        if size is None:
            if name not in (SEGMENT, CLUSTER):
                raise Malformed(f"unknown size at byte {first}")
            after = at
            for _, _, _, after in elements(data, at, end, LEVEL_1 if name == CLUSTER else TOP):
                pass
            yield name, first, at, after
            at = after
            continue
        if at + size > end:
            raise Malformed(f"element at byte {first} is cut off")
        yield name, first, at, at + size
        at += size


def block_packets(file: File, data: bytes, at: int, end: int, cluster: int, time: int, keyframe: bool | None) -> None:
    track, at = read_vint(data, at, end)
    if at + 3 > end:
        raise Malformed(f"block at byte {at} is cut off")
    relative, flags = int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2]
    at += 3
    lacing, sizes = flags >> 1 & 3, []
    if lacing != NO_LACING:
        if at >= end:
            raise Malformed(f"no lace count at byte {at}")
        n = data[at] + 1
        at += 1
        if lacing == XIPH:
            for _ in range(n - 1):
                size = 0
                while True:
                    if at >= end:
                        raise Malformed(f"lace sizes are cut off at byte {at}")
                    size += data[at]
                    at += 1
                    if data[at - 1] != 255:
                        break
                sizes.append(size)
        elif lacing == EBML_LACING:
            for k in range(n - 1):
                width = at
                value, at = read_vint(data, at, end)
                if value is None:
                    raise Malformed(f"unknown lace size at byte {width}")
                if k:
                    value += sizes[-1] - ((1 << 7 * (at - width) - 1) - 1)
                if value < 0:
                    raise Malformed(f"negative lace size at byte {width}")
                sizes.append(value)
        else:
            if (end - at) % n:
                raise Malformed(f"{end - at} bytes in {n} equal frames at byte {at}")
            sizes = [(end - at) // n] * (n - 1)
    last = end - at - sum(sizes)
    if last < 0:
        raise Malformed(f"laced frames exceed the block at byte {at}")
    step = file.tracks.get(track, {}).get("default_duration", 0)
    for k, size in enumerate([*sizes, last]):
        file.packets.append(Packet(track, (time + relative) * file.scale + k * step, bool(flags & 0x80) if keyframe is None else keyframe, lacing, cluster, at, size))
        at += size


def parse(data: bytes) -> File:
    """All packets and cues of a file. Raises Malformed if its structure is not whole."""
    file, header = File(), False
    number = lambda a, b: int.from_bytes(data[a:b], "big")
    for name, _, at, end in elements(data, 0, len(data)):
        if name == EBML:
            header = True
        if name != SEGMENT:
            continue
        segment = at
        for child, first, a, b in elements(data, at, end):
            if child == INFO:
                for n, _, x, y in elements(data, a, b):
                    if n == TIMESTAMP_SCALE:
                        file.scale = number(x, y)
            elif child == TRACKS:
                for n, _, x, y in elements(data, a, b):
                    if n == TRACK_ENTRY:
                        entry: dict = {}
                        for m, _, p, q in elements(data, x, y):
                            if m in (TRACK_NUMBER, TRACK_TYPE, DEFAULT_DURATION):
                                entry[{TRACK_NUMBER: "number", TRACK_TYPE: "type", DEFAULT_DURATION: "default_duration"}[m]] = number(p, q)
                            elif m == CONTENT_ENCODINGS:
                                entry["encoded"] = True
                            elif m == CODEC_ID:
                                entry["codec"] = data[p:q].decode("ascii", "replace")
                        file.tracks[entry.get("number", 0)] = entry
            elif child == CLUSTER:
                file.clusters.append(first)
                time = 0
                for n, _, x, y in elements(data, a, b):
                    if n == TIMESTAMP:
                        time = number(x, y)
                    elif n == ENCRYPTED_BLOCK:
                        raise Malformed(f"encrypted block at byte {x}")
                    elif n == SIMPLE_BLOCK:
                        block_packets(file, data, x, y, first, time, None)
                    elif n == BLOCK_GROUP:
                        inner = list(elements(data, x, y))
                        key = all(m != REFERENCE_BLOCK for m, _, _, _ in inner)
                        for m, _, p, q in inner:
                            if m == BLOCK:
                                block_packets(file, data, p, q, first, time, key)
            elif child == CUES:
                for n, _, x, y in elements(data, a, b):
                    if n != CUE_POINT:
                        continue
                    time, places = 0, []
                    for m, _, p, q in elements(data, x, y):
                        if m == CUE_TIME:
                            time = number(p, q)
                        elif m == CUE_TRACK_POSITIONS:
                            parts = {i: number(r, s) for i, _, r, s in elements(data, p, q) if i in (CUE_TRACK, CUE_CLUSTER_POSITION)}
                            places.append((parts.get(CUE_TRACK, 0), parts.get(CUE_CLUSTER_POSITION, 0)))
                    file.cues += [(time * file.scale, track, segment + position) for track, position in places]
    if not header:
        raise Malformed("no EBML header")
    return file


def vint(value: int, width: int = 0) -> bytes:
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(name: int, data: bytes) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + vint(len(data)) + data


def unsigned(name: int, value: int) -> bytes:
    return element(name, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def block(track: int, relative: int, frames: list[bytes], lacing: int) -> bytes:
    """A simple block; frames of different sizes turn fixed lacing into EBML lacing, and one frame needs none."""
    if len(frames) == 1:
        lacing = NO_LACING
    elif lacing == FIXED and len({len(f) for f in frames}) > 1:
        lacing = EBML_LACING
    head = vint(track) + relative.to_bytes(2, "big", signed=True) + bytes([0x80 | lacing << 1])
    if lacing != NO_LACING:
        head += bytes([len(frames) - 1])
    if lacing == XIPH:
        head += b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
    elif lacing == EBML_LACING:
        head += vint(len(frames[0]))
        for before, f in zip(frames, frames[1:-1], strict=False):
            change = len(f) - len(before)
            width = next(w for w in range(1, 9) if abs(change) < (1 << 7 * w - 1) - 1)
            head += vint(change + (1 << 7 * width - 1) - 1, width)
    return element(SIMPLE_BLOCK, head + b"".join(frames))


def write(payload: bytes) -> bytes:
    """A file with the payload as 8-bit mono samples in one track, with clusters, all kinds of lacing, and cues."""
    header = element(EBML, element(DOC_TYPE, b"matroska") + unsigned(DOC_VERSION, 4) + unsigned(DOC_READ_VERSION, 2))
    audio = element(SAMPLING_FREQUENCY, np.array([RATE], ">f4").tobytes()) + unsigned(CHANNELS, 1) + unsigned(BIT_DEPTH, 8)
    entry = unsigned(TRACK_NUMBER, 1) + unsigned(TRACK_UID, 1) + unsigned(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + unsigned(DEFAULT_DURATION, FRAME * 10**9 // RATE) + element(AUDIO, audio)
    info = unsigned(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, np.array([len(payload) * 1000 / RATE], ">f8").tobytes())
    parts = [element(INFO, info), element(TRACKS, element(TRACK_ENTRY, entry))]
    frames = [payload[k : k + FRAME] for k in range(0, len(payload), FRAME)]
    position, points, per_cluster = sum(map(len, parts)), [], BLOCK_FRAMES * CLUSTER_BLOCKS
    for low in range(0, len(frames), per_cluster):
        time = low * FRAME * 1000 // RATE
        blocks = [unsigned(TIMESTAMP, time)]
        for k in range(low, min(len(frames), low + per_cluster), BLOCK_FRAMES):
            kind = (FIXED, XIPH, EBML_LACING)[k // BLOCK_FRAMES % 3]
            blocks.append(block(1, k * FRAME * 1000 // RATE - time, frames[k : k + BLOCK_FRAMES], kind))
        cluster = element(CLUSTER, b"".join(blocks))
        points.append(element(CUE_POINT, unsigned(CUE_TIME, time) + element(CUE_TRACK_POSITIONS, unsigned(CUE_TRACK, 1) + unsigned(CUE_CLUSTER_POSITION, position))))
        parts.append(cluster)
        position += len(cluster)
    parts.append(element(CUES, b"".join(points)))
    return header + element(SEGMENT, b"".join(parts))


def padded(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode()
    return len(data), data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each text's UTF-8, padded with zeros, as a file. Null: as an empty text."""

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                made = [padded(t.as_py()) for t in part.column(1)]
                media = pa.array([write(p) for _, p in made], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in made], pa.int64()), media], ["doc_id", "n_bytes", "media"])

    named = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    return named.mapInArrow(run, f"doc_id {named.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def tables(media: DataFrame, key: str, column: str, names: list[str], kinds: str, rows_of) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            at: list[int] = []
            for i, data in enumerate(batch.column(1)):
                for row in rows_of(data.as_py()):
                    rows.append(row)
                    at.append(i)
                    if len(rows) >= PACKET_BATCH:
                        yield made(batch, at, rows)
                        rows, at = [], []
            yield made(batch, at, rows)

    def made(batch, at, rows):
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        kind = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
        arrays = [pa.array(c, kind[k]) for c, k in zip(columns, kinds.split(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *arrays], [key, *names])

    named = media.select(media[key].alias(key), media[column].alias(column))
    schema = f"{key} {named.schema[key].dataType.simpleString()}, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds.split(), strict=True))
    return named.mapInArrow(run, schema)


def packets(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """A row per frame: key, track, timestamp_ns, keyframe, lacing, cluster, start, size, error.

    start and size are the frame's byte range in the file as stored (a track's content encodings are
    not undone), cluster the position of its cluster. A null file has no rows; one that is not whole or
    encrypted has one row with an error and no packets. Repeated rows give their packets each; an empty
    table gives no rows; other columns are not looked at, whatever their names.
    """

    def rows(data: bytes | None):
        if data is None:
            return
        try:
            for p in parse(data).packets:
                yield p.track, p.timestamp_ns, p.keyframe, p.lacing, p.cluster, p.start, p.size, None
        except Malformed as e:
            yield None, None, None, None, None, None, None, str(e)

    names = ["track", "timestamp_ns", "keyframe", "lacing", "cluster", "start", "size", "error"]
    return tables(media, key, column, names, "long long boolean int long long long string", rows)


def cues(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """A row per cue: key, timestamp_ns, track, cluster (byte position). Files that are null or not whole have none."""

    def rows(data: bytes | None):
        try:
            yield from parse(data).cues if data is not None else ()
        except Malformed:
            return

    return tables(media, key, column, ["timestamp_ns", "track", "cluster"], "long long long", rows)


def feature(file: File, payload: bytes) -> str:
    samples = np.frombuffer(payload, np.uint8)
    kinds = [sum(p.lacing == k for p in file.packets) for k in range(4)]
    end = max((p.timestamp_ns for p in file.packets), default=0) // 1_000_000
    mean, peak = (f"{samples.mean():.4f}", int(samples.max())) if len(samples) else ("none", "none")
    shown = (("packets", len(file.packets)), ("clusters", len(file.clusters)), ("cues", len(file.cues)), ("last_ms", end), ("lacing", "/".join(map(str, kinds))), ("mean", mean), ("peak", peak))
    return ";".join(f"{k}={v}" for k, v in shown)


def played(raw: bytes | None, track: int) -> tuple[bytes | None, str | None, str | None]:
    """payload, feature and error of one file."""
    if raw is None:
        return None, None, "no file"
    try:
        file = parse(raw)
    except Malformed as e:
        return None, None, str(e)
    if file.tracks.get(track, {}).get("encoded"):
        return None, None, f"track {track} has content encodings"
    payload = b"".join([raw[p.start : p.start + p.size] for p in file.packets if p.track == track])
    return payload, feature(file, payload), None


def payloads(media: DataFrame, track: int = 1) -> DataFrame:
    """doc_id, n_bytes, payload, media, feature and error: the frames of a track put together again.

    media is store()'s result or a table with its columns. A null file, one that is not whole or a
    track with content encodings gives null payload and feature, and says why in error (else null).
    Repeated rows are read each; an empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                data, features, errors = zip(*[played(stored.as_py(), track) for stored in part.column(2)], strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(data, pa.binary()), part.column(2), pa.array(features, pa.string()), pa.array(errors, pa.string())], ["doc_id", "n_bytes", "payload", "media", "feature", "error"])

    named = media.select(media["doc_id"].alias("doc_id"), media["n_bytes"].alias("n_bytes"), media["media"].alias("media"))
    return named.mapInArrow(run, f"doc_id {named.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload binary, media binary, feature string, error string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digests(batches):
        sha = lambda column: pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in column], pa.string())
        size = lambda column: pa.array([x.as_buffer().size for x in column], pa.int64())
        for b in batches:
            tails = pa.array([zlib.crc32(memoryview(x.as_buffer())[-UNIT:]) for x in b.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), size(b.column(2)), sha(b.column(2)), tails, size(b.column(3)), sha(b.column(3)), b.column(4)], names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    back = payloads(store(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    kind = back.schema["doc_id"].dataType.simpleString()
    return back.mapInArrow(digests, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
