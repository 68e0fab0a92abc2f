"""Matroska media columns: payloads stored as 8-bit audio in Matroska, and parsed back into packet tables.

The writer makes a plain audio file: EBML header, a segment with info, one PCM
track of 8-bit samples, clusters of laced simple blocks, and cues. The parser
takes any file of that structure: variable-length ids and sizes (unknown sizes
of segments and clusters too), simple blocks and block groups, Xiph, EBML and
fixed lacing, several tracks, and cues; elements it does not know are passed by.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bytewords import parts

# Element ids of the Matroska specification (fixed values).
EBML, EBML_VERSION, EBML_READ, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, SCALE, DURATION, MUXER, WRITER = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK, NUMBER, TRACK_UID, KIND, CODEC, AUDIO, RATE, CHANNELS, DEPTH, LACING = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264, 0x9C
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

RATE_HZ = 8000
#: Samples in a frame, frames in a block, blocks in a cluster. A frame lasts 32 ms, so a cluster's times fit its blocks' 16 bits.
FRAME, FRAMES, BLOCKS = 256, 16, 32


def number(value: int) -> bytes:
    return value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big")


def size_bytes(value: int) -> bytes:
    """An EBML size in as few bytes as hold it (all ones is kept for unknown)."""
    width = 1
    while value >= (1 << 7 * width) - 1:
        width += 1
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(kind: int, data: bytes) -> bytes:
    return number(kind) + size_bytes(len(data)) + data


def laced_block(track: int, time: int, frames: list[bytes]) -> bytes:
    """A simple block's data; several frames are laced, equal ones by fixed lacing and others by EBML lacing."""
    equal = len({len(f) for f in frames}) == 1
    flags = 0x80 | (0 if len(frames) == 1 else 0x04 if equal else 0x06)
    out = [size_bytes(track), struct.pack(">hB", time, flags)]
    if len(frames) > 1:
        out.append(bytes([len(frames) - 1]))
        if not equal:
            sizes = [len(f) for f in frames]
            out.append(size_bytes(sizes[0]))
            for a, b in zip(sizes, sizes[1:-1]):
                d, width = b - a, 1
                while not -((1 << 7 * width - 1) - 1) <= d <= (1 << 7 * width - 1) - 1:
                    width += 1
                out.append((d + (1 << 7 * width - 1) - 1 | 1 << 7 * width).to_bytes(width, "big"))
    return b"".join([*out, *frames])


def mux(payload: bytes, rate: int = RATE_HZ) -> bytes:
    """A Matroska file whose one track holds payload as unsigned 8-bit samples."""
    head = element(EBML, b"".join([
        element(EBML_VERSION, b"\x01"), element(EBML_READ, b"\x01"), element(EBML_MAX_ID, b"\x04"), element(EBML_MAX_SIZE, b"\x08"),
        element(DOC_TYPE, b"matroska"), element(DOC_VERSION, b"\x04"), element(DOC_READ, b"\x02"),
    ]))
    info = element(INFO, element(SCALE, number(1_000_000)) + element(DURATION, struct.pack(">d", len(payload) * 1000 / rate)) + element(MUXER, b"tonespark") + element(WRITER, b"tonespark"))
    audio = element(AUDIO, element(RATE, struct.pack(">d", rate)) + element(CHANNELS, b"\x01") + element(DEPTH, b"\x08"))
    track = element(TRACK, element(NUMBER, b"\x01") + element(TRACK_UID, b"\x01") + element(KIND, b"\x02") + element(LACING, b"\x01") + element(CODEC, b"A_PCM/INT/LIT") + audio)
    parts = [info, element(TRACKS, track)]
    at, cues, per_cluster, per_block = sum(map(len, parts)), [], FRAME * FRAMES * BLOCKS, FRAME * FRAMES
    view = memoryview(payload)
    for c in range(0, len(payload), per_cluster):
        start = c * 1000 // rate
        blocks = [element(TIMESTAMP, number(start))]
        for b in range(c, min(c + per_cluster, len(payload)), per_block):
            frames = [bytes(view[i : min(i + FRAME, len(payload))]) for i in range(b, min(b + per_block, len(payload)), FRAME)]
            blocks.append(element(SIMPLE_BLOCK, laced_block(1, b * 1000 // rate - start, frames)))
        cues.append(element(CUE_POINT, element(CUE_TIME, number(start)) + element(CUE_POSITIONS, element(CUE_TRACK, b"\x01") + element(CUE_CLUSTER, number(at)))))
        parts.append(element(CLUSTER, b"".join(blocks)))
        at += len(parts[-1])
    parts.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(parts))


@dataclass
class Packet:
    """One frame: its track, time in nanoseconds, byte range in the file, place in its lace, and whether it is a key frame."""

    track: int
    time_ns: int
    start: int
    size: int
    cluster: int
    lace: int
    lacing: str
    key: bool


@dataclass
class Movie:
    packets: list[Packet] = field(default_factory=list)
    tracks: list[dict] = field(default_factory=list)
    cues: list[dict] = field(default_factory=list)
    scale_ns: int = 1_000_000
    clusters: list[int] = field(default_factory=list)
    segment: int = 0


#: Elements whose content is more elements, read in the same loop.
PARENTS = {SEGMENT, CLUSTER, BLOCK_GROUP, TRACKS, TRACK, AUDIO, CUES, CUE_POINT, CUE_POSITIONS, INFO}


def vint(data, at: int, keep_marker: bool) -> tuple[int, int, bool]:
    """(value, next position, all ones) of the variable-length integer at `at`."""
    first = data[at] if at < len(data) else 0
    width = 9 - first.bit_length()
    if not 1 <= width <= 8 or at + width > len(data):
        raise ValueError(f"no variable-length integer at byte {at}")
    raw = int.from_bytes(data[at : at + width], "big")
    value = raw & (1 << 7 * width) - 1
    return raw if keep_marker else value, at + width, value == (1 << 7 * width) - 1


def frames_of(data, at: int, end: int) -> tuple[int, int, int, str, list[tuple[int, int]]]:
    """track, relative time, flags, lacing and byte ranges of a block's data."""
    track, at, _ = vint(data, at, False)
    time, flags = struct.unpack_from(">hB", data, at)
    at += 3
    lacing = ("none", "xiph", "fixed", "ebml")[flags >> 1 & 3]
    if lacing == "none":
        return track, time, flags, lacing, [(at, end - at)]
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == "fixed":
        if (end - at) % n:
            raise ValueError("fixed lacing with unequal frames")
        sizes = [(end - at) // n] * n
    elif lacing == "xiph":
        for _ in range(n - 1):
            total = 0
            while data[at] == 255:
                total, at = total + 255, at + 1
            sizes.append(total + data[at])
            at += 1
    elif n > 1:
        first, at, _ = vint(data, at, False)
        sizes.append(first)
        for _ in range(n - 2):
            before = at
            raw, at, _ = vint(data, at, False)
            sizes.append(sizes[-1] + raw - ((1 << 7 * (at - before) - 1) - 1))
    if lacing != "fixed":
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lace sizes pass the block's end")
    out = []
    for s in sizes:
        out.append((at, s))
        at += s
    return track, time, flags, lacing, out


def demux(data: bytes) -> Movie:
    """Parse a Matroska file. Raises ValueError where it is damaged."""
    movie, now = Movie(), 0
    stack: list[tuple[int, int]] = []  # (kind, end) of open parents
    at = 0
    try:
        while at < len(data):
            while stack and at >= stack[-1][1]:
                stack.pop()
            begun = at
            kind, at, _ = vint(data, at, True)
            size, at, unknown = vint(data, at, False)
            end = len(data) if unknown else at + size
            if unknown and kind not in (SEGMENT, CLUSTER) or end > len(data):
                raise ValueError(f"element {kind:x} passes the file's end")
            while stack and stack[-1][0] == CLUSTER and kind in (CLUSTER, CUES, TRACKS, INFO):
                stack.pop()  # a cluster of unknown size ends where its sibling begins
            if kind in PARENTS:
                stack.append((kind, end))
                if kind == SEGMENT:
                    movie.segment = at
                elif kind == CLUSTER:
                    movie.clusters.append(begun)
                elif kind == TRACK:
                    movie.tracks.append({})
                elif kind == CUE_POINT:
                    movie.cues.append({})
                continue
            if kind in (SIMPLE_BLOCK, BLOCK):
                track, time, flags, lacing, spans = frames_of(data, at, end)
                movie.packets += [
                    Packet(track, (now + time) * movie.scale_ns, s, n, len(movie.clusters) - 1, i, lacing, bool(flags & 0x80) or kind == BLOCK) for i, (s, n) in enumerate(spans)
                ]
            elif kind == TIMESTAMP:
                now = int.from_bytes(data[at:end], "big")
            elif kind == SCALE:
                movie.scale_ns = int.from_bytes(data[at:end], "big")
            elif kind in (NUMBER, KIND, CHANNELS, DEPTH) and movie.tracks:
                movie.tracks[-1][{NUMBER: "number", KIND: "kind", CHANNELS: "channels", DEPTH: "depth"}[kind]] = int.from_bytes(data[at:end], "big")
            elif kind == RATE and movie.tracks:
                movie.tracks[-1]["rate"] = struct.unpack(">d" if end - at == 8 else ">f", data[at:end])[0]
            elif kind == CODEC and movie.tracks:
                movie.tracks[-1]["codec"] = bytes(data[at:end]).decode()
            elif kind in (CUE_TIME, CUE_TRACK, CUE_CLUSTER) and movie.cues:
                movie.cues[-1][{CUE_TIME: "time", CUE_TRACK: "track", CUE_CLUSTER: "cluster"}[kind]] = int.from_bytes(data[at:end], "big")
            at = end
    except (IndexError, struct.error) as broken:
        raise ValueError(f"damaged file near byte {at}") from broken
    return movie


def track_bytes(data: bytes, movie: Movie, track: int = 1) -> bytes:
    """A track's frames one after another."""
    return b"".join([data[p.start : p.start + p.size] for p in movie.packets if p.track == track])


def padded(raw: bytes, unit: int = 64) -> bytes:
    """raw with zero bytes up to a positive multiple of unit."""
    return raw + bytes(-len(raw) % unit or (0 if raw else unit))


def media(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) as media: doc_id, n_bytes (of the text) and media (binary). Null texts are empty; every text gets a file; rows repeat as often as in docs; an empty table gives no rows; other columns are ignored."""

    def rows(batch_iter):
        for batch in batch_iter:
            doc_ids, texts = batch.column("doc_id"), batch.column("text")
            for lo, hi in parts(texts, 4_000_000):
                raw = [(t or "").encode() for t in texts.slice(lo, hi - lo).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(lo, hi - lo), pa.array([len(b) for b in raw], pa.int64()), pa.array([mux(padded(b)) for b in raw], pa.binary())], ["doc_id", "n_bytes", "media"]
                )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(rows, "doc_id long, n_bytes long, media binary")


PACKETS = "doc_id long, packet int, track int, time_ns long, start long, size long, cluster int, lace int, lacing string, key boolean"


def packets(media_rows: DataFrame) -> DataFrame:
    """The packet table of media_rows (doc_id, media): a row for each frame. Null media give no rows; damaged files raise."""

    def rows(batch_iter):
        for batch in batch_iter:
            for d, data in zip(batch.column("doc_id").to_pylist(), batch.column("media")):
                if data.is_valid:
                    found = demux(data.as_buffer().to_pybytes()).packets
                    yield pa.RecordBatch.from_pylist(
                        [{"doc_id": d, "packet": i, "track": p.track, "time_ns": p.time_ns, "start": p.start, "size": p.size, "cluster": p.cluster, "lace": p.lace, "lacing": p.lacing, "key": p.key} for i, p in enumerate(found)],
                        pa.schema([("doc_id", pa.int64()), ("packet", pa.int32()), ("track", pa.int32()), ("time_ns", pa.int64()), ("start", pa.int64()), ("size", pa.int64()), ("cluster", pa.int32()), ("lace", pa.int32()), ("lacing", pa.string()), ("key", pa.bool_())]),
                    )

    return media_rows.select("doc_id", "media").mapInArrow(rows, PACKETS)


def feature(data: bytes, movie: Movie) -> str:
    """What the packet table says of a file: codec, packets, clusters, laces by kind, last time, and cues that point at a cluster."""
    laces = {k: sum(p.lacing == k and p.lace == 0 for p in movie.packets) for k in ("none", "xiph", "fixed", "ebml")}
    starts = {c - movie.segment for c in movie.clusters}
    good = sum(c.get("cluster") in starts for c in movie.cues)
    t = movie.tracks[0] if movie.tracks else {}
    last = max((p.time_ns for p in movie.packets), default=0) // 1_000_000
    return f"{t.get('codec')}:{t.get('depth')}@{t.get('rate', 0):.0f};packets={len(movie.packets)};clusters={len(movie.clusters)};" + ";".join(f"{k}={n}" for k, n in laces.items()) + f";last_ms={last};cues={good}/{len(movie.cues)}"


def digests(media_rows: DataFrame) -> DataFrame:
    """Parse media_rows (doc_id, n_bytes, media) and describe what track 1 holds.

    A row for each row of media_rows, repeated ones too: doc_id, n_bytes,
    payload_bytes, payload_sha256, tail_crc32 (of the last 64 bytes), media_bytes,
    media_sha256, feature. Null media give nulls in all but the first two; damaged
    files raise; an empty table gives no rows; other columns are ignored.
    """

    def rows(batch_iter):
        for batch in batch_iter:
            out = []
            for data in batch.column("media"):
                if not data.is_valid:
                    out.append((None,) * 6)
                    continue
                raw = data.as_buffer().to_pybytes()
                movie = demux(raw)
                payload = track_bytes(raw, movie)
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(raw, movie)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    return media_rows.select("doc_id", "n_bytes", "media").mapInArrow(rows, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op4_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    with common.small_batches(spark, 256):
        stored = common.stored(media(common.documents(spark, sf_dir, "doc_id", "text")), "media")
        return common.stored(digests(stored), "digests")
