"""Uncompressed audio files: headers, ranges and writing, with the standard library and numpy.

WAV (PCM 8, 16, 24, 32 bits, float 32, 64, extensible), AIFF/AIFC (PCM) and AU/SND
(PCM, float). FLAC and OGG need a codec that is not here and are refused.
"""

from __future__ import annotations

import io
import struct
from dataclasses import dataclass, replace

import numpy as np


@dataclass(frozen=True)
class AudioInfo:
    """Where the samples lie in a file, and how: kind is u, i or f, order is < or >."""

    rate: float
    channels: int
    frames: int
    offset: int
    kind: str
    bytes: int
    order: str


def info(data: bytes, total: int | None = None) -> AudioInfo:
    """From a file, or from the beginning of one of total bytes."""
    head, total = bytes(data[:12]), len(data) if total is None else total
    if head[:4] == b"RIFF" and head[8:12] == b"WAVE":
        return _wav(data, total)
    if head[:4] == b"FORM" and head[8:12] in (b"AIFF", b"AIFC"):
        return _aiff(data, total)
    if head[:4] == b".snd":
        return _au(data, total)
    raise ValueError("no WAV, AIFF or AU file")


def _chunks(data: bytes, order: str, total: int):
    at = 12
    while at + 8 <= len(data):
        name, size = struct.unpack_from(f"{order}4sI", data, at)
        yield name, at + 8, min(size, total - at - 8)
        at += 8 + size + size % 2


def _wav(data: bytes, total: int) -> AudioInfo:
    form = None
    for name, at, size in _chunks(data, "<", total):
        if name == b"fmt ":
            tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at)
            if tag == 0xFFFE:
                (tag,) = struct.unpack_from("<H", data, at + 24)
            if tag not in (1, 3):
                raise ValueError(f"WAV coding {tag} is not linear")
            form = channels, rate, bits, "f" if tag == 3 else "u" if bits == 8 else "i"
        elif name == b"data" and form:
            channels, rate, bits, kind = form
            width = bits // 8
            return AudioInfo(float(rate), channels, size // (width * channels), at, kind, width, "<")
    raise ValueError("a WAV file without format or data")


def _extended(b: bytes) -> float:
    exponent, mantissa = struct.unpack(">HQ", b)
    return float(mantissa) * 2.0 ** ((exponent & 0x7FFF) - 16383 - 63)


def _aiff(data: bytes, total: int) -> AudioInfo:
    form = place = None
    for name, at, size in _chunks(data, ">", total):
        if name == b"COMM":
            channels, frames, bits = struct.unpack_from(">hIh", data, at)
            coding = bytes(data[at + 18 : at + 22]) if size >= 22 else b"NONE"
            if coding not in (b"NONE", b"sowt", b"fl32", b"FL32", b"fl64", b"FL64"):
                raise ValueError(f"AIFF coding {coding!r} is not linear")
            form = _extended(bytes(data[at + 8 : at + 18])), channels, frames, (bits + 7) // 8, "f" if coding.lower().startswith(b"fl") else "i", "<" if coding == b"sowt" else ">"
        elif name == b"SSND":
            place = at + 8 + struct.unpack_from(">I", data, at)[0]
    if form is None or place is None:
        raise ValueError("an AIFF file without format or data")
    rate, channels, frames, width, kind, order = form
    return AudioInfo(rate, channels, frames, place, kind, width, order)


def _au(data: bytes, total: int) -> AudioInfo:
    offset, size, coding, rate, channels = struct.unpack_from(">IIIII", data, 4)
    kinds = {2: ("i", 1), 3: ("i", 2), 4: ("i", 3), 5: ("i", 4), 6: ("f", 4), 7: ("f", 8)}
    if coding not in kinds:
        raise ValueError(f"AU coding {coding} is not linear")
    kind, width = kinds[coding]
    size = total - offset if size == 0xFFFFFFFF else min(size, total - offset)
    return AudioInfo(float(rate), channels, size // (width * channels), offset, kind, width, ">")


def decode(data: bytes, meta: AudioInfo, first: int = 0, end: int | None = None) -> np.ndarray:
    """(channels, frames) of a range, as full-scale doubles."""
    end = meta.frames if end is None else max(first, min(end, meta.frames))
    step = meta.bytes * meta.channels
    raw = bytes(data[meta.offset + first * step : meta.offset + end * step])
    if meta.kind == "f":
        x = np.frombuffer(raw, f"{meta.order}f{meta.bytes}").astype(float)
    elif meta.bytes == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        b = b if meta.order == "<" else b[:, ::-1]
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
    elif meta.kind == "u":
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    else:
        x = np.frombuffer(raw, f"{meta.order}i{meta.bytes}") / float(1 << (8 * meta.bytes - 1))
    return x.reshape(-1, meta.channels).T


def decode_part(read, meta: AudioInfo, first: int, end: int) -> np.ndarray:
    """decode() of a range by read(offset, size), which gives the file's bytes."""
    step = meta.bytes * meta.channels
    end = max(first, min(end, meta.frames))
    return decode(read(meta.offset + first * step, (end - first) * step), replace(meta, offset=0, frames=end - first))


def wav_bytes(data: np.ndarray, rate: float) -> bytes:
    """A WAV file of (channels, frames): float 32 where magnitudes are at most 1, else clipped 16-bit PCM."""
    data = np.atleast_2d(np.asarray(data, float))
    floats = not data.size or np.abs(data).max() <= 1
    body = data.T.astype("<f4").tobytes() if floats else np.clip(np.rint(data.T * 32767), -32768, 32767).astype("<i2").tobytes()
    width = 4 if floats else 2
    out = io.BytesIO()
    out.write(b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt ")
    out.write(struct.pack("<IHHIIHH", 16, 3 if floats else 1, len(data), int(rate), int(rate) * width * len(data), width * len(data), 8 * width))
    out.write(b"data" + struct.pack("<I", len(body)) + body)
    return out.getvalue()
