"""RLE Lossless (PS3.5 annex G): a header of segment offsets, then PackBits segments from the highest byte down."""

from __future__ import annotations

import struct

import numpy as np


class FrameError(ValueError):
    """A compressed frame that does not hold what its attributes say."""


def unpacked(data: bytes, size: int) -> np.ndarray:
    """Exactly `size` bytes of a PackBits segment; what follows them is padding."""
    out, at, n = bytearray(), 0, len(data)
    while at < n and len(out) < size:
        control = data[at]
        at += 1
        if control < 128:
            run = data[at : at + control + 1]
            if len(run) <= control:
                raise FrameError("truncatedPixelData")
            out += run
            at += control + 1
        elif control > 128:
            if at >= n:
                raise FrameError("truncatedPixelData")
            out += data[at : at + 1] * (257 - control)
            at += 1
    if len(out) != size:
        raise FrameError("truncatedPixelData")
    return np.frombuffer(bytes(out), np.uint8)


def packed(data: bytes) -> bytes:
    """PackBits of one segment at even length."""
    out, at, n = bytearray(), 0, len(data)
    while at < n:
        run = 1
        while run < 128 and at + run < n and data[at + run] == data[at]:
            run += 1
        if run > 1:
            out += bytes([257 - run, data[at]])
            at += run
            continue
        end = at + 1
        while end < n and end - at < 128 and not (end + 1 < n and data[end] == data[end + 1]):
            end += 1
        out += bytes([end - at - 1]) + data[at:end]
        at = end
    return bytes(out) + b"\0" * (len(out) % 2)


def decode(fragments: list[bytes], pixels: int, samples: int, bytes_per_sample: int) -> bytes:
    """Interleaved little-endian samples of one frame."""
    frame = b"".join(fragments)
    count = samples * bytes_per_sample
    if pixels <= 0:
        raise FrameError("invalidImageAttributes")
    if len(frame) < 64 or struct.unpack_from("<I", frame)[0] != count:
        raise FrameError("unsupportedPixelFormat")
    offsets = struct.unpack_from(f"<{count}I", frame, 4)
    if any(not 64 <= o < len(frame) for o in offsets) or any(a >= b for a, b in zip(offsets, offsets[1:])):
        raise FrameError("truncatedPixelData")
    ends = [*offsets[1:], len(frame)]
    planes = [unpacked(frame[a:b], pixels) for a, b in zip(offsets, ends, strict=True)]
    out = np.empty((pixels, samples, bytes_per_sample), np.uint8)
    for k, plane in enumerate(planes):
        out[:, k // bytes_per_sample, bytes_per_sample - 1 - k % bytes_per_sample] = plane
    return out.tobytes()


def encode(native: bytes, samples: int, bytes_per_sample: int) -> bytes:
    """One frame of interleaved little-endian samples as an RLE fragment."""
    planes = np.frombuffer(native, np.uint8).reshape(-1, samples, bytes_per_sample)
    segments = [packed(planes[:, c, bytes_per_sample - 1 - b].tobytes()) for c in range(samples) for b in range(bytes_per_sample)]
    at, offsets = 64, []
    for s in segments:
        offsets.append(at)
        at += len(s)
    return struct.pack("<16I", len(segments), *offsets, *[0] * (15 - len(offsets))) + b"".join(segments)
