"""JPEG Baseline and extended sequential (ITU-T T.81, SOF0/SOF1), 8 bits: Huffman coding, inverse DCT, chroma to full size.

Colour streams come out as RGB. The inverse DCT is done in floating point; other decoders use fixed-point
approximations and may differ from it by one or two steps.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from lumenframe.codecs.jpeg_lossless import Bits, Image, entropy_end, expect, huffman
from lumenframe.codecs.rle import FrameError

_k = np.arange(8)
#: The one-dimensional DCT basis: rows are frequencies.
BASIS = np.where(_k[:, None] == 0, np.sqrt(1 / 8), np.sqrt(2 / 8)) * np.cos((2 * _k[None, :] + 1) * _k[:, None] * np.pi / 16)


def zigzag() -> np.ndarray:
    """Row-major positions of the 64 coefficients in coding order: along diagonals, turning at the edges."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    cells.sort(key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([r * 8 + c for r, c in cells])


ORDER = zigzag()


@dataclass
class Plane:
    id: int
    h: int
    v: int
    quant: int
    dc: int = 0
    ac: int = 0
    last: int = 0
    blocks: np.ndarray | None = None  # (block rows, block columns, 64) coefficients


def signed(bits: Bits, size: int) -> int:
    value = bits.take(size)
    return value if not size or value >> (size - 1) else value - (1 << size) + 1


def block(bits: Bits, dc: dict, ac: dict, plane: Plane) -> np.ndarray:
    out = np.zeros(64)
    plane.last += signed(bits, bits.code(dc))
    out[0] = plane.last
    k = 1
    while k < 64:
        run, size = divmod(bits.code(ac), 16)
        if not size:
            if run < 15:
                break
            k += 16
            continue
        k += run
        if k > 63:
            raise FrameError("truncatedPixelData")
        out[ORDER[k]] = signed(bits, size)
        k += 1
    return out


def decode(data: bytes, size: tuple[int, int, int] | None = None) -> Image:
    """Samples of one frame: grey, or RGB whatever the stream's own subsampling; size as in jpeg_lossless."""
    if data[:2] != b"\xff\xd8":
        raise FrameError("unsupportedPixelFormat")
    at, quant, tables, frame, restart, transform = 2, {}, {}, None, 0, None
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise FrameError("truncatedPixelData")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        length = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + length]
        if len(body) != length - 2:
            raise FrameError("truncatedPixelData")
        at += 2 + length
        if marker == 0xDB:
            while body:
                wide, n = body[0] >> 4, body[0] & 15
                length = 128 if wide else 64
                if len(body) < 1 + length:
                    raise FrameError("truncatedPixelData")
                table = np.zeros(64)
                table[ORDER] = np.frombuffer(body[1 : 1 + length], ">u2" if wide else np.uint8)
                quant[n], body = table, body[1 + length :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                if len(body) < 17 + n:
                    raise FrameError("truncatedPixelData")
                tables[body[0]] = huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            if len(body) < 6 or len(body) != 6 + 3 * body[5]:
                raise FrameError("truncatedPixelData")
            precision, rows, columns, n = struct.unpack_from(">BHHB", body)
            if precision != 8 or not rows or not columns or n not in (1, 3):
                raise FrameError("unsupportedPixelFormat")
            expect((rows, columns, n), size)
            if not all(1 <= body[7 + 3 * k] >> 4 <= 4 and 1 <= body[7 + 3 * k] & 15 <= 4 for k in range(n)):
                raise FrameError("unsupportedPixelFormat")
            frame = rows, columns, [Plane(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        elif marker == 0xDD:
            if len(body) != 2:
                raise FrameError("truncatedPixelData")
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
            transform = body[11]
        elif marker == 0xDA:
            if frame is None:
                raise FrameError("unsupportedPixelFormat")
            rows, columns, planes = frame
            if not body or body[0] != len(planes) or len(body) < 1 + 2 * len(planes):
                raise FrameError("unsupportedPixelFormat")
            for k in range(body[0]):
                plane = next((p for p in planes if p.id == body[1 + 2 * k]), None)
                if plane is None:
                    raise FrameError("unsupportedPixelFormat")
                plane.dc, plane.ac = body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15
            try:
                scan(data, at, rows, columns, planes, tables, restart)
                return assembled(rows, columns, planes, quant, transform)
            except KeyError as e:
                raise FrameError("unsupportedPixelFormat") from e
        elif 0xC2 <= marker <= 0xCF or marker == 0xD9:
            raise FrameError("unsupportedPixelFormat")


def scan(data: bytes, at: int, rows: int, columns: int, planes: list[Plane], tables: dict, restart: int) -> None:
    if len(planes) == 1:
        planes[0].h = planes[0].v = 1  # one component is coded block by block
    high, wide = max(p.v for p in planes), max(p.h for p in planes)
    down, across = -(-rows // (8 * high)), -(-columns // (8 * wide))
    for p in planes:
        p.blocks, p.last = np.zeros((down * p.v, across * p.h, 64)), 0
    end = entropy_end(data, at)
    bits = Bits(data[at:end])
    for unit in range(down * across):
        if restart and unit and unit % restart == 0:
            if end + 1 >= len(data) or data[end + 1] != 0xD0 + (unit // restart - 1) % 8:
                raise FrameError("truncatedPixelData")
            at, end = end + 2, entropy_end(data, end + 2)
            bits = Bits(data[at:end])
            for p in planes:
                p.last = 0
        y, x = divmod(unit, across)
        for p in planes:
            for r in range(p.v):
                for c in range(p.h):
                    p.blocks[y * p.v + r, x * p.h + c] = block(bits, tables[p.dc], tables[0x10 | p.ac], p)


def assembled(rows: int, columns: int, planes: list[Plane], quant: dict, transform: int | None) -> Image:
    high, wide, full = max(p.v for p in planes), max(p.h for p in planes), []
    for p in planes:
        down, across, _ = p.blocks.shape
        freq = (p.blocks * quant[p.quant]).reshape(down, across, 8, 8)
        space = BASIS.T @ freq @ BASIS + 128
        plane = space.transpose(0, 2, 1, 3).reshape(down * 8, across * 8)
        full.append(np.clip(np.floor(plane + 0.5), 0, 255).repeat(high // p.v, axis=0).repeat(wide // p.h, axis=1)[:rows, :columns])
    if len(full) == 3 and transform != 0:
        y, cb, cr = full
        full = [y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128)]
    samples = np.clip(np.floor(np.stack(full, axis=2) + 0.5), 0, 255).astype(np.int64)
    return Image(samples, rows, columns, 8, len(full))


def encode(planes: list[np.ndarray], sampling: list[tuple[int, int]], rows: int, columns: int, adobe: int | None = None, restart: int = 0) -> bytes:
    """A baseline stream with quantisers of one, DC codes of four bits and AC codes of eight; planes are at their own size."""
    high, wide = max(v for _, v in sampling), max(h for h, _ in sampling)
    if len(planes) == 1:
        sampling, high, wide = [(1, 1)], 1, 1
    down, across = -(-rows // (8 * high)), -(-columns // (8 * wide))
    symbols = [(r << 4) | s for r in range(16) for s in range(1, 11)] + [0x00, 0xF0]
    out = bytearray(b"\xff\xd8\xff\xdb\x00\x43\x00" + b"\1" * 64)
    out += b"\xff\xc0" + struct.pack(">HBHHB", 8 + 3 * len(planes), 8, rows, columns, len(planes))
    out += b"".join(bytes([k + 1, h << 4 | v, 0]) for k, (h, v) in enumerate(sampling))
    out += b"\xff\xc4" + struct.pack(">H", 19 + 12) + b"\0" + bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12))
    out += b"\xff\xc4" + struct.pack(">H", 19 + 162) + b"\x10" + bytes([0] * 7 + [162] + [0] * 8) + bytes(symbols)
    if restart:
        out += b"\xff\xdd" + struct.pack(">HH", 4, restart)
    if adobe is not None:
        out += b"\xff\xee\x00\x0eAdobe\x00\x64\x00\x00\x00\x00" + bytes([adobe])
    out += b"\xff\xda" + struct.pack(">HB", 6 + 2 * len(planes), len(planes)) + b"".join(bytes([k + 1, 0]) for k in range(len(planes))) + b"\0\x3f\0"
    padded = [np.pad(p, ((0, down * 8 * v - p.shape[0]), (0, across * 8 * h - p.shape[1])), mode="edge") for p, (h, v) in zip(planes, sampling, strict=True)]
    last, word = [0] * len(planes), []

    def number(x: int) -> tuple[int, str]:
        size = abs(x).bit_length()
        return size, f"{x if x > 0 else x + (1 << size) - 1:0{size}b}" if size else ""

    def flush() -> None:
        text = "".join(word)
        text += "1" * (-len(text) % 8)
        out.extend(b"".join(bytes([b]) + (b"\0" if b == 255 else b"") for b in (int(text[i : i + 8], 2) for i in range(0, len(text), 8))))
        word.clear()

    for unit in range(down * across):
        if restart and unit and unit % restart == 0:
            flush()
            out.extend(bytes([255, 0xD0 + (unit // restart - 1) % 8]))
            last = [0] * len(planes)
        y, x = divmod(unit, across)
        for k, (h, v) in enumerate(sampling):
            for r in range(v):
                for c in range(h):
                    a, b = (y * v + r) * 8, (x * h + c) * 8
                    freq = np.rint(BASIS @ (padded[k][a : a + 8, b : b + 8] - 128.0) @ BASIS.T).astype(int).reshape(64)[ORDER]
                    size, bits = number(int(freq[0]) - last[k])
                    last[k] = int(freq[0])
                    word.append(f"{size:04b}{bits}")
                    run = 0
                    for f in freq[1:].tolist():
                        if not f:
                            run += 1
                            continue
                        while run > 15:
                            word.append(f"{symbols.index(0xF0):08b}")
                            run -= 16
                        size, bits = number(f)
                        word.append(f"{symbols.index(run << 4 | size):08b}{bits}")
                        run = 0
                    if run:
                        word.append(f"{symbols.index(0):08b}")
    flush()
    return bytes(out) + b"\xff\xd9"
