"""JPEG Lossless, process 14 (ITU-T T.81 annex H): Huffman-coded differences to one of seven predictors."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from lumenframe.codecs.rle import FrameError


@dataclass
class Component:
    id: int
    table: int = 0


class Bits:
    """Bits of an entropy-coded stretch without its stuffed zeros."""

    def __init__(self, data: bytes):
        self.data, self.at, self.window, self.count = data, 0, 0, 0

    def need(self, n: int) -> None:
        while self.count < n:
            if self.at >= len(self.data):
                raise FrameError("truncatedPixelData")
            byte = self.data[self.at]
            self.at += 1
            if byte == 0xFF:
                if self.at < len(self.data) and self.data[self.at] == 0:
                    self.at += 1
                else:
                    raise FrameError("truncatedPixelData")
            self.window = (self.window << 8 | byte) & (1 << 48) - 1
            self.count += 8

    def take(self, n: int) -> int:
        if not n:
            return 0
        self.need(n)
        self.count -= n
        return self.window >> self.count & (1 << n) - 1

    def code(self, table: dict[tuple[int, int], int]) -> int:
        value = 0
        for length in range(1, 17):
            value = value << 1 | self.take(1)
            found = table.get((length, value))
            if found is not None:
                return found
        raise FrameError("unsupportedPixelFormat")


def huffman(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[(length, code)] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def entropy_end(data: bytes, at: int) -> int:
    """Where the coded stretch that starts at `at` meets its next marker."""
    while at + 1 < len(data):
        if data[at] == 0xFF and data[at + 1] != 0:
            return at
        at += 1
    raise FrameError("truncatedPixelData")


@dataclass
class Image:
    """Decoded samples, interleaved, with what the stream says about itself."""

    samples: np.ndarray
    rows: int
    columns: int
    precision: int
    components: int
    predictor: int = 0

    def native(self) -> bytes:
        return self.samples.astype("<u2" if self.precision > 8 else np.uint8).tobytes()


def expect(have: tuple[int, int, int], size: tuple[int, int, int] | None) -> None:
    """The stream's own rows, columns and components must be the file's, before any memory is taken for them."""
    if size is not None and have != size:
        raise FrameError("invalidImageAttributes")


def decode(data: bytes, size: tuple[int, int, int] | None = None) -> Image:
    """Samples of one frame; size is (rows, columns, components) that the stream must have."""
    if data[:2] != b"\xff\xd8":
        raise FrameError("unsupportedPixelFormat")
    at, tables, frame, restart = 2, {}, None, 0
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise FrameError("truncatedPixelData")
        marker = data[at + 1]
        if marker == 0xFF:  # fill
            at += 1
            continue
        length = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + length]
        if len(body) != length - 2:
            raise FrameError("truncatedPixelData")
        at += 2 + length
        if marker == 0xC4:
            while body:
                counts, kind = body[1:17], body[0]
                n = sum(counts)
                if len(body) < 17 + n:
                    raise FrameError("truncatedPixelData")
                if kind > 3 or n > 17:  # tables of class 0 only, one for each category at most
                    raise FrameError("unsupportedPixelFormat")
                tables[kind] = huffman(counts, body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC3:
            if frame is not None or len(body) < 6 or len(body) != 6 + 3 * body[5]:
                raise FrameError("truncatedPixelData")
            precision, rows, columns, n = struct.unpack_from(">BHHB", body)
            # No subsampling and no quantisation table in this process.
            plain = all(body[7 + 3 * k] == 0x11 and not body[8 + 3 * k] for k in range(n))
            if not (2 <= precision <= 16 and rows and columns and 1 <= n <= 4 and plain):
                raise FrameError("unsupportedPixelFormat")
            expect((rows, columns, n), size)
            frame = (precision, rows, columns, [Component(body[6 + 3 * k]) for k in range(n)])
        elif marker == 0xDD:
            if len(body) != 2:
                raise FrameError("truncatedPixelData")
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            if frame is None:
                raise FrameError("unsupportedPixelFormat")
            return scan(data, at, body, frame, tables, restart)
        elif 0xC0 <= marker <= 0xCF and marker != 0xCC or marker == 0xD9:
            raise FrameError("unsupportedPixelFormat")


def scan(data: bytes, at: int, head: bytes, frame, tables, restart: int) -> Image:
    precision, rows, columns, components = frame
    n = head[0] if head else 0
    if n != len(components) or len(head) != 4 + 2 * n:
        raise FrameError("unsupportedPixelFormat")
    if any(head[2 + 2 * k] & 15 for k in range(n)) or head[2 + 2 * n] or head[3 + 2 * n] >> 4:
        raise FrameError("unsupportedPixelFormat")
    by_id = {head[1 + 2 * k]: head[2 + 2 * k] >> 4 for k in range(n)}
    try:
        coders = [tables[by_id[c.id]] for c in components]
    except KeyError as e:
        raise FrameError("unsupportedPixelFormat") from e
    predictor, shift = head[1 + 2 * n], head[3 + 2 * n] & 15
    if not 1 <= predictor <= 7 or shift >= precision:
        raise FrameError("unsupportedPixelFormat")
    out = np.zeros((rows, columns, n), np.int64)
    lines = [[[0] * columns for _ in range(n)] for _ in range(2)]
    start, mask = 1 << (precision - shift - 1), 0xFFFF
    end = entropy_end(data, at)
    bits, left, fresh, marker = Bits(data[at:end]), restart, True, 0
    for y in range(rows):
        above, line = lines[(y + 1) % 2], lines[y % 2]
        for x in range(columns):
            if restart and not left:
                if end + 1 >= len(data) or data[end + 1] != 0xD0 + marker % 8:
                    raise FrameError("truncatedPixelData")
                at, marker = end + 2, marker + 1
                end = entropy_end(data, at)
                bits, left, fresh = Bits(data[at:end]), restart, True
                row_fresh = y
            for c in range(n):
                if fresh:
                    guess = start
                    row_fresh = y
                elif y == row_fresh:
                    guess = line[c][x - 1] if x else above[c][0]
                elif not x:
                    guess = above[c][0]
                else:
                    a, b, d = line[c][x - 1], above[c][x], above[c][x - 1]
                    guess = (a, b, d, a + b - d, a + ((b - d) >> 1), b + ((a - d) >> 1), (a + b) >> 1)[predictor - 1]
                size = bits.code(coders[c])
                if size > 16:
                    raise FrameError("unsupportedPixelFormat")
                if size == 16:
                    diff = 32768
                else:
                    diff = bits.take(size)
                    if size and diff < 1 << (size - 1):
                        diff -= (1 << size) - 1
                line[c][x] = (guess + diff) & mask
            fresh = False
            left -= 1
        for c in range(n):
            out[y, :, c] = line[c]
    tail = data[end:]
    if tail not in (b"\xff\xd9", b"\xff\xd9\0"):
        raise FrameError("truncatedPixelData")
    return Image((out << shift) & ((1 << precision) - 1), rows, columns, precision, n, predictor)


def encode(samples: np.ndarray, precision: int, predictor: int = 1, shift: int = 0, restart: int = 0) -> bytes:
    """A stream for tests and bridges; samples has the shape (rows, columns) or (rows, columns, components)."""
    pixels = (samples if samples.ndim == 3 else samples[:, :, None]).astype(np.int64) >> shift
    rows, columns, n = pixels.shape
    counts = bytes([0, 0, 0, 0, 17, *[0] * 11])  # 17 categories, all codes of five bits
    out = bytearray(b"\xff\xd8\xff\xc3" + struct.pack(">HBHHB", 8 + 3 * n, precision, rows, columns, n))
    out += b"".join(bytes([c + 1, 0x11, 0]) for c in range(n))
    out += b"\xff\xc4" + struct.pack(">H", 19 + 17) + b"\0" + counts + bytes(range(17))
    if restart:
        out += b"\xff\xdd" + struct.pack(">HH", 4, restart)
    out += b"\xff\xda" + struct.pack(">HB", 6 + 2 * n, n) + b"".join(bytes([c + 1, 0]) for c in range(n)) + bytes([predictor, 0, shift])
    word: list[str] = []

    def flush() -> None:
        text = "".join(word)
        text += "1" * (-len(text) % 8)
        out.extend(b"".join(bytes([b]) + (b"\0" if b == 255 else b"") for b in (int(text[i : i + 8], 2) for i in range(0, len(text), 8))))
        word.clear()

    first, row_fresh, done = True, 0, 0
    for y in range(rows):
        for x in range(columns):
            if restart and done and done % restart == 0:
                flush()
                out.extend(bytes([255, 0xD0 + (done // restart - 1) % 8]))
                first = True
            if first:
                row_fresh = y
            for c in range(n):
                a = pixels[y, x - 1, c] if x else 0
                b = pixels[y - 1, x, c] if y else 0
                d = pixels[y - 1, x - 1, c] if x and y else 0
                if first:
                    guess = 1 << (precision - shift - 1)
                elif y == row_fresh:
                    guess = a if x else b
                elif not x:
                    guess = b
                else:
                    guess = (a, b, d, a + b - d, a + ((b - d) >> 1), b + ((a - d) >> 1), (a + b) >> 1)[predictor - 1]
                diff = int(pixels[y, x, c] - guess) & 0xFFFF
                diff -= 65536 if diff > 32768 else 0
                size = abs(diff).bit_length() if diff != 32768 else 16
                word.append(f"{size:05b}")
                if 0 < size < 16:
                    word.append(f"{diff if diff > 0 else diff + (1 << size) - 1:0{size}b}")
            first, done = False, done + 1
    flush()
    return bytes(out) + b"\xff\xd9"
