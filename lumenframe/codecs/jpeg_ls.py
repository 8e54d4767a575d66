"""JPEG-LS (ITU-T T.87): context modelling, Golomb codes and run mode, lossless and near-lossless."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

from lumenframe.codecs.jpeg_lossless import expect, Image
from lumenframe.codecs.rle import FrameError

#: Run-length orders of T.87 A.7.1.1.
RUN_ORDERS = [0] * 4 + [1] * 4 + [2] * 4 + [3] * 4 + [4, 4, 5, 5, 6, 6, 7, 7, 8, 9, 10, 11, 12, 13, 14, 15]


class Bits:
    """Bits of a scan; after a byte of all ones the next has seven."""

    def __init__(self, data: bytes):
        self.data, self.at, self.window, self.count, self.ones = data, 0, 0, 0, False

    def bit(self) -> int:
        if not self.count:
            if self.at >= len(self.data):
                raise FrameError("truncatedPixelData")
            byte = self.data[self.at]
            if self.ones and byte >= 0x80:
                raise FrameError("truncatedPixelData")
            self.window, self.count, self.ones = byte, 7 if self.ones else 8, byte == 0xFF
            self.at += 1
        self.count -= 1
        return self.window >> self.count & 1

    def take(self, n: int) -> int:
        value = 0
        for _ in range(n):
            value = value << 1 | self.bit()
        return value


@dataclass
class Parameters:
    maximum: int
    near: int
    t1: int
    t2: int
    t3: int
    reset: int
    span: int = 0
    bits: int = 0
    limit: int = 0

    def __post_init__(self):
        self.span = (self.maximum + 2 * self.near) // (2 * self.near + 1) + 1
        self.bits = (self.span - 1).bit_length()
        depth = max(2, self.maximum.bit_length())
        self.limit = 2 * (depth + max(8, depth))


def defaults(maximum: int, near: int) -> tuple[int, int, int]:
    """Thresholds of T.87 C.2.4.1.1."""

    def clamp(v: int, low: int) -> int:
        return low if v > maximum or v < low else v

    if maximum >= 128:
        factor = (min(maximum, 4095) + 128) // 256
        t1 = clamp(factor * 1 + 2 + 3 * near, near + 1)
        t2 = clamp(factor * 4 + 3 + 5 * near, t1)
        return t1, t2, clamp(factor * 17 + 4 + 7 * near, t2)
    factor = 256 // (maximum + 1)
    t1 = clamp(max(2, 3 // factor + 3 * near), near + 1)
    t2 = clamp(max(3, 7 // factor + 5 * near), t1)
    return t1, t2, clamp(max(4, 21 // factor + 7 * near), t2)


@dataclass
class State:
    """Adaptive statistics of one scan: 365 regular contexts and two of interrupted runs."""

    p: Parameters
    a: list[int] = field(default_factory=list)
    b: list[int] = field(default_factory=lambda: [0] * 367)
    c: list[int] = field(default_factory=lambda: [0] * 367)
    n: list[int] = field(default_factory=lambda: [1] * 367)
    negative: list[int] = field(default_factory=lambda: [0] * 367)

    def __post_init__(self):
        self.a = [max(2, (self.p.span + 32) // 64)] * 367


class Scan:
    def __init__(self, bits: Bits, p: Parameters):
        self.bits, self.p, self.s = bits, p, State(p)

    def golomb(self, k: int, limit: int) -> int:
        zeros = 0
        while not self.bits.bit():
            zeros += 1
            if zeros > limit:
                raise FrameError("truncatedPixelData")
        if zeros < limit - self.p.bits - 1:
            return zeros << k | self.bits.take(k)
        return self.bits.take(self.p.bits) + 1

    def quantized(self, d: int) -> int:
        p, sign = self.p, 1 if d >= 0 else -1
        d = abs(d)
        return sign * (0 if d <= p.near else 1 if d < p.t1 else 2 if d < p.t2 else 3 if d < p.t3 else 4)

    def rebuilt(self, guess: int, error: int) -> int:
        p = self.p
        value = guess + error * (2 * p.near + 1)
        if value < -p.near:
            value += p.span * (2 * p.near + 1)
        elif value > p.maximum + p.near:
            value -= p.span * (2 * p.near + 1)
        return min(p.maximum, max(0, value))

    def regular(self, a: int, b: int, c: int, context: int, sign: int) -> int:
        s, p = self.s, self.p
        guess = min(a, b) if c >= max(a, b) else max(a, b) if c <= min(a, b) else a + b - c
        guess = min(p.maximum, max(0, guess + sign * s.c[context]))
        k = 0
        while s.n[context] << k < s.a[context]:
            k += 1
        mapped = self.golomb(k, p.limit)
        if not p.near and not k and 2 * s.b[context] <= -s.n[context]:
            error = (mapped - 1) // 2 if mapped & 1 else -(mapped // 2) - 1
        else:
            error = -(mapped + 1) // 2 if mapped & 1 else mapped // 2
        s.b[context] += error * (2 * p.near + 1)
        s.a[context] += abs(error)
        if s.n[context] == p.reset:
            s.a[context] >>= 1
            s.b[context] >>= 1
            s.n[context] >>= 1
        s.n[context] += 1
        if s.b[context] <= -s.n[context]:
            s.b[context] = max(s.b[context] + s.n[context], 1 - s.n[context])
            s.c[context] = max(-128, s.c[context] - 1)
        elif s.b[context] > 0:
            s.b[context] = min(s.b[context] - s.n[context], 0)
            s.c[context] = min(127, s.c[context] + 1)
        return self.rebuilt(guess, sign * error)

    def interrupted(self, a: int, b: int, order: int) -> int:
        s, p = self.s, self.p
        alike = abs(a - b) <= p.near
        guess, sign = (a, 1) if alike else (b, 1 if a <= b else -1)
        context = 366 if alike else 365
        total = s.a[context] + (s.n[context] >> 1 if alike else 0)
        k = 0
        while s.n[context] << k < total:
            k += 1
        mapped = self.golomb(k, p.limit - order - 1)
        t = mapped + alike
        flag = bool(k) or 2 * s.negative[context] >= s.n[context]
        magnitude = (t + 1) // 2
        error = -magnitude if (t % 2 != 0) == flag and magnitude else magnitude
        if error < 0:
            s.negative[context] += 1
        s.a[context] += (mapped + 1 - alike) >> 1
        if s.n[context] == p.reset:
            s.a[context] >>= 1
            s.n[context] >>= 1
            s.negative[context] >>= 1
        s.n[context] += 1
        return self.rebuilt(guess, sign * error)

    def line(self, above: list[int], line: list[int], run_index: int, columns: int) -> int:
        """Fills line[1..columns]; both lists have one sample before and one after the row."""
        x = 1
        line[0] = above[1]
        while x <= columns:
            a, b, c, d = line[x - 1], above[x], above[x - 1], above[x + 1]
            q = self.quantized(d - b), self.quantized(b - c), self.quantized(c - a)
            if any(q):
                number = (q[0] * 9 + q[1]) * 9 + q[2]
                line[x] = self.regular(a, b, c, abs(number), 1 if number > 0 else -1)
                x += 1
                continue
            while x <= columns:
                if self.bits.bit():
                    n = min(1 << RUN_ORDERS[run_index], columns - x + 1)
                    full = n == 1 << RUN_ORDERS[run_index]
                    line[x : x + n] = [a] * n
                    x += n
                    if full and run_index < 31:
                        run_index += 1
                    continue
                n = self.bits.take(RUN_ORDERS[run_index])
                if n > columns - x:
                    raise FrameError("truncatedPixelData")
                line[x : x + n] = [a] * n
                x += n
                line[x] = self.interrupted(a, above[x], RUN_ORDERS[run_index])
                x += 1
                if run_index:
                    run_index -= 1
                break
        return run_index


def decode(data: bytes, size: tuple[int, int, int] | None = None) -> Image:
    """Samples of a JPEG-LS stream, interleaved by pixel whatever the stream's own order; size as in jpeg_lossless."""
    if data[:2] != b"\xff\xd8":
        raise FrameError("unsupportedPixelFormat")
    at, frame, preset, planes, near = 2, None, None, {}, 0
    while True:
        if at + 2 > len(data) or data[at] != 0xFF:
            raise FrameError("truncatedPixelData")
        marker = data[at + 1]
        if marker == 0xD9:
            break
        if at + 4 > len(data):
            raise FrameError("truncatedPixelData")
        length = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + length]
        if len(body) != length - 2:
            raise FrameError("truncatedPixelData")
        at += 2 + length
        if marker == 0xF7:
            if len(body) < 6 or len(body) != 6 + 3 * body[5]:
                raise FrameError("truncatedPixelData")
            precision, rows, columns, n = struct.unpack_from(">BHHB", body)
            if not (2 <= precision <= 16 and rows and columns and n):
                raise FrameError("unsupportedPixelFormat")
            expect((rows, columns, n), size)
            frame = (precision, rows, columns, [body[6 + 3 * k] for k in range(n)])
        elif marker == 0xF8 and body[:1] == b"\1" and len(body) >= 11:
            preset = struct.unpack_from(">5H", body, 1)
        elif marker == 0xDA:
            if frame is None:
                raise FrameError("unsupportedPixelFormat")
            precision, rows, columns, ids = frame
            count = body[0] if body else 0
            if not count or len(body) < 3 + 2 * count or any(body[1 + 2 * k] not in ids for k in range(count)):
                raise FrameError("unsupportedPixelFormat")
            near, interleave = body[1 + 2 * count], body[2 + 2 * count]
            maximum = (preset[0] if preset and preset[0] else (1 << precision) - 1)
            t = defaults(maximum, near)
            own = preset or (0, 0, 0, 0, 0)
            p = Parameters(maximum, near, own[1] or t[0], own[2] or t[1], own[3] or t[2], own[4] or 64)
            end = at
            while end + 1 < len(data) and not (data[end] == 0xFF and data[end + 1] >= 0x80):
                end += 1
            scanned = [body[1 + 2 * k] for k in range(count)]
            for k, plane in zip(scanned, components(Bits(data[at:end]), p, rows, columns, count, interleave), strict=True):
                planes[k] = plane
            at = end
    if frame is None or set(planes) != set(frame[3]):
        raise FrameError("truncatedPixelData")
    precision, rows, columns, ids = frame
    return Image(np.stack([planes[k] for k in ids], axis=2), rows, columns, precision, len(ids), near)


def components(bits: Bits, p: Parameters, rows: int, columns: int, count: int, interleave: int) -> list[np.ndarray]:
    """Planes of one scan: one component, or several interleaved by line (1) or by sample (2)."""
    if interleave == 0 and count != 1 or interleave > 2:
        raise FrameError("unsupportedPixelFormat")
    if interleave == 2:
        return by_sample(bits, p, rows, columns, count)
    scan, out = Scan(bits, p), [np.zeros((rows, columns), np.int64) for _ in range(count)]
    above, run = [[0] * (columns + 2) for _ in range(count)], [0] * count
    for y in range(rows):
        for k in range(count):
            line = [0] * (columns + 2)
            above[k][columns + 1] = above[k][columns]
            run[k] = scan.line(above[k], line, run[k], columns)
            out[k][y] = line[1 : columns + 1]
            above[k] = line
    return out


def by_sample(bits: Bits, p: Parameters, rows: int, columns: int, count: int) -> list[np.ndarray]:
    """Sample-interleaved planes: a run goes on only where all components do."""
    scan, out = Scan(bits, p), [np.zeros((rows, columns), np.int64) for _ in range(count)]
    above, run = [[0] * (columns + 2) for _ in range(count)], 0
    for y in range(rows):
        lines = [[0] * (columns + 2) for _ in range(count)]
        for k in range(count):
            above[k][columns + 1] = above[k][columns]
            lines[k][0] = above[k][1]
        x = 1
        while x <= columns:
            q = []
            for k in range(count):
                a, b, c, d = lines[k][x - 1], above[k][x], above[k][x - 1], above[k][x + 1]
                q.append((scan.quantized(d - b), scan.quantized(b - c), scan.quantized(c - a)))
            if any(any(t) for t in q):
                for k in range(count):
                    number = (q[k][0] * 9 + q[k][1]) * 9 + q[k][2]
                    lines[k][x] = scan.regular(lines[k][x - 1], above[k][x], above[k][x - 1], abs(number), 1 if number >= 0 else -1)
                x += 1
                continue
            last = [lines[k][x - 1] for k in range(count)]
            while x <= columns:
                order = RUN_ORDERS[run]
                more = bits.bit()
                n = min(1 << order, columns - x + 1) if more else bits.take(order)
                if not more and n > columns - x:
                    raise FrameError("truncatedPixelData")
                for k in range(count):
                    lines[k][x : x + n] = [last[k]] * n
                x += n
                if more:
                    run += n == 1 << order and run < 31
                    continue
                for k in range(count):
                    lines[k][x] = alike_interrupted(scan, last[k], above[k][x], order)
                x += 1
                run -= run > 0
                break
        for k in range(count):
            out[k][y] = lines[k][1 : columns + 1]
        above = lines
    return out


def alike_interrupted(scan: Scan, a: int, b: int, order: int) -> int:
    """The end of a sample-interleaved run: always coded in the first run context, predicted from above."""
    s, p = scan.s, scan.p
    sign, context = (1 if a <= b else -1), 365
    k = 0
    while s.n[context] << k < s.a[context]:
        k += 1
    mapped = scan.golomb(k, p.limit - order - 1)
    flag = bool(k) or 2 * s.negative[context] >= s.n[context]
    magnitude = (mapped + 1) // 2
    error = -magnitude if (mapped % 2 != 0) == flag and magnitude else magnitude
    if error < 0:
        s.negative[context] += 1
    s.a[context] += (mapped + 1) >> 1
    if s.n[context] == p.reset:
        s.a[context] >>= 1
        s.n[context] >>= 1
        s.negative[context] >>= 1
    s.n[context] += 1
    return scan.rebuilt(b, sign * error)
