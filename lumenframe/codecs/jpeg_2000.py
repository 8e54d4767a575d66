"""JPEG 2000 codestreams (ITU-T T.800): packets, embedded block coding, wavelets, colour transforms.

Tiles, tile-parts, layers, precincts and all five progressions are read, reversible and irreversible. Not read, and
refused as unsupported: subsampled components, regions of interest, packed headers, changes of progression, and the
bypass and vertically causal block styles. Block decoding is plain Python, decision by decision, and slow.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from lumenframe.codecs.jpeg_lossless import Image, expect
from lumenframe.codecs.rle import FrameError

# The probability states of the arithmetic coder (table C.2): estimate, next state after the more and the
# less probable symbol, and whether the sense switches.
STATES = (
    (0x5601, 1, 1, 1), (0x3401, 2, 6, 0), (0x1801, 3, 9, 0), (0x0AC1, 4, 12, 0), (0x0521, 5, 29, 0), (0x0221, 38, 33, 0),
    (0x5601, 7, 6, 1), (0x5401, 8, 14, 0), (0x4801, 9, 14, 0), (0x3801, 10, 14, 0), (0x3001, 11, 17, 0), (0x2401, 12, 18, 0),
    (0x1C01, 13, 20, 0), (0x1601, 29, 21, 0), (0x5601, 15, 14, 1), (0x5401, 16, 14, 0), (0x5101, 17, 15, 0), (0x4801, 18, 16, 0),
    (0x3801, 19, 17, 0), (0x3401, 20, 18, 0), (0x3001, 21, 19, 0), (0x2801, 22, 19, 0), (0x2401, 23, 20, 0), (0x2201, 24, 21, 0),
    (0x1C01, 25, 22, 0), (0x1801, 26, 23, 0), (0x1601, 27, 24, 0), (0x1401, 28, 25, 0), (0x1201, 29, 26, 0), (0x1101, 30, 27, 0),
    (0x0AC1, 31, 28, 0), (0x09C1, 32, 29, 0), (0x08A1, 33, 30, 0), (0x0521, 34, 31, 0), (0x0441, 35, 32, 0), (0x02A1, 36, 33, 0),
    (0x0221, 37, 34, 0), (0x0141, 38, 35, 0), (0x0111, 39, 36, 0), (0x0085, 40, 37, 0), (0x0049, 41, 38, 0), (0x0025, 42, 39, 0),
    (0x0015, 43, 40, 0), (0x0009, 44, 41, 0), (0x0005, 45, 42, 0), (0x0001, 45, 43, 0), (0x5601, 46, 46, 0),
)
#: Contexts of run lengths and of plain bits, and those that do not begin in state 0.
RUN, PLAIN = 17, 18
BEGIN = [4 if k == 0 else 3 if k == RUN else 46 if k == PLAIN else 0 for k in range(19)]
BYPASS, RESET, TERMINATE, CAUSAL, SYMBOLS = 1, 2, 4, 8, 32
#: Lifting steps of the irreversible filter (table F.4) and its scale.
LIFTS, SCALE = (-1.586134342059924, -0.052980118572961, 0.882911075530934, 0.443506852043971), 1.230174104914001


class Arithmetic:
    """The arithmetic decoder over one codeword segment; beyond its end it reads ones."""

    def __init__(self, data: bytes, states: list[int] | None = None, senses: list[int] | None = None):
        self.data, self.at, self.count = data, 0, 0
        self.state, self.sense = states or list(BEGIN), senses or [0] * 19
        self.c = (data[0] if data else 0xFF) << 16
        self.fill()
        self.c <<= 7
        self.count -= 7
        self.a = 0x8000

    def fill(self) -> None:
        data, at = self.data, self.at
        here = data[at] if at < len(data) else 0xFF
        after = data[at + 1] if at + 1 < len(data) else 0xFF
        if here == 0xFF and after > 0x8F:
            self.c += 0xFF00
            self.count = 8
            return
        self.at = at + 1
        self.c += after << (9 if here == 0xFF else 8)
        self.count = 7 if here == 0xFF else 8

    def bit(self, context: int) -> int:
        estimate, more, less, switch = STATES[self.state[context]]
        sense = self.sense[context]
        self.a -= estimate
        if self.c >> 16 < estimate:
            probable = self.a < estimate
            self.a = estimate
        else:
            self.c -= estimate << 16
            if self.a & 0x8000:
                return sense
            probable = self.a >= estimate
        if probable:
            self.state[context] = more
        else:
            self.sense[context] = sense ^ switch
            self.state[context] = less
            sense ^= 1
        while True:
            if not self.count:
                self.fill()
            self.a <<= 1
            self.c <<= 1
            self.count -= 1
            if self.a & 0x8000:
                return sense


def zero_context(band: str, h: int, v: int, d: int) -> int:
    """The context of a coefficient that is not significant yet, by its significant neighbours (table D.1)."""
    if band == "HH":
        near = min(h + v, 2)
        return 8 if d >= 3 else (6 + min(near, 1) if d == 2 else 3 * d + near)
    if band == "HL":
        h, v = v, h
    if h == 2:
        return 8
    if h == 1:
        return 7 if v else 6 if d else 5
    return 2 + v if v else min(d, 2)


ZERO = {band: [zero_context(band, h, v, d) for h in range(3) for v in range(3) for d in range(5)] for band in ("LL", "LH", "HL", "HH")}
#: (context, flip) of a sign by the senses of its horizontal and vertical neighbours (table D.3).
SIGN = {(h, v): (9 + abs(3 * h + v) if h * v >= 0 or not h else 11, int(h < 0 or not h and v < 0)) for h in (-1, 0, 1) for v in (-1, 0, 1)}


class Block:
    """Coefficients of one code-block while its passes go over them; a border of one keeps neighbours in range.

    coder.bit(context) gives a decision; the same passes drive an encoder, whose bit also takes the true decision.
    """

    def __init__(self, band: str, width: int, height: int):
        self.zero, self.width, self.height, self.stride = ZERO[band], width, height, width + 2
        size = self.stride * (height + 2)
        self.known, self.minus, self.seen, self.refined, self.value = ([0] * size for _ in range(5))

    def order(self) -> Iterator[tuple[int, int]]:
        """(index, rows of the stripe that follow it): stripes of four rows, column by column."""
        for top in range(0, self.height, 4):
            rows = min(4, self.height - top)
            for x in range(self.width):
                first = (top + 1) * self.stride + x + 1
                for k in range(rows):
                    yield first + k * self.stride, rows - k if k else -rows

    def near(self, i: int) -> tuple[int, int, int]:
        s, w = self.known, self.stride
        return s[i - 1] + s[i + 1], s[i - w] + s[i + w], s[i - w - 1] + s[i - w + 1] + s[i + w - 1] + s[i + w + 1]

    def context(self, i: int) -> int:
        h, v, d = self.near(i)
        return self.zero[h * 15 + v * 5 + d]

    def sign(self, i: int, coder, truth) -> None:
        s, m, w = self.known, self.minus, self.stride
        one = lambda j: s[j] * (1 - 2 * m[j])
        h, v = one(i - 1) + one(i + 1), one(i - w) + one(i + w)
        context, flip = SIGN[(max(-1, min(1, h)), max(-1, min(1, v)))]
        self.minus[i] = coder.bit(context, *(() if truth is None else (truth[1][i] ^ flip,))) ^ flip
        s[i] = 1

    def significance(self, coder, plane: int, truth=None) -> None:
        for i, _ in self.order():
            if not self.known[i] and (context := self.context(i)):
                self.seen[i] = 1
                if coder.bit(context, *(() if truth is None else (truth[0][i] >> plane & 1,))):
                    self.value[i] |= 1 << plane
                    self.sign(i, coder, truth)

    def refinement(self, coder, plane: int, truth=None) -> None:
        for i, _ in self.order():
            if self.known[i] and not self.seen[i]:
                context = 16 if self.refined[i] else 15 if any(self.near(i)) else 14
                self.refined[i] = 1
                self.value[i] |= coder.bit(context, *(() if truth is None else (truth[0][i] >> plane & 1,))) << plane

    def cleanup(self, coder, plane: int, truth=None) -> None:
        skip, w = 0, self.stride
        told = lambda x: () if truth is None else (x,)
        for i, left in self.order():
            if skip:
                skip -= 1
                continue
            certain = False
            if left == -4 and not any(self.known[i + k * w] or self.seen[i + k * w] or self.context(i + k * w) for k in range(4)):
                first = next((k for k in range(4) if truth is not None and truth[0][i + k * w] >> plane & 1), 4)
                if not coder.bit(RUN, *told(int(first < 4))):
                    skip = 3
                    continue
                first = coder.bit(PLAIN, *told(first >> 1 & 1)) << 1
                first |= coder.bit(PLAIN, *told(self.second(i, plane, truth)))
                if first:  # the run ends below: go on after it
                    self.hit(i + first * w, coder, plane, truth)
                    skip = first
                    for k in range(first + 1, 4):
                        self.plain(i + k * w, coder, plane, truth)
                    skip = 3
                    continue
                certain = True
            if certain:
                self.hit(i, coder, plane, truth)
            elif not self.known[i] and not self.seen[i]:
                self.plain(i, coder, plane, truth)
        self.seen = [0] * len(self.seen)

    def second(self, i: int, plane: int, truth) -> int:
        return 0 if truth is None else next(k for k in range(4) if truth[0][i + k * self.stride] >> plane & 1) & 1

    def hit(self, i: int, coder, plane: int, truth) -> None:
        self.value[i] |= 1 << plane
        self.sign(i, coder, truth)

    def plain(self, i: int, coder, plane: int, truth) -> None:
        if coder.bit(self.context(i), *(() if truth is None else (truth[0][i] >> plane & 1,))):
            self.hit(i, coder, plane, truth)

    def passes(self, coder_of, planes: int, count: int, style: int, truth=None) -> int:
        """Runs count passes from the highest of planes bit planes on; returns the lowest plane that is complete."""
        plane = planes - 1
        for k in range(count):
            coder = coder_of(k)
            (self.cleanup, self.significance, self.refinement)[k % 3](coder, plane, truth)
            if k % 3 == 0:
                if style & SYMBOLS:
                    for want in (1, 0, 1, 0):
                        coder.bit(PLAIN, *(() if truth is None else (want,)))
                plane -= 1
        return plane + 1

    def magnitudes(self) -> tuple[np.ndarray, np.ndarray]:
        cut = lambda a: np.array(a, np.int64).reshape(self.height + 2, self.stride)[1:-1, 1:-1]
        return cut(self.value), cut(self.minus)


class HeaderBits:
    """Bits of packet headers: after a byte of ones the next has seven bits."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at, self.byte, self.left = data, at, 0, 0

    def bit(self) -> int:
        if not self.left:
            self.left = 7 if self.byte == 0xFF else 8
            if self.at >= len(self.data):
                raise FrameError("truncatedPixelData")
            self.byte = self.data[self.at]
            self.at += 1
        self.left -= 1
        return self.byte >> self.left & 1

    def take(self, n: int) -> int:
        out = 0
        for _ in range(n):
            out = out << 1 | self.bit()
        return out

    def end(self) -> int:
        if self.byte == 0xFF:
            self.at += 1
        return self.at


class TagTree:
    """A quad tree of minima whose values come bit by bit (B.10.2)."""

    def __init__(self, width: int, height: int):
        self.sizes = [(width, height)]
        while self.sizes[-1] != (1, 1) and width and height:
            w, h = self.sizes[-1]
            self.sizes.append(((w + 1) // 2, (h + 1) // 2))
        self.low = [[0] * (w * h) for w, h in self.sizes]
        self.done = [[False] * (w * h) for w, h in self.sizes]

    def below(self, bits: HeaderBits, x: int, y: int, limit: int) -> bool:
        """Is the leaf's value less than limit; reads what is needed to know."""
        low = 0
        for level in range(len(self.sizes) - 1, -1, -1):
            k = (y >> level) * self.sizes[level][0] + (x >> level)
            low = max(low, self.low[level][k])
            while low < limit and not self.done[level][k]:
                if bits.bit():
                    self.done[level][k] = True
                else:
                    low += 1
            self.low[level][k] = low
        return self.done[0][k] and low < limit

    def value(self, bits: HeaderBits, x: int, y: int) -> int:
        limit = 1
        while not self.below(bits, x, y, limit):
            limit += 1
            if limit > 80:
                raise FrameError("truncatedPixelData")
        return limit - 1


@dataclass
class Coded:
    """What packets say of one code-block."""

    x0: int
    y0: int
    x1: int
    y1: int
    included: bool = False
    missing: int = 0
    length_bits: int = 3
    passes: int = 0
    segments: list[bytes] = field(default_factory=list)


@dataclass
class Band:
    kind: str
    x0: int
    y0: int
    x1: int
    y1: int
    planes: int
    step: float
    blocks: list[Coded] = field(default_factory=list)


@dataclass
class Style:
    """Coding and quantisation of one component."""

    levels: int = 0
    block: tuple[int, int] = (64, 64)
    style: int = 0
    reversible: bool = True
    precincts: list[tuple[int, int]] = field(default_factory=list)
    guard: int = 0
    quantised: int = 0
    steps: list[tuple[int, int]] = field(default_factory=list)

    def step(self, k: int, band_level: int) -> tuple[int, int]:
        """Exponent and mantissa of the k-th band."""
        if self.quantised == 1:
            return self.steps[0][0] - max(0, self.levels - band_level), self.steps[0][1]
        return self.steps[k]


def up(a: int, shift: int) -> int:
    return -(-a >> shift)


def coding_style(body: bytes, own: bool) -> dict:
    """Fields of Style from the parameters of a COD or COC segment; own: precinct sizes follow."""
    levels, w, h, style, wavelet = body[:5]
    if levels > 32 or w > 8 or h > 8 or w + h > 8 or wavelet > 1:
        raise FrameError("unsupportedPixelFormat")
    if style & (BYPASS | CAUSAL):
        raise FrameError("unsupportedPixelFormat")
    sizes = [(b & 15, b >> 4) for b in body[5 : 6 + levels]] if own else [(15, 15)] * (levels + 1)
    if len(sizes) != levels + 1 or any(0 in s for s in sizes[1:]):
        raise FrameError("truncatedPixelData")
    return {"levels": levels, "block": (4 << w, 4 << h), "style": style, "reversible": wavelet == 1, "precincts": sizes}


def quantisation(body: bytes) -> dict:
    kind = body[0] & 31
    if kind > 2:
        raise FrameError("unsupportedPixelFormat")
    if kind == 0:
        steps = [(b >> 3, 0) for b in body[1:]]
    else:
        steps = [(v >> 11, v & 0x7FF) for (v,) in struct.iter_unpack(">H", body[1 : 1 + (len(body) - 1) // 2 * 2])]
    if not steps:
        raise FrameError("truncatedPixelData")
    return {"guard": body[0] >> 5, "quantised": kind, "steps": steps}


@dataclass
class Resolution:
    """A resolution of one tile-component: its bands and precincts; a precinct lists (band, blocks, width, trees)."""

    bands: list[Band]
    precincts: list[tuple[int, int, list]]


def resolutions(style: Style, precision: int, x0: int, y0: int, x1: int, y1: int) -> list[Resolution]:
    out = []
    for r in range(style.levels + 1):
        down, (pw, ph) = style.levels - r, style.precincts[r]
        rx0, ry0, rx1, ry1 = up(x0, down), up(y0, down), up(x1, down), up(y1, down)
        bands = []
        for n, (kind, ox, oy) in enumerate([("LL", 0, 0)] if not r else [("HL", 1, 0), ("LH", 0, 1), ("HH", 1, 1)]):
            level = style.levels if not r else down + 1
            at = lambda v, o: up(v - ((o << level) >> 1), level)  # noqa: B023, E731
            exponent, mantissa = style.step(0 if not r else 3 * r - 2 + n, level)
            gain = {"LL": 0, "HL": 1, "LH": 1, "HH": 2}[kind]
            step = 1.0 if style.reversible else 2.0 ** (precision + gain - exponent) * (1 + mantissa / 2048)
            bands.append(Band(kind, at(x0, ox), at(y0, oy), at(x1, ox), at(y1, oy), style.guard + exponent - 1, step))
        precincts = []
        if rx1 > rx0 and ry1 > ry0:
            shift = 1 if r else 0
            bw, bh = min(style.block[0], 1 << pw - shift), min(style.block[1], 1 << ph - shift)
            for py in range(ry0 >> ph, up(ry1, ph)):
                for px in range(rx0 >> pw, up(rx1, pw)):
                    parts = []
                    for band in bands:
                        cx0, cx1 = max(band.x0, px << pw - shift), min(band.x1, px + 1 << pw - shift)
                        cy0, cy1 = max(band.y0, py << ph - shift), min(band.y1, py + 1 << ph - shift)
                        if cx1 <= cx0 or cy1 <= cy0:
                            continue
                        gx, gy = range(cx0 // bw, -(-cx1 // bw)), range(cy0 // bh, -(-cy1 // bh))
                        own = [Coded(max(cx0, x * bw), max(cy0, y * bh), min(cx1, (x + 1) * bw), min(cy1, (y + 1) * bh)) for y in gy for x in gx]
                        band.blocks += own
                        parts.append((own, len(gx), TagTree(len(gx), len(gy)), TagTree(len(gx), len(gy))))
                    precincts.append((py << ph + down, px << pw + down, parts))
        out.append(Resolution(bands, precincts))
    return out


def read_packet(data: bytes, at: int, parts: list, layer: int, style: Style) -> int:
    """Takes one packet's pieces into its code-blocks; returns where the next begins."""
    if data[at : at + 2] == b"\xff\x91":
        at += 6
    bits, taken = HeaderBits(data, at), []
    if bits.bit():
        for blocks, width, inclusion, planes in parts:
            for k, block in enumerate(blocks):
                y, x = divmod(k, width)
                if not (bits.bit() if block.included else inclusion.below(bits, x, y, layer + 1)):
                    continue
                if not block.included:
                    block.included, block.missing = True, planes.value(bits, x, y)
                passes = pass_count(bits)
                while bits.bit():
                    block.length_bits += 1
                    if block.length_bits > 40:
                        raise FrameError("truncatedPixelData")
                lengths = [bits.take(block.length_bits) for _ in range(passes)] if style.style & TERMINATE else [bits.take(block.length_bits + passes.bit_length() - 1)]
                taken.append((block, passes, lengths))
    at = bits.end()
    if data[at : at + 2] == b"\xff\x92":
        at += 2
    for block, passes, lengths in taken:
        block.passes += passes
        for n in lengths:
            if at + n > len(data):
                raise FrameError("truncatedPixelData")
            block.segments.append(data[at : at + n])
            at += n
    return at


def pass_count(bits: HeaderBits) -> int:
    for base, width in ((1, 0), (2, 0), (3, 2), (6, 5)):
        if not width:
            if not bits.bit():
                return base
        elif (more := bits.take(width)) != (1 << width) - 1:
            return base + more
    return 37 + bits.take(7)


def packets(progression: int, layers: int, tile: list[list[Resolution]], x0: int, y0: int) -> Iterator[tuple[int, int, list]]:
    """(layer, component, precinct parts) in the order of the progression."""
    every = []
    for c, own in enumerate(tile):
        for r, resolution in enumerate(own):
            for p, (y, x, parts) in enumerate(resolution.precincts):
                every.append((r, c, p, max(y, y0), max(x, x0), parts))
    keys = {2: lambda e: (e[0], e[3], e[4], e[1], e[2]), 3: lambda e: (e[3], e[4], e[1], e[0], e[2]), 4: lambda e: (e[1], e[3], e[4], e[0], e[2])}
    if progression < 2:
        every.sort(key=lambda e: e[:3])
        order = [(n, e) for n in range(layers) for e in every] if not progression else [(n, e) for r in sorted({e[0] for e in every}) for n in range(layers) for e in every if e[0] == r]
    else:
        every.sort(key=keys[progression])
        order = [(n, e) for e in every for n in range(layers)]
    for n, e in order:
        yield n, e[1], e[5]


def coefficients(band: Band, style: Style) -> np.ndarray:
    """A band's coefficients, dequantised."""
    out = np.zeros((band.y1 - band.y0, band.x1 - band.x0), np.int64 if style.reversible else np.float64)
    for b in band.blocks:
        if not b.passes:
            continue
        planes = band.planes - b.missing
        if planes < 1 or b.passes > 3 * planes - 2 or planes > 62:
            raise FrameError("truncatedPixelData")
        block = Block(band.kind, b.x1 - b.x0, b.y1 - b.y0)
        if style.style & TERMINATE:
            states, senses = list(BEGIN), [0] * 19

            def coder_of(k: int, b=b, states=states, senses=senses):
                if style.style & RESET:
                    states[:], senses[:] = BEGIN, [0] * 19
                return Arithmetic(b.segments[k], states, senses)
        else:
            one = Arithmetic(b"".join(b.segments))

            def coder_of(k: int, one=one):
                if k and style.style & RESET:
                    one.state[:], one.sense[:] = BEGIN, [0] * 19
                return one

        lowest = block.passes(coder_of, planes, b.passes, style.style)
        value, minus = block.magnitudes()
        if not style.reversible:
            value = (value + np.where(value > 0, 0.5 * (1 << lowest), 0)) * band.step
        out[b.y0 - band.y0 : b.y1 - band.y0, b.x0 - band.x0 : b.x1 - band.x0] = np.where(minus == 1, -value, value)
    return out


def merged(low: np.ndarray, high: np.ndarray, start: int, end: int, reversible: bool) -> np.ndarray:
    """One inverse filter step along the first axis; sample k of the result has the coordinate start + k."""
    n = end - start
    y = np.zeros((n, *low.shape[1:]), low.dtype)
    y[start % 2 :: 2], y[1 - start % 2 :: 2] = low, high
    if n == 1:
        return y if start % 2 == 0 else (y >> 1 if reversible else y / 2)
    pad = 4 + start % 2  # an even coordinate stands first, and enough of them for four steps
    x = np.pad(y, [(pad, 5)] + [(0, 0)] * (y.ndim - 1), mode="reflect")
    if reversible:
        x[2:-1:2] -= (x[1:-2:2] + x[3::2][: len(x[2:-1:2])] + 2) >> 2
        x[3:-2:2] += (x[2:-3:2] + x[4:-1:2][: len(x[3:-2:2])]) >> 1
    else:
        x[::2] *= SCALE
        x[1::2] /= SCALE
        for lift, first in ((LIFTS[3], 0), (LIFTS[2], 1), (LIFTS[1], 0), (LIFTS[0], 1)):
            inner = np.arange(2 - first % 2 if first else 2, len(x) - 1, 2)
            x[inner] -= lift * (x[inner - 1] + x[inner + 1])
    return x[pad : pad + n]


def synthesised(own: list[Resolution], style: Style, bounds: tuple[int, int, int, int]) -> np.ndarray:
    """A tile-component from its bands."""
    x0, y0, x1, y1 = bounds
    image = coefficients(own[0].bands[0], style)
    for r in range(1, style.levels + 1):
        down = style.levels - r
        rx0, ry0, rx1, ry1 = up(x0, down), up(y0, down), up(x1, down), up(y1, down)
        hl, lh, hh = (coefficients(b, style) for b in own[r].bands)
        across = lambda a, b: merged(a.T, b.T, rx0, rx1, style.reversible).T  # noqa: B023, E731
        image = merged(across(image, hl), across(lh, hh), ry0, ry1, style.reversible) if rx1 > rx0 and ry1 > ry0 else np.zeros((ry1 - ry0, rx1 - rx0), image.dtype)
    return image


def decode(data: bytes, size: tuple[int, int, int] | None = None) -> Image:
    """Samples of a codestream, RGB where it says that its components were transformed; size as in jpeg_lossless.

    predictor is 1 if any component is irreversible. Signed samples come as their two's complement.
    """
    if data[:4] != b"\xff\x4f\xff\x51":
        raise FrameError("unsupportedPixelFormat")
    at, head, parts, current = 2, None, {}, None
    main: dict = {"cod": None, "coc": {}, "qcd": None, "qcc": {}}
    own: dict[int, dict] = {}
    while True:
        if at + 2 > len(data) or data[at] != 0xFF:
            raise FrameError("truncatedPixelData")
        marker = data[at + 1]
        if marker == 0xD9:
            break
        if marker == 0x93:  # the tile-part's data
            if current is None:
                raise FrameError("truncatedPixelData")
            tile, end = current
            parts.setdefault(tile, []).append(data[at + 2 : end])
            at, current = end, None
            continue
        if at + 4 > len(data):
            raise FrameError("truncatedPixelData")
        length = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + length]
        if len(body) != length - 2:
            raise FrameError("truncatedPixelData")
        where = main if current is None else own.setdefault(current[0], {"cod": None, "coc": {}, "qcd": None, "qcc": {}})
        if marker == 0x51:
            head = image_size(body, size)
        elif head is None:
            raise FrameError("truncatedPixelData")
        elif marker == 0x52:
            where["cod"] = (body[0], body[1], struct.unpack_from(">H", body, 2)[0], body[4], coding_style(body[5:], bool(body[0] & 1)))
        elif marker == 0x53:
            where["coc"][body[0]] = coding_style(body[2:], bool(body[1] & 1))
        elif marker == 0x5C:
            where["qcd"] = quantisation(body)
        elif marker == 0x5D:
            where["qcc"][body[0]] = quantisation(body[1:])
        elif marker == 0x90:
            tile, total = struct.unpack_from(">HI", body)
            end = at + total if total else len(data) - 2
            if end > len(data) or end < at + 12 or tile >= head.tiles:
                raise FrameError("truncatedPixelData")
            current = tile, end
        elif marker in (0x5E, 0x5F, 0x60, 0x61) or head.components > 256:
            raise FrameError("unsupportedPixelFormat")
        at += 2 + length
    if head is None or set(parts) != set(range(head.tiles)):
        raise FrameError("truncatedPixelData")
    out, lossy = np.zeros((head.y1 - head.y0, head.x1 - head.x0, head.components), np.int64), False
    for tile, pieces in parts.items():
        planes, bounds, any_lossy = tile_planes(head, main, own.get(tile, {"cod": None, "coc": {}, "qcd": None, "qcc": {}}), tile, b"".join(pieces))
        x0, y0, x1, y1 = bounds
        lossy |= any_lossy
        for c, plane in enumerate(planes):
            low, high = (-(1 << head.precision - 1), (1 << head.precision - 1) - 1) if head.signed else (0, (1 << head.precision) - 1)
            shifted = np.floor(plane + 0.5).astype(np.int64) + (0 if head.signed else 1 << head.precision - 1)
            out[y0 - head.y0 : y1 - head.y0, x0 - head.x0 : x1 - head.x0, c] = np.clip(shifted, low, high)
    return Image(out & ((1 << head.precision) - 1), out.shape[0], out.shape[1], head.precision, head.components, int(lossy))


@dataclass
class Head:
    x0: int
    y0: int
    x1: int
    y1: int
    tile: tuple[int, int, int, int]
    components: int
    precision: int
    signed: bool

    @property
    def across(self) -> int:
        return -(-(self.x1 - self.tile[2]) // self.tile[0])

    @property
    def tiles(self) -> int:
        return self.across * -(-(self.y1 - self.tile[3]) // self.tile[1])


def image_size(body: bytes, size: tuple[int, int, int] | None) -> Head:
    _, x1, y1, x0, y0, tw, th, tx, ty, n = struct.unpack_from(">H8IH", body)
    if len(body) != 36 + 3 * n or not n or x1 <= x0 or y1 <= y0 or not tw or not th or tx > x0 or ty > y0:
        raise FrameError("truncatedPixelData")
    kinds = {body[36 + 3 * k] for k in range(n)}
    precision = (body[36] & 127) + 1
    if len(kinds) != 1 or any(body[37 + 3 * k : 39 + 3 * k] != b"\1\1" for k in range(n)) or precision > 16:
        raise FrameError("unsupportedPixelFormat")
    expect((y1 - y0, x1 - x0, n), size)
    return Head(x0, y0, x1, y1, (tw, th, tx, ty), n, precision, bool(body[36] >> 7))


def tile_planes(head: Head, main: dict, own: dict, tile: int, data: bytes) -> tuple[list[np.ndarray], tuple[int, int, int, int], bool]:
    """The components of one tile, its bounds, and whether any is irreversible."""
    row, column = divmod(tile, head.across)
    tw, th, tx, ty = head.tile
    bounds = max(tx + column * tw, head.x0), max(ty + row * th, head.y0), min(tx + (column + 1) * tw, head.x1), min(ty + (row + 1) * th, head.y1)
    cod = own["cod"] or main["cod"]
    if cod is None or not (own["qcd"] or main["qcd"]):
        raise FrameError("truncatedPixelData")
    _, progression, layers, transform, default = cod
    if progression > 4 or not layers or transform > 1:
        raise FrameError("unsupportedPixelFormat")
    styles = []
    for c in range(head.components):
        coding = own["coc"].get(c) or (own["cod"] and default) or main["coc"].get(c) or default
        quant = own["qcc"].get(c) or own["qcd"] or main["qcc"].get(c) or main["qcd"]
        styles.append(Style(**coding, **quant))
        if quant["quantised"] != 1 and len(quant["steps"]) < 3 * coding["levels"] + 1:
            raise FrameError("truncatedPixelData")
    parts = [resolutions(s, head.precision, *bounds) for s in styles]
    at = 0
    for layer, c, precinct in packets(progression, layers, parts, bounds[0], bounds[1]):
        if at >= len(data):
            break  # a stream may end early: what came is shown
        at = read_packet(data, at, precinct, layer, styles[c])
    planes = [synthesised(p, s, bounds) for p, s in zip(parts, styles, strict=True)]
    if transform:
        if len(planes) < 3 or len({s.reversible for s in styles[:3]}) != 1:
            raise FrameError("unsupportedPixelFormat")
        y, b, r = planes[:3]
        if styles[0].reversible:
            green = y - ((b + r) >> 2)
            planes[:3] = [r + green, green, b + green]
        else:
            planes[:3] = [y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b]
    return planes, bounds, not all(s.reversible for s in styles)


class ArithmeticWriter:
    """The arithmetic encoder of one codeword segment."""

    def __init__(self, states: list[int] | None = None, senses: list[int] | None = None):
        self.a, self.c, self.count, self.out = 0x8000, 0, 12, bytearray(1)
        self.state, self.sense = states or list(BEGIN), senses or [0] * 19

    def bit(self, context: int, decision: int) -> int:
        estimate, more, less, switch = STATES[self.state[context]]
        self.a -= estimate
        expected = decision == self.sense[context]
        if expected and self.a & 0x8000:
            self.c += estimate
            return decision
        if (self.a < estimate) == expected:
            self.a = estimate
        else:
            self.c += estimate
        if expected:
            self.state[context] = more
        else:
            self.sense[context] ^= switch
            self.state[context] = less
        while True:
            self.a <<= 1
            self.c <<= 1
            self.count -= 1
            if not self.count:
                self.put()
            if self.a & 0x8000:
                return decision

    def put(self) -> None:
        if self.out[-1] != 0xFF and self.c >= 0x8000000:
            self.out[-1] += 1
            self.c &= 0x7FFFFFF
        wide = self.out[-1] != 0xFF
        self.out.append(self.c >> (19 if wide else 20) & 255)
        self.c &= 0x7FFFF if wide else 0xFFFFF
        self.count = 8 if wide else 7

    def end(self) -> bytes:
        top = self.c + self.a
        self.c |= 0xFFFF
        if self.c >= top:
            self.c -= 0x8000
        for _ in range(2):
            self.c <<= self.count
            self.put()
        return bytes(self.out[1:] if self.out[-1] != 0xFF else self.out[1:-1])


class HeaderWriter:
    def __init__(self):
        self.out, self.byte, self.left = bytearray(), 0, 8

    def put(self, value: int, n: int = 1) -> None:
        for k in range(n - 1, -1, -1):
            self.left -= 1
            self.byte |= (value >> k & 1) << self.left
            if not self.left:
                self.out.append(self.byte)
                self.left = 7 if self.byte == 0xFF else 8
                self.byte = 0

    def end(self) -> bytes:
        if self.left < 8 and not (self.left == 7 and self.out[-1:] == b"\xff"):
            self.out.append(self.byte)
        if self.out[-1:] == b"\xff":
            self.out.append(0)
        return bytes(self.out)


class TreeWriter(TagTree):
    def __init__(self, width: int, height: int, values: list[int]):
        super().__init__(width, height)
        self.values = [values]
        for (w, h), (pw, _) in zip(self.sizes[1:], self.sizes, strict=False):
            last = self.values[-1]
            self.values.append([min(last[b * pw + a] for b in range(2 * y, min(2 * y + 2, len(last) // pw)) for a in range(2 * x, min(2 * x + 2, pw))) for y in range(h) for x in range(w)])

    def write(self, out: HeaderWriter, x: int, y: int, limit: int) -> None:
        low = 0
        for level in range(len(self.sizes) - 1, -1, -1):
            k = (y >> level) * self.sizes[level][0] + (x >> level)
            low = max(low, self.low[level][k])
            while low < limit and not self.done[level][k]:
                if self.values[level][k] <= low:
                    out.put(1)
                    self.done[level][k] = True
                else:
                    out.put(0)
                    low += 1
            self.low[level][k] = low


def parted(x: np.ndarray, start: int, reversible: bool) -> tuple[np.ndarray, np.ndarray]:
    """One forward filter step along the first axis: low and high coefficients."""
    n = len(x)
    if n == 1:
        return (x, x[:0]) if start % 2 == 0 else (x[:0], x * 2)
    pad = 4 + start % 2
    y = np.pad(x, [(pad, 5)] + [(0, 0)] * (x.ndim - 1), mode="reflect")
    for k, lift in enumerate(LIFTS[:2] if reversible else LIFTS):
        inner = np.arange(1 if k % 2 == 0 else 2, len(y) - 1, 2)
        near = y[inner - 1] + y[inner + 1]
        y[inner] += (-(near >> 1) if k % 2 == 0 else near + 2 >> 2) if reversible else lift * near
    if not reversible:
        y[::2] /= SCALE
        y[1::2] *= SCALE
    y = y[pad : pad + n]
    return y[start % 2 :: 2], y[1 - start % 2 :: 2]


def number_of_passes(out: HeaderWriter, n: int) -> None:
    if n < 3:
        out.put((0, 0b10)[n - 1], n)
    elif n < 6:
        out.put(0b1100 | n - 3, 4)
    elif n < 37:
        out.put(0b1111 << 5 | n - 6, 9)
    else:
        out.put(0b111111111 << 7 | n - 37, 16)


def encode(samples: np.ndarray, precision: int, levels: int = 2, reversible: bool = True, transform: bool = False, block: int = 64, style: int = 0, progression: int = 0) -> bytes:
    """A stream of one tile and one layer, for tests and bridges; samples has the shape (rows, columns, components)."""
    rows, columns, n = samples.shape
    power = block.bit_length() - 3
    steps = [(precision + 3, 0)] * (3 * levels + 1)
    quant = bytes([2 << 5 | (0 if reversible else 2)]) + b"".join(bytes([e << 3]) if reversible else struct.pack(">H", e << 11 | m) for e, m in steps)
    cod = struct.pack(">BBHB", 0, progression, 1, transform) + bytes([levels, power, power, style, int(reversible)])
    own = Style(**coding_style(cod[5:], False), **quantisation(quant))
    planes = [samples[:, :, c].astype(np.int64) - (1 << precision - 1) for c in range(n)]
    if transform and reversible:
        r, g, b = planes[:3]
        planes[:3] = [r + 2 * g + b >> 2, b - g, r - g]
    elif transform:
        r, g, b = planes[:3]
        y = 0.299 * r + 0.587 * g + 0.114 * b
        planes[:3] = [y, (b - y) / 1.772, (r - y) / 1.402]
    tile = []
    for plane in planes:
        parts, image = resolutions(own, precision, 0, 0, columns, rows), plane if reversible else plane.astype(float)
        bands = {}
        for r in range(levels, 0, -1):
            top, bottom = parted(image, 0, reversible)
            (ll, hl), (lh, hh) = ([h.T for h in parted(half.T, 0, reversible)] for half in (top, bottom))
            bands[r], image = [hl, lh, hh], ll
        bands[0] = [image]
        for r, resolution in enumerate(parts):
            for band, values in zip(resolution.bands, bands[r], strict=True):
                whole = values if reversible else np.sign(values) * np.floor(np.abs(values) / band.step)
                for b in band.blocks:
                    write_block(band, b, whole[b.y0 - band.y0 : b.y1 - band.y0, b.x0 - band.x0 : b.x1 - band.x0].astype(np.int64), own)
        tile.append(parts)
    body = b"".join(written_packet(parts, own) for _, _, parts in packets(progression, 1, tile, 0, 0))
    segment = lambda marker, raw: bytes([0xFF, marker]) + struct.pack(">H", len(raw) + 2) + raw
    out = b"\xff\x4f" + segment(0x51, struct.pack(">H8IH", 0, columns, rows, 0, 0, columns, rows, 0, 0, n) + bytes([precision - 1, 1, 1]) * n)
    out += segment(0x52, cod) + segment(0x5C, quant) + segment(0x90, struct.pack(">HIBB", 0, 14 + len(body), 0, 1))
    return out + b"\xff\x93" + body + b"\xff\xd9"


def write_block(band: Band, coded: Coded, values: np.ndarray, own: Style) -> None:
    planes = int(np.abs(values).max()).bit_length() if values.size else 0
    coded.missing, coded.passes = band.planes - planes, max(0, 3 * planes - 2)
    if not planes:
        return
    block = Block(band.kind, values.shape[1], values.shape[0])
    padded = np.pad(values, 1)
    truth = np.abs(padded).reshape(-1).tolist(), (padded < 0).astype(int).reshape(-1).tolist()
    states, senses, writers = list(BEGIN), [0] * 19, []

    def coder_of(k: int) -> ArithmeticWriter:
        if own.style & RESET:
            states[:], senses[:] = BEGIN, [0] * 19
        if not k or own.style & TERMINATE:
            writers.append(ArithmeticWriter(states, senses))
        return writers[-1]

    block.passes(coder_of, planes, coded.passes, own.style, truth)
    coded.segments = [w.end() for w in writers]


def written_packet(parts: list, own: Style) -> bytes:
    head, body = HeaderWriter(), b""
    head.put(1)
    for blocks, width, *_ in parts:
        height = len(blocks) // width
        inclusion, planes = TreeWriter(width, height, [int(not b.passes) for b in blocks]), TreeWriter(width, height, [b.missing for b in blocks])
        for k, b in enumerate(blocks):
            y, x = divmod(k, width)
            inclusion.write(head, x, y, 1)
            if not b.passes:
                continue
            planes.write(head, x, y, b.missing + 1)
            number_of_passes(head, b.passes)
            extra = 0 if own.style & TERMINATE else b.passes.bit_length() - 1
            wide = max(3, max(len(s).bit_length() for s in b.segments) - extra)
            head.put((1 << wide - 3) - 1, wide - 3)
            head.put(0)
            for s in b.segments:
                head.put(len(s), wide + extra)
            body += b"".join(b.segments)
    return head.end() + body
