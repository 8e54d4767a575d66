"""Frame decoders against golden streams and their own encoders."""

import numpy as np
import pytest

from lumenframe.codecs import jpeg_2000, jpeg_baseline, jpeg_lossless, jpeg_ls, rle
from lumenframe.codecs.rle import FrameError
from lumenframe.operators import frames

# JPEG-LS streams of the CharLS test corpus (BSD-3-Clause) or made with its encoder, and their samples.
STREAMS = {
    "mono": ("FFD8FFF7000B080002000201011100FFDA00080101000000005A98FFD9", [1, 2, 3, 4]),
    "twelve_bit": ("FFD8FFF7000B0C0002000201011100FFDA000801010000000041830C0000000210FFD9", [1, 2, 4095, 1024]),
    "preset": ("FFD8FFF7000B080002000201011100FFF8000D0100FF0004000800160040FFDA00080101000000005A98FFD9", [1, 2, 3, 4]),
    "by_sample": ("FFD8FFF70011080001000103011100021100031100FFDA000C0301000200030000020002020700FFD9", [10, 20, 30]),
    "by_plane": ("FFD8FFF70011080002000203011100021100031100FFDA0008010100000000070003800000BB800080FFDA00080102000000000038001C000005DC0004FFDA00080103000000000001C000E000002EE00020FFD9", list(range(10, 130, 10))),
    "by_line": ("FFD8FFF70011080002000203011100021100031100FFDA000C0301000200030000010007000383DC86C000E000002EE00020D9D000000BBB80FFD9", list(range(10, 130, 10))),
    "near": ("FFD8FFF7000B080002000201011100FFDA000801010001000018C042FFD9", [9, 21, 30, 39]),
}


@pytest.mark.parametrize("name", STREAMS)
def test_jpeg_ls(name):
    stream, samples = STREAMS[name]
    assert jpeg_ls.decode(bytes.fromhex(stream)).samples.reshape(-1).tolist() == samples


def test_jpeg_ls_near_rgb_within_bound():
    stream = "FFD8FFF70011080001000103011100021100031100FFDA000C03010002000300010200086040FFD9"
    assert np.abs(jpeg_ls.decode(bytes.fromhex(stream)).samples.reshape(-1) - [10, 20, 30]).max() <= 1


@pytest.mark.parametrize("predictor", range(1, 8))
@pytest.mark.parametrize("precision", [8, 12, 16])
def test_jpeg_lossless(predictor, precision):
    r = np.random.default_rng(predictor)
    for components in (1, 3):
        for restart in (0, 5):
            samples = r.integers(0, 1 << precision, (4, 6, components))
            image = jpeg_lossless.decode(jpeg_lossless.encode(samples, precision, predictor, 0, restart))
            assert (image.samples == samples).all() and image.predictor == predictor


def test_jpeg_lossless_point_transform_and_pad_byte():
    samples = np.arange(16).reshape(4, 4) * 16
    stream = jpeg_lossless.encode(samples, 8, 1, 2)
    assert (jpeg_lossless.decode(stream + b"\0").samples[:, :, 0] == samples >> 2 << 2).all()
    for broken in (stream[:-6], stream + b"\0\0", b"\0" + stream):
        with pytest.raises(FrameError):
            jpeg_lossless.decode(broken)


def frame(*segments: bytes) -> bytes:
    offsets, at = [], 64
    for s in segments:
        offsets.append(at)
        at += len(s)
    return np.array([len(segments), *offsets, *[0] * (15 - len(offsets))], "<u4").tobytes() + b"".join(segments)


def test_rle_golden():
    assert rle.decode([frame(b"\x03\x00\x40\x80\xff")], 4, 1, 1) == bytes([0, 64, 128, 255])
    assert np.frombuffer(rle.decode([frame(b"\x01\x00\x03", b"\x01\x00\xe8")], 2, 1, 2), "<u2").tolist() == [0, 1000]
    assert rle.decode([frame(b"\x80\xff\x07")], 2, 1, 1) == b"\7\7"


@pytest.mark.parametrize(("samples", "size"), [(1, 1), (1, 2), (3, 1), (3, 2)])
def test_rle_round_trip(samples, size):
    data = bytes(np.random.default_rng(1).integers(0, 3, 500 * samples * size, dtype=np.uint8))
    assert rle.decode([rle.encode(data, samples, size)], 500, samples, size) == data


@pytest.mark.parametrize("broken", [b"", frame(b"\x03\x00"), frame(b"\x00\x01", b"\x00\x01"), frame(b"\x05\x01")])
def test_rle_rejects(broken):
    with pytest.raises(FrameError):
        rle.decode([broken], 4, 1, 1)


@pytest.mark.parametrize("restart", [0, 3])
def test_jpeg_baseline_grey(restart):
    samples = np.random.default_rng(1).integers(0, 256, (19, 21))
    image = jpeg_baseline.decode(jpeg_baseline.encode([samples], [(1, 1)], 19, 21, restart=restart))
    assert (image.rows, image.columns, image.components) == (19, 21, 1) and np.abs(image.samples[:, :, 0] - samples).max() <= 2


def test_jpeg_baseline_colour():
    r = np.random.default_rng(2)
    rgb = r.integers(0, 256, (16, 24, 3))
    image = jpeg_baseline.decode(jpeg_baseline.encode([rgb[:, :, k] for k in range(3)], [(1, 1)] * 3, 16, 24, adobe=0))
    assert np.abs(image.samples - rgb).max() <= 2
    grey, half = r.integers(0, 256, (20, 20)), np.full((10, 10), 128)
    image = jpeg_baseline.decode(jpeg_baseline.encode([grey, half, half], [(2, 2), (1, 1), (1, 1)], 20, 20))
    assert np.abs(image.samples - grey[:, :, None]).max() <= 2
    with pytest.raises(FrameError):
        jpeg_baseline.decode(jpeg_baseline.encode([grey], [(1, 1)], 20, 20)[:-30])


def fuzz_cases():
    r = np.random.default_rng(5)
    grey, rgb = r.integers(0, 256, (9, 11)), r.integers(0, 256, (6, 7, 3))
    yield "jpeg_lossless", jpeg_lossless.encode(grey, 8), (9, 11, 1)
    yield "jpeg_lossless", jpeg_lossless.encode(rgb, 8, 4, 0, 5), (6, 7, 3)
    yield "jpeg_baseline", jpeg_baseline.encode([grey], [(1, 1)], 9, 11, restart=1), (9, 11, 1)
    yield "jpeg_baseline", jpeg_baseline.encode([grey, grey[:5, :6], grey[:5, :6]], [(2, 2), (1, 1), (1, 1)], 9, 11), (9, 11, 3)
    yield "jpeg_ls", bytes.fromhex(STREAMS["by_plane"][0]), (2, 2, 3)
    yield "jpeg_ls", bytes.fromhex(STREAMS["by_line"][0]), (2, 2, 3)
    yield "jpeg_2000", jpeg_2000.encode(grey[:, :, None], 8, 2, block=8), (9, 11, 1)
    yield "jpeg_2000", jpeg_2000.encode(rgb, 8, 1, transform=True, style=6, progression=3), (6, 7, 3)
    yield "rle", rle.encode(grey.astype(np.uint8).tobytes(), 1, 1), (9, 11, 1)


@pytest.mark.parametrize("case", range(9))
def test_broken_streams_are_frame_errors(case):
    """Whatever is wrong with a stream is a FrameError, which becomes a row's status, and takes no memory beyond the frame's."""
    kind, stream, (rows, columns, samples) = list(fuzz_cases())[case]
    photometric = "RGB" if samples == 3 else "MONOCHROME2"
    r = np.random.default_rng(case)
    read = lambda data: frames.decoded_frame(kind, [data], rows, columns, samples, 8, None, photometric)
    read(stream)
    failed = 0
    for _ in range(400):
        broken = bytearray(stream)
        for _ in range(r.integers(1, 4)):
            broken[r.integers(0, len(broken))] = r.integers(0, 256)
        if r.random() < 0.3:
            broken = broken[: r.integers(0, len(broken))]
        try:
            read(bytes(broken))
        except FrameError:
            failed += 1
    assert failed > 20


def test_jpeg_lossless_headers():
    stream = bytearray(jpeg_lossless.encode(np.arange(12).reshape(3, 4), 8))
    frame, table, scan = stream.index(b"\xff\xc3"), stream.index(b"\xff\xc4"), stream.index(b"\xff\xda")
    for at, value in ((frame + 11, 0x21), (frame + 12, 1), (table + 4, 0x10), (scan + 6, 0x01), (scan + 8, 1), (scan + 9, 0x10)):
        broken = bytearray(stream)
        broken[at] = value
        with pytest.raises(FrameError, match="unsupportedPixelFormat"):
            jpeg_lossless.decode(bytes(broken))
    with pytest.raises(FrameError, match="invalidImageAttributes"):
        jpeg_lossless.decode(bytes(stream), (3, 5, 1))


def test_arithmetic_coder_golden():
    """The test sequence of the arithmetic coder's standard (T.88, annex H.2)."""
    coded = bytes.fromhex("84C73BFCE1A1430402200000410DBB86F4317FFF88FF37471ADB6ADFFFAC")
    plain = bytes.fromhex("00020051000000C0035287 2AAAAAAAAA82C02000FCD79EF6BF7FED904F46A3BF".replace(" ", ""))
    coder = jpeg_2000.Arithmetic(coded, [0] * 19, [0] * 19)
    assert np.packbits([coder.bit(0) for _ in range(256)]).tobytes() == plain
    writer = jpeg_2000.ArithmeticWriter([0] * 19, [0] * 19)
    for b in np.unpackbits(np.frombuffer(plain, np.uint8)).tolist():
        writer.bit(0, b)
    assert writer.end() == coded[:-2]


def test_jpeg_2000_block_golden():
    """A code-block of the worked example of T.800, annex J.10."""
    block, coder = jpeg_2000.Block("LH", 1, 4), jpeg_2000.Arithmetic(bytes.fromhex("0FB176"))
    block.passes(lambda k: coder, 3, 7, 0)
    value, minus = block.magnitudes()
    assert (value * (1 - 2 * minus)).reshape(-1).tolist() == [1, 5, 1, 0]
    low, high = np.array([[-26], [-22], [-30], [-32], [-19]]), np.array([[1], [5], [1], [0]])
    assert (jpeg_2000.merged(low, high, 0, 9, True) + 128).reshape(-1).tolist() == [101, 103, 104, 105, 96, 97, 96, 102, 109]


@pytest.mark.parametrize("case", [(1, 1, 1, 8, 0, 0, 64, 0, 0), (9, 1, 1, 8, 1, 0, 64, 0, 0), (40, 37, 1, 16, 3, 0, 8, 0, 2), (20, 33, 3, 8, 2, 1, 16, 0, 1), (20, 33, 3, 8, 2, 1, 16, 4, 3), (20, 33, 3, 8, 2, 0, 16, 6, 4), (33, 20, 1, 10, 5, 0, 4, 32, 0)])
def test_jpeg_2000(case):
    rows, columns, n, precision, levels, transform, block, style, progression = case
    samples = np.random.default_rng(rows).integers(0, 1 << precision, (rows, columns, n))
    image = jpeg_2000.decode(jpeg_2000.encode(samples, precision, levels, True, bool(transform), block, style, progression), (rows, columns, n))
    assert (image.samples == samples).all() and (image.precision, image.predictor) == (precision, 0)


@pytest.mark.parametrize("start", [0, 1, 2, 5])
@pytest.mark.parametrize("n", [1, 2, 3, 8, 9])
def test_wavelets_invert(start, n):
    x = np.random.default_rng(n).integers(-99, 99, (n, 3))
    assert (jpeg_2000.merged(*jpeg_2000.parted(x, start, True), start, start + n, True) == x).all()
    assert np.allclose(jpeg_2000.merged(*jpeg_2000.parted(x.astype(float), start, False), start, start + n, False), x)


@pytest.mark.parametrize("transform", [False, True])
def test_jpeg_2000_irreversible(transform):
    r = np.random.default_rng(3)
    samples = np.clip(np.add.outer(np.arange(40) * 3, np.arange(50) * 2)[:, :, None] + r.integers(0, 20, (40, 50, 3)), 0, 255)
    image = jpeg_2000.decode(jpeg_2000.encode(samples, 8, 3, False, transform))
    assert image.predictor == 1 and np.abs(image.samples - samples).max() <= 2
