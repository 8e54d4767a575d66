"""Image frames: assembly from decoded files, and rendering to 8-bit buffers.

`frames_of` makes one row per frame with everything that rendering needs; a file whose pixel data cannot be resolved
as a whole gives one row with a status and no frame. `render` turns frames into grey or RGB bytes. Both are per-file
work in Arrow batches without a shuffle; the arithmetic for whole tables of samples is in functions.pixels.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumenframe import binary
from lumenframe.arrow import mapped
from lumenframe.codecs import jpeg_2000, jpeg_baseline, jpeg_lossless, jpeg_ls, rle
from lumenframe.codecs.rle import FrameError
from lumenframe.dataset import INTEGER, DataSet
from lumenframe.model import TRANSFER_SYNTAXES

DOUBLE, INT, TEXT = T.DoubleType(), T.IntegerType(), T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


PRESET = _struct(center=DOUBLE, width=DOUBLE, explanation=TEXT)
LUT = _struct(first=INT, bits=INT, entries=T.ArrayType(INT), explanation=TEXT)
PALETTE = _struct(first=INT, bits=INT, red=T.ArrayType(INT), green=T.ArrayType(INT), blue=T.ArrayType(INT))
VERTEX = _struct(row=INT, column=INT)
SHAPE = _struct(kind=TEXT, left=INT, right=INT, upper=INT, lower=INT, row=INT, column=INT, radius=INT, vertices=T.ArrayType(VERTEX), overlay_group=INT)
SHUTTER = _struct(shapes=T.ArrayType(SHAPE), value=INT)
RANGE = _struct(low=DOUBLE, high=DOUBLE)
FRAME = _struct(
    file_id=TEXT,
    sop_instance_uid=TEXT,
    status=TEXT,
    frame_index=INT,
    rows=INT,
    columns=INT,
    samples_per_pixel=INT,
    bits_allocated=INT,
    bits_stored=INT,
    pixel_representation=INT,
    photometric=TEXT,
    planar=INT,
    rescale_slope=DOUBLE,
    rescale_intercept=DOUBLE,
    window_center=DOUBLE,
    window_width=DOUBLE,
    window_presets=T.ArrayType(PRESET),
    voi_luts=T.ArrayType(LUT),
    modality_lut=LUT,
    palette=PALETTE,
    padding=RANGE,
    shutter=SHUTTER,
    lut_shape=TEXT,
    image_lut_shape=TEXT,
    value=T.BinaryType(),
)


def window_presets(ds: DataSet) -> list[dict]:
    centers, widths = ds.numbers("WindowCenter"), ds.numbers("WindowWidth")
    if ds.get("WindowCenter") is None or ds.get("WindowWidth") is None or centers is None or widths is None or len(centers) != len(widths):
        return []
    names = ds.texts("WindowCenterWidthExplanation") if ds.get("WindowCenterWidthExplanation") is not None else []
    return [{"center": c, "width": w, "explanation": names[i] if names and i < len(names) else None} for i, (c, w) in enumerate(zip(centers, widths, strict=True))]


def table_of(item: DataSet, signed: bool) -> dict | None:
    """A modality or VOI table of a sequence item; zero entries mean 65,536."""
    head, data = item.array("LUTDescriptor", "<u2"), item.get("LUTData")
    if head is None or len(head) != 3 or data is None:
        return None
    count, bits = int(head[0]) or 65536, int(head[2])
    if bits <= 8 and data.vr == "OB" and len(data.value) >= count:
        entries = np.frombuffer(data.value, np.uint8)[:count]
    else:
        entries = item.array("LUTData", "<u2")
        if entries is None or len(entries) < count:
            return None
    if not 8 <= bits <= 16:
        return None
    return {"first": int(head[1].astype(np.int16)) if signed else int(head[1]), "bits": bits, "entries": entries[:count].astype(int).tolist(), "explanation": item.text("LUTExplanation")}


def palette_of(ds: DataSet) -> dict | None:
    heads = [ds.array(f"{c}PaletteColorLookupTableDescriptor", "<u2") for c in ("Red", "Green", "Blue")]
    if any(h is None or len(h) != 3 for h in heads) or any((h != heads[0]).any() for h in heads):
        return None
    count, bits, out = int(heads[0][0]) or 65536, int(heads[0][2]), {}
    if bits not in (8, 16):
        return None
    for c in ("Red", "Green", "Blue"):
        e = ds.get(f"{c}PaletteColorLookupTableData")
        if e is None:
            return None
        if bits == 8 and e.vr == "OB" and len(e.value) >= count:
            entries = np.frombuffer(e.value, np.uint8)
        else:
            entries = ds.array(f"{c}PaletteColorLookupTableData", "<u2")
        if entries is None or len(entries) < count:
            return None
        out[c.lower()] = entries[:count].astype(int).tolist()
    return {"first": int(heads[0][1]), "bits": bits, **out}


def shutter_of(ds: DataSet) -> dict | None:
    """Shapes that the display shutter module names; malformed ones are left out, NULL if none is left."""
    shapes = []
    for name in ds.texts("ShutterShape") or []:
        if name.upper() == "RECTANGULAR":
            edges = [ds.integer(f"Shutter{e}") for e in ("LeftVerticalEdge", "RightVerticalEdge", "UpperHorizontalEdge", "LowerHorizontalEdge")]
            if None not in edges:
                shapes.append({"kind": "RECTANGULAR", **dict(zip(("left", "right", "upper", "lower"), edges, strict=True))})
        elif name.upper() == "CIRCULAR":
            center, radius = ds.integers("CenterOfCircularShutter"), ds.integer("RadiusOfCircularShutter")
            if center and len(center) == 2 and radius is not None:
                shapes.append({"kind": "CIRCULAR", "row": center[0], "column": center[1], "radius": radius})
        elif name.upper() == "POLYGONAL":
            flat = ds.integers("VerticesOfThePolygonalShutter")
            if flat and len(flat) >= 6 and len(flat) % 2 == 0:
                shapes.append({"kind": "POLYGONAL", "vertices": [{"row": r, "column": c} for r, c in zip(flat[::2], flat[1::2], strict=True)]})
        elif name.upper() == "BITMAP" and ds.us("ShutterOverlayGroup") is not None:
            shapes.append({"kind": "BITMAP", "overlay_group": ds.us("ShutterOverlayGroup")})
    return {"shapes": shapes, "value": ds.us("ShutterPresentationValue")} if shapes else None


def lut_shape_of(ds: DataSet) -> str | None:
    shape = (ds.text("PresentationLUTShape") or "").upper()
    return shape if shape in ("IDENTITY", "INVERSE") else None


def padding_of(ds: DataSet) -> dict | None:
    read = ds.ss if ds.us("PixelRepresentation") == 1 else ds.us
    if ds.get("PixelPaddingValue") is None or read("PixelPaddingValue") is None:
        return None
    value = limit = read("PixelPaddingValue")
    if ds.get("PixelPaddingRangeLimit") is not None:
        limit = read("PixelPaddingRangeLimit")
        if limit is None:
            return None
    slope, intercept = or_default(ds.number("RescaleSlope"), 1.0), or_default(ds.number("RescaleIntercept"), 0.0)
    ends = sorted((value * slope + intercept, limit * slope + intercept))
    return {"low": ends[0], "high": ends[1]}


def or_default(value, default):
    return default if value is None else value


def group_attributes(group: DataSet | None) -> dict[str, float]:
    """Rendering attributes that a functional group sets."""
    if group is None:
        return {}
    transform, voi = group.first_item("PixelValueTransformationSequence"), group.first_item("FrameVOILUTSequence")
    found = {"rescale_slope": transform and transform.number("RescaleSlope"), "rescale_intercept": transform and transform.number("RescaleIntercept"), "window_center": voi and voi.number("WindowCenter"), "window_width": voi and voi.number("WindowWidth")}
    return {k: v for k, v in found.items() if v is not None}


def frame_attributes(ds: DataSet, frames: int) -> list[dict[str, float]]:
    """Per frame: the shared group's attributes, each overridden by the frame's own."""
    shared, own = group_attributes(ds.first_item("SharedFunctionalGroupsSequence")), ds.items("PerFrameFunctionalGroupsSequence")
    return [{**shared, **(group_attributes(own[i]) if i < len(own) else {})} for i in range(frames)]


def frame_count(ds: DataSet) -> int | None:
    text = ds.text("NumberOfFrames") if ds.get("NumberOfFrames") is not None else "1"
    return int(text) if text and INTEGER.fullmatch(text) and int(text) > 0 else None


def fragments_by_frame(fragments: list[bytes], offsets: list[int], bot: bytes, extended: np.ndarray | None, frames: int) -> list[list[bytes]]:
    """Fragments of each frame. Without an offset table only one frame, or one fragment a frame, is unambiguous."""
    if not bot and extended is not None and len(extended):
        starts = extended.tolist()
    elif not bot:
        if frames == 1:
            return [fragments]
        if len(fragments) != frames:
            raise FrameError("unsupportedPixelFormat")
        return [[f] for f in fragments]
    else:
        if len(bot) % 4:
            raise FrameError("unsupportedPixelFormat")
        starts = np.frombuffer(bot, "<u4").tolist()
    if len(starts) != frames:
        raise FrameError("unsupportedPixelFormat")
    index = {o: k for k, o in enumerate(offsets)}
    if starts[0] or any(a >= b for a, b in zip(starts, starts[1:])) or any(s not in index for s in starts):
        raise FrameError("truncatedPixelData")
    cuts = [*(index[s] for s in starts), len(fragments)]
    return [fragments[a:b] for a, b in zip(cuts, cuts[1:])]


@dataclass
class Decoded:
    value: bytes
    bits_stored: int | None = None
    photometric: str | None = None


def decoded_frame(kind: str, fragments: list[bytes], rows: int, columns: int, samples: int, allocated: int, stored: int | None, photometric: str) -> Decoded:
    """One compressed frame as native samples; raises FrameError where stream and attributes disagree, and for any stream that cannot be read."""
    if min(rows, columns, samples, allocated) <= 0:
        raise FrameError("invalidImageAttributes")
    try:
        return read_frame(kind, fragments, rows, columns, samples, allocated, stored, photometric)
    except FrameError:
        raise
    except (ArithmeticError, LookupError, ValueError, struct.error) as e:
        raise FrameError("truncatedPixelData") from e


def read_frame(kind: str, fragments: list[bytes], rows: int, columns: int, samples: int, allocated: int, stored: int | None, photometric: str) -> Decoded:
    size = (rows, columns, samples)
    if kind == "rle":
        if (samples, allocated, photometric) not in {(1, 8, "MONOCHROME1"), (1, 8, "MONOCHROME2"), (1, 16, "MONOCHROME1"), (1, 16, "MONOCHROME2"), (3, 8, "RGB"), (3, 16, "RGB")}:
            raise FrameError("unsupportedPixelFormat")
        return Decoded(rle.decode(fragments, rows * columns, samples, allocated // 8))
    if kind in ("jpeg_lossless", "jpeg_lossless_sv1"):
        image = jpeg_lossless.decode(b"".join(fragments), size)
        if kind == "jpeg_lossless_sv1" and image.predictor != 1:
            raise FrameError("unsupportedPixelFormat")
    elif kind == "jpeg_baseline":
        image = jpeg_baseline.decode(b"".join(fragments), size)
        if image.components == 1 and photometric not in ("MONOCHROME1", "MONOCHROME2"):
            raise FrameError("unsupportedPixelFormat")
    elif kind in ("jpeg_ls", "jpeg_ls_near"):
        image = jpeg_ls.decode(b"".join(fragments), size)
        if kind == "jpeg_ls" and image.predictor:
            raise FrameError("unsupportedPixelFormat")
    elif kind in ("jpeg_2000", "jpeg_2000_lossless"):
        image = jpeg_2000.decode(b"".join(fragments).rstrip(b"\0"), size)
        if kind == "jpeg_2000_lossless" and image.predictor:
            raise FrameError("unsupportedPixelFormat")
    else:
        raise FrameError("unsupportedCodec")
    if stored is not None and stored != image.precision or (8 if image.precision <= 8 else 16) != allocated:
        raise FrameError("unsupportedPixelFormat")
    # These decoders turn the stream's own colour space to RGB.
    colour = image.components == 3 and (kind == "jpeg_baseline" or photometric in ("YBR_RCT", "YBR_ICT"))
    return Decoded(image.native(), image.precision, "RGB" if colour else None)


def frames_in(file_id: str, syntax: str, elements: list[dict]) -> list[dict]:
    """Frame rows of one file; one row without a frame where it has none, its status says why."""
    ds = DataSet(binary.tree([e for e in elements if not e["is_meta"]]))
    base = {"file_id": file_id, "sop_instance_uid": ds.text("SOPInstanceUID"), "status": "ok", "image_lut_shape": lut_shape_of(ds)}
    try:
        return [base | f for f in resolved(ds, syntax)]
    except FrameError as e:
        return [base | {"status": str(e)}]


def resolved(ds: DataSet, syntax: str) -> list[dict]:
    pixel, rows, columns, samples, allocated = ds.get("PixelData"), ds.us("Rows"), ds.us("Columns"), ds.us("SamplesPerPixel"), ds.us("BitsAllocated")
    photometric, frames = ds.text("PhotometricInterpretation"), frame_count(ds)
    if pixel is None:
        raise FrameError("noPixelData")
    if None in (rows, columns, samples, allocated, photometric, frames):
        raise FrameError("missingAttributes")
    photometric = photometric.upper()
    palette = palette_of(ds) if photometric == "PALETTE COLOR" else None
    if photometric == "PALETTE COLOR" and palette is None:
        raise FrameError("invalidImageAttributes")
    kind, _, _, _, encapsulated = TRANSFER_SYNTAXES[syntax]
    if encapsulated:
        if pixel.fragments is None:
            raise FrameError("truncatedPixelData")
        grouped = fragments_by_frame(pixel.fragments, pixel.row["fragment_offsets"], pixel.bot, ds.array("ExtendedOffsetTable", "<u8"), frames)
        pixels = [decoded_frame(kind, own, rows, columns, samples, allocated, ds.us("BitsStored"), photometric) for own in grouped]
    else:
        if allocated % 8:
            raise FrameError("unsupportedPixelFormat")
        size = rows * columns * samples * (allocated // 8)
        if photometric == "YBR_FULL_422":  # two pixels share their chroma
            size = rows * columns * 2
        # Python's numbers do not overflow: what does not fit the value is found here, before anything is allocated.
        if not size or len(pixel.value) < size * frames:
            raise FrameError("truncatedPixelData")
        pixels = [Decoded(pixel.value[k * size : (k + 1) * size]) for k in range(frames)]
    presets, attributes = window_presets(ds), frame_attributes(ds, frames)
    modality = ds.first_item("ModalityLUTSequence")
    shared = {
        "rows": rows,
        "columns": columns,
        "samples_per_pixel": samples,
        "bits_allocated": allocated,
        "pixel_representation": or_default(ds.us("PixelRepresentation"), 0),
        "photometric": photometric,
        "planar": 0 if encapsulated and kind != "rle" else or_default(ds.us("PlanarConfiguration"), 0),
        "window_presets": presets,
        "voi_luts": [t for t in (table_of(i, True) for i in ds.items("VOILUTSequence")) if t],
        "modality_lut": table_of(modality, ds.us("PixelRepresentation") == 1) if modality else None,
        "palette": palette,
        "padding": padding_of(ds),
        "shutter": shutter_of(ds),
    }
    first = presets[0] if presets else {}
    out = []
    for k, (frame, own) in enumerate(zip(pixels, attributes, strict=True)):
        pick = lambda name, *others: next((v for v in (own.get(name), *others) if v is not None), None)  # noqa: B023, E731
        out.append(
            shared
            | {
                "frame_index": k,
                "photometric": frame.photometric or photometric,
                "bits_stored": frame.bits_stored or or_default(ds.us("BitsStored"), allocated),
                "rescale_slope": pick("rescale_slope", ds.number("RescaleSlope"), 1.0),
                "rescale_intercept": pick("rescale_intercept", ds.number("RescaleIntercept"), 0.0),
                "window_center": pick("window_center", first.get("center"), ds.number("WindowCenter")),
                "window_width": pick("window_width", first.get("width"), ds.number("WindowWidth")),
                "value": frame.value,
            }
        )
    return out


def frames_of(decoded: DataFrame) -> DataFrame:
    """One row per frame of decoded files; see FRAME for the columns."""
    schema = to_arrow_schema(FRAME)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for file_id, syntax, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binary.element_rows(batch.column(2), binary.NEEDED), strict=True):
                rows += frames_in(file_id, syntax, own)
                # Frames are large: batches hold a few megabytes of them.
                while rows and (len(rows) >= 256 or sum(len(r.get("value") or b"") for r in rows) > 8 << 20):
                    yield pa.RecordBatch.from_pylist(rows[:64], schema=schema)
                    rows = rows[64:]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return mapped(decoded.where("status = 'ok'").select("file_id", "transfer_syntax_uid", "elements"), run, FRAME)


def away(x: np.ndarray) -> np.ndarray:
    """Rounded with halves away from zero."""
    return np.sign(x) * np.floor(np.abs(x) + 0.5)


def clipped(x: np.ndarray) -> np.ndarray:
    return np.clip(away(x), 0, 255).astype(np.uint8)


def entry(table: np.ndarray, values: np.ndarray, first: int) -> np.ndarray:
    return table[np.clip(values - first, 0, len(table) - 1).astype(np.int64)]


def rendered(f: dict, center: float | None, width: float | None, legacy_inverse: bool = True) -> np.ndarray:
    """8-bit samples of a frame: grey (pixels,) or RGB (pixels, 3). Raises FrameError where it cannot be shown.

    legacy_inverse: 8-bit grey follows MONOCHROME1 alone; else an inverse LUT shape counts there too.
    """
    rows, columns, samples, allocated, photometric = f["rows"], f["columns"], f["samples_per_pixel"], f["bits_allocated"], f["photometric"]
    pixels, value = rows * columns, f["value"]
    if min(rows, columns, samples, allocated) <= 0:
        raise FrameError("invalidImageAttributes")

    def need(n: int) -> bytes:
        if len(value) < n:
            raise FrameError("truncatedPixelData")
        return value[:n]

    invert = (photometric == "MONOCHROME1") != (f["lut_shape"] == "INVERSE")
    grey = photometric in ("MONOCHROME1", "MONOCHROME2")
    if (grey and samples != 1 and allocated in (1, 8, 16)) or (photometric == "RGB" and samples != 3 and allocated in (8, 16)):
        raise FrameError("invalidImageAttributes")
    if grey and allocated == 1:
        bits = np.unpackbits(np.frombuffer(need((pixels + 7) // 8), np.uint8), bitorder="little")[:pixels] * np.uint8(255)
        return 255 - bits if invert else bits
    if grey and allocated == 8:
        own = np.frombuffer(need(pixels), np.uint8)
        return 255 - own if (photometric == "MONOCHROME1" if legacy_inverse else invert) else own
    if grey and allocated == 16:
        shown = grey_window(f, np.frombuffer(need(pixels * 2), "<u2").astype(np.int64), center, width)
        return 255 - shown if invert else shown
    if photometric == "RGB" and allocated in (8, 16):
        own = np.frombuffer(need(pixels * 3 * allocated // 8), np.uint8 if allocated == 8 else "<u2")
        if f["planar"] not in (0, 1):
            raise FrameError("unsupportedPixelFormat")
        own = own.reshape(pixels, 3) if f["planar"] == 0 else own.reshape(3, pixels).T
        return (own >> 8 if allocated == 16 else own).astype(np.uint8)
    if photometric in ("YBR_FULL", "YBR_FULL_422") and allocated == 8:
        half = photometric == "YBR_FULL_422"
        if samples != 3 or f["planar"] or half and columns % 2:
            raise FrameError("unsupportedPixelFormat")
        own = np.frombuffer(need(pixels * (2 if half else 3)), np.uint8).astype(float)
        if half:
            quads = own.reshape(-1, 4)
            own = np.stack([quads[:, :2].reshape(-1), quads[:, 2].repeat(2), quads[:, 3].repeat(2)], axis=1)
        y, cb, cr = own.reshape(pixels, 3).T
        return np.stack([clipped(y + 1.402 * (cr - 128)), clipped(y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128)), clipped(y + 1.772 * (cb - 128))], axis=1)
    if photometric == "PALETTE COLOR" and allocated in (8, 16):
        palette = f["palette"]
        if samples != 1 or palette is None:
            raise FrameError("invalidImageAttributes")
        own = np.frombuffer(need(pixels * allocated // 8), np.uint8 if allocated == 8 else "<u2").astype(np.int64)
        top = 255.0 if palette["bits"] == 8 else 65535.0
        return np.stack([entry(clipped(np.array(palette[c]) * 255 / top), own, palette["first"]) for c in ("red", "green", "blue")], axis=1)
    raise FrameError("unsupportedPixelFormat")


def modality_values(f: dict, raw: np.ndarray) -> np.ndarray:
    """Stored values, masked and signed, through the modality table or the rescale."""
    stored = f["bits_stored"]
    if not 1 <= stored <= f["bits_allocated"]:
        raise FrameError("invalidImageAttributes")
    own = raw & ((1 << stored) - 1)
    if f["pixel_representation"] == 1:
        own = np.where(own >> (stored - 1), own - (1 << stored), own)
    if f["modality_lut"]:
        return entry(np.array(f["modality_lut"]["entries"], float), own, f["modality_lut"]["first"])
    return own * f["rescale_slope"] + f["rescale_intercept"]


def grey_window(f: dict, raw: np.ndarray, center: float | None, width: float | None) -> np.ndarray:
    own = modality_values(f, raw)
    if center is None and width is None and f["voi_luts"]:
        lut = f["voi_luts"][0]
        return entry(clipped(np.array(lut["entries"], float) * 255 / ((1 << lut["bits"]) - 1)), np.trunc(own), lut["first"])
    used = own if f["padding"] is None else own[(own < f["padding"]["low"]) | (own > f["padding"]["high"])]
    low, high = (used.min(), used.max()) if len(used) else (0.0, 0.0)
    auto = (low + high) / 2, high - low if high > low else 2.0
    center = next(v for v in (center, f["window_center"], auto[0]) if v is not None)
    width = next(v for v in (width, f["window_width"], auto[1]) if v is not None)
    if not (np.isfinite(center) and np.isfinite(width)):
        raise FrameError("invalidWindowSettings")
    if width <= 1:
        raise FrameError("invalidWindowWidth")
    middle, half = center - 0.5, (width - 1) / 2
    out = away(((own - middle) / (width - 1) + 0.5) * 255)
    return np.where(own <= middle - half, 0, np.where(own > middle + half, 255, out)).astype(np.uint8)


def mask_of(shutter: dict, rows: int, columns: int) -> np.ndarray:
    """True where the shutter hides the pixel."""
    r, c = np.mgrid[1 : rows + 1, 1 : columns + 1]
    hidden = np.zeros((rows, columns), bool)
    for s in shutter["shapes"]:
        if s["kind"] == "RECTANGULAR":
            hidden |= ~((s["left"] <= c) & (c <= s["right"]) & (s["upper"] <= r) & (r <= s["lower"]))
        elif s["kind"] == "CIRCULAR":
            hidden |= (r - s["row"]) ** 2 + (c - s["column"]) ** 2 > s["radius"] ** 2
        elif s["kind"] == "POLYGONAL":
            inside, v = np.zeros((rows, columns), bool), s["vertices"]
            for k in range(len(v)) if len(v) >= 3 else ():
                a, b = v[k], v[k - 1]
                if a["row"] != b["row"]:
                    meet = (b["column"] - a["column"]) * (r - a["row"]) / (b["row"] - a["row"]) + a["column"]
                    inside ^= ((a["row"] > r) != (b["row"] > r)) & (c < meet)
            hidden |= ~inside
    return hidden


RENDERED = _struct(file_id=TEXT, frame_index=INT, rows=INT, columns=INT, components=INT, status=TEXT, pixels=T.BinaryType())


def render(frames: DataFrame, window_center: float | None = None, window_width: float | None = None, legacy_inverse: bool = True) -> DataFrame:
    """One row per frame: file_id, frame_index, rows, columns, components, status, pixels (8-bit, interleaved).

    The window is each of the caller's, the frame's or the data's own centre and width, resolved one by one; a VOI
    table is used only where the caller gives neither. The shutter is painted last.
    """
    schema = to_arrow_schema(RENDERED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                yield pa.RecordBatch.from_pylist([shown(f, window_center, window_width, legacy_inverse) for f in batch.slice(k, 64).to_pylist()], schema=schema)

    return mapped(frames.select(*FRAME.names), run, RENDERED)


def shown(f: dict, center: float | None, width: float | None, legacy_inverse: bool) -> dict:
    """A row of RENDERED for a row of FRAME."""
    out = {k: f.get(k) for k in ("file_id", "frame_index", "rows", "columns", "status")}
    if f["status"] != "ok":
        return out
    try:
        image = rendered(f, center, width, legacy_inverse)
    except FrameError as e:
        return out | {"status": str(e)}
    if f["shutter"]:
        image = image.copy()
        image[mask_of(f["shutter"], f["rows"], f["columns"]).reshape(-1)] = (f["shutter"]["value"] or 0) >> 8
    return out | {"components": 3 if image.ndim == 2 else 1, "pixels": image.tobytes()}


def render_files(decoded: DataFrame, window_center: float | None = None, window_width: float | None = None, legacy_inverse: bool = True) -> DataFrame:
    """The same rows as render(frames_of(decoded)) in one step: tables and samples of a file stay in its batch, frame by frame."""
    schema = to_arrow_schema(RENDERED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        size = 0
        for batch in batches:
            for file_id, syntax, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binary.element_rows(batch.column(2), binary.NEEDED), strict=True):
                for f in frames_in(file_id, syntax, own):
                    rows.append(shown({"lut_shape": None, **f}, window_center, window_width, legacy_inverse))
                    size += len(rows[-1].get("pixels") or b"")
                    if size > 8 << 20 or len(rows) >= 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return mapped(decoded.where("status = 'ok'").select("file_id", "transfer_syntax_uid", "elements"), run, RENDERED)


def png_bytes(pixels: bytes, rows: int, columns: int, components: int) -> bytes:
    """An 8-bit grey or RGB image as PNG, without filters."""
    chunk = lambda kind, raw: struct.pack(">I", len(raw)) + kind + raw + struct.pack(">I", zlib.crc32(kind + raw))
    width = columns * components
    lines = b"".join(b"\0" + pixels[y * width : (y + 1) * width] for y in range(rows))
    head = struct.pack(">IIBBBBB", columns, rows, 8, 2 if components == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def as_png(rendered_frames: DataFrame) -> DataFrame:
    """(file_id, frame_index, status, png) of rendered frames."""
    schema = pa.schema([("file_id", pa.string()), ("frame_index", pa.int32()), ("status", pa.string()), ("png", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"file_id": f["file_id"], "frame_index": f["frame_index"], "status": f["status"], "png": png_bytes(f["pixels"], f["rows"], f["columns"], f["components"]) if f["status"] == "ok" else None} for f in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return mapped(rendered_frames.select(*RENDERED.names), run, "file_id string, frame_index int, status string, png binary")


def float_frames(decoded: DataFrame) -> DataFrame:
    """(file_id, frame_index, rows, columns, values) of float or double float pixel data whose size fits."""
    out = _struct(file_id=TEXT, frame_index=INT, rows=INT, columns=INT, values=T.ArrayType(DOUBLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_id, elements in zip(batch.column(0).to_pylist(), binary.element_rows(batch.column(1), binary.NEEDED), strict=True):
                ds = DataSet(binary.tree([e for e in elements if not e["is_meta"]]))
                rows, columns, frames = ds.us("Rows"), ds.us("Columns"), frame_count(ds)
                values = ds.array("FloatPixelData", "<f4")
                values = ds.array("DoubleFloatPixelData", "<f8") if values is None else values
                if None in (rows, columns, frames) or values is None or len(values) != rows * columns * frames:
                    continue
                cut = values.astype(float).reshape(frames, -1)
                yield pa.RecordBatch.from_pylist([{"file_id": file_id, "frame_index": k, "rows": rows, "columns": columns, "values": v.tolist()} for k, v in enumerate(cut)], schema=to_arrow_schema(out))

    return mapped(decoded.where("status = 'ok'").select("file_id", "elements"), run, out)


def cube(raw: bytes, f: dict) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if f["bits_allocated"] > 8 else np.uint8).reshape(f["rows"], f["columns"], f["samples_per_pixel"])


ENCODERS = {
    "rle": lambda raw, f: rle.encode(raw, f["samples_per_pixel"], f["bits_allocated"] // 8),
    "jpeg_lossless": lambda raw, f: jpeg_lossless.encode(cube(raw, f), f["bits_stored"]),
    "jpeg_2000": lambda raw, f: jpeg_2000.encode(cube(raw, f), f["bits_stored"], levels=3),
    "jpeg_baseline": lambda raw, f: jpeg_baseline.encode([p for p in np.moveaxis(cube(raw, f), 2, 0)], [(1, 1)] * f["samples_per_pixel"], f["rows"], f["columns"], adobe=0),
}


def compressed(frames: DataFrame, kind: str) -> DataFrame:
    """(file_id, frame_index, fragment): native frames as streams of one of ENCODERS, ready for encapsulated pixel data."""
    own = ENCODERS[kind]
    schema = pa.schema([("file_id", pa.string()), ("frame_index", pa.int32()), ("fragment", pa.binary())])
    needed = ["file_id", "frame_index", "rows", "columns", "samples_per_pixel", "bits_allocated", "bits_stored", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"file_id": f["file_id"], "frame_index": f["frame_index"], "fragment": own(f["value"], f)} for f in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return mapped(frames.where("status = 'ok'").select(*needed), run, "file_id string, frame_index int, fragment binary")


def frame_ranges(fragment_offsets: Column, starts: Column) -> Column:
    """Per frame the indexes [first, last) of its fragments, as an array; NULL where the table is not valid.

    A table is valid if it begins at zero, grows, and every entry is a fragment's offset.
    """
    n = F.size(starts)
    grows = F.forall(F.sequence(F.lit(1), n), lambda i: (i == n) | (F.element_at(starts, i) < F.element_at(starts, F.least(i + 1, n))))
    known = F.forall(starts, lambda s: F.array_contains(fragment_offsets, s))
    valid = (n > 0) & (F.get(starts, F.lit(0)) == 0) & grows & known
    position = lambda s: F.array_position(fragment_offsets, s) - 1
    frames = F.transform(starts, lambda s, i: F.struct(position(s).alias("first"), F.when(i + 1 < n, position(F.get(starts, i + 1))).otherwise(F.size(fragment_offsets)).alias("last")))
    return F.when(valid, frames)
