"""Registered queries over frames, presentation states, directories and file attributes, with their SQL."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe import model
from lumenframe.functions import values
from lumenframe.model import TAG
from lumenframe.operators import directory, frames, hierarchy, lookup, presentation, validate
from lumenframe.plans.registry import query
from lumenframe.plans.sql import _SAMPLES
from lumenframe.plans.tables import bytes_text, customers, image_files, images, raw_bytes, sl_bytes, spread, table, text, words_bytes
from lumenframe.sources import dicom_json, part10

us = values.us_bytes


def shown(spark: SparkSession, sf_dir: str, own: dict[str, Column], **options) -> DataFrame:
    """The images with other attributes, written, read, assembled and rendered: vec_id, frame, status, pixels."""
    return pixel_text(frames.render_files(part10.decode_files(part10.encode_arrays(image_files(spark, sf_dir, own))), **options))


def pixel_text(rendered: DataFrame) -> DataFrame:
    return rendered.select(F.col("file_id").cast("long").alias("vec_id"), F.col("frame_index").cast("long").alias("frame"), "status", bytes_text(F.col("pixels")).alias("pixels"))


def square() -> dict[str, Column]:
    """Eight rows of eight 8-bit samples."""
    return {"Rows": us(F.lit(8)), "Columns": us(F.lit(8)), "BitsAllocated": us(F.lit(8)), "BitsStored": us(F.lit(8)), "HighBit": us(F.lit(7))}


def low_bytes(modulus: int = 256) -> Column:
    return F.transform("samples", lambda x: F.pmod(x, F.lit(modulus)))


@query
def palette_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexes into a palette of three entries; index 3 takes the last."""
    entries = {"Red": [0, 10, 200], "Green": [5, 15, 205], "Blue": [9, 19, 209]}
    own = {**square(), "PhotometricInterpretation": text(F.lit("PALETTE COLOR")), "PixelData": raw_bytes(low_bytes(4))}
    for c, e in entries.items():
        own[f"{c}PaletteColorLookupTableDescriptor"] = words_bytes(F.lit([3, 0, 16]))
        own[f"{c}PaletteColorLookupTableData"] = words_bytes(F.lit([x * 257 for x in e]))
    return shown(spark, sf_dir, own)


@query
def one_bit_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of one bit, the lowest bit first; odd images are MONOCHROME1."""
    bits = lambda j: F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0).cast("long"), lambda acc, k: acc + F.pmod(F.get("samples", j * 8 + k), F.lit(2)) * F.pow(F.lit(2), k).cast("long"))
    packed = raw_bytes(F.transform(F.sequence(F.lit(0), F.lit(7)), bits))
    found = frames.frames_of(part10.decode_files(part10.encode_arrays(image_files(spark, sf_dir, {**square(), "Rows": us(F.lit(1)), "Columns": us(F.lit(8)), "PixelData": packed}))))
    return pixel_text(frames.render(found.withColumns({"columns": F.lit(64), "bits_allocated": F.lit(1), "bits_stored": F.lit(1)})))


@query
def modality_lut_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored values through a modality table of 4,000 entries that begins at 100, then a window of the caller's."""
    files = image_files(spark, sf_dir, {"PhotometricInterpretation": text(F.lit("MONOCHROME2"))})
    sequence = TAG["ModalityLUTSequence"]
    e = part10.element
    extra = F.array(
        e(sequence, "SQ", F.lit(b""), ordinal=100, items=1),
        e(TAG["LUTDescriptor"], "US", words_bytes(F.lit([4000, 100, 16])), ordinal=101, path=[(sequence, 0)]),
        e(TAG["LUTData"], "OW", F.lit(struct.pack("<4000H", *[k * 3 % 5000 for k in range(4000)])), ordinal=102, path=[(sequence, 0)]),
    )
    whole = files.select("file_id", F.concat("elements", extra).alias("elements"))
    return pixel_text(frames.render_files(part10.decode_files(part10.encode_arrays(whole)), window_center=2500.0, window_width=5001.0))


#: JPEG-LS streams of the CharLS test corpus (BSD-3-Clause) or made with its encoder: rows, columns, components, precision, samples.
JPEG_LS = (
    ("FFD8FFF7000B080002000201011100FFDA00080101000000005A98FFD9", 2, 2, 1, 8, "1,2,3,4"),
    ("FFD8FFF7000B0C0002000201011100FFDA000801010000000041830C0000000210FFD9", 2, 2, 1, 12, "1,2,4095,1024"),
    ("FFD8FFF70011080001000103011100021100031100FFDA000C0301000200030000020002020700FFD9", 1, 1, 3, 8, "10,20,30"),
    ("FFD8FFF70011080002000203011100021100031100FFDA000C0301000200030000010007000383DC86C000E000002EE00020D9D000000BBB80FFD9", 2, 2, 3, 8, "10,20,30,40,50,60,70,80,90,100,110,120"),
)


@query
def jpeg_ls_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of another encoder as frames; every fifth is cut short and has its status."""
    p = spread(table(spark, sf_dir, "part"), "p_partkey")
    kind = (F.pmod("p_partkey", F.lit(len(JPEG_LS))) + 1).cast("int")
    pick = lambda k: F.element_at(F.array(*[F.lit(s[k]) for s in JPEG_LS]), kind)
    stream = F.unhex(pick(0))
    stream = F.when(F.pmod("p_partkey", F.lit(5)) == 0, F.substring(stream, 1, 20)).otherwise(stream)
    e, wide = part10.element, F.when(pick(4) > 8, 16).otherwise(8)
    rows = [
        e(TAG["SamplesPerPixel"], "US", us(pick(3)), ordinal=0),
        e(TAG["PhotometricInterpretation"], "CS", F.when(pick(3) == 3, text(F.lit("RGB"))).otherwise(text(F.lit("MONOCHROME2"))), ordinal=1),
        e(TAG["Rows"], "US", us(pick(1)), ordinal=2),
        e(TAG["Columns"], "US", us(pick(2)), ordinal=3),
        e(TAG["BitsAllocated"], "US", us(wide), ordinal=4),
        e(TAG["BitsStored"], "US", us(pick(4)), ordinal=5),
    ]
    pixel = e(TAG["PixelData"], "OB", F.lit(b""), ordinal=6)
    pixel = F.struct(*[(F.array(stream) if c == "fragments" else F.lit(b"") if c == "bot" else pixel[c]).alias(c) for c in part10.WRITTEN])
    files = p.select(F.col("p_partkey").cast("string").alias("file_id"), F.concat(F.array(*rows), F.array(pixel)).alias("elements"))
    found = frames.frames_of(part10.decode_files(part10.encode_arrays(files, "1.2.840.10008.1.2.4.80")))
    samples = F.when(F.col("bits_allocated") == 16, F.array_join(values.us_list("value"), ",")).otherwise(bytes_text(F.col("value")))
    return found.select(F.col("file_id").cast("long").alias("p_partkey"), (F.col("status") == "ok").cast("string").alias("fine"), samples.alias("samples"))


#: Texts in the coded character sets of Japanese.
JAPANESE = (("ISO_IR 13", "shift_jis", "ﾔﾏﾀﾞ ﾀﾛｳ"), ("\\ISO 2022 IR 87", "iso2022_jp", "山田 太郎"), ("ISO 2022 IR 87", "iso2022_jp", "検査 Kensa"), ("ISO_IR 192", "utf-8", "Größe 大"))


@query
def japanese_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes in four character sets, by what a data set declares; an unknown one gives no text."""
    c = table(spark, sf_dir, "customer")
    kind = (F.pmod("c_custkey", F.lit(5)) + 1).cast("int")
    raw = F.element_at(F.array(*[F.lit(t.encode(codec)) for _, codec, t in JAPANESE], F.lit(b"x")), kind)
    declared = F.element_at(F.array(*[F.lit(d) for d, _, _ in JAPANESE], F.lit("ISO_IR 999")), kind)
    own = c.select("c_custkey", raw.alias("raw"), declared.alias("declared"))
    return own.select("c_custkey", values.charset_text(F.col("raw"), F.col("declared")).alias("text"))


@query
def png_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered images as PNG: its signature and the size that its header gives."""
    found = frames.frames_of(part10.decode_files(part10.encode_arrays(image_files(spark, sf_dir, {**square(), "PixelData": raw_bytes(low_bytes())}))))
    own = frames.as_png(frames.render(found))
    number = lambda at: F.conv(F.hex(F.substring("png", at, 4)), 16, 10).cast("long")
    return own.select(F.col("file_id").cast("long").alias("vec_id"), "status", F.hex(F.substring("png", 1, 8)).alias("signature"), number(17).alias("columns"), number(21).alias("rows"))


@query
def grey8_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8-bit grey as it is, turned round for MONOCHROME1."""
    return shown(spark, sf_dir, {**square(), "PixelData": raw_bytes(low_bytes())})


def colour(photometric: str, samples: int, planar: int, columns: int) -> dict[str, Column]:
    return {"PhotometricInterpretation": text(F.lit(photometric)), "SamplesPerPixel": us(F.lit(samples)), "PlanarConfiguration": us(F.lit(planar)), "Rows": us(F.lit(1)), "Columns": us(F.lit(columns)), "BitsAllocated": us(F.lit(8)), "BitsStored": us(F.lit(8)), "HighBit": us(F.lit(7))}


@query
def rgb_planar_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty pixels a vector, colour by plane; they come out interleaved."""
    return shown(spark, sf_dir, {**colour("RGB", 3, 1, 20), "PixelData": raw_bytes(F.slice(low_bytes(), 1, 60))})


@query
def rgb16_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty pixels of 16 bits a vector; the high bytes are shown."""
    own = {**colour("RGB", 3, 0, 20), "BitsAllocated": us(F.lit(16)), "BitsStored": us(F.lit(16)), "HighBit": us(F.lit(15)), "PixelData": words_bytes(F.transform(F.slice("samples", 1, 60), lambda x: x * 16))}
    return shown(spark, sf_dir, own)


@query
def ybr422_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of pixels that share a neutral chroma: grey comes out, sample by sample."""
    quads = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.array(F.get(low_bytes(), k * 4), F.get(low_bytes(), k * 4 + 1), F.lit(128), F.lit(128))))
    return shown(spark, sf_dir, {**colour("YBR_FULL_422", 3, 0, 32), "PixelData": raw_bytes(quads)})


@query
def padded_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data's own window without the padding from 900 to 1100, on rescaled values."""
    own = {"PixelPaddingValue": us(F.lit(1100)), "PixelPaddingRangeLimit": us(F.lit(900)), "RescaleSlope": text(F.lit("2")), "RescaleIntercept": text(F.lit("-1000")), "PhotometricInterpretation": text(F.lit("MONOCHROME2"))}
    return shown(spark, sf_dir, own)


@query
def shuttered_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rectangle and a circle around the middle of 8 x 8 pixels; what they hide takes the presentation value's high byte."""
    own = {
        **square(),
        "PhotometricInterpretation": text(F.lit("MONOCHROME2")),
        "ShutterShape": text(F.lit("RECTANGULAR\\CIRCULAR\\POLYGONAL")),  # the polygon has no vertices: left out
        "ShutterLeftVerticalEdge": text((F.pmod("vec_id", F.lit(3)) + 1).cast("string")),
        "ShutterRightVerticalEdge": text(F.lit("8")),
        "ShutterUpperHorizontalEdge": text(F.lit("2")),
        "ShutterLowerHorizontalEdge": text(F.lit("7")),
        "CenterOfCircularShutter": text(F.lit("4\\5")),
        "RadiusOfCircularShutter": text(F.lit("3")),
        "ShutterPresentationValue": us(F.lit(0x4DFF)),
        "PixelData": raw_bytes(low_bytes()),
    }
    return shown(spark, sf_dir, own)


def two_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, elements): images of two frames of 32 samples."""
    return image_files(spark, sf_dir, {"NumberOfFrames": text(F.lit("2")), "Columns": us(F.lit(32))})


@query
def first_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = frames.frames_of(part10.decode_files(part10.encode_arrays(two_frames(spark, sf_dir))))
    own = hierarchy.first_frames(found)
    return own.select(F.col("file_id").cast("long").alias("vec_id"), F.array_join(values.us_list("value"), ",").alias("samples"))


@query
def native_frame_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames read one by one from their places, after a scan that left the pixels out."""
    files = part10.encode_arrays(two_frames(spark, sf_dir))
    ranges = part10.native_frame_ranges(part10.decode_files(files, pixels="skip"))
    read = part10.read_ranges(files, ranges)
    return read.select(F.col("file_id").cast("long").alias("vec_id"), F.col("part").cast("long").alias("frame"), "status", F.array_join(values.us_list("bytes"), ",").alias("samples"))


@query
def fragment_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fragments a file, one a frame, read from their places after a scan that left the pixels out."""
    kept = lambda e, **new: F.struct(*[new.get(c, e[c]).alias(c) for c in part10.WRITTEN])
    halves = lambda v: F.array(F.substring(v, 1, 64), F.substring(v, 65, 64))
    own = F.transform("elements", lambda e: F.when(e["tag"] == TAG["PixelData"], kept(e, fragments=halves(e["value"]), value=F.lit(b""), bot=F.lit(b""))).otherwise(kept(e)))
    files = part10.encode_arrays(two_frames(spark, sf_dir).select("file_id", own.alias("elements")), model.RLE)
    ranges = part10.encapsulated_frame_ranges(part10.decode_files(files, pixels="skip"))
    read = part10.read_ranges(files, ranges)
    return read.select(F.col("file_id").cast("long").alias("vec_id"), F.col("part").cast("long").alias("frame"), "status", F.array_join(values.us_list("bytes"), ",").alias("samples"))


def step(tag: int, item: int = 0) -> tuple[int, int]:
    return tag, item


@query
def presentation_state_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state a part, written, read and parsed: every seventh has another SOP class, every third a reference without UID."""
    p = spread(table(spark, sf_dir, "part"), "p_partkey")
    other = F.pmod("p_partkey", F.lit(7)) == 0
    e, lit = part10.element, lambda s: text(F.lit(s))
    series, image, voi, areas = (TAG[f"{n}Sequence"] for n in ("ReferencedSeries", "ReferencedImage", "SoftcopyVOILUT", "DisplayedAreaSelection"))
    layers, notes, texts, graphics = (TAG[f"{n}Sequence"] for n in ("GraphicLayer", "GraphicAnnotation", "TextObject", "GraphicObject"))
    rows: list[Column] = []

    def add(name: str, vr: str, value: Column | None, path: list[tuple[int, int]] = (), items: int | None = None) -> None:
        rows.append(e(TAG[name], vr, value, ordinal=len(rows), path=list(path), items=items))

    def sequence(name: str, items: int, path: list[tuple[int, int]] = ()) -> None:
        add(f"{name}Sequence", "SQ", F.lit(b""), path, items)

    add("SOPClassUID", "UI", F.when(other, lit("1.2")).otherwise(lit(model.SOP_CLASSES["grayscale_presentation_state"][0])))
    add("SOPInstanceUID", "UI", text(F.concat(F.lit("1.2.9."), "p_partkey")))
    add("ContentLabel", "CS", text("p_brand"))
    add("ImageRotation", "US", us(F.pmod("p_size", F.lit(5)) * 90))
    add("ImageHorizontalFlip", "CS", F.when(F.pmod("p_size", F.lit(2)) == 0, lit("Y")).otherwise(lit("N")))
    add("PresentationLUTShape", "CS", F.when(F.pmod("p_size", F.lit(2)) == 0, lit("inverse")).otherwise(lit("OTHER")))
    sequence("ReferencedSeries", 1)
    add("SeriesInstanceUID", "UI", text(F.concat(F.lit("1.3."), "p_size")), [step(series)])
    sequence("ReferencedImage", 2, [step(series)])
    add("ReferencedSOPInstanceUID", "UI", text(F.concat(F.lit("1.4."), "p_partkey")), [step(series), step(image)])
    add("ReferencedFrameNumber", "IS", lit("1\\x\\3"), [step(series), step(image)])
    add("ReferencedSOPInstanceUID", "UI", F.when(F.pmod("p_partkey", F.lit(3)) != 0, lit("1.5")), [step(series), step(image, 1)])
    add("ReferencedSOPClassUID", "UI", lit("1.6"), [step(series), step(image, 1)])
    sequence("SoftcopyVOILUT", 2)
    add("WindowCenter", "DS", text("p_size"), [step(voi)])
    add("WindowWidth", "DS", lit("400"), [step(voi)])
    sequence("ReferencedImage", 1, [step(voi, 1)])
    add("ReferencedSOPInstanceUID", "UI", lit("1.5"), [step(voi, 1), step(image)])
    add("WindowCenter", "DS", lit("1\\2"), [step(voi, 1)])
    add("WindowWidth", "DS", lit("3"), [step(voi, 1)])
    sequence("DisplayedAreaSelection", 1)
    add("DisplayedAreaTopLeftHandCorner", "SL", sl_bytes(F.array(-F.col("p_size"), F.lit(2))), [step(areas)])
    add("DisplayedAreaBottomRightHandCorner", "SL", sl_bytes(F.array(F.col("p_partkey") + 70000, F.col("p_size"))), [step(areas)])
    add("PresentationSizeMode", "CS", lit("SCALE TO FIT"), [step(areas)])
    sequence("GraphicLayer", 2)
    add("GraphicLayer", "CS", text("p_type"), [step(layers)])
    add("GraphicLayerOrder", "IS", text("p_size"), [step(layers)])
    add("GraphicLayer", "CS", lit("NO ORDER"), [step(layers, 1)])
    sequence("GraphicAnnotation", 1)
    add("GraphicLayer", "CS", lit("L"), [step(notes)])
    sequence("TextObject", 2, [step(notes)])
    add("UnformattedTextValue", "ST", text("p_name"), [step(notes), step(texts)])
    add("AnchorPointAnnotationUnits", "CS", lit("PIXEL"), [step(notes), step(texts)])
    add("AnchorPoint", "FL", F.lit(struct.pack("<2f", 1.5, -2.25)), [step(notes), step(texts)])
    add("AnchorPointVisibility", "CS", lit("Y"), [step(notes), step(texts)])
    add("AnchorPointAnnotationUnits", "CS", lit("MILES"), [step(notes), step(texts, 1)])
    sequence("GraphicObject", 2, [step(notes)])
    for k, kind in enumerate(("POLYLINE", "BLOB")):
        at = [step(notes), step(graphics, k)]
        add("GraphicAnnotationUnits", "CS", lit("DISPLAY"), at)
        add("GraphicDimensions", "US", us(F.lit(2)), at)
        add("NumberOfGraphicPoints", "US", us(F.lit(2)), at)
        add("GraphicData", "FL", F.lit(struct.pack("<4f", 0, 0.5, 1, 8)), at)
        add("GraphicType", "CS", lit(kind), at)
    files = p.select(F.col("p_partkey").cast("string").alias("file_id"), F.array_compact(F.array(*rows)).alias("elements"))
    found = presentation.presentation_states(part10.decode_files(part10.encode_arrays(files)))
    join = lambda c: F.array_join(c, ",")
    note, area, vois = F.get("graphic_annotations", F.lit(0)), F.get("displayed_areas", F.lit(0)), F.col("softcopy_voi")
    return found.select(
        F.col("file_id").cast("long").alias("p_partkey"),
        "status",
        F.col("content_label").alias("label"),
        F.col("rotation").cast("string").alias("rotation"),
        F.col("horizontal_flip").cast("string").alias("flip"),
        "lut_shape",
        join(F.col("referenced_images.sop_instance_uid")).alias("images"),
        join(F.get("referenced_images", F.lit(0))["frame_numbers"].cast("array<string>")).alias("numbers"),
        F.get(F.get(vois, F.lit(0))["window_presets"], F.lit(0))["center"].cast("long").cast("string").alias("center"),
        F.size(F.get(vois, F.lit(1))["window_presets"]).cast("string").alias("second_presets"),
        join(F.get(vois, F.lit(1))["refs"]).alias("second_refs"),
        F.concat_ws(",", area["left"], area["top"], area["right"], area["bottom"], area["size_mode"]).alias("area"),
        join(F.transform("graphic_layers", lambda x: F.concat_ws(":", x["name"], x["order"].cast("string")))).alias("layers"),
        join(F.transform(note["texts"], lambda x: F.concat_ws(":", x["text"], x["anchor_units"], join(F.transform(x["anchor"], lambda a: (a * 4).cast("long").cast("string"))), x["anchor_visible"].cast("string")))).alias("texts"),
        join(F.transform(note["graphics"], lambda x: F.concat_ws(":", x["type"], x["units"], x["point_count"].cast("string"), join(F.transform(x["points"], lambda a: (a * 2).cast("long").cast("string")))))).alias("graphics"),
    )


@query
def directory_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory a region with a record a nation; the region number 3 lacks a record type and is refused."""
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("own"))
    sequence = TAG["DirectoryRecordSequence"]
    row = lambda path, depth, k, name, value, items=None: F.struct(F.lit(False).alias("is_meta"), path.cast(model.PATH).alias("path"), F.lit(depth).alias("depth"), k.cast("int").alias("ordinal"), F.lit(TAG[name]).cast("long").alias("tag"), F.lit(model.ATTRIBUTES[name][1]).alias("vr"), value.cast("binary").alias("value"), (F.lit(None) if items is None else items).cast("int").alias("item_count"), F.lit(None).cast("array<binary>").alias("fragments"), F.lit(None).cast("binary").alias("bot"))
    path = lambda i: F.array(F.struct(F.lit(sequence).cast("long").alias("tag"), i.cast("int").alias("item")))
    heads = F.array(row(F.array(), 0, F.lit(0), "OffsetOfTheFirstDirectoryRecordOfTheRootDirectoryEntity", sl_bytes(F.array(F.lit(0)))), row(F.array(), 0, F.lit(1), "DirectoryRecordSequence", F.lit(b""), F.size("own")))
    kind = F.when(F.col("n_regionkey") == 3, text(F.lit(""))).otherwise(text(F.lit("IMAGE")))
    each = F.flatten(F.transform("own", lambda x, i: F.array(row(path(i), 1, i * 3 + 2, "DirectoryRecordType", kind), row(path(i), 1, i * 3 + 3, "ReferencedFileID", text(F.concat(F.lit("D\\"), x["n_name"]))), row(path(i), 1, i * 3 + 4, "ReferencedSOPInstanceUIDInFile", text(F.concat(F.lit("1.2."), x["n_nationkey"]))))))
    files = n.select(F.col("n_regionkey").cast("string").alias("file_id"), F.concat(heads, each).alias("elements"))
    found = directory.directory_records(part10.decode_files(part10.encode_arrays(files)))
    return found.select(F.col("file_id").cast("long").alias("n_regionkey"), "status", F.col("ordinal").cast("string").alias("ordinal"), "record_type", F.array_join("referenced_file", "/").alias("referenced"), F.col("sop_instance_uid").alias("uid"), (F.col("offset") > 0).cast("string").alias("has_offset"))


@query
def file_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ICC profiles, presentation LUT shapes, and the tags of each file in order."""
    p = spread(table(spark, sf_dir, "part"), "p_partkey")
    own = {"PatientID": text("p_partkey"), "ICCProfile": F.when(F.pmod("p_size", F.lit(2)) == 0, text(F.concat("p_name", F.lit("..")))), "PresentationLUTShape": F.element_at(F.array(text(F.lit("identity")), text(F.lit("INVERSE")), text(F.lit("x"))), (F.pmod("p_size", F.lit(3)) + 1).cast("int"))}
    decoded = part10.decode_files(part10.encode_arrays(p.select(F.col("p_partkey").cast("string").alias("file_id"), part10.data_set(own).alias("elements"))))
    tags = lookup.tags_of(part10.elements_of(decoded))
    slim = decoded.select("file_id", lookup.attribute("elements", "ICCProfile")["value"].alias("icc"), lookup.lut_shape(values.text(lookup.attribute("elements", "PresentationLUTShape")["value"])).alias("shape"))
    return slim.join(tags, "file_id").select(F.col("file_id").cast("long").alias("p_partkey"), F.length("icc").cast("string").alias("icc_bytes"), "shape", F.col("n").cast("long").alias("n"), F.array_join("tags", ",").alias("tags"))


@query
def scoped_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items that name a customer's nation, or none."""
    n = table(spark, sf_dir, "nation")
    items = n.select(F.col("n_nationkey").alias("ordinal"), F.when(F.col("n_nationkey") % 7 == 3, F.array().cast("array<string>")).otherwise(F.array(F.col("n_nationkey").cast("string"))).alias("refs"), F.lit(1).alias("state"))
    targets = table(spark, sf_dir, "customer").select(F.lit(1).alias("state"), "c_custkey", F.col("c_nationkey").cast("string").alias("uid"))
    return presentation.scoped_all(F.broadcast(items), targets, ["state"], "uid").select("c_custkey", F.col("ordinal").cast("long").alias("item"))


@query
def iod_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What customers lack of a CT image."""
    decoded = part10.decode_files(part10.encode_arrays(customers(spark, sf_dir)))
    found = validate.issues(part10.files_of(decoded), part10.elements_of(decoded), validate.requirements(spark, validate.IODS["ct_image"]))
    return found.select(F.col("file_id").cast("long").alias("c_custkey"), F.col("ordinal").cast("long").alias("ordinal"), "kind")


@query
def generated_uids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New identifiers differ each time; what holds is their form."""
    c = table(spark, sf_dir, "customer").select("c_custkey", values.uid("1.2.3").alias("uid"))
    return c.select("c_custkey", (F.col("uid").rlike(r"^1\.2\.3\.[1-9][0-9]{12}\.(0|[1-9][0-9]*)$") & (F.length("uid") <= 64)).cast("string").alias("valid"))


@query
def json_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as JSON has them: 64 bits as text or number, 16 bits out of range, wrong types; each bad file is a row."""
    o = table(spark, sf_dir, "orders")
    kind = F.pmod("o_orderkey", F.lit(6))
    us_value = F.when(kind == 0, F.lit("65536")).when(kind == 1, F.lit("1.5")).when(kind == 2, F.lit('"7"')).otherwise(F.pmod("o_custkey", F.lit(65536)).cast("string"))
    uv = F.when(kind == 4, F.concat(F.lit('"'), F.col("o_orderkey") + 9000000000, F.lit('"'))).otherwise((F.col("o_orderkey") + 9000000000).cast("string"))
    json = F.concat(F.lit('{"00280010":{"vr":"US","Value":['), us_value, F.lit(']},"00081140":{"vr":"SQ","Value":'), F.when(kind == 5, F.lit("3")).otherwise(F.lit("[]")), F.lit('},"00720083":{"vr":"UV","Value":['), uv, F.lit("]}}"))
    own = dicom_json.read_json(o.select(F.col("o_orderkey").cast("string").alias("file_id"), json.alias("json")))
    at = lambda tag: lookup.attribute("elements", tag)["value"]
    return own.select(F.col("file_id").cast("long").alias("o_orderkey"), "status", "error_kind", values.us(at("Rows")).cast("string").alias("rows"), F.get(values.uv_list(at(0x00720083)), F.lit(0)).cast("string").alias("uv"))


@query
def implicit_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Implicit VR files with tags of the built-in table, of a given one, of rules and of none, and a sequence of defined length."""
    c = spread(table(spark, sf_dir, "customer"), "c_custkey")
    e, request = part10.element, TAG["RequestAttributesSequence"]
    rows = [
        e(0x00080000, "UL", sl_bytes(F.array(F.lit(4))), ordinal=0),
        e(TAG["PerformedProcedureStepStartDate"], "DA", text(F.lit("20250101")), ordinal=1),
        e(request, "SQ", F.lit(b""), ordinal=2, items=1),
        e(0x00400007, "LO", text("c_name"), ordinal=3, path=[(request, 0)]),
        e(TAG["RadiopharmaceuticalInformationSequence"], "SQ", F.lit(b""), ordinal=4, items=0),
        e(TAG["SegmentationType"], "CS", text(F.lit("BINARY")), ordinal=5),
        e(0x00090010, "LO", text(F.lit("ACME")), ordinal=6),
        e(0x60020010, "US", us(F.lit(3)), ordinal=7),
        e(0x00720001, "LO", text("c_mktsegment"), ordinal=8),
    ]
    files = c.select(F.col("c_custkey").cast("string").alias("file_id"), F.array(*rows).alias("elements"))
    read = part10.elements_of(part10.decode_files(part10.encode_arrays(files, model.IMPLICIT_LE), vrs={0x00400007: "LO"})).where("not is_meta")
    return read.select(F.col("file_id").cast("long").alias("c_custkey"), F.col("tag").cast("long").alias("tag"), "vr", F.col("depth").cast("long").alias("depth"), F.when(F.col("vr") == "LO", values.text("value")).alias("value"))


@query
def hierarchy_without_uids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose nation has no series UID are in the series without name; no file is lost; series come by UID."""
    c = spread(table(spark, sf_dir, "customer"), "c_custkey")
    third = F.pmod("c_nationkey", F.lit(3)) == 0
    own = {"SeriesInstanceUID": F.when(~third, text(F.concat(F.lit("1."), "c_nationkey"))), "SOPInstanceUID": F.when(F.pmod("c_custkey", F.lit(2)) == 0, text(F.lpad(F.col("c_custkey").cast("string"), 9, "0"))), "InstitutionName": F.when(F.pmod("c_custkey", F.lit(5)) == 0, text("c_name"))}
    decoded = part10.decode_columns(part10.encode_arrays(c.select(F.col("c_custkey").cast("string").alias("file_id"), part10.data_set(own).alias("elements"))), hierarchy.KEYS)
    found = hierarchy.series(hierarchy.instances(decoded))
    return found.select("series_uid", F.col("n_instances").cast("long").alias("n_instances"), F.array_join("sop_uids", ",").alias("sop_uids"))


def _pixels(expression: str, status: str = "'ok'") -> str:
    return f"SELECT vec_id, 0::BIGINT AS frame, {status} AS status, array_to_string({expression}, ',') AS pixels FROM ({_SAMPLES})"


_HALVES = "samples[32 * f + 1:32 * f + 32]"

SQL = {
    "palette_frames": _pixels("flatten(list_transform(samples, lambda x: CASE least(x % 4, 2) WHEN 0 THEN [0, 5, 9] WHEN 1 THEN [10, 15, 19] ELSE [200, 205, 209] END))"),
    "one_bit_frames": _pixels("list_transform(samples, lambda x: CASE WHEN (x % 2 = 1) <> (vec_id % 2 = 1) THEN 255 ELSE 0 END)"),
    "modality_lut_frames": f"""
WITH m AS (SELECT vec_id, list_transform(samples, lambda x: ((greatest(0, least(3999, x - 100))) * 3) % 5000) AS v FROM ({_SAMPLES}))
SELECT vec_id, 0::BIGINT AS frame, 'ok' AS status, array_to_string(list_transform(v, lambda x: CASE WHEN x <= -0.5 THEN 0 WHEN x > 4999.5 THEN 255 ELSE CAST(round(((x - 2499.5) / 5000 + 0.5) * 255) AS INTEGER) END), ',') AS pixels FROM m""",
    "jpeg_ls_frames": "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'false' ELSE 'true' END AS fine, CASE WHEN p_partkey % 5 <> 0 THEN [" + ", ".join(f"'{s[5]}'" for s in JPEG_LS) + "][p_partkey % 4 + 1] END AS samples FROM part",
    "japanese_text": "SELECT c_custkey, [" + ", ".join(f"'{t}'" for _, _, t in JAPANESE) + ", NULL][c_custkey % 5 + 1] AS text FROM customer",
    "png_images": "SELECT vec_id, 'ok' AS status, '89504E470D0A1A0A' AS signature, 8::BIGINT AS columns, 8::BIGINT AS rows FROM embeddings",
    "grey8_frames": _pixels("list_transform(samples, lambda x: CASE WHEN vec_id % 2 = 1 THEN 255 - x % 256 ELSE x % 256 END)"),
    "rgb_planar_frames": _pixels("flatten(list_transform(range(1, 21), lambda i: [samples[i] % 256, samples[20 + i] % 256, samples[40 + i] % 256]))"),
    "rgb16_frames": _pixels("list_transform(samples[1:60], lambda x: x * 16 // 256)"),
    "ybr422_frames": _pixels("flatten(list_transform(range(32), lambda i: list_transform(range(3), lambda k: samples[(i // 2) * 4 + i % 2 + 1] % 256)))"),
    "padded_window": f"""
WITH m AS (SELECT vec_id, list_transform(samples, lambda x: x * 2.0 - 1000) AS v FROM ({_SAMPLES})),
u AS (SELECT vec_id, v, list_filter(v, lambda x: x < 800 OR x > 1200) AS used FROM m),
w AS (SELECT vec_id, v, coalesce((list_min(used) + list_max(used)) / 2, 0.0) AS c, CASE WHEN list_max(used) > list_min(used) THEN list_max(used) - list_min(used) ELSE 2.0 END AS w FROM u)
SELECT vec_id, 0::BIGINT AS frame, 'ok' AS status, array_to_string(list_transform(v, lambda x: CASE WHEN x <= c - 0.5 - (w - 1) / 2 THEN 0 WHEN x > c - 0.5 + (w - 1) / 2 THEN 255 ELSE CAST(round(((x - (c - 0.5)) / (w - 1) + 0.5) * 255) AS INTEGER) END), ',') AS pixels FROM w""",
    "shuttered_frames": _pixels("list_transform(range(64), lambda i: CASE WHEN i % 8 + 1 < vec_id % 3 + 1 OR i // 8 + 1 < 2 OR i // 8 + 1 > 7 OR (i // 8 + 1 - 4) * (i // 8 + 1 - 4) + (i % 8 + 1 - 5) * (i % 8 + 1 - 5) > 9 THEN 77 ELSE samples[i + 1] % 256 END)"),
    "first_frames": f"SELECT vec_id, array_to_string(samples[1:32], ',') AS samples FROM ({_SAMPLES})",
    **{k: f"SELECT vec_id, f AS frame, 'ok' AS status, array_to_string({_HALVES}, ',') AS samples FROM ({_SAMPLES}), range(2) t(f)" for k in ("native_frame_reads", "fragment_reads")},
    "presentation_state_fields": r"""
WITH p AS (SELECT *, p_partkey % 7 <> 0 AS ok FROM part)
SELECT p_partkey, CASE WHEN ok THEN 'ok' ELSE 'invalidPresentationState' END AS status, CASE WHEN ok THEN p_brand END AS label,
       CASE WHEN ok THEN CASE p_size % 5 WHEN 4 THEN '0' ELSE ((p_size % 5) * 90)::VARCHAR END END AS rotation,
       CASE WHEN ok THEN CASE p_size % 2 WHEN 0 THEN 'true' ELSE 'false' END END AS flip,
       CASE WHEN ok AND p_size % 2 = 0 THEN 'INVERSE' END AS lut_shape,
       CASE WHEN ok THEN '1.4.' || p_partkey || CASE WHEN p_partkey % 3 <> 0 THEN ',1.5' ELSE '' END END AS images,
       CASE WHEN ok THEN '1,3' END AS numbers, CASE WHEN ok THEN p_size::VARCHAR END AS center, CASE WHEN ok THEN '0' END AS second_presets, CASE WHEN ok THEN '1.5' END AS second_refs,
       CASE WHEN ok THEN (-p_size) || ',2,' || (p_partkey + 70000) || ',' || p_size || ',SCALE TO FIT' ELSE '' END AS area,
       CASE WHEN ok THEN p_type || ':' || p_size END AS layers, CASE WHEN ok THEN p_name || ':PIXEL:6,-9:true' END AS texts, CASE WHEN ok THEN 'POLYLINE:DISPLAY:2:0,1,2,16' END AS graphics
FROM p""",
    "directory_roundtrip": """
SELECT n_regionkey::BIGINT AS n_regionkey, 'ok' AS status, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::VARCHAR AS ordinal, 'IMAGE' AS record_type, 'D/' || n_name AS referenced, '1.2.' || n_nationkey AS uid, 'true' AS has_offset
FROM nation WHERE n_regionkey <> 3
UNION ALL SELECT 3, 'invalidDICOMDirectory', NULL, NULL, NULL, NULL, NULL WHERE EXISTS (SELECT 1 FROM nation WHERE n_regionkey = 3)""",
    "file_attributes": """
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN (strlen(p_name) + 2 + (strlen(p_name) % 2))::VARCHAR END AS icc_bytes, CASE p_size % 3 WHEN 0 THEN 'IDENTITY' WHEN 1 THEN 'INVERSE' END AS shape,
       (2 + (p_size % 2 = 0)::INTEGER)::BIGINT AS n, CASE WHEN p_size % 2 = 0 THEN '1048608,2629632,542113824' ELSE '1048608,542113824' END AS tags FROM part""",
    "scoped_filter": "SELECT c_custkey, n_nationkey::BIGINT AS item FROM customer JOIN nation ON n_nationkey % 7 = 3 OR n_nationkey = c_nationkey",
    "iod_presets": """
SELECT c_custkey, o::BIGINT AS ordinal, 'missing' AS kind FROM customer, (VALUES (0), (2), (8), (9), (10), (11), (12), (13)) t(o)""",
    "generated_uids": "SELECT c_custkey, 'true' AS valid FROM customer",
    "json_numbers": """
SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (3, 4) THEN 'ok' ELSE 'error' END AS status, CASE WHEN o_orderkey % 6 NOT IN (3, 4) THEN 'invalidDICOMJSON' END AS error_kind,
       CASE WHEN o_orderkey % 6 IN (3, 4) THEN (o_custkey % 65536)::VARCHAR END AS rows, CASE WHEN o_orderkey % 6 IN (3, 4) THEN (o_orderkey + 9000000000)::VARCHAR END AS uv FROM orders""",
    "implicit_dictionary": """
SELECT c_custkey, tag::BIGINT AS tag, vr, depth::BIGINT AS depth, CASE WHEN tag = 4194311 THEN c_name WHEN tag = 589840 THEN 'ACME' END AS value FROM customer,
(VALUES (524288, 'UL', 0), (4194884, 'DA', 0), (4194933, 'SQ', 0), (4194311, 'LO', 1), (5505046, 'SQ', 0), (6422529, 'CS', 0), (589840, 'LO', 0), (1610743824, 'US', 0), (7471105, 'UN', 0)) t(tag, vr, depth)""",
    "hierarchy_without_uids": """
WITH f AS (SELECT CASE WHEN c_nationkey % 3 = 0 THEN '' ELSE '1.' || c_nationkey END AS series_uid, CASE WHEN c_custkey % 2 = 0 THEN lpad(c_custkey::VARCHAR, 9, '0') END AS uid FROM customer)
SELECT series_uid, count(*) AS n_instances, coalesce(string_agg(uid, ',' ORDER BY uid), '') AS sop_uids FROM f GROUP BY series_uid""",
}
