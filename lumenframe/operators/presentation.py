"""Grayscale softcopy presentation states: reading them and applying them to frames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumenframe import binary
from lumenframe.arrow import mapped
from lumenframe.dataset import INTEGER, DataSet
from lumenframe.model import SOP_CLASSES
from lumenframe.operators.frames import DOUBLE, FRAME, INT, LUT, PRESET, SHUTTER, TEXT, _struct, lut_shape_of, shutter_of, table_of, window_presets

#: References with their VOI are broadcast up to this many bytes of JSON.
BROADCAST_BYTES = 32 << 20

#: Annotation units and graphic types of PS3.3.
UNITS = frozenset({"PIXEL", "DISPLAY", "MATRIX"})
GRAPHIC_TYPES = frozenset({"POINT", "POLYLINE", "INTERPOLATED", "CIRCLE", "ELLIPSE"})

NUMBERS = T.ArrayType(DOUBLE)
REFERENCE = _struct(series_instance_uid=TEXT, sop_class_uid=TEXT, sop_instance_uid=TEXT, frame_numbers=T.ArrayType(INT))
VOI = _struct(refs=T.ArrayType(TEXT), window_presets=T.ArrayType(PRESET), voi_luts=T.ArrayType(LUT))
AREA = _struct(refs=T.ArrayType(TEXT), left=INT, top=INT, right=INT, bottom=INT, size_mode=TEXT, pixel_spacing=NUMBERS, pixel_aspect_ratio=T.ArrayType(INT), magnification=DOUBLE)
LAYER = _struct(name=TEXT, order=INT, grayscale=INT, description=TEXT)
TEXT_OBJECT = _struct(text=TEXT, top_left=NUMBERS, bottom_right=NUMBERS, anchor=NUMBERS, box_units=TEXT, anchor_units=TEXT, anchor_visible=T.BooleanType())
GRAPHIC = _struct(units=TEXT, dimensions=INT, point_count=INT, points=NUMBERS, type=TEXT, filled=T.BooleanType())
ANNOTATION = _struct(refs=T.ArrayType(TEXT), layer=TEXT, texts=T.ArrayType(TEXT_OBJECT), graphics=T.ArrayType(GRAPHIC))
STATE = _struct(
    file_id=TEXT,
    status=TEXT,
    sop_instance_uid=TEXT,
    content_label=TEXT,
    content_description=TEXT,
    referenced_images=T.ArrayType(REFERENCE),
    rotation=INT,
    horizontal_flip=T.BooleanType(),
    lut_shape=TEXT,
    shutter=SHUTTER,
    softcopy_voi=T.ArrayType(VOI),
    displayed_areas=T.ArrayType(AREA),
    graphic_layers=T.ArrayType(LAYER),
    graphic_annotations=T.ArrayType(ANNOTATION),
)


def scope(item: DataSet) -> list[str]:
    """UIDs of the images that an item names; none means that it holds for all."""
    return [u for u in (i.text("ReferencedSOPInstanceUID") for i in item.items("ReferencedImageSequence")) if u is not None]


def checked(value: str | None, allowed: frozenset[str]) -> str | None:
    return value if value in allowed else None


def floats(item: DataSet, name: str) -> list[float] | None:
    a = item.array(name, "<f4")
    return None if a is None else a.astype(float).tolist()


def reference(series: DataSet, image: DataSet) -> dict:
    numbers = image.texts("ReferencedFrameNumber")
    return {"series_instance_uid": series.text("SeriesInstanceUID"), "sop_class_uid": image.text("ReferencedSOPClassUID"), "sop_instance_uid": image.text("ReferencedSOPInstanceUID"), "frame_numbers": None if numbers is None else [int(n) for n in numbers if INTEGER.fullmatch(n)]}


def area(item: DataSet) -> dict:
    first, last = (item.array(n, "<i4") for n in ("DisplayedAreaTopLeftHandCorner", "DisplayedAreaBottomRightHandCorner"))
    corner = lambda a: (int(a[0]), int(a[1])) if a is not None and len(a) == 2 else (None, None)
    (left, top), (right, bottom), scale = corner(first), corner(last), floats(item, "PresentationPixelMagnificationRatio")
    spacing = item.numbers("PresentationPixelSpacing") if item.get("PresentationPixelSpacing") is not None else None
    return {"refs": scope(item), "left": left, "top": top, "right": right, "bottom": bottom, "size_mode": item.text("PresentationSizeMode"), "pixel_spacing": spacing, "pixel_aspect_ratio": item.integers("PresentationPixelAspectRatio"), "magnification": scale[0] if scale else None}


def annotation(item: DataSet) -> dict:
    yes = lambda i, n: (i.text(n) or "").upper() == "Y"
    texts = [
        {"text": t.text("UnformattedTextValue"), "top_left": floats(t, "BoundingBoxTopLeftHandCorner"), "bottom_right": floats(t, "BoundingBoxBottomRightHandCorner"), "anchor": floats(t, "AnchorPoint"), "box_units": checked(t.text("BoundingBoxAnnotationUnits"), UNITS), "anchor_units": checked(t.text("AnchorPointAnnotationUnits"), UNITS), "anchor_visible": yes(t, "AnchorPointVisibility")}
        for t in item.items("TextObjectSequence")
        if t.text("UnformattedTextValue") is not None
    ]
    graphics = [
        {"units": checked(g.text("GraphicAnnotationUnits"), UNITS), "dimensions": g.us("GraphicDimensions"), "point_count": g.us("NumberOfGraphicPoints"), "points": floats(g, "GraphicData"), "type": g.text("GraphicType"), "filled": yes(g, "GraphicFilled")}
        for g in item.items("GraphicObjectSequence")
        if None not in (g.us("GraphicDimensions"), g.us("NumberOfGraphicPoints"), floats(g, "GraphicData")) and g.text("GraphicType") in GRAPHIC_TYPES
    ]
    return {"refs": scope(item), "layer": item.text("GraphicLayer"), "texts": texts, "graphics": graphics}


def state_in(file_id: str, elements: list[dict]) -> dict:
    ds = DataSet(binary.tree([e for e in elements if not e["is_meta"]]))
    if ds.text("SOPClassUID") not in (None, SOP_CLASSES["grayscale_presentation_state"][0]):
        return {"file_id": file_id, "status": "invalidPresentationState"}
    layers = [{"name": i.text("GraphicLayer"), "order": i.integer("GraphicLayerOrder"), "grayscale": i.us("GraphicLayerRecommendedDisplayGrayscaleValue"), "description": i.text("GraphicLayerDescription")} for i in ds.items("GraphicLayerSequence")]
    rotation = ds.us("ImageRotation")
    return {
        "file_id": file_id,
        "status": "ok",
        "sop_instance_uid": ds.text("SOPInstanceUID"),
        "content_label": ds.text("ContentLabel"),
        "content_description": ds.text("ContentDescription"),
        "referenced_images": [reference(s, i) for s in ds.items("ReferencedSeriesSequence") for i in s.items("ReferencedImageSequence") if i.text("ReferencedSOPInstanceUID") is not None],
        "rotation": rotation if rotation in (90, 180, 270) else 0,
        "horizontal_flip": (ds.text("ImageHorizontalFlip") or "").upper() == "Y",
        "lut_shape": lut_shape_of(ds),
        "shutter": shutter_of(ds),
        "softcopy_voi": [{"refs": scope(i), "window_presets": window_presets(i), "voi_luts": [t for t in (table_of(x, True) for x in i.items("VOILUTSequence")) if t]} for i in ds.items("SoftcopyVOILUTSequence")],
        "displayed_areas": [area(i) for i in ds.items("DisplayedAreaSelectionSequence")],
        "graphic_layers": [x for x in layers if x["name"] is not None and x["order"] is not None],
        "graphic_annotations": [annotation(i) for i in ds.items("GraphicAnnotationSequence")],
    }


def presentation_states(decoded: DataFrame) -> DataFrame:
    """One row per decoded file, see STATE; other SOP classes have the status invalidPresentationState."""
    schema = to_arrow_schema(STATE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([state_in(a, b) for a, b in zip(batch.column(0).to_pylist(), binary.element_rows(batch.column(1), binary.NEEDED), strict=True)], schema=schema)

    return mapped(decoded.where("status = 'ok'").select("file_id", "elements"), run, STATE)


def scoped(items: DataFrame, targets: DataFrame, keys: list[str], uid: str = "sop_instance_uid") -> DataFrame:
    """For each target the item that names it, else the first item that names none.

    items has the keys, ordinal, refs and more; targets the keys and a UID. One item a target, by a partial minimum
    over (does it name none, ordinal).
    """
    extra = [c for c in items.columns if c not in (*keys, "ordinal", "refs")]
    joined = targets.join(items, keys)
    fits = joined.where(F.array_contains("refs", F.col(uid)) | (F.size("refs") == 0))
    best = fits.groupBy(*targets.columns).agg(F.min_by(F.struct("ordinal", *extra), F.struct(F.size("refs") == 0, F.col("ordinal"))).alias("chosen"))
    return best.select(*targets.columns, "chosen.*")


def scoped_all(items: DataFrame, targets: DataFrame, keys: list[str], uid: str = "sop_instance_uid") -> DataFrame:
    """For each target all items that name it or none."""
    return targets.join(items, keys).where(F.array_contains("refs", F.col(uid)) | (F.size("refs") == 0))


def apply_states(frames: DataFrame, states: DataFrame) -> DataFrame:
    """Frames of the images that each state refers to, with its shutter, VOI and LUT shape in place of their own.

    Adds state_file_id. Rotation, flip and displayed area are left to the display; referenced frame numbers do not
    restrict the frames. Images that no state refers to give no rows.
    """
    refs = states.where("status = 'ok'").select(F.col("file_id").alias("state_file_id"), F.col("lut_shape").alias("s_shape"), F.col("shutter").alias("s_shutter"), "softcopy_voi", F.explode(F.array_distinct("referenced_images.sop_instance_uid")).alias("sop_instance_uid"))
    named = F.filter("softcopy_voi", lambda v: F.array_contains(v["refs"], F.col("sop_instance_uid")))
    general = F.filter("softcopy_voi", lambda v: F.size(v["refs"]) == 0)
    chosen = refs.withColumn("voi", F.coalesce(F.get(named, F.lit(0)), F.get(general, F.lit(0)))).drop("softcopy_voi")
    # Frames carry pixels: while what the states say is small, as measured, it goes to the frames and not the other way round.
    size = chosen.agg(F.sum(F.length(F.to_json(F.struct(*chosen.columns)))).alias("n")).first()["n"] or 0
    joined = frames.where("status = 'ok'").join(F.broadcast(chosen) if size <= BROADCAST_BYTES else chosen, "sop_instance_uid")
    preset = F.get(F.col("voi.window_presets"), F.lit(0))
    changed = {
        "window_center": F.coalesce(preset["center"], "window_center"),
        "window_width": F.coalesce(preset["width"], "window_width"),
        "window_presets": F.when(F.col("voi").isNotNull(), F.col("voi.window_presets")).otherwise(F.col("window_presets")),
        "voi_luts": F.when(F.col("voi").isNotNull(), F.col("voi.voi_luts")).otherwise(F.col("voi_luts")),
        "shutter": F.coalesce("s_shutter", "shutter"),
        "lut_shape": F.coalesce("s_shape", "image_lut_shape"),
    }
    return joined.select("state_file_id", *[changed[c].alias(c) if c in changed else F.col(c) for c in FRAME.names])
