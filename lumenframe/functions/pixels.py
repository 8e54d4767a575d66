"""Pixel arithmetic as array expressions: stored values, modality and VOI transforms, windows, masks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.binary import python_values


def _power_of_two(bits: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bits)


def stored(samples: Column, bits_stored: Column, signed: Column) -> Column:
    """Numbers masked to the stored bits, negative where the representation is signed and the top bit is set."""
    span = _power_of_two(bits_stored)
    half = _power_of_two(bits_stored - 1)
    return F.transform(samples, lambda x: F.when(signed & (F.pmod(x, span) >= half), F.pmod(x, span) - span).otherwise(F.pmod(x, span)))


def rescaled(samples: Column, slope: Column, intercept: Column) -> Column:
    return F.transform(samples, lambda x: x * slope + intercept)


def looked_up(samples: Column, first: Column, entries: Column) -> Column:
    """Entries of a table by stored value; values beyond its ends take the end's entry.

    entries should be a column or a literal: an expression would be evaluated again for every sample.
    """
    return F.transform(samples, lambda x: F.element_at(entries, (F.least(F.greatest(x - first, F.lit(0)), F.size(entries) - 1) + 1).cast("int")))


def scaled(entry: Column, bits: Column) -> Column:
    """A table entry on 0 to 255."""
    top = _power_of_two(bits) - 1
    return F.least(F.lit(255), F.round(entry * 255 / top)).cast("int")


def voi_looked_up(samples: Column, first: Column, entries: Column, bits: Column) -> Column:
    """A VOI table's 8-bit output; values are cut towards zero first. Only the entries that are hit are scaled."""
    whole = F.transform(samples, lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)))
    return F.transform(looked_up(whole, first, entries), lambda e: scaled(e, bits))


def auto_window(samples: Column, padding_low: Column | None = None, padding_high: Column | None = None) -> Column:
    """Centre and width from the data's range without the padding; a flat image has width 2, an empty one (0, 2)."""
    own = samples if padding_low is None else F.filter(samples, lambda x: padding_low.isNull() | ~x.between(padding_low, padding_high))
    low, high = F.array_min(own), F.array_max(own)
    center = F.coalesce((low + high) / 2, F.lit(0.0))
    width = F.when(high > low, high - low).otherwise(F.lit(2.0))
    return F.struct(center.cast("double").alias("center"), width.cast("double").alias("width"))


def window_error(center: Column, width: Column) -> Column:
    infinite = F.isnan(center) | F.isnan(width) | (F.abs(center) == float("inf")) | (F.abs(width) == float("inf"))
    return F.when(infinite, "invalidWindowSettings").when(width <= 1, "invalidWindowWidth")


def windowed(samples: Column, center: Column, width: Column) -> Column:
    """8-bit values of the linear window function of PS3.3 C.11.2.1.2; halves round away from zero."""
    middle, half = center - 0.5, (width - 1) / 2
    return F.transform(
        samples,
        lambda x: F.when(x <= middle - half, 0).when(x > middle + half, 255).otherwise(F.round(((x - middle) / (width - 1) + 0.5) * 255)).cast("int"),
    )


def inverts(photometric: Column, lut_shape: Column) -> Column:
    return (photometric == "MONOCHROME1") != (F.coalesce(lut_shape, F.lit("")) == "INVERSE")


def inverted(samples: Column, when: Column) -> Column:
    return F.when(when, F.transform(samples, lambda x: 255 - x)).otherwise(samples)


def inside_polygon(row: Column, column: Column, vertices: Column) -> Column:
    """Even-odd test of a point against an array of (row, column); fewer than three vertices hold nothing."""
    n = F.size(vertices)

    def crossing(i: Column) -> Column:
        a = F.element_at(vertices, i)
        b = F.element_at(vertices, F.when(i == 1, n).otherwise(i - 1))
        meet = (b["column"] - a["column"]).cast("double") * (row - a["row"]) / F.nullif(b["row"] - a["row"], F.lit(0)) + a["column"]
        return F.coalesce(((a["row"] > row) != (b["row"] > row)) & (column.cast("double") < meet), F.lit(False))

    hits = F.size(F.filter(F.sequence(F.lit(1), n), crossing))
    return (n >= 3) & (hits % 2 == 1)


def obscured(row: Column, column: Column, shapes: Column) -> Column:
    """Is the 1-based pixel outside any of the shutter's shapes; a bitmap shutter obscures nothing."""

    def outside(s: Column) -> Column:
        rectangle = ~(column.between(s["left"], s["right"]) & row.between(s["upper"], s["lower"]))
        circle = (row - s["row"]) * (row - s["row"]) + (column - s["column"]) * (column - s["column"]) > s["radius"] * s["radius"]
        return F.when(s["kind"] == "RECTANGULAR", rectangle).when(s["kind"] == "CIRCULAR", circle).when(s["kind"] == "POLYGONAL", ~inside_polygon(row, column, s["vertices"])).otherwise(False)

    return F.exists(shapes, outside)


def mask(shapes: list[dict], rows: int, columns: int) -> np.ndarray:
    """True where a pixel is certainly inside all shapes, as `not obscured` has it: a shape without one of its numbers hides all."""
    r, c = np.mgrid[1 : rows + 1, 1 : columns + 1]
    seen = np.ones((rows, columns), bool)
    for s in shapes:
        needed = {"RECTANGULAR": ("left", "right", "upper", "lower"), "CIRCULAR": ("row", "column", "radius")}.get(s["kind"], ())
        if any(s[n] is None for n in needed):
            seen[:] = False
        elif s["kind"] == "RECTANGULAR":
            seen &= (s["left"] <= c) & (c <= s["right"]) & (s["upper"] <= r) & (r <= s["lower"])
        elif s["kind"] == "CIRCULAR":
            seen &= (r - s["row"]) ** 2 + (c - s["column"]) ** 2 <= s["radius"] ** 2
        elif s["kind"] == "POLYGONAL":
            inside, v = np.zeros((rows, columns), bool), s["vertices"] or []
            for k in range(len(v)) if len(v) >= 3 else ():
                a, b = v[k], v[k - 1]
                if None not in (a["row"], a["column"], b["row"], b["column"]) and a["row"] != b["row"]:
                    meet = (b["column"] - a["column"]) * (r - a["row"]) / (b["row"] - a["row"]) + a["column"]
                    inside ^= ((a["row"] > r) != (b["row"] > r)) & (c < meet)
            seen &= inside
    return seen


def visible(shapes: Column, rows: int, columns: int) -> Column:
    """The places, from 0, of the pixels that no shape obscures, for images of one size; NULL for NULL shapes.

    One mask a row in numpy: as an expression, `obscured` is interpreted anew for every pixel, shape and vertex.
    """

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def places(own: pa.Array) -> pa.Array:
        out = []
        for k in range(0, len(own), 1000):
            out += [None if x is None else np.flatnonzero(mask(x, rows, columns)) for x in python_values(own.slice(k, 1000))]
        return pa.array(out, pa.list_(pa.int32()))

    return places(shapes)


def shuttered(pixels: Column, rows: Column, columns: Column, shapes: Column, value: Column, components: int = 1) -> Column:
    """Pixels with obscured ones set to the high byte of the presentation value (0 if there is none)."""
    byte = F.coalesce(F.shiftright(value, 8), F.lit(0)).cast("int")
    painted = F.transform(pixels, lambda x, i: F.when(obscured(F.floor(i / components / columns).cast("int") + 1, F.pmod(F.floor(i / components).cast("int"), columns) + 1, shapes), byte).otherwise(x))
    return F.when(shapes.isNull() | (F.size(shapes) == 0), pixels).otherwise(painted)


def fixed_point_ybr(y: Column, cb: Column, cr: Column) -> Column:
    """Red, green, blue of a full-range YBR sample."""
    clamp = lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.round(v))).cast("int")
    return F.struct(clamp(y + 1.402 * (cr - 128)).alias("red"), clamp(y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128)).alias("green"), clamp(y + 1.772 * (cb - 128)).alias("blue"))


def frame_duration(vector: Column, frame_time: Column, index: Column) -> Column:
    return F.coalesce(F.get(vector, index), frame_time)


def frame_rate(recommended: Column, cine: Column, frame_time: Column) -> Column:
    return F.coalesce(recommended.cast("double"), cine.cast("double"), F.when(frame_time > 0, 1000 / frame_time))
