"""DICOM JSON (PS3.18 annex F): elements to JSON text and back."""

from __future__ import annotations

import base64
import binascii
import json
import math
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumenframe import binary
from lumenframe.arrow import mapped
from lumenframe.binary import Element
from lumenframe.dataset import DataSet
from lumenframe.model import BINARY_VRS, TEXT_VRS, VRS
from lumenframe.sources.part10 import DECODED

KEY = re.compile(r"[0-9A-Fa-f]{8}")
GROUPS = ("Alphabetic", "Ideographic", "Phonetic")
# Number formats by VR, and least and greatest integers.
FORMATS = {"US": "<H", "SS": "<h", "UL": "<I", "SL": "<i", "UV": "<Q", "SV": "<q", "FL": "<f", "FD": "<d"}
LIMITS = {"US": (0, 2**16 - 1), "SS": (-(2**15), 2**15 - 1), "UL": (0, 2**32 - 1), "SL": (-(2**31), 2**31 - 1), "UV": (0, 2**64 - 1), "SV": (-(2**63), 2**63 - 1)}


class JSONError(ValueError):
    """JSON that is not a DICOM data set."""


def to_json(ds: DataSet) -> dict:
    """A data set as a JSON object; group lengths are left out, 64-bit integers are strings."""
    return {f"{t:08X}": element_json(ds, e) for t, e in sorted(ds.elements.items()) if t & 0xFFFF}


def element_json(ds: DataSet, e: Element) -> dict:
    out: dict = {"vr": e.vr}
    if e.items is not None:
        out["Value"] = [to_json(DataSet(i)) for i in e.items]
    elif e.fragments is not None:
        raise JSONError("encapsulated pixel data needs a bulk data reference")
    elif e.vr in BINARY_VRS:
        out["InlineBinary"] = base64.b64encode(e.value).decode()
    else:
        values = values_of(ds, e)
        if values is not None:
            out["Value"] = values
    return out


def values_of(ds: DataSet, e: Element) -> list | None:
    if e.vr == "AT":
        if len(e.value) % 4:
            return None
        pairs = np.frombuffer(e.value, "<u2").reshape(-1, 2)
        return [f"{g:04X}{n:04X}" for g, n in pairs.tolist()]
    if e.vr in FORMATS:
        if len(e.value) % struct.calcsize(FORMATS[e.vr]):
            return None
        numbers = np.frombuffer(e.value, FORMATS[e.vr]).tolist()
        return [str(x) for x in numbers] if e.vr in ("UV", "SV") else numbers
    texts = ds.texts(e.tag)
    if e.vr == "PN" and texts is not None:
        return [dict(zip(GROUPS, t.split("=", 2), strict=False)) for t in texts]
    return texts


def from_json(raw: dict, bulk: Callable[[str], bytes] | None = None) -> dict[int, Element]:
    """Elements of a JSON object; bulk fetches what bulk data references name."""
    if not isinstance(raw, dict):
        raise JSONError("not an object")
    out = {}
    for key, body in raw.items():
        if not KEY.fullmatch(key) or not isinstance(body, dict) or not isinstance(body.get("vr"), str) or body["vr"] not in VRS:
            raise JSONError(f"not an element: {key}")
        given = [k for k in ("Value", "InlineBinary", "BulkDataURI") if body.get(k) is not None]
        if len(given) > 1:
            raise JSONError(f"{key} has more than one value")
        tag = int(key, 16)
        out[tag] = element_of(tag, body["vr"], body, bulk)
    return out


def element_of(tag: int, vr: str, body: dict, bulk: Callable[[str], bytes] | None) -> Element:
    if not isinstance(body.get("Value", []), (list, type(None))) or not isinstance(body.get("BulkDataURI", ""), (str, type(None))):
        raise JSONError("not a list of values, or no reference")
    if body.get("BulkDataURI") is not None:
        if bulk is None:
            raise JSONError("a bulk data reference without a resolver")
        return Element(tag, vr, bulk(body["BulkDataURI"]))
    values = body.get("Value") or []
    if vr == "SQ" or vr == "UN" and body.get("Value") is not None:
        return Element(tag, vr, items=[from_json(v, bulk) for v in values])
    if vr in BINARY_VRS:
        try:
            return Element(tag, vr, base64.b64decode(body["InlineBinary"], validate=True))
        except (KeyError, TypeError, binascii.Error) as e:
            raise JSONError("no inline binary") from e
    return Element(tag, vr, b"".join(packed(vr, v) for v in values) if vr in FORMATS or vr == "AT" else joined(vr, values))


def packed(vr: str, value) -> bytes:
    if vr == "AT":
        if not isinstance(value, str) or not re.fullmatch(r"[0-9A-F]{8}", value):
            raise JSONError("not a tag")
        return struct.pack("<HH", int(value[:4], 16), int(value[4:], 16))
    if vr in ("UV", "SV") and isinstance(value, str):
        if not re.fullmatch(r"[+-]?[0-9]+", value):
            raise JSONError("not an integer")
        value = int(value)
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        raise JSONError("not a number")
    if vr in LIMITS:
        if value != int(value) or not LIMITS[vr][0] <= value <= LIMITS[vr][1]:
            raise JSONError("out of range")
        value = int(value)
    try:
        return struct.pack(FORMATS[vr], value)
    except OverflowError:
        return struct.pack(FORMATS[vr], math.copysign(math.inf, value))


def joined(vr: str, values: list) -> bytes:
    if vr == "PN":
        parts = []
        for v in values:
            if not isinstance(v, dict) or not any(v.get(g) is not None for g in GROUPS):
                raise JSONError("not a person name")
            own = [v.get(g) for g in GROUPS]
            if not all(x is None or isinstance(x, str) for x in own):
                raise JSONError("not a person name")
            last = max(k for k, x in enumerate(own) if x is not None)
            parts.append("=".join(x or "" for x in own[: last + 1]))
        return "\\".join(parts).encode()
    if vr not in TEXT_VRS or not all(isinstance(v, str) for v in values):
        raise JSONError("not text")
    return "\\".join(values).encode()


JSON = T.StructType([T.StructField("file_id", T.StringType()), T.StructField("status", T.StringType()), T.StructField("json", T.StringType())])


def write_json(decoded: DataFrame) -> DataFrame:
    """(file_id, status, json) of decoded files' data sets."""
    schema = to_arrow_schema(JSON)

    def one(file_id: str, elements: list[dict]) -> dict:
        try:
            text = json.dumps(to_json(DataSet(binary.tree([e for e in elements if not e["is_meta"]]))), ensure_ascii=False, separators=(",", ":"))
        except JSONError:
            return {"file_id": file_id, "status": "invalidDICOMJSON"}
        return {"file_id": file_id, "status": "ok", "json": text}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([one(a, b) for a, b in zip(batch.column(0).to_pylist(), binary.element_rows(batch.column(1), binary.NEEDED), strict=True)], schema=schema)

    return mapped(decoded.where("status = 'ok'").select("file_id", "elements"), run, JSON)


def flattened(elements: dict[int, Element], path: list[dict], rows: list[dict]) -> list[dict]:
    """Flat rows, as decoding gives them, of nested elements."""
    for tag in sorted(elements):
        e = elements[tag]
        rows.append({"is_meta": False, "path": path, "depth": len(path), "ordinal": len(rows), "tag": tag, "tag_hex": f"{tag:08X}", "vr": e.vr, "value": e.value, "item_count": None if e.items is None else len(e.items)})
        for k, item in enumerate(e.items or []):
            flattened(item, [*path, {"tag": tag, "item": k}], rows)
    return rows


def read_json(texts: DataFrame, id_col: str = "file_id", json_col: str = "json", bulk: DataFrame | None = None) -> DataFrame:
    """Decoded files of JSON texts, with the columns of part10.DECODED.

    bulk: (file_id, uri, content) of the references; each file's own travel with it.
    """
    schema = to_arrow_schema(DECODED)
    own = texts.select(F.col(id_col).cast("string").alias("file_id"), F.col(json_col).alias("json"))
    if bulk is None:
        own = own.withColumn("bulk", F.lit(None).cast("map<string,binary>"))
    else:
        own = own.join(bulk.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("uri", "content"))).alias("bulk")), "file_id", "left")

    def one(file_id: str, text: str | None, content: dict[str, bytes] | None) -> dict:
        row = {"file_id": file_id, "length": len(text or ""), "status": "ok", "elements": []}

        def fetch(uri: str) -> bytes:
            if uri not in content:
                raise JSONError(f"no bulk data {uri}")
            return content[uri]

        try:
            row["elements"] = flattened(from_json(json.loads(text or ""), fetch if content is not None else None), [], [])
        except (JSONError, RecursionError, ArithmeticError, AttributeError, LookupError, TypeError, ValueError, struct.error) as e:
            # Whatever types the text has where others are meant, the file is a row with an error.
            row |= {"status": "error", "error_kind": "invalidDICOMJSON", "error_detail": str(e)}
        return row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(a.as_py(), b.as_py(), None if c.as_py() is None else dict(c.as_py())) for a, b, c in zip(*batch.columns, strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return mapped(own.select("file_id", "json", "bulk"), run, DECODED)


def json_value(text: Column, tag: int, index: int = 0) -> Column:
    """One value of a top-level element as text, without decoding the rest."""
    return F.try_variant_get(F.try_parse_json(text), f"$['{tag:08X}'].Value[{index}]", "string")


def valid_keys(text: Column) -> Column:
    """Are all keys of the object tags."""
    return F.forall(F.json_object_keys(text), lambda k: k.rlike("^[0-9A-Fa-f]{8}$"))
