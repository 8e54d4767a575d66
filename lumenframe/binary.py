"""Decoding and encoding of data sets. Plain Python over bytes; the sources wrap it in Arrow batches.

The decoder keeps its own stack of open data sets and sequences, so nesting is not bounded by the interpreter's, and
yields flat rows. What a row holds is `model.ELEMENT`.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from lumenframe.model import BUILT_IN_VRS, EXPLICIT_LE, ITEM, ITEM_END, LONG_VRS, SEQUENCE_END, SWAP_WIDTH, TAG, TRANSFER_SYNTAXES, UNDEFINED, VRS, ruled_vr, tag_text

PIXEL_DATA, TRANSFER_SYNTAX_UID = TAG["PixelData"], TAG["TransferSyntaxUID"]


class DecodeError(ValueError):
    """A file that cannot be read: kind is one of a few names, detail says where."""

    def __init__(self, kind: str, detail: str = ""):
        super().__init__(f"{kind} {detail}".strip())
        self.kind, self.detail = kind, detail


def swapped(value: bytes, vr: str) -> bytes:
    """value with the bytes of its numbers reversed; unchanged if it is not a whole number of them."""
    width = SWAP_WIDTH.get(vr, 1)
    if width == 1 or len(value) % width:
        return value
    out = bytearray(len(value))
    for k in range(width):
        out[k::width] = value[width - 1 - k :: width]
    return bytes(out)


@dataclass
class Open:
    """A data set or sequence that is being read: its end (None: delimited) and the row of its sequence."""

    is_sequence: bool
    end: int | None
    path: list[tuple[int, int]]
    row: dict | None = None


class Decoder:
    def __init__(self, data: bytes, syntax: str, start: int = 0, vrs: dict[int, str] | None = None, pixels: str = "load", tags: frozenset[int] | None = None):
        if syntax not in TRANSFER_SYNTAXES:
            raise DecodeError("unsupportedTransferSyntax", syntax)
        _, self.explicit, big, _, _ = TRANSFER_SYNTAXES[syntax]
        self.data, self.at, self.vrs = data, start, BUILT_IN_VRS if vrs is None else vrs
        self.order, self.big = ">" if big else "<", big
        self.skip_pixels, self.tags = pixels == "skip", tags
        self.rows: list[dict] = []
        #: What was read, step by step: sources.shapes reads other files of the same shape by it.
        self.steps: list[tuple] = []

    def take(self, n: int) -> bytes:
        if n > len(self.data) - self.at:
            raise DecodeError("truncatedData", f"at {self.at}")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, code: str) -> int:
        return struct.unpack(self.order + code, self.take(struct.calcsize(code)))[0]

    def tag(self) -> int:
        group, element = struct.unpack(self.order + "HH", self.take(4))
        return group << 16 | element

    def read(self, meta_only: bool = False) -> list[dict]:
        """Rows up to the end of the data; with meta_only up to the first element outside group 0002."""
        stack = [Open(False, len(self.data), [])]
        while stack:
            top = stack[-1]
            if top.end is not None and self.at >= top.end:
                if self.at > top.end:
                    raise DecodeError("truncatedData", f"at {self.at}: beyond {top.end}")
                self.steps.append(("end",))
                stack.pop()
                continue
            if self.at >= len(self.data):
                raise DecodeError("truncatedData", f"at {self.at}")
            if top.is_sequence:
                self.item(stack)
                continue
            if meta_only and self.peek() >> 16 != 2:
                self.steps.append(("break", len(stack)))
                break
            if top.end is None and self.peek() == ITEM_END:
                self.tag()
                if self.number("I"):
                    raise DecodeError("truncatedData", f"at {self.at}: item end with a length")
                self.steps.append(("item_end",))
                stack.pop()
                continue
            self.element(stack)
        return self.rows

    def peek(self) -> int:
        if self.at + 4 > len(self.data):
            return -1
        group, element = struct.unpack_from(self.order + "HH", self.data, self.at)
        return group << 16 | element

    def item(self, stack: list[Open]) -> None:
        top, start = stack[-1], self.at
        tag, length = self.tag(), self.number("I")
        if tag == SEQUENCE_END:
            if top.end is not None or length:
                raise DecodeError("invalidSequenceItem", tag_text(tag))
            self.steps.append(("sequence_end",))
            stack.pop()
        elif tag != ITEM:
            raise DecodeError("invalidSequenceItem", tag_text(tag))
        else:
            end = None if length == UNDEFINED else self.at + length
            if end is not None and end > len(self.data):
                raise DecodeError("truncatedData", f"item at {start}")
            row = top.row
            row["item_offsets"].append(start)
            row["item_count"] += 1
            self.steps.append(("item", end is None, row))
            stack.append(Open(False, end, [*top.path, (row["tag"], row["item_count"] - 1)]))

    def header(self) -> tuple[int, str, int]:
        tag = self.tag()
        if not self.explicit:
            length = self.number("I")
            return tag, self.vrs.get(tag) or ruled_vr(tag) or ("SQ" if length == UNDEFINED else "UN"), length
        raw = self.take(2)
        vr = raw.decode("ascii", "replace")
        if vr not in VRS:
            raise DecodeError("invalidVR", vr)
        if vr in LONG_VRS:
            self.take(2)
            return tag, vr, self.number("I")
        return tag, vr, self.number("H")

    def element(self, stack: list[Open]) -> None:
        path = stack[-1].path
        tag, vr, length = self.header()
        row = {"is_meta": False, "path": [{"tag": t, "item": i} for t, i in path], "depth": len(path), "ordinal": len(self.rows), "tag": tag, "tag_hex": f"{tag:08X}", "vr": vr, "value": b"", "value_offset": self.at, "value_length": length}
        self.rows.append(row)
        if vr == "SQ" or (vr == "UN" and length == UNDEFINED):
            end = None if length == UNDEFINED else self.at + length
            if end is not None and end > len(self.data):
                raise DecodeError("truncatedData", f"sequence {tag_text(tag)}")
            row |= {"item_count": 0, "item_offsets": [], "value_length": 0}
            self.steps.append(("open" if end is None else "sequence", row))
            stack.append(Open(True, end, path, row))
        elif tag == PIXEL_DATA and length == UNDEFINED:
            self.steps.append(("pixels", row))
            self.encapsulated(row)
        elif length == UNDEFINED:
            raise DecodeError("unsupportedUndefinedLength", tag_text(tag))
        elif tag == PIXEL_DATA and self.skip_pixels and not path or self.tags is not None and tag not in self.tags and not path:
            # Only the place is kept; a later read fetches the bytes.
            if length > len(self.data) - self.at:
                raise DecodeError("truncatedData", f"{tag_text(tag)} at {self.at}")
            self.steps.append(("skipped", row))
            self.at += length
        else:
            self.steps.append(("value", row))
            value = self.take(length)
            row["value"] = swapped(value, vr) if self.big else value

    def encapsulated(self, row: dict) -> None:
        skip = self.skip_pixels and not row["path"]
        table, fragments, offsets, ranges, first = None, [], [], [], None
        while True:
            start = self.at
            if start >= len(self.data):
                raise DecodeError("truncatedData", "pixel items")
            tag, length = self.tag(), self.number("I")
            if tag == SEQUENCE_END:
                if length or table is None or not (offsets or skip):
                    raise DecodeError("invalidEncapsulatedPixelData")
                break
            if tag != ITEM or length == UNDEFINED:
                raise DecodeError("invalidEncapsulatedPixelData")
            if table is None:
                table = self.take(length)
                continue
            first = start if first is None else first
            offsets.append(start - first)
            ranges.append({"offset": self.at, "length": length})
            content = self.take(length)
            if not skip:
                fragments.append(content)
        row |= {"value_length": 0, "fragments": None if skip else fragments, "fragment_offsets": offsets, "bot": table, "fragment_ranges": ranges}


def python_values(column: pa.Array) -> list:
    """The same as column.to_pylist(), several times faster for nested columns and for bytes: no object a value but the value."""
    n, kind = len(column), column.type
    if column.null_count == n:
        return [None] * n
    if pa.types.is_struct(kind):
        names = [f.name for f in kind]
        out = [dict(zip(names, values, strict=True)) for values in zip(*map(python_values, column.flatten()), strict=True)] if names else [{} for _ in range(n)]
    elif pa.types.is_list(kind):
        flat, out, at = python_values(column.flatten()), [], 0
        for size in column.value_lengths().to_numpy(zero_copy_only=False).tolist() if not column.null_count else column.value_lengths().fill_null(0).to_numpy().tolist():
            out.append(flat[at : at + size])
            at += size
    elif pa.types.is_binary(kind):
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
        data = column.buffers()[2]
        data = b"" if data is None else data[int(ends[0]) : int(ends[-1])].to_pybytes()
        ends = (ends - ends[0]).tolist()
        out = [data[x:y] for x, y in zip(ends, ends[1:])]
    elif pa.types.is_string(kind):
        coded = column.dictionary_encode()
        known = coded.dictionary.to_pylist()
        out = [known[k] for k in coded.indices.fill_null(0).to_numpy(zero_copy_only=False).tolist()]
    elif pa.types.is_integer(kind):
        out = column.fill_null(0).to_numpy(zero_copy_only=False).tolist()
    elif pa.types.is_boolean(kind):
        out = column.fill_null(False).to_numpy(zero_copy_only=False).tolist()
    else:
        return column.to_pylist()
    if column.null_count:
        for k in np.flatnonzero(column.is_null().to_numpy(zero_copy_only=False)).tolist():
            out[k] = None
    return out


#: What of an element its nested data sets are made of: tree and the data sets read these.
NEEDED = ("is_meta", "path", "depth", "ordinal", "tag", "vr", "value", "item_count", "fragments", "fragment_offsets", "bot")


def paths(column: pa.Array) -> list:
    """python_values of a column of paths; equal paths are the same list, which nobody may change."""
    inner = column.flatten()
    parts = inner.flatten()
    if not len(inner):
        return [[]] * len(column) if not column.null_count else column.to_pylist()
    if column.null_count or inner.null_count or any(c.null_count for c in parts):
        return python_values(column)
    steps = np.stack([c.cast(pa.int64()).to_numpy() for c in parts], axis=1)
    raw, width = steps.tobytes(), 8 * len(parts)
    names, known, out, at = [f.name for f in inner.type], {b"": []}, [], 0
    for n in column.value_lengths().to_numpy().tolist():
        key = raw[at : at + n * width]
        if (own := known.get(key)) is None:
            own = known[key] = [dict(zip(names, x, strict=True)) for x in steps[at // width : at // width + n].tolist()]
        out.append(own)
        at += n * width
    return out


def element_rows(column: pa.Array, needed: tuple[str, ...] | None = None) -> Iterator[list[dict]]:
    """Each value of an Arrow list-of-structs column as a list of rows, of the needed fields only where they are named.

    Far cheaper than converting value by value.
    """
    flat = column.flatten()
    if flat.null_count:
        for rows in python_values(column):
            yield rows or []
        return
    own = {f.name: c for f, c in zip(flat.type, flat.flatten(), strict=True) if needed is None or f.name in needed}
    columns = [paths(c) if name == "path" and pa.types.is_list(c.type) and pa.types.is_struct(c.type.value_type) else python_values(c) for name, c in own.items()]
    rows = [dict(zip(own, values, strict=True)) for values in zip(*columns, strict=True)]
    at = 0
    for n in column.value_lengths().to_pylist():
        yield rows[at : at + (n or 0)]
        at += n or 0


def inflate(data: bytes) -> bytes:
    try:
        return zlib.decompressobj(-15).decompress(data)
    except zlib.error as e:
        raise DecodeError("invalidDeflatedData", str(e)) from e


def deflate(data: bytes) -> bytes:
    c = zlib.compressobj(9, zlib.DEFLATED, -15)
    return c.compress(data) + c.flush()


def decode_part10(content: bytes, steps: list[tuple] | None = None, **options) -> tuple[str, list[dict]]:
    """(transfer syntax, rows) of a Part 10 file; group 0002 rows come first, marked is_meta. steps takes what was read."""
    if content[128:132] != b"DICM":
        raise DecodeError("missingPart10Preamble")
    head = Decoder(content, EXPLICIT_LE, 132)
    meta = head.read(meta_only=True)
    for row in meta:
        row["is_meta"] = True
    named = [r["value"].rstrip(b"\0 ").decode("ascii", "replace") for r in meta if r["tag"] == TRANSFER_SYNTAX_UID and r["depth"] == 0]
    if not named or not named[-1]:
        raise DecodeError("missingTransferSyntaxUID")
    syntax = named[-1]
    if syntax not in TRANSFER_SYNTAXES:
        raise DecodeError("unsupportedTransferSyntax", syntax)
    data, start = content, head.at
    if TRANSFER_SYNTAXES[syntax][3]:
        data, start = inflate(content[start:]), 0
    body = Decoder(data, syntax, start, **options)
    rows = body.read()
    for row in rows:
        row["ordinal"] += len(meta)
    if steps is not None:
        steps += [*head.steps, ("body",), *body.steps]
    return syntax, meta + rows


def decode_dataset(content: bytes, syntax: str, steps: list[tuple] | None = None, **options) -> list[dict]:
    """Rows of a data set without preamble and file meta information. steps takes what was read."""
    if syntax in TRANSFER_SYNTAXES and TRANSFER_SYNTAXES[syntax][3]:
        content = inflate(content)
    body = Decoder(content, syntax, **options)
    rows = body.read()
    if steps is not None:
        steps += body.steps
    return rows


@dataclass
class Element:
    """An element with its nested items, as the encoder needs it."""

    tag: int
    vr: str
    value: bytes = b""
    items: list[dict[int, Element]] | None = None
    fragments: list[bytes] | None = None
    bot: bytes = b""
    row: dict = field(default_factory=dict)


def tree(rows: list[dict]) -> dict[int, Element]:
    """Nested elements of flat rows; of duplicates in one data set the last one stays."""
    root: dict[int, Element] = {}
    places: dict[tuple, dict[int, Element]] = {(): root}
    for row in sorted(rows, key=lambda r: (r["depth"], r["ordinal"])):
        where = tuple([(p["tag"], p["item"]) for p in row["path"]]) if row["path"] else ()
        if where not in places:
            continue  # below a sequence that is gone or was replaced
        e = Element(row["tag"], row["vr"], bytes(row["value"] or b""), None, row.get("fragments"), bytes(row.get("bot") or b""), row)
        if row.get("item_count") is not None:
            e.items = [{} for _ in range(row["item_count"])]
        if e.tag in places[where]:  # a duplicate takes the items of the one before it away
            for stale in [k for k in places if len(k) > len(where) and k[: len(where)] == where and k[len(where)][0] == e.tag]:
                del places[stale]
        places[where][e.tag] = e
        for i, item in enumerate(e.items or []):
            places[(*where, (e.tag, i))] = item
    return root


class Encoder:
    def __init__(self, syntax: str, undefined_lengths: bool = False):
        if syntax not in TRANSFER_SYNTAXES:
            raise DecodeError("unsupportedTransferSyntax", syntax)
        _, self.explicit, self.big, self.deflated, self.encapsulated = TRANSFER_SYNTAXES[syntax]
        self.order, self.undefined = ">" if self.big else "<", undefined_lengths

    def head(self, tag: int) -> bytes:
        return struct.pack(self.order + "HH", tag >> 16, tag & 0xFFFF)

    def item(self, tag: int, content: bytes = b"", length: int | None = None) -> bytes:
        return self.head(tag) + struct.pack(self.order + "I", len(content) if length is None else length) + content

    def element(self, e: Element) -> bytes:
        if e.tag == PIXEL_DATA and e.fragments is not None:
            if not self.explicit:
                raise DecodeError("invalidEncapsulatedPixelData")
            parts = [self.head(e.tag), e.vr.encode(), b"\0\0", struct.pack(self.order + "I", UNDEFINED)]
            parts += [self.item(ITEM, padded(x, "OB")) for x in (e.bot, *e.fragments)]
            return b"".join([*parts, self.item(SEQUENCE_END)])
        if e.vr == "SQ":
            value = b"".join(self.item(ITEM, (body := self.dataset(i)) + (self.item(ITEM_END) if self.undefined else b""), UNDEFINED if self.undefined else len(body)) for i in e.items or [])
        else:
            value = padded(swapped(e.value, e.vr) if self.big else e.value, e.vr)
        length, tail = len(value), b""
        if e.vr == "SQ" and self.undefined:
            length, tail = UNDEFINED, self.item(SEQUENCE_END)
        if not self.explicit:
            return self.head(e.tag) + struct.pack(self.order + "I", length) + value + tail
        if e.vr in LONG_VRS:
            return self.head(e.tag) + e.vr.encode() + b"\0\0" + struct.pack(self.order + "I", length) + value + tail
        if length > 0xFFFF:
            raise DecodeError("truncatedData", f"{tag_text(e.tag)} is too long for its VR")
        return self.head(e.tag) + e.vr.encode() + struct.pack(self.order + "H", length) + value

    def dataset(self, elements: dict[int, Element]) -> bytes:
        return b"".join(self.element(elements[t]) for t in sorted(elements))


def padded(value: bytes, vr: str) -> bytes:
    """value at even length: short text ends in a space, identifiers and binary in zero."""
    return value if len(value) % 2 == 0 else value + (b"\0" if vr == "UI" or vr in LONG_VRS else b" ")


def encode_dataset(elements: dict[int, Element], syntax: str = EXPLICIT_LE, undefined_lengths: bool = False) -> bytes:
    """A data set alone: no preamble, no group 0002."""
    encoder = Encoder(syntax, undefined_lengths)
    body = {t: e for t, e in elements.items() if t >> 16 != 2}
    if encoder.encapsulated and PIXEL_DATA in body and body[PIXEL_DATA].fragments is None:
        raise DecodeError("invalidEncapsulatedPixelData")
    out = encoder.dataset(body)
    return deflate(out) if encoder.deflated else out


def encode_part10(meta: dict[int, Element], elements: dict[int, Element], syntax: str = EXPLICIT_LE, undefined_lengths: bool = False) -> bytes:
    """A Part 10 file; length, version and transfer syntax of the file meta information are written anew."""
    body = encode_dataset(elements, syntax, undefined_lengths)
    own = {t: e for t, e in meta.items() if t >> 16 == 2 and t != 0x00020000}
    own[0x00020001] = Element(0x00020001, "OB", b"\0\1")
    own[TRANSFER_SYNTAX_UID] = Element(TRANSFER_SYNTAX_UID, "UI", syntax.encode())
    encoder = Encoder(EXPLICIT_LE)
    head = encoder.dataset(own)
    return b"\0" * 128 + b"DICM" + encoder.element(Element(0x00020000, "UL", struct.pack("<I", len(head)))) + head + body


def basic_offset_table(frames: list[list[bytes]]) -> bytes:
    """Offsets of the frames' first fragments, from the first fragment's item."""
    out, at = [], 0
    for fragments in frames:
        out.append(at)
        at += sum(8 + len(f) + len(f) % 2 for f in fragments)
    return struct.pack(f"<{len(out)}I", *out)


def first_multipart_body(body: bytes, content_type: str) -> bytes | None:
    """The first part of a multipart body, by the boundary that its content type names."""
    marks = [p.split("=", 1)[1].strip().strip('"') for p in content_type.split(";")[1:] if p.strip().lower().startswith("boundary=")]
    if not marks or not marks[0]:
        return None
    begin = body.find(b"--" + marks[0].encode())
    head_end = body.find(b"\r\n\r\n", begin) if begin >= 0 else -1
    if head_end < 0:
        return None
    end = body.find(b"\r\n--" + marks[0].encode(), head_end + 2)
    return body[head_end + 4 : end] if end >= 0 else None


def multipart_body(instances: list[bytes], boundary: str) -> bytes:
    """A multipart/related body of Part 10 files."""
    mark = boundary.encode()
    return b"".join(b"--" + mark + b"\r\nContent-Type: application/dicom\r\n\r\n" + x + b"\r\n" for x in instances) + b"--" + mark + b"--\r\n"
