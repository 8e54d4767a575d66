"""Files of the same shape, encoded and decoded as columns.

Most files of a table have the same elements in the same order and differ in their values only. The first file of a
shape goes through `binary`; what was done for it, step by step, is then done for all files of that shape at once with
numpy and Arrow. A file that departs from the steps at any point, and one that no shape is worth while for, goes through
`binary` alone, so that rows and errors are the same either way.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from lumenframe import binary
from lumenframe.binary import DecodeError, Element, Encoder, element_rows
from lumenframe.model import EXPLICIT_LE, ITEM, ITEM_END, LONG_VRS, SEQUENCE_END, TAG, TRANSFER_SYNTAXES, UNDEFINED

#: Files, and bytes of their values, that are worked on at once; what a worker holds does not grow beyond them.
FILES, BYTES = 2000, 16 << 20
#: Shapes that a task remembers; after so many in a row that only their first file has, the rest of a batch is read one by one.
SHAPES, ALONE = 64, 8


def cuts(sizes: np.ndarray, rows: int = FILES, limit: int = BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of at most so many rows, and of at most so many bytes unless one row has more."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + limit, "right"))))
        yield at, to
        at = to


def raw_offsets(column: pa.Array) -> np.ndarray:
    """Where each value of a binary, text or list column begins, and where the last one ends, in its buffer or child."""
    kind = np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_list(column.type) else np.int32
    if not len(column):
        return np.zeros(1, np.int64)
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def plain(column: pa.Array) -> pa.Array:
    """A column of bytes with 32-bit offsets."""
    return column if pa.types.is_binary(column.type) else column.cast(pa.binary())


def fixed(numbers: np.ndarray, kind: str) -> pa.Array:
    """Numbers as bytes, one value each."""
    own = np.ascontiguousarray(numbers, kind)
    return pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(np.arange(len(own) + 1, dtype=np.int32) * own.itemsize), pa.py_buffer(own)])


def ordered(parts: list[pa.Array], places: list[np.ndarray]) -> pa.Array:
    """The parts' values, each at its place."""
    if len(parts) == 1:
        return parts[0]
    back = np.empty(sum(map(len, places)), np.int64)
    back[np.concatenate(places)] = np.arange(len(back))
    return pa.concat_arrays(parts).take(pa.array(back))


# Encoding.


@dataclass
class Length:
    """A length field: a constant and the padded lengths of some values."""

    width: int
    constant: int
    values: list[int]


@dataclass
class Value:
    at: int
    pad: bytes


class Pieces(list):
    """What a file is put together from: bytes, Value and Length."""

    def add(self, *more) -> Pieces:
        for x in more:
            if isinstance(x, bytes) and self and isinstance(self[-1], bytes):
                self[-1] += x
            elif x != b"":
                self.append(x)
        return self

    def length(self, width: int) -> Length:
        own = Length(width, 0, [])
        for x in self:
            if isinstance(x, Value):
                own.values.append(x.at)
            else:
                own.constant += x.width if isinstance(x, Length) else len(x)
        return own


class Outline(Encoder):
    """The encoder's layout with places in place of values."""

    def outline(self, elements: dict[int, Element]) -> Pieces:
        out = Pieces()
        for tag in sorted(elements):
            out.add(*self.parts(elements[tag]))
        return out

    def parts(self, e: Element) -> Pieces:
        if "at" not in e.row:
            return Pieces().add(self.element(e))
        value, tail = Pieces(), b""
        if e.vr == "SQ":
            for i in e.items or []:
                body = self.outline(i)
                if self.undefined:
                    value.add(self.head(ITEM), struct.pack("<I", UNDEFINED), *body, self.item(ITEM_END))
                else:
                    value.add(self.head(ITEM), body.length(4), *body)
        else:
            value.append(Value(e.row["at"], b"\0" if e.vr == "UI" or e.vr in LONG_VRS else b" "))
        length: bytes | Length = value.length(2 if self.explicit and e.vr not in LONG_VRS else 4)
        if e.vr == "SQ" and self.undefined:
            length, tail = struct.pack("<I", UNDEFINED), self.item(SEQUENCE_END)
        name = e.vr.encode() + b"\0\0" * (e.vr in LONG_VRS) if self.explicit else b""
        return Pieces().add(self.head(e.tag), name, length, *value, tail)


def outline(rows: list[dict], syntax: str, dataset_only: bool, undefined: bool) -> tuple[Pieces, Pieces]:
    """Head and body of files with these elements, as binary.encode_part10 and encode_dataset write them."""
    meta, own = binary.tree([r for r in rows if r["is_meta"]]), binary.tree([r for r in rows if not r["is_meta"]])
    encoder = Outline(syntax, undefined)
    body = {t: e for t, e in own.items() if t >> 16 != 2}
    if encoder.encapsulated and binary.PIXEL_DATA in body:
        raise DecodeError("invalidEncapsulatedPixelData")
    out = encoder.outline(body)
    if dataset_only:
        return Pieces(), out
    first = {t: e for t, e in meta.items() if t >> 16 == 2 and t != 0x00020000}
    first[0x00020001] = Element(0x00020001, "OB", b"\0\1")
    first[binary.TRANSFER_SYNTAX_UID] = Element(binary.TRANSFER_SYNTAX_UID, "UI", syntax.encode())
    encoder = Outline(EXPLICIT_LE)
    head = encoder.outline(first)
    return Pieces().add(b"\0" * 128 + b"DICM" + encoder.head(0x00020000) + b"UL" + struct.pack("<H", 4), head.length(4), *head), out


def assembled(pieces: Pieces, base: np.ndarray, values: pa.Array, padded: np.ndarray, odd: np.ndarray) -> pa.Array:
    """One value of bytes for each base, the place of a file's first element."""
    m = len(base)
    constants, lengths, columns = [b"", b"\0", b" "], [], []
    known = sum(isinstance(x, bytes) for x in pieces) + 3
    for x in pieces:
        if isinstance(x, Value):
            columns += [base + (known + x.at), np.where(odd[base + x.at], 1 if x.pad == b"\0" else 2, 0)]
        elif isinstance(x, Length):
            total = np.full(m, x.constant, np.int64)
            for k in x.values:
                total += padded[base + k]
            columns.append(np.arange(m) + (known + len(values) + len(lengths) * m))
            lengths.append(fixed(total, f"<u{x.width}"))
        else:
            columns.append(np.full(m, len(constants)))
            constants.append(x)
    if not columns:
        return pa.array([b""] * m, pa.binary())
    pool = pa.concat_arrays([pa.array(constants, pa.binary()), values, *lengths])
    taken = pool.take(pa.array(np.stack(columns, axis=1).reshape(-1)))
    _, offsets, data = taken.buffers()
    own = np.frombuffer(offsets, np.int32)[taken.offset : taken.offset + len(taken) + 1]
    return pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(np.ascontiguousarray(own[:: len(columns)])), data])


class Writer:
    """Encodes columns of element arrays; remembers the shapes that it has met."""

    def __init__(self, syntax: str, dataset_only: bool, undefined: bool, one: Callable[[str, list[dict]], dict], schema: pa.Schema):
        self.syntax, self.dataset_only, self.undefined, self.one, self.schema = syntax, dataset_only, undefined, one, schema
        self.vrs: dict[str, int] = {}
        self.outlines: dict[bytes, tuple[Pieces, Pieces] | str] = {}
        _, _, big, self.deflated, _ = TRANSFER_SYNTAXES.get(syntax, (None, None, True, False, None))
        self.by_shape = not big  # an unknown syntax is an error of each file

    def batches(self, ids: pa.Array, elements: pa.Array) -> Iterator[pa.RecordBatch]:
        sizes = np.zeros(len(elements), np.int64)
        if len(elements):
            at = raw_offsets(elements)
            values = elements.values.field("value") if pa.types.is_struct(elements.values.type) else elements.values
            ends = raw_offsets(values)
            sizes = ends[at[1:]] - ends[at[:-1]]
        for a, b in cuts(sizes):
            yield self.batch(ids.slice(a, b - a), elements.slice(a, b - a))

    def batch(self, ids: pa.Array, elements: pa.Array) -> pa.RecordBatch:
        parts: list[tuple[np.ndarray, pa.Array, str | None]] = []
        left = np.arange(len(elements))
        if self.by_shape and not elements.null_count and len(elements):
            parts, left = self.shaped(elements)
        if len(left):
            names = ids.take(pa.array(left)).to_pylist()
            rows = [self.one(a, own) for a, own in zip(names, element_rows(elements.take(pa.array(left))), strict=True)]
            kinds = [r["error_kind"] for r in rows]
        places = [p for p, _, _ in parts] + [left] * bool(len(left))
        contents = [c for _, c, _ in parts] + ([pa.array([r["content"] for r in rows], pa.binary())] if len(left) else [])
        errors = [pa.array([e] * len(p), pa.string()) for p, _, e in parts] + ([pa.array(kinds, pa.string())] if len(left) else [])
        if not places:
            return pa.RecordBatch.from_pylist([], schema=self.schema)
        error = ordered(errors, places)
        status = pa.array(np.where(error.is_null().to_numpy(zero_copy_only=False), "ok", "error").tolist(), pa.string())
        return pa.RecordBatch.from_arrays([ids.cast(pa.string()), ordered(contents, places), status, error], schema=self.schema)

    def shaped(self, elements: pa.Array) -> tuple[list[tuple[np.ndarray, pa.Array, str | None]], np.ndarray]:
        """(places, contents, error) of the files that go by shape, and the places of those that don't."""
        none = [], np.arange(len(elements))
        flat = elements.flatten()
        own = {f.name: c for f, c in zip(flat.type, flat.flatten(), strict=True)}
        if any(own[c].null_count for c in ("is_meta", "path", "depth", "ordinal", "tag", "vr")):
            return none
        start = raw_offsets(elements)
        start = start - start[0]
        number = lambda c: own[c].cast(pa.int64()).to_numpy(zero_copy_only=False)
        coded = own["vr"].dictionary_encode()
        ids = np.array([self.vrs.setdefault(v, len(self.vrs)) for v in coded.dictionary.to_pylist()] or [0], np.int64)
        n = len(flat)
        items = own.get("item_count")
        no_items = np.ones(n, bool) if items is None else items.is_null().to_numpy(zero_copy_only=False)
        counts = np.zeros(n, np.int64) if items is None else items.fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
        steps = raw_offsets(own["path"])
        inner = own["path"].flatten()
        if inner.null_count or any(c.null_count for c in inner.flatten()):
            return none
        path = np.stack([c.cast(pa.int64()).to_numpy(zero_copy_only=False) for c in inner.flatten()], axis=1) if len(inner) else np.zeros((0, 2), np.int64)
        names = [f.name for f in inner.type]
        steps = steps - steps[0]
        shape = np.stack([number("tag"), number("ordinal") << 32 | number("depth") & 0xFFFFFFFF, counts << 32 | ids[coded.indices.to_numpy(zero_copy_only=False)] << 2 | number("is_meta") << 1 | no_items, np.diff(steps)], axis=1)
        odd_ones = np.zeros(n, bool)
        if "fragments" in own and own["fragments"].null_count < n:
            odd_ones = own["fragments"].is_valid().to_numpy(zero_copy_only=False)
        alone = {int(k) for k in np.searchsorted(start, np.flatnonzero(odd_ones), "right") - 1}
        groups: dict[bytes, list[int]] = {}
        for k in range(len(elements)):
            if k not in alone:
                a, b = start[k], start[k + 1]
                groups.setdefault(shape[a:b].tobytes() + path[steps[a] : steps[b]].tobytes(), []).append(k)
        values = plain(own["value"].fill_null(b""))
        size = np.diff(raw_offsets(values))
        odd = size % 2 == 1
        padded = size + odd
        parts, left = [], sorted(alone)
        for key, files in groups.items():
            where = np.array(files)
            if key not in self.outlines:
                if len(self.outlines) >= SHAPES * 8:
                    self.outlines.clear()
                a, b = start[files[0]], start[files[0] + 1]
                if len(files) == 1:  # not worth while
                    left += files
                    continue
                rows = [{"is_meta": bool(r[2] >> 1 & 1), "path": [dict(zip(names, p, strict=True)) for p in path[steps[a + k] : steps[a + k + 1]].tolist()], "depth": int(r[1] & 0xFFFFFFFF), "ordinal": int(r[1] >> 32), "tag": int(r[0]), "vr": v, "value": b"", "item_count": None if r[2] & 1 else int(r[2] >> 32), "at": k} for k, (r, v) in enumerate(zip(shape[a:b], own["vr"].slice(a, b - a).to_pylist(), strict=True))]
                try:
                    self.outlines[key] = outline(rows, self.syntax, self.dataset_only, self.undefined)
                except DecodeError as e:
                    self.outlines[key] = e.kind
            found = self.outlines[key]
            if isinstance(found, str):
                parts.append((where, pa.nulls(len(where), pa.binary()), found))
                continue
            base = start[where]
            long = np.zeros(len(where), bool)  # for its length field
            for x in (x for p in found for x in p if isinstance(x, Length) and x.width == 2):
                long |= sum((padded[base + k] for k in x.values), np.int64(x.constant)) > 0xFFFF
            left += where[long].tolist()
            where, base = where[~long], base[~long]
            if not len(where):
                continue
            head, body = found
            if self.deflated:
                packed = [binary.deflate(x) for x in assembled(body, base, values, padded, odd).to_pylist()]
                first = assembled(head, base, values, padded, odd).to_pylist()
                content = pa.array([a + b for a, b in zip(first, packed, strict=True)], pa.binary())
            else:
                content = assembled(Pieces().add(*head, *body), base, values, padded, odd)
            parts.append((where, content, None))
        return parts, np.array(sorted(left), np.int64)


# Decoding.


@dataclass
class Shape:
    """The steps that read a file, its element rows, and what they have that is the same for all files of the shape."""

    syntax: str
    explicit: bool
    steps: list[tuple]
    rows: list[dict]
    whole: bool  # a Part 10 file
    index: dict[int, int] = field(default_factory=dict)
    columns: pa.Array | None = None


def header(row: dict, explicit: bool) -> tuple[int, int, int]:
    """(expected, mask, size) of an element's first eight bytes, as a number, and of its whole header."""
    tag = row["tag"] >> 16 | (row["tag"] & 0xFFFF) << 16
    if not explicit:
        return tag, 0xFFFFFFFF, 8
    return tag | int.from_bytes(row["vr"].encode(), "little") << 32, 0xFFFFFFFFFFFF, 12 if row["vr"] in LONG_VRS else 8


def marker(tag: int) -> int:
    return tag >> 16 | (tag & 0xFFFF) << 16


class Reader:
    """Decodes columns of contents; remembers the shapes that it has met."""

    def __init__(self, one: Callable, syntax: str | None, options: dict, schema: pa.Schema, by_rows: Callable):
        self.one, self.syntax, self.options, self.schema, self.by_rows = one, syntax, options, schema, by_rows
        self.shapes: list[Shape] = []
        self.kind = schema.field("elements").type.value_type

    def batches(self, ids: pa.Array, contents: pa.Array) -> Iterator[pa.RecordBatch]:
        contents = plain(contents)
        for a, b in cuts(np.diff(raw_offsets(contents)) if len(contents) else np.zeros(0, np.int64)):
            yield self.batch(ids.slice(a, b - a), contents.slice(a, b - a))

    def column_batches(self, ids: pa.Array, contents: pa.Array, tags: list[int], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        contents = plain(contents)
        for a, b in cuts(np.diff(raw_offsets(contents)) if len(contents) else np.zeros(0, np.int64)):
            yield self.column_batch(ids.slice(a, b - a), contents.slice(a, b - a), tags, schema)

    def column_batch(self, ids: pa.Array, contents: pa.Array, tags: list[int], schema: pa.Schema) -> pa.RecordBatch:
        """(id, the last top-level value of each tag) of the files that can be read."""
        at = raw_offsets(contents)
        found, alone = self.sorted_out(contents, at)
        last = lambda rows, tag: max((k for k, r in enumerate(rows) if r["tag"] == tag and r["depth"] == 0), default=None)
        places, parts = [], []
        if found:
            every = np.concatenate([hit for _, hit, _ in found])
            order = np.argsort(every, kind="stable")
            places.append(every[order])
            n, own = len(every), []
            for tag in tags:
                start, held, there = at[every], np.zeros(n, np.int64), np.zeros(n, bool)
                a = 0
                for shape, hit, where in found:
                    if (k := last(shape.rows, tag)) is not None:
                        start[a : a + len(hit)], held[a : a + len(hit)], there[a : a + len(hit)] = where["start"][k], where["held"][k], True
                    a += len(hit)
                own.append(self.pieces(start[order], held[order], contents, ~there[order]))
            parts.append(own)
        if alone:
            read = [(k, rows) for k, (head, rows) in zip(alone, map(self.one, contents.take(pa.array(alone, pa.int64())).to_pylist()), strict=True) if head["status"] == "ok"]
            places.append(np.array([k for k, _ in read], np.int64))
            parts.append([pa.array([None if (k := last(rows, tag)) is None else rows[k]["value"] for _, rows in read], pa.binary()) for tag in tags])
        if not places:
            return pa.RecordBatch.from_pylist([], schema=schema)
        files = np.sort(np.concatenate(places))
        ranks = [np.searchsorted(files, p) for p in places]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(files)), *(ordered([p[k] for p in parts], ranks) for k in range(len(tags)))], schema=schema)

    @staticmethod
    def pieces(start: np.ndarray, held: np.ndarray, contents: pa.Array, missing: np.ndarray | None = None) -> pa.Array:
        """The bytes at places of the contents that come one after the other: every other one of them and what lies between."""
        n = len(start)
        bounds = np.zeros(2 * n + 1, np.int32)
        bounds[0 : 2 * n : 2], bounds[1 : 2 * n : 2] = start, start + held
        bounds[-1] = bounds[-2] if n else 0
        both = pa.Array.from_buffers(pa.binary(), 2 * n, [None, pa.py_buffer(bounds), contents.buffers()[2]])
        return both.take(pa.array(np.arange(0, 2 * n, 2), mask=missing))

    def batch(self, ids: pa.Array, contents: pa.Array) -> pa.RecordBatch:
        at = raw_offsets(contents)
        found, alone = self.sorted_out(contents, at)
        parts, places = [], []
        if found:
            parts.append(self.built(found, at, contents))
            places.append(np.sort(np.concatenate([hit for _, hit, _ in found])))
        if alone:
            rows = [self.one(c) for c in contents.take(pa.array(alone, pa.int64())).to_pylist()]
            parts.append(self.by_rows([None] * len(alone), [r[0] for r in rows], [r[1] for r in rows], self.schema).columns[1:])
            places.append(np.array(alone))
        if not parts:
            return pa.RecordBatch.from_pylist([], schema=self.schema)
        return pa.RecordBatch.from_arrays([ids, *(ordered([p[k] for p in parts], places) for k in range(len(self.schema) - 1))], schema=self.schema)

    def sorted_out(self, contents: pa.Array, at: np.ndarray) -> tuple[list[tuple[Shape, np.ndarray, dict]], list[int]]:
        """Shapes with the files that have them and where their values lie, and the files that are read one by one."""
        n = len(contents)
        left = np.flatnonzero(contents.is_valid().to_numpy(zero_copy_only=False))
        alone = [k for k in range(n) if k not in set(left.tolist())] if len(left) < n else []
        data = np.frombuffer(contents.buffers()[2] or b"", np.uint8)
        found: list[tuple[Shape, np.ndarray, dict]] = []
        for shape in list(self.shapes):
            if not len(left):
                break
            hit, places = self.matched(shape, data, at, left)
            if len(hit):
                found.append((shape, hit, places))
                left = np.setdiff1d(left, hit, assume_unique=True)
                self.shapes.remove(shape)
                self.shapes.insert(0, shape)
        single = 0
        while len(left) and single < ALONE:
            shape = self.traced(contents[int(left[0])].as_py())
            hit = left[:0]
            if shape is not None:
                hit, places = self.matched(shape, data, at, left)
            if len(hit) < 2:
                single += 1
                alone.append(int(left[0]))
                left = left[1:]
                continue
            single = 0
            found.append((shape, hit, places))
            left = np.setdiff1d(left, hit, assume_unique=True)
            self.shapes = [shape, *self.shapes[: SHAPES - 1]]
        return found, sorted([*alone, *left.tolist()])

    def traced(self, content: bytes) -> Shape | None:
        """The shape of a file that can be read, has no encapsulated pixel data and no swapped or packed bytes."""
        steps: list[tuple] = []
        try:
            if self.syntax is None:
                syntax, rows = binary.decode_part10(content, steps=steps, **self.options)
                for r in rows:
                    r["is_meta"] = r["is_meta"] or False
            else:
                syntax, rows = self.syntax, binary.decode_dataset(content, self.syntax, steps=steps, **self.options)
        except DecodeError:
            return None
        _, explicit, big, deflated, _ = TRANSFER_SYNTAXES[syntax]
        if big or deflated or any(s[0] == "pixels" or s[0] == "break" and s[1] > 1 for s in steps):
            return None
        shape = Shape(syntax, explicit, steps, rows, self.syntax is None, {id(r): k for k, r in enumerate(rows)})
        skip = {"value", "value_offset", "value_length", "item_offsets"}
        shape.columns = pa.array([{f.name: r.get(f.name) for f in self.kind if f.name not in skip} for r in rows], pa.struct([f for f in self.kind if f.name not in skip]))
        return shape

    def matched(self, shape: Shape, data: np.ndarray, offsets: np.ndarray, files: np.ndarray) -> tuple[np.ndarray, dict]:
        """Those of the files that have the shape, and where their values and items are: (row, file) arrays.

        A step is done for all files that are left; those that it would not read the same way drop out.
        """
        if len(data) < 16:
            return files[:0], {}
        eight = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
        four = np.ndarray((len(data) - 3,), "<u4", buffer=data, strides=(1,))
        begin, end = offsets[files], offsets[files + 1]
        n = len(shape.rows)
        starts, lengths, ends_, items = np.zeros((n, len(files)), np.int64), np.zeros((n, len(files)), np.int64), np.zeros((n, len(files)), np.int64), {k: [] for k in range(n)}
        keep = np.ones(len(files), bool)
        at = begin.copy()
        explicit = True if shape.whole else shape.explicit
        if shape.whole:
            keep &= end - begin >= 132
            keep[keep] = four[begin[keep] + 128] == int.from_bytes(b"DICM", "little")
            at += 132
        stack: list[np.ndarray | None] = [end]

        def read(view: np.ndarray, where: np.ndarray, width: int) -> np.ndarray:
            """Numbers at places; where they go beyond the file the file drops out."""
            nonlocal keep
            keep &= where + width <= end
            return view[np.where(keep, np.minimum(where, len(view) - 1), 0)]

        for step in shape.steps:
            name = step[0]
            if name == "body":
                explicit, stack = shape.explicit, [end]
                continue
            if name == "end":
                keep &= at == stack.pop()
                continue
            if stack[-1] is not None:
                keep &= at < stack[-1]
            if name == "break":
                keep &= read(four, at, 4) & 0xFFFF != 2
            elif name in ("item_end", "sequence_end"):
                keep &= read(eight, at, 8) == marker(ITEM_END if name == "item_end" else SEQUENCE_END)
                at = at + 8
                stack.pop()
            elif name == "item":
                h = read(eight, at, 8)
                keep &= (h & 0xFFFFFFFF) == marker(ITEM)
                size = (h >> 32).astype(np.int64)
                items[shape.index[id(step[2])]].append(at - begin)
                at = at + 8
                if step[1]:
                    keep &= size == UNDEFINED
                    stack.append(None)
                else:
                    keep &= (size != UNDEFINED) & (at + size <= end)
                    stack.append(at + size)
            else:
                row = step[1]
                k = shape.index[id(row)]
                expected, mask, width = header(row, explicit)
                h = read(eight, at, 8)
                keep &= (h & np.uint64(mask)) == np.uint64(expected)
                size = (read(four, at + 8, 4) if width == 12 else h >> 48 if explicit else h >> 32).astype(np.int64)
                at = at + width
                starts[k] = at
                if name == "open":
                    keep &= size == UNDEFINED
                    stack.append(None)
                elif name == "sequence":
                    keep &= (size != UNDEFINED) & (at + size <= end)
                    stack.append(at + size)
                else:
                    if width == 12 or not explicit:
                        keep &= size != UNDEFINED
                    keep &= at + size <= end
                    lengths[k] = size
                    ends_[k] = size if name == "value" else 0
                    if row["tag"] == binary.TRANSFER_SYNTAX_UID and row["is_meta"] and row["depth"] == 0:
                        known = np.frombuffer(row["value"], np.uint8)
                        keep &= size == len(known)
                        rest = np.flatnonzero(keep)
                        keep[rest] = (data[at[rest][:, None] + np.arange(len(known))] == known).all(axis=1)
                    at = at + size
            if not keep.any():
                return files[:0], {}
            if keep.sum() * 2 < len(keep):  # go on with the files that are left
                files, begin, end, at = files[keep], begin[keep], end[keep], at[keep]
                starts, lengths, ends_ = starts[:, keep], lengths[:, keep], ends_[:, keep]
                items = {k: [x[keep] for x in v] for k, v in items.items()}
                stack = [s if s is None else s[keep] for s in stack]
                keep = keep[keep]
        out = {"start": starts[:, keep], "length": lengths[:, keep], "held": ends_[:, keep], "items": {k: [x[keep] for x in v] for k, v in items.items()}}
        return files[keep], out

    def built(self, found: list[tuple[Shape, np.ndarray, dict]], offsets: np.ndarray, contents: pa.Array) -> list[pa.Array]:
        """The columns of the schema but the first, of all files that have a shape, in their order."""
        every = np.concatenate([hit for _, hit, _ in found])
        order = np.argsort(every, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        counts = np.concatenate([np.full(len(hit), len(s.rows)) for s, hit, _ in found])
        first = np.zeros(len(every) + 1, np.int64)
        np.cumsum(counts[order], out=first[1:])
        total = int(first[-1])
        code, start, length, held, begin = (np.zeros(total, np.int64) for _ in range(5))
        listed = np.full(total, -1, np.int64)
        known, at, nested = 0, 0, []
        for shape, hit, own in found:
            n = len(shape.rows)
            where = first[place[at : at + len(hit)]][None, :] + np.arange(n)[:, None]
            code[where] = known + np.arange(n)[:, None]
            start[where], length[where], held[where] = own["start"], own["length"], own["held"]
            begin[where] = offsets[hit][None, :]
            for k, r in enumerate(shape.rows):
                if r.get("item_offsets") is not None:
                    listed[where[k]] = len(own["items"][k])
                    nested += [(where[k], j, x) for j, x in enumerate(own["items"][k])]
            known, at = known + n, at + len(hit)
        pool = found[0][0].columns if len(found) == 1 else pa.concat_arrays([s.columns for s, _, _ in found])
        fixed_ = pool.take(pa.array(code))
        columns = {f.name: c for f, c in zip(fixed_.type, fixed_.flatten(), strict=True)}
        columns["value"] = self.pieces(start, held, contents)
        columns["value_offset"], columns["value_length"] = pa.array(start - begin), pa.array(length)
        ends = np.zeros(total + 1, np.int64)
        np.cumsum(np.maximum(listed, 0), out=ends[1:])
        inner = np.zeros(int(ends[-1]), np.int64)
        for where, j, x in nested:
            inner[ends[where] + j] = x
        kind = self.kind.field("item_offsets").type
        columns["item_offsets"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(inner, pa.int64()), type=kind, mask=pa.array(listed < 0)) if total else pa.array([], kind)
        rows = pa.StructArray.from_arrays([columns[f.name].cast(f.type) for f in self.kind], fields=list(self.kind))
        elements = pa.ListArray.from_arrays(pa.array(first, pa.int32()), rows, type=self.schema.field("elements").type)
        files = every[order]
        syntax = ordered([pa.array([s.syntax] * len(hit), pa.string()) for s, hit, _ in found], [place[a : a + len(h)] for a, (_, h, _) in zip(np.cumsum([0, *(len(h) for _, h, _ in found)]), found)])
        heads = {"length": pa.array(offsets[files + 1] - offsets[files]), "transfer_syntax_uid": syntax, "status": pa.array(["ok"] * len(files), pa.string()), "elements": elements}
        return [heads[f.name] if f.name in heads else pa.nulls(len(files), f.type) for f in list(self.schema)[1:]]
