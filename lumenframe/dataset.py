"""Typed access to the nested elements of one file, for code that runs inside Arrow batches."""

from __future__ import annotations

import re
import struct

import numpy as np

from lumenframe.binary import Element
from lumenframe.model import CHARACTER_SETS, TAG

INTEGER = re.compile(r"[+-]?[0-9]+")


class DataSet:
    """Elements of one data set by keyword or tag; every reader returns None where there is no such value."""

    def __init__(self, elements: dict[int, Element]):
        self.elements = elements

    def get(self, name: str | int) -> Element | None:
        return self.elements.get(TAG[name] if isinstance(name, str) else name)

    def raw(self, name) -> bytes | None:
        e = self.get(name)
        return None if e is None else e.value

    def text(self, name) -> str | None:
        e = self.get(name)
        if e is None or e.items is not None:
            return None
        try:
            return e.value.rstrip(b"\0 ").decode("utf-8")
        except UnicodeDecodeError:
            return None

    def charset_text(self, name) -> str | None:
        """Text in the data set's own character set; nested data sets do not take their parent's."""
        names = [n for n in (self.text("SpecificCharacterSet") or "").split("\\") if n]
        codec = CHARACTER_SETS.get(names[0] if names else "")
        e = self.get(name)
        if e is None or e.items is not None or codec is None:
            return None
        try:
            return e.value.rstrip(b"\0 ").decode(codec)
        except UnicodeDecodeError:
            return None

    def texts(self, name) -> list[str] | None:
        t = self.text(name)
        return None if t is None else t.split("\\")

    def numbers(self, name) -> list[float] | None:
        try:
            return [float(x) for x in self.texts(name) or [""]]
        except ValueError:
            return None

    def number(self, name) -> float | None:
        values = self.numbers(name)
        return values[0] if values else None

    def integer(self, name) -> int | None:
        t = self.text(name)
        return int(t) if t is not None and INTEGER.fullmatch(t) else None

    def integers(self, name) -> list[int] | None:
        parts = self.texts(name)
        return [int(p) for p in parts] if parts is not None and all(INTEGER.fullmatch(p) for p in parts) else None

    def us(self, name) -> int | None:
        v = self.raw(name)
        return struct.unpack_from("<H", v)[0] if v is not None and len(v) >= 2 else None

    def ss(self, name) -> int | None:
        v = self.raw(name)
        return struct.unpack_from("<h", v)[0] if v is not None and len(v) >= 2 else None

    def array(self, name, dtype: str) -> np.ndarray | None:
        v = self.raw(name)
        return None if v is None or len(v) % np.dtype(dtype).itemsize else np.frombuffer(v, dtype)

    def items(self, name) -> list[DataSet]:
        e = self.get(name)
        return [DataSet(i) for i in e.items or []] if e is not None else []

    def first_item(self, name) -> DataSet | None:
        return next(iter(self.items(name)), None)

    def private(self, creator: str, group: int, element: int) -> Element | None:
        """The element of a private block by its creator; the lowest block of that creator counts."""
        for block in range(0x10, 0x100):
            if self.charset_text(group << 16 | block) == creator:
                return self.elements.get(group << 16 | block << 8 | element & 0xFF)
        return None

    def private_creator(self, tag: int) -> str | None:
        group, element = tag >> 16, tag & 0xFFFF
        return self.charset_text(group << 16 | element >> 8) if group % 2 and element >= 0x1000 else None
