"""Typed values of element bytes as column expressions.

Everything but IEEE floats and Japanese text stays in built-in functions. Bytes are little-endian; big-endian files
are swapped when they are read. A value that cannot be read is NULL.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.model import CHARACTER_SETS

def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(value: Column | str) -> Column:
    """UTF-8 text without trailing spaces and zeros; leading ones stay."""
    return F.rtrim(F.try_validate_utf8(_col(value).cast("string")), F.lit("\0 "))


def texts(value: Column | str) -> Column:
    return F.split(text(value), "\\\\", -1)


@F.pandas_udf(T.StringType())
def _decoded(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for values, names in batches:
        out = []
        for v, n in zip(values, names, strict=True):
            codec = CHARACTER_SETS.get(n or "")
            try:
                out.append(None if v is None or codec is None else bytes(v).rstrip(b"\0 ").decode(codec))
            except UnicodeDecodeError:
                out.append(None)
        yield pd.Series(out, dtype=object)


def charset_text(value: Column | str, character_set: Column | str) -> Column:
    """Text in the character set that (0008,0005) names: its first non-empty component, UTF-8 if there is none."""
    first = F.get(F.filter(F.split(F.coalesce(_col(character_set), F.lit("")), "\\\\"), lambda x: x != ""), F.lit(0))
    return _decoded(_col(value), F.coalesce(first, F.lit("")))


_NUMBER = r"^[ ]*[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?[ ]*$"


def decimals(value: Column | str) -> Column:
    """Decimal strings as doubles; one bad component makes the whole array NULL."""
    parts = texts(value)
    good = F.forall(parts, lambda p: p.rlike(_NUMBER))
    return F.when(good, F.transform(parts, lambda p: F.trim(p).cast("double")))


def decimal(value: Column | str) -> Column:
    """The first component of a decimal string."""
    return F.get(decimals(value), F.lit(0))


def strict_int(string: Column) -> Column:
    """An integer string without surrounding spaces."""
    return F.when(string.rlike("^[+-]?[0-9]{1,18}$"), string.cast("long"))


def integer(value: Column | str) -> Column:
    return strict_int(text(value))


def integers(value: Column | str) -> Column:
    """Integer strings; one bad component makes the whole array NULL."""
    parts = texts(value)
    return F.when(F.forall(parts, lambda p: p.rlike("^[+-]?[0-9]{1,18}$")), F.transform(parts, lambda p: p.cast("long")))


def _unsigned(value: Column, at: Column, width: int) -> Column:
    """The little-endian number of `width` bytes at a byte offset, as text of digits."""
    pieces = [F.hex(F.substring(value, at + width - i, F.lit(1))) for i in range(width)]
    return F.conv(F.concat(*pieces), 16, 10)


def _many(value: Column, width: int, kind: str) -> Column:
    n = F.length(value)
    at = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(width)), lambda i: i < n)
    return F.when(n % width == 0, F.transform(at, lambda i: _unsigned(value, i, width).cast(kind)))


def _signed(bits: int):
    return lambda x: F.when(x >= 1 << (bits - 1), x - (1 << bits)).otherwise(x)


def us(value: Column | str) -> Column:
    """The first unsigned 16-bit number; needs two bytes."""
    v = _col(value)
    return F.when(F.length(v) >= 2, _unsigned(v, F.lit(0), 2).cast("int"))


def ss(value: Column | str) -> Column:
    return _signed(16)(us(value))


def us_list(value: Column | str) -> Column:
    return _many(_col(value), 2, "int")


def ss_list(value: Column | str) -> Column:
    return F.transform(us_list(value), _signed(16))


def ul_list(value: Column | str) -> Column:
    return _many(_col(value), 4, "long")


def sl_list(value: Column | str) -> Column:
    return F.transform(ul_list(value), _signed(32))


def uv_list(value: Column | str) -> Column:
    return _many(_col(value), 8, "decimal(20,0)")


def sv_list(value: Column | str) -> Column:
    top = F.lit("9223372036854775808").cast("decimal(20,0)")
    whole = F.lit("18446744073709551616").cast("decimal(21,0)")
    return F.transform(uv_list(value), lambda x: F.when(x >= top, x - whole).otherwise(x).cast("long"))


def at_list(value: Column | str) -> Column:
    """Attribute tags as numbers."""
    return F.transform(ul_list(value), lambda x: F.pmod(x, F.lit(65536)) * 65536 + F.shiftright(x, 16))


def _floats(dtype: str):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def read(values: pd.Series) -> pd.Series:
        width = np.dtype(dtype).itemsize
        return pd.Series([None if v is None or len(v) % width else np.frombuffer(bytes(v), dtype).astype(float).tolist() for v in values])

    return read


fl_list, fd_list = _floats("<f4"), _floats("<f8")


def person_name(value: Column | str) -> Column:
    """Alphabetic, ideographic and phonetic group of a name; components stay joined by carets."""
    groups = F.split(text(value), "=", 3)
    return F.struct(*[F.get(groups, F.lit(i)).alias(n) for i, n in enumerate(("alphabetic", "ideographic", "phonetic"))])


def _part(string: Column, start: int, n: int) -> Column:
    return F.substring(string, start, n).cast("int")


def date(string: Column) -> Column:
    """Year, month, day of an eight-digit date; the calendar is not checked."""
    return F.when(string.rlike("^[0-9]{8}$"), F.struct(_part(string, 1, 4).alias("year"), _part(string, 5, 2).alias("month"), _part(string, 7, 2).alias("day")))


def time(string: Column) -> Column:
    """Hour, minute, second, nanosecond; parts that the text leaves out are NULL."""
    digits, fraction = F.regexp_extract(string, "^([0-9]*)", 1), F.regexp_extract(string, "[.]([0-9]*)$", 1)
    n = F.length(digits)
    return F.when(
        string.rlike("^[0-9]{2,6}([.][0-9]*)?$"),
        F.struct(
            _part(digits, 1, 2).alias("hour"),
            F.when(n >= 4, _part(digits, 3, 2)).alias("minute"),
            F.when(n >= 6, F.substring(digits, 5, 2).cast("int")).alias("second"),
            F.when(string.contains("."), F.rpad(F.substring(fraction, 1, 9), 9, "0").cast("int")).alias("nanosecond"),
        ),
    )


def date_time(string: Column) -> Column:
    """Date, optional time and optional offset in seconds."""
    local, zone = F.regexp_extract(string, "^([^+-]*)", 1), F.regexp_extract(string, "([+-].*)$", 1)
    d, t = date(F.substring(local, 1, 8)), time(F.substring(local, 9, 100))
    good = d.isNotNull() & ((F.length(local) == 8) | t.isNotNull()) & ((zone == "") | zone.rlike("^[+-][0-9]{4}$"))
    offset = F.when(zone != "", F.when(F.substring(zone, 1, 1) == "+", 1).otherwise(-1) * (_part(zone, 2, 2) * 3600 + _part(zone, 4, 2) * 60))
    return F.when(good, F.struct(d["year"].alias("year"), d["month"].alias("month"), d["day"].alias("day"), t["hour"].alias("hour"), t["minute"].alias("minute"), t["second"].alias("second"), t["nanosecond"].alias("nanosecond"), offset.alias("offset_seconds")))


# Encoding of values, the inverse of the above.


def us_bytes(number: Column) -> Column:
    h = F.lpad(F.hex(F.pmod(number.cast("long"), F.lit(65536))), 4, "0")
    return F.unhex(F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2)))


def ul_bytes(number: Column) -> Column:
    h = F.lpad(F.hex(F.pmod(number.cast("long"), F.lit(1 << 32))), 8, "0")
    return F.unhex(F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)]))


def text_bytes(string: Column) -> Column:
    return F.encode(string, "UTF-8")


def fnv1a64(string: Column) -> Column:
    """The 64-bit FNV-1a hash of the UTF-8 bytes, as decimal text. Exact in decimals of 38 digits."""
    codes = F.transform(F.sequence(F.lit(1), F.length(F.encode(string, "UTF-8"))), lambda i: F.conv(F.hex(F.substring(F.encode(string, "UTF-8"), i, F.lit(1))), 16, 10).cast("int"))
    # The hash is kept as two 32-bit halves, so each step is exact in 64-bit numbers: h * (2^40 + 435) mod 2^64.
    seed = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))

    def step(acc: Column, byte: Column) -> Column:
        low = acc["lo"].bitwiseXOR(byte.cast("long"))
        product = low * 435
        carry = F.shiftright(product, 32)
        high = F.pmod(acc["hi"] * 435 + carry + F.shiftleft(F.pmod(low, F.lit(1 << 24)), 8), F.lit(1 << 32))
        return F.struct(high.alias("hi"), F.pmod(product, F.lit(1 << 32)).alias("lo"))

    end = F.aggregate(codes, seed, step)
    whole = end["hi"].cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(11,0)") + end["lo"].cast("decimal(20,0)")
    return F.when(F.length(string) > 0, whole.cast("decimal(20,0)").cast("string")).otherwise(F.when(string.isNotNull(), F.lit("14695981039346656037")))


def pseudonymous_uid(uid: Column) -> Column:
    """A stable identifier below 2.25. It is a plain hash: whoever knows the original can compute it."""
    return F.concat(F.lit("2.25."), fnv1a64(uid))


def uid(root: str) -> Column:
    """A new identifier below root at every evaluation; write the result before using it twice."""
    parts = root.split(".")
    if not root or len(root) > 29 or any(not p.isdigit() or (p[0] == "0" and p != "0") for p in parts):
        raise ValueError("invalidUIDRoot")
    return F.concat(F.lit(root + "."), F.unix_millis(F.current_timestamp()).cast("string"), F.lit("."), F.conv(F.substring(F.regexp_replace(F.uuid(), "-", ""), 1, 16), 16, 10))
