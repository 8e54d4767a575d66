"""Secret scan with recursive decoding.

Each text is a layer. A layer is scanned for secrets, then decoded: URL escapes and Unicode escapes are undone over
the whole layer, base64 runs and what they hold compressed become layers of their own. New layers go on a worklist
until none is new (fixpoint); a layer that was seen before with the same origin is not entered again, which ends
cycles. Every layer knows which span of the document each of its characters comes from, so that what is found in it
is reported where it stands in the document.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import small_batches

#: Kinds in order of listing, with their patterns and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_VALUE, LEAST_ACCESS = 8, 16
KEYWORDS = ("passw", "secret", "token", "api")

URL_ESCAPES = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE_ESCAPES = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 over several lines, as in mails and keys, and the line breaks in it.
WRAPPED = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:[ \t]*\r?\n[ \t>]*[A-Za-z0-9+/_-]+)+={0,2}")
WRAP = re.compile(r"[ \t]*\r?\n[ \t>]*")
#: A compressed layer may not unfold beyond this many bytes; what it unfolds up to there is scanned, the row says so.
LAYER_BYTES = 64 << 20


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every secret in one layer, in code points."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


@dataclass
class Layer:
    """Decoded text; edges lists (start, end, origin start, origin end) of its stretches in order.

    A stretch as long as its origin maps character by character, any other maps to its origin as a whole. raw has the
    bytes of a layer that is compressed.
    """

    text: str
    edges: list[tuple[int, int, int, int]]
    via: tuple[str, ...] = ()
    raw: bytes = b""
    starts: list[int] = field(default_factory=list)

    def mark(self) -> tuple[bytes, int, int]:
        """What tells it from other layers: its content and where it comes from."""
        own = self.raw + b"\0" + self.text.encode("utf-8", "surrogatepass")
        return hashlib.blake2b(own, digest_size=16).digest(), self.edges[0][2], self.edges[-1][3]

    def origin(self, start: int, end: int) -> tuple[int, int]:
        if not self.starts:
            self.starts = [e[0] for e in self.edges]
        a = self.edges[bisect_right(self.starts, start) - 1]
        b = self.edges[bisect_right(self.starts, max(start, end - 1)) - 1]
        exact = lambda e: e[1] - e[0] == e[3] - e[2]
        return (a[2] + start - a[0] if exact(a) else a[2]), (b[2] + end - b[0] if exact(b) else b[3])


def readable(raw: bytes) -> str | None:
    """raw as text if it is printable UTF-8, but for one character in twenty."""
    text = raw.decode("utf-8", "replace")
    odd = sum(c == "\ufffd" or not (c.isprintable() or c in "\t\r\n") for c in text)
    return text if text and odd * 20 <= len(text) else None


def method_of(raw: bytes) -> str | None:
    if raw[:2] == b"\x1f\x8b":
        return "gzip"
    if raw[:4] == b"\x28\xb5\x2f\xfd":
        return "zstd"
    if raw[:3] == b"BZh":
        return "bz2"
    if raw[:6] == b"\xfd7zXZ\x00":
        return "xz"
    return "zlib" if len(raw) > 2 and raw[0] & 15 == 8 and (raw[0] << 8 | raw[1]) % 31 == 0 else None


def member(raw: bytes, method: str, most: int) -> tuple[bytes, bytes]:
    """What the first member of raw unfolds to, up to most bytes, and what follows it."""
    if method == "zstd":
        d, out, size = zstandard.ZstdDecompressor().decompressobj(), [], 0
        for at in range(0, len(raw), 256):  # in small pieces, each of which unfolds to a few MB at most
            out.append(d.decompress(raw[at : at + 256]))
            size += len(out[-1])
            if d.eof:
                return b"".join(out)[:most], d.unused_data + raw[at + 256 :]
            if size >= most:
                break
        return b"".join(out)[:most], b""
    d = {"gzip": lambda: zlib.decompressobj(31), "zlib": zlib.decompressobj, "bz2": bz2.BZ2Decompressor, "xz": lzma.LZMADecompressor}[method]()
    return d.decompress(raw, most), d.unused_data if d.eof else b""


def unfolded(raw: bytes) -> tuple[str, bytes, bool] | None:
    """(method, content of all members, cut short) if raw is compressed; a broken later member ends it."""
    method, out, size, rest = method_of(raw), [], 0, raw
    while method and rest and method_of(rest) == method:
        try:
            part, rest = member(rest, method, LAYER_BYTES - size)
        except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, zstandard.ZstdError):
            break
        out.append(part)
        size += len(part)
        if size >= LAYER_BYTES:
            return method, b"".join(out), True
    return (method, b"".join(out), False) if out else None


def rewritten(layer: Layer, pattern: re.Pattern, decode, name: str) -> Layer | None:
    """The layer with every match decoded; None if nothing changed."""
    out, edges, at, size = [], [], 0, 0

    def add(text: str, start: int, end: int) -> None:
        nonlocal size
        if text:
            edges.append((size, size + len(text), start, end))
            out.append(text)
            size += len(text)

    def add_plain(start: int, end: int) -> None:  # keeps the map of the layer above
        for a, b, oa, ob in layer.edges:
            lo, hi = max(a, start), min(b, end)
            if lo < hi:
                add(layer.text[lo:hi], *((oa + lo - a, oa + hi - a) if b - a == ob - oa else (oa, ob)))

    changed = False
    for m in pattern.finditer(layer.text):
        new = decode(m)
        if new is not None:
            add_plain(at, m.start())
            add(new, *layer.origin(*m.span()))
            at, changed = m.end(), True
    if not changed:
        return None
    add_plain(at, len(layer.text))
    return Layer("".join(out), edges, (*layer.via, name)) if size else None


def url_decoded(m: re.Match) -> str | None:
    try:
        return bytes.fromhex(m[0].replace("%", "")).decode("utf-8")
    except UnicodeDecodeError:
        return bytes.fromhex(m[0].replace("%", "")).decode("latin-1")


def unicode_decoded(m: re.Match) -> str | None:
    hexed = m[1] or m[2] or m[3] or m[4] or m[5]
    code = int(hexed, 16) if hexed else int(m[6])
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else None


def unwrapped(layer: Layer) -> Iterator[tuple[Layer, bool]]:
    """The layers one step below: (layer, cut short)."""
    if layer.raw and (more := unfolded(layer.raw)) and more[1]:
        again = more[1] if method_of(more[1]) else b""
        yield placed(more[1].decode("utf-8", "replace"), again, layer.edges[0][2:], (*layer.via, more[0])), more[2]
    if "%" in layer.text and (new := rewritten(layer, URL_ESCAPES, url_decoded, "url")):
        yield new, False
    if ("\\" in layer.text or "&#" in layer.text) and (new := rewritten(layer, UNICODE_ESCAPES, unicode_decoded, "unicode")):
        yield new, False
    runs = [(m[0], *m.span()) for m in BASE64.finditer(layer.text)]
    if "\n" in layer.text:
        for m in WRAPPED.finditer(layer.text):
            runs += joined(layer.text, *m.span())
    for run, start, end in runs:
        run = run.rstrip("=")
        if len(run) % 4 == 1:
            run = run[:-1]
        try:
            raw = base64.b64decode(run + "=" * (-len(run) % 4), altchars=b"-_" if "-" in run or "_" in run else None)
        except (binascii.Error, ValueError):
            continue
        packed = bool(raw) and method_of(raw) is not None
        # What unfolds is content, whatever bytes it has; else it may be a long word that is no base64.
        text = readable(raw)
        if packed or text:
            yield placed(text or "", raw if packed else b"", layer.origin(start, end), (*layer.via, "base64")), False


def placed(text: str, raw: bytes, origin: tuple[int, int], via: tuple[str, ...]) -> Layer:
    return Layer(text, [(0, len(text), *origin)], via, raw)


def joined(text: str, start: int, end: int) -> Iterator[tuple[str, int, int]]:
    """(run, start, end) of base64 wrapped over lines: all lines, and the lines of one width with and without the neighbours.

    A run may begin after other text in its first line, its last line is shorter, and a long word may stand on the
    line above or below, so each stretch of equal width is tried with either neighbour and without.
    """
    edges, at = [], start
    for m in WRAP.finditer(text, start, end):
        edges.append((at, m.start()))
        at = m.end()
    edges.append((at, end))
    starts = [0] + [k for k in range(1, len(edges)) if edges[k][1] - edges[k][0] != edges[k - 1][1] - edges[k - 1][0]] + [len(edges)]
    tried = {(0, len(edges))}
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        tried |= {(x, y) for x in (max(0, a - 1), a) for y in (b, min(len(edges), b + 1)) if y - x > 1}
    for a, b in sorted(tried):
        yield "".join(text[x:y] for x, y in edges[a:b]), edges[a][0], edges[b - 1][1]


def scan(text: str) -> tuple[list[dict], bool]:
    """All secrets of a document, base ones first, and whether a layer was cut short."""
    found: dict[tuple[str, int, int], str] = {}
    short = False
    work, seen = [Layer(text, [(0, len(text), 0, len(text))])] if text else [], set()
    while work:
        layer = work.pop()
        for kind, start, end in find(layer.text):
            span = (start, end) if not layer.via else layer.origin(start, end)
            found.setdefault((kind, *span), ">".join(layer.via))
        for new, cut in unwrapped(layer):
            short |= cut
            if (mark := new.mark()) not in seen:
                seen.add(mark)
                work.append(new)
    order = {k: i for i, k in enumerate(KINDS)}
    return [{"kind": k, "start": a, "end": b, "via": via} for (k, a, b), via in sorted(found.items(), key=lambda x: (x[0][1], order[x[0][0]], x[0][2]))], short


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, found (array of kind, start, end, via), cut_short.

    Offsets are code points, end exclusive; via is empty for secrets in the text itself and names the decodings
    otherwise, whose spans are those of the encoded stretch. Spans are distinct and ordered by start, kind, end; a
    span found both ways counts as base. Null counts as empty, which has none. Texts of any length are scanned
    whole; cut_short says that a compressed layer exceeded LAYER_BYTES. Repeated rows give equal rows, an empty table
    gives none; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("via", pa.string())])
    schema = pa.schema([("doc_id", pa.int64()), ("found", pa.list_(kind)), ("cut_short", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.list_(kind)), pa.array([r[1] for r in rows], pa.bool_())], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, found array<struct<kind:string,start:long,end:long,via:string>>, cut_short boolean")


def digests(spans: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, cut_short."""
    base = F.filter("found", lambda s: s["via"] == "")

    def listed(own):
        return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(kind):
        return F.filter(base, lambda s: s["kind"] == kind)

    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return spans.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"), "cut_short")
