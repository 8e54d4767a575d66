"""Part 10 files and raw data sets as tables, and back.

A file is decoded once, in Arrow batches, to one row with its status and an array of its elements; `elements` explodes
that array. A file that cannot be read becomes a row with status 'error', it does not end the job (mode FAILFAST does).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumenframe import binary
from lumenframe.arrow import gathered, mapped
from lumenframe.functions import values
from lumenframe.model import ATTRIBUTES, ELEMENT, EXPLICIT_LE, TAG, dictionary
from lumenframe.operators.frames import frame_ranges
from lumenframe.operators.lookup import attribute
from lumenframe.sources import shapes

DECODED = T.StructType(
    [
        T.StructField("file_id", T.StringType()),
        T.StructField("length", T.LongType()),
        T.StructField("transfer_syntax_uid", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("error_kind", T.StringType()),
        T.StructField("error_detail", T.StringType()),
        T.StructField("elements", T.ArrayType(ELEMENT)),
    ]
)
ENCODED = T.StructType([T.StructField("file_id", T.StringType()), T.StructField("content", T.BinaryType()), T.StructField("status", T.StringType()), T.StructField("error_kind", T.StringType())])
#: Bytes of file content that go into one output batch.
BATCH_BYTES = 16 << 20


def _batches(rows: Iterator[tuple[dict, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    own, size = [], 0
    for row, n in rows:
        own.append(row)
        size += n
        if size >= BATCH_BYTES or len(own) >= 2000:
            yield pa.RecordBatch.from_pylist(own, schema=schema)
            own, size = [], 0
    if own:
        yield pa.RecordBatch.from_pylist(own, schema=schema)


def decode_files(files: DataFrame, id_col: str = "file_id", content_col: str = "content", *, transfer_syntax: str | None = None, pixels: str = "load", tags: list[int] | None = None, vrs: dict[int, str] | None = None, mode: str = "PERMISSIVE") -> DataFrame:
    """One row per file: file_id, length, transfer_syntax_uid, status, error_kind, error_detail, elements.

    transfer_syntax: the content is a raw data set of that syntax instead of a Part 10 file. pixels='skip' leaves the
    top-level pixel data's bytes out and keeps their place; tags keeps the bytes of these top-level elements only.
    vrs adds to the dictionary for Implicit VR, say model.read_dictionary's whole table; the built-in rows win. A null content is an error like an empty one.
    """
    schema = to_arrow_schema(DECODED)
    make = _reader(transfer_syntax, pixels, tags, vrs, mode)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = make()
        for batch in gathered(batches, shapes.FILES, shapes.BYTES):
            yield from reader.batches(batch.column(0), batch.column(1))

    return mapped(files.select(F.col(id_col).cast("string"), F.col(content_col).cast("binary")), run, DECODED)


def decode_columns(files: DataFrame, names: list[str], id_col: str = "file_id", content_col: str = "content", *, transfer_syntax: str | None = None, vrs: dict[int, str] | None = None, mode: str = "PERMISSIVE") -> DataFrame:
    """The same rows as lookup.columns_of(decode_files(files), names) in one step: other elements than these never leave the batch."""
    out = T.StructType([T.StructField("file_id", T.StringType()), *[T.StructField(n, T.BinaryType()) for n in names]])
    schema, wanted = to_arrow_schema(out), [TAG[n] for n in names]
    make = _reader(transfer_syntax, "load", wanted, vrs, mode)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = make()
        for batch in gathered(batches, shapes.FILES, shapes.BYTES):
            yield from reader.column_batches(batch.column(0), batch.column(1), wanted, schema)

    return mapped(files.select(F.col(id_col).cast("string"), F.col(content_col).cast("binary")), run, out)


def _reader(transfer_syntax: str | None, pixels: str, tags: list[int] | None, vrs: dict[int, str] | None, mode: str) -> Callable[[], shapes.Reader]:
    """What makes a task's reader of contents."""
    schema = to_arrow_schema(DECODED)
    wanted = None if tags is None else frozenset(tags)
    vrs = None if vrs is None else dictionary(vrs)
    options = {"pixels": pixels, "tags": wanted, "vrs": vrs}

    def one(content: bytes | None) -> tuple[dict, list[dict]]:
        row = {"length": None if content is None else len(content), "transfer_syntax_uid": transfer_syntax, "status": "ok", "error_kind": None, "error_detail": None}
        rows: list[dict] = []
        try:
            if transfer_syntax is None:
                row["transfer_syntax_uid"], rows = binary.decode_part10(content or b"", **options)
            else:
                rows = binary.decode_dataset(content or b"", transfer_syntax, **options)
        except binary.DecodeError as e:
            if mode == "FAILFAST":
                raise
            row |= {"status": "error", "error_kind": e.kind, "error_detail": e.detail}
        return row, rows

    return lambda: shapes.Reader(one, transfer_syntax, options, schema, _decoded_batch)


def _lists(parts: list[list | None]) -> tuple[pa.Array, list]:
    """Offsets (NULL where a part is) and the parts' values one after the other."""
    offsets, flat = [], []
    for p in parts:
        offsets.append(None if p is None else len(flat))
        flat += p or ()
    return pa.array([*offsets, len(flat)], pa.int32()), flat


def _decoded_batch(ids: list, heads: list[dict], own: list[list[dict]], schema: pa.Schema) -> pa.RecordBatch:
    """A batch of DECODED built column by column, which is much cheaper than row by row."""
    offsets, rows = _lists(own)
    kind = schema.field("elements").type.value_type
    columns = []
    for field in kind:
        column = [r.get(field.name) for r in rows]
        if field.name in ("path", "fragment_ranges"):
            at, steps = _lists(column)
            names = [f.name for f in field.type.value_type]
            inner = pa.StructArray.from_arrays([pa.array([s[n] for s in steps], f.type) for n, f in zip(names, field.type.value_type, strict=True)], fields=list(field.type.value_type))
            columns.append(pa.ListArray.from_arrays(at, inner, type=field.type))
        else:
            columns.append(pa.array(column, field.type))
    elements = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, fields=list(kind)), type=schema.field("elements").type)
    heads_ = [pa.array([h[f.name] for h in heads], f.type) for f in list(schema)[1:-1]]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), *heads_, elements], schema=schema)


def scan_part10(spark: SparkSession, path: str, *, glob: str | None = None, recursive: bool = True, **options) -> DataFrame:
    """Decoded files below a path; file_id is the file's path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return decode_files(reader.load(path), "path", "content", **options)


def files_of(decoded: DataFrame) -> DataFrame:
    return decoded.drop("elements")


def elements_of(decoded: DataFrame) -> DataFrame:
    """One row per element: file_id, transfer_syntax_uid and the columns of model.ELEMENT."""
    return decoded.select("file_id", "transfer_syntax_uid", F.explode("elements").alias("e")).select("file_id", "transfer_syntax_uid", "e.*")


WRITTEN = ["is_meta", "path", "depth", "ordinal", "tag", "vr", "value", "item_count", "fragments", "bot"]


def encode_files(elements: DataFrame, transfer_syntax: str = EXPLICIT_LE, *, dataset_only: bool = False, undefined_lengths: bool = False) -> DataFrame:
    """One row per file_id of an elements table: content, status, error_kind. Inverse of decoding.

    Files meet by file_id; what is gathered is one file's own elements.
    """
    have = [F.col(c) if c in elements.columns else F.lit(None).cast(ELEMENT[c].dataType).alias(c) for c in WRITTEN]
    gathered = elements.select("file_id", F.struct(*have).alias("e")).groupBy("file_id").agg(F.collect_list("e").alias("elements"))
    return encode_arrays(gathered, transfer_syntax, dataset_only=dataset_only, undefined_lengths=undefined_lengths)


def encode_arrays(files: DataFrame, transfer_syntax: str = EXPLICIT_LE, *, dataset_only: bool = False, undefined_lengths: bool = False) -> DataFrame:
    """The same for files that hold their elements as an array already; no shuffle.

    Encapsulated pixel data is not transcoded: a compressed target needs elements with fragments.
    """
    schema = to_arrow_schema(ENCODED)

    def one(file_id: str, own: list[dict]) -> dict:
        row = {"file_id": file_id, "content": None, "status": "ok", "error_kind": None}
        try:
            meta = binary.tree([r for r in own if r["is_meta"]])
            body = binary.tree([r for r in own if not r["is_meta"]])
            row["content"] = binary.encode_dataset(body, transfer_syntax, undefined_lengths) if dataset_only else binary.encode_part10(meta, body, transfer_syntax, undefined_lengths)
        except binary.DecodeError as e:
            row |= {"status": "error", "error_kind": e.kind}
        return row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = shapes.Writer(transfer_syntax, dataset_only, undefined_lengths, one, schema)
        for batch in gathered(batches, shapes.FILES, shapes.BYTES):
            yield from writer.batches(batch.column(0), batch.column(1))

    return mapped(files.select(F.col("file_id").cast("string"), "elements"), run, ENCODED)


def element(tag: int, vr: str, value: Column | None, *, ordinal: int = 0, path: list[tuple[int, int]] = (), is_meta: bool = False, items: int | None = None) -> Column:
    """An element as a struct for encode_arrays; array_compact drops those whose value is NULL."""
    steps = F.array(*[F.struct(F.lit(t).cast("long").alias("tag"), F.lit(i).alias("item")) for t, i in path]).cast(ELEMENT["path"].dataType)
    body = F.struct(
        F.lit(is_meta).alias("is_meta"),
        steps.alias("path"),
        F.lit(len(path)).alias("depth"),
        F.lit(ordinal).alias("ordinal"),
        F.lit(tag).cast("long").alias("tag"),
        F.lit(vr).alias("vr"),
        (F.lit(b"") if value is None else value).cast("binary").alias("value"),
        F.lit(items).cast("int").alias("item_count"),
        F.lit(None).cast("array<binary>").alias("fragments"),
        F.lit(None).cast("binary").alias("bot"),
    )
    return body if value is None or items is not None else F.when(value.isNotNull(), body)


def data_set(own: dict[str, Column]) -> Column:
    """The elements array of a flat data set by keyword; NULL values are left out."""
    return F.array_compact(F.array(*[element(*ATTRIBUTES[name], value, ordinal=k) for k, (name, value) in enumerate(own.items())]))


def pixel_ranges(elements: DataFrame) -> DataFrame:
    """(file_id, frame_or_fragment, offset, length) of the top-level pixel data, for positional reads."""
    own = elements.where("not is_meta and depth = 0 and tag = 2145386512")
    native = own.where("fragment_ranges is null").select("file_id", F.lit(0).alias("part"), F.col("value_offset").alias("offset"), F.col("value_length").alias("length"))
    fragments = own.where("fragment_ranges is not null").select("file_id", F.posexplode("fragment_ranges").alias("part", "r")).select("file_id", "part", "r.offset", "r.length")
    return native.unionByName(fragments)


def read_ranges(contents: DataFrame, ranges: DataFrame, content_col: str = "content") -> DataFrame:
    """(file_id, part, bytes, status): the bytes at each range; a range beyond the file is truncatedData."""
    joined = contents.select("file_id", F.col(content_col).alias("content")).join(ranges, "file_id")
    got = F.expr("substring(content, cast(offset + 1 as int), cast(length as int))")
    short = F.length(got) < F.col("length")
    return joined.select("file_id", "part", F.when(~short, got).alias("bytes"), F.when(short, "truncatedData").otherwise("ok").alias("status"))


def native_frame_ranges(decoded: DataFrame) -> DataFrame:
    """(file_id, part, offset, length): where each native frame of a file lies, from a scan that skipped the pixels.

    Files without the attributes that the size follows from, with encapsulated pixels or too short a value have none.
    """
    number = lambda n: values.us(attribute("elements", n)["value"]).cast("long")
    count = F.coalesce(values.integer(attribute("elements", "NumberOfFrames")["value"]), F.lit(1)).cast("long")
    own = decoded.where("status = 'ok'").select("file_id", attribute("elements", "PixelData").alias("p"), (number("Rows") * number("Columns") * number("SamplesPerPixel") * F.floor(number("BitsAllocated") / 8)).alias("length"), count.alias("frames"))
    fits = own.where("p.fragment_ranges is null and length > 0 and frames > 0 and length * frames <= p.value_length")
    return fits.select("file_id", F.explode(F.sequence(F.lit(0), (F.col("frames") - 1).cast("int"))).alias("part"), "length", "p.value_offset").select("file_id", "part", (F.col("value_offset") + F.col("part") * F.col("length")).alias("offset"), "length")


def encapsulated_frame_ranges(decoded: DataFrame) -> DataFrame:
    """(file_id, part, fragment, offset, length): the fragments of each frame, by the basic offset table or one a frame."""
    own = decoded.where("status = 'ok'").select("file_id", attribute("elements", "PixelData").alias("p")).where("p.fragment_ranges is not null")
    bot = F.coalesce(values.ul_list(F.col("p.bot")), F.array().cast("array<long>"))
    starts = F.when(F.size(bot) > 0, bot.cast("array<long>")).otherwise(F.col("p.fragment_offsets"))
    frames = own.select("file_id", F.col("p.fragment_ranges").alias("all"), F.posexplode(frame_ranges(F.col("p.fragment_offsets"), starts)).alias("part", "own"))
    each = frames.select("file_id", "part", F.posexplode(F.slice("all", F.col("own.first") + 1, (F.col("own.last") - F.col("own.first")).cast("int"))).alias("fragment", "r"))
    return each.select("file_id", "part", "fragment", "r.offset", "r.length")


def read_at(ranges: DataFrame, path_col: str = "file_id") -> DataFrame:
    """ranges (path, offset, length and more) with their bytes and status, by positional reads: no file is read whole.

    Paths are URIs or local paths that Arrow's file systems open on the executors; a range beyond its file is
    truncatedData, a file that cannot be opened notFound. Only the ranges are shuffled, by path, so that a file's are
    read in order through one handle.
    """
    keys = [c for c in ranges.columns]
    schema = T.StructType([*ranges.schema.fields, T.StructField("bytes", T.BinaryType()), T.StructField("status", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, handle = None, None

        def rows() -> Iterator[tuple[dict, int]]:
            nonlocal path, handle
            for batch in batches:
                for row in batch.to_pylist():
                    if row[path_col] != path:
                        path = row[path_col]
                        try:
                            system, name = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
                            handle = system.open_input_file(name)
                        except (OSError, pa.ArrowInvalid):
                            handle = None
                    if handle is None:
                        yield row | {"status": "notFound"}, 0
                        continue
                    fits = row["offset"] >= 0 and row["offset"] + row["length"] <= handle.size()
                    got = handle.read_at(row["length"], row["offset"]) if fits else None
                    yield row | {"bytes": got, "status": "ok" if fits else "truncatedData"}, len(got or b"")

        return _batches(rows(), arrow)

    return mapped(ranges.repartition(path_col).sortWithinPartitions(path_col, "offset").select(*keys), run, schema)


def multipart_bodies(instances: DataFrame, boundary: str) -> DataFrame:
    """(file_id, body): each row's array `parts` of Part 10 files as one multipart/related body."""
    schema = pa.schema([("file_id", pa.string()), ("body", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([binary.multipart_body(x, boundary) for x in batch.column(1).to_pylist()], pa.binary())], schema=schema)

    return mapped(instances.select("file_id", "parts"), run, "file_id string, body binary")


def first_parts(bodies: DataFrame) -> DataFrame:
    """(file_id, content, status): the first part of each multipart body by the boundary that its content_type names."""
    schema = pa.schema([("file_id", pa.string()), ("content", pa.binary()), ("status", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [binary.first_multipart_body(b or b"", c or "") for b, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), pa.array(["invalidMultipartResponse" if f is None else "ok" for f in found], pa.string())], schema=schema)

    return mapped(bodies.select("file_id", "body", "content_type"), run, "file_id string, content binary, status string")


def register_parser(spark: SparkSession, name: str = "dicom_elements") -> None:
    """A table function of a file's content for SQL: SELECT ... FROM files, LATERAL dicom_elements(content)."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="is_meta boolean, depth int, ordinal int, tag bigint, vr string, value binary")
    class Parse:
        def eval(self, content: bytes):
            try:
                _, rows = binary.decode_part10(bytes(content or b""))
            except binary.DecodeError:
                return
            for r in rows:
                yield r["is_meta"], r["depth"], r["ordinal"], r["tag"], r["vr"], r["value"]

    spark.udtf.register(name, Parse)
