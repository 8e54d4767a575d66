"""Files by shape: columns have the same rows, bytes and errors as file by file."""

import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql.pandas.types import to_arrow_schema

from lumenframe import binary, model
from lumenframe.arrow import gathered
from lumenframe.model import TAG
from lumenframe.sources import part10, shapes

SYNTAXES = (model.EXPLICIT_LE, model.IMPLICIT_LE, model.EXPLICIT_BE, model.DEFLATED_LE, model.RLE, "1.2.3")
READ = to_arrow_schema(part10.DECODED)


def element(path: list, k: int, tag: int, vr: str, value: bytes = b"", items: int | None = None, **more) -> dict:
    return {"is_meta": False, "path": [{"tag": t, "item": i} for t, i in path], "depth": len(path), "ordinal": k, "tag": tag, "vr": vr, "value": value, "item_count": items, "fragments": None, "bot": None, **more}


def data_set(kind: int, rng: random.Random) -> list[dict]:
    """Elements of one of a few shapes with values of any length: flat, nested, with a repeated tag, with fragments."""
    some = lambda: bytes(rng.randrange(32, 127) for _ in range(rng.randrange(9)))
    outer, inner = TAG["ReferencedSeriesSequence"], TAG["ReferencedImageSequence"]
    rows = [element([], 0, TAG["PatientName"], "PN", some()), element([], 1, TAG["SOPInstanceUID"], "UI", some()), element([], 2, TAG["Rows"], "US", b"\1\0")]
    if kind in (1, 2):
        rows.append(element([], 3, outer, "SQ", items=2))
        rows += [element([(outer, i)], 4 + i, inner, "SQ", items=kind) for i in range(2)]
        rows += [element([(outer, i), (inner, kind - 1)], 9 + i, TAG["ReferencedSOPInstanceUID"], "UI", some()) for i in range(2)]
    if kind == 3:
        rows += [element([], 5, TAG["PatientName"], "PN", some()), element([], 0, 0x00020002, "UI", some(), is_meta=True), element([], 6, 0x00290010, "OB", some())]
    if kind == 4:
        rows.append(element([], 7, TAG["PixelData"], "OB", fragments=[some() for _ in range(rng.randrange(1, 4))], bot=b""))
    if kind == 5:
        rows.append(element([], 7, TAG["PixelData"], "OW", some()))
    if kind == 6:
        rows.append(element([], 7, TAG["InstitutionName"], "LO", b"x" * rng.choice([10, 65534, 65535, 65536, 70000])))
    return rows


def encoded_alone(rows: list[dict], syntax: str, dataset_only: bool, undefined: bool) -> tuple[bytes | None, str | None]:
    try:
        meta, body = binary.tree([r for r in rows if r["is_meta"]]), binary.tree([r for r in rows if not r["is_meta"]])
        return (binary.encode_dataset(body, syntax, undefined) if dataset_only else binary.encode_part10(meta, body, syntax, undefined)), None
    except binary.DecodeError as e:
        return None, e.kind


def written(files: list[list[dict]], syntax: str, dataset_only: bool, undefined: bool) -> list[tuple]:
    def one(file_id: str, own: list[dict]) -> dict:
        content, kind = encoded_alone(own, syntax, dataset_only, undefined)
        return {"content": content, "error_kind": kind}

    writer = shapes.Writer(syntax, dataset_only, undefined, one, to_arrow_schema(part10.ENCODED))
    column = pa.array([None, *files], READ.field("elements").type).slice(1)  # an array with an offset
    ids = pa.array([str(k) for k in range(len(files))])
    table = pa.Table.from_batches(list(writer.batches(ids, column)))
    assert table["file_id"].to_pylist() == ids.to_pylist()
    assert table["status"].to_pylist() == ["ok" if e is None else "error" for e in table["error_kind"].to_pylist()]
    return list(zip(table["content"].to_pylist(), table["error_kind"].to_pylist(), strict=True))


@pytest.mark.parametrize("syntax", SYNTAXES)
@pytest.mark.parametrize("undefined", [False, True])
def test_writing_by_shape_equals_writing_file_by_file(syntax, undefined):
    rng = random.Random(5)
    files = [data_set(rng.randrange(7), rng) for _ in range(300)]
    for dataset_only in (False, True):
        assert written(files, syntax, dataset_only, undefined) == [encoded_alone(f, syntax, dataset_only, undefined) for f in files]


def read_alone(content: bytes | None, syntax: str | None, **options) -> tuple[dict, list[dict]]:
    row = {"length": None if content is None else len(content), "transfer_syntax_uid": syntax, "status": "ok", "error_kind": None, "error_detail": None}
    try:
        if syntax is None:
            row["transfer_syntax_uid"], rows = binary.decode_part10(content or b"", **options)
        else:
            rows = binary.decode_dataset(content or b"", syntax, **options)
    except binary.DecodeError as e:
        return row | {"status": "error", "error_kind": e.kind, "error_detail": e.detail}, []
    return row, rows


def damaged(content: bytes, rng: random.Random) -> bytes:
    """Some files cut, grown or with other bytes in places where headers are."""
    kind, at = rng.randrange(8), rng.randrange(120, max(121, len(content)))
    if kind == 0:
        return content[:at]
    if kind == 1:
        return content + bytes(rng.randrange(12))
    if kind == 2:
        return content[:at] + bytes([rng.choice([0, 1, 8, 255])]) + content[at + 1 :]
    return content


@pytest.mark.parametrize("syntax", SYNTAXES[:5])
@pytest.mark.parametrize("undefined", [False, True])
def test_reading_by_shape_equals_reading_file_by_file(syntax, undefined):
    rng = random.Random(7)
    for whole in (True, False):
        files = [encoded_alone(data_set(rng.randrange(7), rng), syntax, not whole, undefined)[0] for _ in range(700)]
        contents = [None if c is None else damaged(c, rng) for c in files]
        for options in ({}, {"pixels": "skip"}, {"tags": frozenset([TAG["Rows"]])}):
            named = None if whole else syntax
            reader = shapes.Reader(lambda c: read_alone(c, named, **options), named, options, READ, part10._decoded_batch)
            ids = pa.array([str(k) for k in range(len(contents))])
            got = pa.Table.from_batches(list(reader.batches(ids, pa.array([b"none", *contents], pa.binary()).slice(1))))
            alone = [read_alone(c, named, **options) for c in contents]
            want = part10._decoded_batch(ids.to_pylist(), [a for a, _ in alone], [r for _, r in alone], READ)
            got.validate(full=True)
            assert got.to_pylist() == want.to_pylist()
            tags = [TAG["PatientName"], TAG["Rows"], TAG["InstitutionName"]]
            kept = pa.schema([("file_id", pa.string()), *((str(t), pa.binary()) for t in tags)])
            columns = pa.Table.from_batches(list(reader.column_batches(ids, pa.array(contents, pa.binary()), tags, kept)))
            columns.validate(full=True)
            last = lambda rows, t: next((r["value"] for r in reversed(rows) if r["tag"] == t and r["depth"] == 0), None)
            assert columns.to_pylist() == [{"file_id": i, **{str(t): last(rows, t) for t in tags}} for i, (head, rows) in zip(ids.to_pylist(), alone, strict=True) if head["status"] == "ok"]
            if syntax in (model.EXPLICIT_LE, model.IMPLICIT_LE):
                assert reader.shapes


def test_what_a_worker_holds_does_not_grow_with_the_batch():
    """Ten thousand rows of Arrow come out in batches of at most shapes.FILES files and about shapes.BYTES."""
    rng = random.Random(3)
    files = [data_set(k % 4, rng) for k in range(3 * shapes.FILES)]
    writer = shapes.Writer(model.EXPLICIT_LE, False, False, None, to_arrow_schema(part10.ENCODED))
    ids = pa.array([str(k) for k in range(len(files))])
    batches = list(writer.batches(ids, pa.array(files, READ.field("elements").type)))
    assert max(b.num_rows for b in batches) == shapes.FILES and sum(b.num_rows for b in batches) == len(files)
    assert list(shapes.cuts(pa.array([5, 5, 30, 1, 1]).to_numpy(), 10, 10)) == [(0, 2), (2, 3), (3, 5)]
    reader = shapes.Reader(None, None, {}, READ, None)
    contents = pa.concat_arrays([b.column(1) for b in batches])
    assert [b.num_rows for b in reader.batches(ids, contents)] == [shapes.FILES] * 3
    pieces = [b.slice(k, 500) for b in batches for k in range(0, b.num_rows, 500)]
    assert [b.num_rows for b in gathered(iter(pieces), shapes.FILES, 1 << 30)] == [shapes.FILES] * 3
    assert max(b.num_rows for b in gathered(iter(pieces), shapes.FILES, 1000)) == 500
    assert struct.unpack("<H", reader.batch(ids[:1], contents[:1]).column("elements")[0].as_py()[-1]["value"])


def test_python_values_equal_to_pylist():
    rng = random.Random(9)
    maybe = lambda x: None if rng.random() < 0.3 else x
    one = lambda: {"i": maybe(rng.randrange(-5, 5)), "b": maybe(rng.random() < 0.5), "t": maybe("é" * rng.randrange(3)), "raw": maybe(b"x" * rng.randrange(3)), "d": maybe(0.5), "own": maybe([maybe({"tag": maybe(1 << 40), "item": maybe(1)}) for _ in range(rng.randrange(3))]), "many": maybe([maybe(b"a") for _ in range(rng.randrange(3))])}
    kind = pa.struct([("i", pa.int32()), ("b", pa.bool_()), ("t", pa.string()), ("raw", pa.binary()), ("d", pa.float64()), ("own", pa.list_(pa.struct([("tag", pa.int64()), ("item", pa.int32())]))), ("many", pa.list_(pa.binary()))])
    column = pa.array([maybe([maybe(one()) for _ in range(rng.randrange(4))]) for _ in range(200)], pa.list_(kind))
    for own in (column, column.slice(7, 90), column[:0]):
        assert binary.python_values(own) == own.to_pylist()
        assert list(binary.element_rows(own)) == [x or [] for x in own.to_pylist()]
