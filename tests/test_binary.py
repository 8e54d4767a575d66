"""The decoder and encoder against hand-built bytes."""

import random
import struct

import pytest

from lumenframe import binary, model
from lumenframe.binary import DecodeError, Element, decode_dataset, decode_part10, encode_dataset, encode_part10, tree
from lumenframe.dataset import DataSet
from lumenframe.model import TAG


def explicit(tag: int, vr: str, value: bytes, order: str = "<") -> bytes:
    head = struct.pack(order + "HH", tag >> 16, tag & 0xFFFF) + vr.encode()
    return head + (b"\0\0" + struct.pack(order + "I", len(value)) if vr in model.LONG_VRS else struct.pack(order + "H", len(value))) + value


def implicit(tag: int, value: bytes, length: int | None = None) -> bytes:
    return struct.pack("<HHI", tag >> 16, tag & 0xFFFF, len(value) if length is None else length) + value


def part10(body: bytes, syntax: str = model.EXPLICIT_LE) -> bytes:
    return b"\0" * 128 + b"DICM" + explicit(0x00020010, "UI", binary.padded(syntax.encode(), "UI")) + body


def data_set(content: bytes) -> DataSet:
    _, rows = decode_part10(content)
    return DataSet(tree([r for r in rows if not r["is_meta"]]))


NAME = explicit(TAG["PatientName"], "PN", b"Doe^Jane")


def test_explicit_little_endian():
    ds = data_set(part10(NAME + explicit(TAG["Rows"], "US", b"\0\2") + explicit(TAG["Columns"], "US", b"\0\1")))
    assert (ds.text("PatientName"), ds.us("Rows"), ds.us("Columns")) == ("Doe^Jane", 512, 256)


def test_implicit_with_undefined_sequence():
    item = implicit(0x00081150, b"1.2.840\0")
    sequence = implicit(0x00081110, struct.pack("<HHI", 0xFFFE, 0xE000, 0xFFFFFFFF) + item + struct.pack("<HHIHHI", 0xFFFE, 0xE00D, 0, 0xFFFE, 0xE0DD, 0), 0xFFFFFFFF)
    ds = data_set(part10(implicit(TAG["PatientName"], b"Doe^Jane") + sequence, model.IMPLICIT_LE))
    assert [i.text("ReferencedSOPClassUID") for i in ds.items("ReferencedStudySequence")] == ["1.2.840"]


def test_unknown_private_tag_of_undefined_length_is_a_sequence():
    body = implicit(0x00990001, struct.pack("<HHIHHI", 0xFFFE, 0xE000, 0, 0xFFFE, 0xE0DD, 0), 0xFFFFFFFF)
    rows = decode_dataset(body, model.IMPLICIT_LE)
    assert [(r["vr"], r["item_count"]) for r in rows] == [("SQ", 1)]


def test_un_of_undefined_length_keeps_its_vr():
    inner = NAME
    body = struct.pack("<HH", 0x0009, 0x0001) + b"UN\0\0\xff\xff\xff\xff" + struct.pack("<HHI", 0xFFFE, 0xE000, len(inner)) + inner + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
    rows = decode_dataset(body, model.EXPLICIT_LE)
    assert [(r["vr"], r.get("item_count"), r["depth"]) for r in rows] == [("UN", 1, 0), ("PN", None, 1)]


def test_big_endian_and_deflated():
    ds = data_set(part10(explicit(TAG["Rows"], "US", b"\2\0", ">"), model.EXPLICIT_BE))
    assert ds.us("Rows") == 512
    ds = data_set(part10(binary.deflate(NAME), model.DEFLATED_LE))
    assert ds.text("PatientName") == "Doe^Jane"


def test_duplicates_last_wins_and_reserved_bytes_are_ignored():
    ds = data_set(part10(NAME + explicit(TAG["PatientName"], "PN", b"Roe")))
    assert ds.text("PatientName") == "Roe"
    raw = struct.pack("<HH", 0x0009, 0x0002) + b"OB\7\7" + struct.pack("<I", 2) + b"ab"
    assert decode_dataset(raw, model.EXPLICIT_LE)[0]["value"] == b"ab"


@pytest.mark.parametrize(
    ("content", "kind"),
    [
        (b"", "missingPart10Preamble"),
        (b"\0" * 128 + b"DICM", "missingTransferSyntaxUID"),
        (part10(NAME[:-2]), "truncatedData"),
        (part10(struct.pack("<HH", 8, 0x1140) + b"SQ\0\0\xff\xff\xff\xff"), "truncatedData"),
        (part10(explicit(TAG["PatientName"], "ZZ", b"ab")), "invalidVR"),
        (part10(explicit(0x00081140, "SQ", struct.pack("<HHI", 8, 8, 0))), "invalidSequenceItem"),
        (part10(NAME, "1.2.3"), "unsupportedTransferSyntax"),
        (part10(struct.pack("<HH", 9, 1) + b"OB\0\0\xff\xff\xff\xff"), "unsupportedUndefinedLength"),
        (part10(b"no deflate", model.DEFLATED_LE), "invalidDeflatedData"),
        (part10(explicit(0x00081140, "SQ", struct.pack("<HHI", 0xFFFE, 0xE000, 4) + NAME)), "truncatedData"),
    ],
)
def test_malformed(content, kind):
    with pytest.raises(DecodeError) as e:
        decode_part10(content)
    assert e.value.kind == kind


def test_encapsulated_pixel_data_and_skipping():
    frames = [[b"abcd", b"ef"], [b"ghi"]]
    element = Element(TAG["PixelData"], "OB", fragments=[f for own in frames for f in own], bot=binary.basic_offset_table(frames))
    content = encode_part10({}, {element.tag: element}, model.RLE)
    _, rows = decode_part10(content)
    row = rows[-1]
    assert row["fragments"] == [b"abcd", b"ef", b"ghi\0"] and row["fragment_offsets"] == [0, 12, 22] and row["bot"] == struct.pack("<2I", 0, 22)
    _, rows = decode_part10(content, pixels="skip")
    assert [content[r["offset"] : r["offset"] + r["length"]] for r in rows[-1]["fragment_ranges"]] == row["fragments"]
    assert rows[-1]["fragments"] is None


def test_transcoding_is_refused():
    with pytest.raises(DecodeError):
        encode_dataset({TAG["PixelData"]: Element(TAG["PixelData"], "OW", b"ab")}, model.RLE)
    with pytest.raises(DecodeError):
        encode_dataset({TAG["PixelData"]: Element(TAG["PixelData"], "OB", fragments=[b"a"])}, model.IMPLICIT_LE)


def random_set(rnd: random.Random, depth: int = 0) -> dict[int, Element]:
    out = {}
    for tag, vr in rnd.sample(sorted(set(model.BUILT_IN_VRS.items())), 6):
        if tag >> 16 in (2, 4) or tag == TAG["PixelData"]:
            continue
        if vr == "SQ":
            out[tag] = Element(tag, vr, items=[random_set(rnd, depth + 1) for _ in range(rnd.randint(0, 2))] if depth < 3 else [])
        else:
            out[tag] = Element(tag, vr, bytes(rnd.randrange(256) for _ in range(8 * rnd.randint(0, 3))))
    return out


def plain(elements: dict[int, Element]):
    return {t: (e.vr, e.value, None if e.items is None else [plain(i) for i in e.items]) for t, e in elements.items()}


@pytest.mark.parametrize("syntax", [model.EXPLICIT_LE, model.IMPLICIT_LE, model.EXPLICIT_BE, model.DEFLATED_LE])
@pytest.mark.parametrize("undefined", [False, True])
def test_decoding_inverts_encoding(syntax, undefined):
    rnd = random.Random(7)
    for _ in range(40):
        own = random_set(rnd)
        rows = decode_dataset(encode_dataset(own, syntax, undefined), syntax)
        assert plain(tree(rows)) == plain(own)


def test_truncation_anywhere_is_an_error_or_a_shorter_file():
    content = encode_part10({}, random_set(random.Random(3)), undefined_lengths=True)
    for n in range(len(content)):
        try:
            decode_part10(content[:n])
        except DecodeError:
            pass


def test_deep_nesting_needs_no_recursion_in_the_decoder():
    depth = 5000
    body = (struct.pack("<HH", 0x0008, 0x1140) + b"SQ\0\0\xff\xff\xff\xff" + struct.pack("<HHI", 0xFFFE, 0xE000, 0xFFFFFFFF)) * depth
    body += (struct.pack("<HHI", 0xFFFE, 0xE00D, 0) + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)) * depth
    assert len(decode_dataset(body, model.EXPLICIT_LE)) == depth


def test_values():
    rows = decode_dataset(explicit(0x00080005, "CS", b"ISO_IR 100") + explicit(TAG["PatientName"], "PN", b"J\xf6rg"), model.EXPLICIT_LE)
    ds = DataSet(tree(rows))
    assert ds.charset_text("PatientName") == "Jörg" and ds.text("PatientName") is None
    ds = DataSet({TAG["WindowCenter"]: Element(0, "DS", b"40\\400"), TAG["PixelPaddingValue"]: Element(0, "SS", b"\x18\xfc"), 0x00290010: Element(0, "LO", b"ACME 1.0"), 0x00291001: Element(0, "LO", b"42")})
    assert ds.numbers("WindowCenter") == [40, 400] and ds.ss("PixelPaddingValue") == -1000
    assert ds.private("ACME 1.0", 0x29, 0x1001).value == b"42" and ds.private_creator(0x00291001) == "ACME 1.0"


def test_multipart():
    body = binary.multipart_body([b"one", b"two"], "xyz")
    assert binary.first_multipart_body(body, 'multipart/related; type="application/dicom"; boundary="xyz"') == b"one"
    assert binary.first_multipart_body(body, "application/dicom") is None
