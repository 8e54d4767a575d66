"""Operators on small tables, against values worked out by hand."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenframe import binary, model, protocol
from lumenframe.binary import Element, encode_part10
from lumenframe.codecs import rle
from lumenframe.functions import pixels, values
from lumenframe.model import ATTRIBUTES, TAG
from lumenframe.operators import deidentify, directory, frames, hierarchy, lookup, presentation, validate
from lumenframe.plans import queries
from lumenframe.sources import dicom_json, part10, web


def elements(**own) -> dict[int, Element]:
    """Elements by keyword: text, bytes, a number for US, or a list of dicts for a sequence."""
    out = {}
    for name, value in own.items():
        tag, vr = ATTRIBUTES[name]
        if isinstance(value, list):
            out[tag] = Element(tag, "SQ", items=[elements(**i) for i in value])
        else:
            raw = value if isinstance(value, bytes) else value.to_bytes(2, "little", signed=value < 0) if isinstance(value, int) else value.encode()
            out[tag] = Element(tag, vr, raw)
    return out


def decoded(spark, *sets: dict[int, Element], syntax: str = model.EXPLICIT_LE, ids=None):
    rows = [(ids[k] if ids else f"f{k}", encode_part10({}, s, syntax)) for k, s in enumerate(sets)]
    return part10.decode_files(spark.createDataFrame(rows, "file_id string, content binary"))


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_files_on_disk_and_errors(spark, tmp_path):
    (tmp_path / "good.dcm").write_bytes(encode_part10({}, elements(PatientName="Doe^Jane", Rows=512)))
    (tmp_path / "bad.dcm").write_bytes(b"nothing")
    (tmp_path / "other.txt").write_bytes(b"")
    own = part10.scan_part10(spark, str(tmp_path), glob="*.dcm")
    assert {(r.file_id.rsplit("/", 1)[1], r.status, r.error_kind) for r in part10.files_of(own).collect()} == {("good.dcm", "ok", None), ("bad.dcm", "error", "missingPart10Preamble")}
    assert lookup.tags_of(part10.elements_of(own)).select("tags").first()[0] == [TAG["PatientName"], TAG["Rows"]]
    with pytest.raises(Exception, match="missingPart10Preamble"):
        part10.scan_part10(spark, str(tmp_path), glob="*.dcm", mode="FAILFAST").collect()
    part10.register_parser(spark)
    spark.read.format("binaryFile").load(str(tmp_path / "good.dcm")).createOrReplaceTempView("blobs")
    assert spark.sql("SELECT e.tag FROM blobs, LATERAL dicom_elements(content) e WHERE NOT e.is_meta ORDER BY 1").collect() == [(TAG["PatientName"],), (TAG["Rows"],)]


def test_pruned_scan_keeps_places(spark):
    content = encode_part10({}, elements(PatientName="Doe", Rows=1) | {TAG["PixelData"]: Element(TAG["PixelData"], "OW", b"\x12\x34")})
    files = spark.createDataFrame([("a", content)], "file_id string, content binary")
    own = part10.decode_files(files, pixels="skip", tags=[TAG["Rows"]])
    kept = {r.tag: bytes(r.value) for r in part10.elements_of(own).where("not is_meta").collect()}
    assert kept == {TAG["PatientName"]: b"", TAG["Rows"]: b"\1\0", TAG["PixelData"]: b""}
    assert bytes(part10.read_ranges(files, part10.pixel_ranges(part10.elements_of(own))).first()["bytes"]) == b"\x12\x34"


def test_values(spark):
    raw = lambda b: F.lit(b)
    r = one(spark, a=values.text(raw(b" ab \0 ")), b=values.text(raw(b"\xff")), c=values.decimals(raw(b" 40\\400 ")), d=values.decimals(raw(b"1\\abc")), e=values.us(raw(b"\1")), f=values.sl_list(raw(b"\xff\xff\xff\xff\2\0\0\0")), g=values.at_list(raw(b"\x10\0\x10\0\x28\0\x10\0")), h=values.ss(raw(b"\x18\xfc")), i=values.us_list(raw(b"")), j=values.decimals(raw(b"")), k=values.strict_int(F.lit(" 5")), l=values.us_list(raw(b"abc")))
    assert tuple(r) == (" ab", None, [40, 400], None, None, [-1, 2], [0x00100010, 0x00280010], -1000, [], None, None, None)
    t = one(spark, a=values.date_time(F.lit("20260812093015.25+0900")), b=values.time(F.lit("0930")), c=values.date(F.lit("20261301")), d=values.time(F.lit("9")), e=values.date_time(F.lit("2026081")), f=values.person_name(raw(b"A^B=C=D=E")))
    assert tuple(t.a) == (2026, 8, 12, 9, 30, 15, 250000000, 32400) and tuple(t.b) == (9, 30, None, None) and tuple(t.c) == (2026, 13, 1) and t.d is None and t.e is None and tuple(t.f) == ("A^B", "C", "D=E")
    assert one(spark, a=values.pseudonymous_uid(F.lit("1.2.3.4"))).a == "2.25.790097504932053221"
    df = spark.createDataFrame([(b"J\xf6rg", "ISO_IR 100"), ("テスト".encode("shift_jis"), "ISO_IR 13"), ("漢".encode("iso2022_jp"), "\\ISO 2022 IR 87"), (b"x", "nope"), (b"\0\0\x80\x3f", None)], "v binary, c string")
    assert [r[0] for r in df.select(values.charset_text("v", "c")).collect()] == ["Jörg", "テスト", "漢", None, None]
    assert df.where("c is null").select(values.fl_list("v")).first()[0] == [1.0]
    assert one(spark, a=values.uid("1.2.3")).a.startswith("1.2.3.")
    with pytest.raises(ValueError, match="invalidUIDRoot"):
        values.uid("1.02")


def test_hierarchy(spark):
    own = decoded(spark, elements(SeriesInstanceUID="s", SOPInstanceUID="b", InstanceNumber="1", ImagePositionPatient="0\\0\\10"), elements(SeriesInstanceUID="s", SOPInstanceUID="a", InstanceNumber="2", ImagePositionPatient="0\\0\\0"), elements(SOPInstanceUID="c"))
    got = {r.series_uid: r.sop_uids for r in hierarchy.series(hierarchy.instances(own)).collect()}
    assert got == {"s": ["a", "b"], "": ["c"]}


def test_directory(spark):
    image = elements(DirectoryRecordType="IMAGE", ReferencedFileID="D\\I1", OffsetOfTheNextDirectoryRecord=b"\0" * 4)
    record = lambda nxt, child, kind: {TAG["OffsetOfTheNextDirectoryRecord"]: Element(TAG["OffsetOfTheNextDirectoryRecord"], "UL", nxt.to_bytes(4, "little")), TAG["OffsetOfReferencedLowerLevelDirectoryEntity"]: Element(TAG["OffsetOfReferencedLowerLevelDirectoryEntity"], "UL", child.to_bytes(4, "little")), TAG["DirectoryRecordType"]: Element(TAG["DirectoryRecordType"], "CS", kind.encode())}

    def build(root: int, child: int):
        items = [record(0, child, "PATIENT"), image]
        sequence = Element(TAG["DirectoryRecordSequence"], "SQ", items=items)
        first = Element(TAG["OffsetOfTheFirstDirectoryRecordOfTheRootDirectoryEntity"], "UL", root.to_bytes(4, "little"))
        return {first.tag: first, sequence.tag: sequence}

    at = next(r for r in binary.decode_part10(encode_part10({}, build(1, 1)))[1] if r["vr"] == "SQ")["item_offsets"]
    own = decoded(spark, build(at[0], at[1]), build(at[0], at[0]), build(at[0], 7), elements(PatientName="x"))
    records = directory.directory_records(own)
    assert [r.referenced_file for r in records.where("file_id = 'f0'").orderBy("ordinal").collect()] == [None, ["D", "I1"]]
    tree = directory.directory_tree(records)
    assert [(r.offset, r.level, r.parent_offset) for r in tree.where("file_id = 'f0'").orderBy("place").collect()] == [(at[0], 0, None), (at[1], 1, at[0])]
    assert {r.file_id for r in tree.where("status <> 'ok'").collect()} == {"f1", "f2", "f3"}
    records.where("status = 'ok'").createOrReplaceTempView("records")
    assert spark.sql(directory.tree_sql("records")).where("file_id = 'f0'").count() == 2
    assert directory.dangling(records.where("status = 'ok'")).select("file_id").distinct().collect() == [("f2",)]
    assert directory.linked([(k, k + 1, 0) for k in range(1, 50000)] + [(50000, 0, 0)], 1)[-1] == (50000, 0, None)


def test_deidentification(spark):
    own = decoded(spark, elements(PatientName="Doe", PatientBirthDate="20000101", StudyInstanceUID="1.2.3.4", ReferencedStudySequence=[{"PatientName": "Roe", "ReferencedSOPInstanceUID": "1.2.3.4"}]) | {0x00091001: Element(0x00091001, "LO", b"private")})
    left = deidentify.apply_rules(part10.elements_of(own).where("not is_meta"), deidentify.basic_profile(spark))
    got = {(r.depth, r.tag): bytes(r.value).rstrip(b"\0 ").decode() for r in left.collect()}
    assert got == {(0, TAG["ReferencedStudySequence"]): "", (0, TAG["PatientName"]): "Anonymous", (0, TAG["StudyInstanceUID"]): "2.25.790097504932053221", (1, TAG["PatientName"]): "Anonymous", (1, TAG["ReferencedSOPInstanceUID"]): "2.25.790097504932053221"}
    rules = spark.createDataFrame([(TAG["ReferencedStudySequence"], "remove", None), (TAG["PatientName"], "remap", None)], "tag long, action string, replacement string")
    left = deidentify.apply_rules(part10.elements_of(own).where("not is_meta"), rules, remove_private=False)
    assert {r.tag for r in left.collect()} == {0x00091001, TAG["PatientBirthDate"], TAG["StudyInstanceUID"]}


def test_validation(spark):
    own = decoded(spark, elements(Modality="") | {TAG["Rows"]: Element(TAG["Rows"], "SS", b"\1\0")})
    found = validate.issues(part10.files_of(own), part10.elements_of(own), validate.requirements(spark, [("Modality", 1), ("PatientName", 2), ("Rows", 1), ("Modality", 2)]))
    assert [(r.kind, r.expected_vr, r.actual_vr) for r in found.orderBy("ordinal").collect()] == [("empty", None, None), ("missing", None, None), ("unexpectedVR", "US", "SS")]


BASE = {"SamplesPerPixel": 1, "PhotometricInterpretation": "MONOCHROME2", "Rows": 1, "BitsAllocated": 16, "BitsStored": 16, "PixelRepresentation": 0}


def image(numbers, width: int = 2, **own) -> dict[int, Element]:
    raw = b"".join(int(n).to_bytes(width, "little", signed=n < 0) for n in numbers)
    return elements(**{**BASE, "Columns": len(numbers), **own}) | {TAG["PixelData"]: Element(TAG["PixelData"], "OW", raw + b"\0" * (len(raw) % 2))}


@pytest.mark.parametrize(
    ("numbers", "own", "expected"),
    [
        ([100, 200, 300], {}, [0, 128, 255]),
        ([0, 1000], {"WindowCenter": "500", "WindowWidth": "1000"}, [0, 255]),
        ([0, 1000], {"WindowCenter": "500", "WindowWidth": "1000", "PhotometricInterpretation": "MONOCHROME1"}, [255, 0]),
        ([0, 150], {"RescaleSlope": "2", "RescaleIntercept": "-100", "WindowCenter": "0", "WindowWidth": "200"}, [0, 255]),
        ([0, 100, 200], {"PixelPaddingValue": 0}, [0, 0, 255]),
        ([0xFC18, 0], {"PixelRepresentation": 1, "WindowCenter": "-500", "WindowWidth": "1000"}, [0, 255]),
        ([0, 1], {"WindowCenter": "0", "WindowWidth": "1"}, "invalidWindowWidth"),
        ([0, 255], {"VOILUTSequence": [{"LUTDescriptor": b"\0\1\0\0\x08\0", "LUTData": np.arange(256, dtype="<u2").tobytes()}]}, [0, 255]),
        ([100, 2000], {"ModalityLUTSequence": [{"LUTDescriptor": b"\2\0\x64\0\x10\0", "LUTData": np.array([5, 9], "<u2").tobytes()}], "RescaleSlope": "7", "WindowCenter": "7", "WindowWidth": "3"}, [0, 255]),
    ],
)
def test_grey_rendering(spark, numbers, own, expected):
    shown = frames.render(frames.frames_of(decoded(spark, image(numbers, **own)))).first()
    assert (list(shown.pixels) if shown.pixels is not None else shown.status) == expected


def test_colour_rendering(spark):
    rgb = {"SamplesPerPixel": 3, "PhotometricInterpretation": "RGB", "BitsAllocated": 8, "Columns": 2}
    palette = {"PhotometricInterpretation": "PALETTE COLOR", "BitsAllocated": 8, **{f"{c}PaletteColorLookupTableDescriptor": b"\2\0\0\0\x10\0" for c in ("Red", "Green", "Blue")}, "RedPaletteColorLookupTableData": b"\0\0\xff\xff", "GreenPaletteColorLookupTableData": b"\xff\xff\0\0", "BluePaletteColorLookupTableData": b"\0\0\0\0"}
    own = decoded(
        spark,
        image([1, 2, 3, 4, 5, 6], 1, **rgb),
        image([1, 2, 3, 4, 5, 6], 1, **rgb, PlanarConfiguration=1),
        image([76, 85, 255], 1, **{**rgb, "PhotometricInterpretation": "YBR_FULL", "Columns": 1}),
        image([0, 1], 1, **palette),
        image([256, 512, 768], 2, **{**rgb, "BitsAllocated": 16, "Columns": 1}),
    )
    got = {r.file_id: list(r.pixels or b"") for r in frames.render(frames.frames_of(own)).collect()}
    assert got["f0"] == [1, 2, 3, 4, 5, 6] and got["f1"] == [1, 3, 5, 2, 4, 6] and got["f3"] == [0, 255, 0, 255, 0, 0] and got["f4"] == [1, 2, 3]
    assert np.abs(np.array(got["f2"]) - [254, 0, 0]).max() <= 1


def test_one_bit_and_shutter():
    base = {"rows": 1, "columns": 8, "samples_per_pixel": 1, "bits_allocated": 1, "photometric": "MONOCHROME2", "lut_shape": None, "value": b"\x53"}
    assert frames.rendered(base, None, None).tolist() == [255, 255, 0, 0, 255, 0, 255, 0]
    circle = {"shapes": [{"kind": "CIRCULAR", "row": 5, "column": 5, "radius": 3}]}
    hidden = frames.mask_of(circle, 10, 10)
    assert not hidden[4, 7] and hidden[4, 8] and not hidden[4, 4]
    assert frames.mask_of({"shapes": [{"kind": "POLYGONAL", "vertices": [{"row": 1, "column": 1}]}]}, 2, 2).all()
    assert not frames.mask_of({"shapes": [{"kind": "BITMAP", "overlay_group": 0x6000}]}, 2, 2).any()


def test_native_and_python_pixel_arithmetic_agree(spark):
    r = np.random.default_rng(4)
    numbers = r.integers(-500, 1500, 200).tolist()
    df = spark.createDataFrame([(numbers,)], "s array<long>")
    native = df.select(pixels.windowed(F.col("s"), F.lit(300.5), F.lit(700.0))).first()[0]
    f = {"bits_stored": 16, "bits_allocated": 16, "pixel_representation": 1, "modality_lut": None, "rescale_slope": 1.0, "rescale_intercept": 0.0, "voi_luts": [], "padding": None, "window_center": None, "window_width": None}
    assert native == frames.grey_window(f, np.array(numbers) & 0xFFFF, 300.5, 700.0).tolist()


def test_compressed_frames(spark):
    def compressed(own, *fragments, bot=b""):
        return elements(**own) | {TAG["PixelData"]: Element(TAG["PixelData"], "OB", fragments=list(fragments), bot=bot)}

    a, b = (rle.encode(np.array(x, "<u2").tobytes(), 1, 2) for x in ([0, 1000], [7, 8]))
    own = {**BASE, "Columns": 2, "NumberOfFrames": "2"}
    table = binary.basic_offset_table([[a], [b]])
    files = decoded(spark, compressed(own, a, b), compressed(own, a, b, bot=table), compressed(own, a, a, b), compressed(own, a[:70], b), syntax=model.RLE)
    got = {}
    for r in frames.frames_of(files).collect():
        got.setdefault(r.file_id, []).append(r.status if r.value is None else np.frombuffer(bytes(r.value), "<u2").tolist())
    assert got["f0"] == got["f1"] == [[0, 1000], [7, 8]] and got["f2"] == ["unsupportedPixelFormat"] and got["f3"] == ["truncatedPixelData"]


def test_frame_ranges(spark):
    r = one(spark, good=frames.frame_ranges(F.lit([0, 12, 22, 40]), F.lit([0, 22])), late=frames.frame_ranges(F.lit([0, 12]), F.lit([12])), unknown=frames.frame_ranges(F.lit([0, 12]), F.lit([0, 13])), falling=frames.frame_ranges(F.lit([0, 12, 20]), F.lit([0, 20, 12])))
    assert [tuple(x) for x in r.good] == [(0, 2), (2, 4)] and r.late is None and r.unknown is None and r.falling is None


def test_float_frames(spark):
    own = elements(Rows=1, Columns=2) | {TAG["FloatPixelData"]: Element(TAG["FloatPixelData"], "OF", np.array([1.5, 2.25], "<f4").tobytes())}
    assert frames.float_frames(decoded(spark, own)).first()["values"] == [1.5, 2.25]


def test_presentation_state(spark):
    refs = [{"SeriesInstanceUID": "s", "ReferencedImageSequence": [{"ReferencedSOPInstanceUID": "i1", "ReferencedFrameNumber": "1\\x\\2"}, {"ReferencedSOPInstanceUID": "i2"}]}]
    voi = [{"ReferencedImageSequence": [{"ReferencedSOPInstanceUID": "i1"}], "WindowCenter": "200", "WindowWidth": "400"}, {"WindowCenter": "50", "WindowWidth": "100"}]
    state = elements(SOPClassUID=model.SOP_CLASSES["grayscale_presentation_state"][0], ReferencedSeriesSequence=refs, SoftcopyVOILUTSequence=voi, ImageRotation=90, ImageHorizontalFlip="Y", PresentationLUTShape="INVERSE", ShutterShape="CIRCULAR", CenterOfCircularShutter="1\\1", RadiusOfCircularShutter="0", ShutterPresentationValue=0x8000, GraphicLayerSequence=[{"GraphicLayer": "L", "GraphicLayerOrder": "1"}, {"GraphicLayer": "no order"}], GraphicAnnotationSequence=[{"GraphicLayer": "L", "TextObjectSequence": [{"UnformattedTextValue": "t", "BoundingBoxAnnotationUnits": "PIXEL"}, {}], "GraphicObjectSequence": [{"GraphicDimensions": 2, "NumberOfGraphicPoints": 1, "GraphicData": np.array([1, 2], "<f4").tobytes(), "GraphicType": "POINT"}, {"GraphicType": "POINT"}]}], DisplayedAreaSelectionSequence=[{"DisplayedAreaTopLeftHandCorner": np.array([10, 20], "<i4").tobytes()}])
    states = presentation.presentation_states(decoded(spark, state, elements(SOPClassUID="1.2"), ids=["state", "other"])).cache()
    s = states.where("file_id = 'state'").first()
    assert (s.rotation, s.horizontal_flip, s.lut_shape) == (90, True, "INVERSE") and [r.frame_numbers for r in s.referenced_images] == [[1, 2], None]
    assert [x.name for x in s.graphic_layers] == ["L"] and len(s.graphic_annotations[0].texts) == len(s.graphic_annotations[0].graphics) == 1 and (s.displayed_areas[0].left, s.displayed_areas[0].top) == (10, 20)
    assert states.where("file_id = 'other'").first().status == "invalidPresentationState"
    own = frames.frames_of(decoded(spark, *[image([0, 400], SOPInstanceUID=u) for u in ("i1", "i2", "i3")]))
    applied = presentation.apply_states(own, states)
    assert {r.sop_instance_uid: (r.window_center, r.window_width) for r in applied.collect()} == {"i1": (200, 400), "i2": (50, 100)}
    assert {r.file_id: list(r.pixels) for r in frames.render(applied).collect()} == {"f0": [255, 0x80], "f1": [255, 0x80]}


def test_json(spark):
    own = elements(PatientName="A^B=C", PatientWeight="1.250", ReferencedStudySequence=[{"PatientID": "x"}], Rows=5) | {0x00280009: Element(0x00280009, "AT", b"\x10\0\x10\0"), 0x00091002: Element(0x00091002, "SL", b"\xfe\xff\xff\xff"), 0x00091003: Element(0x00091003, "UV", b"\xff" * 8), 0x00091004: Element(0x00091004, "OB", b"ab"), 0x00091000: Element(0x00091000, "FL", b"\0\0\xa0\x3f")}
    texts = dicom_json.write_json(decoded(spark, own))
    back = dicom_json.read_json(texts)
    again = binary.tree([r.asDict(recursive=True) for r in back.first().elements])
    assert {t: (e.vr, e.value) for t, e in again.items() if e.items is None} == {t: (e.vr, e.value) for t, e in own.items() if e.items is None}
    assert again[TAG["ReferencedStudySequence"]].items[0][TAG["PatientID"]].value == b"x"
    bad = ['{"PatientName":{"vr":"PN"}}', "[]", '{"00280010":{"vr":"US","Value":[70000]}}', '{"00100010":{"vr":"PN","Value":[{}]}}', '{"00091004":{"vr":"OB","InlineBinary":"!"}}', '{"00100020":{"vr":"LO","Value":["a"],"InlineBinary":"YQ=="}}', None]
    rows = dicom_json.read_json(spark.createDataFrame([(str(k), b) for k, b in enumerate(bad)], "file_id string, json string"))
    assert [r.error_kind for r in rows.collect()] == ["invalidDICOMJSON"] * len(bad)
    linked = spark.createDataFrame([("a", '{"00091004":{"vr":"OB","BulkDataURI":"u"}}')], "file_id string, json string")
    bulk = spark.createDataFrame([("a", "u", b"zz")], "file_id string, uri string, content binary")
    assert bytes(dicom_json.read_json(linked, bulk=bulk).first().elements[0].value) == b"zz"


REQUEST = {"type": "associate_rq", "called": "PEER", "calling": "ME", "application_context": protocol.APPLICATION_CONTEXT, "contexts": [{"id": 1, "abstract_syntax": "1.2", "transfer_syntaxes": ["a", "b"]}], "user": {"maximum": 32768, "implementation_class": "1.2.3", "implementation_version": "V1", "window": (1, 2), "roles": [("1.2", True, False)], "identity": {"kind": "username_password", "primary": b"u", "secondary": b"p", "response": True}}}
ACCEPT = {"type": "associate_ac", "called": "PEER", "calling": "ME", "application_context": protocol.APPLICATION_CONTEXT, "contexts": [{"id": 1, "result": "acceptance", "transfer_syntax": "a"}], "user": {"maximum": 16384, "roles": [], "identity_response": b"ok"}}


@pytest.mark.parametrize("pdu", [REQUEST, ACCEPT, {"type": "associate_rj", "result": 1, "source": 1, "reason": 7}, {"type": "p_data", "values": [{"context": 3, "command": True, "last": False, "data": b"ab"}, {"context": 3, "command": True, "last": True, "data": b""}]}, {"type": "release_rq"}, {"type": "release_rp"}, {"type": "abort", "source": 2, "reason": 1}])
def test_pdus(pdu):
    raw = protocol.encode_pdu(pdu)
    assert protocol.decode_pdu(raw) == pdu
    for n in range(len(raw)):
        with pytest.raises(protocol.ProtocolError):
            protocol.decode_pdu(raw[:n])


@pytest.mark.parametrize("command", [{"command": "c_echo_rq", "message_id": 1, "has_data_set": False}, {"command": "c_store_rq", "sop_class": "1.2", "message_id": 2, "sop_instance": "1.2.3", "has_data_set": True}, {"command": "c_move_rq", "sop_class": "1.2", "message_id": 2, "destination": "DEST", "has_data_set": True}, {"command": "c_find_rsp", "responded_to": 2, "status": 0xFF00, "has_data_set": True, "error_comment": None}, {"command": "c_get_rsp", "responded_to": 2, "status": 0, "has_data_set": False, "error_comment": "why", "remaining": 0, "completed": 3, "failed": 1, "warning": 2}, {"command": "c_cancel_rq", "responded_to": 9, "has_data_set": False}])
def test_commands(command):
    raw = protocol.encode_command(command)
    assert protocol.decode_command(raw) == command
    with pytest.raises(protocol.ProtocolError):
        protocol.decode_command(raw[:-1])


def test_protocol_errors():
    for broken in ({**REQUEST, "called": "x" * 17}, {**REQUEST, "contexts": [{"id": 2, "abstract_syntax": "1", "transfer_syntaxes": ["a"]}]}, {**REQUEST, "user": {"identity": {"kind": "kerberos", "primary": b"x" * 65536}}}):
        with pytest.raises(protocol.ProtocolError):
            protocol.encode_pdu(broken)
    with pytest.raises(protocol.ProtocolError, match="unsupportedPDU"):
        protocol.decode_pdu(b"\x09\0\0\0\0\0")
    with pytest.raises(protocol.ProtocolError, match="malformedCommandSet"):
        protocol.encode_command({"command": "c_move_rq", "sop_class": "1", "message_id": 1, "destination": "x" * 17})


def test_role_negotiation(spark):
    requests = spark.createDataFrame([(1, protocol.APPLICATION_CONTEXT, "A", [(1, "1.2", ["x"])], [("1.2", True, True), ("9", True, True), ("1.3", True, True)])], "assoc_id long, application_context string, called string, contexts array<struct<id:int,abstract_syntax:string,transfer_syntaxes:array<string>>>, roles array<struct<sop_class:string,scu:boolean,scp:boolean>>")
    uids = lambda *u: spark.createDataFrame([(x,) for x in u], "uid string")
    _, contexts, roles = protocol.negotiated(requests, None, uids("1.2", "1.3"), spark.createDataFrame([("x", 0)], "uid string, preference int"), uids("1.2"))
    assert [(r.sop_class, r.scu, r.scp) for r in roles.orderBy("ordinal").collect()] == [("1.2", True, True), ("1.3", True, False)]
    assert protocol.accepted_context(contexts).first().transfer_syntax == "x"


def test_streams(spark, tmp_path):
    from lumenframe.streaming.landing import landing_zone, reassemble_stream

    zone = tmp_path / "zone"
    zone.mkdir()
    (zone / "a.dcm").write_bytes(encode_part10({}, elements(PatientName="Doe")))
    q = landing_zone(spark, str(zone)).select("status").writeStream.format("memory").queryName("landed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(120)
    assert spark.table("landed").collect() == [("ok",)]
    pieces = tmp_path / "pieces"
    schema = "assoc_id string, context int, command boolean, seq long, last boolean, data binary"
    for part in ([("a", 1, False, 1, False, b"x")], [("a", 1, False, 2, True, b"y"), ("a", 1, False, 3, True, b"z")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(pieces))
        q = reassemble_stream(spark.readStream.schema(schema).parquet(str(pieces))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert [(r.message, bytes(r.data)) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("message").collect()] == [(0, b"xy"), (1, b"z")]


def test_whole_texts_and_vectors(spark, tmp_path):
    """Against brute force, besides their SQL."""
    texts = ["a" * 200 + "é" * 50 + " end  ", "漢 é\n" * 40 + "x", None, ""] * 2
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.line for r in queries.charset_text(spark, str(tmp_path)).collect()}
    assert got == {k: t and re.sub("[^\x20-\xff]", "?", t).rstrip("\0 ") for k, t in enumerate(texts)}

    vectors = [np.random.default_rng(k).uniform(-1, 1, 64).astype("<f4").tolist() for k in range(6)]
    spark.createDataFrame([(k, 0, v) for k, v in enumerate(vectors)], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = {r.vec_id: r for r in queries.number_lists(spark, str(tmp_path)).collect()}
    for k, v in enumerate(vectors):
        samples = [max(0, min(4095, int(np.floor((x + 1) * 1000 + 0.5)))) for x in v]
        raw = np.array([x * 23 % 65536 for x in samples], "<u2").tobytes()
        for name, kind in {"us": "<u2", "ss": "<i2", "ul": "<u4", "sl": "<i4", "uv": "<u8", "sv": "<i8"}.items():
            assert rows[k][name] == ",".join(map(str, np.frombuffer(raw, kind).tolist()))
        assert rows[k]["at"] == ",".join(str(a << 16 | b) for a, b in np.frombuffer(raw, "<u2").reshape(-1, 2).tolist())


def test_json_of_wrong_types(spark):
    bad = ['{"00081140":{"vr":"SQ","Value":3}}', '{"00100010":{"vr":"PN","Value":[{"Alphabetic":3}]}}', '{"00100020":{"vr":["x"]}}', '{"00100020":{"vr":"LO","Value":{"a":1}}}', '{"00100020":3}', '{"00280010":{"vr":"US","Value":[1e400]}}', '{"00081140":{"vr":"SQ","Value":[[]]}}', '{"00091004":{"vr":"OB","InlineBinary":[1]}}']
    rows = dicom_json.read_json(spark.createDataFrame([(str(k), b) for k, b in enumerate(bad)], "file_id string, json string")).collect()
    assert [r.status for r in rows] == ["error"] * len(bad)


def test_positional_reads(spark, tmp_path):
    paths = []
    for k in range(3):
        own = elements(Rows=1, Columns=2, SamplesPerPixel=1, BitsAllocated=16, NumberOfFrames="3") | {TAG["PixelData"]: Element(TAG["PixelData"], "OW", bytes(range(12 * k, 12 * k + 12)))}
        path = tmp_path / f"f{k}.dcm"
        path.write_bytes(encode_part10({}, own))
        paths.append(str(path))
    own = part10.scan_part10(spark, str(tmp_path), pixels="skip")
    ranges = part10.native_frame_ranges(own)
    assert ranges.count() == 9
    got = {(r.file_id[-6:], r.part): (r.status, r.bytes and bytes(r.bytes)) for r in part10.read_at(ranges).collect()}
    assert got == {(f"f{k}.dcm", p): ("ok", bytes(range(12 * k + 4 * p, 12 * k + 4 * p + 4))) for k in range(3) for p in range(3)}
    odd = spark.createDataFrame([(paths[0], 0, 10**9, 4), (str(tmp_path / "none"), 0, 0, 4)], "file_id string, part int, offset long, length long")
    assert sorted(r.status for r in part10.read_at(odd).collect()) == ["notFound", "truncatedData"]


def test_no_file_is_lost(spark):
    own = decoded(spark, elements(PatientName="A"), elements(SOPInstanceUID="1"))
    assert lookup.columns_of(own, ["SOPInstanceUID"]).count() == lookup.pivoted(part10.elements_of(own), ["SOPInstanceUID"]).count() == 2
    rules = deidentify.basic_profile(spark)
    rows = lambda d: sorted((r.file_id, r.tag, bytes(r.value)) for r in d.collect())
    assert rows(part10.elements_of(deidentify.apply_to_files(own, rules))) == rows(deidentify.apply_rules(part10.elements_of(own), rules))


def test_long_lists_are_refused(spark, monkeypatch):
    monkeypatch.setattr(deidentify, "LONGEST_LIST", 3)
    with pytest.raises(ValueError, match="more than 3"):
        deidentify.listed(spark.range(5))


def test_messages_for_each_batch(spark, tmp_path):
    from lumenframe.streaming.landing import for_each_message

    spark.createDataFrame([("a", b"x")], "assoc_id string, data binary").write.parquet(str(tmp_path / "in"))
    seen = []
    q = for_each_message(spark.readStream.schema("assoc_id string, data binary").parquet(str(tmp_path / "in")), lambda rows, n: seen.append((n, rows.count())), str(tmp_path / "c"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert seen == [(0, 1)]


def test_web(spark):
    """Against a small server on this machine: a search, an instance in parts, a store, and one failure that passes."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    stored, asked = [], []
    content = encode_part10({}, elements(PatientName="Doe"))

    class Handler(BaseHTTPRequestHandler):
        def answer(self, code, kind=None, body=b""):
            self.send_response(code)
            if kind:
                self.send_header("Content-Type", kind)
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self):
            asked.append(self.path)
            if self.path.startswith("/studies?"):
                self.answer(200, web.JSON, b'[{"00100020":{"vr":"LO","Value":["x"]}},{"00100020":{"vr":"LO","Value":3}}]')
            elif self.path.endswith("/metadata"):
                self.answer(503 if asked.count(self.path) < 3 else 200, web.JSON, b"[]")
            elif self.path.endswith("/instances/i"):
                self.answer(200, 'multipart/related; boundary="b"', binary.multipart_body([content], "b"))
            else:
                self.answer(404)

        def do_POST(self):
            stored.append(self.rfile.read(int(self.headers["Content-Length"])))
            self.answer(200, web.JSON, b"{}")

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        one = spark.range(1)
        u = lambda x: F.lit(x)
        search = one.select(F.lit("q").alias("file_id"), web.search_url(base, "studies", limit=2).alias("url"))
        assert [r.status for r in web.found(web.performed(search)).orderBy("file_id").collect()] == ["ok", "error"]
        whole = one.select(F.lit("i").alias("file_id"), web.instance_url(base, u("s"), u("t"), u("i")).alias("url"))
        got = web.retrieved(web.performed(whole))
        assert [bytes(r.content) for r in got.collect()] == [content] and part10.decode_files(got).first().status == "ok"
        again = one.select(F.lit("m").alias("file_id"), web.instance_url(base, u("s"), u("t"), u("i"), "metadata").alias("url"))
        assert web.performed(again, attempts=5).first().attempts == 3
        missing = spark.createDataFrame([("n", base + "/none"), ("w", "nonsense")], "file_id string, url string")
        assert {(r.file_id, r.code, r.status) for r in web.performed(missing).collect()} == {("n", 404, "unsuccessfulHTTPStatus"), ("w", None, "invalidHTTPResponse")}
        parts = spark.createDataFrame([("p", [content, b"2"])], "file_id string, parts array<binary>")
        assert web.performed(web.store_requests(parts, base)).first().code == 200 and stored == [binary.multipart_body([content, b"2"], "lumenframe")]
    finally:
        server.shutdown()
    with pytest.raises(ValueError, match="invalidQIDOPagination"):
        web.search_url(base, "studies", limit=0)
    with pytest.raises(ValueError, match="invalidRetryPolicy"):
        web.performed(missing, attempts=0)


def test_rendering_in_one_step(spark):
    own = decoded(spark, elements(**BASE, Columns=4, NumberOfFrames="2") | {TAG["PixelData"]: Element(TAG["PixelData"], "OW", np.arange(8, dtype="<u2").tobytes())}, elements(PatientName="x"))
    rows = lambda d: sorted((r.file_id, r.frame_index or 0, r.status, bytes(r.pixels or b"")) for r in d.collect())
    assert rows(frames.render_files(own)) == rows(frames.render(frames.frames_of(own))) and len(rows(frames.render_files(own))) == 3


def test_png():
    import struct
    import zlib

    raw = frames.png_bytes(bytes(range(24)), 2, 4, 3)
    at = raw.index(b"IDAT")
    lines = zlib.decompress(raw[at + 4 : at + 4 + struct.unpack(">I", raw[at - 4 : at])[0]])
    assert lines == b"\0" + bytes(range(12)) + b"\0" + bytes(range(12, 24)) and raw.endswith(b"IEND\xaeB`\x82")


def test_visible_pixels_equal_those_that_are_not_obscured(spark):
    """Masks in numpy against the expression, with shapes that lack numbers or vertices; a large table took 64 interpreted tests a row."""
    shape = "struct<kind:string,left:int,right:int,upper:int,lower:int,row:int,column:int,radius:int,vertices:array<struct<row:int,column:int>>>"
    corner = [(0, 0), (9, 0), (9, 7)]
    shapes = [("RECTANGULAR", 2, 7, 1, 5, 0, 0, 0, []), ("RECTANGULAR", None, 7, 1, 5, 0, 0, 0, []), ("CIRCULAR", 0, 0, 0, 0, 4, 4, 3, []), ("CIRCULAR", 0, 0, 0, 0, 4, 4, None, []), ("POLYGONAL", 0, 0, 0, 0, 0, 0, 0, corner), ("POLYGONAL", 0, 0, 0, 0, 0, 0, 0, corner[:2]), ("POLYGONAL", 0, 0, 0, 0, 0, 0, 0, [*corner, (None, 3)]), ("BITMAP", 0, 0, 0, 0, 0, 0, 0, [])]
    rows = [(k, own) for k, own in enumerate([[], *[[a, b] for a in shapes for b in shapes]])]
    df = spark.createDataFrame(rows, f"k int, shapes array<{shape}>")
    grid = F.sequence(F.lit(0), F.lit(63))
    slow = F.filter(grid, lambda i: ~pixels.obscured(F.floor(i / 8).cast("int") + 1, F.pmod(i, F.lit(8)) + 1, F.col("shapes")))
    got = df.select(slow.alias("a"), pixels.visible(F.col("shapes"), 8, 8).alias("b")).collect()
    assert len(got) == 65 and all(r.a == r.b for r in got) and any(0 < len(r.a) < 64 for r in got)


def test_batches_for_python_are_small(spark):
    """At most arrow.ROWS_PER_BATCH rows, whatever the session says, unless it says less."""
    from lumenframe import arrow

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for own, then in (("10000", 500), ("0", 500), ("70", 70)):
            spark.conf.set(key, own)
            sizes = arrow.mapped(spark.range(0, 1200, 1, 1), lambda batches: (b.slice(0, 1).set_column(0, "n", pa.array([b.num_rows])) for b in batches), "n long")
            assert max(r.n for r in sizes.collect()) == then
    finally:
        spark.conf.set(key, before)


def test_retrieve_progress_decodes_the_log_once(spark):
    """No join of the responses with their final ones, so one pass; what follows the final response does not count."""
    from lumenframe.plans import messages

    plan = messages.retrieve_progress(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Join" not in plan
    kind = "assoc_id long, seq int, command struct<command:string,responded_to:int,status:int,remaining:int,completed:int,failed:int,warning:int>"
    rows = [(1, k, ("c_get_rsp", 7, s, 9 - k, k, 0, 0)) for k, s in enumerate([0xFF00, None, 0xFF00, 0xB000, 0xFF00, 0])] + [(2, 0, ("c_move_rsp", 1, 0xFF00, 1, 0, 0, 0)), (3, 0, ("c_find_rsp", 1, 0, 1, 0, 0, 0)), (4, 5, ("c_get_rsp", 1, None, 1, 0, 0, 0))]
    got = {r.assoc_id: r for r in protocol.retrieve_progress(spark.createDataFrame(rows, kind), ["assoc_id"], "seq").collect()}
    assert [x.seq for x in got[1].progress] == [0, 2] and (got[1].final_status, got[1].category, got[1].completed) == (0xB000, "warning", 3)
    assert [x.seq for x in got[2].progress] == [0] and got[2].final_status is None and sorted(got) == [1, 2, 4] and got[4].progress == []
