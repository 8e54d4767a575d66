"""Data model: tags, value representations, transfer syntaxes, SOP classes, schemas.

A tag is one number, group * 65536 + element, so numeric order is tag order. Nested data sets are rows too: `path`
lists the (sequence tag, item index) pairs that lead to an element.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Value representations of PS3.5, those with a 32-bit length, and byte widths of numeric ones.
VRS = frozenset("AE AS AT CS DA DS DT FD FL IS LO LT OB OD OF OL OV OW PN SH SL SQ SS ST SV TM UC UI UL UN UR US UT UV".split())
LONG_VRS = frozenset("OB OD OF OL OV OW SQ SV UC UN UR UT UV".split())
SWAP_WIDTH = {"US": 2, "SS": 2, "OW": 2, "AT": 2, "UL": 4, "SL": 4, "FL": 4, "OL": 4, "OF": 4, "UV": 8, "SV": 8, "FD": 8, "OD": 8, "OV": 8}
TEXT_VRS = frozenset("AE AS CS DA DS DT IS LO LT SH ST TM UC UI UR UT".split())
BINARY_VRS = frozenset("OB OD OF OL OV OW UN".split())

# Transfer syntaxes of PS3.5/PS3.6: name, explicit VR, big endian, deflated, encapsulated.
TRANSFER_SYNTAXES = {
    "1.2.840.10008.1.2": ("implicit_le", False, False, False, False),
    "1.2.840.10008.1.2.1": ("explicit_le", True, False, False, False),
    "1.2.840.10008.1.2.1.99": ("deflated_le", True, False, True, False),
    "1.2.840.10008.1.2.2": ("explicit_be", True, True, False, False),
    "1.2.840.10008.1.2.5": ("rle", True, False, False, True),
    "1.2.840.10008.1.2.4.50": ("jpeg_baseline", True, False, False, True),
    "1.2.840.10008.1.2.4.57": ("jpeg_lossless", True, False, False, True),
    "1.2.840.10008.1.2.4.70": ("jpeg_lossless_sv1", True, False, False, True),
    "1.2.840.10008.1.2.4.80": ("jpeg_ls", True, False, False, True),
    "1.2.840.10008.1.2.4.81": ("jpeg_ls_near", True, False, False, True),
    "1.2.840.10008.1.2.4.90": ("jpeg_2000_lossless", True, False, False, True),
    "1.2.840.10008.1.2.4.91": ("jpeg_2000", True, False, False, True),
}
IMPLICIT_LE, EXPLICIT_LE, DEFLATED_LE, EXPLICIT_BE, RLE = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.1.99", "1.2.840.10008.1.2.2", "1.2.840.10008.1.2.5"

# SOP classes of PS3.6 with whether they store images.
SOP_CLASSES = {
    "verification": ("1.2.840.10008.1.1", False),
    "patient_root_find": ("1.2.840.10008.5.1.4.1.2.1.1", False),
    "patient_root_move": ("1.2.840.10008.5.1.4.1.2.1.2", False),
    "patient_root_get": ("1.2.840.10008.5.1.4.1.2.1.3", False),
    "study_root_find": ("1.2.840.10008.5.1.4.1.2.2.1", False),
    "study_root_move": ("1.2.840.10008.5.1.4.1.2.2.2", False),
    "study_root_get": ("1.2.840.10008.5.1.4.1.2.2.3", False),
    "modality_worklist_find": ("1.2.840.10008.5.1.4.31", False),
    "cr_image": ("1.2.840.10008.5.1.4.1.1.1", True),
    "dx_image_presentation": ("1.2.840.10008.5.1.4.1.1.1.1", True),
    "dx_image_processing": ("1.2.840.10008.5.1.4.1.1.1.1.1", True),
    "mg_image_presentation": ("1.2.840.10008.5.1.4.1.1.1.2", True),
    "mg_image_processing": ("1.2.840.10008.5.1.4.1.1.1.2.1", True),
    "ct_image": ("1.2.840.10008.5.1.4.1.1.2", True),
    "enhanced_ct_image": ("1.2.840.10008.5.1.4.1.1.2.1", True),
    "us_multiframe_image": ("1.2.840.10008.5.1.4.1.1.3.1", True),
    "mr_image": ("1.2.840.10008.5.1.4.1.1.4", True),
    "enhanced_mr_image": ("1.2.840.10008.5.1.4.1.1.4.1", True),
    "us_image": ("1.2.840.10008.5.1.4.1.1.6.1", True),
    "sc_image": ("1.2.840.10008.5.1.4.1.1.7", True),
    "grayscale_presentation_state": ("1.2.840.10008.5.1.4.1.1.11.1", False),
    "xa_image": ("1.2.840.10008.5.1.4.1.1.12.1", True),
    "rf_image": ("1.2.840.10008.5.1.4.1.1.12.2", True),
    "nm_image": ("1.2.840.10008.5.1.4.1.1.20", True),
    "segmentation": ("1.2.840.10008.5.1.4.1.1.66.4", True),
    "basic_text_sr": ("1.2.840.10008.5.1.4.1.1.88.11", False),
    "enhanced_sr": ("1.2.840.10008.5.1.4.1.1.88.22", False),
    "comprehensive_sr": ("1.2.840.10008.5.1.4.1.1.88.33", False),
    "encapsulated_pdf": ("1.2.840.10008.5.1.4.1.1.104.1", False),
    "pet_image": ("1.2.840.10008.5.1.4.1.1.128", True),
    "rt_image": ("1.2.840.10008.5.1.4.1.1.481.1", True),
    "rt_dose": ("1.2.840.10008.5.1.4.1.1.481.2", True),
    "ophthalmic_photo_8bit": ("1.2.840.10008.5.1.4.1.1.77.1.5.1", True),
}

# Attributes that the operators use and the most common others (PS3.6): keyword, tag, VR.
ATTRIBUTES = {
    "FileMetaInformationGroupLength": (0x00020000, "UL"),
    "FileMetaInformationVersion": (0x00020001, "OB"),
    "MediaStorageSOPClassUID": (0x00020002, "UI"),
    "MediaStorageSOPInstanceUID": (0x00020003, "UI"),
    "TransferSyntaxUID": (0x00020010, "UI"),
    "ImplementationClassUID": (0x00020012, "UI"),
    "ImplementationVersionName": (0x00020013, "SH"),
    "FileSetID": (0x00041130, "CS"),
    "OffsetOfTheFirstDirectoryRecordOfTheRootDirectoryEntity": (0x00041200, "UL"),
    "DirectoryRecordSequence": (0x00041220, "SQ"),
    "OffsetOfTheNextDirectoryRecord": (0x00041400, "UL"),
    "OffsetOfReferencedLowerLevelDirectoryEntity": (0x00041420, "UL"),
    "DirectoryRecordType": (0x00041430, "CS"),
    "ReferencedFileID": (0x00041500, "CS"),
    "ReferencedSOPClassUIDInFile": (0x00041510, "UI"),
    "ReferencedSOPInstanceUIDInFile": (0x00041511, "UI"),
    "SpecificCharacterSet": (0x00080005, "CS"),
    "ImageType": (0x00080008, "CS"),
    "SOPClassUID": (0x00080016, "UI"),
    "SOPInstanceUID": (0x00080018, "UI"),
    "StudyDate": (0x00080020, "DA"),
    "SeriesDate": (0x00080021, "DA"),
    "AcquisitionDate": (0x00080022, "DA"),
    "ContentDate": (0x00080023, "DA"),
    "AcquisitionDateTime": (0x0008002A, "DT"),
    "StudyTime": (0x00080030, "TM"),
    "SeriesTime": (0x00080031, "TM"),
    "AcquisitionTime": (0x00080032, "TM"),
    "ContentTime": (0x00080033, "TM"),
    "AccessionNumber": (0x00080050, "SH"),
    "Modality": (0x00080060, "CS"),
    "ConversionType": (0x00080064, "CS"),
    "Manufacturer": (0x00080070, "LO"),
    "InstitutionName": (0x00080080, "LO"),
    "ReferringPhysicianName": (0x00080090, "PN"),
    "CodeValue": (0x00080100, "SH"),
    "CodingSchemeDesignator": (0x00080102, "SH"),
    "CodeMeaning": (0x00080104, "LO"),
    "StationName": (0x00081010, "SH"),
    "StudyDescription": (0x00081030, "LO"),
    "ProcedureCodeSequence": (0x00081032, "SQ"),
    "SeriesDescription": (0x0008103E, "LO"),
    "PhysiciansOfRecord": (0x00081048, "PN"),
    "PerformingPhysicianName": (0x00081050, "PN"),
    "NameOfPhysiciansReadingStudy": (0x00081060, "PN"),
    "OperatorsName": (0x00081070, "PN"),
    "ManufacturerModelName": (0x00081090, "LO"),
    "ReferencedStudySequence": (0x00081110, "SQ"),
    "ReferencedSeriesSequence": (0x00081115, "SQ"),
    "ReferencedImageSequence": (0x00081140, "SQ"),
    "ReferencedSOPClassUID": (0x00081150, "UI"),
    "ReferencedSOPInstanceUID": (0x00081155, "UI"),
    "ReferencedFrameNumber": (0x00081160, "IS"),
    "DerivationDescription": (0x00082111, "ST"),
    "SourceImageSequence": (0x00082112, "SQ"),
    "StartTrim": (0x00082142, "IS"),
    "StopTrim": (0x00082143, "IS"),
    "RecommendedDisplayFrameRate": (0x00082144, "IS"),
    "PatientName": (0x00100010, "PN"),
    "PatientID": (0x00100020, "LO"),
    "PatientBirthDate": (0x00100030, "DA"),
    "PatientBirthTime": (0x00100032, "TM"),
    "PatientSex": (0x00100040, "CS"),
    "OtherPatientIDs": (0x00101000, "LO"),
    "OtherPatientNames": (0x00101001, "PN"),
    "PatientAge": (0x00101010, "AS"),
    "PatientSize": (0x00101020, "DS"),
    "PatientWeight": (0x00101030, "DS"),
    "PatientAddress": (0x00101040, "LO"),
    "PatientTelephoneNumbers": (0x00102154, "SH"),
    "BodyPartExamined": (0x00180015, "CS"),
    "CineRate": (0x00180040, "IS"),
    "SliceThickness": (0x00180050, "DS"),
    "KVP": (0x00180060, "DS"),
    "RepetitionTime": (0x00180080, "DS"),
    "EchoTime": (0x00180081, "DS"),
    "ProtocolName": (0x00181030, "LO"),
    "FrameTime": (0x00181063, "DS"),
    "FrameTimeVector": (0x00181065, "DS"),
    "ActualFrameDuration": (0x00181242, "IS"),
    "PreferredPlaybackSequencing": (0x00181244, "US"),
    "ShutterShape": (0x00181600, "CS"),
    "ShutterLeftVerticalEdge": (0x00181602, "IS"),
    "ShutterRightVerticalEdge": (0x00181604, "IS"),
    "ShutterUpperHorizontalEdge": (0x00181606, "IS"),
    "ShutterLowerHorizontalEdge": (0x00181608, "IS"),
    "CenterOfCircularShutter": (0x00181610, "IS"),
    "RadiusOfCircularShutter": (0x00181612, "IS"),
    "VerticesOfThePolygonalShutter": (0x00181620, "IS"),
    "ShutterPresentationValue": (0x00181622, "US"),
    "ShutterOverlayGroup": (0x00181623, "US"),
    "StudyInstanceUID": (0x0020000D, "UI"),
    "SeriesInstanceUID": (0x0020000E, "UI"),
    "StudyID": (0x00200010, "SH"),
    "SeriesNumber": (0x00200011, "IS"),
    "AcquisitionNumber": (0x00200012, "IS"),
    "InstanceNumber": (0x00200013, "IS"),
    "ImagePositionPatient": (0x00200032, "DS"),
    "ImageOrientationPatient": (0x00200037, "DS"),
    "FrameOfReferenceUID": (0x00200052, "UI"),
    "SliceLocation": (0x00201041, "DS"),
    "ImageComments": (0x00204000, "LT"),
    "FrameContentSequence": (0x00209111, "SQ"),
    "PlanePositionSequence": (0x00209113, "SQ"),
    "PlaneOrientationSequence": (0x00209116, "SQ"),
    "SamplesPerPixel": (0x00280002, "US"),
    "PhotometricInterpretation": (0x00280004, "CS"),
    "PlanarConfiguration": (0x00280006, "US"),
    "NumberOfFrames": (0x00280008, "IS"),
    "Rows": (0x00280010, "US"),
    "Columns": (0x00280011, "US"),
    "PixelSpacing": (0x00280030, "DS"),
    "PixelAspectRatio": (0x00280034, "IS"),
    "BitsAllocated": (0x00280100, "US"),
    "BitsStored": (0x00280101, "US"),
    "HighBit": (0x00280102, "US"),
    "PixelRepresentation": (0x00280103, "US"),
    "PixelPaddingValue": (0x00280120, "US"),
    "PixelPaddingRangeLimit": (0x00280121, "US"),
    "WindowCenter": (0x00281050, "DS"),
    "WindowWidth": (0x00281051, "DS"),
    "RescaleIntercept": (0x00281052, "DS"),
    "RescaleSlope": (0x00281053, "DS"),
    "WindowCenterWidthExplanation": (0x00281055, "LO"),
    "RedPaletteColorLookupTableDescriptor": (0x00281101, "US"),
    "GreenPaletteColorLookupTableDescriptor": (0x00281102, "US"),
    "BluePaletteColorLookupTableDescriptor": (0x00281103, "US"),
    "RedPaletteColorLookupTableData": (0x00281201, "OW"),
    "GreenPaletteColorLookupTableData": (0x00281202, "OW"),
    "BluePaletteColorLookupTableData": (0x00281203, "OW"),
    "ICCProfile": (0x00282000, "OB"),
    "LossyImageCompression": (0x00282110, "CS"),
    "ModalityLUTSequence": (0x00283000, "SQ"),
    "LUTDescriptor": (0x00283002, "US"),
    "LUTExplanation": (0x00283003, "LO"),
    "ModalityLUTType": (0x00283004, "LO"),
    "LUTData": (0x00283006, "OW"),
    "VOILUTSequence": (0x00283010, "SQ"),
    "SoftcopyVOILUTSequence": (0x00283110, "SQ"),
    "PixelMeasuresSequence": (0x00289110, "SQ"),
    "FrameVOILUTSequence": (0x00289132, "SQ"),
    "PixelValueTransformationSequence": (0x00289145, "SQ"),
    "RequestingPhysician": (0x00321032, "PN"),
    "AdmissionID": (0x00380010, "LO"),
    "ScheduledPerformingPhysicianName": (0x00400006, "PN"),
    "PerformedProcedureStepStartDate": (0x00400244, "DA"),
    "PerformedProcedureStepStartTime": (0x00400245, "TM"),
    "RequestAttributesSequence": (0x00400275, "SQ"),
    "ValueType": (0x0040A040, "CS"),
    "ConceptNameCodeSequence": (0x0040A043, "SQ"),
    "TextValue": (0x0040A160, "UT"),
    "ContentSequence": (0x0040A730, "SQ"),
    "RadiopharmaceuticalInformationSequence": (0x00540016, "SQ"),
    "SegmentationType": (0x00620001, "CS"),
    "SegmentSequence": (0x00620002, "SQ"),
    "GraphicAnnotationSequence": (0x00700001, "SQ"),
    "GraphicLayer": (0x00700002, "CS"),
    "BoundingBoxAnnotationUnits": (0x00700003, "CS"),
    "AnchorPointAnnotationUnits": (0x00700004, "CS"),
    "GraphicAnnotationUnits": (0x00700005, "CS"),
    "UnformattedTextValue": (0x00700006, "ST"),
    "TextObjectSequence": (0x00700008, "SQ"),
    "GraphicObjectSequence": (0x00700009, "SQ"),
    "BoundingBoxTopLeftHandCorner": (0x00700010, "FL"),
    "BoundingBoxBottomRightHandCorner": (0x00700011, "FL"),
    "AnchorPoint": (0x00700014, "FL"),
    "AnchorPointVisibility": (0x00700015, "CS"),
    "GraphicDimensions": (0x00700020, "US"),
    "NumberOfGraphicPoints": (0x00700021, "US"),
    "GraphicData": (0x00700022, "FL"),
    "GraphicType": (0x00700023, "CS"),
    "GraphicFilled": (0x00700024, "CS"),
    "ImageHorizontalFlip": (0x00700041, "CS"),
    "ImageRotation": (0x00700042, "US"),
    "DisplayedAreaTopLeftHandCorner": (0x00700052, "SL"),
    "DisplayedAreaBottomRightHandCorner": (0x00700053, "SL"),
    "DisplayedAreaSelectionSequence": (0x0070005A, "SQ"),
    "GraphicLayerSequence": (0x00700060, "SQ"),
    "GraphicLayerOrder": (0x00700062, "IS"),
    "GraphicLayerRecommendedDisplayGrayscaleValue": (0x00700066, "US"),
    "GraphicLayerDescription": (0x00700068, "LO"),
    "ContentLabel": (0x00700080, "CS"),
    "ContentDescription": (0x00700081, "LO"),
    "PresentationSizeMode": (0x00700100, "CS"),
    "PresentationPixelSpacing": (0x00700101, "DS"),
    "PresentationPixelAspectRatio": (0x00700102, "IS"),
    "PresentationPixelMagnificationRatio": (0x00700103, "FL"),
    "PresentationLUTShape": (0x20500020, "CS"),
    "SharedFunctionalGroupsSequence": (0x52009229, "SQ"),
    "PerFrameFunctionalGroupsSequence": (0x52009230, "SQ"),
    "ExtendedOffsetTable": (0x7FE00001, "OV"),
    "FloatPixelData": (0x7FE00008, "OF"),
    "DoubleFloatPixelData": (0x7FE00009, "OD"),
    "PixelData": (0x7FE00010, "OW"),
}
TAG = {name: tag for name, (tag, _) in ATTRIBUTES.items()}
BUILT_IN_VRS = {tag: vr for tag, vr in ATTRIBUTES.values()}
ITEM, ITEM_END, SEQUENCE_END = 0xFFFEE000, 0xFFFEE00D, 0xFFFEE0DD
UNDEFINED = 0xFFFFFFFF
MAX_CHILD = 2**31 - 1


#: Elements of the overlay groups 6000 to 60FE (PS3.6).
OVERLAY_VRS = {0x0010: "US", 0x0011: "US", 0x0015: "IS", 0x0022: "LO", 0x0040: "CS", 0x0045: "LO", 0x0050: "SS", 0x0051: "US", 0x0100: "US", 0x0102: "US", 0x1301: "IS", 0x1302: "DS", 0x1303: "DS", 0x1500: "LO", 0x3000: "OW"}


def ruled_vr(tag: int) -> str | None:
    """The VR of a tag that follows from a rule: group lengths, private creators, repeating overlay groups."""
    group, number = tag >> 16, tag & 0xFFFF
    if number == 0:
        return "UL"
    if group % 2 and 0x10 <= number <= 0xFF:
        return "LO"
    return OVERLAY_VRS.get(number) if 0x6000 <= group <= 0x60FE and not group % 2 else None


def tag_text(tag: int) -> str:
    return f"({tag >> 16:04X},{tag & 0xFFFF:04X})"


def dictionary(extra: dict[int, str] | None = None) -> dict[int, str]:
    """VR by tag: the built-in attributes over `extra`, say the whole table 6-1 of PS3.6 read from a file."""
    return {**(extra or {}), **BUILT_IN_VRS}


def read_dictionary(path: str) -> dict[int, str]:
    """A dictionary from lines of 'GGGGEEEE VR'; tags with several VRs or wild cards are left out."""
    out: dict[int, str] = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            parts = line.split()
            if len(parts) == 2 and len(parts[0]) == 8 and parts[1] in VRS and all(c in "0123456789abcdefABCDEF" for c in parts[0]):
                out[int(parts[0], 16)] = parts[1]
    return out


def dictionary_dim(spark: SparkSession, extra: dict[int, str] | None = None) -> DataFrame:
    """(tag, keyword, vr) of the dictionary, for broadcast joins; built-in rows win."""
    names = {tag: name for name, tag in TAG.items()}
    return spark.createDataFrame([(t, names.get(t), v) for t, v in sorted(dictionary(extra).items())], "tag long, keyword string, vr string")


def transfer_syntax_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(uid, *row) for uid, row in TRANSFER_SYNTAXES.items()], "uid string, name string, explicit boolean, big_endian boolean, deflated boolean, encapsulated boolean")


def vr_dim(spark: SparkSession) -> DataFrame:
    kind = lambda v: "sequence" if v == "SQ" else "binary" if v in BINARY_VRS else "text" if v in TEXT_VRS or v == "PN" else "number"
    return spark.createDataFrame([(v, v in LONG_VRS, kind(v)) for v in sorted(VRS)], "vr string, long_length boolean, kind string")


def sop_class_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, u, i) for n, (u, i) in SOP_CLASSES.items()], "name string, uid string, image_storage boolean")


# Defined terms of Specific Character Set and Python's names of the encodings.
CHARACTER_SETS = {"": "utf-8", "ISO_IR 6": "utf-8", "ISO_IR 192": "utf-8", "ISO_IR 100": "latin-1", "ISO_IR 13": "shift_jis", "ISO 2022 IR 87": "iso2022_jp"}

PATH = T.ArrayType(T.StructType([T.StructField("tag", T.LongType()), T.StructField("item", T.IntegerType())]))
ELEMENT = T.StructType(
    [
        T.StructField("is_meta", T.BooleanType()),
        T.StructField("path", PATH),
        T.StructField("depth", T.IntegerType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("tag", T.LongType()),
        T.StructField("tag_hex", T.StringType()),
        T.StructField("vr", T.StringType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("item_count", T.IntegerType()),
        T.StructField("item_offsets", T.ArrayType(T.LongType())),
        T.StructField("fragments", T.ArrayType(T.BinaryType())),
        T.StructField("fragment_offsets", T.ArrayType(T.LongType())),
        T.StructField("bot", T.BinaryType()),
        T.StructField("value_offset", T.LongType()),
        T.StructField("value_length", T.LongType()),
        T.StructField("fragment_ranges", T.ArrayType(T.StructType([T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())]))),
    ]
)
