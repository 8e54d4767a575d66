"""Module requirements: attributes that must be there (type 2) or there and not empty (type 1), with their VR."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.model import ATTRIBUTES
from lumenframe.operators.deidentify import listed
from lumenframe.operators.lookup import last_duplicate

# Attributes that the common image IODs share (PS3.3), with their types.
COMMON_IMAGE = (
    ("SOPClassUID", 1),
    ("SOPInstanceUID", 1),
    ("Modality", 1),
    ("PatientName", 2),
    ("PatientID", 2),
    ("StudyInstanceUID", 1),
    ("SeriesInstanceUID", 1),
    ("Rows", 1),
    ("Columns", 1),
    ("BitsAllocated", 1),
    ("BitsStored", 1),
    ("HighBit", 1),
    ("PixelRepresentation", 1),
    ("PixelData", 1),
)
IODS = {"ct_image": COMMON_IMAGE, "mr_image": COMMON_IMAGE, "sc_image": COMMON_IMAGE}


def requirements(spark: SparkSession, attributes=COMMON_IMAGE) -> DataFrame:
    """(ordinal, tag, vr, type)."""
    rows = [(k, ATTRIBUTES[n][0], ATTRIBUTES[n][1], kind) for k, (n, kind) in enumerate(attributes)]
    return spark.createDataFrame(rows, "ordinal int, tag long, vr string, type int")


def issues(files: DataFrame, elements: DataFrame, needed: DataFrame) -> DataFrame:
    """(file_id, ordinal, tag, kind, expected_vr, actual_vr): the first problem of each requirement that a file misses.

    The requirements are a short list that goes with every file as one array, so nothing is multiplied out beyond the
    files' own elements that the list names.
    """
    rules = listed(needed.orderBy("ordinal"))
    top = last_duplicate(elements.where("depth = 0 and not is_meta").where(F.col("tag").isin([r["tag"] for r in rules])).select("file_id", "is_meta", "path", "ordinal", "tag", "vr", "value", "item_count"))
    have = top.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("tag", F.struct("vr", F.coalesce("item_count", F.length("value")).alias("size"))))).alias("have"))
    every = files.select("file_id").distinct().join(have, "file_id", "left")
    wanted = F.array(*[F.struct(F.lit(r["ordinal"]).alias("ordinal"), F.lit(r["tag"]).cast("long").alias("tag"), F.lit(r["vr"]).alias("vr"), F.lit(r["type"]).alias("type")) for r in rules])
    one = every.select("file_id", "have", F.explode(wanted).alias("r")).select("file_id", "r.*", F.try_element_at("have", F.col("r.tag")).alias("e"))
    kind = F.when(F.col("e").isNull(), "missing").when(F.col("e.vr") != F.col("vr"), "unexpectedVR").when((F.col("type") == 1) & (F.col("e.size") == 0), "empty")
    wrong = kind == "unexpectedVR"
    return one.withColumn("kind", kind).where("kind is not null").select("file_id", "ordinal", "tag", "kind", F.when(wrong, F.col("vr")).alias("expected_vr"), F.when(wrong, F.col("e.vr")).alias("actual_vr"))
