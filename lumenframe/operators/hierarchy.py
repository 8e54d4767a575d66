"""Studies, series and instances, in display order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.functions import values
from lumenframe.operators.lookup import columns_of


#: What places an instance; part10.decode_columns reads it alone.
KEYS = ["StudyInstanceUID", "SeriesInstanceUID", "SOPInstanceUID", "InstanceNumber", "ImagePositionPatient"]


def instances(decoded: DataFrame) -> DataFrame:
    """One row per decoded file: study_uid, series_uid ('' if missing), sop_uid, instance_number, position, z; no shuffle.

    decoded has elements, or the columns KEYS as part10.decode_columns gives them.
    """
    own = columns_of(decoded, KEYS) if "elements" in decoded.columns else decoded
    position = values.decimals("ImagePositionPatient")
    return own.select(
        "file_id",
        values.text("StudyInstanceUID").alias("study_uid"),
        F.coalesce(values.text("SeriesInstanceUID"), F.lit("")).alias("series_uid"),
        values.text("SOPInstanceUID").alias("sop_uid"),
        values.integer("InstanceNumber").alias("instance_number"),
        F.when(F.size(position) == 3, position).alias("position"),
    ).withColumn("z", F.get("position", F.lit(2)))


#: Display order: z of the position, instance number, UID; missing keys last, so that the order is total.
ORDER = ("z", "instance_number", "sop_uid")


def ordered(own: DataFrame, keys: list[str]) -> DataFrame:
    """Instances with their place in the series, from 1: one shuffle of slim rows and a sort that can spill."""
    order = [*[F.col(c).asc_nulls_last() for c in ORDER[:-1]], F.coalesce(F.col(ORDER[-1]), F.lit("")), F.col("file_id")]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return own.select(*keys, place.alias("place"), "file_id", "sop_uid", "instance_number", "z")


def series(own: DataFrame) -> DataFrame:
    """One row per series, by UID: the number of its instances and their UIDs in order (NULL ones left out).

    The places' partitioning serves the groups too. Files without a series UID are the series ''.
    """
    places = ordered(own, ["series_uid"])
    gathered = places.groupBy("series_uid").agg(F.count(F.lit(1)).alias("n_instances"), F.array_sort(F.collect_list(F.when(F.col("sop_uid").isNotNull(), F.struct("place", "sop_uid")))).alias("own"))
    return gathered.select("series_uid", "n_instances", F.col("own.sop_uid").alias("sop_uids")).orderBy("series_uid")


def first_frames(frames: DataFrame) -> DataFrame:
    """The first frame of each file."""
    return frames.where("frame_index = 0")
