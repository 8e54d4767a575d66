"""Lookups on elements: by tag, by private creator, against the dictionary; file meta information; small attribute groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.functions import pixels, values
from lumenframe.model import TAG


#: A caller's table goes to all executors as a whole up to this many rows; beyond, it is joined by a shuffle.
SMALL_ROWS = 100_000


def small(rows: DataFrame) -> DataFrame:
    """rows with a broadcast hint if they are few, as counted."""
    return F.broadcast(rows) if rows.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else rows


def last_duplicate(elements: DataFrame) -> DataFrame:
    """Of duplicate tags in one data set the last one."""
    own = ["file_id", "is_meta", "path", "tag"]
    keep = [c for c in elements.columns if c not in own]
    return elements.groupBy(*own).agg(F.max_by(F.struct(*keep), "ordinal").alias("e")).select(*own, "e.*").select(*elements.columns)


def attribute(elements: Column | str, tag: int | str) -> Column:
    """The last top-level element with a tag in a decoded file's array; no shuffle. NULL if there is none."""
    number = TAG[tag] if isinstance(tag, str) else tag
    own = F.filter(elements, lambda e: (e["tag"] == number) & (e["depth"] == 0))
    return F.when(F.size(own) > 0, F.element_at(own, -1))


def columns_of(decoded: DataFrame, names: list[str]) -> DataFrame:
    """One row per decoded file, also where it has none of them, with a column of bytes for each keyword; no shuffle."""
    return decoded.where("status = 'ok'").select("file_id", *[attribute("elements", n)["value"].alias(n) for n in names])


def pivoted(elements: DataFrame, names: list[str]) -> DataFrame:
    """One row per file with a column of bytes for each keyword, from top-level elements.

    For tables that hold elements as rows already; decoded files have columns_of, which needs no shuffle. Files with
    elements but none of these have a row of NULLs.
    """
    top = elements.where(F.col("depth") == 0)
    picks = [F.max_by(F.when(F.col("tag") == TAG[n], F.col("value")), F.when(F.col("tag") == TAG[n], F.col("ordinal"))).alias(n) for n in names]
    return top.groupBy("file_id").agg(*picks)


def tags_of(elements: DataFrame) -> DataFrame:
    """Distinct tags of each file's top-level data set, in order, and their number."""
    top = elements.where("depth = 0 and not is_meta").groupBy("file_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return top.withColumn("n", F.size("tags"))


def with_dictionary(elements: DataFrame, dictionary: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """Elements with keyword and dictionary VR; a fallback fills what the first leaves open.

    The caller's tables are broadcast if they are small, as counted.
    """
    out = elements.join(small(dictionary.select("tag", "keyword", F.col("vr").alias("dictionary_vr"))), "tag", "left")
    if fallback is None:
        return out
    other = small(fallback.select("tag", F.col("keyword").alias("keyword2"), F.col("vr").alias("vr2")))
    return out.join(other, "tag", "left").withColumns({"keyword": F.coalesce("keyword", "keyword2"), "dictionary_vr": F.coalesce("dictionary_vr", "vr2")}).drop("keyword2", "vr2")


def private_creators(elements: DataFrame) -> DataFrame:
    """(file_id, path, group_number, block, creator) of private blocks."""
    group, element = F.shiftright("tag", 16), F.pmod("tag", F.lit(65536))
    return elements.where((group % 2 == 1) & element.between(0x10, 0xFF)).select("file_id", "path", group.alias("group_number"), element.alias("block"), values.text("value").alias("creator"))


def private_elements(elements: DataFrame, creator: str, group: int, element: int) -> DataFrame:
    """Elements `element` of the lowest block that belongs to the creator, one a data set."""
    blocks = private_creators(elements).where((F.col("creator") == creator) & (F.col("group_number") == group)).groupBy("file_id", "path").agg(F.min("block").alias("block"))
    wanted = blocks.withColumn("tag", F.lit(group) * 65536 + F.col("block") * 256 + (element & 0xFF)).drop("block")
    return elements.join(wanted, ["file_id", "path", "tag"])


def with_private_creator(elements: DataFrame) -> DataFrame:
    """Elements with the creator of their private block; NULL for public tags and blocks without one."""
    group, number = F.shiftright("tag", 16), F.pmod("tag", F.lit(65536))
    own = elements.withColumn("group_number", group).withColumn("block", F.when((group % 2 == 1) & (number >= 0x1000), F.shiftright(number, 8)))
    creators = private_creators(elements).groupBy("file_id", "path", "group_number", "block").agg(F.max("creator").alias("creator"))
    return own.join(creators, ["file_id", "path", "group_number", "block"], "left").drop("group_number", "block")


def file_meta_check(files: DataFrame) -> DataFrame:
    """First problem of file meta information against its data set; NULL if there is none.

    files has media_class, media_instance, implementation, sop_class and sop_instance.
    """
    missing = F.greatest(*[(F.coalesce(F.col(c), F.lit("")) == "").cast("int") for c in ("media_class", "media_instance", "implementation")]) == 1
    problem = F.when(missing, "missingRequiredIdentifier").when(~F.col("media_class").eqNullSafe(F.col("sop_class")), "sopClassUIDMismatch").when(~F.col("media_instance").eqNullSafe(F.col("sop_instance")), "sopInstanceUIDMismatch")
    return files.withColumn("problem", problem)


def derive_file_meta(files: DataFrame, implementation_class: str, implementation_version: str | None = None) -> DataFrame:
    """Media storage identifiers from sop_class and sop_instance; the first missing one is the problem."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    problem = F.when(empty("sop_class"), "missingSOPClassUID").when(empty("sop_instance"), "missingSOPInstanceUID")
    good = problem.isNull()
    return files.withColumns({"problem": problem, "media_class": F.when(good, F.col("sop_class")), "media_instance": F.when(good, F.col("sop_instance")), "implementation": F.when(good, F.lit(implementation_class)), "implementation_version": F.when(good, F.lit(implementation_version))})


def geometry(spacing: Column, aspect: Column, position: Column, orientation: Column) -> Column:
    """A struct of arrays, each NULL unless it has its exact length; NULL if all four are absent."""
    fit = lambda c, n: F.when(F.size(c) == n, c)
    whole = F.struct(fit(spacing, 2).alias("pixel_spacing"), fit(aspect, 2).alias("pixel_aspect_ratio"), fit(position, 3).alias("image_position"), fit(orientation, 6).alias("image_orientation"))
    return F.when(F.coalesce(spacing.isNotNull() | aspect.isNotNull() | position.isNotNull() | orientation.isNotNull(), F.lit(False)), whole)


def presets(centers: Column, widths: Column, explanations: Column) -> Column:
    """Window presets; empty unless there are as many centres as widths."""
    zipped = F.transform(centers, lambda c, i: F.struct(c.alias("center"), F.get(widths, i).alias("width"), F.get(explanations, i).alias("explanation")))
    none = F.array().cast("array<struct<center:double,width:double,explanation:string>>")
    return F.when(F.size(centers) == F.size(widths), zipped).otherwise(none)


def lut_shape(shape: Column) -> Column:
    return F.when(F.upper(shape).isin("IDENTITY", "INVERSE"), F.upper(shape))


def cine(elements: Column | str) -> Column:
    """Cine attributes of a decoded file's array with the resolved frame rate; NULL if none is there."""
    raw = {n: attribute(elements, n)["value"] for n in ("FrameTime", "FrameTimeVector", "CineRate", "RecommendedDisplayFrameRate", "StartTrim", "StopTrim", "ActualFrameDuration", "PreferredPlaybackSequencing")}
    frame_time, cine_rate, recommended = values.decimal(raw["FrameTime"]), values.integer(raw["CineRate"]), values.integer(raw["RecommendedDisplayFrameRate"])
    own = {
        "frame_time": frame_time,
        "frame_time_vector": values.decimals(raw["FrameTimeVector"]),
        "cine_rate": cine_rate,
        "recommended_rate": recommended,
        "start_trim": values.integer(raw["StartTrim"]),
        "stop_trim": values.integer(raw["StopTrim"]),
        "actual_duration": values.integer(raw["ActualFrameDuration"]),
        "sequencing": values.us(raw["PreferredPlaybackSequencing"]),
    }
    some = F.coalesce(*[F.when(c.isNotNull(), F.lit(True)) for c in own.values()])
    return F.when(some, F.struct(*[c.alias(n) for n, c in own.items()], pixels.frame_rate(recommended, cine_rate, frame_time).alias("frame_rate")))


def overlays(elements: DataFrame) -> DataFrame:
    """Overlay planes of groups 6000 to 60FE that have rows, columns and data."""
    group, number = F.shiftright("tag", 16), F.pmod("tag", F.lit(65536))
    own = elements.where((F.col("depth") == 0) & group.between(0x6000, 0x60FE) & (group % 2 == 0)).withColumn("group_number", group).withColumn("number", number)
    pick = lambda n: F.max_by(F.when(F.col("number") == n, F.col("value")), F.when(F.col("number") == n, F.col("ordinal")))
    planes = own.groupBy("file_id", "group_number").agg(values.us(pick(0x10)).alias("rows"), values.us(pick(0x11)).alias("columns"), values.ss_list(pick(0x50)).alias("origin"), pick(0x3000).alias("data"))
    return planes.where("rows is not null and columns is not null and data is not null").withColumn("origin", F.when(F.size("origin") == 2, F.col("origin")))


def page(rows: DataFrame, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    """A page of rows in a total order; limit must be positive and offset not negative."""
    if limit <= 0 or offset < 0:
        raise ValueError("limit must be positive and offset not negative")
    return rows.orderBy(*order).offset(offset).limit(limit)


def fragment_offsets(fragments: DataFrame, keys: list[str], order: list[str], size: str = "size") -> DataFrame:
    """Each fragment's offset from the first one's item: eight bytes of header and the padded content before it."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return fragments.withColumn("offset", F.coalesce(F.sum(F.col(size) + F.col(size) % 2 + 8).over(before), F.lit(0)))


def fragments_to_frames(fragments: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
    """Fragments with the frame that holds them: frame i has those from its start up to the next one's.

    A running maximum over both kinds of rows in offset order, not a range join.
    """
    both = fragments.select(*keys, "offset", F.lit(None).cast("int").alias("frame"), F.lit(1).alias("kind"), F.struct(*fragments.columns).alias("row"))
    marks = starts.select(*keys, "offset", F.col("frame").cast("int"), F.lit(0).alias("kind"), F.lit(None).cast(both.schema["row"].dataType).alias("row"))
    upto = Window.partitionBy(*keys).orderBy("offset", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.unionByName(marks).withColumn("frame", F.max("frame").over(upto)).where("kind = 1").select("row.*", "frame")
