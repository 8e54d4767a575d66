"""Registered queries: each takes (spark, sf_dir) and runs operators of this library over data made from the tables.

A round trip shows that writer and reader agree with each other; that they agree with the standard is what the golden
vectors in the tests show.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe import model, protocol
from lumenframe.arrow import small_batches
from lumenframe.functions import pixels, values
from lumenframe.model import TAG
from lumenframe.operators import deidentify, directory, frames, hierarchy, lookup, presentation, validate
from lumenframe.plans.registry import QUERIES, Query, query
from lumenframe.plans.sql import SQL
from lumenframe.plans.tables import bytes_text, customers, decoded_customers, image_files, images, raw_bytes, spread, table, text, with_doubles, words_bytes
from lumenframe.sources import dicom_json, part10

def round_trip(syntax: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = part10.encode_arrays(customers(spark, sf_dir), syntax)
        own = part10.decode_columns(files, ["PatientName", "PatientID", "PatientWeight", "Rows", "InstitutionName"])
        return own.select(values.text("PatientID").cast("long").alias("c_custkey"), values.text("PatientName").alias("c_name"), values.text("InstitutionName").alias("c_mktsegment"), F.round(values.decimal("PatientWeight") * 100).cast("long").alias("cents"), (values.us("Rows") - 1).alias("c_nationkey"))

    return run


for _name, _syntax in (("explicit_le", model.EXPLICIT_LE), ("implicit_le", model.IMPLICIT_LE), ("explicit_be", model.EXPLICIT_BE), ("deflated_le", model.DEFLATED_LE)):
    QUERIES[f"part10_roundtrip_{_name}"] = round_trip(_syntax)


@query
def raw_dataset_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = part10.encode_arrays(customers(spark, sf_dir), model.IMPLICIT_LE, dataset_only=True)
    decoded = part10.decode_files(raw, transfer_syntax=model.IMPLICIT_LE)
    name = lookup.attribute("elements", "PatientName")["value"]
    return decoded.select(F.col("file_id").cast("long").alias("c_custkey"), values.text(name).alias("c_name"), F.size("elements").cast("long").alias("n_elements"))


@query
def decode_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files cut short, without preamble or with an unknown transfer syntax become error rows."""
    whole = part10.encode_arrays(customers(spark, sf_dir))
    kind = F.pmod(F.col("file_id").cast("long"), F.lit(4))
    uid, bad = F.lit("312E322E3834302E31303030382E312E322E31"), F.lit("312E322E3834302E31303030382E312E322E39")
    broken = F.when(kind == 1, F.expr("substring(content, 1, length(content) - 3)")).when(kind == 2, F.expr("substring(content, 2, length(content))")).when(kind == 3, F.unhex(F.replace(F.hex("content"), uid, bad))).otherwise(F.col("content"))
    return part10.files_of(part10.decode_files(whole.withColumn("content", broken))).select(F.col("file_id").cast("long").alias("c_custkey"), "status", "error_kind")


@query
def hierarchy_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as instances: orders are series, the position's z is the quantity."""
    li = table(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("int"))
    uid = F.concat_ws(".", F.lit("1.2"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    files = spread(li, "l_orderkey").select(uid.alias("file_id"), part10.data_set({"SOPInstanceUID": text(uid), "StudyInstanceUID": text(F.lit("1.2")), "SeriesInstanceUID": text("l_orderkey"), "InstanceNumber": text("l_linenumber"), "ImagePositionPatient": text(F.concat(F.lit("0\\0\\"), F.col("q")))}).alias("elements"))
    own = hierarchy.instances(part10.decode_columns(part10.encode_arrays(files), hierarchy.KEYS))
    return hierarchy.ordered(own, ["study_uid", "series_uid"]).select(F.col("series_uid").cast("long").alias("l_orderkey"), F.col("place").cast("long").alias("place"), F.col("instance_number").alias("l_linenumber"))


@query
def series_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = hierarchy.instances(part10.decode_columns(part10.encode_arrays(customers(spark, sf_dir)), hierarchy.KEYS))
    return hierarchy.series(own).select("series_uid", F.col("n_instances").cast("long"), F.array_join("sop_uids", ",").alias("sop_uids"))


@query
def deid_basic_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lookup.columns_of(deidentify.apply_to_files(decoded_customers(spark, sf_dir, model.EXPLICIT_LE), deidentify.basic_profile(spark)), ["PatientName", "PatientID", "InstitutionName", "SOPInstanceUID", "Rows"])
    return own.select(F.col("file_id").cast("long").alias("c_custkey"), values.text("PatientName").alias("name"), values.text("PatientID").alias("id"), values.text("InstitutionName").alias("institution"), values.text("SOPInstanceUID").alias("uid"), values.us("Rows").alias("rows"))


@query
def module_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers lack most image attributes; every third has an empty modality, every fifth no name."""
    c = spread(table(spark, sf_dir, "customer"), "c_custkey")
    third, fifth = F.pmod("c_custkey", F.lit(3)) == 0, F.pmod("c_custkey", F.lit(5)) == 0
    files = c.select(
        F.col("c_custkey").cast("string").alias("file_id"),
        F.array_compact(
            F.array(
                part10.element(TAG["Modality"], "CS", F.when(third, F.lit(b"")).otherwise(text(F.lit("CT")))),
                part10.element(TAG["PatientName"], "PN", F.when(~fifth, text("c_name")), ordinal=1),
                part10.element(TAG["PatientID"], "SH", text("c_custkey"), ordinal=2),
                part10.element(TAG["Rows"], "US", values.us_bytes(F.lit(4)), ordinal=3),
            )
        ).alias("elements"),
    )
    decoded = part10.decode_files(part10.encode_arrays(files))
    needed = validate.requirements(spark, [("Modality", 1), ("PatientName", 2), ("PatientID", 2), ("Rows", 1), ("Columns", 1)])
    found = validate.issues(part10.files_of(decoded), part10.elements_of(decoded), needed)
    return found.select(F.col("file_id").cast("long").alias("c_custkey"), F.col("ordinal").cast("long").alias("ordinal"), "kind", "expected_vr", "actual_vr")


@query
def directory_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and suppliers as linked records: siblings and children by offset."""
    nodes = directory_nodes(spark, sf_dir)
    tree = directory.directory_tree(nodes)
    return tree.select("offset", F.col("level").cast("long").alias("level"), F.col("parent_offset").cast("string").alias("parent_offset"))


def directory_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1).cast("long").alias("offset"), F.lit(0).cast("long").alias("parent"))
    nation = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 101).cast("long").alias("offset"), (F.col("n_regionkey") + 1).cast("long").alias("parent"))
    supplier = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1000).cast("long").alias("offset"), (F.col("s_nationkey") + 101).cast("long").alias("parent"))
    every = region.unionByName(nation).unionByName(supplier)
    children = every.groupBy("parent").agg(F.array_sort(F.collect_list("offset")).alias("own"))
    siblings = children.select("parent", F.posexplode("own").alias("i", "offset"), "own").select("offset", "parent", F.coalesce(F.get("own", F.col("i") + 1), F.lit(0)).alias("next_offset"))
    first = children.select(F.col("parent").alias("offset"), F.get("own", F.lit(0)).alias("child_offset"))
    return siblings.join(first, "offset", "left").select(F.lit("dir").alias("file_id"), F.lit("ok").alias("status"), F.lit(1).cast("long").alias("root_offset"), "offset", "next_offset", F.coalesce("child_offset", F.lit(0)).cast("long").alias("child_offset"))


@query
def fragment_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as fragments of orders: sizes are quantities."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("size"))
    return lookup.fragment_offsets(li, ["l_orderkey"], ["l_linenumber", "l_partkey", "size"]).select("l_orderkey", "l_linenumber", "l_partkey", "size", "offset")


@query
def fragments_to_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of two fragments each, by their offset tables."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("long").alias("size"))
    own = lookup.fragment_offsets(li, ["l_orderkey"], ["l_linenumber"])
    numbered = own.where(F.pmod("l_linenumber", F.lit(2)) == 1).select("l_orderkey", "offset", F.floor(F.col("l_linenumber") / 2).alias("frame"))
    return lookup.fragments_to_frames(own, numbered, ["l_orderkey"]).select("l_orderkey", "l_linenumber", F.col("frame").cast("string").alias("frame"))


@query
def scoped_voi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers pick their nation's window, else the first that holds for all; even nations have their own."""
    n = table(spark, sf_dir, "nation")
    own = n.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("ordinal"), F.array(F.col("n_nationkey").cast("string")).alias("refs"), (F.col("n_nationkey") * 10).cast("long").alias("center"))
    general = n.where("n_nationkey % 7 = 3").select(F.col("n_nationkey").alias("ordinal"), F.array().cast("array<string>").alias("refs"), (F.col("n_nationkey") + 5000).cast("long").alias("center"))
    items = own.unionByName(general).withColumn("state", F.lit(1))
    targets = table(spark, sf_dir, "customer").select(F.lit(1).alias("state"), "c_custkey", F.col("c_nationkey").cast("string").alias("uid"))
    return presentation.scoped(F.broadcast(items), targets, ["state"], "uid").select("c_custkey", F.col("uid").cast("int").alias("c_nationkey"), "center")


@query
def window_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = images(spark, sf_dir)
    return own.select("vec_id", F.array_join(pixels.windowed(F.col("samples"), F.lit(1000.0), F.lit(600.0)), ",").alias("pixels"))


@query
def auto_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = images(spark, sf_dir)
    window = pixels.auto_window(F.col("samples"), F.lit(950), F.lit(1050))
    return own.select("vec_id", F.round(window["center"] * 2).cast("long").alias("twice_center"), F.round(window["width"]).cast("long").alias("width"))


@query
def rendered_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images written, read, assembled to frames and rendered with the data's own window and polarity."""
    shown = frames.render(frames.frames_of(part10.decode_files(part10.encode_arrays(image_files(spark, sf_dir)))))
    return shown.select(F.col("file_id").cast("long").alias("vec_id"), "status", bytes_text(F.col("pixels")).alias("pixels"))


@query
def stored_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve bits of wider numbers, read as signed, then rescaled."""
    wide = F.transform("samples", lambda x: x * 13)
    own = pixels.rescaled(pixels.stored(wide, F.lit(12), F.lit(True)), F.lit(2), F.lit(-100))
    return images(spark, sf_dir).select("vec_id", F.array_join(own, ",").alias("numbers"))


@query
def lut_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A modality table over the stored values, then a VOI table to eight bits."""
    entries = F.lit([i * i for i in range(100)])
    modality = pixels.looked_up(F.transform("samples", lambda x: F.floor(x / 20)), F.lit(10), entries)
    shown = pixels.voi_looked_up(modality, F.lit(100), F.lit(list(range(4001))), F.lit(12))
    return images(spark, sf_dir).select("vec_id", F.array_join(shown, ",").alias("pixels"))


@query
def ybr_to_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples of each vector by threes."""
    part = lambda i: F.pmod(F.element_at("samples", i), F.lit(256)).cast("double")
    firsts = F.filter(F.sequence(F.lit(1), F.size("samples")), lambda i: (i % 3 == 1) & (i + 2 <= F.size("samples")))
    rgb = F.transform(firsts, lambda i: pixels.fixed_point_ybr(part(i), part(i + 1), part(i + 2)))
    own = images(spark, sf_dir).select("vec_id", rgb.alias("rgb"))
    return own.select("vec_id", *[F.array_join(F.col("rgb")[c], ",").alias(c) for c in ("red", "green", "blue")])


@query
def shutter_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An 8 x 8 grid a part: a rectangle by size, a circle and a triangle; how many pixels stay visible."""
    whole = "struct<kind:string,left:int,right:int,upper:int,lower:int,row:int,column:int,radius:int,vertices:array<struct<row:int,column:int>>>"
    rectangle = F.expr("named_struct('kind','RECTANGULAR','left',1 + p_size % 3,'right',8 - p_size % 2,'upper',1,'lower',4 + p_size % 5,'row',0,'column',0,'radius',0,'vertices',cast(array() as array<struct<row:int,column:int>>))").cast(whole)
    circle = F.expr("named_struct('kind','CIRCULAR','left',0,'right',0,'upper',0,'lower',0,'row',4,'column',4,'radius',3 + p_size % 3,'vertices',cast(array() as array<struct<row:int,column:int>>))").cast(whole)
    triangle = F.expr("named_struct('kind','POLYGONAL','left',0,'right',0,'upper',0,'lower',0,'row',0,'column',0,'radius',0,'vertices',array(named_struct('row',0,'column',0),named_struct('row',9,'column',0),named_struct('row',9,'column',9 + p_size % 4)))").cast(whole)
    small_batches(spark)
    p = spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", pixels.visible(F.array(rectangle, circle, triangle), 8, 8).alias("seen"))
    return p.select("p_partkey", F.size("seen").cast("long").alias("visible"), F.array_join("seen", ",").alias("pixels"))


def compressed_files(spark: SparkSession, sf_dir: str, kind: str, own: dict[str, Column] | None = None) -> DataFrame:
    """(file_id, elements): the images with their pixel data as one compressed fragment."""
    files = image_files(spark, sf_dir, own)
    native = frames.frames_of(part10.decode_files(part10.encode_arrays(files)))
    kept = lambda e, **new: F.struct(*[new.get(c, e[c]).alias(c) for c in part10.WRITTEN])
    own = F.transform("elements", lambda e: F.when(e["tag"] == TAG["PixelData"], kept(e, fragments=F.array("fragment"), value=F.lit(b""), bot=F.lit(b""))).otherwise(kept(e)))
    return files.join(frames.compressed(native, kind), "file_id").select("file_id", own.alias("elements"))


def compressed_round_trip(kind: str, syntax: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = frames.frames_of(part10.decode_files(part10.encode_arrays(compressed_files(spark, sf_dir, kind), syntax)))
        return own.select(F.col("file_id").cast("long").alias("vec_id"), "status", F.array_join(values.us_list("value"), ",").alias("samples"))

    return run


for _name, _kind, _syntax in (("rle_roundtrip", "rle", model.RLE), ("jpeg_lossless_roundtrip", "jpeg_lossless", "1.2.840.10008.1.2.4.57"), ("jpeg_lossless_sv1_roundtrip", "jpeg_lossless", "1.2.840.10008.1.2.4.70"), ("jpeg_2000_roundtrip", "jpeg_2000", "1.2.840.10008.1.2.4.90")):
    QUERIES[_name] = compressed_round_trip(_kind, _syntax)


@query
def jpeg_baseline_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 samples of 8 bits through the lossy codec at quantisation one: no sample is off by more than two."""
    samples = F.transform("samples", lambda x: F.pmod(x, F.lit(256)))
    eight = {"Rows": values.us_bytes(F.lit(8)), "Columns": values.us_bytes(F.lit(8)), "BitsAllocated": values.us_bytes(F.lit(8)), "BitsStored": values.us_bytes(F.lit(8)), "PixelData": raw_bytes(samples)}
    own = frames.frames_of(part10.decode_files(part10.encode_arrays(compressed_files(spark, sf_dir, "jpeg_baseline", eight), "1.2.840.10008.1.2.4.50")))
    back = own.select(F.col("file_id").cast("long").alias("vec_id"), "status", F.split(bytes_text(F.col("value")), ",").cast("array<int>").alias("back"))
    both = back.join(images(spark, sf_dir).select("vec_id", samples.alias("was")), "vec_id")
    off = F.array_max(F.transform(F.arrays_zip("back", "was"), lambda x: F.abs(x["back"] - x["was"])))
    return both.select("vec_id", "status", F.size("back").cast("long").alias("n"), (off <= 2).cast("string").alias("close"))


@query
def number_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed and unsigned readings of the same bytes."""
    return readings(spark, sf_dir)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = words_bytes(F.transform("samples", lambda x: x * 23))
    own = images(spark, sf_dir).select("vec_id", raw.alias("raw"))
    join = lambda c: F.array_join(c, ",")
    return own.select("vec_id", join(values.us_list("raw")).alias("us"), join(values.ss_list("raw")).alias("ss"), join(values.ul_list("raw")).alias("ul"), join(values.sl_list("raw")).alias("sl"), join(values.uv_list("raw")).alias("uv"), join(values.sv_list("raw")).alias("sv"), join(values.at_list("raw")).alias("at"))


@query
def decimal_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components with spaces; every seventh row has a bad one."""
    o = table(spark, sf_dir, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    raw = F.encode(F.concat(F.lit(" "), cents, F.lit(" \\"), F.when(F.pmod("o_orderkey", F.lit(7)) == 0, "x").otherwise(F.lit("1.5e1")), F.lit("\\-"), F.col("o_custkey"), F.lit("  ")), "UTF-8")
    own = o.select("o_orderkey", raw.alias("raw"))
    parts = values.decimals("raw")
    return own.select("o_orderkey", F.size(parts).cast("string").alias("n"), F.get(parts, F.lit(0)).cast("long").cast("string").alias("first"), F.get(parts, F.lit(2)).cast("long").cast("string").alias("last"), values.strict_int(F.get(values.texts("raw"), F.lit(0))).cast("string").alias("strict"), values.strict_int(F.get(values.texts("raw"), F.lit(2))).alias("strict_last"))


@query
def date_time_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyyMMddHHmmss").alias("dt"))
    zoned = F.concat("dt", F.lit(".25"), F.when(F.pmod("event_id", F.lit(2)) == 0, "+0930").otherwise("-0500"))
    d, t, z = values.date(F.substring("dt", 1, 8)), values.time(F.substring("dt", 9, 6)), values.date_time(zoned)
    return e.select("event_id", d["year"].alias("year"), d["month"].alias("month"), d["day"].alias("day"), t["hour"].alias("hour"), t["minute"].alias("minute"), t["second"].alias("second"), z["nanosecond"].alias("nanosecond"), z["offset_seconds"].alias("offset_seconds"), z["hour"].alias("zoned_hour"))


@query
def person_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    raw = F.encode(F.concat_ws("=", F.concat("c_name", F.lit("^"), F.col("c_mktsegment")), F.when(F.pmod("c_custkey", F.lit(2)) == 0, F.concat(F.lit("i"), "c_custkey")), F.when(F.pmod("c_custkey", F.lit(6)) == 0, F.concat(F.lit("p=q"), "c_custkey"))), "UTF-8")
    n = values.person_name(raw)
    return c.select("c_custkey", n["alphabetic"].alias("alphabetic"), n["ideographic"].alias("ideographic"), n["phonetic"].alias("phonetic"))


@query
def charset_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latin-1 and UTF-8 texts of documents by their declared character set."""
    return by_charset(spark, sf_dir, F.col("text"))


def by_charset(spark: SparkSession, sf_dir: str, text: Column) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(text, "[^\\x20-\\xff]", "?").alias("line"))
    latin = F.pmod("doc_id", F.lit(2)) == 0
    raw = F.when(latin, F.encode("line", "ISO-8859-1")).otherwise(F.encode("line", "UTF-8"))
    return d.select("doc_id", values.charset_text(raw, F.when(latin, "ISO_IR 100").otherwise("\\ISO_IR 192")).alias("line"))


@query
def private_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two private blocks of one creator: the lower one counts."""
    c = table(spark, sf_dir, "customer")
    block = 0x10 + F.pmod("c_custkey", F.lit(5))
    own = lambda tag, vr, value, k: F.struct(F.lit(False).alias("is_meta"), F.array().cast(model.PATH).alias("path"), F.lit(0).alias("depth"), F.lit(k).alias("ordinal"), tag.cast("long").alias("tag"), F.lit(vr).alias("vr"), value.alias("value"))
    base = F.lit(0x00290000)
    rows = F.array(own(base + block, "LO", text(F.lit("ACME 1.0")), 0), own(base + block + 9, "LO", text(F.lit("ACME 1.0")), 1), own(base + block * 256 + 1, "LO", text("c_name"), 2), own(base + (block + 9) * 256 + 1, "LO", text(F.lit("later")), 3))
    elements = c.select(F.col("c_custkey").cast("string").alias("file_id"), F.explode(rows).alias("e")).select("file_id", "e.*")
    return lookup.private_elements(elements, "ACME 1.0", 0x0029, 0x1001).select(F.col("file_id").cast("long").alias("c_custkey"), values.text("value").alias("c_name"))


@query
def last_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of an order as duplicates of one tag: the last stays."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("l_partkey"))
    elements = li.select(F.col("l_orderkey").cast("string").alias("file_id"), F.lit(False).alias("is_meta"), F.array().cast(model.PATH).alias("path"), F.lit(TAG["PatientID"]).cast("long").alias("tag"), F.col("l_linenumber").alias("ordinal"), text("l_partkey").alias("value"))
    return lookup.last_duplicate(elements).select(F.col("file_id").cast("long").alias("l_orderkey"), values.text("value").cast("long").alias("l_partkey"))


@query
def dictionary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary VRs of the elements that Implicit VR files hold, counted."""
    elements = part10.elements_of(decoded_customers(spark, sf_dir, model.IMPLICIT_LE)).where("not is_meta")
    return lookup.with_dictionary(elements, model.dictionary_dim(spark)).groupBy("keyword", F.col("dictionary_vr").alias("vr")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("vr") == F.col("dictionary_vr")).cast("long")).alias("same"))


@query
def file_meta_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    kind = F.pmod("o_orderkey", F.lit(4))
    own = o.select("o_orderkey", F.when(kind != 1, "1.2").alias("media_class"), F.when(kind == 2, "x").otherwise(F.col("o_custkey").cast("string")).alias("media_instance"), F.lit("9").alias("implementation"), F.when(kind == 3, "1.3").otherwise("1.2").alias("sop_class"), F.col("o_custkey").cast("string").alias("sop_instance"))
    return lookup.file_meta_check(own).select("o_orderkey", "problem")


@query
def cine_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(table(spark, sf_dir, "part"), "p_partkey")
    third = F.pmod("p_size", F.lit(3))
    files = p.select(F.col("p_partkey").cast("string").alias("file_id"), part10.data_set({"FrameTime": F.when(third == 0, text(F.col("p_size") * 10)), "CineRate": F.when(third == 1, text("p_size")), "RecommendedDisplayFrameRate": F.when(F.pmod("p_size", F.lit(4)) == 1, text(F.col("p_size") + 1)), "PatientID": text("p_partkey")}).alias("elements"))
    own = part10.decode_files(part10.encode_arrays(files)).select("file_id", lookup.cine("elements").alias("c"))
    return own.select(F.col("file_id").cast("long").alias("p_partkey"), F.round(F.col("c.frame_rate") * 1000).cast("long").cast("string").alias("millirate"))


@query
def frame_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two frames a file: the shared group sets the rescale, the second frame overrides the intercept, the data set has the window."""
    p = spread(table(spark, sf_dir, "part"), "p_partkey")
    shared, own = TAG["SharedFunctionalGroupsSequence"], TAG["PerFrameFunctionalGroupsSequence"]
    transform = TAG["PixelValueTransformationSequence"]
    e = part10.element
    rows = [
        e(TAG["SamplesPerPixel"], "US", values.us_bytes(F.lit(1)), ordinal=1),
        e(TAG["PhotometricInterpretation"], "CS", text(F.lit("MONOCHROME2")), ordinal=2),
        e(TAG["NumberOfFrames"], "IS", text(F.lit("2")), ordinal=3),
        e(TAG["Rows"], "US", values.us_bytes(F.lit(1)), ordinal=4),
        e(TAG["Columns"], "US", values.us_bytes(F.lit(1)), ordinal=5),
        e(TAG["BitsAllocated"], "US", values.us_bytes(F.lit(16)), ordinal=6),
        e(TAG["WindowCenter"], "DS", text(F.lit("40")), ordinal=7),
        e(TAG["WindowWidth"], "DS", text(F.lit("400")), ordinal=8),
        e(TAG["PixelData"], "OW", words_bytes(F.array(F.col("p_size"), F.col("p_size") + 1)), ordinal=9),
        e(shared, "SQ", F.lit(b""), ordinal=10, items=1),
        e(transform, "SQ", F.lit(b""), ordinal=11, items=1, path=[(shared, 0)]),
        e(TAG["RescaleSlope"], "DS", text(F.lit("2")), ordinal=12, path=[(shared, 0), (transform, 0)]),
        e(TAG["RescaleIntercept"], "DS", text("p_size"), ordinal=13, path=[(shared, 0), (transform, 0)]),
        e(own, "SQ", F.lit(b""), ordinal=14, items=2),
        e(transform, "SQ", F.lit(b""), ordinal=15, items=1, path=[(own, 1)]),
        e(TAG["RescaleIntercept"], "DS", text("p_partkey"), ordinal=16, path=[(own, 1), (transform, 0)]),
    ]
    files = p.select(F.col("p_partkey").cast("string").alias("file_id"), F.array(*rows).alias("elements"))
    found = frames.frames_of(part10.decode_files(part10.encode_arrays(files, undefined_lengths=True)))
    return found.select(F.col("file_id").cast("long").alias("p_partkey"), "frame_index", F.col("rescale_slope").cast("long").alias("slope"), F.col("rescale_intercept").cast("long").alias("intercept"), F.col("window_center").cast("long").alias("center"), F.get(values.us_list("value"), F.lit(0)).alias("sample"))


@query
def presentation_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One state refers to every third image and gives it a window; the other images drop out."""
    found = frames.frames_of(part10.decode_files(part10.encode_arrays(image_files(spark, sf_dir))))
    uids = table(spark, sf_dir, "embeddings").where("vec_id % 3 = 0").select(F.lit("s").alias("file_id"), F.concat(F.lit("1.2.3."), F.col("vec_id")).alias("uid"))
    reference = uids.groupBy("file_id").agg(F.array_sort(F.collect_list("uid")).alias("uids"))
    voi = F.array(F.struct(F.array().cast("array<string>").alias("refs"), F.array(F.struct(F.lit(1100.0).alias("center"), F.lit(300.0).alias("width"), F.lit(None).cast("string").alias("explanation"))).alias("window_presets"), F.array().cast(presentation.VOI["voi_luts"].dataType).alias("voi_luts")))
    images_ = F.transform("uids", lambda u: F.struct(F.lit(None).cast("string").alias("series_instance_uid"), F.lit(None).cast("string").alias("sop_class_uid"), u.alias("sop_instance_uid"), F.lit(None).cast("array<int>").alias("frame_numbers")))
    states = reference.select("file_id", F.lit("ok").alias("status"), images_.alias("referenced_images"), F.lit("INVERSE").alias("lut_shape"), F.lit(None).cast(presentation.STATE["shutter"].dataType).alias("shutter"), voi.alias("softcopy_voi"))
    shown = frames.render(presentation.apply_states(found, states))
    return shown.select(F.col("file_id").cast("long").alias("vec_id"), "status", bytes_text(F.col("pixels")).alias("pixels"))


@query
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers to DICOM JSON, read back and queried; one value taken straight from the text."""
    texts = dicom_json.write_json(decoded_customers(spark, sf_dir, model.EXPLICIT_LE))
    back = dicom_json.read_json(texts.select("file_id", "json")).select("file_id", "elements").join(texts.select("file_id", "json"), "file_id")
    at = lambda n: lookup.attribute("elements", n)["value"]
    return back.select(F.col("file_id").cast("long").alias("c_custkey"), values.text(at("PatientName")).alias("c_name"), (values.us(at("Rows")) - 1).alias("c_nationkey"), dicom_json.json_value(F.col("json"), TAG["InstitutionName"]).alias("c_mktsegment"), dicom_json.valid_keys(F.col("json")).alias("valid"))


@query
def negotiate_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers ask for their nation's service with two transfer syntaxes; even nations are supported."""
    c = table(spark, sf_dir, "customer")
    context = F.array(F.struct(F.lit(1).alias("id"), F.concat(F.lit("1.9."), F.col("c_nationkey")).alias("abstract_syntax"), F.array(F.concat(F.lit("ts"), F.pmod("c_custkey", F.lit(4))), F.concat(F.lit("ts"), F.pmod("c_custkey", F.lit(3)))).alias("transfer_syntaxes")))
    requests = c.select(F.col("c_custkey").alias("assoc_id"), F.when(F.pmod("c_custkey", F.lit(11)) == 0, "other").otherwise(protocol.APPLICATION_CONTEXT).alias("application_context"), F.col("c_mktsegment").alias("called"), context.alias("contexts"))
    abstract = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("1.9."), F.col("n_nationkey")).alias("uid"))
    transfer = spark.createDataFrame([("ts3", 0), ("ts1", 1), ("ts2", 2)], "uid string, preference int")
    titles = spark.createDataFrame([("BUILDING",), ("MACHINERY",), ("FURNITURE",)], "title string")
    associations, contexts, _ = protocol.negotiated(requests, titles, abstract, transfer)
    return associations.join(contexts, "assoc_id", "left").select(F.col("assoc_id").alias("c_custkey"), "accepted", F.col("reason").cast("string").alias("reason"), "result", "transfer_syntax")


@query
def status_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    code = F.element_at(F.array(*[F.lit(x) for x in (0, 0xFF00, 0xFF01, 0xFE00, 1, 0x0107, 0x0116, 0xB000, 0xBFFF, 0xC000, 0xA700, 0x0122, 0xA900)]), (F.pmod("event_id", F.lit(13)) + 1).cast("int"))
    return e.select("event_id", protocol.status_category(code).alias("category"))


@query
def pdv_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as fragments: a message ends with every turn of the assistant."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    own = protocol.reassembled(c.withColumn("last", F.col("role") == "assistant"), ["conv_id"], ["turn"])
    return own.select("conv_id", "message", "complete", F.sha2("data", 256).alias("content"))


@query
def pdv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut to the pieces of a PDU of 1,012 bytes, written as P-DATA, decoded and put together again."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    pieces = protocol.fragmented(d, "content", 1012)

    data = F.struct(F.lit("p_data").alias("type"), F.array(F.struct(F.lit(1).alias("context"), F.lit(False).alias("command"), "last", "data")).alias("values"))
    log = protocol.encode_pdus(pieces.select("doc_id", "fragment", data.alias("pdu"))).drop("status")
    own = protocol.reassembled(protocol.decode_pdus(log), ["doc_id"], ["fragment"])
    return own.select("doc_id", "complete", F.length("data").cast("long").alias("n_bytes"), F.sha2("data", 256).alias("content"))


@query
def find_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as pending answers; the last order's answer is final."""
    o = table(spark, sf_dir, "orders")
    last = o.groupBy("o_custkey").agg(F.max("o_orderkey").alias("last"))
    own = o.join(last, "o_custkey").select(F.lit(1).alias("assoc_id"), F.col("o_custkey").alias("responded_to"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") == F.col("last"), 0).otherwise(0xFF00).alias("status"), F.when(F.col("o_orderkey") != F.col("last"), F.col("o_orderkey").cast("string")).alias("identifier"))
    return protocol.find_results(own).select(F.col("responded_to").alias("o_custkey"), F.array_join("identifiers", ",").alias("identifiers"), "final_status")


@query
def geometry_arity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = images(spark, sf_dir)
    cut = lambda n: F.slice("samples", 1, n).cast("array<double>")
    g = lookup.geometry(cut(F.pmod("vec_id", F.lit(4)).cast("int")), F.lit(None).cast("array<int>"), cut(F.pmod("vec_id", F.lit(5)).cast("int")), cut(F.pmod("vec_id", F.lit(8)).cast("int")))
    return e.select("vec_id", F.size(g["pixel_spacing"]).cast("string").alias("spacing"), F.size(g["image_position"]).cast("string").alias("position"), F.size(g["image_orientation"]).cast("string").alias("orientation"))


@query
def overlay_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    group = (0x6000 + F.pmod("p_size", F.lit(4)) * 2) * 65536
    e = lambda tag, value, k: F.struct(F.lit(0).alias("depth"), F.lit(k).alias("ordinal"), tag.cast("long").alias("tag"), value.alias("value"))
    rows = F.array(e(group + 0x10, values.us_bytes(F.col("p_size")), 0), e(group + 0x11, values.us_bytes(F.lit(7)), 1), e(group + 0x50, F.when(F.pmod("p_size", F.lit(3)) != 0, F.concat(values.us_bytes(F.lit(-1)), values.us_bytes(F.lit(2)))), 2), e(group + 0x3000, F.when(F.pmod("p_size", F.lit(5)) != 0, F.lit(b"\1\2")), 3))
    elements = p.select(F.col("p_partkey").cast("string").alias("file_id"), F.explode(rows).alias("e")).select("file_id", "e.*")
    found = lookup.overlays(elements)
    return found.select(F.col("file_id").cast("long").alias("p_partkey"), F.col("group_number").cast("long").alias("group_number"), "rows", "columns", F.array_join("origin", ",").alias("origin"))


@query
def sop_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image storage classes by the number of customers whose nation has their place in the registry."""
    dim = model.sop_class_dim(spark).select("uid", "image_storage")
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    uid = F.element_at(F.array(*[F.lit(model.SOP_CLASSES[k][0]) for k in ("ct_image", "mr_image", "grayscale_presentation_state", "verification", "us_image")]), (F.pmod("c_nationkey", F.lit(5)) + 1).cast("int"))
    return c.withColumn("uid", uid).join(F.broadcast(dim), "uid").groupBy("uid", "image_storage").agg(F.sum("n").alias("n"))


@query
def range_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel data left out of the scan and read later from its place in the file."""
    files = part10.encode_arrays(image_files(spark, sf_dir))
    decoded = part10.decode_files(files, pixels="skip")
    read = part10.read_ranges(files, part10.pixel_ranges(part10.elements_of(decoded)))
    return read.select(F.col("file_id").cast("long").alias("vec_id"), "status", F.array_join(values.us_list("bytes"), ",").alias("samples"))


@query
def page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a search: the limit is the feature."""
    return lookup.page(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), ["lang", "n_chars", "doc_id"], 25, 50)


@query
def accepted_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first accepted context of each association and service: line items as contexts, odd ones accepted."""
    li = table(spark, sf_dir, "lineitem")
    own = li.select(F.col("l_orderkey").alias("assoc_id"), (F.col("l_linenumber") * 2 + 1).alias("id"), (F.col("l_partkey") % 3).cast("string").alias("abstract_syntax"), F.when(F.col("l_suppkey") % 2 == 1, "acceptance").otherwise("no_reason").alias("result"), F.concat(F.lit("ts"), F.col("l_linenumber")).alias("transfer_syntax"))
    return protocol.accepted_context(own).select(F.col("assoc_id").alias("l_orderkey"), "abstract_syntax", F.col("id").cast("long").alias("id"), "transfer_syntax")


@query
def window_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two centres, but every fourth part has one width only."""
    p = table(spark, sf_dir, "part")
    centers = F.array((F.col("p_size") * 10).cast("double"), F.col("p_size").cast("double"))
    widths = F.when(F.pmod("p_size", F.lit(4)) == 0, F.array(F.lit(1.0))).otherwise(F.array(F.lit(400.0), F.lit(80.0)))
    own = lookup.presets(centers, widths, F.array(F.col("p_brand")))
    return p.select("p_partkey", F.size(own).cast("long").alias("n"), F.get(own, F.lit(0))["center"].cast("long").cast("string").alias("center"), F.get(own, F.lit(0))["explanation"].alias("first"), F.get(own, F.lit(1))["explanation"].alias("second"))


@query
def frame_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector of durations where it reaches, else the frame time."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.array(F.lit(0.0), F.lit(33.0), F.lit(40.0)).alias("vector"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", pixels.frame_duration(F.col("vector"), F.lit(50.0), F.col("l_linenumber") - 1).cast("long").alias("duration"))


@query
def private_creators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Private elements with the creator of their block; blocks without one have none."""
    c = table(spark, sf_dir, "customer")
    block = 0x10 + F.pmod("c_custkey", F.lit(3))
    own = lambda tag, value: F.struct(F.array().cast(model.PATH).alias("path"), tag.cast("long").alias("tag"), value.alias("value"))
    rows = F.array(own(F.lit(0x00290011), text("c_name")), own(F.lit(0x00290000) + block * 256 + 1, text("c_custkey")))
    elements = c.select(F.col("c_custkey").cast("string").alias("file_id"), F.explode(rows).alias("e")).select("file_id", "e.*")
    return lookup.with_private_creator(elements).where("tag % 65536 >= 4096").select(F.col("file_id").cast("long").alias("c_custkey"), "creator")


@query
def derived_file_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, "1.2").alias("sop_class"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey").cast("string")).otherwise("").alias("sop_instance"))
    return lookup.derive_file_meta(o, "1.9").select("o_orderkey", "problem", "media_class", "media_instance", "implementation")


@query
def transfer_syntaxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by the encoding that their transfer syntax stands for; unknown ones are kept."""
    e = table(spark, sf_dir, "events")
    uid = F.element_at(F.array(F.lit(model.IMPLICIT_LE), F.lit(model.EXPLICIT_BE), F.lit(model.RLE), F.lit("1.2.3")), (F.pmod("event_id", F.lit(4)) + 1).cast("int"))
    own = e.select(uid.alias("uid")).join(F.broadcast(model.transfer_syntax_dim(spark)), "uid", "left")
    return own.groupBy("uid", F.coalesce("name", F.lit("unknown")).alias("name"), F.col("big_endian").cast("string").alias("big_endian"), F.col("encapsulated").cast("string").alias("encapsulated")).agg(F.count(F.lit(1)).alias("n"))


@query
def nested_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sequences of line items, two levels deep, with undefined lengths; the inner values come back by path."""
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "part")
    outer, inner = TAG["ReferencedSeriesSequence"], TAG["ReferencedImageSequence"]
    empty = F.lit(b"").alias("value")
    row = lambda path, depth, k, tag, vr, value, items: F.struct(F.lit(False).alias("is_meta"), path.cast(model.PATH).alias("path"), F.lit(depth).alias("depth"), k.cast("int").alias("ordinal"), F.lit(tag).cast("long").alias("tag"), F.lit(vr).alias("vr"), value.cast("binary").alias("value"), items.cast("int").alias("item_count"), F.lit(None).cast("array<binary>").alias("fragments"), F.lit(None).cast("binary").alias("bot"))
    step = lambda tag, item: F.struct(F.lit(tag).cast("long").alias("tag"), item.cast("int").alias("item"))
    none = F.lit(None)
    lists = spread(li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "part"))).alias("own")), "l_orderkey")
    heads = F.array(row(F.array(), 0, F.lit(0), outer, "SQ", empty, F.size("own")))
    seqs = F.transform("own", lambda x, i: row(F.array(step(outer, i)), 1, i + 1, inner, "SQ", empty, F.lit(1)))
    leaves = F.transform("own", lambda x, i: row(F.array(step(outer, i), step(inner, F.lit(0))), 2, i + 1000, TAG["ReferencedSOPInstanceUID"], "UI", F.encode(F.concat(F.lit("1."), x["part"]), "UTF-8"), none))
    files = lists.select(F.col("l_orderkey").cast("string").alias("file_id"), F.concat(heads, seqs, leaves).alias("elements"))
    read = part10.elements_of(part10.decode_files(part10.encode_arrays(files, model.IMPLICIT_LE, undefined_lengths=True)))
    return read.where(F.col("tag") == TAG["ReferencedSOPInstanceUID"]).select(F.col("file_id").cast("long").alias("l_orderkey"), F.get("path", F.lit(0))["item"].cast("long").alias("item"), "depth", values.text("value").alias("uid"))


@query
def float_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two float frames a part from IEEE bytes; a third of the files lack half of their data."""

    numbers = F.when(F.col("p_size") % 3 != 0, F.array(F.col("p_size").cast("double"), "p_retailprice")).otherwise(F.array(F.col("p_size").cast("double")))
    p = with_doubles(spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", numbers.alias("numbers")), "numbers", "raw")
    files = p.select(F.col("p_partkey").cast("string").alias("file_id"), part10.data_set({"Rows": values.us_bytes(F.lit(1)), "Columns": values.us_bytes(F.lit(1)), "NumberOfFrames": text(F.lit("2")), "DoubleFloatPixelData": F.col("raw")}).alias("elements"))
    own = frames.float_frames(part10.decode_files(part10.encode_arrays(files)))
    return own.select(F.col("file_id").cast("long").alias("p_partkey"), "frame_index", F.round(F.get("values", F.lit(0)) * 100).cast("long").alias("cents"))


@query
def json_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' texts as bulk data that JSON refers to; every tenth reference is missing."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_id"), F.coalesce("text", F.lit("")).alias("text"))
    uri = F.concat(F.lit("bulk/"), "file_id")
    texts = d.select("file_id", F.concat(F.lit('{"00091002":{"vr":"OB","BulkDataURI":"'), uri, F.lit('"},"00100020":{"vr":"LO","Value":["'), "file_id", F.lit('"]}}')).alias("json"))
    content = d.where("cast(file_id as long) % 10 <> 0").select("file_id", uri.alias("uri"), F.encode("text", "UTF-8").alias("content"))
    own = dicom_json.read_json(texts, bulk=content)
    return own.select(F.col("file_id").cast("long").alias("doc_id"), "status", F.sha2(lookup.attribute("elements", 0x00091002)["value"], 256).alias("content"))


@query
def dangling_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as records that link to the record of another key; links beyond the last have no target."""
    s = table(spark, sf_dir, "supplier")
    own = s.select(F.lit("d").alias("file_id"), F.col("s_suppkey").alias("offset"), (F.col("s_suppkey") * 2).alias("next_offset"), F.when(F.col("s_suppkey") % 2 == 0, F.lit(0)).otherwise(F.col("s_suppkey") + 1).cast("long").alias("child_offset"))
    return directory.dangling(own).groupBy("target").agg(F.count(F.lit(1)).alias("n"))


def queries() -> dict[str, Query]:
    from lumenframe.plans import imaging, messages  # noqa: F401  they register their own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from lumenframe.plans import imaging, messages

    return {k: v for k, v in (SQL | imaging.SQL | messages.SQL).items() if k in QUERIES}
