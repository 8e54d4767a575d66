"""DICOM-shaped inputs from relational tables, for queries over tables that hold no DICOM."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumenframe.arrow import mapped
from lumenframe.functions import values
from lumenframe.sources import part10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Slim rows dealt out to all cores before files are made of them: what follows costs far more than their bytes say,
    which is what Spark sizes partitions by."""
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism)
    return rows.repartition(n, key)


def words_bytes(numbers: Column) -> Column:
    """An array of 16-bit numbers as little-endian bytes."""
    swapped = F.transform(numbers, lambda x: F.concat(F.substring(F.lpad(F.hex(F.pmod(x, F.lit(65536)).cast("long")), 4, "0"), 3, 2), F.substring(F.lpad(F.hex(F.pmod(x, F.lit(65536)).cast("long")), 4, "0"), 1, 2)))
    return F.unhex(F.array_join(swapped, ""))


def raw_bytes(numbers: Column) -> Column:
    """An array of numbers from 0 to 255 as bytes."""
    return F.unhex(F.array_join(F.transform(numbers, lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")), ""))


def sl_bytes(numbers: Column) -> Column:
    """An array of 32-bit numbers as little-endian bytes."""
    halves = F.flatten(F.transform(numbers, lambda x: F.array(F.pmod(x.cast("long"), F.lit(65536)), F.pmod(F.floor(x / 65536).cast("long"), F.lit(65536)))))
    return words_bytes(halves)


def with_doubles(rows: DataFrame, numbers: str, out: str) -> DataFrame:
    """rows with an array of doubles as little-endian bytes."""
    keys = [c for c in rows.columns if c != numbers]
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField(out, T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [None if x is None else np.array(x, "<f8").tobytes() for x in batch.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(raw, pa.binary())], schema=arrow)

    return mapped(rows.select(*keys, numbers), run, schema)


def text(column: Column | str) -> Column:
    return values.text_bytes((F.col(column) if isinstance(column, str) else column).cast("string"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, elements): one data set a customer."""
    c = spread(table(spark, sf_dir, "customer"), "c_custkey")
    return c.select(
        F.col("c_custkey").cast("string").alias("file_id"),
        part10.data_set(
            {
                "PatientName": text("c_name"),
                "PatientID": text("c_custkey"),
                "InstitutionName": text("c_mktsegment"),
                "PatientWeight": text(F.round("c_acctbal", 2).cast("decimal(12,2)")),
                "Rows": values.us_bytes(F.col("c_nationkey") + 1),
                "StudyInstanceUID": text(F.concat(F.lit("1.2.840.99."), F.col("c_nationkey"))),
                "SeriesInstanceUID": text(F.concat(F.lit("1.2.840.99."), F.col("c_nationkey"), F.lit("."), F.pmod("c_custkey", F.lit(5)))),
                "SOPInstanceUID": text(F.concat(F.lit("1.2.840.99.7."), F.col("c_custkey"))),
                "InstanceNumber": text("c_custkey"),
            }
        ).alias("elements"),
    )


def decoded_customers(spark: SparkSession, sf_dir: str, syntax: str, **options) -> DataFrame:
    """Customers written as Part 10 files and read again."""
    return part10.decode_files(part10.encode_arrays(customers(spark, sf_dir), syntax), **options)


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, vec_id, label, samples): embeddings as 16-bit samples."""
    e = spread(table(spark, sf_dir, "embeddings"), "vec_id")
    samples = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(4095), F.round((x.cast("double") + 1) * 1000))).cast("int"))
    return e.select(F.col("vec_id").cast("string").alias("file_id"), "vec_id", "label", samples.alias("samples"))


def image_files(spark: SparkSession, sf_dir: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """(file_id, elements): one single-row image a vector."""
    i = images(spark, sf_dir)
    own = {
        "SOPClassUID": text(F.lit("1.2.840.10008.5.1.4.1.1.7")),
        "SOPInstanceUID": text(F.concat(F.lit("1.2.3."), F.col("vec_id"))),
        "SamplesPerPixel": values.us_bytes(F.lit(1)),
        "PhotometricInterpretation": text(F.when(F.pmod("vec_id", F.lit(2)) == 0, "MONOCHROME2").otherwise("MONOCHROME1")),
        "Rows": values.us_bytes(F.lit(1)),
        "Columns": values.us_bytes(F.size("samples")),
        "BitsAllocated": values.us_bytes(F.lit(16)),
        "BitsStored": values.us_bytes(F.lit(12)),
        "HighBit": values.us_bytes(F.lit(11)),
        "PixelRepresentation": values.us_bytes(F.lit(0)),
        "PixelData": words_bytes(F.col("samples")),
        **(extra or {}),
    }
    return i.select("file_id", part10.data_set(own).alias("elements"))


def bytes_text(pixels: Column) -> Column:
    """8-bit samples as comma-joined numbers."""
    at = F.sequence(F.lit(1), F.length(pixels))
    return F.array_join(F.transform(at, lambda i: F.conv(F.hex(F.substring(pixels, i, F.lit(1))), 16, 10)), ",")
