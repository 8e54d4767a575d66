"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark itself so that any store works."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df does not have, whatever extra columns it carries."""
    taken = {c.lower() for c in df.columns}
    name = f"_lf_{base}"
    while name.lower() in taken:
        name += "_"
    return name


def rid_of(id_col: str, text_col: str) -> Column:
    """A key of doc_id and text (null: empty)."""
    return F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.lit(-1).cast("long")), F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (null: empty) and rid, a key of the two.

    Rows that repeat both doc_id and text share a rid; every operator gives them the same row.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), rid_of(id_col, text_col).alias("rid"))


#: Rows of whole texts that go to a Python worker together, at most; Spark's own 10,000 may be far beyond a worker's memory.
TEXTS_PER_BATCH = 1000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to TEXTS_PER_BATCH rows; a lower setting of the session's own stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= TEXTS_PER_BATCH:
        spark.conf.set(key, str(TEXTS_PER_BATCH))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; in local mode a temporary one where none is set."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="lumenframe-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again: short lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/lumenframe-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hex_of(column: Column) -> Column:
    return F.lower(F.hex(column))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value of a string column, without decoding; null gives b''."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
