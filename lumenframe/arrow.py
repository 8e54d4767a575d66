"""Python steps over Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Rows that go to a Python worker together, at most. What a worker holds is one batch as Python objects, some kilobytes a
#: file; and Spark sizes the whole batch again for each row that it adds, so that time grows with the square of this number.
ROWS_PER_BATCH = 500


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to ROWS_PER_BATCH; a lower setting of the session's own and its limit in bytes stay."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ROWS_PER_BATCH:
        spark.conf.set(key, str(ROWS_PER_BATCH))


def mapped(rows: DataFrame, run: Callable, schema: T.StructType | str) -> DataFrame:
    """rows.mapInArrow with small batches."""
    small_batches(rows.sparkSession)
    return rows.mapInArrow(run, schema)


def gathered(batches: Iterator[pa.RecordBatch], rows: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches put together to about so many rows, or bytes where they come first: for work that has a cost a batch."""
    own, n, size = [], 0, 0
    for batch in batches:
        if own and (n + batch.num_rows > rows or size + batch.nbytes > limit):
            yield pa.concat_batches(own)
            own, n, size = [], 0, 0
        own.append(batch)
        n, size = n + batch.num_rows, size + batch.nbytes
    if own:
        yield pa.concat_batches(own)
