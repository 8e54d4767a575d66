"""Line dedup over overlapping windows of three lines, in DataFrame functions only.

Every three consecutive lines of a document are a window with a 128-bit key. A window that occurs more than once
keeps its first occurrence by (doc_id, position); each later occurrence covers its three lines. The covered
positions of a document merge into one set and those lines go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import keyed

WINDOW = 3


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text (without the removed lines), n_lines, n_removed.

    Lines are split at newlines and compared as they are. A null text counts as empty: one empty line, no window.
    Documents of fewer than three lines are kept whole. Windows overlap within a document too: a window that
    repeats in its own document loses the later one. Rows that repeat doc_id and text are one document and get
    the same result. Null doc_ids come first. An empty table gives no rows; other columns are ignored.

    The first occurrence is a minimum with partial aggregation, so a window that a third of all documents have
    adds one row a partition to the shuffle; the join back is a plain equi-join, whose hot keys Spark can split.
    """
    rows = keyed(docs, id_col, text_col).withColumn("lines", F.split("text", "\n"))
    windows = (
        rows.where(F.size("lines") >= WINDOW)
        .select("doc_id", "rid", F.posexplode(F.expr(f"transform(sequence(0, size(lines) - {WINDOW}), i -> unhex(md5(array_join(slice(lines, i + 1, {WINDOW}), '\n'))))")).alias("pos", "key"))
    )
    place = F.struct("doc_id", "rid", "pos")
    repeated = windows.groupBy("key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "first")
    later = windows.join(repeated, "key").where(~place.eqNullSafe(F.col("first")))
    covers = later.groupBy("rid").agg(F.collect_set("pos").alias("starts"))
    covered = F.expr(f"array_distinct(flatten(transform(starts, s -> sequence(s, s + {WINDOW - 1}))))")
    joined = rows.select("doc_id", "rid", "text").join(covers, "rid", "left").withColumn("lines", F.split("text", "\n")).withColumn("gone", covered)
    # Positions are taken away as a set, so that a long text costs no more than its lines.
    kept = F.expr("array_join(transform(array_except(sequence(0, size(lines) - 1), gone), i -> lines[i]), '\n')")
    return joined.select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
    )
