"""DICOMDIR: flat records and the tree that their offsets link.

A record names the offset of its next sibling and of its first child. Siblings are a linked list, as long as the
directory is wide, so a recursive query would need one level a record; each directory's records are linked in one
task instead (a directory is one file). `tree_sql` is the recursive query for small directories.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumenframe import binary
from lumenframe.arrow import mapped
from lumenframe.dataset import DataSet

RECORD = T.StructType(
    [
        T.StructField("file_id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("root_offset", T.LongType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("next_offset", T.LongType()),
        T.StructField("child_offset", T.LongType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("referenced_file", T.ArrayType(T.StringType())),
        T.StructField("sop_class_uid", T.StringType()),
        T.StructField("sop_instance_uid", T.StringType()),
    ]
)


def first_number(ds: DataSet, name: str) -> int | None:
    a = ds.array(name, "<u4")
    return int(a[0]) if a is not None and len(a) else None


def records_in(file_id: str, elements: list[dict]) -> list[dict]:
    ds = DataSet(binary.tree([e for e in elements if not e["is_meta"]]))
    sequence = ds.get("DirectoryRecordSequence")
    bad = [{"file_id": file_id, "status": "invalidDICOMDirectory"}]
    if sequence is None or sequence.items is None:
        return bad
    root, out = first_number(ds, "OffsetOfTheFirstDirectoryRecordOfTheRootDirectoryEntity"), []
    for k, (item, offset) in enumerate(zip(ds.items("DirectoryRecordSequence"), sequence.row["item_offsets"], strict=True)):
        kind = item.text("DirectoryRecordType")
        if not kind:
            return bad
        out.append({"file_id": file_id, "status": "ok", "root_offset": root, "ordinal": k, "offset": offset, "next_offset": first_number(item, "OffsetOfTheNextDirectoryRecord"), "child_offset": first_number(item, "OffsetOfReferencedLowerLevelDirectoryEntity"), "record_type": kind, "referenced_file": item.texts("ReferencedFileID"), "sop_class_uid": item.text("ReferencedSOPClassUIDInFile"), "sop_instance_uid": item.text("ReferencedSOPInstanceUIDInFile")})
    return out


def directory_records(decoded: DataFrame) -> DataFrame:
    """Records of decoded directories in file order; see RECORD."""
    schema = to_arrow_schema(RECORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_id, own in zip(batch.column(0).to_pylist(), binary.element_rows(batch.column(1)), strict=True):
                yield pa.RecordBatch.from_pylist(records_in(file_id, own), schema=schema)

    return mapped(decoded.where("status = 'ok'").select("file_id", "elements"), run, RECORD)


NODE = "file_id string, status string, place long, level int, offset long, parent_offset long"


def linked(rows: list[tuple[int, int | None, int | None]], root: int | None) -> list[tuple[int, int, int | None]] | None:
    """(offset, level, parent) depth first; None where a link dangles or comes back to an open record.

    A chain may not meet a record that stands before it or above it; a child that two records share appears below both.
    """
    by_offset = {o: (n, c) for o, n, c in rows}
    if len(by_offset) != len(rows):
        return None
    out: list[tuple[int, int, int | None]] = []
    open_: set[int] = set()  # the records before and above
    chains: list[list] = [[root, 0, None, []]]  # next sibling, level, parent, records of the chain so far
    while chains:
        chain = chains[-1]
        offset, level, parent, passed = chain
        if not offset:
            open_.difference_update(passed)
            chains.pop()
            continue
        if offset not in by_offset or offset in open_:
            return None
        open_.add(offset)
        passed.append(offset)
        out.append((offset, level, parent))
        chain[0], child = by_offset[offset]
        if child:
            chains.append([child, level + 1, offset, []])
    return out


def directory_tree(records: DataFrame) -> DataFrame:
    """(file_id, status, place, level, offset, parent_offset): the linked records of each directory, depth first."""

    def one(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        file_id, root = rows[0]["file_id"], rows[0]["root_offset"]
        nodes = None if rows[0]["status"] != "ok" else linked([(r["offset"], r["next_offset"], r["child_offset"]) for r in rows], root)
        if nodes is None:
            found = [{"file_id": file_id, "status": "invalidDICOMDirectory"}]
        else:
            found = [{"file_id": file_id, "status": "ok", "place": k, "level": lv, "offset": o, "parent_offset": p} for k, (o, lv, p) in enumerate(nodes)]
        return pa.Table.from_pylist(found, schema=pa.schema([("file_id", pa.string()), ("status", pa.string()), ("place", pa.int64()), ("level", pa.int32()), ("offset", pa.int64()), ("parent_offset", pa.int64())]))

    return records.select("file_id", "status", "root_offset", "offset", "next_offset", "child_offset").groupBy("file_id").applyInArrow(one, NODE)


def tree_sql(view: str) -> str:
    """The same tree by a recursive query over a view of records, without places; cycles end at the visited array."""
    return f"""
WITH RECURSIVE walk AS (
  SELECT file_id, offset, next_offset, child_offset, 0 AS level, CAST(NULL AS BIGINT) AS parent_offset, array(offset) AS seen
  FROM {view} WHERE offset = root_offset
  UNION ALL
  SELECT r.file_id, r.offset, r.next_offset, r.child_offset,
         CASE WHEN r.offset = w.next_offset THEN w.level ELSE w.level + 1 END,
         CASE WHEN r.offset = w.next_offset THEN w.parent_offset ELSE w.offset END,
         array_append(w.seen, r.offset)
  FROM walk w JOIN {view} r ON r.file_id = w.file_id AND (r.offset = w.next_offset OR r.offset = w.child_offset)
  WHERE NOT array_contains(w.seen, r.offset)
)
SELECT file_id, offset, level, parent_offset FROM walk
"""


def dangling(records: DataFrame) -> DataFrame:
    """Links to offsets that no record has."""
    links = records.select("file_id", F.explode(F.array("next_offset", "child_offset")).alias("target")).where("target <> 0")
    return links.join(records.select("file_id", F.col("offset").alias("target")), ["file_id", "target"], "left_anti")
