"""Exact dedup: counting quotient filters per partition, merged by sorted remainders, then byte verification.

Every row's normalised text has a 64-bit fingerprint: the high bits are its quotient, the low bits its
remainder. Each partition builds one counting quotient filter from its fingerprints. A filter is cut into
quotient ranges; ranges of all partitions meet in one task each and merge run by run by their sorted remainders,
which loses nothing: the merged counts are those of the whole table. What is shuffled there is at most one entry for
each partition and fingerprint, so a text that a third of all rows share costs one entry a partition.

Only fingerprints with a count above one go on to byte verification: their rows are grouped by the
normalised text itself, with partial aggregation before the shuffle.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.llm.common import staged

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
REMAINDER_BITS = 44
#: Entries that one merge task should hold.
RANGE_ROWS = 1_000_000
#: Repeated fingerprints are broadcast up to this many (of about 16 bytes); beyond, texts and fingerprints are shuffled.
BROADCAST_ROWS = 1_000_000


class CountingQuotientFilter:
    """A counting quotient filter without empty slots: a slot holds a remainder and its count.

    Slots of one quotient are a run, its remainders ascending; runs lie in the order of their quotients. `occupied` lists
    the quotients that have a run (the occupied bits of a sparse table), `run_end` marks the last slot of each run.
    """

    def __init__(self, occupied: np.ndarray, run_end: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.occupied, self.run_end, self.remainders, self.counts = occupied, run_end, remainders, counts

    @classmethod
    def build(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None) -> CountingQuotientFilter:
        if counts is None:
            keys, counts = np.unique(fingerprints, return_counts=True)
        else:
            order = np.argsort(fingerprints, kind="stable")
            keys, first = np.unique(fingerprints[order], return_index=True)
            counts = np.add.reduceat(counts[order], first) if len(first) else counts[:0]
        quotients = keys >> np.uint64(REMAINDER_BITS)
        run_end = np.append(quotients[1:] != quotients[:-1], True)[: len(keys)]
        return cls(quotients[run_end], run_end, keys & np.uint64((1 << REMAINDER_BITS) - 1), counts.astype(np.int64))

    def runs(self) -> np.ndarray:
        """The number of its run for each slot: the run ends before it (rank)."""
        return np.cumsum(self.run_end) - self.run_end

    def fingerprints(self) -> np.ndarray:
        return (self.occupied[self.runs()] << np.uint64(REMAINDER_BITS)) | self.remainders

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """Lossless: filters merge by twos, smallest first, until one is left."""
        work = [(len(f.remainders), k, f) for k, f in enumerate(filters)] or [(0, 0, cls.build(np.empty(0, np.uint64)))]
        heapq.heapify(work)
        while len(work) > 1:
            (m, k, a), (n, _, b) = heapq.heappop(work), heapq.heappop(work)
            heapq.heappush(work, (m + n, k, a.with_runs_of(b)))
        return work[0][2]

    def with_runs_of(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """Both filters' runs: runs of one quotient merge by their sorted remainders, equal remainders add their counts.

        Each remainder of the other filter is looked up in this filter's run of the same quotient, by a binary search
        over (number of the quotient, remainder), which is ascending in either filter; nothing is sorted anew.
        """
        occupied = np.union1d(self.occupied, other.occupied)
        place = lambda f: (np.searchsorted(occupied, f.occupied)[f.runs()].astype(np.uint64) << np.uint64(REMAINDER_BITS)) | f.remainders
        own, new = place(self), place(other)
        at = np.searchsorted(own, new)
        equal = np.zeros(len(new), bool)
        inside = at < len(own)
        equal[inside] = own[at[inside]] == new[inside]
        counts = self.counts.copy()
        counts[at[equal]] += other.counts[equal]
        merged = np.insert(own, at[~equal], new[~equal])
        counts = np.insert(counts, at[~equal], other.counts[~equal])
        quotients = merged >> np.uint64(REMAINDER_BITS)
        run_end = np.append(quotients[1:] != quotients[:-1], True)[: len(merged)]
        return type(self)(occupied, run_end, merged & np.uint64((1 << REMAINDER_BITS) - 1), counts)

    def cut(self, bits: int) -> Iterator[tuple[int, CountingQuotientFilter]]:
        """One filter for each range of quotients with the same highest bits."""
        ranges = (self.occupied >> np.uint64(64 - REMAINDER_BITS - bits)).astype(np.int64)
        ends = np.flatnonzero(self.run_end) + 1
        last = np.flatnonzero(np.append(ranges[1:] != ranges[:-1], True)[: len(ranges)])
        run, slot = 0, 0
        for k in last.tolist():
            end = int(ends[k])
            yield int(ranges[k]), type(self)(self.occupied[run : k + 1], self.run_end[slot:end], self.remainders[slot:end], self.counts[slot:end])
            run, slot = k + 1, end

    def dump(self) -> dict[str, bytes | int]:
        return {"slots": len(self.remainders), "occupied": self.occupied.astype(np.uint32).tobytes(), "run_end": np.packbits(self.run_end).tobytes(), "remainders": self.remainders.tobytes(), "counts": self.counts.astype(np.uint32).tobytes()}

    @classmethod
    def load(cls, row: dict) -> CountingQuotientFilter:
        run_end = np.unpackbits(np.frombuffer(row["run_end"], np.uint8), count=row["slots"]).astype(bool)
        return cls(np.frombuffer(row["occupied"], np.uint32).astype(np.uint64), run_end, np.frombuffer(row["remainders"], np.uint64), np.frombuffer(row["counts"], np.uint32).astype(np.int64))


def normalised(text: Column) -> Column:
    """Lower-case A-Z only; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def repeated_fingerprints(rows: DataFrame, bits: int) -> DataFrame:
    """Fingerprints (column fp) that more than one row has."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [np.unique(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), return_counts=True) for b in batches]
        if own:
            whole = CountingQuotientFilter.build(np.concatenate([k for k, _ in own]), np.concatenate([c for _, c in own]))
            out = [{"range": k} | part.dump() for k, part in whole.cut(bits)]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("range", pa.int64()), ("slots", pa.int64()), *((c, pa.binary()) for c in ("occupied", "run_end", "remainders", "counts"))]))

    def merge(parts: pa.Table) -> pa.Table:
        whole = CountingQuotientFilter.merge([CountingQuotientFilter.load(r) for r in parts.to_pylist()])
        return pa.table({"fp": whole.fingerprints()[whole.counts > 1].view(np.int64)})

    filters = rows.mapInArrow(build, "range long, slots long, occupied binary, run_end binary, remainders binary, counts binary")
    return filters.groupBy("range").applyInArrow(merge, "fp long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text, hex).

    Texts are equal when identical after lower-casing A-Z; the row with the largest doc_id stays. A null text
    counts as empty, so all null and empty texts are one group. A null doc_id is smaller than any other; where a
    group has no doc_id its keep_id is null. Of rows that repeat doc_id and text, one is kept. An empty table
    gives no rows. Other columns are ignored.
    """
    norm = normalised(F.col(text_col).cast("string"))
    prepared = docs.select(F.col(id_col).cast("long").alias("doc_id"), norm.alias("norm"))
    slim = staged(prepared.select("doc_id", F.xxhash64("norm").alias("fp"), F.unhex(F.sha2("norm", 256)).alias("sha")), "slim")
    bits = max(0, min(14, int(np.ceil(np.log2(max(1, slim.count()) / RANGE_ROWS))))) + 6
    repeated = staged(repeated_fingerprints(slim.select("fp"), bits), "repeated")

    # Only texts of repeated fingerprints go on; while those are few, no other text leaves its task.
    few = repeated.count() <= BROADCAST_ROWS
    alike = prepared.withColumn("fp", F.xxhash64("norm")).join(F.broadcast(repeated) if few else repeated, "fp", "left_semi")
    groups = (
        alike.groupBy("norm")  # not by fp too: the join's partitions would do then, and a hot text would not be counted before its shuffle
        .agg(F.max("doc_id").alias("keep"), F.count(F.lit(1)).alias("size"))
        .select(F.xxhash64("norm").alias("fp"), F.unhex(F.sha2("norm", 256)).alias("sha"), "keep", "size")
    )
    # Written first, so that the join has two shuffled sides and Spark can split a hot group.
    grouped = slim.join(staged(groups, "groups"), ["fp", "sha"], "left")
    single = F.col("size").isNull()
    out = grouped.select(
        "doc_id",
        "sha",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
    )
    # Only rows that repeat doc_id and text need a tie-break; the key is as fine as a row everywhere else.
    nth = F.row_number().over(Window.partitionBy("doc_id", "sha").orderBy("group_size"))
    return out.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (nth == 1)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
