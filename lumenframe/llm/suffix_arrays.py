"""Suffix-array dedup: every byte that lies in a 400-byte string which also starts anywhere else goes.

A string of LENGTH bytes belongs to its anchor: of all GRAM-byte strings inside it, the leftmost with the smallest
hash. Equal strings have equal anchors at equal places, so a string can only recur among the strings of the same
anchor key, and each string of a document belongs to exactly one anchor. Consecutive strings of one anchor are a
segment (at most LENGTH - GRAM + 1 strings). Everything that can match therefore meets by anchor key:

1. Segments are listed with a hash of their bytes. Keys that occur once are done. Equal segments are repeated as a
   whole; that settles copies by counts alone, with partial aggregation before the shuffle.
2. One representative of each different segment under a shared key goes to a shard with its bytes. A shard is a
   bounded group of keys. It sorts its suffixes by Larsson-Sadakane refinement in numpy and takes the common prefixes
   of neighbours by Kasai's rule; neighbours with LENGTH bytes in common are the same string.
3. A key with more than KEY_SEGMENTS different segments is spread over several shards. Each writes sorted fingerprints
   of its distinct strings, cut into ranges; a range of all shards of such keys merges by binary search.

Work and rows grow with the input, also for one passage in a third of all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.llm.common import keyed, small_batches, staged

LENGTH, GRAM = 400, 64
#: Bytes of text that a worker looks at together, bytes of a shard (its suffixes need about 100 times that), segments
#: of one key in one shard, and fingerprints in one merge task.
BLOCK, SHARD, KEY_SEGMENTS, MERGE_ROWS = 1 << 21, 1 << 20, 1000, 400_000

U = np.uint64
POSITION_BITS = 24


def rolling(data: np.ndarray, length: int, seed: int = 0x1234567, factor: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """A 64-bit polynomial hash of every string of `length` bytes, by doubling and joining powers of two."""
    one = data.astype(U) * U(0x9E3779B97F4A7C15) + U(seed)
    one ^= one >> U(29)
    powers, size, h, c = {}, 1, one, factor
    while size <= length:
        powers[size] = (h, c)
        if size * 2 <= length:
            h = h[: len(h) - size] * U(c) + h[size:]
            c = c * c & (2**64 - 1)
        size *= 2
    out, done = None, 0
    for size in sorted(powers, reverse=True):
        if length - done >= size:
            h, c = powers[size]
            h = h[done:]
            if out is None:
                out = h
            else:
                n = min(len(out), len(h))
                out = out[:n] * U(c) + h[:n]
            done += size
    return out


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if width > size else values


def segments_of(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, length: int, gram: int):
    """(document, first string, number of strings, key) of all segments; documents lie in data one after the other."""
    h = rolling(data, gram)
    mixed = h ^ (h >> U(32))
    mixed *= U(0x9FB21C651E98DF25)
    mixed ^= mixed >> U(35)
    place = (mixed & ~U((1 << POSITION_BITS) - 1)) | np.arange(len(h), dtype=U)
    anchor = (sliding_minimum(place, length - gram + 1) & U((1 << POSITION_BITS) - 1)).astype(np.int64)
    doc = np.repeat(np.arange(len(starts)), lengths)[: len(anchor)]
    inside = np.arange(len(anchor)) + length <= (starts + lengths)[doc]
    first = inside.copy()
    first[1:] &= (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    upto = np.append(0, np.cumsum(inside))
    wins = upto[np.append(at[1:], len(anchor))] - upto[at] if len(at) else at
    return doc[at], at, wins, mixed[anchor[at]]


def suffix_order(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Suffixes in the order of their first h >= depth bytes, the group of each suffix (equal h bytes), and h.

    Larsson-Sadakane: groups sorted by h bytes are refined by the groups of the suffixes h further on; groups of one
    suffix are done and take no further part.
    """
    n = len(data)
    bits = max(1, int(n).bit_length())
    # What lies beyond the end sorts as zero; where the text has zero bytes itself, its bytes count from one.
    zeros = n > 0 and not data.min()
    first, width = (4, 9) if zeros else (5, 8)
    padded = np.append(data.astype(U) + U(zeros), np.zeros(first, U))
    key = np.zeros(n, U)
    for j in range(first):
        key = (key << U(width)) | padded[j : j + n]
    if width * first + bits <= 64:
        packed = np.sort((key << U(bits)) | np.arange(n, dtype=U))
        order = (packed & U((1 << bits) - 1)).astype(np.int64)
        key = packed >> U(bits)
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    slots = np.arange(n)
    new = np.append(True, key[1:] != key[:-1])
    group = np.empty(n, np.int64)
    group[order] = np.maximum.accumulate(np.where(new, slots, 0))
    h = first
    # A suffix shorter than h has the lowest group beyond its end.
    while h < depth:
        new = np.append(np.diff(group[order]) != 0, True)
        lone = new & np.append(True, new[:-1])
        open_ = np.flatnonzero(~lone)
        if not len(open_):
            break
        at = order[open_]
        g = group[at]
        beyond = at + h
        then = np.where(beyond < n, group[np.minimum(beyond, n - 1)] + 1, 0)
        if 3 * bits <= 64:
            packed = np.sort((g.astype(U) << U(2 * bits)) | (then.astype(U) << U(bits)) | at.astype(U))
            at = (packed & U((1 << bits) - 1)).astype(np.int64)
            pair = packed >> U(bits)
        else:
            pair = (g.astype(U) << U(32)) | then.astype(U)
            by = np.argsort(pair, kind="stable")
            at, pair = at[by], pair[by]
        order[open_] = at
        group[at] = np.maximum.accumulate(np.where(np.append(True, pair[1:] != pair[:-1]), open_, 0))
        h *= 2
    return order, group, h


def common_prefixes(data: np.ndarray, order: np.ndarray, group: np.ndarray, h: int) -> np.ndarray:
    """Bytes that each suffix of the order has in common with the one before it; h for suffixes of one group.

    Kasai's rule, all at once: going from a suffix to the next of the text, the common prefix shrinks by exactly one
    as long as the bytes before the two suffixes agree. Only where they differ, or where the suffix before is in a
    group (its neighbours are known to h bytes only), are bytes compared, eight at a time.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    tied = np.zeros(n, bool)
    tied[order[1:]] = group[order[1:]] == group[order[:-1]]
    alone = before < 0
    grouped = np.bincount(group, minlength=n)[group] > 1
    anew = np.ones(n, bool)
    prior = before[1:]
    anew[1:] = alone[1:] | (prior == 0) | grouped[:-1] | alone[:-1] | (data[:-1] != data[np.maximum(prior - 1, 0)])
    padded = np.append(data, np.zeros(16, np.uint8))
    words = np.zeros(n + 8, U)
    for j in range(8):
        words |= padded[j : j + n + 8].astype(U) << U(8 * j)
    length = np.zeros(n, np.int64)
    live = np.flatnonzero(anew & ~tied & ~alone)
    at = 0
    while len(live):
        a, b = live + at, before[live] + at
        x = words[np.minimum(a, n)] ^ words[np.minimum(b, n)]
        same = (x == 0) & (a < n) & (b < n)
        stop = ~same
        if stop.any():
            y = x[stop]
            low = y & (~y + U(1))
            tail = np.where(y == 0, 8, np.log2(np.maximum(low, U(1)).astype(np.float64)).astype(np.int64) // 8)
            ends = n - np.maximum(live[stop], before[live[stop]])
            length[live[stop]] = np.minimum(at + tail, ends)
        live = live[same]
        at += 8
    base = np.maximum.accumulate(np.where(anew, np.arange(n), 0))
    plcp = np.where(anew, length, length[base] - (np.arange(n) - base))
    plcp[tied] = h
    plcp[alone] = 0
    return plcp[order]


def repeated_starts(data: np.ndarray, own: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For the positions marked in own: is the string there also at another such position; and its class."""
    if not len(data):
        return np.zeros(0, bool), np.zeros(0, np.int64)
    order, group, h = suffix_order(data, length)
    same = common_prefixes(data, order, group, h) >= length
    same[0] = False
    classes = np.cumsum(~same) - 1
    counts = np.bincount(classes, weights=own[order], minlength=classes[-1] + 1)
    of = np.empty(len(data), np.int64)
    of[order] = classes
    return own & (counts[of] > 1), of


def runs(marked: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the runs of marked positions that stay in one piece."""
    begins = marked.copy()
    begins[1:] &= ~(marked[:-1] & (piece[1:] == piece[:-1]))
    at = np.flatnonzero(begins)
    upto = np.append(0, np.cumsum(marked))
    return at, upto[np.append(at[1:], len(marked))] - upto[at] if len(at) else at


def list_segments(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(rid, key, seg, start, wins, c, again) of all segments of all texts.

    Equal segments of a block are counted there: the first has their number in c, the others have zero, and again says
    that there is more than one. What is counted further on is then one row a block, however common a segment is.
    """
    schema = pa.schema([("rid", pa.int64()), ("key", pa.int64()), ("seg", pa.int64()), ("start", pa.int64()), ("wins", pa.int64()), ("c", pa.int64()), ("again", pa.bool_())])

    def block(rids: list[int], pieces: list[bytes], offsets: list[int]) -> pa.RecordBatch:
        raw = b"".join(pieces)
        lengths = np.array([len(p) for p in pieces], np.int64)
        starts = np.cumsum(lengths) - lengths
        doc, at, wins, key = segments_of(np.frombuffer(raw, np.uint8), starts, lengths, length, gram)
        seg = np.fromiter((xxhash.xxh3_64_intdigest(raw[a : a + w + length - 1]) for a, w in zip(at.tolist(), wins.tolist(), strict=True)), U, len(at))
        place = at - starts[doc] + np.array(offsets, np.int64)[doc]
        order = np.lexsort((seg, key))
        new = np.ones(len(at), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (seg[order][1:] != seg[order][:-1])
        size = np.diff(np.append(np.flatnonzero(new), len(at)))
        count, again = np.zeros(len(at), np.int64), np.empty(len(at), bool)
        count[order[new]], again[order] = size, np.repeat(size > 1, size)
        return pa.RecordBatch.from_arrays([pa.array(np.array(rids, np.int64)[doc]), pa.array(key.view(np.int64)), pa.array(seg.view(np.int64)), pa.array(place), pa.array(wins), pa.array(count), pa.array(again)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rids, pieces, offsets, size = [], [], [], 0
        for batch in batches:
            for rid, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = value.as_py()
                # A text beyond a block is looked at in stretches that share length - 1 bytes.
                for at in range(0, max(1, len(raw) - length + 1), BLOCK):
                    piece = raw[at : at + BLOCK + length - 1]
                    if len(piece) < length:
                        continue
                    if size + len(piece) > 2 * BLOCK:
                        yield block(rids, pieces, offsets)
                        rids, pieces, offsets, size = [], [], [], 0
                    rids.append(rid)
                    pieces.append(piece)
                    offsets.append(at)
                    size += len(piece)
            if size > BLOCK:
                yield block(rids, pieces, offsets)
                rids, pieces, offsets, size = [], [], [], 0
        if pieces:
            yield block(rids, pieces, offsets)

    return rows.select("rid", F.col("text").cast("binary").alias("raw")).where(F.length("raw") >= length).mapInArrow(run, "rid long, key long, seg long, start long, wins long, c long, again boolean")


COVERS = pa.schema([("rid", pa.int64()), ("start", pa.int64()), ("wins", pa.int64()), ("bucket", pa.int64()), ("prints", pa.binary())])
PRINT = np.dtype([("hi", "<u8"), ("lo", "<u8"), ("rid", "<i8"), ("start", "<i8"), ("single", "?")])


def shard_covers(length: int, buckets: int):
    """What one shard finds: covers of segments that occur once, and for spread keys fingerprints of its strings."""

    def run(table: pa.Table) -> pa.Table:
        contents = table.column("content").to_pylist()
        rid, start, wins, count, sub = (table.column(c).to_numpy() for c in ("rid", "start", "wins", "c", "sub"))
        sizes = np.array([len(x) for x in contents], np.int64)
        data = np.frombuffer(b"".join(contents), np.uint8)
        begin = np.cumsum(sizes) - sizes
        piece = np.repeat(np.arange(len(sizes)), sizes)
        within = np.arange(len(data)) - begin[piece]
        own = within < wins[piece]
        repeated, of = repeated_starts(data, own, length)
        at, n = runs(repeated & (count[piece] == 1), piece)
        out = [pa.table([rid[piece[at]], start[piece[at]] + within[at], n, pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.binary())], schema=COVERS)]
        if len(sub) and sub[0] >= 0:
            owned = np.flatnonzero(own)
            _, first = np.unique(of[owned], return_index=True)  # one for each distinct string
            places = owned[first]
            prints = np.empty(len(places), PRINT)
            prints["hi"], prints["lo"] = rolling(data, length)[places], rolling(data, length, 0x7654321, 0xA0761D6478BD642F)[places]
            prints["rid"], prints["start"] = rid[piece[places]], start[piece[places]] + within[places]
            prints["single"] = ~repeated[places] & (count[piece[places]] == 1)
            prints = prints[np.argsort(prints["hi"], kind="stable")]
            # The highest bits of a polynomial hash are its best; ranges of them are the buckets.
            bucket = ((prints["hi"] >> U(32)) * U(buckets) >> U(32)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            parts = [p for p in np.split(prints, cuts) if len(p)]
            ids = bucket[np.append(0, cuts)] if len(bucket) else bucket
            none = pa.nulls(len(parts), pa.int64())
            out.append(pa.table([none, none, none, pa.array(ids), pa.array([p.tobytes() for p in parts], pa.binary())], schema=COVERS))
        return pa.concat_tables(out)

    return run


def merge_prints(table: pa.Table) -> pa.Table:
    """Strings of one shard that another shard has too, by binary search in the other shards' sorted fingerprints."""
    shards = [np.frombuffer(x, PRINT) for x in table.column("prints").to_pylist()]
    everything = np.sort(np.concatenate([s["hi"] for s in shards]))
    again = []
    for s in shards:
        n = np.searchsorted(everything, s["hi"], "right") - np.searchsorted(everything, s["hi"], "left")
        again.append(s[n > 1])
    met = np.concatenate(again)
    order = np.lexsort((met["lo"], met["hi"]))
    met = met[order]
    same = (met["hi"][1:] == met["hi"][:-1]) & (met["lo"][1:] == met["lo"][:-1])
    hit = np.append(same, False) | np.append(False, same)
    met = met[hit & met["single"]] if len(met) else met
    return pa.table({"rid": met["rid"], "start": met["start"], "wins": np.ones(len(met), np.int64)})


def repeated_spans(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(rid, spans): the maximal runs of bytes to remove, by start. rows has rid and text."""
    listed = staged(list_segments(rows, length, gram), "segments")
    covers = listed.where("again").select("rid", "start", "wins")
    counted = listed.where("c > 0")
    # Written first, so that the joins below have two shuffled sides and Spark can split a hot key.
    keys = staged(counted.groupBy("key").agg(F.sum("c").alias("n"), F.min("seg").alias("least"), F.max("seg").alias("most")).where("n > 1"), "keys")
    shared = staged(counted.join(keys, "key").select("rid", "key", "seg", "start", "wins", "c", (F.col("least") != F.col("most")).alias("mixed")), "shared")
    covers = covers.unionByName(shared.where("not mixed and c = 1").select("rid", "start", "wins"))

    mixed = shared.where("mixed")
    different = staged(mixed.groupBy("key", "seg").agg(F.sum("c").alias("c"), F.min(F.struct("rid", "start", "wins")).alias("rep")).select("key", "seg", "c", "rep.*"), "different")
    several = different.where("c > 1").select("key", "seg")
    covers = covers.unionByName(mixed.where("c = 1").join(several, ["key", "seg"]).select("rid", "start", "wins"))

    sizes = staged(different.groupBy("key").agg(F.count(F.lit(1)).alias("d"), F.sum(F.col("wins") + length).alias("bytes")), "sizes")
    total = sizes.agg(F.sum("bytes").alias("bytes"), F.sum(F.when(F.col("d") > KEY_SEGMENTS, F.col("bytes"))).alias("spread")).first()
    if total["bytes"]:
        shards, buckets = max(1, -(-total["bytes"] // SHARD)), max(1, -(-(total["spread"] or 0) // MERGE_ROWS))
        spread = F.col("d") > KEY_SEGMENTS
        placed = different.join(sizes.select("key", "d"), "key").select(
            "rid",
            F.struct(
                "start",
                "wins",
                "c",
                F.when(spread, F.col("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(shards))).alias("shard"),
                F.when(spread, F.pmod(F.xxhash64("seg"), F.ceil(F.col("d") / KEY_SEGMENTS))).otherwise(-1).cast("long").alias("sub"),
            ).alias("s"),
        )
        wanted = placed.groupBy("rid").agg(F.collect_list("s").alias("own"))
        bodies = rows.join(wanted, "rid").select("rid", F.col("text").cast("binary").alias("raw"), F.explode("own").alias("s"))
        bodies = bodies.select("rid", "s.*", F.expr(f"substring(raw, cast(s.start + 1 as int), cast(s.wins + {length - 1} as int))").alias("content"))
        found = staged(bodies.groupBy("shard", "sub").applyInArrow(shard_covers(length, buckets), "rid long, start long, wins long, bucket long, prints binary"), "covers")
        merged = found.where("bucket is not null").select("bucket", "prints").groupBy("bucket").applyInArrow(merge_prints, "rid long, start long, wins long")
        covers = covers.unionByName(found.where("bucket is null").select("rid", "start", "wins")).unionByName(merged)

    edges = covers.select("rid", "start", (F.col("start") + F.col("wins") + length - 1).alias("end"))
    by_start = Window.partitionBy("rid").orderBy("start", "end")
    reach = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    runs_ = edges.withColumn("new", (F.coalesce(reach, F.lit(-1)) < F.col("start")).cast("int")).withColumn("run", F.sum("new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs_.groupBy("rid", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return spans.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, raw (its UTF-8 bytes), spans (array of start, end removed) and kept (bytes left).

    A string of `length` bytes counts as repeated if it also starts at any other place of the same or another
    document; strings do not cross documents. Null counts as empty; texts below `length` bytes are kept whole; very
    long texts are looked at in overlapping stretches. Rows that repeat doc_id and text repeat each other's strings,
    so from `length` bytes on they are removed whole. An empty table gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    spans = repeated_spans(rows.select("rid", "text"), length, gram)
    joined = rows.join(spans, "rid", "left").select("doc_id", F.col("text").cast("binary").alias("raw"), F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"))
    # The stretches between the spans, joined as hex: linear in the text's length.
    left = "if(i = 0, 0, spans[i - 1].end)"
    kept = F.expr(f"unhex(array_join(transform(sequence(0, size(spans)), i -> hex(substring(raw, cast({left} + 1 as int), cast(if(i = size(spans), length(raw), spans[i].start) - {left} as int)))), ''))")
    return joined.withColumn("kept", F.when(F.size("spans") == 0, F.col("raw")).otherwise(kept))


def digests(deduped: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the input), n_removed, n_spans, kept_sha256, spans (start:end of the removed runs, comma-joined)."""
    listed = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return deduped.select("doc_id", F.length("raw").cast("long").alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), listed.alias("spans"))
