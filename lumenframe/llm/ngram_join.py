"""N-gram Jaccard self-join by chosen paths: documents whose sets of five-word shingles have a similarity of 0.8 or more.

Documents of equal sets are one class from the start; the join runs over distinct sets. A set is embedded by
COORDINATES min-hashes. In each of RUNS runs a set goes down a tree: every node samples coordinates, and the sets
that share the sampled token go to the same child. Nodes of at most LEAF sets are leaves and are brute-forced;
larger ones split again (now and then by two coordinates, so that a similar pair is lost more slowly) down to DEPTH.
A pair whose shared nodes are small stays together in one run with its similarity. In a crowd it has to survive the
splits too, so sets that are in more than SPARE large nodes go on to CROWD_RUNS runs: as many as bring the chance of missing a pair at the
threshold, split down to DEPTH in each of them, below 1 - RECALL, whatever share of the coordinates it agrees in.

Brute force first compares byte sketches of SKETCH min-hashes, which rules out a pair at the threshold with a chance
of 2e-8, then the sets themselves. A pair that shares several leaves counts in the least of them only. A leaf of more
than BUCKET sets is dealt out in tiles of TILE x TILE sets. Pairs are never written out:
a tile gives each set's number of links and a star for each connected part, and the stars' components are the classes.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import keyed, small_batches, staged

SHINGLE, SIMILARITY = 5, 0.8
COORDINATES, SKETCH = 128, 64
RECALL = 1 - 1e-6
#: Runs of every set; one keeps a pair at the threshold in one node with chance 0.8, and 0.2 ** RUNS is far below 1 - RECALL.
RUNS = 12
BUCKET, TILE, DEPTH = 256, 512, 5
#: Sets of a leaf: up to here a split would lose more links than it saves comparisons.
LEAF = 8 * TILE
#: One node in BRANCHING splits by two coordinates.
BRANCHING = 4
#: Shingles that the sets of one block should have together, which bounds a tile's memory for very long texts.
TILE_SHINGLES = 1 << 20
#: Keys of sets that are split are broadcast up to this many rows of 16 bytes.
BROADCAST_ROWS = 1_000_000
#: Least number of equal sketch bytes of a pair worth comparing.
SKETCH_MATCHES = 32


def survival(agreeing: float, depth: int) -> float:
    """Chance that one run keeps a pair together down to depth, if it agrees in that share of the coordinates."""
    kept = 1.0
    for _ in range(depth - 1):
        kept = (1 - 1 / BRANCHING) * agreeing * kept + (1 - (1 - agreeing * kept) ** 2) / BRANCHING
    return agreeing * kept


def missed(runs: int, depth: int) -> float:
    """Chance that no run keeps a pair at the threshold together; the runs share the coordinates, so they are not independent."""
    n = COORDINATES
    return sum(math.comb(n, k) * SIMILARITY**k * (1 - SIMILARITY) ** (n - k) * (1 - survival(k / n, depth)) ** runs for k in range(n + 1))


#: Large nodes that a set may be in: what the other runs miss of its pairs is still below 1 - RECALL.
SPARE = RUNS - math.ceil(math.log(1 - RECALL) / math.log(1 - SIMILARITY))
#: Runs of a set that was in more than SPARE nodes of more than LEAF sets.
CROWD_RUNS = next(r for r in range(RUNS, COORDINATES) if missed(r, DEPTH) < 1 - RECALL)

U = np.uint64
WORD = re.compile(r"[^\W_]+")
BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(20240229)
FACTORS = _rng.integers(1, 2**63, COORDINATES, dtype=np.uint64) * U(2) + U(1)
OFFSETS = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64)
_POWERS = np.ones(1, U)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.append(U(1), np.full(max(n, 1 << 16), U(BASE))), dtype=U)
    return _POWERS


def shingles_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts, and how many each text has. Shorter texts are one shingle of all words."""
    words = [WORD.findall(t.lower()) for t in texts]
    raw = np.frombuffer("".join(" ".join(w) + " " for w in words).encode("utf-8", "replace"), np.uint8)
    p = powers(len(raw) + 1)
    prefix = np.append(U(0), np.cumsum((raw.astype(U) + U(1)) * p[: len(raw)], dtype=U))
    ends = np.flatnonzero(raw == 32)
    counts = np.array([len(w) for w in words], np.int64)
    real = np.maximum(counts, 1)  # a text without words still has its separator
    first = np.cumsum(real) - real
    n = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(texts)), n)
    at = np.arange(len(doc)) - (np.cumsum(n) - n)[doc] + first[doc]
    last = at + np.minimum(counts[doc], SHINGLE) - 1
    begin = np.append(0, ends + 1)[at]
    h = (prefix[ends[last]] - prefix[begin]) * p[len(raw) - begin]  # the same string at any place has the same hash
    h *= inverse_power(len(raw))
    h ^= h >> U(31)
    h *= U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32)), n


def inverse_power(n: int) -> np.uint64:
    """BASE ** -n modulo 2**64."""
    return U(pow(pow(BASE, -1, 2**64), n, 2**64))


def described(texts: list[str]) -> list[tuple[bytes, int, list[int], bytes]]:
    """(identity of the set, its size, min-hashes, sketch) of each text; size 0 for texts without words."""
    out = []
    h, n = shingles_of(texts)
    ends = np.cumsum(n)
    some = np.flatnonzero(n)
    mins = np.zeros((len(texts), COORDINATES), np.uint32)
    if len(some):
        starts = (ends - n)[some]
        for k in range(COORDINATES):
            mins[some, k] = np.minimum.reduceat((h * FACTORS[k] + OFFSETS[k]) >> U(32), starts).astype(np.uint32)
    for i in range(len(texts)):
        own = np.unique(h[ends[i] - n[i] : ends[i]])
        out.append((xxhash.xxh3_128_digest(own.tobytes()), len(own), mins[i].view(np.int32).tolist(), (mins[i, :SKETCH] & 255).astype(np.uint8).tobytes()))
    return out


def in_blocks(texts: list[str], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    start, total = 0, 0
    for i, t in enumerate(texts):
        if total > size:
            yield start, i
            start, total = i, 0
        total += len(t)
    if texts:
        yield start, len(texts)


def describe_sets(rows: DataFrame) -> DataFrame:
    """(doc_id, rid, identity, size, mins, sketch) of rows with doc_id, rid and text."""
    schema = pa.schema([("doc_id", pa.int64()), ("rid", pa.int64()), ("identity", pa.binary()), ("size", pa.int64()), ("mins", pa.list_(pa.int32())), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for a, b in in_blocks(texts):
                identity, size, mins, sketch = zip(*described(texts[a:b]), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(identity, pa.binary()), pa.array(size, pa.int64()), pa.array(mins, pa.list_(pa.int32())), pa.array(sketch, pa.binary())], schema=schema)

    return rows.select("doc_id", "rid", "text").mapInArrow(run, "doc_id long, rid long, identity binary, size long, mins array<int>, sketch binary")


def by_group(df: DataFrame, keys: list[str], work: Callable[[pa.Table], list[dict]], schema: str, out: pa.Schema) -> DataFrame:
    """Applies work to every group of keys; groups are small, so many share a partition, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def groups(table: pa.Table, whole: bool) -> tuple[list[dict], pa.Table | None]:
            marks = [table.column(k).to_numpy() for k in keys]
            change = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1
            edges = np.append(np.append(0, change), len(table))
            found: list[dict] = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if b == len(table) and not whole:
                    return found, table.slice(a)
                found += work(table.slice(a, b - a))
            return found, None

        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            found, rest = groups(table.combine_chunks(), False)
            yield pa.RecordBatch.from_pylist(found, schema=out)
        if rest is not None:
            yield pa.RecordBatch.from_pylist(groups(rest.combine_chunks(), True)[0], schema=out)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def leaves_of(sets: DataFrame) -> DataFrame:
    """(leaf, sid, m, total): leaves of at least two sets, with the number of their sets and shingles, over all runs."""

    def roots(own: DataFrame, first: int, end: int) -> DataFrame:
        tokens = F.posexplode(F.slice("mins", first + 1, end - first)).alias("run", "token")
        return own.select("sid", "size", tokens).select("sid", "size", F.xxhash64(F.col("run") + first, "token").alias("leaf"))

    def with_sizes(nodes: DataFrame, name: str) -> DataFrame:
        sizes = nodes.groupBy("leaf").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("total")).where("m > 1")
        return staged(nodes.join(sizes, "leaf").select("leaf", "sid", "m", "total"), name)

    nodes = roots(sets, 0, RUNS)
    done = []
    for depth in range(1, DEPTH + 1):
        sized = with_sizes(nodes, f"nodes{depth}")
        if depth == 1 and not (large := sized.where(F.col("m") > LEAF)).isEmpty():
            counts = staged(large.groupBy("sid").agg(F.count(F.lit(1)).alias("n")), "large")
            # Only the min-hashes of sets in large nodes take part in the splits.
            split = staged(sets.select("sid", "size", "mins").join(F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts, "sid"), "split")
            # A pair is safe by the small nodes of either of its sets; else both are in many large ones, so both go on.
            crowd = split.where(F.col("n") > SPARE)
            sized = sized.unionByName(with_sizes(roots(crowd, RUNS, CROWD_RUNS), "crowd"))
        last = depth == DEPTH
        done.append(sized if last else sized.where(F.col("m") <= LEAF))
        large = sized.where(F.col("m") > LEAF)
        if last or large.isEmpty():
            break
        branches = F.explode(F.when(F.pmod(F.xxhash64("leaf", F.lit("branch")), F.lit(BRANCHING)) == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
        chosen = large.select("leaf", "sid", branches.alias("branch")).withColumn("at", F.pmod(F.xxhash64("leaf", "branch"), F.lit(COORDINATES)).cast("int"))
        nodes = chosen.join(split.drop("n"), "sid").select("sid", "size", F.xxhash64("leaf", "branch", F.get("mins", F.col("at"))).alias("leaf")).distinct()
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def tiled(leaves: DataFrame) -> DataFrame:
    """(leaf, i, j, block, sid): every set of a leaf goes to the tiles of its block's row and column; most leaves are one tile."""
    by_number = F.when(F.col("m") <= BUCKET, 1).otherwise(F.ceil(F.col("m") / TILE))
    own = leaves.withColumn("blocks", F.greatest(F.lit(1), by_number, F.ceil(F.col("total") / TILE_SHINGLES)).cast("int")).withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    tiles = own.select("leaf", "sid", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return tiles.select("leaf", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "sid")


def earlier(paths: list[list[int]], leaf: int) -> np.ndarray:
    """Pairs that meet in a lesser leaf already."""
    m = len(paths)
    below = [[p for p in own if p < leaf] for own in paths]
    values = {v: k for k, v in enumerate({v for own in below for v in own})}
    member = np.zeros((m, max(1, len(values))), np.float32)
    for i, own in enumerate(below):
        member[i, [values[v] for v in own]] = 1
    return member @ member.T > 0


def plausible(group: dict, leaf: int) -> np.ndarray:
    """The pairs of a tile that this leaf must compare: symmetric, False on the diagonal."""
    sketch = np.frombuffer(b"".join(group["sketch"]), np.uint8).reshape(-1, SKETCH)
    size = np.array(group["size"], np.float64)
    m = len(size)
    block = np.array(group["block"])
    ok = np.minimum(size[:, None], size[None, :]) >= SIMILARITY * np.maximum(size[:, None], size[None, :]) - 1e-9
    np.fill_diagonal(ok, False)
    if group["i"][0] != group["j"][0]:
        ok &= block[:, None] != block[None, :]
    if ok.any():
        equal = np.zeros((m, m), np.int16)
        for k in range(SKETCH):
            equal += sketch[:, k][:, None] == sketch[:, k][None, :]
        ok &= equal >= SKETCH_MATCHES
    return ok & ~earlier(group["paths"], leaf) if ok.any() else ok


def intersections(sets: list[np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the wanted pairs."""
    m = len(sets)
    out = np.zeros((m, m), np.int64)
    if m <= 24:
        for i, j in zip(*np.nonzero(np.triu(wanted)), strict=True):
            out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    tokens, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    shared = df > 1  # a token of one set adds nothing
    column = np.cumsum(shared) - 1
    keep = shared[inverse]
    owner, column = owner[keep], column[inverse[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    step = max(256, (1 << 21) // m)
    total = np.zeros((m, m), np.float32)
    for a in range(0, int(shared.sum()), step):
        lo, hi = np.searchsorted(column, [a, a + step])
        part = np.zeros((m, step), np.float32)
        part[owner[lo:hi], column[lo:hi] - a] = 1
        total += part @ part.T
    return np.rint(total).astype(np.int64)


def components_of(linked: np.ndarray) -> np.ndarray:
    """The least index of each index's connected part."""
    label = np.arange(len(linked))
    while True:
        least = np.where(linked, label[None, :], len(linked)).min(axis=1)
        new = np.minimum(label, least)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def verified(group: dict, leaf: int) -> list[dict]:
    """Links of one tile: per set its number of linked documents and, for a star, the least set of its part."""
    wanted = plausible(group, leaf)
    sets = [np.frombuffer(s, U) for s in group["members"]]
    size = np.array([len(s) for s in sets], np.int64)
    both = intersections(sets, wanted)
    linked = wanted & (both >= SIMILARITY * (size[:, None] + size[None, :] - both) - 1e-9)
    if not linked.any():
        return []
    documents = np.array(group["documents"], np.int64)
    links, root = linked @ documents, components_of(linked)
    sid = group["sid"]
    return [{"sid": sid[k], "links": int(links[k]), "root": sid[root[k]]} for k in np.flatnonzero(linked.any(axis=1)).tolist()]


def members_of(rows: DataFrame) -> DataFrame:
    """(sid, members): the sorted shingle hashes of rows with sid and text."""
    schema = pa.schema([("sid", pa.int64()), ("members", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in in_blocks(texts):
                h, n = shingles_of(texts[a:b])
                ends = np.cumsum(n)
                sets = [np.unique(h[e - k : e]).tobytes() for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sets, pa.binary())], schema=schema)

    return rows.select("sid", "text").mapInArrow(run, "sid long, members binary")


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b), root being the least node of its component.

    Alternates large-star and small-star steps; each is an aggregate and a join. The aggregates group by a struct, so
    that their partitions do not serve for the join: both its sides are shuffled and Spark can split a hub.
    """
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.struct("a").alias("k")).agg(F.min("b").alias("m")).select(F.col("k.a").alias("a"), F.least("k.a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        below = large.groupBy(F.struct("a").alias("k")).agg(F.min("b").alias("m")).select(F.col("k.a").alias("a"), "m")
        small = large.join(below, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e")).select("e.a", F.col("e.m").alias("b")).where("a <> b").distinct()
        now = staged(small, "edges")
        new = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if new == mark:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, rid, class_id, n_links, n_copies, n_shingles, first (is it its class's first row).

    n_links counts the other documents whose similarity is at least 0.8, copies included; classes are the connected
    groups of links and class_id is the least doc_id of a class; n_copies counts the documents of the same set. Words
    are lower-cased runs of letters and digits; a text of fewer than five words is one shingle of all of them. Null
    and empty texts and texts without words have no links and are classes of their own. Repeated rows are copies.
    Null doc_ids come first in a class. An empty table gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    described_ = staged(describe_sets(rows), "sets")
    sid = F.xxhash64("identity", "size")
    worded = described_.where("size > 0")
    sets = staged(worded.groupBy("identity", "size").agg(F.count(F.lit(1)).alias("documents"), F.min("rid").alias("rep"), F.first("mins").alias("mins"), F.first("sketch").alias("sketch")).select(sid.alias("sid"), "size", "documents", "rep", "mins", "sketch"), "distinct")

    leaves = leaves_of(sets)
    paths = leaves.groupBy("sid").agg(F.sort_array(F.collect_set("leaf")).alias("paths"))
    known = sets.drop("mins").join(paths, "sid")
    tile = ["leaf", "i", "j"]
    placed = tiled(leaves).join(known, "sid")

    def active(table: pa.Table) -> list[dict]:
        group = table.to_pydict()
        own = plausible(group, group["leaf"][0])
        return [{"leaf": group["leaf"][k], "i": group["i"][k], "j": group["j"][k], "block": group["block"][k], "sid": group["sid"][k]} for k in np.flatnonzero(own.any(axis=1)).tolist()]

    place = pa.schema([("leaf", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("block", pa.int32()), ("sid", pa.int64())])
    wanted = staged(by_group(placed.select(*tile, "block", "sid", "size", "sketch", "paths"), tile, active, "leaf long, i int, j int, block int, sid long", place), "wanted")

    reps = known.join(wanted.select("sid").distinct(), "sid", "left_semi")
    bodies = members_of(rows.join(reps.select(F.col("rep").alias("rid"), "sid"), "rid"))
    dealt = wanted.join(bodies, "sid").join(reps.drop("rep"), "sid")

    def links(table: pa.Table) -> list[dict]:
        group = table.to_pydict()
        first = list({s: k for k, s in reversed(list(enumerate(group["sid"])))}.values())  # rows repeat where input rows do
        group = {c: [v[k] for k in sorted(first)] for c, v in group.items()}
        return verified(group, group["leaf"][0])

    star = pa.schema([("sid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
    found = staged(by_group(dealt, tile, links, "sid long, links long, root long", star), "links")

    total = found.groupBy("sid").agg(F.sum("links").alias("links"))
    roots = connected(found.select(F.col("sid").alias("a"), F.col("root").alias("b")))
    # Written, like the class heads below, so that the joins that follow have two shuffled sides and Spark can split a hot one.
    whole = sets.select("sid", "documents").join(total, "sid", "left").join(roots.withColumnRenamed("node", "sid"), "sid", "left")
    whole = staged(whole.select("sid", "documents", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "sid").alias("root")), "whole")
    every = described_.select("doc_id", "rid", "size", sid.alias("sid"))
    member = every.where("size > 0").join(whole, "sid")
    firsts = staged(member.groupBy("root").agg(F.min(F.struct("doc_id", "rid")).alias("head"), F.min("doc_id").alias("class_id")), "firsts")
    classed = member.join(firsts, "root").select(
        "doc_id",
        "rid",
        "class_id",
        (F.col("links") + F.col("documents") - 1).alias("n_links"),
        F.col("documents").alias("n_copies"),
        F.col("size").alias("n_shingles"),
        F.struct("doc_id", "rid").eqNullSafe(F.col("head")).alias("first"),
    )
    alone = every.where("size = 0").select("doc_id", "rid", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"), F.col("size").alias("n_shingles"), F.lit(True).alias("first"))
    return classed.unionByName(alone)
