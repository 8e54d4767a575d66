"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Sets are word shingles of five words. An item of n distinct shingles is contained in a document that has at least
ceil(0.8 n) of them. Items are partitioned by size, in classes that double. An item's sketch are its least hashes, as
many as its size asks for: of any n - ceil(0.8 n) + 1 shingles of an item a document that contains it has at least one.
The largest hash of a class's sketches is the class's bound. A document's sketch for a class are its hashes up to that
bound, taken only where the document is large enough to hold the share asked for of an item of that class, so a short
item is found however long the document is. Sketches meet by (class, hash). Candidates are verified on the shingles
themselves. DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.llm.common import keyed, staged

SHINGLE = 5
#: At least this share of an item's shingles, as a fraction.
SHARE = (4, 5)
#: Items' shingles are broadcast up to this many rows (of about 60 bytes); beyond, the join is shuffled.
BROADCAST_ROWS = 200_000
#: The same for the keys of documents to verify, of about 16 bytes.
CANDIDATE_ROWS = 1_000_000
#: Hashes have so many bits; a class's number stands above them in its keys.
HASH_BITS = 57


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def exploded(rows: DataFrame, lengths: list[int], *keep: str) -> DataFrame:
    """A row for each shingle of any of the lengths: the kept columns, len, h (its hash) and, computed on demand, its words."""
    lengths = sorted(lengths)
    own = rows.where(F.size("words") >= lengths[0]).select(*keep, "words", F.explode(F.sequence(F.lit(0), F.size("words") - lengths[0])).alias("at"))
    if len(lengths) == 1:
        own = own.withColumn("len", F.lit(lengths[0]))
    else:
        own = own.select("*", F.explode(F.array(*[F.lit(n) for n in lengths])).alias("len")).where(F.col("at") + F.col("len") <= F.size("words"))
    parts = lambda n: [F.get("words", F.col("at") + i) for i in range(n)]

    def by_length(of) -> Column:
        return reduce(lambda rest, n: F.when(F.col("len") == n, of(n)).otherwise(rest), lengths[1:], of(lengths[0]))

    h = by_length(lambda n: F.xxhash64(F.lit(n), *parts(n)))
    return own.select(*keep, "len", h.bitwiseAND(F.lit((1 << HASH_BITS) - 1)).alias("h"), by_length(lambda n: F.concat_ws(" ", *parts(n))).alias("shingle"))


def class_key(size_class: Column, h: Column) -> Column:
    return F.shiftleft(size_class.cast("long"), HASH_BITS).bitwiseOR(h)


def item_shingles(benchmark: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(distinct items' shingles, item ids of each distinct item). Items of the same words are one item."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), words_of(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("words")).where(F.size("words") > 0)
    items = items.withColumn("item", F.xxhash64("words"))
    members = items.select("item", "item_id").distinct()
    distinct = items.groupBy("item").agg(F.first("words").alias("words"))
    by_length = [exploded(distinct.where(F.size("words") >= SHINGLE), [SHINGLE], "item")]
    by_length += [exploded(distinct.where(F.size("words") == n), [n], "item") for n in range(1, SHINGLE)]
    shingles = reduce(DataFrame.unionByName, by_length).dropDuplicates(["item", "shingle"])
    own = Window.partitionBy("item")
    shingles = shingles.withColumn("n", F.count(F.lit(1)).over(own)).withColumn("nth", F.row_number().over(own.orderBy("h", "shingle")))
    need = F.ceil(F.col("n") * SHARE[0] / SHARE[1])
    shingles = shingles.withColumn("need", need.cast("int")).withColumn("class", F.ceil(F.log2("n")).cast("int"))
    return shingles.withColumn("sketch", F.col("nth") <= F.col("n") - F.col("need") + 1), members


def contained_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and benchmark item that it contains: doc_id, rid, item_id, n_item, n_shared, containment.

    n_item and n_shared count distinct shingles. Items of fewer than five words are one shingle of all their words;
    items and documents without a word match nothing. Null texts count as empty. Repeated rows give one pair,
    repeated items one for each item_id; empty tables give no rows. Other columns are ignored.
    """
    shingles, members = item_shingles(benchmark, item_id_col, item_text_col)
    shingles = staged(shingles, "items")
    # A row for each length and size class: a few dozen however many items there are.
    classes = shingles.groupBy("len", "class").agg(F.count(F.lit(1)).alias("rows"), F.max(F.when(F.col("sketch"), F.col("h"))).alias("bound"), F.min("need").alias("need")).collect()
    lengths = sorted({c["len"] for c in classes}) or [SHINGLE]
    small = sum(c["rows"] for c in classes) <= BROADCAST_ROWS

    def probed(side: DataFrame) -> DataFrame:
        return F.broadcast(side) if small else side

    rows = keyed(docs, id_col, text_col)
    worded = rows.select("rid", words_of(F.col("text")).alias("words")).withColumn("n_words", F.size("words"))
    # A document of w words has at most w - len + 1 shingles; a smaller one cannot hold the share of an item.
    of_class = [F.when((F.col("len") == c["len"]) & (F.col("h") <= c["bound"]) & (F.col("n_words") - F.col("len") + 1 >= c["need"]), class_key(F.lit(c["class"]), F.col("h"))) for c in classes]
    sketched = exploded(worded, lengths, "rid", "n_words").select("rid", F.explode(F.array(*(of_class or [F.lit(None).cast("long")]))).alias("key")).where("key is not null")
    sketches = shingles.where("sketch").select(class_key(F.col("class"), F.col("h")).alias("key")).distinct()
    candidates = staged(sketched.join(probed(sketches), "key").select("rid").distinct(), "candidates")

    few = candidates.count() <= CANDIDATE_ROWS
    sure = rows.join(F.broadcast(candidates) if few else candidates, "rid", "left_semi").select("doc_id", "rid", words_of(F.col("text")).alias("words"))
    pairs = exploded(sure, lengths, "doc_id", "rid").join(probed(shingles.select("h", "shingle", "item", "n", "need")), ["h", "shingle"])
    verified = pairs.groupBy("doc_id", "rid", "item", "n", "need").agg(F.count_distinct("shingle").alias("shared")).where("shared >= need")
    out = verified.join(probed(members) if small else members, "item")
    return out.select("doc_id", "rid", "item_id", F.col("n").cast("long").alias("n_item"), F.col("shared").cast("long").alias("n_shared"), (F.col("shared") / F.col("n")).alias("containment"))
