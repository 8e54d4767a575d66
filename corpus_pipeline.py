"""A corpus pipeline over documents: quality, exact dedup, near-duplicate join, decontamination, BPE encoding.

Each stage is a function of (spark, docs, sf_dir) and works on all that its predecessor kept. All stages but the last
return the columns of documents; the last returns one row of digests per remaining document.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import bpe, decontamination, exact_dedup, ngram_join, quality
from lumenframe.llm.common import fresh, rid_of, scratch_dir, table

VOCABULARY = "byte_bpe_50k.tiktoken"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from this stage's documents and the labels outside its held-out fold.

    Null texts are scored as empty ones and their rows stay as they are. Rows that repeat are scored alike. An empty
    table gives no rows; labels that are empty or of one kind give every text one score. Texts are scored whole, of any
    length. Other columns stay, whatever their names.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs, "score")
    scored = docs.withColumn(score, quality.score_udf(model)(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return scored.where(F.col(score) >= quality.THRESHOLD).drop(score)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal after lower-casing A-Z, the document with the largest doc_id; of repeated rows, one.

    A null text equals an empty one. A null doc_id is smaller than any other. Of rows that repeat doc_id and text one
    stays, whichever it is where they differ in other columns. An empty table gives no rows; texts may have any length;
    other columns stay, whatever their names.
    """
    kept = exact_dedup.exact_dedup(docs).where("kept")
    rid, own = fresh(docs, "rid"), exact_dedup.normalised(F.col("text").cast("string"))
    marked = docs.withColumn(rid, F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(own, 256).alias("text_sha256")))
    kept = kept.select(F.struct("doc_id", "text_sha256").alias(rid))
    # Only rows that repeat doc_id and text share a key; the join has dealt the rows out by it already.
    return marked.join(kept, rid, "left_semi").dropDuplicates([rid]).drop(rid)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document by doc_id of each class of near duplicates.

    Null and empty texts and texts without words are alike to nothing, so they stay. A null doc_id comes first. Rows that
    repeat doc_id and text stay or go together. An empty table gives no rows; texts may have any length; other columns
    stay, whatever their names.
    """
    firsts = ngram_join.similar_documents(docs).where("first")
    rid = fresh(docs, "rid")
    return docs.withColumn(rid, rid_of("doc_id", "text")).join(firsts.select(F.col("rid").alias(rid)), rid, "left_semi").drop(rid)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.

    Null and empty texts contain none, and neither do items without words. Rows that repeat stay or go together. An empty
    table gives no rows, an empty benchmark takes none away; texts may have any length; other columns stay, whatever
    their names.
    """
    hits = decontamination.contained_items(docs, table(spark, sf_dir, "benchmark")).select("rid").distinct()
    rid = fresh(docs, "rid")
    return docs.withColumn(rid, rid_of("doc_id", "text")).join(hits.withColumnRenamed("rid", rid), rid, "left_anti").drop(rid)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every remaining document.

    A null text has no tokens, like an empty one. Repeated rows give equal rows; an empty table gives none. Texts are
    encoded whole, of any length; other columns are left out.
    """
    return bpe.digests(bpe.bpe_round_trip(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN))


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_jaccard_join", ngram_join_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("byte_bpe", bpe_stage),
]

#: No SQL: compressed sizes and token ids are beyond it. The tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
