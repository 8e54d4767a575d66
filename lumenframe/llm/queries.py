"""Queries opN_<name> over the input tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import bpe, decontamination, exact_dedup, html_extraction, licenses, line_dedup, ngram_join, quality, secrets, suffix_arrays
from lumenframe.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

VOCABULARY = "byte_bpe_50k.tiktoken"


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("rid", "containment")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies", "n_shingles")


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_arrays.digests(suffix_arrays.suffix_dedup(table(spark, sf_dir, "documents")))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return bpe.digests(encoded)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.secret_spans(table(spark, sf_dir, "documents")))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.flat(licenses.license_scan(table(spark, sf_dir, "documents")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # the module stands at the top of the repository, not in the package

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "op1_html_extraction": op1_html_extraction,
        "op2_line_dedup": op2_line_dedup,
        "op3_benchmark_decontamination": op3_benchmark_decontamination,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
        "op6_suffix_array_dedup": op6_suffix_array_dedup,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_byte_bpe": op8_byte_bpe,
        "op9_secret_scan": op9_secret_scan,
        "op10_license_scan": op10_license_scan,
        "pipeline": pipeline,
    }


LINE_DEDUP_SQL = """
WITH l AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, i, ls[i] || chr(10) || ls[i + 1] || chr(10) || ls[i + 2] AS k
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM l)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS nth FROM w),
c AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r WHERE nth > 1) GROUP BY doc_id)
SELECT l.doc_id,
       CASE WHEN gone IS NULL THEN text
            ELSE array_to_string([ls[p] FOR p IN range(1, len(ls) + 1) IF NOT list_contains(gone, p)], chr(10)) END AS text,
       len(ls)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed
FROM l LEFT JOIN c USING (doc_id)
"""

DECONTAMINATION_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM benchmark),
bl AS (SELECT item_id, ws, least(5, len(ws)) AS m FROM b WHERE len(ws) > 0),
bs AS (SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS s
       FROM (SELECT item_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM bl)),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
ds AS (SELECT DISTINCT doc_id, m, array_to_string(ws[i:i + m - 1], ' ') AS s
       FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bl) WHERE len(ws) >= m))
SELECT doc_id, item_id, n_item::BIGINT AS n_item, count(*)::BIGINT AS n_shared
FROM ds JOIN bs USING (m, s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING count(*) >= ceil(n_item * 4 / 5.0)
"""

EXACT_DEDUP_SQL = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM t
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": LINE_DEDUP_SQL, "op3_benchmark_decontamination": DECONTAMINATION_SQL, "op7_exact_dedup": EXACT_DEDUP_SQL}
