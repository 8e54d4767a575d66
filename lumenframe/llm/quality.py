"""Quality classifier by compression: two zstandard dictionaries, one from good and one from bad labelled text.

A text is compressed with both. The difference of the two sizes, normalised by their sum, says which dictionary
knows it better; with the two compression ratios it goes through a logistic calibration to a score from 0 to 1.
Training sees a bounded sample of the labelled rows (SAMPLE_PER_CLASS documents and CHUNKS_PER_CLASS passages of
CHUNK characters a class, chosen by a hash of doc_id); class weights restore the share that each class has over
all labels. Scoring compresses every whole text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import small_batches

SAMPLE_PER_CLASS = 6000
CHUNKS_PER_CLASS = 2000
CHUNK = 2000
DICT_BYTES = 64 * 1024
LEVEL = 3
FOLDS = 5
THRESHOLD = 0.3


@dataclass(frozen=True)
class QualityModel:
    """What scoring needs: the dictionaries, the features' scale and the calibration. good is empty if there was nothing to learn."""

    good: bytes
    bad: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    prior: float

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        out = []
        for raw in (self.good, self.bad):
            words = zstandard.ZstdCompressionDict(raw)
            words.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(dict_data=words))
        return out[0], out[1]

    def probabilities(self, features: np.ndarray) -> np.ndarray:
        z = design((features - np.array(self.mean)) / np.array(self.scale)) @ np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def design(z: np.ndarray) -> np.ndarray:
    z = np.clip(z, -8, 8)
    return np.concatenate([np.ones((len(z), 1)), z, z * z], axis=1)


def features_of(text: bytes, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> tuple[float, float, float]:
    """Normalised difference of the compressed sizes, and both ratios to the text's length."""
    g, b = len(good.compress(text)), len(bad.compress(text))
    n = len(text) + 32
    return (b - g) / (b + g), g / n, b / n


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == 0


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weighted ridge logistic regression by damped Newton steps."""
    coef = np.zeros(x.shape[1])

    def loss(c: np.ndarray) -> float:
        z = x @ c
        return float((w * (np.logaddexp(0, z) - y * z)).sum() + ridge * (c @ c) / 2)

    now = loss(coef)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ coef, -30, 30)))
        gradient = x.T @ (w * (y - p)) - ridge * coef
        step = np.linalg.solve((x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(coef)), gradient)
        rate = 1.0
        while rate > 1e-4 and loss(coef + rate * step) > now:
            rate /= 2
        coef = coef + rate * step
        new = loss(coef)
        if now - new < 1e-7 * (1 + abs(now)):
            break
        now = new
    return coef


def feature_udf(model: QualityModel):
    @F.pandas_udf("array<double>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        good, bad = model.compressors()
        for texts in batches:
            yield pd.Series([list(features_of((t or "").encode("utf-8", "replace"), good, bad)) for t in texts])

    return features


def score_udf(model: QualityModel):
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if not model.good:
            for texts in batches:
                yield pd.Series(np.full(len(texts), model.prior))
            return
        good, bad = model.compressors()
        for texts in batches:
            rows = [features_of((t or "").encode("utf-8", "replace"), good, bad) for t in texts]
            yield pd.Series(model.probabilities(np.array(rows, dtype=float).reshape(-1, 3)))

    return score


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Learns from labelled rows outside the held-out fold; labels that are null or neither 0 nor 1 count for nothing."""
    small_batches(docs.sparkSession)
    label = F.col(label_col).cast("int")
    usable = labels.select(F.col(id_col).cast("long").alias("doc_id"), label.alias("y")).where("y in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
    totals = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = totals.get(1, 0) / sum(totals.values()) if totals else 0.5
    empty = QualityModel(b"", b"", (0.0,) * 3, (1.0,) * 3, (0.0,) * 7, prior)
    if len(totals) < 2:
        return empty

    spread = F.xxhash64("doc_id", F.lit("sample"))
    sample = None
    for y in (0, 1):
        own = usable.where(F.col("y") == y).orderBy(spread, "doc_id").limit(SAMPLE_PER_CLASS)
        sample = own if sample is None else sample.unionByName(own)
    # At most 2 * SAMPLE_PER_CLASS rows of two numbers, so a broadcast; the texts are never shuffled.
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    learned = texts.join(F.broadcast(sample), "doc_id")

    at = F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / CHUNK).cast("int")))
    passages = learned.where(F.length("text") > 0).select("doc_id", "y", "text", at.alias("at"))
    passages = passages.select("y", "doc_id", "at", F.expr(f"substring(text, at * {CHUNK} + 1, {CHUNK})").alias("passage"))
    dictionaries = []
    for y in (1, 0):
        chosen = passages.where(F.col("y") == y).orderBy(F.xxhash64("doc_id", "at"), "doc_id", "at").limit(CHUNKS_PER_CLASS).collect()
        samples = [r["passage"].encode("utf-8", "replace") for r in chosen]
        try:
            dictionaries.append(zstandard.train_dictionary(DICT_BYTES, samples).as_bytes())
        except (zstandard.ZstdError, ValueError):  # too few samples for the trainer: use the text itself
            raw = b"\n".join(samples)[-DICT_BYTES:]
            dictionaries.append(raw if len(raw) >= 8 else b"        ")
    model = QualityModel(dictionaries[0], dictionaries[1], empty.mean, empty.scale, empty.weights, prior)

    rows = learned.select("y", feature_udf(model)("text").alias("f")).collect()
    if len({r["y"] for r in rows}) < 2:
        return empty
    x, y = np.array([r["f"] for r in rows], dtype=float), np.array([r["y"] for r in rows], dtype=float)
    order = np.lexsort((*x.T, y))  # the same model whatever order the rows came in
    x, y = x[order], y[order]
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    share = np.array([(y == 0).sum(), (y == 1).sum()])
    weight = np.array([totals[0], totals[1]]) / share
    weight = weight / (weight @ share) * len(y)
    coef = fit_logistic(design((x - mean) / scale), y, weight[y.astype(int)])
    if not all(math.isfinite(c) for c in coef):
        return empty
    return QualityModel(model.good, model.bad, tuple(mean.tolist()), tuple(scale.tolist()), tuple(coef.tolist()), prior)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    The score depends on the text alone. Null and empty texts are scored as the empty text; texts of any length are
    compressed whole; repeated rows get equal scores. Without labels of both classes every score is the labels' mean
    (0.5 if there are none). A null doc_id counts as the text '' for the fold. Other columns are ignored.
    """
    model = train(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    scored = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_udf(model)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
