"""The corpus pipeline, stage by stage against brute force on a small corpus."""

import hashlib
import random
import re

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lumenframe.llm import bpe
from lumenframe.llm.common import staged


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    rnd = random.Random(8)
    words = [f"{a}{b}" for a in ("re", "in", "the", "ou", "ti") for b in ("on", "er", "st", "ing", "ed", "ly")]
    some = lambda n: " ".join(rnd.choice(words) + rnd.choice(words) for _ in range(n))
    good = [some(120) for _ in range(120)]
    bad = ["".join(rnd.choice("!#$%&*?QZX") for _ in range(500)) for _ in range(120)]
    items = [some(30) for _ in range(5)]
    rows = [(k, t) for k, t in enumerate(good + bad)]
    rows += [(300 + k, t.upper()) for k, t in enumerate(good[:5])]  # equal but for case
    rows += [(400 + k, t.replace(t.split()[50], "changed")) for k, t in enumerate(good[10:15])]  # near copies
    rows += [(500 + k, some(60) + " " + t + " " + some(60)) for k, t in enumerate(items)]  # leaks
    rows += [(600, some(60)), (600, None)]
    rows.append(rows[3])
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long"), "_lf_rid": F.lit(1)})
    d.write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(k, int(k < 120), 0) for k in range(240)], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder), rows


def test_stages(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, folder), name)
        assert docs.columns == columns, name
        kept[name] = sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())
    first = kept["quality_classifier"]
    assert not any(120 <= d < 240 for d, _ in first) and {d for d, _ in first if d < 120} == set(range(120))
    lower = {}
    for d, t in first:
        lower[t.lower()] = max(d, lower.get(t.lower(), -1))
    second = sorted((d, t) for d, t in set(first) if lower[t.lower()] == d)
    assert kept["exact_dedup"] == second
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [re.findall(r"[^\W_]+", t.lower())] for i in range(len(w) - 4)}
    sets = [shingles(t) for _, t in second]
    third = [x for k, x in enumerate(second) if not any(sets[k] and len(sets[k] & sets[j]) >= 0.8 * len(sets[k] | sets[j]) for j in range(k))]
    assert kept["ngram_jaccard_join"] == third and len(third) < len(second)
    assert kept["benchmark_decontamination"] == [x for x in third if not 500 <= x[0] < 510]


def test_run(spark, corpus):
    folder, _ = corpus
    got = corpus_pipeline.run(spark, folder).collect()
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(f.read()), special_tokens={})
    texts = {(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()): r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert 100 < len(got) < 140 and all(r.n_tokens == len(other.encode_ordinary(texts[(r.doc_id, r.decoded_sha256)])) for r in got)


def test_empty_tables(spark, corpus, tmp_path):
    folder, _ = corpus
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path)).count() == docs.count()


def test_registered_queries():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert [n for n in names if re.match(r"op\d+_", n)] == [n for k in range(1, 11) for n in names if n.startswith(f"op{k}_")] and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names) and corpus_pipeline.ORACLE_SQL is None
