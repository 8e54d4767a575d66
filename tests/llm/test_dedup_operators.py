"""Operators over pairs and copies, against brute force on small tables with nulls, repeats, ties and hot groups."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import decontamination, exact_dedup, line_dedup, ngram_join, suffix_arrays

SCHEMA = "doc_id long, text string"


def frame(spark, rows):
    """With extra columns whose names operators might use themselves."""
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(0) for c in ("rid", "key", "n", "size", "spans", "keep", "fp", "words", "_lf_rid")})


def test_counting_quotient_filters_merge_without_loss():
    r = np.random.default_rng(1)
    parts = [r.integers(0, 50, 300, dtype=np.uint64) << np.uint64(40) | r.integers(0, 3, 300, dtype=np.uint64) for _ in range(7)]
    whole = exact_dedup.CountingQuotientFilter.merge([exact_dedup.CountingQuotientFilter.load(exact_dedup.CountingQuotientFilter.build(p).dump()) for p in parts])
    keys, counts = np.unique(np.concatenate(parts), return_counts=True)
    assert (whole.fingerprints() == keys).all() and (whole.counts == counts).all()
    cut = [f for _, f in whole.cut(4)]
    assert (np.concatenate([f.fingerprints() for f in cut]) == keys).all()


def test_merged_runs_are_exact():
    r = np.random.default_rng(2)
    for _ in range(40):
        parts = [r.choice(np.append(r.integers(0, 2**63, 30, dtype=np.uint64), r.integers(0, 5, 8, dtype=np.uint64)), r.integers(0, 200)) for _ in range(r.integers(1, 6))]
        whole = exact_dedup.CountingQuotientFilter.merge([exact_dedup.CountingQuotientFilter.build(p) for p in parts])
        keys, counts = np.unique(np.concatenate(parts), return_counts=True)
        assert (whole.fingerprints() == keys).all() and (whole.counts == counts).all()
        assert (np.diff(whole.occupied.astype(np.int64)) > 0).all() and whole.run_end.sum() == len(whole.occupied)


def test_exact_dedup_without_broadcast(spark, monkeypatch):
    rows = [(k, "abc"[k % 3] * (k % 7)) for k in range(60)]
    some = lambda: sorted(map(tuple, exact_dedup.exact_dedup(frame(spark, rows)).collect()))
    expected = some()
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 0)
    assert some() == expected


def test_exact_dedup(spark):
    rows = [(5, "Abc"), (7, "aBC"), (9, "ÀBC"), (1, "àbc"), (2, None), (3, ""), (None, "abc"), (None, "lone"), (4, "x" * 50_000), (6, "X" * 50_000), (8, "same"), (8, "same")] + [(100 + k, "hot") for k in range(300)]
    got = exact_dedup.exact_dedup(frame(spark, rows)).collect()
    norm = lambda t: (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    groups = defaultdict(list)
    for d, t in rows:
        groups[norm(t)].append(d)
    assert len(got) == len(rows)
    for r in got:
        t = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256 and r.doc_id in groups[t])
        ids = [d for d in groups[t] if d is not None]
        assert (r.keep_id, r.group_size) == (max(ids) if ids else None, len(groups[t]))
    assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.exact_dedup(frame(spark, rows).limit(0)).count() == 0


def test_line_dedup(spark):
    rnd = random.Random(2)
    rows = [(k, "\n".join(rnd.choice("abcde") for _ in range(rnd.randint(0, 12)))) for k in range(40)] + [(50, None), (51, "a\nb"), (52, "long\n" * 3000)]
    seen, expected = set(), {}
    for d, t in rows:
        lines = (t or "").split("\n")
        gone = set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if w in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(w)
        expected[d] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone))
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.line_dedup(frame(spark, rows)).collect()}
    assert got == expected
    repeated = line_dedup.line_dedup(frame(spark, [(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc")])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in repeated) == [(0, 0), (1, 3), (1, 3)]
    assert line_dedup.line_dedup(frame(spark, rows).limit(0)).count() == 0


def shingles(text, n=5):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def test_decontamination(spark):
    rnd = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(rnd.choice(words) for _ in range(n))) for k, n in enumerate([1, 3, 5, 6, 20, 40, 40])] + [(20, None), (21, "..."), (22, None)]
    items.append((30, items[5][1].upper()))
    rows = [(k, " ".join(rnd.choice(words) for _ in range(400))) for k in range(20)]
    for k, (_, t) in enumerate(items):
        w = (t or "").split()
        rows.append((100 + k, " ".join([rnd.choice(words) for _ in range(3000)] + w + [rnd.choice(words) for _ in range(30)])))
        if len(w) > 10:
            w[3] = "changed"
            rows.append((200 + k, "Start, " + "; ".join(w) + ". End"))
            rows.append((300 + k, " ".join(w[: len(w) // 2])))
    rows += [(400, None), (401, ""), (402, "w1")]

    def contained(t, item):
        own = shingles(item)
        n = len(next(iter(own))) if own else 0
        w = re.findall(r"[^\W_]+", (t or "").lower())
        have = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        return len(own), len(own & have)

    expected = sorted((d, i, n, s) for d, t in rows for i, x in items for n, s in [contained(t, x)] if n and 5 * s >= 4 * n)
    docs, tests = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string").withColumn("h", F.lit(1))
    got = sorted((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in decontamination.contained_items(docs, tests).collect())
    assert got == expected and len(got) > 10
    decontamination.BROADCAST_ROWS, limit = 0, decontamination.BROADCAST_ROWS
    try:
        assert sorted((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in decontamination.contained_items(docs, tests).collect()) == expected
    finally:
        decontamination.BROADCAST_ROWS = limit
    assert decontamination.contained_items(docs, tests.limit(0)).count() == 0


def linked(rows):
    sets = [shingles(t) for _, t in rows]
    links = [[j for j in range(len(rows)) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9] for i in range(len(rows))]
    root = list(range(len(rows)))
    for _ in rows:
        root = [min([root[i], *(root[j] for j in links[i])]) for i in range(len(rows))]
    groups = defaultdict(list)
    for i, r in enumerate(root):
        groups[r].append(rows[i][0])
    return sorted((rows[i][0], min(groups[root[i]]), len(links[i])) for i in range(len(rows)))


@pytest.mark.parametrize(("bucket", "tile", "shingles_"), [(256, 512, 1 << 20), (8, 7, 1 << 20), (256, 512, 1000)])
def test_chosen_path_join_loses_no_link(spark, monkeypatch, bucket, tile, shingles_):
    monkeypatch.setattr(ngram_join, "TILE_SHINGLES", shingles_)
    monkeypatch.setattr(ngram_join, "BUCKET", bucket)
    monkeypatch.setattr(ngram_join, "LEAF", bucket)
    monkeypatch.setattr(ngram_join, "TILE", tile)
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    some = lambda n: [rnd.choice(words) for _ in range(n)]
    docs = []
    for _ in range(25):
        base = some(rnd.randint(3, 200))
        docs.append(" ".join(base))
        for _ in range(rnd.choice([0, 1, 2, 5])):
            w = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 3])):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            docs.append(rnd.choice([" ", ". ", ", "]).join(w))
    base, passage = some(300), some(40)
    docs += [" ".join([*base[:k], f"z{k}", *base[k + 1 :]]) for k in range(50)]  # one large group of near copies
    docs += [" ".join(some(60) + passage + some(60)) for _ in range(40)]  # one common passage
    docs += [None, "", "...", "a b", "A b!", docs[0], docs[0], "long " * 20_000]
    rows = list(enumerate(docs))
    rows.append(rows[0])
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in ngram_join.similar_documents(frame(spark, rows)).collect())
    assert got == linked(rows)


@pytest.mark.parametrize("leaf", [256, 4096])
def test_crowd_loses_no_link(spark, monkeypatch, leaf):
    """More different sets than BUCKET, nearly all of whose pairs have a similarity of 0.80 to 0.85, in split nodes and in tiles."""
    monkeypatch.setattr(ngram_join, "LEAF", leaf)
    rnd = random.Random(6)
    base = [f"w{k}" for k in range(300)]
    docs = []
    for k in range(600):
        w = list(base)
        for i in rnd.sample(range(300), 3):
            w[i] = f"z{k}x{i}"
        docs.append(" ".join(w))
    sets = [shingles(t) for t in docs]
    place = {s: i for i, s in enumerate(set().union(*sets))}
    member = np.zeros((len(docs), len(place)), np.float32)
    for i, own in enumerate(sets):
        member[i, [place[s] for s in own]] = 1
    both, size = member @ member.T, member.sum(axis=1)
    alike = both / (size[:, None] + size[None, :] - both)
    assert np.mean((alike >= 0.8) & (alike < 0.85)) > 0.8
    expected = ((alike >= 0.8 - 1e-9).sum(axis=1) - 1).tolist()
    got = {r.doc_id: r.n_links for r in ngram_join.similar_documents(frame(spark, list(enumerate(docs)))).collect()}
    assert sum(expected) - sum(got.values()) == 0 and [got[k] for k in range(len(docs))] == expected


def test_chance_of_a_missed_link():
    assert ngram_join.missed(ngram_join.CROWD_RUNS, ngram_join.DEPTH) < 1e-6 and 0.2 ** (ngram_join.RUNS - ngram_join.SPARE) < 1e-6


def test_join_of_nothing(spark):
    assert ngram_join.similar_documents(frame(spark, [(1, "a")]).limit(0)).count() == 0
    rows = ngram_join.similar_documents(frame(spark, [(None, None), (3, "one two three")])).collect()
    assert sorted((r.doc_id or 0, r.n_links, r["first"]) for r in rows) == [(0, 0, True), (3, 0, True)]


def brute_spans(texts, length):
    counts = defaultdict(int)
    for t in texts:
        for i in range(len(t) - length + 1):
            counts[t[i : i + length]] += 1
    out = []
    for t in texts:
        cover = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                cover[i : i + length] = b"\1" * length
        kept = bytes(b for b, c in zip(t, cover, strict=True) if not c)
        out.append((len(t), sum(cover), sum(c and not (i and cover[i - 1]) for i, c in enumerate(cover)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("spread", "shard", "block"), [(1000, 1 << 20, 1 << 21), (3, 3000, 1000)])
def test_suffix_dedup(spark, monkeypatch, spread, shard, block):
    for name, value in (("KEY_SEGMENTS", spread), ("SHARD", shard), ("BLOCK", block), ("MERGE_ROWS", 500)):
        monkeypatch.setattr(suffix_arrays, name, value)
    rnd = random.Random(3)
    parts = ["anti", "the", "è", "und", "of", "ß", "ing", "st", "x", "\x00"]
    some = lambda n: " ".join(rnd.choice(parts) + rnd.choice(parts) for _ in range(n))
    passages = [some(150) for _ in range(4)]
    docs = []
    for _ in range(40):
        own = [some(rnd.randint(1, 150)) for _ in range(rnd.randint(0, 3))] + rnd.sample(passages, rnd.randint(0, 3))
        rnd.shuffle(own)
        docs.append("\n".join(own))
    docs += [docs[3], docs[5] + "z", None, "", "a" * 1500, "ab" * 900, docs[7][10:], "q" * 399, "r" * 400, "r" * 400]
    docs += [d[: rnd.randint(0, len(d))] + "Q" + d[rnd.randint(0, len(d)) :] for d in docs[:10]]
    rows = list(enumerate(docs))
    rows += [rows[0], (None, docs[1])]
    got = sorted(((r.doc_id if r.doc_id is not None else -1), *tuple(r)[1:5]) for r in suffix_arrays.digests(suffix_arrays.suffix_dedup(frame(spark, rows))).collect())
    expected = sorted((-1 if d is None else d, *b) for (d, _), b in zip(rows, brute_spans([(t or "").encode() for _, t in rows], 400), strict=True))
    assert got == expected


def test_passages_of_many_documents(spark):
    """Passages of 51 to 200 words in several documents: those of LENGTH bytes go, as brute force says; shorter ones stay."""
    rnd = random.Random(31)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(n) for n in (51, 55, 60, 64, 68, 72, 80, 120, 200)]
    rows = [(k, " ".join([prose(rnd.randint(5, 60)), passages[k % 9], prose(rnd.randint(5, 60))])) for k in range(36)] + [(100 + k, prose(150)) for k in range(10)]
    seen = defaultdict(int)
    raw = {d: t.encode() for d, t in rows}
    for t in raw.values():
        for i in range(len(t) - suffix_arrays.LENGTH + 1):
            seen[t[i : i + suffix_arrays.LENGTH]] += 1
    got = {r.doc_id: r for r in suffix_arrays.digests(suffix_arrays.suffix_dedup(frame(spark, rows))).collect()}
    for d, t in raw.items():
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - suffix_arrays.LENGTH + 1):
            if seen[t[i : i + suffix_arrays.LENGTH]] > 1:
                gone[i : i + suffix_arrays.LENGTH] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        spans = ",".join(f"{a}:{b}" for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()))
        assert (got[d].n_bytes, got[d].n_removed, got[d].spans) == (len(t), int(gone.sum()), spans)
        long = d < 100 and len(passages[d % 9]) >= suffix_arrays.LENGTH
        assert (got[d].n_removed > 0) == long
    assert 0 < sum(len(p) < suffix_arrays.LENGTH for p in passages) < 9


def test_suffix_dedup_of_nothing(spark):
    assert suffix_arrays.suffix_dedup(frame(spark, [(1, "a")]).limit(0)).count() == 0


def test_suffix_order_and_common_prefixes():
    rnd = random.Random(3)
    for trial in range(60):
        data = np.array([rnd.choice([0, 97, 98]) for _ in range(rnd.randint(1, 300))], np.uint8)
        data = np.tile(data[: max(1, len(data) // 7)], 9) if trial % 3 == 0 else data
        text, n = data.tobytes(), len(data)
        order, group, h = suffix_arrays.suffix_order(data, 40)
        assert sorted(order.tolist()) == list(range(n))
        heads = [text[i : i + h] for i in order]
        assert all(a <= b for a, b in zip(heads, heads[1:]))
        common = suffix_arrays.common_prefixes(data, order, group, h)
        for r in range(1, n):
            a, b = heads[r - 1], heads[r]
            same = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
            assert common[r] == (h if group[order[r]] == group[order[r - 1]] else same)
