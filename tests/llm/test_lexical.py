"""Ranked search against scoring every document with plain Python."""
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tollgate.llm import common, lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    N, L = sum(1 for _, c in counts if c), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        asked = Counter(terms(text))
        scored = []
        for d, c in counts:
            m = 25 + 75 * c.total() * N // max(L, 1)
            s = sum(r * math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t, r in asked.items() if c[t])
            if s > 0:
                scored.append((-s, (d is not None, d or 0), d))
        out += [(item, rank + 1, d, -s) for rank, (s, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def sample(seed, n=300):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "naïve", "42", "日本"]
    text = lambda most: rng.choice([" ", ", ", "\n"]).join(rng.choice([str.upper, str])(rng.choice(vocabulary[:rng.randint(3, 64)])) for _ in range(rng.randint(0, most)))
    docs = [(i * 7 % 1009, text(rng.choice([5, 60, 400]))) for i in range(n)]
    docs += [(5000 + i, "w1 w2 w3 copy") for i in range(120)] + [(None, "w1 w2"), (None, None), (6000, ""), (6001, "..."), (7, "w1 w5 42"), (7, "w1 w5 42"), (6002, "w9 " * 5000 + "w1")]
    items = [(i, text(30)) for i in range(30)] + [(100, None), (101, ""), (102, "absent"), (3, "w1 w1 W1 w2"), (103, "copy w1"), (104, "w9 42")]
    return docs, items


@pytest.mark.parametrize("seed,postings,queries,broadcast", [(1, 2_000_000, 2000, 500_000), (2, 700, 10, 500_000), (3, 2_000, 2000, 5)])
def test_against_scoring_all(spark, monkeypatch, seed, postings, queries, broadcast):
    common.prepare(spark)
    for name, value in (("POSTINGS", postings), ("QUERIES", queries), ("BROADCAST_TERMS", broadcast)):
        monkeypatch.setattr(lexical, name, value)
    docs, items = sample(seed)
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS id", "'x' AS terms", "2 AS m").repartition(4)
    q = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS query", "2 AS block")
    assert sorted((tuple(r) for r in lexical.search(d, q).collect()), key=str) == brute(docs, items)


def test_empty_tables(spark):
    common.prepare(spark)
    docs, items = sample(1, 20)
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert lexical.search(d.limit(0), q).collect() == [] and lexical.search(d, q.limit(0)).collect() == []


def test_long_texts_in_stretches():
    for text in ("", "a", "A b " * 100 + "c" * 50 + "é,É" * 9, "x" * 99):
        for stretch in (1, 7, 1000):
            assert lexical.counts_of(text.encode(), stretch) == Counter(t.encode() for t in terms(text))


def test_bounds_stop_the_visits():
    """Strata whose bound is below the k-th score are not visited."""
    rows = [{"id": i, "m": 25 + i % 40, "terms": ["rare", "w"] if i < 12 else ["w"], "tfs": [9, 1] if i < 12 else [1]} for i in range(4000)]
    shard = lexical.Shard(pa.Table.from_pylist(rows))
    codes = np.array([shard.terms["rare"], shard.terms["w"]])
    docs, scores, visited = shard.best(codes, np.array([9000, 10]), 10)
    assert visited < len(shard.m) and sorted(shard.ids[docs].tolist()) == list(range(10))
    assert (np.diff(scores) <= 0).all()


def test_waves_of_any_size():
    rng = random.Random(5)
    rows = [{"id": rng.randint(0, 200), "m": 25 + rng.randint(0, 30), "terms": sorted(rng.sample("abcdef", 3)), "tfs": [rng.randint(1, 4) for _ in range(3)]} for _ in range(500)]
    shard = lexical.Shard(pa.Table.from_pylist(rows))
    codes, weights = np.array([shard.terms[t] for t in "ace"]), np.array([700, 20, 3])
    scores = {}
    for i, r in enumerate(rows):
        scores[i] = sum(w * (1000000000 * f // (1000 * f + 8 * r["m"])) for t, w in zip("ace", weights.tolist()) for u, f in zip(r["terms"], r["tfs"]) if t == u)
    best = sorted(((-s, rows[i]["id"]) for i, s in scores.items() if s))[:10]
    for room in (1, 50, 10_000):
        docs, found, _ = shard.best(codes, weights, 10, room)
        assert [(-s, d) for s, d in zip(found.tolist(), shard.ids[docs].tolist())] == best
