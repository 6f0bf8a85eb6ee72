"""Mixing against plain targets, all subsets of small knapsacks, and the budget."""
import itertools
import random
import re
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from tollgate.llm import common, mixing


def plain_targets(sizes, weights=(5, 2, 1)):
    """Share by weight, stop at twice the size, share the excess again, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, budget, free = {}, 1.5 * sum(sizes.values()), set(order)
    while free:
        share = {s: budget * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= 2 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            budget -= target[s]
            free.remove(s)
    return target


def sample(seed, n=600):
    rng = random.Random(seed)
    sources = [None, "", "a", "b", "é", "Z", "z1"] + ["hot"] * 5
    rows = [(i, rng.choice(["word ", "two words\n", "a\tb c "]) * rng.randint(0, 30), rng.choice(sources)) for i in range(n)]
    rows += [(9000 + i, "same copy of five words", "hot") for i in range(150)] + [(7, "again and again", "hot")] * 90
    return rows + [(None, "no id here", "a"), (None, "no id here", "a"), (1, None, "a"), (2, "", None), (3, " \n", "empty"), (4, "x " * 50_000, "long"), (5, "é ü w", "b")]


def check(rows, found):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += words(t)
    target = plain_targets(sizes)
    key = {s: "1" if s is None else "0" + s for s in sizes}
    assert sorted(((d, words(t), key[s]) for d, t, s in rows), key=str) == sorted(((r.doc_id, r.size, r.key) for r in found), key=str)
    taken, shortest = defaultdict(int), defaultdict(lambda: 10**9)
    for r in found:
        taken[r.key] += r.taken
        assert r.taken == r.copies * r.size and 0 <= r.taken <= 2 * r.size
        if r.size:
            shortest[r.key] = min(shortest[r.key], r.size)
    for s, k in key.items():
        for r in found:
            if r.key == k:
                assert r.source_size == sizes[s] and abs(r.target - target[s]) <= 1e-9 * max(target[s], 1)
        assert abs(taken[k] - target[s]) <= (shortest[k] + 1 if sizes[s] else 0)
        groups = defaultdict(list)
        for r in found:
            if r.key == k:
                groups[r.size].append(r.copies)
        for copies in groups.values():
            assert max(copies) - min(copies) <= 1


def test_mix(spark, monkeypatch):
    common.prepare(spark)
    for stratum, exact in ((4096, 1 << 16), (8, 200)):
        monkeypatch.setattr(mixing, "STRATUM", stratum)
        rows = sample(stratum)
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS copies", "'k' AS key")
        found = mixing.mix(df.repartition(5), exact=exact).collect()
        check(rows, found)
        again = mixing.mix(df.repartition(3, "text"), exact=exact).collect()
        cells = lambda rows: sorted((tuple(r)[:7] for r in rows), key=str)
        assert cells(found) == cells(again)
        total = sum(r.copies for r in found)
        out = mixing.mixed(df, exact=exact)
        assert out.columns == df.columns and out.count() == total


def test_empty(spark):
    common.prepare(spark)
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(df).collect() == [] and mixing.mixed(df).collect() == []
    (r,) = mixing.mix(spark.createDataFrame([(1, None, None)], df.schema)).collect()
    assert (r.size, r.target, r.taken) == (0, 0.0, 0)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.integers(0, 3)), min_size=1, max_size=5, unique_by=lambda x: x[0]), st.integers(0, 150))
def test_knapsack_is_nearest(pairs, budget):
    lengths, counts = map(list, zip(*pairs))
    taken = mixing.knapsack(lengths, counts, budget)
    assert all(0 <= t <= c for t, c in zip(taken, counts))
    sums = [sum(n * k for n, k in zip(lengths, ks)) for ks in itertools.product(*(range(c + 1) for c in counts))]
    assert abs(sum(n * t for n, t in zip(lengths, taken)) - budget) == min(abs(s - budget) for s in sums)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 500), st.integers(1, 400)), min_size=1, max_size=40, unique_by=lambda x: x[0]), st.floats(0, 2))
def test_fit_stays_within_counts(pairs, share):
    lengths, counts = map(list, zip(*pairs))
    size = sum(n * c for n, c in pairs)
    budget = int(size * share)
    repeats, more = mixing.fit(lengths, counts, budget)
    assert all(0 <= t <= c for t, c in zip(more, counts))
    total = repeats * size + sum(n * t for n, t in zip(lengths, more))
    assert abs(total - budget) <= max((n for n in lengths if n), default=0)
