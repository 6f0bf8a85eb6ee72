"""Nearest neighbours against brute force."""
import numpy as np
import pytest

from tollgate.llm import ann, common


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        order = [j for j in np.lexsort((ids, d)) if d[j] < np.inf][:k]
        out[q] = [(int(ids[j]), float(d[j])) for j in order]
    return out


@pytest.mark.parametrize("part_rows", [2000, 10])
def test_recall_and_scores(spark, part_rows):
    """One level of parts, and two; blocks of 500 rows and queries."""
    common.prepare(spark)
    rng = np.random.default_rng(3)
    n = 6000
    centres = rng.standard_normal((24, 16)) * 3
    x = (centres[rng.integers(0, 24, n)] + rng.standard_normal((n, 16))).astype(np.float32)
    x[:1500] = x[0]  # one vector fills a quarter of the table
    ids = rng.permutation(n)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>").repartition(4)
    got = ann.search(df, "vec_id % 100 = 0", sample=2048, block=500 if part_rows > 100 else 20, part_rows=part_rows).collect()
    want = brute(ids, x.astype(np.float64), [i for i in range(0, n, 100)], 10)
    found = {}
    for r in got:
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(found) == set(want)
    hit = 0
    for q, best in want.items():
        assert sorted(found[q]) == list(range(1, 11))
        mine = [found[q][k] for k in range(1, 11)]
        assert mine == sorted(mine, key=lambda p: (p[1], p[0]))
        hit += len({i for i, _ in mine} & {i for i, _ in best})
        d = {i: s for i, s in best}
        assert all(abs(s - d[i]) < 1e-12 for i, s in mine if i in d)
    assert hit / (10 * len(want)) >= 0.9


def test_edges(spark):
    common.prepare(spark)
    rows = [(0, [1.0, 0.0]), (100, [0.0, 0.0]), (200, None), (300, [float("nan"), 1.0]), (400, [1.0, None]), (500, [1.0, 2.0, 3.0]),
            (None, [1.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [1.0, 1.0]), (2, [1.0, 1.0]), (600, [float("inf"), 0.0]), (700, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS part", "2 AS block", "3 AS rank")
    got = [tuple(r) for r in ann.search(df, "vec_id % 100 = 0").orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 1.0), (0, 3, 3, 1.0)]
    assert ann.search(df.limit(0), "vec_id % 100 = 0").count() == 0


def test_parts_are_balanced():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1001, 8))
    part = ann.balanced_parts(ann.nearest(x, x, 10, skip_self=True), 3)
    assert sorted(np.bincount(part)) == [125] * 7 + [126]


@pytest.mark.parametrize("rows", [100, 500, 2000])
def test_small_tables_have_parts_too(spark, rows):
    """Every table size is split by a learned router; recall and the share of rows that a query meets."""
    common.prepare(spark)
    df = common.table(spark, "/root/testdata/sf0.1", "embeddings").filter(f"vec_id < {rows}")
    assigned, asked = ann.index(df, "vec_id % 20 = 0")
    sizes = dict(assigned.groupBy("part").count().collect())
    assert len(sizes) >= 2 and sum(sizes.values()) == rows
    met = asked.groupBy("vec_id").agg({"part": "count"}).collect()
    assert len(met) == rows // 20
    got = ann.search(df, "vec_id % 20 = 0").collect()
    local = df.select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in local]), np.array([r.embedding for r in local], float)
    want = brute(ids, x, [i for i in range(0, rows, 20)], 10)
    hits = sum(r.vec_id in {i for i, _ in want[r.query_id]} for r in got)
    assert hits / sum(map(len, want.values())) >= 0.9


def test_two_levels_split_large_parts(spark):
    common.prepare(spark)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((6000, 8)) + 4 * rng.standard_normal((40, 8))[rng.integers(0, 40, 6000)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assigned, asked = ann.index(df, "vec_id % 100 = 0", part_rows=10, sample=2048, block=64)
    sizes = dict(assigned.groupBy("part").count().collect())
    assert len(sizes) > ann.WIDTH and sum(sizes.values()) == 6000  # more parts than one router can have
    visited = asked.join(assigned.groupBy("part").count(), "part").groupBy("vec_id").agg({"count": "sum"}).collect()
    assert len(visited) == 60 and np.median([r[1] for r in visited]) < 3000
