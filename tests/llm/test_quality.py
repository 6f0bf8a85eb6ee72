"""Co-training: held-out accuracy on the given documents, and edge cases."""
import numpy as np

from tollgate.llm import common, quality


def test_held_out_accuracy(spark):
    common.prepare(spark)
    sf = "/root/testdata/sf0.01"
    labels = common.table(spark, sf, "labels")
    found = quality.quality(common.table(spark, sf, "documents"), labels).join(labels.filter(quality.held_out()), "doc_id").collect()
    good = [r.keep for r in found if r.quality == 1]
    poor = [r.keep for r in found if r.quality == 0]
    assert len(found) > 50 and np.mean(good) >= 0.97 and np.mean(poor) <= 0.25


def test_one_view_teaches_the_other():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 400).astype(float)
    a = y[:, None] * 3 + rng.standard_normal((400, 2))
    b = y[:, None] * 2 + rng.standard_normal((400, 3))
    py = rng.integers(0, 2, 2000).astype(float)
    pool = (py[:, None] * 3 + rng.standard_normal((2000, 2)), py[:, None] * 2 + rng.standard_normal((2000, 3)))
    few = np.arange(400) < 300
    model = quality.co_train((a, b), y, few, quality.LocalPool(pool))
    assert ((model.score(*pool) >= 0.5) == py).mean() > 0.93


def test_edges(spark):
    common.prepare(spark)
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "text", "en", "s", -5), (3, "w " * 50_000, "en", "s", 1), (3, "w " * 50_000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS score", "2 AS keep")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.keep and r.score == 1.0 for r in quality.quality(docs, none).collect())
    one_kind = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    assert quality.kept_documents(docs, one_kind).count() == len(rows)
    assert quality.kept_documents(docs, one_kind).columns == docs.columns
    assert quality.quality(docs.limit(0), none).count() == 0
    assert len(quality.statistics(b"")) == len(quality.statistics("É x\n||".encode())) == len(quality.CONTENT)


def two_views(seed=1, n=400, m=2000):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n).astype(float)
    py = rng.integers(0, 2, m).astype(float)
    views = lambda y: (y[:, None] * 3 + rng.standard_normal((len(y), len(quality.CONTENT))), np.abs(y[:, None] * 2 + rng.standard_normal((len(y), 2 * quality.HASHED + 1))))
    return views(y), y, views(py), py


def test_moments_against_plain_sums():
    """What the tasks add up is the loss's gradient and curvature over the rows that the other view is sure of."""
    (a, b), y, pool, _ = two_views()
    models = [quality.Logistic().fit(a, y), quality.Logistic().fit(b, y)]
    limits = [{1: 0.9}, {0: 0.8, 1: 0.95}]
    sums = quality.taught(models, limits, pool)
    parts = [quality.taught(models, limits, tuple(x[i::3] for x in pool)) for i in range(3)]
    assert np.allclose(sums, sum(parts))
    for v in (0, 1):
        d = len(models[v].coef)
        for label in (0, 1):
            n, g, h = 0, np.zeros(d), np.zeros((d, d))
            for row in range(len(pool[0])):
                p = quality.sigmoid(models[1 - v].logit(pool[1 - v][row:row + 1]))[0]
                limit = limits[1 - v].get(label)
                if limit is None or (p if label else 1 - p) < limit:
                    continue
                z = models[v]._columns(pool[v][row:row + 1])[0]
                q = quality.sigmoid(z @ models[v].coef)
                n, g, h = n + 1, g + (q - label) * z, h + max(q * (1 - q), 1e-6) * np.outer(z, z)
            size = 1 + d + d * d
            part, sums = sums[:size], sums[size:]
            assert part[0] == n and np.allclose(part[1:1 + d], g) and np.allclose(part[1 + d:], h.ravel())


def test_table_pool_equals_rows_in_memory(spark):
    common.prepare(spark)
    docs = common.table(spark, "/root/testdata/sf0.001", "documents").repartition(5)
    rows = common.written(quality.features(docs), "test-features")
    views = quality._views(rows.collect())
    y = (views[0][:, 0] > np.median(views[0][:, 0])).astype(float)
    models = [quality.Logistic().fit(views[v], y) for v in (0, 1)]
    limits = [{0: 0.7, 1: 0.7}, {0: 0.55, 1: 0.55}]
    table = quality.TablePool(rows)
    assert table.rows == len(views[0]) and np.allclose(table.taught(models, limits), quality.LocalPool(views).taught(models, limits))


def test_an_id_that_holds_a_third_of_the_rows(spark):
    common.prepare(spark)
    sf = "/root/testdata/sf0.001"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    hot = labels.filter(~quality.held_out()).orderBy("doc_id").first().doc_id
    many = docs.unionByName(docs.filter(f"doc_id = {hot}").selectExpr("*", "explode(sequence(1, 200)) AS copy").select(docs.columns))
    found = quality.quality(many, labels).collect()
    assert len(found) == many.count()
    plain = {r.doc_id: r.keep for r in quality.quality(docs, labels).collect()}
    assert np.mean([plain[r.doc_id] == r.keep for r in found]) > 0.97
