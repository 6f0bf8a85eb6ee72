"""The random field against sums over all tag sequences; held-out accuracy; edge cases."""
import itertools

import numpy as np
import pytest

from tollgate.llm import common, toxicity


def test_marginals_are_exact():
    rng = np.random.default_rng(4)
    lengths = [0, 1, 5, 3, 0, 7]
    first = np.concatenate([[0], np.cumsum(lengths)])
    score, move = rng.normal(0, 2, first[-1]), rng.normal(0, 1, (2, 2))
    got = toxicity.marginals(score, first, move)
    for a, b in zip(first[:-1], first[1:]):
        mass, tagged = 0.0, np.zeros(b - a)
        for tags in itertools.product((0, 1), repeat=int(b - a)):
            w = np.exp(sum(s * t for s, t in zip(score[a:b], tags)) + sum(move[i, j] for i, j in zip(tags, tags[1:])))
            mass += w
            tagged += w * np.array(tags)
        if b > a:
            assert np.allclose(got[a:b], tagged / mass)
    segments = score[:14].reshape(2, 7)
    p, moves = toxicity._pairs(segments, 7, move)
    assert np.allclose(p.ravel(), toxicity.marginals(score[:14], np.array([0, 7, 14]), move))
    assert np.isclose(moves.sum(), 12)


def test_held_out_accuracy_and_spans(spark):
    common.prepare(spark)
    sf = "/root/testdata/sf0.1"
    labels = common.table(spark, sf, "labels")
    docs = common.table(spark, sf, "documents").join(labels.select("doc_id"), "doc_id", "left_semi")
    found = toxicity.toxicity(docs, labels).join(labels.filter(toxicity.held_out()), "doc_id").join(docs.select("doc_id", "text"), "doc_id").collect()
    toxic = [r.predicted for r in found if r.toxic == 1]
    clean = [r.predicted for r in found if r.toxic == 0]
    assert np.mean(toxic) >= 0.9 and np.mean(clean) <= 0.02
    marked = [r for r in found if r.spans and r.toxic == 1]
    assert marked
    for r in marked[:20]:
        for s in r.spans:
            word = r.text[s.start:s.end]
            assert word and not any(c.isspace() for c in word) and 0.5 <= s.p <= 1


def test_edges(spark):
    common.prepare(spark)
    rows = [(1, None), (2, ""), (None, "some text"), (4, "word " * 30_000), (4, "word " * 30_000), (5, "!!! ...")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS spans")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.score == 0.0 and r.predicted == 0 and r.spans == [] for r in toxicity.toxicity(docs, none).collect())
    assert toxicity.toxicity(docs.limit(0), none).count() == 0
    assert toxicity.observations("...") == [] and "widiot" in toxicity.observations("Idiot!!")
    bad = [f"you idiot number {i}" * 15 for i in range(30)]
    good = [f"a kind word number {i} " * 15 for i in range(60)]
    model = toxicity.fit([t.encode() for t in bad + good], np.array([1] * 30 + [0] * 60), np.ones(90), 1 / 3)
    p, first, _, _ = model.marginals([b"you idiot", b"a kind word", b""])
    assert p[:2].max() > 0.5 > p[2:].max() and len(first) == 4


def test_training_segments_count_for_all_tokens():
    rng = np.random.default_rng(8)
    docs = [rng.integers(0, 50, int(n)).astype(np.int32) for n in rng.integers(0, 300, 120)]
    toxic, cue = rng.integers(0, 2, 120), np.arange(50) == 7
    rows, tags, weights = toxicity.training_segments(docs, toxic, cue)
    assert sum(w.sum() * r.shape[1] for r, w in zip(rows, weights)) == pytest.approx(sum(map(len, docs)))
    assert sum((w @ t).sum() for t, w in zip(tags, weights)) == sum(int(cue[d].sum()) for d, k in zip(docs, toxic) if k)


def test_weighted_segments_equal_repeated_ones():
    rng = np.random.default_rng(9)
    score, move, weight = rng.normal(0, 1, (4, 5)), rng.normal(0, 1, (2, 2)), np.array([1, 3, 1, 2])
    _, moves = toxicity._pairs(score, 5, move, weight)
    assert moves == pytest.approx(toxicity._pairs(np.repeat(score, weight, axis=0), 5, move)[1])
