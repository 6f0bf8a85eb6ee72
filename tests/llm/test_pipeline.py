"""The pipeline, stage by stage, against plain versions on small documents."""
import re
from collections import defaultdict

import corpus_pipeline
from tollgate.llm import common, simhash


def test_stages(spark, sf_small):
    docs = common.table(spark, sf_small, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "simhash", "substring_dedup", "packing"]
    seen = {}
    rows = docs
    for name, stage in corpus_pipeline.STAGES:
        before = rows.collect()
        rows = common.written(stage(spark, rows, sf_small), f"test-{name}")
        seen[name] = (before, rows.collect())
        if name != "packing":
            assert rows.columns == docs.columns
    before, after = seen["quality"]
    kept = {r.doc_id for r in after}
    labels = {r.doc_id: r.quality for r in common.table(spark, sf_small, "labels").collect()}
    good = [d for d, q in labels.items() if q == 1 and any(r.doc_id == d for r in before)]
    assert sum(d in kept for d in good) >= 0.97 * len(good)
    before, after = seen["exact_dedup"]
    last = defaultdict(int)
    for r in before:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), r.text)
        last[t] = max(last[t], r.doc_id)
    assert {r.doc_id for r in after} == set(last.values())
    before, after = seen["simhash"]
    fps = {r.doc_id: simhash.fingerprint(r.text.encode(), 3) for r in before}
    ids = sorted(fps)
    parent = {d: d for d in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if bin(fps[a] ^ fps[b]).count("1") <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert {r.doc_id for r in after} == {find(d) for d in ids}
    before, after = seen["substring_dedup"]
    first = {}
    words = {r.doc_id: r.text.split() for r in before}
    for d in sorted(words):
        for k in range(len(words[d]) - 12):
            first.setdefault(tuple(words[d][k:k + 13]), d)
    texts = {r.doc_id: r.text for r in after}
    assert set(texts) == set(words)
    for d, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k:k + 13])] < d:
                gone[k:k + 13] = [True] * 13
        assert texts[d].split() == [x for x, g in zip(w, gone) if not g]
    before, after = seen["packing"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}


def test_stages_on_an_empty_table(spark, sf_small):
    rows = common.table(spark, sf_small, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        rows = common.written(stage(spark, rows, sf_small), f"empty-{name}")
        assert rows.count() == 0


def test_stages_on_odd_rows(spark, sf_small):
    """Null and repeated ids, null, empty and very long texts, further columns of any name: no stage fails or loses a clean row."""
    docs = common.table(spark, sf_small, "documents")
    one = docs.orderBy("doc_id").first()
    odd = [(None, one.text + " of nobody", "en", None, 5), (None, None, None, None, None), (900_001, "", "en", "s", 0), (900_002, None, "en", "s", None),
           (900_003, "long words " * 100_000, "en", "s", 1), (900_004, one.text + " again", "en", "s", 3), (900_004, one.text + " once more and more", "en", "s", 3)]
    rows = docs.unionByName(spark.createDataFrame(odd, docs.schema)).selectExpr("*", "1 AS keep", "'c' AS chunk", "2 AS row", "doc_id AS component_id", "3 AS score")
    before = rows.count()
    for name, stage in corpus_pipeline.STAGES:
        rows = common.written(stage(spark, rows, sf_small), f"odd-{name}")
        if name != "packing":
            assert rows.columns == [*docs.columns, "keep", "chunk", "row", "component_id", "score"]
            assert rows.count() <= before
            before = rows.count()
    assert rows.select("doc_id").distinct().count() > 100
