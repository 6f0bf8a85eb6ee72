"""SimHash near-duplicates against all-pairs brute force."""
import numpy as np
import pytest
import xxhash

from tollgate.llm import common, components, simhash
from tollgate.llm.common import signed


def brute(ids, fps, radius):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        least.setdefault(find(i), []).append(d)
    return [min(least[find(i)]) for i in range(len(ids))]


@pytest.mark.parametrize("lanes,tile,segment", [(2, 16, 8), (4, 16_384, 8_192), (8, 4, 4), (2, 16_384, 8_192)])
def test_links_span_components(spark, lanes, tile, segment):
    common.prepare(spark)
    rng = np.random.default_rng(lanes)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = set(base.tolist())
    for f in base.tolist()[:15]:  # chains of near fingerprints, and a dense group
        g = f
        for _ in range(6):
            g ^= 1 << int(rng.integers(0, 64))
            g ^= 1 << int(rng.integers(0, 64))
            fps.add(g)
    fps |= {base.tolist()[20] ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)}
    fps = sorted(fps)
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    parts = components.connected_components(simhash.near_links(df, 2, lanes, tile, segment)).collect()
    found = {r.node: r.component for r in parts}
    label = brute([signed(f) for f in fps], fps, 2)
    assert [found.get(signed(f), signed(f)) for f in fps] == label


def test_fingerprint_by_definition():
    text = "The cat\tsat on THE mat the cat sat on É É"
    words = "".join(c.lower() if c.isascii() else c for c in text).split()
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) > len(shingles))
    assert simhash.fingerprint(text.encode(), 3) == want
    assert simhash.fingerprint(b" \t", 3) == 0
    assert simhash.fingerprint(b"One two", 3) == xxhash.xxh64_intdigest(b"one two", 42)


def test_edges(spark):
    common.prepare(spark)
    rows = [(5, None), (3, ""), (3, ""), (None, "a b c d"), (9, "A b c d"), (None, "only one"), (7, "w " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "'x' AS component")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (3, 3), (None, 9), (9, 9), (None, None), (7, 7)], key=str)
    kept = simhash.kept_documents(df)
    assert kept.columns == df.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, [3, 3, None, 9, None, 7]))
    assert simhash.near_duplicates(df.limit(0)).count() == 0
