"""Merkle manifest against a plain recursive tree."""
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tollgate.llm import common, merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(digests):
    """(root, each leaf's list of (left, right))."""
    level, where, paths = list(digests), list(range(len(digests))), [[] for _ in digests]
    while len(level) > 1:
        for i, w in enumerate(where):
            a = w // 16 * 16
            paths[i].append(("".join(level[a:w]), "".join(level[w + 1:a + 16])))
            where[i] = w // 16
        level = [sha("".join(level[a:a + 16])) for a in range(0, len(level), 16)]
    return level[0], paths


def brute(rows):
    first = lambda v: (v is not None, v if v is not None else 0)
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        mine = sorted((r for r in rows if r[1] == s), key=lambda r: (first(r[0]), leaf(r)))
        trees[s] = mine, *tree([leaf(r) for r in mine])
    root, above = tree([trees[s][1] for s in sources])
    out = []
    for s, up in zip(sources, above):
        mine, subroot, paths = trees[s]
        for r, p in zip(mine, paths):
            path = p + up
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4]) if tampered else r[4]
            d = leaf((*r[:4], text))
            for a, b in path:
                d = sha(a + d + b)
            out.append((r[0], leaf(r), subroot, root, sha("".join(a + b for a, b in path)), d, d == root))
    return sorted(out, key=str)


def sample(seed, n=700):
    rng = random.Random(seed)
    sources = [None, "", "a", "b", "é", "Z"] + ["hot"] * 6
    rows = [(i * 7 % 5003, rng.choice(sources), rng.choice(["en", None, "de"]), rng.choice([None, 5, 0]), rng.choice([None, "", "Text A", "low", f"Row {i} É"])) for i in range(n)]
    return rows + [(None, "a", None, None, None), (None, None, "x", 1, "B"), (3, "a", "en", 1, "Same"), (3, "a", "en", 1, "Same"), (3, "a", "en", 2, "Other"), (9, "lone", "", 0, "L" * 100_000)]


@pytest.mark.parametrize("levels", [1, 3])
def test_against_a_plain_tree(spark, levels):
    common.prepare(spark)
    rows = sample(levels)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS tree", "2 AS digest", "3 AS row_id", "4 AS pos").repartition(5)
    found = merkle.manifest(df, tamper=F.crc32(F.col("doc_id").cast("string")) % 5 == 0, with_path=True, most=levels).collect()
    assert sorted((tuple(r)[:7] for r in found), key=str) == brute(rows)
    for r in found[:50]:
        assert sha("".join(s.left + s.right for s in r.path)) == r.proof_sha256


def test_small_tables(spark):
    common.prepare(spark)
    df = spark.createDataFrame([], SCHEMA)
    assert merkle.manifest(df).collect() == []
    one = [(1, "s", "en", 1, "x")]
    (r,) = merkle.manifest(spark.createDataFrame(one, SCHEMA)).collect()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.verified and r.proof_sha256 == sha("")


def test_sweeps_of_one_block():
    for n in (1, 2, 15, 16, 17, 255, 256, 257, 4096):
        digests = [sha(str(i)) for i in range(n)]
        root, paths = tree(digests)
        levels = merkle.levels_of(n)
        top, runs = merkle.forward(digests, levels)
        assert top == root
        assert [list(merkle.steps(p)) for p in merkle.backward(n, levels, runs, None)] == paths
