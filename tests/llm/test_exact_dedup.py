"""Grace hash deduplication against grouping in Python, with tables so small that buckets overflow."""
import hashlib
import random

import pytest

from tollgate.llm import common, exact_dedup


def az(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def check(rows, found):
    groups = {}
    for d, t in rows:
        groups.setdefault(az(t), []).append(d)
    assert len(found) == len(rows)
    for r in found:
        members = groups[az(r["text"])]
        ids = [d for d in members if d is not None]
        assert r["keep_id"] == (max(ids) if ids else None)
        assert r["group_size"] == len(members)
        assert r["text_sha256"] == hashlib.sha256(az(r["text"]).encode()).hexdigest()
    for t in groups:
        kept = [r for r in found if az(r["text"]) == t and r["kept"]]
        assert len(kept) == 1 and kept[0]["doc_id"] == kept[0]["keep_id"]


@pytest.mark.parametrize("table_bytes,segment_bytes,partitions", [(64 << 20, 32 << 20, None), (40, 200, 2)])
def test_groups(spark, table_bytes, segment_bytes, partitions):
    common.prepare(spark)
    rng = random.Random(3)
    texts = ["", None, "Same", "sAME", "É", "é", "x" * 5000, "a b", "a  b"] + [f"text {i % 40}" for i in range(120)]
    rows = [(i * 7 % 1000, t) for i, t in enumerate(texts)] + [(5, "Same"), (5, "Same"), (None, "Same"), (None, "lonely"), (None, "lonely")]
    rows += [(2000 + i, "hot copy") for i in range(300)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS kept", "2 AS row_id", "'h' AS hash", "doc_id AS grp").repartition(5)
    found = exact_dedup.grace_dedup(df, table_bytes=table_bytes, segment_bytes=segment_bytes, partitions=partitions)
    check(rows, [{"doc_id": r["row"]["doc_id"], "text": r["row"]["text"], **r.asDict()} for r in found.collect()])
    kept = exact_dedup.kept_documents(df)
    assert kept.columns == df.columns and kept.count() == len({az(t) for _, t in rows})


def test_empty(spark):
    common.prepare(spark)
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert exact_dedup.kept_documents(df).collect() == []


def test_open_addressing_compares_content():
    table = exact_dedup.ContentTable(slots=2)
    for i in range(50):  # one hash for all: only the content tells them apart
        content = str(i).encode()
        e, slot = table.find(content, 12345)
        assert e == -1
        table.add(content, 12345, slot)
    assert [table.find(str(i).encode(), 12345)[0] for i in range(50)] == list(range(50))
