"""Exact deduplication: Grace hashing with open-addressing tables over complete content.

1. Each input task groups its own rows with an open-addressing table that compares whole
   contents, a bounded segment at a time, and writes one representative per distinct
   content and segment.  A content that fills a third of the corpus so costs one row per
   segment in the shuffle.
2. Representatives are partitioned by hash.  A task holds the distinct contents of its
   partition in one open-addressing table of at most ``table_bytes``; copies of a resident
   content are absorbed.  What no longer fits is written to spill files (a table in the
   shared checkpoint folder) and partitioned again by another hash, recursively, until
   every bucket fits.
3. Each row finds its group through its segment's representative.

Defined cases: null text counts as empty; A-Z compare as a-z, nothing else is normalised.
Of equal texts the largest doc_id stays; a null doc_id is smaller than any other; of rows
that also share the doc_id, exactly one (the first read) stays.  An empty table gives an
empty result.  Further columns of any name pass through unread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER_AZ, as_bytes, as_int64, signed, tasks_for, written

NO_ID = -(1 << 63)
SEGMENT_BYTES = 32 << 20
TABLE_BYTES = 64 << 20


class ContentTable:
    """Open addressing with linear probing; equal means the same complete bytes."""

    def __init__(self, slots: int = 1024):
        self.slots = [-1] * slots
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def find(self, content: bytes, h: int) -> tuple[int, int]:
        """(entry or -1, slot where the probe ended)."""
        mask = len(self.slots) - 1
        i = h & mask
        while (e := self.slots[i]) >= 0:
            if self.hashes[e] == h and self.contents[e] == content:
                return e, i
            i = (i + 1) & mask
        return -1, i

    def add(self, content: bytes, h: int, slot: int) -> int:
        e = len(self.hashes)
        self.slots[slot] = e
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content)
        if 2 * len(self.hashes) > len(self.slots):
            self._grow()
        return e

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for e, h in enumerate(self.hashes):
            i = h & mask
            while self.slots[i] >= 0:
                i = (i + 1) & mask
            self.slots[i] = e


def _segment(batches: list[pa.RecordBatch], base: int, id_col: str, text_col: str) -> Iterator[pa.RecordBatch]:
    """One bounded run of rows: its groups, then every row with its group; ``base`` numbers rows and groups."""
    table, tops, rows, counts, reps, shas = ContentTable(), [], [], [], [], []
    group: list[int] = []
    for batch in batches:
        row = batch.column(0)
        for doc_id, text in zip(as_int64(row.field(id_col), NO_ID).tolist(), as_bytes(row.field(text_col)), strict=True):
            content = text.translate(LOWER_AZ)
            h = xxhash.xxh3_64_intdigest(content)
            e, slot = table.find(content, h)
            row_id = base + len(group)
            if e < 0:
                e = table.add(content, h, slot)
                tops.append(doc_id), rows.append(row_id), counts.append(0), reps.append(row_id)
                shas.append(hashlib.sha256(content).hexdigest())
            elif doc_id > tops[e]:
                tops[e], rows[e] = doc_id, row_id
            counts[e] += 1
            group.append(e)
    at = 0
    sizes = [len(c) for c in table.contents]
    for batch in batches:
        es = group[at : at + batch.num_rows]
        ids = range(base + at, base + at + batch.num_rows)
        rep = [reps[e] == i for e, i in zip(es, ids, strict=True)]
        pick = lambda values, es=es: [values[e] for e in es]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(ids, pa.int64()), pa.array(pick(reps), pa.int64()), pa.array(rep, pa.bool_()),
             pa.array(pick(counts), pa.int64()), pa.array(pick(tops), pa.int64()), pa.array(pick(rows), pa.int64()),
             pa.array([signed(table.hashes[e]) for e in es], pa.int64()), pa.array(pick(sizes), pa.int64()), pa.array(pick(shas))],
            names=["row", "row_id", "grp", "rep", "n", "top_id", "top_row", "hash", "n_bytes", "sha"])
        at += batch.num_rows


def _local_groups(id_col: str, text_col: str, segment_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, held, held_bytes = TaskContext.get().partitionId() << 40, [], 0
        for batch in batches:
            held.append(batch)
            held_bytes += batch.nbytes
            if held_bytes >= segment_bytes:
                yield from _segment(held, base, id_col, text_col)
                base, held, held_bytes = base + sum(b.num_rows for b in held), [], 0
        if held:
            yield from _segment(held, base, id_col, text_col)
    return run


RESOLVED = "grp long, keep_id long, keep_row long, group_size long, hash long, n long, top_id long, top_row long, text string"


def _bucket_tables(table_bytes: int):
    """Fill one table per task; emit each resident content's groups, and at once what does not fit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, members, totals, keeps = ContentTable(), [], [], []
        for batch in batches:
            grp, h, n = (batch.column(c).to_pylist() for c in ("grp", "hash", "n"))
            top_id, top_row = (batch.column(c).to_pylist() for c in ("top_id", "top_row"))
            spill = []
            for k, text in enumerate(as_bytes(batch.column("text"))):
                content = text.translate(LOWER_AZ)
                key = h[k] & 0xFFFFFFFFFFFFFFFF
                e, slot = table.find(content, key)
                if e < 0:
                    if table.bytes + len(content) > table_bytes and table.hashes:
                        spill.append(k)
                        continue
                    e = table.add(content, key, slot)
                    members.append([]), totals.append(0), keeps.append((NO_ID - 1, 0))
                members[e].append(grp[k])
                totals[e] += n[k]
                keeps[e] = max(keeps[e], (top_id[k], -top_row[k]))
            if spill:
                part = batch.take(pa.array(spill))
                nulls = pa.nulls(len(spill), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("grp"), nulls, nulls, nulls, part.column("hash"), part.column("n"), part.column("top_id"),
                     part.column("top_row"), part.column("text").cast(pa.string())], names=_names(RESOLVED))
        groups = [g for m in members for g in m]
        of = [e for e, m in enumerate(members) for _ in m]
        for i in range(0, len(groups), 20_000):
            es = of[i : i + 20_000]
            nulls = pa.nulls(len(es), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(groups[i : i + 20_000], pa.int64()),
                 pa.array([None if keeps[e][0] == NO_ID else keeps[e][0] for e in es], pa.int64()),
                 pa.array([-keeps[e][1] for e in es], pa.int64()), pa.array([totals[e] for e in es], pa.int64()),
                 nulls, nulls, nulls, nulls, pa.nulls(len(es), pa.string())], names=_names(RESOLVED))
    return run


def _names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(", ")]


def grace_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                table_bytes: int = TABLE_BYTES, segment_bytes: int = SEGMENT_BYTES, partitions: int | None = None) -> DataFrame:
    """Every input row as struct ``row`` with keep_id, group_size, kept and text_sha256 (of the lowered text).

    ``partitions`` fixes the first level's bucket count; by default it follows the bytes.
    """
    spark = docs.sparkSession
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    schema = T.StructType([whole.schema["row"]])
    for name, kind in (("row_id", T.LongType()), ("grp", T.LongType()), ("rep", T.BooleanType()), ("n", T.LongType()),
                       ("top_id", T.LongType()), ("top_row", T.LongType()), ("hash", T.LongType()), ("n_bytes", T.LongType()), ("sha", T.StringType())):
        schema.add(name, kind)
    rows = written(whole.mapInArrow(_local_groups(id_col, text_col, segment_bytes), schema), "exact-rows")
    reps = rows.filter("rep")
    total = reps.agg(F.sum("n_bytes")).first()[0]
    left = reps.select("grp", "hash", "n", "top_id", "top_row", F.col(f"row.`{text_col}`").alias("text"))
    buckets, resolved, depth = partitions or tasks_for(spark, total, table_bytes // 2), None, 0
    while True:
        key = F.col("hash") if depth == 0 else F.xxhash64("hash", F.lit(depth))
        level = written(left.repartition(buckets, key).mapInArrow(_bucket_tables(table_bytes), RESOLVED), f"exact-level{depth}")
        done = level.filter("keep_row IS NOT NULL").select("grp", "keep_id", "keep_row", "group_size")
        resolved = done if resolved is None else resolved.unionByName(done)
        left = level.filter("keep_row IS NULL").select("grp", "hash", "n", "top_id", "top_row", "text")
        over = left.agg(F.sum(F.octet_length("text")), F.count("*")).first()
        if not over[1]:
            break
        buckets, depth = tasks_for(spark, over[0], table_bytes // 2), depth + 1
    return rows.join(resolved, "grp", "left").select(
        "row", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"),
        "row_id", "keep_row")


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows that stay, with the columns of ``docs``."""
    found = grace_dedup(docs, **options)
    return found.filter("kept").select("row.*")
