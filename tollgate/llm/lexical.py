"""Ranked lexical search over a length-stratified index.

1. One pass counts every text's terms.  Documents, terms and document frequencies are counted
   over all of them, so every document has its integer length normaliser m.
2. The index is dealt to shards by row.  In a shard, documents of equal m form a stratum; a
   term's postings stand by stratum and, in it, by falling tf, so that a run of equal tf shares
   one impact, computed once, and its first run bounds the stratum.
3. For each query, a stratum's bound is the sum of its terms' weighted first impacts.  Strata are
   visited by falling bound, in waves of doubling size, until the bound is below the k-th score
   found; ties at that score are still visited.  Each shard hands on at most k rows a query.

Queries meet all shards in blocks of a bounded number; each block of queries passes over the
index on its own, so neither side of a group grows with its table.  While the queries' own terms
are few (``BROADCAST_TERMS``, counted first), the first pass drops all others; beyond, it keeps
every term and the queries find theirs in the shards, with the same result.

Defined cases: null and empty texts have no terms, such documents do not count in N, and such
queries have no rows; very long texts are read whole, a stretch at a time; equal scores go by
ascending doc_id, null first; rows that repeat a doc_id rank as rows of their own, and so do
queries that repeat an item_id.  Empty tables give an empty result.  Further columns, whatever
their names, are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER_AZ, as_bytes, as_int64, written

NO_ID = -(1 << 63)
POSTINGS = 2_000_000  # of a shard
QUERIES = 2_000  # of a block
BROADCAST_TERMS = 500_000
STRETCH = 4 << 20
WAVE = 512  # documents in the first wave
HEAD = 75  # hundredths of the length that count
TERM = bytes(LOWER_AZ[b] if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def counts_of(text: bytes, stretch: int = STRETCH) -> Counter:
    """How often each term occurs; a term is a run of letters, digits and characters beyond ASCII."""
    if len(text) <= stretch:
        return Counter(text.translate(TERM).split())
    found, at, plain = Counter(), 0, text.translate(TERM)
    while at < len(plain):
        end = plain.find(b" ", at + stretch)
        end = len(plain) if end < 0 else end
        found.update(plain[at:end].split())
        at = end
    return found


def _lists(values: list, sizes: list[int], of: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.binary()).cast(of) if of == pa.string() else pa.array(values, of))


def _counted(wanted: frozenset[bytes] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sizes, terms, tfs = [], [], [], []
            for text in as_bytes(batch.column("text")):
                counts = counts_of(text)
                keep = sorted(counts if wanted is None else counts.keys() & wanted)
                n.append(counts.total()), sizes.append(len(keep))
                terms += keep
                tfs += [counts[t] for t in keep]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), _lists(terms, sizes, pa.string()), _lists(tfs, sizes, pa.int64())],
                                             names=["id", "n", "terms", "tfs"])
    return run


def counted(rows: DataFrame, id_col: str, text_col: str, wanted: frozenset[bytes] | None = None) -> DataFrame:
    """(id, n, terms, tfs) of every row: all its terms, or those that are wanted; n counts all."""
    light = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return light.mapInArrow(_counted(wanted), "id long, n long, terms array<string>, tfs array<long>")


class Shard:
    """The index of one shard's documents."""

    def __init__(self, table: pa.Table):
        self.ids = as_int64(table.column("id").combine_chunks(), NO_ID)
        m = as_int64(table.column("m").combine_chunks(), 0)
        self.m, self.stratum = np.unique(m, return_inverse=True)
        lists, tfs = (table.column(c).combine_chunks() for c in ("terms", "tfs"))
        coded = lists.flatten().dictionary_encode()
        self.terms = {t: i for i, t in enumerate(coded.dictionary.to_pylist())}
        code, tf = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), tfs.flatten().to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(self.ids)), lists.value_lengths().to_numpy(zero_copy_only=False))
        cell = code * len(self.m) + self.stratum[doc]
        order = np.lexsort((-tf, cell))
        cell, tf, self.doc = cell[order], tf[order], doc[order]
        new = np.ones(len(cell), bool)
        new[1:] = (cell[1:] != cell[:-1]) | (tf[1:] != tf[:-1])
        run = np.flatnonzero(new)  # postings of one term, stratum and tf: one impact
        self.impact = (1_000_000_000 * tf[run]) // (1000 * tf[run] + 8 * self.m[cell[run] % max(len(self.m), 1)])
        self.run_of = np.cumsum(new) - 1
        new[1:] = cell[1:] != cell[:-1]
        self.first = np.flatnonzero(new)
        self.last = np.append(self.first[1:], len(cell))
        self.cell = cell[self.first]
        self.top = self.impact[self.run_of[self.first]]
        self.size = np.bincount(self.stratum, minlength=len(self.m))
        self.score = np.zeros(len(self.ids), np.int64)

    def bounds(self, codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For each stratum, what no document in it can exceed."""
        bound, strata = np.zeros(len(self.m), np.int64), len(self.m)
        ends = np.searchsorted(self.cell, [codes * strata, (codes + 1) * strata])
        for c, w, a, b in zip(codes.tolist(), weights.tolist(), *ends.tolist(), strict=True):
            bound[self.cell[a:b] - c * strata] += w * self.top[a:b]
        return bound

    def visit(self, strata: np.ndarray, codes: np.ndarray, weights: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of these strata with a score of ``least`` or more."""
        keys = (codes[:, None] * len(self.m) + strata[None, :]).ravel()
        at = np.minimum(np.searchsorted(self.cell, keys), len(self.cell) - 1)
        hit = np.flatnonzero(self.cell[at] == keys)
        at = at[hit]
        sizes = self.last[at] - self.first[at]
        until = np.cumsum(sizes) - sizes
        posting = np.repeat(self.first[at] - until, sizes) + np.arange(int(sizes.sum()))
        docs = self.doc[posting]
        np.add.at(self.score, docs, np.repeat(weights[hit // len(strata)], sizes) * self.impact[self.run_of[posting]])
        good = np.unique(docs[self.score[docs] >= least])
        scores = self.score[good]
        self.score[docs] = 0
        return good, scores

    def best(self, codes: np.ndarray, weights: np.ndarray, k: int, room: int = WAVE) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, strata visited) of the k best documents with a score above 0; ``room``: documents of the first wave."""
        bound = self.bounds(codes, weights)
        order = np.flatnonzero(bound > 0)
        order = order[np.argsort(-bound[order], kind="stable")]
        docs, scores, at = np.empty(0, np.int64), np.empty(0, np.int64), 0
        while at < len(order):
            least = int(scores[k - 1]) if len(scores) >= k else 1
            stop = at + max(int(np.searchsorted(np.cumsum(self.size[order[at:]]), room)) + 1, 1)
            wave = order[at:stop]
            wave = wave[bound[wave] >= least]
            if not len(wave):
                break
            more, values = self.visit(wave, codes, weights, least)
            docs, scores = np.concatenate([docs, more]), np.concatenate([scores, values])
            top = np.lexsort((self.ids[docs], -scores))[:k]
            docs, scores, at, room = docs[top], scores[top], at + len(wave), 2 * room
        return docs, scores, at


def _search(k: int):
    def run(table: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if table.num_rows and queries.num_rows:
            shard = Shard(table)
            for query, item, terms, weights in zip(*(queries.column(c).to_pylist() for c in ("query", "item_id", "terms", "weights")), strict=True):
                known = [(shard.terms[t], w) for t, w in zip(terms, weights, strict=True) if t in shard.terms]
                if not known:
                    continue
                docs, scores, _ = shard.best(*(np.array(x, np.int64) for x in zip(*known, strict=True)), k)
                ids = [None if d == NO_ID else d for d in shard.ids[docs].tolist()]
                for column, values in zip(out, ([query] * len(ids), [item] * len(ids), ids, scores.tolist()), strict=True):
                    column += values
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("query", "item_id", "doc_id", "score"), out, strict=True)})
    return run


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item, best first."""
    spark = docs.sparkSession
    asked = written(counted(items, item_col, item_text), "lexical-items").withColumn("query", F.monotonically_increasing_id())
    term = asked.select("query", "id", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select("query", "id", "t.terms", "t.tfs")
    vocabulary = term.select("terms").distinct()
    n_terms, n_queries = vocabulary.count(), asked.count()
    wanted = None
    if n_terms <= BROADCAST_TERMS:  # a few MB in each task
        wanted = frozenset(r.terms.encode() for r in vocabulary.collect())
    index = written(counted(docs, id_col, text_col, wanted), "lexical-index")
    total = index.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("terms"), F.sum(F.size("terms").cast("long")).alias("postings")).first()
    n_docs, n_all = total.documents or 0, total.terms or 0
    frequency = index.select(F.explode("terms").alias("terms")).groupBy("terms").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weighted = (term.join(frequency, "terms").select("query", "id", "terms", (F.col("tfs") * weight).alias("weight")).where("weight > 0")
                .groupBy("query").agg(F.first("id").alias("item_id"), F.collect_list(F.struct("terms", "weight")).alias("t"))
                .select("query", "item_id", F.col("t.terms").alias("terms"), F.col("t.weight").alias("weights")))
    shards, blocks = max(-(-(total.postings or 0) // POSTINGS), 1), max(-(-n_queries // QUERIES), 1)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = weighted.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")).withColumn("shard", every(shards))
    m = F.expr(f"{100 - HEAD} + ({HEAD} * n * {n_docs}L) div {max(n_all, 1)}L")
    dealt = (index.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
             .where("size(terms) > 0").select("id", m.alias("m"), "terms", "tfs", "shard").withColumn("block", every(blocks)))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), shards * blocks)  # a task holds a shard or so at any size
    dealt, queries = (side.repartition(tasks, "shard", "block") for side in (dealt, queries))
    found = dealt.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInArrow(_search(k), "query long, item_id long, doc_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
