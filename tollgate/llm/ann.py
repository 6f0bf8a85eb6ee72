"""Approximate nearest neighbours over learned partitions.

Fitting, on a bounded sample: exact nearest neighbours inside the sample give a graph; the
graph is split into balanced halves again and again (spectral order, cut at the middle,
then swaps that lower the cut); a small neural classifier learns each vector's part, from
the shares of its neighbours' parts.  The number of parts a query visits is the smallest
that finds ``recall`` of the neighbours of held-back sample vectors.

One classifier has at most 128 parts, so a larger table is split level by level: each part that
is still large gets a classifier of its own, fitted in a task on a bounded sample of that part,
until parts hold about ``PART_ROWS`` rows.  A query visits the likeliest parts of each level
inside those of the level before.  The number of parts so follows the rows at any size; the
classifiers travel to the rows through the shuffle, not through the driver.

Searching: every row is put into its likeliest part.  Parts are dealt out in blocks of bounded
size, rows and queries alike, and each block of a part's rows meets each block of its
queries, so a vector that fills a third of the table, or a part that many queries visit, is
spread.  A query goes on to more parts where its likeliest hold too few rows.  The blocks'
best are merged by the exact distance.

Defined cases: vectors that are null, empty, zero, hold null or non-finite components, or
whose length is not the commonest take no part, nor do rows without an id; rows that
repeat an id count once (the smallest vector); equal distances go to the smaller id; with
fewer candidates than k, all are returned.  An empty table gives an empty result.  Vectors of any length are
read whole.  Further columns, whatever their names, are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hashed_sample, written

SAMPLE, HIDDEN, BLOCK, GRAPH_K = 8_192, 96, 2_048, 10
PART_ROWS, FEW = 2_000, 64  # rows of a part, about; with fewer distinct vectors there is nothing to learn
WIDTH = 128  # parts of one classifier at most


def nearest(queries: np.ndarray, rows: np.ndarray, k: int, skip_self: bool = False) -> np.ndarray:
    """Indices of the k nearest rows of each query, by squared distance (an order, not a score)."""
    norms = (rows**2).sum(axis=1)
    out = []
    for i in range(0, len(queries), 512):
        d = norms - 2 * queries[i : i + 512] @ rows.T
        if skip_self:
            d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        top = np.argpartition(d, min(k, d.shape[1] - 1), axis=1)[:, :k]
        out.append(np.take_along_axis(top, np.argsort(np.take_along_axis(d, top, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out) if out else np.empty((0, k), int)


def _halves(members: np.ndarray, a: np.ndarray, b: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A balanced split of a graph's nodes 0..n-1 (edges a-b, both directions given): True for one half."""
    n = len(members)
    degree = np.bincount(a, minlength=n) + 1e-9
    root = np.sqrt(degree)
    trivial = root / np.linalg.norm(root)
    x = rng.standard_normal(n)
    for _ in range(60):  # second eigenvector of the normalised graph, by power steps
        x -= trivial * (trivial @ x)
        x = x / max(np.linalg.norm(x), 1e-30)
        x = (x + np.bincount(a, x[b] / (root[a] * root[b]), minlength=n)) / 2
    half = np.zeros(n, bool)
    half[np.argsort(x / root, kind="stable")[: n // 2]] = True
    for _ in range(8):  # swap the nodes that gain most, as long as the cut shrinks
        across = half[a] != half[b]
        gain = np.bincount(a, np.where(across, 1.0, -1.0), minlength=n)
        left, right = np.flatnonzero(half), np.flatnonzero(~half)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        m = min(len(left), len(right), max(n // 50, 1))
        good = int((gain[left[:m]] + gain[right[:m]] > 0).sum())
        trial = half.copy()
        trial[left[:good]], trial[right[:good]] = False, True
        if not good or (trial[a] != trial[b]).sum() >= across.sum():
            break
        half = trial
    return half


def balanced_parts(neighbours: np.ndarray, depth: int, seed: int = 7) -> np.ndarray:
    """Part (0 .. 2**depth - 1) of each node of a neighbour graph; parts differ by one node at each split."""
    n, k = neighbours.shape
    a, b = np.repeat(np.arange(n), k), neighbours.ravel()
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    part, rng = np.zeros(n, np.int64), np.random.default_rng(seed)
    for _ in range(depth):
        new = part * 2
        for p in np.unique(part):
            members = np.flatnonzero(part == p)
            place = np.full(n, -1)
            place[members] = np.arange(len(members))
            inside = (part[a] == p) & (part[b] == p)
            new[members[_halves(members, place[a[inside]], place[b[inside]], rng)]] += 1
        part = new
    return part


class Router:
    """One hidden layer; probabilities of the parts."""

    def __init__(self, dims: int, parts: int, mean: np.ndarray, scale: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale, self.probes = mean, scale, parts
        self.w = [rng.standard_normal((dims, HIDDEN)) / np.sqrt(dims), np.zeros(HIDDEN), rng.standard_normal((HIDDEN, parts)) / np.sqrt(HIDDEN), np.zeros(parts)]

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = (x - self.mean) / self.scale
        h = np.maximum(x @ self.w[0] + self.w[1], 0)
        z = h @ self.w[2] + self.w[3]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return x, h, p / p.sum(axis=1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self._forward(x)[2]

    def fit(self, x: np.ndarray, target: np.ndarray, epochs: int = 40, batch: int = 256, rate: float = 0.004, seed: int = 7) -> None:
        """Adam steps on the cross-entropy with the target shares."""
        rng = np.random.default_rng(seed)
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                at = order[i : i + batch]
                xs, h, p = self._forward(x[at])
                dz = (p - target[at]) / len(at)
                dh = (dz @ self.w[2].T) * (h > 0)
                t += 1
                for k, g in enumerate((xs.T @ dh, dh.sum(axis=0), h.T @ dz, dz.sum(axis=0))):
                    g = g + 1e-4 * self.w[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] -= rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-9)


def fit(sample: np.ndarray, rows: int, k: int, recall: float, part_rows: int = PART_ROWS) -> Router | None:
    """A router for a table of ``rows`` vectors, from a sample of distinct vectors; None where these are fewer than ``FEW``."""
    if len(sample) < FEW:
        return None
    held = sample[::8]
    known = np.delete(sample, np.arange(0, len(sample), 8), axis=0)
    parts = min(rows // min(part_rows, max(rows // 8, 1)), len(known) // 24, WIDTH)  # small tables: about eight parts
    depth = int(np.log2(max(parts, 2)))
    graph = nearest(known, known, GRAPH_K, skip_self=True)
    part = balanced_parts(graph, depth)
    n = 1 << depth
    target = 0.5 * np.eye(n)[part] + 0.5 * np.eye(n)[part[graph]].mean(axis=1)
    router = Router(sample.shape[1], n, known.mean(axis=0), float(known.std()) or 1.0)
    router.fit(known, target)
    # parts to visit: enough for the held-back vectors' neighbours, where the router puts them
    home = router.probabilities(known).argmax(axis=1)
    truth = home[nearest(held, known, min(k, len(known)))]
    rank = np.argsort(np.argsort(-router.probabilities(held), axis=1, kind="stable"), axis=1)
    found = np.take_along_axis(rank, truth, 1)
    router.probes = next(m for m in range(1, n + 1) if (found < m).mean() >= recall)
    return router


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _parts(router: Router | None, x: np.ndarray) -> np.ndarray:
    return router.probabilities(x).argmax(axis=1) if router is not None else np.zeros(len(x), np.int64)


def _visits(router: Router | None, x: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, part) pairs: each query's likeliest parts, and more of them where these hold too few rows."""
    p = router.probabilities(x) if router is not None else np.ones((len(x), 1))
    order = np.argsort(-p, axis=1, kind="stable")
    before = np.cumsum(sizes[order], axis=1) - sizes[order]
    visit = (np.arange(order.shape[1]) < (router.probes if router is not None else 1)) | (before < k + 1)  # k candidates and the query itself
    q, r = np.nonzero(visit & (sizes[order] > 0))
    return q, order[q, r]


def _assigned(router: Router | None):
    def run(batches):
        for batch in batches:
            part = _parts(router, _matrix(batch.column("embedding")))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array(part.astype(np.int64))], names=["vec_id", "embedding", "part"])
    return run


def _routed(router: Router | None, sizes: np.ndarray, k: int):
    """A row for each part a query visits."""
    def run(batches):
        for batch in batches:
            q, part = _visits(router, _matrix(batch.column("embedding")), sizes, k)
            at = pa.array(q)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(at), batch.column("embedding").take(at), pa.array(part.astype(np.int64))], names=["vec_id", "embedding", "part"])
    return run


def _fit_part(k: int, recall: float, part_rows: int):
    """The classifier of one large part, from a bounded sample of its rows."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        known = np.unique(_matrix(table.column("embedding")), axis=0)
        rng = np.random.default_rng(7)
        router = fit(known[rng.permutation(len(known))], table.column("rows")[0].as_py(), k, recall, part_rows)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "model": pa.array([pickle.dumps(router)], pa.binary())})
    return run


def _split_rows(table: pa.Table, models: pa.Table) -> pa.Table:
    """A block of a large part's rows, each in its part of the next level."""
    if table.num_rows:
        sub = _parts(pickle.loads(models.column("model")[0].as_py()), _matrix(table.column("embedding")))
        part = table.column("part").to_numpy() * WIDTH + sub
    else:
        part = np.empty(0, np.int64)
    return pa.table({"vec_id": table.column("vec_id"), "embedding": table.column("embedding"), "part": pa.array(part, pa.int64())})


def _split_queries(k: int):
    def run(table: pa.Table, models: pa.Table) -> pa.Table:
        """A block of the queries that visit a large part, once for each part of the next level they visit."""
        q, part = np.empty(0, np.int64), np.empty(0, np.int64)
        if table.num_rows and models.num_rows:
            router = pickle.loads(models.column("model")[0].as_py())
            sizes = np.zeros(len(router.w[3]) if router is not None else 1, np.int64)
            for s in models.column("sizes")[0].as_py():
                sizes[s["sub"]] = s["n"]
            q, part = _visits(router, _matrix(table.column("embedding")), sizes, k)
            part = part + models.column("part")[0].as_py() * WIDTH
        at = pa.array(q, pa.int64())
        return pa.table({"vec_id": table.column("vec_id").take(at), "embedding": table.column("embedding").take(at), "part": pa.array(part, pa.int64())})
    return run


VECTORS = "vec_id long, embedding array<double>, part long"


def _with_blocks(rows: DataFrame, block: int, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows with ``name``, their block inside the part; one row a part with how many blocks it has)."""
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.expr(f"cast((n + {block - 1}) div {block} as int)"))
    dealt = rows.join(sizes.select("part", "blocks"), "part").withColumn(name, F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).drop("blocks")
    return dealt, sizes


def _every(blocks: str, name: str) -> Callable[[DataFrame], DataFrame]:
    """Each row once for every block of its part."""
    return lambda rows: rows.withColumn(name, F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))).drop(blocks)


def _deeper(assigned: DataFrame, asked: DataFrame, sample: int, block: int, k: int, recall: float, part_rows: int, level: int) -> tuple[DataFrame, DataFrame]:
    """The next level: parts of more than twice ``part_rows`` rows split by classifiers of their own."""
    dealt, sizes = _with_blocks(assigned, block, "block")
    large = written(sizes.filter(F.col("n") > 2 * part_rows), f"ann-large-{level}")
    chance = F.least(F.lit(1.0), (1.2 * sample + 20) / F.col("n")) * float(1 << 62)
    rows = assigned.join(large.select("part", F.col("n").alias("rows"), chance.alias("chance")), "part")
    picked = rows.filter(F.shiftrightunsigned(F.xxhash64("vec_id", F.lit(level)), 2).cast("double") < F.col("chance")).select("part", "embedding", "rows")
    models = written(picked.groupBy("part").applyInArrow(_fit_part(k, recall, part_rows), "part long, model binary"), f"ann-models-{level}")
    some = models.join(large, "part")
    here = _every("blocks", "block")(some.select("part", "model", "blocks"))
    split = dealt.join(models.select("part"), "part", "left_semi").groupBy("part", "block").cogroup(here.groupBy("part", "block")).applyInArrow(_split_rows, VECTORS)
    whole = assigned.join(models.select("part"), "part", "left_anti")
    same = F.col("part") * WIDTH  # a part that is not split is its own first part
    below = written(split.unionByName(whole.withColumn("part", same)), f"ann-assigned-{level}")
    inside = below.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(
        F.expr(f"part div {WIDTH}").alias("parent"), F.struct(F.expr(f"cast(part % {WIDTH} as int)").alias("sub"), "n").alias("s"))
    sized = models.join(inside.groupBy(F.col("parent").alias("part")).agg(F.collect_list("s").alias("sizes")), "part")  # at most WIDTH a part
    queries, visited = _with_blocks(asked, block, "block")
    there = _every("blocks", "block")(sized.join(visited.select("part", "blocks"), "part"))
    moved = queries.join(models.select("part"), "part", "left_semi").groupBy("part", "block").cogroup(there.groupBy("part", "block")).applyInArrow(_split_queries(k), VECTORS)
    stay = asked.join(models.select("part"), "part", "left_anti").withColumn("part", same)
    return below, written(moved.unionByName(stay), f"ann-asked-{level}")


def _best(k: int):
    """The k nearest of one block's rows to each query that meets it."""
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if rows.num_rows and queries.num_rows:
            x, ids = _matrix(rows.column("embedding")), rows.column("vec_id").to_numpy()
            qs, names = _matrix(queries.column("embedding")), queries.column("vec_id").to_numpy()
            norms = (x**2).sum(axis=1)
            for i in range(0, len(qs), 256):
                q, name = qs[i : i + 256], names[i : i + 256]
                own = (q**2).sum(axis=1)
                d = norms + own[:, None] - 2 * q @ x.T
                d[ids[None, :] == name[:, None]] = np.inf
                kth = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
                slack = 1e-9 * (own + norms.max() + 1)  # more than the rounding of this form
                for j in range(len(q)):
                    near = np.flatnonzero((d[j] <= kth[j] + slack[j]) & (d[j] < np.inf))
                    score = np.sqrt(((x[near] - q[j]) ** 2).sum(axis=1))
                    top = np.lexsort((ids[near], score))[:k]
                    out[0].append(np.full(len(top), name[j])), out[1].append(ids[near][top]), out[2].append(score[top])
        a, b, c = (np.concatenate(o) if o else np.empty(0) for o in out)
        return pa.table({"query_id": pa.array(a.astype(np.int64)), "vec_id": pa.array(b.astype(np.int64)), "score": pa.array(c.astype(np.float64))})
    return run


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, embedding) of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding")).filter(
        "vec_id IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(embedding, x -> x <> 0)")
    rows = written(rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "ann-rows")
    common = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("embedding") == (common["n"] if common else 0))


def index(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE,
          block: int = BLOCK, recall: float = 0.95, part_rows: int = PART_ROWS) -> tuple[DataFrame, DataFrame]:
    """(every row with its part, a row for each query and part it visits)."""
    rows = usable(vectors, id_col, vector_col)
    n = rows.count()
    levels, reach = 1, WIDTH * 2 * part_rows
    while n > reach:
        levels, reach = levels + 1, reach * WIDTH
    picked = hashed_sample(rows, sample, n, "vec_id").select("embedding").collect()
    # copies of a vector would fill each other's neighbour lists
    known = np.unique(np.array([r["embedding"] for r in picked], np.float64), axis=0) if picked else np.empty((0, 1))
    share = recall ** (1 / levels)
    router = fit(known[np.random.default_rng(7).permutation(len(known))], n, k, share, part_rows)
    assigned = written(rows.mapInArrow(_assigned(router), VECTORS), "ann-assigned")
    counts = dict(assigned.groupBy("part").count().collect())  # at most WIDTH rows
    sizes = np.array([counts.get(p, 0) for p in range(1 if router is None else len(router.w[3]))], np.int64)
    asked = written(rows.filter(is_query).mapInArrow(_routed(router, sizes, k), VECTORS), "ann-asked")
    for level in range(1, levels):
        assigned, asked = _deeper(assigned, asked, sample, block, k, share, part_rows, level)
    return assigned, asked


def search(vectors: DataFrame, is_query, k: int = 10, block: int = BLOCK, **options) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of all other rows found for each row where ``is_query`` (on vec_id)."""
    assigned, asked = index(vectors, is_query, k, block=block, **options)
    rows, row_sizes = _with_blocks(assigned, block, "block")
    queries, query_sizes = _with_blocks(asked, block, "query_block")
    both = row_sizes.select("part", F.col("blocks").alias("row_blocks")).join(query_sizes.select("part", F.col("blocks").alias("query_blocks")), "part")
    both = written(both, "ann-blocks")
    rows = _every("query_blocks", "query_block")(rows.join(both.select("part", "query_blocks"), "part"))
    queries = _every("row_blocks", "block")(queries.join(both.select("part", "row_blocks"), "part"))
    keys = ("part", "block", "query_block")
    best = rows.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(_best(k), "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
