"""Mixing sources to target weights by subset-sum budget fitting.

1. Documents are counted by source and exact length (words).  All later planning reads these
   counts alone.
2. Targets: the sources' weights share the budget; a source stops at ``most`` times its size and
   its excess is shared again by weight.  The rounds pass only sums through the driver.
3. Budget fitting, per source: whole repeats first, then each length's even share of the rest,
   rounded down.  What the rounding leaves is a bounded knapsack over the length counts still
   free: long lengths are taken while more than ``exact`` words are missing, and the last ones by
   dynamic programming over sums, exactly, or as near as the lengths allow.
4. Seeded selection by length count: of a source's documents of one length, those with the
   smallest seeded hash of id and text are taken once more.  A length's documents are cut into
   strata by that hash, so no task holds a length, a source or the copies of one row: equal rows
   count as one row with a number.

Defined cases: null text has no words and a document without words gives none; a null source is
a source of its own, last; very long texts are counted whole; documents are chosen by hash, so
there are no ties but equal rows, of which any are as good; an empty table gives an empty result.
Further columns, whatever their names, are not read by ``mix`` and pass through ``mixed``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WORD = r"[^\x20\x09-\x0D]+"
FIT = 1 << 16  # words fitted by dynamic programming
STRATUM = 4096  # documents of one stratum, about
SEED = 42


def knapsack(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length to take so that the sum is nearest to ``budget``, at most ``counts``.

    Dynamic programming over sums: ``by[s]`` is the first item to reach s, an item being 1, 2, 4, ...
    documents of one length; each sum is walked back through items of falling number."""
    taken = [0] * len(lengths)
    usable = [i for i in range(len(lengths)) if counts[i] and lengths[i]]
    if budget <= 0 or not usable:
        return taken
    limit = 2 * budget  # a sum over the budget may be nearer, but none beyond this is nearer than 0
    by = np.full(limit + 1, -1, np.int32)
    by[0] = 0
    items: list[tuple[int, int]] = [(-1, 0)]
    for i in sorted(usable, key=lambda i: -lengths[i]):
        left, n = min(counts[i], limit // lengths[i]), 1
        while left > 0 and by[budget] < 0:
            n = min(n, left)
            size = n * lengths[i]
            new = np.flatnonzero((by[:-size] >= 0) & (by[size:] < 0)) + size
            by[new] = len(items)
            items.append((i, n))
            left, n = left - n, 2 * n
        if by[budget] >= 0:
            break
    sums = np.flatnonzero(by >= 0)
    at = int(sums[np.argmin(np.abs(sums - budget))])
    while at:
        i, n = items[by[at]]
        taken[i] += n
        at -= n * lengths[i]
    return taken


def fit(lengths: list[int], counts: list[int], budget: int, exact: int = FIT) -> tuple[int, list[int]]:
    """(whole repeats of all documents, how many of each length to take once more)."""
    size = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if not size:
        return 0, [0] * len(lengths)
    repeats, rest = divmod(budget, size)
    taken = [c * rest // size for c in counts]
    left = rest - sum(n * t for n, t in zip(lengths, taken, strict=True))
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if lengths[i] and left > exact:
            more = min(counts[i] - taken[i], (left - exact) // lengths[i])
            taken[i] += more
            left -= more * lengths[i]
    free = [c - t for c, t in zip(counts, taken, strict=True)]
    return repeats, [t + m for t, m in zip(taken, knapsack(lengths, free, left), strict=True)]


def _fit(exact: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("size")
        sizes, counts = table.column("size").to_pylist(), table.column("n").to_pylist()
        repeats, taken = fit(sizes, counts, table.column("budget")[0].as_py(), exact)
        return pa.table({"key": pa.array([key[0].as_py()] * len(sizes), pa.string()), "size": pa.array(sizes, pa.int64()), "n": pa.array(counts, pa.int64()),
                         "more": pa.array(taken, pa.int64()), "repeats": pa.array([repeats] * len(sizes), pa.int64())})
    return run


def source_key(source: Column) -> Column:
    """Null apart from every text; sorted by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def weighted(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """``sources`` with the weight of their rank by key: ``weights`` in turn.

    Ranks come from a range partitioning: a partition's offset plus the place in it."""
    ranged = written(sources.repartitionByRange("key").sortWithinPartitions("key")
                     .withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "mixing-ranges")
    inside = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    shift = inside.select("part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place") + F.col("shift"), F.lit(len(weights))) + 1).cast("int"))
    return ranged.join(shift, "part").select("key", "source_size", turn.cast("long").alias("weight"))


def targets(sources: DataFrame, percent: int, most: int) -> DataFrame:
    """``sources`` (key, source_size, weight) with ``target``: the level at which the weights, each
    stopped at ``most`` times its source's size, share ``percent`` of all words.

    A round stops the sources above their limit and shares what is left by weight; only sums reach the driver."""
    limit, big = F.col("source_size") * most, "decimal(38,0)"
    all_words = sources.agg(F.sum("source_size")).first()[0] or 0
    stopped, rest, weight = F.lit(False), 0, 1  # sources at their limit; 100 times the words and the weight of the others
    count = -1
    while True:
        s = sources.agg(F.sum(F.when(stopped, limit)).alias("words"), F.sum(F.when(~stopped, F.col("weight"))).alias("weight"),
                        F.count_if(stopped).alias("n")).first()
        rest, weight = percent * all_words - 100 * (s.words or 0), s.weight or 0
        if s.n == count or not weight:
            break
        count = s.n
        stopped = 100 * limit.cast(big) * F.lit(weight).cast(big) <= F.col("weight").cast(big) * F.lit(rest).cast(big)
    share = F.col("weight") * F.lit(rest / (100 * weight) if weight else 0.0)
    return sources.withColumn("target", F.when(stopped, limit.cast("double")).otherwise(share))


def repeated(rows: DataFrame, times: str, name: str, *keys: str) -> DataFrame:
    """Each row as often as ``times`` says, numbered from 0 in ``name``; a row with a huge number is dealt out in runs."""
    runs = rows.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1, F.lit(STRATUM).cast("long"))))
    return (runs.repartition(*keys, "run").withColumn(name, F.explode(F.sequence("run", F.least(F.col("run") + (STRATUM - 1), F.col(times) - 1))))
            .drop("run"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, most: int = 2, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source", seed: int = SEED, exact: int = FIT) -> DataFrame:
    """For every row: doc_id, size, key (of its source), source_size, target, copies, taken (= copies * size), chosen (its hash)."""
    text = F.col(f"`{text_col}`").cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    rows = written(docs.select(F.col(f"`{id_col}`").alias("doc_id"), source_key(F.col(f"`{source_col}`")).alias("key"), size.alias("size"),
                               chosen(id_col, text_col, seed).alias("chosen")), "mixing-sizes")
    lengths = written(rows.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")), "mixing-lengths")
    sources = lengths.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    sources = written(targets(written(weighted(sources, weights), "mixing-sources"), percent, most), "mixing-targets")
    budget = lengths.join(sources.select("key", F.floor(F.col("target") + 0.5).cast("long").alias("budget")), "key")
    plan = budget.groupBy("key").applyInArrow(_fit(exact), "key string, size long, n long, more long, repeats long")
    plan = written(plan.join(sources.drop("weight"), "key").withColumn("strata", F.expr(f"(n + {STRATUM - 1}) div {STRATUM}")), "mixing-plan")
    # equal rows become one row with a number before anything is dealt by source or length
    units = rows.groupBy("key", "size", "doc_id", "chosen").agg(F.count(F.lit(1)).alias("same")).join(plan, ["key", "size"])
    spread = F.shiftrightunsigned("chosen", 32)  # 32 bits, so that the product below stays a long
    units = written(units.withColumn("stratum", F.shiftright(spread * F.least("strata", F.lit(1 << 30)), 32)), "mixing-units")
    strata = units.groupBy("key", "size", "stratum").agg(F.sum("same").alias("inside"))
    earlier = Window.partitionBy("key", "size").orderBy("stratum").rowsBetween(Window.unboundedPreceding, -1)
    strata = strata.select("key", "size", "stratum", F.coalesce(F.sum("inside").over(earlier), F.lit(0)).alias("before"))
    order = Window.partitionBy("key", "size", "stratum").orderBy("chosen", F.asc_nulls_first("doc_id"))
    first = F.coalesce(F.sum("same").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = units.join(strata, ["key", "size", "stratum"]).withColumn("first", F.col("before") + first)
    copies = F.col("repeats") + (F.col("first") + F.col("i") < F.col("more")).cast("long")
    return (repeated(cut, "same", "i", "chosen")
            .select("doc_id", "size", "key", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "chosen"))


def chosen(id_col: str, text_col: str, seed: int) -> Column:
    """The seeded hash that decides which documents of a length are taken."""
    return F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **options) -> DataFrame:
    """The mix itself: each taken row of ``docs`` as often as it is taken, all columns unchanged.

    Rows are found again by hash, id, source; of rows that agree in these and in the text, one stands for all."""
    plan = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed, **options)
    total = plan.groupBy("key", F.col("doc_id").alias("mix_id"), F.col("chosen").alias("mix_hash")).agg(F.sum("copies").alias("mix_copies"), F.count(F.lit(1)).alias("mix_rows"))
    total = written(total.where("mix_copies > 0").withColumnRenamed("key", "mix_key"), "mixing-total")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), source_key(F.col(f"`{source_col}`")).alias("row_key"),
                      F.col(f"`{id_col}`").alias("row_id"), chosen(id_col, text_col, seed).alias("row_hash"))
    found = row.join(total, (F.col("row_key") == F.col("mix_key")) & F.col("row_id").eqNullSafe(F.col("mix_id")) & (F.col("row_hash") == F.col("mix_hash")))
    single = found.where("mix_rows = 1").select("row", "mix_copies")
    several = found.where("mix_rows > 1").groupBy("mix_key", "mix_id", "mix_hash").agg(F.first("row").alias("row"), F.first("mix_copies").alias("mix_copies"))
    single = single.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies")))).select("row")
    several = repeated(several, "mix_copies", "copy", "mix_hash").select("row")
    return single.unionByName(several).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])

