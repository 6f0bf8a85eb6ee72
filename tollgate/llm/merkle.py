"""Merkle manifest of a dataset by time-forward processing: digests forward in label order, proofs backward.

A node's label is (level, index), so every child precedes its parent.  The forward sweep takes
messages from a priority queue ordered by label: all digests addressed to one node come out
together, are hashed, and the result goes into the queue for that node's own parent.  The
reversed sweep runs the labels downward: a node takes its proof suffix from the queue and sends
each child the child's siblings followed by that suffix, until the leaves have theirs.

The queue is external in two steps.  Labels are cut into aligned blocks of 16**3 nodes; between
blocks the messages wait in a table and Spark's shuffle delivers them by (tree, block), and
within a block they pass through a heap.  A block holds at most 4,096 nodes whatever the size of
a tree, so a source with a third of all rows is only more blocks.  A table of n leaves takes
log(n)/log(4096) rounds; each writes one row per 4,096 of the round before.

Rows are numbered by a range partitioning on (source, id, leaf) that also splits one source, one
id or equal rows; nothing but counts of a partition and a source is joined back.  Of the texts
only digests leave the first scan.

Defined cases: a null field is written as ``-``, an empty one as ``0:``; null sources form a tree
of their own, first; null ids come first in their source and are never tampered with; rows that
share an id follow the order of their leaves, equal rows are leaves of their own; very long texts
are hashed whole.  An empty table gives an empty result.  Further columns, whatever their names,
are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WIDTH, LEVELS = 16, 3
LEVEL_BITS = 48  # a label is level << LEVEL_BITS | index
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ROWS_PER_TASK = 500_000
PATH = "array<struct<left:string,right:string>>"
A_Z, a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Step = tuple[str, str]  # the siblings left and right of a node
Link = tuple[Step, "Link"] | None  # a proof suffix; its tail is shared by all below a node


def digest(parts: Iterator[str] | list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(total: int, most: int = LEVELS) -> int:
    """Levels a block climbs: all ``most`` of them, or as many as leave one node of a tree that ends here."""
    if total > WIDTH**most:
        return most
    n = 0
    while WIDTH**n < total:
        n += 1
    return n


def forward(digests: list[str], levels: int) -> tuple[str, dict[int, list[str]]]:
    """(the block's top digest, each inner node's child digests by label)."""
    if not levels:
        return digests[0], {}
    queue = [(1 << LEVEL_BITS | i // WIDTH, i, d) for i, d in enumerate(digests)]
    heapq.heapify(queue)
    runs: dict[int, list[str]] = {}
    while queue:
        label, run = queue[0][0], []
        while queue and queue[0][0] == label:
            run.append(heapq.heappop(queue)[2])
        runs[label], own = run, digest(run)
        level, index = label >> LEVEL_BITS, label & ((1 << LEVEL_BITS) - 1)
        if level < levels:
            heapq.heappush(queue, (level + 1 << LEVEL_BITS | index // WIDTH, index, own))
    return own, runs


def backward(n: int, levels: int, runs: dict[int, list[str]], suffix: Link) -> list[Link]:
    """Each of the block's n nodes' path to the root, from the suffix of the block's top."""
    if not levels:
        return [suffix]
    out: list[Link] = [None] * n
    queue = [(-(levels << LEVEL_BITS), suffix)]
    while queue:
        label, above = heapq.heappop(queue)
        level, index = -label >> LEVEL_BITS, -label & ((1 << LEVEL_BITS) - 1)
        run = runs[-label]
        for j in range(len(run)):
            path = (("".join(run[:j]), "".join(run[j + 1 :])), above)
            child = index * WIDTH + j
            if level == 1:
                out[child] = path
            else:
                heapq.heappush(queue, (-(level - 1 << LEVEL_BITS | child), path))
    return out


def steps(path: Link) -> Iterator[Step]:
    while path is not None:
        yield path[0]
        path = path[1]


def linked(path: list[dict]) -> Link:
    out: Link = None
    for step in reversed(path):
        out = ((step["left"], step["right"]), out)
    return out


def proof_of(path: Link) -> str:
    return digest([s for step in steps(path) for s in step])


def fold(leaf: str, path: Link) -> str:
    for left, right in steps(path):
        leaf = digest([left, leaf, right])
    return leaf


def _in_order(table: pa.Table) -> pa.Table:
    return table.sort_by("pos")


def _up(most: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """A block's top: a node of the next round."""
        table = _in_order(table)
        total = table.column("total")[0].as_py()
        top, _ = forward(table.column("digest").to_pylist(), levels_of(total, most))
        return pa.table({"tree": pa.array([key[0].as_py()], pa.string()), "pos": pa.array([key[1].as_py()], pa.int64()),
                         "total": pa.array([-(-total // WIDTH**most)], pa.int64()), "digest": [top]})
    return run


def _paths(table: pa.Table, above: pa.Table, most: int) -> list[Link]:
    digests, levels = table.column("digest").to_pylist(), levels_of(table.column("total")[0].as_py(), most)
    return backward(len(digests), levels, forward(digests, levels)[1], linked(above.column("path")[0].as_py()))


def _down(most: int):
    def run(table: pa.Table, above: pa.Table) -> pa.Table:
        """The paths of a block's nodes, which are the suffixes of the blocks below."""
        table, paths, subroot = _in_order(table), [], []
        if table.num_rows:
            paths, subroot = _listed(_paths(table, above, most)), [above.column("subroot")[0].as_py()] * table.num_rows
        return pa.table({"tree": table.column("tree"), "block": table.column("pos"), "path": pa.array(paths, _path_type()), "subroot": pa.array(subroot, pa.string())})
    return run


def _listed(paths: list[Link]) -> list[list[dict]]:
    return [[{"left": a, "right": b} for a, b in steps(p)] for p in paths]


def _path_type() -> pa.DataType:
    return pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _leaves(root: str, with_path: bool, most: int):
    def run(table: pa.Table, above: pa.Table) -> pa.Table:
        """Each leaf's proof, and the root folded from what the row holds now."""
        table = _in_order(table)
        n = table.num_rows
        paths = _paths(table, above, most) if n else []
        leaf, tampered = table.column("digest").to_pylist(), table.column("tampered").to_pylist()
        folded = [fold(t or d, p) for d, t, p in zip(leaf, tampered, paths, strict=True)]
        kept = _listed(paths) if with_path else [[]] * n
        return pa.table({"doc_id": table.column("doc_id"), "leaf": table.column("digest"),
                         "subroot": pa.array([above.column("subroot")[0].as_py()] * n if n else [], pa.string()),
                         "root": pa.array([root] * n, pa.string()), "proof_sha256": pa.array([proof_of(p) for p in paths], pa.string()),
                         "folded_root": pa.array(folded, pa.string()), "verified": pa.array([f == root for f in folded], pa.bool_()),
                         "path": pa.array(kept, _path_type())})
    return run


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with pos (from 0) and total within their tree.

    A range partitioning on (tree, order) is written once; a row's number is its partition's
    offset in the tree plus its place there.  ``order`` must tell rows apart, so that any tree splits."""
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_PER_TASK))
    ranged = written(rows.repartitionByRange(tasks, "tree", *order).sortWithinPartitions("tree", *order)
                     .withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "merkle-ranges")
    inside = ranged.groupBy("part", "tree").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = inside.select("part", "tree", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(tree).alias("total"))
    return ranged.join(offsets, ["part", "tree"]).withColumn("pos", F.col("place") + F.col("shift")).drop("part", "place", "shift")


class Sweep:
    """The rounds of all trees of one kind; ``nodes``: (tree, pos, total, digest, ...), one row per leaf."""

    def __init__(self, nodes: DataFrame, name: str, most: int = LEVELS):
        self.most, size = most, WIDTH**most
        self.rounds = [nodes.withColumn("block", F.expr(f"pos div {size}"))]
        rest = nodes.agg(F.max("total")).first()[0] or 0
        tops = []
        while rest:
            up = self.rounds[-1].select("tree", "block", "pos", "total", "digest").groupBy("tree", "block").applyInArrow(_up(most), "tree string, pos long, total long, digest string")
            up = written(up, f"merkle-{name}-{len(self.rounds)}")
            tops.append(up.where("total = 1").select("tree", F.col("digest").alias("subroot"), F.lit(len(self.rounds) - 1).alias("round")))
            rest = -(-rest // size) if rest > size else 0
            if rest:
                self.rounds.append(up.where("total > 1").withColumn("block", F.expr(f"pos div {size}")))
        self.tops = tops[0] if tops else nodes.sparkSession.createDataFrame([], "tree string, subroot string, round int")
        for t in tops[1:]:
            self.tops = self.tops.unionByName(t)

    def paths(self, above: DataFrame, finish, schema: str) -> DataFrame:
        """The reversed sweep from ``above`` (tree, path, subroot, round) to the leaves, where ``finish`` makes the rows."""
        suffix = None
        for k in range(len(self.rounds) - 1, -1, -1):
            own = above.where(F.col("round") == k).select("tree", F.lit(0).cast("long").alias("block"), "path", "subroot")
            suffix = own if suffix is None else suffix.unionByName(own)
            to = (finish, schema) if k == 0 else (_down(self.most), f"tree string, block long, path {PATH}, subroot string")
            suffix = self.rounds[k].groupBy("tree", "block").cogroup(suffix.groupBy("tree", "block")).applyInArrow(*to)
        return suffix


def _field(c: Column) -> Column:
    c = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))


def _leaf(columns: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*map(_field, columns.values())), 256)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", tree_col: str = "source", text_col: str = "text",
             tamper: Column | None = None, with_path: bool = False, most: int = LEVELS) -> DataFrame:
    """For every row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified and, if asked for, its path.

    ``tamper``: the rows whose text is lower-cased (A-Z) before the root is folded again.  ``most``: levels of a block."""
    spark = docs.sparkSession
    given = {f: F.col(f"`{f}`") for f in fields}
    changed = given | {text_col: F.translate(given[text_col], A_Z, a_z)}
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{tree_col}`").cast("string")), F.lit(""))  # null first, then bytewise
    tamper = F.lit(False) if tamper is None else F.coalesce(tamper, F.lit(False))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), tree.alias("tree"), _leaf(given).alias("digest"),
                       F.when(tamper, _leaf(changed)).alias("tampered"), F.monotonically_increasing_id().alias("row_id"))
    leaves = written(numbered(written(rows, "merkle-leaves"), "doc_id", "digest", "row_id").drop("row_id"), "merkle-numbered")
    sweep = Sweep(leaves, "leaves", most)
    subroots = written(sweep.tops, "merkle-subroots")
    order = numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("member"), F.col("subroot").alias("digest"), "round"), "member")
    order = written(order, "merkle-order")
    top = Sweep(order, "sources", most)
    root = (top.tops.first() or {"subroot": ""})["subroot"]
    above = top.tops.select("tree", F.array().cast(PATH).alias("path"), "subroot", "round")
    above = top.paths(above, _members(most), f"tree string, path {PATH}, subroot string, round int")
    doc_type = leaves.schema["doc_id"].dataType.simpleString()
    out = sweep.paths(above, _leaves(root, with_path, most), f"doc_id {doc_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, path {PATH}")
    return out if with_path else out.drop("path")


def _members(most: int):
    def run(table: pa.Table, above: pa.Table) -> pa.Table:
        """Each source's path from its subroot to the root."""
        table = _in_order(table)
        paths = _listed(_paths(table, above, most)) if table.num_rows else []
        return pa.table({"tree": table.column("member"), "path": pa.array(paths, _path_type()), "subroot": table.column("digest"), "round": table.column("round")})
    return run
