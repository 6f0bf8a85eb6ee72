"""SimHash near-duplicates: tiled exact comparison of fingerprints with numpy.

Distinct fingerprints are put into tiles by the population counts of their lanes (the
64 bits cut into 2, 4 or 8 equal parts).  Two fingerprints within the radius differ
by at most the radius in the sum of the lanes' population counts, so a tile meets only
the tiles whose counts are that near; every other tile pair is skipped.  Inside a pair
all bits are compared (exclusive-or, bit counts).  The lane count follows the number of
fingerprints, so that tiles stay small; it decides which pairs are skipped, never which
links are found.  A tile above TILE fingerprints is cut into blocks, and what passes by a
tile into segments, so that no task depends on how full the middle tiles are.

A tile pair gives a spanning set of its links, not all of them: components are the same.

Defined cases: null and empty texts have fingerprint zero and link like any other; a
document of fewer words than the shingle length is one shingle; repeated rows share a
fingerprint; a null doc_id never names a component (null if no linked row has an id); ties and
equal fingerprints are one component; very long texts are read whole.  An empty table gives an empty
result.  Further columns, whatever their names, pass through ``kept_documents`` unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_AZ, as_bytes, signed, tasks_for, written
from .components import connected_components

SEED = 42
TILE, SEGMENT = 16_384, 8_192


def fingerprint(text: bytes, width: int) -> int:
    """SimHash of one text's word shingles; zero without words."""
    words = text.translate(LOWER_AZ).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    stops = (ends[width - 1 :] - 1).tolist()
    starts = [0, *ends[: len(stops) - 1].tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64)
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_535):  # uint16 sums cannot overflow inside a slice
        bits = np.unpackbits(hashes[i : i + 65_535].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += np.add.reduce(bits, axis=0, dtype=np.uint16)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(text_col: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [signed(fingerprint(t, width)) for t in as_bytes(batch.column(text_col))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])
    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; fp is the 64 bits as a signed long."""
    light = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return light.mapInArrow(_fingerprints("text", width), "doc_id long, fp long")


def _near(lanes: int, radius: int) -> list[tuple[int, ...]]:
    """Differences of lane counts up to the radius: zero first, then one of each opposite pair."""
    found = []

    def grow(head: tuple[int, ...], left: int) -> None:
        if len(head) == lanes:
            found.append(head)
            return
        for d in range(-left, left + 1):
            grow((*head, d), left - abs(d))

    grow((), radius)
    return sorted((d for d in found if d >= (0,) * lanes), key=lambda d: (d != (0,) * lanes, d))


def lanes_for(n: int, tile: int = TILE) -> int:
    """The fewest lanes (2, 4 or 8) at which the fullest tile of n random fingerprints stays within ``tile``."""
    for lanes, share in ((2, 0.02), (4, 0.0015)):  # share of the fullest tile
        if n * share <= tile:
            return lanes
    return 8


def _spanning(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row-to-column links that connect what the hit matrix connects, at most about rows + columns of them."""
    r, c = np.nonzero(hits)
    if len(r) <= 4 * sum(hits.shape):
        return r, c
    first = hits.argmax(axis=0)  # of each hit column, the first row that hits it
    # a row joins the first rows of its columns: keep one column for each (row, first row)
    pair = r * hits.shape[0] + first[c]
    _, keep = np.unique(pair, return_index=True)
    cols = np.flatnonzero(hits.any(axis=0))
    return np.concatenate([r[keep], first[cols]]), np.concatenate([c[keep], cols])


def _compare(left: np.ndarray, right: np.ndarray, radius: int, upper: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between two arrays; ``upper``: they are the same array, each pair once."""
    for i in range(0, len(left), 256):
        rows = left[i : i + 256]
        cols = right[i:] if upper else right
        if len(cols):
            hits = np.bitwise_count(rows[:, None] ^ cols[None, :]) <= radius
            if upper:
                hits[np.tril_indices(len(rows), 0, hits.shape[1])] = False
            if hits.any():
                r, c = _spanning(hits)
                yield rows[r], cols[c]


def _tiles(radius: int):
    """Rows sorted by (unit, block, segment, side): side 0 is the block's own tile part, side 1 is streamed past it.
    The own part is compared with itself in segment 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, closed = None, [], False

        def close() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            nonlocal own, closed
            if not closed:
                own, closed = np.concatenate(own) if own else np.empty(0, np.uint64), True
                if key[2] == 0:
                    yield from _compare(own, own, radius, True)

        def links(found):
            for a, b in found:
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["u", "v"])

        for batch in batches:
            unit, block, segment, side, fp = (batch.column(c).to_numpy() for c in ("unit", "block", "segment", "side", "fp"))
            fp = fp.view(np.uint64)
            cuts = np.flatnonzero((np.diff(unit) != 0) | (np.diff(block) != 0) | (np.diff(segment) != 0) | (np.diff(side) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(fp)], strict=True):
                if a == b:
                    continue
                if (unit[a], block[a], segment[a]) != key:
                    yield from links(close()) if key is not None else ()
                    key, own, closed = (unit[a], block[a], segment[a]), [], False
                if side[a] == 0:
                    own.append(fp[a:b])
                else:
                    yield from links(close())
                    if len(own):
                        yield from links(_compare(fp[a:b], own, radius, False))
        if key is not None:
            yield from links(close())
    return run


def _tile_key(lanes: int) -> F.Column:
    size = 64 // lanes
    parts = [F.bit_count(F.col("fp").bitwiseAND(F.lit(signed(((1 << size) - 1) << (size * k))).cast("long"))).cast("long") * (1 << (7 * k)) for k in range(lanes)]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def near_links(distinct: DataFrame, radius: int = 2, lanes: int | None = None, tile: int = TILE, segment: int = SEGMENT) -> DataFrame:
    """(u, v) over a written table of distinct ``fp`` that span every component of fingerprints within ``radius`` bits."""
    spark = distinct.sparkSession
    n = distinct.count()
    lanes = lanes or lanes_for(n, tile)
    keyed = distinct.select("fp", _tile_key(lanes).alias("tile"))
    steps = [F.lit(sum(d * (1 << (7 * k)) for k, d in enumerate(delta))).cast("long") for delta in _near(lanes, radius)]
    # how many blocks a tile has, and how many segments pass by it: its near tiles, and its own later blocks
    sizes = written(keyed.groupBy("tile").count(), "simhash-tiles")
    passing = sizes.select(F.posexplode(F.array(*[F.col("tile") - s for s in steps])).alias("step", "unit"), "count") \
        .groupBy("unit").agg(F.sum(F.when(F.col("step") > 0, F.col("count")).otherwise(0)).alias("passing"))
    blocks = F.ceil(F.col("count") / tile).cast("int")
    plan = written(sizes.withColumnRenamed("tile", "unit").join(passing, "unit").select(
        "unit", blocks.alias("blocks"),
        F.greatest(F.ceil((F.col("passing") + F.when(blocks > 1, F.col("count")).otherwise(0)) / segment), F.lit(1)).cast("int").alias("segments")), "simhash-plan")
    sent = keyed.select("fp", F.posexplode(F.array(*[F.col("tile") - s for s in steps])).alias("step", "unit")).join(plan, "unit")
    placed = sent.withColumn("home", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")) \
        .withColumn("segment", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("segments")).cast("int"))
    # a tile's own fingerprint meets every segment in its block; any other passes by each block in its segment
    at = F.expr("""concat(
        if(step = 0, transform(sequence(0, segments - 1), s -> struct(home AS block, s AS segment, 0 AS side)), array()),
        transform(filter(sequence(0, blocks - 1), b -> step > 0 OR b > home), b -> struct(b AS block, segment AS segment, 1 AS side)))""")
    rows = placed.select("fp", "unit", F.explode(at).alias("at")).select("unit", "at.*", "fp")
    parts = tasks_for(spark, n * len(steps) * 32, 32 << 20)
    return rows.repartition(parts, "unit", "block", "segment").sortWithinPartitions("unit", "block", "segment", "side") \
        .mapInArrow(_tiles(radius), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
                    radius: int = 2, lanes: int | None = None, tile: int = TILE, segment: int = SEGMENT) -> DataFrame:
    """(doc_id, fp, component_id) of every row: the smallest doc_id reachable over links of ``radius`` bits or fewer."""
    rows = written(fingerprints(docs, id_col, text_col, width), "simhash-fp")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    parts = connected_components(near_links(distinct.select("fp"), radius, lanes, tile, segment))
    grouped = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component"))
    names = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = written(grouped.join(names, "component").select("fp", "component_id"), "simhash-components")
    return rows.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """One row of each group, that with the smallest doc_id; rows without a doc_id stay.

    Rows that repeat the kept doc_id stay with it: they carry one id and count as one document.
    """
    found = near_duplicates(docs, **options)
    id_col = options.get("id_col", "doc_id")
    dropped = found.filter("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(dropped, id_col, "left_anti").select(*[docs[f"`{c}`"] for c in docs.columns])
