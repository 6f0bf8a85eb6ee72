"""Packing along a space-filling curve.

Each document's token ids give a hashed bag-of-tokens vector, projected to a few
dimensions (the two steps are one table of pseudo-random directions per id).  The
quantised point's Hilbert key orders documents: neighbours on the curve have like
content.  Spark range-sorts by the key; each range is packed as one stream, cut every
``length`` ids.  The last, partial sequence of a range is cut into powers of two, which
need no padding, so nothing is padded at all.

Defined cases: null and empty texts are their end id alone; equal keys are ordered by
doc_id (null first), so that a hot key is spread over ranges; repeated rows are packed
each.  A document longer than a sequence goes on in the next; very long texts are encoded
whole.  An empty table gives an empty result.  Further columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, tasks_for, written
from .tokens import word_ids
from .words import mix

DIMENSIONS, BITS, SEGMENT_BYTES = 3, 10, 4 << 20
PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def directions(vocabulary: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A pseudo-random vector per id, uniform in [-1, 1]."""
    h = mix(np.arange(1, vocabulary * dimensions + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return ((h >> np.uint64(11)).astype(np.float64) / 2**52 - 1).reshape(vocabulary, dimensions)


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of each row of integers below 2**bits."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns of every level, from the top
        low = q - 1
        for i in range(n):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code across the axes
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(ids: np.ndarray, bounds: np.ndarray, table: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert key of each text's mean direction."""
    if len(bounds) < 2:
        return np.empty(0, np.int64)
    sums = np.stack([np.add.reduceat(table[:, d][ids], bounds[:-1]) for d in range(table.shape[1])], axis=1)
    mean = sums / np.diff(bounds)[:, None]
    grid = ((np.tanh(4 * mean) + 1) / 2 * ((1 << bits) - 1)).round().astype(np.int64)
    return hilbert_keys(grid, bits)


def _tokenised(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_ids(path)
        table = directions(max(tokens.tokenizer.get_vocab_size(with_added_tokens=True), end + 1))

        def encoded(doc_ids: list, texts: list[bytes]) -> pa.RecordBatch:
            ids, bounds = tokens.encode(texts, end)
            keys = curve_keys(ids, bounds, table)
            small = ids.astype("<u2") if len(table) <= 1 << 16 else ids.astype("<u4")
            offsets = pa.array(bounds * small.itemsize, pa.int32())
            blob = pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, offsets.buffers()[1], pa.py_buffer(small.tobytes())])
            return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(np.diff(bounds), pa.int64()),
                                               blob, pa.array([small.itemsize] * len(texts), pa.int32())], names=["doc_id", "curve", "n", "ids", "width"])

        for batch in batches:
            texts, doc_ids, i, held = as_bytes(batch.column("text")), batch.column("doc_id").to_pylist(), 0, 0
            for j, t in enumerate(texts):
                held += len(t)
                if held >= SEGMENT_BYTES:
                    yield encoded(doc_ids[i : j + 1], texts[i : j + 1])
                    i, held = j + 1, 0
            if i < len(texts):
                yield encoded(doc_ids[i:], texts[i:])
    return run


def _packed(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence, fill, held, out = TaskContext.get().partitionId() << 36, 0, [], []

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            doc, start, ids, total, seq, at = zip(*pieces, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array([len(i) for i in ids], pa.int64()),
                 pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary()), pa.array(total, pa.int64()),
                 pa.array(seq, pa.int64()), pa.array(at, pa.int64())],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for doc, blob, width in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "width")), strict=True):
                ids, start = np.frombuffer(blob, f"<u{width}"), 0
                while start < len(ids):
                    part = ids[start : start + length - fill]
                    held.append((doc, start, part, len(ids), sequence, fill))
                    start, fill = start + len(part), fill + len(part)
                    if fill == length:
                        out += held
                        held, fill, sequence = [], 0, sequence + 1
                if len(out) >= 2000:
                    yield rows(out)
                    out = []
        # the rest, cut into powers of two
        power = 1 << max(fill.bit_length() - 1, 0)
        room, at = 0, 0
        for doc, start, ids, total, _, _ in held:
            i = 0
            while i < len(ids):
                if not room:
                    while not fill & power:
                        power >>= 1
                    room, at, fill = power, 0, fill ^ power
                part = ids[i : i + room]
                out.append((doc, start + i, part, total, sequence, at))
                i, at, room = i + len(part), at + len(part), room - len(part)
                if not room:
                    sequence += 1
        if out:
            yield rows(out)
    return run


def pack(docs: DataFrame, tokenizer: str, end: int = 1, length: int = 2048, id_col: str = "doc_id", text_col: str = "text",
         range_bytes: int = 32 << 20) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of a word-level vocabulary file, the same on every executor.
    """
    light = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = written(light.mapInArrow(_tokenised(tokenizer, end), "doc_id long, curve long, n long, ids binary, width int"), "packing-ids")
    total = rows.agg(F.sum(F.col("n") * F.col("width"))).first()[0]
    ranges = tasks_for(docs.sparkSession, total, range_bytes)
    return rows.repartitionByRange(ranges, "curve", "doc_id").sortWithinPartitions("curve", "doc_id") \
        .mapInArrow(_packed(length), PIECE)
