"""Substring deduplication: fixed-block anchors, probed with every rolling window.

A passage of ``window`` words that occurs twice holds, at its earlier place, one whole
aligned block of (window + 1) / 2 words (blocks do not overlap; word 0 starts one).

1. Anchors.  Documents are dealt to chunks.  A chunk hashes every rolling block-sized
   window of its texts; those at aligned positions are the index entries, all of them
   are probes.  Distinct hashes go, sorted and delta-coded, to hash buckets.  A bucket
   answers each chunk with one bit per hash: some chunk indexed it, and it is elsewhere too.
2. Extension.  Full windows around a hit are the candidates to extend.  A chunk sends the
   distinct ones (96 bits of two independent hashes) with its smallest doc_id; the bucket
   answers with one bit: another chunk holds this window in a smaller document.
3. Each word under a window that also starts in a smaller document is removed; touching
   windows merge into maximal exact repeats (``spans``).

A hot passage costs one entry per chunk, however many documents repeat it; nothing is
paired.  Texts are shuffled once and read three times from the same exchange.  A bucket
and a chunk are bounded: their numbers follow the bytes of the texts.

Defined cases: null text has no words; texts shorter than the window keep all words; a
null doc_id is smaller than any other; rows that share a doc_id do not remove each
other's words; windows are judged on the input.  Texts without a removed word can be
told by n_removed = 0.  A very long text is one chunk's, read whole.  An empty table gives an
empty result.  Further columns, whatever their names, travel in ``row`` unread.

Windows are told apart by 96 bits of two independent hashes of their words (each word 64 bits
by tabulation and xxh3, not a polynomial), so two different windows agree with a chance of 2**-96 a pair.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, as_int64, tasks_for
from .words import inside_one_text, spans, window_hashes, word_hashes

NO_ID = -(1 << 63)
CHUNK_BYTES = 8 << 20
MESSAGE = "chunk int, bucket int, own boolean, blob binary"
U = np.uint64


def pack(values: np.ndarray) -> bytes:
    """Unsigned 64-bit values as byte planes, the low ones only, so that compression sees the zeros."""
    if not len(values):
        return struct.pack("<IB", 0, 0)
    k = max(1, (int(values.max()).bit_length() + 7) // 8)
    return struct.pack("<IB", len(values), k) + values.astype(U).view(np.uint8).reshape(-1, 8)[:, :k].T.tobytes()


def unpack(blob: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """(values, where the next part starts)."""
    n, k = struct.unpack_from("<IB", blob, at)
    at += 5
    out = np.zeros((n, 8), np.uint8)
    out[:, :k] = np.frombuffer(blob, np.uint8, n * k, at).reshape(k, n).T
    return out.view(U).reshape(-1), at + n * k


def pack_sorted(values: np.ndarray) -> bytes:
    return struct.pack("<Q", int(values[0]) if len(values) else 0) + pack(np.diff(values))


def unpack_sorted(blob: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    first = struct.unpack_from("<Q", blob, at)[0]
    steps, at = unpack(blob, at + 8)
    out = np.empty(len(steps) + 1, U)
    out[0] = first
    np.cumsum(steps, out=out[1:])
    out[1:] += U(first)
    return out, at


def bounds(buckets: int) -> np.ndarray:
    """Smallest hash of each bucket but the first."""
    return np.array([-(-(b << 64) // buckets) for b in range(1, buckets)], U)


class Chunk:
    """The words of one chunk's documents, in an order that depends on the rows alone.

    The three steps read the chunk from a shuffle, whose blocks arrive in any order; what one
    step notes by position, the next finds there again.  Equal rows are interchangeable."""

    def __init__(self, table: pa.Table, window: int):
        texts, ids = as_bytes(table.column("text")), as_int64(table.column("doc_id").combine_chunks(), NO_ID).tolist()
        order = sorted(range(len(texts)), key=lambda i: (ids[i], texts[i]))
        self.table, self.window, self.block = table.take(pa.array(order, pa.int64())), window, (window + 1) // 2
        self.texts, self.ids = [texts[i] for i in order], np.array([ids[i] for i in order], np.int64)
        self.buf, self.starts, self.ends, self.first = spans(self.texts)
        self.words = word_hashes(self.buf, self.starts, self.ends)

    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct hashes sorted, index of each rolling window's hash or -1, which hashes are aligned anywhere)."""
        hashes = window_hashes(self.words, self.block)
        ok = inside_one_text(self.first, self.block, len(hashes))
        at = np.flatnonzero(ok)
        distinct, inverse = np.unique(hashes[at], return_inverse=True)
        of = np.full(len(self.words), -1, np.int64)
        of[at] = inverse
        offset = at - self.first[np.searchsorted(self.first, at, "right") - 1]
        aligned = np.zeros(len(distinct), bool)
        aligned[inverse[offset % self.block == 0]] = True
        return distinct, of, aligned

    def candidates(self, hit: np.ndarray) -> np.ndarray:
        """Which full windows hold a hit (a bool per rolling block window)."""
        n = max(len(self.words) - self.window + 1, 0)
        total = np.zeros(len(hit) + 1, np.int64)
        np.cumsum(hit, out=total[1:])
        reach = self.window - self.block + 1
        return (total[reach : reach + n] > total[:n]) & inside_one_text(self.first, self.window, n)

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For the full windows at ``at``: distinct (hash, check) sorted by hash, each window's index, each one's smallest doc_id."""
        key = window_hashes(self.words, self.window)[at]
        second = word_hashes(self.buf, self.starts, self.ends, 1)
        check = window_hashes(second, self.window, 1)[at] >> U(32)
        order = np.lexsort((check, key))
        k, c = key[order], check[order]
        new = np.ones(len(order), bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        heads = np.flatnonzero(new)
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        docs = self.ids[np.searchsorted(self.first, at[order], "right") - 1]
        least = np.minimum.reduceat(docs, heads) if len(heads) else docs
        return k[heads], c[heads], of, least


def _message(chunk: int, parts: list[tuple[int, bool, bytes]]) -> pa.Table:
    b, own, blob = zip(*parts, strict=True) if parts else ((), (), ())
    return pa.table({"chunk": pa.array([chunk] * len(parts), pa.int32()), "bucket": pa.array(b, pa.int32()),
                     "own": pa.array(own, pa.bool_()), "blob": pa.array(blob, pa.binary())})


def _bits(replies: pa.Table, sizes: np.ndarray) -> np.ndarray:
    """The buckets' answers, one after the other; ``sizes``: how many hashes each bucket got."""
    found = [np.zeros(n, bool) for n in sizes]
    for bucket, own, blob in zip(*(replies.column(c).to_pylist() for c in ("bucket", "own", "blob")), strict=True):
        if not own:
            if len(blob) != (sizes[bucket] + 7) // 8:
                raise ValueError("a bucket answered another number of hashes than it was sent")
            found[bucket] = np.unpackbits(np.frombuffer(blob, np.uint8), count=sizes[bucket]).astype(bool)
    return np.concatenate(found) if found else np.empty(0, bool)


def _edges(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return np.concatenate([[0], np.searchsorted(hashes, bounds(buckets)), [len(hashes)]])


def _send_blocks(window: int, buckets: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        chunk = Chunk(table, window)
        hashes, _, aligned = chunk.blocks()
        cuts = _edges(hashes, buckets)
        return _message(key[0].as_py(), [
            (b, False, pack_sorted(hashes[i:j]) + np.packbits(aligned[i:j]).tobytes())
            for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if i < j])
    return run


def _gather(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(all values, the cuts between the parts)."""
    return (np.concatenate(parts) if parts else np.empty(0, U)), np.cumsum([0, *map(len, parts)])


def _match_blocks(table: pa.Table) -> pa.Table:
    """A bit for each hash a chunk sent: indexed by some chunk, and sent by another or indexed by another."""
    chunks, bucket = table.column("chunk").to_pylist(), table.column("bucket")[0].as_py()
    hashes, flags = [], []
    for blob in table.column("blob").to_pylist():
        h, at = unpack_sorted(blob)
        hashes.append(h)
        flags.append(np.unpackbits(np.frombuffer(blob, np.uint8, offset=at), count=len(h)).astype(bool))
    every, cuts = _gather(hashes)
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    heads = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    size = np.diff(np.append(heads, len(ranked)))
    shared = (size > 1) & np.logical_or.reduceat(np.concatenate(flags)[order], heads)
    answer = np.empty(len(every), bool)
    answer[order] = np.repeat(shared, size)
    return pa.table({"chunk": pa.array(chunks, pa.int32()), "bucket": pa.array([bucket] * len(chunks), pa.int32()), "own": pa.array([False] * len(chunks)),
                     "blob": pa.array([np.packbits(answer[i:j]).tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})


def _send_windows(window: int, buckets: int):
    def run(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _message(0, [])
        chunk = Chunk(table, window)
        hashes, of, aligned = chunk.blocks()
        shared = _bits(replies, np.diff(_edges(hashes, buckets)))
        shared |= aligned & (np.bincount(of[of >= 0], minlength=len(hashes)) > 1)  # repeats inside the chunk
        cand = chunk.candidates(np.append(shared, False)[of])
        name = key[0].as_py()
        parts = [(name % buckets, True, np.packbits(cand).tobytes())]
        k, c, _, least = chunk.windows(np.flatnonzero(cand))
        low = (least ^ np.int64(NO_ID)).view(U)  # order-keeping unsigned form
        cuts = _edges(k, buckets)
        for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if i < j:
                base = low[i:j].min()
                parts.append((b, False, pack_sorted(k[i:j]) + pack(c[i:j]) + struct.pack("<Q", int(base)) + pack(low[i:j] - base)))
        return _message(name, parts)
    return run


def _match_windows(table: pa.Table) -> pa.Table:
    """A bit for each window a chunk sent: another chunk has it in a smaller document.  A chunk's own note passes through."""
    chunks, notes = [], []
    keys, checks, lows = [], [], []
    bucket = table.column("bucket")[0].as_py()
    for name, own, blob in zip(*(table.column(c).to_pylist() for c in ("chunk", "own", "blob")), strict=True):
        if own:
            notes.append((name, blob))
            continue
        k, at = unpack_sorted(blob)
        c, at = unpack(blob, at)
        base = struct.unpack_from("<Q", blob, at)[0]
        low, _ = unpack(blob, at + 8)
        chunks.append(name), keys.append(k), checks.append(c), lows.append(low + U(base))
    every, cuts = _gather(keys)
    check, low = _gather(checks)[0], _gather(lows)[0]
    answer = np.zeros(len(every), bool)
    if len(every):
        order = np.lexsort((check, every))
        k, c = every[order], check[order]
        heads = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])]))
        least = np.minimum.reduceat(low[order], heads)
        answer[order] = low[order] > np.repeat(least, np.diff(np.append(heads, len(k))))
    blobs = [np.packbits(answer[i:j]).tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.table({"chunk": pa.array([*chunks, *(n for n, _ in notes)], pa.int32()),
                     "bucket": pa.array([bucket] * (len(chunks) + len(notes)), pa.int32()),
                     "own": pa.array([False] * len(chunks) + [True] * len(notes), pa.bool_()),
                     "blob": pa.array([*blobs, *(b for _, b in notes)], pa.binary())})


def _remove(window: int, buckets: int, with_text: bool):
    def run(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        chunk = Chunk(table, window) if table.num_rows else None
        if chunk is not None:
            table = chunk.table
        ids, given = table.column("doc_id"), table.column("text").is_valid().to_pylist()
        n_words, n_removed, shas, kept, repeats = [], [], [], [], []
        if chunk is not None:
            cand = np.zeros(max(len(chunk.words) - window + 1, 0), bool)
            for own, blob in zip(replies.column("own").to_pylist(), replies.column("blob").to_pylist(), strict=True):
                if own:
                    if len(blob) != (len(cand) + 7) // 8:
                        raise ValueError("a chunk's note is about another number of windows")
                    cand = np.unpackbits(np.frombuffer(blob, np.uint8), count=len(cand)).astype(bool)
            at = np.flatnonzero(cand)
            k, _, of, least = chunk.windows(at)
            remote = _bits(replies, np.diff(_edges(k, buckets)))
            doc = chunk.ids[np.searchsorted(chunk.first, at, "right") - 1]
            at = at[remote[of] | (doc > least[of])]
            change = np.zeros(len(chunk.words) + 1, np.int64)
            np.add.at(change, at, 1)
            np.add.at(change, at + window, -1)
            gone = np.cumsum(change[:-1]) > 0
            for t, (i, j) in enumerate(zip(chunk.first[:-1].tolist(), chunk.first[1:].tolist(), strict=True)):
                words = chunk.texts[t].split()
                cut = gone[i:j]
                removed = int(cut.sum())
                if removed:
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], cut.astype(np.int8), [0]]))).reshape(-1, 2)
                    repeats.append([{"start": int(a), "end": int(b)} for a, b in edge])
                    words = [w for w, c in zip(words, cut.tolist(), strict=True) if not c]
                else:
                    repeats.append([])
                text = b" ".join(words)
                n_words.append(j - i), n_removed.append(removed), shas.append(hashlib.sha256(text).hexdigest())
                kept.append(None if not with_text or not given[t] else text if removed else chunk.texts[t])
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.table({"row": table.column("row"), "doc_id": ids, "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
                         "kept_sha256": pa.array(shas, pa.string()), "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
                         "spans": pa.array(repeats, span)})
    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13,
                    with_text: bool = True, chunk_bytes: int = CHUNK_BYTES, chunks: int | None = None) -> DataFrame:
    """For every input row: ``row`` (its other columns, as a struct), doc_id, n_words, n_removed, kept_sha256,
    kept_text (unchanged where nothing goes, null where null) and the removed ``spans`` (words from 0)."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0]
    parts = tasks_for(spark, total, 2 * chunk_bytes)
    chunks = chunks or 2 * parts
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    whole = docs.select(F.struct(*others or [F.lit(0).alias("none")]).alias("row"),
                        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # by id, text and input task: neither a hot id nor repeated rows make one chunk large.  A document
    # may so stand in several chunks; they send the same smallest doc_id for it and remove nothing of it
    place = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(chunks)).cast("int")
    base = whole.withColumn("chunk", place).repartition(parts, "chunk")  # one exchange, read by all three steps
    asked = base.groupBy("chunk").applyInArrow(_send_blocks(window, chunks), MESSAGE)
    answers = asked.groupBy("bucket").applyInArrow(_match_blocks, MESSAGE)
    sent = base.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_send_windows(window, chunks), MESSAGE)
    verdicts = sent.groupBy("bucket").applyInArrow(_match_windows, MESSAGE)
    out = T.StructType([base.schema["row"], T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                        T.StructField("kept_sha256", T.StringType()), T.StructField("kept_text", T.StringType()),
                        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])
    return base.groupBy("chunk").cogroup(verdicts.groupBy("chunk")).applyInArrow(_remove(window, chunks, with_text), out)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_chars: str = "n_chars", **options) -> DataFrame:
    """The rows of ``docs`` with repeats cut from the text (null text stays null) and ``n_chars`` brought up to date."""
    found = substring_dedup(docs, id_col, text_col, **options)
    def column(c: str):
        if c == text_col:
            return F.col("kept_text").alias(c)
        if c == id_col:
            return F.col("doc_id").cast(docs.schema[c].dataType).alias(c)
        if c == n_chars:
            return F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col(f"row.`{c}`")).cast(docs.schema[c].dataType).alias(c)
        return F.col(f"row.`{c}`").alias(c)
    return found.select(*[column(c) for c in docs.columns])
