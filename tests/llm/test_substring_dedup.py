"""Substring deduplication against a dictionary of all windows."""
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from tollgate.llm import common, substring_dedup
from tollgate.llm.words import WordTable, spans, word_hashes


def brute(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (d, _), w in zip(rows, words):
        for k in range(len(w) - window + 1):
            key = tuple(w[k:k + window])
            rank = (d is not None, d)
            least[key] = min(least.get(key, rank), rank, key=lambda r: (r[0], r[1] or 0))
    out = []
    for (d, _), w in zip(rows, words):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            low = least[tuple(w[k:k + window])]
            if (low[0], low[1] or 0) < (d is not None, d or 0):
                gone[k:k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def sample(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "c", "Word", "word", "é", "x."]
    passage = [rng.choice(vocabulary) + str(rng.randint(0, 9)) for _ in range(60)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            a = rng.randint(0, 40)
            parts += passage[a:a + rng.randint(3, 30)] if rng.random() < 0.6 else [rng.choice(vocabulary) + str(rng.randint(0, 99)) for _ in range(rng.randint(0, 12))]
        rows.append((i * 13 % 61, rng.choice([" ", "  ", "\n", "\t"]).join(parts)))
    return rows + [(70, None), (71, ""), (72, " \n "), (3, rows[3][1]), (None, rows[5][1]), (80, rows[5][1]), (81, rows[5][1]), (82, "same " * 200), (83, "same " * 50)]


@pytest.mark.parametrize("window,chunks", [(5, 4), (13, 7), (6, 1)])
def test_against_brute_force(spark, window, chunks):
    common.prepare(spark)
    rows = sample(window)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' AS spans", "9 AS chunk_", "1 AS n_words")
    found = substring_dedup.substring_dedup(df, window=window, chunks=chunks).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found), key=str) == brute(rows, window)
    for r in found:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
        if r.n_removed:
            assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256


def test_stage_keeps_columns(spark):
    common.prepare(spark)
    long = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, long, "en", "s", 5), (2, "intro  " + long, "en", None, None), (3, None, None, "s", 0)],
                               "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in substring_dedup.without_repeats(df).collect()}
    assert substring_dedup.without_repeats(df).schema.names == df.schema.names
    assert (out[1].text, out[1].n_chars) == (long, 5)
    assert (out[2].text, out[2].n_chars) == ("intro", 5)
    assert (out[3].text, out[3].n_chars) == (None, 0)
    assert substring_dedup.without_repeats(df.limit(0)).collect() == []


def test_packing_of_hashes():
    rng = np.random.default_rng(1)
    for values in (np.empty(0, np.uint64), rng.integers(0, 1 << 63, 999, dtype=np.uint64), np.arange(5, dtype=np.uint64)):
        assert (substring_dedup.unpack(substring_dedup.pack(values))[0] == values).all()
    values = np.unique(rng.integers(0, 1 << 63, 999, dtype=np.uint64))
    assert (substring_dedup.unpack_sorted(substring_dedup.pack_sorted(values))[0] == values).all()


def test_words_and_hashes():
    texts = [b"", b" a\tbb  c\n", "é a".encode(), b"a" * 5000 + b" x"]
    buf, starts, ends, first = spans(texts)
    raw = buf.tobytes()
    assert [[raw[s:e] for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(first[:-1], first[1:])] == [t.split() for t in texts]
    h = word_hashes(buf, starts, ends)
    words = [raw[s:e] for s, e in zip(starts, ends)]
    assert len(set(h.tolist())) == len(set(words)) and h[words.index(b"a")] == h[len(words) - 3]


def steps(rows, window, buckets, shuffle):
    """The operator's functions by hand, each chunk's rows permuted before each of the three reads."""
    table = pa.table({"row": pa.array([{"n": 0}] * len(rows)), "doc_id": pa.array([d for d, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())})
    chunks = [[i for i in range(len(rows)) if i % 4 == c] for c in range(4)]

    def read(c):
        order = chunks[c][:]
        shuffle(order)
        return table.take(pa.array(order, pa.int64()))

    def by(name, tables):
        every = pa.concat_tables(tables)
        return {v: every.filter(pc.equal(every.column(name), v)) for v in set(every.column(name).to_pylist())}

    key = lambda c: (pa.scalar(c, pa.int32()),)
    none = substring_dedup._message(0, [])
    answers = by("chunk", [substring_dedup._match_blocks(t) for t in by("bucket", [substring_dedup._send_blocks(window, buckets)(key(c), read(c)) for c in range(4)]).values()])
    sent = by("bucket", [substring_dedup._send_windows(window, buckets)(key(c), read(c), answers.get(c, none)) for c in range(4)])
    verdicts = by("chunk", [substring_dedup._match_windows(t) for t in sent.values()])
    found = pa.concat_tables([substring_dedup._remove(window, buckets, True)(key(c), read(c), verdicts.get(c, none)) for c in range(4)])
    return [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found.to_pylist()]


@pytest.mark.parametrize("seed", range(6))
def test_rows_in_any_order(seed):
    rows = sample(seed) + [(5, "x y " * 30), (5, "x z " * 30)]
    assert sorted(steps(rows, 6, 5, random.Random(seed).shuffle), key=str) == brute(rows, 6)


def test_wrong_counts_raise():
    replies = pa.table({"bucket": pa.array([0], pa.int32()), "own": [False], "blob": pa.array([b"\x01\x02\x03"], pa.binary())})
    with pytest.raises(ValueError):
        substring_dedup._bits(replies, np.array([9]))


def test_hot_id_and_repeated_rows(spark):
    common.prepare(spark)
    rng = random.Random(7)
    hot = [(7, " ".join(rng.choice("abcdef") + str(rng.randint(0, 30)) for _ in range(60))) for _ in range(60)]
    rows = hot + [hot[0]] * 20 + [(i, hot[i % 60][1][:90] + " tail " + "long " * (3000 if i == 9 else 1)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = substring_dedup.substring_dedup(df, window=5, chunks=6).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found), key=str) == brute(rows, 5)


def thue_morse():
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_of_equal_polynomials_differ():
    one, other = thue_morse()
    rows = [(i, " ".join([w, *"cdefgh"])) for i, w in enumerate((one, other))]
    assert [r[2] for r in sorted(steps(rows, 7, 3, random.shuffle))] == [0, 0]


def test_word_table_is_exact():
    table = WordTable(100)
    words = [b"a", b"bb", b"ccccccccc", b"a" * 70, b"b" * 600, b"a" * 600, b"a", b"ccccccccd", b"bb"]
    buf, starts, ends, _ = spans([b" ".join(words)])
    for _ in range(2):  # one hash for all: only the bytes tell words apart
        number, new = table.number(buf, starts, ends, np.zeros(len(words), np.uint64))
        assert len({(n, w) for n, w in zip(number.tolist(), words)}) == len(set(words)) == len(set(number.tolist()))
    assert len(new) == 0 and len(table) == len(set(words))
    small = WordTable(4)
    for _ in range(3):  # more words than it may hold: it starts anew, and stays exact
        number, new = small.number(buf, starts, ends)
        assert len({(n, w) for n, w in zip(number.tolist(), words)}) == len(set(words))
    assert small.cleared == 2 and len(new) == len(set(words))
