"""Packing against the tokenizer itself."""
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tollgate.llm import common, packing
from tollgate.llm.tokens import WordIds, word_ids

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def direct(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]


def test_pieces_and_padding(spark):
    common.prepare(spark)
    rows = [(1, None), (2, ""), (3, "Hello WORLD, it's 42!"), (None, "no id"), (4, "word " * 9000), (5, "x" * 30_000)]
    rows += [(10 + i, f"copy text {i % 3}") for i in range(300)] + [(3, "Hello WORLD, it's 42!")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS curve", "3 AS n")
    found = packing.pack(df, PATH, length=256).collect()
    wanted = defaultdict(list)
    for d, t in rows:
        wanted[d].append(direct(t))
    pieces = defaultdict(list)
    sequences = defaultdict(list)
    for r in found:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length
        pieces[r.doc_id].append((r.start, ids, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    for d, want in wanted.items():
        assert sum(len(i) for _, i, _ in pieces[d]) == sum(map(len, want))
        if len(want) == 1:
            assert sum((i for _, i, _ in sorted(pieces[d])), []) == want[0] and {n for *_, n in pieces[d]} == {len(want[0])}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 256 or at & (at - 1) == 0  # nothing to pad
    assert packing.pack(df.limit(0), PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=5))
def test_words_cache_is_exact(texts):
    ids, first = word_ids(PATH).encode([t.encode("utf-8", "replace") for t in texts], 1)
    for t, a, b in zip(texts, first[:-1], first[1:]):
        assert ids[a:b].tolist() == direct(t.encode("utf-8", "replace").decode())


def test_special_words():
    texts = ["<|endoftext|> a<|startoftext|>b \x01 c\x01d   e f 's can't É ﬁ é İ", "\x01", "  "]
    ids, first = WordIds(PATH).encode([t.encode() for t in texts], 1)
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == [direct(t) for t in texts]


def test_hilbert_neighbours():
    for dims, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = packing.hilbert_keys(grid, bits)
        assert sorted(keys.tolist()) == list(range(len(grid)))
        steps = np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1)
        assert (steps == 1).all()  # consecutive keys are adjacent cells


def test_crc_of_ids(spark):
    common.prepare(spark)
    df = spark.createDataFrame([(1, "some text here")], "doc_id long, text string")
    got = packing.pack(df, PATH).selectExpr("crc32(ids) AS c").first().c
    assert got == zlib.crc32(np.array(direct("some text here"), "<u4").tobytes())


def test_words_of_equal_polynomials_get_their_own_ids():
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    texts = ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)]
    ids, first = word_ids(PATH).encode([t.encode() for t in texts], 1)
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == [direct(t) for t in texts]
