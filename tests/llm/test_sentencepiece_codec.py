"""Viterbi pieces against a plain search over all splits, and exact round trips."""
import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from tollgate.llm import common, sentencepiece_codec
from tollgate.llm.sentencepiece_codec import BLANK, Codec, codec

PATH = public_tokenizers.path("piece_bpe_32k.model")


def plain(c, pieces, text):
    """Best (score, ids) by trying every piece at every place; of equal scores, the longer last piece."""
    s = (BLANK + text.replace(" ", BLANK)) if text else ""
    best = [(0.0, [])]
    for e in range(1, len(s) + 1):
        here = None
        for b in range(max(0, e - 40), e):
            p = pieces.get(s[b:e])
            if p is not None and (here is None or best[b][0] + c.score[p] > here[0]):
                here = (best[b][0] + c.score[p], best[b][1] + [p])
        if s[e - 1] not in pieces:
            lone = best[e - 1][0] + c.unknown
            if here is None or lone > here[0]:
                here = (lone, best[e - 1][1] + [c.bytes[x] for x in s[e - 1].encode()])
        best.append(here)
    return best[-1]


def own_pieces(c):
    import sentencepiece
    m = sentencepiece.SentencePieceProcessor(model_file=PATH)
    return {m.id_to_piece(i): i for i in range(m.vocab_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}


def test_public_vocabulary():
    c = codec(PATH)
    pieces = own_pieces(c)
    rng = random.Random(2)
    texts = ["", " ", "  two  blanks ", "tab\tnew\nline", "漢字 😀 é", "a" * 300, "▁x"]
    texts += ["".join(rng.choice("abcdetionshr  éü漢\n.,😀") for _ in range(rng.randint(1, 50))) for _ in range(300)]
    ids, first, scores = c.encode([t.encode() for t in texts])
    for k, t in enumerate(texts):
        want = plain(c, pieces, t)
        assert (ids[first[k]:first[k + 1]].tolist(), scores[k]) == (want[1], want[0])
        assert c.decode(ids[first[k]:first[k + 1]]) == t.replace(BLANK, " ")


def test_pieces_across_blanks_are_searched_whole():
    pieces = [("<unk>", 0.0, "unknown"), ("a", -1.0, "normal"), ("b", -1.0, "normal"), (BLANK, -1.0, "normal"), (f"a{BLANK}b", -1.5, "normal")]
    c = Codec(pieces)
    assert not c.splits
    ids, _, scores = c.encode([b"a b"])
    assert ids.tolist() == [3, 4] and scores[0] == -2.5


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=4))
def test_round_trip(texts):
    c = codec(PATH)
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    ids, first, _ = c.encode([t.encode() for t in texts])
    for t, a, b in zip(texts, first[:-1], first[1:]):
        assert c.decode(ids[a:b]) == t.replace(BLANK, " ")


def test_table(spark):
    common.prepare(spark)
    rows = [(1, None), (2, ""), (None, "x y"), (4, "long " * 20_000), (4, "long " * 20_000), (5, "q" * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sentencepiece_codec.digest(df, PATH).collect()
    assert len(got) == len(rows) and all(r.round_trip for r in got)
    assert {r.doc_id: r.n_ids for r in got}[1] == 0
    extra = sentencepiece_codec.encode(df.selectExpr("*", "7 AS ids", "8 AS other"), PATH)
    assert extra.columns == ["doc_id", "text", "other", "ids", "ids_score"]
    assert sentencepiece_codec.decode(extra, PATH).filter("decoded <> coalesce(text, '')").count() == 0
    assert sentencepiece_codec.digest(df.limit(0), PATH).count() == 0
    nulls = spark.createDataFrame([(None,)], "ids binary")
    assert sentencepiece_codec.decode(nulls, PATH).first().decoded == ""
    assert np.frombuffer(extra.filter("text = 'x y'").first().ids, "<u4").size > 0


def test_the_query_returns_the_ids(spark):
    common.prepare(spark)
    texts = {1: None, 2: "", 3: "Two words, 漢字 😀", 4: "long " * 3000}
    got = {r.doc_id: r for r in sentencepiece_codec.digest(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), PATH).collect()}
    c = codec(PATH)
    for d, t in texts.items():
        ids = c.encode([(t or "").encode()])[0]
        assert got[d].ids == ids.tolist() and got[d].n_ids == len(ids)
        assert got[d].ids_crc32 == zlib.crc32(ids.astype("<u4").tobytes()) and c.decode(np.array(got[d].ids)) == (t or "")


def test_segments_of_equal_polynomials_round_trip():
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    texts = ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)]
    c = codec(PATH)
    ids, first, _ = c.encode([t.encode() for t in texts])
    assert [c.decode(ids[a:b]) for a, b in zip(first[:-1], first[1:])] == texts


def test_long_segments_one_by_one_equal_side_by_side():
    c = codec(PATH)
    rng = random.Random(3)
    letters = "abcdefgehilnorstu" * 3 + "éñ日\U0001f600\x01XQ"
    segments = sorted((BLANK + "".join(rng.choice(letters) for _ in range(rng.choice([300, 900, 1500]))) for _ in range(12)), key=len)
    a = c._together(segments, np.array([len(s) for s in segments]))
    b = c._in_turn(segments)
    assert all((x == y).all() for x, y in zip(a[:2], b[:2])) and np.allclose(a[2], b[2])


def test_a_long_text_without_blanks_is_linear():
    import time
    c = codec(PATH)
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefghinorst") for _ in range(300_000))
    begin = time.process_time()
    ids, first, _ = c.encode([text.encode()])
    assert time.process_time() - begin < 20 and c.decode(ids) == text
