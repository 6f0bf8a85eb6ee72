"""Licence scan: base phrases against a plain search, notices by hand."""
import random
import re

from tollgate.llm import common, licenses

GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
ROWS = [
    (1, None), (2, ""), (3, "Released under the MIT License."), (4, "MIT-license mit LICENSE Mit license"), (5, "Licensed under CC BY-NC 4.0."),
    (6, GPL), (7, "Licensed under the Apache License, Version 2.0."), (8, "apache licenses are not one"), (9, "The license of the version is by the software."),
    (10, "émit license mité license"), (None, "Apache  \n License"), (11, "word " * 20_000 + "Licensed under the Apache License, Version 2.0. " + "software license " * 2000),
    (11, "word"), (12, "cc by cc by gnu general public license"), (13, "mitK license")]


def base(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    at, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        for k in range(len(w) - len(p) + 1):
            if w[k:k + len(p)] == p:
                at.append(k)
                labels.add(label)
    return len(w), len(at), min(at) if at else None, max(at) if at else None, ",".join(sorted(labels))


def test_scan(spark):
    common.prepare(spark)
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 AS row_id", "'x' AS labels", "2 AS notice")
    got = licenses.scan(df).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str) == \
        sorted(((d, *base(t)) for d, t in ROWS), key=str)
    labels = {(r.doc_id, r.n_words): (r.labels, r.score) for r in got}
    by_id = {d: v for (d, _), v in labels.items() if d != 11}
    assert by_id[3] == ("mit", 1.0) and by_id[5] == ("cc-by,cc-by-nc", 1.0) and by_id[7] == ("apache,apache-2.0", 1.0)
    assert by_id[6][0] == "gpl,gpl-3.0" and by_id[6][1] > 0.9
    assert by_id[1] == by_id[2] == by_id[8] == by_id[9] == ("", 0.0)
    assert labels[max(k for k in labels if k[0] == 11)][0] == "apache,apache-2.0"
    assert all(0 <= r.score <= 1 for r in got)
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert licenses.scan(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    common.prepare(spark)
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    plan = licenses.scan(df)._jdf.queryExecution().toString() + licenses.scanned(df, "doc_id", "text")._jdf.queryExecution().toString()
    assert not re.search(r"Python|Pandas|MapInArrow", plan)


def test_every_notice_of_a_file_is_found(spark):
    """Other notices and rarer licence words in a file take nothing from a notice that stands whole in it."""
    common.prepare(spark)
    notices = {label: words for label, words, _ in licenses.NOTICES}  # the last of each label
    third_party = " -- ".join([GPL, notices["mit"], notices["bsd"], "Released under the MIT License.", notices["mpl-2.0"]])
    prose = "Publish, merge and sublicense binary conditions; a person may distribute copies without warranty, limitation, restriction or charge. "
    rows = [(1, third_party), (2, prose * 3 + "word " * 500 + "Released under the MIT License."), (3, "Released under the MIT License.")]
    rows += [(k, "The software is under a free license, released by the public foundation.") for k in range(10, 40)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == "bsd,gpl,gpl-3.0,mit,mpl-2.0" and got[1].score == 1.0
    assert (got[2].labels, got[2].score) == (got[3].labels, got[3].score) == ("mit", 1.0)
    assert all(got[k].labels == "" for k in range(10, 40))


def test_looked_up_words_lose_no_match():
    """Whatever the IDFs: words that reach the least share hold a word that is looked up."""
    rng = random.Random(4)
    for _, words, _ in licenses.NOTICES:
        notice = [w for w in words.split() if w not in licenses.FUNCTION_WORDS]
        for least in (0.3, 0.5, 0.8):
            idf = {w: rng.choice([1e-6, 0.1, 1.0, 5.0]) for w in notice}
            others = sum(idf[w] for w in notice if w not in licenses.rarest(notice, idf, least))
            assert others < least * sum(idf[w] for w in notice)


def plain_notices(texts, least=0.5):
    """Every notice at every place of every text."""
    import math
    split = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for t in texts]
    words = set(licenses.licence_words())
    idf = {w: math.log((len(texts) + 1) / (sum(w in set(s) for s in split) + 1)) + 1e-6 for w in words}
    out = []
    for s in split:
        heard, joined, labels, best = len(words & set(s)), " " + " ".join(s) + " ", set(), 0.0
        for label, notice, needed in licenses.NOTICES:
            places = [(i, w) for i, w in enumerate(notice.split()) if w in words]
            total = sum(idf[w] for _, w in places)
            if any(f" {p} " not in joined for p in needed):
                continue
            for offset in range(-len(notice.split()), len(s)):
                here = [w for i, w in places if 0 <= offset + i < len(s) and s[offset + i] == w]
                share = sum(idf[w] for w in here) / total
                if here and share >= least and len(here) >= min(2, heard):
                    labels.add(label)
                    best = max(best, share)
        out.append((labels, min(round(best, 9), 1.0)))
    return out


def test_notices_against_every_place(spark):
    common.prepare(spark)
    rng = random.Random(9)
    notices = [words.split() for _, words, _ in licenses.NOTICES]
    texts = []
    for k in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            n = list(rng.choice(notices))
            for _ in range(rng.randint(0, len(n) // 3)):
                n[rng.randrange(len(n))] = rng.choice(["other", "software", "license"])
            parts += n[rng.randint(0, len(n) // 4):] + ["plain"] * rng.randint(0, 3)
        texts.append(" ".join(w.upper() if rng.random() < 0.1 else w for w in parts))
    want = plain_notices(texts)
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, (labels, score) in enumerate(want):
        mine = set(filter(None, got[k].labels.split(",")))
        assert mine == labels | set(filter(None, got[k].base_labels.split(","))) and abs(got[k].score - score) < 1e-6
    assert len(set().union(*(labels for labels, _ in want))) >= 10
