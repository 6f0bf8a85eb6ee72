"""Licence scan with a positional rare-token index, DataFrame functions only.

1. One pass over the texts finds each file's words, the base phrases' places, which key
   phrases it holds and where licence words (words of the notices below, but for function
   words) stand; that light table is written.
2. Document frequencies of the licence words, over all files, give their IDF.
3. Of each file's words, the places of those among a notice's highest-IDF words are looked up in
   its postings: so many words of each notice that its others alone cannot reach ``least``, so
   that no match is lost however many other licence words the file holds (a number of words
   per file would lose some).  A notice and a relative position are a candidate; its
   score is the IDF share of the notice's licence words that stand at that position.
4. A candidate counts if its score reaches ``least``, two of its licence words stand (one,
   where the file has one) and the file holds the notice's mandatory phrases.

Defined cases: null text counts as empty (no words, no labels, score 0); repeated rows,
null doc_ids and further columns do not matter, every row is scanned on its own; a word
is frequent in one file without harm, its places are grouped by file and position.  An
empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# fixed values: the base phrases with their labels
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# fixed values: notices (label, words, mandatory phrases), as their licences word them
NOTICES = [
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by "
                "the free software foundation either version 3 of the license or at your option any later version", ["gnu general public license", "version 3"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license", "version 2"]),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
     ["gnu lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ["gnu affero general public license"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license", "version 2 0"]),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain "
                   "a copy of the license at http www apache org licenses license 2 0", ["apache license", "version 2 0"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to "
            "deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or "
            "sell copies of the software", ["permission is hereby granted free of charge"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
     ["redistribution and use in source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     ["permission to use copy modify and or distribute this software"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
                     "software without specific prior written permission", ["endorse or promote products derived from this software"]),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely "
             "subject to the following restrictions", ["alter it and redistribute it freely"]),
    ("bsl-1.0", "distributed under the boost software license version 1 0", ["boost software license"]),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ["eclipse public license"]),
    ("cddl-1.0", "the contents of this file are subject to the terms of the common development and distribution license", ["common development and distribution license"]),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
     ["waived all copyright and related or neighboring rights"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
]
FUNCTION_WORDS = set("a and any are as at be by can either for in is it may met not of on or that the this to use with without you your".split())


def licence_words() -> list[str]:
    return sorted({w for _, words, _ in NOTICES for w in words.split()} - FUNCTION_WORDS)


def rarest(notice: list[str], idf: dict[str, float], least: float) -> set[str]:
    """A notice's highest-IDF words, so many that the others' share of its IDF is below ``least``."""
    total = left = sum(idf[w] for w in notice)
    chosen: set[str] = set()
    for w in sorted(set(notice), key=lambda w: (-idf[w], w)):
        if left < least * total * (1 - 1e-9):
            break
        chosen.add(w)
        left -= idf[w] * notice.count(w)
    return chosen


def _framed(phrase: str) -> str:
    """A phrase as it stands in a framed text: every word between blanks of its own."""
    return "".join(f" {w} " for w in phrase.split())


def _count(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def _words_in(framed: Column) -> Column:
    return F.when(framed == "", F.lit(0)).otherwise(_count(framed, "  ") + 1).cast("long")


def scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per file: what one pass over its whole text tells."""
    lowered = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.filter(F.split(lowered, SEPARATORS, -1), lambda w: w != "").alias("words"))
    rows = rows.select("doc_id", "words", F.size("words").cast("long").alias("n_words"),
                       F.when(F.size("words") > 0, F.concat(F.lit(" "), F.array_join("words", "  "), F.lit(" "))).otherwise(F.lit("")).alias("framed"),
                       F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i).isin(licence_words())).alias("at"))
    text, n = F.col("framed"), F.col("n_words")
    counts = [_count(text, _framed(p)) for p, _ in BASE]
    first = [F.when(text.contains(_framed(p)), _words_in(F.substring_index(text, _framed(p), 1))) for p, _ in BASE]
    last = [F.when(text.contains(_framed(p)), n - _words_in(F.substring_index(text, _framed(p), -1)) - len(p.split())) for p, _ in BASE]
    keys = sorted({k for _, _, phrases in NOTICES for k in phrases})
    return rows.select(
        F.monotonically_increasing_id().alias("row_id"), "doc_id", "n_words", sum(counts[1:], counts[0]).alias("n_base"),
        F.least(*first).alias("first_word"), F.greatest(*last).alias("last_word"),
        F.array_compact(F.array(*[F.when(text.contains(_framed(p)), F.lit(label)) for p, label in BASE])).alias("base"),
        F.transform("at", lambda i: F.struct(F.get("words", i).alias("word"), i.alias("pos"))).alias("places"),
        F.when(F.size("at") > 0, F.array_compact(F.array(*[F.when(text.contains(_framed(k)), F.lit(k)) for k in keys])))
         .otherwise(F.array().cast("array<string>")).alias("phrases"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row."""
    spark = docs.sparkSession
    files = written(scanned(docs, id_col, text_col), "licence-files")
    n = files.count()
    heard = files.filter("size(places) > 0")
    # a number per licence word; the word list is fixed, so this is bounded
    df = dict(heard.select(F.explode(F.array_distinct(F.transform("places", lambda p: p["word"]))).alias("word")).groupBy("word").count().collect())
    idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1e-6 for w in licence_words()}
    notices = [[w for w in enumerate(words.split()) if w[1] in idf] for _, words, _ in NOTICES]
    postings = F.broadcast(spark.createDataFrame(
        [(t, w, i, idf[w], sum(idf[x] for _, x in notices[t])) for t in range(len(NOTICES)) for i, w in notices[t]],
        "notice int, word string, place int, idf double, total double"))
    rules = F.broadcast(spark.createDataFrame([(t, label) for t, (label, _, _) in enumerate(NOTICES)], "notice int, label string"))
    rare = F.broadcast(spark.createDataFrame(
        [(t, w, i) for t, words in enumerate(notices) for chosen in [rarest([w for _, w in words], idf, least)] for i, w in words if w in chosen],
        "notice int, word string, place int"))
    several = heard.select("row_id", "places", F.size(F.array_distinct(F.transform("places", lambda p: p["word"]))).alias("n_heard"))
    candidates = several.select("row_id", "n_heard", F.explode("places").alias("p")) \
        .select("row_id", "n_heard", "p.word", "p.pos").join(rare, "word") \
        .groupBy("row_id", "notice", (F.col("pos") - F.col("place")).alias("offset")).agg(F.max("n_heard").alias("n_heard"))
    expected = candidates.join(postings, "notice").select("row_id", "notice", "offset", "n_heard", "word", (F.col("offset") + F.col("place")).alias("pos"), "idf", "total")
    standing = several.select("row_id", F.explode("places").alias("p")).select("row_id", "p.word", "p.pos")
    scored = expected.join(standing, ["row_id", "word", "pos"]).groupBy("row_id", "notice", "offset") \
        .agg((F.sum("idf") / F.max("total")).alias("share"), F.count("*").alias("agree"), F.max("n_heard").alias("n_heard")) \
        .filter((F.col("share") >= least) & F.expr("agree >= least(2, n_heard)"))
    needed = F.array(*[F.array(*map(F.lit, phrases)) for _, _, phrases in NOTICES])
    held = heard.select("row_id", "phrases").filter("size(phrases) > 0")
    verified = scored.join(held, "row_id").filter(F.size(F.array_except(needed[F.col("notice")], "phrases")) == 0).join(rules, "notice").groupBy("row_id").agg(F.collect_set("label").alias("found"), F.max("share").alias("share"))
    comma = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return files.join(verified, "row_id", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", comma(F.col("base")).alias("base_labels"),
        comma(F.concat("base", F.coalesce("found", F.array().cast("array<string>")))).alias("labels"),
        F.least(F.coalesce(F.round("share", 9), F.lit(0.0)), F.lit(1.0)).alias("score"))
