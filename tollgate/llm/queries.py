"""The operators as registered queries, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, common, exact_dedup, html_extract, lexical, licenses, merkle, mixing, packing, quality, sentencepiece_codec, simhash, substring_dedup, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            common.prepare(spark)
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return fn
    return deco


AZ_LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op9_exact_dedup", f"""
WITH d AS (SELECT doc_id, {AZ_LOWER_SQL} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal documents, whole texts, every row."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = exact_dedup.grace_dedup(docs)
    return found.select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op7_simhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3-word SimHash fingerprints of every document, linked at 2 or fewer differing bits."""
    found = simhash.near_duplicates(common.table(spark, sf_dir, "documents"), width=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


_LEADS = " || ' ' || ".join(f"lead(word, {k}) over o" for k in range(1, 13))


@query("op3_substring_dedup", rf"""
WITH t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents)),
g AS (SELECT *, word || ' ' || {_LEADS} AS gram FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
m AS (SELECT gram, min(doc_id) AS low FROM g WHERE gram IS NOT NULL GROUP BY gram),
f AS (SELECT g.doc_id, i, word, coalesce(low < g.doc_id, false) AS hit FROM g LEFT JOIN m USING (gram)),
c AS (SELECT *, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM f),
a AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
  string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN a USING (doc_id)""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words under 13-word windows that also start in a smaller document, over whole texts."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.substring_dedup(docs, window=13, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op6_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of 2048-id sequences, along a Hilbert curve."""
    docs = common.table(spark, sf_dir, "documents")
    found = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end=1, length=2048)
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op5_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Co-trained quality score of every document; a quarter of the labels is held out."""
    found = quality.quality(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return found.select("doc_id", quality.held_out().alias("held_out"), "score", "keep")


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text, by a field trained on labels outside the held-out quarter."""
    found = toxicity.toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"), threshold=0.3)
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"))


@query("op8_html_extract")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(common.table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars", "n_blocks", "n_content")


@query("op10_ann")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest rows of every hundredth vector, over learned partitions of all rows."""
    return ann.search(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query("op4_licenses")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in every whole text."""
    return licenses.scan(common.table(spark, sf_dir, "documents"))


@query("op2_sentencepiece")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces by Viterbi search, and whether they decode to it."""
    return sentencepiece_codec.digest(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op11_mixing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150 % of all words, sources weighing 5, 2, 1 in turn, none above twice its size."""
    found = mixing.mix(common.table(spark, sf_dir, "documents"), weights=(5, 2, 1), percent=150, most=2)
    return found.select("doc_id", "size", "source_size", "target", "taken")


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query("op12_lexical", f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
q AS (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS t FROM benchmark),
c AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS n_docs, sum(len(t))::BIGINT AS n_all FROM d),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, c GROUP BY term, n_docs),
m AS (SELECT r, doc_id, 25 + (75 * len(t)::BIGINT * n_docs) // n_all AS m FROM d, c WHERE len(t) > 0),
a AS (SELECT q, item_id, term, count(*) AS k FROM (SELECT q, item_id, unnest(t) AS term FROM q) GROUP BY ALL),
s AS (SELECT q, item_id, r, doc_id, sum(k * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM a JOIN w USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY rank <= 10""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents of every benchmark item."""
    return lexical.search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"), k=10)


def _merkle_sql(leaf_levels: int, source_levels: int) -> str:
    """The trees level by level (16 ** leaf_levels rows of a source, 16 ** source_levels sources)."""
    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"
                                       for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    crc = ("xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), "
           "lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))))")
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [f"""b AS (SELECT doc_id, source, {leaf('text')} AS leaf,
  CASE WHEN {crc} % 5 = 0 THEN {leaf(lower)} END AS tampered FROM documents)""",
             "d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM b)",
             "l0 AS (SELECT source AS g, i, leaf AS h, count(*) OVER (PARTITION BY source) AS m FROM d)"]
    def climb(name: str, levels: int) -> None:
        for k in range(levels):
            parts.append(f"""{name}{k + 1} AS (SELECT g, i // 16 AS i, CASE WHEN any_value(m) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h,
  (any_value(m) + 15) // 16 AS m FROM {name}{k} GROUP BY g, i // 16)""")
            side = "coalesce(string_agg(h, '') OVER (PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN {}), '')"
            parts.append(f"""{name}p{k} AS (SELECT g, i, m, {side.format('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS a,
  {side.format('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS z FROM {name}{k})""")
    climb("l", leaf_levels)
    parts.append("s0 AS (SELECT 0 AS g, g AS source, row_number() OVER (ORDER BY g IS NOT NULL, encode(g)) - 1 AS i, h, count(*) OVER () AS m"
                 f" FROM l{leaf_levels})")
    climb("s", source_levels)
    f, proof = "coalesce(tampered, leaf)", "''"
    last = "d"
    for name, levels in (("l", leaf_levels), ("s", source_levels)):
        if name == "s":
            parts.append(f"e AS (SELECT t.* EXCLUDE (i), s0.i AS i, s0.h AS subroot FROM {last} t JOIN s0 ON s0.source IS NOT DISTINCT FROM t.source)")
            last = "e"
        for k in range(levels):
            on = ("p.g IS NOT DISTINCT FROM t.source AND " if name == "l" else "") + f"p.i = t.i // {16 ** k}"
            parts.append(f"""{name}f{k} AS (SELECT t.* EXCLUDE (i{', f, proof' if f == 'f' else ''}), t.i, CASE WHEN p.m = 1 THEN {f} ELSE sha256(p.a || {f} || p.z) END AS f,
  {proof} || CASE WHEN p.m = 1 THEN '' ELSE p.a || p.z END AS proof FROM {last} t JOIN {name}p{k} p ON {on})""")
            last, f, proof = f"{name}f{k}", "f", "proof"
    return (f"WITH {', '.join(parts)} SELECT t.doc_id, t.leaf, t.subroot, r.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = r.h AS verified"
            f" FROM {last} t, s{source_levels} r")


@query("op13_merkle", _merkle_sql(4, 2))
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document; those whose id's crc32 is divisible by 5 are folded from a tampered text."""
    docs = common.table(spark, sf_dir, "documents")
    found = merkle.manifest(docs, tamper=F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
