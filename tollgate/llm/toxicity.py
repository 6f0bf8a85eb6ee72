"""Toxic spans by a linear-chain conditional random field.

Tags are "toxic" and "other".  A token's observations are its word, its prefixes and its
suffix (lower case, marks at the ends stripped).  Labelled tokens come from labelled
documents: an observation that is significantly more frequent in toxic documents (a
likelihood-ratio test on document counts) and many times likelier there is a cue; in a
toxic document the tokens with a cue are toxic, unless the word itself is as common
elsewhere; all others are not.  Copies among the labelled documents count once.  The field is fitted
by gradient steps on its conditional likelihood, with forward and backward sums.

Scoring runs forward-backward over every whole text.  The marginals give the offending
spans; their expected number and their maximum, through a logistic model fitted on
documents, give the document's score.

Bounds: the field and the score are fitted, in one task, on about ``toxic_docs`` and
``clean_docs`` labelled documents (lowest by a hash of the id; never more than twice as
many), weighted back to the labels' true shares.  Of these documents the field reads every
stretch of 48 tokens with a toxic token and one in sixteen of each label's others, which
count for all of them.  The score reads the text alone.

Defined cases: null and empty texts have no tokens and get the score of "no evidence";
a null doc_id has no label and is not held out; without labels of both kinds every score
is the share of label 1 (0 without labels); repeated rows get equal scores, and of rows that
share a sampled doc_id one trains; very long texts are read whole.  Words are told apart by 64-bit hashes
(tabulation and xxh3).  An empty table gives an empty result.  Further columns, whatever their names, are not read.
"""

from __future__ import annotations

import pickle
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, hashed_sample
from .logistic import Logistic, sigmoid
from .words import mix, spans, window_hashes, word_hashes

TOXIC_DOCS, CLEAN_DOCS = 1_500, 3_000
PREFIXES, SUFFIX = (3, 4, 5, 6, 7), 4
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "…“”‘’«»¿¡"
SEGMENT = 48  # tokens of a training segment
SPANS = "array<struct<start:int,end:int,p:double>>"


def observations(word: str) -> list[str]:
    """The features of one token; a token of marks alone has none."""
    w = word.lower().strip(MARKS)
    if not w:
        return []
    return ["w" + w, *(f"{k}{w[:k]}" for k in PREFIXES if len(w) >= k), "s" + w[-SUFFIX:]]


def _g2(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Likelihood-ratio statistic of each 2x2 table (documents with and without, by label)."""
    total = np.zeros(len(a))
    for have, n in ((a, n1), (b, n0)):
        for cell, row in ((have, a + b), (n - have, n1 + n0 - a - b)):
            expected = row * n / (n1 + n0)
            total += 2 * np.where(cell > 0, cell * np.log(np.maximum(cell, 1e-9) / np.maximum(expected, 1e-9)), 0)
    return total


class Tokens:
    """Texts as word numbers; each distinct word's observations are held once, as numbers too."""

    def __init__(self, texts: Iterable[list[str]]):
        words: dict[str, int] = {}
        self.names: dict[str, int] = {}
        flat, until, self.docs = array("i"), array("i", [0]), []
        for text in texts:
            doc = array("i")
            for w in text:
                n = words.get(w)
                if n is None:
                    n = words[w] = len(words)
                    for f in observations(w):
                        flat.append(self.names.setdefault(f, len(self.names)))
                    until.append(len(flat))
                doc.append(n)
            self.docs.append(np.array(doc, np.int32))
        self.flat, self.until = np.array(flat, np.int32), np.array(until, np.int64)

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``words``, observation) of every observation of the words."""
        size = np.diff(self.until)[words]
        place = np.repeat(np.arange(len(words)), size)
        start = np.repeat(self.until[words] - (np.cumsum(size) - size), size)
        return place, self.flat[start + np.arange(len(start))]


def cue_words(tokens: Tokens, toxic: np.ndarray, g2: float = 25.0, times: float = 4.0) -> np.ndarray:
    """Which words are cues: an observation of theirs marks toxic documents, and the word itself is not as common elsewhere."""
    n = len(tokens.names)
    seen = np.zeros((2, n))
    for doc, label in zip(tokens.docs, toxic.tolist(), strict=True):
        seen[label, np.unique(tokens.of(np.unique(doc))[1])] += 1
    n0, n1 = int((toxic == 0).sum()), int((toxic == 1).sum())
    rate0, rate1 = (seen[0] + 0.5) / (n0 + 1), (seen[1] + 0.5) / (n1 + 1)
    marks = (seen[1] >= 3) & (_g2(seen[1], seen[0], n1, n0) >= g2) & (rate1 >= times * rate0)
    some = np.diff(tokens.until) > 0
    out = np.zeros(len(some), bool)
    if some.any():
        first = tokens.until[:-1][some]
        out[some] = np.logical_or.reduceat(marks[tokens.flat], first) & (rate1 >= times / 2 * rate0)[tokens.flat[first]]
    return out


class Field:
    """Two tags: the log-odds weight of each observation, a bias, and the transitions' potentials."""

    def __init__(self, weights: dict[str, float], bias: float, move: np.ndarray):
        self.weights, self.bias, self.move = weights, bias, move  # move[i, j]: log potential from tag i to tag j

    def emission(self, word: str) -> float:
        w = self.weights
        return self.bias + sum(w.get(f, 0.0) for f in observations(word))


def marginals(score: np.ndarray, first: np.ndarray, move: np.ndarray) -> np.ndarray:
    """P(toxic) of each token; text t has tokens first[t]:first[t+1].

    Both sums run as the odds of the two tags, one step for all texts that still have a token.
    """
    m = np.exp(move)
    e = np.exp(np.clip(score, -30, 30))
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    starts, left = first[:-1][order], lengths[order]
    alive = np.searchsorted(-left, -np.arange(1, (left[0] if len(left) else 0) + 1), "right")  # texts longer than t tokens
    fore, back = np.empty(len(score)), np.empty(len(score))
    x = None
    for t, n in enumerate(alive.tolist()):
        at = starts[:n] + t
        x = e[at] if x is None else e[at] * (x[:n] * m[1, 1] + m[0, 1]) / (x[:n] * m[1, 0] + m[0, 0])
        fore[at] = x
    y = np.ones(len(left))
    for t in range(len(alive) - 1, -1, -1):
        n = alive[t]
        longer = alive[t + 1] if t + 1 < len(alive) else 0
        if longer:
            z = e[starts[:longer] + t + 1] * y[:longer]
            y[:longer] = (m[1, 0] + m[1, 1] * z) / (m[0, 0] + m[0, 1] * z)
        back[starts[:n] + t] = y[:n]
    odds = fore * back
    return odds / (1 + odds)


def _pairs(score: np.ndarray, length: int, move: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(marginals, expected transitions) of equal-length segments, which count ``weight`` times; score: segments x length."""
    m = np.exp(move)
    e = np.exp(np.clip(score, -30, 30))
    n = len(score)
    weight = np.ones(n) if weight is None else weight
    fore, back = np.empty((n, length, 2)), np.ones((n, length, 2))
    a = np.stack([np.ones(n), e[:, 0]], axis=1)
    fore[:, 0] = a / a.sum(axis=1, keepdims=True)
    for t in range(1, length):
        a = fore[:, t - 1] @ m
        a[:, 1] *= e[:, t]
        fore[:, t] = a / a.sum(axis=1, keepdims=True)
    for t in range(length - 2, -1, -1):
        b = back[:, t + 1].copy()
        b[:, 1] *= e[:, t + 1]
        b = b @ m.T
        back[:, t] = b / b.sum(axis=1, keepdims=True)
    p = fore * back
    p /= p.sum(axis=2, keepdims=True)
    moves = np.zeros((2, 2))
    for t in range(1, length):
        b = back[:, t].copy()
        b[:, 1] *= e[:, t]
        joint = fore[:, t - 1, :, None] * m[None] * b[:, None, :]
        moves += (joint / joint.sum(axis=(1, 2), keepdims=True) * weight[:, None, None]).sum(axis=0)
    return p[:, :, 1], moves


def training_segments(docs: list[np.ndarray], toxic: np.ndarray, cue: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """(tokens, tags, weights) in groups of equal-length segments: every segment with a toxic token, and of each label's
    others a sixteenth that counts for all.  No token is left out of the weights' sum."""
    rows, tags, weights = [], [], []
    for label in (0, 1):  # documents of one label follow each other in one stream, so that short ones count too
        stream = np.concatenate([np.empty(0, np.int32), *(d for d, k in zip(docs, toxic.tolist(), strict=True) if k == label)])
        whole = len(stream) // SEGMENT * SEGMENT
        for part in (stream[:whole].reshape(-1, SEGMENT), stream[None, whole:]):
            if not part.size:
                continue
            tag = cue[part] & bool(label)
            marked = tag.any(axis=1)
            others = np.flatnonzero(~marked)
            keep = np.concatenate([np.flatnonzero(marked), others[::16]])
            count = np.ones(len(keep))
            count[marked.sum():] = len(others) / max(len(others[::16]), 1)
            rows.append(part[keep]), tags.append(tag[keep].astype(float)), weights.append(count)
    return rows, tags, weights


def fit_field(texts: list[list[str]], toxic: np.ndarray, steps: int = 60, ridge: float = 0.02) -> Field | None:
    """Fit on labelled documents (lists of words); None without cues."""
    tokens = Tokens(texts)
    cue = cue_words(tokens, toxic)
    rows, y, weight = training_segments(tokens.docs, toxic, cue)
    if not any(t.any() for t in y):
        return None
    names = tokens.names
    at, feature = tokens.of(np.concatenate([r.ravel() for r in rows]))
    common = np.bincount(feature, minlength=len(names)) >= 3  # rare observations get no weight of their own
    flat = np.concatenate([t.ravel() for t in y])
    counts = np.concatenate([np.repeat(w, t.shape[1]) for t, w in zip(y, weight, strict=True)])
    until = np.cumsum([0, *(t.size for t in y)])
    mean = float((flat * counts).sum() / counts.sum())
    weights, bias, move = np.zeros(len(names)), float(np.log(max(mean, 1e-6) / (1 - min(mean, 0.5)))), np.zeros((2, 2))
    true_moves = np.zeros((2, 2))
    for t, w in zip(y, weight, strict=True):
        a, b = t[:, :-1], t[:, 1:]
        true_moves += [[(w @ ((1 - a) * (1 - b))).sum(), (w @ ((1 - a) * b)).sum()], [(w @ (a * (1 - b))).sum(), (w @ (a * b)).sum()]]
    sums = [np.zeros(len(names)), 0.0, np.zeros((2, 2))]
    for _ in range(steps):  # steps scaled by each parameter's own past gradients
        score = bias + np.bincount(at, weights[feature], minlength=flat.size)
        found = [_pairs(score[a:b].reshape(t.shape), t.shape[1], move, w) for a, b, t, w in zip(until[:-1], until[1:], y, weight, strict=True)]
        moves = sum(k for _, k in found)
        error = counts * (flat - np.concatenate([p.ravel() for p, _ in found]))
        grads = [np.where(common, np.bincount(feature, error[at], minlength=len(names)), 0) - ridge * weights, error.sum() - ridge * bias, true_moves - moves - ridge * move]
        for k, g in enumerate(grads):
            sums[k] = sums[k] + g * g
        weights += 0.5 * grads[0] / np.sqrt(sums[0] + 1e-9)
        bias += 0.2 * grads[1] / np.sqrt(sums[1] + 1e-9)
        move = move + 0.2 * grads[2] / np.sqrt(sums[2] + 1e-9)
    strong = np.abs(weights) > 0.05
    return Field({f: float(weights[k]) for f, k in names.items() if strong[k]}, float(bias), move)


class Emissions:
    """Scores of tokens, by word hash; each distinct word of a batch is scored once."""

    def __init__(self, field: Field):
        self.field = field

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        buf, starts, ends, first = spans(texts)
        _, index, inverse = np.unique(word_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        raw = buf.tobytes()
        scores = np.array([self.field.emission(raw[starts[i] : ends[i]].decode()) for i in index.tolist()], float)
        return scores[inverse] if len(index) else np.empty(0), first, starts, ends


def evidence(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each text, from its marginals: log of 1 + expected toxic tokens, the root of their share, the largest
    marginal, and the (bounded) log-odds against no toxic token at all."""
    out = np.zeros((len(first) - 1, 4))
    have = np.flatnonzero(np.diff(first))
    if len(have):
        at = first[:-1][have]
        total = np.add.reduceat(p, at)
        out[have, 0] = np.log1p(total)
        out[have, 1] = np.sqrt(total / np.diff(first)[have])
        out[have, 2] = np.maximum.reduceat(p, at)
        out[have, 3] = np.log1p(np.add.reduceat(np.minimum(-np.log1p(-np.minimum(p, 1 - 1e-9)), 8.0), at))
    return out


class Model:
    def __init__(self, share: float, field: Field | None = None, document: Logistic | None = None):
        self.share, self.field, self.document = share, field, document

    def marginals(self, texts: list[bytes]):
        score, first, starts, ends = Emissions(self.field).of(texts)
        return marginals(score, first, self.field.move), first, starts, ends


def distinct(texts: list[bytes]) -> np.ndarray:
    """Indices of the texts that share none of four minimum hashes of 5-word shingles with an earlier one kept.

    Copies of one toxic document, exact or near, would make its every word look like a cue."""
    seen: set[tuple[int, int]] = set()
    kept = []
    for t, text in enumerate(texts):
        buf, starts, ends, _ = spans([text])
        words = word_hashes(buf, starts, ends)
        grams = window_hashes(words, min(5, len(words))) if len(words) else words
        keys = [(k, int(mix(grams ^ np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)).min())) for k in range(4)] if len(grams) else [(-1, 0)]
        if seen.isdisjoint(keys):
            kept.append(t)
            seen.update(keys)
    return np.array(kept, int)


def fit(texts: list[bytes], toxic: np.ndarray, weight: np.ndarray, share: float) -> Model:
    some = distinct(texts)
    texts, toxic, weight = [texts[i] for i in some], toxic[some], weight[some]
    if not 0 < toxic.sum() < len(toxic):
        return Model(share)
    field = fit_field([t.decode().split() for t in texts], toxic)
    if field is None:
        return Model(share)
    model = Model(share, field)
    parts = [model.marginals(texts[i : i + 500])[:2] for i in range(0, len(texts), 500)]
    x = np.vstack([evidence(p, first) for p, first in parts])
    model.document = Logistic(1.0).fit(x, toxic.astype(float), weight)
    return model


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _fitted(weights: dict[int, float], share: float):
    """Fit in one task: its input is the bounded sample."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["doc_id"], r["toxic"], r["text"]) for b in batches for r in b.to_pylist())
        if rows:
            toxic = np.array([k for _, k, _ in rows], int)
            weight = np.array([weights[k] / max((toxic == k).sum(), 1) for k in toxic.tolist()])
            model = fit([t.encode() for *_, t in rows], toxic, weight * len(rows), share)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])
    return run


def train(docs: DataFrame, labels: DataFrame, toxic_docs: int = TOXIC_DOCS, clean_docs: int = CLEAN_DOCS) -> Model:
    """Fit on labelled documents that are not held out, about ``toxic_docs`` and ``clean_docs`` of them."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")) \
        .filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out()) \
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = dict(known.groupBy("toxic").count().collect())
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.0
    if len(counts) < 2:
        return Model(share)
    picked = [hashed_sample(known.filter(F.col("toxic") == k), n, counts[k], "doc_id") for k, n in ((0, clean_docs), (1, toxic_docs))]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")) \
        .join(F.broadcast(picked[0].union(picked[1])), "doc_id") \
        .groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text"))  # one text an id, however often it occurs
    found = rows.repartition(1).mapInArrow(_fitted({k: counts[k] / total for k in counts}, share), "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else Model(share)


def _code_points(text: bytes, at: int) -> int:
    """Characters before byte ``at``."""
    return len(text[:at].decode())


def scorer(model: Model, threshold: float, mark: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            found: list[list[dict]] = [[] for _ in texts]
            if model.document is None:
                score = np.full(len(texts), model.share)
            else:
                p, first, starts, ends = model.marginals(texts)
                score = sigmoid(model.document.logit(evidence(p, first)))
                base = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
                hits = np.flatnonzero(p >= mark)
                for w, t in zip(hits.tolist(), (np.searchsorted(first, hits, "right") - 1).tolist(), strict=True):
                    a, b = int(starts[w] - base[t]), int(ends[w] - base[t])
                    begin = _code_points(texts[t], a)
                    found[t].append({"start": begin, "end": begin + len(texts[t][a:b].decode()), "p": float(p[w])})
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(found, kind)],
                names=["doc_id", "score", "predicted", "spans"])
    return run


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, mark: float = 0.5, id_col: str = "doc_id",
             text_col: str = "text", toxic_docs: int = TOXIC_DOCS, clean_docs: int = CLEAN_DOCS) -> DataFrame:
    """(doc_id, score, predicted, spans) of every row; spans are code-point offsets of toxic words with their marginals."""
    light = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = train(light, labels, toxic_docs, clean_docs)
    return light.mapInArrow(scorer(model, threshold, mark), f"doc_id long, score double, predicted int, spans {SPANS}")
