"""Quality classifier by co-training of two views.

View A sees the text's content (character classes, repeats, line shapes); view B sees the
page's metadata (language, source, stated length).  Both start from labelled rows.  In
each round each view scores every unlabelled row, and the rows it is sure of become training
rows of the other view, where the view is right on labelled rows it did not train on.
At the end each view's logit is calibrated on those rows, a last logistic model combines the
two, and every document is scored.

Unlabelled rows are never sampled.  A round is one pass over all of them: each task adds up, for
each view and pseudo-label, the number of rows and the gradient and curvature of the view's
loss on them, and Spark adds the tasks' sums.  The next model is the Newton minimum of the
labelled rows' loss and that quadratic form.  A label weighs no more than its own share of the rows allows, and all
pseudo-labels together half as much as the labelled rows, at every size of the table.

Bound, a documented parameter: about ``labelled`` labelled ids (the lowest by a hash of the id,
one row each) are fitted on the driver as some 30 numbers a row.  Scores, statistics of
the text and decisions cover every row and whole texts.

Defined cases: null and empty texts have zero statistics (their score follows from the
fitted model); very long texts are read whole; null language, source or length are values of their own; a null doc_id has
no label; with labels of one kind only, or none, every score is the share of label 1 (1
without labels), so nothing is rejected.  Repeated rows get equal scores; of rows that share a
labelled doc_id one trains.  An empty table gives an empty result.  Further columns, whatever their
names, are not read, and ``kept_documents`` passes them through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, hashed_sample, written
from .logistic import Logistic, sigmoid

LABELLED, ROUNDS, SURE = 12_000, 4, 0.9
CONTENT = ["letters", "upper", "digits", "marks", "pipes", "spaces", "wide", "mark_ends", "mark_words", "upper_words", "repeats",
           "distinct", "word_len", "lines", "line_len", "log_words", "doubled_marks"]
HASHED = 24  # columns for each hashed metadata value

KIND = np.zeros(256, np.uint8)  # 1 letter, 2 digit, 3 mark, 4 space; bytes above 127 count as letters
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
KIND[48:58] = 2
KIND[[b for b in range(33, 127) if not chr(b).isalnum()]] = 3
KIND[[32, 9, 10, 11, 12, 13]] = 4
PLAIN_MARKS = np.zeros(256, bool)
PLAIN_MARKS[[ord(c) for c in ".,;:'\"()-?"]] = True


def statistics(text: bytes) -> list[float]:
    """The content view's numbers of one whole text, in the order of CONTENT."""
    buf = np.frombuffer(text, np.uint8)
    if not len(buf):
        return [0.0] * len(CONTENT)
    counts = np.bincount(buf, minlength=256)
    n = len(buf)
    kinds = [int(counts[KIND == k].sum()) for k in range(5)]
    mark = KIND[buf] == 3
    space = KIND[buf] == 4
    upper = int(counts[65:91].sum())
    odd = mark & ~PLAIN_MARKS[buf]
    last = np.append(space[1:], True) & ~space  # last byte of each word
    words = text.split()
    many = max(len(words), 1)
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lines = int(counts[10]) + 1
    return [kinds[1] / n, upper / max(kinds[1], 1), kinds[2] / n, int(odd.sum()) / n, int(counts[124]) / n, kinds[4] / n, int(counts[128:].sum()) / n,
            int((odd & last).sum()) / many, sum(not w.strip(b"|*#$%&!~-=_+.") for w in words) / many, sum(w.isupper() and len(w) > 1 for w in words) / many, same / many,
            len(set(words)) / many, n / many, lines / many, np.log1p(n / lines), np.log1p(len(words)), int((mark[1:] & (buf[1:] == buf[:-1])).sum()) / many]


def _content(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.float32())
    for batch in batches:
        found = [statistics(t) for t in as_bytes(batch.column("text"))]
        keep = [c for c in range(batch.num_columns) if batch.schema.names[c] != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(found, kind)], names=[*[batch.schema.names[c] for c in keep], "content"])


def _bucket(c: str) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("\x00"))), F.lit(HASHED)).cast("int")


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, lang, source, log_chars, content): ``row`` holds the other columns; the text itself is left out."""
    def given(c: str, kind: str) -> Column:
        return F.col(c).cast(kind) if c in docs.columns else F.lit(None).cast(kind)
    light = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), given("lang", "string").alias("_lang"),
                        given("source", "string").alias("_source"), given("n_chars", "long").alias("_chars"))
    light = light.select("doc_id", "text", _bucket("_lang").alias("lang"), _bucket("_source").alias("source"),
                         F.log1p(F.greatest(F.coalesce("_chars", F.lit(0)), F.lit(0))).cast("float").alias("log_chars"))
    return light.mapInArrow(_content, "doc_id long, lang int, source int, log_chars float, content array<float>")


def _views(rows: list) -> tuple[np.ndarray, np.ndarray]:
    a = np.array([r["content"] for r in rows], np.float64).reshape(len(rows), len(CONTENT))
    return a, metadata(np.array([r["lang"] for r in rows], int), np.array([r["source"] for r in rows], int), np.array([r["log_chars"] for r in rows], float))


def metadata(lang: np.ndarray, source: np.ndarray, log_chars: np.ndarray) -> np.ndarray:
    return np.hstack([np.eye(HASHED)[lang], np.eye(HASHED)[source], log_chars[:, None]])


class CoTrained:
    """Two views, their calibrations and the model that combines them."""

    def __init__(self, share: float, views=None, joint=None):
        self.share, self.views, self.joint = share, views, joint

    def score(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.views is None:
            return np.full(len(a), self.share)
        return sigmoid(self.joint.logit(np.stack([cal.logit(v.logit(x)[:, None]) for (v, cal), x in zip(self.views, (a, b), strict=True)], axis=1)))


def moments(model: Logistic, x: np.ndarray, label: float) -> np.ndarray:
    """(rows, gradient, curvature) of a view's loss on rows with one pseudo-label, as one vector."""
    z = model._columns(x)
    p = sigmoid(z @ model.coef)
    return np.concatenate([[float(len(x))], z.T @ (p - label), ((z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z).ravel()])


Limits = list[dict[int, float]]  # for each view and label, how sure it must be; absent: it may not teach that label


def taught(models: list[Logistic], limits: Limits, views: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The moments of both views on the rows that the other one is sure of: view 0 by label 0 and 1, then view 1."""
    parts = []
    for v in (0, 1):
        p = sigmoid(models[1 - v].logit(views[1 - v]))
        for label, score in ((0, 1 - p), (1, p)):
            limit = limits[1 - v].get(label)
            at = np.flatnonzero(score >= limit) if limit is not None else np.empty(0, int)
            parts.append(moments(models[v], views[v][at], float(label)))
    return np.concatenate(parts)


class LocalPool:
    """Unlabelled rows in memory (the two views' matrices)."""

    def __init__(self, views: tuple[np.ndarray, np.ndarray]):
        self.views, self.rows = views, len(views[0])

    def taught(self, models: list[Logistic], limits: Limits) -> np.ndarray:
        return taught(models, limits, self.views)


class TablePool:
    """Unlabelled rows of a written feature table: every pass reads them all, and only sums come back."""

    def __init__(self, rows: DataFrame):
        self.table, self.rows = rows, rows.count()

    def taught(self, models: list[Logistic], limits: Limits) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                found = taught(models, limits, _batch_views(batch))
                total = found if total is None else total + found
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["place", "value"])
        sums = self.table.mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
        size = len(taught(models, limits, (np.empty((0, len(CONTENT))), np.empty((0, 2 * HASHED + 1)))))
        out = np.zeros(size)
        for r in sums:
            out[r["place"]] = r["value"]
        return out


def co_train(labelled: tuple, y: np.ndarray, fold: np.ndarray, pool, rounds: int = ROUNDS, sure: float = SURE) -> CoTrained:
    """``labelled``: the two views' matrices; ``pool``: unlabelled rows.  Rows of ``fold`` True check and calibrate, the others train."""
    share = float(y.mean()) if len(y) else 1.0
    train, check = ~fold, fold
    if not (0 < y[train].sum() < train.sum() and 0 < y[check].sum() < check.sum()):
        return CoTrained(share)
    models = [Logistic().fit(labelled[v][train], y[train]) for v in (0, 1)]
    for k in range(1, rounds + 1):
        limits: Limits = [{}, {}]
        for v in (0, 1):
            known = sigmoid(models[v].logit(labelled[v][check]))
            for label, score in ((1, known), (0, 1 - known)):
                base = share if label else 1 - share
                limit = sure + (1 - sure) * base  # surer than the label's own share
                right = y[check][score >= limit] == label
                if len(right) >= 10 and right.mean() >= limit:
                    limits[v][label] = limit
        sums = pool.taught(models, limits)
        for v in (0, 1):
            d = len(models[v].coef)
            width, parts = 1 + d + d * d, []
            for label in (0, 1):
                part, sums = sums[:width], sums[width:]
                quota = (share if label else 1 - share) * k / rounds * pool.rows
                parts.append((min(part[0], quota), part[1 : 1 + d] / max(part[0], 1), part[1 + d :].reshape(d, d) / max(part[0], 1)))
            weight = 0.5 * train.sum() / max(sum(n for n, *_ in parts), train.sum())
            models[v] = models[v].again(labelled[v][train], y[train], sum(n * weight * g for n, g, _ in parts), sum(n * weight * h for n, _, h in parts))
    yc = y[check]
    calibrated = [(m, Logistic(0.1).fit(m.logit(labelled[v][check])[:, None], yc)) for v, m in enumerate(models)]
    logits = np.stack([cal.logit(m.logit(labelled[v][check])[:, None]) for v, (m, cal) in enumerate(calibrated)], axis=1)
    return CoTrained(share, calibrated, Logistic(1.0).fit(logits, yc))


def train(rows: DataFrame, labels: DataFrame, labelled: int = LABELLED, held_out: Column | None = None) -> CoTrained:
    """Fit on about ``labelled`` labelled ids and all unlabelled rows of a written feature table; labels of held-out ids are not read."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")) \
        .filter("doc_id IS NOT NULL AND quality IN (0, 1)")
    if held_out is not None:
        known = known.filter(~held_out)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))  # a doubtful label counts as the lower
    cols = ["lang", "source", "log_chars", "content"]
    known = written(known, "quality-labels")
    some = hashed_sample(known, labelled, known.count(), "doc_id")
    one = F.min(F.struct("content", "lang", "source", "log_chars")).alias("r")  # one row an id, however often it occurs
    found = rows.join(some, "doc_id").groupBy("doc_id").agg(F.first("quality").alias("quality"), one).select("doc_id", "quality", *[f"r.{c}" for c in cols]).collect()
    found.sort(key=lambda r: (r["content"], r["doc_id"]))
    y = np.array([r["quality"] for r in found], float)
    fold = np.arange(len(found)) % 3 == 0
    if len(set(y.tolist())) < 2:
        return CoTrained(float(y.mean()) if len(y) else 1.0)
    free = written(rows.join(known, "doc_id", "left_anti").select(cols), "quality-unlabelled")
    return co_train(_views(found), y, fold, TablePool(free))


def _batch_views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    content = batch.column("content").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, len(CONTENT))
    return content, metadata(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("lang", "source", "log_chars")))


def scorer(model: CoTrained, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(*_batch_views(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array(score >= threshold)], names=["doc_id", "score", "keep"])
    return run


def held_out(id_col: str = "doc_id") -> Column:
    """A quarter of the ids, by checksum; their labels are kept for measuring."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **bounds) -> DataFrame:
    """(doc_id, score, keep) of every row: the chance of label 1, and whether it reaches the threshold."""
    rows = written(features(docs, id_col, text_col), "quality-features")
    model = train(rows, labels, held_out=held_out(), **bounds)
    return rows.mapInArrow(scorer(model, threshold), "doc_id long, score double, keep boolean")


def kept_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are not rejected, with their columns.  Rows without a doc_id stay: a decision cannot name them."""
    id_col = options.get("id_col", "doc_id")
    rejected = quality(docs, labels, **options).filter("NOT keep AND doc_id IS NOT NULL").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(rejected, id_col, "left_anti").select(*[docs[f"`{c}`"] for c in docs.columns])
