"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

Each text gives a vector of statistics, transformed towards normality. Each
class of the labelled rows has its mean and a covariance shrunk towards a
multiple of the identity (of pooled, standardised statistics). The score is
the logistic of the difference of the two log densities, half Mahalanobis
distances plus log determinants, and the log odds of the classes. Cholesky
factors are computed once a model and sent to the tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voicegauge.llm import _words as W
from voicegauge.llm._store import Store

_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop": b".", "comma": b",", "bang": b"!?", "bar": b"|\t", "line": b"\n", "mark": b"#$%&*+-/<=>@\\^_`~:;\"'()[]{}"}
_USUAL = {"upper": 0.02, "stop": 0.015, "comma": 0.01, "line": 0.004}
NAMES = ["words", "word_length", "length_spread", "upper", "digit", "stop", "comma", "bang", "bar", "line", "mark", "high", "distinct", "distinct_pairs", "distinct_lines", "short", "long", "end_stop"]


def statistics(w: W.Words) -> np.ndarray:
    """A row of transformed statistics for each text; zeros for a text without words."""
    n, data = w.n_docs, w.data
    size = np.maximum(np.diff(w.offsets), 1).astype(float)
    doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(w.offsets))
    length = (w.end - w.start).astype(float)
    mean = (np.bincount(w.doc, length, n) + 20 * 5.0) / (w.count + 20)
    spread = np.sqrt(np.maximum((np.bincount(w.doc, length**2, n) + 20 * 35.0) / (w.count + 20) - mean**2, 0))
    out = {"words": np.log1p(w.count), "word_length": np.log1p(mean), "length_spread": np.log1p(spread)}
    kind = np.zeros(256, np.uint8)
    for i, chars in enumerate(_CLASSES.values(), 1):
        kind[list(chars)] = i
    kind[128:] = len(_CLASSES) + 1
    kinds = len(_CLASSES) + 2
    counts = np.bincount(doc * kinds + kind[data], minlength=n * kinds).reshape(n, kinds)
    # shares with a prior of 200 ordinary characters, so that few words don't look extreme
    for i, name in enumerate([*_CLASSES, "high"], 1):
        out[name] = np.sqrt((counts[:, i] + 200 * _USUAL.get(name, 0.0)) / (size + 200))

    def distinct(h, d):
        order = np.lexsort((h, d))
        h, d = h[order], d[order]
        new = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])) if len(h) else np.zeros(0, bool)
        return (np.bincount(d[new], minlength=n) + 20) / (np.bincount(d, minlength=n) + 20)

    # vocabulary grows about as the square root of the words
    out["distinct"] = np.log(np.maximum(distinct(w.h, w.doc), 1e-3)) * 2
    pair = w.within(2)
    out["distinct_pairs"] = np.log(np.maximum(distinct(w.grams(2)[pair], w.doc[pair]), 1e-3)) * 4
    # a line is the words up to the next line feed
    feeds = np.cumsum(data == 10)
    of = feeds[w.start] if len(w.start) else np.zeros(0, np.int64)
    new = np.append(True, (of[1:] != of[:-1]) | (w.doc[1:] != w.doc[:-1])) if len(of) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    lines = np.add.reduceat(w.h * W.powers(0xD6E8FEB86659FD93, len(w.h) + 1)[_place(new)], at) if len(at) else np.zeros(0, np.uint64)
    out["distinct_lines"] = np.log(np.maximum(distinct(lines, w.doc[at]), 1e-3)) * 4
    out["short"] = np.sqrt((np.bincount(w.doc[length <= 3], minlength=n) + 20 * 0.35) / (w.count + 20))
    out["long"] = np.sqrt((np.bincount(w.doc[length >= 14], minlength=n) + 20 * 0.03) / (w.count + 20))
    last = np.zeros(n)
    full = w.count > 0
    last[full] = data[w.end[w.first[1:][full] - 1] - 1] == 46
    out["end_stop"] = last
    out = np.stack([out[name] for name in NAMES], 1)
    out[~full] = 0
    return out


def _place(new: np.ndarray) -> np.ndarray:
    """The number of each element within its run."""
    i = np.arange(len(new))
    return i - np.maximum.accumulate(np.where(new, i, 0))


@dataclass
class Discriminant:
    """Two classes' means, inverse Cholesky factors and log determinants, over standardised statistics."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    inverse: np.ndarray
    logdet: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        log = [-0.5 * (((z - self.means[c]) @ self.inverse[c].T) ** 2).sum(1) - 0.5 * self.logdet[c] for c in (0, 1)]
        return 1 / (1 + np.exp(-np.clip(log[1] - log[0] + self.prior, -500, 500)))


def solve(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float, width: int) -> Discriminant:
    """A model from each class's count, sum and sum of outer products. A class without rows takes the other's moments and even odds; without any rows every score is 0.5."""
    n = np.array([sums[c][0] if c in sums else 0.0 for c in (0, 1)])
    if n.sum() == 0:
        eye = np.stack([np.eye(width)] * 2)
        return Discriminant(np.zeros(width), np.ones(width), np.zeros((2, width)), eye, np.zeros(2), 0.0)
    first = sum(s[1] for s in sums.values()) / n.sum()
    second = sum(s[2] for s in sums.values()) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(second) - first**2, 1e-6))
    means, inverse, logdet = [], [], []
    for c in (0, 1):
        k, s, o = sums[c] if n[c] else sums[1 - c]
        mean = s / k
        cov = (o / k - np.outer(mean, mean)) / np.outer(scale, scale)
        cov = (1 - shrinkage) * cov + shrinkage * max(np.trace(cov) / width, 1e-3) * np.eye(width) + 1e-6 * np.eye(width)
        factor = np.linalg.cholesky(cov)
        means.append((mean - first) / scale)
        inverse.append(np.linalg.inv(factor))
        logdet.append(2 * np.log(np.diag(factor)).sum())
    prior = float(np.log(n[1] / n[0])) if n.all() else 0.0
    return Discriminant(first, scale, np.array(means), np.array(inverse), np.array(logdet), prior)


def document_statistics(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, x): the statistics of each row's whole text."""

    def rows(batches):
        for b in batches:
            for lo, hi, w in W.chunks(b.column(1)):
                x = statistics(w)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(NAMES)), pa.array(x.ravel()))], ["id", "x"])

    return docs.select(F.col(doc_id).cast("long").alias("id"), text).mapInArrow(rows, "id long, x array<double>")


def fit(labelled: DataFrame, shrinkage: float) -> Discriminant:
    """A model of rows (x, label): sums a batch on the executors, added up there by class."""
    width = len(NAMES)
    upper = np.triu_indices(width)

    def moments(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(0).flatten().to_numpy().reshape(-1, width)
            y = b.column(1).to_numpy()
            for c in (0, 1):
                own = x[y == c]
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array(np.array([float(len(own))])), *(pa.array([v]) for v in own.sum(0)), *(pa.array([v]) for v in (own.T @ own)[upper])], ["c", *names])

    names = ["n", *(f"s{i}" for i in range(width)), *(f"o{i}" for i in range(len(upper[0])))]
    sums = {}
    for row in labelled.select("x", "label").mapInArrow(moments, "c int, " + ", ".join(f"{n} double" for n in names)).groupBy("c").agg(*(F.sum(n).alias(n) for n in names)).collect():
        values = np.array(row[1:], float)
        outer = np.zeros((width, width))
        outer[upper] = values[1 + width :]
        sums[row[0]] = (values[0], values[1 : 1 + width], outer + np.triu(outer, 1).T)
    return solve(sums, shrinkage, width)


def quality_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", learn: str | None = None, shrinkage: float = 0.05) -> DataFrame:
    """(doc_id, score) of every row of docs; score from 0 to 1, higher: good likelier.

    labels (doc_id, label 0 or 1) gives the rows to learn from, all of them;
    learn: an SQL condition on doc_id that they must meet besides. Of several
    labels of an id the greatest counts; null labels and labels without a
    document don't. Rows of equal doc_id are each scored.

    Null, blank and wordless texts have zeros as their statistics and are
    scored like any other. With labels of one class only the two densities are
    the same, and without any label too: every score is 0.5. Further columns
    are ignored, whatever their names. Empty docs: empty result.
    """
    store = Store(docs.sparkSession, "quality")
    seen = store.keep(document_statistics(docs, doc_id, text))
    ids = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(doc_id).cast("long").alias("id")).agg(F.max(label).cast("int").alias("label")).where("id is not null")
    if learn:
        ids = ids.withColumn("doc_id", F.col("id")).where(learn).select("id", "label")
    model = docs.sparkSession.sparkContext.broadcast(fit(seen.join(ids, "id"), shrinkage))

    def score(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.value.score(x))], ["doc_id", "score"])

    return seen.mapInArrow(score, "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", learn: str | None = None, shrinkage: float = 0.05, least: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, whose score is `least` or more; scores as in quality_scores. No text is shuffled."""
    store = Store(docs.sparkSession, "quality")
    ids = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(doc_id).cast("long").alias("id")).agg(F.max(label).cast("int").alias("label")).where("id is not null")
    if learn:
        ids = ids.withColumn("doc_id", F.col("id")).where(learn).select("id", "label")
    seen = store.keep(document_statistics(docs, doc_id, text))
    model = docs.sparkSession.sparkContext.broadcast(fit(seen.join(ids, "id"), shrinkage))
    store.drop(seen)
    at = docs.columns.index(text)

    def keep(batches):
        for b in batches:
            good = [model.value.score(statistics(w)) >= least for _, _, w in W.chunks(b.column(at))]
            if good:
                yield b.filter(pa.array(np.concatenate(good)))

    return docs.mapInArrow(keep, docs.schema)
