"""Toxicity classifier with a counterfactual penalty on identity terms.

Features are densities of words and of word beginnings (4 to 8 bytes), so
stems count in any inflection. Those that tell the classes of the labelled
sample apart best are kept. The model is a logistic regression; besides the
log loss and an L2 term, training adds the mean squared change of the logit
between a labelled text and its copies with identity terms swapped for each
other of their group. Weight then can't sit on the mention of a group.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voicegauge.llm import _words as W
from voicegauge.llm._store import Store

#: Groups of terms that may stand for each other.
IDENTITY_GROUPS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("muslims", "christians", "jews", "hindus", "atheists"), ("muslim", "christian", "jewish", "hindu", "atheist"),
    ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian", "bisexual", "transgender"), ("immigrants", "natives", "refugees"), ("disabled", "able-bodied"), ("young", "old"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("frauen", "männer"), ("muslime", "christen", "juden"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
_SWAP = {g[i].encode(): [t.encode() for t in g[i + 1 :] + g[:i]] for g in IDENTITY_GROUPS for i in range(len(g))}
_EDGE = np.zeros(256, bool)
_EDGE[list(b".,!?;:\"'()[]|*%$#&")] = True
PREFIXES = (4, 5, 6, 7, 8)


def features(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each word without punctuation around it and of each of its beginnings, lower case."""
    start, end = w.start.copy(), w.end.copy()
    for _ in range(3):
        start += (start < end) & _EDGE[w.data[np.minimum(start, len(w.data) - 1)]]
        end -= (start < end) & _EDGE[w.data[end - 1]]
    go = start < end
    start, end, doc = start[go], end[go], w.doc[go]
    if not len(start):
        return doc, np.zeros(0, np.uint64)
    n = len(w.data) + 1
    run = np.zeros(n, np.uint64)
    np.cumsum(W._BYTE_LOWER[w.data] * W.powers(W._BASE, n)[1:], out=run[1:])
    back = W.powers(W._BASE_INV, n)[start]
    docs, out = [doc], [W.mix((run[end] - run[start]) * back + np.uint64(1))]
    for k in PREFIXES:
        at = end - start > k
        out.append(W.mix((run[start[at] + k] - run[start[at]]) * back[at] + np.uint64(1000 + k)))
        docs.append(doc[at])
    return np.concatenate(docs), np.concatenate(out)


def density(count: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Occurrences in a hundred words, at most 2; short texts count as somewhat longer."""
    return np.minimum(count * 100 / (words + 30), 2.0)


def vectors(w: W.Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, column, value) of the texts' chosen features; chosen is in order."""
    doc, h = features(w)
    if not len(chosen) or not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    col = np.minimum(np.searchsorted(chosen, h), len(chosen) - 1)
    hit = chosen[col] == h
    key, count = np.unique(doc[hit] * len(chosen) + col[hit], return_counts=True)
    doc = key // len(chosen)
    return doc, key % len(chosen), density(count, w.count[doc])


def swapped(text: bytes) -> list[bytes]:
    """Copies of the text with its identity terms swapped: in the k-th each is the k-th next of its group, until every group is through."""
    words = text.split()
    terms = {}
    for i, word in enumerate(words):
        core = word.strip(b".,!?;:\"'()[]")
        if (others := _SWAP.get(core.lower())) is not None:
            terms[i] = [word.replace(core, t) for t in others]
    copies = max(map(len, terms.values()), default=0)
    return [b" ".join(terms[i][k % len(terms[i])] if i in terms else w for i, w in enumerate(words)) for k in range(copies)]


@dataclass
class Model:
    chosen: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, w: W.Words) -> np.ndarray:
        doc, col, value = vectors(w, self.chosen)
        logit = np.full(w.n_docs, self.bias)
        np.add.at(logit, doc, value * self.weight[col])
        return 1 / (1 + np.exp(-logit))


def train(rows: list[tuple], width: int, l2: float, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights and bias of rows (label, columns, values, (columns, values) of each swapped copy), by full-batch Adam steps."""
    y = np.array([r[0] for r in rows], float)
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1)
        return np.zeros(width), float(np.log(p / (1 - p)))

    def matrix(pairs):
        n = np.array([len(c) for c, _ in pairs], np.int64)
        return np.repeat(np.arange(len(pairs)), n), np.concatenate([np.asarray(c, np.int64) for c, _ in pairs] or [np.zeros(0, np.int64)]), np.concatenate([np.asarray(v, float) for _, v in pairs] or [np.zeros(0)])

    row, col, val = matrix([(r[1], r[2]) for r in rows])
    both = [(r, c, 1 / len(r[3])) for r in rows for c in r[3]]
    # x - x' as one sparse matrix, a row a copy; the copies of a text share its weight
    drow, dcol, dval = matrix([(list(r[1]) + list(c[0]), list(r[2]) + [-v for v in c[1]]) for r, c, _ in both])
    share = np.array([k for _, _, k in both])
    texts = max(share.sum(), 1)
    w, b = np.zeros(width), float(np.log(y.mean() / (1 - y.mean())))
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for step in range(1, steps + 1):
        z = b + np.bincount(row, val * w[col], len(y))
        err = (1 / (1 + np.exp(-z)) - y) / len(y)
        g = np.bincount(col, err[row] * val, width) + l2 * w
        if len(both):
            gap = np.bincount(drow, dval * w[dcol], len(both)) * share / texts
            g += 2 * penalty * np.bincount(dcol, gap[drow] * dval, width)
        gb = err.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        scale = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        w -= 0.1 * scale * m / (np.sqrt(v) + 1e-8)
        b -= 0.1 * scale * mb / (np.sqrt(vb) + 1e-8)
    return w, float(b)


def fit(labelled: DataFrame, text: str, label: str, width: int, least: float, l2: float, penalty: float, steps: int, store: Store) -> Model:
    """A model of rows (text, label 0 or 1). Only the best features' rows, and the rows' values of them, come to the driver."""
    rows = store.keep(labelled.select(F.col(text).alias("text"), F.col(label).cast("int").alias("label")))
    n0, n1 = (rows.where(F.col("label") == c).count() for c in (0, 1))

    def seen(batches):
        for b in batches:
            y = b.column(1).to_numpy()
            for lo, _, w in W.chunks(b.column(0)):
                doc, h = features(w)
                order = np.lexsort((doc, h))
                doc, h = doc[order], h[order]
                new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])) if len(h) else np.zeros(0, bool)
                at = np.flatnonzero(new)
                count = np.diff(np.append(at, len(h)))
                value = density(count, w.count[doc[at]])
                key = h[at]
                new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
                first = np.flatnonzero(new)
                own = y[lo + doc[at]]
                if len(first):
                    yield pa.RecordBatch.from_arrays([pa.array(W.signed(key[first])), *(pa.array(np.add.reduceat(x, first).astype(float)) for x in (np.ones(len(own)), value * (own == 1), value * (own == 0), value**2))], ["h", "d", "v1", "v0", "s"])

    stats = rows.mapInArrow(seen, "h long, d double, v1 double, v0 double, s double").groupBy("h").agg(*(F.sum(c).alias(c) for c in ("d", "v1", "v0", "s"))).where("d >= 3")
    # the classes' mean densities, over the standard error of their difference
    n = max(n0 + n1, 1)
    spread = F.col("s") / n - F.pow((F.col("v1") + F.col("v0")) / n, 2)
    z = F.abs(F.col("v1") / max(n1, 1) - F.col("v0") / max(n0, 1)) / F.sqrt((spread + 1e-4) * (1 / max(n1, 1) + 1 / max(n0, 1)))
    best = stats.where(z >= least).orderBy(z.desc(), "h").limit(width).select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64)
    chosen = np.sort(best)

    pair = pa.struct([("col", pa.list_(pa.int64())), ("val", pa.list_(pa.float64()))])

    def rows_of(batches):
        for b in batches:
            for lo, hi, w in W.chunks(b.column(0)):
                doc, col, value = vectors(w, chosen)
                cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                others = []
                for i in range(hi - lo):
                    copies = [np.frombuffer(c, np.uint8) for c in swapped(w.bytes_of(i))]
                    found = [vectors(W.Words(raw, np.array([0, len(raw)]), False), chosen) for raw in copies]
                    others.append([{"col": c.tolist(), "val": v.tolist()} for _, c, v in found])
                own = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x)) for x in (col, value)]
                label = b.column(1).slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([label, *own, pa.array(others, pa.list_(pair))], ["label", "col", "val", "others"])

    made = "label int, col array<long>, val array<double>, others array<struct<col:array<long>,val:array<double>>>"
    got = rows.mapInArrow(rows_of, made).orderBy("label", F.xxhash64("col", "val")).toLocalIterator()
    weight, bias = train([tuple(r) for r in got], len(chosen), l2, penalty, steps)
    store.drop(rows)
    return Model(chosen, weight, bias)


def toxicity_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", learn: str | None = None, sample: int = 12_000, width: int = 3000, least: float = 4.0, l2: float = 2e-5, penalty: float = 1.0, steps: int = 400) -> DataFrame:
    """(doc_id, score) of every row of docs; score from 0 to 1, higher: toxic likelier.

    labels (doc_id, label 0 or 1) gives the rows to learn from; learn: an SQL
    condition on doc_id that they must meet besides. At most `sample` labelled
    documents are used, those with the least hash of their id. Of the features
    that three of them or more have, the `width` best by the difference of
    class means count, if it is `least` standard errors or more. These bound
    what is learnt from; whole texts of all rows are scored. Of several labels
    of an id the greatest counts; null labels and labels without a document
    don't. Rows of equal doc_id are each scored.

    Null and blank texts have no feature: their score is the model's for no
    evidence. Without labels of both classes every score is the (smoothed)
    share of label 1. Further columns are ignored, whatever their names. Empty
    docs: empty result.
    """
    spark = docs.sparkSession
    store = Store(spark, "toxicity")
    ids = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(doc_id).cast("long").alias("id")).agg(F.max(label).cast("int").alias("label")).where("id is not null")
    if learn:
        ids = ids.withColumn("doc_id", F.col("id")).where(learn).select("id", "label")
    picked = store.keep(ids.orderBy(F.xxhash64("id"), "id").limit(sample))
    own = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    model = fit(own.join(F.broadcast(picked), "id"), "text", "label", width, least, l2, penalty, steps, store)  # at most `sample` rows of two numbers
    sent = spark.sparkContext.broadcast(model)

    def score(batches):
        for b in batches:
            for lo, hi, w in W.chunks(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(sent.value.score(w))], ["doc_id", "score"])

    return own.mapInArrow(score, "doc_id long, score double")
