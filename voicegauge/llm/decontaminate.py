"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words.

Words compare without case and without punctuation around them.

1. Every n-gram of every item is a seed, however many documents hold it.
2. One scan of the documents, whatever the number of items, finds the places
   whose n-gram may be a seed, by a bitmap of all seeds whose size is bounded;
   it lets no seed through its mesh, and others rarely pass. Places near each
   other make a stretch, which carries its words and its hits.
3. Hits and seeds are joined, so a stretch meets the items that it shares seeds
   with and no other; what is shuffled are stretches, not documents. Items are
   never sent whole to all tasks.
4. A passage around the diagonals of shared seeds is left out if it has too few
   of the item's words for the threshold, which bounds its score from above;
   the others are aligned with the item by local alignment (2 for equal words,
   -1 for a substitution or a gap). The score over twice the item's words is
   the share of the item that is found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voicegauge.llm import _words as W
from voicegauge.llm._store import Store
from voicegauge.llm.toxicity import _EDGE

FOUND = "doc_id long, item_id long, score double, seeds long, start long, end long"


def bare(w: W.Words) -> W.Words:
    """The same words, hashed in lower case without punctuation around them."""
    start, end = w.start.copy(), w.end.copy()
    for _ in range(3):
        start += (start < end) & _EDGE[w.data[np.minimum(start, len(w.data) - 1)]] if len(w.data) else 0
        end -= (start < end) & _EDGE[w.data[end - 1]] if len(w.data) else 0
    n = len(w.data) + 1
    run = np.zeros(n, np.uint64)
    np.cumsum(W._BYTE_LOWER[w.data] * W.powers(W._BASE, n)[1:], out=run[1:])
    w.h = W.mix((run[end] - run[start]) * W.powers(W._BASE_INV, n)[start] + (end - start).astype(np.uint64))
    return w


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """(score, word after the last) of the best local alignment of two word sequences; a row of the matrix at a time."""
    n = len(passage)
    place = np.arange(n)
    row = np.zeros(n, np.int64)
    best, end = 0, 0
    for word in item:
        diagonal = np.concatenate([[0], row[:-1]]) + np.where(passage == word, 2, -1)
        new = np.maximum(np.maximum(diagonal, row - 1), 0)
        row = np.maximum.accumulate(new + place) - place  # gaps in the item's direction
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at + 1
    return best, end


def seeds_of(items: DataFrame, n: int) -> DataFrame:
    """(seed, item, place) from (item, text): every n-gram with its place; an item of fewer than n words is one seed."""

    def rows(batches):
        for b in batches:
            for lo, _, w in W.chunks(b.column(1), lower=True):
                bare(w)
                for k in sorted({min(n, int(c)) for c in w.count} - {0}):
                    at = np.flatnonzero(w.within(k) & (np.minimum(w.count, n)[w.doc] == k))
                    own = b.column(0).take(pa.array(lo + w.doc[at]))
                    place = (at - w.first[w.doc[at]]).astype(np.int32)
                    columns = [pa.array(W.signed(w.grams(k)[at])), own, pa.array(place), pa.array(np.full(len(at), k, np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, ["seed", "item", "place", "k"])

    return items.mapInArrow(rows, "seed long, item long, place int, k int")


def _slot(h: np.ndarray, bits: int) -> np.ndarray:
    return (W.mix(h) >> np.uint64(64 - bits)).astype(np.int64)


def bitmap(seeds: DataFrame, count: int, most: int = 27) -> tuple[np.ndarray, int]:
    """(bytes, bits) of a bitmap with 2**bits slots of hashed seeds: 32 or more a seed, up to 2**most, which is 16 MB."""
    bits = int(min(most, max(16, np.ceil(np.log2(32 * max(count, 1))))))

    def mark(batches):
        seen = np.zeros(1 << bits, bool)
        for b in batches:
            seen[_slot(b.column(0).to_numpy().view(np.uint64), bits)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(seen).tobytes()])], ["seen"])

    out = np.zeros(1 << bits >> 3, np.uint8)
    for row in seeds.select("seed").coalesce(8).mapInArrow(mark, "seen binary").toLocalIterator():
        out |= np.frombuffer(row.seen, np.uint8)
    return out, bits


def _stretches(sent, sizes: list[int], near: int, reach: int):
    """Rows (stretch, doc_id, row, start, words, at, seeds): runs of hits that are at most `near` words apart, as those of one passage are, with `reach` words more on each side."""

    def rows(batches):
        seen, bits = sent.value
        table = np.unpackbits(seen)
        task, number, rows_seen = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            for lo, hi, w in W.chunks(b.column(1), lower=True):
                bare(w)
                base, rows_seen = (task << 40) + rows_seen, rows_seen + hi - lo
                found = []
                for k in sizes:
                    g, at = w.grams(k), np.flatnonzero(w.within(k))
                    at = at[table[_slot(g[at], bits)] > 0]
                    found.append((at, g[at]))
                at, h = (np.concatenate([f[i] for f in found]) for i in (0, 1))
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, h = at[order], h[order]
                doc = w.doc[at]
                first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (at[1:] - at[:-1] > near)))
                last = np.append(first[1:], len(at)) - 1
                own = doc[first]
                start = np.maximum(w.first[own], at[first] - reach)
                stop = np.minimum(w.first[own + 1], at[last] + reach)
                offsets = np.append(first, len(at)).astype(np.int32)
                text = [w.data[w.start[x] : w.end[y - 1]].tobytes() for x, y in zip(start, stop, strict=True)]
                ids = (task << 40) + number + np.arange(len(first))
                number += len(first)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids), b.column(0).take(pa.array(lo + own)), pa.array(base + own), pa.array((start - w.first[own]).astype(np.int32)), pa.array(text, pa.binary()).cast(pa.string()),
                        pa.ListArray.from_arrays(offsets, pa.array((at - np.repeat(start, last - first + 1)).astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(W.signed(h))),
                    ],
                    ["stretch", "doc_id", "row", "start", "words", "at", "seeds"],
                )

    return rows


def _common(item: np.ndarray, words: np.ndarray) -> int:
    """How many of an item's words a passage has, in any order; an alignment scores 2 for each at most."""
    own, n = np.unique(item, return_counts=True)
    at = np.minimum(np.searchsorted(own, words), len(own) - 1)
    return int(np.minimum(np.bincount(at[own[at] == words], minlength=len(own)), n).sum())


def passages(diagonals: np.ndarray, size: int, length: int):
    """(first word, word after the last, seeds) of the passages that share seeds along near diagonals; diagonals in order."""
    slack = size // 4 + 2
    first = np.flatnonzero(np.append(True, np.diff(diagonals) > size))
    for a, b in zip(first, np.append(first[1:], len(diagonals)), strict=True):
        yield max(0, diagonals[a] - slack), min(length, diagonals[b - 1] + size + slack), b - a


def _aligned(threshold: float):
    """The best passage of each row (doc_id, row, start, words, item_id, text, diagonals), if it reaches the threshold."""

    def rows(batches):
        for b in batches:
            out = []
            texts = pa.concat_arrays([b.column("words"), b.column("text")])
            words = []
            for lo, hi, w in W.chunks(texts, lower=True):
                bare(w)
                words += [w.h[w.first[i] : w.first[i + 1]] for i in range(hi - lo)]
            for i in range(b.num_rows):
                own, item = words[i], words[b.num_rows + i]
                best = (0.0,)
                for start, stop, seeds in passages(np.sort(b.column("diagonals")[i].values.to_numpy()), len(item), len(own)):
                    if _common(item, own[start:stop]) < threshold * len(item):
                        continue
                    points, end = align(item, own[start:stop])
                    share = points / (2 * len(item))
                    if share >= threshold and share > best[0]:
                        back = align(item[::-1], own[start : start + end][::-1])[1]
                        place = int(b.column("start")[i].as_py() + start + end)
                        best = (share, int(seeds), place - back, place)
                if best[0]:
                    out.append((i, *best))
            if out:
                at, *columns = (pa.array(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in ("doc_id", "row", "item_id")), *columns], ["doc_id", "row", "item_id", "score", "seeds", "start", "end"])

    return rows


def contaminated_passages(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 4, threshold: float = 0.5) -> DataFrame:
    """(doc_id, item_id, score, seeds, start, end), a row for each document and item that it holds.

    score: from threshold to 1; the best passage's, start and end in words of
    the document. Items of fewer than n words have themselves as their seed.

    Null and wordless texts and items match nothing. A null doc_id or item_id
    is carried as null (the latter as -1). Documents of equal ids are each
    compared and can give equal rows; of items of one id the best counts.
    Texts may have any length. Further columns are ignored, whatever their
    names. Without documents or items the result is empty.
    """
    spark = docs.sparkSession
    store = Store(spark, "decontaminate")
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    items = benchmark.select(F.coalesce(F.col(item_id).cast("long"), F.lit(-1).cast("long")).alias("item_id"), F.col(item_text).alias("text"))
    items = store.keep(items.where(F.col("text").isNotNull()).withColumn("item", F.monotonically_increasing_id()))
    seeds = store.keep(seeds_of(items.select("item", "text"), n))
    facts = seeds.agg(F.count("*"), F.max("place"), F.collect_set("k")).first()
    if not facts[0]:
        return spark.createDataFrame([], FOUND)
    sent = spark.sparkContext.broadcast(bitmap(seeds, facts[0]))
    longest = facts[1] + n  # words of an item at most
    made = "stretch long, doc_id long, row long, start int, words string, at array<int>, seeds array<long>"
    stretches = store.keep(own.mapInArrow(_stretches(sent, sorted(facts[2]), 2 * longest, longest + longest // 4 + 2), made))
    hits = stretches.select("stretch", F.explode(F.arrays_zip("at", "seeds")).alias("h")).select("stretch", "h.at", F.col("h.seeds").alias("seed"))
    met = hits.join(seeds, "seed").groupBy("stretch", "item").agg(F.collect_list(F.col("at") - F.col("place")).alias("diagonals"))
    both = met.join(stretches.select("stretch", "doc_id", "row", "start", "words"), "stretch").join(items, "item")
    found = both.mapInArrow(_aligned(threshold), "doc_id long, row long, item_id long, score double, seeds long, start long, end long")
    # a long document can hold an item in several stretches
    best = found.groupBy("row", "doc_id", "item_id").agg(F.max_by(F.struct("score", "seeds", "start", "end"), F.struct("score", -F.col("start"))).alias("b"))
    return best.select("doc_id", "item_id", "b.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without the rows that hold an item, those with a null doc_id too; of rows with one doc_id each is judged by its own text."""
    store = Store(docs.sparkSession, "decontaminate")
    row = F.xxhash64(F.col(doc_id), F.col(text))
    found = contaminated_passages(docs.select(row.alias("row"), F.col(text).alias("text")), benchmark, doc_id="row", **options)
    bad = store.keep(found.select(F.col("doc_id").alias("bad")).distinct())
    return docs.join(bad, row == bad["bad"], "left_anti")
