"""Exact self-join of documents under the Jaccard distance of their word shingles.

The space is the sets of k-word shingles with d(x, y) = 1 - |x & y| / |x | y|,
a metric, and two documents link when d <= t (t = 0.25 by default).

* Reach. Let S be the shingles that stand in more than one set. Whatever y is,
  x & y lies within x & S, so d(x, y) >= d(x, x & S): a set that is further
  than t from its own common part links with nothing and needs no region. A
  census counts every shingle and hands each set its common ones back.
* Pivots. Almost any two documents are at distance 1, so documents alone
  don't divide the space. The first pivots are therefore the one-shingle sets
  {s}: d(x, {s}) < 1 exactly if x holds s. The nearest of them are x's own
  shingles; ties go to the first in one global order (rare before frequent,
  then by hash), and that is x's Voronoi region.
* Windows. Let x_i be x without its first i shingles; d(x, x_i) = i / |x|. If
  d(x, y) <= t and the least shingle that both hold is x's number i, then
  x & y lies within x_i, so i / |x| = d(x, x_i) <= d(x, x & y) <= d(x, y) <= t.
  A document is thus replicated into the regions of its first
  |x| - ceil((1 - t)|x|) + 1 shingles, and no link is lost. Shingles outside S
  come first and their regions have one member, so only the common ones count.
* Recursion. Regions that share a member are one cluster, and no link leaves
  it. A cluster elects a document as its next pivot p and computes the
  distances to it: those within t are its core and join its component. Each
  member of the core is the pivot of a smaller region, of what no component
  has yet and what the triangle inequality leaves, |d(x, p) - d(y, p)| <= t for
  every pivot p that was elected so far. When nothing is near any more, the
  component is closed, and what is left elects its own next pivot, and so on.
* Large clusters. The members of a cluster are dealt into blocks, and each pair
  of blocks is such a recursion of its own; components join across them. Up to
  `ways` blocks of at least `split` shingles spread the work; more only where
  blocks would have over `block` shingles. A task holds two blocks.

Equal sets count as one throughout, so a group of copies is one member. Sets
are of 64-bit shingle hashes, and equal if two 64-bit sums of them are. Texts
are read once and never shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voicegauge.llm import _words as W
from voicegauge.llm._store import Store
from voicegauge.llm.components import components

_U = np.uint64
_BLOBS = ["a", "b", "c", "d", "e", "f"]
_SENT = "part int, chunk long, a binary, b binary, c binary, d binary, e binary, f binary"
_SEEN = "id long, n long, f1 long, f2 long, shared binary"
_MANY = 65535  # in place of a set's number: the chunk has the shingle in several sets


def shingle_sets(w: W.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, lengths): each text's distinct shingles in order of hash.

    A text of fewer than k words has its whole sequence as one.
    """
    grams, ok = w.grams(k), w.within(k)
    doc, h = w.doc[ok], grams[ok]
    short = np.flatnonzero((w.count > 0) & (w.count < k))
    if len(short):
        whole = np.empty(len(short), np.uint64)
        for n in range(1, k):
            at = w.count[short] == n
            if at.any():
                whole[at] = w.grams(n)[w.first[short[at]]]
        doc, h = np.concatenate([doc, short]), np.concatenate([h, whole])
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=w.n_docs)


def fingerprints(h: np.ndarray, n: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each set."""
    fp = np.zeros(len(n), np.uint64)
    np.add.at(fp, np.repeat(np.arange(len(n)), n), W.mix(h ^ _U(seed)))
    return W.mix(fp + n.astype(np.uint64))


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _one(x: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())


def _tails(h: np.ndarray, n: np.ndarray) -> pa.Array:
    """The low seven bytes of each hash, in pieces of n hashes; the top byte is known from the part.

    A piece has all first bytes, then all second ones and so on: the hashes
    are in order, so the high bytes repeat and are compressed away.
    """
    raw = h.view(np.uint8).reshape(-1, 8)[:, :7]
    ends = np.cumsum(n)
    planes = [raw[b - m : b].T.ravel() for m, b in zip(n, ends, strict=True) if m]
    return W.binaries(np.concatenate(planes) if planes else np.zeros(0, np.uint8), n * 7)


def _shingles(k: int, bits: int, most: int):
    """Of rows (id, text), for each chunk of sets: its shingles by part, and a row that describes the chunk."""

    def rows(batches):
        task, number = TaskContext.get().partitionId(), 0
        ids, hashes, sizes, have = [], [], [], 0
        for b in batches:
            for lo, hi, w in W.chunks(b.column(1), lower=True):
                h, n = shingle_sets(w, k)
                ids.append(b.column(0).slice(lo, hi - lo))
                hashes.append(h)
                sizes.append(n)
                have += len(h) + 50 * len(n)  # a chunk has fewer than _MANY sets
                if have > most:
                    yield from chunk(pa.concat_arrays(ids), np.concatenate(hashes), np.concatenate(sizes), (task << 32) + number)
                    ids, hashes, sizes, have, number = [], [], [], 0, number + 1
        if ids:
            yield from chunk(pa.concat_arrays(ids), np.concatenate(hashes), np.concatenate(sizes), (task << 32) + number)

    def chunk(ids, h, n, name):
        f1, f2 = fingerprints(h, n, 0x51ED270B0A1F39C1), fingerprints(h, n, 0x2545F4914F6CDD1D)
        order = np.lexsort((f2, f1))
        order = order[n[order] > 0]
        first = _starts(f1[order], f2[order])
        slot = np.full(len(n), _MANY, np.int64)
        slot[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        lead = order[first]  # a document of each distinct set
        once = np.zeros(len(n), bool)
        once[lead] = True
        doc = np.repeat(np.arange(len(n)), n)
        own = once[doc]
        h, s = h[own], slot[doc[own]]
        order = np.argsort(h, kind="stable")
        h, s = h[order], s[order]
        at = _starts(h)
        count = np.diff(np.append(at, len(h)))
        many = np.repeat(count > 1, count)
        edges = np.arange(1, 1 << bits, dtype=np.uint64) << _U(64 - bits)
        cut = lambda x: np.diff(np.concatenate([[0], np.searchsorted(x, edges), [len(x)]]))
        h1, s1, hm, cm = h[~many], s[~many], h[at[count > 1]], count[count > 1]
        n1, nm = cut(h1), cut(hm)
        some = np.flatnonzero(n1 + nm > 0)
        none = pa.nulls(len(some), pa.binary())
        parts = [_tails(h1, n1), W.binaries(s1.astype(np.uint16), n1), _tails(hm, nm), W.binaries(cm.astype(np.uint32), nm)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(np.full(len(some), name))]
            + [x.take(pa.array(some)) for x in parts] + [none, none],
            ["part", "chunk", *_BLOBS],
        )
        known = np.concatenate([f1[lead], f2[lead], n[lead].astype(np.uint64)])
        away = -1 - int(W.mix(np.array([name], np.uint64))[0] % _U(1 << 30))
        valid = ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)
        whole = [ids.fill_null(0).to_numpy(), valid, slot.astype(np.uint16), known, s[many].astype(np.uint16), h[many]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([away], pa.int32()), pa.array([name])] + [_one(x) for x in whole], ["part", "chunk", *_BLOBS]
        )

    return rows


def _flat(column: pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """(values, values a row) of a column of binaries."""
    rows = [np.frombuffer(x.as_buffer(), dtype) if x.is_valid else np.zeros(0, dtype) for c in column.chunks for x in c]
    return (np.concatenate(rows) if rows else np.zeros(0, dtype)), np.array([len(x) for x in rows], np.int64)


def _whole(column: pa.ChunkedArray, part: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes whose tails a column has."""
    raw, n = _flat(column, np.uint8)
    out = np.zeros((len(raw) // 7, 8), np.uint8)
    out[:, 7] = part >> (bits - 8)
    n //= 7
    for m, b in zip(n, np.cumsum(n), strict=True):
        out[b - m : b, :7] = raw[7 * (b - m) : 7 * b].reshape(7, m).T
    return out.view(np.uint64).ravel(), n


def _rarity(count: np.ndarray) -> np.ndarray:
    """How many sets have a shingle, on a scale of eighths of a doubling in one byte; it only orders the pivots."""
    return np.minimum(8 * np.log2(count), 255).astype(np.uint8)


def _census(bits: int):
    """To each chunk the shingles of its sets that other sets have too, with their rarity; descriptions pass."""

    def rows(batches):
        for t in W.groups(batches, ["part"]):
            part = t.column("part").to_numpy()
            head = t.filter(pa.array(part < 0))
            if head.num_rows:
                kind = pa.array(np.zeros(head.num_rows, np.int32))
                for b in pa.table([kind, *(head.column(c) for c in ["chunk", *_BLOBS])], ["kind", "chunk", *_BLOBS]).to_batches():
                    yield b
            at = _starts(part)
            for lo, hi in zip(at, np.append(at[1:], len(part)), strict=True):
                if part[lo] >= 0:
                    yield from shared(t.slice(lo, hi - lo), int(part[lo]))

    def shared(t, part):
        h1, n1 = _whole(t.column("a"), part, bits)
        hm, nm = _whole(t.column("c"), part, bits)
        s = np.concatenate([_flat(t.column("b"), np.uint16)[0], np.full(len(hm), _MANY, np.uint16)])
        count = np.concatenate([np.ones(len(h1), np.int64), _flat(t.column("d"), np.uint32)[0].astype(np.int64)])
        row = np.concatenate([np.repeat(np.arange(t.num_rows), n1), np.repeat(np.arange(t.num_rows), nm)])
        h = np.concatenate([h1, hm])
        order = np.argsort(h, kind="stable")
        h = h[order]
        at = _starts(h)
        size = np.diff(np.append(at, len(h)))
        total = np.add.reduceat(count[order], at) if len(at) else at
        go = np.repeat(size > 1, size)
        pick = order[go]
        h, total = h[go], np.repeat(total, size)[go]
        back = np.argsort(row[pick], kind="stable")
        pick, h, total = pick[back], h[back], total[back]
        n = np.bincount(row[pick], minlength=t.num_rows)
        some = pa.array(np.flatnonzero(n))
        if len(some):
            blobs = [W.binaries(h, n), W.binaries(s[pick], n), W.binaries(_rarity(total), n)]
            none = pa.nulls(len(some), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ones(len(some), np.int32)), t.column("chunk").combine_chunks().take(some)]
                + [x.take(some) for x in blobs] + [none] * 3,
                ["kind", "chunk", *_BLOBS],
            )

    return rows


def _gathered(percent: int):
    """(id, n, f1, f2, shared) of each document from its chunk's rows.

    shared: the common shingles, rare before frequent, of a set that has enough
    of them to link; null for others and for all but one of a chunk's equal sets.
    """

    def rows(batches):
        for t in W.groups(batches, ["chunk"]):
            chunk = t.column("chunk").to_numpy()
            at = _starts(chunk)
            for lo, hi in zip(at, np.append(at[1:], len(chunk)), strict=True):
                yield from documents(t.slice(lo, hi - lo))

    def documents(t):
        blob = lambda c, dtype: np.frombuffer(t.column(c)[0].as_buffer(), dtype)
        ids = pa.array(blob("a", np.int64), mask=blob("b", np.uint8) == 0)
        slot, known = blob("c", np.uint16), blob("d", np.uint64)
        m = len(known) // 3
        f1, f2, n = known[:m], known[m : 2 * m], known[2 * m :].astype(np.int64)
        s, h = blob("e", np.uint16), blob("f", np.uint64)
        count = np.diff(np.append(_starts(h), len(h)))
        count = _rarity(np.repeat(count, count))
        told = t.slice(1)
        other, who, often = (_flat(told.column(c), d)[0] for c, d in (("a", np.uint64), ("b", np.uint16), ("c", np.uint8)))
        own = who == _MANY
        if own.any() and len(h):
            order = np.argsort(other[own])
            oh, oc = other[own][order], often[own][order]
            where = np.minimum(np.searchsorted(oh, h), len(oh) - 1)
            count = np.where(oh[where] == h, oc[where], count)
        s, h = np.concatenate([s, who[~own]]).astype(np.int64), np.concatenate([h, other[~own]])
        count = np.concatenate([count, often[~own]])
        have = np.bincount(s, minlength=m)
        near = have >= (percent * n + 99) // 100
        go = near[s]
        s, h, count = s[go], h[go], count[go]
        h = h[np.lexsort((h, count, s))]
        size = np.where(near, have, 0)
        doc = np.flatnonzero(slot != _MANY)
        lead = np.zeros(len(slot), bool)
        lead[doc[np.unique(slot[doc], return_index=True)[1]]] = True
        empty = slot == _MANY
        at = np.where(empty, 0, slot)
        value = lambda x: pa.array(W.signed(x[at]), mask=empty) if m else pa.nulls(len(slot), pa.int64())
        if m:
            none = pa.array(np.where(lead & near[at], at, 0), mask=~(lead & near[at]))
            shared = W.binaries(h, size).take(none)
            n = np.where(empty, 0, n[at])
        else:
            shared, n = pa.nulls(len(slot), pa.binary()), np.zeros(len(slot), np.int64)
        yield pa.RecordBatch.from_arrays([ids, pa.array(n), value(f1), value(f2), shared], ["id", "n", "f1", "f2", "shared"])

    return rows


def _prefix(n: np.ndarray, have: np.ndarray, percent: int) -> np.ndarray:
    """How many of its common shingles, in order, a set's window holds."""
    return have - (percent * n + 99) // 100 + 1


def _regions(percent: int):
    """Of rows (node, n, shared): (cell, u, v), a region's least member here with v null, and the others hung on it with cell null."""

    def rows(batches):
        held, size = [], 0
        for b in batches:
            h, have = _flat(pa.chunked_array([b.column("shared")]), np.uint64)
            kept = _prefix(b.column("n").to_numpy(), have, percent)
            first = np.cumsum(have) - have
            pick = np.repeat(first - np.cumsum(kept) + kept, kept) + np.arange(kept.sum())
            held.append((h[pick], np.repeat(b.column("node").to_numpy(), kept)))
            size += len(pick)
            if size > 2_000_000:
                yield hung(held)
                held, size = [], 0
        if size:
            yield hung(held)

    def hung(held):
        cell, node = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((node, cell))
        cell, node = cell[order], node[order]
        at = _starts(cell)
        count = np.diff(np.append(at, len(cell)))
        least = np.repeat(node[at], count)
        pair = np.unique(np.stack([node[node != least], least[node != least]]), axis=1)
        null = np.concatenate([np.zeros(len(at), bool), np.ones(pair.shape[1], bool)])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([W.signed(cell[at]), pair[0]]), mask=null),
                pa.array(np.concatenate([node[at], pair[0]])),
                pa.array(np.concatenate([node[at], pair[1]]), mask=~null),
            ],
            ["cell", "u", "v"],
        )

    return rows


class Cluster:
    """The sets of a cluster over the shingles that two of them have: rows of bits, or lists where bits would be too wide."""

    def __init__(self, n: np.ndarray, h: np.ndarray, have: np.ndarray):
        self.n, m = n, len(n)
        words, place, often = np.unique(h, return_inverse=True, return_counts=True)
        code = np.cumsum(often > 1) - 1
        member = np.repeat(np.arange(m), have)[often[place] > 1]
        self.item = code[place[often[place] > 1]]
        self.at = np.searchsorted(member, np.arange(m + 1))
        self.width = int((often > 1).sum())
        longs = self.width // 64 + 1
        self.bits = None
        if longs * m <= max(4 * len(self.item), 1 << 16):
            raw = np.zeros((m, longs * 64), np.uint8) if m * longs <= 1 << 18 else None
            if raw is not None:
                raw[member, self.item] = 1
                self.bits = np.packbits(raw, axis=1).view(np.uint64)
            else:
                self.bits = np.zeros((m, longs), np.uint64)
                np.bitwise_or.at(self.bits, (member, self.item >> 6), _U(1) << (self.item & 63).astype(np.uint64))

    def common(self, c: int, rows: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of set c with those of rows."""
        if self.bits is not None:
            return np.bitwise_count(self.bits[rows] & self.bits[c]).sum(1, dtype=np.int64)
        mark = np.zeros(self.width + 1, np.int64)
        mark[self.item[self.at[c] : self.at[c + 1]]] = 1
        size = self.at[rows + 1] - self.at[rows]
        pick = np.repeat(self.at[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())
        sums = np.concatenate([[0], np.cumsum(mark[self.item[pick]])])
        ends = np.cumsum(size)
        return sums[ends] - sums[ends - size]


def join_cluster(sets: Cluster, percent: int, every: bool, pivots: int = 8):
    """(a, b, common, total) of members of a cluster.

    With every: all links. Else as many as connect each component: a member of
    a component isn't compared with another of it.
    """
    n = sets.n
    t = (100 - percent) / 100 + 1e-9
    left = np.argsort(n, kind="stable")
    far = np.zeros((0, len(n)))  # distances to the last pivots, of all that were left when they were elected
    while len(left) > 1:
        queue, left, elected = [left[0]], left[1:], True
        while queue and len(left):
            c = queue.pop()
            low, high = np.searchsorted(n[left], [-(-percent * n[c] // 100), n[c] * 100 // percent + 1])
            rows = left if elected else left[low:high]
            if not elected and len(far):
                rows = rows[(np.abs(far[:, rows] - far[:, c : c + 1]) <= t).all(0)]
            both = sets.common(c, rows)
            total = n[rows] + n[c] - both
            if elected:
                new = np.zeros((1, len(n)))
                new[0, rows] = 1 - both / total
                far, elected = np.concatenate([far[1 - pivots :] if len(far) >= pivots else far, new]), False
            near = both * 100 >= total * percent
            if near.any():
                yield np.full(near.sum(), c), rows[near], both[near], total[near]
                if not every:
                    queue.extend(rows[near])
                    left = left[~np.isin(left, rows[near])]


def _solved(percent: int, every: bool):
    """Of rows (region, x, y, node, n, shared), sorted by the first three: links (a, b, common, total)."""

    def rows(batches):
        for t in W.groups(batches, ["region", "x", "y"]):
            key = [t.column(c).to_numpy() for c in ("region", "x", "y")]
            node, n = t.column("node").to_numpy(), t.column("n").to_numpy()
            h, have = _flat(t.column("shared"), np.uint64)
            first = np.append(0, np.cumsum(have))
            at = _starts(*key)
            out = []
            for lo, hi in zip(at, np.append(at[1:], len(node)), strict=True):
                sets = Cluster(n[lo:hi], h[first[lo] : first[hi]], have[lo:hi])
                for a, b, both, total in join_cluster(sets, percent, every):
                    a, b = node[lo + a], node[lo + b]
                    out.append((np.minimum(a, b), np.maximum(a, b), both, total))
            if out:
                columns = [pa.array(np.concatenate(x)) for x in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b", "common", "total"])

    return rows


def _clusters(members: DataFrame, percent: int, block: int, split: int, ways: int, store: Store) -> DataFrame:
    """(region, x, y, node, n, shared) from (node, n, shared): each member with its cluster, once for each pair of blocks."""
    hung = store.keep(members.mapInArrow(_regions(percent), "cell long, u long, v long"))
    tops = hung.where("cell is not null").select("cell", "u")
    least = tops.groupBy("cell").agg(F.min("u").alias("v"), F.count("*").alias("n")).where("n > 1")
    across = tops.join(least, "cell").where("u <> v").select("u", "v")
    cluster = components(hung.where("cell is null").select("u", "v").union(across), store)
    sizes = members.select("node", F.expr("length(shared) div 8").alias("size"))
    sizes = store.keep(cluster.join(sizes, "node").select("node", F.col("component").alias("region"), "size"))
    enough = f"greatest(ceil(sum(size) / {block}), least({ways}, ceil(sum(size) / {split})))"
    blocks = sizes.groupBy("region").agg(F.expr(f"cast({enough} as int)").alias("blocks"))
    own = "cast(pmod(xxhash64(node), blocks) as int)"
    pairs = F.expr(
        f"if(blocks = 1, array(struct(0 as x, 0 as y)), transform(filter(sequence(0, blocks - 1), q -> q <> {own}),"
        f" q -> struct(least(q, {own}) as x, greatest(q, {own}) as y)))"
    )
    dealt = sizes.join(blocks, "region").select("node", "region", F.explode(pairs).alias("p"))
    placed = members.join(dealt.select("node", "region", "p.x", "p.y"), "node")
    return placed.select("region", "x", "y", "node", "n", "shared")


def ngram_jaccard_join(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 75, block: int = 4_000_000,
    split: int = 25_000, ways: int = 16, chunk: int = 1_000_000, part_rows: int = 2_000_000, links: bool = False,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) of every row of docs, or with links the linked pairs of classes.

    n_shingles: size of the set. class_id: least doc_id with the same set.
    component_id: least doc_id that a chain of links reaches. With links=True
    the result is (class_a, class_b, common, total), a row for every two
    different sets that link, with the sizes of intersection and union.

    block, split, ways, chunk, part_rows: shingles of a block of a large
    cluster, at most and at least, and how many blocks serve to spread it;
    shingles of a chunk of the census and of a part of it. They bound memory
    and deal out work, and don't change results.

    Null, blank and wordless texts: size 0, linked with nothing, their own
    doc_id as class and component. Fewer than k words: the whole sequence is
    the one shingle. Rows with the same doc_id are each kept and linked by
    their own texts. Rows with a null doc_id link like others; class and
    component are null where no document of theirs has an id. Further
    columns of docs are ignored, whatever their names. An empty table gives
    an empty result.
    """
    store = Store(docs.sparkSession, "ngram-join")
    own = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(16, max(10, int(np.ceil(np.log2(max(size / 6 / part_rows, 1))))))
    sent = own.mapInArrow(_shingles(k, bits, chunk), _SENT).repartition("part").sortWithinPartitions("part")
    told = sent.mapInArrow(_census(bits), _SENT.replace("part", "kind"))
    told = told.repartition("chunk").sortWithinPartitions("chunk", "kind")
    seen = store.keep(told.mapInArrow(_gathered(percent), _SEEN))
    del sent, told  # the census is over, and what it shuffled can go
    store.drop()
    classes = seen.where("n > 0").groupBy("f1", "f2").agg(F.min("id").alias("first"))
    classes = store.keep(classes.withColumn("node", F.monotonically_increasing_id()))
    store.drop()
    held = seen.where("shared is not null").dropDuplicates(["f1", "f2"])
    members = store.keep(held.join(classes, ["f1", "f2"]).select("node", "n", "shared"))
    del held
    store.drop()
    placed = _clusters(members, percent, block, split, ways, store).repartition("region", "x", "y").sortWithinPartitions("region", "x", "y")
    found = store.keep(placed.mapInArrow(_solved(percent, links), "a long, b long, common long, total long"))
    if links:
        a, b = (classes.select(F.col("node").alias(x), F.col("first").alias(f"id_{x}")) for x in "ab")
        named = found.distinct().join(a, "a").join(b, "b")
        ends = F.least("id_a", "id_b").alias("class_a"), F.greatest("id_a", "id_b").alias("class_b")
        return named.select(*ends, "common", "total")
    comp = components(found.select(F.col("a").alias("u"), F.col("b").alias("v")), store)
    store.drop(members)
    named = classes.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    named = named.join(least, "component").select("f1", "f2", "first", "least")
    # Documents without a set have no class; their own numbers spread them over the join's partitions.
    rows = seen.select("id", "n", F.coalesce("f1", "id").alias("f1"), "f2")
    out = rows.join(named, ["f1", "f2"], "left")
    return out.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"),
        F.coalesce("first", "id").alias("class_id"),
    )
