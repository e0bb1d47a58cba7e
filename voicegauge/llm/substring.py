"""Substring dedup of word sequences by prefix-partitioned suffix trees.

Every word position starts a suffix. A window is a suffix's path of `window`
words from the root, so two windows are equal where their suffixes share a
node of at least that depth; the leaves below such a node are the places of a
repeat, and places that follow each other are the maximal repeat. The tree of
all suffixes is never whole in one place:

1. Prefixes. Each window's least-hashed `prefix`-word gram is its anchor; equal
   windows have theirs at the same place. The suffixes that start at anchors
   are counted by that prefix over all documents. A prefix with one suffix is a
   leaf: no window around it repeats. At 20 and 8 words this counts a seventh
   of all suffixes.
2. Groups. A suffix that starts at an anchor goes to the group of its prefix,
   with the words that its windows have before and behind. Where the census
   found a prefix too frequent for a group, its windows are dealt by a longer
   prefix, of `window` words; such a group holds equal windows only. Of equal
   windows a task sends the earliest; its others are repeats already, so a
   group of either kind has no more rows than fit.
3. Subtrees. In a group the suffixes are sorted by the words behind the prefix,
   and the lengths that neighbours have in common give the subtree's internal
   nodes: a node of depth d is a run of neighbours that share d words at least.
   The words before the anchors are sorted into a tree of their own, from the
   anchor backwards. A window with o words before its anchor is a pair of
   nodes: of depth `window` - o in the one, of depth o in the other. Of the
   leaves of a pair the earliest stays, the others are repeats.
4. Repeats of one document that follow each other merge into spans.

Nodes compare the words themselves, by 64 bits each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voicegauge.llm import _words as W
from voicegauge.llm._store import Store

_COLUMNS = ["key", "id", "start", "length", "before", "offsets", "words"]
_ROWS = "key long, id long, start int, length int, before tinyint, offsets int, words string"


def _anchors(w: W.Words, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix hash at each word, whether a window starts there, place of each window's least prefix hash, the first of equal ones)."""
    g, width = w.grams(prefix), window - prefix + 1
    place, have = np.arange(len(g)), 1
    while have < width:
        step = min(have, width - have)
        here, there = place[:-step], place[step:]
        place = np.concatenate([np.where(g[there] < g[here], there, here), place[-step:]])
        have += step
    return g, w.within(window), place


def _census(window: int, prefix: int):
    """Rows (part, gram, id, n): id null where only the gram's count matters to others; n 0 where the row is known to repeat."""

    def count(batches):
        for gram, doc, ids in _batched(batches):
            order = np.lexsort((doc, gram))
            gram, doc = gram[order], doc[order]
            new = np.append(True, gram[1:] != gram[:-1])
            size = np.diff(np.append(np.flatnonzero(new), len(gram)))
            many = np.repeat(size > 1, size)
            # a gram that repeats here: its documents know it, others hear of it once
            pair = many & np.append(True, (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1]))
            head = new & many
            once = ~many
            own = ids[doc]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([W.signed(gram[once]), own[pair], W.signed(gram[head])])),
                    pa.array(np.concatenate([W.signed(gram[once]), W.signed(gram[pair]), W.signed(gram[head])])),
                    pa.array(np.concatenate([own[once], own[pair], np.zeros(head.sum(), np.int64)]), mask=np.concatenate([np.zeros(once.sum() + pair.sum(), bool), np.ones(head.sum(), bool)])),
                    pa.array(np.concatenate([np.ones(once.sum(), np.int64), np.zeros(pair.sum(), np.int64), size[size > 1]])),
                ],
                ["part", "gram", "id", "n"],
            )

    def _batched(batches, most=1_000_000):
        gram, doc, ids, n, size = [], [], [], 0, 0
        for b in batches:
            own = b.column(0).to_numpy()
            for lo, hi, w in W.chunks(b.column(1)):
                g, ok, place = _anchors(w, window, prefix)
                at = np.unique(place[ok])
                gram.append(g[at])
                doc.append(w.doc[at] + n)
                ids.append(own[lo:hi])
                n += hi - lo
                size += len(at)
                if size > most:
                    yield np.concatenate(gram), np.concatenate(doc), np.concatenate(ids)
                    gram, doc, ids, n, size = [], [], [], 0, 0
        if size:
            yield np.concatenate(gram), np.concatenate(doc), np.concatenate(ids)

    return count


def _repeating(batches):
    """Of rows sorted by (gram, n descending): (id, gram, count of the first two) of grams with two suffixes or more. A stream; it holds one row."""
    last, held = None, None
    for b in batches:
        gram, n = b.column("gram").to_numpy(), b.column("n").to_numpy()
        ids = b.column("id")
        null = ids.is_null().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy()
        known = n == 0
        out_id, out_gram, out_n = [ids[known]], [gram[known]], [np.zeros(known.sum(), np.int64)]
        go = np.flatnonzero(~known)
        if len(go):
            g, i, c, nul = gram[go], ids[go], n[go], null[go]
            if held is not None:
                g, i, c, nul = np.append(last, g), np.append(held[0], i), np.append(held[1], c), np.append(held[2], nul)
            same = np.append(False, g[1:] == g[:-1])
            repeat = same | np.append(g[1:] == g[:-1], False) | (c > 1)
            if held is not None and held[3]:
                repeat[0] = False  # given out before
                if len(g) > 1 and g[1] == g[0]:
                    repeat[1] = True
            out_id.append(i[repeat & ~nul])
            out_gram.append(g[repeat & ~nul])
            out_n.append(c[repeat & ~nul])
            done = bool(repeat[-1]) or (len(g) == 1 and held is not None and held[3])
            last, held = g[-1], (i[-1], c[-1], nul[-1], done)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_id, out_gram, out_n)], ["id", "gram", "n"])


def _suffixes(window: int, prefix: int, frequent):
    """Rows (key, id, start, length, before, offsets, words).

    Length 0: a suffix for the group of key, with start, the first of its words
    in the document; before, how many of them stand before the anchor; offsets,
    a bit for each window by how many words it has before the anchor. Else a
    span of starts that are known to repeat.
    """

    def rows(batches):
        long_ones = frequent.value
        held: list[tuple] = []
        size = 0
        for b in batches:
            own = b.column(0).to_numpy()
            grams = b.column(2)
            for lo, hi, w in W.chunks(b.column(1)):
                g, ok, place = _anchors(w, window, prefix)
                part = grams.slice(lo, hi - lo)
                known = part.flatten().to_numpy().view(np.uint64)
                doc = np.repeat(np.arange(hi - lo), part.value_lengths().fill_null(0).to_numpy())
                tie = lambda h, d: W.mix(h ^ W.mix(d.astype(np.uint64) + np.uint64(1)))
                go = np.flatnonzero(ok)
                go = go[np.isin(tie(g[place[go]], w.doc[go]), tie(known, doc))]
                if not len(go):
                    continue
                names = w.grams(window)[go]
                w.h = W.mix(w.h ^ np.uint64(0x6A09E667F3BCC909))
                held.append((names, w.grams(window)[go], own[lo:hi], go, place[go], g[place[go]], w))
                size += len(go)
                if size > 500_000:
                    yield from one_each(held, long_ones)
                    held, size = [], 0
        if held:
            yield from one_each(held, long_ones)

    def one_each(held, long_ones):
        """Of windows that are equal (128 bits of hashes) the earliest goes on."""
        size = np.array([len(x[0]) for x in held])
        one, two = (np.concatenate([x[j] for x in held]) for j in (0, 1))
        docs = np.concatenate([ids[w.doc[go]] for _, _, ids, go, _, _, w in held])
        start = np.concatenate([go - w.first[w.doc[go]] for _, _, _, go, _, _, w in held])
        order = np.lexsort((start, docs, two, one))
        same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
        again = np.zeros(len(one), bool)
        again[order[1:][same]] = True
        a, b, c = spans(docs[again], start[again])
        none, short = np.zeros(len(a), np.int32), np.zeros(len(a), np.int8)
        key = W.signed(W.mix(a.astype(np.uint64)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(key), pa.array(a), pa.array(b.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(short), pa.array(none), pa.array([""] * len(a), pa.string())],
            _COLUMNS,
        )
        for (_, _, ids, go, place, gram, w), lo, n in zip(held, np.cumsum(size) - size, size, strict=True):
            new = ~again[lo : lo + n]
            hot = new & np.isin(gram, long_ones)
            new &= ~hot
            yield from sent(ids, go[new], place[new], W.signed(gram[new]), w)
            yield from sent(ids, go[hot], go[hot], W.signed(W.mix(one[lo : lo + n][hot])), w)

    def sent(ids, go, place, key, w):
        """The windows of go as suffixes from their anchors on, one for each anchor."""
        if not len(go):
            return
        at = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        before = place - go
        bits = np.bitwise_or.reduceat(1 << before, at)
        most, least = np.maximum.reduceat(before, at), np.minimum.reduceat(before, at)
        first, last = place[at] - most, place[at] - least + window - 1
        a, size = w.start[first], w.end[last] - w.start[first]
        for cut in np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(size) >> 22)) + 1):
            n = size[cut]
            pick = np.repeat(a[cut] - np.cumsum(n) + n, n) + np.arange(n.sum())
            d = w.doc[first[cut]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key[at][cut]), pa.array(ids[d]), pa.array((first[cut] - w.first[d]).astype(np.int32)), pa.array(np.zeros(len(cut), np.int32)),
                    pa.array(most[cut].astype(np.int8)), pa.array(bits[cut].astype(np.int32)), W.binaries(w.data[pick], n).cast(pa.string()),
                ],
                _COLUMNS,
            )

    return rows


def spans(own: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, start, length) of runs of starts that follow each other."""
    order = np.lexsort((start, own))
    own, start = own[order], start[order]
    new = np.append(True, (own[1:] != own[:-1]) | (start[1:] > start[:-1] + 1)) if len(own) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(own)) - 1
    return own[at], start[at], start[last] - start[at] + 1


def _classes(columns: np.ndarray, *before: np.ndarray) -> np.ndarray:
    """The tree of rows of words: (depth + 1, rows), each row's node at each depth. before: what must be equal besides."""
    order = np.lexsort((*columns.T[::-1], *before))
    rows = columns[order]
    same = rows[1:] == rows[:-1]
    for x in before:
        same &= (x[order][1:] == x[order][:-1])[:, None]
    common = np.append(0, np.logical_and.accumulate(same, 1).sum(1))  # words that a suffix shares with the one before it
    apart = np.zeros(len(order), bool)
    apart[:1] = True
    for x in before:
        apart[1:] |= x[order][1:] != x[order][:-1]
    out = np.empty((columns.shape[1] + 1, len(order)), np.int64)
    for depth in range(columns.shape[1] + 1):
        out[depth, order] = np.cumsum(apart | (common < depth))
    return out


def _trees(window: int, prefix: int):
    """(id, start, length) of all leaves of each pair of nodes but the earliest, and of the spans known before. The rows come sorted by key."""
    wide = window - prefix

    def rows(batches):
        for t in _tables(W.groups(batches, ["key"])):
            known = t.column("length").to_numpy() > 0
            out = [tuple(t.column(c).to_numpy()[known] for c in ("id", "start", "length"))]
            t = t.filter(pa.array(~known))
            if t.num_rows:
                out += repeats(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["id", "start", "length"])

    def repeats(t):
        own, start, before = (t.column(c).to_numpy().astype(np.int64) for c in ("id", "start", "before"))
        bits = t.column("offsets").to_numpy()
        # words from the anchor on, and from the anchor backwards; 0 where the suffix was sent without
        on, back = np.zeros((t.num_rows, window), np.uint64), np.zeros((t.num_rows, wide), np.uint64)
        for lo, hi, w in W.chunks(t.column("words")):
            for target, place in ((on[lo:hi], np.arange(window)), (back[lo:hi], -1 - np.arange(wide))):
                at = w.first[:-1, None] + before[lo:hi, None] + place
                ok = (at >= w.first[:-1, None]) & (at < w.first[1:, None])
                target[ok] = w.h[at[ok]]
        _, group = np.unique(t.column("key").to_numpy(), return_inverse=True)
        stem = _classes(on[:, :prefix], group)[prefix]
        front, rear = _classes(on[:, prefix:], stem), _classes(back, stem)
        out = []
        for o in range(wide + 1):
            go = np.flatnonzero(bits & (1 << o))
            if not len(go):
                continue
            x, y = front[wide - o, go], rear[o, go]
            place = start[go] + before[go] - o
            order = np.lexsort((place, own[go], y, x))
            x, y = x[order], y[order]
            again = order[1:][(x[1:] == x[:-1]) & (y[1:] == y[:-1])]
            out.append((own[go][again], place[again].astype(np.int32), np.ones(len(again), np.int32)))
        return out

    return rows


def _tables(tables, rows: int = 50_000):
    """Tables put together until they have some rows."""
    held, size = [], 0
    for t in tables:
        held.append(t)
        size += t.num_rows
        if size >= rows:
            yield pa.concat_tables(held)
            held, size = [], 0
    if held:
        yield pa.concat_tables(held)


def _merged(batches):
    """(id, spans): start and length of each maximal span, as pairs of 32-bit numbers. The rows come sorted by (id, start)."""
    for t in W.groups(batches, ["id"]):
        own, start, length = (t.column(c).to_numpy() for c in ("id", "start", "length"))
        first = np.append(True, own[1:] != own[:-1])
        group = np.cumsum(first) - 1
        wide = int((start.astype(np.int64) + length).max()) + 2
        end = np.maximum.accumulate(group * wide + start + length)  # of all spans of the document so far
        new = first | np.append(True, group[1:] * wide + start[1:] > end[:-1])
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(own)) - 1
        pairs = np.stack([start[at], end[last] - group[last] * wide - start[at]], 1).astype(np.int32)
        n = np.bincount(group[at])
        yield pa.RecordBatch.from_arrays([pa.array(own[first]), W.binaries(pairs.ravel(), n * 2)], ["id", "spans"])


def _repeats(docs: DataFrame, window: int, prefix: int, store: Store) -> DataFrame:
    """(id, gram, n): the prefixes that have more than one suffix, with the documents that have them."""
    counted = docs.mapInArrow(_census(window, prefix), "part long, gram long, id long, n long")
    counted = counted.repartition("part").sortWithinPartitions("gram", F.desc("n"))
    return store.keep(counted.mapInArrow(_repeating, "id long, gram long, n long"))


def _found(docs: DataFrame, repeats: DataFrame, window: int, prefix: int, frequent, store: Store) -> DataFrame:
    known = repeats.groupBy("id").agg(F.collect_set("gram").alias("grams"))
    rows = docs.join(known, "id").select("id", "text", "grams").mapInArrow(_suffixes(window, prefix, frequent), _ROWS)
    again = rows.repartition("key").sortWithinPartitions("key").mapInArrow(_trees(window, prefix), "id long, start int, length int")
    return store.keep(again.repartition("id").sortWithinPartitions("id", "start").mapInArrow(_merged, "id long, spans binary"))


def repeated_spans(docs: DataFrame, window: int, prefix: int, group_rows: int, most_long: int, store: Store) -> DataFrame:
    """(id, spans) from (id, text) with ids that are unique and not null: the maximal repeats that have started earlier, as spans of window starts."""
    repeats = _repeats(docs, window, prefix, store)
    store.drop()  # of each step only the written table is left, not what it shuffled
    many = repeats.groupBy("gram").agg(F.count("*").alias("rows")).where(F.col("rows") > group_rows)
    many = many.orderBy(F.desc("rows"), "gram").limit(most_long).select("gram").toPandas()
    frequent = docs.sparkSession.sparkContext.broadcast(np.sort(many["gram"].to_numpy(np.int64).view(np.uint64)))
    found = _found(docs, repeats, window, prefix, frequent, store)
    store.drop(repeats)
    return found


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 20, prefix: int = 8, group_rows: int = 100_000, most_long: int = 100_000) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept) of every row of docs.

    A word goes if a window of `window` words over it has started before: in a
    smaller doc_id, or earlier in the same document. spans: (start, length) of
    the maximal runs of such windows' starts, in words. kept: the words left,
    joined by one space.

    Null and blank texts have no words. Rows with the same doc_id are ordered
    by a hash of their text; rows that are repeated whole are one document,
    and each gets its result. A null doc_id comes first. Further columns are
    ignored, whatever their names. Empty table: empty result.
    """
    if not prefix <= window <= prefix + 30:
        raise ValueError("a window has from 0 to 30 words more than a prefix")
    spark = docs.sparkSession
    store = Store(spark, "substring")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n, ids = rows.agg(F.count("*"), F.countDistinct("doc_id")).first()
    if n == ids:
        named = rows.select(F.col("doc_id").alias("id"), "doc_id", "text")
    else:
        key = F.xxhash64(F.coalesce("text", F.lit("")))
        one = rows.select("doc_id", key.alias("key")).distinct()
        order = one.repartitionByRange(F.col("doc_id").asc_nulls_first(), "key").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "key")
        order = store.keep(order.select("key", F.col("doc_id").alias("own"), F.monotonically_increasing_id().alias("id")))
        named = rows.withColumn("key", key).join(order, ["key"]).where(F.col("doc_id").eqNullSafe(F.col("own"))).select("id", "doc_id", "text")
    single = named.select("id", "text") if n == ids else named.dropDuplicates(["id"]).select("id", "text")
    found = repeated_spans(single, window, prefix, group_rows, most_long, store)

    def cut(batches):
        for b in batches:
            out = []
            for lo, hi, w in W.chunks(b.column(1), hashed=False):
                for i in range(hi - lo):
                    words = w.bytes_of(i).split()
                    raw = b.column(2)[lo + i]
                    pairs = np.frombuffer(raw.as_buffer(), np.int32).reshape(-1, 2) if raw.is_valid else np.zeros((0, 2), np.int32)
                    gone = np.zeros(len(words) + 1, np.int32)
                    np.add.at(gone, pairs[:, 0], 1)
                    np.add.at(gone, pairs[:, 0] + pairs[:, 1] + window - 1, -1)
                    gone = np.cumsum(gone[:-1]) > 0
                    removed = int(gone.sum())
                    kept = words if not removed else [x for x, g in zip(words, gone, strict=True) if not g]
                    out.append((b.column(0)[lo + i].as_py(), len(words), removed, [{"start": int(s), "length": int(n)} for s, n in pairs], b" ".join(kept)))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))), pa.array(cols[4], pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "spans", "kept"])

    return named.join(found, "id", "left").select("doc_id", "text", "spans").mapInArrow(cut, "doc_id long, n_words long, n_removed long, spans array<struct<start:int,length:int>>, kept string")

