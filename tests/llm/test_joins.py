"""The n-gram Jaccard join and the substring dedup against brute force."""

import random
import re

import pytest

from tests.conftest import SMALL

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, n long"


def words(text):
    return WORD.findall((text or "").encode())


def shingles(text):
    ws = [w.lower() for w in words(text)]
    return frozenset(tuple(ws[i : i + 5]) for i in range(len(ws) - 4)) if len(ws) >= 5 else frozenset([tuple(ws)] if ws else [])


def components(rows):
    """{doc_id: (size, least reachable doc_id)} by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def family(seed, bases=4, copies=14, size=60, edits=6):
    """Groups of near copies around the threshold, some exact copies, and a passage that all share."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh", k=4))
    passage = [word() for _ in range(25)]
    out = []
    for _ in range(bases):
        base = [word() for _ in range(size)]
        for k in range(copies):
            own = list(base)
            for _ in range(r.randint(0, edits) if k else 0):
                own[r.randrange(len(own))] = word()
            out.append(" ".join(own + (passage if k % 3 == 0 else [])))
    out += out[:3] + ["one two", "ONE\ttwo", "", None, " \n ", "a b c d e", "a b c d e f"]
    return list(enumerate(out))


@pytest.mark.parametrize(("seed", "block", "chunk"), [(1, 4_000_000, 2_000_000), (2, 200, 900), (3, 600, 1)])
def test_join_is_exact(spark, seed, block, chunk):
    """Also with clusters of many blocks, and with chunks of a few sets or one."""
    from voicegauge.llm.ngram_join import ngram_jaccard_join

    rows = family(seed)
    df = spark.createDataFrame([(i, t, "en", 0) for i, t in rows], DOCS).repartition(3)
    got = ngram_jaccard_join(df, block=block, chunk=chunk).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components(rows)


def test_large_family_near_the_threshold(spark):
    """2,000 copies of one text, edited so that most pairs are just under the threshold; in one cluster of several blocks."""
    from voicegauge.llm.ngram_join import ngram_jaccard_join

    r = random.Random(11)
    base = [f"w{i}" for i in range(104)]
    rows = []
    for i in range(2000):
        own = list(base)
        for k in r.sample(range(6, 98, 6), 2):
            own[k] = f"e{r.randrange(10**9)}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame([(i, t, "en", 0) for i, t in rows], DOCS).repartition(4)
    sets = {i: shingles(t) for i, t in rows}
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    links = set()
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                links.add((a, b))
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    want = {i: find(i) for i in range(len(rows))}
    assert 100 < len(set(want.values())) < 2000
    assert {x.doc_id: x.component_id for x in ngram_jaccard_join(df, block=30_000).collect()} == want
    found = [(x.class_a, x.class_b) for x in ngram_jaccard_join(df, block=30_000, links=True).collect()]
    assert len(found) == len(links) and set(found) == links


def test_join_edge_cases(spark):
    from voicegauge.llm.ngram_join import ngram_jaccard_join

    schema = "doc_id long, text string, component_id long, fp string, id string, n long, a long"
    assert ngram_jaccard_join(spark.createDataFrame([], schema)).count() == 0
    rows = [(7, "a b c d e f", 1, "", "", 1, 1), (7, "a b c d e f", 1, "", "", 1, 1), (9, "A B C D E F", 1, "", "", 1, 1), (None, "a b c d e f", 1, "", "", 1, 1), (None, "q", 1, "", "", 1, 1), (3, None, None, None, None, None, None), (4, "w " * 30000, 1, "", "", 1, 1)]
    got = sorted(((r.doc_id or -1), r.n_shingles, r.component_id or -1) for r in ngram_jaccard_join(spark.createDataFrame(rows, schema)).collect())
    assert got == [(-1, 1, -1), (-1, 2, 7), (3, 0, 3), (4, 1, 4), (7, 2, 7), (7, 2, 7), (9, 2, 7)]


def test_links_are_all_and_true(spark):
    from voicegauge.llm.ngram_join import ngram_jaccard_join

    rows = dict(family(5))
    df = spark.createDataFrame([(i, t, "en", 0) for i, t in rows.items()], DOCS)
    found = {}
    for r in ngram_jaccard_join(df, links=True).collect():
        a, b = shingles(rows[r.class_a]), shingles(rows[r.class_b])
        assert (r.common, r.total) == (len(a & b), len(a | b)) and 100 * r.common >= 75 * r.total
        found[r.class_a, r.class_b] = r.common
    first = {shingles(t): i for i, t in sorted(rows.items(), reverse=True) if shingles(t)}
    pairs = [(i, j) for a, i in first.items() for b, j in first.items() if i < j and 100 * len(a & b) >= 75 * len(a | b)]
    assert sorted(found) == sorted(pairs)


def removed(rows, window=20):
    """{doc_id: (words, words removed, words kept)} by looking at every window in order."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        ws = words(t)
        gone = [False] * len(ws)
        for j in range(len(ws) - window + 1):
            key = tuple(ws[j : j + window])
            if key in seen:
                gone[j : j + window] = [True] * window
            seen.add(key)
        out[i] = (len(ws), sum(gone), b" ".join(w for w, g in zip(ws, gone, strict=True) if not g).decode())
    return out


def repeats(seed, n=60):
    r = random.Random(seed)
    passages = [[str(r.randrange(50)) for _ in range(r.randint(18, 45))] for _ in range(6)]
    docs = []
    for _ in range(n):
        body = []
        for _ in range(r.randint(0, 4)):
            p = r.choice(passages)
            a = r.randint(0, 8)
            body += [str(r.randrange(1000)) for _ in range(r.randint(0, 30))] + p[a : len(p) - r.randint(0, 5)]
        docs.append(r.choice([" ", "\n", "\t "]).join(body))
    docs += [docs[0], docs[3], "x " * 300, "x " * 25, "", None, "short text", "y z " * 15]
    return list(enumerate(docs))


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_is_exact(spark, seed):
    from voicegauge.llm.substring import substring_dedup

    rows = repeats(seed)
    got = substring_dedup(spark.createDataFrame([(i, t, "en", 0) for i, t in rows], DOCS).repartition(4), group_rows=3 if seed == 1 else 100_000).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == removed(rows)


def test_subtrees_compare_words(spark):
    """A head with 3,000 continuations, and every group under one key: equal keys don't make equal windows."""
    import numpy as np
    import pyarrow as pa

    from voicegauge.llm import substring as s
    from voicegauge.llm.decontaminate import W

    r = random.Random(5)
    head = [f"h{i}" for i in range(8)]
    tails = [[f"{a}{r.randrange(9)}" for a in "abcdefghijkl"] for _ in range(8)]
    docs = []
    for i in range(3000):
        tail = list(r.choice(tails))
        tail[r.randrange(12)] = f"x{r.randrange(900)}"
        docs.append((i, " ".join([f"p{r.randrange(4)}", *head, *tail, f"q{r.randrange(4)}"])))
    texts = pa.array([t for _, t in docs])
    grams = []
    for lo, hi, w in W.chunks(texts):
        grams += [W.signed(s._anchors(w, 20, 8)[0][w.first[i] : w.first[i + 1]]) for i in range(hi - lo)]

    class Frequent:
        value = np.zeros(0, np.uint64)

    for n in (3000, 500):  # one task's rows, and of tasks of 500 documents
        sent = []
        for lo in range(0, len(docs), n):
            ids = pa.array(range(lo, min(lo + n, len(docs))), pa.int64())
            known = pa.array(grams[lo : lo + n], pa.list_(pa.int64()))
            batch = pa.RecordBatch.from_arrays([ids, texts.slice(lo, n), known], ["id", "text", "grams"])
            sent += list(s._suffixes(20, 8, Frequent)(iter([batch])))
        t = pa.Table.from_batches(sent)
        t = t.set_column(0, "key", pa.array(np.zeros(t.num_rows, np.int64)))
        gone = {i: set() for i, _ in docs}
        for b in s._trees(20, 8)(iter(t.to_batches())):
            for i, a, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                gone[i] |= set(range(a, a + size + 19))
        assert {i: len(x) for i, x in gone.items()} == {i: k for i, (_, k, _) in removed(docs).items()}


def test_substring_edge_cases(spark):
    from voicegauge.llm.substring import substring_dedup

    schema = "doc_id long, text string, spans string, id long, kept string"
    assert substring_dedup(spark.createDataFrame([], schema)).count() == 0
    text = " ".join(map(str, range(30)))
    rows = [(5, text, "", 1, ""), (5, text, "", 1, ""), (5, "z " + text, "", 1, ""), (None, text, "", 1, ""), (1, None, None, None, None), (9, "é " * 20000, "", 1, "")]
    got = [(r.doc_id, r.n_words, r.n_removed) for r in substring_dedup(spark.createDataFrame(rows, schema)).collect()]
    assert sorted(got, key=repr) == sorted([(5, 30, 30), (5, 30, 30), (5, 31, 30), (None, 30, 0), (1, 0, 0), (9, 20000, 19999)], key=repr)


def test_queries_on_the_small_tables(spark):
    from voicegauge.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op1_ngram_jaccard_join"](spark, SMALL).collect()}
    assert got == components(rows)
    import hashlib

    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op6_substring_dedup"](spark, SMALL).collect()}
    assert got == {i: (n, k, hashlib.sha256(t.encode()).hexdigest()) for i, (n, k, t) in removed(rows).items()}
