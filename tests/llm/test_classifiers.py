"""Toxicity and quality: held-out accuracy, the counterfactual penalty, discriminants against the formula, edge cases."""

import zlib

import numpy as np
import pytest

MEDIUM = "/root/testdata/sf0.01"


def held_out(rows, labels, key):
    """(right among label 1, among label 0) of held-out rows."""
    out = {0: [], 1: []}
    for r in rows:
        if r.held_out and r.doc_id in labels:
            out[labels[r.doc_id]].append(r.predicted == labels[r.doc_id])
    return np.mean(out[1]), np.mean(out[0])


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}


def test_toxicity_query(spark, labels):
    from voicegauge.llm.queries import QUERIES

    rows = QUERIES["op2_toxicity"](spark, MEDIUM).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    toxic, clean = held_out(rows, {i: r.toxic for i, r in labels.items()}, "toxic")
    assert toxic >= 0.5 and clean >= 0.97  # few labels at this size
    again = QUERIES["op2_toxicity"](spark, MEDIUM).collect()
    assert {r.doc_id: r.score for r in rows} == pytest.approx({r.doc_id: r.score for r in again})


def test_quality_query(spark, labels):
    from voicegauge.llm.queries import QUERIES

    rows = QUERIES["op9_quality_classifier"](spark, MEDIUM).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    good, bad = held_out(rows, {i: r.quality for i, r in labels.items()}, "quality")
    assert good >= 0.9 and bad >= 0.9


def test_swapping_identity_terms():
    from voicegauge.llm.toxicity import swapped

    assert swapped(b"All Women, and old men") == [b"All men, and young women"]
    assert swapped(b"nothing here") == []
    assert swapped(b"jews and women") == [b"hindus and men", b"atheists and men", b"muslims and men", b"christians and men"]


def test_penalty_takes_weight_off_a_group(spark):
    """A group's name stands in most toxic rows; with the penalty its neutral mention scores lower."""
    from voicegauge.llm.toxicity import toxicity_scores

    filler = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta"]
    say = lambda i, extra: " ".join([filler[(i + k) % 8] for k in range(12)] + extra)
    docs = [(i, say(i, ["idiot"] * (i % 2) + ["muslims"] * (i % 10 != 1)), "en") for i in range(0, 60)] + [(i, say(i, ["christians"] * (i % 9 == 0)), "en") for i in range(60, 160)] + [(999, say(3, ["muslims"]), "en"), (998, say(3, []), "en")]
    labels = [(i, 1 if i < 60 else 0) for i in range(160)]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    free = {r.doc_id: r.score for r in toxicity_scores(d, lab, penalty=0.0).collect()}
    held = {r.doc_id: r.score for r in toxicity_scores(d, lab, penalty=100.0).collect()}
    assert held[999] < free[999] - 0.2 and abs(held[999] - held[998]) < abs(free[999] - free[998])


def test_gradient_of_the_training_step():
    from voicegauge.llm.toxicity import train

    rows = [(1, [0], [1.0], []), (0, [1], [1.0], []), (1, [0, 2], [1.0, 1.0], [([0, 1], [1.0, 1.0])]), (0, [1], [0.5], [])]
    w, b = train(rows, 3, 1e-3, 0.0, 600)
    assert w[0] > 1 and w[1] < -1
    tied, _ = train(rows, 3, 1e-3, 1000.0, 600)
    assert abs(tied[2] - tied[1]) < 0.2
    assert train([(1, [0], [1.0], [])], 3, 1e-3, 1.0, 10)[0].tolist() == [0, 0, 0]


def test_discriminant_against_the_formula():
    from voicegauge.llm.quality import solve

    r = np.random.default_rng(0)
    x = {0: r.normal(0, 2, (300, 3)), 1: r.normal(1, 1, (500, 3))}
    model = solve({c: (float(len(v)), v.sum(0), v.T @ v) for c, v in x.items()}, 0.1, 3)
    point = r.normal(0, 1, (5, 3))
    allx = np.concatenate([x[0], x[1]])
    z = lambda v: (v - allx.mean(0)) / allx.std(0)
    log = []
    for c in (0, 1):
        s = np.cov(z(x[c]).T, bias=True)
        s = 0.9 * s + 0.1 * np.trace(s) / 3 * np.eye(3) + 1e-6 * np.eye(3)
        d = z(point) - z(x[c]).mean(0)
        log.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) - 0.5 * np.linalg.slogdet(s)[1])
    assert model.score(point) == pytest.approx(1 / (1 + np.exp(-(log[1] - log[0] + np.log(500 / 300)))))


@pytest.mark.parametrize("name", ["toxicity", "quality"])
def test_edge_cases(spark, name):
    from voicegauge.llm.quality import quality_scores
    from voicegauge.llm.toxicity import toxicity_scores

    ask, label = (toxicity_scores, "toxic") if name == "toxicity" else (quality_scores, "quality")
    schema = "doc_id long, text string, score double, label int, id long, x string"
    rows = [(1, "a b", None, None, None, ""), (1, "a b", None, None, None, ""), (None, "c", None, None, None, ""), (2, None, None, None, None, ""), (3, "", None, None, None, ""), (4, " \n", None, None, None, ""), (5, "w " * 60000, None, None, None, "")]
    docs, none = spark.createDataFrame(rows, schema), spark.createDataFrame([], f"doc_id long, {label} int, id long")
    got = ask(docs, none).collect()
    assert len(got) == 7 and len({r.score for r in got}) == 1
    assert ask(spark.createDataFrame([], schema), none).count() == 0
    some = spark.createDataFrame([(1, 1, 5), (1, 0, 5), (5, 0, 5), (77, 1, 5), (2, None, 5), (None, 1, 5)], f"doc_id long, {label} int, id long")
    got = ask(docs, some).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)


def test_keep_good_keeps_all_columns(spark):
    from voicegauge.llm.quality import keep_good, quality_scores

    d, lab = (spark.read.parquet(f"{MEDIUM}/{t}.parquet") for t in ("documents", "labels"))
    kept = keep_good(d, lab)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality_scores(d, lab).where("score >= 0.3").collect()}


def _words(texts):
    import pyarrow as pa

    from voicegauge.llm import _words as W

    return [w for _, _, w in W.chunks(pa.array(texts), limit=1 << 30)][0]


TEXTS = ["Fools! Fools, \"fool\" (foolish) FOOLISHNESS said Zoë.", "", None, " \n", "a " * 50 + "idiots idiots", "one. two, three\n\nthree three\none. two,\n# 12 | x!", "Ein Wort.", "x", "ünïcödé ünïcödé\tÉTÉ\r\nlast."]


def test_toxicity_scores_by_plain_counting():
    """Words and their beginnings counted text by text, and the logistic of their weighted densities."""
    from voicegauge.llm.toxicity import PREFIXES, Model, features

    strings = {"fools": 1.5, "fool^": 2.0, "fooli^": -1.0, "idiots": 3.0, "three": -0.5, "ünï^": 0.7, "idio^": 0.2}
    code = {}
    for s in strings:  # a word's own feature comes first, then its beginnings by length
        size = len(s.rstrip("^").encode())
        own = features(_words([s.rstrip("^") + ("zzzz" if "^" in s else "")]))[1]
        code[s] = own[1 + PREFIXES.index(size) if "^" in s else 0]
    names = sorted(strings, key=lambda s: code[s])
    model = Model(np.array([code[s] for s in names], np.uint64), np.array([strings[s] for s in names]), -0.3)
    want = []
    for text in TEXTS:
        words = [w.strip(b".,!?;:\"'()[]|*%$#&") for w in (text or "").encode().split()]
        low = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words]
        logit = -0.3
        for s, weight in strings.items():
            bare = s.rstrip("^").encode()
            n = sum(w.startswith(bare) and len(w) > len(bare) if "^" in s else w == bare for w in low)
            logit += weight * min(n * 100 / (len(words) + 30), 2.0)
        want.append(1 / (1 + np.exp(-logit)))
    assert model.score(_words(TEXTS)) == pytest.approx(want)


def test_quality_statistics_by_plain_counting():
    from voicegauge.llm import quality

    got = quality.statistics(_words(TEXTS))
    for row, text in zip(got, TEXTS, strict=True):
        data = (text or "").encode()
        words = data.split()
        n, size = len(words), max(len(data), 1)
        if not n:
            assert not row.any()
            continue
        length = [len(w) for w in words]
        mean = (sum(length) + 100) / (n + 20)
        spread = max((sum(x * x for x in length) + 700) / (n + 20) - mean**2, 0) ** 0.5
        share = lambda chars, usual: ((sum(b in chars for b in data) + 200 * usual) / (size + 200)) ** 0.5  # noqa: B023, E731
        fresh = lambda x: (len(set(x)) + 20) / (len(x) + 20)
        lines = [tuple(x.split()) for x in data.split(b"\n") if x.split()]
        want = {
            "words": np.log1p(n), "word_length": np.log1p(mean), "length_spread": np.log1p(spread),
            **{k: share(v, {"upper": 0.02, "stop": 0.015, "comma": 0.01, "line": 0.004}.get(k, 0)) for k, v in quality._CLASSES.items()},
            "high": share(range(128, 256), 0), "distinct": 2 * np.log(fresh(words)), "distinct_pairs": 4 * np.log(fresh(list(zip(words, words[1:], strict=False)))),
            "distinct_lines": 4 * np.log(fresh(lines)), "short": ((sum(x <= 3 for x in length) + 7) / (n + 20)) ** 0.5,
            "long": ((sum(x >= 14 for x in length) + 0.6) / (n + 20)) ** 0.5, "end_stop": float(words[-1].endswith(b".")),
        }
        assert dict(zip(quality.NAMES, row, strict=True)) == pytest.approx(want)


def test_neutral_mentions_with_and_without_the_penalty(spark):
    """The share of neutral mentions of a group at 0.7 or more, learnt from labels in which the group stands mostly in toxic rows."""
    from voicegauge.llm.toxicity import toxicity_scores

    r = np.random.default_rng(7)
    filler = [f"word{i}" for i in range(60)]
    say = lambda *extra: " ".join(r.permutation([*r.choice(filler, 14), *extra]))
    insults = ["".join(r.choice(list("bcdfgklmnprstvz"), 9)) for _ in range(20)]
    toxic = lambda *extra: say(r.choice(insults), *extra)
    rows = [(toxic("muslims") if i % 10 else toxic(), 1) for i in range(240)] + [(say("christians") if i % 8 == 0 else say(), 0) for i in range(480)]
    neutral = [say("muslims") for _ in range(200)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate([*(t for t, _ in rows), *neutral])], "doc_id long, text string")
    lab = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    share, found = {}, {}
    for penalty in (0.0, 1.0, 30.0):
        got = {x.doc_id: x.score for x in toxicity_scores(d, lab, penalty=penalty).collect()}
        share[penalty] = np.mean([got[len(rows) + i] >= 0.7 for i in range(len(neutral))])
        found[penalty] = np.mean([got[i] >= 0.7 for i, (_, y) in enumerate(rows) if y])
    print("neutral mentions flagged", share, "toxic rows found", found)
    assert share[1.0] < share[0.0] and share[30.0] <= 0.02 and found[1.0] > 0.95 and found[30.0] > 0.95
