"""Every query with a SQL twin gives the twin's rows; the others give rows."""

import unicodedata

import pytest
import regex

from tests.compare import same
from tests.conftest import SMALL
from voicegauge.plans import load_all

QUERIES, ORACLE = load_all()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twin(spark, duck, name):
    same(QUERIES[name](spark, SMALL), duck.sql(ORACLE[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


# ---- queries that SQL can't express, against plain versions over the whole small tables


def rows_of(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet").collect()


def pairs_of(spark):
    c = {(r.conv_id, r.turn): r for r in rows_of(spark, "conversations")}
    for (i, t), r in c.items():
        if r.role == "user" and (i, t + 1) in c and c[(i, t + 1)].role == "assistant":
            yield f"{i}:{t + 1}", r.text, c[(i, t + 1)].text


def word_list(text):
    text = unicodedata.normalize("NFKC", text).translate(str.maketrans("’‘“”–—", "''\"\"--"))
    return regex.findall(r"[0-9]+(?:[.,][0-9]+)*|\p{L}+(?:['’]\p{L}+)*", text)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
    return row[-1]


def test_rouge_l_by_the_table(spark):
    tokens = lambda t: [w for w in (x.lower().replace("'", "").replace("’", "") for x in word_list(t)) if w and w not in ("a", "an", "the")]
    items = {r.item_id: tokens(r.text) for r in rows_of(spark, "benchmark")}
    docs = {r.doc_id: tokens(r.text) for r in rows_of(spark, "documents") if r.n_chars < 3000}
    got = {(r.doc_id, r.item_id): r.rouge_l for r in QUERIES["q29_rouge_l"](spark, SMALL).collect()}
    assert len(got) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for (doc, item), score in got.items():
        if doc in docs:
            a, b = items[item], docs[doc]
            row = [0] * (len(b) + 1)
            for x in a:
                last, row = row, [0]
                for j, y in enumerate(b, 1):
                    row.append(last[j - 1] + 1 if x == y else max(last[j], row[-1]))
            recall, precision = row[-1] / max(len(a), 1), row[-1] / max(len(b), 1)
            want = 2.44 * precision * recall / (recall + 1.44 * precision) if row[-1] else 0.0
            assert score == pytest.approx(want, abs=1e-4), (doc, item)


def test_word_errors_by_the_table(spark):
    from voicegauge.functions.kernels import reference_variants

    tokens = lambda t: [x.lower().replace("'", "").replace("’", "") for x in word_list(t)]
    got = {r.item: r for r in QUERIES["q31_wer_alignment"](spark, SMALL).collect()}
    errors = n = 0
    for item, question, _ in pairs_of(spark):
        heard = regex.sub(r"\bthe\b", "a", regex.sub(r"\b\p{L}{2}\b", "", question))
        best = min(((distance(v, tokens(heard)), len(v)) for v in reference_variants(tokens(question))), key=lambda x: x[0])
        r = got[item]
        assert r.substitutions + r.deletions + r.insertions == best[0] and r.wer == pytest.approx(best[0] / best[1], abs=1e-4)
        errors, n = errors + best[0], n + best[1]
    assert got["(corpus)"].wer == pytest.approx(errors / n, abs=1e-4)
    strata = {r.stratum: r for r in QUERIES["q32_strata"](spark, SMALL).collect()}
    rates = [r.wer for i, r in got.items() if i != "(corpus)"]
    assert {s: r.n for s, r in strata.items()} == {s: k for s, k in (("clean", sum(w == 0 for w in rates)), ("mild", sum(0 < w <= 1 / 3 for w in rates)), ("severe", sum(w > 1 / 3 for w in rates))) if k}


def test_simple_word_errors(spark):
    tokens = lambda t: "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789' " else " " for c in t.lower()).split()
    got = {r.item: r.wer for r in QUERIES["q53_simple_wer"](spark, SMALL).collect()}
    for item, question, _ in pairs_of(spark):
        a, b = tokens(question), tokens(regex.sub(r"\bthe\b", "a", question))
        assert got[item] == pytest.approx(distance(a, b) / len(a) if a else 1.0, abs=5e-4)


def test_recovered_scores(spark):
    got = {r.doc_id: r.score for r in QUERIES["q49_json_recovery"](spark, SMALL).collect()}
    for r in rows_of(spark, "documents"):
        n, form = r.n_chars % 7, r.doc_id % 4
        if "{" in r.text or "```" in r.text:
            continue
        said = [r.text, ('{"score": %d}' % n, "{'score': %d,}" % n, "score %d of 5" % n, "none")[form]]
        numbers = [float(x) for x in regex.findall(r"-?[0-9]+", " ".join(said))]
        want = n if form < 2 and 1 <= n <= 5 else next((x for x in numbers if 1 <= x <= 5), None)
        assert got[r.doc_id] == want, r.doc_id


def test_response_measures_and_chunks(spark):
    measures = {r.item: r for r in QUERIES["q51_response_measures"](spark, SMALL).collect()}
    checks = {(r.item, r.check_id): r for r in QUERIES["q24_sentence_checks"](spark, SMALL).collect()}
    chunks = {}
    for r in QUERIES["q48_text_chunker"](spark, SMALL).collect():
        chunks.setdefault(r.item, {})[r.chunk_no] = r.chunk
    for item, _, text in pairs_of(spark):
        m, n = measures[item], len(word_list(text))
        assert m.word_count == n and m.char_count == len(text) and m.estimated_spoken_seconds == pytest.approx(n / 2.5, abs=0.01)
        assert checks[(item, "total")].strict == (1 <= m.sentence_count <= 3) and checks[(item, "opener")].strict == (m.sentence_count > 0 and m.opening_words <= 5)
        assert checks[(item, "detail")].strict == (max(m.sentence_count - 1, 0) <= 2)
        own = [c for _, c in sorted(chunks.get(item, {}).items())]
        said = lambda t: "".join(c for c in t if c.isalnum())
        assert said("".join(own)) == said(text) and all(any(map(str.isalnum, c)) for c in own)
