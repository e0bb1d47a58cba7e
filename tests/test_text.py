"""Text measures, checks, alignment and recovery of model output."""

import difflib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voicegauge.functions import kernels as K
from voicegauge.functions import text as T
from voicegauge.operators import constraints, contrasts, overlap, sweep


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


@pytest.mark.parametrize(("text", "want"), [
    ("Dr. Smith left. He ran!", ["Dr. Smith left.", "He ran!"]), ("It is 3.14 now. Yes.", ["It is 3.14 now.", "Yes."]), ("Arthur C. Clarke wrote it.", ["Arthur C. Clarke wrote it."]),
    ('He said "go." Then left', ['He said "go."', "Then left"]), ("In 1948. It ended", ["In 1948.", "It ended"]), ("u.s.a is one", ["u.s.a is one"]), ("", []), ("  ", []), ("no end", ["no end"]), ("What?! Yes…", ["What?!", "Yes..."]),
])
def test_sentences(text, want):
    assert K.split_sentences(text) == want


def test_words_and_stems(spark):
    assert one(spark, T.words(F.col("x")), x="Australia’s 3.14 isn't 40,000 x_y") == ["Australia's", "3.14", "isn't", "40,000", "x", "y"]
    assert one(spark, T.content_tokens(F.col("x")), x="The exploring of Australia's cities explored") == ["explor", "australia", "citi", "explor"]
    assert one(spark, T.syllables(F.col("x")), x="beautiful") == 4 and one(spark, T.syllables(F.col("x")), x="the") == 1


@pytest.mark.parametrize(("token", "want"), [
    ("1990", ["one thousand nine hundred ninety", "nineteen ninety", "one nine nine zero", "one thousand nine hundred and ninety"]), ("40,000", ["forty point zero zero zero"]), ("12345", ["12345", "one two three four five"]), ("7", ["seven"]),
    ("1905", ["one thousand nine hundred five", "nineteen o five", "one nine zero five", "one thousand nine hundred and five"]), ("x", []),
])
def test_number_readings(token, want):
    assert [" ".join(r) for r in K.number_readings(token)] == want


WORDS = st.lists(st.sampled_from("abcd"), max_size=8)


@settings(max_examples=200, deadline=None)
@given(WORDS, WORDS)
def test_alignment_costs_the_edit_distance(a, b):
    s, d, i, n = K.alignment(a, b)
    table = [[max(x, y) if not x or not y else 0 for y in range(len(b) + 1)] for x in range(len(a) + 1)]
    for x in range(1, len(a) + 1):
        for y in range(1, len(b) + 1):
            table[x][y] = min(table[x - 1][y] + 1, table[x][y - 1] + 1, table[x - 1][y - 1] + (a[x - 1] != b[y - 1]))
    assert s + d + i == table[-1][-1] and len(b) - len(a) == i - d and n == len(a)


def test_error_rates(spark):
    df = spark.createDataFrame([("1", "the cat sat on the mat", "the cat sat on a mat"), ("2", "in 1990", "in nineteen ninety"), ("3", "", "x"), ("4", "", "")], "item string, r string, h string")
    got = {r.item: (r.wer, r.substitutions) for r in overlap.word_errors(df, "r", "h").collect()}
    assert got["1"] == (pytest.approx(1 / 6), 1) and got["2"][0] == 0 and got["3"][0] == float("inf") and got["4"][0] == 0
    assert one(spark, sweep.simple_wer(F.col("a"), F.col("b")), a="the cat sat", b="the dog sat down") == 0.667
    assert one(spark, overlap.character_error_rate(F.col("a"), F.col("b")), a="abc", b="abd") == pytest.approx(1 / 3)


def test_overlap_measures(spark):
    p, r = T.answer_tokens(F.col("p")), T.answer_tokens(F.col("r"))
    s = one(spark, overlap.token_scores(p, r), p="The capital is Paris, France", r="Paris France")
    assert s.presence == 1 and s.recall == 1 and s.precision == pytest.approx(0.5) and s.exact == 0
    assert one(spark, overlap.token_scores(p, r), p="", r="").f1 == 1.0
    assert one(spark, overlap.rouge_n(p, r, 2), p="x y z", r="y z w") == pytest.approx(0.5)
    assert one(spark, overlap.rouge_l(p, r), p="x y z", r="x z") == pytest.approx((1 + 1.44) * (2 / 3) * 1 / (1 + 1.44 * 2 / 3))
    refs = spark.createDataFrame([("i", "it is Paris", ["Rome", "paris"])], "item string, p string, refs array<string>")
    assert overlap.reference_scores(refs, "p", "refs").first().answer_presence == 1.0


@settings(max_examples=60, deadline=None)
@given(WORDS, WORDS)
def test_common_subsequence(a, b):
    import pandas as pd

    got = K.common_subsequence.func(pd.Series([a]), pd.Series([b]))[0]
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert got == table[-1][-1]
    assert got >= sum(m.size for m in difflib.SequenceMatcher(None, a, b, False).get_matching_blocks())


CHECKS = [{"type": t} for t in constraints.CHECKS if t not in ("max_total_words",)]


def evaluated(spark, text, checks, **more):
    row = {"item": "i", "text": text, "category": "general", "must_include": [], "must_forbid": []} | more
    df = spark.createDataFrame([tuple(row.values())], "item string, text string, category string, must_include array<string>, must_forbid array<string>")
    return {r.check_id: r for r in constraints.evaluate(df, checks, {"max_tokens": 10}).collect()}


def test_every_check_type(spark):
    got = evaluated(spark, "It is Paris. The capital of France is in the north.", CHECKS, must_include=["paris"], must_forbid=["rome"])
    assert all(r.strict for r in got.values()) and got["must_include"].applicable
    bad = evaluated(spark, "Well this is a very long opening sentence, that goes on? and", CHECKS, must_include=["rome"], must_forbid=["long"])
    failed = {k for k, r in bad.items() if not r.strict}
    assert failed == {"opening_sentence_max_words", "opening_sentence_terminator", "no_question", "response_complete", "not_truncated_at_cap", "must_include", "must_forbid"}
    none = evaluated(spark, "Yes.", CHECKS)
    assert not none["must_include"].applicable and none["must_include"].strict


def test_scope_and_loose_verdict(spark):
    checks = [{"id": "a", "type": "no_question", "skip_for": ["general"]}, {"id": "b", "type": "non_empty", "applies_to": ["crisis"]}, {"id": "c", "type": "language_marker_ratio", "min_response_words": 8}, {"id": "d", "type": "opening_sentence_max_words"}]
    got = evaluated(spark, "Answer: it is a fine day. Yes.", checks)
    assert not any(got[x].applicable for x in "abc") and not got["d"].strict and got["d"].loose
    with pytest.raises(ValueError):
        evaluated(spark, "x", [{"type": "none such"}])


def test_item_without_hard_checks_passes_and_has_no_rate(spark):
    df = spark.createDataFrame([("i", "c", "soft", True, False, False, None)], "item string, check_id string, severity string, applicable boolean, strict boolean, loose boolean, reason string")
    got = constraints.item_verdicts(df).first()
    assert got.pass_strict and got.rate_strict is None and constraints.check_rates(df).first().rate_strict == 0


def test_model_tags_and_recognisers(spark):
    tag = one(spark, contrasts.parse_model_tag(F.col("x")), x="llama3.1:8b-instruct-q4_K_M")
    assert tuple(tag) == ("llama3.1", "8b", 8.0, "instruct", "q4_K_M", 4)
    assert tuple(one(spark, contrasts.parse_model_tag(F.col("x")), x="phi3")) == ("phi3", "", 0.0, "", "", 0)
    assert one(spark, contrasts.parse_model_tag(F.col("x")), x="smol:500m").size_b == 0.5
    got = one(spark, contrasts.recognizer_fields(F.col("c")), c={"stt_engine": "vosk", "vosk_model": "models/vosk-model-small-en-us-0.15"})
    assert tuple(got) == ("small-en-us-0.15", "cpu", "")
    assert one(spark, contrasts.recognizer(F.lit("vosk"), F.lit("small"), F.lit("cpu"), F.col("x")), x="") == "vosk-small-cpu"


def test_rouge_l_over_every_document(spark):
    from tests.conftest import SMALL
    from voicegauge.plans import load_all

    def lcs(x, y):
        old = [0] * (len(y) + 1)
        for w in x:
            new = [0]
            for j, v in enumerate(y):
                new.append(old[j] + 1 if v == w else max(old[j + 1], new[j]))
            old = new
        return old[-1]

    tokens = lambda name, key: {r[0]: r[1] or [] for r in spark.read.parquet(f"{SMALL}/{name}.parquet").select(key, T.answer_tokens(F.col("text"))).collect()}
    docs, items = tokens("documents", "doc_id"), tokens("benchmark", "item_id")
    got = {r.doc_id: (r.item_id, r.rouge_l) for r in load_all()[0]["q29_rouge_l"](spark, SMALL).collect()}
    assert set(got) == set(docs)
    for i, p in docs.items():
        r = items[i % len(items)]
        n = lcs(p, r)
        want = 2.44 * (n / len(p)) * (n / len(r)) / (n / len(r) + 1.44 * n / len(p)) if n else 0.0
        assert got[i] == (i % len(items), pytest.approx(want, abs=6e-5))


@pytest.mark.parametrize(("text", "want"), [
    ('Sure: {"score": 4} ok', 4), ("```json\n{'score': 3,}\n```", 3), ("score 9, or 2", 2), ("none", None), ('{"score": "5/5"}', 5), ('{"score": 99} maybe 4', 4), ('{"a": {"b": "}"}} {"score": 2}', 2), ("", None),
])
def test_scores_out_of_model_output(text, want):
    assert K.score_of(text, 1, 5) == want


def test_scores_out_of_whole_documents(spark):
    from tests.conftest import SMALL
    from voicegauge.plans import load_all

    got = {r.doc_id: r.score for r in load_all()[0]["q49_json_recovery"](spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "n_chars").collect()
    assert set(got) == {r.doc_id for r in docs}
    for r in docs:
        n, form = r.n_chars % 7, r.doc_id % 4
        assert "{" not in r.text and "```" not in r.text
        tail = f"{n} 5" if form == 2 else f"{n}" if form < 2 else ""
        numbers = [int(x) for x in re.findall(r"-?[0-9]+", f"{r.text} {tail}")]
        assert got[r.doc_id] == (n if form < 2 and 1 <= n <= 5 else next((x for x in numbers if 1 <= x <= 5), None))
    body = "He wrote {once, it's \"so\" and 'left'. ``` It was 9 } of " + "7" * 5000 + " things. " * 50
    assert K.score_of(body + '{"score": 4}', 1, 5) == 4 and K.score_of(body + "or 3", 1, 5) == 3


def test_sweep_scores(spark):
    seg = "array<struct<at_s:double,flush:boolean,text:string,n_words:long,last_word_end_s:double>>"
    rows = [("cut", [(1.0, False, "a b", 2, 0.8), (3.0, False, "c", 1, 2.5)], 2.0), ("ok", [(2.6, False, "a", 1, 2.0), (3.0, True, "", 0, None)], 2.0), ("never", [(3.0, True, "x", 1, 2.0)], None)]
    got = {r.file: r for r in sweep.score_segments(spark.createDataFrame(rows, f"file string, segments {seg}, speech_end_s double")).collect()}
    assert got["cut"].acoustic_cut and got["cut"].words_at_first_cut == 2 and got["cut"].asr_split and got["cut"].endpoint_delay_ms == 500
    assert not got["ok"].acoustic_cut and got["ok"].endpoint_delay_ms == 600 and not got["never"].endpointer_fired
    assert one(spark, sweep.parse_schedule(F.col("x")), x="500/600/600") == [500, 600, 600] and one(spark, sweep.schedule_label(sweep.parse_schedule(F.col("x"))), x="600") == "600"
    assert one(spark, sweep.coverage(F.col("a"), F.col("b")), a=1.0, b=0.0) == 0


def test_folding_before_measuring(spark):
    """Compatibility forms count as what they stand for; texts in ASCII never reach the kernel."""
    from pyspark.sql import functions as F

    from voicegauge.functions import text as T
    from voicegauge.operators import constraints, overlap

    rows = [(1, "ﬁne １２３ 10½"), (2, "plain 7"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r.id: r.w for r in df.select("id", T.words(T.folded(F.col("text"))).alias("w")).collect()}
    assert got[1] == ["fine", "123", "101", "2"] and got[2] == ["plain", "7"] and got[3] is None and got[4] == []
    items = df.where("id = 1").select(F.col("id").cast("string").alias("item"), "text", F.lit("x").alias("category"), F.array().cast("array<string>").alias("must_include"), F.array().cast("array<string>").alias("must_forbid"))
    check = [{"type": "max_total_words", "params": {"max_words": 3}}]
    assert constraints.evaluate(items, check).first().strict is False
    pair = spark.createDataFrame([("i", "ﬁne day", "fine day")], "item string, a string, b string")
    assert overlap.word_errors(pair, "a", "b").first().wer == 0 and overlap.coverage(pair, "a", "b").first().coverage == 1


def test_json_recovery_takes_the_first_object():
    from voicegauge.functions import kernels as K

    cases = {
        '{"score": 4}': {"score": 4}, "Here:\n```json\n{'score': 2, 'reason': 'vague'}\n```": {"score": 2, "reason": "vague"}, "Sure! {'score': 5, 'reason': 'fine'} Bye.": {"score": 5, "reason": "fine"},
        '{"score": 3, "list": [1, 2,],}': {"score": 3, "list": [1, 2]}, '{"a": "text with } brace", "b": 1}': {"a": "text with } brace", "b": 1},
        '{bad {"a":1}}': None, "no json": None, "": None, None: None, '{"a": "open': None, "[1, 2]": None, "it's {'k': 'v'} isn't it": {"k": "v"},
    }
    for text, want in cases.items():
        assert K.json_object(text) == want, text


def test_alignment_against_the_table():
    import random

    from voicegauge.functions import kernels as K

    r = random.Random(6)
    for _ in range(300):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 8))] for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
        s, d, n, size = K.alignment(a, b)
        assert s + d + n == row[-1] and size == len(a) and len(a) - d + n == len(b)


@pytest.mark.parametrize(("text", "want"), [
    ("Dr. Who met A. B. Smith. He left!", ["Dr. Who met A. B. Smith.", "He left!"]), ("It is 3.5 or 10. Next", ["It is 3.5 or 10.", "Next"]), ('He said "nay." (Yes?) etc. and so on', ['He said "nay."', "(Yes?)", "etc. and so on"]),
    ("e.g. this, i.e. that. U.S. law", ["e.g. this, i.e. that.", "U.S. law"]), ("Wait... what?! ok", ["Wait...", "what?!", "ok"]), ("", []), ("  \n ", []),
])
def test_sentences(text, want):
    from voicegauge.functions import kernels as K

    assert K.split_sentences(text) == want
