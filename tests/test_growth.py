"""Steps whose cost must grow with their input only: results by plain versions, and plans without what grew faster."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from voicegauge.operators import contrasts, pairing, sweep
from voicegauge.plans import load_all
from voicegauge.sources import models

QUERIES = load_all()[0]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_contrast_groups_carry_no_sets_of_a_group(spark):
    runs = [("a", 1, "m:1b-q8_0", "r"), ("b", 2, "m:1b-q4_0", "r"), ("c", 3, "m:1b-q8_0", None), ("d", 4, "m:1b-q8_0", "s")]
    edges = contrasts.contrast_edges(contrasts.identify(spark.createDataFrame([(r, o, t, 0.0, 1, v) for r, o, t, v in runs], "run string, ord int, model_tag string, temperature double, seed int, recognizer string")))
    got = {(e.kind, e.group_id, e.baseline, e.contrast) for e in edges.collect()}
    assert ("quantization", "m_1b_t0/s1_r", "a", "b") in got and ("cross_model", "at_t0/s1_r", "a", "b") in got
    assert {e[2:] for e in got if e[0] == "recognizer"} == {("a", "c"), ("a", "d")}
    assert "collect_set" not in plan_of(edges)


def test_contrast_groups_are_one_pass_a_kind(spark):
    """Identities are made once, whatever the number of kinds, and a kind's groups are put in order once."""
    plan = QUERIES["q37_contrast_groups"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.lstrip(" :+-").startswith("Window ") for line in plan.splitlines()) == len(contrasts.KINDS)
    assert "regexp_extract" not in plan and "parquet" not in plan


def test_shared_inputs_carry_no_sets_of_a_group(spark):
    assert "collect_set" not in plan_of(QUERIES["q38_shared_inputs"](spark, SMALL))


def test_means_of_spans_cost_no_pairs(spark):
    rng = random.Random(7)
    values = [1.5, 2.25, -3.0, None, float("nan"), float("inf"), float("-inf")]
    samples = [(g, t, rng.choice(values[:3] if g == "plain" else values)) for g in ("plain", "odd") for t in [0, *(rng.randrange(400) for _ in range(60))] for _ in range(2)]
    spans = [(g, str(i), a, a + rng.randrange(1, 90)) for g in ("plain", "odd") for i in range(80) for a in [rng.randrange(-20, 440)]]
    s, p = spark.createDataFrame(samples, "series string, at long, value double").repartition(5), spark.createDataFrame(spans, "series string, span string, start long, end long")
    means = pairing.overlap_means(s, p, 25)
    got = {(r.series, r.span): r["mean"] for r in means.collect()}
    assert len(got) == len(spans)
    for g, name, a, b in spans:
        rank = lambda v: (v is None, v is not None and math.isnan(v), 0 if v is None or math.isnan(v) else v)
        own = sorted(((t, v) for h, t, v in samples if h == g), key=lambda x: (x[0], rank(x[1])))
        held = [(min(t, b) - max(o, a), v) for (o, _), (t, v) in zip(own, own[1:]) if o < b and t > a and min(t, b) > max(o, a)]
        known = [(w, v) for w, v in held if v is not None]
        want = sum(w * v for w, v in known) / sum(w for w, _ in held) if known and own[0][0] <= a else None
        assert got[g, name] == (None if want is None else pytest.approx(want, nan_ok=True)), (g, name, a, b)
    # many spans over many samples in one bucket: pairs would be 4 * 10 ** 8
    n = 20_000
    s = spark.range(n).select(F.lit("g").alias("series"), F.col("id").alias("at"), F.lit(2.0).alias("value"))
    p = spark.range(n).select(F.lit("g").alias("series"), F.col("id").cast("string").alias("span"), F.lit(0).cast("long").alias("start"), (F.col("id") + 1).alias("end"))
    assert pairing.overlap_means(s, p).where("mean = 2.0").count() == n


def test_simple_word_errors_of_many_words(spark):
    said = [f"w{i}" for i in range(600)]
    pair = spark.createDataFrame([(" ".join(said), " ".join(said[256:] + said[:256]).replace("w7 ", "x "))], "a string, b string")
    a, b = said, " ".join(said[256:] + said[:256]).replace("w7 ", "x ").split()
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
    assert pair.select(sweep.simple_wer(F.col("a"), F.col("b")).alias("wer")).first().wer == round(row[-1] / len(a), 3)


def test_words_are_told_apart_once(spark):
    """A text's words are found once, and lists of words don't go to the kernels."""
    plans = {q: QUERIES[q](spark, SMALL)._jdf.queryExecution().executedPlan().toString() for q in ("q28_token_overlap", "q29_rouge_l", "q32_strata", "q53_simple_wer")}
    assert plans["q28_token_overlap"].count("array_intersect") == 2
    assert plans["q29_rouge_l"].count("regexp_extract_all") == 2
    assert plans["q53_simple_wer"].count("split(") == 2
    assert plans["q32_strata"].count("ArrowEvalPython") == 2 and "spoken_variants" not in plans["q32_strata"]


def test_reliability_reads_the_ratings_once(spark):
    assert QUERIES["q18_icc"](spark, SMALL)._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def python_steps_of_stages(df):
    """How many Python steps each stage of a plan has, so how many Python workers each of its tasks."""
    found, stack = [], []
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth, name = len(line) - len(line.lstrip(" :+-")), line.lstrip(" :+-*(0123456789)")
        while stack and stack[-1][0] >= depth:
            stack.pop()
        n = 0 if name.startswith(("Exchange", "BroadcastExchange")) else (stack[-1][1] if stack else 0) + name.startswith(("ArrowEvalPython", "BatchEvalPython", "MapInArrow", "MapInPandas", "ArrowEvalPythonUDTF"))
        stack.append((depth, n))
        found.append(n)
    return found


def test_claims_take_a_python_worker_a_task(spark):
    df = QUERIES["q50_selfcheck_factprecision"](spark, SMALL)
    assert max(python_steps_of_stages(df)) == 1
    assert "MapInPandas" not in df._jdf.queryExecution().executedPlan().toString()


def test_replies_of_more_prompts_than_a_task_holds(spark):
    n = 2 * models.HELD + 7
    prompts = spark.range(n).select("id", F.when(F.col("id") != 5, F.format_string("rate from 1 to 9 %d", "id")).alias("prompt")).coalesce(1)
    got = {r.id: r for r in models.ask_all(prompts, ["id"], models.stub).collect()}
    assert len(got) == n and got[5].reply is None and got[5].error
    assert all(r.reply == models.stub(f"rate from 1 to 9 {i}") and r.error is None for i, r in got.items() if i != 5)
