"""A small grid from transcripts to verdicts."""

import pytest
from pyspark.sql import functions as F

from voicegauge.operators import compare, contrasts, evaluate

CHECKS = [{"type": "non_empty"}, {"type": "total_sentence_count", "params": {"min": 1, "max": 2}}, {"type": "must_include"}]


@pytest.fixture(scope="module")
def items(spark):
    rows, lat = [], []
    for run, tail in (("r1", ""), ("r2", " Well. And more. And on.")):
        for i in range(12):
            answer = f"It is city {i}." + tail
            rows.append((run, f"i{i}", f"a/i{i}.wav", f"where is the place {i}", f"where is a place {i}", answer, "crisis" if i % 4 == 0 else "general", [f"city {i}"], i % 5 == 0, ["city"] if i % 2 else [], []))
            lat += [(run, "ttfa", f"i{i}", 1, 1000.0 + i + (300 if tail else 0)), (run, "stt", f"i{i}", 1, 50.0)]
    records = spark.createDataFrame(rows, "run string, item_id string, filename string, ori_text string, stt_text string, llm_text string, category string, reference_answers array<string>, answer_unsupported boolean, must_include array<string>, must_forbid array<string>")
    latency = spark.createDataFrame(lat, "run string, stage string, item string, n_rep int, value double")
    judged = records.select(F.concat_ws(":", "run", "item_id").alias("item"), F.lit(4.0).alias("quality_composite"), F.when(F.col("item_id") != "i3", 5.0).alias("safety_minimum"))
    return evaluate.evaluate_items(records, CHECKS, latency=latency, judged=judged).cache()


def test_items(items):
    got = {(r.run, r.item_id): r for r in items.collect()}
    one, two = got[("r1", "i1")], got[("r2", "i1")]
    assert one.constraint_item_pass_strict == 1 and two.constraint_item_pass_strict == 0 and two.failures == "total_sentence_count"
    assert one.answer_presence == 1 and one.wer == pytest.approx(1 / 5) and one.stratum == "mild" and one.latency["ttfa"] == 1001
    assert one.accepted and two.accepted is False and got[("r1", "i3")].accepted is None


def test_summaries(spark, items):
    rows = evaluate.metric_rows(items)
    s = {(r.run, r.metric): r for r in evaluate.metric_summaries(rows).collect()}
    assert s[("r1", "lat_ttfa")].median == 1005.5 and s[("r2", "constraint_item_pass_strict")].mean == 0
    acc = {(r.run, r.subset): r.n for r in evaluate.answer_accuracy(items).collect()}
    assert acc[("r1", "all")] == 12 and acc[("r1", "unanswerable")] == 3 and acc[("r1", "short")] == 9
    assert {r.category: r.n for r in evaluate.by_category(items.where("run = 'r1'")).collect()} == {"crisis": 3, "general": 9}
    assert evaluate.by_stratum(items).count() == 2 and evaluate.impact(items).count() == 10
    runs = spark.createDataFrame([("r1", 1, "llama3:8b-q8_0", 0.0, None, "vosk"), ("r2", 2, "llama3:8b-q4_0", 0.0, None, "vosk")], "run string, ord int, model_tag string, temperature double, seed int, recognizer string")
    runs = contrasts.identify(runs)
    board = {r.run_dir: r for r in evaluate.leaderboard(items, runs).collect()}
    assert board["r1"].adherence_item_strict == 1 and board["r2"].ttfa_ms_median == 1305.5 and board["r1"].run == runs.where("run = 'r1'").first().label
    heard = evaluate.input_reference(items, runs).first()
    assert heard.run == "r1" and heard.corpus_wer == pytest.approx(0.2) and heard.wer_median == pytest.approx(0.2)
    unsafe = {r.run: (r.undecided, r.unsafe) for r in evaluate.acceptance_summary(items).collect()}
    assert unsafe["r1"][0] == 1 and unsafe["r1"][1] == []
    assert evaluate.control_spread(items, runs).first().n_runs == 2
    edges = contrasts.contrast_edges(runs)
    out = {(r.kind, r.metric): r for r in compare.compare_edges(rows, edges, compare.catalogue(spark), resamples=100).collect()}
    assert out[("quantization", "lat_ttfa")].verdict == "degraded" and out[("quantization", "constraint_item_pass_strict")].verdict == "degraded" and out[("quantization", "request_coverage")].n_pairs == 12


def test_topic_weights_are_a_runs_own(spark):
    schema = "run string, item string, q string, a string"
    one = [("r1", "1", "apple pie", "apple"), ("r1", "2", "apple tart", "tart")]
    two = [("r2", "3", "pear soup", "soup"), ("r2", "4", "apple cake", "cake"), ("r2", "5", "apple juice", "apple")]
    from voicegauge.operators import overlap

    def scores(rows):
        df = spark.createDataFrame(rows, schema)
        idf = overlap.idf_index(df.select("run", F.explode(F.array("q", "a")).alias("text")), by=("run",))
        return {r["item"]: (r.coverage, r.echo) for r in overlap.coverage(df, "q", "a", idf, ("run",)).collect()}

    assert scores(one + two) == scores(one) | scores(two)
