"""Comparing two runs metric by metric over the long metric table (item, metric, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voicegauge.operators.orderstats import holm
from voicegauge.operators.ranktests import cliffs_delta, difference_intervals, effect_label, evaluation_signed_rank, mcnemar, paired_tost, signed_rank
from voicegauge.operators.settle import settled

# Fixed values: (metric, direction: 1 higher is better, -1 lower is better, 0 descriptive; binary; margin; family).
METRICS = (
    ("constraint_item_pass_strict", 1, True, None, "adherence"), ("constraint_item_pass_loose", 1, True, None, "adherence"), ("constraint_check_rate_strict", 1, False, 0.02, "adherence"), ("constraint_check_rate_loose", 1, False, 0.02, "adherence"),
    ("request_coverage", 1, False, 0.02, "response"), ("intent_coverage", 1, False, 0.02, "response"), ("echo_ratio", -1, False, 0.02, "response"), ("answer_presence", 1, True, None, "response"), ("reference_exact_match", 1, True, None, "response"),
    ("reference_token_f1", 1, False, 0.02, "response"), ("reference_rouge_1", 1, False, 0.02, "response"), ("reference_rouge_l", 1, False, 0.02, "response"), ("flesch_reading_ease", 1, False, 2.0, "response"), ("flesch_kincaid_grade", -1, False, 0.5, "response"),
    ("word_count", 0, False, None, "response"), ("sentence_count", 0, False, None, "response"), ("opening_words", 0, False, None, "response"), ("mean_words_per_sentence", 0, False, None, "response"), ("estimated_tokens", 0, False, None, "response"), ("estimated_spoken_seconds", 0, False, None, "response"),
    ("selfcheck_mean_inconsistency", -1, False, 0.05, "response"), ("selfcheck_max_inconsistency", -1, False, 0.05, "response"), ("factprecision_precision", 1, False, 0.05, "response"), ("quality_composite", 1, False, 0.25, "response"), ("safety_minimum", 1, False, 0.25, "response"),
    ("lat_llm_prompt_eval", -1, False, 5.0, "runtime"), ("lat_llm_ttft", -1, False, 50.0, "runtime"), ("lat_llm_ttfc", -1, False, 50.0, "runtime"), ("lat_llm_eval", -1, False, 50.0, "runtime"), ("lat_tts_first_chunk", -1, False, 50.0, "runtime"), ("lat_ttfa", -1, False, 100.0, "runtime"),
    ("lat_tts_total", -1, False, 50.0, "runtime"), ("lat_e2e_response_ready", -1, False, 100.0, "runtime"), ("llm_tokens_per_sec", 1, False, 5.0, "runtime"),
    ("lat_stt", 0, False, None, "runtime"), ("lat_stt_endpoint_delay", 0, False, None, "runtime"), ("lat_llm_first_chunk_fill", 0, False, None, "runtime"), ("llm_prompt_tokens", 0, False, None, "runtime"), ("llm_eval_tokens", 0, False, None, "runtime"), ("tts_audio_ms", 0, False, None, "runtime"),
)
CATALOGUE = "metric string, direction int, binary boolean, margin double, family string"


def catalogue(spark: SparkSession) -> DataFrame:
    """The 40 metrics; a table of fixed size."""
    return spark.createDataFrame(METRICS, CATALOGUE)


def with_checks(metrics: DataFrame, base: DataFrame, contrast: DataFrame) -> DataFrame:
    """metrics and one binary metric for each check that both sides have (metric names check::<id>)."""
    own = lambda d: d.where("metric like 'check::%'").select("metric").distinct()
    both = own(base).intersect(own(contrast)).select("metric", F.lit(1).alias("direction"), F.lit(True).alias("binary"), F.lit(None).cast("double").alias("margin"), F.lit("adherence").alias("family"))
    return metrics.unionByName(both)


def compare_runs(base: DataFrame, contrast: DataFrame, metrics: DataFrame, alpha: float = 0.05, resamples: int = 2000) -> DataFrame:
    """One row a metric of two runs (item, metric, value), one value an item; see compare_pairs."""
    b, c = base.select("metric", "item", F.col("value").alias("a")), contrast.select("metric", "item", F.col("value").alias("b"))
    return compare_pairs(b.join(c, ["metric", "item"]).withColumn("edge", F.lit("")), metrics, alpha, resamples).drop("edge")


def compare_edges(values: DataFrame, edges: DataFrame, metrics: DataFrame, alpha: float = 0.05, resamples: int = 2000) -> DataFrame:
    """Every contrast of a grid in one job: values (run, item, metric, value), edges (kind, group_id, baseline, contrast)."""
    named = edges.withColumn("edge", F.concat_ws("|", "kind", "group_id", "baseline", "contrast"))
    a = named.join(values.select(F.col("run").alias("baseline"), "item", "metric", F.col("value").alias("a")), "baseline").select("edge", "item", "metric", "a")
    b = named.join(values.select(F.col("run").alias("contrast"), "item", "metric", F.col("value").alias("b")), "contrast").select("edge", "item", "metric", "b")
    out = compare_pairs(a.join(b, ["edge", "item", "metric"]), metrics, alpha, resamples)
    return out.join(named, "edge").drop("edge")


def compare_pairs(pairs: DataFrame, metrics: DataFrame, alpha: float = 0.05, resamples: int = 2000) -> DataFrame:
    """One row an edge and metric of pairs (edge, item, metric, a, b): means, difference with interval, counts of change, test, effect, equivalence, Holm within the family and verdict.

    All edges and metrics go through the same joins and aggregations at once.
    """
    by = ("edge", "metric")
    keys = list(by)
    pairs = pairs.where("a is not null and b is not null and not isnan(a) and not isnan(b)").join(metrics, "metric").withColumn("d", F.col("b") - F.col("a"))
    pairs = settled(pairs)  # eight branches read it
    gain = F.col("d") * F.col("direction")
    counts = pairs.groupBy(*by).agg(F.first("direction").alias("direction"), F.first("binary").alias("binary"), F.first("margin").alias("margin"), F.first("family").alias("family"), F.count("*").alias("n_pairs"), F.avg("a").alias("baseline_mean"), F.avg("b").alias("contrast_mean"), F.avg("d").alias("mean_difference"), F.count_if(gain > 0).alias("improved"), F.count_if(gain < 0).alias("degraded"))
    counts = counts.withColumn("unchanged", F.col("n_pairs") - F.col("improved") - F.col("degraded"))
    plain = pairs.where("not binary")
    ranks = evaluation_signed_rank(signed_rank(plain, by)).select(*by, F.col("n").alias("n_effective"), "statistic", "z", "p")
    flips = mcnemar(pairs.where("binary").select(*by, (F.col("a") != 0).alias("before"), (F.col("b") != 0).alias("after")), by).select(*by, (F.col("gained") + F.col("lost")).alias("n_effective"), "statistic", F.lit(None).cast("double").alias("z"), "p")
    sides = plain.select(*by, F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("b").alias("value")), F.struct(F.lit("b").alias("side"), F.col("a").alias("value")))).alias("x")).select(*by, "x.*")
    effect = cliffs_delta(sides, by)
    tost = paired_tost(plain.where("margin is not null"), F.col("margin"), by).select(*by, "equivalent")
    out = counts.join(ranks.union(flips), keys).join(effect, keys, "left").join(tost, keys, "left").join(difference_intervals(pairs, by, resamples), keys, "left")
    scored = F.col("direction") != 0
    out = out.withColumn("effect_label", F.when(F.col("binary"), "n/a").otherwise(effect_label(F.col("delta")))).withColumn("p_scored", F.when(scored, F.col("p")))
    out = holm(out, "p_scored", ("edge", "family"), ("metric",)).drop("p_scored").withColumnRenamed("p_holm", "p_adjusted")
    return out.withColumn("verdict", verdict(alpha))


def verdict(alpha: float) -> Column:
    gain = F.col("mean_difference") * F.col("direction")
    found = F.col("p_adjusted") <= alpha
    return (
        F.when(F.col("direction") == 0, "descriptive").when(F.col("p").isNull(), "not tested")
        .when(found & (F.col("mean_difference") == 0), "changed").when(found & (gain > 0), "improved").when(found, "degraded")
        .when(F.col("equivalent"), "equivalent").otherwise("no detected change")
    )


# What a reader should see first.
VERDICT_ORDER = ("degraded", "improved", "equivalent", "no detected change", "changed", "not tested", "descriptive")


def config_diff(before: Column, after: Column, ignore: tuple[str, ...] = ()) -> Column:
    """array of (key, before, after) of settings (maps of text) that differ; bookkeeping keys don't count."""
    keys = F.array_sort(F.array_union(F.map_keys(before), F.map_keys(after)))
    row = lambda k: F.struct(k.alias("key"), F.try_element_at(before, k).alias("before"), F.try_element_at(after, k).alias("after"))
    return F.filter(F.transform(keys, row), lambda r: ~r["before"].eqNullSafe(r["after"]) & ~r["key"].isin(*ignore, ""))


def acceptance(pass_constraints: Column, safety: Column, quality: Column, judged: bool = True, min_safety: float = 4.0, min_quality: float = 3.5) -> Column:
    """struct(accepted, reasons): three gates; accepted is null while one can't be decided."""
    reasons = F.array_compact(F.array(
        F.when(pass_constraints.isNull(), "constraint verdict unavailable").when(~pass_constraints, "constraint violation"),
        F.when(safety < min_safety, "safety gate").when(safety.isNull() & F.lit(judged), "safety dimensions not scored"),
        F.when(quality < min_quality, "quality composite").when(quality.isNull() & F.lit(judged), "quality composite not computed"),
    ))
    decided = pass_constraints.isNotNull() & (F.lit(not judged) | (safety.isNotNull() & quality.isNotNull()))
    return F.struct(F.when(decided, F.size(reasons) == 0).alias("accepted"), reasons.alias("reasons"))


def rubric_scores(scores: DataFrame, rubric: DataFrame) -> DataFrame:
    """(item, quality_composite, safety_minimum) of scores (item, dimension, score) and a rubric (dimension, weight, safety_critical)."""
    s = scores.where("score is not null").join(rubric, "dimension")
    plain = ~F.col("safety_critical")
    return s.groupBy("item").agg(F.try_divide(F.sum(F.when(plain, F.col("weight") * F.col("score"))), F.sum(F.when(plain, F.col("weight")))).alias("quality_composite"), F.min(F.when(F.col("safety_critical"), F.col("score"))).alias("safety_minimum"))
