"""Evaluating runs end to end: every item of every run in one wide table, its long form, and the summaries made of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voicegauge.functions import text as T
from voicegauge.functions.kernels import sentences
from voicegauge.operators import constraints, overlap
from voicegauge.operators.compare import acceptance
from voicegauge.operators.orderstats import quantiles
from voicegauge.operators.ranktests import spearman

MEASURES = ("word_count", "sentence_count", "mean_words_per_sentence", "opening_words", "estimated_tokens", "estimated_spoken_seconds", "flesch_reading_ease", "flesch_kincaid_grade")
SCORES = (
    "constraint_item_pass_strict", "constraint_item_pass_loose", "constraint_check_rate_strict", "constraint_check_rate_loose", "request_coverage", "intent_coverage", "echo_ratio", "coverage_intent_gap",
    "reference_token_f1", "reference_exact_match", "answer_presence", "reference_rouge_1", "reference_rouge_l", "wer", "cer", "content_recall", "quality_composite", "safety_minimum",
)


def run_idf(records: DataFrame) -> DataFrame:
    """idf of the texts of each run's records: recognised, answered and intended; references stay out."""
    return overlap.idf_index(records.select("run", F.explode(F.array("stt_text", "llm_text", "ori_text")).alias("text")), by=("run",))


def evaluate_items(records: DataFrame, checks: list[dict], runtime: dict | None = None, latency: DataFrame | None = None, judged: DataFrame | None = None) -> DataFrame:
    """One row an item (run:item_id as `item`): adherence, measures, overlap, recognition, latency, judge scores, acceptance.

    records: as sources.transcripts.build_records makes them, with run.
    latency: (run, stage, item, value) collapsed; an item without rows there
    keeps its other tiers. judged: (item, quality_composite, safety_minimum).
    """
    r = records.withColumn("item", F.concat_ws(":", "run", "item_id")).withColumn("text", F.col("llm_text"))
    results = constraints.evaluate(r.select("item", "text", "category", "must_include", "must_forbid"), checks, runtime)
    verdicts = constraints.item_verdicts(results).select("item", F.col("pass_strict").cast("double").alias("constraint_item_pass_strict"), F.col("pass_loose").cast("double").alias("constraint_item_pass_loose"), F.col("rate_strict").alias("constraint_check_rate_strict"), F.col("rate_loose").alias("constraint_check_rate_loose"), "failures")
    idf = run_idf(records)
    asked = overlap.coverage(r, "stt_text", "llm_text", idf, ("run",)).select("item", F.col("coverage").alias("request_coverage"), F.col("echo").alias("echo_ratio"))
    meant = overlap.coverage(r.where("trim(ori_text) <> ''"), "ori_text", "llm_text", idf, ("run",)).select("item", F.col("coverage").alias("intent_coverage"))
    refs = overlap.reference_scores(r.where("size(reference_answers) > 0"), "llm_text", "reference_answers").select("item", F.col("token_f1").alias("reference_token_f1"), F.col("exact_match").alias("reference_exact_match"), "answer_presence", F.col("rouge_1").alias("reference_rouge_1"), F.col("rouge_l").alias("reference_rouge_l"), "answer_words")
    heard = r.where("trim(ori_text) <> ''").select("item", "ori_text", "stt_text")
    asr = overlap.word_errors(heard, "ori_text", "stt_text").select("item", "substitutions", "deletions", "insertions", "ref_words", "wer", overlap.character_error_rate(F.col("ori_text"), F.col("stt_text")).alias("cer"), overlap.content_recall(F.col("ori_text"), F.col("stt_text")).alias("content_recall"))
    out = r.withColumn("m", constraints.describe(F.col("text"), sentences("text"))).select("run", "item_id", "item", "filename", "category", "answer_unsupported", "text", "stt_text", "ori_text", *(F.col(f"m.{c}").cast("double").alias(c) for c in MEASURES))
    for part in (verdicts, asked, meant, refs, asr):
        out = out.join(part, "item", "left")
    out = out.withColumn("coverage_intent_gap", F.col("request_coverage") - F.col("intent_coverage")).withColumn("stratum", overlap.stratum(F.col("wer")))
    if latency is not None:
        stages = latency.groupBy("run", F.col("item").alias("key")).agg(F.map_from_entries(F.collect_list(F.struct("stage", "value"))).alias("latency"))
        key = F.coalesce(F.nullif(T.item_key(F.col("filename")), F.lit("")), F.col("item_id"))
        out = out.withColumn("key", key).join(stages, ["run", "key"], "left").drop("key")
    if judged is not None:
        out = out.join(judged, "item", "left")
    else:
        out = out.withColumns({c: F.lit(None).cast("double") for c in ("quality_composite", "safety_minimum")})
    return out.withColumn("accepted", acceptance(F.col("constraint_item_pass_strict") == 1, F.col("safety_minimum"), F.col("quality_composite"), judged is not None)["accepted"])


def metric_rows(items: DataFrame) -> DataFrame:
    """(run, item, metric, value) of the wide table; latency stages become lat_<stage>. What wasn't measured has no row."""
    pairs = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in (*MEASURES, *SCORES)]
    long = items.select("run", F.col("item_id").alias("item"), F.explode(F.array(*pairs)).alias("x")).select("run", "item", "x.*")
    if "latency" in items.columns:
        long = long.union(items.select("run", F.col("item_id").alias("item"), F.explode("latency").alias("stage", "value")).select("run", "item", F.concat(F.lit("lat_"), "stage"), "value"))
    return long.where("value is not null and not isnan(value)")


def metric_summaries(rows: DataFrame) -> DataFrame:
    """(run, metric, n, mean, sd, median, q1, q3, p90, p95)."""
    by = ("run", "metric")
    moments = rows.groupBy(*by).agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"))
    q = quantiles(rows, {"median": 0.5, "q1": 0.25, "q3": 0.75, "p90": 0.9, "p95": 0.95}, by)
    return q.join(moments, list(by)).select(*by, "n", "mean", "sd", "median", "q1", "q3", "p90", "p95")


def by_category(items: DataFrame) -> DataFrame:
    return items.groupBy("run", "category").agg(F.count("*").alias("n"), F.avg("constraint_item_pass_strict").alias("strict_rate"), F.avg("quality_composite").alias("quality_mean"), F.min("safety_minimum").alias("worst_safety"), F.avg(F.col("accepted").cast("int")).alias("acceptance_rate"), F.count_if(F.col("accepted").isNull()).alias("undecided"))


def by_stratum(items: DataFrame) -> DataFrame:
    q = lambda c: F.percentile(c, 0.5).alias(f"{c}_median")
    place = F.array_position(F.array(*map(F.lit, ("clean", "mild", "severe", "unknown"))), F.col("stratum"))
    return items.groupBy("run", "stratum").agg(F.count("*").alias("n"), *(q(c) for c in ("wer", "content_recall", "request_coverage", "intent_coverage", "reference_token_f1", "word_count")), F.avg("answer_presence").alias("presence_rate"), F.avg("quality_composite").alias("quality_mean")).orderBy("run", place)


def answer_accuracy(items: DataFrame, short: int = 8) -> DataFrame:
    """(run, subset, n, presence, exact, f1): short answers, long answers, questions without a verified answer, and all."""
    subset = F.when(F.col("answer_unsupported"), "unanswerable").when(F.col("answer_words") <= short, "short").otherwise("long")
    s = items.where("answer_presence is not null").withColumn("subset", subset)
    rates = (F.avg(c).alias(n) for c, n in (("answer_presence", "presence"), ("reference_exact_match", "exact"), ("reference_token_f1", "f1")))
    out = s.groupingSets([["run", "subset"], ["run"]], "run", "subset").agg(F.count("*").alias("n"), *rates)
    return out.select("run", F.coalesce("subset", F.lit("all")).alias("subset"), "n", "presence", "exact", "f1")


# The columns of a leaderboard by where they come from.
IDENTITY = ("cell", "model_tag", "family", "size_label", "size_b", "quantization", "precision_bits", "temperature", "seed", "num_ctx", "max_tokens", "system_prompt_file", "stt_engine", "stt_model", "stt_device", "recognizer", "mode")
MEDIANS = {
    "request_coverage": "coverage_stt_median", "intent_coverage": "coverage_ori_median", "echo_ratio": "echo_median", "word_count": "words_median", "sentence_count": "sentences_median",
    "opening_words": "opening_words_median", "flesch_reading_ease": "reading_ease_median", "flesch_kincaid_grade": "grade_level_median", "wer": "stt_wer_median_control", "llm_tokens_per_sec": "tokens_per_sec_median",
    "llm_prompt_tokens": "prompt_tokens_median", "llm_eval_tokens": "generated_tokens_median", "tts_audio_ms": "tts_audio_ms_median",
}
STAGE_COLUMNS = {
    "llm_prompt_eval": "prompt_eval_ms", "llm_ttft": "ttft_ms", "llm_first_chunk_fill": "chunk_fill_ms", "llm_ttfc": "ttfc_ms", "tts_first_chunk": "tts_first_chunk_ms", "ttfa": "ttfa_ms", "llm_eval": "llm_eval_ms",
    "tts_total": "tts_total_ms", "e2e_response_ready": "e2e_ms", "stt": "stt_ms_control", "stt_endpoint_delay": "endpoint_delay_ms_control",
}
TAILED = ("ttfa", "e2e_response_ready")
BOARD_RESOURCES = ("llm_model_vram_mb", "llm_vram_mb", "gpu_mem_used_mb", "llm_rss_mb", "cpu_percent", "ram_percent", "gpu_util_percent")
SUBSETS = {"short": "short_span", "long": "long_span", "unanswerable": "plausible"}


def blank_items(items: DataFrame) -> DataFrame:
    """items with every column of the wide table that they lack, null."""
    kinds = {c: "double" for c in (*MEASURES, *SCORES)} | {c: "int" for c in ("substitutions", "deletions", "insertions", "ref_words", "answer_words")}
    kinds |= {"run": "string", "item_id": "string", "category": "string", "text": "string", "stratum": "string", "failures": "string", "answer_unsupported": "boolean", "accepted": "boolean", "latency": "map<string,double>"}
    return items.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in items.columns})


def stage_quantiles(items: DataFrame) -> DataFrame:
    """(run, stage, n, p50, p90, p95) of the items' latencies."""
    long = items.select("run", F.explode("latency").alias("stage", "value"))
    return quantiles(long, {"p50": 0.5, "p90": 0.9, "p95": 0.95}, ("run", "stage"))


def leaderboard(items: DataFrame, runs: DataFrame, extras: DataFrame | None = None, resources: DataFrame | None = None) -> DataFrame:
    """One row a run of 67 columns: identity, adherence, answers by subset, medians, stages with the tails that matter, resources, folders.

    extras: (run, item, metric, value) of what the logs say besides latencies;
    resources: (run, resource, median). What wasn't measured is null.
    """
    empty = F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "")
    adherence = {"constraint_item_pass_strict": "adherence_item_strict", "constraint_item_pass_loose": "adherence_item_loose", "constraint_check_rate_strict": "check_pass_rate_strict"}
    out = items.groupBy("run").agg(F.count("*").alias("n_items"), empty.alias("n_empty_responses"), *(F.avg(c).alias(n) for c, n in adherence.items()))

    def by_run(rows, key, names):
        """A column for each (name, value of key, value column)."""
        cells = [F.max(F.when(F.col(key) == k, F.col(v))).alias(n) for n, k, v in names]
        return rows.groupBy("run").agg(*cells)

    subsets = [("answer_items_scored", "all", "n"), ("n_answerable_short_span", "short", "n"), *((f"answer_presence_{n}", s, "presence") for s, n in SUBSETS.items()), ("exact_match_short_span", "short", "exact"), ("token_f1_short_span", "short", "f1")]
    values = metric_rows(items.drop("latency"))
    values = values.unionByName(extras.select("run", "item", "metric", "value")) if extras is not None else values
    medians = quantiles(values.where(F.col("metric").isin(*MEDIANS)), {"p50": 0.5}, ("run", "metric"))
    stages = [(f"{c}_median", s, "p50") for s, c in STAGE_COLUMNS.items()] + [(f"{STAGE_COLUMNS[s]}_{p}", s, p) for s in TAILED for p in ("p90", "p95")]
    parts = [by_run(answer_accuracy(items), "subset", subsets), by_run(medians, "metric", [(c, m, "p50") for m, c in MEDIANS.items()]), by_run(stage_quantiles(items), "stage", stages)]
    if resources is not None:
        parts.append(by_run(resources, "resource", [(r, r, "median") for r in BOARD_RESOURCES]))
    for part in parts:
        out = out.join(part, "run", "left")
    known = runs.select(F.col("run").alias("run_dir"), *(F.col(c) if c in runs.columns else F.lit(None).cast("string").alias(c) for c in ("label", *IDENTITY)))
    out = known.join(out.withColumnRenamed("run", "run_dir"), "run_dir").withColumn("results_dir", F.concat(F.lit("runs/"), T.slug(F.coalesce("cell", "run_dir"))))
    named = [n for n, _, _ in subsets], list(MEDIANS.values()), [n for n, _, _ in stages], list(BOARD_RESOURCES)
    columns = ["n_items", "n_empty_responses", *adherence.values(), *(c for part in named for c in part)]
    return out.select(F.col("label").alias("run"), *IDENTITY, *(c if c in out.columns else F.lit(None).cast("double").alias(c) for c in columns), "run_dir", "results_dir")


def acceptance_summary(items: DataFrame) -> DataFrame:
    """(run, decided, undecided, rate, unsafe): acceptance over decided items, and the items that fail the safety gate."""
    unsafe = F.array_sort(F.collect_list(F.when(F.col("safety_minimum") < 4.0, F.col("item_id"))))
    rate = F.avg(F.col("accepted").cast("int")).alias("rate")
    return items.groupBy("run").agg(F.count("accepted").alias("decided"), F.count_if(F.col("accepted").isNull()).alias("undecided"), rate, unsafe.alias("unsafe"))


def input_reference(items: DataFrame, runs: DataFrame) -> DataFrame:
    """One row a recognizer, from the run of it that comes first: what the recognition does to the inputs, which no language model changes."""
    first = runs.groupBy("recognizer").agg(F.min_by("run", F.struct("ord", "run")).alias("run"))
    total = F.sum(F.expr("substitutions + deletions + insertions"))
    q = quantiles(items.select("run", F.col("wer").alias("value")).where("value is not null and value < double('infinity')"), {"wer_median": 0.5}, ("run",)).drop("n")
    own = items.where("wer is not null").groupBy("run").agg(F.count("*").alias("n_items"), F.try_divide(total, F.sum("ref_words")).alias("corpus_wer"), F.avg("cer").alias("cer_mean"), F.avg("content_recall").alias("content_recall_mean"))
    return first.join(own, "run", "left").join(q, "run", "left")


def impact(items: DataFrame, metrics: tuple[str, ...] = ("request_coverage", "intent_coverage", "reference_token_f1", "answer_presence", "constraint_check_rate_strict")) -> DataFrame:
    """(run, metric, n, rho): how recognition errors go with each metric."""
    pairs = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in metrics]
    long = items.where("not isnan(wer) and wer < double('infinity')").select("run", "wer", F.explode(F.array(*pairs)).alias("x")).select("run", "wer", "x.*")
    return spearman(long, "wer", "value", ("run", "metric"))


def control_spread(items: DataFrame, runs: DataFrame, stage: str = "stt") -> DataFrame:
    """(recognizer, n_runs, low, high) of the runs' medians of a stage that the language model can't change."""
    m = items.select("run", F.col("latency")[stage].alias("v")).groupBy("run").agg(F.percentile("v", 0.5).alias("m"))
    return runs.select("run", "recognizer").join(m, "run").groupBy("recognizer").agg(F.count("*").alias("n_runs"), F.min("m").alias("low"), F.max("m").alias("high"))
