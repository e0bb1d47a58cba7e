"""From raw log rows to one value an item, and the summaries of stages and runs.

Rows are (run, item, stage, value, pos): pos is the row's place in its log,
since files promise no order. All groupings aggregate partially before they
shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voicegauge.operators import orderstats
from voicegauge.schemas import CONTEXT, HEADLINE_STAGES, STAGES


def numeric(text: Column) -> Column:
    """A tolerant number: blanks, [N/A], words and NaN are null."""
    value = F.trim(text).try_cast("double")
    return F.when(~F.isnan(value), value)


def first_appearance(log: DataFrame) -> DataFrame:
    """(run, item, place): items of each run numbered by their first row."""
    seen = log.groupBy("run", "item").agg(F.min("pos").alias("pos"))
    return seen.select("run", "item", F.row_number().over(Window.partitionBy("run").orderBy("pos", "item")).alias("place"))


def drop_warmup(log: DataFrame, n: int) -> DataFrame:
    """log without each run's first n items. Only (run, item) rows are ranked, and those to drop come back as a small anti join."""
    if n <= 0:
        return log
    early = first_appearance(log).where(F.col("place") <= n).select("run", "item")
    return log.join(early, ["run", "item"], "left_anti")


def collapse_items(log: DataFrame) -> DataFrame:
    """(run, stage, item, n_rep, value): the median of each item's repeats of a stage."""
    kept = log.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.coalesce("item", F.lit("")) != "") & (F.coalesce("stage", F.lit("")) != ""))
    return kept.groupBy("run", "stage", "item").agg(F.count("*").alias("n_rep"), F.percentile("value", 0.5).alias("value"))


def known_stages(log: DataFrame) -> DataFrame:
    return log.where(F.col("stage").isin(*STAGES))


def item_values(items: DataFrame) -> DataFrame:
    """(stage, item, value): the median over runs."""
    return items.groupBy("stage", "item").agg(F.percentile("value", 0.5).alias("value"))


def stage_summary(items: DataFrame, by: tuple[str, ...] = ("stage",)) -> DataFrame:
    """n, median, quartiles, tails, maximum and spread of each group of item values."""
    q = orderstats.quantiles(items, {"median": 0.5, "q1": 0.25, "q3": 0.75, "p90": 0.9, "p95": 0.95}, by)
    top = items.groupBy(*by).agg(F.max("value").alias("max"))
    return q.join(top, list(by)).withColumn("iqr", F.col("q3") - F.col("q1"))


def full_summary(items: DataFrame, by: tuple[str, ...] = ("stage",), confidence: float = 0.95) -> DataFrame:
    """Size, moments, quantiles, and the distribution-free interval of the median; the interval and sd of a single value are null."""
    out = moments(items, by).join(orderstats.quantiles(items, {"p50": 0.5, "p90": 0.9, "p95": 0.95}, by).drop("n"), list(by))
    return out.join(orderstats.quantile_interval(items, 0.5, confidence, by).drop("n"), list(by))


def moments(items: DataFrame, by: tuple[str, ...] = ("stage",), single_sd: float | None = None) -> DataFrame:
    """n, mean, sd, min, max. sd of one value is null; describe() of the evaluation tier asks for 0 there (single_sd)."""
    sd = F.stddev_samp("value")
    return items.groupBy(*by).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), (F.coalesce(sd, F.lit(single_sd)) if single_sd is not None else sd).alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"))


def run_rollup(items: DataFrame, stages: tuple[str, ...] | None = HEADLINE_STAGES) -> DataFrame:
    """(run, stage, n, p50) for each run, and for all runs pooled (run null)."""
    kept = items.where(F.col("stage").isin(*stages)) if stages else items
    of_run = kept.groupBy("run", "stage").agg(F.count("value").alias("n"), F.percentile("value", 0.5).alias("p50"))  # a run is a few hundred items
    pooled = orderstats.quantiles(kept, {"p50": 0.5}).select(F.lit(None).cast("string").alias("run"), "stage", "n", "p50")
    return of_run.unionByName(pooled)


def context_values(log: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(run, column, values, n): the distinct values of each context column, blank as (unset); warm-up rows count too."""
    shown = [F.struct(F.lit(c).alias("column"), F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("(unset)")).alias("value")) for c in columns]
    long = log.select("run", F.explode(F.array(*shown)).alias("x")).select("run", "x.column", "x.value").distinct()
    return long.groupBy("run", "column").agg(F.array_join(F.array_sort(F.collect_list("value")), "|").alias("values"), F.count("*").alias("n"))


def extra_metrics(log: DataFrame, json: str, key: str) -> DataFrame:
    """(run, item, last, median) of one number in a JSON object column: the logs take an item's last value, the evaluation its median."""
    number = F.get_json_object(json, f"$.{key}").try_cast("double")
    rows = log.select("run", "item", "pos", number.alias("x")).where("x is not null and not isnan(x)")
    return rows.groupBy("run", "item").agg(F.max_by("x", "pos").alias("last"), F.percentile("x", 0.5).alias("median"))


def resource_table(log: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(stage, resource, n, p50, p90, max) over raw rows, and over all stages (stage null)."""
    long = log.unpivot(["stage"], list(columns), "resource", "value").where("value is not null")
    return long.groupingSets([["stage", "resource"], ["resource"]], "stage", "resource").agg(F.count("value").alias("n"), F.percentile("value", 0.5).alias("p50"), F.percentile("value", 0.9).alias("p90"), F.max("value").alias("max")).select("stage", "resource", "n", "p50", "p90", "max")


#: Fixed values: (stage, key of its JSON, metric).
EXTRAS = (("llm_prompt_eval", "prompt_tokens", "llm_prompt_tokens"), ("llm_eval", "eval_tokens", "llm_eval_tokens"), ("llm_eval", "tokens_per_sec", "llm_tokens_per_sec"), ("e2e_response_ready", "output_duration_ms", "tts_audio_ms"))


def extra_rows(log: DataFrame) -> DataFrame:
    """(run, item, metric, value): the median of each item's numbers in the JSON of its stages."""
    out = None
    for stage, key, metric in EXTRAS:
        rows = extra_metrics(log.where(F.col("stage") == stage), "extra_json", key).select("run", "item", F.lit(metric).alias("metric"), F.col("median").alias("value"))
        out = rows if out is None else out.union(rows)
    return out


def resource_medians(log: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(run, resource, median) over raw rows."""
    long = log.unpivot(["run"], list(columns), "resource", "value").where("value is not null")
    return orderstats.quantiles(long, {"median": 0.5}, ("run", "resource")).drop("n")


def hardware(log: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The first value of each column that isn't blank, by place in the log."""
    return log.groupBy("run").agg(*(F.min_by(F.when(F.trim(c) != "", F.col(c)), F.when(F.trim(c) != "", F.col("pos"))).alias(c) for c in columns))


def log_warnings(log: DataFrame, items: DataFrame, columns: tuple[str, ...] = CONTEXT, least: int = 20) -> DataFrame:
    """(kind, detail) of what would make a reader misread a selection of logs: mixed settings, runs without an input mode, ends of speech located in several
    ways, several system prompts, repeats that were collapsed, runs of different sizes, small stages."""
    detail = lambda rows, kind, text: rows.select(F.lit(kind).alias("kind"), text.cast("string").alias("detail"))
    shown = context_values(log.withColumn("run", F.lit("")), columns)
    out = detail(shown.where("n > 1"), "mixed settings", F.concat_ws(": ", "column", "values"))
    out = out.union(detail(shown.where("column = 'input_mode' and array_contains(split(values, '[|]'), '(unset)')"), "no input mode", F.lit("ttfa counts from the start of processing")))
    extra = lambda key: F.nullif(F.trim(F.get_json_object("extra_json", f"$.{key}")), F.lit(""))
    for key, kind in (("speech_end_source", "ends of speech"), ("system_prompt", "system prompts")):
        values = log.select(extra(key).alias("v")).where("v is not null").agg(F.array_sort(F.collect_set("v")).alias("v"))
        out = out.union(detail(values.where("size(v) > 1"), kind, F.array_join("v", ", ")))
    repeats = items.agg(F.count_if(F.col("n_rep") > 1).alias("n"))
    out = out.union(detail(repeats.where("n > 0"), "collapsed repeats", F.col("n")))
    sizes = items.groupBy("run").agg(F.countDistinct("item").alias("n")).agg(F.array_sort(F.collect_set("n")).alias("n"))
    out = out.union(detail(sizes.where("size(n) > 1"), "runs of different sizes", F.array_join(F.transform("n", lambda x: x.cast("string")), ", ")))
    small = items.groupBy("stage").agg(F.countDistinct("item").alias("n")).agg(F.min("n").alias("n"))
    return out.union(detail(small.where(F.col("n") < least), "few items", F.col("n")))


def in_stage_order(df: DataFrame, stage: str = "stage") -> DataFrame:
    """Known stages in pipeline order, then the others by name."""
    place = F.array_position(F.array(*map(F.lit, STAGES)), F.col(stage))
    return df.orderBy(F.when(place > 0, place).otherwise(len(STAGES) + 1), stage)
