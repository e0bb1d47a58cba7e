"""Queries over a grid of runs: identities, contrasts, leaderboards, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voicegauge.operators import compare, contrasts, evaluate
from voicegauge.operators.collapse import collapse_items
from voicegauge.plans.registry import query
from voicegauge.plans.tables import PAIRS_SQL, event_log, r4, table

QUANTS = ("q4_K_M", "q8_0", "fp16")
FAMILIES = ("llama3.2", "llama3.1", "qwen2.5", "gemma3")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a run; each 240 of them make a grid with recognizers of its own."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))
    tag = F.concat(pick(FAMILIES, F.floor(k / 3)), F.lit(":"), pick(("1b", "3b", "8b", "500m"), F.floor(k / 12)), F.lit("-instruct-"), pick(QUANTS, k))
    temperature = F.when(F.floor(k / 48) % 3 == 0, 0.0).when(F.floor(k / 48) % 3 == 1, 0.7)
    return p.select(k.cast("string").alias("run"), k.alias("ord"), tag.alias("model_tag"), temperature.alias("temperature"), F.when(F.floor(k / 48) % 3 == 1, 42).alias("seed"), F.concat(pick(("vosk-small-cpu", "whisper-small-cuda"), F.floor(k / 120)), F.lit("-"), F.floor(k / 240).cast("string")).alias("recognizer"), F.col("p_type").alias("prompt_file"), F.col("p_size").alias("num_ctx"))


def _identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs are a few bytes in a file and many steps in a task, so they are dealt out before they are told apart."""
    return contrasts.identify(runs(spark, sf_dir).repartition("run"))


IDENT_SQL = """runs as (select cast(k as varchar) as run, k as ord, (['llama3.2', 'llama3.1', 'qwen2.5', 'gemma3'])[(k // 3) % 4 + 1] || ':' || (['1b', '3b', '8b', '500m'])[(k // 12) % 4 + 1] || '-instruct-' || (['q4_K_M', 'q8_0', 'fp16'])[k % 3 + 1] as model_tag,
      case when (k // 48) % 3 = 0 then 0.0 when (k // 48) % 3 = 1 then 0.7 end::double as temperature, case when (k // 48) % 3 = 1 then 42 end as seed, (['vosk-small-cpu', 'whisper-small-cuda'])[(k // 120) % 2 + 1] || '-' || (k // 240)::varchar as recognizer, p_type as prompt_file, p_size as num_ctx from (select p_partkey as k, * from part)),
    ident as (select *, split_part(model_tag, ':', 1) as family, split_part(split_part(model_tag, ':', 2), '-', 1) as size_label, split_part(model_tag, '-', 2) as tuning, split_part(model_tag, '-', 3) as quantization,
      case when model_tag like '%500m%' then 0.5 else try_cast(regexp_extract(model_tag, ':(\\d+)b', 1) as double) end::double as size_b, case split_part(model_tag, '-', 3) when 'q4_K_M' then 4 when 'q8_0' then 8 else 16 end as precision_bits,
      regexp_extract(model_tag, '^([^0-9]+)', 1) as lineage, case when temperature is null then 't?' when temperature = 0 then 't0' else 't0.7/s42' end as setting from runs)"""


@query("q36_run_identity", f"with {IDENT_SQL} select run, family, size_label, size_b, tuning, quantization, precision_bits, lineage, setting, case when ord < 10 then '0' else '' end || cast(ord as varchar) || ' ' || family || ':' || size_label || '-' || quantization || ' ' || setting as label from ident")
def q36(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contrasts.identify(runs(spark, sf_dir)).select("run", "family", "size_label", "size_b", "tuning", "quantization", "precision_bits", "lineage", "setting", "label")


def _edges_sql() -> str:
    parts = []
    for kind, (fixed, varying, order, name) in contrasts.KINDS.items():
        by = ", ".join(o if " desc" in o else f"{o} asc nulls last" for o in order)
        w = f"partition by {', '.join(fixed)}"
        spread = f"(select count(distinct j.{varying}) from used j where {' and '.join(f'j.{c} = i.{c}' for c in fixed)})" if varying else f"count(*) over ({w})"
        group = name if kind == "recognizer" else f"{name} || '_' || recognizer"
        parts.append(f"select '{kind}' as kind, {group} as group_id, first_value(run) over ({w} order by {by}) as baseline, run as contrast, {spread} as spread, row_number() over ({w} order by {by}) as place from used i")
    return f"{IDENT_SQL}, used as (select *, count(*) over (partition by recognizer) as used from ident), all_edges as ({' union all '.join(parts)}), edges as (select kind, group_id, baseline, contrast from all_edges where spread >= 2 and place > 1)"


@query("q37_contrast_groups", f"with {_edges_sql()} select * from edges")
def q37(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contrasts.contrast_edges(_identified(spark, sf_dir))


@query("q38_shared_inputs", f"with {_edges_sql()}, m as (select distinct kind, group_id, run from (select kind, group_id, baseline as run from edges union all select kind, group_id, contrast from edges)), v as (select kind, group_id, unnest([{{'p': 'prompt_file', 'v': prompt_file}}, {{'p': 'num_ctx', 'v': cast(num_ctx as varchar)}}, {{'p': 'seed', 'v': cast(seed as varchar)}}]) as x from m join runs using (run)) select kind, group_id, x.p as property, count(distinct x.v) + max((x.v is null)::int) as n_distinct from v group by all")
def q38(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _identified(spark, sf_dir)
    return contrasts.shared_inputs(contrasts.contrast_edges(r), r, ("prompt_file", "num_ctx", "seed"))


BOARD_SQL = """with l as (select l_returnflag as run, o_orderpriority as stage, l_extendedprice as v, l_discount > 0.05 as ok from lineitem join orders on l_orderkey = o_orderkey),
    s as (select run, stage, quantile_cont(v, 0.5) as p50, quantile_cont(v, 0.9) as p90, quantile_cont(v, 0.95) as p95, count(*) as n, sum(ok::int) as ok from l group by all)
    select run, sum(n)::bigint as n_items, round(sum(ok)::double / sum(n), 4) as adherence_item_strict, round(max(p50) filter (stage = '1-URGENT'), 4) as ttfa_ms_median, round(max(p90) filter (stage = '1-URGENT'), 4) as ttfa_ms_p90,
      round(max(p95) filter (stage = '1-URGENT'), 4) as ttfa_ms_p95, round(max(p50) filter (stage = '5-LOW'), 4) as e2e_ms_median, round(max(p90) filter (stage = '5-LOW'), 4) as e2e_ms_p90, round(max(p50) filter (stage = '2-HIGH'), 4) as ttft_ms_median from s group by run"""


@query("q39_leaderboard", BOARD_SQL)
def q39(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return flags as runs; an order's priority says which stage its lines' prices are."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("run"), F.col("l_extendedprice").cast("double").alias("v"), (F.col("l_discount") > 0.05).cast("double").alias("constraint_item_pass_strict"))
    stage = F.create_map(*map(F.lit, ("1-URGENT", "ttfa", "5-LOW", "e2e_response_ready", "2-HIGH", "llm_ttft", "3-MEDIUM", "stt", "4-NOT SPECIFIED", "tts_total")))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.try_element_at(stage, F.col("o_orderpriority")).alias("stage"))
    items = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("run", F.concat_ws(":", "l_orderkey", "l_linenumber").alias("item_id"), "constraint_item_pass_strict", F.create_map("stage", "v").alias("latency"))
    runs = li.select("run", F.col("run").alias("label")).distinct()
    board = evaluate.leaderboard(evaluate.blank_items(items), runs)
    return board.select("run", "n_items", *(r4(c).alias(c) for c in ("adherence_item_strict", "ttfa_ms_median", "ttfa_ms_p90", "ttfa_ms_p95", "e2e_ms_median", "e2e_ms_p90", "ttft_ms_median")))


#: Event types stand for metrics: (metric, direction, binary, margin, family).
METRICS = [("click", 1, False, 5.0, "response"), ("view", -1, False, 5.0, "response"), ("purchase", 1, False, None, "runtime"), ("error", -1, False, 2.0, "runtime"), ("signup", 0, False, None, "runtime")]


@query("q40_compare_metrics", f"with {PAIRS_SQL}, c as (select stage as metric, d as d, a, b, case stage when 'click' then 1 when 'purchase' then 1 when 'view' then -1 when 'error' then -1 else 0 end as dir from pairs where stage in ('click', 'view', 'purchase', 'error', 'signup')), nz as (select metric, abs(d) as m, d > 0 as up from c where d <> 0), tied as (select metric, m, count(*) as t, count(*) filter (up) as ups from nz group by all), rk as (select *, sum(t) over (partition by metric order by m) - (t - 1) / 2.0::double as r from tied), w as (select metric, sum(t)::double as n, sum(ups * r) as wp, sum(t::double * t * t - t) as ties from rk group by metric) select c.metric, count(*) as n_pairs, round(avg(b), 4) as baseline_mean, round(avg(a), 4) as contrast_mean, round(avg(d), 4) as mean_difference, count(*) filter (d * dir > 0) as improved, count(*) filter (d * dir < 0) as degraded, round(max((wp - n * (n + 1) / 4 - case when wp < n * (n + 1) / 4 then -0.5 else 0.5 end) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)), 4) as z from c join w on c.metric = w.metric group by c.metric")
def q40(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _compared(spark, sf_dir)
    return out.select("metric", "n_pairs", *(r4(c).alias(c) for c in ("baseline_mean", "contrast_mean", "mean_difference")), "improved", "degraded", r4("z").alias("z"))


def _compared(spark, sf_dir):
    items = collapse_items(event_log(spark, sf_dir)).withColumnRenamed("stage", "metric")
    return compare.compare_runs(items.where("run = 'base'"), items.where("run = 'current'"), spark.createDataFrame(METRICS, compare.CATALOGUE))


@query("q52_comparison_verdicts")
def q52(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir).select("metric", "family", "n_effective", r4("p").alias("p"), r4("p_adjusted").alias("p_adjusted"), "effect_label", "equivalent", r4("ci_low").alias("ci_low"), r4("ci_high").alias("ci_high"), "verdict")


@query("q41_config_diff", "with p as (select a.p_brand as pair, a.p_name as an, a.p_type as aty, a.p_size as az, b.p_name as bn, b.p_type as bt, b.p_size as bz from (select *, row_number() over (partition by p_brand order by p_partkey) as r from part) a join (select *, row_number() over (partition by p_brand order by p_partkey desc) as r from part) b on a.p_brand = b.p_brand and a.r = 1 and b.r = 1), x as (select pair, unnest([{'key': 'name', 'before': an, 'after': bn}, {'key': 'size', 'before': cast(az as varchar), 'after': cast(bz as varchar)}, {'key': 'type', 'before': aty, 'after': bt}]) as d from p) select pair, d.key as key, d.before as before, d.after as after from x where d.before is distinct from d.after and d.key <> 'type'")
def q41(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    settings = F.create_map(F.lit("name"), F.col("p_name"), F.lit("type"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string"))
    ends = p.groupBy("p_brand").agg(F.min_by(settings, "p_partkey").alias("a"), F.max_by(settings, "p_partkey").alias("b"))
    return ends.select(F.col("p_brand").alias("pair"), F.explode(compare.config_diff(F.col("a"), F.col("b"), ("type",))).alias("d")).select("pair", "d.*")
