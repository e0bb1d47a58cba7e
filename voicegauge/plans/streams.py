"""Queries over event streams in their batch form, resampling, judges and recovery of model output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voicegauge.functions.kernels import recovered_score
from voicegauge.functions.text import answer_tokens
from voicegauge.operators import overlap, pairing, sweep
from voicegauge.operators import ranktests as rt
from voicegauge.operators.collapse import collapse_items
from voicegauge.plans.registry import query
from voicegauge.plans.tables import one_run, r4, table, turns
from voicegauge.sources import models
from voicegauge.streaming import chunker
from voicegauge.streaming import turns as rules


def micros(c: str = "ts"):
    """Microseconds of a timestamp without zone, counted in UTC whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz '1970-01-01 00:00:00', {c})")


SPANS_SQL = "s as (select event_type as series, epoch_us(ts) as pt, value from events), iv as (select series, lag(pt) over (partition by series order by pt, value) as opened, pt as closed, value from s), sp as (select user_id::varchar || ':' || (epoch_us(ts) // 86400000000)::varchar as span, event_type as series, min(epoch_us(ts)) as s, max(epoch_us(ts)) + 1800000000 as e from events group by all)"


@query("q42_overlap_utilisation", f"with {SPANS_SQL}, f as (select series, min(pt) as first, count(*) as n from s group by series), o as (select sp.series, span, sum(value * (least(closed, e) - greatest(opened, s))::double) / sum((least(closed, e) - greatest(opened, s))::double) as mean from sp join iv on sp.series = iv.series and opened < e and closed > s group by all) select sp.series, sp.span, case when f.n >= 2 and f.first <= sp.s then round(o.mean, 4) end as mean from sp left join o on sp.series = o.series and sp.span = o.span left join f on f.series = sp.series")
def q42(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), micros().alias("at"), "value", "user_id")
    day = F.floor(F.col("at") / 86_400_000_000).cast("string")
    spans = e.groupBy("series", F.concat_ws(":", F.col("user_id").cast("string"), day).alias("span")).agg(F.min("at").alias("start"), (F.max("at") + 1_800_000_000).alias("end"))
    return pairing.overlap_means(e.select("series", "at", "value"), spans).select("series", "span", r4("mean").alias("mean"))


SWEEP_SQL = """e as (select user_id, event_type, epoch_us(ts) / 1e6 as pt, value, event_id from events),
    u as (select user_id, quantile_cont(pt, 0.5) as speech_end, count(*) as n, sum(value) as words from e group by user_id),
    g as (select e.user_id, count(*) as n_fires, count(*) filter (event_type <> 'error') as spoken, count(*) filter (pt < speech_end - 1e-6) as cuts, arg_max(pt, pt) filter (event_type <> 'error') as closing_at, arg_max(pt - value, pt) filter (event_type <> 'error') as last_word from e join u on e.user_id = u.user_id group by e.user_id),
    sc as (select user_id % 3 as chunk_ms, case when user_id % 2 = 0 then '600' else '500/600/600' end as label, spoken > 1 as split, cuts > 0 as cut, closing_at is not null as fired, round((closing_at - last_word) * 1000, 1) as delay, user_id % 5 > 0 as usable from g)"""


@query("q43_sweep_summary", f"with {SWEEP_SQL} select chunk_ms, label, count(*) as n_all, count(*) filter (usable) as n_usable, count(*) filter (cut) as cut_all, count(*) filter (usable and cut) as cut_usable, count(*) filter (usable and split) as split_usable, round(100.0::double * count(*) filter (usable and split) / greatest(count(*) filter (usable), 1), 2) as split_usable_pct, count(*) filter (usable and not fired) as never_fired_usable, round(quantile_cont(case when usable then delay end, 0.5), 2) as delay_p50_ms, round(quantile_cont(case when usable then delay end, 0.9), 2) as delay_p90_ms from sc group by all")
def q43(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", (micros() / 1e6).alias("at"), "value")
    segment = F.struct(F.col("at").alias("at_s"), F.lit(False).alias("flush"), F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("text"), F.lit(1).cast("long").alias("n_words"), (F.col("at") - F.col("value")).alias("last_word_end_s"))
    runs = e.groupBy("user_id").agg(F.array_sort(F.collect_list(segment)).alias("segments"), F.percentile("at", 0.5).alias("speech_end_s"))
    s = sweep.score_segments(runs).withColumns({"chunk_ms": F.col("user_id") % 3, "label": F.when(F.col("user_id") % 2 == 0, "600").otherwise("500/600/600"), "usable": F.col("user_id") % 5 > 0})
    return sweep.summarize(s).select("chunk_ms", "label", "n_all", "n_usable", "cut_all", "cut_usable", "split_usable", "split_usable_pct", "never_fired_usable", F.round("delay_p50_ms", 2).alias("delay_p50_ms"), F.round("delay_p90_ms", 2).alias("delay_p90_ms"))


@query("q44_endpoint_sessions", "with p as (select user_id as user, epoch_us(ts) as t, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) as pause from events), n as (select *, sum(case when pause >= 21600000000 then 1 else 0 end) over (partition by user order by t rows unbounded preceding)::bigint as no from p) select user, no as session_no, min(t) as start_us, count(*) as n, coalesce(max(pause) filter (pause < 21600000000), 0) as longest_us from n group by user, no")
def q44(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), micros().alias("t"))
    return rules.gap_sessions(e, "user", "t", 21_600_000_000)


@query("q45_latest_wins", "select user_id as user, max(event_id) as seq, arg_max(value, event_id) as value from events group by user_id")
def q45(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), F.col("event_id").alias("seq"), "value")
    return rules.latest(e, "user")


CENTRE_SQL = """with x as (select vec_id, label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as i from embeddings),
    c as (select label, i, avg(v) as m from x group by all)
    select vec_id, x.label, round(sum(v * m) / (sqrt(sum(v * v)) * sqrt(sum(m * m))), 4) as cosine from x join c on x.label = c.label and x.i = c.i group by vec_id, x.label"""


@query("q46_embedding_cosine", CENTRE_SQL)
def q46(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector against the mean of its label's vectors."""
    e = table(spark, sf_dir, "embeddings")
    at = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    centre = at.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("centre"))
    return e.join(centre, "label").select("vec_id", "label", r4(overlap.cosine(F.col("embedding"), F.col("centre"))).alias("cosine"))


@query("q47_bootstrap_ci")
def q47(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = collapse_items(one_run(spark, sf_dir))
    mean = rt.bootstrap_intervals(items).select("stage", r4("low").alias("mean_low"), r4("high").alias("mean_high"))
    return mean.join(rt.bootstrap_intervals(items, kind="median").select("stage", r4("low").alias("median_low"), r4("high").alias("median_high")), "stage")


@query("q48_text_chunker")
def q48(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunker.chunk_texts(turns(spark, sf_dir), "item", "text")


@query("q49_json_recovery")
def q49(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "text")
    n = (F.col("n_chars") % 7).cast("string")
    forms = F.array(F.concat(F.lit('{"score": '), n, F.lit("}")), F.concat(F.lit("```json\n{'score': "), n, F.lit(",}\n```")), F.concat(F.lit("score "), n, F.lit(" of 5")), F.lit("none"))
    reply = F.concat_ws(" ", "text", F.element_at(forms, (F.col("doc_id") % 4 + 1).cast("int")))
    return d.select("doc_id", reply.alias("reply")).select("doc_id", recovered_score(1, 5)("reply").alias("score"))


@query("q50_selfcheck_factprecision")
def q50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Self-consistency against the question's own words, and claims labelled by the stub judge.

    What a Python step makes is dealt out before the next, so a task has one Python worker, not one for each step.
    """
    t = turns(spark, sf_dir)
    parts = t.select("item", F.posexplode(F.split("text", r"[.!?]\s+")).alias("sentence", "s"), F.split("question", r"[.!?]\s+").alias("qs"))
    support = parts.select("item", "sentence", F.lit(0).alias("sample"), "s", F.posexplode("qs").alias("other", "q")).select("item", "sentence", "sample", "other", overlap.token_scores(answer_tokens(F.col("s")), answer_tokens(F.col("q")))["f1"].alias("score"))
    check = models.self_check(support)
    asked = models.ask_all(t.select("item", F.concat_ws("\n", F.lit("claims of:"), "text").alias("prompt")), ["item"], models.stub)
    asked.select("item", "reply").repartition("item").createOrReplaceTempView("voicegauge_replies")
    spark.udtf.register("voicegauge_claims", models.Claims)
    claims = spark.sql("select item, c.claim_no, c.claim from voicegauge_replies, lateral voicegauge_claims(reply, 10) c").repartition("item")
    labels = models.ask_all(claims.select("item", F.concat_ws("\n", F.lit("supported?"), "item", "claim").alias("prompt")), ["item"], models.stub)
    facts = models.fact_precision(labels.select("item", F.regexp_extract("reply", r'"label": "(\w+)"', 1).alias("label")))
    return check.join(facts, "item", "left").select("item", r4("mean").alias("inconsistency"), r4("max").alias("worst"), "flagged", "n_claims", r4("precision").alias("precision"))


@query("q53_simple_wer", None)
def q53(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    return t.select("item", sweep.simple_wer(F.col("question"), F.regexp_replace("question", r"\bthe\b", "a")).alias("wer"))


@query("q54_delay_model", "with p as (select value as wait_ms, user_id % 6 * 50 as chunk_ms, value + 280 + 0.4::double * (user_id % 6 * 50) + event_id % 3 as delay_ms from events) select count(*) as n, round(regr_slope(delay_ms - wait_ms, chunk_ms), 4) as slope, round(regr_intercept(delay_ms - wait_ms, chunk_ms), 4) as intercept from p")
def q54(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunk = F.col("user_id") % 6 * 50
    p = table(spark, sf_dir, "events").select(F.col("value").alias("wait_ms"), chunk.alias("chunk_ms"), (F.col("value") + 280 + 0.4 * chunk + F.col("event_id") % 3).alias("delay_ms"))
    return sweep.fit_delay(p).select("n", r4("slope").alias("slope"), r4("intercept").alias("intercept"))
