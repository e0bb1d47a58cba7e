"""Queries over latency logs: collapse, summaries, intervals, tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voicegauge.operators import agreement, collapse, orderstats, pairing
from voicegauge.operators import ranktests as rt
from voicegauge.plans.registry import query
from voicegauge.plans.tables import ITEMS_SQL, LOG_SQL, PAIRS_SQL, event_log, halves, one_run, r4, table

ONE_SQL = "log as (select 'all' as run, cast(user_id as varchar) as item, event_type as stage, value, event_id as pos, props from events), firsts as (select item, row_number() over (order by min(pos), item) as place from log group by item), kept as (select l.* from log l join firsts f on l.item = f.item where place > 1), items as (select stage, item, count(*) as n_rep, quantile_cont(value, 0.5) as value from kept group by all)"


def _warm(spark, sf_dir):
    return collapse.collapse_items(collapse.drop_warmup(one_run(spark, sf_dir), 1))


@query("q01_item_collapse", f"with {ONE_SQL} select stage, item, n_rep, round(value, 4) as median from items")
def q01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _warm(spark, sf_dir).select("stage", "item", "n_rep", r4("value").alias("median"))


CI_SQL = f"""with {ONE_SQL},
    sizes as (select stage, count(*) as n, avg(value) as mean, stddev_samp(value) as sd, quantile_cont(value, 0.5) as p50, quantile_cont(value, 0.9) as p90 from items group by stage),
    facts as (select k, sum(case when k = 0 then 0 else ln(greatest(k, 1)) end) over (order by k) as lf from range((select max(n) + 1 from sizes)) r(k)),
    terms as (select s.stage, s.n, k.k, exp(fn.lf - k.lf - fr.lf + s.n * ln(0.5::double)) as p from sizes s join facts k on k.k <= s.n join facts fn on fn.k = s.n join facts fr on fr.k = s.n - k.k),
    cdf as (select stage, n, k, sum(p) over (partition by stage order by k) as c from terms),
    ranks as (select stage, max(case when c <= 0.025 then k + 1 end) as low, min(case when c >= 0.975 then k + 1 end) as high from cdf group by stage),
    ordered as (select stage, value, row_number() over (partition by stage order by value) as r from items)
    select s.stage, s.n, round(s.mean, 4) as mean, round(s.sd, 4) as sd, round(s.p50, 4) as p50, round(s.p90, 4) as p90,
      round((select o.value from ordered o where o.stage = s.stage and o.r = ranks.low), 4) as ci_low, round((select o.value from ordered o where o.stage = s.stage and o.r = ranks.high), 4) as ci_high
    from sizes s join ranks on ranks.stage = s.stage"""


@query("q02_stage_quantile_ci", CI_SQL)
def q02(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _warm(spark, sf_dir)
    return collapse.full_summary(items).select("stage", "n", *(r4(c).alias(c) for c in ("mean", "sd", "p50", "p90", "ci_low", "ci_high")))


@query("q03_stage_summary", f"with {ITEMS_SQL}, s as (select stage, count(value) as n, quantile_cont(value, 0.5) as median, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3, quantile_cont(value, 0.9) as p90, quantile_cont(value, 0.95) as p95, max(value) as max from items group by stage) select stage, n, round(median, 4) as median, round(q1, 4) as q1, round(q3, 4) as q3, round(p90, 4) as p90, round(p95, 4) as p95, round(max, 4) as max, round(q3 - q1, 4) as iqr from s")
def q03(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = collapse.stage_summary(collapse.collapse_items(event_log(spark, sf_dir)))
    return s.select("stage", "n", *(r4(c).alias(c) for c in ("median", "q1", "q3", "p90", "p95", "max", "iqr")))


@query("q04_extra_metrics", "with x as (select cast(user_id as varchar) as item, event_id as pos, try_cast(json_extract_string(props, '$.k') as double) as k from events) select item, round(arg_max(k, pos), 4) as k_last, round(quantile_cont(k, 0.5), 4) as k_median from x where k is not null group by item")
def q04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse.extra_metrics(one_run(spark, sf_dir), "extra_json", "k").select("item", r4("last").alias("k_last"), r4("median").alias("k_median"))


@query("q05_per_run_rollup", "with log as (select strftime(ts, '%Y-%m-%d') as run, event_type as stage, user_id as item, value from events), items as (select run, stage, item, quantile_cont(value, 0.5) as value from log group by all) select run, stage, count(value) as n, round(quantile_cont(value, 0.5), 4) as p50 from items group by grouping sets ((run, stage), (stage))")
def q05(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir).withColumn("run", F.date_format("ts", "yyyy-MM-dd"))
    return collapse.run_rollup(collapse.collapse_items(log), None).select("run", "stage", "n", r4("p50").alias("p50"))


@query("q06_context_drift", "with c as (select cast(c_nationkey as varchar) as run, case when trim(c_mktsegment) = '' or c_mktsegment is null then '(unset)' else trim(c_mktsegment) end as v from customer), d as (select distinct run, v from c) select run, 'c_mktsegment' as \"column\", string_agg(v, '|' order by v) as \"values\", count(*) as n from d group by run")
def q06(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("run"), "c_mktsegment")
    return collapse.context_values(log, ("c_mktsegment",))


@query("q07_pair_items", f"with {LOG_SQL}, n as (select run, stage || ':' || item as key, value, row_number() over (partition by run, stage, item order by pos) as occ from log) select coalesce(a.key, b.key) as key, coalesce(a.occ, b.occ) as occ, a.value as base_value, b.value as contrast_value, a.key is null as only_contrast, b.key is null as only_base from (select * from n where run = 'base') a full join (select * from n where run = 'current') b on a.key = b.key and a.occ = b.occ")
def q07(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir).withColumn("key", F.concat_ws(":", "stage", "item"))
    out = pairing.pair_occurrences(log.where("run = 'base'"), log.where("run = 'current'"))
    return out.select("key", F.col("occ").cast("long").alias("occ"), "base_value", "contrast_value", F.col("in_base").isNull().alias("only_contrast"), F.col("in_contrast").isNull().alias("only_base"))


def _pairs(spark, sf_dir):
    a, b = halves(spark, sf_dir)
    return pairing.pair_items(a, b)


RANKS = "nz as (select stage, abs(d) as m, d > 0 as up from pairs where d <> 0), tied as (select stage, m, count(*) as t, count(*) filter (up) as ups from nz group by stage, m), ranked as (select *, sum(t) over (partition by stage order by m) - (t - 1) / 2.0::double as r from tied), w as (select stage, sum(t)::bigint as n, sum(ups * r) as w_plus, sum(t::double * t * t - t) as ties from ranked group by stage)"


@query("q08_wilcoxon_stat", f"with {PAIRS_SQL}, {RANKS}, v as (select stage, n, w_plus, n::double * (n + 1) / 4 as mu, n::double * (n + 1) * (2 * n + 1) / 24 - ties / 48 as variance from w) select stage, n, round(w_plus, 4) as w_plus, round(variance, 4) as variance, case when n > 20 then round((w_plus - mu - sign(w_plus - mu) * least(0.5, abs(w_plus - mu))) / sqrt(variance), 4) end as z, round((w_plus - mu - case when w_plus < mu then -0.5 else 0.5 end) / sqrt(variance), 4) as z_evaluation from v")
def q08(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rt.signed_rank(_pairs(spark, sf_dir))
    off = F.col("w_plus") - F.col("mean")
    z = (off - F.signum(off) * F.least(F.lit(0.5), F.abs(off))) / F.sqrt("variance")
    z_evaluation = (off - F.when(off < 0, -0.5).otherwise(0.5)) / F.sqrt("variance")
    return s.where("n > 0").select("stage", "n", r4("w_plus").alias("w_plus"), r4("variance").alias("variance"), F.when(F.col("n") > 20, r4(z)).alias("z"), r4(z_evaluation).alias("z_evaluation"))


WALSH = "sizes as (select stage, count(*) as n from pairs group by stage), o as (select stage, d, row_number() over (partition by stage order by d) as i from pairs), walsh as (select a.stage, (a.d + b.d) / 2 as v from o a join o b on a.stage = b.stage and a.i <= b.i), wr as (select stage, v, row_number() over (partition by stage order by v) as r, count(*) over (partition by stage) as m from walsh), ks as (select stage, n, floor(n::double * (n + 1) / 4 - 1.959963984540054::double * sqrt(n::double * (n + 1) * (2 * n + 1) / 24))::bigint as k from sizes)"


@query("q09_hodges_lehmann", f"with {PAIRS_SQL}, {WALSH} select wr.stage, ks.n, round(quantile_cont(v, 0.5), 4) as shift, case when k >= 0 and 2 * k < max(m) and ks.n >= 2 then round(max(case when r = k + 1 then v end), 4) end as ci_low, case when k >= 0 and 2 * k < max(m) and ks.n >= 2 then round(max(case when r = m - k then v end), 4) end as ci_high from wr join ks on wr.stage = ks.stage group by wr.stage, ks.n, k")
def q09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.hodges_lehmann(_pairs(spark, sf_dir)).select("stage", "n", *(r4(c).alias(c) for c in ("shift", "ci_low", "ci_high")))


MW = "rows as (select stage, case when run = 'current' then 'a' else 'b' end as side, value from items), tied as (select stage, value, count(*) as t, count(*) filter (side = 'a') as a from rows group by stage, value), ranked as (select *, sum(t) over (partition by stage order by value) - (t - 1) / 2.0::double as r from tied), s as (select stage, sum(a)::bigint as n_a, sum(t - a)::bigint as n_b, sum(a * r) as ra, sum(t::double * t * t - t) as ties from ranked group by stage), u as (select *, ra - n_a::double * (n_a + 1) / 2 as u, n_a::double * n_b / 12 * ((n_a + n_b + 1) - ties / ((n_a + n_b)::double * (n_a + n_b - 1))) as variance, n_a::double * n_b / 2 as mu from s)"


@query("q10_mann_whitney_cliff", f"with {ITEMS_SQL}, {MW} select stage, n_a, n_b, round(u, 4) as u, round((u - mu - sign(u - mu) * least(0.5, abs(u - mu))) / sqrt(variance), 4) as z, round(2 * u / (n_a::double * n_b) - 1, 4) as delta, case when abs(2 * u / (n_a::double * n_b) - 1) < 0.147 then 'negligible' when abs(2 * u / (n_a::double * n_b) - 1) < 0.33 then 'small' when abs(2 * u / (n_a::double * n_b) - 1) < 0.474 then 'medium' else 'large' end as label from u where n_a >= 3 and n_b >= 3 and variance > 0")
def q10(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = collapse.collapse_items(event_log(spark, sf_dir)).withColumn("side", F.when(F.col("run") == "current", "a").otherwise("b"))
    m = rt.mann_whitney(items).where("u is not null")
    return m.select("stage", "n_a", "n_b", r4("u").alias("u"), r4("z").alias("z"), r4("delta").alias("delta"), rt.effect_label(F.col("delta")).alias("label"))


SHIFT_SQL = f"""with {ITEMS_SQL}, r as (select stage, case when run = 'current' then 'a' else 'b' end as side, value from log),
    n as (select stage, count(*) filter (side = 'a') as n_a, count(*) filter (side = 'b') as n_b, quantile_cont(case when side = 'a' then value end, 0.5) - quantile_cont(case when side = 'b' then value end, 0.5) as far from r group by stage),
    few as (select r.* from r join n on r.stage = n.stage where n_a * n_b <= 4000000),
    d as (select a.stage, quantile_cont(a.value - b.value, 0.5) as shift from few a join few b on a.stage = b.stage and a.side = 'a' and b.side = 'b' group by a.stage)
    select n.stage, n_a, n_b, round(coalesce(d.shift, far), 4) as shift from n left join d on n.stage = d.stage"""


@query("q11_two_sample_shift", SHIFT_SQL)
def q11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events of the second half against all of the first."""
    rows = event_log(spark, sf_dir).withColumn("side", F.when(F.col("run") == "current", "a").otherwise("b"))
    return rt.two_sample_shift(rows).select("stage", "n_a", "n_b", r4("shift").alias("shift"))


HOLM = "t as (select p_brand as family, p_partkey as key, case when p_size % 7 = 0 then null else round(1.0::double / (1 + p_partkey % 97), 6) end as p from part)"


@query("q12_holm", f"with {HOLM}, r as (select *, count(*) over (partition by family) as m, row_number() over (partition by family order by p, key) as i from t where p is not null), h as (select family, key, p, max(least(1.0::double, (m - i + 1) * p)) over (partition by family order by p, key rows unbounded preceding) as h from r) select family, key, p, round(h, 6) as p_holm, h <= 0.05 as reject from h union all select family, key, p, null, null from t where p is null")
def q12(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part").select(F.col("p_brand").alias("family"), F.col("p_partkey").alias("key"), F.when(F.col("p_size") % 7 != 0, F.round(1.0 / (1 + F.col("p_partkey") % 97), 6)).alias("p"))
    return orderstats.holm(t, "p", ("family",), ("key",)).select("family", "key", "p", F.round("p_holm", 6).alias("p_holm"), (F.col("p_holm") <= 0.05).alias("reject"))


@query("q13_detectable_shift", f"with {PAIRS_SQL} select stage, count(d) as n, round((1.959963984540054::double + 0.8416212335729143::double) * stddev_samp(d) / sqrt(count(d)), 4) as mds from pairs group by stage")
def q13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.detectable_shift(_pairs(spark, sf_dir)).select("stage", "n", r4("mds").alias("mds"))


@query("q14_mcnemar", "with b as (select d.lang, l.quality = 1 as before, l.toxic = 0 as after from labels l join documents d using (doc_id)), s as (select lang, count(*) as n, count(*) filter (not before and after) as gained, count(*) filter (before and not after) as lost from b group by lang) select lang, n, gained, lost, round(case when gained + lost = 0 then 0 when gained + lost < 25 then least(gained, lost) else pow(abs(gained - lost) - 1, 2) / (gained + lost) end::double, 4) as statistic, case when gained + lost = 0 then 1.0::double when gained + lost < 25 then round(least(1.0::double, 2 * (select sum(exp(lgamma(gained + lost + 1) - lgamma(k + 1) - lgamma(gained + lost - k + 1))) from range(0, least(gained, lost) + 1) r(k)) / pow(2.0::double, gained + lost)), 4) end as p_exact from s")
def q14(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").select("lang", (F.col("quality") == 1).alias("before"), (F.col("toxic") == 0).alias("after"))
    m = rt.mcnemar(b, ("lang",))
    return m.select("lang", "n", "gained", "lost", r4("statistic").alias("statistic"), F.when(F.col("gained") + F.col("lost") < 25, r4("p")).alias("p_exact"))


@query("q15_tost_moments", f"with {PAIRS_SQL}, p as (select stage, count(d) as n, avg(d) as m, sqrt(var_samp(d) / count(d)) as se from pairs group by stage), w as (select stage, count(*) filter (run = 'current') as na, count(*) filter (run = 'base') as nb, var_samp(value) filter (run = 'current') as va, var_samp(value) filter (run = 'base') as vb from items group by stage) select p.stage, n, round(m, 4) as mean_diff, round(se, 4) as se, round((m + 5) / se, 4) as t_lower, round((m - 5) / se, 4) as t_upper, (n - 1)::double as df, round(pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)), 4) as welch_df from p join w on p.stage = w.stage")
def q15(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = collapse.collapse_items(event_log(spark, sf_dir)).withColumn("side", F.when(F.col("run") == "current", "a").otherwise("b"))
    p = rt.paired_tost(_pairs(spark, sf_dir), 5.0)
    w = rt.welch_tost(items, 5.0).select("stage", F.col("df").alias("welch_df"))
    return p.join(w, "stage").select("stage", "n", *(r4(c).alias(c) for c in ("mean_diff", "se", "t_lower", "t_upper")), "df", r4("welch_df").alias("welch_df"))


@query("q16_spearman_kendall", "with r as (select p_brand as brand, rank() over (partition by p_brand order by p_size) + (count(*) over (partition by p_brand, p_size) - 1) / 2.0::double as rx, rank() over (partition by p_brand order by p_retailprice) + (count(*) over (partition by p_brand, p_retailprice) - 1) / 2.0::double as ry from part), rho as (select brand, count(*) as n, case when count(*) >= 3 then corr(rx, ry) end as rho from r group by brand), pr as (select a.p_brand as brand, sum(sign(a.p_size - b.p_size) * sign(a.p_retailprice - b.p_retailprice))::double as s, count(*) filter (a.p_size <> b.p_size)::double as nx, count(*) filter (a.p_retailprice <> b.p_retailprice)::double as ny from part a join part b on a.p_brand = b.p_brand and a.p_partkey < b.p_partkey group by 1) select rho.brand, n, round(rho, 4) as rho, round(s / (sqrt(nx) * sqrt(ny)), 4) as tau_b from rho join pr on rho.brand = pr.brand")
def q16(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumnRenamed("p_brand", "brand")
    return rt.spearman(p, "p_size", "p_retailprice", ("brand",)).join(rt.kendall(p, "p_size", "p_retailprice", ("brand",)), "brand").select("brand", "n", r4("rho").alias("rho"), r4("tau").alias("tau_b"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two raters of every labelled document, and a third of the even ones; a dimension for each language."""
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    rows = F.array(F.struct(F.lit("a").alias("rater"), F.col("quality").cast("double").alias("score")), F.struct(F.lit("b").alias("rater"), (1 - F.col("toxic")).cast("double").alias("score")), F.struct(F.lit("c").alias("rater"), F.when(F.col("doc_id") % 2 == 0, (F.col("n_chars") % 3).cast("double")).alias("score")))
    return d.select(F.col("lang").alias("dimension"), F.col("doc_id").alias("item"), F.explode(rows).alias("r")).select("dimension", "item", "r.*").where("score is not null")


RATINGS = "d as (select l.doc_id as item, lang as dimension, quality, toxic, n_chars from labels l join documents using (doc_id)), ratings as (select dimension, item, 'a' as rater, quality::double as score from d union all select dimension, item, 'b', (1 - toxic)::double from d union all select dimension, item, 'c', (n_chars % 3)::double from d where item % 2 = 0)"
PANEL = f"""with {RATINGS},
    cells as (select *, sum(c) over (partition by dimension, item)::bigint as m from (select dimension, item, score, count(*) as c from ratings group by all)),
    pct as (select dimension, sum(case when a.score = b.score then 1 else 0 end)::double / count(*) as pct from ratings a join ratings b using (dimension, item) where a.rater < b.rater group by dimension),
    two as (select dimension, max(score) filter (rater = 'a') as a, max(score) filter (rater = 'b') as b from ratings where rater <> 'c' group by dimension, item),
    two_n as (select dimension, count(*)::double as n, count(*) filter (a = b)::double as same from two group by dimension),
    two_e as (select dimension, sum(ka * kb)::double as e from (select dimension, a as v, count(*) as ka from two group by all) join (select dimension, b as v, count(*) as kb from two group by all) using (dimension, v) group by dimension),
    kappa as (select dimension, (same / n - e / (n * n)) / (1 - e / (n * n)) as kappa from two_n join two_e using (dimension)),
    sizes as (select dimension, m, count(distinct item) as k, min(item) as f from cells where m >= 2 group by all),
    modal as (select dimension, m as modal, k as items from (select *, row_number() over (partition by dimension order by k desc, f) as r from sizes) where r = 1),
    fl as (select dimension, max(items)::double as n, max(modal)::double as m, sum(c * c)::double as sq from cells join modal using (dimension) where m = modal group by dimension),
    fe as (select dimension, sum(c * c)::double as ch from (select dimension, score, sum(c)::double as c from cells join modal using (dimension) where m = modal group by all) group by dimension),
    fleiss as (select dimension, ((sq - n * m) / (n * m * (m - 1)) - ch / pow(n * m, 2)) / (1 - ch / pow(n * m, 2)) as fleiss from fl join fe using (dimension)),
    un as (select dimension, count(distinct item)::double as n, count(distinct score) as q, sum(c * (c - 1)::double / (m * (m - 1))) as same from cells where m >= 2 group by dimension),
    ge as (select dimension, sum(s / n * (1 - s / n)) / (max(q) - 1) as pe from (select dimension, score, sum(c::double / m) as s from cells where m >= 2 group by all) join un using (dimension) group by dimension),
    ac1 as (select dimension, (same / n - pe) / (1 - pe) as ac1 from un join ge using (dimension)),
    vals as (select dimension, score, t, sum(t) over (partition by dimension order by score) as upto from (select dimension, score, sum(c)::double as t from cells where m >= 2 group by all)),
    dl as (select a.dimension, a.score as sa, b.score as sb, a.t as ta, b.t as tb, 1.0::double as nom, pow(abs(b.upto - a.upto) + case when a.score < b.score then a.t else b.t end - (a.t + b.t) / 2, 2) as ord from vals a join vals b on a.dimension = b.dimension and a.score <> b.score),
    ex as (select dimension, sum(ta * tb * nom) as en, sum(ta * tb * ord) as eo from dl group by dimension),
    ob as (select x.dimension, sum(x.c::double * y.c / (x.m - 1) * nom) as o_n, sum(x.c::double * y.c / (x.m - 1) * ord) as o_o from cells x join cells y on x.dimension = y.dimension and x.item = y.item and x.score <> y.score join dl on dl.dimension = x.dimension and dl.sa = x.score and dl.sb = y.score where x.m >= 2 group by x.dimension),
    nn as (select dimension, sum(c)::double as n from cells where m >= 2 group by dimension)
    select dimension, round(pct, 4) as pct, round(fleiss, 4) as fleiss, round(ac1, 4) as ac1, round(1 - (o_n / n) / (en / (n * (n - 1))), 4) as alpha_nominal, round(1 - (o_o / n) / (eo / (n * (n - 1))), 4) as alpha_ordinal, round(kappa, 4) as kappa_ab
    from pct join fleiss using (dimension) join ac1 using (dimension) join ex using (dimension) join ob using (dimension) join nn using (dimension) join kappa using (dimension)"""


@query("q17_agreement_panel", PANEL)
def q17(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ratings(spark, sf_dir)
    two = agreement.cohen_kappa(r.where("rater <> 'c'")).withColumnRenamed("kappa", "kappa_ab")
    return agreement.agreement_panel(r).join(two, "dimension").select("dimension", *(r4(c).alias(c) for c in ("pct", "fleiss", "ac1", "alpha_nominal", "alpha_ordinal", "kappa_ab")))


ICC = """with r as (select l_returnflag as dimension, l_orderkey * 10 + l_linenumber as item, unnest(['q', 'd', 't']) as rater, unnest([l_quantity / 10, l_discount * 50, l_tax * 60]) as score from lineitem),
    one as (select dimension, item, rater, avg(score) as score from r group by all),
    g as (select dimension, var_pop(score) as v, count(distinct item)::double as n, count(distinct rater)::double as k from one group by dimension),
    gi as (select dimension, var_pop(m) as vi from (select dimension, item, avg(score) as m from one group by all) group by dimension),
    gr as (select dimension, var_pop(m) as vr from (select dimension, rater, avg(score) as m from one group by all) group by dimension),
    ms as (select dimension, n, k, vi * n * k / (n - 1) as r, vr * n * k / (k - 1) as c, (v - vi - vr) * n * k / ((n - 1) * (k - 1)) as e from g join gi using (dimension) join gr using (dimension))
    select dimension, round((r - e) / (r + (k - 1) * e + k * (c - e) / n), 4) as icc_2_1, round((r - e) / (r + (c - e) / n), 4) as icc_2_k, n::bigint as n, k::bigint as k, 0::bigint as dropped from ms"""


@query("q18_icc", ICC)
def q18(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    # an item's ratings are averaged before they become rows
    scores = {"q": F.col("l_quantity") / 10, "d": F.col("l_discount") * 50, "t": F.col("l_tax") * 60}
    items = li.groupBy(F.col("l_returnflag").alias("dimension"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item")).agg(*(F.avg(c).alias(n) for n, c in scores.items()))
    cells = F.array(*(F.struct(F.lit(n).alias("rater"), F.col(n).alias("score")) for n in scores))
    return agreement.icc_of_items(items.select("dimension", "item", cells.alias("cells"))).select("dimension", r4("icc_2_1").alias("icc_2_1"), r4("icc_2_k").alias("icc_2_k"), "n", "k", "dropped")


@query("q19_ppi", "with s as (select lang, quality::double as human, least(n_chars / 4000.0::double, 1.0) as judge from documents left join labels using (doc_id)), a as (select lang, count(human) as n_lab, count(*) filter (human is null) as n_unl, avg(judge - human) as bias, avg(abs(human - judge)) as mae, avg(judge) filter (human is null) + avg(human - judge) as ppi, sqrt(var_samp(judge) filter (human is null) / count(*) filter (human is null) + var_samp(human - judge) / count(human)) as se from s group by lang) select lang, n_lab, n_unl, round(bias, 4) as bias, round(mae, 4) as mae, round(ppi, 4) as ppi, round(ppi - 1.959963984540054::double * se, 4) as low, round(ppi + 1.959963984540054::double * se, 4) as high from a where n_lab >= 2 and n_unl >= 2")
def q19(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("lang", F.col("quality").cast("double").alias("human"), F.least(F.col("n_chars") / 4000.0, F.lit(1.0)).alias("judge"))
    return agreement.prediction_powered(s, ("lang",)).where("ppi is not null").select("lang", "n_lab", "n_unl", *(r4(c).alias(c) for c in ("bias", "mae", "ppi", "low", "high")))
