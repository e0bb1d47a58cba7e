"""Worked examples with known values, and properties on random samples."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voicegauge.functions import kernels as K
from voicegauge.operators import agreement, collapse, compare, orderstats, pairing
from voicegauge.operators import ranktests as rt


def ratings(spark, rows, dimension="d"):
    """rows: one list of scores an item, null for a missing cell."""
    return spark.createDataFrame([(dimension, i, str(r), float(s)) for i, row in enumerate(rows) for r, s in enumerate(row) if s is not None], "dimension string, item long, rater string, score double")


def test_two_by_two_table(spark):
    r = ratings(spark, [[1, 1]] * 20 + [[1, 0]] * 5 + [[0, 1]] * 10 + [[0, 0]] * 15)
    got = agreement.agreement_panel(r).first()
    assert got.pct == pytest.approx(0.70) and got.kappa == pytest.approx(0.40) and got.ac1 == pytest.approx((0.70 - 0.495) / (1 - 0.495))


def test_icc_of_six_targets_and_four_judges(spark):
    # Shrout and Fleiss (1979), table 2
    got = agreement.icc(ratings(spark, [[9, 2, 5, 8], [6, 1, 3, 2], [8, 4, 6, 8], [7, 1, 2, 6], [10, 5, 6, 9], [6, 2, 4, 7]])).first()
    assert got.icc_2_1 == pytest.approx(0.290, abs=0.01) and got.icc_2_k == pytest.approx(0.620, abs=0.01) and got.dropped == 0


def test_alpha_of_identical_ratings_is_one(spark):
    got = agreement.krippendorff(ratings(spark, [[1, 1], [1, 1], [1, 1]]), "nominal").first()
    assert got.alpha_nominal == 1.0


def test_alpha_against_pairs(spark):
    rows = [[1, 2, 3], [3, 3, None], [2, 2, 2], [1, None, 2], [4, 3, 4], [1, 1, None], [None, 5, None]]
    units = [[s for s in r if s is not None] for r in rows]
    units = [u for u in units if len(u) > 1]
    values = [v for u in units for v in u]
    n = len(values)
    o = sum(sum((a - b) ** 2 for a in u for b in u) / (len(u) - 1) for u in units) / n
    e = sum((a - b) ** 2 for a in values for b in values) / (n * (n - 1))
    assert agreement.krippendorff(ratings(spark, rows), "interval").first().alpha_interval == pytest.approx(1 - o / e)


def test_prediction_powered_mean_removes_a_constant_bias(spark):
    r = random.Random(1)
    truth = [r.gauss(3, 1) for _ in range(200)]
    rows = [(t if i < 50 else None, t + 1) for i, t in enumerate(truth)]
    got = agreement.prediction_powered(spark.createDataFrame(rows, "human double, judge double")).first()
    assert got.bias == pytest.approx(1.0) and got.ppi == pytest.approx(sum(truth[50:]) / 150) and got.low < got.ppi < got.high


def paired(spark, ds):
    return spark.createDataFrame([("s", str(i), 0.0, 0.0, float(d)) for i, d in enumerate(ds)], "stage string, item string, a double, b double, d double")


def test_signed_rank_examples(spark):
    s = rt.signed_rank(paired(spark, [1, 2, 3, 4, 5, -1]))
    assert rt.evaluation_signed_rank(s).first().statistic == 1.5
    two = rt.evaluation_signed_rank(rt.signed_rank(paired(spark, [1, 1, -1, -1]))).first()
    assert two.p == pytest.approx(0.841, abs=1e-3)
    assert rt.log_signed_rank(rt.signed_rank(paired(spark, [1, 2, 3, -4, 5]))).first().p is None
    exact = rt.log_signed_rank(rt.signed_rank(paired(spark, [1, 2, 3, 4, 5, 6]))).first()
    assert exact.method == "exact" and exact.p == pytest.approx(2 / 64)
    none = rt.evaluation_signed_rank(rt.signed_rank(paired(spark, [0, 0]))).first()
    assert none.p == 1.0 and none.n == 0


def test_mcnemar_eight_to_one(spark):
    rows = [(False, True)] * 8 + [(True, False)] + [(True, True)] * 4
    got = rt.mcnemar(spark.createDataFrame(rows, "before boolean, after boolean")).first()
    assert got.p == pytest.approx(2 * 10 / 512) and got.gained == 8 and got.lost == 1


def test_holm_by_family(spark):
    df = spark.createDataFrame([("a", "1", 0.001), ("a", "2", 0.02), ("a", "3", 0.04), ("a", "4", 0.5), ("b", "1", 0.02), ("b", "2", None)], "family string, k string, p double")
    got = {(r.family, r.k): r.p_holm for r in orderstats.holm(df, "p", ("family",)).collect()}
    assert got[("a", "1")] == pytest.approx(0.004) and got[("b", "1")] == pytest.approx(0.02) and got[("b", "2")] is None
    assert got[("a", "1")] <= got[("a", "2")] <= got[("a", "3")] <= got[("a", "4")]


@pytest.mark.parametrize(("q", "least"), [(0.9, 36), (0.95, 72), (0.99, 368)])
def test_sizes_at_which_an_interval_closes(q, least):
    assert None in orderstats.interval_ranks(least - 1, q) and None not in orderstats.interval_ranks(least, q)


@settings(max_examples=50, deadline=None)
@given(st.integers(2, 400), st.sampled_from([0.1, 0.5, 0.9]))
def test_interval_ranks_against_the_sum(n, q):
    terms = [math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(q) + (n - i) * math.log1p(-q)) for i in range(n + 1)]
    cdf = [math.fsum(terms[: i + 1]) for i in range(n + 1)]
    low = max((r for r in range(1, n + 1) if cdf[r - 1] <= 0.025 - 1e-13), default=None)
    high = min((r for r in range(1, n + 1) if cdf[r - 1] >= 0.975 + 1e-13), default=None)
    assert orderstats.interval_ranks(n, q) == (low, high)


def test_select_ranks_is_exact(spark):
    r = random.Random(3)
    values = {g: sorted(r.choice([r.random(), r.randint(0, 5)]) for _ in range(n)) for g, n in (("a", 1), ("b", 7), ("c", 900))}
    items = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs], "stage string, value double")
    wanted = [(g, k) for g, vs in values.items() for k in {1, len(vs), (len(vs) + 1) // 2}]
    got = orderstats.select_ranks(items, spark.createDataFrame(wanted, "stage string, rank long")).collect()
    assert {(x.stage, x["rank"]): x.value for x in got} == {(g, k): float(values[g][k - 1]) for g, k in wanted}


def test_hodges_lehmann_against_all_pairs(spark):
    r = random.Random(5)
    d = [float(r.randint(-9, 20)) for _ in range(25)]
    walsh = sorted((a + b) / 2 for i, a in enumerate(sorted(d)) for b in sorted(d)[i:])
    k = math.floor(25 * 26 / 4 - rt.Z975 * math.sqrt(25 * 26 * 51 / 24))
    got = rt.hodges_lehmann(paired(spark, d)).first()
    assert (got.shift, got.ci_low, got.ci_high) == (K.quantile(walsh, 0.5), walsh[k], walsh[len(walsh) - 1 - k])


def test_kendall_and_spearman_with_ties(spark):
    rows = [("g", 1, 2), ("g", 2, 2), ("g", 3, 5), ("g", 3, 4), ("g", 1, 1), ("g", 5, 2)]
    pairs = [(a, b) for i, a in enumerate(rows) for b in rows[i + 1 :]]
    sign = lambda v: (v > 0) - (v < 0)
    s = sum(sign(a[1] - b[1]) * sign(a[2] - b[2]) for a, b in pairs)
    x, y = sum(a[1] != b[1] for a, b in pairs), sum(a[2] != b[2] for a, b in pairs)
    df = spark.createDataFrame(rows, "g string, x int, y int")
    assert rt.kendall(df, "x", "y", ("g",)).first().tau == pytest.approx(s / math.sqrt(x * y))
    assert rt.spearman(df.limit(2), "x", "y", ("g",)).first().rho is None


def test_tails():
    assert K.upper_tail(1.959963984540054) == pytest.approx(0.025)
    assert K.student_upper(2.228138851964939, 10) == pytest.approx(0.025, abs=1e-9) and K.student_upper(-2.228138851964939, 10) == pytest.approx(0.975, abs=1e-9)
    assert K.student_upper(0, 5) == pytest.approx(0.5)


def test_bootstraps_need_enough_values():
    assert K.mean_interval(range(19)) == (None, None) and K.statistic_interval([1, 2]) == (None, None) and K.paired_interval([1, 2], [2, 3]) == (None, None)
    low, high = K.mean_interval(list(range(40)), resamples=500)
    assert low < 19.5 < high and K.mean_interval(list(range(40)), resamples=500) == (low, high)


LOG = [("r", 0, "00001", "stt", 100.0), ("r", 1, "00001", "llm_ttft", 200.0), ("r", 2, "00001", "llm_eval", 300.0), ("r", 3, "00002", "stt", 400.0), ("r", 4, "00002", "llm_ttft", 500.0), ("r", 5, "00002", "llm_ttft", 700.0), ("r", 6, "00003", "stt", 900.0), ("r", 7, "00003", "llm_ttft", 1000.0)]


def test_collapse_and_warm_up(spark):
    log = spark.createDataFrame(LOG, "run string, pos long, item string, stage string, value double")
    items = {(r.item, r.stage): r.value for r in collapse.collapse_items(log).collect()}
    assert items[("00002", "llm_ttft")] == 600
    warm = collapse.collapse_items(collapse.drop_warmup(log, 1))
    assert {r.stage: r.median for r in collapse.stage_summary(warm).collect()}["stt"] == 650
    one = collapse.moments(warm.where("stage = 'stt' and item = '00003'")).first()
    assert one.sd is None and collapse.moments(warm.where("item = '00003' and stage = 'stt'"), single_sd=0.0).first().sd == 0


def test_numbers_are_read_tolerantly(spark):
    df = spark.createDataFrame([("1.5",), (" 2 ",), ("[N/A]",), ("",), ("nan",), (None,)], "x string")
    assert [r[0] for r in df.select(collapse.numeric(df.x)).collect()] == [1.5, 2.0, None, None, None, None]


def test_pairing_by_occurrence(spark):
    a = spark.createDataFrame([("x", 0, 1.0), ("x", 1, 2.0), ("y", 2, 3.0)], "key string, pos long, value double")
    b = spark.createDataFrame([("x", 0, 5.0), ("z", 1, 6.0)], "key string, pos long, value double")
    got = {(r.key, r.occ): (r.base_value, r.contrast_value) for r in pairing.pair_occurrences(a, b).collect()}
    assert got == {("x", 1): (1.0, 5.0), ("x", 2): (2.0, None), ("y", 1): (3.0, None), ("z", 1): (None, 6.0)}
    assert not pairing.share_items(a.selectExpr("key as stage", "key as item"), b.selectExpr("'q' as stage", "key as item"))


def test_comparison_verdicts(spark):
    r = random.Random(2)
    rows = [("quality_composite", str(i), 3 + r.random(), None) for i in range(60)]
    base = spark.createDataFrame([(m, i, v) for m, i, v, _ in rows] + [("answer_presence", str(i), 0.0) for i in range(60)] + [("word_count", str(i), 5.0) for i in range(60)], "metric string, item string, value double")
    new = spark.createDataFrame([(m, i, v + 0.5) for m, i, v, _ in rows] + [("answer_presence", str(i), float(i < 40)) for i in range(60)] + [("word_count", str(i), 9.0) for i in range(60)], "metric string, item string, value double")
    got = {x.metric: x for x in compare.compare_runs(base, new, compare.catalogue(spark), resamples=200).collect()}
    assert got["quality_composite"].verdict == "improved" and got["answer_presence"].verdict == "improved" and got["word_count"].verdict == "descriptive" and got["word_count"].p_adjusted is None
    assert got["quality_composite"].mean_difference == pytest.approx(0.5) and got["quality_composite"].unchanged == 0
    same = {x.metric: x for x in compare.compare_runs(base, base, compare.catalogue(spark), resamples=200).collect()}
    assert same["quality_composite"].verdict == "equivalent" and same["answer_presence"].verdict == "no detected change"


def _groups(spark, seed, n=70, kinds=12):
    import random

    r = random.Random(seed)
    rows = [(g, r.choice([r.randrange(kinds) / 4, r.gauss(0, 3)]), r.randrange(9) * 1.0) for g in ("a", "b") for _ in range(n)]
    return rows, spark.createDataFrame(rows, "g string, x double, y double").repartition(3)


@pytest.mark.parametrize("least", [1_000_000, 5])
def test_walsh_averages_of_small_and_large_groups(spark, least):
    rows, df = _groups(spark, 3)
    got = {r.g: r for r in rt.hodges_lehmann(df, ("g",), "x", least=least).collect()}
    for g in ("a", "b"):
        x = sorted(v for k, v, _ in rows if k == g)
        walsh = sorted((x[i] + x[j]) / 2 for i in range(len(x)) for j in range(i, len(x)))
        n, m = len(x), len(walsh)
        k = math.floor(n * (n + 1) / 4 - rt.Z975 * math.sqrt(n * (n + 1) * (2 * n + 1) / 24))
        assert got[g].n == n and got[g].shift == pytest.approx((walsh[(m - 1) // 2] + walsh[m // 2]) / 2)
        assert (got[g].ci_low, got[g].ci_high) == (walsh[k], walsh[m - k - 1])


@pytest.mark.parametrize("least", [100_000, 4])
def test_rank_correlations_by_pairs(spark, least):
    rows, df = _groups(spark, 8)
    tau = {r.g: r.tau for r in rt.kendall(df, "x", "y", ("g",), least=least).collect()}
    rho = {r.g: r.rho for r in rt.spearman(df, "x", "y", ("g",)).collect()}
    sign = lambda v: (v > 0) - (v < 0)
    for g in ("a", "b"):
        own = [(x, y) for k, x, y in rows if k == g]
        pairs = [(sign(a - c), sign(b - d)) for i, (a, b) in enumerate(own) for c, d in own[:i]]
        nx, ny = (sum(p[i] != 0 for p in pairs) for i in (0, 1))
        assert tau[g] == pytest.approx(sum(a * b for a, b in pairs) / math.sqrt(nx * ny))
        ranks = lambda v: [sum(w < u for w in v) + (sum(w == u for w in v) + 1) / 2 for u in v]
        rx, ry = ranks([x for x, _ in own]), ranks([y for _, y in own])
        assert rho[g] == pytest.approx(np.corrcoef(rx, ry)[0, 1])


def test_buckets_never_fall(spark):
    from pyspark.sql import functions as F

    from voicegauge.operators import orderstats

    r = random.Random(2)
    values = [0.0, 1e308, -1e308, float("inf"), -float("inf"), 5e-324, *(s * 2.0**k * (1 + e) for k in range(-60, 61) for e in (-1e-16, 0, 1e-16) for s in (1, -1))]
    values += [r.gauss(0, 10 ** r.randint(-3, 6)) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", orderstats.value_bucket(F.col("v")).alias("b"))
    got = sorted((x.v, x.b) for x in df.collect())
    assert all(a[1] <= b[1] for a, b in zip(got, got[1:], strict=False))


def test_quantiles_and_running_sums(spark):
    from voicegauge.operators import orderstats

    rows, df = _groups(spark, 5)
    qs = {"low": 0.0, "q1": 0.25, "median": 0.5, "p95": 0.95, "top": 1.0}
    got = {r.g: r for r in orderstats.quantiles(df.withColumnRenamed("x", "value"), qs, ("g",)).collect()}
    for g in ("a", "b"):
        x = [v for k, v, _ in rows if k == g]
        assert [got[g][c] for c in qs] == pytest.approx([np.quantile(x, q) for q in qs.values()])
    counted = df.groupBy("g", "y").count()
    sums = orderstats.running_sum(counted, "count", "y", ("g",)).collect()
    for r in sums:
        assert r.upto == sum(1 for k, _, y in rows if k == r.g and y <= r.y)
    assert orderstats.quantiles(df.limit(0).withColumnRenamed("x", "value"), qs, ("g",)).count() == 0
