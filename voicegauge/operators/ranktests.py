"""Tests of differences between two runs. Statistics are SQL; only tail probabilities go through a kernel, a row a test."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voicegauge.functions.kernels import chi2_tail_1, mean_interval, normal_two_sided, paired_interval, statistic_interval, student_upper_tail
from voicegauge.operators.orderstats import quantiles, running_sum, tie_ranks

Z975 = 1.959963984540054
Z80 = 0.8416212335729143
PAIR_LIMIT = 4_000_000


def signed_rank(pairs: DataFrame, by: tuple[str, ...] = ("stage",), d: str = "d") -> DataFrame:
    """(by, n_pairs, n_zero, n, w_plus, mean, variance, tied) of the Wilcoxon signed-rank statistic; zero differences are dropped."""
    by = list(by)
    sizes = pairs.where(F.col(d).isNotNull()).groupBy(*by).agg(F.count("*").alias("n_pairs"), F.count_if(F.col(d) == 0).alias("n_zero"))
    nonzero = pairs.where(F.col(d) != 0).select(*by, F.abs(d).alias("size"), (F.col(d) > 0).alias("up"))
    ranks = tie_ranks(nonzero, "size", by, {"ups": F.count_if("up")})
    w = ranks.groupBy(*by).agg(F.sum(F.col("ups") * F.col("rank")).alias("w_plus"), F.sum("t").alias("n"), F.sum(F.expr("cast(t as double) * t * t - t")).alias("ties"))
    out = sizes.join(w, by, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    n = F.col("n").cast("double")
    variance = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    return out.select(*by, "n_pairs", "n_zero", "n", F.coalesce("w_plus", F.lit(0.0)).alias("w_plus"), (n * (n + 1) / 4).alias("mean"), F.coalesce(variance, F.lit(0.0)).alias("variance"), (F.coalesce("ties", F.lit(0.0)) > 0).alias("tied"))


def exact_signed_rank_p(w_plus: float, n: int) -> float:
    """Two-sided p without ties, from the number of sign assignments that reach each sum."""
    ways = [1]
    for rank in range(1, n + 1):
        ways = [(ways[s] if s < len(ways) else 0) + (ways[s - rank] if s >= rank else 0) for s in range(len(ways) + rank)]
    below, above = sum(ways[: int(w_plus) + 1]), sum(ways[math.ceil(w_plus) :])
    return min(1.0, 2 * min(below, above) / 2**n)


@F.pandas_udf(T.DoubleType())
def _exact_p(w: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([exact_signed_rank_p(a, int(b)) if pd.notna(a) and b <= 20 else None for a, b in zip(w, n, strict=True)], dtype="float64")


def log_signed_rank(stats: DataFrame) -> DataFrame:
    """stats with z, p and method as the logs use them: null under 6 differences, exact up to 20 without ties, else normal with the continuity correction towards the mean."""
    off = F.col("w_plus") - F.col("mean")
    z = (off - F.signum(off) * F.least(F.lit(0.5), F.abs(off))) / F.sqrt("variance")
    few, exact = F.col("n") < 6, (F.col("n") <= 20) & ~F.col("tied")
    out = stats.withColumn("z", F.when(few | exact | (F.col("variance") <= 0), None).otherwise(z))
    p = F.when(few, None).when(exact, _exact_p("w_plus", F.when(exact, F.col("n")).otherwise(99))).otherwise(normal_two_sided("z"))
    method = F.when(few, "too few non-zero differences").when(exact, "exact").when(F.col("variance") <= 0, "no variation").otherwise("normal")
    return out.withColumn("p", p).withColumn("method", method)


def evaluation_signed_rank(stats: DataFrame) -> DataFrame:
    """stats with statistic, z and p as the evaluation uses them: always normal, and corrected by 0.5 at the mean too; p is 1 without differences or variance."""
    off = F.col("w_plus") - F.col("mean")
    half = F.when(off < 0, -0.5).otherwise(0.5)
    total = F.col("n") * (F.col("n") + 1) / F.lit(2.0)
    z = F.when((F.col("n") > 0) & (F.col("variance") > 0), (off - half) / F.sqrt("variance"))
    out = stats.withColumn("statistic", F.least("w_plus", total - F.col("w_plus"))).withColumn("z", z)
    return out.withColumn("p", F.when(F.col("z").isNull(), 1.0).otherwise(F.least(F.lit(1.0), normal_two_sided("z"))))


def walsh_at(x: np.ndarray, t: np.ndarray, ranks: list[int]) -> list[float]:
    """The averages (x + x') / 2 of the given ranks among all of a sample with itself; x in order, each t times.

    A search over the doubles between the extremes, in the order of their
    bits; each step counts the averages up to a value by one search a value.
    """
    upto = np.concatenate([[0], np.cumsum(t)])

    def count(v: float) -> int:
        at = np.searchsorted(x, 2 * v - x, "right")
        while True:  # rounding can be off by a place
            more = (at < len(x)) & ((x + x[np.minimum(at, len(x) - 1)]) / 2 <= v)
            less = (at > 0) & ((x + x[np.maximum(at - 1, 0)]) / 2 > v)
            if not (more.any() or less.any()):
                break
            at = at + more - less
        return (int((t * upto[at]).sum()) + int(t[x <= v].sum())) // 2

    bits = lambda v: (lambda i: i if i >= 0 else -(1 << 63) - i)(int(np.float64(v).view(np.int64)))
    back = lambda i: float(np.int64(i if i >= 0 else -(1 << 63) - i).view(np.float64))
    out = []
    for rank in ranks:
        low, high = bits(x[0]), bits(x[-1])
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if count(back(mid)) >= rank else (mid + 1, high)
        out.append(back(low))
    return out


def _shift(x: np.ndarray, t: np.ndarray) -> tuple[int, float, float | None, float | None]:
    """(n, shift, ci_low, ci_high) of one group."""
    n = int(t.sum())
    m = n * (n + 1) // 2
    k = math.floor(n * (n + 1) / 4 - Z975 * math.sqrt(n * (n + 1) * (2 * n + 1) / 24))
    ends = [k + 1, m - k] if n >= 2 and 0 <= 2 * k < m else []
    left, right, *ci = walsh_at(x, t, [(m + 1) // 2, (m + 2) // 2, *ends])
    return n, (left + right) / 2, *(ci or (None, None))


def hodges_lehmann(pairs: DataFrame, by: tuple[str, ...] = ("stage",), d: str = "d", least: int = 1_000_000) -> DataFrame:
    """(by, n, shift, ci_low, ci_high): median of the Walsh averages of each group's differences, with the interval of the signed-rank distribution.

    Equal differences are counted first. A group of up to `least` different
    ones is one call of walsh_at(), which needs n log n; larger ones go through
    _large_shifts(). Averages are never written out for all pairs.
    """
    by = list(by)
    values = pairs.where(F.col(d).isNotNull()).groupBy(*by, F.col(d).cast("double").alias("x")).agg(F.count("*").alias("t"))
    sizes = values.groupBy(*by).agg(F.count("*").alias("rows"))
    many = sizes.where(F.col("rows") > least).select(*by)
    kinds = dict(values.dtypes)

    def one(key, pdf):
        pdf = pdf.sort_values("x")
        return pd.DataFrame([[*key, *_shift(pdf["x"].to_numpy(), pdf["t"].to_numpy())]], columns=[*by, "n", "shift", "ci_low", "ci_high"])

    made = ", ".join([*(f"{b} {kinds[b]}" for b in by), "n long, shift double, ci_low double, ci_high double"])
    if many.isEmpty():
        return values.groupBy(*by).applyInPandas(one, made)
    few = values.join(many, by, "left_anti").groupBy(*by).applyInPandas(one, made)
    return few.unionByName(_large_shifts(values.join(many, by, "left_semi"), by))


def _large_shifts(values: DataFrame, by: list[str], most_buckets: int = 4096) -> DataFrame:
    """The same from (by, x, t) without a task that holds a group.

    A group's n differences are cut into about n ** (2/3) buckets of
    neighbours. A pair of buckets bounds its averages from both sides and
    counts them, which brackets the averages of the wanted ranks; only pairs of
    buckets across a bracket are written out, so n ** (4/3) averages instead of
    all n(n+1)/2.
    """
    size = values.groupBy(*by).agg(F.sum("t").alias("n"))
    n = F.col("n").cast("double")
    k = F.floor(n * (n + 1) / 4 - Z975 * F.sqrt(n * (n + 1) * (2 * n + 1) / 24))
    at = size.select(*by, "n", k.alias("k"), (F.col("n") * (F.col("n") + 1) / 2).cast("long").alias("m"))
    ok = (F.col("k") >= 0) & (2 * F.col("k") < F.col("m")) & (F.col("n") >= 2)
    ranks = {"left": F.floor((F.col("m") + 1) / 2), "right": F.floor((F.col("m") + 2) / 2), "low": F.when(ok, F.col("k") + 1), "high": F.when(ok, F.col("m") - F.col("k"))}
    wanted = at.select(*by, F.explode(F.array(*(F.struct(F.lit(e).alias("end"), r.cast("long").alias("rank")) for e, r in ranks.items()))).alias("w")).select(*by, "w.*").where("rank is not null")
    cut = F.least(F.lit(most_buckets), F.ceil(F.pow(F.col("n"), 2 / 3)))
    placed = running_sum(values, "t", "x", tuple(by)).join(size, by)
    placed = placed.select(*by, "x", "t", F.floor((F.col("upto") - F.col("t")) * cut / F.col("n")).alias("bucket"))
    ends = placed.groupBy(*by, "bucket").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("t").alias("w"))
    a, b = (ends.select(*by, *(F.col(c).alias(c + s) for c in ("bucket", "lo", "hi", "w"))) for s in "ab")
    pair = F.when(F.col("bucketa") == F.col("bucketb"), F.col("wa") * (F.col("wa") + 1) / 2).otherwise(F.col("wa") * F.col("wb"))
    grid = a.join(b, by).where("bucketa <= bucketb").select(*by, "bucketa", "bucketb", ((F.col("loa") + F.col("lob")) / 2).alias("lo"), ((F.col("hia") + F.col("hib")) / 2).alias("hi"), pair.cast("long").alias("c"))

    def reached(column):
        """The least bound up to which a rank is reached."""
        sums = running_sum(grid.groupBy(*by, column).agg(F.sum("c").alias("c")), "c", column, tuple(by))
        return wanted.join(sums, by).where("upto >= rank").groupBy(*by, "end", "rank").agg(F.min(column).alias(column))

    bracket = reached("lo").withColumnRenamed("lo", "from").join(reached("hi").withColumnRenamed("hi", "to"), [*by, "end", "rank"])
    cells = grid.join(bracket, by).where("lo <= to")
    below = cells.where("hi < `from`").groupBy(*by, "end").agg(F.sum("c").alias("below"))
    across = cells.where("hi >= `from`").select(*by, "end", "bucketa", "bucketb")
    x, y = (placed.select(*by, *(F.col(c).alias(c + s) for c in ("bucket", "x", "t"))) for s in "ab")
    walsh = across.join(x, [*by, "bucketa"]).join(y, [*by, "bucketb"]).where("xa <= xb")
    weight = F.when(F.col("xa") == F.col("xb"), F.col("ta") * (F.col("ta") + 1) / 2).otherwise(F.col("ta") * F.col("tb")).cast("long")
    walsh = walsh.groupBy(*by, "end", ((F.col("xa") + F.col("xb")) / 2).alias("value")).agg(F.sum(weight).alias("w"))
    ranked = running_sum(walsh, "w", "value", (*by, "end")).join(bracket.select(*by, "end", "rank"), [*by, "end"]).join(below, [*by, "end"], "left")
    found = ranked.where(F.col("upto") + F.coalesce("below", F.lit(0)) >= F.col("rank")).groupBy(*by, "end").agg(F.min("value").alias("value"))
    of = lambda e: F.max(F.when(F.col("end") == e, F.col("value")))
    ends = found.groupBy(*by).agg(((of("left") + of("right")) / 2).alias("shift"), of("low").alias("ci_low"), of("high").alias("ci_high"))
    return size.join(ends, by).select(*by, "n", "shift", "ci_low", "ci_high")


def mann_whitney(rows: DataFrame, by: tuple[str, ...] = ("stage",), side: str = "side", value: str = "value") -> DataFrame:
    """(by, n_a, n_b, u, variance, z, delta) of sides 'a' and 'b'; nulls under three values a side. delta = 2u/(ab) - 1 is Cliff's."""
    by = list(by)
    ranks = tie_ranks(rows.where(F.col(value).isNotNull()), value, by, {"a": F.count_if(F.col(side) == "a")})
    s = ranks.groupBy(*by).agg(F.sum("a").alias("n_a"), F.sum(F.col("t") - F.col("a")).alias("n_b"), F.sum(F.col("a") * F.col("rank")).alias("ra"), F.sum(F.expr("cast(t as double) * t * t - t")).alias("ties"))
    a, b = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    n = a + b
    u = F.col("ra") - a * (a + 1) / 2
    variance = a * b / 12 * ((n + 1) - F.col("ties") / (n * (n - 1)))
    ok = (a >= 3) & (b >= 3) & (variance > 0)
    off = u - a * b / 2
    z = (off - F.signum(off) * F.least(F.lit(0.5), F.abs(off))) / F.sqrt(variance)
    return s.select(*by, "n_a", "n_b", F.when(ok, u).alias("u"), F.when(ok, variance).alias("variance"), F.when(ok, z).alias("z"), F.when(ok, 2 * u / (a * b) - 1).alias("delta"))


def cliffs_delta(rows: DataFrame, by: tuple[str, ...] = ("stage",), side: str = "side", value: str = "value") -> DataFrame:
    """(by, delta) for any sizes, from ranks: as dominance over all pairs, without the pairs."""
    by = list(by)
    ranks = tie_ranks(rows.where(F.col(value).isNotNull()), value, by, {"a": F.count_if(F.col(side) == "a")})
    s = ranks.groupBy(*by).agg(F.sum("a").cast("double").alias("n_a"), F.sum(F.col("t") - F.col("a")).cast("double").alias("n_b"), F.sum(F.col("a") * F.col("rank")).alias("ra"))
    return s.select(*by, F.expr("2 * try_divide(ra - n_a * (n_a + 1) / 2, n_a * n_b) - 1").alias("delta"))


def effect_label(delta: Column) -> Column:
    size = F.abs(delta)
    return F.when(delta.isNull(), "undefined").when(size < 0.147, "negligible").when(size < 0.33, "small").when(size < 0.474, "medium").otherwise("large")


def two_sample_shift(rows: DataFrame, by: tuple[str, ...] = ("stage",), limit: int = PAIR_LIMIT) -> DataFrame:
    """(by, n_a, n_b, shift): median of all differences a - b; beyond `limit` pairs the difference of medians, as the measure is defined."""
    by = list(by)
    sizes = rows.where("value is not null").groupBy(*by).agg(F.count_if(F.col("side") == "a").alias("n_a"), F.count_if(F.col("side") == "b").alias("n_b"))
    medians = quantiles(rows.where(F.col("side").isin("a", "b")), {"m": 0.5}, (*by, "side"))
    for s in "ab":
        sizes = sizes.join(medians.where(F.col("side") == s).select(*by, F.col("m").alias(f"m{s}")), by, "left")
    small = sizes.where(F.col("n_a") * F.col("n_b") <= limit).select(*by)
    own = lambda s: rows.where((F.col("side") == s) & F.col("value").isNotNull()).join(small, by, "left_semi").groupBy(*by, F.col("value").alias(f"x{s}")).agg(F.count("*").alias(f"t{s}"))
    diffs = own("a").join(own("b"), by).select(*by, (F.col("xa") - F.col("xb")).alias("d"), (F.col("ta") * F.col("tb")).alias("w"))
    middle = diffs.groupBy(*by).agg(F.percentile("d", 0.5, F.col("w")).alias("shift"))
    return sizes.join(middle, by, "left").select(*by, "n_a", "n_b", F.coalesce("shift", F.when(F.col("n_a") * F.col("n_b") > limit, F.col("ma") - F.col("mb"))).alias("shift"))


def detectable_shift(pairs: DataFrame, by: tuple[str, ...] = ("stage",), d: str = "d") -> DataFrame:
    """(by, n, mds): the least shift found four times in five at 5 %; null under three pairs, 0 without spread."""
    return pairs.groupBy(*by).agg(F.count(d).alias("n"), F.when(F.count(d) >= 3, (Z975 + Z80) * F.stddev_samp(d) / F.sqrt(F.count(d))).alias("mds"))


def mcnemar(pairs: DataFrame, by: tuple[str, ...] = (), before: str = "before", after: str = "after") -> DataFrame:
    """(by, n, gained, lost, statistic, p) of paired outcomes: exact binomial under 25 changes, else chi-square with continuity; p is 1 without a change."""
    both = pairs.where(F.col(before).isNotNull() & F.col(after).isNotNull())
    s = both.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(~F.col(before) & F.col(after)).alias("gained"), F.count_if(F.col(before) & ~F.col(after)).alias("lost"))
    m, least = F.col("gained") + F.col("lost"), F.least("gained", "lost")
    # sum of binomials up to the lesser count, each from the one before
    tail = F.aggregate(F.sequence(F.lit(0), least), F.struct(F.lit(1.0).alias("c"), F.lit(0.0).alias("s")), lambda a, k: F.struct((a["c"] * (m - k) / (k + 1)).alias("c"), (a["s"] + a["c"]).alias("s")))["s"]
    exact = F.when(m < 25, F.least(F.lit(1.0), 2 * tail / F.pow(F.lit(2.0), m)))
    chi = F.when(m >= 25, F.pow(F.abs(F.col("gained") - F.col("lost")) - 1, 2) / m)
    s = s.withColumn("statistic", F.when(m == 0, 0.0).when(m < 25, least.cast("double")).otherwise(chi)).withColumn("chi", chi)
    return s.withColumn("p", F.when(m == 0, 1.0).when(m < 25, exact).otherwise(chi2_tail_1("chi"))).drop("chi")


def paired_tost(pairs: DataFrame, margin: Column | float, by: tuple[str, ...] = ("stage",), d: str = "d", alpha: float = 0.05) -> DataFrame:
    """(by, n, mean_diff, se, t_lower, t_upper, df, p_lower, p_upper, equivalent): two one-sided tests of differences against +-margin."""
    m = margin if isinstance(margin, Column) else F.lit(float(margin))
    s = pairs.groupBy(*by).agg(F.count(d).alias("n"), F.avg(d).alias("mean_diff"), F.sqrt(F.var_samp(d) / F.count(d)).alias("se"), F.first(m).alias("margin")).where("n >= 2")
    s = s.withColumn("t_lower", F.expr("try_divide(mean_diff + margin, se)")).withColumn("t_upper", F.expr("try_divide(mean_diff - margin, se)")).withColumn("df", (F.col("n") - 1).cast("double"))
    return _tost(s, alpha).select(*by, "n", "mean_diff", "se", "t_lower", "t_upper", "df", "p_lower", "p_upper", "equivalent")


def welch_tost(rows: DataFrame, margin: float, by: tuple[str, ...] = ("stage",), alpha: float = 0.05) -> DataFrame:
    """The same for two independent sides 'a' and 'b' with Satterthwaite's degrees of freedom."""
    side = lambda f, s: f(F.when(F.col("side") == s, F.col("value")))
    s = rows.groupBy(*by).agg(*(side(f, x).alias(f"{n}{x}") for x in "ab" for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp)))).where("na >= 2 and nb >= 2")
    s = s.withColumn("ea", F.col("va") / F.col("na")).withColumn("eb", F.col("vb") / F.col("nb")).withColumn("mean_diff", F.col("ma") - F.col("mb")).withColumn("se", F.sqrt(F.col("ea") + F.col("eb"))).withColumn("margin", F.lit(float(margin)))
    s = s.withColumn("t_lower", F.expr("try_divide(mean_diff + margin, se)")).withColumn("t_upper", F.expr("try_divide(mean_diff - margin, se)"))
    df = F.expr("coalesce(try_divide(pow(ea + eb, 2), ea * ea / (na - 1) + eb * eb / (nb - 1)), na + nb - 2)")
    return _tost(s.withColumn("df", df), alpha).select(*by, F.col("na").alias("n_a"), F.col("nb").alias("n_b"), "mean_diff", "se", "t_lower", "t_upper", "df", "p_lower", "p_upper", "equivalent")


def _tost(s: DataFrame, alpha: float) -> DataFrame:
    inside = F.abs("mean_diff") < F.col("margin")
    flat = F.when(inside, 0.0).otherwise(1.0)
    s = s.withColumn("p_lower", F.when(F.col("se") == 0, flat).otherwise(student_upper_tail("t_lower", "df"))).withColumn("p_upper", F.when(F.col("se") == 0, flat).otherwise(1 - student_upper_tail("t_upper", "df")))
    return s.withColumn("equivalent", (F.col("p_lower") < alpha) & (F.col("p_upper") < alpha))


def _counted(df: DataFrame, x: str, y: str, by: tuple[str, ...]) -> DataFrame:
    """(by, x, y, t): equal pairs, counted."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.groupBy(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.count("*").alias("t"))


def spearman(df: DataFrame, x: str, y: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, n, rho): correlation of average ranks; null under three pairs or without variance."""
    c = _counted(df, x, y, by)
    for v in ("x", "y"):
        ranks = running_sum(c.groupBy(*by, v).agg(F.sum("t").alias("k")), "k", v, by)
        c = c.join(ranks.select(*by, v, (F.col("upto") - (F.col("k") - 1) / 2).alias(f"r{v}")), [*by, v])
    total = lambda e: F.sum(F.expr(f"t * {e}"))
    s = c.groupBy(*by).agg(F.sum("t").alias("n"), *(total(e).alias(a) for a, e in (("sx", "rx"), ("sy", "ry"), ("xy", "rx * ry"), ("xx", "rx * rx"), ("yy", "ry * ry"))))
    own = "(xx - sx * sx / n)", "(yy - sy * sy / n)"
    rho = F.expr(f"case when n >= 3 and {own[0]} > 0 and {own[1]} > 0 then (xy - sx * sy / n) / (sqrt{own[0]} * sqrt{own[1]}) end")
    return s.where("n > 0").select(*by, "n", rho.alias("rho"))


def sign_sum(x: np.ndarray, y: np.ndarray, t: np.ndarray) -> float:
    """Sum of t t' sign(x - x') sign(y - y') over pairs of rows, in n log n.

    Two different ranks of x first differ in some bit. For each bit the rows
    that agree above it are sorted by y together, and running sums of the
    weights on the lower side give what each row of the higher side meets.
    """
    x, y = (np.unique(v, return_inverse=True)[1] for v in (x, y))
    t, out = t.astype(float), 0.0
    for bit in range(int(x.max(initial=0)).bit_length()):
        block, high = x >> (bit + 1), (x >> bit & 1).astype(bool)
        order = np.lexsort((y, block))
        g, v, w, up = block[order], y[order], np.where(high, 0, t)[order], high[order]
        upto = np.cumsum(w)
        new = np.append(True, (g[1:] != g[:-1]) | (v[1:] != v[:-1]))
        first = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        less = (upto - w)[first][run]
        same = np.add.reduceat(w, first)[run]
        begin = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        own = np.cumsum(np.append(False, g[1:] != g[:-1]))
        start, total = (upto - w)[begin][own], np.add.reduceat(w, begin)[own]
        less = less - start
        out += float((t[order] * (less - (total - less - same)))[up].sum())
    return out


def kendall(df: DataFrame, x: str, y: str, by: tuple[str, ...] = (), least: int = 100_000) -> DataFrame:
    """(by, tau): Kendall's tau-b; null without variance.

    A group of up to `least` different pairs is one call of sign_sum(). A
    larger one is cut into bands of x and bands of y: pairs of rows apart in
    both are counted from the cells of the grid, those within a band of x or of
    y by sign_sum(), and those within a cell, counted by both, once less.
    """
    by = list(by)
    c = _counted(df, x, y, tuple(by))
    facts = c.groupBy(*by).agg(F.sum("t").cast("double").alias("n"), F.count("*").alias("rows"), *(F.percentile_approx(v, [i / 64 for i in range(1, 64)], 10_000).alias(f"c{v}") for v in ("x", "y")))
    bands = facts.select(*by, F.least(F.lit(64), F.ceil(F.col("rows") / least)).alias("bands"), "cx", "cy")
    band = lambda v: F.floor(F.size(F.filter(f"c{v}", lambda q: q < F.col(v))) * F.col("bands") / 64)
    c = (c.join(bands, by) if by else c.crossJoin(F.broadcast(bands))).select(*by, "x", "y", "t", "bands", band("x").alias("bx"), band("y").alias("by"))
    kinds = dict(c.dtypes)

    def within(keys, rows):
        def one(key, pdf):
            return pd.DataFrame([[*key, sign_sum(pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["t"].to_numpy())]], columns=[*by, *keys, "s"])

        out = rows.groupBy(*by, *keys).applyInPandas(one, ", ".join([*(f"{k} {kinds[k]}" for k in (*by, *keys)), "s double"]))
        return out.select(*by, "s")

    cut = c.where("bands > 1")
    cells = cut.groupBy(*by, "bx", "by").agg(F.sum("t").cast("double").alias("t"))
    a, b = (cells.select(*by, *(F.col(n).alias(n + s) for n in ("bx", "by", "t"))) for s in "ab")
    apart = (a.join(b, by) if by else a.crossJoin(b)).where("bxa < bxb and bya <> byb")
    parts = within(["bx"], c)
    if not facts.where(F.col("rows") > least).isEmpty():
        parts = parts.union(within(["by"], cut)).union(within(["bx", "by"], cut).select(*by, (-F.col("s")).alias("s")))
        parts = parts.union(apart.select(*by, (F.col("ta") * F.col("tb") * F.signum(F.col("byb") - F.col("bya"))).alias("s")))
    s = parts.groupBy(*by).agg(F.sum("s").alias("s"))
    ties = lambda v: c.groupBy(*by, v).agg(F.sum("t").cast("double").alias("k")).groupBy(*by).agg(F.sum(F.col("k") * (F.col("k") - 1) / 2).alias(f"t{v}"))
    out = facts.select(*by, "n")
    for part in (ties("x"), ties("y"), s):
        out = out.join(part, by) if by else out.crossJoin(part)
    out = out.withColumn("pairs", F.col("n") * (F.col("n") - 1) / 2)
    return out.select(*by, F.when(F.col("n") >= 2, F.expr("try_divide(s, sqrt(pairs - tx) * sqrt(pairs - ty))")).alias("tau"))


def bootstrap_intervals(items: DataFrame, by: tuple[str, ...] = ("stage",), value: str = "value", kind: str = "mean", resamples: int = 2000) -> DataFrame:
    """(by, low, high) by resampling each group; kinds: mean (the logs' generator) or median. A group's values go to one task, in order, so reruns agree."""
    by = list(by)
    kinds = dict(items.dtypes)

    def one(key, pdf):
        values = np.sort(pdf[value].to_numpy())
        low, high = mean_interval(values.tolist(), resamples=resamples) if kind == "mean" else statistic_interval(values, np.median, resamples=resamples)
        return pd.DataFrame([[*key, low, high]], columns=[*by, "low", "high"])

    return items.where(F.col(value).isNotNull()).select(*by, value).groupBy(*by).applyInPandas(one, ", ".join([*(f"{b} {kinds[b]}" for b in by), "low double", "high double"]))


def difference_intervals(pairs: DataFrame, by: tuple[str, ...] = ("stage",), resamples: int = 2000, seed: int = 0) -> DataFrame:
    """(by, ci_low, ci_high) of the mean of b - a over pairs (a, b)."""
    by = list(by)
    kinds = dict(pairs.dtypes)

    def one(key, pdf):
        d = np.sort((pdf["b"] - pdf["a"]).to_numpy())
        low, high = paired_interval(np.zeros(len(d)), d, resamples=resamples, seed=seed)
        return pd.DataFrame([[*key, low, high]], columns=[*by, "ci_low", "ci_high"])

    return pairs.where("a is not null and b is not null").select(*by, "a", "b").groupBy(*by).applyInPandas(one, ", ".join([*(f"{b} {kinds[b]}" for b in by), "ci_low double", "ci_high double"]))


def compare_paired(pairs: DataFrame, by: tuple[str, ...] = ("stage",)) -> DataFrame:
    """One row a group: sizes, medians of both sides, Hodges-Lehmann shift with interval and relative size, p and detectable shift."""
    by = list(by)
    test = log_signed_rank(signed_rank(pairs, tuple(by))).select(*by, "n_pairs", "n_zero", "p", "method")
    sides = pairs.unpivot(by, ["a", "b"], "side", "value")
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("m"))).alias(f"median_{s}")
    medians = quantiles(sides, {"m": 0.5}, (*by, "side")).groupBy(*by).agg(side("a"), side("b"))
    shift, least = hodges_lehmann(pairs, tuple(by)).drop("n"), detectable_shift(pairs, tuple(by)).drop("n")
    return test.join(medians, by).join(shift, by, "left").join(least, by, "left").withColumn("relative_shift", F.expr("try_divide(shift, median_b)"))


