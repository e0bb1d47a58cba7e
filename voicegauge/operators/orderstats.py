"""Order statistics: distribution-free intervals, average ranks, exact selection in large groups, Holm's step-down."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voicegauge.functions.kernels import _beta_fraction


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k), by the incomplete beta function: its cost doesn't grow with n."""
    if k < 0:
        return 0.0
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1 - p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def interval_ranks(n: int, q: float, confidence: float = 0.95) -> tuple[int | None, int | None]:
    """Ranks (from 1) of the values that bound the q-quantile; None where n is too small for that end."""
    if n < 2 or not 0 < q < 1:
        return None, None
    tail = (1 - confidence) / 2

    def first(ok) -> int:
        low, high = 1, n + 1
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if ok(mid) else (mid + 1, high)
        return low

    below = first(lambda r: binomial_cdf(r - 1, n, q) > tail) - 1
    above = first(lambda r: binomial_cdf(r - 1, n, q) >= 1 - tail)
    return below or None, above if above <= n else None


def _ranks_udf(q: float, confidence: float):
    @F.pandas_udf("low long, high long")
    def ranks(n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([interval_ranks(int(v), q, confidence) for v in n], columns=["low", "high"], dtype="Int64")

    return ranks


def quantile_interval(items: DataFrame, q: float = 0.5, confidence: float = 0.95, by: tuple[str, ...] = ("stage",)) -> DataFrame:
    """(by, n, ci_low, ci_high): order statistics that bracket each group's q-quantile whatever its distribution.

    The two ranks come from a kernel that sees one row a group; which values
    have them, from select_ranks().
    """
    sizes = items.groupBy(*by).agg(F.count("value").alias("n"))
    wanted = sizes.withColumn("r", _ranks_udf(q, confidence)("n")).select(*by, "n", "r.low", "r.high")
    ends = wanted.select(*by, F.explode(F.array(F.struct(F.lit("low").alias("end"), F.col("low").alias("rank")), F.struct(F.lit("high").alias("end"), F.col("high").alias("rank")))).alias("x")).select(*by, "x.end", "x.rank").where("rank is not null")
    found = select_ranks(items, ends, by)
    pair = found.groupBy(*by).agg(F.max(F.when(F.col("end") == "low", F.col("value"))).alias("ci_low"), F.max(F.when(F.col("end") == "high", F.col("value"))).alias("ci_high"))
    return wanted.select(*by, "n").join(pair, list(by), "left")


def value_bucket(value: Column, fine: int = 4096) -> Column:
    """A number that never falls as the value rises: `fine` steps for each doubling, so it divides a group without a look at it."""
    size = F.abs(value.cast("double"))
    power = F.floor(F.log2(size))
    step = (power + 1100) * fine + F.floor((size / F.pow(F.lit(2.0), power) - 1) * fine)
    place = F.when(size < 1e-300, 0).when(size <= 1e300, step).otherwise(2200 * fine).cast("long")
    return F.when(value < 0, -place).otherwise(place)


def running_sum(rows: DataFrame, weight: str, value: str, by: tuple[str, ...]) -> DataFrame:
    """rows with upto: the sum of weight over the rows of its group whose value isn't greater. A value stands once in a group.

    A window runs over one bucket of a group, and the sums of buckets, a
    bounded number of rows a group, give it its start. So no task holds a group.
    """
    by = list(by)
    same = [F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by]
    placed = rows.withColumn("__bucket", value_bucket(F.col(value)))
    sums = placed.groupBy(*by, "__bucket").agg(F.sum(weight).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*by).orderBy("__bucket")) - F.col("__n")
    sums = sums.select(*(F.col(b).alias(f"__{b}") for b in by), F.col("__bucket").alias("__place"), before.alias("__before"))
    own = F.sum(weight).over(Window.partitionBy(*by, "__bucket").orderBy(value))
    out = placed.withColumn("__own", own).join(sums, [*same, F.col("__bucket") == F.col("__place")])
    return out.select(*rows.columns, (F.col("__before") + F.col("__own")).alias("upto"))


def select_ranks(items: DataFrame, wanted: DataFrame, by: tuple[str, ...] = ("stage",)) -> DataFrame:
    """wanted (by, rank, ...) with the value of that rank in its group: exact, and no task holds a group.

    Distinct values are counted first, partially before the shuffle.
    """
    by = list(by)
    counts = items.where("value is not null").groupBy(*by, "value").agg(F.count("*").alias("__t"))
    ends = running_sum(counts, "__t", "value", tuple(by)).select(*by, "value", (F.col("upto") - F.col("__t")).alias("__from"), F.col("upto").alias("__to"))
    return wanted.join(ends, by).where("rank > __from and rank <= __to").drop("__from", "__to")


def quantiles(items: DataFrame, qs: dict[str, float], by: tuple[str, ...] = ("stage",)) -> DataFrame:
    """(by, n, a column for each of qs): exact quantiles of value with linear interpolation, by rank selection; for groups of any size."""
    sizes = items.where("value is not null").groupBy(*by).agg(F.count("*").alias("n"))
    place = lambda q: (F.col("n") - 1) * F.lit(float(q))
    ends = [F.struct(F.lit(c).alias("name"), (f(place(q)) + 1).cast("long").alias("rank")) for c, q in qs.items() for f in (F.floor, F.ceil)]
    wanted = sizes.select(*by, F.explode(F.array_distinct(F.array(*ends))).alias("x")).select(*by, "x.*")
    found = select_ranks(items, wanted, by).groupBy(*by)
    found = found.agg(*(f(F.when(F.col("name") == c, F.col("value"))).alias(f"__{c}_{n}") for c in qs for n, f in (("low", F.min), ("high", F.max))))
    part = lambda q: place(q) - F.floor(place(q))
    value = lambda c, q: F.col(f"__{c}_low") * (1 - part(q)) + F.col(f"__{c}_high") * part(q)
    return sizes.join(found, list(by)).select(*by, "n", *(value(c, q).alias(c) for c, q in qs.items()))


def tie_ranks(df: DataFrame, value: str, by: list[str], counts: dict[str, Column]) -> DataFrame:
    """One row for each distinct value of a group: counts, t (all of them) and the rank they share.

    What the rank tests need of a sample; rows with equal values meet before
    anything is ordered.
    """
    tied = df.groupBy(*by, value).agg(F.count("*").alias("t"), *(c.alias(n) for n, c in counts.items()))
    ranked = running_sum(tied, "t", value, tuple(by))
    return ranked.withColumn("rank", F.col("upto") - (F.col("t") - 1) / F.lit(2.0)).drop("upto")


def holm(df: DataFrame, p: str = "p", family: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> DataFrame:
    """df with p_holm: Holm's adjusted p within each family; rows with a null p take no part. Families are small tables of tests."""
    tests = df.where(F.col(p).isNotNull())
    w = Window.partitionBy(*family)
    step = F.row_number().over(w.orderBy(p, *order))
    scaled = tests.withColumn("__s", F.least(F.lit(1.0), (F.count("*").over(w) - step + 1) * F.col(p)))
    done = scaled.withColumn("p_holm", F.max("__s").over(w.orderBy(p, *order).rowsBetween(Window.unboundedPreceding, 0))).drop("__s")
    return done.unionByName(df.where(F.col(p).isNull()).withColumn("p_holm", F.lit(None).cast("double")))
