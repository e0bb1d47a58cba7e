"""Pairing runs item by item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, key: str = "key", pos: str = "pos") -> DataFrame:
    """df with occ, the number of each row among those of its key."""
    return df.withColumn("occ", F.row_number().over(Window.partitionBy(key).orderBy(pos)))


def pair_occurrences(base: DataFrame, contrast: DataFrame, key: str = "key", pos: str = "pos") -> DataFrame:
    """(key, occ, base_value, contrast_value): the k-th row of a key with the k-th of the other side; unmatched rows keep a null side."""
    a = numbered(base, key, pos).select(key, "occ", F.col("value").alias("base_value"), F.lit(True).alias("in_base"))
    b = numbered(contrast, key, pos).select(key, "occ", F.col("value").alias("contrast_value"), F.lit(True).alias("in_contrast"))
    return a.join(b, [key, "occ"], "full")


def pair_items(a: DataFrame, b: DataFrame) -> DataFrame:
    """(stage, item, a, b, d): items that both sides have; d = a - b."""
    left, right = a.select("stage", "item", F.col("value").alias("a")), b.select("stage", "item", F.col("value").alias("b"))
    return left.join(right, ["stage", "item"]).withColumn("d", F.col("a") - F.col("b"))


def share_items(a: DataFrame, b: DataFrame) -> bool:
    """Whether any stage has an item on both sides: then the comparison is paired."""
    return not a.select("stage", "item").join(b.select("stage", "item"), ["stage", "item"], "left_semi").limit(1).isEmpty()


def first_match(left: DataFrame, right: DataFrame, keys: list[str], right_key: str, prefix: str = "m_") -> DataFrame:
    """left with right's columns of the first of its keys that right knows; right has one row a key."""
    out = left
    payload = [c for c in right.columns if c != right_key]
    for i, key in enumerate(keys):
        side = right.select(F.col(right_key).alias(f"__k{i}"), F.struct(*payload).alias(f"__v{i}"))
        out = out.join(side, F.col(key) == F.col(f"__k{i}"), "left")
    best = F.coalesce(*(F.col(f"__v{i}") for i in range(len(keys))))
    out = out.withColumn("__best", best)
    out = out.select(*left.columns, *(F.col(f"__best.{c}").alias(f"{prefix}{c}") for c in payload))
    return out


def bounded_history(samples: DataFrame, most: int = 30_000) -> DataFrame:
    """samples (series, at, value) with each series' newest `most` only, as a buffer of that length would hold them."""
    place = F.row_number().over(Window.partitionBy("series").orderBy(F.desc("at")))
    return samples.withColumn("__place", place).where(F.col("__place") <= most).drop("__place")


#: Parts of an integral over time: of finite values, and the times of values, of NaN and of either infinity.
_PARTS = ("area", "known", "nan", "up", "down")


def overlap_means(samples: DataFrame, spans: DataFrame, width_us: int = 3_600_000_000) -> DataFrame:
    """spans (span, start, end) with the time-weighted mean of samples (series, at, value) that cover them; times in microseconds.

    Each sample describes the interval since the one before; of samples at one
    time the least describes it, as the others have no length. The mean is the
    difference of the running integral at the span's ends, so a span costs the
    same however many samples it covers. Ends meet samples in buckets of time;
    what came before a bucket is carried in, so no task holds a series. A span
    that starts before its series' first sample is null.
    """
    bucket = F.floor(F.col("at") / width_us)
    # the sample before, in its own bucket or else the last of an earlier one
    s = samples.groupBy("series", "at").agg(F.min("value").alias("value"), F.count("*").alias("times")).withColumn("b", bucket)
    in_bucket, of_series = Window.partitionBy("series", "b").orderBy("at"), Window.partitionBy("series").orderBy("b")
    bounds = s.groupBy("series", "b").agg(F.min_by(F.struct("at", "value"), "at").alias("head"), F.max("at").alias("last"), F.sum("times").alias("times"))
    bounds = bounds.select("series", "b", "times", "head", F.lag("last").over(of_series).alias("before"), F.lead("head").over(of_series).alias("after"))
    first = bounds.groupBy("series").agg(F.min("head.at").alias("first"), F.sum("times").alias("n"))
    s = s.join(bounds.select("series", "b", "before", "after"), ["series", "b"])
    s = s.withColumn("long", F.coalesce(F.col("at") - F.coalesce(F.lag("at").over(in_bucket), "before"), F.lit(0)))
    s = s.withColumn("next", F.coalesce(F.lead(F.struct("at", "value")).over(in_bucket), "after"))
    s = s.select("series", "b", "at", "next", *(x.alias(n) for n, x in _area(F.col("value"), F.col("long")).items()))
    s = s.select("series", "b", "at", F.struct("at", "next", *(F.sum(n).over(in_bucket).alias(n) for n in _PARTS)).alias("knot"))
    # sums of whole buckets before, and the last sample before, for every bucket that has samples or ends
    ends = spans.select("series", "span", F.col("start").alias("from"), F.explode(F.array(*(F.struct(F.col(c).alias("at"), F.lit(sign).alias("sign")) for c, sign in (("start", -1), ("end", 1))))).alias("x"))
    ends = ends.select("series", "span", "from", "x.*").withColumn("b", bucket)
    none = lambda c: F.lit(None).cast(s.schema[c].dataType).alias(c)
    whole = s.groupBy("series", "b").agg(F.max_by("knot", "at").alias("knot")).unionByName(ends.select("series", "b").distinct().withColumn("knot", none("knot")))
    whole = whole.groupBy("series", "b").agg(F.first("knot", ignorenulls=True).alias("knot"))
    earlier = of_series.rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("series", "b", F.last("knot", ignorenulls=True).over(earlier).alias("carried"), F.struct(*(F.coalesce(F.sum(f"knot.{n}").over(earlier), F.lit(0)).alias(n) for n in _PARTS)).alias("whole"))
    # an end before, a start after a sample of the same time: each sees the last sample before it
    both = s.select("series", "b", "at", F.lit(0).alias("sign"), "knot").withColumns({"span": none_of(spans, "span"), "from": none_of(spans, "start")})
    both = both.unionByName(ends.withColumn("knot", none("knot")))
    seen = F.last("knot", ignorenulls=True).over(Window.partitionBy("series", "b").orderBy("at", F.desc("sign")).rowsBetween(Window.unboundedPreceding, 0))
    at = both.withColumn("own", seen).where("sign <> 0").join(whole, ["series", "b"], "left")
    knot = F.coalesce("own", "carried")
    rest = F.when(knot["next"].isNotNull(), F.col("at") - knot["at"]).otherwise(F.lit(0))
    more = _area(knot["next"]["value"], rest)
    # within the bucket and before it apart: small differences of large sums lose digits
    own = lambda n: F.coalesce(F.col("own")[n], F.lit(0)) + F.coalesce(more[n], F.lit(0))
    at = at.select("series", "span", "from", "sign", (knot["at"] + rest).alias("reached"), *(own(n).alias(n) for n in _PARTS), *(F.col("whole")[n].alias(f"whole_{n}") for n in _PARTS))
    total = lambda c: F.sum(F.col(c) * F.col("sign"))
    out = at.groupBy("series", "span").agg(F.min("from").alias("start"), total("reached").alias("covered"), *((total(n) + total(f"whole_{n}")).alias(n) for n in _PARTS))
    odd = F.when((F.col("nan") > 0) | ((F.col("up") > 0) & (F.col("down") > 0)), F.lit(float("nan"))).when(F.col("up") > 0, F.lit(float("inf"))).when(F.col("down") > 0, F.lit(float("-inf")))
    mean = F.when(F.col("known") > 0, F.coalesce(odd, F.col("area") / F.col("covered")))
    out = out.withColumn("mean", mean).join(first, "series", "left")
    return out.select("series", "span", F.when((F.col("n") >= 2) & (F.col("first") <= F.col("start")), F.col("mean")).alias("mean"))


def none_of(df: DataFrame, c: str) -> Column:
    return F.lit(None).cast(df.schema[c].dataType)


def _area(value: Column, long: Column) -> dict[str, Column]:
    """_PARTS of a value that holds for a time."""
    up, down = value == float("inf"), value == float("-inf")
    finite = value.isNotNull() & ~F.isnan(value) & ~up & ~down
    time = lambda c: F.when(c, long).otherwise(F.lit(0))
    return {"area": F.when(finite, value * long).otherwise(F.lit(0.0)), "known": time(value.isNotNull()), "nan": time(F.isnan(value)), "up": time(up), "down": time(down)}
